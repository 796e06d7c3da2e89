import pytest
from pyspark.sql import functions as F

from quillform.functions import formats, text, types

FORMATS = [
    (formats.cnpj, "12345678000195", "12.345.678/0001-95"), (formats.cpf, "52998224725", "529.982.247-25"), (formats.cep, "58000000", "58000-000"), (formats.phone, "83999998888", "(83) 99999-8888"), (formats.phone, "8333334444", "(83) 3333-4444"),
    (formats.currency, "125050", "R$ 1.250,50"), (formats.currency, "-5", "R$ 0,05"), (formats.currency, "", ""), (formats.currency, None, ""), (formats.decimal, "1.234,5", "1.234,50"), (formats.decimal, "R$ 7", "7,00"), (formats.decimal, "abc", "0,00"), (formats.decimal, "0,125", "0,12"),
    (formats.percentage, "12.50", "12,50%"), (formats.percentage, "007,1%", "7,1%"), (formats.percentage, "", ""), (formats.percentage, "-3,999", "3,99%"), (formats.cnpj, "12", "12"), (formats.cnpj, "123", "12.3"), (formats.cpf, "x", ""), (formats.phone, "83", "83"), (formats.phone, "839", "(83) 9"),
]


@pytest.mark.parametrize(("f", "given", "wanted"), FORMATS)
def test_formats(spark, f, given, wanted):
    assert spark.range(1).select(f(F.lit(given).cast("string")).alias("x")).first().x == wanted


@pytest.mark.parametrize(("f", "given", "wanted"), [(formats.valid_cpf, "529.982.247-25", True), (formats.valid_cpf, "111.111.111-11", False), (formats.valid_cpf, "529.982.247-26", False), (formats.valid_cpf, None, False), (formats.valid_cnpj, "12.345.678/0001-95", True), (formats.valid_cnpj, "00.000.000/0000-00", False), (formats.valid_cnpj, "1", False)])
def test_check_digits(spark, f, given, wanted):
    assert spark.range(1).select(f(F.lit(given).cast("string")).alias("x")).first().x is wanted


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [(text.identity_text, "2.1. Razão Social & Cia", "razao social e cia"), (text.context_text, "2.1. Razão", "2 1 razao"), (text.detection_slug, "3. Data de Início", "data_de_inicio"), (text.semantic_slug, "3. Straße", "3_strasse"), (text.name_key, "  Termo  Nº 5 ", "termo n 5"), (text.safe_name, ' a/b:  c?. ', "a-b- c-"), (text.label_from_id, "company.trade_name", "Company Trade Name"), (text.store_slug, "Olá Mundo", "ola-mundo")],
)
def test_normalisers(spark, f, given, wanted):
    assert spark.range(1).select(f(F.lit(given)).alias("x")).first().x == wanted


@pytest.mark.parametrize(
    ("given", "guessed", "inferred", "suggested"),
    [("empresa.cnpj", "cnpj", "cnpj", "cnpj"), ("signer_cpf", "cpf", "cpf", "cpf"), ("birthdate", "date", "text", "text"), ("form.accepted", "checkbox", "text", "checkbox"), ("item.qty", "integer", "integer", "integer"), ("contract.deadline", "text", "text", "date"), ("zip_code", "text", "text", "cep"), ("valor total", "currency", "text", "currency")],
)
def test_type_cascades_differ_where_they_should(spark, given, guessed, inferred, suggested):
    x = F.lit(given)
    row = spark.range(1).select(types.guess(x).alias("g"), types.infer(x, F.lit("text")).alias("i"), types.suggest(x).alias("s")).first()
    assert (row.g, row.i, row.s) == (guessed, inferred, suggested)


def test_contextual_types_and_aliases(spark):
    df = spark.createDataFrame([("CPF", "000.000.000-00", False), ("Nome", "", True), ("Valor", "R$", False), ("Telefone", "", False)], "label string, mask string, opts boolean")
    got = [(r.t.type, r.t.source, r.t.confidence) for r in df.select(types.contextual(F.col("label"), F.col("mask"), F.col("opts")).alias("t")).collect()]
    assert got == [("cpf", "mask", 0.99), ("dropdown", "options", 1.0), ("currency", "mask", 0.97), ("phone", "label", 0.88)]
    row = spark.range(1).select(types.normalize_type(F.lit(" Money ")).alias("a"), types.normalize_type(F.lit("what")).alias("b"), types.infer(F.lit("x.cpf"), F.lit("Money")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("currency", "text", "currency")


def test_percentage_matches_its_pattern_once(spark):
    df = spark.createDataFrame([("1.234,567 %",), ("1,2,3",), ("1.2.3",), ("-",), (".",), (",5",), ("000",), (None,), ("a",), ("1-2,.-3",)], "x string").select(formats.percentage(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == ["1234,56%", "1,23%", "1,23%", "0%", "0%", "0,5%", "0%", "", "", "12,3%"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
