"""Missing metadata from evidence."""

from quillform.operators import evidence

SCHEMA = (
    "doc int, pos int, field_id string, label string, label_source string, section string, type string, type_source string, placeholder string, default_value string, options array<string>, profile_identity string, "
    "choice_group_label string, layout_group_label string, layout_row_label string, layout_column string, profile_key string"
)


def resolve(spark, *given):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(({"doc": 1, "pos": k} | g).get(n) for n in names) for k, g in enumerate(given)], SCHEMA)
    return sorted(evidence.resolve(df).collect(), key=lambda r: r.pos)


def test_labels_ids_types_and_identities(spark):
    a, b, c, d = resolve(
        spark, {"layout_row_label": "Valor total:", "layout_column": "Coluna", "section": "3. Dados"}, {"field_id": "x", "label": "Nome", "type": "date", "profile_identity": "p"}, {"label": "Campo livre", "options": ["A", " "]}, {}
    )
    assert (a.label, a.label_source, a.type, a.id_source, a.profile_identity) == ("Valor total", "context_resolver", "currency", "context_resolver", "dados.valor_total:currency")
    assert a.field_id == "valor_total" and a.evidence["label"].source == "row_label" and a.context_confidence == 0.918
    assert (b.field_id, b.type, dict(b.evidence), b.context_confidence) == ("x", "date", {}, None)
    assert (c.type, c.type_source, c.evidence["type"].confidence) == ("dropdown", "context_resolver", 1.0)
    assert (d.label, d.field_id, d.context_confidence) == (None, None, None)


def test_shapes_come_before_words_and_settled_types_stay(spark):
    kinds = [r.type for r in resolve(spark, *[{"field_id": f"f{k}", "label": "Data", "placeholder": p} for k, p in enumerate(["000.000.000-00", "XX.XXX.XXX/XXXX-XX", "a@b.c", "(83) 99999-9999", "_/_/____", "01/02/2024", "R$ 0,00", None])])]
    assert kinds == ["cpf", "cnpj", "email", "phone", "date", "date", "currency", "date"]
    (r,) = resolve(spark, {"field_id": "a", "label": "CPF", "type": "text", "type_source": "manual"})
    assert r.type == "text" and set(r.evidence) == {"profile_identity"}
    sure = [r.evidence["type"].confidence for r in resolve(spark, *[{"field_id": f"f{k}", "label": x} for k, x in enumerate(["CNPJ", "E-mail", "Telefone", "Custo", "Alíquota", "Qtd", "Observação"])])]
    assert sure == [0.99, 0.98, 0.97, 0.92, 0.94, 0.88, 0.88]


def test_ids_are_free_in_their_document(spark):
    got = resolve(spark, {"label": "Nome", "section": "1. Sócio"}, {"field_id": "cidade", "label": "x"}, {"label": "Cidade", "section": "2. Sede"}, {"label": "Cidade", "section": "2. Sede"}, {"label": "Bairro"}, {"label": "Bairro"}, {"label": "Bairro"})
    # A general label takes its section first.
    assert [r.field_id for r in got] == ["socio.nome", "cidade", "sede.cidade", "sede.cidade_2", "bairro", "bairro_2", "bairro_3"]


def test_fields_with_ids_are_not_joined(spark):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    fields = spark.createDataFrame([(1, k, *[None] * (len(names) - 2)) for k in range(3)], SCHEMA).selectExpr(*["'f' AS field_id" if n == "field_id" else n for n in names])
    out = evidence.resolve(fields)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and {r.field_id for r in out.collect()} == {"f"}
