"""Queries of the detectors: the records of one form, dealt to every customer, and the fields that must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors
from .forms import table
from .labels import _sql

QUERIES, ORACLES = {}, {}

#: (ordinal, table, row, cell, text, section, context, is_red, has_marker)
FORM = [
    (0, None, None, None, "1. Justificativa", None, None, False, False),
    (1, None, None, None, "A aquisição é necessária para atender a demanda do setor neste ano.", "1. Justificativa", None, False, False),
    (2, None, None, None, "Declaro que li. ☐ Li e concordo", None, None, False, False),
    (3, None, None, None, "☐", None, None, False, False),
    (4, None, None, None, "Tipo: Escolher um item.", None, None, False, False),
    (5, None, None, None, "Selecione uma opção", None, None, False, False),
    (6, None, None, None, "País: Brasil", None, None, False, False),
    (7, None, None, None, "Órgão: Secretaria", None, None, False, False),
    (8, None, None, None, "Prazo: informar o prazo de entrega", None, None, True, False),
    (9, None, None, None, "Objeto: descreva " + "o bem " * 12, None, None, False, False),
    (10, None, None, None, "UF: __ Nome: XXXX e {cliente.nome}", None, None, False, False),
    (11, None, None, None, "Use chaves {assim} no exemplo", None, None, False, False),
    (12, None, None, None, "Valor em R$ ____", None, None, False, True),
    (13, None, None, None, "Descrever a necessidade da contratação", None, "Necessidade", True, False),
    (14, None, None, None, "Descrever a necessidade da contratação", None, None, False, False),
    (15, 0, 0, 0, "Observação / Justificativa", None, None, False, False),
    (16, 0, 0, 0, " ", None, None, False, False),
    (17, 1, 0, 0, "E-mail:", None, None, False, False),
    (18, 1, 0, 1, "servidor@orgao.gov.br", None, None, False, False),
    (19, 1, 0, 2, "Telefone", None, None, False, False),
    (20, 1, 0, 3, "(83) 99999-9999", None, None, False, False),
    (21, 1, 1, 0, "Cargo:", None, None, False, False),
    (22, 1, 1, 1, "Analista", None, None, False, False),
    (23, 1, 1, 2, "Matrícula: ____", None, None, False, False),
    (24, 1, 2, 0, "Setor", None, None, False, False),
    (25, 1, 2, 1, "", None, None, False, False),
    (26, 2, 0, 0, "Item", None, None, False, False),
    (27, 2, 0, 1, "Quantidade", None, None, False, False),
    (28, 2, 1, 0, "Texto livre que o requisitante escreveu sobre o item e sobre a quantidade pedida.", None, None, False, False),
]
#: (ordinal, stage, label, type, confidence, start, end) by hand.
WANT = [
    (1, 8, "Justificativa", "multiline", 0.90, None, None),
    (2, 1, "Declaro que li — Li e concordo", "checkbox", 0.92, 16, 17),
    (4, 3, "Tipo", "dropdown", 0.82, 6, 23),
    (5, 3, "Selecione uma opção", "dropdown", 0.70, 0, 19),
    (6, 4, "País", "text", 0.86, 6, 12),
    (8, 5, "Prazo", "text", 0.90, 7, 34),
    (9, 5, "Objeto", "multiline", 0.82, 8, 89),
    (10, 6, "UF", "text", 0.91, 4, 6),
    (10, 6, "Nome", "text", 0.91, 13, 17),
    (10, 6, "Nome", "text", 0.82, 20, 34),
    (13, 7, "Necessidade", "text", 0.84, None, None),
    (16, 2, "Observação / Justificativa", "multiline", 0.82, None, None),
    (18, 9, "E-mail", "email", 0.88, 0, 21),
    (20, 9, "Telefone", "phone", 0.85, 0, 15),
    (21, 10, "Cargo", "text", 0.82, None, None),
    (23, 6, "Matrícula", "text", 0.91, 11, 15),
    (25, 11, "Setor", "text", 0.84, None, None),
    (28, 8, "Texto editável", "multiline", 0.82, None, None),
]
_SCHEMA = "array<struct<ordinal:int,table_index:int,row_index:int,cell_index:int,text:string,section:string,context:string,is_red:boolean,has_marker:boolean>>"


def _records(spark, sf_dir):
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else _sql(v)
    form = F.expr("cast(array(" + ", ".join("struct(" + ", ".join(lit(v) for v in r) + ")" for r in FORM) + f") as {_SCHEMA})")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.explode(form).alias("r")).select("doc", "r.*")


_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else _sql(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in WANT)


def detector_cascade(spark, sf_dir):
    """Every detector on its own kind of record, and each record claimed once."""
    return detectors.cascade(_records(spark, sf_dir)).select("doc", "ordinal", "stage", "label", "type", "confidence", "start", "end")


QUERIES["detector_cascade"] = detector_cascade
ORACLES["detector_cascade"] = f'SELECT c_custkey AS doc, ordinal, stage, label, type, confidence, start, "end" FROM customer, (VALUES {_VALUES}) AS v(ordinal, stage, label, type, confidence, start, "end")'

#: The fields that those become: position, id, type, whether required, section.
FIELDS = [
    (0, "auto.justificativa", "multiline", True, "Dados do documento"), (1, "auto.declaro_que_li_li_e_concordo", "checkbox", False, "Dados do documento"), (2, "auto.tipo", "dropdown", True, "Dados do documento"), (3, "auto.selecione_uma_opcao", "dropdown", True, "Dados do documento"),
    (4, "auto.pais", "text", True, "Dados do documento"), (5, "auto.prazo", "text", True, "Dados do documento"), (6, "auto.objeto", "multiline", True, "Dados do documento"), (7, "auto.uf", "text", True, "Endereço"), (8, "auto.nome", "text", True, "Dados do documento"), (9, "auto.cliente.nome", "text", True, "Dados do documento"),
    (10, "auto.necessidade", "text", True, "Dados do documento"), (11, "auto.observacao_justificativa", "multiline", True, "Dados do documento"), (12, "auto.e_mail", "email", True, "Dados do documento"), (13, "auto.telefone", "phone", True, "Dados do documento"), (14, "auto.cargo", "text", True, "Dados do documento"),
    (15, "auto.matricula", "text", True, "Dados do documento"), (16, "auto.setor", "text", True, "Dados do documento"), (17, "auto.texto_editavel", "multiline", True, "Dados do documento"),
]


def candidate_fields(spark, sf_dir):
    found = detectors.cascade(_records(spark, sf_dir))
    return detectors.as_fields(found).select("doc", "pos", "field_id", "type", "required", "section")


QUERIES["candidate_fields"] = candidate_fields
ORACLES["candidate_fields"] = "SELECT c_custkey AS doc, pos, field_id, type, required, section FROM customer, (VALUES " + ", ".join(f"({p}, {_sql(i)}, {_sql(t)}, {str(r).upper()}, {_sql(s)})" for p, i, t, r, s in FIELDS) + ") AS v(pos, field_id, type, required, section)"


def applied_tags(spark, sf_dir):
    """Texts with the tags of what was found in them."""
    records = _records(spark, sf_dir)
    found = detectors.cascade(records).filter("ordinal IN (2, 4, 10, 16, 21)")
    tags = found.select("doc", "ordinal", "start", "end", F.concat(F.lit("{{"), F.col("stage").cast("string"), F.lit(":"), F.lower(F.left("label", F.lit(2))), F.lit("}}")).alias("tag"))
    return detectors.apply_spans(records.filter("ordinal IN (2, 3, 4, 10, 16, 21)"), tags).select("doc", "ordinal", "text")


QUERIES["applied_tags"] = applied_tags
ORACLES["applied_tags"] = "SELECT c_custkey AS doc, ordinal, text FROM customer, (VALUES (2, 'Declaro que li. {{1:de}} Li e concordo'), (3, '☐'), (4, 'Tipo: {{3:ti}}'), (10, 'UF: {{6:uf}} Nome: {{6:no}} e {{6:no}}'), (16, '{{2:ob}}'), (21, 'Cargo: {{10:ca}}')) AS v(ordinal, text)"
