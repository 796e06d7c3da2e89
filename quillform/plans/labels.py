"""Queries on labels and ids: hand-written cases dealt to customers, with the expected values written out in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import labels
from .forms import table

QUERIES, ORACLES = {}, {}


def _sql(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def cases(name: str, build: Callable[..., Column], *rows: tuple) -> None:
    """Register a query: customer k has row k modulo the number of rows; the last element of a row is what comes out."""
    n, width = len(rows), len(rows[0]) - 1

    def run(spark, sf_dir):
        at = (F.col("c_custkey") % n).cast("int")
        given = table(spark, sf_dir, "customer").select("c_custkey", *[F.get(F.array(*[F.lit(r[k]).cast("string") for r in rows]), at).alias(f"a{k}") for k in range(width)])
        return given.select("c_custkey", build(*[F.col(f"a{k}") for k in range(width)]).cast("string").alias("got"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT c_custkey, CASE c_custkey % {n} " + " ".join(f"WHEN {i} THEN {_sql(r[-1])}" for i, r in enumerate(rows)) + " END AS got FROM customer"


cases("label_clean", labels.clean, ("  2.1.  Nome\n completo : ", "Nome completo"), ("Data —", "Data"), (None, ""), ("3 Prazo：", "Prazo"), ("Órgão gestor:", "Órgão gestor"), ("::", ""))
cases(
    "label_before_tag", labels.before_tag, ("Órgão: ", "Órgão"), ("texto corrido ", ""), ("linha um\n• Nome completo – ", "Nome completo"), ("1) Data: ", "Data"), ("Frase. Com. Pontos: ", ""), ("x" * 101 + ":", ""), ("", ""), (":", ""), ("{{a}} Cargo: ", ""), ("Não é rótulo?:", ""),
)
cases("label_reasonable", labels.reasonable, ("Nome", "true"), ("A", "false"), ("1 2 3", "false"), ("OU", "false"), ("{{campo}} x", "false"), (" CPF: ", "true"), ("x" * 151, "false"), ("12 de abril", "true"))
cases("label_section", labels.is_section, ("1. Dados gerais", "true"), ("2.3 Objeto", "true"), ("Justificativa:", "true"), ("Nome", "false"), ("", "false"), ("1." + "x" * 200, "false"), ("10", "false"))
cases("label_page_header", labels.is_page_header, ("SECRETARIA DE ESTADO da saúde CEP: 58000", "true"), ("Governo da Paraíba", "false"), ("CEP: 1", "false"), ("Governo da Paraíba - Sistema Integrado de Gerenciamento", "true"))
cases(
    "fill_whole", labels.is_fill, ("", "true"), ("____", "true"), ("R$ ____", "true"), ("CPF: ___", "false"), ("☐ Sim ☐ Não", "true"), ("(00) 00000-0000", "true"), ("XXXX", "true"), ("Selecione um item.", "true"), ("teste@exemplo.com", "true"), ("000.000.000-00", "true"), ("nada", "false"), ("XX", "false"), ("( ) Sim", "true"),
)
cases("fill_anywhere", labels.has_fill, ("CPF: ___", "true"), ("texto", "false"), ("", "true"), ("veja {{tag}}", "true"), ("opção ☑ dada", "true"), ("valor R$ 00,00 aqui", "true"), ("escolher uma opção", "true"), ("escolher uma opção agora", "false"))
cases("label_local", labels.local, ("UF: ", "UF"), ("um; Matrícula: ", "Matrícula"), (" | Cargo — ", "Cargo"), ("OU", ""), ("1. Nome do setor：", "Nome do setor"), ("___", ""))
cases(
    "label_instruction", labels.instruction, ("Informar o prazo de entrega", "O prazo de entrega"), ("descreva", "Descreva"), ("", "Campo a preencher"), ("INDIQUE a unidade", "A unidade"),
    ("Justificar " + "a" * 80, "A" + "a" * 72 + "…"),
)
cases(
    "label_short_choice", labels.short_choice, ("Não se aplica ao caso", "Não se aplica"), ("O provável valor não ser superior ao limite", "Valor abaixo do limite"), ("Demandas supervenientes (art. 13)", "Demanda superveniente"), ("Situação emergencial", "Emergência ou calamidade"),
    ("Contém informação sigilosa", "Informações sigilosas"), ("Será verificado posteriormente", "Análise administrativa posterior"), ("Primeira frase. Segunda frase.", "Primeira frase."), ("b" * 90, "b" * 85 + "…"), ("b" * 88, "b" * 88),
)
cases("id_humanize", labels.humanize, ("auto.nome_completo", "Nome completo"), ("a.b-c", "B c"), ("x", "X"), ("", ""), ("Ábaco.ção_1", "Ção 1"))
cases("id_label", labels.from_id, ("nome_completo", "Nome Completo"), ("valor", "Conteúdo"), (" FIELD ", "Campo a preencher"), ("a1b.c-d", "A1B C D"), ("órgão.uf", "Órgão Uf"), ("o'neil", "O'Neil"))
cases("id_from_label", labels.field_id, ("1.2 Nome do Órgão", "auto.nome_do_orgao"), ("", "auto.campo"), ("2024 - Ano", "auto.ano"), ("Nº 5º", "auto.n_5"), ("x" * 80, "auto." + "x" * 72), ("(3ª via)", "auto.campo_3_via"))
cases("id_from_braces", labels.legacy_id, ("Descrição.Demanda", "auto.descricao.demanda"), ("a  b--c", "auto.a_b--c"), ("9x", "auto.campo_9x"), ("...", "auto.campo"), ("a__b_", "auto.a_b"))
cases(
    "id_profile_identity", labels.profile_identity, ("Nome Completo", "1. Dados", "text", "dados.nome_completo:text"), ("CPF", "", "cpf", "cpf:cpf"), ("", "Dados", "text", ""), ("2º nome", None, "", "campo_2_nome:text"), ("A & B", "3) Geral", "date", "geral.a_e_b:date"),
)
cases(
    "id_context", lambda a, b, t, i: F.array_join(labels.context_ids(a, b, t, i.cast("int")), ","), ("Nome", "1. Servidor", "text", "1", "servidor.nome,nome"), ("Matrícula", "Servidor", "text", "1", "matricula,servidor.matricula"), ("Data", "", "date", "1", "data"), ("", "x", "date", "3", "auto_word.date_03"), ("", "", "", "0", "auto_word.campo_01"),
    ("Não", "2 Parecer", "checkbox", "1", "parecer.nao,nao"),
)
cases(
    "id_section", labels.suggest_section, ("company.name", "Empresa / Fornecedor"), ("cliente.cidade", "Endereço"), ("contrato.numero", "Processo / Contrato"), ("DATA", "Documento"), ("assinatura", "Assinaturas"), ("nome", "Dados do documento"), ("responsável", "Assinaturas"), ("status_uf", "Endereço"), ("estatuto", "Dados do documento"),
)
cases("id_profile_key", labels.suggest_profile_key, ("empresa.cnpj", "company.cnpj"), ("Fornecedor_nome-fantasia", "supplier.nome.fantasia"), ("cliente.nome", ""), ("", ""), ("responsavel", "signatory"), ("..address", "address"))
cases(
    "part_names", labels.part_name, ("word/document.xml", "Corpo / tabelas / caixas de texto"), ("word/header2.xml", "Cabeçalho"), ("word/footer1.xml", "Rodapé"), ("word/footnotes.xml", "Notas de rodapé"), ("word/endnotes.xml", "Notas finais"), ("comments.xml", "Comentários"), ("word/styles.xml", "styles.xml"),
)
cases(
    "process_numbers", lambda k1, v1, k2, v2: labels.process_number(F.map_from_arrays(F.array(k1, k2), F.array(v1, v2))), ("processo", "12", "process.number", "34", "34"), ("a", "1", "meu_processo_numero", "9", "9"), ("a", "1", "b", "2", ""), ("processo", "", "Process Number X", "7", "7"), ("process_number", "5", "processo.numero", "6", "5"),
)
cases(
    "assisted_fields", lambda s, t, i, f: labels.is_assisted(s, t.cast("boolean"), i, f), (" Automatic ", "false", "", "x", "true"), ("manual", "true", "", "x", "true"), ("", "false", "context_resolver", "x", "true"), ("", "false", "", "AUTO.nome", "true"), (None, None, None, "nome", "false"), ("assisted", "false", "", "automovel", "false"),
)
cases(
    "validation_hints", lambda c, t, m: labels.hint(c, t, m.cast("int")), ("Meu aviso", "cpf", None, "Meu aviso"), ("", "cpf", None, "Formato esperado: 000.000.000-00"), (None, "repeatable_table", "2", "Adicione pelo menos 2 item(ns). É possível colar linhas copiadas do Excel."), ("", "repeatable_table", "0", "Adicione, duplique, remova ou cole linhas conforme necessário."),
    (" ", "text", None, ""), ("", "email", None, "Exemplo: nome@orgao.gov.br"), ("", "repeatable_table", None, "Adicione pelo menos 1 item(ns). É possível colar linhas copiadas do Excel."),
)
cases("option_types", labels.supports_options, ("dropdown", "true"), (" DropDown ", "true"), ("text", "false"), (None, "false"))
cases("layout_ints", lambda x, d: labels.layout_int(x, d.cast("int")), ("3", "1", "3"), (" 7 ", "1", "7"), ("x", "12", "12"), (None, "2", "2"), ("-4", "1", "-4"))
cases("column_keys", labels.column_label_key, ("Descrição (item)", "descrição item"), ("  Nº ", "n"), ("A/B", "a b"), ("", ""))
cases(
    "mask_types", lambda m, x: labels.mask_type(m, x), ("__/__/____", "x", "date"), ("(00) 00000-0000", "x", "phone"), ("000.000.000-00", "x", "cpf"), ("R$ XXX,XX", "x", "currency"), ("teste@empresa.com", "x", "email"), ("____", "CPF do servidor", "cpf"), ("____", "Item 1 Observação", "text"), ("_" * 30, "Item 1 Observação", "multiline"), ("XXXX", "Nome", "text"), ("__/__/____", "Observação curta", "text"),
)
cases(
    "column_types", lambda h, a, b: labels.column_type(h, F.array(a, b)), ("Prazo", "texto", "__/__/____", "date"), ("Quantidade", "", "", "integer"), ("Nome", "x", "y", "text"), ("Contato", "(00) 0000-0000", "__/__/____", "phone"),
)
cases("labels_poor", labels.is_poor, ("", "true"), ("Campo 12", "true"), ("Item", "true"), ("Descrição", "true"), ("Item do contrato", "false"), ("Nome", "false"), ("campo", "true"), ("field x", "false"))
cases("labels_equivalent", labels.equivalent, ("Nome completo", "NOME", "true"), ("Data", "Cargo", "false"), ("", "x", "false"), ("Órgão", "orgao gestor", "true"), ("...", "a", "false"))
cases(
    "types_supported", labels.supports_type, ("date", "Data", "", "true"), ("date", "Prazo", "__/__/____", "true"), ("date", "Prazo", "", "false"), ("phone", "x", "(00)", "true"), ("email", "E-mail", "", "true"), ("cpf", "Documento", "000", "false"), ("dropdown", "x", "Escolher", "true"), ("checkbox", "x", "☐", "true"), ("text", "", "", "true"), ("cnpj", "CNPJ da empresa", "", "true"),
)
cases(
    "tags_for_fields", lambda t, i, a, b, c: labels.tag_for(t, i, F.filter(F.array(*[F.when(x.isNotNull(), F.struct(F.split(x, "=")[0].alias("label"), F.element_at(F.split(x, "="), -1).alias("value"))) for x in (a, b)]), lambda x: x.isNotNull()), c.cast("boolean")),
    ("date", "d", None, None, "false", "{{date:d}}"), ("checkbox", "c", None, None, "false", "{{checkbox:c}}"), ("text", "t.x", None, None, "false", "{{t.x}}"), ("dropdown", "o", "Sim", "Não=nao", "false", "{{dropdown:o|Sim|Não => nao}}"), ("dropdown", "o", "a|b", "c", "true", "{{single_choice:o|a / b|c}}"),
    ("dropdown", "o", "a", None, "false", None), ("text", " ", None, None, "false", None), ("dropdown", "o", "a}}", "b", "false", None), ("dropdown", "o", " ", "b", "false", None),
)
cases("choice_labels", labels.clean_choice, (" Sim : ", "Sim"), ("x" * 141, ""), ("{{a}}", ""), ("Não – ", "Não"))
