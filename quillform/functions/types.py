"""Field types: the canonical list, and three rule cascades whose order matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold

#: Canonical types, and other names for them.
CANONICAL = ("text", "multiline", "date", "checkbox", "dropdown", "currency", "integer", "decimal", "percentage", "cnpj", "cpf", "cep", "phone", "email", "repeatable_table")
ALIASES = {"string": "text", "textarea": "multiline", "bool": "checkbox", "boolean": "checkbox", "select": "dropdown", "single_choice": "dropdown", "choice": "dropdown", "money": "currency", "number": "decimal", "int": "integer", "percent": "percentage", "telefone": "phone", "table": "repeatable_table"}

# What the cascades look for.
PHONE = ("phone", "telefone", "celular", "whatsapp", "mobile")
QUANTITY = ("quantidade", "quantity", "qty", "count")
PERCENT = ("percentage", "percentual", "porcentagem", "percent", "aliquota", "alíquota")
MONEY = ("total_value", "valor_total", "valor_estimado", "price", "preco", "preço", "amount", "montante", "currency", "custo_total", "orcamento", "orçamento")
MONEY_SPACED = ("valor total", "valor estimado", "custo total")
LONG_TEXT = ("description", "descricao", "descrição", "object", "objeto", "observation", "observacao", "observação", "observacoes", "observações", "notes", "justification", "justificativa", "fundamentacao", "fundamentação")
GUESS_LONG_TEXT = (*LONG_TEXT, "nota", "details", "detalhes")
SUGGEST_LONG_TEXT = (*LONG_TEXT, "observations", "providencia", "providência")
DATE_LAST = ("date", "data", "issued", "signed", "deadline", "validity")
DATE_COMPACT = ("birthdate", "dataassinatura", "datanascimento", "signingdate")
BOX = ("checkbox.", ".checked", ".selected", ".accepted", ".aceito", ".marcado")
AGREE = ("accepted", "approved", "confirmed", "declaration", "declaracao", "declaração", "checkbox")
CPF = r"(^|[._\-\s])cpf($|[._\-\s])"
CPF_STRICT = r"(^|[._\-])cpf($|[._\-])"
PART = r"[._\-\s/()]+"


def has(x: Column, *needles: str) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(x, F.lit(n))
    return out


def part(x: Column, *names: str) -> Column:
    """Whether a part between separators is one of the names."""
    return F.arrays_overlap(F.split(x, PART), F.array(*[F.lit(n) for n in names]))


def first_of(*rules: tuple[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def normalize_type(kind: Column, otherwise: str = "text") -> Column:
    k = F.trim(casefold(kind))
    mapped = first_of(*[(to, k == name) for name, to in ALIASES.items()], otherwise=k)
    return F.when(mapped.isin(*CANONICAL), mapped).otherwise(otherwise)


def guess(field_id: Column, label: Column | None = None) -> Column:
    """Type of a scanned placeholder from its id and label."""
    ident = F.trim(casefold(field_id))
    x = ident if label is None else F.trim(F.concat_ws(" ", ident, F.trim(casefold(label))))
    compact = F.regexp_replace(x, "[^a-z0-9áàâãéêíóôõúç]", "")
    return first_of(
        ("checkbox", has(ident, *BOX)),
        ("date", part(x, "date", "data") | compact.isin(*DATE_COMPACT)),
        ("multiline", has(x, *GUESS_LONG_TEXT)),
        ("cnpj", has(x, "cnpj")),
        ("cpf", x.rlike(CPF)),
        ("cep", part(x, "cep") | has(x, "postal", "código postal")),
        ("phone", has(x, *PHONE)),
        ("email", has(x, "email", "e-mail")),
        ("currency", has(x, *MONEY, *MONEY_SPACED)),
        ("percentage", has(x, *PERCENT)),
        ("integer", part(x, *QUANTITY)),
        otherwise=F.lit("text"),
    )


def infer(field_id: Column, configured: Column) -> Column:
    """A configured type wins, unless it is text or blank."""
    raw, x = F.trim(casefold(configured)), casefold(field_id)
    return F.when(~raw.isin("text", ""), normalize_type(raw)).otherwise(
        first_of(
            ("cnpj", has(x, "cnpj")),
            ("cpf", x.rlike(CPF_STRICT)),
            ("cep", part(x, "cep") | has(x, "postal")),
            ("phone", has(x, *PHONE)),
            ("email", has(x, "email", "e-mail")),
            ("currency", has(x, *MONEY)),
            ("percentage", has(x, *PERCENT)),
            ("integer", part(x, *QUANTITY)),
            otherwise=F.lit("text"),
        )
    )


def suggest(context: Column) -> Column:
    """Type from free context; a date only by its last word."""
    x = casefold(context)
    last = F.element_at(F.split(F.trim(x), r"[._\-\s]+"), -1)
    return first_of(
        ("cnpj", has(x, "cnpj")),
        ("cpf", x.rlike(CPF)),
        ("email", has(x, "email", "e-mail")),
        ("phone", has(x, *PHONE)),
        ("cep", part(x, "cep") | has(x, "postal", "zip_code")),
        ("date", last.isin(*DATE_LAST) | F.endswith(x, F.lit(".date"))),
        ("percentage", has(x, *PERCENT, "tax_rate")),
        ("currency", has(x, *MONEY, *MONEY_SPACED)),
        ("integer", part(x, *QUANTITY)),
        ("multiline", has(x, *SUGGEST_LONG_TEXT)),
        ("checkbox", has(x, *AGREE)),
        otherwise=F.lit("text"),
    )


# Masks that betray a type, in the order they are tried, with the confidence in each.
MASKS = (("cpf", r"000\.?000\.?000-?00", 0.99), ("cnpj", r"00\.?000\.?000/?0000-?00", 0.99), ("cep", r"00000-?000", 0.98), ("phone", r"\(00\)\s?0{4,5}-?0{4}", 0.98), ("date", r"(?:dd/mm/aaaa|__/__/____)", 0.98), ("currency", r"r\$", 0.97), ("percentage", r"%", 0.97))


def contextual(label: Column, placeholder: Column, has_options: Column) -> Column:
    """STRUCT<type, source, confidence>: options, then masks, then the label."""
    x = F.regexp_replace(casefold(placeholder), "[0-9]", "0")
    struct = lambda t, s, c: F.struct(t.alias("type"), F.lit(s).alias("source"), F.lit(c).cast("double").alias("confidence"))
    out = struct(suggest(label), "label", 0.88)
    for kind, pattern, sure in reversed(MASKS):
        out = F.when(x.rlike(pattern), struct(F.lit(kind), "mask", sure)).otherwise(out)
    return F.when(has_options, struct(F.lit("dropdown"), "options", 1.0)).otherwise(out)
