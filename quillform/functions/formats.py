"""Brazilian masks, localised numbers and check digits as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits_only, text


def mask(digits: Column, cuts: list[tuple[int, str]], size: int) -> Column:
    """Progressive mask: each separator appears once there are digits beyond its cut; more than ``size`` are dropped."""
    kept, out, begin = F.left(digits, F.lit(size)), F.lit(""), 0
    for at, sep in [*cuts, (size, "")]:
        part = F.substring(kept, begin + 1, at - begin)
        out = F.concat(out, part, F.when(F.length(kept) > at, F.lit(sep)).otherwise(F.lit("")))
        begin = at
    return out


def cnpj(x: Column) -> Column:
    return mask(digits_only(x), [(2, "."), (5, "."), (8, "/"), (12, "-")], 14)


def cpf(x: Column) -> Column:
    return mask(digits_only(x), [(3, "."), (6, "."), (9, "-")], 11)


def cep(x: Column) -> Column:
    return mask(digits_only(x), [(5, "-")], 8)


def phone(x: Column) -> Column:
    d = F.left(digits_only(x), F.lit(11))
    head = F.when(F.length(d) > 10, 7).otherwise(6)
    tail = F.substring(d, F.lit(3), F.length(d))
    middle = F.when(F.length(d) > head, F.concat(F.substring(d, F.lit(3), head - 2), F.lit("-"), F.substring(d, head + 1, F.lit(11)))).otherwise(tail)
    return F.when(F.length(d) <= 2, d).otherwise(F.concat(F.lit("("), F.left(d, F.lit(2)), F.lit(") "), middle))


def _swap(x: Column) -> Column:
    """Thousands and decimal separators change places."""
    return F.translate(x, ",.", ".,")


def currency(x: Column) -> Column:
    """Digits are cents, whatever else stands there."""
    d = digits_only(x)
    return F.when(d == "", "").otherwise(F.concat(F.lit("R$ "), _swap(F.format_number(F.try_divide(d.cast("decimal(36,0)"), F.lit(100)).cast("decimal(38,2)"), 2))))


def localized(x: Column) -> Column:
    """A number written with a decimal comma or point: null if it is none, 0 if blank."""
    t = F.trim(F.replace(F.replace(F.trim(text(x)), F.lit("R$"), F.lit("")), F.lit("%"), F.lit("")))
    plain = F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(t == "", F.lit(0).cast("decimal(38,18)")).otherwise(plain.try_cast("decimal(38,18)"))


def decimal(x: Column, places: int = 2) -> Column:
    """Localised with ``places`` decimals; what is no number is read again without letters, or stays as it is."""
    t = F.trim(text(x))
    number = F.coalesce(localized(t), localized(F.regexp_replace(t, "[^0-9,.-]", "")))
    return F.when(t == "", "").otherwise(F.coalesce(_swap(F.format_number(number, places)), t))


def percentage(x: Column) -> Column:
    """Two decimals at most, cut off; the sign is dropped."""
    t = F.regexp_replace(F.trim(F.replace(text(x), F.lit("%"), F.lit(""))), "[^0-9,.-]", "")

    def split(v: Column) -> Column:
        """Digits before the first comma and up to two behind it, from a text of digits and commas."""
        whole = F.substring_index(v, ",", 1)
        few = F.left(F.replace(F.substring(v, F.char_length(whole) + 2, F.char_length(v)), F.lit(","), F.lit("")), F.lit(2))
        return F.struct(F.ltrim(whole, F.lit("0")).alias("big"), few.alias("few"))

    # Values that several conditions read are bound once, as the one element of an array: written out, the pattern ran for each of them.
    once = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    comma = lambda v: F.when(F.contains(v, F.lit(",")), F.translate(v, ".-", "")).otherwise(F.translate(v, ".-", ","))
    written = lambda p: F.concat(F.when(p["big"] == "", "0").otherwise(p["big"]), F.when(p["few"] != "", F.concat(F.lit(","), p["few"])).otherwise(F.lit("")), F.lit("%"))
    return once(t, lambda v: F.when(v == "", "").otherwise(once(once(comma(v), split), written)))


def _weighted(digits: Column, weights: list[int]) -> Column:
    """Sum of the leading digits by their weights."""
    return sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def _plausible(d: Column, size: int) -> Column:
    return (F.length(d) == size) & (F.replace(d, F.left(d, F.lit(1)), F.lit("")) != "")


def valid_cpf(x: Column) -> Column:
    d = digits_only(x)
    first = _weighted(d, list(range(10, 1, -1))) * 10 % 11 % 10
    second = _weighted(d, list(range(11, 1, -1))) * 10 % 11 % 10
    return F.when(_plausible(d, 11), (F.substring(d, 10, 1).cast("int") == first) & (F.substring(d, 11, 1).cast("int") == second)).otherwise(F.lit(False))


def valid_cnpj(x: Column) -> Column:
    d = digits_only(x)

    def digit(weights: list[int]) -> Column:
        rest = _weighted(d, weights) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest)

    tail = [9, 8, 7, 6, 5, 4, 3, 2]
    first, second = digit([5, 4, 3, 2, *tail]), digit([6, 5, 4, 3, 2, *tail])
    return F.when(_plausible(d, 14), (F.substring(d, 13, 1).cast("int") == first) & (F.substring(d, 14, 1).cast("int") == second)).otherwise(F.lit(False))


#: Type -> formatter; other types keep their text, dates and choices are not reformatted.
FORMATTERS = {"cnpj": cnpj, "cpf": cpf, "cep": cep, "phone": phone, "currency": currency, "decimal": decimal, "percentage": percentage, "integer": digits_only}


def format_by_type(kind: Column, x: Column) -> Column:
    out = text(x)
    for name, f in FORMATTERS.items():
        out = F.when(kind == name, f(x)).otherwise(out)
    return out


def sample(kind: Column) -> Column:
    """A sample value for each type; dates take theirs from the caller."""
    # Fixed values.
    samples = {"cnpj": "12.345.678/0001-95", "cpf": "529.982.247-25", "cep": "58000-000", "phone": "(83) 99999-8888", "email": "nome@exemplo.com", "currency": "R$ 1.250,50", "integer": "10", "decimal": "10,50", "percentage": "12,50%"}
    out = F.lit("Texto de exemplo")
    for name, value in samples.items():
        out = F.when(kind == name, value).otherwise(out)
    return out
