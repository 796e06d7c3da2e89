"""Text normalisers; each is a Column expression. They differ on purpose: see the docstrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def bound(x: Column, then) -> Column:
    """``then`` of a value that is evaluated once, however often ``then`` reads it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def text(x: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(x.cast("string"), F.lit(""))


def digits_only(x: Column) -> Column:
    return F.regexp_replace(text(x), r"\D+", "")


def casefold(x: Column) -> Column:
    return F.replace(F.lower(text(x)), F.lit("ß"), F.lit("ss"))


def fold(x: Column) -> Column:
    """Casefolded without accents."""
    return F.lower(F.translate(casefold(x), ACCENTED, PLAIN))


def without_number(x: Column) -> Column:
    """Drop a leading section number such as ``2.1.``."""
    return F.regexp_replace(x, r"^\s*\d+(?:\.\d+)*\.?\s*", "")


def squeeze(x: Column, by: str) -> Column:
    """Runs of anything but a-z and 0-9 become one separator, none at the ends."""
    joined = F.regexp_replace(x, "[^a-z0-9]+", by)
    return F.trim(joined) if by == " " else F.regexp_replace(joined, f"^{by}+|{by}+$", "")


def identity_text(x: Column) -> Column:
    """Profile identity: section number dropped, ``&`` read as ``e``."""
    return squeeze(F.replace(without_number(fold(x)), F.lit("&"), F.lit(" e ")), " ")


def context_text(x: Column) -> Column:
    """As identity_text, but the section number stays."""
    return squeeze(F.replace(fold(x), F.lit("&"), F.lit(" e ")), " ")


def detection_slug(x: Column) -> Column:
    return squeeze(without_number(fold(x)), "_")


def semantic_slug(x: Column) -> Column:
    """As detection_slug, but the section number stays."""
    return squeeze(fold(x), "_")


def name_key(x: Column) -> Column:
    """Template names: numbers stay, ``&`` is no word."""
    return squeeze(fold(x), " ")


def store_slug(x: Column) -> Column:
    return squeeze(fold(x), "-")


def label_from_id(x: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.translate(text(x), "._-", "   "), r"\s+", " ")))


def safe_name(x: Column) -> Column:
    """A file name without reserved characters; runs of blanks become one, none or dots at the ends."""
    clean = F.regexp_replace(F.regexp_replace(text(x), r'[<>:"/\\|?*]', "-"), r"\s+", " ")
    return F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")


def safe_filename(x: Column, otherwise: str = "generated_document.docx") -> Column:
    clean = safe_name(x)
    return F.when(clean == "", otherwise).otherwise(clean)


def safe_segment(x: Column) -> Column:
    return F.left(safe_name(x), F.lit(120))


def is_empty(x: Column) -> Column:
    """Null or blank; 0 and false are values."""
    return x.isNull() | (F.trim(x.cast("string")) == "")


def truthy(x: Column, more: tuple[str, ...] = ()) -> Column:
    """Words that stand for true; consumers add their own."""
    return F.lower(F.trim(text(x))).isin("1", "true", "yes", "sim", "checked", *more)


#: What the document generator and a pasted table also take for true.
GENERATOR_TRUE = ("marcado", "x", "☑")
PASTE_TRUE = ("marcado", "x", "☑", "s")
