"""Completed documents: templates as DOCX packages with answers filled in, a package per row."""

from __future__ import annotations

import copy
import io
import json
import re
import zipfile
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ooxml import BATCH, _control, _legacy, _own, _W, _W14, dealt, packed

_TAG = re.compile(r"\{\{([^{}]+)\}\}")
_REPEAT = re.compile(r"\{\{\s*repeat:\s*([^{}]+?)\s*\}\}", re.IGNORECASE)
#: Ids of row numbers, words for a checked box, prefixes of typed tags.
ROW_NUMBERS = ("row.number", "row.index", "linha.numero", "linha.número")
TRUE = ("1", "true", "yes", "sim", "checked", "marcado", "x", "☑")
PREFIXES = ("checkbox", "date", "dropdown", "single_choice", "default_or_text")


class Unfilled(ValueError):
    """A document that cannot be completed."""


def _true(x) -> bool:
    return x if isinstance(x, bool) else str(x).strip().lower() in TRUE


def filled(token: str, values: dict) -> str | None:
    """What a tag becomes, or null without an answer; a list's answer must be one of its options."""
    head, colon, body = token.strip().partition(":")
    kind = head.strip().casefold() if colon else ""
    if kind not in PREFIXES:
        v = values.get(token.strip())
        return None if v is None else str(v)
    name, *rest = (p.strip() for p in body.split("|"))
    v = values.get(name)
    if kind == "checkbox":
        return None if v is None else "☑" if _true(v) else "☐"
    if kind == "default_or_text" and (v is None or not str(v).strip()):
        return "|".join(rest).strip() or None
    if kind in ("dropdown", "single_choice") and v not in (None, ""):
        options = {p.partition("=>")[2].strip() or p for p in rest if p}
        if options and str(v) not in options:
            raise Unfilled(f"{name}: {v} is not an option")
    return None if v is None else str(v)


def _texts(paragraph) -> list[ElementTree.Element]:
    return [n for n in _own(paragraph) if n.tag == _W + "t"]


def _fill_paragraph(paragraph, values: dict, left: set[str]) -> None:
    """Replace tags from the right; a value goes into the first run of its tag, all other runs keep their texts."""
    nodes = _texts(paragraph)
    parts = [n.text or "" for n in nodes]
    for m in reversed(list(_TAG.finditer("".join(parts)))):
        value = "" if _REPEAT.fullmatch(m[0]) else filled(m[1], values)
        if value is None:
            left.add(m[1].strip())
            continue
        at, first = 0, True
        for i, p in enumerate(parts):
            a, z = max(m.start() - at, 0), min(m.end() - at, len(p))
            at += len(p)
            if a < z:
                parts[i] = p[:a] + (value if first else "") + p[z:]
                first = False
    for n, p in zip(nodes, parts, strict=True):
        n.text = p
        n.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _fill(root, values: dict, left: set[str]) -> None:
    for p in root.iter(_W + "p"):
        _fill_paragraph(p, values, left)
        name = _legacy(p)
        if name and name in values:
            for box in p.iter(_W + "checkBox"):
                for state in box.findall(_W + "checked"):
                    box.remove(state)
                ElementTree.SubElement(box, _W + "checked", {_W + "val": "1" if _true(values[name]) else "0"})
    for sdt in root.iter(_W + "sdt"):
        name, kind, options = _control(sdt)
        if not name or kind is None or values.get(name) is None:
            continue
        value = str(values[name])
        if kind == "checkbox":
            state = sdt.find(f"{_W}sdtPr/{_W14}checkbox/{_W14}checked")
            if state is not None:
                state.set(_W14 + "val", "1" if _true(values[name]) else "0")
            value = "☒" if _true(values[name]) else "☐"
        elif kind == "dropdown" and value and options and value not in options:
            raise Unfilled(f"{name}: {value} is not an option")
        nodes = list(sdt.iter(_W + "t"))
        for n in nodes:
            n.text = ""
        if nodes:
            nodes[0].text = value


def _repeat(root, values: dict) -> None:
    """Rows with a repeat tag become a row for each item; numbers count from 01 unless an item has its own."""
    for table in list(root.iter(_W + "tbl")):
        for row in table.findall(_W + "tr"):
            names = set(_REPEAT.findall("".join(n.text or "" for n in row.iter(_W + "t"))))
            if not names:
                continue
            if len(names) > 1:
                raise Unfilled("a row with several repeat tags")
            name = names.pop().strip()
            items = values.get(name)
            if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
                raise Unfilled(f"{name}: no rows")
            at = list(table).index(row)
            table.remove(row)
            for n, item in enumerate(items, 1):
                made, left = copy.deepcopy(row), set()
                scope = values | {f"{name}.{k.strip()}": v for k, v in item.items()} | dict.fromkeys(ROW_NUMBERS, str(item.get("__row_number__") or f"{n:02d}"))
                _fill(made, scope, left)
                if left:
                    raise Unfilled(f"{name} {n}: " + ", ".join(sorted(left)))
                table.insert(at + n - 1, made)


def _serialized(root: ElementTree.Element, raw: bytes) -> bytes:
    """An edited part with the prefixes and all declarations of its source, also those that only values of attributes name."""
    declared: dict[str, str] = {}
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(raw), events=["start-ns"]):
        declared.setdefault(prefix or "", uri)
    for prefix, uri in declared.items():
        if not re.fullmatch(r"ns\d+", prefix):  # kept by the writer for itself
            ElementTree.register_namespace(prefix, uri)
    out = ElementTree.tostring(root, "unicode")
    end = re.match(r"""<[^\s/>]+(?:[^>"']|"[^"]*"|'[^']*')*?(?=/?>)""", out).end()
    missing = [f' xmlns:{p}="{u}"' for p, u in declared.items() if p and f' xmlns:{p}="' not in out[:end]]
    return f"<?xml version='1.0' encoding='UTF-8' standalone='yes'?>\n{out[:end]}{''.join(missing)}{out[end:]}".encode()


@lru_cache(maxsize=4)
def _members(template: bytes) -> tuple[tuple[str, bytes], ...]:
    """The members of a template, which many rows share: it is unpacked once for those that follow each other."""
    with zipfile.ZipFile(io.BytesIO(template)) as z:
        return tuple((name, z.read(name)) for name in z.namelist())


def generate(template: bytes, values: dict) -> bytes:
    """The template with its repeated rows, tags, controls and legacy boxes filled; ``Unfilled`` if a tag is left."""
    members, left = [], set()
    for name, raw in _members(template):
        if name == "word/document.xml" or (name.startswith(("word/header", "word/footer")) and name.endswith(".xml")):
            root = ElementTree.fromstring(raw)
            _repeat(root, values)
            _fill(root, values, left)
            if left:  # no package comes of it, but what else is left is told
                continue
            raw = _serialized(root, raw)
        members.append((name, raw))
    if left:
        raise Unfilled("left: " + ", ".join(sorted(left)))
    return packed(members)


def documents(df: DataFrame, key: str, template: str, answers: str) -> DataFrame:
    """(key, content, problem): each row's template (binary) filled with its answers (a JSON object); one of the two is null."""
    kept = df.select(F.col(key), F.col(template).alias("g_template"), F.col(answers).alias("g_answers"))
    schema = kept.select(key, F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("problem")).schema

    def one(raw, said):
        try:
            return generate(raw, json.loads(said or "{}")), None
        except (Unfilled, zipfile.BadZipFile, ElementTree.ParseError, json.JSONDecodeError) as e:
            return None, f"{type(e).__name__}: {e}"[:200]

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                made = [one(t, a) for t, a in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], schema.names)

    return dealt(kept).mapInArrow(run, schema)
