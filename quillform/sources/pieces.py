"""Text nodes of DOCX packages as rows, and changed nodes back into their bytes.

Nothing but the changed nodes is written anew: a part's bytes are copied up to a node, the node's text is put in, and all else
(names, prefixes, declarations, formatting) stays as it was, byte by byte.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ooxml import _W, BATCH, _escaped

_MAIN = _W[1:-1] + " "
_FALLBACK = "http://schemas.openxmlformats.org/markup-compatibility/2006 Fallback"
_NODE = "doc string, ordinal int, node int, kind string, text string"
_TAG_END = re.compile(rb"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")


def parts(package: zipfile.ZipFile) -> list[str]:
    """The parts with text: the document, then headers and footers by name."""
    names = package.namelist()
    return [n for n in names if n == "word/document.xml"] + sorted(n for n in names if re.fullmatch(r"word/(?:header|footer)[^/]*\.xml", n))


class Scan:
    """Where the paragraphs of a part and their nodes lie in its bytes."""

    def __init__(self, raw: bytes):
        #: Of each paragraph: begin, end, and its nodes (kind, text, begin, end).
        self.paragraphs: list[dict] = []
        self._raw = raw
        self._open: list[tuple] = []
        self._text: list[str] | None = None
        p = self._parser = expat.ParserCreate(namespace_separator=" ")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._said
        p.Parse(raw, True)

    def _paragraph(self) -> dict | None:
        for name, found, _ in reversed(self._open):
            if name == _FALLBACK:
                return None
            if found is not None:
                return found
        return None

    def _tag_end(self, at: int) -> int:
        return _TAG_END.match(self._raw, at).end()

    def _start(self, name, _):
        at, found, closed = self._parser.CurrentByteIndex, None, None
        if name in (_MAIN + "p", _MAIN + "t"):
            # An element without content ends with its tag; the parser's index is behind it then.
            end = self._tag_end(at)
            closed = end if self._raw[end - 2 : end] == b"/>" else None
        if name == _MAIN + "p" and not any(n == _FALLBACK for n, _, _ in self._open):
            found = {"begin": at, "end": None, "nodes": [], "name": re.match(rb"<([^\s/>]+)", self._raw[at : at + 200])[1]}
            self.paragraphs.append(found)
        elif name == _MAIN + "t" and self._paragraph() is not None:
            self._text, self._at = [], at
        elif name in (_MAIN + "br", _MAIN + "cr", _MAIN + "tab") and self._open and self._open[-1][0] == _MAIN + "r" and self._paragraph() is not None:
            self._paragraph()["nodes"].append(("gap", "\t" if name.endswith("tab") else "\n", at, at))
        self._open.append((name, found, closed))

    def _said(self, text):
        if self._text is not None:
            self._text.append(text)

    def _end(self, name):
        at, (_, found, closed) = self._parser.CurrentByteIndex, self._open.pop()
        if found is not None:
            found["end"] = closed or self._tag_end(at)
        elif name == _MAIN + "t" and self._text is not None:
            self._paragraph()["nodes"].append(("t", "".join(self._text), self._at, closed or self._tag_end(at)))
            self._text = None


def read(content: bytes) -> list[tuple]:
    """(ordinal, node, kind, text) of all nodes of a package; paragraphs count through its parts."""
    out, base = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in parts(z):
            found = Scan(z.read(name)).paragraphs
            out += [(base + i, k, kind, text) for i, p in enumerate(found) for k, (kind, text, _, _) in enumerate(p["nodes"])]
            base += len(found)
    return out


def parse(files: DataFrame) -> DataFrame:
    """(doc, ordinal, node, kind, text) of packages (doc, content), a row for each text node, break and tab; damaged packages have none."""
    schema = files.select("doc", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text")).schema

    def run(batches):
        for b in batches:
            for doc, content in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                try:
                    rows = read(content or b"")
                except (zipfile.BadZipFile, expat.ExpatError):
                    continue
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(rows), b.column(0).type), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3])], schema.names)

    return files.select("doc", "content").mapInArrow(run, schema)


def rewritten(content: bytes, changes: dict[tuple[int, int], str], dropped: set[int]) -> bytes:
    """A package with the texts of nodes changed ((ordinal, node); node -1 is a run that is added) and paragraphs dropped."""
    out, base = io.BytesIO(), 0
    touched = {o for o, _ in changes} | dropped
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        new = {}
        for name in parts(z):
            raw = z.read(name)
            found = Scan(raw).paragraphs
            cuts: list[tuple[int, int, bytes]] = []
            for i, p in enumerate(found):
                o = base + i
                if o not in touched:
                    continue
                if o in dropped:
                    cuts.append((p["begin"], p["end"], b""))
                    continue
                prefix = p["name"][: p["name"].find(b":") + 1].decode()
                node = lambda text: f'<{prefix}t xml:space="preserve">{_escaped(text)}</{prefix}t>'  # noqa: B023, E731
                for k, (kind, _, begin, end) in enumerate(p["nodes"]):
                    if kind == "t" and (o, k) in changes:
                        cuts.append((begin, end, node(changes[o, k]).encode()))
                if (o, -1) in changes:
                    run = f"<{prefix}r>{node(changes[o, -1])}</{prefix}r>".encode()
                    closing = raw.rfind(b"</", p["begin"], p["end"])
                    if raw[p["begin"] : p["end"]].endswith(b"/>") and closing < 0:
                        cuts.append((p["end"] - 2, p["end"], b">" + run + b"</" + p["name"] + b">"))
                    else:
                        cuts.append((closing, closing, run))
            base += len(found)
            if cuts:
                new[name] = _spliced(raw, cuts)
        for info in z.infolist():
            made.writestr(zipfile.ZipInfo(info.filename, (1980, 1, 1, 0, 0, 0)), new.get(info.filename, z.read(info.filename)), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _spliced(raw: bytes, cuts: list[tuple[int, int, bytes]]) -> bytes:
    out, at = [], 0
    for begin, end, text in sorted(cuts):
        if begin < at:  # inside a paragraph that is dropped
            continue
        out += [raw[at:begin], text]
        at = end
    return b"".join([*out, raw[at:]])


def write(files: DataFrame, changes: DataFrame, dropped: DataFrame) -> DataFrame:
    """(doc, content): packages with ``changes`` (doc, ordinal, node, text) made and the paragraphs of ``dropped`` (doc, ordinal) left out.

    Changes meet their package by document, a row per document; packages without any are as they were.
    """
    c = changes.groupBy("doc").agg(F.collect_list(F.struct("ordinal", "node", "text")).alias("changes"))
    d = dropped.groupBy("doc").agg(F.collect_set("ordinal").alias("dropped"))
    joined = files.select("doc", "content").join(c, "doc", "left").join(d, "doc", "left")
    schema = files.select("doc", "content").schema

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                made = []
                for content, ch, dr in zip(*[part.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                    made.append(rewritten(content, {(x["ordinal"], x["node"]): x["text"] for x in ch or []}, set(dr or [])) if ch or dr else content)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], schema.names)

    return joined.select("doc", "content", "changes", "dropped").mapInArrow(run, schema)
