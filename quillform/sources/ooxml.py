"""DOCX files as tables: paragraph records from ``binaryFile`` rows, and rendered documents back to DOCX.

The package is parsed where its bytes are, a file per row, with the standard library's ZIP and XML readers.
"""

from __future__ import annotations

import io
import unicodedata
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
_ALTERNATE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}AlternateContent"
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
_RECORD = (
    "path string, ordinal int, story string, table_index int, row_index int, cell_index int, grid_start int, grid_span int, v_merge string, text string, style string, is_bold boolean, is_red boolean, has_marker boolean, "
    "control_id string, control_kind string, control_options array<string>, legacy_box string, "
    "block int, depth int, grid int, width int, runs int, bold_runs int, is_numbered boolean, named_boxes int, bare_boxes int, named_legacy int, bare_legacy int, glyph string, has_field boolean, has_object boolean, error string"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_CONTENT = "<?xml version='1.0' encoding='UTF-8' standalone='yes'?>"
_TYPES = _CONTENT + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = _CONTENT + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: Packages that are made or checked at once.
BATCH = 64
#: Bytes that one member may unpack to.
MEMBER_LIMIT = 512 << 20


def _own(paragraph: ElementTree.Element):
    """The elements of a paragraph, without those of paragraphs inside it (text boxes) and of fallbacks."""
    for child in paragraph:
        if child.tag not in (_W + "txbxContent", _W + "p", _FALLBACK):
            yield child
            yield from _own(child)


def _text(paragraph: ElementTree.Element) -> str:
    out = []
    for node in _own(paragraph):
        if node.tag == _W + "t":
            out.append(node.text or "")
        elif node.tag == _W + "tab":
            out.append("\t")
        elif node.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _boxes(paragraph: ElementTree.Element):
    """The text boxes of a paragraph, outermost ones."""
    for child in paragraph:
        if child.tag == _W + "txbxContent":
            yield child
        elif child.tag not in (_W + "p", _FALLBACK):
            yield from _boxes(child)


def _red(paragraph: ElementTree.Element) -> bool:
    """Whether a run is coloured red: 150 or more, and 1.35 times green and blue."""
    for node in _own(paragraph):
        value = node.get(_W + "val", "") if node.tag == _W + "color" else ""
        if len(value) == 6 and all(c in "0123456789abcdefABCDEF" for c in value):
            r, g, b = (int(value[k : k + 2], 16) for k in (0, 2, 4))
            if r >= 150 and r > g * 1.35 and r > b * 1.35:
                return True
    return False


def _control(sdt: ElementTree.Element) -> tuple[str | None, str | None, list[str] | None]:
    """(id, kind, options) of a content control: its tag or else its alias; check box, date, list or combo box."""
    props = sdt.find(_W + "sdtPr")
    if props is None:
        return None, None, None
    names = [e.get(_W + "val", "").strip() for e in (props.find(_W + "tag"), props.find(_W + "alias")) if e is not None]
    name = next((unicodedata.normalize("NFC", n) for n in names if n), None)
    if props.find(_W14 + "checkbox") is not None:
        return name, "checkbox", None
    if props.find(_W + "date") is not None:
        return name, "date", None
    listed = props.find(_W + "dropDownList")
    listed = props.find(_W + "comboBox") if listed is None else listed
    if listed is None:
        return name, None, None
    said = [(i.get(_W + "displayText", "").strip() or i.get(_W + "value", "").strip()) for i in listed.findall(_W + "listItem")]
    return name, "dropdown", [x for x in said if x]


def _flag(node: ElementTree.Element | None) -> bool:
    return node is not None and node.get(_W + "val", "true").lower() not in ("0", "false", "off")


def _number(node: ElementTree.Element | None, name: str) -> int | None:
    value = "" if node is None else node.get(_W + name, "")
    return int(value) if value.removeprefix("-").isdigit() else None


def _marks(p: ElementTree.Element) -> tuple:
    """What of a paragraph isn't text: its runs with text and the bold ones, list style, check boxes by kind and name, the one
    symbol or drawing of a paragraph without text, and whether it has fields or controls, or any object."""
    every = list(p.iter())
    text = "".join(n.text or "" for n in every if n.tag == _W + "t")
    runs = [r for r in every if r.tag == _W + "r" and "".join(t.text or "" for t in r.iter(_W + "t")).strip()]
    count = {k: 0 for k in ("named", "bare", "named_old", "bare_old")}
    for node in every:
        if node.tag == _W + "sdt":
            name, kind, _ = _control(node)
            if kind == "checkbox":
                count["named" if name else "bare"] += 1
        elif node.tag == _W + "ffData" and node.find(_W + "checkBox") is not None:
            count["named_old" if (node.find(_W + "name") is not None and node.find(_W + "name").get(_W + "val", "").strip()) else "bare_old"] += 1
    symbols = [n for n in every if n.tag == _W + "sym"]
    # A drawing and its fallback are one.
    drawings = [n for n in every if n.tag in (_W + "drawing", _W + "pict")]
    pairs = [n for n in every if n.tag == _ALTERNATE]
    glyph = None
    if not text.strip():
        if len(symbols) == 1 and any(f in symbols[0].get(_W + "font", "").lower() for f in ("wingdings", "webdings")):
            glyph = "symbol"
        elif (len(pairs) == 1 and any(n.tag in (_W + "drawing", _W + "pict") for n in pairs[0].iter())) or len(drawings) == 1:
            glyph = "drawing"
    fields = any(n.tag in (_W + "sdt", _W + "fldChar") for n in every)
    bold = sum(_flag(r.find(f"{_W}rPr/{_W}b")) for r in runs)
    return (len(runs), bold, p.find(f"{_W}pPr/{_W}numPr") is not None, *count.values(), glyph, fields, fields or bool(symbols or drawings))


def _legacy(paragraph: ElementTree.Element) -> str | None:
    """The name of a legacy check box (empty without one), or null where there is none."""
    for node in _own(paragraph):
        if node.tag == _W + "ffData" and node.find(_W + "checkBox") is not None:
            name = node.find(_W + "name")
            return "" if name is None else unicodedata.normalize("NFC", name.get(_W + "val", "").strip())
    return None


def records(content: bytes) -> list[tuple]:
    """A tuple of ``_RECORD`` without path and error for every paragraph, body first, then headers and footers."""
    out: list[tuple] = []
    tables = 0
    nowhere = (None, None, None, None, None, None)
    block = 0

    def paragraph(p, story, place, control, shape):
        props = p.find(f"{_W}pPr/{_W}pStyle")
        inner = next((n for n in _own(p) if n.tag == _W + "sdt"), None)
        if inner is not None:
            control = _control(inner)
        bold, text, legacy = p.find(f".//{_W}rPr/{_W}b") is not None, _text(p), _legacy(p)
        out.append((len(out), story, *place, text, props.get(_W + "val") if props is not None else None, bold, _red(p), "{{" in text or control[1] is not None or legacy is not None, *control, legacy, block, *shape, *_marks(p)))
        for box in _boxes(p):
            walk(box, story, place, (None, None, None), shape)

    def walk(node, story, place, control, shape):
        nonlocal tables, block
        for child in node:
            block += place is nowhere
            if child.tag == _W + "p":
                paragraph(child, story, place, control, shape)
            elif child.tag == _W + "tbl":
                index, tables = tables, tables + 1
                columns = len(child.findall(f"{_W}tblGrid/{_W}gridCol")) or None
                for r, row in enumerate(child.findall(_W + "tr")):
                    start = max(0, _number(row.find(f"{_W}trPr/{_W}gridBefore"), "val") or 0)
                    for c, cell in enumerate(row.findall(_W + "tc")):
                        grid, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
                        span = max(1, int(grid.get(_W + "val", "1"))) if grid is not None else 1
                        here = (shape[0] + 1, columns, _number(cell.find(f"{_W}tcPr/{_W}tcW"), "w"))
                        walk(cell, story, (index, r, c, start, span, None if merge is None else merge.get(_W + "val", "continue")), control, here)
                        start += span
            elif child.tag == _W + "sdt":
                body = child.find(_W + "sdtContent")
                if body is not None:
                    walk(body, story, place, _control(child), shape)

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n == "word/document.xml"] + sorted(n for n in z.namelist() if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"))
        for name in names:
            if z.getinfo(name).file_size > MEMBER_LIMIT:
                raise ValueError(f"{name} is larger than {MEMBER_LIMIT} bytes")
            root = ElementTree.fromstring(z.read(name))
            body = root.find(_W + "body") if name == "word/document.xml" else root
            walk(body if body is not None else root, name.rpartition("/")[2].removesuffix(".xml"), nowhere, (None, None, None), (0, None, None))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraph records of all DOCX files under a path; an unreadable file is one row with ``error``."""
    return parse_docx(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path))


def parse_docx(files: DataFrame) -> DataFrame:
    """Paragraph records of packages (path, content)."""

    def run(batches):
        names, kinds = zip(*(x.split(" ") for x in _RECORD.split(", ")), strict=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(name, *r, None) for r in records(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
                    rows = [(name, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"[:200])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return files.select("path", "content").mapInArrow(run, _RECORD)


def layout_inputs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, cells) of body records as the layout operators read them: doc is the path, tables are numbered from 1 in their
    order, a cell's text is its paragraphs by line; tables inside cells, headers and footers are left out."""
    body = records.filter("story = 'document' AND error IS NULL").withColumnRenamed("path", "doc")
    paragraphs = body.filter("depth = 0").select("doc", "block", "text", "style", "runs", "bold_runs")
    number = F.dense_rank().over(Window.partitionBy("doc").orderBy("block"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n")
    cells = body.filter("depth = 1").groupBy("doc", "block", "row_index", "cell_index").agg(
        F.first("grid_start").alias("start"), F.first("grid_span").alias("span"), lines.alias("text"), F.coalesce(F.first("v_merge") == "continue", F.lit(False)).alias("continues"), F.first("grid").alias("grid")
    )
    return paragraphs, cells.select("doc", "block", number.alias("table_index"), "row_index", "cell_index", "start", "span", "text", "continues", "grid")


def build_docx(blocks: list[str | list[list[str]]]) -> bytes:
    """A minimal DOCX of paragraphs (texts) and tables (rows of cells); the same bytes for the same blocks."""
    one = lambda p: f'<w:p><w:r><w:t xml:space="preserve">{_escaped(p)}</w:t></w:r></w:p>'
    rows = lambda t: "".join("<w:tr>" + "".join(f"<w:tc>{one(c)}</w:tc>" for c in r) + "</w:tr>" for r in t)
    body = "".join(one(b) if isinstance(b, str) else f"<w:tbl>{rows(b)}</w:tbl>" for b in blocks)
    document = f'{_CONTENT}<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>'
    return packed([("[Content_Types].xml", _TYPES.encode()), ("_rels/.rels", _RELS.encode()), ("word/document.xml", document.encode())])


def packed(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP package of members in their order, with a fixed date."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


#: Characters that XML cannot hold.
_BARRED = {c: None for c in range(32) if c not in (9, 10, 13)} | {0xFFFE: None, 0xFFFF: None}


def _escaped(x: str) -> str:
    """A text for XML; characters that it cannot hold go, a carriage return is written as a reference."""
    return x.translate(_BARRED).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly to the session's number of shuffle partitions.

    A package takes a task far longer than its row's bytes tell: files and row groups that Spark cuts by bytes, and exchanges that it
    coalesces by bytes, leave most cores without packages to make or read.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def to_docx(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content): each text as a DOCX, a paragraph per line; null is an empty text."""
    kept = df.select(F.col(key), F.col(text).alias("x_text"))
    schema = kept.select(key, F.lit(None).cast("binary").alias("content")).schema

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                made = [build_docx((x or "").split("\n")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], schema.names)

    return dealt(kept).mapInArrow(run, schema)


def check_docx(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with ``problem``: null for a whole package, else what is wrong: no ZIP, a damaged member, or a missing one."""
    schema = df.select("*", F.lit(None).cast("string").alias("problem")).schema

    def verdict(raw: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                names, bad = set(z.namelist()), z.testzip()
        except zipfile.BadZipFile:
            return "no package"
        missing = [n for n in ("[Content_Types].xml", "word/document.xml") if n not in names]
        return f"damaged {bad}" if bad else f"missing {missing[0]}" if missing else None

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(content)
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([verdict(x) for x in part.column(at).to_pylist()], pa.string())], schema.names)

    return df.mapInArrow(run, schema)
