"""Alignment of the tokens of two tokenizers, by relational joins over token intervals.

Both tokenizers cut the same bytes (a blank and the text). A task takes documents in chunks of bounded text, puts their
tokens into two tables of byte intervals (doc, k, id, start, stop; documents behind each other) and lets DuckDB align them:

* groups: windows over the offsets where tokens of both end number the groups between them and give the tokens in each;
* links: pairs that end together, by an equal join; or all pairs that overlap, for which ASOF joins find the first and the last
  partner of a token and a range join those between.

Each chunk keeps its own distinct id pairs with their number of links. Spark adds these partial counts up, marks the best
partners of each id of the second tokenizer, and hands every chunk the counts of its own pairs; documents then add up
theirs. No pair or id is a bottleneck: a chunk has each pair once.
"""

from __future__ import annotations

import functools
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, prepare
from .tokens import default_path, encoder, piece_encoder, piece_path

CHUNK_BYTES = 2 << 20
DUCKDB_MB = 700

#: Tokens that end together, and whether a group ends with them (behind its last tokens, should some be empty).
_MEET = "SELECT a.doc, a.id AS a, b.id AS b, a.k AS ka, b.k AS kb, a.last AND b.last AS cut FROM a JOIN b ON a.stop = b.stop"
#: The first and the last partner of a token by ASOF joins, then those between by number: no more rows than there are links.
_OVERLAP = """
WITH lo AS (SELECT a.doc, a.k, a.id, b.k AS first FROM a ASOF JOIN b ON a.start < b.stop),
hi AS (SELECT a.k, b.k AS last FROM a ASOF JOIN b ON a.stop > b.start)
SELECT lo.doc, lo.id AS a, b.id AS b FROM lo JOIN hi USING (k), unnest(range(first, last + 1)) r(k2) JOIN b ON b.k = r.k2
"""
_LINKS = {"end": "SELECT doc, a, b FROM meet", "overlap": _OVERLAP}
#: The tokens of both in each group. A document ends with a group, so positions run on through the chunk.
_GROUPS = "SELECT doc, ka - lag(ka, 1, -1) OVER w AS n_a, kb - lag(kb, 1, -1) OVER w AS n_b FROM meet WHERE cut WINDOW w AS (ORDER BY ka) ORDER BY ka"


@functools.lru_cache(maxsize=1)
def _database():
    """One database in memory for each worker: one thread, a bound of its own, nothing on local disks."""
    db = duckdb.connect(":memory:")
    db.execute("SET threads = 1")
    db.execute(f"SET memory_limit = '{DUCKDB_MB}MB'")
    db.execute("SET temp_directory = ''")
    return db


def _intervals(ids: list[np.ndarray], lengths: np.ndarray) -> pa.Table:
    """Tokens of a chunk as intervals of its bytes: documents lie behind each other, in both tables at the same places."""
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    size = lengths[flat]
    stop = np.cumsum(size)
    last = np.append(np.diff(stop) != 0, True) if len(flat) else np.zeros(0, bool)
    return pa.table({"doc": doc, "k": np.arange(len(flat)), "id": flat, "start": stop - size, "stop": stop, "last": last})


def _texts(a: list[np.ndarray], b: list[np.ndarray], doc: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each document from the sizes of its groups in order; empty without tokens."""
    # Tokens by group, those of the first tokenizer in front: runs of sizes n_a, n_b, n_a, n_b, ...
    sizes = np.stack([n_a, n_b], axis=1).reshape(-1)
    begins = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.int32)
    of_a = np.repeat(np.arange(len(sizes)) % 2 == 0, sizes)
    if len(ids):
        ids[of_a], ids[~of_a] = np.concatenate(a), np.concatenate(b)
    mark = np.zeros(len(ids), np.int32)
    mark[begins[::2]], mark[begins[1::2]] = 1, 2
    edges = np.concatenate(([0], np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)]))).astype(np.int32)
    mark[edges[:-1][np.diff(edges) > 0]] = 3
    parts = pc.binary_join_element_wise(pa.array([",", ";", "|", ""]).take(pa.array(mark)), pc.cast(pa.array(ids), pa.string()), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), parts), "").to_pylist()


def align_chunk(a: list[np.ndarray], b: list[np.ndarray], a_lengths: np.ndarray, b_lengths: np.ndarray, relation: str, digest: bool) -> tuple[dict, dict]:
    """Columns of the documents (``pairs`` numbers those of the chunk, ``times`` tells how often), and the chunk's (a, b, n) pairs."""
    db = _database()
    db.register("a", _intervals(a, a_lengths))
    db.register("b", _intervals(b, b_lengths))
    try:
        db.execute(f"CREATE OR REPLACE TEMP TABLE meet AS {_MEET}")
        db.execute(f"CREATE OR REPLACE TEMP TABLE link AS {_LINKS[relation]}")
        db.execute("CREATE OR REPLACE TEMP TABLE pair AS SELECT a, b, n, row_number() OVER (ORDER BY a, b) - 1 AS i FROM (SELECT a, b, count(*) AS n FROM link GROUP BY a, b)")
        groups = db.execute(_GROUPS).fetchnumpy()
        pairs = db.execute("SELECT a, b, n FROM pair ORDER BY i").fetchnumpy()
        held = db.execute("SELECT link.doc, CAST(pair.i AS INTEGER) AS i, count(*) AS n FROM link JOIN pair ON link.a = pair.a AND link.b = pair.b GROUP BY link.doc, pair.i ORDER BY link.doc, pair.i").fetchnumpy()
    finally:
        for name in ("meet", "link", "pair"):
            db.execute(f"DROP TABLE IF EXISTS {name}")
        db.unregister("a")
        db.unregister("b")
    said = _texts(a, b, groups["doc"], groups["n_a"], groups["n_b"])
    if digest:
        said = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said]
    total = lambda doc, weights=None: np.bincount(doc, weights, minlength=len(a)).astype(np.int64)
    edges = pa.array(np.concatenate(([0], np.cumsum(total(held["doc"])))).astype(np.int32))
    docs = {
        "n_a": [len(x) for x in a], "n_b": [len(x) for x in b], "n_groups": total(groups["doc"]), "n_links": total(held["doc"], held["n"]), "groups": said,
        "pairs": pa.ListArray.from_arrays(edges, pa.array(held["i"], pa.int32())), "times": pa.ListArray.from_arrays(edges, pa.array(held["n"], pa.int64())),
    }
    return docs, pairs


def _chunk_schema(row: T.StructType) -> T.StructType:
    doc = T.StructType([T.StructField("row", row), *T._parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<long>").fields])
    return T.StructType([*T._parse_datatype_string("part int, chunk long").fields, T.StructField("docs", T.ArrayType(doc)), T.StructField("pairs", T._parse_datatype_string("array<struct<a:int,b:int,n:bigint>>"))])


def chunks(docs: DataFrame, keep: list[str], text: str, a_path: str, b_path: str, relation: str, digest: bool) -> DataFrame:
    """One row per chunk: its documents with the numbers of their pairs, and its pairs with their links; stored."""
    prepare(docs.sparkSession)
    row = T.StructType([docs.schema[c] for c in keep])
    schema = _chunk_schema(row)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, number = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        first, second = encoder(a_path), piece_encoder(b_path)
        a_bytes, b_bytes = first.token_bytes, second.token_bytes
        a_lengths, b_lengths = np.array([len(x) for x in a_bytes], np.int64), np.array([len(x) for x in b_bytes], np.int64)
        none = np.zeros(0, np.uint32)

        def tokens(said: str | None):
            if not said:
                return none, none
            raw, a, b = f" {said}".encode(), first.encode_plain(f" {said}"), second.encode_plain(said)
            whole = b"".join(map(a_bytes.__getitem__, a.tolist())) == raw and b"".join(map(b_bytes.__getitem__, b.tolist())) == raw
            return (a, b) if whole else (none, none)

        def made(rows, found):
            nonlocal number
            done, pairs = align_chunk([x for x, _ in found], [x for _, x in found], a_lengths, b_lengths, relation, digest)
            number += 1
            kind = arrow.field("docs").type
            doc = pa.StructArray.from_arrays([pa.array(rows, kind.value_type.field("row").type), *[pa.array(done[f.name], f.type) if not isinstance(done[f.name], pa.Array) else done[f.name].cast(f.type) for f in list(kind.value_type)[1:]]], fields=list(kind.value_type))
            pair = arrow.field("pairs").type.value_type
            listed = pa.StructArray.from_arrays([pa.array(pairs[f.name], f.type) for f in pair], fields=list(pair))
            one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(t)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), one(doc, kind), one(listed, arrow.field("pairs").type)], schema=arrow)

        rows, found, size = [], [], 0
        for batch in batches:
            for r, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = said.as_py()
                rows.append(r)
                found.append(tokens(said))
                size += 16 + len(said or "")
                if size >= CHUNK_BYTES:
                    yield made(rows, found)
                    rows, found, size = [], [], 0
        if rows:
            yield made(rows, found)

    chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return materialize(chosen.mapInArrow(run, schema), "crosstoken")


def pair_counts(of: DataFrame) -> DataFrame:
    """Every linked id pair of ``chunks`` with its links corpus-wide (``n``) and whether no partner of ``b`` has more (``best``)."""
    total = of.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    # A window over the partners of an id: at most as many as the first vocabulary has entries.
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def align(docs: DataFrame, keep: list[str] | None = None, text: str = "text", a_path: str | None = None, b_path: str | None = None, relation: str = "end", digest: bool = False) -> DataFrame:
    """One row per document: the columns ``keep`` (all but the text by default) in the struct ``row``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``n_best`` (links whose pair is a best one of its b), ``count_sum`` (pair counts over links) and ``groups``
    (``a1,a2|b1;a3|b2``, or with ``digest`` its SHA-256).

    Texts that are null, empty, or that a tokenizer doesn't give back byte by byte have no tokens: zeros and an empty ``groups``.
    Repeated rows count as documents of their own; columns of any name may be kept, for they lie in the struct.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if not keep:
        raise ValueError("keep at least one column")
    of = chunks(docs, keep, text, a_path or default_path(), b_path or piece_path(), relation, digest)
    mine = of.select("part", "chunk", F.posexplode("pairs").alias("i", "p")).select("part", "chunk", "i", "p.a", "p.b")
    told = mine.join(pair_counts(of), ["a", "b"]).groupBy("part", "chunk").agg(F.sort_array(F.collect_list(F.struct("i", "n", "best"))).alias("told"))
    told = told.select("part", "chunk", F.col("told.n").alias("counts"), F.col("told.best").alias("bests"))
    row = T.StructType([docs.schema[c] for c in keep])
    schema = T.StructType([T.StructField("row", row), *T._parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string").fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for held, counts, bests in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                listed = held.values
                field = lambda n: listed.field(listed.type.get_field_index(n))  # noqa: B023, E731
                pairs, times = field("pairs"), field("times")
                # The documents' lists lie behind each other; empty ones add nothing.
                at = np.repeat(np.arange(len(listed)), np.diff(pairs.offsets.to_numpy()))
                i, n = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
                count = np.array(counts.as_py() or [], np.int64)[i]
                best = np.array(bests.as_py() or [], bool)[i]
                n_best, count_sum = np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64)
                np.add.at(n_best, at, n * best)
                np.add.at(count_sum, at, n * count)
                yield pa.RecordBatch.from_arrays([field("row"), field("n_a"), field("n_b"), field("n_groups"), field("n_links"), pa.array(n_best), pa.array(count_sum), field("groups")], schema=arrow)

    joined = of.select("part", "chunk", "docs").join(told, ["part", "chunk"], "left").select("docs", "counts", "bests")
    return joined.mapInArrow(run, schema)
