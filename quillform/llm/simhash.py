"""SimHash near-duplicate groups by pigeonring filtering.

Fingerprints of 64 bits link at ``MAX_BITS`` = 4 or fewer differing bits. The bits form a ring of five segments. If two
fingerprints differ in at most 4 bits, then from some segment of the ring every chain of l consecutive segments holds at
most floor(l * 4 / 5) of the differences (strong pigeonring principle): 0 in the first segment, 1 in the first two, 2 in
three, 3 in four, 4 in all five. Candidates therefore share one segment exactly, and are pruned chain by chain before
the full Hamming check.

Equal fingerprints collapse to one node first, so a large group of copies costs one row. A segment value that holds
more than ``WIDE`` nodes is keyed by its chain of two segments instead, where a node also goes to the keys that differ in
one raised bit of the second segment; no pair is lost by it. The table of wide values has at most 5 * 2^13 rows. Buckets
emit a spanning forest of their links, never all pairs, and components are found by alternating large-star and
small-star steps over tables in the shared folder.

``keep_one`` takes those links, and drops edited copies too: texts whose 5-word shingle sets have a Jaccard similarity of 0.8 or more. There the
fingerprints differ in some ten bits; segments for a budget of twice that would have three bits and let every pair meet.
Its candidates meet in bands of MinHashes instead, and are checked on the whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, arrow_column, materialize, packed, prepare, unpacked

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: (shift, bits) of the ring's segments from the lowest bit.
RING = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Nodes of a segment value above which its bucket is keyed by two segments.
WIDE = 4096
#: Side of the tiles in which a bucket's pairs are compared.
TILE = 1024
_BLOCK = 1 << 15
#: Near copies of ``keep_one``: words of a shingle, least Jaccard similarity, and the bands of MinHashes in which candidates meet.
WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
#: Hashes of shingle sets in a tile of a band's members; a task holds two.
TILE_HASHES = 1 << 21
#: Compared nodes up to which their table is broadcast (two longs each).
BROADCAST_ROWS = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    flat = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lens[:-1] + 1)))
    ends = starts + lens
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), _BLOCK):
        h = np.array([digest(flat[a:b], seed) for a, b in zip(starts[k : k + _BLOCK].tolist(), ends[k : k + _BLOCK].tolist(), strict=True)], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with a column ``name`` (long, the fingerprint's bits); an old column of that name is replaced."""
    docs = docs.drop(name)
    prepare(docs.sparkSession)
    out = docs.withColumn(name, F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            got = pa.array([_signed(fingerprint(x)) for x in arrow_column(b, text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, name])

    return docs.mapInArrow(run, out)


def _segment(i: int):
    shift, bits = RING[i % len(RING)]
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, ring, probe, fp): where each node meets its candidates."""
    first = F.array(*[F.struct(F.lit(i).alias("ring"), _segment(i).alias("seg"), _segment(i + 1).alias("next")) for i in range(len(RING))])
    rows = nodes.select("fp", F.explode(first).alias("e")).select("fp", "e.ring", "e.seg", "e.next")
    wide = materialize(rows.groupBy("ring", "seg").count().filter(F.col("count") > WIDE).select("ring", "seg", F.lit(True).alias("wide")), "simhash-wide")
    rows = rows.join(F.broadcast(wide), ["ring", "seg"], "left")  # 5 * 2^13 rows at most
    # Keys: ring, level, segment, second segment. The second level has the node itself and its raised-bit neighbours.
    bits = F.when(F.col("ring") == len(RING) - 2, RING[-1][1]).otherwise(RING[0][1])
    raised = F.filter(F.transform(F.sequence(F.lit(0), bits - 1), lambda k: F.when(F.col("next").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) == 0, F.col("next").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))), lambda x: x.isNotNull())
    at = F.when(F.col("wide"), F.concat(F.array(F.struct(F.col("next").alias("second"), F.lit(False).alias("probe"))), F.transform(raised, lambda x: F.struct(x.alias("second"), F.lit(True).alias("probe"))))).otherwise(
        F.array(F.struct(F.lit(-1).cast("long").alias("second"), F.lit(False).alias("probe")))
    )
    out = rows.select("fp", "ring", "seg", F.explode(at).alias("a"))
    key = F.col("ring").cast("long") * (1 << 40) + F.col("seg") * (1 << 20) + F.col("a.second") + 1
    return out.select(key.alias("key"), "ring", F.col("a.probe").alias("probe"), "fp")


def _chains(ring: int) -> list[tuple[np.uint64, int]]:
    """(mask, budget) of the chains of two and more segments from a segment of the ring; the last is the full check."""
    out, mask = [], 0
    for length in range(1, len(RING) + 1):
        shift, bits = RING[(ring + length - 1) % len(RING)]
        mask |= ((1 << bits) - 1) << shift
        if length > 1:
            out.append((np.uint64(mask), length * MAX_BITS // len(RING)))
    return out


def _root(up: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite u and v pairwise in the forest ``up``, whose pointers never rise."""
    while len(u):
        while True:
            deeper = up[up]
            if np.array_equal(deeper, up):
                break
            up[:] = deeper
        a, b = up[u], up[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))


def _links(fp: np.ndarray, probe: np.ndarray, ring: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in a bucket: nodes, and a linked representative of each."""
    order = np.argsort(probe, kind="stable")
    fp, homes = fp[order], int((~probe).sum())
    up, chains = np.arange(len(fp)), _chains(ring)
    for a in range(0, homes, TILE):
        left = fp[a : a + TILE][: homes - a]
        for b in range(a, len(fp), TILE):
            diff = left[:, None] ^ fp[None, b : b + TILE]
            u, v = np.nonzero(np.bitwise_count(diff & chains[0][0]) <= chains[0][1])
            keep = u + a < v + b
            u, v = u[keep], v[keep]
            x = diff[u, v]
            for mask, budget in chains[1:]:
                keep = np.bitwise_count(x & mask) <= budget
                u, v, x = u[keep], v[keep], x[keep]
            _root(up, u + a, v + b)
    _root(up, np.array([], np.int64), np.array([], np.int64))
    while not np.array_equal(up[up], up):
        up = up[up]
    child = np.nonzero(up != np.arange(len(up)))[0]
    return fp[child], fp[up[child]]


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): a spanning forest per bucket of all links between the distinct fingerprints ``nodes`` (fp)."""
    rows = _keyed(nodes)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held: list[tuple] = []

        def flush(key, ring, probe, fp):
            if len(fp) > 1:
                a, b = _links(fp, probe, int(ring[0]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cols = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy().view(np.uint64))
            cuts = np.flatnonzero(np.diff(cols[0])) + 1
            pieces = list(zip(*(np.split(c, cuts) for c in cols), strict=True))
            for piece in pieces:
                if not len(piece[0]):
                    continue
                if held and held[0][0][0] != piece[0][0]:
                    yield from flush(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                held.append(piece)
        if held:
            yield from flush(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node of its component, roots left out."""
    same = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(same, "simhash-edges")
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u != v")
        e = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "simhash-edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def groups(prints: DataFrame, *best: str) -> DataFrame:
    """(fp, component columns): for rows (fp, ``best``...) the smallest ``best`` struct of each component, per distinct fp."""
    pick = F.min(F.struct(*best)) if len(best) > 1 else F.min(best[0])
    nodes = materialize(prints.groupBy("fp").agg(pick.alias("best")), "simhash-nodes")
    root = components(materialize(links(nodes.select("fp")), "simhash-links"))
    rooted = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    top = rooted.groupBy("root").agg(F.min("best").alias("best"))
    return rooted.select("fp", "root").join(top, "root").select("fp", "best")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Null and wordless texts have fingerprint 0 and link as any other. Rows with equal ids count each; a null id gets a
    row and is nobody's component id unless a component has no other. An empty table gives an empty result.
    """
    prints = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "simhash-prints")
    found = groups(prints, "doc_id")
    return prints.join(found, "fp").select("doc_id", "fp", F.col("best").alias("component_id"))


def shingle_set(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of all its words if they are fewer; none without words."""
    words = (text or "").encode().lower().split()
    size, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    if not words:
        return np.array([], np.uint64)
    return np.unique(np.array([digest(b" ".join(words[k : k + size]), SEED) for k in range(len(words) - size + 1)], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each of ``BANDS`` groups of ``ROWS`` MinHashes of a set; sets of Jaccard similarity j share one with 1 - (1 - j^ROWS)^BANDS."""
    if not len(hashes):
        return []
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        low = np.minimum(low, (_FACTORS[:, None] * hashes[None, k : k + 4096]).min(axis=1))
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), i)) for i, x in enumerate(low.reshape(BANDS, ROWS))]


def _sketched(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` with sim_node (equal for equal shingle sets), sim_size, sim_bands and sim_fp, the fingerprint."""
    prepare(docs.sparkSession)
    schema = docs.withColumns({"sim_node": F.lit(0).cast("long"), "sim_size": F.lit(0).cast("long"), "sim_bands": F.array(F.lit(0).cast("long")), "sim_fp": F.lit(0).cast("long")}).schema

    def run(batches):
        for b in batches:
            texts = arrow_column(b, text).to_pylist()
            sets = [shingle_set(x, shingle) for x in texts]
            node = pa.array([_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in sets], pa.int64())
            new = [node, pa.array([len(x) for x in sets], pa.int64()), pa.array([band_keys(x) for x in sets], pa.list_(pa.int64())), pa.array([_signed(fingerprint(x)) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema.names)

    return docs.mapInArrow(run, schema)


def _sets(wanted: DataFrame, nodes: DataFrame, staged: DataFrame, text: str, shingle: int) -> DataFrame:
    """(node, hashes): the whole shingle sets of the distinct nodes ``wanted`` (node), stored."""
    wanted = materialize(wanted.join(nodes, "node").select("node", F.col("best.row").alias("sim_row")), "simhash-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("merge")

    def run(batches):
        for b in batches:
            sets = [shingle_set(x, shingle).view(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    texts = staged.select("sim_row", F.col(text).alias("sim_text")).join(wanted, "sim_row").select("node", "sim_text")
    return materialize(texts.mapInArrow(run, "node long, hashes array<long>"), "simhash-sets")


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose whole shingle sets have a Jaccard similarity of ``similar`` or more."""
    # Merge joins, which split a node of many pairs among tasks.
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).hint("merge"), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")).hint("merge")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(both / (F.size("x") + F.size("y") - both) >= F.lit(similar)).select("a", "b")


def _forest(node: np.ndarray, root: np.ndarray, tile: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Similar pairs that bring the members of a bucket, known to be together by ``root``, into components.

    ``hashes`` holds the sets behind each other. If there are two tiles, only pairs of both are compared. A member's overlaps with
    all others are counted at once, by marking its shingles; members of its own component are passed over, and the rest is
    not looked at once all are in one.
    """
    _, codes = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    _, up = np.unique(root, return_inverse=True)
    mark, out = np.zeros(int(codes.max()) + 1, bool), []
    across = tile[0] != tile[-1]
    for u in range(len(node)):
        if across and tile[u] != tile[0]:
            break
        later = (up != up[u]) & (np.minimum(sizes, sizes[u]) >= similar * np.maximum(sizes, sizes[u]))
        later[: u + 1] = False
        if across:
            later &= tile != tile[0]
        v = np.flatnonzero(later)
        if not len(v):
            continue
        mine = codes[begins[u] : ends[u]]
        mark[mine] = True
        if len(v) * 2 > len(node) - u:
            both = np.add.reduceat(mark[codes[begins[u] :]], begins[u:] - begins[u], dtype=np.int64)[v - u]
        else:
            both = np.array([np.count_nonzero(mark[codes[begins[k] : ends[k]]]) for k in v.tolist()], np.int64)
        mark[mine] = False
        for k in v[both / (sizes[u] + sizes[v] - both) >= similar].tolist():
            if up[k] != up[u]:
                out.append((int(node[u]), int(node[k])))
                up[up == up[k]] = up[u]
    return out


def _bucket_links(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b): what ``_forest`` finds in each band of ``members`` (band, node, size, root).

    A band is cut into tiles of ``TILE_HASHES`` hashes, and a task compares two tiles at a time: its memory is bounded, and no pair is
    a row. A set goes to as many buckets as its band has tiles, which is one but for bands of very many long sets.
    """
    w = Window.partitionBy("band").orderBy("node")
    m = members.withColumn("tile", F.floor((F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")) / TILE_HASHES).cast("int"))
    tiles = m.groupBy("band").agg((F.max("tile") + 1).alias("tiles"))
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    m = m.join(tiles, "band").select("band", "node", "root", "tile", F.explode(other).alias("other"))
    m = m.select(F.xxhash64("band", F.least("tile", "other"), F.greatest("tile", "other")).alias("part"), "band", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "node", "root", "tile")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = m.join(sets.hint("merge"), "node").select("part", "band", "lo", "hi", "tile", "node", "root", "hashes")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            lists = t.column("hashes").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy())
            col = lambda n: t.column(n).to_numpy()
            found = _forest(col("node"), col("root"), col("tile"), sizes, lists.flatten().to_numpy(), similar) if len(sizes) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        def same(x, i, y, j):
            return all(x.column(c)[i].as_py() == y.column(c)[j].as_py() for c in range(4))

        for batch in batches:
            # Rows of a bucket follow each other, sorted by (part, band, lo, hi).
            keys = [batch.column(c).to_numpy() for c in range(4)]
            change = np.zeros(max(batch.num_rows - 1, 0), bool)
            for k in keys:
                change |= np.diff(k) != 0
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                piece = batch.slice(lo, hi - lo)
                if held and not same(held[-1], held[-1].num_rows - 1, piece, 0):
                    yield from flush()
                    held.clear()
                held.append(piece)
        if held:
            yield from flush()

    ordered = rows.repartition(parts, "part").sortWithinPartitions("part", "band", "lo", "hi", "tile", "node")
    return ordered.mapInArrow(run, "a long, b long")


def _printed(staged: DataFrame) -> DataFrame:
    """(a, b): for each node of ``staged`` (sim_node, sim_fp) the smallest node whose fingerprint is in the same component."""
    pairs = materialize(staged.select("sim_node", "sim_fp").distinct(), "simhash-prints")
    best = groups(pairs.select(F.col("sim_fp").alias("fp"), "sim_node"), "sim_node").select(F.col("fp").alias("sim_fp"), F.col("best").alias("a"))
    return materialize(pairs.join(best.hint("merge"), "sim_fp").filter("a <> sim_node").select("a", F.col("sim_node").alias("b")).distinct(), "simhash-links")


def _near(nodes: DataFrame, staged: DataFrame, text: str, shingle: int, similar: float, printed: DataFrame) -> DataFrame:
    """(node, root) of the components by the links ``printed`` (a, b) and by similar shingle sets, roots left out.

    Nodes that share a band are compared with one of the band's nodes first. Bands that this has not brought into one
    component are then compared within, all members that may still link, a spanning forest of the links coming out.
    """
    rows = nodes.select("node", "size", F.explode("bands").alias("band"))
    lead = rows.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("band", "node").alias("h"), "node", "size")).alias("lead")).filter("n > 1")
    met = materialize(rows.join(lead, "band").select("band", "node", "size", F.col("lead.node").alias("lead"), F.col("lead.size").alias("lead_size")), "simhash-bands")
    fits = lambda x, y: F.least(x, y) / F.greatest(x, y) >= F.lit(similar)
    first = met.filter((F.col("node") != F.col("lead")) & fits("size", "lead_size")).select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    first = materialize(first, "simhash-pairs")
    sets = _sets(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, staged, text, shingle)
    edges = materialize(_similar(first, sets, similar).union(printed), "simhash-links")
    root = components(edges)
    placed = met.join(root, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    members = materialize(placed.join(mixed, "band", "left_semi"), "simhash-members")
    if members.isEmpty():
        return root
    sets = _sets(members.select("node").distinct(), nodes, staged, text, shingle)
    more = materialize(_bucket_links(members, sets, similar), "simhash-links")
    return root if more.isEmpty() else components(edges.union(more))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """One row of ``docs`` of each component, that with the smallest id (null ids last, then any one), all columns kept.

    Texts link if their fingerprints differ in ``MAX_BITS`` bits or fewer, as in ``near_duplicates``, and if their sets of ``shingle``-word shingles have a Jaccard similarity of ``similar`` or more. Candidates share
    a band of MinHashes, and each is checked on the whole sets. Texts without words are one group.
    """
    staged = materialize(_sketched(packed(docs), f"{ROW}.{text}", shingle).withColumn("sim_row", F.monotonically_increasing_id()), "simhash-docs")
    prints = staged.select("sim_node", "sim_size", "sim_bands", F.struct(F.col(f"{ROW}.{doc_id}").isNull().alias("no_id"), F.col(f"{ROW}.{doc_id}").alias("id"), F.col("sim_row").alias("row")).alias("one"))
    nodes = prints.groupBy(F.col("sim_node").alias("node")).agg(F.min("one").alias("best"), F.first("sim_size").alias("size"), F.first("sim_bands").alias("bands"))
    nodes = materialize(nodes, "simhash-nodes")
    root = _near(nodes, staged, f"{ROW}.{text}", shingle, similar, _printed(staged))
    rooted = nodes.select("node", "best").join(root, "node", "left").select("best", F.coalesce("root", "node").alias("root"))
    chosen = materialize(rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("sim_row")), "simhash-kept")
    # Always by shuffle: what is kept grows with the rows.
    return unpacked(staged.join(chosen.hint("merge"), "sim_row", "left_semi"))
