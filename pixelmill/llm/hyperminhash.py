"""Near-duplicate documents by HyperMinHash registers, banding and verification.

1. A document's set holds the 64-bit hashes of its distinct five-word shingles.
   Every shingle falls into one of ``BANDS * ROWS`` buckets; a bucket keeps the
   least second hash in it, compressed to its leading-zero count and the
   ``MANTISSA`` bits that follow its first one bit.
2. Equal sets are one node from here on (copies are never paired).
3. Registers are banded. In every bucket of equal bands one node is the hub: the
   one whose buckets are the fullest, which tends to be the least edited copy. A
   node is first tested against the hub that it shares most bands with.
4. A pair is tested by its registers (Jaccard estimate, corrected for chance
   collisions, five standard errors of margin) and then on the full sets.
5. Buckets that still hold several components are compared across components,
   every pair in the first band that it shares. In small buckets the pairs above the
   margin are tested as in 4. Larger ones are cut into blocks; a task holds two
   blocks with their full sets, goes through the members outside the largest
   component, best estimates first, and gives one confirmed link for each other
   component. So no group is ever paired in full, and yet no pair is left out that
   could join two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import SpanHash, by_group, mix, multi_arange, slices, text_buffer, word_spans, written
from pixelmill.llm.components import connected_components
from pixelmill.llm.exact_dedup import BROADCAST_IDS, without_ids

WORDS = 5
THRESHOLD_PERCENT = 75
#: At similarity 0.75 a pair of larger sets shares no band with probability
#: (1 - 0.75 ** ROWS) ** BANDS, about 1e-10.
BANDS, ROWS = 42, 3
MANTISSA = 26
EMPTY = 0xFFFFFFFF
#: Standard errors that the estimate may lie below the threshold.
MARGIN = 5.0
#: Buckets of up to so many members give pairs; larger ones are worked on in blocks.
SMALL = 64
#: Members of a block; a task holds two blocks.
BLOCK = 1024
RUN_BYTES = 4 << 20
BATCH_BYTES = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """Distinct shingle hashes of all texts: (owner, hash), sorted by both."""
    lower = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
    start, end, first = word_spans(lower, offsets)
    value = SpanHash(lower)(start, end)
    n = np.diff(first)
    size = np.minimum(n, words)  # words of a shingle; a short text is one shingle
    count = np.where(n > 0, n - size + 1, 0)
    at = multi_arange(first[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    width = size[owner]
    h = mix(width.astype(np.uint64))
    for i in range(words):
        use = width > i
        h = np.where(use, mix(h * np.uint64(0x9E3779B97F4A7C15) + value[np.where(use, at + i, at)]), h) if len(at) else h
    cuts = np.concatenate([[0], np.cumsum(count)])
    sets = [np.unique(h[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return (np.repeat(np.arange(len(n)), [len(x) for x in sets]),
            np.concatenate(sets) if sets else np.empty(0, np.uint64))


def registers(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """One row of compressed registers per text."""
    buckets = BANDS * ROWS
    v = mix(h ^ np.uint64(0xD1B54A32D192ED03))
    _, e = np.frexp((v >> np.uint64(11)).astype(np.float64))
    e = np.maximum(e.astype(np.int64) + 10, 0)  # position of the first one bit: 63 - leading zeros
    rest = (v << (np.uint64(63) - e.astype(np.uint64))) << np.uint64(1)
    code = (e.astype(np.uint64) << np.uint64(MANTISSA)) | (rest >> np.uint64(64 - MANTISSA))
    out = np.full(n * buckets, EMPTY, np.uint32)
    np.minimum.at(out, owner * buckets + (h % np.uint64(buckets)).astype(np.int64), code.astype(np.uint32))
    return out.reshape(n, buckets)


def node_names(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a whole set, and its size."""
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(one, owner, mix(h + np.uint64(0x632BE59BD9B4E019)))
    np.add.at(two, owner, mix(h ^ np.uint64(0x8CB92BA72F3D8DD7)))
    return np.stack([one, two], 1), np.bincount(owner, minlength=n)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, n, regs) per row; regs is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            owner, h = shingle_sets(*text_buffer(batch.column(1)))
            names, sizes = node_names(owner, h, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _packed(names), pa.array(sizes, pa.int64()),
                 _packed(registers(owner, h, batch.num_rows))], names=["key", "node", "n", "regs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
            .mapInArrow(run, f"key {kind}, node binary, n long, regs binary")
            .withColumnRenamed("key", "doc_id"))


def _band_rows(nodes: DataFrame) -> DataFrame:
    """(key, b, nid): a row for every band of a node that holds anything."""
    width = ROWS * 4
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                                 lambda b: F.struct(b.alias("b"), F.substring("regs", b * width + 1, F.lit(width)).alias("r"))))
    nothing = F.unhex(F.lit("FF" * width))
    return (nodes.select("nid", band.alias("x")).where(F.col("x.r") != nothing)
            .select(F.xxhash64("x.b", "x.r").alias("key"), F.col("x.b").alias("b"), "nid"))


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for chance collisions, and
    whether each is within the margin of the threshold. Broadcasts like numpy."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    equal = ((a == b) & (a != EMPTY)).sum(-1)
    used = np.maximum(used, 1)
    # chance that two different minima get one register (HyperMinHash, large sets)
    chance = 0.169919487159739 * 4 * (n_a * n_b) / np.maximum(n_a + n_b, 1) ** 2.0 / 2.0 ** MANTISSA
    jaccard = (equal / used - chance) / (1 - chance)
    t = THRESHOLD_PERCENT / 100
    # the minima of the buckets are drawn from the union without replacement
    union = np.maximum((n_a + n_b) / (1 + t), used + 1)
    spread = np.sqrt(t * (1 - t) / used * (union - used) / (union - 1))
    return jaccard, jaccard >= t - MARGIN * spread - 1 / used


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), BANDS * ROWS)


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers do not rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            _, near = estimates(_regs(batch.column("r_a")), _regs(batch.column("r_b")), n_a, n_b)
            near &= 100 * np.minimum(n_a, n_b) >= THRESHOLD_PERCENT * np.maximum(n_a, n_b)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near))

    side = lambda c: nodes.select(F.col("nid").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(nid, set): the full sets of the wanted nodes (nid, node, first_id), from
    the texts of one document each."""
    ids = written(wanted.select(F.col("first_id").alias("_id")).distinct(), "wanted-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    texts = texts.join(ids, F.col("key").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            owner, h = shingle_sets(*text_buffer(batch.column(0)))
            names, _ = node_names(owner, h, batch.num_rows)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [_packed(names), pa.array([h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["node", "set"])

    found = texts.mapInArrow(run, "node binary, set binary")
    return (found.join(wanted.select("nid", "node"), "node")
            .groupBy("nid").agg(F.first("set").alias("set")))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are a link."""
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= THRESHOLD_PERCENT * (len(x) + len(y) - common)


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_linked(_set(x), _set(y)) for x, y in zip(batch.column("s_a"), batch.column("s_b"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c: sets.select(F.col("nid").alias(c), F.col("set").alias(f"s_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band that register rows share (BANDS where none is)."""
    shape = (*np.broadcast_shapes(a.shape, b.shape)[:-1], BANDS, ROWS)
    same = ((a == b).reshape(shape).all(-1)) & np.broadcast_to(a != EMPTY, (*shape[:-2], BANDS * ROWS)).reshape(shape).any(-1)
    return np.where(same.any(-1), same.argmax(-1), BANDS)


class _Bucket:
    """Members of one bucket: ids, components, set sizes and registers."""

    def __init__(self, table: pa.Table):
        self.nid, self.comp, self.n = (table[c].to_numpy() for c in ("nid", "component", "n"))
        self.regs = _regs(table["regs"])
        self.band = table["b"].to_numpy()

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of members, those in different components that the registers
        do not rule out and that share no earlier band; and their estimates."""
        ok = (self.comp[x] != self.comp[y]) & (
            100 * np.minimum(self.n[x], self.n[y]) >= THRESHOLD_PERCENT * np.maximum(self.n[x], self.n[y]))
        x, y = x[ok], y[ok]
        value, ok = estimates(self.regs[x], self.regs[y], self.n[x].astype(float), self.n[y].astype(float))
        x, y, value = x[ok], y[ok], value[ok]
        ok = _first_shared(self.regs[x], self.regs[y]) == self.band[x]
        return x[ok], y[ok], value[ok]


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin, and its end."""
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        v = table[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])


def _small_pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    bucket, cuts = _Bucket(table), _cuts(table, ["key"])
    sizes = np.diff(cuts)
    # every member with all members after it in its bucket
    rest = np.repeat(cuts[1:], sizes) - np.arange(table.num_rows) - 1
    x, y = np.repeat(np.arange(table.num_rows), rest), multi_arange(np.arange(table.num_rows) + 1, rest)
    for at in range(0, len(x), 1 << 14):
        a, b, _ = bucket.near(x[at:at + (1 << 14)], y[at:at + (1 << 14)])
        a, b = bucket.nid[a], bucket.nid[b]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _large_links(table: pa.Table) -> Iterator[pa.RecordBatch]:
    cuts = _cuts(table, ["key", "i", "j"])
    for begin, end in zip(cuts, cuts[1:]):
        yield _block_links(table.slice(begin, end - begin).combine_chunks())


def _block_links(table: pa.Table) -> pa.RecordBatch:
    """One confirmed link for each two components that have one, of two blocks."""
    bucket, sets = _Bucket(table), table["set"]
    i, j, own = table["i"][0].as_py(), table["j"][0].as_py(), table["own"].to_numpy()
    kinds, sizes = np.unique(bucket.comp, return_counts=True)
    main = bucket.comp == kinds[np.argmax(sizes)]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    filled = (bucket.regs != EMPTY).sum(1)
    found, a, b = set(), [], []

    def against(xs: np.ndarray, ys: np.ndarray, same_block: bool) -> None:
        others = bucket.regs[ys]
        for x in xs.tolist():
            # equal registers alone rule out most pairs; an empty one equals none
            own_regs = np.where(bucket.regs[x] == EMPTY, EMPTY - 1, bucket.regs[x]).astype(np.uint32)
            equal = np.count_nonzero(others == own_regs, axis=1)
            most = np.maximum(filled[x], filled[ys])
            t = THRESHOLD_PERCENT / 100
            y = ys[equal >= (t - MARGIN * np.sqrt(t * (1 - t) / most)) * most - 1]
            if same_block:
                y = y[main[y] | (y > x)]
            u, v, value = bucket.near(np.full(len(y), x), y)
            order = np.argsort(-value, kind="stable")
            for u, v in zip(u[order].tolist(), v[order].tolist()):
                two = frozenset((int(bucket.comp[u]), int(bucket.comp[v])))
                if two not in found and _linked(_set(sets[u]), _set(sets[v])):
                    found.add(two)
                    a.append(min(bucket.nid[u], bucket.nid[v]))
                    b.append(max(bucket.nid[u], bucket.nid[v]))

    # members of the largest component need no comparison with each other
    against(left[~main[left]], right, i == j)
    if i != j:
        against(right[~main[right]], left[main[left]], False)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _blocked(large: DataFrame) -> DataFrame:
    """Members of large buckets, once for each pair (i, j) of blocks that theirs is
    compared in. Members of a bucket's largest component are only compared with
    the others: these come in the first blocks, each of which meets all blocks."""
    counts = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"))
    rows = (large.join(top, "key").withColumn("main", F.col("component") == F.col("top.component"))
            .withColumn("minor_blocks", F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int"))
            .withColumn("blocks", F.col("minor_blocks") + F.ceil(F.col("top.c") / BLOCK).cast("int")))
    columns = ["key", "b", "nid", "component", "own", "i", "j"]
    none = F.lit(0)
    whole = (rows.where(F.col("all") <= BLOCK).withColumn("own", none).withColumn("i", none).withColumn("j", none))
    place = F.xxhash64("nid")
    own = F.when(F.col("main"), F.col("minor_blocks") + F.pmod(place, (F.col("blocks") - F.col("minor_blocks")).cast("long")))
    cut = (rows.where(F.col("all") > BLOCK)
           .withColumn("own", own.otherwise(F.pmod(place, F.col("minor_blocks").cast("long"))).cast("int"))
           .withColumn("other", F.explode(F.sequence(none, F.when(F.col("main"), F.col("minor_blocks"))
                                                     .otherwise(F.col("blocks")) - 1)))
           .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))
    return whole.select(columns).unionByName(cut.select(columns))


def _links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of all nodes that are linked with another."""
    bands = _band_rows(nodes)
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "band-buckets")
    members = written(bands.join(shared, "key").select("key", "b", "nid", "size"), "band-members")
    fullness = members.groupBy("nid").agg(F.sum("size").alias("fullness"))
    hubs = (members.join(fullness, "nid").groupBy("key")
            .agg(F.max(F.struct("fullness", (-F.col("nid")).alias("hub"))).alias("top"))
            .select("key", (-F.col("top.hub")).alias("hub")))
    start = (members.join(hubs, "key").where(F.col("nid") != F.col("hub"))
             .groupBy("nid", "hub").agg(F.count(F.lit(1)).alias("bands"))
             .groupBy("nid").agg(F.max(F.struct("bands", (-F.col("hub")).alias("hub"))).alias("best"))
             .select(F.least("nid", -F.col("best.hub")).alias("a"), F.greatest("nid", -F.col("best.hub")).alias("b"))
             .distinct())
    known = nodes.select("nid", "node", "first_id")

    def sets_of(nids: DataFrame, have: DataFrame | None = None) -> DataFrame:
        nids = nids.distinct() if have is None else nids.distinct().join(have.select("nid"), "nid", "left_anti")
        more = written(_sets(docs, known.join(nids, "nid"), id_col, text_col), "shingle-sets")
        return more if have is None else have.unionByName(more)

    both = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("nid"))
    pairs = written(_likely(start, nodes), "likely-pairs")
    sets = sets_of(both(pairs))
    links = written(_confirmed(pairs, sets), "links")
    component = connected_components(links)
    placed = (members.join(component, F.col("nid") == F.col("node"), "left")
              .select("key", "b", "nid", F.coalesce("component", "nid").alias("component"), "size"))
    open_keys = (placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                 .where("low < high").select("key"))
    left = written(placed.join(open_keys, "key", "left_semi"), "open-buckets")
    if left.isEmpty():
        return component
    registers_of = nodes.select("nid", "n", "regs")
    columns = ["nid", "b", "component", "n", "regs"]
    small = written(by_group(left.where(F.col("size") <= SMALL).join(registers_of, "nid"), ["key"], columns, _small_pairs,
                             "a long, b long", "regs", RUN_BYTES)
                    .distinct().join(pairs, ["a", "b"], "left_anti"), "small-pairs")
    large = left.where(F.col("size") > SMALL)
    sets = sets_of(both(small).unionByName(large.select("nid")), sets)
    more = _confirmed(small, sets)
    if not large.isEmpty():
        blocked = _blocked(large).join(registers_of, "nid").join(sets, "nid")
        more = more.unionByName(by_group(blocked, ["key", "i", "j"], [*columns, "own", "set"], _large_links,
                                         "a long, b long", "set", RUN_BYTES))
    return connected_components(links.unionByName(written(more, "more-links")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` (size of its set), ``component_id``
    (smallest id reachable by links, its own included), ``kept`` (it is that id).

    Words are lower-cased in A-Z only; a text of one to four words is one
    shingle. Null, empty and blank texts have an empty set and are linked with
    nothing, not even each other. Rows that repeat an id and text share a
    component and are both kept if their id is the smallest; a null id is never
    the smallest, and a component of null ids only has none. An empty table
    gives no rows. Extra columns are not read."""
    rows = written(_sketched(docs, id_col, text_col), "sketches")
    nodes = written(rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        .withColumn("nid", F.monotonically_increasing_id()), "nodes")
    component = _links(docs, nodes, id_col, text_col)
    placed = nodes.select("nid", "node", "first_id").join(component.withColumnRenamed("node", "_nid"),
                                                          F.col("nid") == F.col("_nid"), "left")
    placed = written(placed.select("node", "first_id", F.coalesce("component", "nid").alias("component")), "placed-nodes")
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = written(placed.join(least, "component").select("node", "component_id"), "named-nodes")
    full = rows.where("n > 0").select("doc_id", "node", "n").join(named, "node")
    alone = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return full.select(*cols).unionByName(alone.select(*cols))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stays: one id of each component. A
    row goes if no row with its id is kept."""
    groups = near_groups(docs, id_col, text_col)
    dropped = groups.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return without_ids(docs, dropped, id_col)
