"""Exact duplicates by deterministic block naming (DataFrame operations only).

Texts are cut into blocks of a fixed number of bytes. Distinct blocks are sorted
and named by integers, so two blocks have one name exactly if they are equal.
Adjacent names are then paired and the distinct pairs named in the same way,
level by level, until every document has one name. Documents are equal exactly
if they reach one name at the same level: the names are collision-free.

A name is looked up by the 64-bit hash of its block or pair, so that block texts
cross a shuffle once, in the sort that names them. Where two different
blocks share a hash, the hash is set aside and those rows are joined by their
content instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import written

BLOCK_BYTES = 4096
#: Ids of dropped rows are broadcast up to this number (16 MB), else joined by a shuffle.
BROADCAST_IDS = 1 << 21
#: Groups of more rows meet their documents by a broadcast (there is at most one of them
#: for so many rows), up to this number of groups.
HOT_GROUP, BROADCAST_GROUPS = 1 << 10, 1 << 20


#: The right half of a pair that has none. Names are never -1.
NO_NAME = -1


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row per block: (doc_id, row_hash, n_bytes, left, pos, hash, block);
    ``left`` is the number of blocks. An empty text is one empty block."""
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("t")).select(
        "doc_id", "t", F.xxhash64("t").alias("row_hash"), F.length("t").cast("long").alias("n_bytes"))
    left = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / F.lit(block_bytes))).cast("int")
    rows = rows.withColumn("left", left)
    return (rows.select("doc_id", "row_hash", "n_bytes", "left", F.posexplode(F.transform(
                F.sequence(F.lit(0), F.col("left") - 1),
                lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"))
            .withColumn("hash", F.xxhash64("block")))


def _named(contents: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys``, sorted inside the ranges of hash space that the
    grouping leaves them in, and named by their positions: unique integers >= 0."""
    return (contents.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
            .sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))


def _first_names(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Level 0: (doc_id, row_hash, n_bytes, left, pos, name) for every block."""
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    names = written(_named(blocks, ["hash", "block"]).select("hash", "name"), "block-names")
    shared = names.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("hash")
    cols = ["doc_id", "row_hash", "n_bytes", "left", "pos", "name"]
    if shared.isEmpty():
        return blocks.join(names, "hash").select(cols)
    shared = written(shared, "shared-hashes")
    contents = written(_named(blocks.join(shared, "hash", "left_semi"), ["hash", "block"])
                       .withColumn("name", -2 - F.col("name")), "shared-names")
    alone = blocks.join(shared, "hash", "left_anti").join(names, "hash").select(cols)
    return alone.unionByName(blocks.join(contents, ["hash", "block"]).select(cols))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, row_hash, n_bytes, level, name) for every different (id, text):
    two texts are equal exactly if they agree in (level, name)."""
    cols = ["doc_id", "row_hash", "n_bytes", "left", "pos", "name"]
    rows = written(_first_names(docs, id_col, text_col, block_bytes).select(cols), "names-0")
    done, level = [], 0
    while True:
        ended = rows.where(F.col("left") == 1).select("doc_id", "row_hash", "n_bytes", F.lit(level).alias("level"), "name")
        # rows that repeat an id and its text say the same twice
        done.append(ended.distinct() if level == 0 else ended)
        rows = rows.where(F.col("left") > 1)
        if rows.isEmpty():
            break
        level += 1
        half = F.col("pos") % 2
        pairs = rows.groupBy("doc_id", "row_hash", "n_bytes", "left", F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(NO_NAME)).alias("b"))
        pairs = written(pairs, f"pairs-{level}")
        names = written(_named(pairs, ["a", "b"]), f"pair-names-{level}")
        rows = written(pairs.join(names, ["a", "b"]).select(
            "doc_id", "row_hash", "n_bytes", F.ceil(F.col("left") / 2).cast("int").alias("left"),
            F.col("half").alias("pos"), "name"), f"names-{level}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``doc_id``, ``keep_id`` (the largest id among equal texts),
    ``group_size`` (rows with this text), ``kept``, ``text_sha256`` and ``n_rows``.

    Texts are equal when identical after no change; a null text counts as
    empty, and empty texts form one group. Rows that repeat both id and text
    are one document, counted in ``n_rows`` and in ``group_size``; rows that
    share only an id are different documents. Null ids come below all others;
    a group of null ids only keeps them. An empty table gives no rows."""
    ids = written(identities(docs, id_col, text_col, block_bytes), "identities")
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = (docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("row_hash"),
                        F.length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))
            .groupBy("doc_id", "row_hash", "n_bytes", "text_sha256").agg(F.count(F.lit(1)).alias("n_rows")))
    known = ids.alias("i").join(rows.alias("r"), (F.col("i.row_hash") == F.col("r.row_hash"))
                                & (F.col("i.n_bytes") == F.col("r.n_bytes"))
                                & F.col("i.doc_id").eqNullSafe(F.col("r.doc_id")))
    known = written(known.select("i.doc_id", "level", "name", "text_sha256", "n_rows"), "named-documents")
    groups = known.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    return (_with_groups(known, written(groups, "groups"))
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256", "n_rows"))


def _with_groups(known: DataFrame, groups: DataFrame) -> DataFrame:
    """``known`` with the columns of its group. Rows of a large group never meet in
    one task: large groups are counted, and up to ``BROADCAST_GROUPS`` of them broadcast."""
    keys = ["level", "name"]
    hot = groups.where(F.col("group_size") > HOT_GROUP)
    if not 0 < hot.count() <= BROADCAST_GROUPS:
        return known.join(groups, keys)
    large = known.join(F.broadcast(hot), keys)
    rest = known.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups, keys)
    return large.unionByName(rest)


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``dropped`` (one id column). The
    ids are counted first: up to ``BROADCAST_IDS`` of them are broadcast, more
    are joined by a shuffle. A null id matches a null id."""
    dropped = written(dropped.toDF("_dropped"), "dropped-ids")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs[id_col].eqNullSafe(dropped["_dropped"]), "left_anti")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the
    row with the largest id, once. Ids name documents here: of rows that share
    an id but not the text, each goes only if its own text has a larger id."""
    groups = written(exact_groups(docs, id_col, text_col, block_bytes), "exact-groups")
    per_id = groups.groupBy("doc_id").agg(F.min(F.col("kept").cast("int")).alias("all"),
                                          F.max(F.col("kept").cast("int")).alias("any"),
                                          F.sum("n_rows").alias("n"))
    per_id = written(per_id, "exact-ids")
    plain = per_id.where((F.col("any") == 0) | (F.col("n") > 1)).select("doc_id")
    rest = without_ids(docs, plain, id_col)
    unclear = per_id.where((F.col("any") == 1) & (F.col("n") > 1)).select(F.col("doc_id").alias("_unclear"))
    if unclear.isEmpty():
        return rest
    # several rows with one id: decided row by row, by id and text
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)
    kept = groups.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha256"))
    several = (docs.join(unclear, docs[id_col].eqNullSafe(unclear["_unclear"]), "left_semi").withColumn("_dedup_sha256", sha)
               .join(kept, F.col(id_col).eqNullSafe(F.col("_kept_id"))
                     & (F.col("_dedup_sha256") == F.col("_kept_sha256")), "left_semi")
               .dropDuplicates([id_col, "_dedup_sha256"]).drop("_dedup_sha256"))
    return rest.unionByName(several)
