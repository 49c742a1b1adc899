"""Mixing sources to target weights by weighted fair queueing.

Every document of a source stands in a shuffled queue (ordered by a hash of its
id). Its virtual finish time is the cumulative size of its source's queue up to
and including it, divided by the source's target; a further copy of the queue
follows the first where the target asks for more than the source holds. All
copies of all documents are put in order of finish time, and the mix is what
fits in the total budget.

No queue and no order ever stands in one task: queues and the global order are
cut into hash or time buckets whose number follows the input, running sums are
taken over the bucket totals, and only single buckets are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: Rows that a bucket of a queue holds on average, at most.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source (``source``, ``source_size``): ``target``, its share of all sizes.

    Sources in code point order, null last, weigh ``weights`` in turn. A target
    stops at ``max_copies`` times its source's size; the excess is reshared by
    weight until none is above: target = min(cap, level * weight), where the
    level is found by filling the sources in order of cap / weight. One row per
    source is handled here, never documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = (sources.withColumn("weight", F.element_at(kinds, (F.row_number().over(order) - 1) % len(weights) + 1))
         .withColumn("cap", F.col("source_size") * F.lit(float(max_copies))))
    # caps below the level come first in this order; the level after the first k of them is
    # (total - their caps) / (weights of the others)
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("_left", F.sum("source_size").over(everyone).cast("double")
                      - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("_weights", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("_level", F.col("_left") / F.col("_weights"))
         # the first source whose cap is not below the level sets it for itself and all after it
         .withColumn("_fits", F.col("_level") * F.col("weight") <= F.col("cap"))
         .withColumn("_level", F.min(F.when(F.col("_fits"), F.struct(F.col("cap") / F.col("weight"),
                                                                      F.col("_level").alias("level")))).over(everyone)["level"]))
    return s.select("source", "source_size",
                    F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_counts(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix",
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: ``doc_id``, ``source``, ``size`` (words), ``source_size``,
    ``target`` (its source's), ``copies`` that the mix takes and ``taken`` words.

    Null texts have size 0; documents of size 0 are never taken. The null source
    is a source of its own. Rows that agree in id and source are one document:
    their sizes add up and they are taken together; a null id is an id like
    others. An empty table gives no rows. Extra columns are not read."""
    rows = (docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
                        word_count(docs[text_col]).alias("size"))
            .groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
            .withColumn("u", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"),
                                                                          F.lit("null"))))))
    rows = written(rows, "mix-sizes")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("u", 1, 8), 16, 10).cast("double")
                                             * F.lit(buckets / 2.0 ** 32)).cast("long"))
    totals = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("total")), "mix-buckets")
    targets = written(source_targets(totals.groupBy("source").agg(F.sum("total").alias("source_size")),
                                     weights, max_copies), "mix-targets")
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (totals.withColumn("before", F.coalesce(F.sum("total").over(in_source), F.lit(0)))
              .join(targets, totals["source"].eqNullSafe(targets["source"]))
              .select(totals["source"].alias("_source"), F.col("bucket").alias("_bucket"), "before",
                      "source_size", "target"))
    queue = Window.partitionBy("source", "bucket").orderBy("u", "doc_id")
    queued = (rows.withColumn("within", F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0)))
              .join(starts, rows["source"].eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
              .select("doc_id", "size", "source", "u", "source_size", "target",
                      (F.col("before") + F.col("within")).alias("upto")))
    queued = written(queued, "mix-queues")
    # every copy of every document, with its virtual finish time
    copies = (queued.where((F.col("size") > 0) & (F.col("target") > 0))
              .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
              .withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target"))
              .select("doc_id", "size", "source", "u", "copy", "finish"))
    kept = within_budget(copies, targets.agg(F.sum("source_size")).first()[0] or 0, buckets)
    taken = kept.groupBy("doc_id", "source").agg(F.count(F.lit(1)).cast("int").alias("copies")).alias("t")
    n = F.coalesce(F.col("copies"), F.lit(0))
    q = queued.alias("q")
    return (q.join(taken, F.col("q.doc_id").eqNullSafe(F.col("t.doc_id"))
                   & F.col("q.source").eqNullSafe(F.col("t.source")), "left")
            .select("q.doc_id", "q.source", "size", "source_size", "target", n.alias("copies"),
                    (n * F.col("size")).cast("long").alias("taken")))


def within_budget(copies: DataFrame, budget: int, buckets: int) -> DataFrame:
    """The copies, in order of finish time, whose running size is within the
    budget. Targets add up to the budget, so the cut is near time 1: time is
    ranged into even slots up to 2 and one rest, slots below the cut are kept
    whole, and only the slot of the cut is sorted."""
    slotted = copies.withColumn("slot", F.least(F.floor(F.col("finish") * F.lit(buckets * 4.0)),
                                                F.lit(buckets * 8)).cast("long"))
    running = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    cut = (slotted.groupBy("slot").agg(F.sum("size").alias("total"))
           .withColumn("upto", F.sum("total").over(running)).where(F.col("upto") > budget)
           .agg(F.min("slot").alias("slot"), F.min(F.col("upto") - F.col("total")).alias("before")).first())
    if cut["slot"] is None:
        return slotted
    order = (Window.partitionBy("slot").orderBy("finish", "source", "copy", "u", "doc_id")
             .rowsBetween(Window.unboundedPreceding, 0))
    edge = (slotted.where(F.col("slot") == cut["slot"])
            .withColumn("upto", F.lit(cut["before"]) + F.sum("size").over(order))
            .where(F.col("upto") <= budget).drop("upto"))
    return slotted.where(F.col("slot") < cut["slot"]).unionByName(edge)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    counts = (mix_counts(docs, **options).where("copies > 0")
              .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("copies").alias("_copies")))
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    joined = docs.join(counts, docs[id_col].eqNullSafe(counts["_id"]) & docs[source_col].eqNullSafe(counts["_source"]))
    each = F.explode(F.sequence(F.lit(1), counts["_copies"])).alias("_mix_copy_number")
    return joined.select(*[docs[c] for c in docs.columns], each).drop("_mix_copy_number")


#: DuckDB: the size, shuffle, targets and cut of the mix with default options.
_SQL_PARTS = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([1, 2, 3][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
         3.0::DOUBLE * source_size AS cap FROM sources),
filling AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT arg_min(level, cap / weight) FILTER (WHERE level * weight <= cap) AS level FROM filling),
targets AS (
  SELECT source, source_size, least(cap, coalesce(found.level * weight, cap)) AS target FROM weighed, found),
queued AS (
  SELECT s.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CAST(copy * source_size + upto AS DOUBLE) / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND target > 0),
running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, copy, u, doc_id ROWS UNBOUNDED PRECEDING) AS total
  FROM copies),
taken AS (
  SELECT doc_id, source, count(*) AS copies FROM running
  WHERE total <= (SELECT sum(source_size) FROM sources) GROUP BY doc_id, source)
"""

SQL = _SQL_PARTS + """
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source"""
