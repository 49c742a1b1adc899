"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import written


def _roots(parent: DataFrame) -> DataFrame:
    """(r, t): every node of a forest with its root, by pointer jumping.
    ``parent`` has t < r in every row, so there is no cycle."""
    while True:
        up = parent.select(F.col("r").alias("_r"), F.col("t").alias("_t"))
        jumped = written(parent.join(up, F.col("t") == F.col("_r"), "left")
                         .select("r", F.coalesce("_t", "t").alias("t"), F.col("_t").isNotNull().alias("moved")),
                         "cc-jump")
        parent = jumped.select("r", "t")
        if jumped.where("moved").isEmpty():
            return parent


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); the component
    is its smallest node. Loops and repeated links do no harm.

    Each round hangs every node that has a smaller neighbour on its smallest
    one, finds the roots of that forest and contracts the links to them; links
    vanish at a geometric rate, so rounds are logarithmic in the input."""
    edges = links.select("a", "b").where(F.col("a") != F.col("b"))
    labels = None
    while True:
        edges = written(edges.select(F.greatest("a", "b").alias("r"), F.least("a", "b").alias("t")).distinct(), "cc-edges")
        if edges.isEmpty():
            break
        roots = _roots(edges.groupBy("r").agg(F.min("t").alias("t")))
        if labels is None:
            everyone = edges.select(F.explode(F.array("r", "t")).alias("node")).distinct()
            labels = everyone.withColumn("component", F.col("node"))
        labels = written(labels.join(roots, F.col("component") == F.col("r"), "left")
                         .select("node", F.coalesce("t", "component").alias("component")), "cc-labels")
        one = roots.select(F.col("r").alias("_r1"), F.col("t").alias("_t1"))
        two = roots.select(F.col("r").alias("_r2"), F.col("t").alias("_t2"))
        edges = (edges.join(one, F.col("r") == F.col("_r1"), "left").join(two, F.col("t") == F.col("_r2"), "left")
                 .select(F.coalesce("_t1", "r").alias("a"), F.coalesce("_t2", "t").alias("b"))
                 .where(F.col("a") != F.col("b")))
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    return labels
