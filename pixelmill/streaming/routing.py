"""Arriving requests, each answered by the model that it names.

A stream of requests is answered batch by batch. The answers of a batch are one
folder, ``batch=<id>``, split by ``sink`` (scored, rejected); a batch that runs again
after a failure replaces its whole folder, so that every request leaves exactly one
row in exactly one sink, also when the models have changed in between. Models
are read again when the model store has changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators import scoring as Sc
from pixelmill.operators.models import load_models
from pixelmill.schemas import MODEL_NAMES
from pixelmill.session import scratch_path

#: Columns of an answer that only one of the sinks has.
ONLY_SCORED = ["prediction", "score", "flag", "class_predicted", "diagnosis"]
ONLY_REJECTED = ["reason", "available_models"]


class ModelStore:
    """The saved models under a folder, read again when one of them has changed."""

    def __init__(self, spark: SparkSession, root: str, names=MODEL_NAMES, prefix: str = "spark_"):
        self.spark, self.root, self.names, self.prefix = spark, root.rstrip("/"), tuple(names), prefix
        self._seen: tuple | None = None
        self._models: dict[str, PipelineModel] = {}
        self.loads = 0

    def state(self) -> tuple:
        """(name, time of the last change) of every model that is there: a model is
        written with its metadata folder, which a save replaces."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        found = []
        for name in self.names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.prefix}{name}/metadata")
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                files = sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(path))
                found.append((name, tuple(files)))
        return tuple(found)

    def current(self) -> dict[str, PipelineModel]:
        state = self.state()
        if state != self._seen:
            self._models, _ = load_models(self.spark, self.root, self.names, self.prefix)
            self._seen = state
            self.loads += 1
        return self._models


def write_batch(answers: DataFrame, out_path: str, batch_id: int) -> None:
    """One batch of answers, both sinks in one job; replaces what the batch left before."""
    answers.write.partitionBy("sink").mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")


def route_stream(spark: SparkSession, store: ModelStore, source: DataFrame, model_col: str, keys: list[str],
                 out_path: str | None = None, checkpoint: str | None = None,
                 prepare: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Answers everything that has arrived at ``source`` (a streaming DataFrame with
    ``keys``, the requested model's name and the models' input, or what
    ``prepare`` makes it from) and returns the folder of the answers. Run again on the
    same folder and checkpoint, it goes on where it stopped. A store without
    models rejects every request."""
    out_path = out_path or scratch_path(spark, "answers")
    checkpoint = checkpoint or scratch_path(spark, "answers-ckpt")

    def answer(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        write_batch(Sc.answer_requests(store.current(), rows, model_col, keys), out_path, batch_id)

    query = (source.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return out_path


def answers(spark: SparkSession, out_path: str) -> DataFrame:
    """All answers so far, with ``batch`` and ``sink``."""
    return spark.read.option("basePath", out_path).parquet(f"{out_path.rstrip('/')}/batch=*")


def scored(spark: SparkSession, out_path: str) -> DataFrame:
    return answers(spark, out_path).where(F.col("sink") == Sc.SCORED).drop("sink", *ONLY_REJECTED)


def rejected(spark: SparkSession, out_path: str) -> DataFrame:
    return answers(spark, out_path).where(F.col("sink") == Sc.REJECTED).drop("sink", *ONLY_SCORED)
