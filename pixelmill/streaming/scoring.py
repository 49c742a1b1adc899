"""The request/response scoring path as a Structured Streaming query.

New rows (or image files) arriving under a folder are scored by a saved
pipeline and appended to a Parquet sink. The query is stateless, so it needs
no watermark; the checkpoint makes it exactly-once across restarts and
executor loss. ``availableNow`` processes everything present, then stops.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pixelmill.operators.scoring import score
from pixelmill.schemas import IMAGE_STRUCT
from pixelmill.session import scratch_path


def stream_score(spark: SparkSession, model: PipelineModel, source: DataFrame, keys: list[str],
                 model_name: str, out_path: str | None = None,
                 checkpoint: str | None = None, prepare=None) -> DataFrame:
    """Run a streaming scoring query to completion and return the sink table.

    ``source`` is a streaming DataFrame; ``prepare`` optionally maps it to the
    model's input (e.g. image decoding + feature extraction)."""
    out_path = out_path or scratch_path(spark, "scored")
    checkpoint = checkpoint or scratch_path(spark, "scored-ckpt")
    frame = prepare(source) if prepare else source
    q = (score(model, frame, keys, model_name).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_path)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType,
                   max_files_per_trigger: int = 1000) -> DataFrame:
    """Rows of Parquet files as a stream; a backlog is taken up in batches of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def image_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Image files under a folder (any depth) as a stream; bad files are dropped."""
    return (spark.readStream.format("image").schema(T.StructType([T.StructField("image", IMAGE_STRUCT)]))
            .option("dropInvalid", True).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))
