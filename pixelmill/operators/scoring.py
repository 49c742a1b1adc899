"""Batch scoring with fitted pipelines (R1, R2 tail, R4, P6, X8).

Several models score the same rows in one projection: each pipeline is copied with
output columns of its own, so the rows are scanned once, whatever the number of
models. Requests that name a model become exactly one answer each, either scored or
rejected with a reason.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.compare import MISSING_MODEL_TEXT, UNKNOWN_MODEL_TEXT
from pixelmill.operators.metrics import decision, positive_score

_INPUTS = ("inputCol", "featuresCol")
_OUTPUTS = ("outputCol", "predictionCol", "rawPredictionCol", "probabilityCol")
SCORED, REJECTED = "scored", "rejected"
INVALID_INPUT_TEXT = "Entrée nulle, non finie ou de taille inattendue"


def _timestamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")


def score(model: PipelineModel, df: DataFrame, keys: list[str], model_name: str) -> DataFrame:
    """R1 + P6: predictions with decision fields, the model name and an ISO
    timestamp. Narrow: the model's coefficients / trees travel to the tasks."""
    pred = model.transform(df)
    return pred.select(
        *keys, F.col("prediction"), positive_score("rawPrediction").alias("score"),
        *decision("prediction"), F.lit(model_name).alias("model"), _timestamp())


def _copied(model: PipelineModel, tag: str) -> tuple[list[Transformer], dict[str, str]]:
    """The stages of a pipeline with every output column renamed to end in ``tag``, and
    the new names. An assembler keeps rows with nulls: nothing drops out."""
    names: dict[str, str] = {}
    stages = []
    for stage in model.stages:
        stage = stage.copy()
        for p in _INPUTS:
            if stage.hasParam(p):
                old = stage.getOrDefault(p)
                stage._set(**{p: names.get(old, old)})
        if stage.hasParam("inputCols"):
            stage._set(inputCols=[names.get(c, c) for c in stage.getInputCols()])
        if isinstance(stage, VectorAssembler):
            stage._set(handleInvalid="keep")
        for p in _OUTPUTS:
            if stage.hasParam(p) and stage.getOrDefault(p):
                old = stage.getOrDefault(p)
                names[old] = f"{old}{tag}"
                stage._set(**{p: names[old]})
        stages.append(stage)
    return stages, names


def _usable(model: PipelineModel, df: DataFrame) -> tuple[Column, dict[str, Column]]:
    """Whether a row can go through a pipeline (its inputs are there and finite, vectors
    of the fitted length), and the input columns with zeros where it can not."""
    first = model.stages[0]
    columns = first.getInputCols() if first.hasParam("inputCols") and first.isSet("inputCols") else [
        next(first.getOrDefault(p) for p in _INPUTS if first.hasParam(p))]
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine, filled = F.lit(True), {}
    for c in columns:
        if isinstance(df.schema[c].dataType, VectorUDT):
            size = next((int(s.numFeatures) if hasattr(s, "numFeatures") else int(s.mean.size) for s in model.stages
                         if hasattr(s, "numFeatures") or hasattr(s, "mean")), None)
            values = vector_to_array(F.col(c))
            ok = F.col(c).isNotNull() & F.forall(values, finite)
            if size is not None:
                ok = ok & (F.size(values) == size)
                filled[c] = F.when(ok, F.col(c)).otherwise(array_to_vector(F.array_repeat(F.lit(0.0), size)))
        else:
            ok = finite(F.col(c).cast("double"))
            filled[c] = F.when(ok, F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType))
        fine = fine & F.coalesce(ok, F.lit(False))
    return fine, filled


def with_scores(models: dict[str, PipelineModel], df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with the scores of every model added in one projection, and for each
    model a column (fine, prediction, score); ``fine`` is false where the row's input
    is null, not finite or of another length."""
    out, answers = df, {}
    for n, name in enumerate(sorted(models)):
        fine, filled = _usable(models[name], df)
        tag = f"__{n}"
        stages, names = _copied(models[name], tag)
        out = out.withColumn(f"_fine{tag}", fine)
        for c, value in filled.items():
            # the pipeline reads a column of its own, so that the row itself stays as it is
            out = out.withColumn(f"{c}{tag}_in", value)
            for stage in stages:
                for p in _INPUTS:
                    if stage.hasParam(p) and stage.getOrDefault(p) == c:
                        stage._set(**{p: f"{c}{tag}_in"})
                if stage.hasParam("inputCols"):
                    stage._set(inputCols=[f"{c}{tag}_in" if x == c else x for x in stage.getInputCols()])
        out = PipelineModel(stages).transform(out)
        answers[name] = F.struct(F.col(f"_fine{tag}").alias("fine"), F.col(names["prediction"]).alias("prediction"),
                                 positive_score(names["rawPrediction"]).alias("score"))
    return out, answers


def score_all(models: dict[str, PipelineModel], df: DataFrame, keys: list[str]) -> DataFrame:
    """R1 with every model: one row for each row of ``df`` and model, as :func:`score`
    gives them; rows that cannot be scored have null predictions. One scan."""
    if not models:
        raise ValueError("no models to score with")
    scored, answers = with_scores(models, df)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), a.alias("a")) for name, a in answers.items()]))
    rows = scored.select(*keys, each.alias("_x"))
    value = lambda c: F.when(F.col("_x.a.fine"), F.col(f"_x.a.{c}"))
    rows = rows.select(*keys, F.col("_x.model").alias("model"), value("prediction").alias("prediction"), value("score").alias("score"))
    return rows.select(*keys, "prediction", "score", *_decided("prediction"), "model", _timestamp())


def _decided(prediction: str) -> list[Column]:
    """The decision fields, null where there is no prediction."""
    has = F.col(prediction).isNotNull()
    flag, cls, text = decision(prediction)
    return [F.when(has, flag).alias("flag"), cls.alias("class_predicted"), F.when(has, text).alias("diagnosis")]


def answer_requests(models: dict[str, PipelineModel], requests: DataFrame, model_col: str, keys: list[str]) -> DataFrame:
    """R2 + R4: exactly one answer for every request, in one pass: ``keys``, ``sink``
    (scored or rejected), ``model`` (as requested), prediction, score and decision
    fields (null where rejected), ``reason`` and ``available_models`` (null where
    scored), ``timestamp``. A request is rejected if it names no model, a model that
    is not among ``models``, or holds an input that cannot be scored."""
    scored, answers = with_scores(models, requests)
    model = F.col(model_col)
    answer = F.lit(None).cast("struct<fine:boolean,prediction:double,score:double>")
    for name, a in answers.items():
        answer = F.when(model == name, a).otherwise(answer)
    rows = scored.select(*keys, model.alias("model"), answer.alias("_a"))
    reason = (F.when(F.col("model").isNull(), F.lit(MISSING_MODEL_TEXT))
              .when(F.col("_a").isNull(), F.format_string(UNKNOWN_MODEL_TEXT, "model"))
              .when(~F.col("_a.fine"), F.lit(INVALID_INPUT_TEXT)))
    rows = rows.withColumn("reason", reason)
    fine = F.col("reason").isNull()
    rows = rows.select(*keys, F.when(fine, F.lit(SCORED)).otherwise(F.lit(REJECTED)).alias("sink"), "model",
                       F.when(fine, F.col("_a.prediction")).alias("prediction"), F.when(fine, F.col("_a.score")).alias("score"), "reason")
    return rows.select(*keys, "sink", "model", "prediction", "score", *_decided("prediction"), "reason",
                       F.when(F.col("sink") == REJECTED, F.lit(",".join(sorted(models)))).alias("available_models"), _timestamp())


def score_requests(models: dict[str, PipelineModel], requests: DataFrame, model_col: str, keys: list[str]) -> DataFrame:
    """R2: the scored answers of :func:`answer_requests` alone."""
    if not models:
        raise ValueError("no models to score with")
    return answer_requests(models, requests, model_col, keys).where(F.col("sink") == SCORED).drop(
        "sink", "reason", "available_models")
