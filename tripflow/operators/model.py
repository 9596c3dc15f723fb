"""Six-class training, scoring and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import argmax
from ..schemas import FEATURES, FEATURES_WITHOUT_WEATHER, N_CLASSES
from .cleaning import has_weather


def class_shares(df: DataFrame, c: str = "label_6class") -> DataFrame:
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(c, "n", (F.col("n") / F.col("_all")).alias("share"))


def with_class_weight(df: DataFrame, c: str = "label_6class", classes: int = N_CLASSES) -> DataFrame:
    """weight: rows over classes times the class's rows. The counts are one row a class, broadcast."""
    shares = class_shares(df, c).select(c, (1 / (F.lit(classes) * F.col("share"))).alias("weight"))
    return df.join(F.broadcast(shares), c)


def fit(df: DataFrame, columns: Sequence[str] = FEATURES, label: str = "label_6class", weight: str | None = "weight", trees: int = 20, depth: int = 8, seed: int = 42) -> PipelineModel:
    """Imputation by column means, then a random forest over exactly these columns."""
    rows = df.select(label, *([weight] if weight else []), *[F.col(c).cast("double").alias(c) for c in columns])
    none = rows.agg(*[F.count(c).alias(c) for c in columns]).first()
    used = [c for c in columns if none[c]]  # a column without any value has no mean
    stages = [Imputer(inputCols=used, outputCols=[f"{c}__i" for c in used]), VectorAssembler(inputCols=[f"{c}__i" for c in used], outputCol="features"),
              RandomForestClassifier(labelCol=label, weightCol=weight, numTrees=trees, maxDepth=depth, seed=seed) if weight else RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def saved(model: PipelineModel, path: str) -> PipelineModel:
    """The model as a scoring job finds it: written, replacing one that is there, and read back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def _proba(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows plus proba: an array of N_CLASSES; classes that training never saw have 0."""
    inputs = model.stages[0].getInputCols()
    out = model.transform(rows.withColumns({c: F.col(c).cast("double") for c in inputs}))
    padded = F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), N_CLASSES))
    return out.select(*rows.columns, F.slice(padded, 1, N_CLASSES).alias("proba"))


def choose_model(matrix: DataFrame) -> DataFrame:
    """used_model by row: model_a where all weather is there, else model_b."""
    return matrix.withColumn("used_model", F.when(has_weather(), "model_a").otherwise("model_b"))


def score(matrix: DataFrame, model_a: PipelineModel | None, model_b: PipelineModel | None, shadow: PipelineModel | None = None, version_a: str | None = None, version_b: str | None = None, at: Column | None = None) -> DataFrame:
    """Predictions: model_a where weather is complete, else model_b, else no row; a shadow class beside where weather is complete."""
    complete = has_weather()
    keep = ["zone_id", "window_end"]
    parts = []
    if model_a:
        parts.append(_proba(model_a, matrix.where(complete)).withColumns({"used_model": F.lit("model_a"), "model_version": F.lit(version_a).cast("string"), "_complete": F.lit(True)}))
    if model_b:
        rest = matrix.where(~complete) if model_a else matrix
        parts.append(_proba(model_b, rest).withColumns({"used_model": F.lit("model_b"), "model_version": F.lit(version_b).cast("string"), "_complete": complete}))
    if not parts:
        raise ValueError("a model is needed")
    scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if shadow:  # on the scored rows themselves, so no join is needed
        inner = scored.withColumnRenamed("proba", "_proba")
        scored = _proba(shadow, inner).withColumnRenamed("proba", "_shadow").withColumnRenamed("_proba", "proba")
        shadow_proba = F.when(F.col("_complete"), F.col("_shadow"))
    else:
        shadow_proba = F.lit(None).cast("array<double>")
    best, confidence = argmax(F.col("proba"))
    shadow_best, _ = argmax(F.col("_s"))
    out = scored.withColumn("_s", shadow_proba)
    return out.select(*keep, best.cast("short").alias("predicted_class"), confidence.cast("float").alias("pred_confidence"), "used_model", "model_version", (at if at is not None else F.current_timestamp()).alias("predicted_at"), shadow_best.cast("short").alias("shadow_predicted_class"),
                      *[F.col("proba")[i].cast("float").alias(f"proba_{i}") for i in range(N_CLASSES)], *[F.col("_s")[i].cast("float").alias(f"shadow_proba_{i}") for i in range(N_CLASSES)])


def skipped(matrix: DataFrame, with_a: bool = True, with_b: bool = False) -> DataFrame:
    """Rows that no loaded model can score."""
    scorable = F.lit(with_b) | (F.lit(with_a) & has_weather())
    return matrix.agg(F.count_if(~scorable).alias("n_skipped"))


def importance(model: PipelineModel) -> DataFrame:
    """(feature, importance, share), greatest first: one row per column of the contract."""
    from pyspark.sql import SparkSession

    forest, names = model.stages[-1], model.stages[0].getInputCols()
    rows = [(n, float(forest.featureImportances[i])) for i, n in enumerate(names)]
    total = sum(x for _, x in rows) or 1.0
    frame = SparkSession.active().createDataFrame([(n, x, x / total) for n, x in rows], "feature string, importance double, share double")
    return frame.orderBy(F.desc("importance"), "feature")


def confusion(df: DataFrame, label: str = "actual_class", prediction: str = "predicted_class", classes: int = N_CLASSES) -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias(label)).pivot(prediction, list(range(classes))).agg(F.count(F.lit(1))).fillna(0).select(label, *[F.col(str(i)).alias(f"predicted_{i}") for i in range(classes)])


def evaluate(df: DataFrame, label: str = "actual_class", prediction: str = "predicted_class") -> DataFrame:
    """One row: accuracy, macro and weighted F1, macro precision and recall; from one count by (label, prediction)."""
    cells = df.groupBy(F.col(label).cast("int").alias("a"), F.col(prediction).cast("int").alias("p")).agg(F.count("*").cast("double").alias("n"))
    each = cells.select("n", F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit(1).alias("is_a"), (F.col("a") == F.col("p")).cast("int").alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_a"), F.lit(0).alias("hit")))).alias("x")).select("n", "x.*")
    by = each.groupBy("c").agg(F.sum(F.col("n") * F.col("is_a")).alias("actual"), F.sum(F.col("n") * (1 - F.col("is_a"))).alias("predicted"), F.sum(F.col("n") * F.col("hit")).alias("hit"))
    precision, recall = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "actual"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    rows = by.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)
    return rows.agg((F.sum("hit") / F.sum("actual")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("actual")) / F.sum("actual")).alias("weighted_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"))


CONTRACTS = {"model_a": FEATURES, "model_b": FEATURES_WITHOUT_WEATHER}
