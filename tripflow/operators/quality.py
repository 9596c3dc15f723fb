"""Live accuracy of predictions, promotion of model versions and which slots to score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import six_class
from ..schemas import KEYS
from .history import PROBS


def newest(predictions: DataFrame, n: int = 50_000, hours: int = 72) -> DataFrame:
    """The newest n predictions with a shadow class (ties by zone), of the last hours of event time."""
    top = predictions.where("shadow_predicted_class IS NOT NULL").orderBy(F.desc("window_end"), "zone_id").limit(n)
    last = predictions.where("shadow_predicted_class IS NOT NULL").agg(F.max("window_end").alias("_last"))
    return top.crossJoin(F.broadcast(last)).where(F.col("window_end") >= F.col("_last") - F.expr(f"INTERVAL {hours} HOURS")).drop("_last")


def with_actuals(predictions: DataFrame, actuals: DataFrame, minutes: int = 60) -> DataFrame:
    """Predictions joined to the actual rows at the slot that they forecast."""
    shifted = predictions.withColumn("target_we", F.col("window_end") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return shifted.join(actuals.withColumnRenamed("window_end", "target_we"), ["zone_id", "target_we"])


def actual_classes(gold: DataFrame, targets: DataFrame, probs: Sequence[float] = PROBS) -> DataFrame:
    """(zone_id, window_end, actual_class) of gold at the target slots, classes cut by the targets' own quantiles of imbalance.

    The targets are slots of some hours, so the rows that one task ranks don't grow with the history.
    """
    rows = gold.select(*KEYS, "imbalance").join(targets.select("window_end").distinct(), "window_end", "left_semi")
    cuts = rows.agg(F.percentile("imbalance", F.array(*[F.lit(float(p)) for p in probs])).alias("_cuts"))
    return rows.crossJoin(F.broadcast(cuts)).select(*KEYS, six_class(F.col("imbalance"), [F.col("_cuts")[i] for i in range(len(probs))]).alias("actual_class"))


def scored_pairs(predictions: DataFrame, gold: DataFrame, hours: int = 72, n: int = 50_000, minutes: int = 60) -> DataFrame:
    recent = newest(predictions, n, hours).select(*KEYS, "predicted_class", "shadow_predicted_class")
    targets = recent.select((F.col("window_end") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("window_end"))
    return with_actuals(recent, actual_classes(gold, targets), minutes)


def accuracy(pairs: DataFrame) -> DataFrame:
    hit = lambda c: F.avg((F.col(c) == F.col("actual_class")).cast("double"))
    return pairs.agg(F.count("*").alias("n"), hit("predicted_class").alias("prod_accuracy"), hit("shadow_predicted_class").alias("shadow_accuracy"))


def live_accuracy(predictions: DataFrame, gold: DataFrame, hours: int = 72, min_samples: int = 500, n: int = 50_000) -> DataFrame:
    """One row (n, prod_accuracy, shadow_accuracy); accuracies are null under min_samples joined rows."""
    one = accuracy(scored_pairs(predictions, gold, hours, n))
    enough = F.col("n") >= min_samples
    return one.select("n", *[F.when(enough, F.col(c)).alias(c) for c in ("prod_accuracy", "shadow_accuracy")])


def promotion_decision(versions: DataFrame, live: DataFrame, now: DataFrame, max_days: int = 14, min_days: int = 3, ratio: float = 0.97, min_samples: int = 500) -> DataFrame:
    """A decision for every staging version: archive, wait, promote or hold.

    versions: model, version, stage, created_at, val_accuracy. live: one row of live_accuracy; where it has no accuracy the
    stages' validation accuracies stand in. now: one row with column now.
    """
    stage = lambda s: versions.where(F.col("stage") == s)
    prod = stage("Production").groupBy("model").agg(F.max("val_accuracy").alias("_prod_val"))
    rows = stage("Staging").join(prod, "model", "left").crossJoin(F.broadcast(live)).crossJoin(F.broadcast(now))
    is_live = F.col("shadow_accuracy").isNotNull()
    shadow = F.coalesce("shadow_accuracy", "val_accuracy")
    base = F.when(is_live, F.col("prod_accuracy")).otherwise(F.coalesce("_prod_val", F.lit(0.0)))
    age = F.floor(F.timestamp_diff("SECOND", F.col("created_at"), F.col("now")) / 86400)
    decision = F.when(age >= max_days, "archive").when(age < min_days, "wait").when(is_live & (F.col("n") < min_samples), "hold").when(shadow >= base * ratio, "promote").otherwise("hold")
    return rows.where(shadow.isNotNull()).select("model", "version", age.cast("int").alias("age_days"), F.when(is_live, "live").otherwise("val_accuracy").alias("source"), shadow.alias("shadow"), base.alias("production"), decision.alias("decision"))


def slots_to_score(gold: DataFrame, predictions: DataFrame, refresh_seconds: int | None = None, now: DataFrame | None = None) -> DataFrame:
    """(window_end, reason): the latest gold slot if it is new, has more zones than were predicted, or is due for a refresh; an older one never."""
    have = gold.groupBy("window_end").agg(F.count_distinct("zone_id").alias("gold_zones"))
    latest = have.join(gold.agg(F.max("window_end").alias("window_end")), "window_end")
    done = predictions.groupBy("window_end").agg(F.count_distinct("zone_id").alias("predicted_zones"), F.max("predicted_at").alias("written_at"))
    last = predictions.agg(F.max("window_end").alias("last_slot"))
    rows = latest.join(done, "window_end", "left").crossJoin(F.broadcast(last))
    new = F.col("last_slot").isNull() | (F.col("window_end") > F.col("last_slot"))
    more = (F.col("window_end") == F.col("last_slot")) & (F.coalesce("predicted_zones", F.lit(0)) < F.col("gold_zones"))
    reason = F.when(new, "new_slot").when(more, "same_slot_more_gold_zones")
    if refresh_seconds:
        rows = rows.crossJoin(F.broadcast(now)) if now is not None else rows.withColumn("now", F.current_timestamp())
        reason = reason.when((F.col("window_end") == F.col("last_slot")) & (F.timestamp_diff("SECOND", F.col("written_at"), F.col("now")) >= refresh_seconds), "same_slot_refresh")
    return rows.select("window_end", reason.alias("reason"), "gold_zones", F.coalesce("predicted_zones", F.lit(0)).alias("predicted_zones")).where("reason IS NOT NULL")
