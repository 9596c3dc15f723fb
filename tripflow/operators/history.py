"""Lags, leads, labels, weather joins and splits over slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.labels import six_class
from ..schemas import KEYS, LAGGED, LAG_STEPS, LEAD_COLS, LEAD_STEPS, WEATHER_COLS
from ..sources.sinks import sized

PROBS = [0.2, 0.4, 0.6, 0.8, 0.95]


def by_zone() -> WindowSpec:
    """One window for all lags, leads and labels: one exchange and one sort."""
    return Window.partitionBy("zone_id").orderBy("window_end")


def row_lags(df: DataFrame, columns: Sequence[str] = LAGGED, steps: Sequence[int] = LAG_STEPS) -> DataFrame:
    return df.withColumns({f"{c}_lag{s}": F.lag(c, s).over(by_zone()) for c in columns for s in steps})


def row_leads(df: DataFrame, columns: Sequence[str] = LEAD_COLS, steps: Sequence[int] = LEAD_STEPS) -> DataFrame:
    return df.withColumns({f"{c}_lead{s}": F.lead(c, s).over(by_zone()) for c in columns for s in steps})


def time_lags(slots: DataFrame, columns: Sequence[str] = LAGGED, steps: Sequence[int] = LAG_STEPS, minutes: int = 15) -> DataFrame:
    """Values at exactly ``step`` slots earlier, by time, in one join: a row's values go to the slots that lag on it.

    Of a repeated (zone_id, window_end) each column's greatest value counts.
    """
    later = slots.select(*KEYS, *columns, F.explode(F.array(*[F.lit(s) for s in steps])).alias("_step"))
    later = later.withColumn("window_end", F.col("window_end") + F.make_dt_interval(mins=F.col("_step") * minutes))
    wide = later.groupBy(*KEYS).agg(*[F.max(F.when(F.col("_step") == s, F.col(c))).alias(f"{c}_lag{s}") for c in columns for s in steps])
    return slots.join(wide, KEYS, "left")


def future_value(df: DataFrame, c: str, steps: int = 4, name: str = "future_imbalance") -> DataFrame:
    return df.withColumn(name, F.lead(c, steps).over(by_zone()))


def exact_cuts(df: DataFrame, c: str, probs: Sequence[float] = PROBS, margin: float = 1e-3, few: int = 10_000, by: Sequence[str] = (), discrete: bool = False) -> DataFrame:
    """One row (_cuts), or one of each group of ``by`` (by, _cuts) that has a value: the quantiles of percentile(), with no task that holds all values.

    A sketch of the values bounds each cut from both sides by ``margin`` of the rows, ten times its own error; frames or groups of under
    ``few`` rows are ranked whole. Rows below the bounds are counted where they are read, and only values between them are shuffled and
    ranked, equal ones as one row with their count. df is read three times by these columns, so it should be a written table. No value: nulls.
    discrete: the least value that so large a share of the rows doesn't exceed, instead of one between two values.
    """
    k, group = len(probs), ["_by"] if by else []
    df = df.select(F.col(c).alias("v"), *([F.struct(*by).alias("_by")] if by else []))  # as one column, null keys are equal
    side = lambda d: F.percentile_approx("v", F.array(*[F.lit(min(max(p + d, 0.0), 1.0)) for p in probs]), 10_000)
    whole = lambda f: F.array(*[f("v")] * k)
    beside = lambda left, right: left.join(right, "_by") if by else left.crossJoin(F.broadcast(right))
    one = df.groupBy(*group).agg(F.count("v").alias("n"), side(-margin).alias("lo"), side(margin).alias("hi"), whole(F.min).alias("min"), whole(F.max).alias("max"))
    is_small = F.col("n") < few
    limits = one.select(*group, "n", F.when(is_small, F.col("min")).otherwise(F.col("lo")).alias("lo"), F.when(is_small, F.col("max")).otherwise(F.col("hi")).alias("hi"))
    values = beside(df.where(F.col("v").isNotNull()), limits)
    below = values.groupBy(*group).agg(F.array(*[F.count_if(F.col("v") < F.col("lo")[i]) for i in range(k)]).alias("below"))
    inside = F.filter(F.array(*[F.lit(i) for i in range(k)]), lambda i: F.col("v").between(F.get("lo", i), F.get("hi", i)))
    near = values.select(*group, "n", "v", F.explode(inside).alias("i")).groupBy(*group, "i", "v").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    run = Window.partitionBy(*group, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = beside(near.withColumn("upto", F.sum("k").over(run)), below)
    last = F.get("below", F.col("i")) + F.col("upto") - 1
    of_all = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("i"))
    pos = F.greatest(F.ceil(of_all * F.col("n")) - 1, F.lit(0)).cast("double") if discrete else of_all * (F.col("n") - 1)
    at = lambda r: F.max(F.when((r <= last) & (r > last - F.col("k")), F.col("v")))
    found = ranked.groupBy(*group, "i").agg(at(F.floor(pos)).alias("a"), at(F.ceil(pos)).alias("b"), F.max(pos).alias("pos"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("pos") - F.col("pos")) * F.col("a") + (F.col("pos") - F.floor("pos")) * F.col("b"))
    ordered = found.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("i", value.cast("double").alias("cut")))).alias("_all"))
    return ordered.select(*[F.col(f"_by.{b}").alias(b) for b in by], F.when(F.size("_all") == k, F.col("_all.cut")).alias("_cuts"))


def labelled(df: DataFrame, c: str = "future_imbalance", probs: Sequence[float] = PROBS, closed: str = "right", exact: bool = True, name: str = "label_6class") -> DataFrame:
    """Rows with a value, and their class by the value's own quantiles; the cut points are one row, broadcast.

    df is read for its cuts and for its rows, so it should be a written table.
    """
    some = df.na.drop(subset=[c])
    cuts = exact_cuts(some, c, probs) if exact else some.agg(F.percentile_approx(c, F.array(*[F.lit(float(x)) for x in probs])).alias("_cuts"))
    classes = six_class(F.col(c), [F.col("_cuts")[i] for i in range(len(probs))], closed)
    return some.crossJoin(F.broadcast(cuts)).withColumn(name, classes).drop("_cuts")


def ffill(df: DataFrame, columns: Sequence[str], rows: int = 6) -> DataFrame:
    """Last non-null value within so many earlier rows of the zone."""
    near = by_zone().rowsBetween(-rows, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(near) for c in columns})


def latest_per(df: DataFrame, key: str = "zone_id", ts: str = "window_end") -> DataFrame:
    """All rows at the latest time of each key, by aggregate and join: no task sorts a key's history."""
    last = df.groupBy(key).agg(F.max(ts).alias(ts))
    return df.join(last, [key, ts])


def share(df: DataFrame, c: str, name: str = "share") -> DataFrame:
    total = df.agg(F.sum(c).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.col(c) / F.col("_total")).drop("_total")


def time_split(df: DataFrame, ratio: float = 0.9) -> DataFrame:
    """is_train: the first ``ratio`` of rows by (window_end, zone_id).

    Rows are counted by slot; the running count runs over slots, not rows, and only the slot at the cut ranks its zones.
    """
    slots = df.groupBy("window_end").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("window_end").rowsBetween(Window.unboundedPreceding, -1)
    before = slots.select("window_end", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    cut = slots.agg(F.floor(F.sum("_n") * ratio).alias("_cut"))
    placed = df.join(before.crossJoin(F.broadcast(cut)), "window_end")
    rank = F.row_number().over(Window.partitionBy("window_end").orderBy("zone_id"))
    return placed.withColumn("is_train", F.col("_before") + rank <= F.col("_cut")).drop("_before", "_cut")


def weather_now(slots: DataFrame, weather: DataFrame, columns: Sequence[str] = WEATHER_COLS) -> DataFrame:
    """Weather at the slot; values that slots already have win."""
    side = weather.dropDuplicates(KEYS).select(*KEYS, *[F.col(c).alias(f"_w_{c}") for c in columns])
    joined = slots.join(side, KEYS, "left")

    def value(c: str) -> Column:
        return F.coalesce(F.col(c), F.col(f"_w_{c}")) if c in slots.columns else F.col(f"_w_{c}")

    return joined.withColumns({c: value(c) for c in columns}).drop(*[f"_w_{c}" for c in columns])


def weather_leads(slots: DataFrame, weather: DataFrame, columns: Sequence[str] = LEAD_COLS, steps: Sequence[int] = LEAD_STEPS, minutes: int = 15) -> DataFrame:
    """Weather at the next slots by time, in one join: a weather row goes to the slots that it is ahead of."""
    offsets = F.explode(F.array(*[F.lit(s) for s in steps])).alias("_step")
    ahead = weather.dropDuplicates(KEYS).select("zone_id", "window_end", *columns, offsets)
    ahead = ahead.withColumn("window_end", F.col("window_end") - F.make_dt_interval(mins=F.col("_step") * minutes))
    wide = ahead.groupBy(*KEYS).agg(*[F.max(F.when(F.col("_step") == s, F.col(c))).alias(f"{c}_lead{s}") for c in columns for s in steps])
    return slots.join(wide, KEYS, "left")


def snapshots(gold: DataFrame, steps: Sequence[int] = (0, *LAG_STEPS), minutes: int = 15, latest: DataFrame | None = None) -> DataFrame:
    """Rows at the latest slot and so many slots before it, with their step.

    latest: one row (window_end) instead of a scan. Of a table partitioned by slot_day, only the days of these slots are read.
    """
    latest = gold.agg(F.max("window_end").alias("window_end")) if latest is None else latest
    wanted = latest.select(F.explode(F.array(*[F.struct(F.lit(s).alias("step"), (F.col("window_end") - F.expr(f"INTERVAL {s * minutes} MINUTES")).alias("window_end")) for s in steps])).alias("w")).select("w.*")
    return _at(gold, wanted, len(steps)).select(*gold.columns, "step")


def rows_at(gold: DataFrame, targets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows at these slots; of a table partitioned by slot_day, only their days are read."""
    return _at(gold, targets.select("window_end").distinct()).select(*columns)


def _at(gold: DataFrame, slots: DataFrame, most: int | None = None) -> DataFrame:
    """gold joined with slots. The day is a key too where gold is partitioned by it, so that Spark prunes partitions by the slots' days when the plan runs.

    It does so only if the other side is filtered, so its slots are asked to be there. most: bound of its rows, if known.
    """
    slots = slots.where("window_end > TIMESTAMP_NTZ'1900-01-01 00:00:00'")
    if most:
        slots = F.broadcast(slots)
    if "slot_day" not in gold.columns:
        return gold.join(slots, "window_end")
    slots = slots.withColumn("slot_day", F.to_date("window_end"))
    return gold.join(slots if most else sized(slots), ["slot_day", "window_end"])
