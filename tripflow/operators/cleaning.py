"""Projections, validity rules, profiling and the feature contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_double, clean_int, clean_string, clean_timestamp
from ..schemas import FEATURES, MONEY, N_ZONES, REQUIRED_WEATHER

# Columns of the event tables and limits of valid trips.
REQUEST = ["trip_id", "hvfhs_license_num", "dispatching_base_num", "originating_base_num", "PULocationID", "DOLocationID", "request_datetime", "wav_request_flag", "access_a_ride_flag", "shared_request_flag"]
PICKUP = ["trip_id", "pickup_datetime", "on_scene_datetime", "PULocationID", "share_match_flag", "wav_match_flag"]
DROPOFF = ["trip_id", "dropoff_datetime", "DOLocationID", "trip_miles", "trip_time", *MONEY]
CLEAN = "base_passenger_fare > 0 AND driver_pay > 0 AND trip_miles < 500 AND trip_time < 20000 AND driver_pay < 1500 AND pickup_datetime > request_datetime"
VALID_STATS = "trip_miles BETWEEN 0.3 AND 500 AND trip_time BETWEEN 200 AND 20000 AND base_passenger_fare BETWEEN 1 AND 1500 AND driver_pay BETWEEN 1 AND 1500"


def with_event_day(df: DataFrame, ts: str) -> DataFrame:
    c = F.col(ts)
    return df.withColumns({"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c)})


def route(events: DataFrame, kind: str) -> DataFrame:
    """Request, pickup or dropoff events in their table's columns, cleaned and typed, with year, month and day."""
    columns = {"request": REQUEST, "pickup": PICKUP, "dropoff": DROPOFF}[kind]
    rows = events.where(F.col("event_type") == kind).withColumn("share_match_flag", F.col("shared_match_flag"))

    def typed(c: str) -> Column:
        if c.endswith("_datetime"):
            return clean_timestamp(c).alias(c)
        if c.endswith("LocationID") or c == "trip_time":
            return clean_int(c).alias(c)
        return (clean_double(c) if c in ("trip_miles", *MONEY) else clean_string(c)).alias(c)

    return with_event_day(rows.withColumn("_ts", clean_timestamp("event_time")), "_ts").select(*[typed(c) for c in columns], "year", "month", "day")


def routed_days(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(kind, year, month, day) of the events that route() gives to any of these kinds, in one pass."""
    rows = events.where(F.col("event_type").isin(*kinds)).select(F.col("event_type").alias("kind"), clean_timestamp("event_time").alias("_ts"))
    return with_event_day(rows, "_ts").drop("_ts")


def _zone(c: str, lo: int, hi: int) -> Column:
    return F.col(c).between(lo, hi)


def valid_requests(df: DataFrame, lo: int = 1, hi: int = N_ZONES) -> DataFrame:
    return df.where(F.col("trip_id").isNotNull() & F.col("request_datetime").isNotNull() & _zone("PULocationID", lo, hi) & _zone("DOLocationID", lo, hi))


def valid_pickups(df: DataFrame, lo: int = 1, hi: int = N_ZONES) -> DataFrame:
    return df.where(F.col("trip_id").isNotNull() & F.col("pickup_datetime").isNotNull() & _zone("PULocationID", lo, hi))


def valid_dropoffs(df: DataFrame) -> DataFrame:
    return df.where(F.col("trip_id").isNotNull() & F.col("dropoff_datetime").isNotNull() & F.col("trip_miles").between(0, 200) & F.col("trip_time").between(0, 86400))


def ordered(df: DataFrame) -> DataFrame:
    return df.where("pickup_datetime >= request_datetime")


def clean_trips(df: DataFrame) -> DataFrame:
    return df.where(CLEAN)


def valid_stats(df: DataFrame) -> DataFrame:
    return df.where(VALID_STATS)


def restrict(slots: DataFrame, zones: tuple[int, int] = (1, N_ZONES), start: str | None = None, end: str | None = None) -> DataFrame:
    out = slots.where(F.col("zone_id").between(*zones))
    if start:
        out = out.where(F.col("window_end") >= F.lit(start).cast("timestamp_ntz"))
    return out.where(F.col("window_end") <= F.lit(end).cast("timestamp_ntz")) if end else out


def recast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Replaces columns in place by tolerant casts: what doesn't fit becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def fill_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=[c for c in columns if c in df.columns])


def apply_contract(df: DataFrame, columns: Sequence[str] = FEATURES, keep: Sequence[str] = ("window_end",)) -> DataFrame:
    """Exactly these columns in this order after ``keep``; missing ones are null doubles."""
    have = {c.lower() for c in df.columns}
    names = [*keep, *[c for c in dict.fromkeys(columns) if c not in keep]]
    return df.select(*[F.col(c) if c.lower() in have else F.lit(None).cast("double").alias(c) for c in names])


def has_weather(columns: Sequence[str] = REQUIRED_WEATHER) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def count_where(df: DataFrame, predicate: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(predicate).groupBy(*by).agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def bounds(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, nulls) of every column, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], one.columns, "column_name", "nulls")


def quantiles(df: DataFrame, c: str, probs: Sequence[float], exact: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """cuts: linear quantiles if exact, else approximate ones of bounded memory."""
    p = F.array(*[F.lit(float(x)) for x in probs])
    value = F.percentile(c, p) if exact else F.percentile_approx(c, p)
    return df.groupBy(*by).agg(value.alias("cuts"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, mean, std, lo, hi) of each column, in one pass."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev, "lo": F.min, "hi": F.max}
    one = df.agg(*[f(F.col(c).cast("double")).cast("double").alias(f"{c}__{s}") for c in columns for s, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("n", F.col("n").cast("long"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def anti(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_anti")


def semi(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_semi")
