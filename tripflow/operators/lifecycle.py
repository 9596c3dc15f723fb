"""Joining a trip's events; the same functions take batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = ["trip_id", "request_datetime", "pickup_datetime", "on_scene_datetime", "PULocationID", "confirmed_PU", "DOLocationID", "hvfhs_license_num", "dispatching_base_num", "originating_base_num",
            "wav_request_flag", "access_a_ride_flag", "shared_request_flag", "wav_match_flag", "share_match_flag"]
PICKUP_WITHIN, DROPOFF_WITHIN = "24 minutes", "60 minutes"


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str) -> DataFrame:
    """Equal keys and right_ts in [left_ts, left_ts + within]; right columns that left has too get the prefix r_.

    The key is hashed, the range is checked on matching pairs; on streams the range bounds the state.
    """
    names = {c: f"r_{c}" for c in right.columns if c in left.columns}
    r = right.withColumnsRenamed(names)
    t = F.col(names.get(right_ts, right_ts))
    return left.join(r, (F.col(key) == F.col(names.get(key, key))) & (t >= F.col(left_ts)) & (t <= F.col(left_ts) + F.expr(f"INTERVAL {within}")))


def responses(requests: DataFrame, pickups: DataFrame, within: str = PICKUP_WITHIN) -> DataFrame:
    joined = interval_join(requests, pickups.withColumnRenamed("PULocationID", "confirmed_PU"), "trip_id", "request_datetime", "pickup_datetime", within)
    return joined.select(*[c for c in RESPONSE if c in joined.columns])


def completed(response: DataFrame, dropoffs: DataFrame, within: str = DROPOFF_WITHIN) -> DataFrame:
    """response with its dropoff; the dropoff's zone wins over the request's."""
    joined = interval_join(response, dropoffs, "trip_id", "pickup_datetime", "dropoff_datetime", within)
    own = [c for c in dropoffs.columns if c not in ("trip_id", "DOLocationID", "year", "month", "day")]
    zone = F.coalesce("r_DOLocationID", "DOLocationID").alias("DOLocationID")
    return joined.select(*[zone if c == "DOLocationID" else c for c in response.columns if not c.endswith("_match_flag")], *own)


def dedup(events: DataFrame, keys: list[str], ts: str, delay: str = "5 minutes") -> DataFrame:
    """First event of a key: within the watermark on streams, overall on batches (the earliest one)."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    first = F.min(F.struct(ts, *[c for c in rest if c != ts])).alias("_first")
    return events.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*events.columns)


def unmatched(left: DataFrame, joined: DataFrame, key: str = "trip_id") -> DataFrame:
    """How many left rows no join partner was found for: late or outside the bounds."""
    return left.join(joined.select(key), key, "left_anti").agg(F.count("*").alias("n_unmatched"))
