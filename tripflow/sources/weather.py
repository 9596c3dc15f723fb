"""Weather sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LAG_STEPS, N_ZONES, WEATHER, WEATHER_COLS, WEATHER_TYPES
from .readers import first_non_empty

_RAW = WEATHER.replace("zone_id", "LocationID").replace("window_end", "datetime")


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RAW).csv(path, header=True).withColumnsRenamed({"LocationID": "zone_id", "datetime": "window_end"})


def normalize_weather(df: DataFrame, zones: int = N_ZONES) -> DataFrame:
    """Keys renamed and typed, zones 1 to 263, numbers coerced; absent measures null. Without keys: no rows."""
    names = {a: b for a, b in (("LocationID", "zone_id"), ("datetime", "window_end")) if a in df.columns and b not in df.columns}
    out = df.withColumnsRenamed(names)
    if not {"zone_id", "window_end"} <= set(out.columns):
        return df.sparkSession.createDataFrame([], WEATHER)
    measures = [(F.col(c).try_cast("double").cast(WEATHER_TYPES[c]) if c in out.columns else F.lit(None).cast(WEATHER_TYPES[c])).alias(c) for c in WEATHER_COLS]
    keys = [F.col("zone_id").try_cast("double").cast("int").alias("zone_id"), F.col("window_end").try_cast("timestamp_ntz").alias("window_end")]
    return out.select(*keys, *measures).where(F.col("zone_id").between(1, zones) & F.col("window_end").isNotNull())


def needed_days(slots: DataFrame, minutes: int = 15) -> DataFrame:
    """(date): the days that slots need weather of: their own, three leads, both lags, and the day after each."""
    steps = [0, 1, 2, 3]
    times = F.array(*[F.col("window_end") + F.expr(f"INTERVAL {s * minutes} MINUTES") for s in steps], *[F.col("window_end") - F.expr(f"INTERVAL {s * minutes} MINUTES") for s in LAG_STEPS])
    days = slots.select("window_end").distinct().select(F.explode(times).alias("t")).select(F.explode(F.array(F.to_date("t"), F.date_add(F.to_date("t"), 1))).alias("date"))
    return days.distinct()


def read_weather(spark: SparkSession, sources: Sequence[Callable[[SparkSession], DataFrame]], slots: DataFrame | None = None) -> DataFrame:
    """The first source with rows, normalised; a source partitioned by ``date`` is pruned to the days that slots need."""
    def load(source: Callable[[SparkSession], DataFrame]) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            df = source(spark)
            if slots is not None and "date" in df.columns:
                df = df.join(F.broadcast(needed_days(slots)), "date", "left_semi")  # dynamic partition pruning
            return normalize_weather(df)
        return run

    return first_non_empty([load(s) for s in sources])
