"""The dense zone-slot grid, neighbours and imbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import imbalance as imbalance_of
from ..schemas import COUNTS, KEYS, N_ZONES
from .cleaning import fill_counts


def dense_grid(zones: DataFrame, limits: DataFrame, step: str = "15 minutes") -> DataFrame:
    """Every zone (zone_id) at every slot from lo to hi of a one-row frame, ends included."""
    kind = limits.schema["lo"].dataType
    slots = limits.select(F.explode(F.expr(f"sequence(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL {step})")).alias("window_end")).select(F.col("window_end").cast(kind))
    # The slots of a year are 35,000 rows, whatever the trips.
    return zones.select("zone_id").crossJoin(F.broadcast(slots))


def fill_grid(grid: DataFrame, metrics: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """grid with metrics (absent counts 0) and weather."""
    out = fill_counts(grid.join(metrics, KEYS, "left"), COUNTS)
    return out.join(weather.dropDuplicates(KEYS), KEYS, "left") if weather is not None else out


def ring_edges(spark: SparkSession, n: int = N_ZONES) -> DataFrame:
    """A stand-in adjacency by rule, for data without zone geometry: z is next to z - 1 and z + 1; zones of 46 divide none."""
    zones = spark.range(1, n + 1).select(F.col("id").cast("int").alias("zone_id")).where("zone_id % 46 <> 0")
    near = F.explode(F.array(F.col("zone_id") - 1, F.col("zone_id") + 1)).alias("neighbor_zone_id")
    return zones.select("zone_id", near).where(F.col("neighbor_zone_id").between(1, n))


def ring_area(zone: Column) -> Column:
    """A stand-in area in square km by rule; a table or map of real areas takes its place."""
    return 0.5 + (zone * 7) % 40 / 10.0


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Directed edges (zone_id, neighbor_zone_id) from a CSV table."""
    return spark.read.schema("zone_id int, neighbor_zone_id int").csv(path, header=True)


def area_map(areas: dict[int, float]) -> Column:
    """Lookup zone_id -> area from a dictionary; unknown zones 1.0."""
    pairs = F.create_map(*[F.lit(x) for kv in areas.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.col("zone_id")), F.lit(1.0))


def neighbor_features(slots: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests and delay of the neighbours at the same slot, and the out-degree.

    Each slot row is sent to the zones that name it as a neighbour (the edge list is small and broadcast), so the
    neighbours' rows are aggregated by (zone, slot) without a join on the large side.
    """
    value = slots.select(F.col("zone_id").alias("neighbor_zone_id"), "window_end", "requests_60m", "pickup_delay_mean")
    sums = value.join(F.broadcast(edges), "neighbor_zone_id").groupBy(*KEYS).agg(F.sum("requests_60m").alias("neighbor_requests_60m"), F.avg("pickup_delay_mean").alias("neighbor_pickup_delay_mean"))
    degree = edges.groupBy("zone_id").agg(F.count("*").alias("num_neighbors"))
    out = slots.join(sums, KEYS, "left").join(F.broadcast(degree), "zone_id", "left")
    return out.fillna({"neighbor_requests_60m": 0, "neighbor_pickup_delay_mean": 0.0, "num_neighbors": 0})


def with_imbalance(slots: DataFrame, area: Column) -> DataFrame:
    return slots.withColumn("imbalance", imbalance_of(F.col("pickup_delay_mean"), F.col("requests_60m"), area))
