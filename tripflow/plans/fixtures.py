"""Trips, weather and predictions derived from the driver's tables by integer arithmetic, equal in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import N_CLASSES, N_ZONES

START, END = "2025-01-05 08:00:00", "2025-01-19 09:45:00"
SLOTS = 1352
SPARK_ADD = f"TIMESTAMP_NTZ'{START}' + make_dt_interval(0, 0, 0, {{}})"
DUCK_ADD = f"TIMESTAMP '{START}' + to_seconds({{}})"

_SECONDS = {
    "r_s": "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1209600",
    "d_s": "CASE WHEN l_orderkey % 53 = 0 THEN -60 ELSE 30 + (l_suppkey * 13 + l_linenumber * 97 + l_orderkey * 3) % 2000 END",
    "t_s": "120 + (CAST(l_quantity AS BIGINT) * 53 + l_orderkey * 11) % 5400",
}


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'Y' ELSE 'N' END"


def _fee(condition: str, amount: float) -> str:
    return f"CAST(CASE WHEN {condition} THEN {amount} ELSE 0.0 END AS DOUBLE)"


def trip_columns(add: str) -> dict[str, str]:
    return {
        "trip_id": "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))",
        "hvfhs_license_num": "CASE WHEN l_suppkey % 3 = 0 THEN 'HV0005' ELSE 'HV0003' END",
        "PULocationID": f"CAST(l_partkey % {N_ZONES} + 1 AS INT)",
        "DOLocationID": "CAST((l_partkey * 7 + l_linenumber) % 265 + 1 AS INT)",
        "request_datetime": add.format("r_s"),
        "on_scene_datetime": f"CASE WHEN l_linenumber = 7 THEN NULL ELSE {add.format('r_s + d_s - 15')} END",
        "pickup_datetime": add.format("r_s + d_s"),
        "dropoff_datetime": add.format("r_s + d_s + t_s"),
        "trip_miles": "l_quantity * 0.4",
        "trip_time": "t_s",
        "base_passenger_fare": "CASE WHEN l_partkey % 41 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / 1000 END",
        "driver_pay": "l_extendedprice * (1 - l_discount) / 1250",
        "tips": "l_tax * 10",
        "sales_tax": "l_tax * 25",
        "bcf": "l_discount * 3",
        "tolls": _fee("l_partkey % 5 = 0", 6.94),
        "congestion_surcharge": _fee("l_partkey % 2 = 0", 2.75),
        "airport_fee": _fee("l_suppkey % 7 = 0", 2.5),
        "cbd_congestion_fee": _fee("l_partkey % 4 = 0", 1.5),
        "wav_request_flag": _flag("l_returnflag = 'R'"),
        "access_a_ride_flag": _flag("l_returnflag = 'A'"),
        "shared_request_flag": _flag("l_linestatus = 'O'"),
        "shared_match_flag": _flag("l_linestatus = 'O' AND l_linenumber % 2 = 0"),
        "wav_match_flag": _flag("l_returnflag = 'R' AND l_linenumber <> 3"),
    }


def weather_columns() -> dict[str, str]:
    return {
        "temperature_2m": "CAST(5 + ((zone_id * 3 + i) % 40) * 0.5 AS DOUBLE)",
        "relative_humidity_2m": "CAST(40 + (zone_id + i) % 60 * 1.0 AS DOUBLE)",
        "surface_pressure": "CAST(1000 + (zone_id * 7 + i) % 30 * 1.0 AS DOUBLE)",
        "precipitation": "CAST(CASE WHEN i % 9 = 0 THEN 0.8 ELSE 0.0 END AS DOUBLE)",
        "rain": "CAST(CASE WHEN i % 9 = 0 THEN 0.6 ELSE 0.0 END AS DOUBLE)",
        "snowfall": "CAST(CASE WHEN i % 90 = 0 THEN 0.1 ELSE 0.0 END AS DOUBLE)",
        "cloud_cover": "CAST((zone_id + i * 5) % 101 AS INT)",
        "weather_code": "CAST((zone_id + i) % 4 AS INT)",
        "wind_speed_10m": "CAST((i % 25) * 1.0 AS DOUBLE)",
        "wind_gusts_10m": "CAST((i % 25) * 1.6 AS DOUBLE)",
    }


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def trips_of(lines: DataFrame) -> DataFrame:
    """Trips of line items, batch or streaming."""
    return lines.selectExpr("*", *[f"{e} AS {n}" for n, e in _SECONDS.items()]).selectExpr(*[f"{e} AS {n}" for n, e in trip_columns(SPARK_ADD).items()])


def weather(spark: SparkSession) -> DataFrame:
    """A slot-grain dimension by rule, with a gap in each seventeenth slot of a zone."""
    grid = spark.range(N_ZONES).selectExpr("CAST(id + 1 AS INT) AS zone_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).where("(zone_id + i) % 17 <> 0")
    return grid.selectExpr("zone_id", f"{SPARK_ADD.format('i * 900')} AS window_end", *[f"{e} AS {n}" for n, e in weather_columns().items()])


_K = "CAST(floor({epoch} / 900) AS BIGINT)"


def prediction_columns(epoch: str, minutes5: str) -> tuple[str, dict[str, str]]:
    """The expression of k, and columns over requests_60m, zone_id and k."""
    total = " + ".join(f"(1 + (k + zone_id + {i * 7}) % 11)" for i in range(N_CLASSES))
    return _K.format(epoch=epoch), {
        "zone_id": "zone_id", "window_end": "window_end",
        "predicted_class": "CAST((requests_60m * 5 + zone_id + k) % 6 AS INT)",
        "used_model": "CASE WHEN (zone_id + k) % 17 = 0 THEN 'model_b' ELSE 'model_a' END",
        "model_version": "CASE WHEN (zone_id + k) % 17 = 0 THEN '1' ELSE '2' END",
        "predicted_at": minutes5,
        "shadow_predicted_class": "CASE WHEN (zone_id + k) % 4 = 0 THEN NULL ELSE CAST((requests_60m * 5 + zone_id + k * 3) % 6 AS INT) END",
        **{f"proba_{i}": f"CAST(1 + (zone_id + {i * 7} + k) % 11 AS DOUBLE) / ({total})" for i in range(N_CLASSES)},
    }


def predictions(gold: DataFrame) -> DataFrame:
    k, columns = prediction_columns("unix_timestamp(CAST(window_end AS TIMESTAMP))", "window_end + INTERVAL 5 MINUTES")
    rows = gold.where("requests_60m > 0").selectExpr("zone_id", "window_end", "requests_60m", f"{k} AS k").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])
    return rows.withColumn("pred_confidence", F.greatest(*[F.col(f"proba_{i}") for i in range(N_CLASSES)]))


def model_versions(predictions_: DataFrame) -> DataFrame:
    """Versions aged relative to the newest prediction."""
    rows = [("model_a", 1, "Production", 40, 0.61), ("model_a", 2, "Staging", 5, 0.64), ("model_b", 1, "Production", 40, 0.55), ("model_b", 2, "Staging", 1, 0.57), ("model_c", 1, "Staging", 15, 0.5), ("model_c", 0, "Archived", 60, 0.4)]
    names = ("model", "version", "stage", "age", "val_accuracy")
    versions = F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]))
    last = predictions_.agg(F.max("predicted_at").alias("now"))
    return last.select("now", versions).selectExpr("model", "version", "stage", "now - make_dt_interval(age) AS created_at", "val_accuracy")


# DuckDB text of the same views.

DUCK_TRIPS = f"k AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SECONDS.items())} FROM lineitem), trips AS (SELECT {', '.join(f'{e} AS {n}' for n, e in trip_columns(DUCK_ADD).items())} FROM k)"
DUCK_WEATHER = (
    f"weather AS MATERIALIZED (SELECT zone_id, {DUCK_ADD.format('i * 900')} AS window_end, {', '.join(f'{e} AS {n}' for n, e in weather_columns().items())} "
    f"FROM (SELECT CAST(z.range + 1 AS INT) AS zone_id, s.range AS i FROM range({N_ZONES}) z, range({SLOTS}) s) WHERE (zone_id + i) % 17 <> 0)")


def duck_predictions() -> str:
    k, columns = prediction_columns("epoch(window_end)", "window_end + INTERVAL 5 MINUTES")
    best = ", ".join(f"proba_{i}" for i in range(N_CLASSES))
    return (f"pk AS (SELECT zone_id, window_end, requests_60m, {k} AS k FROM gold WHERE requests_60m > 0), "
            f"pp AS (SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM pk), predictions AS MATERIALIZED (SELECT *, greatest({best}) AS pred_confidence FROM pp)")
