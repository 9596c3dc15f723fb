"""Reporting tables over predictions and trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import class_color, class_label
from ..schemas import N_ZONES


def latest_predictions(p: DataFrame) -> DataFrame:
    last = p.agg(F.max("window_end").alias("window_end"))
    return p.join(F.broadcast(last), "window_end")


def coverage(p: DataFrame) -> DataFrame:
    """Zones and last write of every slot."""
    return p.groupBy("window_end").agg(F.count_distinct("zone_id").alias("zones"), F.max("predicted_at").alias("written_at"))


def missing_zones(p: DataFrame, n: int = N_ZONES) -> DataFrame:
    return latest_predictions(p).agg(F.count_distinct("zone_id").alias("covered")).withColumn("missing", n - F.col("covered"))


def latest_count(p: DataFrame) -> DataFrame:
    return latest_predictions(p).groupBy("window_end").agg(F.count("*").alias("n"))


def slot_counts(p: DataFrame, n: int = 5) -> DataFrame:
    return p.groupBy("window_end").agg(F.count("*").alias("n")).orderBy(F.desc("window_end")).limit(n)


def confidence(p: DataFrame) -> DataFrame:
    return latest_predictions(p).agg(F.avg("pred_confidence").alias("avg_confidence"), F.max("predicted_class").alias("peak_class"))


def class_distribution(p: DataFrame) -> DataFrame:
    return latest_predictions(p).groupBy("predicted_class").agg(F.count("*").alias("zones"))


def class_trend(p: DataFrame, hours: int = 24) -> DataFrame:
    last = p.agg(F.max("window_end").alias("_last"))
    recent = p.crossJoin(F.broadcast(last)).where(F.col("window_end") >= F.col("_last") - F.expr(f"INTERVAL {hours} HOURS"))
    return recent.groupBy("window_end", "predicted_class").agg(F.count("*").alias("zones"))


def confidence_by_slot(p: DataFrame) -> DataFrame:
    return p.groupBy("window_end").agg(F.avg("pred_confidence").alias("avg_confidence"), F.count_distinct("zone_id").alias("zones"))


def freshness(p: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """Minutes since the last prediction, at now (one row, column now) or the current time."""
    last = p.agg(F.max("predicted_at").alias("written_at"))
    at = last.crossJoin(F.broadcast(now)) if now is not None else last.withColumn("now", F.current_timestamp())
    return at.select((F.timestamp_diff("SECOND", F.col("written_at"), F.col("now")) / 60).alias("minutes"))


def top_zones(p: DataFrame, n: int = 10) -> DataFrame:
    return latest_predictions(p).orderBy(F.desc("predicted_class"), F.desc("pred_confidence"), "zone_id").limit(n).select("zone_id", "predicted_class", "pred_confidence")


def zone_map_rows(zones: DataFrame, p: DataFrame) -> DataFrame:
    """(zone_id, document): one JSON feature per zone with its latest prediction, geometry included if zones has it."""
    last = latest_predictions(p).select("zone_id", "predicted_class", "pred_confidence", "used_model", "model_version", "window_end")
    rows = zones.join(last, "zone_id", "left")
    has = F.col("predicted_class").isNotNull()
    # The map's property names, stroke and opacities.
    properties = F.struct(
        F.col("zone_id").alias("LocationID"), has.alias("has_prediction"), F.col("predicted_class").cast("int").alias("predicted_class"), class_label(F.col("predicted_class")).alias("demand_label"),
        F.round("pred_confidence", 3).alias("confidence"), F.col("used_model").alias("model"), F.when(has, F.coalesce("model_version", F.lit("n/a"))).alias("model_version"),
        F.date_format("window_end", "yyyy-MM-dd'T'HH:mm:ss").alias("window_end"), class_color(F.col("predicted_class")).alias("fill"), F.when(has, 0.9).otherwise(0.45).alias("fill-opacity"), F.lit("#FFFFFF").alias("stroke"), F.when(has, 0.7).otherwise(0.5).alias("stroke-width"))
    shape = [F.col("geometry").alias("geometry")] if "geometry" in zones.columns else []
    return rows.select("zone_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("zone_id").alias("id"), *shape, properties.alias("properties"))).alias("document"))


def map_properties(p: DataFrame) -> DataFrame:
    """What the map says as a whole: zones with a latest prediction, and its slot."""
    return latest_predictions(p).agg(F.count_distinct("zone_id").alias("prediction_count"), F.max("window_end").alias("latest_window"))


def by_provider(trips: DataFrame) -> DataFrame:
    return trips.groupBy("hvfhs_license_num").agg(F.count("*").alias("trips"), F.sum("base_passenger_fare").alias("revenue"), F.avg("base_passenger_fare").alias("avg_fare"))


def by_hour(trips: DataFrame) -> DataFrame:
    at = F.col("request_datetime")
    return trips.groupBy(F.weekday(at).alias("dow"), F.hour(at).alias("hour")).agg(F.count("*").alias("trips"))


def by_month(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.date_format("request_datetime", "yyyy-MM").alias("month")).agg(F.count("*").alias("trips"))


def by_day(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.date_format("request_datetime", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("trips"))


def hotspots(slots: DataFrame, n: int = 20) -> DataFrame:
    """Zones by mean requests a slot, and how steady they are."""
    rows = slots.groupBy("zone_id").agg(F.count("*").alias("slots"), F.avg("requests_60m").alias("avg_requests"), F.stddev("requests_60m").alias("std_requests"))
    return rows.orderBy(F.desc("avg_requests"), "zone_id").limit(n)


def weather_effect(slots: DataFrame) -> DataFrame:
    """Requests and delay with and without rain; slots need weather columns."""
    return slots.where("precipitation IS NOT NULL").groupBy((F.col("precipitation") > 0).alias("wet")).agg(F.count("*").alias("slots"), F.avg("requests_60m").alias("avg_requests"), F.avg("pickup_delay_mean").alias("avg_delay"))


def surcharge_effect(trips: DataFrame) -> DataFrame:
    return trips.groupBy((F.col("congestion_surcharge") > 0).alias("surcharged")).agg(F.count("*").alias("trips"), F.avg("base_passenger_fare").alias("avg_fare"), F.avg("trip_miles").alias("avg_miles"))


def driver_pay(trips: DataFrame) -> DataFrame:
    return trips.groupBy("hvfhs_license_num").agg(F.avg("driver_pay").alias("avg_pay"), (F.sum("driver_pay") / F.sum("base_passenger_fare")).alias("pay_share"), (F.sum("driver_pay") / F.sum("trip_miles")).alias("pay_per_mile"))


def accessibility(trips: DataFrame) -> DataFrame:
    share = lambda c: F.avg((F.col(c) == "Y").cast("double"))
    return trips.groupBy("PULocationID").agg(F.count("*").alias("trips"), share("wav_request_flag").alias("wav_share"), share("access_a_ride_flag").alias("aar_share"), share("shared_request_flag").alias("shared_share"))
