"""Whole plans: trips to gold, features, labels, training and inference matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import with_calendar
from ..operators.cleaning import apply_contract, clean_trips, restrict
from ..operators.grid import neighbor_features, with_imbalance
from ..operators.history import PROBS, future_value, labelled, latest_per, row_lags, snapshots, time_lags, weather_leads, weather_now
from ..operators.slots import SLIDE, WINDOW, slot_metrics, trip_facts
from ..schemas import FEATURES, LAG_STEPS, LAGGED, LEAD_COLS, LEAD_STEPS
from ..sources.sinks import written


def gold(trips: DataFrame, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """Slot metrics of cleaned trips, known zones only."""
    return restrict(slot_metrics(trip_facts(clean_trips(trips)), window, slide))


def base_features(slots: DataFrame, edges: DataFrame, area: Column, **calendar: object) -> DataFrame:
    return with_calendar(neighbor_features(with_imbalance(slots, area), edges), **calendar)


def with_weather(slots: DataFrame, weather: DataFrame | None) -> DataFrame:
    if weather is None:
        return slots.withColumns({f"{c}_lead{s}": F.lit(None).cast("double") for c in LEAD_COLS for s in LEAD_STEPS})
    return weather_leads(weather_now(slots, weather), weather)


def training_set(slots: DataFrame, edges: DataFrame, area: Column, weather: DataFrame | None = None, label_steps: int = 4, probs: Sequence[float] = PROBS, gridded: bool = True) -> DataFrame:
    """80 features, future_imbalance and label_6class. gridded: lags by row on gap-free slots; else by time.

    The features are written once, by a job that runs while the plan is built; cut points and rows are read from that table.
    """
    rows = with_weather(base_features(slots, edges, area), weather)
    rows = row_lags(rows) if gridded else time_lags(rows)
    rows = written(future_value(rows, "imbalance", label_steps).where("future_imbalance IS NOT NULL"))
    return apply_contract(labelled(rows, probs=probs), FEATURES, ("window_end", "future_imbalance", "label_6class"))


def inference_matrix(slots: DataFrame, edges: DataFrame, area: Column, weather: DataFrame | None = None) -> DataFrame:
    """Features of the latest slot: only it and its two lag slots are read on."""
    rows = base_features(snapshots(slots), edges, area)
    current = rows.where("step = 0").drop("step")
    for s in LAG_STEPS:
        lag = rows.where(F.col("step") == s).select("zone_id", *[F.col(c).alias(f"{c}_lag{s}") for c in LAGGED])
        current = current.join(lag, "zone_id", "left")
    return apply_contract(with_weather(current, weather))


def inference_latest(history: DataFrame, edges: DataFrame, area: Column, weather: DataFrame | None = None) -> DataFrame:
    """Features of each zone's latest row, lags by row over its history."""
    return apply_contract(latest_per(with_weather(row_lags(base_features(history, edges, area)), weather)))
