"""Sliding-slot metrics per zone and for the whole city.

A trip is three facts: its request, pickup and dropoff, each with a zone, a time and its measures, and a fourth for the statistics of
valid trips. Batches aggregate them once into panes, tumbling windows as wide as the slide, with counts, sums and moments
that can be added up; a window is then made of its panes. So at most four rows a trip meet the first aggregate, and the
second reads panes, not trips. Streams, which have one stateful operator, aggregate sliding windows at once.
``kind`` narrows a facts frame before panes or windows are assigned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import flag, is_provider, seconds_between
from ..functions.labels import city_imbalance
from ..schemas import STATS
from .cleaning import VALID_STATS

WINDOW, SLIDE = "60 minutes", "15 minutes"


def trip_facts(trips: DataFrame, zone_type: str = "int") -> DataFrame:
    """(zone_id, ts, kind, request_ts, measures...): kinds request, pickup, dropoff and stats.

    Stats are those of valid trips at their pickup zone and dropoff time.
    """
    null = lambda t: F.lit(None).cast(t)
    measures = {
        "wav": {"request": flag("wav_request_flag"), "pickup": flag("wav_match_flag")},
        "share": {"request": flag("shared_request_flag"), "pickup": flag("shared_match_flag")},
        "aar": {"request": flag("access_a_ride_flag")},
        "uber": {"request": is_provider("hvfhs_license_num")},
        "same_zone": {"dropoff": (F.col("PULocationID") == F.col("DOLocationID")).cast("int")},
        "delay": {"pickup": seconds_between("request_datetime", "pickup_datetime")},
    }

    def fact(kind: str, zone: str, ts: str) -> Column:
        own = [m.get(kind, null("long" if n == "delay" else "int")).alias(n) for n, m in measures.items()]
        stats = [(F.col(c).cast("double") if kind == "stats" else null("double")).alias(c) for c in STATS.values()]
        return F.struct(F.col(zone).cast(zone_type).alias("zone_id"), F.col(ts).alias("ts"), F.lit(kind).alias("kind"), F.col("request_datetime").alias("request_ts"), *own, *stats)

    facts = F.array(fact("request", "PULocationID", "request_datetime"), fact("pickup", "PULocationID", "pickup_datetime"), fact("dropoff", "DOLocationID", "dropoff_datetime"))
    with_stats = F.when(F.expr(VALID_STATS), F.concat(facts, F.array(fact("stats", "PULocationID", "dropoff_datetime")))).otherwise(facts)
    return trips.select(F.explode(with_stats).alias("f")).select("f.*").where("ts IS NOT NULL")


def _of(kind: str, value: Column | None = None) -> Column:
    return F.when(F.col("kind") == kind, F.lit(1) if value is None else value)


def metric_columns(slide: str = SLIDE) -> dict[str, list[Column]]:
    """Aggregates over facts with an assigned window, by group."""
    matched = F.col("request_ts") >= F.col("window.start")
    recent = F.col("ts") >= F.col("window.end") - F.expr(f"INTERVAL {slide}")
    count = lambda c: F.count(F.when(c, 1))
    total = lambda kind, c: F.coalesce(F.sum(_of(kind, F.col(c))), F.lit(0)).cast("long")
    is_ = lambda kind: F.col("kind") == kind
    return {
        "request": [F.count(_of("request")).alias("requests_60m"), total("request", "wav").alias("wav_req"), total("request", "aar").alias("aar_req"), total("request", "share").alias("share_req"), total("request", "uber").alias("uber_req")],
        "pickup": [F.count(_of("pickup")).alias("pickup_60m"), F.avg(_of("pickup", F.col("delay"))).alias("pickup_delay_mean"), F.coalesce(F.stddev(_of("pickup", F.col("delay"))), F.lit(0.0)).alias("pickup_delay_std"),
                   count(is_("pickup") & matched).alias("matched_rp"), total("pickup", "wav").alias("wav_match"), total("pickup", "share").alias("share_match")],
        "pickup_recent": [count(is_("pickup") & recent).alias("pickup_15m"), count(is_("pickup") & recent & matched).alias("matched_rp_15m")],
        "dropoff": [F.count(_of("dropoff")).alias("dropoff_60m"), count(is_("dropoff") & matched).alias("matched_rd")],
        "dropoff_recent": [count(is_("dropoff") & recent).alias("dropoff_15m"), count(is_("dropoff") & matched & (F.col("same_zone") == 1)).alias("matched_rd_same_zone")],
        "stats": [F.avg(c).alias(n) for n, c in STATS.items()],
        "stats_spread": [F.stddev("congestion_surcharge").alias("std_congestion_surcharge"), F.stddev("airport_fee").alias("std_airport_fee")],
    }


def _seconds(duration: str) -> int:
    n, unit = duration.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.removesuffix("s")]


def _kinds(groups: Sequence[str]) -> list[str]:
    return sorted({g.removesuffix("_recent").removesuffix("_spread") for g in groups})


GROUPS = ("request", "pickup", "dropoff", "stats")
#: Whether a fact's request lies in the window depends on the pane's place there, so these are counted for every place.
_PLACED = {"pickup": ["matched_rp"], "dropoff": ["matched_rd"], "dropoff_recent": ["matched_rd_same_zone"]}


def panes(facts: DataFrame, slide: str = SLIDE, places: int = 4, groups: Sequence[str] = GROUPS, by: Sequence[str] = ("zone_id",)) -> DataFrame:
    """One row per key and pane, a tumbling window as wide as the slide, with what windows of up to ``places`` panes need of it."""
    total = lambda kind, c: F.coalesce(F.sum(_of(kind, F.col(c))), F.lit(0)).cast("long")
    delay = _of("pickup", F.col("delay"))

    def placed(kind: str, name: str, more: Column | bool = True) -> list[Column]:
        before = [F.col("request_ts") >= F.col("pane.start") - F.make_dt_interval(secs=F.lit(o * _seconds(slide))) for o in range(places)]
        return [F.count(F.when((F.col("kind") == kind) & b & more, 1)).alias(f"{name}_{o}") for o, b in enumerate(before)]

    columns = {
        "request": [F.count(_of("request")).alias("requests_60m"), total("request", "wav").alias("wav_req"), total("request", "aar").alias("aar_req"), total("request", "share").alias("share_req"), total("request", "uber").alias("uber_req")],
        "pickup": [F.count(_of("pickup")).alias("pickup_60m"), F.count(delay).alias("delay_n"), F.sum(delay).alias("delay_sum"), F.sum(delay * delay).alias("delay_squares"), *placed("pickup", "matched_rp"), total("pickup", "wav").alias("wav_match"), total("pickup", "share").alias("share_match")],
        "pickup_recent": [],  # made of the same columns
        "dropoff": [F.count(_of("dropoff")).alias("dropoff_60m"), *placed("dropoff", "matched_rd")],
        "dropoff_recent": placed("dropoff", "matched_rd_same_zone", F.col("same_zone") == 1),
        "stats": [f(c).alias(f"{n}_{part}") for n, c in STATS.items() for part, f in (("sum", F.sum), ("n", F.count))],
    }
    kinds = _kinds(groups)
    mine = facts if len(kinds) == 4 else facts.where(F.col("kind").isin(kinds))
    rows = mine.withColumn("pane", F.window("ts", slide)).groupBy(*by, "pane").agg(*[c for g in groups for c in columns[g]])
    return rows.withColumn("pane", F.col("pane.start"))


def windows(of: DataFrame, slide: str = SLIDE, places: int = 4, groups: Sequence[str] = GROUPS, by: Sequence[str] = ("zone_id",)) -> DataFrame:
    """Slot metrics of windows of so many panes: a pane goes to each window that covers it, at its place there."""
    placed = [n for g in groups for n in _PLACED.get(g, [])]
    recent = {"pickup_15m": ("pickup_recent", "pickup_60m"), "matched_rp_15m": ("pickup_recent", "matched_rp_{}"), "dropoff_15m": ("dropoff_recent", "dropoff_60m")}
    recent = {n: c for n, (g, c) in recent.items() if g in groups}

    def at(o: int) -> Column:
        end = (F.col("pane") + F.make_dt_interval(secs=F.lit((places - o) * _seconds(slide)))).alias("window_end")
        last = [(F.col(c.format(o)) if o == places - 1 else F.lit(0).cast("long")).alias(n) for n, c in recent.items()]
        return F.struct(end, *[F.col(f"{n}_{o}").alias(n) for n in placed], *last)

    many = tuple(f"{n}_" for n in placed)
    plain = [c for c in of.columns if c != "pane" and not (c.startswith(many) and c.rpartition("_")[2].isdigit() if many else False)]
    rows = of.select(*plain, F.explode(F.array(*[at(o) for o in range(places)])).alias("w")).select(*plain, "w.*")
    big = lambda c: F.sum(c).cast("decimal(19, 0)")
    squares = big("delay_n") * big("delay_squares") - big("delay_sum") * big("delay_sum")  # exact: equal delays have no spread
    n = F.sum("delay_n")
    summed = lambda *names: [F.sum(c).alias(c) for c in names]

    columns = {
        "request": summed("requests_60m", "wav_req", "aar_req", "share_req", "uber_req"),
        "pickup": [*summed("pickup_60m"), F.try_divide(F.sum("delay_sum"), n).alias("pickup_delay_mean"), F.when(n > 1, F.sqrt(squares.cast("double") / n / (n - 1))).otherwise(0.0).alias("pickup_delay_std"), *summed("matched_rp", "wav_match", "share_match")],
        "pickup_recent": summed("pickup_15m", "matched_rp_15m"),
        "dropoff": summed("dropoff_60m", "matched_rd"),
        "dropoff_recent": summed("dropoff_15m", "matched_rd_same_zone"),
        "stats": [F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in STATS],
    }
    return rows.groupBy(*by, "window_end").agg(*[c for g in groups for c in columns[g]])


def slot_metrics(facts: DataFrame, window: str = WINDOW, slide: str = SLIDE, groups: Sequence[str] = GROUPS, by: Sequence[str] = ("zone_id",)) -> DataFrame:
    """One row per key and slot with any fact of these groups; counts are 0 and means null where a group has none.

    Of a stream, for spreads of amounts, or where the window isn't a multiple of the slide, facts are aggregated by windows at once.
    """
    places, rest = divmod(_seconds(window), _seconds(slide))
    if not facts.isStreaming and not rest and "stats_spread" not in groups:
        return windows(panes(facts, slide, places, groups, by), slide, places, groups, by)
    columns, kinds = metric_columns(slide), _kinds(groups)
    mine = facts if len(kinds) == 4 else facts.where(F.col("kind").isin(kinds))
    rows = mine.withColumn("window", F.window("ts", window, slide)).groupBy(*by, "window").agg(*[c for g in groups for c in columns[g]])
    return rows.select(*by, F.col("window.end").alias("window_end"), *[c for c in rows.columns if c not in (*by, "window")])


def city_metrics(facts: DataFrame, window: str = "120 minutes", slide: str = "30 minutes") -> DataFrame:
    """All metrics of the city per slot, with last-slide counts and the plain imbalance."""
    groups = ("request", "pickup", "pickup_recent", "dropoff", "dropoff_recent", "stats", "stats_spread")
    rows = slot_metrics(facts, window, slide, groups, ())
    return rows.withColumn("imbalance", city_imbalance(F.col("pickup_delay_mean"), F.col("requests_60m")))
