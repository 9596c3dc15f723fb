"""Registered queries through readers, sinks and repairs: tables are written, read back and held against DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.clean import slot_ts
from ..operators import cleaning, grid, history, lifecycle, marts, model
from ..operators.slots import panes, slot_metrics, trip_facts, windows
from ..schemas import CYCLES, FEATURES, KEYS, LAG_STEPS, LAGGED, LEAD_COLS, LEAD_STEPS, STATS, WEATHER_COLS
from ..sources import readers, sinks
from ..sources.weather import normalize_weather, read_weather
from . import features, fixtures
from . import queries as base
from .queries import CLEAN, EDGES, GOLD, GRID, LABELED, ORACLE_SQL, PREDICTIONS, query, rounded

_MEANS = ", ".join(f"round({c}, 6) AS {c}" for c in ("pickup_delay_mean", "pickup_delay_std", *STATS))


# Row rules.

@query(f"WITH {fixtures.DUCK_TRIPS} SELECT trip_id, pickup_datetime FROM trips WHERE pickup_datetime >= request_datetime")
def ordered_trips(spark, sf_dir):
    return cleaning.ordered(base._trips(spark, sf_dir)).select("trip_id", "pickup_datetime")


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN concat('x', user_id) ELSE CAST(user_id AS STRING) END AS INT) AS user FROM events")
def recast_events(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "user_id")).otherwise(F.col("user_id").cast("string"))
    return cleaning.recast(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("user")), {"user": "int"})


@query(f"WITH {GOLD} SELECT DISTINCT window_end, CAST(epoch(window_end) AS BIGINT) AS epoch FROM gold")
def slot_instants(spark, sf_dir):
    slots = cleaning.distinct_keys(base._gold(spark, sf_dir), ["window_end"])
    return slots.select("window_end", F.unix_seconds(slot_ts("window_end")).alias("epoch"))


@query(f"WITH {GOLD} SELECT zone_id, window_end, requests_60m FROM gold WHERE zone_id BETWEEN 10 AND 200 AND window_end BETWEEN TIMESTAMP '2025-01-08 00:00:00' AND TIMESTAMP '2025-01-10 12:00:00'")
def slots_in_range(spark, sf_dir):
    return cleaning.restrict(base._gold(spark, sf_dir), (10, 200), "2025-01-08 00:00:00", "2025-01-10 12:00:00").select(*KEYS, "requests_60m")


@query(f"WITH {CLEAN} SELECT PULocationID, count(*) AS n, round(quantile_disc(driver_pay, 0.5), 6) AS median FROM clean GROUP BY 1")
def approximate_medians(spark, sf_dir):
    """Medians of bounded memory, exact however many trips a zone has: sketches only tell which values are ranked."""
    trips = sinks.written(cleaning.clean_trips(base._trips(spark, sf_dir)).select("PULocationID", "driver_pay"))
    cuts = history.exact_cuts(trips, "driver_pay", [0.5], by=["PULocationID"], discrete=True)
    return rounded(cuts.join(cleaning.count_where(trips, "true", ["PULocationID"]), "PULocationID").select("PULocationID", "n", F.col("_cuts")[0].alias("median")))


@query(f"WITH {CLEAN} SELECT strftime(request_datetime, '%Y-%m') AS month, count(*) AS trips FROM clean GROUP BY 1")
def monthly_demand(spark, sf_dir):
    return marts.by_month(cleaning.clean_trips(base._trips(spark, sf_dir)))


@query(f"WITH {CLEAN} SELECT strftime(request_datetime, '%Y-%m-%d') AS day, count(*) AS trips FROM clean GROUP BY 1")
def daily_demand(spark, sf_dir):
    return marts.by_day(cleaning.clean_trips(base._trips(spark, sf_dir)))


@query(f"WITH {CLEAN}, n AS (SELECT PULocationID, count(*) AS trips FROM clean GROUP BY 1) SELECT PULocationID, trips, round(trips / sum(trips) OVER (), 6) AS share FROM n")
def zone_shares(spark, sf_dir):
    n = cleaning.clean_trips(base._trips(spark, sf_dir)).groupBy("PULocationID").agg(F.count("*").alias("trips"))
    return rounded(history.share(n, "trips"))


# Slots at given times, leads by row, real edges.

@query(f"WITH {GRID}, {fixtures.DUCK_WEATHER} SELECT zone_id, window_end, " + ", ".join(f"lead({c}, {s}) OVER w AS {c}_lead{s}" for c in ("temperature_2m", "cloud_cover") for s in LEAD_STEPS) + " FROM filled LEFT JOIN weather USING (zone_id, window_end) WINDOW w AS (PARTITION BY zone_id ORDER BY window_end)")
def row_leads(spark, sf_dir):
    rows = history.weather_now(base._filled(spark, sf_dir, "requests_60m").select(*KEYS), fixtures.weather(spark), ["temperature_2m", "cloud_cover"])
    leads = history.row_leads(rows, ["temperature_2m", "cloud_cover"])
    return leads.select(*KEYS, *[c for c in leads.columns if "_lead" in c])


@query(f"WITH {PREDICTIONS}, t AS (SELECT DISTINCT window_end + INTERVAL '60 minutes' AS window_end FROM predictions WHERE predicted_class = 5) SELECT zone_id, window_end, requests_60m FROM gold SEMI JOIN t USING (window_end)")
def target_slots(spark, sf_dir):
    gold = base._gold_table(spark, sf_dir, "requests_60m")
    targets = fixtures.predictions(gold).where("predicted_class = 5").select((F.col("window_end") + F.expr("INTERVAL 60 MINUTES")).alias("window_end"))
    return history.rows_at(gold, targets, [*KEYS, "requests_60m"])


@query(f"WITH {GOLD}, e AS (SELECT DISTINCT PULocationID AS zone_id, DOLocationID AS neighbor_zone_id FROM trips WHERE trip_time < 150 AND DOLocationID BETWEEN 1 AND 263), d AS (SELECT zone_id, count(*) AS num_neighbors FROM e GROUP BY 1), n AS (SELECT e.zone_id, window_end, sum(requests_60m) AS s FROM e JOIN gold g ON g.zone_id = e.neighbor_zone_id GROUP BY ALL) SELECT zone_id, window_end, CAST(coalesce(s, 0) AS BIGINT) AS neighbor_requests_60m, coalesce(num_neighbors, 0) AS num_neighbors FROM gold LEFT JOIN n USING (zone_id, window_end) LEFT JOIN d USING (zone_id)")
def adjacent_requests(spark, sf_dir):
    """Neighbours by an edge table that is written as CSV and read as real adjacency is: zones that short trips join."""
    trips = base._trips(spark, sf_dir)
    edges = trips.where("trip_time < 150 AND DOLocationID BETWEEN 1 AND 263").select(F.col("PULocationID").alias("zone_id"), F.col("DOLocationID").alias("neighbor_zone_id")).distinct()
    path = f"{sinks.work_folder(spark)}/edges"
    edges.write.option("header", True).csv(path)
    return grid.neighbor_features(base._gold_table(spark, sf_dir, "requests_60m", "pickup_delay_mean"), grid.adjacency(spark, path)).select(*KEYS, "neighbor_requests_60m", "num_neighbors")


@query(f"WITH {GOLD} SELECT zone_id, window_end, round(coalesce(pow(greatest(coalesce(pickup_delay_mean, 0), 0), 1.2) * requests_60m / CASE WHEN zone_id % 2 = 0 THEN 1.5 ELSE 1.0 END, 0), 6) AS imbalance FROM gold")
def mapped_area_imbalance(spark, sf_dir):
    """Areas from a dictionary; zones that it lacks count as 1.0."""
    return rounded(grid.with_imbalance(base._gold(spark, sf_dir), grid.area_map({z: 1.5 for z in range(2, 264, 2)})).select(*KEYS, "imbalance"))


# Tables written and read back.

@query(ORACLE_SQL["time_split"])
def split_tables(spark, sf_dir):
    path = f"{sinks.work_folder(spark)}/split"
    sinks.write_split(history.time_split(sinks.written(base._gold(spark, sf_dir).select(*KEYS))), path)
    return readers.read_table(spark, path).withColumn("is_train", F.col("is_train").cast("boolean"))


@query(f"WITH {GOLD} SELECT zone_id, window_end, requests_60m FROM gold WHERE window_end BETWEEN TIMESTAMP '2025-01-07 22:00:00' AND TIMESTAMP '2025-01-09 01:00:00'")
def appended_days(spark, sf_dir):
    """Slots appended to day folders in two parts, read back by a time range that prunes them; an existing table is not created again."""
    path = f"{sinks.work_folder(spark)}/days"
    dated = cleaning.with_event_day(base._gold(spark, sf_dir).select(*KEYS, "requests_60m"), "window_end").persist()
    try:
        sinks.append(dated.where("zone_id <= 100"), path, sinks.DAY)
        sinks.create_if_absent(dated, path)
        sinks.append(dated.where("zone_id > 100"), path, sinks.DAY)
    finally:
        dated.unpersist()
    return readers.read_table(spark, path, time_range=("window_end", "2025-01-07 22:00:00", "2025-01-09 01:00:00")).select(*KEYS, "requests_60m")


@query(f"WITH {fixtures.DUCK_TRIPS} SELECT trip_id, CAST(CASE WHEN PULocationID % 2 = 0 THEN NULL ELSE trip_time END AS BIGINT) AS trip_time FROM trips")
def drifting_files(spark, sf_dir):
    """Files of two schemas (a column of text, or absent), grouped by their footers, cast and united."""
    trips, folder = base._trips(spark, sf_dir), sinks.work_folder(spark)
    sinks.write_training(trips.where("PULocationID % 2 = 0").select("trip_id"), f"{folder}/old")
    sinks.rewrite_zstd(trips.where("PULocationID % 2 = 1").select("trip_id", F.col("trip_time").cast("string").alias("trip_time")), f"{folder}/new")
    groups = [r.files for r in readers.schema_groups(spark, [f"{folder}/old", f"{folder}/new"]).orderBy("schema").collect()]
    return readers.read_union_by_name(spark, groups, {"trip_time": "bigint"})


@query(ORACLE_SQL["zone_map_rows"])
def zone_map_file(spark, sf_dir):
    """The map written as lines and read back."""
    gold, path = base._gold_table(spark, sf_dir, "requests_60m"), f"{sinks.work_folder(spark)}/map"
    sinks.write_zone_map(marts.zone_map_rows(cleaning.distinct_keys(gold, ["zone_id"]), fixtures.predictions(gold)), path)
    p = F.from_json("value", "id int, properties struct<has_prediction:boolean, demand_label:string, confidence:double>")
    return spark.read.text(path).select(p.alias("d")).select(F.col("d.id").alias("zone_id"), "d.properties.*")


@query(ORACLE_SQL["event_parse"])
def event_files(spark, sf_dir):
    """Messages written as text files and read by the event reader."""
    path = f"{sinks.work_folder(spark)}/events"
    sinks.write_events(sinks.encode_events(base._trips(spark, sf_dir)), path)
    events = readers.parse_events(readers.read_events(spark, path), base._fields("trip_id", "event_type", "event_time", "PULocationID", "DOLocationID"))
    zone = F.when(F.col("event_type") == "dropoff", F.col("DOLocationID")).otherwise(F.col("PULocationID"))
    return events.select("trip_id", "event_type", base.clean_timestamp("event_time").cast("timestamp_ntz").alias("event_time"), zone.alias("zone"))


_DAY2 = "CAST(window_end AS DATE) >= (SELECT max(CAST(window_end AS DATE)) - 1 FROM predictions)"


@query(f"WITH {PREDICTIONS} SELECT zone_id, window_end, CASE WHEN {_DAY2} THEN CAST(5 - predicted_class AS INT) ELSE predicted_class END AS predicted_class, used_model, model_version, predicted_at, shadow_predicted_class, round(pred_confidence, 6) AS pred_confidence, {', '.join(f'round(proba_{i}, 6) AS proba_{i}' for i in range(6))}, {', '.join(f'CAST(NULL AS DOUBLE) AS shadow_proba_{i}' for i in range(6))} FROM predictions")
def prediction_upsert(spark, sf_dir):
    """Predictions with all their columns upserted by (zone_id, window_end); the last two days twice, the second time with new classes."""
    path = f"{sinks.work_folder(spark)}/predictions"
    rows = base._predictions(spark, sf_dir).withColumns({f"shadow_proba_{i}": F.lit(None).cast("double") for i in range(6)})
    sinks.upsert(rows, path)
    last = rows.agg(F.date_sub(F.max(F.to_date("window_end")), 1).alias("_from"))
    again = rows.crossJoin(F.broadcast(last)).where("to_date(window_end) >= _from").drop("_from").withColumn("predicted_class", (5 - F.col("predicted_class")).cast("int"))
    for _ in range(2):
        sinks.upsert(again, path)
    return rounded(readers.read_predictions(spark, path).drop("slot_day"))


@query(f"WITH {GOLD} SELECT * REPLACE ({_MEANS}) FROM gold")
def repaired_slots(spark, sf_dir):
    """A table made without the trips that come late; the days that those touch are made anew."""
    from ..streaming.jobs import repair_days

    trips, path = cleaning.clean_trips(base._trips(spark, sf_dir)), f"{sinks.work_folder(spark)}/gold"
    late = "PULocationID % 5 = 0 AND to_date(request_datetime) = DATE'2025-01-12'"
    sinks.upsert(slot_metrics(trip_facts(trips.where(f"NOT ({late})"))), path)
    days = slot_metrics(trip_facts(trips.where(late))).select(F.to_date("window_end").alias("date")).distinct()
    repair_days(trips, path, days)
    return rounded(cleaning.restrict(spark.read.parquet(path).drop("slot_day")))


# Panes, pruned reads, tables of several schemas, databases, models, maps.

def _width(n: int) -> str:
    """Requests and pickups of windows of n panes, in SQL."""
    slots = lambda ts, columns: f"SELECT PULocationID AS zone_id, window_end, {columns} FROM (SELECT *, {base._slots(ts, n)} FROM clean) GROUP BY ALL"
    pickups = f"count(*) AS pickup_60m, count(*) FILTER (WHERE request_datetime >= window_end - INTERVAL '{15 * n} minutes') AS matched_rp, avg({base._DELAY}) AS m, stddev_samp({base._DELAY}) AS s"
    return (f"SELECT {15 * n} AS minutes, zone_id, window_end, coalesce(requests_60m, 0) AS requests_60m, coalesce(pickup_60m, 0) AS pickup_60m, coalesce(matched_rp, 0) AS matched_rp, round(m, 6) AS pickup_delay_mean, round(coalesce(s, 0), 6) AS pickup_delay_std "
            f"FROM ({slots('request_datetime', 'count(*) AS requests_60m')}) FULL JOIN ({slots('pickup_datetime', pickups)}) USING (zone_id, window_end)")


@query(f"WITH {CLEAN} " + " UNION ALL ".join(map(_width, (1, 2, 4))))
def pane_windows(spark, sf_dir):
    """Slots of 15, 30 and 60 minutes from one table of panes, which is all that is made of the trips themselves."""
    groups = ("request", "pickup")
    made = sinks.written(panes(trip_facts(cleaning.clean_trips(base._trips(spark, sf_dir))), groups=groups))
    columns = [*KEYS, "requests_60m", "pickup_60m", "matched_rp", "pickup_delay_mean", "pickup_delay_std"]
    widths = [windows(made, places=n, groups=groups).select(F.lit(15 * n).alias("minutes"), *columns) for n in (1, 2, 4)]
    return rounded(cleaning.union_all(widths))


def _slot_table(spark, sf_dir, *columns):
    """Gold partitioned by slot_day, with the slot in seconds beside, as jobs write it."""
    path = f"{sinks.work_folder(spark)}/gold"
    gold = base._gold(spark, sf_dir)
    sinks.upsert(gold.select(*KEYS, *columns, sinks.slot_seconds().alias("slot_s")), path)
    return path


@query(f"WITH {GOLD} SELECT max(window_end) AS window_end FROM gold")
def footer_latest_slot(spark, sf_dir):
    """The latest slot by the footers of the files: no row is read."""
    return readers.latest_slot(spark, _slot_table(spark, sf_dir, "requests_60m"))


@query(ORACLE_SQL["lag_snapshots"])
def pruned_snapshots(spark, sf_dir):
    """The latest slot, from footers, and its two lag slots, from their own three days."""
    path = _slot_table(spark, sf_dir, "requests_60m")
    return history.snapshots(readers.read_table(spark, path), latest=readers.latest_slot(spark, path)).select(*KEYS, "step", "requests_60m")


@query(ORACLE_SQL["target_slots"])
def pruned_targets(spark, sf_dir):
    """Slots that predictions aim at, read from their days."""
    gold = readers.read_table(spark, _slot_table(spark, sf_dir, "requests_60m"))
    targets = fixtures.predictions(gold).where("predicted_class = 5").select((F.col("window_end") + F.expr("INTERVAL 60 MINUTES")).alias("window_end"))
    return history.rows_at(gold, targets, [*KEYS, "requests_60m"])


@query(f"WITH {GOLD} SELECT zone_id, window_end, requests_60m, CASE WHEN zone_id > 100 THEN round(pickup_delay_mean, 6) END AS pickup_delay_mean, CASE WHEN zone_id > 180 THEN zone_id % 7 END AS source FROM gold")
def merged_appends(spark, sf_dir):
    """Three appends to one table, each with a column more than the last, one of them with a column of another type."""
    path = f"{sinks.work_folder(spark)}/merged"
    gold = sinks.written(cleaning.with_event_day(base._gold(spark, sf_dir).select(*KEYS, "requests_60m", "pickup_delay_mean"), "window_end"))
    sinks.append_merged(gold.where("zone_id <= 100").drop("pickup_delay_mean"), path, sinks.DAY)
    sinks.append_merged(gold.where("zone_id > 100 AND zone_id <= 180").withColumn("requests_60m", F.col("requests_60m").cast("int")), path, sinks.DAY)
    sinks.append_merged(gold.where("zone_id > 180").withColumns({"source": F.col("zone_id") % 7, "requests_60m": F.col("requests_60m").cast("string")}), path, sinks.DAY)
    return rounded(readers.read_table(spark, path, merge=True).select(*KEYS, "requests_60m", "pickup_delay_mean", "source"))


def _database(spark) -> dict[str, str]:
    """JDBC options by spark.tripflow.jdbc.*, or a database inside Spark's own process where that is unset and there is no other process."""
    url = spark.conf.get("spark.tripflow.jdbc.url", None)
    if url:
        return {"url": url, **{k: v for k in ("driver", "user", "password") if (v := spark.conf.get(f"spark.tripflow.jdbc.{k}", None))}}
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.tripflow.jdbc.url to a database that all executors reach")
    return {"url": "jdbc:derby:memory:tripflow;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@query(ORACLE_SQL["prediction_upsert"])
def prediction_jdbc(spark, sf_dir):
    """prediction_upsert through a database: staged in parallel, merged by key, read back in ranges of zones."""
    rows = sinks.written(base._predictions(spark, sf_dir).withColumns({f"shadow_proba_{i}": F.lit(None).cast("double") for i in range(6)}))
    jdbc = {**_database(spark), "dbtable": f"predictions_{uuid.uuid4().hex[:12]}"}
    kinds = {"int": "INTEGER", "string": "VARCHAR(40)", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE PRECISION"}
    columns = ", ".join(f'"{c}" {kinds[t]}{" NOT NULL" if c in KEYS else ""}' for c, t in rows.dtypes)
    sinks.execute(spark, jdbc, [f'CREATE TABLE {jdbc["dbtable"]} ({columns}, PRIMARY KEY ("zone_id", "window_end"))'])
    last = rows.agg(F.date_sub(F.max(F.to_date("window_end")), 1).alias("_from"))
    again = rows.crossJoin(F.broadcast(last)).where("to_date(window_end) >= _from").drop("_from").withColumn("predicted_class", (5 - F.col("predicted_class")).cast("int"))
    for batch in (rows, again, again):
        sinks.upsert_jdbc(batch, jdbc)
    found = sinks.written(readers.read_predictions(spark, jdbc=jdbc))
    sinks.execute(spark, jdbc, [f'DROP TABLE {jdbc["dbtable"]}'])
    return rounded(found)


@query(f"WITH {fixtures.DUCK_TRIPS} SELECT CAST(PULocationID AS BIGINT) AS \"PULocationID\", CAST(DOLocationID AS BIGINT) AS \"DOLocationID\", request_datetime, shared_match_flag AS share_match_flag, shared_request_flag AS share_request_flag, round(base_passenger_fare, 6) AS base_passenger_fare, trip_time FROM trips WHERE {cleaning.VALID_STATS}")
def projected_trips(spark, sf_dir):
    """Trips written as the source's files are, read by the fixed schema, projected to 22 columns, valid ones only."""
    path = f"{sinks.work_folder(spark)}/source"
    trips = base._trips(spark, sf_dir)
    sinks.write_training(trips.select(*[c for c in trips.columns if c != "trip_id"]), path)
    found = readers.project_trips(readers.read_trips(spark, path))
    return rounded(cleaning.valid_stats(found).select("PULocationID", "DOLocationID", "request_datetime", "share_match_flag", "share_request_flag", "base_passenger_fare", "trip_time"))


@query(f"WITH {fixtures.DUCK_TRIPS}, {base._R} SELECT count(*) AS n_unmatched FROM r WHERE trip_id NOT IN (SELECT trip_id FROM response)")
def unmatched_requests(spark, sf_dir):
    t = base._trips(spark, sf_dir)
    requests = lifecycle.dedup(cleaning.valid_requests(t).select("trip_id", "request_datetime"), ["trip_id"], "request_datetime")
    return lifecycle.unmatched(requests, base._response(spark, sf_dir))


@query(f"WITH {fixtures.DUCK_TRIPS}, twice AS (SELECT trip_id FROM trips UNION ALL SELECT trip_id FROM trips WHERE PULocationID % 50 = 0 UNION ALL SELECT trip_id FROM trips WHERE PULocationID % 100 = 0) SELECT trip_id, count(*) AS n FROM twice GROUP BY 1 HAVING count(*) > 1")
def repeated_trips(spark, sf_dir):
    """Trips of some zones given twice, and of some three times, found by their key."""
    t = base._trips(spark, sf_dir).select("trip_id", "PULocationID")
    return cleaning.duplicate_keys(t.unionAll(t.where("PULocationID % 50 = 0")).unionAll(t.where("PULocationID % 100 = 0")), ["trip_id"])


_FLAGS = f"""weather_flags AS (SELECT g.zone_id, g.window_end, a.zone_id IS NOT NULL AND b.zone_id IS NOT NULL AND c.zone_id IS NOT NULL AND d.zone_id IS NOT NULL AS ok FROM labeled g LEFT JOIN weather a USING (zone_id, window_end)
LEFT JOIN weather b ON b.zone_id = g.zone_id AND b.window_end = g.window_end + INTERVAL '15 minutes' LEFT JOIN weather c ON c.zone_id = g.zone_id AND c.window_end = g.window_end + INTERVAL '30 minutes' LEFT JOIN weather d ON d.zone_id = g.zone_id AND d.window_end = g.window_end + INTERVAL '45 minutes')"""


@query(f"""WITH {LABELED}, {fixtures.DUCK_WEATHER}, {_FLAGS}, o AS (SELECT *, row_number() OVER (ORDER BY window_end, zone_id) AS r, count(*) OVER () AS n FROM weather_flags), v AS (SELECT * FROM o WHERE r > floor(n * 0.9)),
s AS (SELECT count(*) FILTER (WHERE NOT ok) AS n_skipped FROM v)
SELECT CASE WHEN ok THEN 'model_a' ELSE 'model_b' END AS used_model, count(*) AS n, count(*) FILTER (WHERE ok) AS n_shadow, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS BIGINT) AS n_unlike, any_value(n_skipped) AS n_skipped, CASE WHEN ok THEN 80 ELSE 55 END AS n_features, 1.0 AS importance FROM v, s GROUP BY ok""")
def trained_scores(spark, sf_dir):
    """Two models, with and without weather, fitted by class weights on the first nine tenths of slots, saved, loaded and applied to the last tenth.

    Per model: rows, rows with a shadow class, rows whose probabilities aren't six shares of one, rows that the loaded model scores unlike the fitted one, rows that
    model_a alone would skip, features of the contract, and the sum of their importances.
    """
    folder = sinks.work_folder(spark)
    gold = base._gold_table(spark, sf_dir)
    rows = features.training_set(grid.fill_grid(base._grid(gold), gold), grid.ring_edges(spark), base._area(), fixtures.weather(spark))
    rows = sinks.written(history.time_split(rows))
    train, rest = model.with_class_weight(rows.where("is_train")), rows.where("NOT is_train")
    fitted = {name: model.fit(train, columns, trees=2, depth=3) for name, columns in model.CONTRACTS.items()}
    loaded = {name: model.saved(m, f"{folder}/{name}") for name, m in fitted.items()}
    score = lambda m: model.score(rest, m["model_a"], m["model_b"], m["model_a"], "1", "1", F.lit("2025-01-19 10:00:00").cast("timestamp"))
    probas = [f"proba_{i}" for i in range(6)]
    sound = (F.least(*probas) >= 0) & (F.abs(sum(F.col(p).cast("double") for p in probas) - 1) < 1e-5)
    other = score(fitted).select(*KEYS, F.struct("predicted_class", "shadow_predicted_class", *probas).alias("other"))
    both = score(loaded).join(other, KEYS)
    unlike = F.struct("predicted_class", "shadow_predicted_class", *probas) != F.col("other")
    out = both.groupBy("used_model").agg(F.count("*").alias("n"), F.count("shadow_predicted_class").alias("n_shadow"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("n_wrong"), F.count_if(unlike).alias("n_unlike"))
    shares = cleaning.union_all([model.importance(m).agg(F.sum("share").alias("importance")).select(F.lit(name).alias("used_model"), F.lit(len(model.CONTRACTS[name])).alias("n_features"), "importance") for name, m in loaded.items()])
    return rounded(out.crossJoin(F.broadcast(model.skipped(rest))).join(F.broadcast(shares), "used_model"))


@query(f"WITH {PREDICTIONS}, l AS (SELECT * FROM predictions {base._LATEST}) SELECT zone_id, predicted_class IS NOT NULL AS has_prediction, {base._LABEL_CASE} AS demand_label, round(pred_confidence, 3) AS confidence, 'Polygon' AS shape, round(zone_id % 20 * 0.05 - 74.3, 6) AS lon, round(floor(zone_id / 20) * 0.05 + 40.4, 6) AS lat FROM (SELECT DISTINCT zone_id FROM gold) LEFT JOIN l USING (zone_id)")
def zone_map_geometry(spark, sf_dir):
    """Zones of one nested document over many lines, exploded, joined with the latest predictions and exported with their geometry."""
    folder, gold = sinks.work_folder(spark), base._gold_table(spark, sf_dir, "requests_60m")
    x, y = F.col("zone_id") % 20 * 0.05 - 74.3, F.floor(F.col("zone_id") / 20) * 0.05 + 40.4
    ring = F.array(*[F.array(x + dx, y + dy) for dx, dy in ((0.0, 0.0), (0.04, 0.0), (0.04, 0.04), (0.0, 0.04), (0.0, 0.0))])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.col("zone_id").cast("string").alias("LocationID"), F.lit("zone").alias("zone")).alias("properties"))
    # At most one feature a zone, of which there are some hundreds.
    document = cleaning.distinct_keys(gold, ["zone_id"]).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features")), {"pretty": "true"}).alias("value"))
    document.write.text(f"{folder}/zones")
    zones = readers.read_zone_features(spark, f"{folder}/zones")
    sinks.write_zone_map(marts.zone_map_rows(zones, fixtures.predictions(gold)), f"{folder}/map")
    # A feature's geometry is written as it was read: a text of its own.
    p = F.from_json("value", "id int, geometry string, properties struct<has_prediction:boolean, demand_label:string, confidence:double>")
    shape = F.from_json("d.geometry", "type string, coordinates array<array<array<double>>>")
    found = spark.read.text(f"{folder}/map").select(p.alias("d")).select("d", shape.alias("g"))
    corner = F.col("g.coordinates")[0][0]
    return rounded(found.select(F.col("d.id").alias("zone_id"), "d.properties.*", F.col("g.type").alias("shape"), corner[0].alias("lon"), corner[1].alias("lat")))


@query(f"WITH {PREDICTIONS} SELECT count(DISTINCT zone_id) AS prediction_count, max(window_end) AS latest_window FROM predictions {base._LATEST}")
def map_properties(spark, sf_dir):
    return marts.map_properties(base._predictions(spark, sf_dir))


@query(f"WITH {GOLD}, {fixtures.DUCK_WEATHER} SELECT zone_id, window_end, round(coalesce(CASE WHEN zone_id % 3 = 0 THEN requests_60m - 50.0 END, temperature_2m), 6) AS temperature_2m, round(precipitation, 6) AS precipitation FROM gold LEFT JOIN weather USING (zone_id, window_end)")
def own_weather(spark, sf_dir):
    """Slots that have a measure of their own keep it; the rest is the table's."""
    slots = base._gold(spark, sf_dir).select(*KEYS, F.when(F.col("zone_id") % 3 == 0, F.col("requests_60m") - 50.0).alias("temperature_2m"))
    return rounded(history.weather_now(slots, fixtures.weather(spark), ["temperature_2m", "precipitation"]))


_W = ", ".join(f"round({c}, 6) AS {c}" if c not in ("cloud_cover", "weather_code") else c for c in WEATHER_COLS)


@query(f"WITH {fixtures.DUCK_WEATHER} SELECT zone_id, window_end, {_W} FROM weather WHERE window_end BETWEEN TIMESTAMP '2025-01-10 00:00:00' AND TIMESTAMP '2025-01-12 23:59:59' AND EXISTS (SELECT 1 FROM lineitem)")
def weather_fallback(spark, sf_dir):
    """Weather of one trip day's slots: an absent source, then an empty one, then a table by date, pruned to the days needed."""
    folder = sinks.work_folder(spark)
    weather = fixtures.weather(spark).where("window_end BETWEEN TIMESTAMP_NTZ'2025-01-09 00:00:00' AND TIMESTAMP_NTZ'2025-01-13 23:59:59'")
    weather.withColumn("date", F.to_date("window_end")).write.partitionBy("date").parquet(f"{folder}/weather")
    weather.where("false").write.parquet(f"{folder}/empty")
    slots = base._gold(spark, sf_dir).where("to_date(window_end) = DATE'2025-01-11'")
    sources = [lambda s: s.read.parquet(f"{folder}/absent"), lambda s: s.read.parquet(f"{folder}/empty"), lambda s: s.read.parquet(f"{folder}/weather")]
    rows = read_weather(spark, sources, slots.select("window_end"))
    return rounded(normalize_weather(rows).where("to_date(window_end) BETWEEN DATE'2025-01-10' AND DATE'2025-01-12'"))


# Whole matrices.

def _feature_sql(source: str) -> str:
    """All features but the lags, of the slots in ``source``."""
    leads = ", ".join(f"w{s}.{c} AS {c}_lead{s}" for c in LEAD_COLS for s in LEAD_STEPS)
    joins = " ".join(f"LEFT JOIN weather w{s} ON w{s}.zone_id = f.zone_id AND w{s}.window_end = f.window_end + INTERVAL '{15 * s} minutes'" for s in (0, *LEAD_STEPS))
    return (f"""{GRID}, {EDGES}, {fixtures.DUCK_WEATHER}, im AS MATERIALIZED (SELECT *, {base._IMBALANCE} AS imbalance FROM {source}), deg AS (SELECT zone_id, count(*) AS num_neighbors FROM edges GROUP BY ALL),
nb AS (SELECT e.zone_id, window_end, sum(requests_60m) AS s, avg(pickup_delay_mean) AS m FROM edges e JOIN im g ON g.zone_id = e.neighbor_zone_id GROUP BY ALL),
f AS MATERIALIZED (SELECT im.*, CAST(coalesce(s, 0) AS BIGINT) AS neighbor_requests_60m, coalesce(m, 0) AS neighbor_pickup_delay_mean, coalesce(num_neighbors, 0) AS num_neighbors, CAST(isodow(window_end) >= 6 AS INT) AS is_weekend, CAST(CAST(window_end AS DATE) IN ({base._HOLIDAYS}) AS INT) AS is_holiday, {base._CYCLE_SQL}
FROM im LEFT JOIN nb USING (zone_id, window_end) LEFT JOIN deg USING (zone_id)), feat AS MATERIALIZED (SELECT f.*, {', '.join(f'w0.{c}' for c in WEATHER_COLS)}, {leads} FROM f {joins})""")


_LAG_BY_ROW = ", ".join(f"lag({c}, {s}) OVER w AS {c}_lag{s}" for c in LAGGED for s in LAG_STEPS)
_DOUBLES = {"pickup_delay_mean", "pickup_delay_std", *STATS, *WEATHER_COLS, "neighbor_pickup_delay_mean", "imbalance", *CYCLES} - {"cloud_cover", "weather_code"}
_CONTRACT = ", ".join(f"round({c}, 6) + 0.0 AS {c}" if c.split("_lag")[0].split("_lead")[0] in _DOUBLES else c for c in FEATURES)
_BY_ROW = f"{_feature_sql('filled')}, lagged AS MATERIALIZED (SELECT *, {_LAG_BY_ROW} FROM feat WINDOW w AS (PARTITION BY zone_id ORDER BY window_end))"
_SNAPSHOT_LAGS = ", ".join(f"s{s}.{c} AS {c}_lag{s}" for c in LAGGED for s in LAG_STEPS)

ORACLE_SQL["inference_matrix"] = (f"WITH {_feature_sql('gold')}, lagged AS (SELECT feat.*, {_SNAPSHOT_LAGS} FROM feat " + " ".join(f"LEFT JOIN f s{s} ON s{s}.zone_id = feat.zone_id AND s{s}.window_end = feat.window_end - INTERVAL '{15 * s} minutes'" for s in LAG_STEPS)
                                  + f" WHERE feat.window_end = (SELECT max(window_end) FROM gold)) SELECT window_end, {_CONTRACT} FROM lagged")
ORACLE_SQL["training_matrix"] = (f"WITH {LABELED.replace(GRID, _BY_ROW, 1).replace('im AS (SELECT zone_id, window_end,', 'im2 AS (SELECT zone_id, window_end,').replace('FROM im)', 'FROM im2)')} "
                                 f"SELECT window_end, round(l.f, 6) AS future_imbalance, l.label_6class, {_CONTRACT} FROM lagged JOIN labeled l USING (zone_id, window_end)")


@query(f"WITH {_BY_ROW} SELECT window_end, {_CONTRACT} FROM lagged WHERE window_end = (SELECT max(window_end) FROM filled)")
def inference_from_history(spark, sf_dir):
    """The latest row of each zone, lags by row over its whole history."""
    return rounded(features.inference_latest(base._filled(spark, sf_dir), grid.ring_edges(spark), base._area(), fixtures.weather(spark)))
