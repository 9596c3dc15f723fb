"""Sinks: partitioned appends, fan-out, keyed upserts on plain Parquet, exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import anti, route
from ..schemas import KEYS

DAY = ["year", "month", "day"]
#: An option of Parquet: a dictionary of ids that hardly repeat is built in vain.
UNIQUE_ID = ("parquet.enable.dictionary#trip_id", "false")


def work_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a local one only where that is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder: for plans that use it several times, and to cut lineage."""
    path = f"{work_folder(df.sparkSession)}/once"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most so many rows, and as it is beyond. Counts no further, and at once."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def append(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def append_merged(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Appends rows whose columns may differ from the table's: new ones are added, absent ones stay null, and those of other types are cast.

    A value that the table's type can't hold is an error, not a null. Read the table with ``merge``.
    """
    spark = df.sparkSession
    have = {f.name.lower(): f for f in spark.read.option("mergeSchema", "true").parquet(path).schema} if exists(spark, path) else {}
    fitted = [F.col(c).cast(have[c.lower()].dataType).alias(have[c.lower()].name) if c.lower() in have else F.col(c) for c in df.columns]
    append(df.select(*fitted), path, partitions)


def fan_out(batch: DataFrame, batch_id: int, tables: Mapping[str, str], routes: Callable[[DataFrame, str], DataFrame] = route) -> None:
    """One micro-batch of events to a table per kind, read once. Each batch overwrites its own part, so a repeat is harmless."""
    batch = batch.persist()
    try:
        if batch.isEmpty():
            return
        for kind, path in tables.items():
            rows = routes(batch, kind).withColumn("batch_id", F.lit(batch_id))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("batch_id", *DAY).parquet(path)
    finally:
        batch.unpersist()


def start_append(stream: DataFrame, path: str, checkpoint: str, name: str, trigger: str | None = None, partitions: Sequence[str] = ()) -> StreamingQuery:
    """trigger: a processing time such as "10 seconds"; None: all that is available, then stop."""
    writer = stream.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).option("path", path).option(*UNIQUE_ID).format("parquet").partitionBy(*partitions)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def one_per_key(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ()) -> DataFrame:
    """The row of each key that is greatest by ``order`` and then by all columns (none of them a map), whatever the order of arrival."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    rows = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate((*order, *rest))])).alias("_row"))
    return rows.select(*[F.col(c) if c in keys else F.col(f"_row._{len(order) + rest.index(c)}").alias(c) for c in df.columns])


def merge_rows(existing: DataFrame, updates: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ()) -> DataFrame:
    """existing with rows of equal keys replaced by updates, and the other updates added. Repeated keys in updates: the row greatest by ``order``."""
    new = one_per_key(updates, keys, order)
    return anti(existing, new.select(*keys)).unionByName(new, allowMissingColumns=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def move(spark: SparkSession, path: str, to: str) -> None:
    """A folder under another name, whose parent is made where it lacks. No file is copied where the file system renames."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, new = files.Path(path), files.Path(to)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"{path} could not be moved to {to}")


def upsert(df: DataFrame, path: str, keys: Sequence[str] = KEYS, ts: str = "window_end", merge: Callable[[DataFrame, str, Sequence[str]], None] | None = None, order: Sequence[str] = ()) -> None:
    """Keyed upsert of a table partitioned by the day of ts.

    Only days that df touches are read and rewritten: their new content is staged beside the table, then replaces
    those partitions. Running it again with the same rows changes nothing; of a repeated key the row greatest by
    ``order`` stays. A crash between the days leaves some of them replaced and the staged folder behind: the same call
    again mends the table, and the folder may be deleted. One writer at a time. merge: a table format's own MERGE,
    used in its place.
    """
    spark = df.sparkSession
    if merge:
        merge(df, path, keys)
        return
    dated = one_per_key(df, keys, order).withColumn("slot_day", F.to_date(ts)).persist()
    try:
        if exists(spark, path):
            old = spark.read.parquet(path)
            touched = old.join(F.broadcast(dated.select("slot_day").distinct()), "slot_day", "left_semi")
            new = anti(touched, dated.select(*keys)).unionByName(dated, allowMissingColumns=True)
        else:
            new = dated
        staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
        new.write.partitionBy("slot_day").parquet(staged)
        spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot_day").parquet(path)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    finally:
        dated.unpersist()


def slot_seconds(ts: str = "window_end") -> Column:
    """Seconds since 1970 of a time of day and year, whatever the session's zone: numbers have statistics in footers that times lack."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def create_if_absent(df: DataFrame, path: str) -> None:
    if not exists(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)


def write_training(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def rewrite_zstd(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """df with is_train as two tables, written in one pass as partitions."""
    df.write.mode("overwrite").partitionBy("is_train").parquet(path)


def encode_events(trips: DataFrame) -> DataFrame:
    """(key, value): three JSON messages per trip, keyed by trip_id, times in UTC ISO-8601. Nulls are left out."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(c)
    money = ["base_passenger_fare", "driver_pay", "tips", "tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee", "cbd_congestion_fee"]
    kinds = {
        "request": ("request_datetime", ["hvfhs_license_num", "PULocationID", "DOLocationID", "wav_request_flag", "access_a_ride_flag", "shared_request_flag"], []),
        "pickup": ("pickup_datetime", ["PULocationID", "shared_match_flag", "wav_match_flag"], ["on_scene_datetime"]),
        "dropoff": ("dropoff_datetime", ["DOLocationID", "trip_miles", "trip_time", *money], []),
    }
    messages = [
        F.to_json(F.struct(F.lit(kind).alias("event_type"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("event_time"), "trip_id", iso(ts), *[iso(c) for c in more], *[F.col(c) for c in columns if c in trips.columns]))
        for kind, (ts, columns, more) in kinds.items()
    ]
    return trips.select(F.col("trip_id").alias("key"), F.explode(F.array(*messages)).alias("value"))


def write_events(messages: DataFrame, target: str, options: Mapping[str, str] | None = None) -> None:
    """Messages to a Kafka topic (target "kafka:topic") or to text files.

    Files are compressed, as JSON of repeated names takes many times the disk of its source. A compressed file is read by one task, so each ends at a million lines.
    """
    if target.startswith("kafka:"):
        messages.write.format("kafka").options(topic=target.removeprefix("kafka:"), **dict(options or {})).save()
    else:
        messages.select("value").write.mode("append").options(**{"compression": "gzip", "maxRecordsPerFile": "1000000", **dict(options or {})}).text(target)


def write_zone_map(rows: DataFrame, path: str) -> None:
    rows.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def execute(spark: SparkSession, jdbc: Mapping[str, str], statements: Sequence[str]) -> None:
    """Statements in one transaction of a database, from the driver."""
    jvm = spark.sparkContext._jvm
    if "driver" in jdbc:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(jdbc["driver"])
    options = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in jdbc:
            options.setProperty(k, jdbc[k])
    connection = jvm.java.sql.DriverManager.getConnection(jdbc["url"], options)
    try:
        connection.setAutoCommit(False)
        for text in statements:
            statement = connection.createStatement()
            statement.execute(text)
            statement.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def upsert_jdbc(df: DataFrame, jdbc: Mapping[str, str], keys: Sequence[str] = KEYS, order: Sequence[str] = ()) -> None:
    """Keyed upsert of a database table (option dbtable) with a primary key: rows go to a staging table in parallel, then one MERGE takes them over.

    Repeating it changes nothing. A crash before the MERGE leaves the table as it was and a staging table behind.
    """
    table, staged = jdbc["dbtable"], f"staged_{uuid.uuid4().hex[:12]}"
    rows = one_per_key(df, keys, order)
    name = lambda c: f'"{c}"'
    execute(df.sparkSession, jdbc, [f"CREATE TABLE {staged} AS SELECT {', '.join(map(name, rows.columns))} FROM {table} WITH NO DATA"])
    rows.write.format("jdbc").mode("append").options(**{**jdbc, "dbtable": staged}).save()
    on, rest = " AND ".join(f"t.{name(k)} = s.{name(k)}" for k in keys), [c for c in rows.columns if c not in keys]
    merge = (f"MERGE INTO {table} t USING {staged} s ON {on} WHEN MATCHED THEN UPDATE SET {', '.join(f'{name(c)} = s.{name(c)}' for c in rest)} "
             f"WHEN NOT MATCHED THEN INSERT ({', '.join(map(name, rows.columns))}) VALUES ({', '.join(f's.{name(c)}' for c in rows.columns)})")
    execute(df.sparkSession, jdbc, [merge, f"DROP TABLE {staged}"])
