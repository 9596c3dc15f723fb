"""Progress of streaming queries as rows."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.clean import metric_name, progress_epoch

SCHEMA = "name string, id string, runId string, batchId long, timestamp string, numInputRows long, inputRowsPerSecond double, processedRowsPerSecond double, durationMs map<string,long>, stateOperators array<struct<numRowsTotal:long>>"


class ProgressListener(StreamingQueryListener):
    """Appends each progress report to a table, and keeps which queries are active."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.active, self.ended = spark, path, set(), set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.active.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress_rows(self.spark, [event.progress.json]).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.active.discard(str(event.runId))
        self.ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all reports of an ended query are written: its end is told after them."""
        end = time.monotonic() + seconds
        while str(query.runId) not in self.ended:
            if time.monotonic() > end:
                raise TimeoutError("the listener wasn't told of the query's end")
            time.sleep(0.05)


@contextmanager
def listening(spark: SparkSession, path: str) -> Iterator[ProgressListener]:
    """A listener to all queries that run meanwhile."""
    listener = ProgressListener(spark, path)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def progress_rows(spark: SparkSession, reports: list[str | dict]) -> DataFrame:
    texts = [(r if isinstance(r, str) else json.dumps(r),) for r in reports]
    return spark.createDataFrame(texts, "j string").select(F.from_json("j", SCHEMA).alias("p")).select("p.*")


def summary(progress: DataFrame) -> DataFrame:
    """Per report: rows, rates, trigger time, epoch seconds and state rows."""
    state = F.aggregate(F.coalesce("stateOperators", F.array()), F.lit(0).cast("long"), lambda t, s: t + F.coalesce(s["numRowsTotal"], F.lit(0)))
    return progress.select("name", "id", "runId", "batchId", F.coalesce("numInputRows", F.lit(0)).alias("input_rows"), F.coalesce("inputRowsPerSecond", F.lit(0.0)).alias("input_rate"), F.coalesce("processedRowsPerSecond", F.lit(0.0)).alias("processed_rate"),
                           F.coalesce(F.try_element_at("durationMs", F.lit("triggerExecution")), F.lit(0)).alias("trigger_ms"), progress_epoch("timestamp").alias("epoch_s"), state.alias("state_rows"))


def operation_ms(progress: DataFrame) -> DataFrame:
    rows = progress.select("name", "batchId", F.explode("durationMs").alias("operation", "ms"))
    return rows.withColumn("operation", metric_name("operation"))
