"""What a scan does with each file as keyed state: by content hash the last status, retries when they are due, and forgetting.

A stream has two kinds of rows: files as they are found, and outcomes as they are reached. For each hash the state holds the last status, the attempts and the last place of the
file. A timer sends a file of a retry state out again once its pause is over, without it being found again. A state that no row touches for its time to live is forgotten, so
the store holds the hashes of that span and not all there ever were; a forgotten file is new when it comes again, and is settled by the stored papers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lectern.model import RETRIED

#: Rows of the stream: ``status`` is null for a file found, ``filepath`` for an outcome.
FEED = "file_hash string, filepath string, status string"
ROUTE = "file_hash string, filepath string, route string, attempt int"
STATE = "status string, attempt int, filepath string"
#: Between its route and its outcome a file is under way.
UNDER_WAY = "under way"
DAY = 86_400_000
#: Hashes of a state partition, at most, if their number is known when a checkpoint begins.
KEYS = 10_000
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # With timers a query would otherwise run batches without data for ever; what is due goes out with the next rows.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Routes(StatefulProcessor):
    """State of one hash. Times are milliseconds of processing time."""

    def __init__(self, pause: int, live: int):
        self.pause, self.live = pause, live

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", STATE, self.live)

    def keep(self, timed: bool, status: str, attempt: int, path: str | None, now: int) -> None:
        self.last.update((status, attempt, path))
        # Each look at the store is a message to the JVM, so timers are listed only where there may be one.
        for timer in list(self.handle.listTimers()) if timed else []:
            self.handle.deleteTimer(timer)
        if status in RETRIED and path is not None and self.pause:
            self.handle.registerTimer(now + self.pause)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        outcomes, found = [], []
        for row in rows:
            if row.status is None:
                found.append(row.filepath)
            else:
                outcomes.append(row.status)
        status, attempt, path = self.last.get() or (None, 0, None)
        timed = status in RETRIED and path is not None
        if outcomes:
            # Several outcomes in one batch have no order but their names': the retry states come first, so a success holds.
            status, attempt = max(outcomes, key=lambda s: (s not in RETRIED, s)), attempt + len(outcomes)
        found.sort()
        routes = []
        for k, place in enumerate(found):
            route = "Skipped" if k else "Insert" if status is None else "Retry" if status in RETRIED else "Skipped"
            if route != "Skipped":
                status, path = UNDER_WAY, place
            routes.append(Row(file_hash=key[0], filepath=place, route=route, attempt=attempt + 1 if route != "Skipped" else attempt))
        self.keep(timed, status, attempt, path if path is not None else (found[0] if found else None), timerValues.getCurrentProcessingTimeInMs() if self.pause else 0)
        yield from routes

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempt, path = self.last.get() or (None, 0, None)
        if status in RETRIED and path is not None:
            self.last.update((UNDER_WAY, attempt, path))
            yield Row(file_hash=key[0], filepath=path, route="Retry", attempt=attempt + 1)

    def close(self):
        pass


def routes(feed: DataFrame, pause: int = DAY, live: int = 30 * DAY) -> DataFrame:
    """Routes of a stream of :data:`FEED` rows: ``file_hash, filepath, route, attempt``. ``pause`` 0 sends nothing out by itself."""
    return feed.groupBy("file_hash").transformWithState(Routes(pause, live), ROUTE, "append", "processingTime")


def partitions_for(rows: int) -> int:
    """State partitions for so many hashes: Python asks the store a few times for each, so a partition holds a bounded number."""
    return max(4, -(-rows // KEYS))


def run(spark: SparkSession, folder: str, rows: DataFrame, pause: int = DAY, live: int = 30 * DAY, partitions: int = 4) -> None:
    """Append ``rows`` to the feed in ``folder`` and start the query on its checkpoint until all is read; its routes are in ``folder/out``, each once."""
    rows.select("file_hash", "filepath", "status").write.mode("append").parquet(f"{folder}/feed")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = routes(spark.readStream.schema(FEED).parquet(f"{folder}/feed"), pause, live)
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def outcomes(papers: DataFrame) -> DataFrame:
    """Stored papers ``(file_hash, classification_status)`` as rows of the feed."""
    return papers.select("file_hash", F.lit(None).cast("string").alias("filepath"), F.col("classification_status").alias("status"))


def files(found: DataFrame) -> DataFrame:
    return found.select("file_hash", "filepath", F.lit(None).cast("string").alias("status"))
