"""Hourly panes with revisions: two stages of keyed state, of which the first is salted.

Rows go to shards by a hash of their click, so a pane that holds a third of all rows is spread over all shards. A shard keeps, for each
open pane, the part that it has not forwarded yet. A batch ends with a punctuation for every shard; on it a shard forwards its parts, also
those that are zero, to the mergers, one for each pane. A merger adds them up and decides, on what the punctuation says of the
clock, whether the pane is published, revised or closed. Only parts, never rows, meet at a pane, at most one for each shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lectern.llm.common import delete, shared_folder, table

BATCHES = 8
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: After a pane's end: when it is published, and when it is closed.
DUE, CLOSED = 6 * HOUR, 4 * DAY
#: The clock before any row.
NEVER = -(1 << 62)
#: Shards for each partition of the state, so that a hash deals them evenly; rows of a batch for each partition, and least partitions.
SHARDS, ROWS, LEAST = 2, 250_000, 4

PART = "pane_hour long, pane_kind string, part long, hour long, kind string, batch long, clock long, last boolean, click_id long, n_rows long, cents long"
RECORD = "batch long, hour long, kind string, click_id long, n_rows long, cents long, record string"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # A query runs once, then another starts: stores of ended runs, each with megabytes of preallocated files, would only wait for maintenance.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def micros(name: str) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    since = F.expr(f"CAST(`{name}` AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    day, hour, minute, second = (F.date_part(F.lit(p), since) for p in ("DAY", "HOUR", "MINUTE", "SECOND"))
    return day * F.lit(DAY) + hour * F.lit(HOUR) + ((minute * 60 + second) * 1_000_000).cast("long")


def below(name: str, size: int) -> Column:
    """How many times ``size`` goes into a long, rounded down."""
    return F.expr(f"({name} - pmod({name}, {size})) div {size}")


def arrivals(clicks: DataFrame) -> DataFrame:
    """``batch, event, hour, kind, click_id, cents``: each click once, in its batch.

    Rows without ``ts`` are dropped; without ``arrived_at`` a click arrives when it happens. Of rows that share a click, the one that arrived first
    counts (then the smallest by its other values); all rows without an id are one click, whose id is shown as -1. A value that is null, not a
    number or beyond 64 bits counts 0 cents. Other columns are not read.
    """
    value = F.floor(100 * F.col("value") + 0.5)
    rows = clicks.where(F.col("ts").isNotNull()).select(
        "click_id", F.coalesce(micros("arrived_at"), micros("ts")).alias("arrived"), micros("ts").alias("ts"), F.coalesce("kind", F.lit("none")).alias("kind"),
        F.when(F.abs("value") < 9e16, value).otherwise(0).cast("long").alias("cents"),
    )
    once = rows.groupBy("click_id").agg(F.min(F.struct("arrived", "ts", "kind", "cents")).alias("x")).select("click_id", "x.*")
    day = below("arrived", DAY)
    turn = F.pmod(day, F.lit(BATCHES))
    delay = F.coalesce(F.greatest(F.lit(0), F.crc32(F.col("click_id").cast("string").cast("binary")) % 30 - 23), F.lit(0))
    event = F.col("ts") - (day - turn) * DAY
    placed = once.select(F.least(F.lit(BATCHES - 1), turn + delay).cast("int").alias("batch"), event.alias("event"), "kind", F.coalesce("click_id", F.lit(-1)).cast("long").alias("click_id"), "cents")
    return placed.select("batch", "event", below("event", HOUR).alias("hour"), "kind", "click_id", "cents")


class Shard(StatefulProcessor):
    """A shard's unforwarded part of every open pane that it has seen, in one state value."""

    def init(self, handle):
        self.open = handle.getValueState("open", "hour array<long>, kind array<string>, n_rows array<long>, cents array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hours, kinds, counts, cents = self.open.get() if self.open.exists() else ((), (), (), ())
        parts = {(h, k): [n, c] for h, k, n, c in zip(hours, kinds, counts, cents, strict=True)}
        tick = None
        for frame in rows:
            if frame["tick"].any():
                tick = frame[frame["tick"]].iloc[0]
            frame = frame[~frame["tick"]]
            late = frame[frame["late"]]
            if len(late):
                yield late.assign(pane_hour=0, pane_kind="", part=key[0], n_rows=1)[[c.split()[0] for c in PART.split(", ")]]
            sums = frame[~frame["late"]].groupby(["hour", "kind"], sort=False)["cents"].agg(["size", "sum"])
            for (h, k), n, c in zip(sums.index, sums["size"], sums["sum"], strict=True):
                part = parts.setdefault((int(h), k), [0, 0])
                part[0] += int(n)
                part[1] += int(c)
        if tick is not None:
            clock = int(tick["clock"])
            if parts:
                panes, sums = zip(*parts, strict=True), zip(*parts.values(), strict=True)
                parted = pd.DataFrame(dict(zip(("hour", "kind", "n_rows", "cents"), (*panes, *sums), strict=True)))
                yield parted.assign(
                    pane_hour=parted["hour"], pane_kind=parted["kind"], part=-1, batch=int(tick["batch"]), clock=clock, last=bool(tick["last"]), click_id=-1
                )[[c.split()[0] for c in PART.split(", ")]]
            parts = {p: [0, 0] for p in parts if clock < (p[0] + 1) * HOUR + CLOSED}
        self.open.update(([p[0] for p in parts], [p[1] for p in parts], [s[0] for s in parts.values()], [s[1] for s in parts.values()]))

    def close(self):
        pass


class Merger(StatefulProcessor):
    """Totals of one pane and whether they were published. Late rows, keyed by their shard alone, pass."""

    def init(self, handle):
        self.pane = handle.getValueState("pane", "n_rows long, cents long, published boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hour, kind, part = key
        columns = [c.split()[0] for c in RECORD.split(", ")]
        if part >= 0:
            for frame in rows:
                yield frame.assign(record="late")[columns]
            return
        more = cents = 0
        for frame in rows:
            more, cents = more + int(frame["n_rows"].sum()), cents + int(frame["cents"].sum())
            batch, clock, last = int(frame["batch"].iloc[0]), int(frame["clock"].iloc[0]), bool(frame["last"].iloc[0])
        old_n, old_cents, published = self.pane.get() if self.pane.exists() else (0, 0, False)
        old, new = (old_n, old_cents), (old_n + more, old_cents + cents)
        end = (int(hour) + 1) * HOUR
        if published:
            out = [("retract", old), ("replace", new)] if more else []
        else:
            out = [("emit", new)] if clock >= end + DUE else [("final", new)] if last else []
        if clock >= end + CLOSED:
            self.pane.clear()
        elif more or (out and not published):
            self.pane.update((*new, published or bool(out)))
        if out:
            yield pd.DataFrame([(batch, int(hour), kind, -1, *total, record) for record, total in out], columns=columns)

    def close(self):
        pass


def panes(rows: DataFrame, batches: int = BATCHES, files_per_trigger: int | None = None) -> DataFrame:
    """Feed ``rows`` (as of :func:`arrivals`) batch by batch to the stateful query, started anew for each on one checkpoint, and read what it wrote.

    Everything is written in a new folder under the shared one. The query's sink is a folder of Parquet files with a log of what was committed,
    so a batch that fails and runs again leaves each record once. The clock of a batch is one number for each batch before it; that is all
    that reaches the driver. A batch without rows has its punctuation only. An empty table gives no records.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/panes-{uuid.uuid4().hex}"
    rows.write.partitionBy("batch").parquet(f"{folder}/batches")
    kept = spark.read.schema(rows.schema).parquet(f"{folder}/batches")
    sizes = kept.groupBy("batch").agg(F.max("event").alias("most"), F.count(F.lit(1)).alias("n")).collect()
    most = {r.batch: r.most for r in sizes}
    # A store costs a task's start and megabytes whatever it holds, so their number follows the rows of the largest batch, not the session's shuffles.
    parts = max([LEAST, *(-(-r.n // ROWS) for r in sizes)])
    shards = SHARDS * parts
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        clock = NEVER
        for batch in range(batches):
            said = [F.lit(batch).cast("long").alias("batch"), F.lit(clock).cast("long").alias("clock"), F.lit(batch == batches - 1).alias("last")]
            late = F.lit(clock) >= (F.col("hour") + 1) * HOUR + CLOSED
            fed = kept.where(F.col("batch") == batch).select(
                F.pmod(F.xxhash64("click_id", "event"), F.lit(shards)).alias("shard"), F.lit(False).alias("tick"), *said, "hour", "kind", "click_id", "cents", late.alias("late")
            )
            fed.write.mode("append").parquet(f"{folder}/feed")
            nothing = [F.lit(0).cast("long").alias("hour"), F.lit("").alias("kind"), F.lit(-1).cast("long").alias("click_id"), F.lit(0).cast("long").alias("cents"), F.lit(False).alias("late")]
            # All punctuations in one file, after the rows': they come to the query together.
            spark.range(shards, numPartitions=1).select(F.col("id").alias("shard"), F.lit(True).alias("tick"), *said, *nothing).write.mode("append").parquet(f"{folder}/feed")
            stream = spark.readStream.schema(fed.schema)
            if files_per_trigger:
                stream = stream.option("maxFilesPerTrigger", files_per_trigger)
            partial = stream.parquet(f"{folder}/feed").groupBy("shard").transformWithStateInPandas(Shard(), PART, "append", "none")
            records = partial.groupBy("pane_hour", "pane_kind", "part").transformWithStateInPandas(Merger(), RECORD, "append", "none")
            query = records.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
            query.awaitTermination()
            clock = max(clock, most.get(batch, NEVER))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for done in ("batches", "feed", "checkpoint"):
        delete(spark, f"{folder}/{done}")
    return spark.read.schema(RECORD).parquet(f"{folder}/out")


def op13_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes(arrivals(table(spark, sf_dir, "clicks")))


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8
), once AS (
  SELECT click_id, min({'arrived': epoch_us(coalesce(arrived_at, ts)), 'ts': epoch_us(ts), 'kind': coalesce(kind, 'none'),
    'cents': CASE WHEN abs(value) < 9e16 THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END}) AS x
  FROM clicks WHERE ts IS NOT NULL GROUP BY click_id
), placed AS (
  SELECT click_id, x.ts AS ts, x.kind AS kind, x.cents AS cents, floor(x.arrived / 86400000000.0)::BIGINT AS d,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(click_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM once, crc
), turns AS (
  SELECT *, ((d % 8) + 8) % 8 AS q FROM placed
), rows AS (
  SELECT least(7, q + greatest(0, coalesce(h % 30 - 23, 0))) AS batch, ts - (d - q) * 86400000000 AS event, kind, coalesce(click_id, -1) AS click_id, cents FROM turns
), hours AS (
  SELECT *, CAST(floor(event / 3600000000.0) AS BIGINT) AS hour FROM rows
), clock AS (
  SELECT b AS batch, (SELECT max(event) FROM rows WHERE rows.batch < b) AS w FROM range(8) t(b)
), marked AS (
  SELECT hours.*, coalesce(w >= (hour + 1) * 3600000000 + 345600000000, false) AS late FROM hours JOIN clock USING (batch)
), deltas AS (
  SELECT hour, kind, batch, count(*) AS n, sum(cents) AS c FROM marked WHERE NOT late GROUP BY ALL
), totals AS (
  SELECT *, sum(n) OVER w AS n_all, sum(c) OVER w AS c_all, min(batch) OVER (PARTITION BY hour, kind) AS since FROM deltas
  WINDOW w AS (PARTITION BY hour, kind ORDER BY batch)
), published AS (
  SELECT hour, kind, (SELECT min(clock.batch) FROM clock WHERE clock.batch >= since AND w >= (hour + 1) * 3600000000 + 21600000000) AS shown
  FROM (SELECT DISTINCT hour, kind, since FROM totals)
), records AS (
  SELECT batch, hour, kind, click_id, 1 AS n_rows, cents, 'late' AS record FROM marked WHERE late
  UNION ALL
  SELECT coalesce(shown, 7), hour, kind, -1, sum(n), sum(c), CASE WHEN shown IS NULL THEN 'final' ELSE 'emit' END FROM totals JOIN published USING (hour, kind) WHERE batch <= coalesce(shown, 7) GROUP BY shown, hour, kind
  UNION ALL
  SELECT batch, hour, kind, -1, n_all - n, c_all - c, 'retract' FROM totals JOIN published USING (hour, kind) WHERE batch > shown
  UNION ALL
  SELECT batch, hour, kind, -1, n_all, c_all, 'replace' FROM totals JOIN published USING (hour, kind) WHERE batch > shown
)
SELECT CAST(batch AS BIGINT) AS batch, CAST(hour AS BIGINT) AS hour, kind, CAST(click_id AS BIGINT) AS click_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(cents AS BIGINT) AS cents, record FROM records
"""
