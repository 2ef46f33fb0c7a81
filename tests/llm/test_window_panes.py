"""Panes with revisions against a simulation row by row."""

import datetime as dt
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import window_panes as wp

EPOCH = dt.datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch string, hour string, x string"


def us(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def placed(clicks):
    """(batch, event, hour, kind, click_id, cents) of each click."""
    first = {}
    for r in clicks:
        if r[1] is not None:
            value = r[5]
            cents = math.floor(100 * value + 0.5) if value is not None and abs(value) < 9e16 else 0
            row = (us(r[2] or r[1]), us(r[1]), r[4] if r[4] is not None else "none", cents)
            first[r[0]] = min(first.get(r[0], row), row)
    for c, (arrived, ts, kind, cents) in first.items():
        day = arrived // wp.DAY
        event = ts - (day - day % 8) * wp.DAY
        delay = max(0, zlib.crc32(str(c).encode()) % 30 - 23) if c is not None else 0
        yield min(7, day % 8 + delay), event, event // wp.HOUR, kind, -1 if c is None else c, cents


def simulated(clicks):
    rows, out, panes = list(placed(clicks)), [], {}
    for b in range(8):
        clock = max((r[1] for r in rows if r[0] < b), default=-math.inf)
        end = lambda pane: (pane[0] + 1) * wp.HOUR
        before = {p: (n, c) for p, (n, c, _) in panes.items()}
        fresh = set()
        for _, _, hour, kind, click, cents in (r for r in rows if r[0] == b):
            pane = hour, kind
            if clock >= end(pane) + 4 * wp.DAY:
                out.append((b, hour, kind, click, 1, cents, "late"))
            else:
                n, c, shown = panes.get(pane, (0, 0, False))
                panes[pane] = n + 1, c + cents, shown
                fresh.add(pane)
        for pane, (n, c, shown) in list(panes.items()):
            if shown and pane in fresh:
                out += [(b, *pane, -1, *before[pane], "retract"), (b, *pane, -1, n, c, "replace")]
            if not shown and clock >= end(pane) + 6 * wp.HOUR:
                out.append((b, *pane, -1, n, c, "emit"))
                panes[pane] = n, c, True
            if clock >= end(pane) + 4 * wp.DAY:
                del panes[pane]
    return sorted(out + [(7, *pane, -1, n, c, "final") for pane, (n, c, shown) in panes.items() if not shown])


def clicks(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        # The third to the sixth day have no arrivals of their own, so a batch can be empty.
        arrived = dt.datetime(2024, 1, 1 + rng.choice([0, 1, 1, 2, 6, 7, 8, 9]), rng.randrange(24), rng.randrange(60), rng.randrange(60), rng.randrange(10**6))
        late = dt.timedelta(hours=rng.choice([0, 0, 0, 1, 9, 100, 200]), seconds=rng.randrange(4000))
        value = rng.choice([None, float("nan"), float("inf"), 1e300, -0.005, 0.125, 12.345, 218620.59, rng.uniform(-300, 300)])
        out.append((k, arrived - late, arrived, None, rng.choice([None, "none", "click", "click", "view", ""]), value, None, "b", "h", "x"))
    out += rng.sample(out, 60)
    out += [(k, None, out[k][2], 1, "click", 1.0, "{}", None, None, None) for k in range(5)]
    out += [(9000, dt.datetime(2024, 1, 2, 3), None, 1, "view", 2.0, "{}", None, None, None), (None, dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 2, 4), 1, "view", 2.0, None, None, None, None)]
    out += [(9001, dt.datetime(1969, 12, 31, 22, 59, 59, 999999), dt.datetime(1970, 1, 1, 0, 0, 1), 1, "old", 1.0, None, None, None, None)]
    out += [(9002, dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 3, 6), 1, "view", 1.0, None, None, None, None), (9002, dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 2, 6), 1, "view", 3.0, None, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    return clicks()


def test_arrivals(spark, rows):
    df = wp.arrivals(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, df.collect())) == sorted(placed(rows))
    assert {r[0] for r in placed(rows)} == set(range(8)) or len({r[0] for r in placed(rows)}) > 5


def test_arrivals_do_not_depend_on_the_session_zone(spark, rows):
    df = wp.arrivals(spark.createDataFrame(rows, SCHEMA))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sorted(map(tuple, wp.arrivals(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(placed(rows))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert df.count()


def test_equals_the_simulation(spark, rows):
    """With two files a trigger, shards hold what they have not forwarded over several triggers of a batch."""
    expected = simulated(rows)
    assert {r[-1] for r in expected} == {"late", "emit", "retract", "replace", "final"}
    df = wp.arrivals(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, wp.panes(df.repartition(3), files_per_trigger=2).collect())) == expected


def test_rows_of_a_hot_pane_are_spread(spark):
    """However many rows one pane has, a shard holds a part of them, and the merger meets one part a shard."""
    rows = spark.range(20_000).select(F.lit(0).alias("batch"), F.col("id").alias("event"), F.lit(0).cast("long").alias("hour"), F.lit("k").alias("kind"), F.col("id").alias("click_id"), F.lit(1).cast("long").alias("cents"))
    shards = wp.SHARDS * wp.LEAST
    sizes = [r["count"] for r in rows.groupBy(F.pmod(F.xxhash64("click_id", "event"), F.lit(shards))).count().collect()]
    assert len(sizes) == shards and max(sizes) < 1.2 * 20_000 / shards
    assert [tuple(r) for r in wp.panes(rows, batches=1).collect()] == [(0, 0, "k", -1, 20_000, 20_000, "final")]


def test_empty_table(spark, rows):
    df = wp.arrivals(spark.createDataFrame([], SCHEMA))
    names = [*wp.SETTINGS, "spark.sql.shuffle.partitions"]
    before = {k: spark.conf.get(k, None) for k in names}
    assert wp.panes(df, batches=1).collect() == []
    assert {k: spark.conf.get(k, None) for k in names} == before
