"""Routes of a scan as keyed state: restarts, retries by timer, forgetting."""

import time

import pytest

from lectern.sources.scratch import new_folder
from lectern.streaming import retries


def rows(spark, *values):
    return spark.createDataFrame(list(values), retries.FEED)


def out(spark, folder):
    return sorted(tuple(r) for r in spark.read.schema(retries.ROUTE).parquet(f"{folder}/out").collect())


@pytest.mark.parametrize("live", [10_000_000])
def test_states_survive_a_restart(spark, live):
    folder = new_folder(spark, "routes")
    retries.run(spark, folder, rows(spark, ("h1", None, "classified"), ("h2", None, "failed"), ("h3", "/c", None), ("h3", "/b", None)), pause=0, live=live)
    assert out(spark, folder) == [("h3", "/b", "Insert", 1), ("h3", "/c", "Skipped", 0)]
    retries.run(spark, folder, rows(spark, ("h1", "/1", None), ("h2", "/2", None), ("h3", "/b", None), ("h4", "/4", None)), pause=0, live=live)
    assert out(spark, folder)[:2] == [("h1", "/1", "Skipped", 1), ("h2", "/2", "Retry", 2)]
    assert ("h3", "/b", "Skipped", 0) in out(spark, folder) and ("h4", "/4", "Insert", 1) in out(spark, folder)


def test_a_due_retry_is_sent_out_and_a_forgotten_state_is_gone(spark):
    folder = new_folder(spark, "routes")
    retries.run(spark, folder, rows(spark, ("h1", "/1", None), ("h2", "/2", None)), pause=1, live=10_000_000)
    retries.run(spark, folder, rows(spark, ("h1", None, "failed"), ("h2", None, "classified")), pause=1, live=10_000_000)
    # Any row starts a batch; the timer of h1 is due in it.
    retries.run(spark, folder, rows(spark, ("h9", "/9", None)), pause=1, live=1)
    assert ("h1", "/1", "Retry", 2) in out(spark, folder) and not [r for r in out(spark, folder) if r[0] == "h2" and r[2] == "Retry"]
    time.sleep(0.1)
    retries.run(spark, folder, rows(spark, ("h9", "/9", None)), pause=1, live=1)
    assert out(spark, folder).count(("h9", "/9", "Insert", 1)) == 2
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/checkpoint")
    assert state.count() <= 3


def test_state_partitions_follow_the_hashes():
    """A partition holds a bounded number of hashes; there were four, whatever the number."""
    assert retries.partitions_for(100) == 4
    assert retries.partitions_for(1_500_000) == 150
