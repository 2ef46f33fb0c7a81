"""Several writers of one library: what does not meet is rebased, what clashes is refused; unchanged tables are not rewritten."""

import tempfile

import pytest

from lectern.sources.store import Store


@pytest.fixture
def store(spark):
    s = Store(spark, tempfile.mkdtemp(prefix="lectern-store-"))
    s.commit({"papers": spark.range(3), "notes": spark.range(2), "folders": spark.range(1)}, None)
    return s


def test_disjoint_writers(spark, store):
    base = store.version()
    first = store.commit({"notes": spark.range(5)}, base, reads=["notes"])
    other = Store(spark, store.path)
    second = other.commit({"folders": spark.range(7)}, base, reads=["papers"])
    assert store.version() == second and [store.read(t).count() for t in ("papers", "notes", "folders")] == [3, 5, 7]
    assert [store.read(t, first).count() for t in ("papers", "notes", "folders")] == [3, 5, 1] and store.read("notes", base).count() == 2


@pytest.mark.parametrize("write,reads", [("notes", ["notes"]), ("folders", ["notes"]), ("folders", None)])
def test_clashing_writers(spark, store, write, reads):
    base = store.version()
    now = store.commit({"notes": spark.range(5)}, base, reads=[])
    with pytest.raises(ValueError, match="changed since"):
        store.commit({write: spark.range(9)}, base, reads=reads)
    assert store.version() == now


def test_a_writer_that_is_overtaken_tries_again(spark, store):
    """Another commit lands between the check of the new version and its pointer."""
    base, checks = store.version(), []

    def check(s, version):
        checks.append(s.read("notes", version).count())
        if len(checks) == 1:
            Store(spark, store.path).commit({"notes": spark.range(5)}, base, reads=[])

    store.commit({"folders": spark.range(7)}, base, check, reads=[])
    assert checks == [2, 5] and store.read("notes").count() == 5 and store.read("folders").count() == 7


def test_unchanged_tables_are_not_rewritten(spark, store):
    base = store.of(None)
    store.commit({"notes": spark.range(5)}, base["version"])
    now = store.of(None)
    assert {t for t in now["tables"] if now["tables"][t] != base["tables"][t]} == {"notes"} and now["follows"] == base["version"]


def test_backup_is_verified(spark, store):
    base = store.version()
    store.commit({"notes": spark.range(5)}, base)
    store.verify(base)
    store.verify()
    spark.range(4).write.mode("overwrite").parquet(f"{store.path}/{store.of(base)['tables']['papers']}")
    with pytest.raises(ValueError, match="papers"):
        store.verify(base)


def test_failed_check_changes_nothing(spark, store):
    base = store.version()

    def check(s, version):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.commit({"notes": spark.range(5)}, base, check)
    assert store.version() == base and store.read("notes").count() == 2
