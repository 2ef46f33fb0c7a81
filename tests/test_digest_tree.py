"""A changed row is found by reading the buckets whose sums differ, and no others."""

import tempfile

from pyspark.sql import functions as F

from lectern.sources.digest_tree import Tree, root


def folder():
    return tempfile.mkdtemp(prefix="lectern-tree-") + "/t"


def test_one_changed_row_is_one_bucket(spark):
    rows = spark.range(3000).select("id", (F.col("id") * 7).alias("v"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("s"))
    old = Tree.write(rows, folder(), ["id"], 32)
    same = Tree.write(rows.repartition(7).orderBy(F.desc("v")).select("s", "v", "id"), folder(), ["id"], 32)
    assert root(old.leaves()) == root(same.leaves()) and old.differing(same) == [] and old.changes(same, ["id"]).collect() == []
    new = Tree.write(rows.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v"))), folder(), ["id"], 32)
    changes = old.changes(new, ["id"])
    assert len(old.differing(new)) == 1 and [tuple(r) for r in changes.collect()] == [(77, "changed")]
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(digest_bucket") + plan.count("PartitionFilters: [(digest_bucket") + plan.count("PartitionFilters: [digest_bucket IN") >= 1
    files = [len({r[0] for r in t.rows().where(F.col("digest_bucket").isin(old.differing(new))).select(F.input_file_name()).collect()}) for t in (old, new)]
    assert files == [1, 1]


def test_added_and_removed_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string")
    other = spark.createDataFrame([(1, "a"), (2, ""), (4, "c")], "id long, v string")
    found = Tree.write(rows, folder(), ["id"]).changes(Tree.write(other, folder(), ["id"]), ["id"])
    assert sorted(tuple(r) for r in found.collect()) == [(2, "changed"), (3, "removed"), (4, "added")]
