"""Helpers shared by the training-data operators: lineage cuts, table access and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch handed to a Python worker; a single longer text is a batch of its own.
ARROW_BYTES = 8 << 20

#: A key is heavy if it has over 1 / HEAVY of the rows of all keys with more than FEW: so fewer than HEAVY keys are, whatever the data.
HEAVY, FEW = 1 << 12, 1 << 8

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of Python workers at ``ARROW_BYTES``: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage as :func:`cut` does, and later reads take only the columns they need."""
    path = path or f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark can reach."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(*frames: DataFrame | None) -> None:
    """Delete what :func:`cut` or :func:`stored` wrote for ``frames``, of which nothing that is still to run may depend."""
    for df in frames:
        if df is None:
            continue
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in (leaves.apply(k) for k in range(leaves.size())):
            if leaf.nodeName() == "LogicalRDD":
                file = leaf.rdd().getCheckpointFile()
                if file.isDefined():
                    delete(df.sparkSession, file.get())
            elif leaf.nodeName() == "LogicalRelation":
                path = leaf.relation().location().rootPaths().head().toString()
                if path.rsplit("/", 1)[-1].startswith("table-"):
                    delete(df.sparkSession, path)


def packed(df: DataFrame, *columns: str) -> Column:
    """All of a frame's columns, or those named, as one struct ``d``, so that none can clash with columns that a plan adds; ``d.*`` unpacks them."""
    return F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]).alias("d")


def row_key(*columns: str) -> Column:
    """128 bits that name a row by its content, alike in a retried task: two hashes of the values and of which of them are null."""
    parts = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[p.isNull().cast("string") for p in parts])
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), nulls, *parts)), 16, "0") for seed in (1, 2)])


def even(rows: DataFrame, groups: DataFrame, on: str, counts: DataFrame) -> DataFrame:
    """Inner equi-join on ``on``, null meeting null, in which no task has to take all rows of a heavy key; ``on`` comes first.

    ``groups`` has one row a key and ``counts``, a table, the number ``n`` of ``rows`` of each. The fewer than ``HEAVY`` heavy keys go to every task
    with the number of their parts; their ``rows`` are dealt to parts by a hash of their content, alike in a retried task, and
    their row of ``groups`` is copied to each part. There are fewer than 2 * ``HEAVY`` parts in all, so the copies are bounded too.
    """
    others = [c for c in groups.columns if c != on]
    right = groups.withColumnRenamed(on, "of")
    many = counts.where(F.col("n") > FEW).select(F.col(on).alias("heavy"), "n")
    total = many.agg(F.sum("n")).first()[0]
    if total is None:
        return rows.join(right, F.col(on).eqNullSafe(F.col("of"))).select(on, *[c for c in rows.columns if c != on], *others)
    parts = F.ceil(F.least(F.col("n") * HEAVY / total, F.col("n") / FEW)).cast("int")
    heavy = cut(many.where(F.col("n") * HEAVY > total).select("heavy", parts.alias("parts")))
    spot = F.pmod(F.xxhash64(*rows.columns), F.coalesce("parts", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(heavy), F.col(on).eqNullSafe(F.col("heavy")), "left").select(*rows.columns, spot.alias("part"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part_of")
    right = right.join(F.broadcast(heavy), F.col("of").eqNullSafe(F.col("heavy")), "left").select("of", *others, copies)
    joined = left.join(right, F.col(on).eqNullSafe(F.col("of")) & (F.col("part") == F.col("part_of")))
    return joined.select(on, *[c for c in rows.columns if c != on], *others)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list ``(a, b)``: distributed union-find.

    Every vertex hooks onto the smallest label among its neighbours, then labels are shortened by
    pointer jumping, until nothing changes. Labels only ever travel between rows of DataFrames;
    nothing but one change count per round reaches the driver. Both sides of the joins that a hub vertex or the
    label of a large component makes uneven are tables, so that each is shuffled for the join and adaptive execution can split it.

    Returns ``(id, label)`` with ``label`` the smallest vertex of the component; vertices without an
    edge are not listed.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = cut(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b"))
    if both.isEmpty():
        return both.select(F.col("a").alias("id"), F.col("b").alias("label"))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("m"))
        )
        hooked = cut(labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label")))
        up = hooked.select(F.col("id").alias("label"), F.col("label").alias("top"))
        # A label is always a vertex of the same component, so the inner join keeps every row.
        step = cut(hooked.join(up, "label").select("id", "was", F.least("label", "top").alias("label")))
        release(labels, hooked)
        labels = step
        if step.where("was <> label").isEmpty():
            release(both)
            return step.select("id", "label")
