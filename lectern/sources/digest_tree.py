"""Digests of a table as a tree: rows summed into buckets by a hash of their key, buckets into a root. Two versions are compared by going down only where sums differ.

A row's digest is its SHA-256 over the values of all columns in the order of their names; a bucket holds the number of its rows and the sums of four 60-bit parts
of theirs, which do not depend on any order. The table is stored by bucket, so a comparison reads the leaves of both versions, some thousands of
rows, and then the rows of the buckets that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets, by default and at most: the numbers of those that differ go through the driver.
BUCKETS, MOST = 64, 4096
PARTS = 4
BUCKET = "digest_bucket"


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.conv(F.substring(F.sha2(text_of(key), 256), 1, 8), 16, 10).cast("long") % buckets


def text_of(columns: list[str]) -> Column:
    """The values of some columns as JSON text, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def row_digest(columns: list[str]) -> Column:
    return F.sha2(text_of(sorted(columns)), 256)


def leaves(df: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``digest_bucket, n, p0 to p3`` of each bucket that has rows."""
    columns = [c for c in df.columns if c != BUCKET]
    rows = df.select((F.col(BUCKET) if BUCKET in df.columns else bucket_of(key, buckets)).cast("int").alias(BUCKET), row_digest(columns).alias("digest"))
    return summed(rows.select(BUCKET, F.lit(1).cast("long").alias("n"), *[F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(PARTS)]), BUCKET)


def summed(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(PARTS)])


def root(tree: DataFrame) -> list[str]:
    """The sums of a whole table."""
    return [str(x) for x in summed(tree).first()]


class Tree:
    """A table and its leaves in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> Tree:
        if not 0 < buckets <= MOST:
            raise ValueError(f"from 1 to {MOST} buckets")
        df.withColumn(BUCKET, bucket_of(key, buckets).cast("int")).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/rows")
        out = cls(df.sparkSession, path)
        leaves(out.rows(), key, buckets).coalesce(1).write.parquet(f"{path}/leaves")
        return out

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/leaves")

    def differing(self, other: Tree) -> list[int]:
        """Buckets whose sums differ; none if the roots agree."""
        if root(self.leaves()) == root(other.leaves()):
            return []
        named = lambda t: t.leaves().select(BUCKET, F.struct("n", *[f"p{k}" for k in range(PARTS)]).alias("sums"))
        both = named(self).join(named(other).withColumnRenamed("sums", "others"), BUCKET, "full")
        return sorted(r[0] for r in both.where(~F.col("sums").eqNullSafe(F.col("others"))).select(BUCKET).collect())

    def changes(self, other: Tree, key: list[str]) -> DataFrame:
        """``key`` and ``change`` (added, removed or changed) of the rows in which ``other`` differs from this version. Keys are unique in each."""
        of = self.differing(other)
        side = lambda t, name: t.rows().where(F.col(BUCKET).isin(of)).select(*key, row_digest([c for c in t.rows().columns if c != BUCKET]).alias(name))
        both = side(self, "old").join(side(other, "new"), key, "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
        return both.select(*key, change.alias("change")).where("change IS NOT NULL")
