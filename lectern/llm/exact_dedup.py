"""Exact deduplication against a persistent digest index (native DataFrame operations only)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import SPACES, cut, delete, even, release, shared_folder, table


def digest(text: str = "text"):
    """SHA-256 (lowercase hex) of the text with each run of white space replaced by one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " "), 256)


class DigestIndex:
    """Table of known digests, bucketed and sorted by digest, kept between runs.

    ``path`` holds the Parquet files, in a folder that all executors share. When it exists already (a new session, a restarted driver) it
    is registered again under ``name`` with the same bucketing. A row says that batch ``batch`` brought ``copies`` rows of a digest whose
    ``keep_id`` was settled by the first batch that had it. New digests are found by a sort-merge anti-join, for which only the new
    side is shuffled (to the index's own buckets), and are appended one file per bucket.
    """

    SCHEMA = "digest STRING, keep_id BIGINT, copies BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 48):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({self.SCHEMA}) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def before(self, batch: str) -> DataFrame:
        """The rows of all other batches."""
        return self.read().where(F.col("batch") != batch)

    def append(self, groups: DataFrame, known: DataFrame, batch: str) -> None:
        """Add a batch's groups ``(digest, keep_id, copies)``: those whose digest the index lacks, and the copies of digests ``known``.

        What the batch has in the index already, from a run that was repeated, is not added again.
        """
        new = groups.join(self.before(batch).select("digest").hint("merge"), "digest", "left_anti").select("digest", "keep_id", "copies")
        more = groups.select("digest", "copies").join(known.select("digest", "keep_id"), "digest").select("digest", "keep_id", "copies")
        mine = self.read().where(F.col("batch") == batch).select("digest")
        rows = new.unionByName(more).join(mine.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def content_name(groups: DataFrame) -> str:
    """A name that a batch's content gives, alike on every run: sums of hashes, in any order."""
    hashes = [F.sum(F.xxhash64(F.lit(seed), "digest", F.coalesce("keep_id", F.lit(-1)), "copies").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    x = groups.agg(F.count(F.lit(1)).alias("n"), *hashes).first()
    return f"{x.n}-{x.h1}-{x.h2}"


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Deduplicate a batch against ``index`` and append what is new.

    Texts are equal when they are identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one
    space. The first batch that brings a text decides which row stays: the smallest ``doc_id`` in it.
    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. ``group_size``
    counts this batch's copies, and those of the other batches that the index holds.

    ``batch`` names the batch, by default after its content. A batch that is run again, after a failure or by mistake, neither
    meets its own entries nor adds them twice, so it returns what it returned before.

    Null texts count as empty and form one group. Exactly one row of a new group is kept: of repeated rows with its smallest id any one;
    a null id sorts last, so a group of null ids alone keeps one of them. An empty batch gives no rows; other columns are ignored.
    """
    rows = cut(docs.select("doc_id", digest().alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()))
    # Partial aggregation leaves one row per digest and task, whatever the size of a group of copies.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    groups = cut(rows.groupBy(F.col("text_sha256").alias("digest")).agg(least, F.count(F.lit(1)).alias("copies")).select("digest", "copies", F.col("least.doc_id").alias("keep_id"), F.col("least.row").alias("keep_row")))
    batch = batch or content_name(groups)
    known = index.before(batch).join(groups.select("digest").hint("merge"), "digest", "left_semi")
    known = cut(known.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies")))
    index.append(groups, known, batch)
    verdict = cut(groups.join(known.select("digest", F.lit(True).alias("was_known"), F.col("keep_id").alias("old_id"), F.col("copies").alias("old")), "digest", "left").select(
        F.col("digest").alias("text_sha256"),
        F.when(F.col("was_known"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        (F.col("copies") + F.coalesce("old", F.lit(0))).alias("group_size"),
        F.when(F.col("was_known"), F.lit(-1)).otherwise(F.col("keep_row")).alias("keep_row"), F.col("copies").alias("n"),
    ))
    # The rows of a digest that very many documents share are dealt to several tasks.
    joined = even(rows, verdict.drop("n"), "text_sha256", verdict.select("text_sha256", "n"))
    release(groups, known)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def new_index(spark: SparkSession, buckets: int = 48) -> DigestIndex:
    """A fresh index in the folder that the cluster shares."""
    name = f"digest_index_{uuid.uuid4().hex[:12]}"
    return DigestIndex(spark, name, f"{shared_folder(spark)}/{name}", buckets)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch into an index of its own, which goes once the verdicts no longer need it."""
    index = new_index(spark)
    out = deduplicate(table(spark, sf_dir, "documents"), index)
    index.drop()
    return out


SQL = r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), groups AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY 1
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
FROM rows JOIN groups USING (text_sha256)
"""
