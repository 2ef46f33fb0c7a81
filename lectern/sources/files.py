"""Source files: discovery, identity, inventory, and tabular inputs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First bytes of a PDF (fixed value).
MAGIC = b"%PDF-"


def within(path: str, directory: str) -> bool:
    """Whether a path, links resolved, lies in a directory."""
    real, root = os.path.realpath(path), os.path.realpath(directory)
    return real == root or real.startswith(root.rstrip(os.sep) + os.sep)


def scan(spark: SparkSession, directory: str, longest: int | None = None) -> DataFrame:
    """Every file with the suffix .pdf in any case, below ``directory``: ``path, name, length, modified, content``.

    A bound on the length is pushed to the scan, so larger files are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(directory)
    if longest is not None:
        files = files.where(F.col("length") <= longest)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")


def has_signature(content: Column) -> Column:
    return F.substring(content, 1, len(MAGIC)) == F.lit(MAGIC)


def identified(files: DataFrame) -> DataFrame:
    """Files with their content's SHA-256 and whether they are PDFs; the bytes are dropped."""
    return files.withColumns({"file_hash": F.sha2("content", 256), "valid": has_signature(F.col("content"))}).drop("content")


def discovered(files: DataFrame) -> DataFrame:
    """Valid files in order of their path without case."""
    return identified(files).where("valid").orderBy(F.lower("path"))


def inventory(files: DataFrame) -> DataFrame:
    """All files with what is wrong with them: not a PDF, or a further copy of a hash."""
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("path")) == 1
    return files.withColumn("error", F.when(~F.col("valid"), "invalid").when(~first, "duplicate"))


def reconcile(files: DataFrame, papers: DataFrame) -> DataFrame:
    """Hashes on disk against those registered: ``file_hash, status`` with status present, missing or unexpected."""
    disk = files.select("file_hash", F.lit(True).alias("__disk")).distinct()
    known = papers.select("file_hash", F.lit(True).alias("__known")).distinct()
    status = F.when(F.col("__disk").isNull(), "missing").when(F.col("__known").isNull(), "unexpected").otherwise("present")
    return disk.join(known, "file_hash", "full").select("file_hash", status.alias("status"))


def located(papers: DataFrame, files: DataFrame) -> DataFrame:
    """A file for each registered paper: same hash, the recorded path first, else the same name, else the first by path."""
    pairs = papers.select("id", "file_hash", "filename", "filepath").join(files.select("file_hash", "path", "name"), "file_hash", "left")
    rank = F.struct((F.col("path") != F.col("filepath")).alias("a"), (F.lower("name") != F.lower("filename")).alias("b"), F.col("path").alias("path"))
    return pairs.groupBy("id", "file_hash").agg(F.min(F.when(F.col("path").isNotNull(), rank)).alias("r")).select("id", "file_hash", F.col("r.path").alias("path"))


def stamps(files: DataFrame) -> DataFrame:
    return files.select("path", "file_hash", "length", "modified")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose stamp differs between two reads."""
    b = after.select("path", *[F.col(c).alias(f"__{c}") for c in ("file_hash", "length", "modified")])
    same = F.col("file_hash").eqNullSafe(F.col("__file_hash")) & F.col("length").eqNullSafe(F.col("__length")) & F.col("modified").eqNullSafe(F.col("__modified"))
    return before.join(b, "path", "full").where(~same).select("path")


def evaluation_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of strings, with or without a byte order mark; columns by the file's header."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    return rows.select(*[F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def reviewed_runs(runs: DataFrame, papers: DataFrame) -> DataFrame:
    """Successful runs of reviewed papers, as evaluation rows."""
    truth = papers.where("manually_reviewed").select(F.col("id").alias("paper_id"), "file_hash", F.coalesce("primary_category", F.lit("")).alias("truth"))
    predicted = F.coalesce(F.get_json_object("result_json", "$.primary_category"), F.lit(""))
    return runs.where("status = 'classified'").withColumn("predicted", predicted).join(truth, "paper_id").select("id", "provider", "model", "file_hash", "truth", "predicted")

