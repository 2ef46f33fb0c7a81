"""Controlled refresh of metadata: what changed, whether evidence agrees, and what an audit must cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import format_input
from lectern.model import INPUT_FIELDS, METADATA_FIELDS


def _comparable(name: str, column: Column) -> Column:
    """Maps have no equality: their entries in order have."""
    return F.array_sort(F.map_entries(column)) if name == "metadata_sources" else column


def changes(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = METADATA_FIELDS) -> DataFrame:
    """``id, changes, input_changed``: the fields that differ between old and newly extracted metadata, null-safe."""
    after = new.select("id", *[F.col(f).alias(f"__{f}") for f in fields])
    names = F.array_compact(F.array(*[F.when(~_comparable(f, F.col(f)).eqNullSafe(_comparable(f, F.col(f"__{f}"))), F.lit(f)) for f in fields]))
    out = old.join(after, "id").select("id", names.alias("changes"))
    return out.withColumn("input_changed", F.arrays_overlap("changes", F.array(*map(F.lit, INPUT_FIELDS))))


def summary(plan: DataFrame) -> DataFrame:
    """Counts of a plan's rows in one aggregation."""
    return plan.agg(
        F.count(F.lit(1)).alias("papers"), F.count_if(F.size("changes") > 0).alias("changed"), F.count_if("input_changed").alias("input_changed"),
        F.count_if((F.size("changes") > 0) & ~F.col("input_changed")).alias("bibliographic_only"),
    )


def field_counts(plan: DataFrame) -> DataFrame:
    return plan.select(F.explode("changes").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("papers"))


def disagreements(first: DataFrame, second: DataFrame, plan: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields in which two phases of evidence, or the evidence and the plan, do not agree: ``id, field``; also papers that one lacks."""
    b = second.select("id", *[F.col(f).alias(f"__b_{f}") for f in fields], F.lit(True).alias("__b"))
    c = plan.select("id", *[F.col(f).alias(f"__c_{f}") for f in fields], F.lit(True).alias("__c"))
    joined = first.withColumn("__a", F.lit(True)).join(b, "id", "full").join(c, "id", "full")
    whole = F.col("__a").isNull() | F.col("__b").isNull() | F.col("__c").isNull()
    wrong = [F.when(~(F.col(f).eqNullSafe(F.col(f"__b_{f}")) & F.col(f).eqNullSafe(F.col(f"__c_{f}"))), F.lit(f)) for f in fields]
    return joined.select("id", F.explode(F.when(whole, F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*wrong)))).alias("field"))


def format_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, format_only``: whether the classifier's input changed in form alone."""
    shape = lambda p: format_input(F.col(f"{p}title"), F.col(f"{p}abstract"), F.col(f"{p}introduction_excerpt"), F.col(f"{p}keywords"))
    after = new.select("id", *[F.col(f).alias(f"__{f}") for f in INPUT_FIELDS])
    return old.join(after, "id").select("id", shape("").eqNullSafe(shape("__")).alias("format_only"))


def audit_errors(targets: DataFrame, decisions: DataFrame, forms: DataFrame) -> DataFrame:
    """What keeps an audit from freezing: ``id, error``. Verdict A reclassifies, B claims a change of form only, C is open."""
    counted = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), F.first("verdict").alias("verdict"))
    joined = targets.select("id", F.lit(True).alias("__target")).join(counted, "id", "full").join(forms, "id", "left")
    error = (
        F.when(F.col("__n").isNull(), "no decision").when(F.col("__target").isNull(), "not a candidate").when(F.col("__n") > 1, "decided twice")
        .when(F.col("verdict") == "C", "questionable").when((F.col("verdict") == "B") & ~F.coalesce("format_only", F.lit(False)), "changes content")
        .when(~F.col("verdict").isin("A", "B"), "unknown verdict")
    )
    return joined.withColumn("error", error).where("error IS NOT NULL").select("id", "error")


def index_errors(records: DataFrame, first: int, last: int) -> DataFrame:
    """Records of a frozen set that break its rules: ids ``first`` to ``last`` each once, each hash once and of 64 hex digits."""
    spark = records.sparkSession
    ids = records.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.range(first, last + 1)
    twice = ids.where("n > 1").select(F.col("id").cast("string").alias("what"), F.lit("id twice").alias("error"))
    lacking = wanted.join(ids, "id", "left_anti").select(F.col("id").cast("string").alias("what"), F.lit("id missing").alias("error"))
    extra = ids.where(~F.col("id").between(first, last)).select(F.col("id").cast("string").alias("what"), F.lit("id unexpected").alias("error"))
    hashes = records.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"))
    again = hashes.where("n > 1").select(F.col("file_hash").alias("what"), F.lit("hash twice").alias("error"))
    bad = hashes.where(~F.coalesce(F.col("file_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))).select(F.col("file_hash").alias("what"), F.lit("not a hash").alias("error"))
    return twice.unionByName(lacking).unionByName(extra).unionByName(again).unionByName(bad)
