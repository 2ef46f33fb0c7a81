"""Agreement of predictions with human labels: single-label and multi-label metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_labels, strip


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 for a whole of 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def ratios(df: DataFrame) -> DataFrame:
    """Add support, predicted, precision, recall and f1 to ``tp, fp, fn``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumns({"support": tp + fn, "predicted": tp + fp, "precision": share(tp, tp + fp), "recall": share(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.when(p + r == 0, F.lit(1.0)).otherwise(p + r)))


def averages(per_label: DataFrame, *keys: str) -> DataFrame:
    """Pooled (micro) and unweighted (macro) averages of per-label rows."""
    grouped = per_label.groupBy(*keys) if keys else per_label.groupBy()
    sums = grouped.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    )
    out = ratios(sums)
    return out.select(*keys, "tp", "fp", "fn", *[F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1")], *[f"macro_{c}" for c in ("precision", "recall", "f1")])


def usable(pairs: DataFrame) -> DataFrame:
    """Pairs ``(truth, predicted)`` with both given, stripped."""
    return pairs.withColumns({"truth": strip(F.col("truth")), "predicted": strip(F.col("predicted"))}).where("truth <> '' AND predicted <> ''")


def per_class(pairs: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn and ratios of every class seen as truth or prediction, from one pass over the pairs."""
    sides = F.array_distinct(F.array("truth", "predicted"))
    rows = pairs.select(*keys, "truth", "predicted", F.explode(sides).alias("label"))
    truth, predicted = F.col("label") == F.col("truth"), F.col("label") == F.col("predicted")
    return ratios(rows.groupBy(*keys, "label").agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn")))


def accuracy(pairs: DataFrame, *keys: str) -> DataFrame:
    """``evaluated`` and ``accuracy`` (null for none)."""
    grouped = pairs.groupBy(*keys) if keys else pairs.groupBy()
    hit = F.count_if(F.col("truth") == F.col("predicted"))
    n = F.count(F.lit(1))
    return grouped.agg(n.alias("evaluated"), F.when(n > 0, hit / F.greatest(n, F.lit(1))).alias("accuracy"))


def evaluate(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accuracy, and metrics of the observed classes; rows that lack a label are left out."""
    good = usable(pairs)
    return accuracy(good), per_class(good)


def latest_runs(runs: DataFrame, *keys: str, order: str = "id") -> DataFrame:
    """The last row by ``order`` for each key."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return runs.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth")


def evaluate_providers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`evaluate` for each provider and model, from the last run per file; missing names are 'unknown'."""
    named = rows.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) for c in ("provider", "model")})
    good = usable(latest_runs(named, "provider", "model", "file_hash"))
    return accuracy(good, "provider", "model"), per_class(good, "provider", "model")


def checked(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Stripped pairs; a value outside ``classes`` is an error, never left out."""
    allowed = list(classes)
    out = pairs.withColumns({"truth": strip(F.col("truth")), "predicted": strip(F.col("predicted"))})
    good = F.coalesce(F.col("truth").isin(allowed) & F.col("predicted").isin(allowed), F.lit(False))
    return out.withColumn("truth", F.when(good, F.col("truth")).otherwise(F.raise_error(F.lit("invalid single-label value")).cast("string")))


def fixed_classes(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Ratios of every class of a fixed list, in order, absent ones with zeros."""
    spark = pairs.sparkSession
    listed = spark.createDataFrame([(k, c) for k, c in enumerate(classes)], "position int, label string")
    found = per_class(checked(pairs, classes)).select("label", "tp", "fp", "fn")
    joined = F.broadcast(listed).join(found, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    return ratios(joined)


def confusion(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Rows are true classes, columns predicted ones, in the fixed order, zeros included."""
    spark = pairs.sparkSession
    listed = spark.createDataFrame([(k, c) for k, c in enumerate(classes)], "position int, truth string")
    counted = checked(pairs, classes).groupBy("truth").pivot("predicted", list(classes)).agg(F.count(F.lit(1)))
    return F.broadcast(listed).join(counted, "truth", "left").na.fill(0, list(classes))


def multilabel(df: DataFrame, field: str) -> DataFrame:
    """Per-label tp, fp, fn over the union of true and predicted sets of ``(doc, truth, predicted)``."""
    sets = df.select("doc", normalize_labels(F.col("truth"), field).alias("truth"), normalize_labels(F.col("predicted"), field).alias("predicted"))
    # Each side's own and common labels by hashing, so the work is in proportion to the sets.
    kinds = {"tp": F.array_intersect("truth", "predicted"), "fp": F.array_except("predicted", "truth"), "fn": F.array_except("truth", "predicted")}
    named = [F.struct(F.lit(kind).alias("kind"), labels.alias("labels")) for kind, labels in kinds.items()]
    rows = sets.select(F.explode(F.array(*named)).alias("s")).select("s.kind", F.explode("s.labels").alias("label"))
    return ratios(rows.groupBy("label").agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds]))


def exact_match(df: DataFrame, field: str) -> DataFrame:
    """Share of documents whose two label sets are equal; empty sets are."""
    same = normalize_labels(F.col("truth"), field) == normalize_labels(F.col("predicted"), field)
    return df.agg(F.count(F.lit(1)).alias("evaluated"), share(F.count_if(same), F.count(F.lit(1))).alias("exact_match_accuracy"))


def unanimous_top(evidence: DataFrame, key: str, priority: str, value: str) -> DataFrame:
    """The value that all evidence of the highest priority agrees on; null where it does not."""
    top = Window.partitionBy(key)
    best = evidence.withColumn("__top", F.max(priority).over(top)).where(F.col(priority) == F.col("__top"))
    return best.groupBy(key).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value), F.max(priority).alias(priority))
