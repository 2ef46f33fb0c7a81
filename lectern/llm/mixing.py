"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, cut, packed, row_key, table

#: Hex digits of the seeded hash that form the bins in which running sizes are kept.
BIN_DIGITS = 3


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def default_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last. One row per source is ranked."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """Target words of each source ``(source, source_size, weight)``: they share the total size by weight.

    A source that would exceed ``epochs`` times its size is clamped there and the excess is shared
    among the others by weight, until none is above. Sources clamp in the order of cap by weight, so
    one running sum over the table of sources (one row each, never documents) finds the last clamp:
    with k clamped sources the level is (total - their caps) / (weight of the others), and the first k whose
    level keeps the next source at or below its cap is the fixed point of the repeated resharing.
    """
    order = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    capped = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    capped = capped.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.col("all_weight") - F.col("weight_below")
    ranked = (
        capped.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("caps_below", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_below", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.when((F.col("weight") > 0) & (rest > 0), (F.col("total") - F.col("caps_below")) / rest))
        .withColumn("fits", F.col("level") <= F.col("ratio"))
    )
    # Levels of a clamped prefix only matter up to the first that fits.
    final = F.min(F.when(F.col("fits"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)
    target = F.when(F.col("weight") > 0, F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).otherwise(F.lit(0.0))
    return ranked.withColumn("level", final["level"]).select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, epochs: float = 3.0, seed: int = 17, weights: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Choose how often each document enters the mix.

    ``size`` is the number of words. A source whose target is e times its size takes every document
    floor(e) times, and once more those whose middle, in the running size along a seeded hash order,
    lies below the fraction left: so each source's words come within half a document of its target.
    Running sizes are kept in two steps, over 16**3 hash bins of a source and then inside a bin, so no
    task orders a whole source. ``weights`` is a table ``(source, weight)``; by default 1, 2, 3, repeating. A source that it
    does not list, or lists with a weight that is null, zero or negative, has the target 0 (its words still count in the total that
    the others share); of a source listed twice the weights are added.

    Returns ``doc_id, size, source_size, target, repeats, taken`` and ``columns``. Null texts have size 0
    and are taken 0 words; a null source is a source of its own; repeated rows count each by itself and
    rows that tie in the hash order are ordered by size; rows with a null id are ordered by a hash of their text; a mix of empty texts has targets 0.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")))))
    keyed = docs.select("doc_id", "source", words().alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("order"), *columns)
    rows = cut(keyed)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighed = default_weights(sources)
    else:
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        weighed = sources.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    targets = water_fill(weighed, epochs)
    bin_ = F.substring("order", 1, BIN_DIGITS)
    bins = rows.groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("start", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    # At most 16**3 bins a source: the table grows with the number of sources, not with that of documents.
    plan = starts.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    plan = plan.select(F.coalesce("source", F.lit("")).alias("p_source"), F.col("source").isNull().alias("p_null"), "bin", "start", "source_size", "target")
    inside = Window.partitionBy("source", "bin").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("bin", bin_).withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.withColumn("p_source", F.coalesce("source", F.lit(""))).withColumn("p_null", F.col("source").isNull()).join(plan, ["p_source", "p_null", "bin"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share)
    middle = (F.col("start") + F.col("inner")) * 2 + F.col("size")
    extra = (middle.cast("double") < (share - whole) * F.col("source_size") * 2).cast("long")
    return joined.withColumn("repeats", whole + extra).select(
        "doc_id", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), *columns
    )


def take(docs: DataFrame, epochs: float = 3.0, seed: int = 17, weights: DataFrame | None = None) -> DataFrame:
    """The mix itself: every document as many times as :func:`mix` says, with all its columns.

    Rows meet their number of repeats by a hash of the whole row; equal rows are interchangeable, so they are
    taken together as often as all of them.
    """
    key = row_key(*docs.columns)
    slim = docs.select("doc_id", "source", "text", key.alias("key"))
    chosen = cut(mix(slim, epochs, seed, weights, ("key",)).groupBy("key").agg(F.sum("repeats").alias("repeats"), F.count(F.lit(1)).alias("rows")))
    keyed = docs.select(packed(docs), key.alias("key"))
    if not chosen.where("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["key"])
    taken = keyed.join(chosen.where("repeats > 0").select("key", "repeats"), "key")
    return taken.select("d", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("d.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '#' || md5(coalesce(text, '')))) AS ord
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY 1
), weighed AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM sources
), ranked AS (
  SELECT *, cap / weight AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (
  SELECT arg_min(level, (ratio, source IS NULL, source)) AS level FROM ranked WHERE level <= ratio
), targets AS (
  SELECT source, source_size, least(cap, coalesce(final.level * weight, cap)) AS target FROM ranked, final
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS share,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.ord, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(share) + CASE WHEN CAST(2 * before + size AS DOUBLE) < (share - floor(share)) * source_size * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
