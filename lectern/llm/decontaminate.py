"""Benchmark decontamination by SimHash windows and a multi-index Hamming search (native operations only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, packed, row_key, table

#: Words of a shingle, least similarity, and the Hamming radius within which the search finds every fingerprint.
WORDS, SIMILARITY, RADIUS = 5, 0.8, 12
#: Items up to this many go to every task (their shingles take 8 bytes each); beyond it all joins are shuffled.
BROADCAST_SHINGLES = 200_000
#: Documents with windows that may go to every task (their places take some tens of bytes each).
BROADCAST_ROWS = 100_000
#: Low bits of every byte.
LANES = 0x0101010101010101


def words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def hashes(text: str) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_rows(df: DataFrame, keys: list[str], n: str, array: str, size: int = WORDS) -> DataFrame:
    """One row a shingle: ``keys, pos, shingle``. A text of fewer than ``size`` words gives one shingle of all.

    The hash is computed after the generator, so inside generated code and not in a lambda.
    """
    # Slices of equal length, shifted by one word each, zip into windows; a short text has nulls at the end.
    count = F.greatest(F.col(n) - (size - 1), F.lit(1))
    zipped = F.arrays_zip(*[F.slice(F.col(array), k + 1, count).alias(f"w{k}") for k in range(size)])
    rows = df.where(F.col(n) > 0).select(*keys, n, F.posexplode(zipped).alias("pos", "w"))
    return rows.select(*keys, n, "pos", F.xxhash64(*[f"w.w{k}" for k in range(size)]).alias("shingle"))


def simhash(windows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Add ``mark``, the SimHash of each row's words (an array of word hashes).

    Words are features, so that an edit moves the fingerprint little. Eight longs count the set bits, a byte
    lane a bit, over pieces of at most 120 words; the pieces of a longer window are added bit by bit.
    """
    chunk = 120
    pieces = windows.select(*keys, F.size(array).alias("size"), F.explode(F.transform(F.sequence(F.lit(0), F.size(array) - 1, F.lit(chunk)), lambda i: F.slice(F.col(array), i + 1, chunk))).alias("piece"))
    words_ = pieces.select(*keys, "size", F.monotonically_increasing_id().alias("nth"), F.explode("piece").alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", lane).bitwiseAND(LANES)).alias(f"l{lane}") for lane in range(8)]
    counted = words_.groupBy(*keys, "size", "nth").agg(*lanes)
    single = [F.sum(F.shiftrightunsigned(f"l{lane}", 8 * k).bitwiseAND(255)).alias(f"b{lane}_{k}") for lane in range(8) for k in range(8)]
    summed = counted.groupBy(*keys, "size").agg(*single)
    bits = []
    for lane in range(8):
        for k in range(8):
            at = 8 * k + lane
            bits.append(F.when(F.col(f"b{lane}_{k}") * 2 > F.col("size"), F.lit(1 << at if at < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("mark"))


def index_blocks(mark: str) -> Column:
    """The fingerprint in RADIUS + 1 blocks: two within the radius agree in one block at least."""
    n = RADIUS + 1
    edges = [64 * k // n for k in range(n + 1)]
    parts = [
        F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftrightunsigned(mark, a).bitwiseAND((1 << (b - a)) - 1)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return F.array(*parts)


def lay(matches: DataFrame, similarity: float) -> DataFrame:
    """``row, start, length, item`` of all windows that may be as similar as asked for, from matches of single shingles.

    ``matches`` has ``row, pos, item, length, words``: where a text of ``words`` words has a shingle of an item of
    ``length`` words. A window shares at most as many shingles with the item as there are matches inside it, in
    whatever order, so a window with fewer than the threshold needs is left out and no other. Matches are grouped by stretches
    of two items' length that overlap by one, so that a group is in proportion to an item and not to a text.
    """
    size = F.greatest(F.col("length") - (WORDS - 1), F.lit(1))
    stretch = F.floor(F.col("pos") / F.col("size"))
    near = matches.withColumn("size", size).select("*", F.explode(F.array(stretch, stretch - 1)).alias("stretch"))
    groups = near.groupBy("row", "item", "length", "words", "size", "stretch").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # A window that sticks out of the text is smaller, and shares at least this part of the item.
    least = F.greatest(F.ceil(F.col("size") * similarity - 1e-9), F.lit(1)).cast("int")
    groups = groups.withColumn("least", least).where(F.size("at") >= F.col("least"))
    low = F.greatest(F.col("stretch") * F.col("size"), F.expr("at[least - 1]") - F.col("size") + 1)
    high = F.least(F.col("stretch") * F.col("size") + F.col("size") - 1, F.expr("at[size(at) - least]"))
    starts = groups.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("start", F.explode(F.sequence("low", "high")))
    inside = F.expr("size(filter(at, p -> p >= start and p < start + size))")
    held = F.least(F.col("start") + F.col("length"), F.col("words")) - F.greatest("start", F.lit(0))
    own = F.greatest(held - (WORDS - 1), F.lit(1))
    # Similarity is common / (own + size - common), and common is at most what is inside.
    enough = inside * (1 + similarity) >= (own + F.col("size")) * similarity - 1e-6
    return starts.where((held > 0) & enough).select("row", F.col("start").cast("int").alias("start"), "length", "item").distinct()


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Windows of documents that hold a benchmark item: ``row, doc_id, item_id, start, similarity``.

    Windows are as long as the item, in words. They are laid at every start with enough of an item's shingles inside, whatever
    their order (``lay``): this loses no window over the threshold and leaves the rest of 100 TB unfingerprinted. Each window gets a SimHash; a multi-index of RADIUS + 1 blocks finds
    the items of that length with every fingerprint within RADIUS bits. These and the items a window was laid for are
    compared by the exact weighted Jaccard similarity of the shingles (repeats count), which decides.
    """
    items = cut(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), hashes("text").alias("h"))
        .withColumn("n", F.size("h")).where("n > 0")
        .select(F.monotonically_increasing_id().alias("item"), "item_id", "h", "n")
    )
    shingles = cut(shingle_rows(items, ["item"], "n", "h"))
    small = shingles.count() <= BROADCAST_SHINGLES
    # A hint only below the stated size; above it the planner shuffles both sides.
    hint = F.broadcast if small else lambda df: df
    places = hint(shingles.select("shingle", "item", F.col("n").alias("length")).distinct())
    source = docs.select("row", "doc_id", "text")
    texts = source.select("row", hashes("text").alias("h")).withColumn("n", F.size("h"))
    # An item of fewer than WORDS words is one shingle of that length: longer texts give those too, for the lengths there are.
    short = sorted(r.n for r in items.where(F.col("n") < WORDS).select("n").distinct().collect())
    parts = [shingle_rows(texts, ["row"], "n", "h"), *(shingle_rows(texts.where(F.col("n") > k), ["row"], "n", "h", k) for k in short)]
    anchors = cut(lay(reduce(DataFrame.unionByName, parts).join(places, "shingle").withColumnRenamed("n", "words"), similarity))
    at = cut(anchors.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("at")))
    # The texts with windows: a hint only below a checked number of rows, else the join is shuffled.
    few = F.broadcast(at) if at.count() <= BROADCAST_ROWS else at
    held = source.join(few, "row").select("row", "doc_id", "at", hashes("text").alias("h")).dropDuplicates(["row"])
    own_words = F.expr("slice(h, greatest(w.start, 0) + 1, w.length + least(w.start, 0))")
    rows = cut(held.select("row", "doc_id", "h", F.explode("at").alias("w")).select("row", "doc_id", "w.start", "w.length", own_words.alias("h")))
    key = ["row", "start", "length"]
    marked = simhash(rows, key, "h")
    item_marks = simhash(items, ["item", "n"], "h").select("item", F.col("n").alias("length"), F.col("mark").alias("item_mark"))
    left = marked.select(*key, "mark", F.explode(index_blocks("mark")).alias("block"))
    right = hint(item_marks.select("item", "length", "item_mark", F.explode(index_blocks("item_mark")).alias("block")))
    near = left.join(right, ["length", "block"]).where(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= RADIUS).select(*key, "item")
    # The radius alone loses pairs over the threshold, so every window laid for an item is checked against it as well.
    near = near.unionByName(anchors.select(*key, "item")).distinct()
    both = rows.join(near, key).join(hint(items.select("item", "item_id", F.col("h").alias("g"))), "item")
    own = shingle_rows(both.select(*key, "doc_id", "item", "item_id", F.col("h"), F.size("h").alias("n")), [*key, "doc_id", "item", "item_id"], "n", "h")
    have = own.groupBy(*key, "doc_id", "item", "item_id", "shingle").agg(F.count(F.lit(1)).alias("x"))
    want = hint(shingles.groupBy("item", "shingle").agg(F.count(F.lit(1)).alias("y")))
    sizes = hint(shingles.groupBy("item").agg(F.count(F.lit(1)).alias("item_size")))
    shared = have.join(want, ["item", "shingle"], "left").groupBy(*key, "doc_id", "item", "item_id").agg(
        F.sum("x").alias("size"), F.sum(F.least("x", F.coalesce("y", F.lit(0)))).alias("common"))
    scored = shared.join(sizes, "item").withColumn("similarity", F.col("common") / (F.col("size") + F.col("item_size") - F.col("common")))
    return scored.where(F.col("similarity") >= similarity).select("row", "doc_id", "item_id", "start", "similarity")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a name of each row, which a retried task computes again alike: 128 bits of its id and text."""
    return docs.withColumn("row", row_key("doc_id", "text"))


def scan(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``row, contaminated, item_ids`` (in order) and ``best_similarity`` (0 if none).

    Words are runs of letters and digits in lower case, so case, punctuation and line ends do not
    hide an item. Null and empty texts, and an empty benchmark, give clean documents; an item shorter than five words is one
    shingle and must occur whole, anywhere in a text; repeated rows get the same verdict; other columns of ``docs`` pass through and
    columns named like the added ones are replaced.
    """
    docs = numbered(docs.drop("row", "contaminated", "item_ids", "best_similarity"))
    hits = find(docs.select("row", "doc_id", "text"), benchmark, similarity)
    verdict = hits.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("best_similarity"))
    return docs.join(verdict, "row", "left").withColumn("contaminated", F.col("item_ids").isNotNull()).withColumn(
        "item_ids", F.coalesce("item_ids", F.array().cast("array<bigint>"))
    ).withColumn("best_similarity", F.coalesce("best_similarity", F.lit(0.0)))


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    hits = cut(find(numbered(docs.select("doc_id", "text")), benchmark).select("row").distinct())
    few = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    return docs.select(packed(docs), row_key("doc_id", "text").alias("row")).join(few, "row", "left_anti").select("d.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("item_ids").alias("n_items"), F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), F.round("best_similarity", 6).alias("best_similarity"))
