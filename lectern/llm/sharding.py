"""Sharding by extendible hashing (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, packed, release, table

#: Bits of the hash; cells to a shard in the first pass, as bits; how many bits a further pass can split.
MAX_BITS, SPARE, STEP = 60, 3, 10
#: Bytes of a shard by default, and in the query: small enough to split small tables too.
LIMIT, QUERY_LIMIT = 16 << 20, 256 << 10
#: Directory cells that may go to every task (some 50 bytes each); a larger table is joined by a shuffle.
BROADCAST_CELLS = 100_000
ADDED = ("n_bytes", "shard", "shard_bits", "page", "shard_bytes", "oversize")


def hashed() -> Column:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def sized() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def directory(docs: DataFrame, limit: int = LIMIT) -> tuple[list[tuple[int, DataFrame]], bool]:
    """Tables ``(cell, leaf)`` of the directory, each with the bits of its cells, and whether some bucket is full at the last.

    It starts as one bucket; only a bucket over the limit splits, on its next bit, until every bucket fits.
    Sizes are summed by cells of leading bits, from which all splits above follow. The first pass has some eight cells to a shard, so its
    table grows with the shards and not with the rows; only rows of buckets still too large enter the next pass, on further bits.
    """
    left = cut(docs.select(sized().alias("n_bytes"), hashed().alias("hash")).groupBy("hash").agg(F.sum("n_bytes").alias("n_bytes")))
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    levels: list[tuple[int, DataFrame]] = []
    base, upto = 0, min(max((total // limit).bit_length() + SPARE, 1), MAX_BITS)
    while True:
        cell = F.shiftright("hash", MAX_BITS - upto)
        cells = cut(left.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes")))
        least = base + 1 if base else 0
        depths = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(least), F.lit(upto))).alias("bits"))
        prefixed = depths.withColumn("prefix", F.expr(f"shiftright(cell, CAST({upto} - bits AS INT))"))
        buckets = cut(prefixed.groupBy("bits", "prefix").agg(F.sum("bytes").alias("shard_bytes")))
        # A leaf fits and its parent does not, so each cell meets one leaf at most.
        full = buckets.where(F.col("shard_bytes") > limit).select((F.col("bits") + 1).alias("b"), F.col("prefix").alias("p"))
        fits = buckets.where(F.col("shard_bytes") <= limit)
        below = fits.where(F.col("bits") > least).join(full, (F.col("b") == F.col("bits")) & (F.col("p") == F.shiftright("prefix", 1)), "left_semi")
        found = cut(below.unionByName(fits.where(F.col("bits") == least)))
        # Cells look for their leaf at the depths that leaves have: the short prefixes above would bring all cells into a few tasks.
        low, high = found.agg(F.min("bits"), F.max("bits")).first()
        there = prefixed.drop("bytes") if low is None else prefixed.drop("bytes").where(F.col("bits").between(low, high))
        leaves = cut(there.join(found, ["bits", "prefix"]).select("cell", F.struct("bits", "prefix", "shard_bytes").alias("leaf")))
        levels.append((upto, leaves))
        over = cells.join(leaves, "cell", "left_anti").select("cell")
        if over.isEmpty():
            return levels, False
        if upto == MAX_BITS:
            return levels, True
        release(buckets, found)
        left = left.withColumn("cell", cell).join(over, "cell", "left_semi").drop("cell")
        base, upto = upto, min(upto + STEP, MAX_BITS)


def shard(docs: DataFrame, limit: int = LIMIT, columns: tuple[str, ...] = ()) -> DataFrame:
    """Assign each document to a shard of at most ``limit`` bytes of UTF-8 text, by leading bits of a hash of ``doc_id``.

    The directory is made from ids and sizes alone; then the documents look up their shard in it, so texts are
    not shuffled while the directory is small.

    Rows with one ``doc_id`` share all bits: when such rows alone pass the limit, their bucket at full depth
    gets overflow pages, which are filled partition by partition. One document larger than the limit has
    a page to itself and is the only case of a shard over it (``oversize``).

    Returns ``doc_id``, ``columns`` and ``n_bytes, shard, shard_bits, page, shard_bytes, oversize``: ``shard`` is the
    bit string, ``shard_bytes`` the size of the shard's page. Null texts have 0 bytes, a null id hashes
    as an empty string, an empty table gives no rows; columns named like those added are replaced.
    """
    columns = tuple(c for c in columns if c not in ("doc_id", *ADDED))
    levels, full = directory(docs.select("doc_id", "text"), limit)
    placed = docs.select(packed(docs, "doc_id", *columns), sized().alias("n_bytes"), hashed().alias("hash"))
    for k, (bits, leaves) in enumerate(levels):
        # Cells are counted before they are sent anywhere.
        small = leaves if leaves.count() > BROADCAST_CELLS else F.broadcast(leaves)
        here = small.select("cell", F.col("leaf").alias(f"leaf{k}"))
        placed = placed.withColumn("cell", F.shiftright("hash", MAX_BITS - bits)).join(here, "cell", "left")
    leaf = F.coalesce(*[F.col(f"leaf{k}") for k in range(len(levels))])
    placed = placed.select("d", "n_bytes", "hash", leaf.alias("leaf"))
    out = placed.where("leaf IS NOT NULL") if full else placed
    done = out.select(
        "d.*", "n_bytes", F.expr("lpad(bin(leaf.prefix), leaf.bits, '0')").alias("shard"), F.col("leaf.bits").alias("shard_bits"),
        F.lit(0).cast("long").alias("page"), F.col("leaf.shard_bytes").alias("shard_bytes"), F.lit(False).alias("oversize"),
    )
    return done.unionByName(overflow(placed.where("leaf IS NULL"), limit)) if full else done


def overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for rows whose bucket is over the limit at full depth: inside each partition, so no key meets in one task."""
    rows = cut(rows.select("d", "n_bytes", "hash")).withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("hash", "part").orderBy("n_bytes", "d.doc_id")
    running = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # Small rows fill slots of half a limit and overlap the next by less than half; a large row has a page of its own.
    slot = F.when(F.col("n_bytes") * 2 > limit, -F.row_number().over(order)).otherwise(F.floor(F.greatest(running - 1, F.lit(0)) * 2 / F.lit(limit)))
    paged = rows.withColumn("slot", slot)
    page = F.shiftleft(F.col("part").cast("long"), 32) + F.col("slot")
    own = Window.partitionBy("hash", "part", "slot")
    return paged.select(
        "d.*", "n_bytes", F.expr(f"lpad(bin(hash), {MAX_BITS}, '0')").alias("shard"), F.lit(MAX_BITS).alias("shard_bits"),
        page.alias("page"), F.sum("n_bytes").over(own).alias("shard_bytes"), (F.col("n_bytes") > limit).alias("oversize"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), QUERY_LIMIT)


SQL = f"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents
), depths AS (
  SELECT bits, hash >> ({MAX_BITS} - bits) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes
  FROM rows, (SELECT CAST(unnest(range({MAX_BITS + 1})) AS INTEGER) AS bits) GROUP BY ALL
), leaves AS (
  SELECT r.doc_id, r.hash, r.n_bytes, min(d.bits) AS shard_bits, arg_min(d.prefix, d.bits) AS prefix, arg_min(d.shard_bytes, d.bits) AS shard_bytes
  FROM rows r JOIN depths d ON r.hash >> ({MAX_BITS} - d.bits) = d.prefix WHERE d.shard_bytes <= {QUERY_LIMIT} GROUP BY ALL
)
SELECT doc_id, n_bytes, CASE WHEN shard_bits = 0 THEN '' ELSE lpad(bin(prefix), shard_bits, '0') END AS shard, shard_bits,
  CAST(0 AS BIGINT) AS page, shard_bytes, false AS oversize
FROM leaves
"""
