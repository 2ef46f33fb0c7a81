"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import SPACES, bound_batches, cut, even, packed, release, row_key, table
from lectern.llm.linking import Sets, buckets, maybe, presence, resolve
from lectern.llm.wordhash import blocks, mix, utf8

#: Counters of the document-frequency table and slices in which it travels.
SLOTS, SLICES = 1 << 18, 16
#: Rows of random draws per sample; a shingle uses the row its hash selects.
DRAWS = 1 << 14


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    #: Frequencies below this share of all documents weigh alike: the table's noise lies below it at any size.
    floor: float = 1 / 256
    #: How much more a rare shingle weighs than one in every document. A steep idf would punish large groups
    #: of near copies, whose common shingles are frequent just because the group is large.
    slope: float = 0.25
    seed: int = 11


@cache
def draws(settings: Settings) -> tuple[np.ndarray, ...]:
    """Tables for the sampling: 1/r, beta, r and ln c - r + r*beta, with r, c ~ Gamma(2, 1) and beta ~ U(0, 1)."""
    random = np.random.default_rng(settings.seed)
    shape = (DRAWS, settings.bands * settings.rows)
    r = random.gamma(2, 1, shape)
    c = random.gamma(2, 1, shape)
    beta = random.random(shape)
    return tuple(x.astype(np.float32) for x in (1 / r, beta, r, np.log(c) - r + r * beta))


def sample(elements: np.ndarray, log_weight: np.ndarray, settings: Settings) -> np.ndarray:
    """One weighted set's samples: for each of the hash functions the element and level with the least ln a.

    t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r. Pieces bound the memory for long texts.
    """
    inverse, beta, r, rest = draws(settings)
    row = (elements & np.uint64(DRAWS - 1)).astype(np.int64)
    best = picked = None
    for at in range(0, len(elements), 4096):
        own = row[at : at + 4096]
        t = inverse.take(own, 0)
        t *= log_weight[at : at + 4096, None]
        t += beta.take(own, 0)
        np.floor(t, out=t)
        a = r.take(own, 0)
        a *= t
        np.subtract(rest.take(own, 0), a, out=a)
        k = a.argmin(0)
        least = np.take_along_axis(a, k[None], 0)[0]
        level = np.take_along_axis(t, k[None], 0)[0].astype(np.int64).view(np.uint64)
        found = elements[at + k] ^ mix(level + np.uint64(0x5BD1E995))
        if best is None:
            best, picked = least, found
        else:
            less = least < best
            best, picked = np.where(less, least, best), np.where(less, found, picked)
    return picked


def band_keys(picked: np.ndarray, settings: Settings) -> np.ndarray:
    rows = picked.reshape(settings.bands, settings.rows)
    key = np.arange(settings.bands, dtype=np.uint64) + np.uint64(1)
    for j in range(settings.rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, j])
    return key.view(np.int64)


def frequencies(docs: DataFrame, settings: Settings) -> np.ndarray:
    """idf of each slot of the document-frequency table, counted over the whole texts of all documents.

    A shingle's count goes to the slot of its hash, less the mean load of a slot: so the table has
    one size for any corpus, and its noise is a fixed small share of the number of documents.
    """
    size = settings.words
    per = SLOTS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        rows = 0
        for batch in batches:
            for _, _, words in blocks(batch.column(0)):
                shingles, ptr = words.shingles(size)
                rows += int((np.diff(ptr) > 0).sum())
                slot = (shingles >> np.uint64(46)).astype(np.int64)
                # Once a document: its repeats are dropped by sorting (document, slot).
                pair = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)) * SLOTS + slot
                pair.sort()
                first = np.ones(len(pair), bool)
                first[1:] = pair[1:] != pair[:-1]
                total += np.bincount(pair[first] & (SLOTS - 1), minlength=SLOTS)
        if rows:
            yield pa.RecordBatch.from_pydict({"slice": list(range(SLICES)), "rows": [rows] * SLICES, "counts": [total[k * per : (k + 1) * per].tobytes() for k in range(SLICES)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, rows, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = sums.setdefault(part, [0, np.zeros(per, np.int64)])
                own[0] += rows
                own[1] += np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"slice": list(sums), "rows": [x[0] for x in sums.values()], "counts": [x[1].tobytes() for x in sums.values()]})

    schema = "slice long, rows long, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).withColumn("salt", F.spark_partition_id() % 8)
    # Sums of sums: a fixed number of slices reaches the driver, whatever the number of partitions.
    summed = parts.repartition(SLICES * 8, "slice", "salt").select("slice", "rows", "counts").mapInArrow(add, schema)
    total, rows = np.zeros(SLOTS), 0
    for x in summed.toLocalIterator():
        total[x.slice * per : (x.slice + 1) * per] += np.frombuffer(x.counts, np.int64)
        rows += x.rows if x.slice == 0 else 0
    share = np.clip((total - total.mean()) / max(rows, 1), settings.floor, 1.0)
    return (1 + settings.slope * np.log(share) / np.log(settings.floor)).astype(np.float32)


def weigh(shingles: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and their tf * idf."""
    distinct, tf = np.unique(shingles, return_counts=True)
    return distinct, tf * idf[(distinct >> np.uint64(46)).astype(np.int64)]


#: Bits of a hash that select the slot of its frequency, and the others.
SLOT_BITS = np.uint64(((1 << 18) - 1) << 46)


def elements(shingles: np.ndarray) -> np.ndarray:
    """A text's multiset of shingles as a sorted set: the second and later copies of a shingle are elements of their own, in its slot."""
    s = np.sort(shingles)
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    start = np.flatnonzero(first)
    copy = (np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))).astype(np.uint64)
    other = (s & SLOT_BITS) | (mix(s + copy * np.uint64(0x9E3779B97F4A7C15)) & ~SLOT_BITS)
    return np.unique(np.where(copy > 0, other, s))


def compared(idf: np.ndarray, settings: Settings) -> Sets:
    """Weighted Jaccard similarity over packed elements: the sum of the lesser tf * idf over the sum of the greater."""

    def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = utf8(column)
        return np.frombuffer(raw[offsets[0] : offsets[-1]].tobytes(), np.uint64), (offsets - offsets[0]) // 8

    return Sets(
        unpack,
        lambda e: idf[(e >> np.uint64(46)).astype(np.int64)],
        settings.similarity,
    )


def signatures(docs: DataFrame, idf: np.ndarray, settings: Settings) -> DataFrame:
    """``doc_id, digest, shingles, keys``: one key a band; none for an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    clean = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), f"^{SPACES}|{SPACES}$", ""))
    rows = docs.select("doc_id", F.md5(F.regexp_replace(clean, SPACES, " ")).alias("digest"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys = [], []
            for _, _, words in blocks(batch.column(2)):
                shingles, ptr = words.shingles(settings.words)
                for d in range(len(ptr) - 1):
                    own = shingles[ptr[d] : ptr[d + 1]]
                    counts.append(len(own))
                    if not len(own):
                        keys.append([])
                        continue
                    elements, weight = weigh(own, shared.value)
                    keys.append(band_keys(sample(elements, np.log(weight).astype(np.float32), settings), settings))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "shingles", "keys"])

    return rows.mapInArrow(sign, "doc_id long, digest string, shingles long, keys array<long>")


def contents(docs: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """``id, content`` (packed elements) of the documents listed in ``ids``.

    A filter of fixed size, built by a distributed bit-or, first drops most texts that have no
    candidate partner, so that only few texts are hashed and shuffled; the join then is exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(presence(ids))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe(shared.value, batch.column(1).to_numpy())))
            out = []
            for _, _, words in blocks(batch.column(2)):
                shingles, ptr = words.shingles(settings.words)
                out += [elements(shingles[ptr[d] : ptr[d + 1]]).tobytes() for d in range(len(ptr) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "content"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("at"), "text")
    found = rows.mapInArrow(pack, "id long, content binary").join(ids, "id", "left_semi")
    return found.groupBy("id").agg(F.max("content").alias("content"))  # rows repeated with one id count once


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Near-duplicate class of every document.

    Texts that agree but for case and white space are one node, the copy with the smallest ``doc_id``.
    Nodes that share a band are candidates: a pair at 0.8 does with probability 0.9998. Pairs of a bucket are not emitted:
    every member meets the bucket's pivot, then another, and what still lies in different components of its bucket
    is compared in blocks; so each bucket's pair is either compared or already connected, and no link that could join
    two classes is lost. Classes are the connected components of the verified links.

    Returns ``doc_id, class_id, rep_id, shingles`` with ``class_id`` the smallest ``doc_id`` of the class and ``rep_id``
    that of the exact copies. Null and empty texts are copies of each other; a text of one to four words is one
    shingle; rows with a null id form their own class with a null ``class_id``; repeated rows stay repeated; an empty
    table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = frequencies(docs, settings)
    signed = cut(signatures(docs, idf, settings))
    groups = cut(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    hot = buckets(groups.where(F.col("rep").isNotNull()).select(F.col("rep").alias("id"), F.explode("keys").alias("key")))
    labels = None
    if not hot.isEmpty():
        texts = cut(contents(docs, hot.select("id").distinct(), settings))
        labels = resolve(hot, texts, compared(idf, settings))
        release(texts)
    release(hot)
    if labels is None:
        nodes = groups.select("digest", "rep", F.col("rep").alias("class_id"))
    else:
        nodes = groups.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("digest", "rep", F.coalesce("label", "rep").alias("class_id"))
    return signed.select("doc_id", "digest", "shingles").join(nodes, "digest").select("doc_id", "class_id", F.col("rep").alias("rep_id"), "shingles")


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest ``doc_id``, with all its columns; rows with a null id stay.

    Of different rows under one id the one with the least hash of its content stays, so reruns agree.
    """
    found = cut(classes(docs).select("doc_id", "class_id"))
    first = found.where("doc_id = class_id").select(F.col("doc_id").alias("id")).distinct()
    out = docs.select(packed(docs), F.col("doc_id").alias("id"), row_key(*docs.columns).alias("key")).join(first, "id", "left_semi")
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.groupBy("id").agg(F.min_by("d", "key").alias("d"))
    return out.select("d.*").unionByName(docs.where("doc_id IS NULL"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized(cut(classes(table(spark, sf_dir, "documents"))))


def sized(found: DataFrame) -> DataFrame:
    """One row per document with the size of its class; rows of the null class (see :func:`classes`) count together and all stay."""
    sizes = cut(found.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")))
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull())
    return even(found, sizes, "class_id", sizes.withColumnRenamed("class_size", "n")).select("doc_id", "class_id", "class_size", "rep_id", kept.alias("kept"))
