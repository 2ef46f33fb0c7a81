"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, table
from lectern.llm.sample import fold, labelled, rows_of
from lectern.llm.wordhash import LOWER, SPACE, Words, blocks, mix

#: Labelled documents that are compared with every text, at most; each is ``RANK`` floats in the broadcast.
SAMPLE = 4096
#: Terms: hashed byte trigrams, then word-level marks of style. Dimensions of the latent space. Neighbours.
GRAMS, RANK, NEIGHBOURS = 4096, 64, 25
MARKS = 11
#: Weight of the block of style marks beside that of the trigrams (each block has unit length).
STYLE = 1.5

_kinds = np.zeros(256, np.int64)  # 0 letters and other bytes, 1 upper case, 2 digit, 3 sentence mark, 4 symbol, 5 white space
_kinds[65:91] = 1
_kinds[48:58] = 2
_kinds[[ord(c) for c in ".,;:?'\"()-"]] = 3
_kinds[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_kinds[SPACE] = 5


def terms(words: Words) -> np.ndarray:
    """Term weights of each text of a block, in order: trigram block and style block, each of unit length.

    Counts cover the whole text. The style marks are shares: of kinds of bytes, of words that repeat the
    word before, of words seen before in the text, of short, long and capital words, and of very short lines and texts.
    """
    raw, offsets = words.raw, words.offsets
    texts = len(offsets) - 1
    size = np.diff(offsets)
    of = np.repeat(np.arange(texts), size)
    low = LOWER[raw].astype(np.uint64)
    out = np.zeros((texts, GRAMS + MARKS), np.float32)
    if len(raw) >= 3:
        gram = mix((low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:])
        inside = of[:-2] == of[2:]
        slot = of[:-2] * GRAMS + (gram & np.uint64(GRAMS - 1)).astype(np.int64)
        counts = np.bincount(slot[inside], minlength=texts * GRAMS).reshape(texts, GRAMS)
        np.log1p(counts, out=out[:, :GRAMS], casting="same_kind", dtype=np.float32)
    some = np.maximum(size, 1)
    kinds = np.bincount(of * 6 + _kinds[raw], minlength=texts * 6).reshape(texts, 6) / some[:, None]
    counts = words.counts
    many = np.maximum(counts, 1)
    text = words.text_of_word
    again = np.zeros(len(text))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((words.hash, text))
    seen = np.zeros(len(text))
    seen[order[1:]] = (words.hash[order[1:]] == words.hash[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    # Pairs of words seen before: what a text repeats beyond its common words.
    pair = mix(words.hash[:-1] * np.uint64(3) + words.hash[1:]) if len(text) > 1 else np.zeros(0, np.uint64)
    of_pair = text[:-1]
    order = np.lexsort((pair, of_pair))
    twice = np.zeros(len(pair))
    twice[order[1:]] = (pair[order[1:]] == pair[order[:-1]]) & (of_pair[order[1:]] == of_pair[order[:-1]])
    length = words.ends - words.starts
    style = out[:, GRAMS:]
    style[:, 0] = kinds[:, 1] * 2
    style[:, 1] = kinds[:, 2] * 2
    style[:, 2] = kinds[:, 3]
    style[:, 3] = kinds[:, 4] * 4
    style[:, 4] = np.bincount(text, again, texts) / many * 2
    style[:, 5] = np.bincount(text, seen, texts) / many
    style[:, 6] = np.bincount(of_pair, twice, texts) / many * 2
    style[:, 7] = np.bincount(text, (length <= 2), texts) / many
    style[:, 8] = np.bincount(text, (length > 20), texts) / many * 2
    style[:, 9] = 0.5
    style[:, 10] = np.minimum(1.0, 20 / (counts + 1)) * 0.5
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    base: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled x rank, unit length
    labels: np.ndarray
    prior: float


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = x.copy()
    x[:, :GRAMS] *= idf
    for block, weight in ((x[:, :GRAMS], 1.0), (x[:, GRAMS:], STYLE)):
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9) / weight
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model:
    """TF-IDF of the sampled labelled documents, a truncated SVD (randomised, fixed seed), and their latent vectors."""
    ids, y = labelled(labels, "quality", 4, 2, sample)
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(rows_of(shared.value, batch.column(0))))
            out = [x.astype(np.float16).tobytes() for _, _, words in blocks(batch.column(1)) for x in terms(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "terms"])

    found = {}
    if len(ids):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, "doc_id long, terms binary")
        found = {r.doc_id: np.frombuffer(r.terms, np.float16) for r in rows.toLocalIterator()}
    keep = np.array([i in found for i in ids.tolist()], bool)
    if not keep.any():
        return Model(np.ones(GRAMS, np.float32), np.zeros((GRAMS + MARKS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    y = y[keep]
    x = np.stack([found[i] for i in ids[keep].tolist()]).astype(np.float32)
    idf = (1 + np.log((1 + len(x)) / (1 + (x[:, :GRAMS] > 0).sum(0)))).astype(np.float32)
    x = weigh(x, idf)
    random = np.random.default_rng(seed)
    basis = x.T @ random.standard_normal((len(x), RANK + 16)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ np.linalg.qr(basis)[0]))
    _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
    base = (basis @ v.T)[:, :RANK].astype(np.float32)
    return Model(idf, base, unit(x @ base).astype(np.float32), y, float(y.mean()))


def vote(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors; every cosine is computed exactly."""
    if not len(model.labels):
        return np.full(len(vectors), model.prior)
    near = min(NEIGHBOURS, len(model.labels))
    cosine = vectors @ model.vectors.T
    at = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
    # A steep power: a neighbour at 0.95 counts for far more than one at 0.6.
    weight = np.maximum(np.take_along_axis(cosine, at, 1), 1e-3) ** 16
    return (weight * model.labels[at]).sum(1) / weight.sum(1)


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``doc_id, columns`` and the score of every document, from its whole text, in blocks of texts by all labelled vectors."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = tuple(c for c in columns if c != "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [vote(unit(weigh(terms(words), model.idf) @ model.base), model) for _, _, words in blocks(batch.column("text"))]
            scores = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
            own = ["doc_id", *columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(np.clip(scores, 0, 1))], [*own, name])

    schema = docs.select("doc_id", *columns, F.lit(0.0).alias(name)).schema
    return docs.select("doc_id", "text", *(c for c in columns if c != "text")).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """Quality of every document: ``doc_id, held_out, score, predicted`` and ``columns``.

    A bounded sample of labelled rows outside the held-out fold (crc32 of the id mod 4 = 2) is mapped
    into a latent-semantic space and broadcast; each document is compared with all of it.

    Null and empty texts are compared by their style marks alone; a null id is not held out; without usable labels
    every score is 0.5; repeated rows score alike; an empty table gives no rows.
    """
    scored = score(docs, fit(docs, labels, sample), columns)
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *columns)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is 0.7 or more, with all their columns in order."""
    bound_batches(docs.sparkSession)
    name = "quality_score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    scored = score(docs, fit(docs, labels), tuple(docs.columns), name)
    return scored.where(F.col(name) >= 0.7).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
