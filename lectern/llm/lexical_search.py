"""Ranked lexical search over an index of compressed posting blocks, by Block-Max WAND.

The index is cut by documents into segments, each built by one task from texts that it reads anyway, so no term is gathered
anywhere and a term that every text holds costs each segment its share. A list of a term in a segment has blocks of ``BLOCK`` postings, packed on
their own, and beside them each block's first and last document and its largest impact. A query looks at those alone first (a shallow move): only
blocks that can lift a document to the k-th best score so far are unpacked.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, cut, delete, shared_folder, table

#: Terms: runs of ASCII letters and digits and of all other characters beyond ASCII; as bytes of lower-cased UTF-8 too.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Postings of a block; documents and postings after which a task closes a segment; bytes of a text above which its terms are not listed at once.
BLOCK, SEGMENT_DOCS, SEGMENT_POSTINGS, LONG = 128, 1 << 15, 1 << 21, 16 << 20
#: Queries, and bytes of their texts, that are searched for at a time, on average.
QUERIES, QUERY_BYTES = 4096, 8 << 20
#: Runs of documents that a query looks at first; each next lot is so many times as large.
FIRST, GROWTH = 4, 4
#: Fixed values of the score.
SCALE, PER_TF, PER_M = 1_000_000_000, 1000, 8

INDEX = "segment string, term binary, df int, firsts binary, lasts binary, most binary, ends binary, payload binary"
WIDTHS = (np.uint8, np.uint16, np.uint32)


def terms_of(text: bytes) -> Counter:
    """Terms of a text with their occurrences; ``bytes.lower`` changes A-Z only."""
    text = text.lower()
    return Counter(TERM_BYTES.findall(text) if len(text) <= LONG else map(methodcaller("group"), TERM_BYTES.finditer(text)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (PER_TF * tf + PER_M * m)


def norms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """A document's length against the mean, in hundredths as the score takes it: 25 + 75 n N / L, rounded as the score rounds it."""
    return 100 - 75 + (75 * n * n_docs) // total


class Segment:
    """Postings of some documents while they are gathered."""

    def __init__(self, n_docs: int, total: int):
        self.n_docs, self.total = n_docs, total
        self.ids: dict[bytes, int] = {}
        self.codes, self.tfs, self.lengths, self.sizes = array("I"), array("I"), array("q"), array("q")
        self.docs: list[int | None] = []

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = terms_of(text or b"")
        if not found:
            return
        ids = self.ids
        self.codes.extend([ids.setdefault(t, len(ids)) for t in found])
        self.tfs.extend(found.values())
        self.docs.append(doc_id)
        self.sizes.append(len(found))
        self.lengths.append(found.total())

    def full(self) -> bool:
        return len(self.docs) >= SEGMENT_DOCS or len(self.codes) >= SEGMENT_POSTINGS

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        """A row with the ids and lengths of the documents, numbered by id with those without one last, then a row for each term."""
        none = np.array([d is None for d in self.docs])
        docs = np.array([0 if d is None else d for d in self.docs], np.int64)
        lengths = np.frombuffer(self.lengths, np.int64)
        order = np.lexsort((docs, none))
        number = np.empty(len(docs), np.int64)
        number[order] = np.arange(len(docs))
        ords = np.repeat(number, np.frombuffer(self.sizes, np.int64))
        code, tf = np.frombuffer(self.codes, np.uint32), np.frombuffer(self.tfs, np.uint32).astype(np.int64)
        by = np.lexsort((ords, code))
        code, ords, tf = code[by], ords[by], tf[by]
        impact = impacts(tf, norms(lengths[order], self.n_docs, self.total)[ords])
        starts = np.searchsorted(code, np.arange(len(self.ids) + 1))
        df = np.diff(starts)
        per = -(-df // BLOCK)
        term_of = np.repeat(np.arange(len(df)), per)
        at = np.arange(len(term_of)) - np.repeat(np.cumsum(per) - per, per)
        begin = starts[:-1][term_of] + at * BLOCK
        end = np.minimum(begin + BLOCK, starts[1:][term_of])
        # Gaps to the posting before, and within a block's first place to nothing: its first document stands beside the block.
        gap = np.diff(ords, prepend=0)
        gap[begin] = 0
        firsts, lasts, most = ords[begin].astype(np.int32), ords[end - 1].astype(np.int32), np.maximum.reduceat(impact, begin)
        widths = [np.searchsorted([1 << 8, 1 << 16], np.maximum.reduceat(x, begin), side="right") for x in (gap, tf)]
        whole = [[x.astype(w).tobytes() for w in WIDTHS] for x in (gap, tf)]
        blocks, sizes = [], np.empty(len(begin), np.int32)
        for k, (a, b, g, t) in enumerate(zip(begin.tolist(), end.tolist(), widths[0].tolist(), widths[1].tolist(), strict=True)):
            block = bytes((g << 2 | t,)) + whole[0][g][a << g : b << g] + whole[1][t][a << t : b << t]
            blocks.append(block)
            sizes[k] = len(block)
        bound = np.cumsum(per).tolist()
        words = list(self.ids)
        yield batch([(name, None, len(docs), np.frombuffer(none[order].tobytes(), np.uint8).tobytes(), b"", lengths[order].tobytes(), b"", docs[order].tobytes())])
        rows, size, a = [], 0, 0
        for k, b in enumerate(bound):
            rows.append((name, words[k], int(df[k]), firsts[a:b].tobytes(), lasts[a:b].tobytes(), most[a:b].tobytes(), np.cumsum(sizes[a:b], dtype=np.int32).tobytes(), b"".join(blocks[a:b])))
            size += len(rows[-1][-1])
            a = b
            if len(rows) == 1 << 13 or size > 4 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])


@dataclass(frozen=True)
class Index:
    """Segments in the folder ``path``, of ``n_docs`` documents that have a term, with ``total`` terms."""

    path: str
    n_docs: int
    total: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(INDEX).parquet(f"{self.path}/postings")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(path, *spark.read.parquet(f"{path}/totals").select("n_docs", "total").first())


def build(docs: DataFrame, path: str) -> Index:
    """Index the ``doc_id`` and ``text`` of every row of ``docs`` in the folder ``path``, which all executors share.

    A null text has no term. Each row is a document of its own, also one whose id is null or repeated. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM))
    totals = docs.select(n.cast("long").alias("n")).agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    totals.write.parquet(f"{path}/totals")
    index = Index.open(spark, path)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, k, segment = TaskContext.get().partitionId(), 0, Segment(index.n_docs, index.total)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                segment.add(doc_id, text.as_py())
                if segment.full():
                    yield from segment.rows(f"{name}-{k}")
                    k, segment = k + 1, Segment(index.n_docs, index.total)
        if segment.docs:
            yield from segment.rows(f"{name}-{k}")

    docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(segments, INDEX).write.parquet(f"{path}/postings")
    return index


class Postings:
    """One list of a segment. Blocks are unpacked when they are asked for, and then kept for the segment's other queries."""

    def __init__(self, row: dict, m: np.ndarray):
        self.firsts, self.lasts, self.ends = (np.frombuffer(row[c], np.int32) for c in ("firsts", "lasts", "ends"))
        self.most, self.payload, self.df, self.m = np.frombuffer(row["most"], np.int64), row["payload"], row["df"], m
        self.top = int(self.most.max())
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shallow(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the block that may hold it, and the largest impact that it can have there; none is unpacked."""
        at = np.searchsorted(self.lasts, docs)
        there = np.minimum(at, len(self.lasts) - 1)
        return there, np.where((at < len(self.lasts)) & (self.firsts[there] <= docs), self.most[there], 0)

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.unpacked:
            n = min(BLOCK, self.df - k * BLOCK)
            at = int(self.ends[k - 1]) if k else 0
            g, t = divmod(self.payload[at], 4)
            gaps = np.frombuffer(self.payload, WIDTHS[g], n, at + 1).astype(np.int64)
            tf = np.frombuffer(self.payload, WIDTHS[t], n, at + 1 + (n << g)).astype(np.int64)
            docs = np.cumsum(gaps) + int(self.firsts[k])
            self.unpacked[k] = docs, impacts(tf, self.m[docs])
        return self.unpacked[k]

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(k) for k in which.tolist()]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def add(self, weight: int, docs: np.ndarray, seen: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> None:
        """Add the weighted impacts at ``docs``, in order, of which a shallow move has ``seen`` the blocks."""
        which = np.unique(seen[0][seen[1] > 0])
        if len(which):
            found, impact = self.blocks(which)
            inside = docs[np.minimum(np.searchsorted(docs, found), len(docs) - 1)] == found
            scores[found[inside]] += weight * impact[inside]


def best(lists: list[tuple[int, Postings]], k: int, scores: np.ndarray) -> list[tuple[int, int]]:
    """The ``k`` highest ``(score, document)`` above 0 of a query's weighted lists; of equal scores the earlier documents. ``scores`` is all 0, before and after.

    The best block of the list that reaches highest gives a first k-th best score. Then documents are looked at in runs over which no list
    changes its block. Runs go from the highest bound down, in growing lots, until no bound reaches the k-th best score; in a lot only documents of lists
    that are needed to reach it are pivots, and the blocks of the other lists are unpacked only where a pivot's bound reaches it.
    """
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0] * x[1].top)
    if not lists:
        return []
    reach = np.cumsum([w * p.top for w, p in lists])
    starts = np.unique(np.concatenate([x for _, p in lists for x in (p.firsts, p.lasts + 1)]))
    bounds = np.zeros(len(starts), np.int64)
    for w, p in lists:
        bounds += w * p.shallow(starts)[1]
    order = np.argsort(-bounds, kind="stable")
    kept: list[tuple[int, int]] = []

    def keep(docs: np.ndarray, kept: list[tuple[int, int]], least: int) -> tuple[list[tuple[int, int]], int]:
        found = scores[docs]
        good = np.flatnonzero(found >= max(least, 1))
        if len(good) > k:
            good = good[np.argsort(-found[good], kind="stable")[:k]]
        kept = sorted({*kept, *zip((-found[good]).tolist(), docs[good].tolist(), strict=True)})[:k]
        return kept, -kept[-1][0] if len(kept) == k else 0

    _, high = lists[-1]
    pivots = high.block(int(high.most.argmax()))[0]
    for w, p in lists:
        p.add(w, pivots, p.shallow(pivots), scores)
    kept, least = keep(pivots, kept, 0)
    scores[pivots] = 0
    at, lot = 0, FIRST
    while at < len(order):
        runs = order[at : at + lot]
        runs = runs[bounds[runs] >= max(least, 1)]
        if not len(runs):
            break
        at, lot = at + lot, lot * GROWTH
        mine = np.zeros(len(starts), bool)
        mine[runs] = True
        needed = int(np.searchsorted(reach, least))  # the lists before it reach less than the k-th best score together
        touched = []
        for w, p in lists[needed:]:
            which, top = p.shallow(starts[runs])
            which = np.unique(which[top > 0])
            if len(which):
                docs, impact = p.blocks(which)
                inside = mine[np.searchsorted(starts, docs, side="right") - 1]
                scores[docs[inside]] += w * impact[inside]
                touched.append(docs[inside])
        if not touched:
            continue
        pivots = np.unique(np.concatenate(touched))
        everything = pivots
        if needed:
            most = scores[pivots]
            seen = [p.shallow(pivots) for _, p in lists[:needed]]
            for (w, _), (_, top) in zip(lists, seen, strict=False):
                most = most + w * top
            live = most >= least
            pivots = pivots[live]
            for (w, p), (which, top) in zip(lists, seen, strict=False):
                p.add(w, pivots, (which[live], top[live]), scores)
        kept, least = keep(pivots, kept, least)
        scores[everything] = 0
    return [(-s, d) for s, d in kept]


def search(index: Index, items: DataFrame, k: int = 10, id: str = "item_id") -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``(id, rank, doc_id, score)`` with scores above 0.

    ``items`` has the columns ``id`` and ``text``. The distinct texts of one id, also of a null one, are one query together; items without a term
    that the index has get no row. Equal scores go by ascending ``doc_id``, null last. Items are searched for in blocks of a bounded size, one after another.
    """
    spark = items.sparkSession
    bound_batches(spark)
    texts = items.groupBy(F.col(f"`{id}`").alias("item")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("text"))
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_blocks = max(1, math.ceil(size.n / QUERIES), math.ceil((size.bytes or 0) / QUERY_BYTES)) if index.n_docs else 0
    out = spark.createDataFrame([], f"item {items.schema[id].dataType.simpleString()}, doc_id long, score long")
    for block in range(n_blocks):
        found = searched(index, texts.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block), k)
        out = out if found is None else out.unionByName(found)
    # Spark keeps the k first of each item in every task before it shuffles.
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(id), "rank", "doc_id", "score")


def searched(index: Index, texts: DataFrame, k: int) -> DataFrame | None:
    """Each segment's ``k`` best documents of each item of one block of queries."""
    spark = texts.sparkSession
    asked = [(r.item, terms_of(bytes(r.text))) for r in texts.select("item", F.col("text").cast("binary").alias("text")).collect()]
    words = sorted({t for _, q in asked for t in q})
    if not words:
        return None
    postings = index.read(spark)
    wanted = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in words], "term binary"))
    known = postings.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = {bytes(r.term): math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1))) for r in known}
    queries = spark.sparkContext.broadcast([[(t, weight[t] * n) for t, n in q.items() if t in weight] for _, q in asked])
    schema = "query long, doc_id long, score long"

    def per_segment(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        head = next(r for r in rows if r["term"] is None)
        docs, none = np.frombuffer(head["payload"], np.int64), np.frombuffer(head["firsts"], np.uint8)
        m = norms(np.frombuffer(head["most"], np.int64), index.n_docs, index.total)
        lists = {r["term"]: Postings(r, m) for r in rows if r["term"] is not None}
        scores, out = np.zeros(len(docs), np.int64), []
        for q, terms in enumerate(queries.value):
            found = best([(w, lists[t]) for t, w in terms if t in lists], k, scores)
            out += [(q, None if none[d] else int(docs[d]), s) for s, d in found]
        columns = zip(*out, strict=True) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    # Lists of the query's terms, and each segment's documents; what meets in a task is one segment, of a bounded size.
    lists = postings.join(wanted.withColumn("asked", F.lit(True)), "term", "left").where("asked OR term IS NULL").select(*[c.split()[0] for c in INDEX.split(", ")])
    found = lists.groupBy("segment").applyInArrow(per_segment, schema)
    kind = texts.schema["item"].dataType.simpleString()
    items = F.broadcast(spark.createDataFrame([(q, item) for q, (item, _) in enumerate(asked)], f"query long, item {kind}"))
    return found.join(items, "query").select("item", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index goes once the ranks, at most ten rows an item, are written."""
    path = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    index = build(table(spark, sf_dir, "documents"), path)
    out = cut(search(index, table(spark, sf_dir, "benchmark")))
    delete(spark, path)
    return out


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
