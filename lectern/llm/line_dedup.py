"""Fuzzy deduplication of lines by MinHash of character shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, cut, even, packed, release, row_key, stored, table
from lectern.llm.linking import ROW_BITS, Sets, maybe, partition_buckets, presence, resolve
from lectern.llm.wordhash import LOWER, SPACE, mix, powers, utf8

NEWLINE, BLANK = 10, 32
#: Bytes of texts per block: its arrays stay in a processor's cache.
BLOCK = 1 << 17
NORMAL = np.where(SPACE, np.uint8(BLANK), LOWER).astype(np.uint8)
#: What each byte adds to a line's sum.
BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
#: Line hashes a task remembers, so as to sign a line that it saw before only once.
REMEMBERED = 1 << 18


@dataclass(frozen=True)
class Settings:
    #: Bytes of a shingle, similarity of a link, bands and rows: at 0.8 a pair shares a band with 0.9994.
    size: int = 8
    similarity: float = 0.8
    bands: int = 14
    rows: int = 4


class Lines:
    """Lines of a block of texts in normal form: A-Z in lower case, runs of white space as one blank, none at the ends.

    ``raw[ptr[k]:ptr[k + 1]]`` is line ``k``, of text ``text[k]`` with number ``number[k]`` and hash ``ids[k]``; blank lines are left out.
    :meth:`sums` are hashes that do not depend on ``ids``, to tell lines apart that share one.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        at = np.flatnonzero(SPACE.take(raw))
        # Text boundaries, as marks at the byte behind them.
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        is_newline = raw[at] == NEWLINE
        newlines = at[is_newline]
        dropped = at
        if len(at):
            # Runs of white space inside a text; one without a line feed and with text on both sides leaves one blank, at its last place.
            first = np.ones(len(at), bool)
            first[1:] = (at[1:] != at[:-1] + 1) | edge[at[1:]]
            start = np.flatnonzero(first)
            final = np.append(start[1:], len(at)) - 1
            broken = np.add.reduceat(is_newline, start) > 0 if len(newlines) else np.zeros(len(start), bool)
            inner = ~broken & ~edge[at[start]] & ~edge[at[final] + 1]
            away = np.ones(len(at), bool)
            away[final[inner]] = False
            dropped = at[away]
        self.raw = np.delete(NORMAL.take(raw), dropped)
        # A line runs from the start of its text, or behind a line feed, to the next line feed or the end of the text.
        per_text = np.diff(np.searchsorted(newlines, offsets)) + 1
        lines = int(per_text.sum())
        text = np.repeat(np.arange(len(per_text)), per_text)
        number = np.arange(lines) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        end = np.empty(lines, np.int64)
        final = np.cumsum(per_text) - 1
        inner_lines = np.ones(lines, bool)
        inner_lines[final] = False
        end[final], end[inner_lines] = offsets[1:], newlines
        kept = end - np.searchsorted(dropped, end)  # bytes kept before each line's end
        length = np.diff(kept, prepend=0)
        some = length > 0
        self.text, self.number = text[some], number[some]
        self.ptr = np.concatenate([[0], np.cumsum(length[some])])
        self.total, self.down = prefix(self.raw)
        a = self.ptr[:-1]
        self.ids = mix((self.total[self.ptr[1:]] - self.total[a]) * self.down[a] + length[some].astype(np.uint64)).view(np.int64)

    def sums(self) -> np.ndarray:
        total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE.take(self.raw))])
        return np.diff(total[self.ptr]).view(np.int64)

    def shingles(self, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` bytes of the lines chosen (in order), and pointers. A shorter line is one shingle."""
        length = np.diff(self.ptr)
        chosen = np.zeros(len(length), bool)
        chosen[which] = True
        short = length < size
        begin = np.repeat(chosen & ~short, length)
        tail = np.minimum(size - 1, length) * (chosen & ~short)
        gaps = np.repeat(self.ptr[1:] - tail, tail) + (np.arange(tail.sum()) - np.repeat(np.cumsum(tail) - tail, tail))
        begin[gaps] = False
        n = len(self.raw) - size + 1
        many = np.maximum(length - size + 1, 1)[chosen]
        ptr = np.concatenate([[0], np.cumsum(many)])
        whole = ((self.total[size:] - self.total[:n]) * self.down[:n])[begin[:n]] if n > 0 else np.zeros(0, np.uint64)
        if (short & chosen).any():
            k = np.flatnonzero(short & chosen)
            out = np.zeros(ptr[-1], np.uint64)
            alone = ptr[:-1][short[chosen]]
            rest = np.ones(len(out), bool)
            rest[alone] = False
            out[rest] = whole
            out[alone] = (self.total[self.ptr[1:][k]] - self.total[self.ptr[:-1][k]]) * self.down[self.ptr[:-1][k]]
            whole = out
        return mix(whole), ptr


def prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    part = raw.astype(np.uint64)
    part += np.uint64(1)
    part *= up[: len(raw)]
    np.cumsum(part, out=total[1:])
    return total, down


def lines(texts: pa.Array) -> Iterator[tuple[int, int, Lines]]:
    """Blocks of texts: first row, end row, lines."""
    raw, offsets = utf8(texts)
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        own = offsets[at : end + 1]
        yield at, end, Lines(raw[own[0] : own[-1]], own - own[0])
        at = end


def signatures(hashes: np.ndarray, ptr: np.ndarray, settings: Settings) -> np.ndarray:
    """One-permutation MinHash of each line, empty bins filled from bins that a fixed hash sequence picks: (lines, bins)."""
    bins = settings.bands * settings.rows
    count = len(ptr) - 1
    empty = np.uint32(0xFFFFFFFF)
    out = np.full(count * bins, empty)
    # Bin by the high bits, value by the low ones.
    slot = ((hashes >> np.uint64(40)).astype(np.uint32) * np.uint32(bins) >> np.uint32(24)).astype(np.int32)
    slot += np.repeat(np.arange(count, dtype=np.int32) * np.int32(bins), np.diff(ptr))
    np.minimum.at(out, slot, hashes.astype(np.uint32))
    out = out.reshape(count, bins)
    filled = out != empty
    filled[~filled.any(1), 0] = True  # a line whose only value is the empty mark itself
    full = out.copy()
    turn = np.uint64(1)
    line, slot = np.nonzero(~filled)
    while len(line):
        source = (mix(slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn) % np.uint64(bins)).astype(np.int64)
        good = filled[line, source]
        full[line[good], slot[good]] = out[line[good], source[good]]
        line, slot = line[~good], slot[~good]
        turn += np.uint64(1)
    return full


def band_keys(full: np.ndarray, settings: Settings) -> np.ndarray:
    rows = full.reshape(len(full), settings.bands, settings.rows)
    key = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64) + np.uint64(1), rows.shape[:2]).copy()
    for j in range(settings.rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, :, j].astype(np.uint64))
    return key.view(np.int64)


def signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, line_no, line_id, sum, keys`` of every line that is not blank, the keys packed; none for a line that its task signed lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64)
        for batch in batches:
            for first, _, found in lines(batch.column(1)):
                ids, at = np.unique(found.ids, return_index=True)
                new = ~np.isin(ids, known, assume_unique=True)
                known = np.concatenate([known if len(known) < REMEMBERED else known[:0], ids[new]])
                at = np.sort(at[new])
                keys = band_keys(signatures(*found.shingles(at, settings.size), settings), settings)
                size = np.zeros(len(found.ids), np.int64)
                size[at] = settings.bands * 8
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + found.text)), pa.array(found.number.astype(np.int32)), pa.array(found.ids), pa.array(found.sums()), packed],
                    ["doc_id", "line_no", "line_id", "sum", "keys"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line_no int, line_id long, sum long, keys binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def contents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, content``: the lines listed in ``ids``, each once.

    A filter of fixed size keeps most other lines from being shuffled, and a task sends a line that it sent lately only once; the join then is exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(presence(ids, F.col("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, found in lines(batch.column(0)):
                own, at = np.unique(found.ids, return_index=True)
                new = maybe(shared.value, own)
                new[new] = ~np.isin(own[new], sent, assume_unique=True)
                sent = np.concatenate([sent if len(sent) < REMEMBERED else sent[:0], own[new]])
                at = np.sort(at[new])
                length = np.diff(found.ptr)
                pick = np.zeros(len(length), bool)
                pick[at] = True
                raw = found.raw[np.repeat(pick, length)]
                ptr = np.concatenate([[0], np.cumsum(length[pick])]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ptr.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(found.ids[at]), packed], ["id", "content"])

    rows = docs.select("text").mapInArrow(run, "id long, content binary").join(ids, "id", "left_semi")
    return rows.groupBy("id").agg(F.first("content").alias("content"))


def compared(settings: Settings) -> Sets:
    """Exact Jaccard similarity of the lines' character shingles."""

    row = np.uint64(64 - ROW_BITS)

    def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Contents are lines in normal form, so each is its own only line. Keys of (line, shingle) are sorted a chunk of lines at a time.
        out, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, _, found in lines(column):
            hashes, ptr = found.shingles(np.arange(len(found.ids)), settings.size)
            hashes >>= np.uint64(ROW_BITS)
            for at in range(0, len(ptr) - 1, 1 << ROW_BITS):
                own = ptr[at : at + (1 << ROW_BITS) + 1]
                keys = (np.repeat(np.arange(len(own) - 1, dtype=np.uint64), np.diff(own)) << row) | hashes[own[0] : own[-1]]
                keys.sort()
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                keys = keys[new]
                sizes.append(np.bincount((keys >> row).astype(np.int64), minlength=len(own) - 1))
                out.append(keys & ((np.uint64(1) << row) - np.uint64(1)))
        return np.concatenate(out), np.cumsum(np.concatenate(sizes))

    return Sets(unpack, None, settings.similarity)


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Class of every line that is not blank: ``doc_id, line_no, line_id, class_id, kept``.

    Lines that agree but for the case of A-Z and white space are one node (``line_id``, a 64-bit hash). Should different lines share a
    hash, a second one tells them apart: all but those with the smallest are left alone, kept and in no class. Nodes are compared by character shingles: MinHash signatures, banding of high recall, exact Jaccard similarity of candidates, and
    components of the links. In each class the first line by (doc_id, line_no) is kept; a null ``doc_id`` sorts first.

    Blank lines have no row and are always kept in a text. Null and empty texts have no lines; a line shorter than a shingle
    links only to its equals; of repeated rows with equal ids each line's row is marked alike; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    signs = stored(signed(docs, settings))
    spots = signs.drop("keys")
    hot = partition_buckets(signs.select(F.col("line_id").alias("id"), "keys"), signs.count() * settings.bands)
    labels = None
    if not hot.isEmpty():
        ids = cut(hot.select("id").distinct())
        texts = stored(contents(docs, ids))
        labels = resolve(hot, texts, compared(settings))
        release(ids, texts)
    release(hot)
    # Each node's first line, then each class's: aggregations with map-side combine, so a line in every document is no hot spot.
    nodes = spots.groupBy("line_id").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("sum", "doc_id", "line_no")).alias("least"), F.max("sum").alias("most"))
    nodes = nodes.select("line_id", "copies", F.struct("least.doc_id", "least.line_no").alias("first"), F.when(F.col("least.sum") < F.col("most"), F.col("least.sum")).alias("own"))
    if labels is None:
        listed = nodes.where("copies > 1").select(F.col("line_id").alias("node"), F.col("line_id").alias("class"), "first", "own")
    else:
        named = nodes.join(labels.select(F.col("id").alias("line_id"), "label"), "line_id", "left").where("copies > 1 OR label IS NOT NULL")
        named = stored(named.select(F.col("line_id").alias("node"), F.coalesce("label", "line_id").alias("class"), "first", "own"))
        firsts = cut(named.groupBy("class").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")))
        listed = even(named.drop("first"), firsts.drop("n"), "class", firsts.select("class", "n"))
    # A line that is alone is its own class; the others meet theirs by an equi-join, which adaptive execution splits at a frequent line.
    is_first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no"))
    stranger = F.coalesce(F.col("own") != F.col("sum"), F.lit(False))
    of = F.when(stranger, F.xxhash64("line_id", "sum")).otherwise(F.coalesce("class", "line_id"))
    return spots.join(listed, F.col("node") == F.col("line_id"), "left").select("doc_id", "line_no", "line_id", of.alias("class_id"), (F.col("node").isNull() | stranger | is_first).alias("kept"))


def clean(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``text`` less the lines that an earlier line's class has already; other columns pass through, whatever their names.

    Rows are told apart by all their values, so rows with one id, or without one, each lose their own lines only; of rows with one id the order is
    that of a hash of the row. Rows equal in all values are cleaned alike. A null text stays null.
    """
    rows = docs.select(packed(docs), row_key(*docs.columns).alias("row"))
    named = rows.select(F.struct(F.col("d.doc_id").alias("id"), "row").alias("doc_id"), F.col("d.text").alias("text"))
    dropped = classes(named, settings).where("NOT kept").groupBy(F.col("doc_id.row").alias("row")).agg(F.collect_set("line_no").alias("lines"))
    left = F.filter(F.transform(F.split("d.text", "\n"), lambda line, k: F.when(~F.array_contains("lines", k), line)), lambda line: line.isNotNull())
    text = F.when(F.col("lines").isNull(), F.col("d.text")).otherwise(F.array_join(left, "\n"))
    return rows.join(dropped, "row", "left").select(F.col("d").withField("text", text).alias("d")).select("d.*")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
