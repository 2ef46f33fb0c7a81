"""From band keys to classes: candidate links without emitting all pairs of a bucket, and their components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, cut, even, release, stored
from lectern.llm.wordhash import mix, utf8

#: Bits of the presence filter for each id, and its words of 64 bits at least and at most: 512 KB and 32 MB.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 22
#: Most rows and bytes, on average, of a block's queries and of the members they are compared with.
QUERIES, MEMBERS = 512, 4096
QUERY_BYTES, MEMBER_BYTES = 2 << 20, 8 << 20
#: Rows of a partition that wait to be grouped by key; keys of a partition, on average and at most.
HELD, DEALT_TO = 4_000_000, 2_000_000
#: Pairs that a task deals to partitions at a time.
DEALT = 1_000_000
#: Elements that a matrix of a block spans at a time.
SPAN = 2048
#: Bits that number the rows of a chunk, above the bits of an element; elements of a chunk of pairs.
ROW_BITS = 12
PAIR_ELEMENTS = 1 << 21


@dataclass(frozen=True)
class Sets:
    """How rows are compared: ``unpack`` turns a content column into each row's sorted distinct elements, one after another, and
    pointers to them; ``weigh`` weighs elements. Elements that all weigh 1 have at most 64 - ``ROW_BITS`` bits."""

    unpack: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    weigh: Callable[[np.ndarray], np.ndarray] | None  # None: all weigh 1
    similarity: float

    def weights(self, elements: np.ndarray) -> np.ndarray:
        return np.ones(len(elements), np.float32) if self.weigh is None else self.weigh(elements)


def presence(ids: DataFrame, spot: Column | None = None) -> np.ndarray:
    """A filter of bounded size that says for every row of ``ids`` that its ``spot`` may be there: a distributed bit-or.

    ``spot`` is a well-mixed long, by default xxhash64 of ``id``. The filter's size follows the number of rows, so that few others pass, up to a
    bound; beyond that more pass, which costs a shuffle and no result.
    """
    spot = F.xxhash64("id") if spot is None else spot
    words = min(max(FILTER_LEAST, 1 << (ids.count() * FILTER_BITS // 64).bit_length()), FILTER_MOST)
    low = spot.bitwiseAND(words * 64 - 1)
    bits = ids.select(F.shiftright(low, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int")).alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    present = np.zeros(words, np.uint64)
    present[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return present


def maybe(present: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which ``spots`` the filter may have."""
    at = spots & (len(present) * 64 - 1)
    return (present[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def buckets(members: DataFrame) -> DataFrame:
    """``key, id, pivot, other`` of the ``(key, id)`` whose key has several members; the pivot is the smallest id, ``other`` one that a hash picks."""
    ends = members.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.min_by("id", F.xxhash64("id", "key")).alias("other"), F.count(F.lit(1)).alias("n"))
    ends = cut(ends.where("pivot < last").drop("last"))
    out = cut(even(members, ends.drop("n"), "key", ends.select("key", "n")))
    release(ends)
    return out


def partition_buckets(signed: DataFrame, n_keys: int = 0) -> DataFrame:
    """As :func:`buckets`, for very many keys: ``signed`` has ``id, keys``, the packed 64-bit keys of each row, ``n_keys`` in all at most.

    Keys are dealt to partitions in Python and travel as packed pairs, a row for each piece and partition, so the shuffle moves bytes
    and not a row a key. Each partition's pairs are then sorted by numpy. When the pairs held pass ``HELD``, members of keys met more than
    once are sent on, and each key keeps its smallest id only; if a later row has a smaller one still, the old pivot is sent as its
    member, so members stay joined through pivots. Memory is in proportion to a partition's keys, whose number the number of partitions bounds,
    and not to the rows of any key.
    """
    parts = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // DEALT_TO))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        rows = 0

        def piece() -> pa.RecordBatch:
            pairs = np.concatenate(waiting)
            part = ((mix(pairs[:, 0].view(np.uint64)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            pairs = pairs[np.argsort(part, kind="stable")]
            size = np.bincount(part, minlength=parts)
            some = np.flatnonzero(size)
            ends = np.cumsum(size[some])
            return pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([pairs[end - n : end].tobytes() for n, end in zip(size[some], ends, strict=True)], pa.binary())], ["part", "pairs"]
            )

        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            keys = np.frombuffer(raw[offsets[0] : offsets[-1]].tobytes(), np.int64)
            waiting.append(np.stack([keys, np.repeat(batch.column(0).to_numpy(), np.diff(offsets) // 8)], 1))
            rows += len(keys)
            if rows > DEALT:
                yield piece()
                waiting, rows = [], 0
        if rows:
            yield piece()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # keys, ids, whether sent on before
        rows = 0

        def settle() -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]:
            keys, ids, sent = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((~sent, ids, keys))
            keys, ids, sent = keys[order], ids[order], sent[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            keys, ids, sent = keys[new], ids[new], sent[new]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(keys)))
            pivot = np.repeat(ids[start], size)
            # A pivot that was sent and stays the smallest need not be sent again.
            out = np.repeat(size > 1, size) & ~(sent & (ids == pivot))
            batch = pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(ids[out]), pa.array(pivot[out])], ["key", "id", "pivot"])
            return batch, (keys[start], ids[start], (size > 1) | sent[start])

        for batch in batches:
            for x in batch.column(0):
                pairs = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2)
                held.append((pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), bool)))
                rows += len(pairs)
                if rows > HELD:
                    out, kept = settle()
                    yield out
                    held, rows = [kept], min(len(kept[0]), HELD // 2)
        if held:
            yield settle()[0]

    dealt = signed.select("id", "keys").mapInArrow(deal, "part int, pairs binary")
    return stored(dealt.repartitionById(parts, F.col("part")).select("pairs").mapInArrow(run, "key long, id long, pivot long"))


def similar(a: np.ndarray, b: np.ndarray, sets: Sets) -> bool:
    """Weighted Jaccard similarity of two sets of elements against the threshold; two empty sets are equal."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = large.searchsorted(small)
    hit = large.take(at, mode="clip") == small
    if sets.weigh is None:
        common = int(hit.sum())
        return common >= sets.similarity * (len(a) + len(b) - common)
    common = sets.weigh(small[hit]).sum()
    return bool(common >= sets.similarity * (sets.weigh(a).sum() + sets.weigh(b).sum() - common))


def ragged(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of ``rows``, and the number in ``rows`` of the row that each belongs to."""
    size = ptr[rows + 1] - ptr[rows]
    of = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(of)) + np.repeat(ptr[rows] - (np.cumsum(size) - size), size), of


def similar_pairs(a: tuple[np.ndarray, np.ndarray], i: np.ndarray, b: tuple[np.ndarray, np.ndarray], j: np.ndarray, sets: Sets) -> np.ndarray:
    """For each k whether row ``i[k]`` of ``a`` is similar to row ``j[k]`` of ``b``; both are elements and pointers.

    Without weights a chunk of pairs is compared at once: what occurs twice among its sorted (pair, element) keys is common.
    """
    (all_a, ptr_a), (all_b, ptr_b) = a, b
    if sets.weigh is not None:
        return np.array([similar(all_a[ptr_a[x] : ptr_a[x + 1]], all_b[ptr_b[y] : ptr_b[y + 1]], sets) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
    out = np.zeros(len(i), bool)
    size_a, size_b = ptr_a[i + 1] - ptr_a[i], ptr_b[j + 1] - ptr_b[j]
    upto = np.cumsum(size_a + size_b)
    at = 0
    while at < len(i):
        done = upto[at - 1] if at else 0
        end = max(at + 1, min(at + (1 << ROW_BITS), int(np.searchsorted(upto, done + PAIR_ELEMENTS, "right"))))
        keys = []
        for elements, ptr, rows in ((all_a, ptr_a, i), (all_b, ptr_b, j)):
            place, of = ragged(ptr, rows[at:end])
            keys.append((of.astype(np.uint64) << np.uint64(64 - ROW_BITS)) | elements[place])
        both = np.concatenate(keys)
        both.sort()
        twice = both[1:][both[1:] == both[:-1]] >> np.uint64(64 - ROW_BITS)
        common = np.bincount(twice.astype(np.int64), minlength=end - at)
        out[at:end] = common >= sets.similarity * (size_a[at:end] + size_b[at:end] - common)
        at = end
    return out


def verify(pairs: DataFrame, texts: DataFrame, sets: Sets) -> DataFrame:
    """The pairs ``(a, b)`` that are similar. Both joins are plain equi-joins on an id, so adaptive execution splits a pivot with many partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            good = similar_pairs(sets.unpack(batch.column(2)), rows, sets.unpack(batch.column(3)), rows, sets)
            yield batch.select([0, 1]).filter(pa.array(good))

    left, right = texts.select(F.col("id").alias("a"), F.col("content").alias("x")), texts.select(F.col("id").alias("b"), F.col("content").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_links(queries: list[np.ndarray], members: list[np.ndarray], sets: Sets) -> np.ndarray:
    """Which query is similar to which member: products of weighted incidence matrices over the elements that both sides have."""
    of_q, of_m = np.repeat(np.arange(len(queries)), [len(x) for x in queries]), np.repeat(np.arange(len(members)), [len(x) for x in members])
    all_q, all_m = np.concatenate(queries), np.concatenate(members)
    size_q = np.bincount(of_q, sets.weights(all_q), len(queries))
    size_m = np.bincount(of_m, sets.weights(all_m), len(members))
    shared = np.intersect1d(all_q, all_m)
    common = np.zeros((len(queries), len(members)), np.float32)
    for at in range(0, len(shared), SPAN):
        own = shared[at : at + SPAN]
        sides = []
        for elements, of, count in ((all_q, of_q, len(queries)), (all_m, of_m, len(members))):
            where = np.searchsorted(own, elements)
            where[where == len(own)] = 0
            hit = own[where] == elements
            matrix = np.zeros((count, len(own)), np.float32)
            matrix[of[hit], where[hit]] = 1
            sides.append(matrix)
        common += (sides[0] * sets.weights(own).astype(np.float32)) @ sides[1].T
    # Sums in single precision may differ in the last digits: what is that near is compared exactly.
    union = size_q[:, None] + size_m - common
    link = (common >= (sets.similarity + 1e-4) * union) & (union > 0)
    for i, j in zip(*np.nonzero(~link & (common >= (sets.similarity - 1e-4) * union)), strict=True):
        link[i, j] = similar(queries[i], members[j], sets)
    return link


def compare_blocks(mixed: DataFrame, texts: DataFrame, sets: Sets) -> DataFrame:
    """Links ``(a, b)`` that join different components of a bucket, every such pair of ``(key, id, label)`` being compared.

    In each bucket the rows outside its largest component are queries. They meet all rows of the bucket in blocks of
    bounded rows and bytes; a block compares its pairs by matrix products and returns for each query one link into each
    other component, so pairs are never rows, and no task holds more than a block.
    """
    sized = mixed.join(texts.select("id", F.octet_length("content").alias("bytes")), "id")
    sizes = sized.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    total = cut(sizes.groupBy("key").agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "label")).alias("most")))
    placed = even(mixed, total.select("key", "rows", "bytes", "most", F.col("most.label").alias("main")), "key", total.select("key", F.col("rows").alias("n")))
    wide = F.ceil(F.greatest(F.col("rows") / MEMBERS, F.col("bytes") / MEMBER_BYTES, F.lit(1.0)))
    high = F.ceil(F.greatest((F.col("rows") - F.col("most.n")) / QUERIES, (F.col("bytes") - F.col("most.bytes")) / QUERY_BYTES, F.lit(1.0)))
    blocks_ = placed.select("key", "id", "label", "main", wide.cast("int").alias("wide"), high.cast("int").alias("high"))
    spot = F.xxhash64("id", "key")
    is_query = F.col("label") != F.col("main")
    as_query = blocks_.where(is_query).select("key", "id", "label", F.lit(True).alias("query"), F.pmod(spot, F.col("high")).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("col"))
    as_member = blocks_.select("key", "id", "label", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("row"), F.pmod(F.shiftright(spot, 20), F.col("wide")).cast("int").alias("col"))
    rows = as_query.unionByName(as_member).join(texts, "id").select("key", "row", "col", "id", "label", "query", "content")

    def links(part: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        """Links of whole blocks: the many small ones as pairs, all at once; the others by matrix products."""
        elements, ptr = content = sets.unpack(part.column("content"))
        ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
        query = part.column("query").to_numpy(zero_copy_only=False).astype(bool)
        ends = np.append(starts[1:], part.num_rows)
        queries = np.add.reduceat(query, starts, dtype=np.int64)
        members = ends - starts - queries
        few = queries * members <= 64
        # Pairs of the small blocks: every query row beside every member row of its block.
        of_block = np.repeat(np.arange(len(starts)), ends - starts)
        member_rows = np.flatnonzero(~query)
        first_member = np.searchsorted(member_rows, starts)
        q = np.flatnonzero(query & few[of_block])
        many = members[of_block[q]]
        i = np.repeat(q, many)
        j = member_rows[np.arange(len(i)) + np.repeat(first_member[of_block[q]] - (np.cumsum(many) - many), many)]
        apart = labels[i] != labels[j]
        i, j = i[apart], j[apart]
        good = similar_pairs(content, i, content, j, sets)
        found = [(i[good], j[good])]
        for k in np.flatnonzero(~few & (queries > 0)).tolist():
            own = np.arange(starts[k], ends[k])
            q, m = own[query[own]], own[~query[own]]
            link = block_links([elements[ptr[x] : ptr[x + 1]] for x in q], [elements[ptr[x] : ptr[x + 1]] for x in m], sets) & (labels[q][:, None] != labels[m])
            x, y = np.nonzero(link)
            found.append((q[x], m[y]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(i):  # one link of a query into each other component
            _, first = np.unique(np.stack([i, labels[j]]), axis=1, return_index=True)
            i, j = i[first], j[first]
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks arrive in order; the one that a batch cuts waits for its other rows."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            part = pa.concat_batches([*waiting, batch])
            place = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("key", "row", "col")])
            starts = np.concatenate([[0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1])
            if len(starts) > 1:
                yield links(part.slice(0, starts[-1]), starts[:-1])
            waiting = [part.slice(starts[-1])]
        if waiting and waiting[0].num_rows:
            yield links(waiting[0], np.zeros(1, np.int64))

    ordered = rows.repartition("key", "row", "col").sortWithinPartitions("key", "row", "col")
    out = cut(ordered.mapInArrow(run, "a long, b long"))
    release(total)
    return out


def resolve(hot: DataFrame, texts: DataFrame, sets: Sets) -> DataFrame | None:
    """Components ``(id, label)`` of the links among members of the buckets; None if there is no link.

    First every member meets its bucket's pivot, and the ``other`` member if ``hot`` names one, so that a
    member meets different ones in different bands, which connects large groups of copies that are far from the pivot. What then lies in different components of a bucket is compared in blocks.
    So each pair of a bucket is compared or connected already, and a bucket of n copies takes about n comparisons.
    """
    partners = [c for c in ("pivot", "other") if c in hot.columns]
    near = hot.select(F.explode(F.array(*[F.struct(F.col(c).alias("a"), F.col("id").alias("b")) for c in partners])).alias("p"))
    pairs = cut(near.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).where("a < b").distinct())
    labels = components(verify(pairs, texts, sets))
    release(pairs)
    named = hot.select("key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # The one pair of a bucket of two has been compared.
    split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high AND n > 2")
    split = cut(split.select("key", "n"))
    mixed = cut(even(named, split.select("key"), "key", split).select("key", "id", "label"))
    release(split)
    found = None if mixed.isEmpty() else compare_blocks(mixed, texts, sets)
    if found is None or found.isEmpty():
        release(mixed, found)
        return None if labels.isEmpty() else labels
    # The new links join whole components: it is these that are joined, and their members follow.
    own = mixed.select("id", "label").distinct()
    ends = found.join(own.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(own.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    joined = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    everyone = labels.unionByName(mixed.select("id", "label")).distinct()
    merged = everyone.join(joined.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left")
    out = cut(merged.select("id", F.coalesce("top", "label").alias("label")))
    release(labels, mixed, found, joined)
    return out
