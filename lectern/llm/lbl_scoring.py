"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, cut, table
from lectern.llm.sample import fold
from lectern.llm.wordhash import blocks, mix

#: Outputs of the neural model: two marks, the most frequent words, and classes into which a hash deals all other words; size of a vector.
VOCABULARY, CLASSES, WIDTH = 2048, 512, 32
END, BEGIN, FIRST_WORD, FIRST_CLASS = 0, 1, 2, VOCABULARY - CLASSES
#: Most frequent words whose counts every task holds (16 bytes each); the others are joined.
FREQUENT = 1 << 17
#: Windows of a trainer, and tasks at most (beyond it a task trains several models in turn); noise words a batch shares; windows of a batch.
WINDOWS, TASKS, NOISE, BATCH = 1 << 21, 10_000, 64, 512
#: Windows of a text that travel together; windows handed to a trainer at once.
PIECE, HANDED = 4096, 1 << 15
#: Slices in which a model's weights are averaged.
SLICES = 8
#: Key of the end token in the table of counts.
END_KEY = np.uint64(0xE0D0E0D0E0D0E0D1)
LN10 = float(np.log(10))


@dataclass(frozen=True)
class Counts:
    tokens: int  # N
    types: int  # V
    ends: int
    hashes: np.ndarray  # the most frequent words, sorted by hash
    counts: np.ndarray
    model_id: np.ndarray  # id in the neural model, -1 for words of a class
    class_tokens: np.ndarray  # of each class: its tokens
    class_types: np.ndarray  # and its distinct words


@dataclass(frozen=True)
class Tables:
    """The trained model as look-ups: log-score of a word after a word one and two back, and the log normaliser."""

    one: np.ndarray
    two: np.ndarray
    norm: np.ndarray


def held() -> F.Column:
    return F.coalesce(fold(7) == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, count`` over the whole texts of ``docs``, words by their 64-bit hash, with the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = ends = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, where = np.unique(np.concatenate([w for w, _ in kept]), return_inverse=True)
            return words, np.bincount(where, np.concatenate([c for _, c in kept])).astype(np.int64)

        def emit(words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000].view(np.int64)), pa.array(counts[at : at + 50_000])], ["word", "count"])

        for batch in batches:
            for _, _, words in blocks(batch.column(0)):
                ends += len(words.ptr) - 1
                kept.append(np.unique(words.hash, return_counts=True))
                size += len(kept[-1][0])
            if size > 2_000_000:
                kept = [merged()]
                size = len(kept[0][0])
                if size > 1_000_000:  # bounded memory: hand over and start anew
                    yield from emit(*kept[0])
                    kept, size = [], 0
        if kept:
            yield from emit(*merged())
        if ends:
            yield from emit(np.array([END_KEY]), np.array([ends]))

    return docs.select("text").mapInArrow(count, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def summarise(counts: DataFrame) -> Counts:
    end = int(END_KEY.view(np.int64))
    n = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == end, F.col("count"))).alias("ends")).first()
    # A histogram of counts tells from which count on the words fit the table, so none are sorted but these.
    step = F.floor(F.log2("count") * 16).cast("int")
    plain = counts.where(F.col("word") != end)
    bins = sorted(((r.bin, r.n) for r in plain.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, room = None, FREQUENT
    for bin_, words in bins:
        room -= words
        if room < 0:
            break
        least = bin_
    # Words that tie with more than fit are taken by their hash, so reruns agree.
    top = plain.where(step >= least) if least is not None else plain.orderBy(F.desc("count"), "word").limit(FREQUENT)
    rows = sorted(((r["count"], r["word"]) for r in top.select("word", "count").collect()), key=lambda x: (-x[0], x[1]))
    word, count = np.array([w for _, w in rows], np.int64).view(np.uint64), np.array([c for c, _ in rows], np.int64)
    ids = np.full(len(word), -1, np.int32)
    known = min(len(word), FIRST_CLASS - FIRST_WORD)
    ids[:known] = np.arange(FIRST_WORD, FIRST_WORD + known)
    tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    of = (F.shiftrightunsigned("word", 40) % CLASSES).alias("of")
    for r in plain.groupBy(of).agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("types")).collect():
        tokens[r.of], types[r.of] = r.tokens, r.types
    own = class_of(word[:known])
    tokens -= np.bincount(own, count[:known], CLASSES).astype(np.int64)
    types -= np.bincount(own, minlength=CLASSES)
    order = np.argsort(word)
    return Counts(n.n or 0, n.v or 0, n.ends or 0, word[order], count[order], ids[order], tokens, types)


def class_of(words: np.ndarray) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.int64)


def look_up(words: np.ndarray, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the table of frequent words, and whether it is there."""
    if not len(counts.hashes):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.searchsorted(counts.hashes, words)
    at[at == len(counts.hashes)] = 0
    return at, counts.hashes[at] == words


def model_ids(words: np.ndarray, at: np.ndarray, hit: np.ndarray, counts: Counts) -> np.ndarray:
    """Ids in the neural model: a frequent word's own, or its class's."""
    ids = np.where(hit, counts.model_id[at], -1) if len(counts.hashes) else np.full(len(words), -1)
    return np.where(ids >= 0, ids, FIRST_CLASS + class_of(words)).astype(np.int32)


def sequences(words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Model ids of all tokens with each text's end, the ids one and two before, and the text of each token."""
    texts = len(words.ptr) - 1
    of = words.text_of_word
    target = np.full(len(ids) + texts, END, np.int32)
    target[np.arange(len(ids)) + of] = ids
    text = np.repeat(np.arange(texts), words.counts + 1)
    begin = words.ptr[:-1] + np.arange(texts)
    one = np.concatenate([[BEGIN], target[:-1]]).astype(np.int32) if len(target) else target
    one[begin] = BEGIN
    two = np.concatenate([[BEGIN], one[:-1]]).astype(np.int32) if len(target) else target
    two[begin] = BEGIN
    return target, one, two, text


def unigram(counts: Counts) -> np.ndarray:
    """Smoothed unigram shares of the model's ids; the begin mark is never predicted, nor are ids without a word."""
    share = np.zeros(VOCABULARY)
    own = counts.model_id >= 0
    share[counts.model_id[own]] = counts.counts[own] + 1
    share[FIRST_CLASS:] = counts.class_tokens + 1
    share[END] = counts.ends + 1
    return share / share.sum()


def initial(seed: int, share: np.ndarray) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    size = (VOCABULARY, WIDTH)
    near = lambda: (np.eye(WIDTH) + random.normal(0, 0.05, (WIDTH, WIDTH))).astype(np.float32)
    bias = np.full(VOCABULARY, -40.0)
    bias[share > 0] = np.log(share[share > 0])
    return {
        "context": random.normal(0, 0.1, size).astype(np.float32), "target": random.normal(0, 0.1, size).astype(np.float32),
        "one": near(), "two": near(), "bias": bias.astype(np.float32),
    }


def train(windows: Iterator[np.ndarray], share: np.ndarray, seed: int) -> tuple[int, dict[str, np.ndarray]]:
    """Noise-contrastive estimation by AdaGrad over (two back, one back, word) rows.

    The data word is told from ``NOISE`` draws of the unigram distribution that a batch shares; the score
    less ln(k * noise share) is the log-odds of data. The model stays near normalised and is normalised exactly later.
    """
    p = initial(seed, share)
    state = {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}
    random = np.random.default_rng(seed + 1)
    edges = np.cumsum(share)
    log_noise = np.where(share > 0, np.log(np.maximum(share, 1e-300) * NOISE), 0).astype(np.float32)
    seen = 0

    def step(name: str, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            state[name] += gradient**2
            p[name] -= 0.05 * gradient / np.sqrt(state[name])
            return
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        own, total = ordered[first], np.add.reduceat(gradient[order], first)
        state[name][own] += total**2
        p[name][own] -= 0.05 * total / np.sqrt(state[name][own])

    for batch in windows:
        for at in range(0, len(batch), BATCH):
            two, one, word = batch[at : at + BATCH].astype(np.int64).T
            seen += len(word)
            noise = np.minimum(np.searchsorted(edges, random.random(NOISE) * edges[-1], "right"), VOCABULARY - 1)
            r1, r2 = p["context"][one], p["context"][two]
            h = r1 @ p["one"] + r2 @ p["two"]
            data = (h * p["target"][word]).sum(1) + p["bias"][word] - log_noise[word]
            other = h @ p["target"][noise].T + p["bias"][noise] - log_noise[noise]
            g_data = (1 / (1 + np.exp(-np.clip(data, -30, 30))) - 1).astype(np.float32)
            g_other = (1 / (1 + np.exp(-np.clip(other, -30, 30)))).astype(np.float32)
            g_h = g_data[:, None] * p["target"][word] + g_other @ p["target"][noise]
            rows = np.concatenate([word, noise])
            g_target = np.concatenate([g_data[:, None] * h, g_other.T @ h])
            g_bias = np.concatenate([g_data, g_other.sum(0)])
            g_one, g_two = r1.T @ g_h, r2.T @ g_h
            g_context = np.concatenate([g_h @ p["one"].T, g_h @ p["two"].T])
            step("target", g_target, rows)
            step("bias", g_bias, rows)
            step("one", g_one)
            step("two", g_two)
            step("context", g_context, np.concatenate([one, two]))
    return seen, p


NAMES = ("context", "target", "one", "two", "bias")


def training_windows(docs: DataFrame, counts: Counts, seed: int = 3) -> DataFrame:
    """``trainer, turn, windows``: every position of every text as (two back, one back, word), in pieces of a text.

    A piece's trainer and its turn there are a hash of the document's id, its text and the piece's place, so they do not depend on how
    the rows lie in partitions. There are as many trainers as the corpus has ``WINDOWS`` windows. Only rows equal in id and text go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    trainers = max(1, -(-counts.tokens // WINDOWS))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            spots = batch.column(1).to_numpy().view(np.uint64)
            for first, end, words in blocks(batch.column(0)):
                at, hit = look_up(words.hash, counts)
                target, one, two, _ = sequences(words, model_ids(words.hash, at, hit, counts))
                rows = np.stack([two, one, target], 1).astype(np.int16)
                place = np.arange(len(words.hash)) - np.repeat(words.ptr[:-1], words.counts)
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))])
                text = mix(upto[words.ptr[1:]] - upto[words.ptr[:-1]] + spots[first:end] + np.uint64(seed))
                size = words.counts + 1
                pieces = -(-size // PIECE)
                of = np.repeat(np.arange(len(size)), pieces)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = (words.ptr[:-1] + np.arange(len(size)))[of] + nth * PIECE
                stop = np.minimum(start + PIECE, (words.ptr[1:] + np.arange(len(size)) + 1)[of])
                turn = mix(text[of] + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                trainer = ((turn >> np.uint64(33)) % np.uint64(trainers)).astype(np.int64)
                raw = [rows[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(trainer), pa.array(turn.view(np.int64)), pa.array(raw, pa.binary())], ["trainer", "turn", "windows"])

    return docs.select("text", F.xxhash64("doc_id").alias("spot")).mapInArrow(gather, "trainer long, turn long, windows binary")


def fit(docs: DataFrame, counts: Counts, seed: int = 3) -> dict[str, np.ndarray]:
    """Train on the windows of all positions of all training texts.

    Each trainer starts alike and streams through its windows in the order of their turns; the models are averaged by the windows
    seen, slice by slice in tasks of their own. A window is six bytes; what is gathered is in proportion to the corpus, and so is the number
    of trainers; what reaches the driver is a few sums of weights of fixed size.
    """
    share = unigram(counts)
    shared = docs.sparkSession.sparkContext.broadcast(share)
    tasks = min(max(1, -(-counts.tokens // WINDOWS)), TASKS)
    size = sum(v.size for v in initial(seed, share).values())
    edges = [size * k // SLICES for k in range(SLICES + 1)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t, np.frombuffer(x.as_buffer(), np.int16).reshape(-1, 3)) for batch in batches for t, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))

        def handed(own: Iterator[tuple[int, np.ndarray]]) -> Iterator[np.ndarray]:
            waiting, n = [], 0
            for _, x in own:
                waiting.append(x)
                n += len(x)
                if n >= HANDED:
                    whole = np.concatenate(waiting)
                    yield whole[: n - n % BATCH]
                    waiting, n = [whole[n - n % BATCH :]], n % BATCH
            if n:
                yield np.concatenate(waiting)

        for trainer, own in groupby(rows, key=lambda x: x[0]):
            seen, p = train(handed(own), shared.value, seed)
            whole = np.concatenate([p[k].ravel() for k in NAMES]).astype(np.float64) * seen
            for k in range(SLICES):
                yield pa.RecordBatch.from_pydict({"slice": [k], "trainer": [trainer], "seen": [seen], "weights": [whole[edges[k] : edges[k + 1]].tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, seen, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = sums.setdefault(k, [0, np.zeros(edges[k + 1] - edges[k])])
                own[0] += seen
                own[1] += np.frombuffer(weights.as_buffer(), np.float64)
        for k, (seen, total) in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": [k], "seen": [seen], "weights": [total.tobytes()]})

    windows = training_windows(docs, counts, seed).repartitionById(tasks, (F.col("trainer") % tasks).cast("int")).sortWithinPartitions("trainer", "turn")
    models = windows.select("trainer", "windows").mapInArrow(learn, "slice long, trainer long, seen long, weights binary")
    # Sums in a fixed order: eight parts of each slice, by trainer.
    parts = models.repartitionById(8 * SLICES, (F.col("slice") * 8 + F.col("trainer") % 8).cast("int")).sortWithinPartitions("slice", "trainer")
    sums = sorted(parts.select("slice", "seen", "weights").mapInArrow(add, "slice long, seen long, weights binary").collect(), key=lambda r: (r.slice, r.seen, bytes(r.weights)))
    start = initial(seed, share)
    total = sum(r.seen for r in sums if r.slice == 0)
    if not total:
        return start
    mean = np.zeros(size)
    for r in sums:
        mean[edges[r.slice] : edges[r.slice + 1]] += np.frombuffer(r.weights, np.float64)
    mean /= total
    out, at = {}, 0
    for k in NAMES:
        out[k] = mean[at : at + start[k].size].reshape(start[k].shape)
        at += start[k].size
    return out


def normalised(p: dict[str, np.ndarray], share: np.ndarray) -> Tables:
    """All log-scores and normalisers by batched matrix products.

    Scores add over the context, so the normaliser of a pair of context words is the product of two
    matrices of exponentials: sum over w of exp(one[a, w] + bias[w]) * exp(two[b, w]).
    """
    usable = share > 0
    bias = np.where(usable, p["bias"], -80.0)
    one = p["context"] @ p["one"] @ p["target"].T + bias
    two = p["context"] @ p["two"] @ p["target"].T
    top_one, top_two = one[:, usable].max(1), two[:, usable].max(1)
    total = np.exp(one - top_one[:, None]) @ np.where(usable, np.exp(two - top_two[:, None]), 0.0).T
    norm = np.log(np.maximum(total, 1e-300)) + top_one[:, None] + top_two
    return Tables(one.astype(np.float32), two.astype(np.float32), norm.astype(np.float32))


def score(docs: DataFrame) -> DataFrame:
    """Scores of every document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words (A-Z lower-cased) and one end. ``base_score`` is the add-one unigram log10 probability from the
    counts of all training documents (crc32 of the id mod 7 not 2). ``score`` is that of the log-bilinear model:
    given the two tokens before, it spreads probability over the end, its vocabulary and the classes of all other words,
    and within a class by add-one counts with one share for unseen words; so texts of any words have a proper probability.

    Frequent words are looked up in a table of fixed size; all others are joined with the counts by word, whose rows no
    single word can dominate.

    Null and empty texts are one end token; a null id counts as training; repeated rows count and score each;
    with no training documents the base is 0 and the model untrained; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", held().alias("held_out"), "text")
    training = docs.where(~F.col("held_out"))
    table_ = cut(word_counts(training))
    counts = summarise(table_)
    share = unigram(counts)
    tables = normalised(fit(training, counts), share)
    log_all = np.log10(counts.tokens + counts.types + 1)
    log_class = np.log10(counts.class_tokens + counts.class_types + 1.0)
    shared = docs.sparkSession.sparkContext.broadcast((counts, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tables = shared.value
        log_count = np.log10(counts.counts + 1.0)
        log_end = float(np.log10(counts.ends + 1.0))
        for batch in batches:
            tokens, known, base, model, words_, times = [], [], [], [], [], []
            for _, _, words in blocks(batch.column(2)):
                texts = len(words.ptr) - 1
                at, hit = look_up(words.hash, counts)
                ids = model_ids(words.hash, at, hit, counts)
                target, one, two, text = sequences(words, ids)
                log_p = (tables.one[one, target] + tables.two[two, target] - tables.norm[one, two]) / LN10
                of = words.text_of_word
                own = np.where(hit, log_count[at], 0.0) if len(log_count) else np.zeros(len(at))
                n = words.counts + 1
                other = ids >= FIRST_CLASS
                inside = own[other] - log_class[ids[other] - FIRST_CLASS]
                tokens.append(n)
                known.append(np.bincount(of, hit, texts) + (counts.ends > 0))
                base.append(np.bincount(of, own, texts) + log_end - n * log_all)
                model.append(np.bincount(text, log_p, texts) + np.bincount(of[other], inside, texts))
                rare, of = words.hash[~hit], of[~hit]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                first = np.ones(len(rare), bool)
                first[1:] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])
                start = np.flatnonzero(first)
                tf = np.diff(np.append(start, len(rare)))
                edge = np.searchsorted(of[start], np.arange(texts + 1))
                words_.append((edge, rare[start].view(np.int64)))
                times.append(tf.astype(np.int32))
            if not tokens:
                continue
            sizes = np.concatenate([np.diff(e) for e, _ in words_])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(known).astype(np.int64)),
                    pa.array(np.concatenate(base)), pa.array(np.concatenate(model).astype(np.float64)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([w for _, w in words_]))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times))),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "base", "model", "words", "times"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, model double, words array<long>, times array<int>"
    rows = cut(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    pairs = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    more = pairs.join(table_, "word").groupBy("row").agg(F.sum("times").alias("known_more"), F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("log_more"))
    extra = F.coalesce("log_more", F.lit(0.0))
    return rows.drop("words", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return score(table(spark, sf_dir, "documents"))
