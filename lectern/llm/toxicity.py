"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, table
from lectern.llm.sample import fold, labelled, rows_of
from lectern.llm.wordhash import BREAKS, blocks, hash_words

#: Labelled rows the models are fitted on, at most.
SAMPLE = 20_000
#: Slots in which features are first counted, those looked at exactly, and features of the classifier, at most.
SLOTS, OPENED, FEATURES = 1 << 18, 4096, 1024
GRAM = 5
#: Share of mined features that may be there by chance.
FALSE_SHARE = 0.1
#: Voters into which the mined words and byte patterns are dealt by strength.
GROUPS = 24
#: Words that a person would vote on without having seen a label, a voter a language.
LEXICONS = {
    "en": "idiot moron stupid dumb fool loser scum trash garbage worthless pathetic disgusting clown jerk creep freak lowlife filth vermin imbecile",
    "de": "idiot dumm dummkopf trottel depp blödmann abschaum versager schwein drecksau arschloch scheiße ekelhaft widerlich armselig erbärmlich wertlos gesindel",
    "fr": "idiot imbécile crétin stupide débile abruti connard salaud ordure minable pathétique dégoûtant merde racaille pourriture",
    "es": "idiota imbécil estúpido tonto inútil basura escoria asqueroso patético payaso cretino mierda gentuza desgraciado",
}
#: Patterns that no language owns: words in capitals (three, or three in ten), stacked marks, letters masked by signs, a letter four times.
PATTERNS = np.array([0xA11CA95000000001 + (k << 46) * 7 for k in range(5)], np.uint64)
LETTER, UPPER, MARK, SIGN = np.zeros((4, 256), bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER[65:91] = True
MARK[[33, 63]] = True
SIGN[[ord(c) for c in "*@$#"]] = True


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def patterns(words) -> np.ndarray:
    """Which of ``PATTERNS`` each text of a block has: (texts, patterns)."""
    raw, offsets = words.raw, words.offsets
    texts = len(offsets) - 1
    of = np.repeat(np.arange(texts), np.diff(offsets))
    upto = np.concatenate([[0], np.cumsum(UPPER[raw])])
    length = words.ends - words.starts
    shouted = np.bincount(words.text_of_word[(length >= 3) & (upto[words.ends] - upto[words.starts] == length)], minlength=texts)
    out = np.zeros((texts, len(PATTERNS)), bool)
    out[:, 0] = shouted >= 3
    out[:, 1] = (shouted >= 3) & (shouted * 10 >= 3 * words.counts)
    if len(raw) >= 4:
        mark, sign, letter = MARK[raw], SIGN[raw], LETTER[raw]
        same = (raw[1:] == raw[:-1]) & letter[1:] & (of[1:] == of[:-1])
        for k, hit in ((2, mark[:-1] & mark[1:] & (of[1:] == of[:-1])), (3, letter[:-2] & sign[1:-1] & letter[2:] & (of[2:] == of[:-2])), (4, same[:-2] & same[1:-1] & same[2:])):
            out[of[: len(hit)][hit], k] = True
    return out


def found(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, of the byte patterns in them and of ``PATTERNS``, and the text each is from."""
    grams, of = words.grams(GRAM)
    text, k = np.nonzero(patterns(words))
    return np.concatenate([words.hash, grams, PATTERNS[k]]), np.concatenate([words.text_of_word, of, text])


def slot_counts(docs: DataFrame, ids: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sampled documents of each label that have a feature, by slot of its hash: sums of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, y))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = shared.value
        total = np.zeros(2 * SLOTS, np.int64)
        any_ = False
        for batch in batches:
            batch = batch.take(pa.array(rows_of(ids, batch.column(0))))
            label = y[np.searchsorted(ids, batch.column(0).to_numpy())].astype(np.int64)
            for first, _, words in blocks(batch.column(1), breaks=BREAKS):
                feature, of = found(words)
                pair = np.unique(of * SLOTS + (feature >> np.uint64(46)).astype(np.int64))
                total += np.bincount(label[first + pair // SLOTS] * SLOTS + pair % SLOTS, minlength=2 * SLOTS)
                any_ = True
        if any_:
            for k in range(16):
                yield pa.RecordBatch.from_pydict({"slice": [k], "counts": [total[k * SLOTS // 8 : (k + 1) * SLOTS // 8].tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"slice": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    parts = docs.mapInArrow(count, "slice long, counts binary").withColumn("salt", F.spark_partition_id() % 4)
    total = np.zeros(2 * SLOTS)
    for x in parts.repartition(64, "slice", "salt").select("slice", "counts").mapInArrow(add, "slice long, counts binary").toLocalIterator():
        total[x.slice * SLOTS // 8 : (x.slice + 1) * SLOTS // 8] += np.frombuffer(x.counts, np.int64)
    return total.reshape(2, SLOTS)


def log_odds(ones: np.ndarray, zeros: np.ndarray, n1: float, n0: float) -> np.ndarray:
    return np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros + 0.5) / (n0 + 1))


def surprise(ones: np.ndarray, zeros: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Likelihood-ratio statistic (G) of a feature's being in as many documents of either label."""
    part = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    share = (ones + zeros) / (n1 + n0)
    return 2 * (part(ones, share * n1) + part(zeros, share * n0) + part(n1 - ones, (1 - share) * n1) + part(n0 - zeros, (1 - share) * n0))


def label_model(votes: np.ndarray, marks: np.ndarray, steps: int = 40) -> np.ndarray:
    """Posterior of label 1 from binary votes (rows, voters), by EM.

    The model has for each voter its rates of voting under either label, and for each pair the correlation left under a label; a
    voter's evidence is divided by the correlated evidence beside it, so that many voters that say the same by construction count as
    few. The annotators' ``marks`` are no vote: they start the rates, and each step estimates rates and correlations from them and the posteriors alike.
    """
    q = np.clip(marks, 0.05, 0.95)
    for _ in range(steps):
        t = (q + marks) / 2
        rate1 = (t @ votes + 0.5) / (t.sum() + 1)
        rate0 = ((1 - t) @ votes + 0.5) / ((1 - t).sum() + 1)
        centred = votes - (t[:, None] * rate1 + (1 - t)[:, None] * rate0)
        spread = np.sqrt((centred**2).mean(0)) + 1e-6
        correlation = np.abs(centred.T @ centred / len(votes) / spread / spread[:, None])
        weight = 1 / correlation.sum(1)
        evidence = votes * (np.log(rate1) - np.log(rate0)) + (1 - votes) * (np.log1p(-rate1) - np.log1p(-rate0))
        share = np.clip(t.mean(), 1e-3, 1 - 1e-3)
        q = 1 / (1 + np.exp(-np.clip(evidence @ weight + np.log(share / (1 - share)), -30, 30)))
    return q


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.3, steps: int = 500) -> tuple[np.ndarray, float]:
    """Linear classifier on soft targets: accelerated gradient descent on the ridge-penalised cross entropy."""
    w, b = np.zeros(x.shape[1]), float(np.log(target.mean() / (1 - target.mean()))) if 0 < target.mean() < 1 else 0.0
    look_w, look_b = w.copy(), b
    rate = 4 / (np.linalg.norm(x, 2) ** 2 + len(x) + 4 * ridge) if len(x) else 1.0
    for k in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x @ look_w + look_b, -30, 30))) - target
        new_w, new_b = look_w - rate * (x.T @ error + ridge * look_w), look_b - rate * error.sum()
        pace = k / (k + 3)
        look_w, look_b = new_w + pace * (new_w - w), new_b + pace * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ids, y = labelled(labels, "toxic", 5, 0, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = slot_counts(rows, ids, y) if len(ids) else np.zeros((2, SLOTS))
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = log_odds(counts[1], counts[0], n1, n0) * np.sqrt(counts[1])
    order = np.argsort(-odds, kind="stable")[:OPENED]
    opened = np.sort(order[counts[1][order] >= 3])
    tried = max(int((counts.sum(0) >= 3).sum()), 1)
    shared = docs.sparkSession.sparkContext.broadcast((ids, opened))
    lexicons = [hash_words(words.split()) for words in LEXICONS.values()]
    seed = np.unique(np.concatenate([*lexicons, PATTERNS]))
    lexical = np.unique(np.concatenate(lexicons))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sampled documents' features in the opened slots."""
        ids, opened = shared.value
        is_open = np.zeros(SLOTS, bool)
        is_open[opened] = True
        for batch in batches:
            batch = batch.take(pa.array(rows_of(ids, batch.column(0))))
            out, sizes = [], []
            for _, _, words in blocks(batch.column(1), breaks=BREAKS):
                feature, of = found(words)
                keep = is_open[(feature >> np.uint64(46)).astype(np.int64)] | np.isin(feature, seed)
                feature, of = feature[keep], of[keep]
                edge = np.searchsorted(np.sort(of), np.arange(len(words.ptr)))
                feature = feature[np.argsort(of, kind="stable")]
                out += [feature[edge[d] : edge[d + 1]].tobytes() for d in range(len(words.ptr) - 1)]
                sizes += words.counts.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "words", "features"])

    seen = {r.doc_id: (r.words, np.frombuffer(r.features, np.uint64)) for r in rows.mapInArrow(look, "doc_id long, words long, features binary").toLocalIterator()} if len(ids) else {}
    keep = np.array([i in seen for i in ids.tolist()], bool)
    ids, y = ids[keep], y[keep]
    if len(ids) == 0 or y.min() == y.max():  # nothing to learn from: the lexicon alone votes
        return Model(lexical, np.full(len(lexical), 3.0), -2.0)
    own = [seen[i] for i in ids.tolist()]
    of = np.repeat(np.arange(len(ids)), [len(f) for _, f in own])
    all_ = np.concatenate([f for _, f in own])
    hashes, column = np.unique(all_, return_inverse=True)
    tf = np.zeros((len(hashes),))
    pair, times = np.unique(of * len(hashes) + column, return_counts=True)
    row, column = pair // len(hashes), pair % len(hashes)
    ones, zeros = np.bincount(column, y[row], len(hashes)), np.bincount(column, 1 - y[row], len(hashes))
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = log_odds(ones, zeros, n1, n0)
    strength = odds * np.sqrt(ones)
    # Among so many features some go with the label by chance: a false discovery rate decides which may vote.
    chance = np.where(odds > 1.2, np.exp(-surprise(ones, zeros, n1, n0) / 2), 1.0)
    ranked = np.sort(chance)
    passed = np.flatnonzero(ranked <= FALSE_SHARE * np.arange(1, len(ranked) + 1) / max(tried, len(ranked)))
    enough = (chance <= (ranked[passed[-1]] if len(passed) else 0.0)) | np.isin(hashes, lexical)
    best = np.argsort(-np.where(enough, strength, -np.inf), kind="stable")[: min(FEATURES, int(enough.sum()))]
    place = np.full(len(hashes), -1)
    place[best] = np.arange(len(best))
    keep = place[column] >= 0
    x = np.zeros((len(ids), len(best)))
    x[row[keep], place[column[keep]]] = np.log1p(times[keep])
    # Voters: a lexicon a language, the patterns, the mined features dealt by strength, and several or dense hits.
    hit = x > 0
    size = np.array([w for w, _ in own])
    dealt = np.arange(len(best)) * GROUPS // max(len(best), 1)
    votes = [hit[:, dealt == k].any(1) for k in range(GROUPS) if (dealt == k).any()]
    votes += [np.bincount(row[np.isin(hashes[column], words)], minlength=len(ids)) > 0 for words in (*lexicons, *PATTERNS[:, None])]
    votes += [hit.sum(1) >= n for n in (2, 3, 4, 8)] + [hit.sum(1) * per >= np.maximum(size, 1) for per in (100, 30)]
    q = label_model(np.stack(votes, 1).astype(float), y)
    w, b = logistic(x, q)
    order = np.argsort(hashes[best])
    return Model(hashes[best][order], w[order], b)


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score`` and ``columns``: the whole text of every document through the linear classifier."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        has = np.zeros(1 << 16, bool)
        has[(model.features >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            out = []
            for _, _, words in blocks(batch.column(1), breaks=BREAKS):
                feature, of = found(words)
                maybe = has[(feature >> np.uint64(48)).astype(np.int64)]
                feature, of = feature[maybe], of[maybe]
                at = np.searchsorted(model.features, feature)
                at[at == len(model.features)] = 0
                hit = model.features[at] == feature if len(model.features) else np.zeros(len(at), bool)
                pair, tf = np.unique(of[hit] * len(model.features) + at[hit], return_counts=True)
                total = np.bincount(pair // max(len(model.features), 1), np.log1p(tf) * model.weights[pair % max(len(model.features), 1)], len(words.ptr) - 1)
                out.append(1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30))))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), *batch.columns[2:]], ["doc_id", "score", *columns])

    rows = docs.select("doc_id", "text", *columns)
    schema = docs.select("doc_id", F.lit(0.0).alias("score"), *columns).schema
    return rows.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Toxicity of every document: ``doc_id, held_out, score, predicted``.

    Tens of voters (lexicons of four languages, patterns of no language, and words and byte patterns mined from the whole texts of a
    bounded sample of labelled rows) go through a generative label model that estimates each voter's accuracy and the correlations
    among voters, with the annotators' marks of the sample; its posteriors train a linear classifier, which scores every whole text. Rows of the held-out fold (crc32 of the id mod 5 = 0) are never learned from.

    Null and empty texts score the classifier's bias; a null id is not held out; without usable
    labels the fixed lexicon decides; repeated rows score alike; an empty table gives no rows.
    """
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
