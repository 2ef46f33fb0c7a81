"""Ranked search against scores by definition; how much of the lists it unpacks."""

import math
import random
import re
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lexical_search as ls


def plain(docs, items, k=10):
    """Every document scored for every item."""

    def terms(text):
        return re.findall(ls.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, total = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    texts = {}
    for i, t in items:
        texts.setdefault(i, set()).add(t)
    out = []
    for i, x in texts.items():
        asked = terms(" ".join(sorted(t for t in x if t is not None)))
        scores = []
        for d, c in found:
            m = 100 - 75 + (75 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=10):
    docs = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string")
    items = items if not isinstance(items, list) else spark.createDataFrame(items, "item_id long, text string")
    out = ls.search(ls.build(docs, tempfile.mkdtemp(prefix="lexical-") + "/i"), items, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed, n=900):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["É", "été", "ﬃ", "9"]
    common = lambda: words[min(int(rng.expovariate(0.03)), len(words) - 1)]
    docs = [(k, " ".join(common() for _ in range(rng.choice([0, 1, 3, 30, 30, 200]))) or None) for k in range(n)]
    docs += [(k + n, t) for k, t in docs[:200]]  # ties
    items = [(k, " ".join(common() for _ in range(rng.choice([1, 2, 8, 30])))) for k in range(40)] + [(40, "w0 w0 w0 w1"), (41, "absent"), (42, None), (43, "W0,É;é")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("sizes", [(4, 1 << 15, 1 << 21, 4), (128, 50, 1 << 21, 1), (16, 1 << 15, 700, 4)])
def test_equals_all_scores(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "SEGMENT_DOCS", "SEGMENT_POSTINGS", "FIRST"), sizes, strict=True):
        monkeypatch.setattr(ls, name, value)
    docs, items = corpus(sizes[0])
    assert ranked(spark, docs, items) == plain(docs, items)


def in_memory(docs):
    n = [sum(ls.terms_of(t.encode()).values()) for _, t in docs if t]
    segment = ls.Segment(len(n), sum(n))
    for d, t in docs:
        segment.add(d, t and t.encode())
    rows = [r for b in segment.rows("s") for r in b.to_pylist()]
    m = ls.norms(np.frombuffer(rows[0]["most"], np.int64), segment.n_docs, segment.total)
    return {r["term"]: ls.Postings(r, m) for r in rows[1:]}, np.frombuffer(rows[0]["payload"], np.int64), m


def test_blocks_below_the_threshold_stay_packed():
    """A hundred good documents stand together among 20,000 poor ones: the blocks elsewhere are not unpacked, and the ranks are those of all blocks."""
    rng = random.Random(5)
    docs = [(k, ("key lock door " * 9 if 9000 <= k < 9100 else "") + " ".join(rng.sample(["key", "lock", "door"] + ["x", "y", "z"] * 12, 38))) for k in range(20_000)]
    lists, ids, m = in_memory(docs)
    asked = [(5, lists[t]) for t in (b"key", b"lock", b"door")]
    scores = np.zeros(len(ids), np.int64)
    got = ls.best(asked, 10, scores)
    done, there = (sum(f(p) for _, p in asked) for f in (lambda p: len(p.unpacked), lambda p: len(p.lasts)))
    assert done < there / 20 and not scores.any()
    for w, p in asked:
        d, i = p.blocks(np.arange(len(p.lasts)))
        scores[d] += w * i
    assert got == sorted(zip(scores.tolist(), range(len(ids)), strict=True), key=lambda x: (-x[0], x[1]))[:10]


def test_common_lists_are_unpacked_only_at_pivots():
    """Once ten documents with a rare word are known, the lists of common words are opened only there."""
    docs = [(k, "the of " + ("rare " * 5 if k % 2000 == 7 else "") + f"u{k}") for k in range(40_000)]
    lists, ids, _ = in_memory(docs)
    asked = [(900, lists[b"rare"]), (1, lists[b"the"]), (1, lists[b"of"])]
    got = ls.best(asked, 10, np.zeros(len(ids), np.int64))
    assert [d for _, d in got] == [2000 * k + 7 for k in range(10)]
    assert len(lists[b"the"].unpacked) < len(lists[b"the"].lasts) / 5


def test_round_trip_of_blocks():
    rng = np.random.default_rng(3)
    docs = [(int(k) * 70_000 + 3, " ".join(["a"] * int(rng.integers(1, 4)) + ["b"] * (300 if k % 9 == 0 else 0) + [f"c{k}"] * (70_000 if k == 5 else 1))) for k in range(700)]
    lists, ids, m = in_memory(docs)
    for term in (b"a", b"b", b"c5"):
        d, i = lists[term].blocks(np.arange(len(lists[term].lasts)))
        expected = [(k, t.split().count(term.decode())) for k, (_, t) in enumerate(docs) if term.decode() in t.split()]
        assert d.tolist() == [k for k, _ in expected] and ids[d].tolist() == [docs[k][0] for k, _ in expected]
        assert i.tolist() == [(10**9 * tf) // (1000 * tf + 8 * int(m[k])) for k, tf in expected]


def test_items_in_blocks(spark, monkeypatch):
    docs, items = corpus(8, 200)
    monkeypatch.setattr(ls, "QUERIES", 7)
    assert ranked(spark, docs, items, 3) == plain(docs, items, 3)


def test_odd_rows(spark, odd, none, benchmark):
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "a b c"), (1, "a b c"), (1, "line"), (None, "word5x5 WORD6x6"), (3, ""), (4, None)]
    assert ranked(spark, odd, items) == plain(pairs, items)
    assert ranked(spark, none, items) == [] and ranked(spark, odd, []) == []
    wide = benchmark.select("item_id", "text", F.lit("x").alias("item"), F.lit(1).alias("rank"), F.lit(1).alias("doc_id"), F.lit("s").alias("score"))
    assert ranked(spark, odd, wide) == plain(pairs, [(r.item_id, r.text) for r in benchmark.collect()])


def test_index_is_opened_again(spark):
    docs, items = corpus(9, 100)
    path = tempfile.mkdtemp(prefix="lexical-") + "/i"
    built = ls.build(spark.createDataFrame(docs, "doc_id long, text string"), path)
    assert ls.Index.open(spark, path) == built
