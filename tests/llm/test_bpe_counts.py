"""Token counts against the tokenizer library and against merging by definition."""

import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return bpe_counts.Counter(bpe_counts.Encoding(PATH))


def expected(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_query_equals_the_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = bpe_counts.op11_token_counts(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    rows = out.collect()
    assert len(rows) == len(texts) and any(r.over_limit for r in rows)
    for r in rows:
        n = expected(library, texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


CASES = [
    "", " ", "\n\n  x", "a  b", "it's we'll I'D", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 3000, " " * 3000, "ab" * 5000,
    "a\x1cb\x85c d e", "第2024年の論文", "naïve – “quoted” €5", "\U0001f600\U0001f469‍\U0001f680", "՘࢏\U0001e6c0 x", "é �\x00",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(library, counter, text):
    assert counter.count(text) == expected(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, counter, text):
    assert counter.count(text) == expected(library, text)


def test_every_character(library, counter):
    """Each code point between letters, digits and signs: the quick pattern only sees characters whose class both Unicode versions share."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(1).shuffle(points)
    for k in range(0, len(points), 4000):
        part = points[k : k + 4000]
        for settled in (True, False):
            text = "".join(f"a{chr(c)}1{chr(c)}!" for c in part if bool(bpe_counts.SETTLED.fullmatch(chr(c))) == settled)
            assert counter.count(text) == expected(library, text)


def test_long_texts_are_cut_where_no_piece_is(library, counter, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["word", " ", "\n", "\t ", "  ", "12", "!?", " é", "\x1c", "'s"]) for _ in range(4000))
    n = expected(library, text)
    for span in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(bpe_counts, "SPAN", span)
        assert counter.count(text) == n


def test_forgotten_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe_counts, "REMEMBERED", 3)
    counter = bpe_counts.Counter(bpe_counts.Encoding(PATH))
    text = "several words of some length here"
    assert counter.count(text) == counter.count(text) == expected(library, text)


def test_merges_by_definition():
    """The heap against merging the leftmost pair of lowest rank in a scan of the whole piece."""
    encoding = bpe_counts.Encoding(PATH)
    rng = random.Random(3)
    for _ in range(300):
        piece = bytes(rng.choice(b"aehinorst\xc3\xa9 ") for _ in range(rng.randint(1, 30)))
        symbols = list(piece)
        while True:
            pairs = [(encoding.merges[p][0], k) for k in range(len(symbols) - 1) if (p := symbols[k] << bpe_counts.BITS | symbols[k + 1]) in encoding.merges]
            if not pairs:
                break
            _, k = min(pairs)
            symbols[k : k + 2] = [encoding.merges[symbols[k] << bpe_counts.BITS | symbols[k + 1]][1]]
        assert encoding.tokens(piece) == len(symbols)


def test_odd_rows(spark, odd, none, library):
    out = bpe_counts.with_counts(odd, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in out if r.doc_id is not None) == sorted((False, r.doc_id, expected(library, r.text or "")) for r in odd.collect() if r.doc_id is not None)
    assert len(out) == odd.count() and {(r.n_bytes, r.n_tokens, r.over_limit) for r in out if r.doc_id in (0, 1)} == {(0, 0, False)}
    assert bpe_counts.with_counts(none, PATH).collect() == []


def test_other_encodings_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe_counts.Encoding(public_tokenizers.path("word_bpe_49k.json"))
    file = json.load(open(PATH))
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "x.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        bpe_counts.Encoding(str(tmp_path / "x.json"))
