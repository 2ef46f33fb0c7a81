"""Each operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, exact_dedup, html_text, knn_quality, lbl_scoring, line_dedup, minhash_dedup, mixing, sharding, toxicity


def test_exact_dedup(spark, odd, none):
    out = exact_dedup.deduplicate(odd, exact_dedup.new_index(spark, 4)).collect()
    assert len(out) == odd.count()
    keep = {r.doc_id: r.keep_id for r in out}
    assert keep[1] == 0 and keep[6] == 5 and keep[8] == 7 and keep[2] == 2
    assert {r.group_size for r in out if r.doc_id == 5} == {4}
    assert exact_dedup.deduplicate(none, exact_dedup.new_index(spark, 4)).collect() == []


def test_exact_dedup_is_incremental(spark):
    index = exact_dedup.new_index(spark, 4)
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d")], "doc_id long, text string")
    exact_dedup.deduplicate(first, index).collect()
    again = exact_dedup.DigestIndex(spark, index.name, "unused", 4)
    out = {r.doc_id: r for r in exact_dedup.deduplicate(second, again).collect()}
    assert out[1].keep_id == 5 and not out[1].kept and out[1].group_size == 2
    assert out[2].keep_id == 2 and out[2].kept and out[3].keep_id == 2
    assert index.read().select("digest").distinct().count() == 3 and index.read().agg(F.sum("copies")).first()[0] == 5


def rows_of(df, *columns):
    return sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))


def test_exact_dedup_of_a_repeated_batch(spark):
    """A batch that is run again returns what it did, and later batches count each batch once."""
    index = exact_dedup.new_index(spark, 4)
    batches = [[(1, "a b"), (2, "a  b"), (3, "c")], [(4, "c"), (5, "d"), (None, "d")], [(6, "c"), (7, "a b")]]
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in batches]
    for df in frames[:2]:
        first, again = (exact_dedup.deduplicate(df, index) for _ in range(2))
        columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert rows_of(first, *columns) == rows_of(again, *columns)
    out = {r.doc_id: r for r in exact_dedup.deduplicate(frames[2], index).collect()}
    assert (out[6].keep_id, out[6].group_size, out[6].kept) == (3, 3, False)
    assert (out[7].keep_id, out[7].group_size, out[7].kept) == (1, 3, False)
    index.drop()


def test_exact_dedup_keeps_one_row_of_each_group(spark, odd):
    docs = spark.createDataFrame([(None, "x y"), (None, "x  y"), (None, "z"), (9, "z"), (9, "z")], "doc_id long, text string")
    for df in (docs, odd):
        kept = {}
        for r in exact_dedup.deduplicate(df, exact_dedup.new_index(spark, 4)).collect():
            kept.setdefault(r.text_sha256, []).append(r.kept)
        assert all(sum(x) == 1 for x in kept.values())


def test_near_dedup_returns_every_row(spark, odd):
    """Also those whose text only rows without an id have."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(None, text), (None, text + " x"), (None, "e"), (None, "e")], "doc_id long, text string"))
    out = minhash_dedup.sized(minhash_dedup.classes(docs)).collect()
    assert len(out) == docs.count()
    lone = [r for r in out if r.class_id is None]
    assert len(lone) == 4 and all(r.kept and r.class_size == 4 and r.rep_id is None for r in lone)


def test_near_dedup_picks_alike_among_texts_of_one_id(spark):
    rows = [(1, f"text number {k} of the id", f"s{k}") for k in range(6)] + [(2, "another one", "s"), (2, "another one", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    picked = [rows_of(minhash_dedup.keep(x), "doc_id", "text", "id") for x in (docs, docs.repartition(5), docs.orderBy(F.desc("text")))]
    assert len(picked[0]) == 2 and picked[0] == picked[1] == picked[2]


CLASH = "doc_id long, text string, source string, row string, key string, d string, id string, n_words string, quality_score string, __row string, __key string, hash string, cell string"


def test_columns_of_any_name_pass_through(spark, benchmark, labels):
    texts = [" ".join(f"w{(k * 7 + j) % 50}" for j in range(30)) for k in range(12)]
    rows = [(k if k else None, t, "s", *("abcdefghij"[:10])) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASH)
    for out in (minhash_dedup.keep(docs), decontaminate.keep(docs, benchmark), mixing.take(docs, epochs=1.0), knn_quality.keep(docs, labels)):
        assert out.columns == docs.columns
        assert all(tuple(r)[3:] == rows[0][3:] for r in out.collect())
    out = sharding.shard(docs, limit=100, columns=tuple(docs.columns[1:]))
    assert set(docs.columns) | set(sharding.ADDED) == set(out.columns) and out.count() == len(rows)


def test_near_dedup(odd, none):
    out = {r.doc_id: r for r in minhash_dedup.classes(odd).collect()}
    assert out[6].class_id == 5 and out[8].class_id == 7 and out[3].class_id == 3 and out[1].class_id == 0
    assert minhash_dedup.classes(odd).count() == odd.count()
    assert minhash_dedup.classes(none).collect() == []
    kept = minhash_dedup.keep(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [0, 3, 4, 5, 7, 9, None]


def test_line_dedup(odd, none):
    out = line_dedup.classes(odd).where("doc_id = 9").collect()
    assert {(r.line_no, r.kept) for r in out} == {(0, True), (1, False), (2, True)}
    assert line_dedup.classes(none).collect() == []
    text = {r.doc_id: r.text for r in line_dedup.clean(odd).collect()}
    assert text[9] == "same line\nother line here" and text[0] is None and text[1] == ""


def test_decontamination(odd, none, benchmark):
    found = {r.doc_id: r for r in decontaminate.scan(odd, benchmark).collect()}
    assert found[5].item_ids == [1] and found[6].item_ids == [1] and not found[7].contaminated and found[0].item_ids == []
    assert decontaminate.scan(none, benchmark).collect() == []
    assert decontaminate.scan(odd, benchmark.limit(0)).where("contaminated").collect() == []
    kept = decontaminate.keep(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4


@pytest.mark.parametrize("module,function", [(toxicity, "judge"), (knn_quality, "judge")])
def test_classifiers(odd, none, labels, module, function):
    judge = getattr(module, function)
    out = judge(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert judge(none, labels).collect() == []
    assert judge(odd, labels.limit(0)).count() == odd.count()


def test_quality_filter_keeps_columns(odd, labels):
    assert knn_quality.keep(odd, labels).columns == odd.columns


def test_lm_scoring(odd, none):
    out = lbl_scoring.score(odd).collect()
    assert len(out) == odd.count()
    assert {r.n_tokens for r in out if r.doc_id in (0, 1, 2)} == {1}
    assert lbl_scoring.score(none).collect() == []


def test_html_pages(spark):
    schema = "page_id long, html string, text string, n_chars string, url string"
    long = "<div class='content'>" + "<p>word, and so on</p>" * 60_000 + "<div>" * 3000
    rows = [(1, None, "x", "y", None), (2, "", "x", "y", "u"), (None, "<p>one", "x", "y", "u"), (4, long, None, None, "u"), (4, long, None, None, "u"), (5, "<<<>&#xZ;</p", None, None, None)]
    out = html_text.extract(spark.createDataFrame(rows, schema))
    assert sorted(out.columns) == ["n_chars", "page_id", "text", "url"]
    got = out.collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""} and [r.text for r in got if r.page_id is None] == ["one"]
    assert [r.text.count("\n") for r in got if r.page_id == 4] == [59_999] * 2
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


def test_mixing(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == r.size * r.repeats and r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(none).collect() == []
    taken = mixing.take(odd)
    assert taken.columns == odd.columns and taken.count() == sum(r.repeats for r in rows)


def test_mixing_clamps_and_reshares(spark):
    rows = [(k, "w " * 10, "small") for k in range(2)] + [(100 + k, "w " * 10, "big") for k in range(40)] + [(200 + k, "w " * 10, "mid") for k in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("small", 5.0), ("big", 1.0), ("mid", 1.0)], "source string, weight double")
    targets = {r.source: (r.target, r.total) for r in mixing.mix(docs, weights=weights, columns=("source",)).groupBy("source", "target").agg(F.sum("taken").alias("total")).collect()}
    assert targets["small"][0] == 60 and targets["big"][0] == targets["mid"][0] == 270
    assert all(abs(total - target) <= 10 for target, total in targets.values())


def test_mixing_with_weights_that_are_missing_null_or_zero(spark):
    rows = [(k, "w " * 10, f"s{k % 5}") for k in range(50)] + [(None, "w w", None), (None, "v v", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 0.0), ("s2", None), ("s3", -2.0), ("s0", 1.0), ("other", 5.0)], "source string, weight double")
    out = mixing.mix(docs, weights=weights, columns=("source",)).collect()
    assert len(out) == len(rows)
    assert {r.target for r in out if r.source == "s0"} == {300.0} and {r.target for r in out if r.source != "s0"} == {0.0}
    assert sum(r.taken for r in out) == 300
    assert {r.taken for r in mixing.mix(docs, weights=weights.limit(0)).collect()} == {0}


def test_sharding(odd, none):
    out = sharding.shard(odd, limit=200).collect()
    assert len(out) == odd.count()
    assert all(r.shard_bytes <= 200 or r.oversize for r in out)
    assert sharding.shard(none).collect() == []


def test_sharding_pages_rows_of_one_id(spark):
    docs = spark.createDataFrame([(7, "x" * 40)] * 50 + [(k, "y" * 10) for k in range(20)], "doc_id long, text string").repartition(3)
    out = sharding.shard(docs, limit=100).collect()
    assert len(out) == 70 and all(r.shard_bytes <= 100 for r in out)
    size = {}
    for r in out:
        size[r.shard, r.page] = size.get((r.shard, r.page), 0) + r.n_bytes
    assert max(size.values()) <= 100


def test_line_clean_takes_only_a_rows_own_lines(spark):
    """Rows that share an id, or have none, keep lines that stand nowhere else; columns may have any name."""
    rows = [(0, "A line of text", 1, 2), (1, "A line of text", 3, 4), (1, "Quite another line", 5, 6), (None, "the only one of its kind", 7, 8), (None, "A line of text\nlast words here", 9, 10), (2, None, 0, 0), (3, "", 0, 0), (3, "", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped_lines int, dropped_doc int").withColumns({c: F.lit("x") for c in ("row", "d", "lines", "line_no", "sum", "keys")})
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns
    texts = sorted((r.dropped_lines, r.text) for r in out.collect() if r.dropped_lines)
    # A null id sorts first, so its line is the one that stays.
    assert texts == [(1, ""), (3, ""), (5, "Quite another line"), (7, "the only one of its kind"), (9, "A line of text\nlast words here")]
    assert sorted(str(r.text) for r in out.collect() if not r.dropped_lines) == ["", "", "None"]


def test_lines_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With all ids alike by construction no line but copies of one is dropped."""
    docs = spark.createDataFrame([(1, "first line"), (2, "second line"), (3, "first line"), (4, "third line of all")], "doc_id long, text string")
    plain = {r.doc_id: r for r in line_dedup.classes(docs).collect()}
    assert [plain[k].kept for k in (1, 2, 3, 4)] == [True, True, False, True]
    signed = line_dedup.signed
    monkeypatch.setattr(line_dedup, "signed", lambda docs, settings: signed(docs, settings).withColumn("line_id", F.lit(7).cast("long")))
    out = {r.doc_id: r for r in line_dedup.classes(docs).collect()}
    assert sum(not r.kept for r in out.values()) <= 1 and len({r.class_id for r in out.values()}) == 3


def test_filter_follows_the_number_of_ids(spark, monkeypatch):
    import numpy as np

    from lectern.llm import linking

    monkeypatch.setattr(linking, "FILTER_LEAST", 1)
    few, many = (linking.presence(spark.range(n).select(F.xxhash64("id").alias("id")), F.col("id")) for n in (10, 5000))
    assert len(few) < len(many) == 2048
    ids = np.array([r.id for r in spark.range(20_000).select(F.xxhash64("id").alias("id")).collect()])
    found = linking.maybe(many, ids)
    assert found[:5000].all() and found[5000:].mean() < 0.1
    monkeypatch.setattr(linking, "FILTER_MOST", 4)
    assert len(linking.presence(spark.range(5000))) == 4
