import pytest
from pyspark.sql import functions as F

from lectern.operators import metrics, search, state
from lectern.plans import refresh


def pairs(spark, truth, predicted):
    return spark.createDataFrame(list(zip(truth, predicted, strict=True)), "truth string, predicted string")


def test_observed_class_metrics(spark):
    total, classes = metrics.evaluate(pairs(spark, ["Authn", "Authn", "Authz", ""], ["Authn", "Authz", "Authz", "x"]))
    assert total.first().accuracy == pytest.approx(2 / 3)
    assert {r.label: r.precision for r in classes.collect()}["Authz"] == 0.5


def test_confusion_and_macro(spark):
    p = pairs(spark, ["A", "B", "B", "C"], ["B", "B", "A", "C"])
    rows = metrics.confusion(p, ("A", "B", "C")).orderBy("position").collect()
    assert [[r.A, r.B, r.C] for r in rows] == [[0, 1, 0], [1, 1, 0], [0, 0, 1]]
    assert metrics.averages(metrics.fixed_classes(p, ("A", "B", "C"))).first().macro_f1 == pytest.approx(0.5)


def test_absent_classes_count(spark):
    classes = tuple("abcdefgh")
    out = metrics.fixed_classes(pairs(spark, ["a"], ["a"]), classes)
    assert out.count() == 8 and metrics.averages(out).first().macro_f1 == pytest.approx(1 / 8)
    with pytest.raises(Exception, match="invalid"):
        metrics.fixed_classes(pairs(spark, ["z"], ["a"]), classes).collect()


def test_multilabel(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "c"]), (2, ["a"], ["a"]), (3, [], [])], "doc int, truth array<string>, predicted array<string>")
    average = metrics.averages(metrics.multilabel(df, "tags")).first()
    assert metrics.exact_match(df, "tags").first().exact_match_accuracy == pytest.approx(2 / 3)
    assert average.micro_f1 == pytest.approx(2 / 3) and average.macro_f1 == pytest.approx(1 / 3)


# Published counts of a 32-document evaluation, and the ratios printed beside them.
@pytest.mark.parametrize(
    "tp,fp,fn,precision,recall,f1",
    [(46, 138, 89, 0.25, 0.340741, 0.288401), (17, 38, 47, 0.309091, 0.265625, 0.285714), (4, 21, 16, 0.16, 0.2, 0.177778)],
)
def test_published_ratios(spark, tp, fp, fn, precision, recall, f1):
    r = metrics.ratios(spark.createDataFrame([(tp, fp, fn)], "tp long, fp long, fn long")).first()
    assert (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6)) == (precision, recall, f1)


def test_published_relevance_confusion(spark):
    matrix = [[1, 0, 0], [24, 0, 1], [4, 0, 2]]
    rows = [("ABC"[i], "ABC"[j]) for i in range(3) for j in range(3) for _ in range(matrix[i][j])]
    out = metrics.averages(metrics.fixed_classes(spark.createDataFrame(rows, "truth string, predicted string"), tuple("ABC"))).first()
    assert round(out.micro_f1, 6) == 0.09375 and round(out.macro_precision, 6) == 0.233716 and round(out.macro_f1, 6) == 0.17037


def test_reviewed_paper_without_labels_has_none(spark):
    papers = spark.createDataFrame([(1, True), (2, False)], "id long, manually_reviewed boolean")
    labels = spark.createDataFrame([(1, "tags", "ai", "x"), (2, "tags", "ai", "CSRF")], "paper_id long, field string, value_source string, label string")
    out = {r.id: r.tags for r in search.with_labels(papers, labels).collect()}
    assert out == {1: [], 2: ["CSRF"]}
    assert [r.id for r in search.having_label(papers, labels, "tags", ["csrf"]).collect()] == [2]


def test_argument_gates(spark):
    papers = spark.createDataFrame([], "id long, status string")
    with pytest.raises(ValueError):
        search.search(papers, papers, favorites_only=1)
    with pytest.raises(ValueError):
        search.search(papers, papers, papers, papers, folder_id=True)


def test_projection_keeps_last_success(spark):
    runs = [(1, 7, "local", "m1", "classified", "{}", None, 1.0), (2, 7, "remote", "m2", "failed", None, "timeout", None)]
    log = spark.createDataFrame(runs, "id long, paper_id long, provider string, model string, status string, result_json string, error string, processing_seconds double")
    r = state.classification_projection(log).first()
    assert (r.classification_status, r.classification_error, r.result_json, r.classification_provider, r.processing_seconds) == ("failed", "timeout", "{}", "local", 1.0)


def test_labels_keep_first_spelling(spark):
    arrivals = spark.createDataFrame([(1, "tags", "ai", "CSRF", 1), (2, "tags", "ai", "csrf ", 2), (2, "tags", "ai", "É", 3), (3, "tags", "ai", "é", 4)], "paper_id long, field string, value_source string, label string, arrival long")
    names = state.label_dictionary(arrivals)
    assert {r.name for r in names.collect()} == {"CSRF", "É", "é"}
    assert {(r.paper_id, r.name) for r in state.junction(arrivals, names).collect()} == {(1, "CSRF"), (2, "CSRF"), (2, "É"), (3, "é")}


def test_replace_labels_with_none(spark):
    schema = "paper_id long, field string, value_source string, label string"
    labels = spark.createDataFrame([(1, "tags", "ai", "a"), (2, "tags", "ai", "b")], schema)
    out = state.replace_labels(labels, spark.createDataFrame([(1, "tags", "ai", None)], schema))
    assert [r.paper_id for r in out.collect()] == [2]


def test_equal_flag_write_changes_nothing(spark):
    now = spark.createDataFrame([(1, True, False)], "paper_id long, is_favorite boolean, read_later boolean")
    changes = spark.createDataFrame([(1, 1, True, None), (2, 2, None, True)], "seq long, paper_id long, is_favorite boolean, read_later boolean")
    out = {r.paper_id: (r.is_favorite, r.read_later, r.changed) for r in state.upsert_flags(now, changes).collect()}
    assert out == {1: (True, False, False), 2: (False, True, True)}


def test_unknown_folder_is_an_error(spark):
    folders = spark.createDataFrame([(1, "a", "a")], "id long, name string, name_key string")
    inside = spark.createDataFrame([(1, 1), (2, 1)], "paper_id long, folder_id long")
    assert state.set_membership(inside, spark.createDataFrame([(1, None)], "paper_id long, folder_id long"), folders).collect()[0].paper_id == 2
    with pytest.raises(Exception, match="unknown folder"):
        state.set_membership(inside, spark.createDataFrame([(1, 9)], "paper_id long, folder_id long"), folders).collect()


def test_refresh_changes(spark):
    schema = "id long, title string, authors array<string>, year int, venue string, abstract string, keywords array<string>, introduction_excerpt string, metadata_sources map<string,string>, review_reasons array<string>"
    old = spark.createDataFrame([(1, "t", ["a"], None, None, ". x", ["k·l"], None, {"a": "b", "c": "d"}, []), (2, "t", [], 2000, "v", "x", [], None, {}, [])], schema)
    new = spark.createDataFrame([(1, "t", ["a"], None, None, "x", ["k", "l"], None, {"c": "d", "a": "b"}, []), (2, "t", [], 2001, "v", "x", [], None, {}, [])], schema)
    out = {r.id: (r.changes, r.input_changed) for r in refresh.changes(old, new).collect()}
    assert out == {1: (["abstract", "keywords"], True), 2: (["year"], False)}
    forms = refresh.format_only(old, new)
    assert {r.id: r.format_only for r in forms.collect()} == {1: True, 2: True}
    assert refresh.summary(refresh.changes(old, new)).first().asDict() == {"papers": 2, "changed": 2, "input_changed": 1, "bibliographic_only": 1}
    decisions = spark.createDataFrame([(1, "B"), (3, "A")], "id long, verdict string")
    targets = spark.createDataFrame([(1,), (2,)], "id long")
    assert {(r.id, r.error) for r in refresh.audit_errors(targets, decisions, forms).collect()} == {(2, "no decision"), (3, "not a candidate")}


def test_index_errors(spark):
    good = spark.createDataFrame([(k, f"{k:064x}") for k in range(1, 6)], "id long, file_hash string")
    assert refresh.index_errors(good, 1, 5).collect() == []
    assert {r.error for r in refresh.index_errors(good.withColumn("file_hash", F.lit("x")), 1, 6).collect()} == {"id missing", "hash twice", "not a hash"}
