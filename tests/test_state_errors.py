"""Updates of what is not there or not allowed, and a dictionary that keeps its names and ids."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import state


@pytest.fixture(scope="module")
def folders(spark):
    return spark.createDataFrame([(1, "Web", "web"), (2, "Été", "été")], "id long, name string, name_key string")


@pytest.mark.parametrize("name", ["a\x07b", "a\nb", "", "  ", "x" * 101])
def test_folder_names(spark, folders, name):
    with pytest.raises(Exception, match="a folder name must be"):
        state.create_folders(folders, spark.createDataFrame([(name,)], "name string"), 3).collect()
    with pytest.raises(Exception, match="a folder name must be"):
        state.rename_folder(folders, 1, name).collect()


def test_renaming_a_folder_that_is_not_there(folders):
    with pytest.raises(Exception, match="no folder has this id"):
        state.rename_folder(folders, 7, "New").collect()


def test_updating_a_paper_that_is_not_there(spark):
    papers = spark.createDataFrame([(1, "t", "pending", None)], "id long, title string, classification_status string, classification_error string")
    update = lambda id: spark.createDataFrame([(id, 1, "new", "failed", "e")], "id long, seq int, title string, status string, error string")
    assert [tuple(r) for r in state.update_metadata(papers, update(1), ["title"]).collect()] == [(1, "new", "failed", "e")]
    with pytest.raises(Exception, match="no paper has this id"):
        state.update_metadata(papers, update(2), ["title"]).collect()


def test_review_labels_are_cut_and_folded(spark):
    labels = spark.createDataFrame([], "paper_id long, field string, value_source string, label string")
    reviews = spark.createDataFrame([(1, ["Straße", "STRASSE", "É", "é", "y" * 130], None, None)], "paper_id long, tags array<string>, research_methods array<string>, target_vulnerabilities array<string>")
    assert sorted(r.label for r in state.review_labels(labels, reviews).collect()) == ["Straße", "y" * 120, "É"]


def test_dictionary_keeps_names_and_ids(spark):
    """A later spelling is the same entry, an entry that no batch uses any more stays, and new ids follow the highest."""
    batches = [[("tags", "Web", 1), ("tags", "web", 2), ("tags", "É", 2)], [("tags", "WEB", 3), ("tags", "é", 3), ("methods", "Web", 3)], [("tags", " new  one ", 4)]]
    dictionary = spark.createDataFrame([], "id long, field string, label_key string, name string")
    seen = {}
    for rows in batches:
        dictionary = state.extended_dictionary(dictionary, spark.createDataFrame(rows, "field string, label string, arrival long"))
        now = {(r.field, r.label_key): (r.id, r.name) for r in dictionary.collect()}
        assert all(now[k] == v for k, v in seen.items()) and sorted(i for i, _ in now.values()) == list(range(1, len(now) + 1))
        seen = now
    assert {k: n for k, (_, n) in seen.items()} == {("tags", "web"): "Web", ("tags", "É"): "É", ("tags", "é"): "é", ("methods", "web"): "Web", ("tags", "new one"): "new one"}


def test_numbering_has_no_gaps(spark):
    rows = state.numbered(spark.range(3000).withColumnRenamed("id", "v"), F.sha2(F.col("v").cast("string"), 256), 5)
    out = sorted((r.id, r.v) for r in rows.collect())
    assert [i for i, _ in out] == list(range(5, 3005))
