import pytest

from lectern.queries import QUERIES, SQL
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert len(df.columns) == len(set(df.columns)) and df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("name", ["canonical_labels", "label_junction"])
def test_a_commit_of_labels_is_not_computed_again(spark, sf, name):
    """Each commit's dictionary is read as written; it carried the plans of all commits before, three times each."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "Generate" not in plan and plan.count("Relation") <= 3


def test_one_record_with_two_kinds_of_evidence(spark, tmp_path):
    """A serial's volume and a field of the publication in one line weigh the same: the field is the source. The SQL leaves that tie open."""
    line = "Journal of Web Safety, Vol. 3; Published: 3 June 2001"
    rows = [(i, line, "en", "s", len(line)) for i in (6, 16, 26, 36)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["publication_evidence"](spark, str(tmp_path))
    assert {r.year_source for r in df.collect()} == {"first page publication header"}
