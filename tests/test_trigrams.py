"""LIKE through a trigram index: the same rows, and few of them compared."""

import pytest

from lectern.functions.text import like_ascii
from lectern.operators import trigrams
from pyspark.sql import functions as F

TEXTS = [(1, "Session Management"), (2, "session  handling"), (3, "ÉTÉ sess"), (4, "ab"), (5, ""), (6, None), (7, "Ses_sion %x"), (8, "\U0001f600\U0001f601\U0001f602 sessions of a kind"), (9, "été session")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string").cache()


@pytest.mark.parametrize("pattern", ["%session%", "%SES_ION%", "%ses%ment%", "%ab%", "%e_sio%", "%", "ses%", "%été%", "%ÉTÉ%", "%absent words%", "%\U0001f601\U0001f602 %"])
def test_same_rows(texts, pattern):
    plain = {r.id for r in texts.where(like_ascii(F.col("text"), trigrams.folded(pattern))).collect()}
    assert plain or "absent" in pattern
    assert {r.id for r in trigrams.matching(texts, trigrams.index(texts), pattern).collect()} == plain


def test_few_rows_are_compared(spark):
    many = spark.range(500).select("id", F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" of many")).alias("text"))
    found = trigrams.candidates(trigrams.index(many), "%ber 123 of%")
    assert [r.id for r in found.collect()] == [123]
    assert trigrams.candidates(trigrams.index(many), "%a_b%") is None


def test_the_index_is_shuffled_once(spark, texts):
    """Each trigram of a text is dealt once, on its way to its file; it was dealt to be made unique and again to be sorted."""
    plan = trigrams.index(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
