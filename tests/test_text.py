import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import digest
from lectern.functions import text as tx


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return rows.select(column.alias("x")).first().x


@pytest.mark.parametrize("value,clean", [("  a \t b\x1cc ", "a b c"), ("  　", None), (None, None)])
def test_collapse(spark, value, clean):
    assert one(spark, tx.blank_to_null(F.col("v")), v=value) == clean


def test_equalities_differ(spark):
    assert one(spark, tx.ascii_lower(F.col("v")), v="CSRF É") == "csrf É"
    assert one(spark, tx.casefold(F.col("v")), v="Straße") == "strasse"
    key = tx.folder_key(F.col("v"))
    assert one(spark, key, v="Straße") == one(spark, key, v="STRASSE")
    assert one(spark, key, v="Café") == one(spark, key, v="Café")


@pytest.mark.parametrize("pattern,hit", [("a_b%", True), ("a~b", False), ("A", False), ("%\\%", False)])
def test_like_has_no_escape(spark, pattern, hit):
    assert one(spark, tx.like_ascii(F.col("v"), pattern), v="AxBc") is hit


@pytest.mark.parametrize("name,out", [("dir/My_paper-v2.pdf", "My paper v2"), ("__.pdf", "Unknown paper"), (".hidden", ".hidden"), ("a.b.pdf", "a.b")])
def test_title_from_filename(spark, name, out):
    assert one(spark, tx.title_from_filename(F.col("v")), v=name) == out


def test_bodies(spark):
    assert one(spark, tx.clean_body(F.col("v")), v="﻿authen-\n tication\tof\n\nusers  here ") == "authentication of users here"
    assert one(spark, tx.normalize(F.col("v")), v="a b\x00 c-\nd") == "a b cd"
    assert one(spark, tx.join_cjk(F.col("v")), v="認 証 Web 系") == "認証Web 系"
    assert one(spark, tx.cut_at_first(F.col("v"), r"\d+"), v="abc 12 d") == "abc "
    assert one(spark, tx.cut_at_first(F.col("v"), r"\d+"), v="abc") == "abc"
    assert one(spark, tx.ascii_letter_ratio(F.col("v")), v="ab認1") == pytest.approx(2 / 3)


def test_lists(spark):
    assert one(spark, tx.clean_list(F.col("v")), v=["A  b", "a B", "", "c"]) == ["A b", "c"]
    assert one(spark, tx.clean_keywords(F.col("v")), v=["web,", " Web ", "†x*"]) == ["web", "x"]


@pytest.mark.parametrize(
    "field,values,out",
    [
        ("tags", ["csrf", "Cross-Site  Request Forgery", "SQLi", "black box testing"], ["Black-box Testing", "CSRF", "SQL Injection"]),
        ("research_methods", ["csrf", "Black box testing"], ["Black-box Testing", "csrf"]),
        ("target_vulnerabilities", ["Login CSRF", "IDOR", "BOLA", "Foo", "foo"], ["BOLA", "Foo", "IDOR", "Login CSRF", "foo"]),
        ("tags", [], []),
    ],
)
def test_label_aliases(spark, field, values, out):
    assert one(spark, tx.normalize_labels(F.col("v"), field), v=values) == out


@pytest.mark.parametrize("values", [None, ["a", " "], ["a", None]])
def test_missing_labels_are_an_error(spark, values):
    df = spark.createDataFrame([(values,)], "v array<string>")
    with pytest.raises(Exception, match="nonempty strings"):
        df.select(tx.normalize_labels(F.col("v"), "tags")).collect()


def test_folder_names(spark):
    assert one(spark, tx.valid_folder_name(F.col("v")), v="  A ") == "A"
    assert one(spark, tx.valid_folder_name(F.col("v")), v="a\x07b") is None
    assert one(spark, tx.valid_folder_name(F.col("v")), v="x" * 101) is None


@pytest.mark.parametrize("value,good", [(0.0, True), (None, True), (-1.0, False), (math.inf, False), (math.nan, False)])
def test_seconds(spark, value, good):
    assert spark.createDataFrame([(value,)], "v double").select(tx.valid_seconds(F.col("v")).alias("x")).first().x is good


def test_digests():
    assert digest.canonical_bytes({"b": [1, "é"], "a": None}) == '{"a":null,"b":[1,"é"]}'.encode()
    with pytest.raises(ValueError):
        digest.canonical_bytes(math.nan)
    sealed = digest.sealed({"x": 1})
    assert digest.unsealed(sealed) == {"x": 1}
    with pytest.raises(ValueError):
        digest.unsealed(sealed | {"content": {"x": 2}})


@pytest.mark.parametrize("bad", [0, -1, True, 1.0, "1", 1 << 63])
def test_ids(bad):
    with pytest.raises(ValueError):
        digest.positive_id(bad)


@pytest.mark.parametrize("bad", [True, "1", -0.1, math.nan, math.inf])
def test_driver_seconds(bad):
    with pytest.raises(ValueError):
        digest.seconds(bad)


@pytest.mark.parametrize("bad", ["https://127.0.0.1", "http://example.org", "http://u:p@127.0.0.1", "http://127.0.0.1/x", "http://127.0.0.1?x=1", "http://10.0.0.1"])
def test_endpoints(bad):
    assert digest.local_endpoint("http://127.0.0.1") == ("127.0.0.1", 11434)
    assert digest.local_endpoint("http://[::1]:80/") == ("::1", 80)
    with pytest.raises(ValueError):
        digest.local_endpoint(bad)
