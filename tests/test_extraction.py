"""Extraction as a plan over parsed documents: what each field is, and what shows it."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import clean_body
from lectern.model import BLOCK, PARSED
from lectern.operators import authors, evidence, fields, layout
from lectern.operators import extraction as ex


def block(text, y0, size=10.0, x0=60.0, width=400.0, height=None, way=(1.0, 0.0), lines=()):
    box = {"x0": float(x0), "y0": float(y0), "x1": float(x0 + width), "y1": float(y0 + (height or size * 1.2)), "font_size": float(size)}
    return {"text": text, **box, "direction": {"dx": way[0], "dy": way[1]}, "lines": [{"text": t, **box, "y0": float(y)} for t, y in lines]}


def parsed(text="", blocks=(), properties=None, first=None, pages=()):
    return {"text": text, "first_page_text": first if first is not None else text, "metadata": properties or {}, "page_count": 1, "first_page_blocks": list(blocks), "first_page_size": {"width": 600.0, "height": 800.0}, "page_layouts": list(pages)}


PROSE = "We study how web applications manage sessions, and measure how often they fail to end them when users log out of the service. " * 2
SIZE = {"width": 600.0, "height": 800.0}


def documents():
    blocks = [
        block("arXiv:2401.00001v1", 100, 20, way=(0.0, 1.0)), block("A Study of Session Management", 80, 18), block("in Web Applications", 103, 18), block("Ada Lovelace and Jean van der Berg", 140),
        block("University of Somewhere", 155), block("Abstract", 200, width=60), block(PROSE, 215, height=60), block("1 Introduction", 300, 12), block("Web sessions are old.", 320),
    ]
    yield "layout.pdf", parsed("\n".join(b["text"] for b in blocks), blocks)
    yield "some_paper-final.pdf", parsed()
    yield "agree.pdf", parsed("", [block("Token Leakage in Practice", 80, 18), block("ADA LOVELACE", 120), block("Alan Turing", 135)], {"author": "Alan Turing; Ada Lovelace"})
    yield "keywords.pdf", parsed("Abstract\n" + "Long words of text. " * 600 + "\nKeywords: OAuth, Single Sign-On; OAuth\n\n1 Introduction\nText.")
    yield "contents.pdf", parsed("Contents\nIntroduction\n5\nOther\nIntroduction\n" + PROSE + "\nDepartment of Computing\nmore")
    cover = block("Proceedings of the 9th Workshop", 400, 12)
    body = {"text": "Abstract\n" + PROSE, "size": SIZE, "blocks": [block("A Body Page Title Here", 80, 18), block("Abstract", 200, width=60), block(PROSE, 215, height=60)]}
    yield "cover.pdf", parsed(cover["text"], [cover], pages=[{"text": cover["text"], "size": SIZE, "blocks": [cover]}, body])
    # A second column beside the abstract, a gap below it, and a summary of two paragraphs without a label.
    left, right = {"x0": 60.0, "width": 220.0}, {"x0": 320.0, "width": 220.0}
    yield "columns.pdf", parsed("", [
        block("Two Columns of Sessions", 60, 20), block("Abstract", 200, **left), block("First part of the abstract, which is long enough to count.", 215, height=40, **left), block("Other column entirely.", 216, height=40, **right),
        block("Second part of it.", 260, height=20, **left), block("Far below, of something else.", 400, height=20, **left),
    ])
    yield "plain.pdf", parsed("", [
        block("Untold Summaries of Sessions", 60, 20), block("University of Somewhere", 100), block(PROSE, 150, height=40), block("Longest. " + PROSE + PROSE, 195, height=80), block("After a gap. " + PROSE, 330, height=40), block("1 Introduction", 500),
    ])
    yield "usenix.pdf", parsed("", [
        block("This paper is included in the Proceedings of the 30th USENIX Security Symposium.", 700, 9), block("A Title on the Cover", 250, 24), block("of Three Lines in", 276, 24), block("All of This Size", 302, 24), block("Far Line", 390, 24),
    ])
    yield "rows.pdf", parsed("", [block("Names in Rows of Blocks", 60, 20), block("x", 100, lines=[("Ada", 100), ("Lovelace", 110), ("Dept. of Computing, Oslo", 120), ("Not Read Here", 130), ("a@b.org", 140), ("Alan Turing", 150)]), block("Grace Hopper, MIT", 180), block("Abstract", 300)])
    yield "prefix.pdf", parsed("Keywords: web, x@y.org\nIndex Terms: a, b-\n", properties={"keywords": "From; Property", "title": "A Title by Property Only"}, first="")


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([*documents(), *list(documents())[:1], ("null.pdf", None)], f"filename string, parsed {PARSED.simpleString()}")
    out = ex.extracted(rows).collect()
    assert len(out) == len(list(documents())) + 2
    return {r.filename: r for r in out}


def prose(spark, text):
    return spark.range(1).select(clean_body(F.lit(text))).first()[0]


def test_layout_title_authors_and_abstract(spark, found):
    m = found["layout.pdf"].metadata
    assert m.title == "A Study of Session Management in Web Applications" and m.authors == ["Ada Lovelace", "Jean van der Berg"] and m.abstract == prose(spark, PROSE)
    assert m.metadata_sources == {"title": "first page layout", "authors": "first page layout", "abstract": "first page layout"}
    assert m.review_reasons == [] and m.introduction_excerpt is None


def test_empty_document(found):
    m = found["some_paper-final.pdf"].metadata
    assert m.title == "some paper final" and m.authors == [] and m.year is None
    assert m.review_reasons == [ex.NO_RELIABLE_TITLE, ex.NO_RELIABLE_TEXT] and m.metadata_sources == {"title": "filename fallback"}


def test_properties_win_when_they_agree_with_the_page(found):
    m = found["agree.pdf"].metadata
    assert m.authors == ["Alan Turing", "Ada Lovelace"] and m.metadata_sources["authors"] == "PDF metadata"


def test_keywords_and_limits(found):
    m = found["keywords.pdf"].metadata
    assert m.keywords == ["OAuth", "Single Sign-On"] and 5990 < len(m.abstract) <= 6000
    m = found["prefix.pdf"].metadata
    assert m.keywords == ["From", "Property"] and m.title == "A Title by Property Only" and m.metadata_sources["keywords"] == m.metadata_sources["title"] == "PDF metadata"


def test_introduction_skips_contents(spark, found):
    assert found["contents.pdf"].metadata.introduction_excerpt == prose(spark, PROSE)


def test_cover_page_title_of_body(found):
    m = found["cover.pdf"].metadata
    assert m.title == "A Body Page Title Here" and m.metadata_sources["title"] == "second page layout" and m.metadata_sources["abstract"].startswith("second page")


def test_columns_and_gaps(spark, found):
    m = found["columns.pdf"].metadata
    assert m.abstract == "First part of the abstract, which is long enough to count. Second part of it."
    m = found["plain.pdf"].metadata
    assert m.abstract == prose(spark, PROSE + "\nLongest. " + PROSE + PROSE) and m.metadata_sources["abstract"] == "first page layout fallback"


def test_title_of_a_cover(found):
    m = found["usenix.pdf"].metadata
    assert m.title == "A Title on the Cover of Three Lines in All of This Size" and m.metadata_sources["title"] == "first page cover layout"


def test_rows_of_authors(found):
    """A broken name is joined; none is read inside an affiliation, until its mail row; a name may stand before its affiliation."""
    assert found["rows.pdf"].metadata.authors == ["Ada Lovelace", "Alan Turing", "Grace Hopper"]


def test_rows_are_isolated(found):
    assert found["layout.pdf"].failure is None and found["null.pdf"].failure == "TypeError" and found["null.pdf"].metadata is None


NAMES = [("Ada Lovelace1,2, Alan M. Turing†", ["Ada Lovelace", "Alan M. Turing"]), ("Jos´e Garcia and Maria de Cruz", ["José Garcia", "Maria de Cruz"]), ("山田太郎, 鈴木一郎", ["山田太郎", "鈴木一郎"]), ("University of Oslo", []), ("ada lovelace", [])]


def test_names(spark):
    rows = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(NAMES)], "k int, row string").withColumn("form", authors.compatible(authors.joined_accents(F.col("row"))))
    assert {r.k: r.n for r in rows.select("k", authors.names_in(F.col("row"), F.col("form")).alias("n")).collect()} == {k: n for k, (_, n) in enumerate(NAMES)}
    twice = spark.range(1).select(authors.unique(F.array(*map(F.lit, ["ADA L", "Bo B", "Ada L"]))).alias("n")).first().n
    assert twice == ["Ada L", "Bo B"]


VENUES = [
    ("30th USENIX Security Symposium", "USENIX Security Symposium"), ("Proceedings of the 28th USENIX Security Symposium", "USENIX Security Symposium"), ("Journal of Web Security, Vol. 12, 2020", "Journal of Web Security"),
    ("Paper published at Workshop on Web Security.", "Workshop on Web Security"), ("We discuss the USENIX Security Symposium", None), ("Received 3 May 2020, Journal of X, Vol. 2", None),
    ("Proceedings of the International Conference on Web Safety", "International Conference on Web Safety"), ("Network and Distributed System Security (NDSS) Symposium 2020", "Network and Distributed System Security (NDSS) Symposium"),
    ("NDSS ’20 San Diego", "NDSS"), ("talk of NDSS 2020", None), ("published in the University Press of Conference", None),
]


def test_venues(spark):
    rows = spark.createDataFrame([(v,) for v, _ in VENUES], "r string").select("r", evidence.venue_of(F.col("r"))["name"].alias("v"))
    assert {r.r: r.v for r in rows.collect()} == dict(VENUES)


YEARS = [
    ("Journal of Web Security, Vol. 12, 2019\n© 2020 The Authors", {}, 2019, "first page journal header"), ("© 2020 The Authors", {}, 2020, "first page copyright line"), ("© 2020 The Authors", {"year": "2021"}, 2021, "PDF metadata"),
    ("Accessed 2018", {}, None, None), ("Received: 1 May 2018; Published: 3 June 2019", {}, 2019, "first page publication header"), ("", {"publicationdate": "2020-13-01"}, None, None), ("", {"year": "2020;2021"}, None, None),
    ("", {"publicationdate": "2020-02"}, 2020, "PDF metadata"), ("", {"publicationdate": "2020-02-30T10:00"}, None, None), ("", {"publicationdate": "2020-02-03T10:11:12Z"}, 2020, "PDF metadata"),
    ("Proceedings of the 9th Workshop on Things\nAugust 12, 2003", {}, 2003, "first page proceedings date"), ("© 2019 A\n© 2020 B", {}, None, None), ("30th USENIX Security Symposium 2021\n© 2022", {}, 2021, "first page proceedings header"),
]


@pytest.fixture(scope="module")
def dated(spark):
    none = F.array().cast(T.ArrayType(BLOCK))
    return spark.createDataFrame([(str(k), t, p) for k, (t, p, _, _) in enumerate(YEARS)], "key string, text string, properties map<string,string>").withColumn("blocks", none)


def test_years(dated):
    got = {r.key: (r.year, r.source) for r in evidence.agreed(evidence.evidence(dated, evidence.located(dated))).collect()}
    assert [got.get(str(k), (None, None)) for k in range(len(YEARS))] == [(y, s) for _, _, y, s in YEARS]


def test_footers_and_covers(spark):
    low = [block("text at the top", 10), block("30th USENIX Security Symposium", 700)]
    rows = spark.createDataFrame([("a", "30th USENIX Security Symposium\nAbstract", low, {}), ("b", "Proceedings of the 30th USENIX Security Symposium", low, {})], f"key string, text string, blocks {T.ArrayType(BLOCK).simpleString()}, properties map<string,string>")
    assert {r.key: r.source for r in evidence.venues(evidence.located(rows)).collect()} == {"a": "first page proceedings footer", "b": "first page proceedings cover"}


def test_bad_titles(spark):
    bad = ["arXiv:2401.00001v2 [cs.CR]", "Proceedings of X", "main-v2.pdf", "12 34", "Abstract of it", "ab", "mail a@b.org here", "Untitled", None]
    rows = spark.createDataFrame([(t,) for t in [*bad, "  Web- \n based  Auth* "]], "t string").select(fields.title_or_null(F.col("t")).alias("t"))
    assert [r.t for r in rows.collect()] == [None] * len(bad) + ["Webbased Auth"]


def test_documents_are_dealt_once(spark):
    """Windows and aggregations over blocks, lines and records follow the one exchange on the document's key."""
    rows = spark.createDataFrame(list(documents())[:1], f"filename string, parsed {PARSED.simpleString()}")
    docs = ex.documents(rows)
    blocks = layout.blocks(ex.pages_of(docs))
    for plan in (layout.titles(blocks), layout.runs(blocks, ("key", "page"), F.col("at") == 0)):
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_common_title_is_cleaned_once(spark):
    """The patterns of a bad title read one clean form of it; each made its own."""
    from lectern.operators.fields import title_or_null

    plan = spark.range(1).select(title_or_null(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= 8
