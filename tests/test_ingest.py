import pytest
from pyspark.sql import functions as F

from lectern.operators import extraction
from lectern.plans import ingest
from lectern.sources import files
from lectern.sources.store import Store
from lectern.streaming import inbox

TEXT = "This text about session management and authentication is long enough to pass the gate that holds poor inputs back."


def library(spark, rows):
    return spark.createDataFrame(rows, "id long, file_hash string, classification_status string")


def inputs(spark, rows):
    schema = "filepath string, filename string, file_hash string, title string, abstract string, failure string"
    return spark.createDataFrame(rows, schema)


def extract(df):
    none = F.array().cast("array<string>")
    m = F.struct(
        "title", none.alias("authors"), F.lit(2020).alias("year"), F.lit(None).cast("string").alias("venue"), "abstract", none.alias("keywords"),
        F.lit(None).cast("string").alias("introduction_excerpt"), F.create_map().cast("map<string,string>").alias("metadata_sources"), none.alias("review_reasons"),
    )
    return df.withColumn("metadata", F.when(F.col("failure").isNull(), m))


ROWS = [
    ("/a", "a", "h1", "A good long title", TEXT, None),
    ("/b", "b", "h1", "A good long title", TEXT, None),
    ("/c", "c", "h2", "bad", TEXT, None),
    ("/d", "d", "h3", "A good long title", TEXT, "PDFParseError"),
    ("/e", "e", "h4", "A good long title", TEXT, None),
    ("/f", "f", "h5", "A good long title", TEXT, None),
]


class Failing:
    provider, model = "local", "fails"

    def classify(self, batch):
        return ["timeout"] * len(batch)


@pytest.mark.parametrize(
    "classifier,expected",
    [
        (ingest.RuleClassifier(), {"a": "Classified", "b": "Skipped", "c": "Needs review", "d": "Failed", "e": "Skipped", "f": "Classified"}),
        (None, {"a": "Pending", "b": "Skipped", "c": "Needs review", "d": "Failed", "e": "Skipped", "f": "Pending"}),
        (Failing(), {"a": "Failed", "b": "Skipped", "c": "Needs review", "d": "Failed", "e": "Skipped", "f": "Failed"}),
    ],
)
def test_scan(spark, classifier, expected):
    papers = library(spark, [(1, "h4", "classified"), (2, "h5", "failed")])
    out = {r.filename: r for r in ingest.plan(inputs(spark, ROWS), papers, extract, classifier).collect()}
    assert {k: r.status for k, r in out.items()} == expected
    assert out["f"].paper_id == 2 and out["f"].route == "Retry" and out["d"].message == "Processing failed (PDFParseError)"
    if classifier and classifier.model == "rules":
        assert out["a"].classification.primary_category == "Session Management" and out["f"].message == "Classification retry succeeded"


def test_a_file_is_extracted_once(spark):
    """Ready, held and failed files are parts of one extraction; it ran once for each of them."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    ingest.plan(inputs(spark, ROWS), library(spark, []), lambda df: extract(df.mapInPandas(counted, df.schema)), ingest.RuleClassifier()).collect()
    assert read.value == 5


@pytest.mark.parametrize(
    "title,abstract,introduction,n",
    [("A proper title", TEXT, None, 0), ("short", TEXT, None, 1), ("A proper title", "x" * 79, "y" * 200, 1), ("A proper title", None, "y" * 120, 0), (None, None, None, 2), ("A proper title", "httpxproxy " * 20, None, 1)],
)
def test_gate(spark, title, abstract, introduction, n):
    df = spark.createDataFrame([(title, abstract, introduction)], "t string, a string, i string")
    assert len(df.select(ingest.input_issues(F.col("t"), F.col("a"), F.col("i")).alias("x")).first().x) == n


GOOD = {"primary_category": "Authorization", "tags": ["a", " A "], "research_methods": [], "target_vulnerabilities": [], "relevance": "A", "relevance_reason": " because ", "relevance_confidence": 1}


@pytest.mark.parametrize("change", [{"extra": 1}, {"relevance": "D"}, {"tags": "a"}, {"tags": ["a", 1]}, {"tags": ["x"] * 31}, {"relevance_reason": " "}, {"relevance_confidence": True}, {"relevance_confidence": 1.1}])
def test_strict_answers(change):
    assert ingest.valid_answer(GOOD)["tags"] == ["a"]
    with pytest.raises(ValueError):
        ingest.valid_answer(GOOD | change)


def write(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_files(spark, tmp_path):
    write(tmp_path, "a.pdf", b"%PDF-1.4\nx")
    write(tmp_path, "sub/B.PDF", b"%PDF-1.4\nx")
    write(tmp_path, "bad.pdf", b"no")
    write(tmp_path, "c.txt", b"%PDF-1.4")
    found = files.identified(files.scan(spark, str(tmp_path)))
    assert [r.name for r in files.discovered(files.scan(spark, str(tmp_path))).collect()] == ["a.pdf", "B.PDF"]
    assert {r.name: r.error for r in files.inventory(found).collect()} == {"a.pdf": None, "B.PDF": "duplicate", "bad.pdf": "invalid"}
    papers = spark.createDataFrame([(1, "gone", "g.pdf", "/g.pdf")], "id long, file_hash string, filename string, filepath string")
    assert sorted(r.status for r in files.reconcile(found, papers).collect()) == ["missing", "unexpected", "unexpected"]
    assert files.located(papers, found).first().path is None
    assert files.within(str(tmp_path / "a.pdf"), str(tmp_path)) and not files.within(str(tmp_path / ".." / "x"), str(tmp_path))


def test_csv_with_mark(spark, tmp_path):
    write(tmp_path, "e.csv", "﻿truth,predicted\nA,\n".encode())
    assert files.evaluation_csv(spark, f"{tmp_path}/e.csv", ["truth", "predicted", "model"]).columns == ["truth", "predicted", "model"]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/library")
    one = store.commit({"papers": spark.range(3), "notes": spark.range(1)}, None)
    digest = store.digest()
    two = store.commit({"papers": spark.range(5)}, one)
    assert store.read("papers").count() == 5 and store.read("notes").count() == 1 and store.read("papers", one).count() == 3
    assert store.digest(one) == digest != store.digest(two)
    with pytest.raises(ValueError, match="changed"):
        store.commit({"papers": spark.range(1)}, one)

    def refuse(s, version):
        raise RuntimeError("protected columns differ")

    with pytest.raises(RuntimeError):
        store.commit({"papers": spark.range(1)}, two, refuse)
    assert store.version() == two


def test_stream(spark, tmp_path):
    write(tmp_path, "in/a.pdf", b"%PDF-1.4\nx")
    write(tmp_path, "in/b.pdf", b"%PDF-1.4\nx")
    seen = []
    for _ in range(2):
        inbox.ingest(inbox.arrivals(spark, f"{tmp_path}/in"), lambda df, k: seen.extend(r.filename for r in df.collect()), f"{tmp_path}/state").awaitTermination(120)
    assert len(seen) == 1


def test_extraction_feeds_the_scan(spark):
    from lectern.model import PARSED

    document = {"text": "Abstract\n" + TEXT * 2, "first_page_text": "Abstract\n" + TEXT * 2, "metadata": {"title": "Session Management Studied"}, "page_count": 1, "first_page_blocks": [], "first_page_size": None, "page_layouts": []}
    rows = spark.createDataFrame([("/a", "a.pdf", "h1", document)], f"filepath string, filename string, file_hash string, parsed {PARSED.simpleString()}")
    out = ingest.plan(rows, library(spark, []), extraction.extracted, ingest.RuleClassifier()).first()
    assert out.status == "Classified" and out.metadata.title == "Session Management Studied"
