"""Classifier contract, manifests, settings, text blocks, form input, folders and pointers."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import __main__ as cli
from lectern import settings
from lectern.functions.digest import local_endpoint
from lectern.operators import blocks, state
from lectern.plans import contract, manifest, refresh
from lectern.sources.store import Store

GOOD = {"primary_category": "Authentication", "tags": ["a"], "research_methods": [], "target_vulnerabilities": [], "relevance": "A", "relevance_reason": "why", "relevance_confidence": 0.5}


def test_schema_requires_every_field_and_no_other():
    s = contract.schema()
    assert set(s["required"]) == set(s["properties"]) == set(GOOD) and s["additionalProperties"] is False
    json.dumps(s)


def test_messages_are_gated_and_bounded(spark):
    rows = spark.createDataFrame([("A title of some length", "x" * 7000, ["k"] * 40, None), ("x", None, [], "short")], "title string, abstract string, keywords array<string>, introduction_excerpt string")
    good, held = contract.messages(rows).collect()
    record = json.loads(good.messages[1].content)
    assert [m.role for m in good.messages] == ["system", "user"] and len(record["abstract"]) == 6000 and len(record["keywords"]) == 30
    assert held.messages is None and len(held.issues) == 2


class Fake:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), 0

    def __call__(self, record):
        self.asked += 1
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer if isinstance(answer, str) else json.dumps(answer)


@pytest.mark.parametrize(
    "answers,retries,asked,good",
    [
        ((GOOD,), 1, 1, True), (("no json", GOOD), 1, 2, True), (("no json", GOOD), 0, 1, False), (({"a": 1}, "x"), 1, 2, False),
        ((contract.Unreachable(), GOOD), 1, 1, False), ((GOOD | {"tags": [1]}, GOOD), 1, 2, True), ((GOOD | {"more": 1},), 0, 1, False),
    ],
)
def test_retries(answers, retries, asked, good):
    import pandas as pd

    fake = Fake(*answers)
    out = contract.Retrying(fake, "m", retries=retries).classify(pd.DataFrame([{"title": "t"}]))
    assert fake.asked == asked and isinstance(out[0], dict) == good


def test_nothing_is_sent_before_the_provider_is_ready():
    import pandas as pd

    def absent():
        raise contract.Unreachable

    fake = Fake(GOOD)
    assert contract.Retrying(fake, "m", ready=absent).classify(pd.DataFrame([{"title": "t"}])) == ["Unreachable"] and fake.asked == 0
    with pytest.raises(ValueError):
        contract.Retrying(fake, "m", retries=2)


def test_factory_has_no_fallback():
    assert contract.create("none") is None and contract.create("rules").model == "rules"
    with pytest.raises(ValueError):
        contract.create("other")


def test_manifest_is_pinned_and_bound(spark, tmp_path, capsys):
    old = spark.createDataFrame([(1, "a", 2000), (2, "b", 2001), (3, "c", 2002)], "id long, title string, year int")
    new = old.withColumn("title", F.when(F.col("id") == 1, "z").otherwise(F.col("title"))).withColumn("year", F.when(F.col("id") == 2, 1999).otherwise(F.col("year")))
    seen = manifest.observation(refresh.changes(old, new, ("title", "year")), "store-digest")
    assert seen["input_changed"] == [1] and seen["bibliographic_only"] == [2] and seen["fields"] == {"title": 1, "year": 1}
    code, path = manifest.code_identity(), f"{tmp_path}/m.json"
    assert "plans/manifest.py" in code
    pin = manifest.freeze(path, code, seen, [{"id": 2, "verdict": "A"}, {"id": 1, "verdict": "B"}])
    with pytest.raises(FileExistsError):
        manifest.freeze(path, code, seen, [])
    loaded = manifest.load(path, pin)
    bound = manifest.bind(loaded, {"version": "v"})
    assert manifest.check(loaded, bound, code, "store-digest") == {"version": "v"}
    for bad in (lambda: manifest.load(path, "0" * 64), lambda: manifest.check(loaded, bound, code | {"x.py": "0"}), lambda: manifest.check(loaded, bound, code, "other"),
                lambda: manifest.check(loaded | {"decisions": []}, bound, code), lambda: manifest.covered({1, 9}, {1})):
        with pytest.raises(ValueError):
            bad()
    manifest.covered({1}, {1, 2})
    assert cli.main(["refresh", "--report", path, pin]) == 0 and "| changed | 2 |" in capsys.readouterr().out


def test_settings(tmp_path):
    assert settings.read({}) == settings.Settings()
    got = settings.read({"LECTERN_INBOX": " in ", "LECTERN_ENDPOINT": "http://localhost:5000", "LECTERN_RETRIES": "0", "LECTERN_STORE": " "})
    assert (got.inbox, got.endpoint, got.retries, got.store) == ("in", ("127.0.0.1", 5000), 0, "library")
    for bad in ({"LECTERN_RETRIES": "2"}, {"LECTERN_ENDPOINT": "http://example.org"}):
        with pytest.raises(ValueError):
            settings.read(bad)
    log = settings.logger(settings.Settings(logs=f"{tmp_path}/logs"))
    log.info("paper 1: classified")
    assert "paper 1" in (tmp_path / "logs" / "lectern.log").read_text()
    assert local_endpoint("http://[::1]:80") == ("::1", 80)


def test_text_blocks(spark):
    flat, up = (1.0, 0.0), (0.0, 1.0)
    rows = [
        ("d", 0, 0, 1, "text", "second", 10.0, 30.0, 80.0, 40.0, 9.0, flat), ("d", 0, 0, 0, "text", "first", 12.0, 10.0, 60.0, 20.0, 12.0, flat),
        ("d", 0, 0, 2, "text", "side", 0.0, 0.0, 5.0, 90.0, 8.0, up), ("d", 0, 1, 0, "image", "x", 0.0, 0.0, 1.0, 1.0, 1.0, flat), ("d", 0, 2, 0, "text", " ", 0.0, 0.0, 1.0, 1.0, 1.0, flat),
        ("d", 1, 0, 0, "text", "y" * 7000, 0.0, 0.0, 1.0, 1.0, 1.0, flat),
    ]
    schema = "doc string, page int, block int, line int, kind string, text string, x0 double, y0 double, x1 double, y1 double, font_size double, direction struct<dx: double, dy: double>"
    out = {(r.page, r.block, r.direction.dx): r for r in blocks.text_blocks(spark.createDataFrame(rows, schema), "doc").collect()}
    assert len(out) == 3 and len(out[1, 0, 1.0].text) == 6000
    r = out[0, 0, 1.0]
    assert (r.text, r.x0, r.y0, r.x1, r.y1, r.font_size) == ("first\nsecond", 10.0, 10.0, 80.0, 40.0, 12.0) and [x.text for x in r.lines] == ["first", "second"]


def test_errors_of_mutations(spark):
    folders = spark.createDataFrame([(1, "Web", "web"), (2, "Été", "été")], "id long, name string, name_key string")
    papers = spark.createDataFrame([(1, "h1")], "id long, file_hash string")
    incoming = "file_hash string, reasons array<string>, labels array<struct<field: string, label: string>>, result_json string"
    for bad in (
        lambda: state.rename_folder(folders, 1, " E\u0301TE\u0301 "), lambda: state.create_folders(folders, spark.createDataFrame([("WEB",)], "name string"), 3),
        lambda: state.create_folders(folders, spark.createDataFrame([("x",), ("X ",)], "name string"), 3), lambda: state.create_folders(folders, spark.createDataFrame([(" ",)], "name string"), 3),
        lambda: state.add_papers(spark.createDataFrame([("h1", [], None, None)], incoming), papers, 2)["papers"],
        lambda: state.add_papers(spark.createDataFrame([("h2", [], None, None)] * 2, incoming), papers, 2)["papers"],
        lambda: state.review(papers.selectExpr("id", "'' AS primary_category", "'' AS relevance", "'' AS relevance_reason", "false AS manually_reviewed"), spark.createDataFrame([(1, "Nothing", "A", None)], "paper_id long, primary_category string, relevance string, relevance_reason string")),
    ):
        with pytest.raises(Exception, match="folder name|hash exists|not allowed"):
            bad().collect()
    assert [r.name for r in state.rename_folder(folders, 1, "web ").orderBy("id").collect()] == ["web", "Été"]


def test_a_paper_reviewed_twice_is_one_row(spark):
    papers = spark.createDataFrame([(1, None, None, "old", False), (2, None, None, None, True)], "id long, primary_category string, relevance string, relevance_reason string, manually_reviewed boolean")
    reviews = spark.createDataFrame([(1, 1, "Authentication", "A", None), (1, 2, "Authorization", "B", " new ")], "paper_id long, seq int, primary_category string, relevance string, relevance_reason string")
    out = {r.id: r for r in state.review(papers, reviews).collect()}
    assert len(out) == 2 and (out[1].primary_category, out[1].relevance, out[1].relevance_reason, out[1].manually_reviewed) == ("Authorization", "B", "new", True)


def test_pointers_are_never_missing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    df = spark.range(2)
    first = store.commit({"t": df}, None)
    second = store.commit({"t": spark.range(3)}, first)
    assert store.version() == second and len(store.pointers()) == 2 and store.read("t", first).count() == 2
    with pytest.raises(ValueError):
        store.commit({"t": df}, first)
