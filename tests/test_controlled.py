import json

import pytest
from pyspark.sql import functions as F

from lectern.functions.digest import content_digest, sealed
from lectern.model import CATEGORIES, LABELS, METADATA_FIELDS, PAPERS, RUNS
from lectern.plans import controlled, frozen, ingest
from lectern.sources.store import Store

TEXT = "A long enough abstract about authorization in web services that passes the gate for poor inputs of all kinds."


def paper(i, abstract=TEXT):
    values = dict.fromkeys(PAPERS.fieldNames())
    values |= {
        "id": i, "file_hash": f"{i:064x}", "filename": f"{i}.pdf", "filepath": f"/{i}.pdf", "title": "Authorization Explained", "authors": [], "abstract": abstract, "keywords": [],
        "metadata_sources": {}, "review_reasons": [], "status": "Unread", "manually_reviewed": False, "classification_status": "pending",
    }
    return tuple(values[f] for f in PAPERS.fieldNames())


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/library")
    s.commit(
        {
            "papers": spark.createDataFrame([paper(1), paper(2), paper(3)], PAPERS),
            "classification_runs": spark.createDataFrame([(1, 1, "local", "old", "classified", "{}", None, "t", "t")], RUNS),
            "labels": spark.createDataFrame([(1, "tags", "ai", "old"), (1, "tags", "current", "human"), (2, "tags", "ai", "kept")], LABELS),
        },
        None,
    )
    return s


def refreshed(spark, store):
    new = store.read("papers").select("id", "file_hash", *METADATA_FIELDS)
    return new.withColumns({"abstract": F.when(F.col("id") == 1, F.concat("abstract", F.lit(" More of it."))).otherwise(F.col("abstract")), "venue": F.when(F.col("id") == 2, F.lit("A Journal"))})


def test_refresh_then_reclassify(spark, store):
    new = refreshed(spark, store)
    digest = controlled.plan_digest(store, new, [1])
    receipt = controlled.apply_metadata(store, new, [1], digest)
    after = {r.id: r for r in store.read("papers").collect()}
    assert after[1].abstract.endswith("More of it.") and after[2].venue == "A Journal" and after[1].classification_status == "pending"
    with pytest.raises(controlled.Rejected):
        controlled.apply_metadata(store, new, [1], digest)
    out = controlled.reclassify(store, receipt, ingest.RuleClassifier(), "now")
    assert out == {"classified": 1, "failed": 0, "target_ids": [1]}
    after = {r.id: r for r in store.read("papers").collect()}
    assert after[1].ai_primary_category == "Authorization" and after[1].classified_at == "now" and after[2].ai_primary_category is None
    assert {(r.paper_id, r.value_source, r.label) for r in store.read("labels").collect()} == {(1, "ai", "Authorization"), (1, "current", "human"), (2, "ai", "kept")}
    assert store.read("classification_runs").count() == 2
    with pytest.raises(controlled.Rejected):
        controlled.reclassify(store, receipt, ingest.RuleClassifier(), "later")
    assert store.read("papers", receipt.base).where("id = 1").first().abstract == TEXT


def test_only_changed_inputs_are_reclassified(spark, store):
    new = refreshed(spark, store)
    with pytest.raises(controlled.Rejected):
        controlled.apply_metadata(store, new, [2], controlled.plan_digest(store, new, [2]))
    short = new.where("id > 1")
    with pytest.raises(controlled.Rejected):
        controlled.apply_metadata(store, short, [], controlled.plan_digest(store, short, []))


PROTOCOL = frozen.Protocol(development=(1,), heldout=(2, 3, 4))
PREDICTED = {2: "Authorization", 3: "Authorization", 4: "Token Security"}
TRUE = {2: "Authorization", 3: "Token Security", 4: "Token Security"}


def artifacts(folder, change=lambda a: None):
    ids = (1, 2, 3, 4)
    names = ("primary_category", "relevance", "tags", "research_methods", "target_vulnerabilities")
    answer = lambda c: dict(zip(names, (c, "A", ["csrf"], [], ["IDOR"]), strict=True))
    content = {"dataset_identifier": PROTOCOL.dataset, "papers": [{"paper_id": i, "file_hash": f"{i:064x}", "ai_prediction": {f"ai_{k}": v for k, v in answer(PREDICTED.get(i, CATEGORIES[0])).items()}} for i in ids]}
    digest = content_digest(content)
    base = {"dataset_content_digest": digest, "dataset_identifier": PROTOCOL.dataset}
    rows = [{"paper_id": i, "file_hash": f"{i:064x}", "role": "development" if i == 1 else "heldout"} for i in ids]
    truth = base | {"rubric_version": "v1", "normalization_version": "normalization-v1", "human_final_approval": True, "papers": [r | answer(TRUE.get(r["paper_id"], CATEGORIES[0])) for r in rows]}
    split = base | {"split_version": "split-v1", "development_ids": [1], "heldout_ids": [2, 3, 4], "papers": rows}
    files = {"manifest": {"freeze_status": "frozen", "dataset_identifier": PROTOCOL.dataset, "dataset_content_digest": digest, "content": content}, "truth": sealed(truth), "split": sealed(split), "protocol": sealed({"version": 1})}
    change(files)
    paths = []
    for name, value in files.items():
        (folder / f"{name}.json").write_text(json.dumps(value), encoding="utf-8-sig")
        paths.append(str(folder / f"{name}.json"))
    return paths


def test_frozen_evaluation(spark, tmp_path):
    out = frozen.evaluate(spark, *artifacts(tmp_path), protocol=PROTOCOL)
    primary = out["fields"]["primary_category"]
    assert primary["accuracy"] == pytest.approx(2 / 3) and primary["confusion_matrix"][3][2] == 1
    assert out["fields"]["tags"]["exact_match_accuracy"] == 1 and list(out["fields"]["tags"]["per_label"]) == ["CSRF"]
    assert out["fields"]["research_methods"]["macro_f1"] == 0


def reseal(files, name, **change):
    files[name] = sealed(files[name]["content"] | change)


@pytest.mark.parametrize(
    "change",
    [
        lambda f: f["truth"]["content"].update(rubric_version="v2"),
        lambda f: reseal(f, "truth", human_final_approval=False),
        lambda f: reseal(f, "split", heldout_ids=[2, 3]),
        lambda f: f["manifest"].update(freeze_status="draft"),
        lambda f: f["manifest"]["content"]["papers"].pop(),
        lambda f: reseal(f, "truth", papers=f["truth"]["content"]["papers"][:-1]),
        lambda f: reseal(f, "truth", papers=[p | {"relevance": "D"} for p in f["truth"]["content"]["papers"]]),
        lambda f: reseal(f, "truth", papers=[p | {"tags": None} for p in f["truth"]["content"]["papers"]]),
        lambda f: reseal(f, "split", papers=[p | {"role": "heldout"} for p in f["split"]["content"]["papers"]]),
    ],
)
def test_altered_artifacts_are_refused(spark, tmp_path, change):
    with pytest.raises(ValueError):
        frozen.evaluate(spark, *artifacts(tmp_path, change), protocol=PROTOCOL)
