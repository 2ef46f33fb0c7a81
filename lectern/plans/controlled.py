"""Writes of a controlled refresh: metadata first, then new classifications of the documents whose input changed.

Both start from a version of the store named by its digest, stage a new version, prove on it that nothing but what may
change has changed, and only then make it current. The version before is the backup.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.digest import content_digest
from lectern.model import METADATA_FIELDS
from lectern.plans import refresh
from lectern.plans.ingest import Classifier, classified, input_issues, payload
from lectern.sources.store import Store, row_digest

CLASSIFICATION_COLUMNS = (
    "ai_primary_category", "ai_relevance", "ai_relevance_reason", "ai_relevance_confidence", "classification_status", "classification_error",
    "classification_provider", "classification_model", "classified_at", "processing_seconds", "updated_at",
)


class Rejected(Exception):
    """A refresh that must not go on."""


@dataclass(frozen=True)
class Receipt:
    plan_digest: str
    version: str
    base: str
    store_digest: str
    target_ids: tuple[int, ...]

    @property
    def digest(self) -> str:
        return content_digest(asdict(self) | {"target_ids": list(self.target_ids)})


def without(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    return row_digest(df.select(*sorted(c for c in df.columns if c not in columns)))


def plan_digest(store: Store, new: DataFrame, audited: list[int]) -> str:
    """What a reviewed plan is bound to: the state it starts from, the metadata it brings, the documents to reclassify."""
    return content_digest({"store": store.digest(), "new": without(new, ()), "targets": sorted(audited)})


def apply_metadata(store: Store, new: DataFrame, audited: list[int], digest: str) -> Receipt:
    """Write new metadata ``(id, file_hash, fields)`` for every paper. ``audited`` are the ids whose input changed in content."""
    base = store.version()
    if plan_digest(store, new, audited) != digest:
        raise Rejected("the plan is stale or altered")
    papers = store.read("papers")
    keys = new.join(papers.select("id", "file_hash"), ["id", "file_hash"])
    if not (keys.count() == new.count() == papers.count()):
        raise Rejected("the plan and the papers do not have the same ids and hashes")
    changed = refresh.changes(papers, new)
    wrong = changed.where("NOT input_changed").where(F.col("id").isin(list(audited)))
    if not wrong.isEmpty():
        raise Rejected("a document to reclassify has no change of input")
    fresh = new.select("id", *METADATA_FIELDS)
    updated = papers.drop(*METADATA_FIELDS).join(fresh, "id").select(*papers.columns)

    def check(s: Store, version: str) -> None:
        after = s.read("papers", version)
        if without(after, METADATA_FIELDS) != without(papers, METADATA_FIELDS):
            raise Rejected("a protected value would change")
        if row_digest(after.select("id", *METADATA_FIELDS)) != row_digest(new.select("id", *METADATA_FIELDS)):
            raise Rejected("the metadata written differ from the plan")

    version = store.commit({"papers": updated}, base, check)
    return Receipt(digest, version, base, store.digest(), tuple(sorted(audited)))


def reclassify(store: Store, receipt: Receipt, classifier: Classifier, at: str) -> dict[str, object]:
    """One attempt for each target of ``receipt``, committed together; a receipt whose state has gone cannot be used again."""
    if store.version() != receipt.version or store.digest() != receipt.store_digest:
        raise Rejected("the state is not the receipt's, or the retry was made already")
    papers, runs, labels = (store.read(t) for t in ("papers", "classification_runs", "labels"))
    targets = list(receipt.target_ids)
    rows = papers.where(F.col("id").isin(targets))
    issues = F.concat(F.coalesce("review_reasons", F.array().cast("array<string>")), input_issues(F.col("title"), F.col("abstract"), F.col("introduction_excerpt")))
    if not rows.where(F.size(issues) > 0).isEmpty():
        raise Rejected("a target has open issues")
    if not targets:
        return {"classified": 0, "failed": 0, "target_ids": []}
    inputs = rows.select("id", payload(F.col("title"), F.col("abstract"), F.col("keywords"), F.col("introduction_excerpt")).alias("p")).select("id", "p.*")
    from pyspark import StorageLevel

    # The provider is asked once: its answers are kept until the version is written, and a commit is refused if they were lost.
    answers = classified(inputs, classifier).select("id", "classification", "error").persist(StorageLevel.DISK_ONLY)
    good, last = answers.where("error IS NULL").count(), runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    c = lambda name: F.col(f"classification.{name}")
    ok = F.col("error").isNull() & F.col("__asked").isNotNull()
    joined = papers.join(answers.withColumn("__asked", F.lit(True)), "id", "left")
    values = {f"ai_{n}": F.when(ok, c(n)).otherwise(F.col(f"ai_{n}")) for n in ("primary_category", "relevance", "relevance_reason", "relevance_confidence")}
    values |= {
        "classification_status": F.when(ok, "classified").when(F.col("__asked"), "failed").otherwise(F.col("classification_status")),
        "classification_error": F.when(F.col("__asked"), F.col("error")).otherwise(F.col("classification_error")),
        "classification_provider": F.when(ok, classifier.provider).otherwise(F.col("classification_provider")),
        "classification_model": F.when(ok, classifier.model).otherwise(F.col("classification_model")),
        "classified_at": F.when(ok, at).otherwise(F.col("classified_at")),
        "updated_at": F.when(F.col("__asked"), at).otherwise(F.col("updated_at")),
    }
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy("id")).cast("long") + F.lit(last)
    added = answers.select(
        number.alias("id"), F.col("id").alias("paper_id"), F.lit(classifier.provider).alias("provider"), F.lit(classifier.model).alias("model"),
        F.when(F.col("error").isNull(), "classified").otherwise("failed").alias("status"), F.to_json("classification").alias("result_json"), "error",
        F.lit(at).alias("classified_at"), F.lit(at).alias("created_at"),
    )
    fields = F.array(*[F.struct(F.lit(f).alias("field"), c(f).alias("values")) for f in ("tags", "research_methods", "target_vulnerabilities")])
    fresh = answers.where("error IS NULL").select(F.col("id").alias("paper_id"), F.explode(fields).alias("f")).select("paper_id", "f.field", F.lit("ai").alias("value_source"), F.explode("f.values").alias("label"))
    replaced = answers.where("error IS NULL").select(F.col("id").alias("paper_id"), F.lit("ai").alias("value_source"))
    kept = labels.join(replaced, ["paper_id", "value_source"], "left_anti").select(*labels.columns)

    def check(s: Store, version: str) -> None:
        after, log, names = (s.read(t, version) for t in ("papers", "classification_runs", "labels"))
        other = ~F.col("id").isin(targets)
        if without(after.where(other), ()) != without(papers.where(other), ()) or without(after, CLASSIFICATION_COLUMNS) != without(papers, CLASSIFICATION_COLUMNS):
            raise Rejected("a protected value would change")
        protected = ~F.col("paper_id").isin(targets) | (F.col("value_source") == "current")
        if without(names.where(protected), ()) != without(labels.where(protected), ()):
            raise Rejected("protected labels would change")
        if row_digest(log.where(F.col("id") <= last)) != row_digest(runs) or sorted(r.paper_id for r in log.where(F.col("id") > last).collect()) != targets:
            raise Rejected("the history would not be a continuation")

    tables = {"papers": joined.withColumns(values).select(*papers.columns), "classification_runs": runs.unionByName(added), "labels": kept.unionByName(fresh.select(*labels.columns))}
    store.commit(tables, receipt.version, check)
    answers.unpersist()
    return {"classified": good, "failed": len(targets) - good, "target_ids": targets}
