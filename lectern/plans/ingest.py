"""The scan of an inbox as one plan: route, extract, gate, classify, and report each file."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import answers
from lectern.functions.text import collapse
from lectern.model import CATEGORIES, CLASSIFICATION, METADATA, RELEVANCES
from lectern.operators.fields import bad_title, noisy
from lectern.operators.state import routed
from lectern.sources.scratch import cut

# Fixed texts of the gate and the report.
NO_TITLE = "A trustworthy title is required before classification."
NO_TEXT = "A usable abstract or bounded introduction excerpt is required."
HELD = "Classification held for metadata review"
UNCONFIGURED = "Classifier is not configured"

class Classifier(Protocol):
    """A provider answers for a batch of inputs (title, abstract, keywords, introduction) with a classification or an error each."""

    provider: str
    model: str

    def classify(self, batch: pd.DataFrame) -> list[dict | str]: ...


class RuleClassifier:
    """Stand-in provider without a language model: categories by the words they share with a text. Not of a model's quality."""

    provider, model = "local", "rules"

    def classify(self, batch: pd.DataFrame) -> list[dict | str]:
        out: list[dict | str] = []
        for title, abstract, introduction in zip(batch["title"], batch["abstract"], batch["introduction_excerpt"], strict=True):
            text = f"{title or ''} {abstract or introduction or ''}".casefold()
            scores = [sum(text.count(w.casefold()) for w in c.replace("/", " ").split() if len(w) > 3) for c in CATEGORIES]
            best = max(range(len(scores)), key=lambda k: scores[k])
            category = CATEGORIES[best] if scores[best] else CATEGORIES[-1]
            out.append(
                {
                    "primary_category": category, "tags": [category] if scores[best] else [], "research_methods": [], "target_vulnerabilities": [],
                    "relevance": RELEVANCES[min(2, max(0, 2 - scores[best]))], "relevance_reason": "shared words", "relevance_confidence": min(1.0, 0.5 + scores[best] / 10),
                }
            )
        return out


def input_issues(title, abstract, introduction):
    """Why a record is held before classification: an array of reasons, empty for a good one."""
    clean = collapse(F.coalesce(title, F.lit("")))
    has_abstract = F.coalesce(F.length(abstract) > 0, F.lit(False))
    good_abstract = has_abstract & (F.length(F.btrim(F.coalesce(abstract, F.lit("")))) >= 80) & ~noisy(abstract)
    good_introduction = ~has_abstract & (F.length(F.btrim(F.coalesce(introduction, F.lit("")))) >= 120)
    return F.array_compact(F.array(F.when((F.length(clean) < 8) | bad_title(clean), NO_TITLE), F.when(~(good_abstract | good_introduction), NO_TEXT)))


def payload(title, abstract, keywords, introduction):
    """What a classifier gets to see: bounded title, abstract, 30 keywords, and an introduction only for want of an abstract."""
    text = F.nullif(abstract, F.lit(""))
    return F.struct(
        F.substring(F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown")), 1, 500).alias("title"), F.substring(text, 1, 6000).alias("abstract"),
        F.slice(keywords, 1, 30).alias("keywords"), F.when(text.isNull(), F.substring(F.nullif(introduction, F.lit("")), 1, 2500)).alias("introduction_excerpt"),
    )


def valid_answer(answer: object) -> dict:
    """One strict classification on the driver or in a provider's own retries; plans judge answers by :mod:`lectern.functions.answers`."""
    fields = {f.name for f in CLASSIFICATION.fields}
    if not isinstance(answer, dict) or set(answer) != fields:
        raise ValueError("fields")
    if answer["primary_category"] not in CATEGORIES or answer["relevance"] not in RELEVANCES:
        raise ValueError("classes")
    out = dict(answer)
    for name, most in (("tags", 30), ("research_methods", 20), ("target_vulnerabilities", 30)):
        values = answer[name]
        if not isinstance(values, list) or len(values) > most or any(not isinstance(v, str) for v in values):
            raise ValueError(name)
        seen: dict[str, str] = {}
        for v in (" ".join(v.split()) for v in values):
            if v:
                seen.setdefault(v.casefold(), v)
        out[name] = list(seen.values())
    reason = answer["relevance_reason"]
    if not isinstance(reason, str) or not 1 <= len(" ".join(reason.split())) or len(reason) > 500:
        raise ValueError("relevance_reason")
    confidence = answer["relevance_confidence"]
    if isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
        raise ValueError("relevance_confidence")
    out["relevance_reason"], out["relevance_confidence"] = " ".join(reason.split()), float(confidence)
    return out


def classified(rows: DataFrame, classifier: Classifier) -> DataFrame:
    """Add ``classification`` and ``error`` to rows with ``title, abstract, keywords, introduction_excerpt``. A bad answer is that row's error.

    The provider's answers leave Python as JSON text; what they are worth is decided by columns.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("failure_to_answer", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = classifier.classify(batch)
            yield batch.assign(answer=[None if isinstance(x, str) else json.dumps(x) for x in given], failure_to_answer=[x if isinstance(x, str) else None for x in given])

    judged = rows.mapInPandas(run, schema).withColumn("answer", answers.parsed(F.col("answer"))).withColumn("refused", answers.errors(F.col("answer")))
    why = F.coalesce("failure_to_answer", F.when(F.size("refused") > 0, F.array_join("refused", "; ")))
    error = F.when(why.isNotNull(), F.concat(F.lit("Classification failed ("), why, F.lit(")")))
    return judged.select(*[F.col(f"`{c}`") for c in rows.columns], answers.classification(F.col("answer"), F.col("refused")).alias("classification"), error.alias("error"))


def plan(files: DataFrame, papers: DataFrame, extract: Callable[[DataFrame], DataFrame], classifier: Classifier | None, reclassify: bool = False) -> DataFrame:
    """One row a file: ``path, filename, file_hash, paper_id, route, metadata, classification, status, message, classification_status``.

    ``files`` has ``file_hash, filepath, filename`` and what ``extract`` needs; ``extract`` adds ``metadata`` and ``failure``
    (a class name, or null). Files to skip are never parsed; held files never reach the provider. A failed parse
    is reported and registered nowhere. Cut the result before writing logs from it: a provider must be asked once.
    """
    routes = routed(files, papers, reclassify)
    skipped = routes.where("route = 'Skipped'")
    found = ["filepath", "filename", "file_hash", "paper_id", "route", "metadata", "failure"]
    # Written once: ready, held and failed files are parts of it, and their plans would each extract everything again.
    work = cut(extract(routes.where("route <> 'Skipped'")).select(*found), "extracted")
    m = lambda c: F.col(f"metadata.{c}")
    reasons = F.array_distinct(F.concat(F.coalesce(m("review_reasons"), F.array().cast("array<string>")), input_issues(m("title"), m("abstract"), m("introduction_excerpt"))))
    gated = work.withColumn("issues", F.when(F.col("failure").isNull(), reasons))
    keep = [*found, "issues"]
    ready = gated.where("failure IS NULL AND size(issues) = 0").select(*keep, payload(m("title"), m("abstract"), m("keywords"), m("introduction_excerpt")).alias("p"))
    none = F.lit(None).cast(CLASSIFICATION)
    if classifier is None:
        answered = ready.select(*keep, none.alias("classification"), F.lit(UNCONFIGURED).alias("error"), F.lit("pending").alias("classification_status"))
    else:
        asked = classified(ready.select(*keep, "p.*"), classifier)
        answered = asked.select(*keep, "classification", "error", F.when(F.col("error").isNull(), "classified").otherwise("failed").alias("classification_status"))
    held = gated.where("failure IS NULL AND size(issues) > 0").select(*keep, none.alias("classification"), F.lit(HELD).alias("error"), F.lit("needs_review").alias("classification_status"))
    failed = gated.where("failure IS NOT NULL").select(*keep, none.alias("classification"), F.concat(F.lit("Processing failed ("), "failure", F.lit(")")).alias("error"), F.lit(None).cast("string").alias("classification_status"))
    passed = skipped.select(
        "filepath", "filename", "file_hash", "paper_id", "route", F.lit(None).cast(METADATA).alias("metadata"), F.lit(None).cast("string").alias("failure"),
        F.lit(None).cast("array<string>").alias("issues"), none.alias("classification"), F.lit("Already registered").alias("error"), F.lit(None).cast("string").alias("classification_status"),
    )
    everything = answered.unionByName(held).unionByName(failed).unionByName(passed)
    status = (
        F.when(F.col("route") == "Skipped", "Skipped").when(F.col("failure").isNotNull(), "Failed")
        .otherwise(F.element_at(F.create_map(*[F.lit(x) for x in ("pending", "Pending", "failed", "Failed", "needs_review", "Needs review", "classified", "Classified")]), F.col("classification_status")))
    )
    success = F.when(F.col("route") == "Retry", "Classification retry succeeded").otherwise("Success")
    return everything.withColumn("status", status).withColumn("message", F.coalesce("error", success))


def with_ids(inserted: DataFrame, last: int) -> DataFrame:
    """New papers numbered after ``last`` in the order of their path."""
    return inserted.withColumn("id", F.row_number().over(Window.orderBy("filepath")).cast("long") + F.lit(last))
