"""Evidence of a controlled refresh: what a reviewed plan was made by and is bound to, its observation, and a report of a dry run."""

from __future__ import annotations

import hashlib
import json
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import lectern
from lectern.functions.digest import content_digest, read_json_object, sealed, unsealed
from lectern.plans import refresh

KEYS = {"code", "observation", "decisions"}


def code_identity(root: str | None = None) -> dict[str, str]:
    """SHA-256 of every source file of the library by its relative path: a plan made by other code is another plan."""
    root = root or os.path.dirname(lectern.__file__)
    out = {}
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    out[os.path.relpath(path, root)] = hashlib.sha256(f.read()).hexdigest()
    return dict(sorted(out.items()))


def observation(plan: DataFrame, store_digest: str) -> dict[str, Any]:
    """What a plan saw, frozen: the store it starts from, its counts, and the ids whose input or only whose bibliography changes (ids alone, so in proportion to the changes)."""
    some = plan.where(F.size("changes") > 0).select("id", "input_changed").orderBy("id").collect()
    return {
        "store": store_digest, "counts": refresh.summary(plan).first().asDict(), "fields": {r.field: r.papers for r in refresh.field_counts(plan).orderBy("field").collect()},
        "input_changed": [r.id for r in some if r.input_changed], "bibliographic_only": [r.id for r in some if not r.input_changed],
    }


def freeze(path: str, code: dict[str, str], seen: dict[str, Any], decisions: list[dict[str, Any]]) -> str:
    """Write a manifest, once, and return its digest, by which later steps pin it."""
    envelope = sealed({"code": code, "observation": seen, "decisions": sorted(decisions, key=lambda d: d["id"])})
    with open(path, "x", encoding="utf-8") as f:
        json.dump(envelope, f, ensure_ascii=False, sort_keys=True)
    return envelope["content_digest"]


def load(path: str, pin: str) -> dict[str, Any]:
    """The manifest with the digest ``pin``; another, or one that was altered, is an error."""
    envelope = read_json_object(path)
    content = unsealed(envelope)
    if envelope["content_digest"] != pin:
        raise ValueError("the manifest is not the one pinned")
    if not isinstance(content, dict) or set(content) != KEYS:
        raise ValueError("the manifest has other parts than it must")
    return content


def bind(manifest: dict[str, Any], receipt: dict[str, Any]) -> dict[str, Any]:
    """A receipt bound to the manifest under which it was made."""
    return sealed({"manifest": content_digest(manifest), "receipt": receipt})


def check(manifest: dict[str, Any], bound: dict[str, Any], code: dict[str, str], store_digest: str | None = None) -> dict[str, Any]:
    """The receipt, if it belongs to the manifest, the code is the same and, where given, so is the store."""
    content = unsealed(bound)
    if content["manifest"] != content_digest(manifest):
        raise ValueError("the receipt belongs to another manifest")
    if manifest["code"] != code:
        raise ValueError("the code has changed since the manifest was frozen")
    if store_digest is not None and manifest["observation"]["store"] != store_digest:
        raise ValueError("the library has changed since the manifest was frozen")
    return content["receipt"]


def covered(targets: set[int], allowed: set[int]) -> None:
    """Targets must be a subset of what a review allowed."""
    if extra := sorted(targets - allowed):
        raise ValueError(f"{len(extra)} targets were not reviewed")


def dry_run_report(seen: dict[str, Any]) -> str:
    """Counts of an observation as Markdown; no titles, paths or texts."""
    rows = [*seen["counts"].items(), *((f"field {name}", n) for name, n in seen["fields"].items())]
    ids = [f"- {name.replace('_', ' ')}: {', '.join(map(str, seen[name])) or 'none'}" for name in ("input_changed", "bibliographic_only")]
    return "\n".join(["# Dry run", "", "| What | Papers |", "|---|---|", *(f"| {name} | {n} |" for name, n in rows), "", *ids, ""])
