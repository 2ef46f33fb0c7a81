"""Strict reading of a classifier's answer: JSON text as a Variant, every reason to refuse it as a column, no Python.

A cast to the answer's struct would take what it should refuse: further fields, a number for a text, a text for a number. So the type of
each value is asked of the Variant itself, and values are read only once all of an answer's types are right.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse, distinct_by, full_casefold
from lectern.model import CATEGORIES, CLASSIFICATION, RELEVANCES

#: Fixed limits of an answer.
LIST_LIMITS = {"tags": 30, "research_methods": 20, "target_vulnerabilities": 30}
REASON_LIMIT = 500
FIELDS = tuple(f.name for f in CLASSIFICATION.fields)


def parsed(text: Column) -> Column:
    """The Variant of a JSON text, null for what is none. A field that comes twice makes an answer malformed.

    A parser stops after the first value, so the text is read as the one element of an array and as the value of a field: what follows a value could close only one of them.
    """
    alone = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit("}")))
    return F.when(alone.isNotNull(), F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$[0]", "variant"))


def part(answer: Column, name: str) -> Column:
    return F.try_variant_get(answer, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """A Variant's type, without what its size says: STRING, NUMBER, BOOLEAN, VOID, ARRAY<...> or OBJECT<...>."""
    name = F.schema_of_variant(value)
    return F.when(name.rlike(r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$"), "NUMBER").otherwise(name)


def text_of(answer: Column, name: str) -> Column:
    return F.try_variant_get(answer, f"$.{name}", "string")


def objections(answer: Column, field: str) -> Iterator[Column]:
    """What is wrong with a field that the answer has; each is a text, or null."""
    of = kind(part(answer, field))
    if field in LIST_LIMITS:
        texts = of.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(F.try_variant_get(answer, f"$.{field}", "array<variant>"), F.is_variant_null), F.lit(False))
        yield F.when(~texts, f"{field}: not a list of texts")
        yield F.when(F.size(F.try_variant_get(answer, f"$.{field}", "array<variant>")) > LIST_LIMITS[field], f"{field}: over {LIST_LIMITS[field]}")
    elif field == "relevance_confidence":
        value = F.try_variant_get(answer, f"$.{field}", "double")
        yield F.when(of != "NUMBER", f"{field}: not a number").when(~value.between(0, 1), f"{field}: not between 0 and 1")
    elif field == "relevance_reason":
        value = text_of(answer, field)
        yield F.when(of != "STRING", f"{field}: not a text").when(collapse(value) == "", f"{field}: blank").when(F.length(value) > REASON_LIMIT, f"{field}: over {REASON_LIMIT}")
    else:
        allowed = CATEGORIES if field == "primary_category" else RELEVANCES
        yield F.when(of != "STRING", f"{field}: not a text").when(~text_of(answer, field).isin(*allowed), f"{field}: not allowed")


def errors(answer: Column) -> Column:
    """All reasons to refuse an answer (a Variant), in the order of its fields; empty for a good one."""
    whole = F.schema_of_variant(answer)
    names = F.map_keys(F.try_variant_get(answer, "$", "map<string,variant>"))
    reasons = []
    for field in FIELDS:
        present = F.array_contains(names, field)
        reasons.append(F.when(~present, f"{field}: missing"))
        reasons += [F.when(present, o) for o in objections(answer, field)]
    extra = F.transform(F.array_sort(F.array_except(names, F.array(*map(F.lit, FIELDS)))), lambda n: F.concat(n, F.lit(": unknown")))
    found = F.concat(F.array_compact(F.array(*reasons)), extra)
    return F.when(answer.isNull(), F.array(F.lit("malformed"))).when(~whole.startswith("OBJECT<"), F.array(F.lit("not an object"))).otherwise(found)


def labels(answer: Column, field: str) -> Column:
    """Labels of a list: white space collapsed, no blanks, first spelling of those that agree but for case."""
    values = F.transform(F.try_variant_get(answer, f"$.{field}", "array<string>"), collapse)
    return distinct_by(F.filter(values, lambda v: v != ""), full_casefold)


def classification(answer: Column, refused: Column) -> Column:
    """The answer as a classification; null where ``refused`` (its :func:`errors`) is not empty."""
    values = {f: labels(answer, f) if f in LIST_LIMITS else text_of(answer, f) for f in FIELDS}
    values["relevance_reason"] = collapse(values["relevance_reason"])
    values["relevance_confidence"] = F.try_variant_get(answer, "$.relevance_confidence", "double")
    return F.when(F.size(refused) == 0, F.struct(*[values[f].alias(f) for f in FIELDS]))
