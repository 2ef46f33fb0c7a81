"""Text functions as native column expressions, and Arrow functions for the keys that Spark cannot express."""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's white space: Java's Unicode class lacks U+001C to U+001F.
SPACE = r"(?U)[\s\x1C-\x1F]+"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
EMAIL = r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
CJK = "[\u3040-\u30ff\u3400-\u9fff]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: inside a lambda or a condition Spark shares no expressions."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def collapse(value: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(value, SPACE, " "))


def blank_to_null(value: Column) -> Column:
    return F.nullif(collapse(value), F.lit(""))


def ascii_lower(value: Column) -> Column:
    """Folds A-Z only: the equality of label names, and of LIKE."""
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def like_ascii(value: Column, pattern: str) -> Column:
    """LIKE without case for ASCII letters and without an escape character; ``%`` and ``_`` are wildcards."""
    escape = next(c for c in ("~", "^", "\ue000", "\ue001") if c not in pattern)
    return F.like(ascii_lower(value), F.lit(pattern), F.lit(escape))


def contains_keyword(value: Column, keyword: str) -> Column:
    return like_ascii(value, f"%{keyword.casefold()}%")


@F.pandas_udf(T.StringType())
def casefold(values: pd.Series) -> pd.Series:
    """Full Unicode case folding, which maps one character to several."""
    return values.str.casefold()


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other, those in order, and those that fold to several: what Unicode says, asked of Python once."""
    folds = {c: f for c in map(chr, range(sys.maxunicode + 1)) if (f := c.casefold()) != c}
    single = {c: f for c, f in folds.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folds.items() if len(f) > 1}


FOLDED, FOLDS, MULTIPLE = _fold_tables()


def full_casefold(value: Column) -> Column:
    """Full Unicode case folding in the JVM: a translation, and for texts with one of the hundred characters that fold to several a table of these."""
    one = F.translate(value, FOLDED, FOLDS)
    table = F.str_to_map(F.lit("\n".join(f"{c}\t{f}" for c, f in MULTIPLE.items())), F.lit("\n"), F.lit("\t"))
    several = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.when(one.rlike(f"[{''.join(MULTIPLE)}]"), several).otherwise(one)


@F.pandas_udf(T.StringType())
def folder_key(values: pd.Series) -> pd.Series:
    """NFC of the case-folded name: equal for names that a reader takes as equal."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v.casefold()))


def valid_folder_name(name: Column) -> Column:
    """The stripped name if it has 1 to 100 characters and no control character, else null."""
    stripped = strip(name)
    return F.when(F.length(stripped).between(1, 100) & ~stripped.rlike(r"\p{Cc}"), stripped)


def join_hyphenated(value: Column) -> Column:
    """A word broken by a hyphen at a line end, as one word."""
    return F.regexp_replace(value, r"(?U)([A-Za-z])[-‐‑]\s*\n\s*([a-z])", "$1$2")


def blanked(value: Column, letters: str) -> Column:
    """Each of some letters as a space; few are in most texts, and to look for each is faster than to translate."""
    for letter in letters:
        value = F.replace(value, F.lit(letter), F.lit(" "))
    return value


def clean_body(value: Column) -> Column:
    """Body text as one paragraph."""
    out = blanked(value, "\x00\ufeff")
    out = join_hyphenated(out)
    out = F.regexp_replace(out, r"[\t\r]+", " ")
    out = F.regexp_replace(out, r" *\n+ *", " ")
    return strip(F.regexp_replace(out, r"(?U)[\s\x1C-\x1F]{2,}", " "))


def normalize(value: Column) -> Column:
    return collapse(join_hyphenated(blanked(value, "\u00a0\x00")))


def cut_at_first(value: Column, pattern: str) -> Column:
    """The text before the first match of ``pattern``, or all of it."""
    at = F.regexp_instr(value, F.lit(pattern))
    return F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value)


def title_from_filename(filename: Column) -> Column:
    """The file name's stem in words, at most 250 characters."""
    name = F.regexp_replace(filename, r"^.*/", "")
    # A stem ends before the last dot, unless the dot begins or ends the name.
    stem = F.when(name.rlike(r"^.+\.[^.]+$") & ~name.rlike(r"^\.[^.]*$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    words = collapse(F.translate(stem, "_-", "  "))
    return F.coalesce(F.nullif(F.substring(words, 1, 250), F.lit("")), F.lit("Unknown paper"))


def ascii_letter_ratio(value: Column) -> Column:
    letters = F.length(F.regexp_replace(value, r"\P{L}", ""))
    return F.length(F.regexp_replace(value, "[^A-Za-z]", "")) / F.greatest(letters, F.lit(1))


def join_cjk(value: Column) -> Column:
    """Spaces between CJK characters, and between one and a following Latin letter, removed."""
    out = F.regexp_replace(value, rf"(?U)(?<={CJK})\s+(?={CJK})", "")
    return F.regexp_replace(out, rf"(?U)(?<={CJK})\s+(?=[A-Za-z])", "")


def distinct_by(values: Column, key) -> Column:
    """Array elements whose key no earlier element has, in order. ``key`` is a column function, evaluated once an element.

    Elements are sorted by key and place, those that differ from the one before are kept and put back in order: n log n for n elements.
    """
    keyed = F.sort_array(F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v"))))
    # The array as an element of another is bound to a name, so it is not computed again for each of its elements.
    first = F.transform(F.array(keyed), lambda s: F.filter(s, lambda x, i: x["k"].isNotNull() & ((i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(x["k"]))))
    ordered = F.sort_array(F.transform(F.element_at(first, 1), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"))))
    return F.transform(ordered, lambda x: x["v"])


def labels_typed(value: Column) -> Column:
    """Labels typed into a form: parts between commas, stripped, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), strip), lambda v: v != "")


def clean_list(values: Column, key=F.lower) -> Column:
    """Elements with collapsed white space, no blanks, first spelling of those that agree but for case."""
    return distinct_by(F.filter(F.transform(values, collapse), lambda v: v != ""), key)


def clean_keywords(values: Column, key=F.lower) -> Column:
    """As :func:`clean_list`, with separators and markers stripped from the ends."""
    ends = r"^[ ,;，、†‡⋆*]+|[ ,;，、†‡⋆*]+$"
    return distinct_by(F.filter(F.transform(values, lambda v: F.regexp_replace(collapse(v), ends, "")), lambda v: v != ""), key)


def valid_seconds(value: Column) -> Column:
    """A duration is null, or a finite number of at least 0 (NaN compares as the largest double, so it is tested first)."""
    v = value.cast("double")
    return value.isNull() | (~F.isnan(v) & (v >= 0) & (v < float("inf")))


# Aliases of evaluation labels, by field.
ALIASES = {
    "csrf": ("CSRF", ("tags", "target_vulnerabilities")),
    "cross site request forgery": ("CSRF", ("tags", "target_vulnerabilities")),
    "cross-site request forgery": ("CSRF", ("tags", "target_vulnerabilities")),
    "cross site request forgery (csrf)": ("CSRF", ("tags", "target_vulnerabilities")),
    "cross-site request forgery (csrf)": ("CSRF", ("tags", "target_vulnerabilities")),
    "sqli": ("SQL Injection", ("tags", "target_vulnerabilities")),
    "sql injection": ("SQL Injection", ("tags", "target_vulnerabilities")),
    "black box testing": ("Black-box Testing", ("tags", "research_methods")),
    "black-box testing": ("Black-box Testing", ("tags", "research_methods")),
}


def normalize_labels(values: Column, field: str) -> Column:
    """Evaluation labels: collapsed white space, the field's aliases, sorted set. Missing or blank values are an error."""
    from lectern.model import LABEL_FIELDS

    if field not in LABEL_FIELDS:
        raise ValueError(f"unknown field {field}")
    own = [(k, v) for k, (v, fields) in ALIASES.items() if field in fields]
    names = F.create_map(*[F.lit(x) for pair in own for x in pair])
    cleaned = F.transform(F.transform(values, collapse), lambda v: F.coalesce(F.element_at(names, F.lower(v)), v))
    error = F.raise_error(F.lit(f"{field}: a list of nonempty strings is required")).cast("array<string>")
    good = lambda c: F.coalesce(F.forall(c, lambda v: v.isNotNull() & (v != "")), F.lit(False))
    # As the element of another array the cleaned one is bound to a name, so it is computed once.
    return F.element_at(F.transform(F.array(cleaned), lambda c: F.when(good(c), F.sort_array(F.array_distinct(c))).otherwise(error)), 1)


def format_input(title: Column, abstract: Column, introduction: Column, keywords: Column) -> Column:
    """What of a classifier input counts as content: white space, an orphan leading period and merged keywords do not."""
    body = F.when(F.startswith(abstract, F.lit(". ")), F.substring(abstract, F.lit(3), F.length(abstract))).otherwise(abstract)
    terms = F.flatten(F.transform(keywords, lambda k: F.split(k, "·")))
    return F.struct(collapse(title).alias("title"), collapse(body).alias("abstract"), collapse(introduction).alias("introduction"), F.transform(terms, collapse).alias("keywords"))
