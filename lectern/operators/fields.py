"""Fields of a document from its text alone, as column expressions: titles, labelled abstracts, keywords, introductions.

A pattern's matches in a text are an array of places (:func:`found`), and what a field takes of each is a function of the text behind it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import EMAIL, clean_body, collapse, distinct_by, full_casefold, let, normalize, strip
from lectern.operators.evidence import LINE_BREAK

# --- Fixed values: patterns and limits that decide what is a field of the front matter ---

CJK = "[぀-ヿ㐀-鿿]"
NUMBERED = r"(?:\d{1,2}(?:\.\d+)*[.)]?|[IVX]+[.)])"
END_OF_WORD = r"(?![A-Za-z0-9_])"
KEYWORD_LABELS = rf"keywords?{END_OF_WORD}|key[ \t]+words?{END_OF_WORD}|index[ \t]+terms?{END_OF_WORD}|キーワード"
SUMMARY_LABELS = r"summary(?=[ \t]*(?:$|[:：–—]))|概要|要旨|あらまし"
INTRODUCTION_LABELS = rf"introduction{END_OF_WORD}|はじめに"
LINE_START = r"(?imUd)^[ \t]*"
ABSTRACT = rf"{LINE_START}(?:abstract(?=[ \t]*(?:$|[:：.\-–—]))|{SUMMARY_LABELS})[ \t]*[:：\-–—]?[ \t]*"
KEYWORDS = rf"{LINE_START}(?:{KEYWORD_LABELS})[ \t]*[:：\-–—]?[ \t]*"
INTRODUCTION = rf"{LINE_START}(?:(?:{NUMBERED}[ \t]*(?:\n[ \t]*)?))?(?:{INTRODUCTION_LABELS})[ \t]*[：:]?[ \t]*\r?$"
SECTION = rf"{LINE_START}(?:{NUMBERED}(?:[ \t]+\n?[ \t]*|\n[ \t]*)[A-Za-z぀-ヿ㐀-鿿][^\n]{{0,100}}|(?:references|bibliography|acknowledg(?:e)?ments)[ \t]*)\r?$"
ABSTRACT_STOP = (
    rf"{LINE_START}(?:{KEYWORD_LABELS}|categories and subject descriptors|general terms|ccs concepts|acm classification|content warning|abstract{END_OF_WORD}|"
    rf"{SUMMARY_LABELS}|{INTRODUCTION_LABELS}|{NUMBERED}(?:[ \t]+\n?[ \t]*|\n[ \t]*)(?:{INTRODUCTION_LABELS}))"
)
KEYWORD_STOP = rf"{LINE_START}(?:abstract{END_OF_WORD}|概要|要旨|あらまし|{INTRODUCTION_LABELS}|\d+(?:\.\d+)*[.)]?[ \t]+)"
FRONT_NOISE = (
    LINE_START + r"(?:[∗*†‡]\s*[A-Za-z]|authors[’']?\s+addresses|copyright\b|©|all rights reserved|permission to\b|this (?:work|article) is (?:an open access|licensed)|"
    r"arxiv:\s*(?:\d{4}\.\d{4,5}|[a-z-]+/\d{7})|(?:email|e-mail|affiliation|address)\s*[:：]|(?:\S+@\S+)|ccs concepts\b|categories and subject descriptors\b|"
    r"acm classification\b|content warning\b|usenix association\b|this paper is included in the proceedings of\b|network and distributed system security \(ndss\) symposium\b)"
)
BODY_AFFILIATION = (
    r"(?iU)\b(?:university|institute|department|faculty|school|laboratory|lab\.?|campus|company|corp\.?|inc\.?|cispa|saarland|keio|samsung|sap se)\b|"
    r"大学|大学院|研究科|学部|研究所|情報基盤|センター|機構"
)
BAD_TITLE = (
    r"(?U)^(?:reprinted from|regular paper|abstractproxy)",
    r"(?U)^(?:abstract|keywords?|key words?|index terms?)\b",
    r"received:|accepted:",
    r"^(?:unknown|untitled|paper|usenix association|the usenix association)$",
    r"(?U)^arxiv\s*:\s*(?:\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?(?=\s|$)",
    r"(?U)^proceedings\s+of\b",
    r"^(?:main|paper|manuscript|submission|draft|document|untitled|output)(?:[-_](?:[a-z]+\d+|\d+|final|draft|camera[-_]?ready|rev\d*|copy))+(?:\.(?:pdf|tex|dvi))?$",
    r"^(?:main|manuscript|submission|document|output)\.(?:pdf|tex|dvi)$",
)
NOISE = r"(?s)abstractproxy|httpxproxy|(?:\bactivate\s*\(\)\s*close\s*\(\)\s*proxy\b.*){2}"
CONTACT_ROW = r"(?iU)^(?:(?:department|faculty|school|institute|laboratory) (?:of|for)\b|university of\b|(?:[\w-]+\s+){1,4}university\s*$)"
PAGE_NUMBERS = r"^[\d .…·]+$"
TITLE_ENDS, COVER_ENDS, BODY_ENDS, KEYWORD_ENDS = " \t\r\n-–—|:：⋆∗†‡*", " ⋆∗†‡*", " .：:–—-", " .。:："
TITLE_LENGTH, TITLE_WORDS, SHORT_TITLE = (5, 300), 42, 28
ABSTRACT_LIMIT, INTRODUCTION_LIMIT = 6000, 2500
LEAST_ABSTRACT, LEAST_CJK_ABSTRACT, LEAST_INTRODUCTION = 40, 20, 80
KEYWORD_LENGTH, KEYWORD_WORDS, CONTACT_WORDS, LATIN = 100, 80, 16, 0.35


def starts_with(text: Column, pattern: str) -> Column:
    """Whether ``pattern``, one of those that begin at a line, matches at the text's very start."""
    flags, rest = pattern.split(")", 1)
    return F.coalesce(text.rlike(rf"{flags})\A(?:{rest})"), F.lit(False))


def heading(text: Column) -> Column:
    """Whether a block begins with the heading of an abstract, an introduction or a section."""
    return starts_with(text, ABSTRACT) | starts_with(text, INTRODUCTION) | starts_with(strip(text), SECTION)


def noisy(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(NOISE), F.lit(False))


def affiliated(text: Column) -> Column:
    return text.rlike(BODY_AFFILIATION) | text.rlike(EMAIL)


def mostly_latin(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.length(F.regexp_replace(text, "[^A-Za-z]+", "")) >= LATIN * F.greatest(letters, F.lit(1))


def before(text: Column, *stops: str) -> Column:
    """The text before the first match of each pattern in turn."""
    for stop in stops:
        text = F.get(F.split(text, stop, 2), 0)
    return text


def bad_title(title: Column) -> Column:
    short = lambda t: (F.length(t) < SHORT_TITLE) & t.rlike(r"(?U)^[\d\W_]+$")
    return let(F.lower(collapse(title)), lambda t: reduce(or_, [t.rlike(pattern) for pattern in BAD_TITLE], short(t)))


def title_or_null(text: Column) -> Column:
    """A title in clean form, or null for what is none."""
    out = F.btrim(normalize(F.coalesce(text, F.lit(""))), F.lit(TITLE_ENDS))
    good = lambda t: F.length(t).between(*TITLE_LENGTH) & ~F.contains(t, F.lit("@")) & (F.size(F.split(collapse(t), " ")) <= TITLE_WORDS)
    return let(out, lambda t: F.when(good(t) & ~bad_title(t), t))


def found(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``, in order: ``label, start, end``, in characters."""
    labels, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.arrays_zip(labels.alias("label"), F.slice(gaps, 1, F.size(labels)).alias("gap"))
    empty = F.array().cast("array<struct<label:string,start:int,end:int>>")
    # A fold over matches: where the last one ended is where the next gap begins.
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(p["label"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(p["label"].alias("label"), (acc["at"] + F.length(p["gap"])).alias("start"), (acc["at"] + F.length(p["gap"]) + F.length(p["label"])).alias("end")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def behind(text: Column, match: Column) -> Column:
    return F.substring(text, match["end"] + 1, F.length(text))


def in_front(text: Column, match: Column) -> Column:
    """Whether a match stands in the front matter: no introduction or section ahead of it."""
    ahead = F.left(text, match["start"])
    return ~(ahead.rlike(INTRODUCTION) | ahead.rlike(SECTION))


def abstracts(text: Column) -> Column:
    """Abstracts that a text labels, clean and at most 6000 characters; a summary counts only in the front matter."""

    def read(match: Column) -> Column:
        front = ~F.lower(strip(match["label"])).startswith("summary") | in_front(text, match)
        least = lambda body: F.when(body.rlike(CJK), LEAST_CJK_ABSTRACT).otherwise(LEAST_ABSTRACT)
        good = lambda body: (F.length(body) >= LEAST_CJK_ABSTRACT) & (F.length(body) >= least(body)) & ~noisy(body)
        body = clean_body(F.ltrim(before(behind(text, match), ABSTRACT_STOP, SECTION, FRONT_NOISE), F.lit(BODY_ENDS)))
        return F.when(front, let(body, lambda b: F.when(good(b), strip(F.left(b, F.lit(ABSTRACT_LIMIT))))))

    return F.array_compact(F.transform(found(F.coalesce(text, F.lit("")), ABSTRACT), read))


def best_abstract(of_text: Column, of_layout: Column) -> Column:
    """``text, layout`` of the best of two lists: mostly Latin first, then set on the page, then the longest, the earlier of equals."""
    listed = lambda values, layout: F.transform(values, lambda v, i: F.struct(mostly_latin(v).alias("latin"), F.lit(layout).alias("layout"), F.length(v).alias("n"), (-i).alias("i"), v.alias("text")))
    best = F.array_max(F.concat(listed(of_text, False), listed(of_layout, True)))
    return F.when(best.isNotNull(), F.struct(best["text"].alias("text"), best["layout"].alias("layout")))


def keyword_list(field: Column) -> Column:
    """Keywords of one field; none at all if a part is too long, hyphenated or an address."""
    clean = F.btrim(clean_body(F.coalesce(field, F.lit(""))), F.lit(KEYWORD_ENDS))
    parts = F.transform(F.split(clean, r"(?U)\s*[,;，；、|·•]\s*"), lambda p: F.btrim(p, F.lit(KEYWORD_ENDS)))
    unfit = F.exists(parts, lambda p: (F.length(p) > KEYWORD_LENGTH) | p.rlike("[-‐‑]$") | p.rlike(EMAIL) | p.rlike("https?://"))
    good = (clean != "") & (F.size(F.split(collapse(clean), " ")) <= KEYWORD_WORDS) & ~clean.rlike(FRONT_NOISE) & ~unfit
    return F.when(good, unique(parts)).otherwise(F.array().cast("array<string>"))


def unique(values: Column) -> Column:
    """Values without marks at their ends, first spelling of those that agree but for case."""
    ends = F.lit(" ,;，、†‡⋆*")
    return distinct_by(F.filter(F.transform(values, lambda v: F.btrim(collapse(v), ends)), lambda v: v != ""), full_casefold)


def keywords(texts: Column) -> Column:
    """Keywords that the front matter of the ``texts`` labels."""

    def read(text: Column) -> Column:
        def of(match: Column) -> Column:
            tail = strip(before(behind(text, match), SECTION, KEYWORD_STOP, FRONT_NOISE))
            first = F.regexp_replace(F.get(F.split(tail, r"\n[ \t]*\n", 2), 0), r"(?U)^[:：]\s*", "")
            return F.when(in_front(text, match), let(first, keyword_list)).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(found(text, KEYWORDS), of))

    return unique(F.flatten(F.transform(texts, read)))


def introduction(text: Column) -> Column:
    """The first introduction of a text that is prose, at most 2500 characters: no entry of a table of contents, and nothing from the first contact row on."""

    def read(match: Column) -> Column:
        contact = lambda s: s.rlike(CONTACT_ROW) & (F.size(F.split(collapse(s), " ")) <= CONTACT_WORDS) & ~s.rlike("[.!?。．]$")

        def of(body: Column) -> Column:
            listed = strip(F.get(F.split(body, LINE_BREAK, 2), 0)).rlike(PAGE_NUMBERS)
            prose = let(F.split(before(body, SECTION, FRONT_NOISE), LINE_BREAK), lambda lines: clean_body(F.array_join(kept(lines), "\n")))
            return F.when(~listed, let(prose, lambda p: F.when(F.length(p) >= LEAST_INTRODUCTION, strip(F.left(p, F.lit(INTRODUCTION_LIMIT))))))

        def kept(lines: Column) -> Column:
            row = F.array_min(F.transform(lines, lambda x, i: F.when(let(strip(x), contact), i)))
            return let(row, lambda r: F.when(r.isNull(), lines).otherwise(F.slice(lines, 1, F.coalesce(r, F.lit(0)))))

        return let(strip(behind(text, match)), of)

    return F.get(F.array_compact(F.transform(found(F.coalesce(text, F.lit("")), INTRODUCTION), read)), 0)
