"""Names of authors: what is a name, as columns over the parts of a row, and which rows below a title list them, as a plan."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import collapse, full_casefold
from lectern.operators.evidence import AFFILIATION, FRONT_HEADING, LINE_BREAK

# --- Fixed values: patterns and limits that decide what is a name ---

CJK = "[぀-ヿ㐀-鿿]"
ADDRESS = r"(?iU)\d{3,}|\b(?:street|road|avenue|postal|zip|address|USA|UK|Germany|Norway|China|Indonesia)\b|https?://|www\.|@"
NOT_A_NAME = r"(?iU)\b(?:technical|copyright|published|abstract|keywords|security|independent|international|national|technology|computing|division)\b"
NOT_NAMES = r"(?iU)\d{3,}|https?://|\b(?:street|road|avenue|postal|zip)\b"
PARTICLES = "van|von|de|der|den|del|da|di|dos|du|le|bin|al"
WORD = rf"(?:(?i:{PARTICLES})|\p{{IsUppercase}}(?:\p{{L}}|[.'\-’‐])*)"
LATIN_NAME = rf"(?U)\A{WORD}(?: {WORD}){{1,4}}\z"
CJK_NAME = rf"\A{CJK}{{2,12}}\z"
LONE_WORD = r"(?U)\A\p{L}+\z"
MAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
BETWEEN = r"(?iU)\s*(?:[,;，；、&]|\band\b)\s*"
NUMBER_MARKS = r"(?U)\d+(?:\s*,\s*[a-z]\))?\s*(?:\([^)]{0,4}\))?"
SIGN_MARKS = "†‡⋆∗*§⁎⁑\x00\x0c"
LETTERED = r"(?iU)\d+\s*,\s*[a-z]\)"
NAME_ENDS = " ,;，、&()."
DETACHED = {"´": "́", "`": "̀", "¨": "̈"}
PAGE = ("key", "page")
LONGEST, PROSE, REGION, SLACK = 80, 180, 300.0, 2.0


@F.pandas_udf(T.StringType())
def compatible(values: pd.Series) -> pd.Series:
    """Unicode's compatibility form, which Spark has no function for."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def joined_accents(row: Column) -> Column:
    """Accents printed before their letter, as glyphs of their own, put on it."""
    for glyph, mark in DETACHED.items():
        row = F.regexp_replace(row, rf"(?U){glyph}(\p{{L}})", f"$1{mark}")
    return row


def tidy(part: Column) -> Column:
    """A name without footnote marks."""
    return F.btrim(collapse(F.translate(F.regexp_replace(part, NUMBER_MARKS, ""), SIGN_MARKS, "")), F.lit(NAME_ENDS))


def is_name(value: Column) -> Column:
    """Two to five words, each a capital or a particle; or two to twelve CJK characters; nothing that tells of a place or a trade."""
    form = F.when(value.rlike(CJK), value.rlike(CJK_NAME)).otherwise(value.rlike(LATIN_NAME))
    return F.length(value).between(1, LONGEST) & ~value.rlike(AFFILIATION) & ~value.rlike(ADDRESS) & ~value.rlike(NOT_A_NAME) & form


def names_in(printed: Column, row: Column | None = None) -> Column:
    """The names that a row in compatible form lists; none if the row as ``printed`` holds an address."""
    row = printed if row is None else row
    listed = F.regexp_replace(F.translate(F.regexp_replace(row, MAIL, ""), "<>", ""), LETTERED, "")
    parts = F.transform(F.filter(F.split(listed, BETWEEN), lambda p: ~p.rlike(AFFILIATION)), tidy)
    single = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(CJK), F.split(p, " ")).otherwise(F.array(p))))
    return F.when(~printed.rlike(NOT_NAMES), F.filter(single, is_name)).otherwise(F.array().cast("array<string>"))


def head_of(row: Column) -> Column:
    return F.get(F.split(row, "[,;]", 2), 0)


def unique(names: Column) -> Column:
    """Each name once, at its first place and in its last spelling."""
    keyed = F.transform(names, lambda n: F.struct(full_casefold(n).alias("k"), n.alias("n")))
    firsts = F.array_distinct(F.transform(keyed, lambda x: x["k"]))
    return F.transform(firsts, lambda k: F.element_at(F.filter(keyed, lambda x: x["k"] == k), -1)["n"])


def same_people(a: Column, b: Column) -> Column:
    keys = lambda names: F.array_sort(F.array_distinct(F.transform(names, full_casefold)))
    return keys(a) == keys(b)


def rows_below(pages: DataFrame) -> DataFrame:
    """``key, page, block, at, row``: rows of the blocks between a title and the text, of pages ``(key, page, blocks, bottom)``; ``block`` orders blocks as they are read."""
    listed = pages.where(F.col("bottom") > 0).select(*PAGE, "bottom", F.posexplode("blocks").alias("n", "b")).where(F.col("b.y0") >= F.col("bottom") - SLACK)
    text = F.coalesce("b.text", F.lit(""))
    closes = text.rlike(FRONT_HEADING) | ((F.length(text) > PROSE) & text.rlike("[.。．]") & ~text.rlike(AFFILIATION))
    end = F.coalesce(F.min(F.when(closes, F.col("b.y0"))).over(Window.partitionBy(*PAGE)), F.col("bottom") + REGION)
    region = listed.withColumn("end", end).where((F.col("b.direction.dx") >= 0.95) & (F.abs("b.direction.dy") <= 0.1) & (F.col("b.y0") < F.col("end")))
    printed = F.when(F.size("b.lines") > 0, F.transform("b.lines", lambda x: F.struct(x["text"].alias("row"), x["y0"].alias("y")))).otherwise(F.transform(F.split(text, LINE_BREAK), lambda r: F.struct(r.alias("row"), F.col("b.y0").alias("y"))))
    rows = region.select(*PAGE, "bottom", "end", F.struct("b.y0", "b.x0", "n").alias("block"), F.posexplode(printed).alias("at", "r"))
    return rows.where((F.col("r.y") < F.col("end")) & (F.col("r.y") <= F.col("bottom") + REGION)).select(*PAGE, "block", "at", F.coalesce("r.row", F.lit("")).alias("row"))


def printed_authors(rows: DataFrame) -> DataFrame:
    """``key, page, authors`` of :func:`rows_below`.

    What a row is (an affiliation, a mail address, a place, names) is decided row by row; a lone word is read together with the row below it, a name that was broken.
    A fold over each block's few rows then says which are read: none inside an affiliation, until a row with a mail address ends it.
    """
    r = rows.withColumn("form", compatible(joined_accents(F.col("row"))))
    head = tidy(head_of(F.col("form")))
    affiliation = F.col("row").rlike(AFFILIATION)
    kind = (
        F.when(affiliation & is_name(head), "member").when(affiliation, "affiliation").when(F.col("row").rlike(ADDRESS) & F.contains("row", F.lit("@")), "mail")
        .when(F.col("row").rlike(ADDRESS), "place").when(F.contains("row", F.lit(",")) & (head != "") & ~is_name(head), "located").otherwise("names")
    )
    lone = F.when(tidy(F.col("form")).rlike(LONE_WORD), tidy(F.col("form")))
    ahead = F.lag("lone").over(Window.partitionBy(*PAGE, "block").orderBy("at"))
    classed = r.withColumn("kind", kind).withColumn("lone", F.when(F.col("kind") == "names", lone)).withColumn("ahead", ahead)
    with_ahead = lambda c: F.concat_ws(" ", "ahead", c)
    before_mail = lambda c: F.get(F.split(F.col(c), MAIL, 2), 0)
    ready = classed.select(
        *PAGE, "block", "at", "kind", (F.col("lone").isNotNull()).alias("lone"), F.col("ahead").isNotNull().alias("broken"),
        F.when(F.col("kind") == "member", names_in(head_of(F.col("row")), head_of(F.col("form")))).when(F.col("kind") == "mail", names_in(before_mail("row"), before_mail("form"))).otherwise(names_in(F.col("row"), F.col("form"))).alias("names"),
        names_in(with_ahead("row"), with_ahead("form")).alias("rejoined"),
    )
    # state: 0 names may come, 1 inside an affiliation, 2 behind its contact; waits: whether the row above was a lone word that was read and is no name.
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        state, waits = acc["state"], acc["waits"] & x["broken"]
        outside = state != 1
        kind = F.when((x["kind"] == "located") & waits, "names").otherwise(x["kind"])
        read = (kind == "names") & outside
        found = (
            F.when((kind == "member") & (state == 0), x["names"]).when((kind == "mail") & (state == 0), x["names"])
            .when(read & waits, x["rejoined"]).when(read & (x["kind"] == "names"), x["names"]).otherwise(empty)
        )
        any_found = F.size(found) > 0
        after = (
            F.when((kind == "member") & (state == 0), state).when(kind.isin("member", "affiliation"), 1)
            .when(kind == "mail", F.when(state == 0, 0).otherwise(2)).when(kind == "place", F.when(state == 0, 0).otherwise(1))
            .when((kind == "located") & outside, 1).when(read & any_found, 0).otherwise(state)
        )
        return F.struct(after.cast("int").alias("state"), (read & ~any_found & x["lone"]).alias("waits"), F.concat(acc["names"], found).alias("names"))

    start = F.struct(F.lit(0).alias("state"), F.lit(False).alias("waits"), empty.alias("names"))
    by_block = ready.groupBy(*PAGE, "block").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "lone", "broken", "names", "rejoined"))).alias("rows"))
    read = by_block.select(*PAGE, "block", F.aggregate("rows", start, step, lambda acc: acc["names"]).alias("names"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "names"))), lambda x: x["names"]))
    return read.groupBy(*PAGE).agg(whole.alias("names")).select(*PAGE, unique(F.col("names")).alias("authors")).where(F.size("authors") > 0)
