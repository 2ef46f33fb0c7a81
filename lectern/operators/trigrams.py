"""LIKE by an index of trigrams: posting lists of the three-character pieces of texts, candidates by intersection, the pattern itself as exact check.

A pattern's wildcards split it into pieces; a text that matches holds every trigram of every piece. So a text outside the candidates is
never compared, and one inside is compared as before. A pattern without a piece of three characters has no trigram, and all texts are its candidates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import ascii_lower, like_ascii

SIZE, SPREAD = 3, 16


def pieces_of(text: Column) -> Column:
    """Distinct trigrams of a text, A-Z in lower case. One pass reads the text, a character at a time with the two behind it; what is folded are the few that differ."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))."), F.lit(1))
    return F.array_distinct(F.transform(F.array_distinct(runs), ascii_lower))


def index(texts: DataFrame) -> DataFrame:
    """``trigram, id`` of rows ``(id, text)``, each pair once for each text that holds it."""
    rows = texts.where(F.length("text") >= SIZE).select("id", F.explode(pieces_of(F.col("text"))).alias("trigram"))
    return rows.select("trigram", "id")


def write(texts: DataFrame, path: str) -> None:
    """The :func:`index` sorted by trigram inside files, so that a reader of some trigrams skips the rest; a frequent trigram's list lies in up to :data:`SPREAD` files.

    One shuffle, of one row for each trigram of each text: to make pairs unique takes a second one, and counting trigrams does not need it.
    """
    spread = F.pmod(F.xxhash64("id"), F.lit(SPREAD))
    index(texts).repartition("trigram", spread).sortWithinPartitions("trigram").write.parquet(path)


def folded(pattern: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in pattern)


def trigrams_of(pattern: str) -> list[str]:
    """Trigrams that every text matching a LIKE pattern holds; ``%`` and ``_`` are wildcards, as in the search itself."""
    return sorted({p[k : k + SIZE] for p in re.split("[%_]", folded(pattern)) for k in range(len(p) - SIZE + 1)})


def candidates(postings: DataFrame, pattern: str) -> DataFrame | None:
    """Ids that hold all trigrams of a pattern; None if it has none, so that every id may match."""
    wanted = trigrams_of(pattern)
    if not wanted:
        return None
    return postings.where(F.col("trigram").isin(wanted)).groupBy("id").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted)).select("id")


def matching(texts: DataFrame, postings: DataFrame, pattern: str) -> DataFrame:
    """Rows of ``texts`` whose text matches, without case for A-Z; the exact check reads candidates only."""
    found = candidates(postings, pattern)
    near = texts if found is None else texts.join(found, "id", "left_semi")
    return near.where(like_ascii(F.col("text"), folded(pattern)))
