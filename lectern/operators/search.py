"""Effective values, faceted search and dashboard of the library."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.digest import flag, positive_id
from lectern.functions.text import ascii_lower, contains_keyword
from lectern.model import LABEL_FIELDS

SCALARS = ("primary_category", "relevance", "relevance_reason", "relevance_confidence")


def effective(name: str) -> Column:
    """The human value once a paper is reviewed, even where that is null; else the machine's."""
    return F.when(F.col("manually_reviewed"), F.col(name)).otherwise(F.col(f"ai_{name}"))


def with_effective(papers: DataFrame) -> DataFrame:
    return papers.withColumns({f"effective_{c}": effective(c) for c in SCALARS if c in papers.columns})


def effective_labels(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """``paper_id, field, label`` on the side that counts. A reviewed paper without human labels has none."""
    side = F.when(F.col("manually_reviewed"), F.lit("current")).otherwise(F.lit("ai"))
    sides = papers.select(F.col("id").alias("paper_id"), side.alias("value_source"))
    return labels.join(sides, ["paper_id", "value_source"]).select("paper_id", "field", "label")


def label_lists(labels: DataFrame) -> DataFrame:
    """One row a paper with the ordered labels of each field; a paper without labels has no row."""
    ordered = lambda f: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct(ascii_lower(F.col("label")).alias("k"), F.col("label").alias("v"))))), lambda x: x["v"]
    )
    return labels.groupBy("paper_id").agg(*[ordered(f).alias(f) for f in LABEL_FIELDS])


def with_labels(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """Papers with their effective label lists, empty where there are none."""
    lists = label_lists(effective_labels(papers, labels))
    joined = papers.join(lists, papers["id"] == lists["paper_id"], "left").drop("paper_id")
    return joined.withColumns({f: F.coalesce(F.col(f), F.array().cast("array<string>")) for f in LABEL_FIELDS})


def having_label(papers: DataFrame, labels: DataFrame, field: str, names: Iterable[str]) -> DataFrame:
    """Papers with any of the labels in one field; names agree but for the case of ASCII letters."""
    folded = [n.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for n in names]
    found = effective_labels(papers, labels.where(F.col("field") == field)).where(ascii_lower(F.col("label")).isin(folded))
    return papers.join(found, papers["id"] == found["paper_id"], "left_semi")


def matching(papers: DataFrame, labels: DataFrame, keyword: str) -> DataFrame:
    """Papers whose title, abstract, tags or vulnerabilities contain the keyword. Methods, venue and notes are not searched."""
    own = F.coalesce(contains_keyword(F.col("title"), keyword), F.lit(False)) | F.coalesce(contains_keyword(F.col("abstract"), keyword), F.lit(False))
    hits = effective_labels(papers, labels.where(F.col("field").isin("tags", "target_vulnerabilities"))).where(contains_keyword(F.col("label"), keyword))
    hits = hits.select(F.col("paper_id").alias("__hit")).distinct()
    return papers.join(hits, papers["id"] == F.col("__hit"), "left").where(own | F.col("__hit").isNotNull()).drop("__hit")


def searched_texts(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, text`` of all that a keyword is looked for in: titles, abstracts, effective tags and vulnerabilities."""
    own = papers.select("id", F.explode(F.array("title", "abstract")).alias("text")).where("text IS NOT NULL")
    named = effective_labels(papers, labels.where(F.col("field").isin("tags", "target_vulnerabilities")))
    return own.unionByName(named.select(F.col("paper_id").alias("id"), F.col("label").alias("text")))


def order_key() -> list[Column]:
    """Relevance A, B, C, none; newest first, unknown years last; title or file name without ASCII case."""
    relevance = effective("relevance")
    rank = F.when(relevance == "A", 0).when(relevance == "B", 1).when(relevance == "C", 2).otherwise(3)
    return [rank.asc(), F.col("year").desc_nulls_last(), ascii_lower(F.coalesce("title", "filename")).asc(), F.col("id").asc()]


def ranked(hits: DataFrame, name: str = "position") -> DataFrame:
    """``hits`` with their place in display order, counted in two steps so that no task orders all of them.

    Groups of equal relevance, year and first two letters of the title follow one another; the table of group sizes, some thousands of
    rows whatever the number of hits, gives where each begins, and a window inside a group the rest.
    """
    title, last = order_key()[2:]
    folded = ascii_lower(F.coalesce("title", "filename"))
    relevance = effective("relevance")
    group = {"__rank": F.when(relevance == "A", 0).when(relevance == "B", 1).when(relevance == "C", 2).otherwise(3), "__start": F.substring(folded, 1, 2)}
    grouped = hits.withColumns(group)
    keys = ["__rank", "year", "__start"]
    order = Window.orderBy(F.col("__rank"), F.col("year").desc_nulls_last(), F.col("__start")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = grouped.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    begins = sizes.select(F.col("__rank").alias("__r"), F.col("year").alias("__y"), F.col("__start").alias("__s"), F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(title, last))
    placed = grouped.withColumn("__inside", inside)
    joined = placed.join(begins, (F.col("__rank") == F.col("__r")) & F.col("year").eqNullSafe(F.col("__y")) & F.col("__start").eqNullSafe(F.col("__s")))
    return joined.withColumn(name, (F.col("__before") + F.col("__inside")).cast("int")).select(*hits.columns, name)


def bounded_years(chosen: tuple[int, int], known: tuple[int, int]) -> tuple[int | None, int | None]:
    """Bounds that a reader's choice of years means: the whole known range is no bound, so papers of unknown year stay visible."""
    return (None, None) if tuple(chosen) == tuple(known) else (chosen[0], chosen[1])


def by_id(papers: DataFrame, paper_id: int) -> DataFrame:
    return papers.where(F.col("id") == F.lit(paper_id))


def by_hash(papers: DataFrame, file_hash: str) -> DataFrame:
    return papers.where(F.col("file_hash") == F.lit(file_hash))


def flags_of(papers: DataFrame, state: DataFrame) -> DataFrame:
    """``paper_id, is_favorite, read_later`` of every paper, false where no state is stored."""
    stored = state.select("paper_id", "is_favorite", "read_later")
    joined = papers.select(F.col("id").alias("paper_id")).join(stored, "paper_id", "left")
    return joined.select("paper_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_favorite", "read_later")])


def run_history(runs: DataFrame, paper_id: int, answer: str = "primary_category STRING") -> DataFrame:
    """Runs of one paper in order, their stored answer parsed."""
    return runs.where(F.col("paper_id") == F.lit(paper_id)).withColumn("result", F.from_json("result_json", answer)).orderBy("id")


def search(
    papers: DataFrame,
    labels: DataFrame,
    state: DataFrame | None = None,
    paper_folders: DataFrame | None = None,
    *,
    keyword: str = "",
    categories: Iterable[str] = (),
    tags: Iterable[str] = (),
    methods: Iterable[str] = (),
    vulnerabilities: Iterable[str] = (),
    relevances: Iterable[str] = (),
    statuses: Iterable[str] = (),
    classification_statuses: Iterable[str] = (),
    favorites_only: bool = False,
    read_later_only: bool = False,
    year_min: int | None = None,
    year_max: int | None = None,
    folder_id: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Papers that meet all the filters given, in display order.

    An empty list is no filter; within a list any value matches; a year bound leaves out unknown years.
    Native predicates come first, so they reach the scan; label, flag and folder filters are semi joins.
    """
    favorites, later = flag(favorites_only), flag(read_later_only)
    out = papers
    for column, values in ((F.col("status"), statuses), (F.col("classification_status"), classification_statuses), (effective("primary_category"), categories), (effective("relevance"), relevances)):
        if chosen := list(values):
            out = out.where(column.isin(chosen))
    if year_min is not None:
        out = out.where(F.col("year") >= year_min)
    if year_max is not None:
        out = out.where(F.col("year") <= year_max)
    for wanted, column in ((favorites, "is_favorite"), (later, "read_later")):
        if wanted:
            own = state.where(F.col(column)).select("paper_id")
            out = out.join(own, out["id"] == own["paper_id"], "left_semi")
    if folder_id is not None:
        own = paper_folders.where(F.col("folder_id") == positive_id(folder_id)).select("paper_id")
        out = out.join(own, out["id"] == own["paper_id"], "left_semi")
    for field, names in zip(LABEL_FIELDS, (tags, methods, vulnerabilities), strict=True):
        if chosen := list(names):
            out = having_label(out, labels, field, chosen)
    if keyword.strip():
        out = matching(out, labels, keyword.strip())
    return out.orderBy(*order_key()) if ordered else out


def hydrate(papers: DataFrame, labels: DataFrame, state: DataFrame, folders: DataFrame, paper_folders: DataFrame, notes: DataFrame) -> DataFrame:
    """Papers with labels, flags, note and folders: each side is aggregated once and joined, no look-up per row."""
    inside = paper_folders.join(folders, paper_folders["folder_id"] == folders["id"]).groupBy("paper_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("name_key", "folder_id", "name"))), lambda x: x["name"]).alias("folders")
    )
    out = with_labels(with_effective(papers), labels)
    for right in (inside, state.select("paper_id", "is_favorite", "read_later"), notes.select("paper_id", F.col("content").alias("note"))):
        out = out.join(right, out["id"] == right["paper_id"], "left").drop("paper_id")
    return out.withColumns(
        {
            "folders": F.coalesce("folders", F.array().cast("array<string>")), "note": F.coalesce("note", F.lit("")),
            "is_favorite": F.coalesce("is_favorite", F.lit(False)), "read_later": F.coalesce("read_later", F.lit(False)),
        }
    )


def table_view(hydrated: DataFrame) -> DataFrame:
    """Rows of the list: title or file name, labels as text, and whose classification it is."""
    source = F.when(F.col("manually_reviewed"), "Human").when(F.col("ai_primary_category").isNotNull(), "AI")
    return hydrated.select(
        "id", F.coalesce("title", "filename").alias("title"), "year", "effective_primary_category", "effective_relevance",
        *[F.array_join(f, ", ").alias(f) for f in LABEL_FIELDS], "status", "is_favorite", "read_later", source.alias("classification_source"),
    )


def facets(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct effective labels of each field."""
    return effective_labels(papers, labels).select("field", "label").distinct()


def year_range(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("year") != 0).agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def counts(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "Unread").alias("unread"))


def count_by_category(papers: DataFrame) -> DataFrame:
    return papers.groupBy(F.coalesce(effective("primary_category"), F.lit("Unclassified")).alias("category")).agg(F.count(F.lit(1)).alias("papers"))


def count_by_relevance(papers: DataFrame) -> DataFrame:
    return papers.groupBy(F.coalesce(effective("relevance"), F.lit("Unclassified")).alias("relevance")).agg(F.count(F.lit(1)).alias("papers"))


def folder_counts(folders: DataFrame, paper_folders: DataFrame) -> DataFrame:
    """Folders with the number of papers in each, also empty ones."""
    return folders.join(paper_folders, folders["id"] == paper_folders["folder_id"], "left").groupBy("id", "name", "name_key").agg(F.count("paper_id").alias("papers"))


def status_histogram(papers: DataFrame, runs: DataFrame) -> DataFrame:
    """Classification statuses with how many of each are reviewed and how many runs their papers have."""
    per_paper = runs.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    joined = papers.join(per_paper, papers["id"] == per_paper["paper_id"], "left")
    return joined.groupBy("classification_status").agg(
        F.count(F.lit(1)).alias("papers"), F.count_if("manually_reviewed").alias("reviewed"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs")
    )
