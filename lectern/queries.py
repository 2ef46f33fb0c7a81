"""Queries of the library operators over the plain tables, and the SQL equal to each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import answers, i18n
from lectern.functions import text as tx
from lectern.model import BLOCK, CATEGORIES, LABEL_FIELDS, PAGE, RELEVANCES, SIZE
from lectern.operators import evidence, extraction, fields, layout, metrics, search, state, trigrams
from lectern.plans import ingest, refresh
from lectern.plans import library as lib
from lectern.plans.library import SQL as LIBRARY
from lectern.plans.library import read
from lectern.sources import files
from lectern.sources.digest_tree import Tree
from lectern.sources.scratch import cut, new_folder
from lectern.streaming import retries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, library: bool = True):
    """Register a query under its function's name, with SQL that starts from the library's tables or from the plain ones."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (LIBRARY if library else "") + sql
        return f

    return add


EFFECTIVE = "effective_primary_category, effective_relevance, effective_relevance_confidence"
LIKE = lambda column, word: f"lower({column}) LIKE '%{word}%'"


# --- effective values, filters, search ---


@query(f"SELECT id, {EFFECTIVE} FROM effective")
def effective_values(spark: SparkSession, d: str) -> DataFrame:
    return search.with_effective(lib.papers(spark, d)).select("id", "effective_primary_category", "effective_relevance", "effective_relevance_confidence")


SEARCH = """
, hits AS (
  SELECT * FROM effective e WHERE status IN ('Unread', 'Read', 'Important') AND effective_relevance IN ('A', 'B') AND year >= 1995 AND year <= 2020
  AND EXISTS (SELECT 1 FROM effective_labels l WHERE l.paper_id = e.id AND l.field = 'tags' AND lower(l.label) IN ('the', 'of', 'and', 'de', 'in'))
)
SELECT id, title, year, effective_relevance, CAST(row_number() OVER (ORDER BY CASE effective_relevance WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END, year DESC NULLS LAST,
  translate(coalesce(title, filename), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id) AS INTEGER) AS position FROM hits
"""


@query(SEARCH)
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: combined filters with a label facet, in display order (a position makes the order part of the rows)."""
    found = search.search(
        lib.papers(spark, d), lib.labels(spark, d), statuses=("Unread", "Read", "Important"), relevances=("A", "B"), year_min=1995, year_max=2020,
        tags=("The", "OF", "and", "de", "in"), ordered=False,
    )
    return search.ranked(found).select("id", "title", "year", search.effective("relevance").alias("effective_relevance"), "position")


@query("SELECT id, effective_primary_category FROM effective WHERE effective_primary_category IN ('Authentication', 'Token Security')")
def filter_category(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(lib.papers(spark, d), lib.labels(spark, d), categories=("Authentication", "Token Security"), ordered=False)
    return found.select("id", search.effective("primary_category").alias("effective_primary_category"))


@query("SELECT id, status, classification_status FROM papers WHERE status IN ('Unread', 'Read') AND classification_status IN ('failed', 'classified')")
def filter_status(spark: SparkSession, d: str) -> DataFrame:
    found = search.search(lib.papers(spark, d), lib.labels(spark, d), statuses=("Unread", "Read"), classification_statuses=("failed", "classified"), ordered=False)
    return found.select("id", "status", "classification_status")


@query("SELECT id, year FROM papers WHERE year >= 2010")
def filter_year(spark: SparkSession, d: str) -> DataFrame:
    return search.search(lib.papers(spark, d), lib.labels(spark, d), year_min=2010, ordered=False).select("id", "year")


@query(
    """SELECT id FROM papers p WHERE lower(title) LIKE '%er_th%' OR lower(abstract) LIKE '%er_th%' OR EXISTS (
      SELECT 1 FROM effective_labels l WHERE l.paper_id = p.id AND l.field IN ('tags', 'target_vulnerabilities') AND lower(l.label) LIKE '%er_th%')"""
)
def filter_keyword(spark: SparkSession, d: str) -> DataFrame:
    """A typed underscore is a wildcard."""
    return search.search(lib.papers(spark, d), lib.labels(spark, d), keyword="Er_TH", ordered=False).select("id")


@query(
    """SELECT id FROM papers p WHERE lower(title) LIKE '%ing_the%ther%' OR lower(abstract) LIKE '%ing_the%ther%' OR EXISTS (
      SELECT 1 FROM effective_labels l WHERE l.paper_id = p.id AND l.field IN ('tags', 'target_vulnerabilities') AND lower(l.label) LIKE '%ing_the%ther%')"""
)
def keyword_by_index(spark: SparkSession, d: str) -> DataFrame:
    """The keyword search by a trigram index over the texts it searches, written sorted by trigram."""
    texts = search.searched_texts(lib.papers(spark, d), lib.labels(spark, d))
    path = f"{new_folder(spark, 'trigrams')}/index"
    trigrams.write(texts, path)
    return trigrams.matching(texts, spark.read.parquet(path), "%Ing_The%ther%").select("id").distinct()


@query(
    """SELECT id FROM papers p WHERE EXISTS (SELECT 1 FROM effective_labels l WHERE l.paper_id = p.id AND field = 'tags' AND lower(label) IN ('the', 'of'))
      AND NOT EXISTS (SELECT 1 FROM effective_labels l WHERE l.paper_id = p.id AND field = 'research_methods' AND lower(label) = 'the')"""
)
def filter_labels(spark: SparkSession, d: str) -> DataFrame:
    papers, labels = lib.papers(spark, d), lib.labels(spark, d)
    found = search.search(papers, labels, tags=("The", "of"), ordered=False)
    others = search.having_label(papers, labels, "research_methods", ("THE",)).select("id")
    return found.join(others, "id", "left_anti").select("id")


@query("SELECT id FROM papers JOIN user_state ON paper_id = id WHERE is_favorite AND read_later")
def filter_flags(spark: SparkSession, d: str) -> DataFrame:
    return search.search(lib.papers(spark, d), lib.labels(spark, d), lib.user_state(spark, d), favorites_only=True, read_later_only=True, ordered=False).select("id")


@query("SELECT id FROM papers WHERE id IN (SELECT paper_id FROM paper_folders WHERE folder_id = 3)")
def filter_folder(spark: SparkSession, d: str) -> DataFrame:
    return search.search(lib.papers(spark, d), lib.labels(spark, d), paper_folders=lib.paper_folders(spark, d), folder_id=3, ordered=False).select("id")


LISTS = ", ".join(f"coalesce(array_to_string(list(label ORDER BY translate(label, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), label) FILTER (field = '{f}'), ', '), '') AS {f}" for f in LABEL_FIELDS)


@query(f"""SELECT id, {", ".join(f"coalesce({f}, '') AS {f}" for f in LABEL_FIELDS)} FROM papers LEFT JOIN (SELECT paper_id, {LISTS} FROM effective_labels GROUP BY 1) ON paper_id = id""")
def effective_label_lists(spark: SparkSession, d: str) -> DataFrame:
    out = search.with_labels(lib.papers(spark, d), lib.labels(spark, d))
    order = lambda f: F.array_join(f, ", ")
    return out.select("id", *[order(f).alias(f) for f in LABEL_FIELDS])


@query(
    f"""SELECT e.id, coalesce(title, filename) AS title, year, effective_primary_category, effective_relevance,
      {", ".join(f"coalesce({f}, '') AS {f}" for f in LABEL_FIELDS)}, status, coalesce(is_favorite, false) AS is_favorite, coalesce(read_later, false) AS read_later,
      CASE WHEN manually_reviewed THEN 'Human' WHEN ai_primary_category IS NOT NULL THEN 'AI' END AS classification_source
    FROM effective e LEFT JOIN (SELECT paper_id, {LISTS} FROM effective_labels GROUP BY 1) l ON l.paper_id = e.id LEFT JOIN user_state s ON s.paper_id = e.id"""
)
def table_view(spark: SparkSession, d: str) -> DataFrame:
    return search.table_view(
        search.hydrate(lib.papers(spark, d), lib.labels(spark, d), lib.user_state(spark, d), lib.folders(spark, d), lib.paper_folders(spark, d), lib.notes(spark, d))
    )


@query(
    """SELECT p.id, coalesce(content, '') AS note, coalesce(is_favorite, false) AS is_favorite, coalesce(read_later, false) AS read_later,
      coalesce(folders, '') AS folders FROM papers p LEFT JOIN notes n ON n.paper_id = p.id LEFT JOIN user_state s ON s.paper_id = p.id
      LEFT JOIN (SELECT paper_id, string_agg(name, ', ' ORDER BY name_key, id) AS folders FROM paper_folders JOIN folders ON folder_id = id GROUP BY 1) f ON f.paper_id = p.id"""
)
def hydrated(spark: SparkSession, d: str) -> DataFrame:
    out = search.hydrate(lib.papers(spark, d), lib.labels(spark, d), lib.user_state(spark, d), lib.folders(spark, d), lib.paper_folders(spark, d), lib.notes(spark, d))
    return out.select("id", "note", "is_favorite", "read_later", F.array_join("folders", ", ").alias("folders"))


@query("SELECT id, file_hash FROM papers WHERE file_hash = (SELECT sha256(text) FROM documents WHERE doc_id = 5)")
def lookup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d)
    wanted = read(spark, d, "documents").where("doc_id = 5").select(F.sha2("text", 256).alias("file_hash"))
    return papers.join(F.broadcast(wanted), "file_hash", "left_semi").select("id", "file_hash")


# --- dashboard and facets ---


@query("SELECT count(*) AS total, CAST(count(*) FILTER (status = 'Unread') AS BIGINT) AS unread FROM papers")
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.counts(lib.papers(spark, d))


@query("SELECT coalesce(effective_primary_category, 'Unclassified') AS category, count(*) AS papers FROM effective GROUP BY 1")
def papers_by_category(spark: SparkSession, d: str) -> DataFrame:
    return search.count_by_category(lib.papers(spark, d))


@query("SELECT coalesce(effective_relevance, 'Unclassified') AS relevance, count(*) AS papers FROM effective GROUP BY 1")
def papers_by_relevance(spark: SparkSession, d: str) -> DataFrame:
    return search.count_by_relevance(lib.papers(spark, d))


@query("SELECT id, name, name_key, count(paper_id) AS papers FROM folders LEFT JOIN paper_folders ON folder_id = id GROUP BY ALL")
def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.folder_counts(lib.folders(spark, d), lib.paper_folders(spark, d))


@query("SELECT DISTINCT field, label FROM effective_labels")
def label_facets(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(lib.papers(spark, d), lib.labels(spark, d))


@query("SELECT min(year) AS year_min, max(year) AS year_max FROM papers WHERE year <> 0")
def year_bounds(spark: SparkSession, d: str) -> DataFrame:
    return search.year_range(lib.papers(spark, d))


@query(
    """SELECT classification_status, count(*) AS papers, CAST(count(*) FILTER (manually_reviewed) AS BIGINT) AS reviewed, CAST(coalesce(sum(n), 0) AS BIGINT) AS runs
    FROM papers LEFT JOIN (SELECT paper_id, count(*) AS n FROM runs GROUP BY 1) ON paper_id = id GROUP BY 1"""
)
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return search.status_histogram(lib.papers(spark, d), lib.runs(spark, d))


# --- run history and state ---


PROJECTION = """SELECT paper_id, arg_max(status, id) AS classification_status, CASE WHEN arg_max(status, id) = 'failed' THEN 'failed' END AS classification_error,
      arg_max(result_json, id) FILTER (status = 'classified') AS result_json,
      CASE WHEN max(id) FILTER (status = 'classified') % 5 = 0 THEN NULL WHEN max(id) FILTER (status = 'classified') % 2 = 0 THEN 'local' WHEN max(id) FILTER (status = 'classified') IS NOT NULL THEN 'remote' END AS classification_provider,
      arg_max(model, id) FILTER (status = 'classified') AS classification_model, arg_max(processing_seconds, id) AS processing_seconds,
      CAST(count(*) FILTER (status = 'classified') AS BIGINT) AS successes, count(*) AS attempts FROM runs GROUP BY 1"""


@query(PROJECTION)
def classification_projection(spark: SparkSession, d: str) -> DataFrame:
    return state.classification_projection(lib.runs(spark, d))


@query(PROJECTION)
def projection_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same projection kept up to date: each of five parts of the log is folded once and merged into the state."""
    runs = lib.runs(spark, d)
    states = state.folded(runs.where("id % 5 = 0"))
    for part in range(1, 5):
        states = state.merged(states, state.folded(runs.where(F.col("id") % 5 == part)))
    return state.projected(states)


@query("SELECT id, paper_id, provider, model, status FROM runs QUALIFY row_number() OVER (PARTITION BY coalesce(provider, 'unknown'), model, paper_id ORDER BY id DESC) = 1")
def latest_run_per_model(spark: SparkSession, d: str) -> DataFrame:
    runs = lib.runs(spark, d).withColumn("named", F.coalesce("provider", F.lit("unknown")))
    return metrics.latest_runs(runs, "named", "model", "paper_id").select("id", "paper_id", "provider", "model", "status")


@query("SELECT id, status, json_extract_string(result_json, '$.primary_category') AS primary_category, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS position FROM runs WHERE paper_id = 7")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    runs = search.run_history(lib.runs(spark, d), 7)
    return runs.select("id", "status", "result.primary_category", F.row_number().over(Window.orderBy("id")).alias("position"))


@query(
    """, old AS (SELECT id, file_hash FROM papers WHERE id % 3 = 0), incoming AS (SELECT file_hash, filename AS filepath FROM papers)
    SELECT file_hash, min(filepath) AS filepath, 'Insert' AS route FROM incoming WHERE file_hash NOT IN (SELECT file_hash FROM old) GROUP BY 1"""
)
def inserts_by_hash(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d)
    incoming = papers.select("file_hash", F.col("filename").alias("filepath"))
    fresh, _ = state.new_papers(incoming, papers.where("id % 3 = 0"))
    return fresh.select("file_hash", "filepath", F.lit("Insert").alias("route"))


ROUTES = """, old AS (SELECT file_hash, min(id) AS paper_id, arg_min(classification_status, id) AS s FROM papers WHERE id % 2 = 0 GROUP BY 1),
    files AS (SELECT file_hash, filename AS filepath, row_number() OVER (PARTITION BY file_hash ORDER BY filename) AS nth FROM papers)
    SELECT filepath, CASE WHEN nth > 1 THEN 'Skipped' WHEN paper_id IS NULL THEN 'Insert' WHEN s IN ('pending', 'failed', 'needs_review') THEN 'Retry' ELSE 'Skipped' END AS route
    FROM files LEFT JOIN old USING (file_hash)"""


@query(ROUTES)
def scan_routes(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d)
    stored = papers.where("id % 2 = 0").groupBy("file_hash").agg(F.min("id").alias("id"), F.min_by("classification_status", "id").alias("classification_status"))
    return state.routed(papers.select("file_hash", F.col("filename").alias("filepath")), stored).select("filepath", "route")


@query(ROUTES)
def scan_routes_by_state(spark: SparkSession, d: str) -> DataFrame:
    """The same routes from keyed state: outcomes in one run of the stream, files in the next, started anew on its checkpoint."""
    papers = lib.papers(spark, d)
    stored = papers.where("id % 2 = 0").groupBy("file_hash").agg(F.min_by("classification_status", "id").alias("classification_status"))
    folder = new_folder(spark, "routes")
    partitions = retries.partitions_for(papers.count())
    retries.run(spark, folder, retries.outcomes(stored), pause=0, partitions=partitions)
    retries.run(spark, folder, retries.files(papers.select("file_hash", F.col("filename").alias("filepath"))), pause=0, partitions=partitions)
    return spark.read.schema(retries.ROUTE).parquet(f"{folder}/out").select("filepath", "route")


@query(
    """, arrivals AS (SELECT paper_id, field, value_source, substr(trim(regexp_replace(label, '\\s+', ' ', 'g')), 1, 120) AS label, paper_id AS arrival FROM paper_labels),
    folded AS (SELECT field, translate(label, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS label_key, label, arrival FROM arrivals WHERE label <> '')
    SELECT field, label_key, arg_min(label, (arrival, label)) AS name, count(*) AS uses, min(arrival) AS first_paper FROM folded GROUP BY field, label_key"""
)
def label_dictionary(spark: SparkSession, d: str) -> DataFrame:
    arrivals = lib.labels(spark, d).withColumn("arrival", F.col("paper_id"))
    names = state.label_dictionary(arrivals)
    clean = arrivals.withColumn("label_key", tx.ascii_lower(F.substring(tx.collapse(F.col("label")), 1, 120)))
    return clean.join(names, ["field", "label_key"]).groupBy("field", "label_key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("uses"), F.min("arrival").alias("first_paper"))


_DICTIONARY = """, arrivals AS (SELECT paper_id, field, value_source, substr(trim(regexp_replace(label, '\\s+', ' ', 'g')), 1, 120) AS label, paper_id % 3 AS batch FROM paper_labels),
    folded AS (SELECT *, translate(label, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS label_key FROM arrivals WHERE label <> ''),
    entries AS (SELECT field, label_key, arg_min(label, (batch, paper_id, label)) AS name, min(batch) AS batch FROM folded GROUP BY field, label_key),
    dictionary AS (SELECT row_number() OVER (ORDER BY batch, sha256(field || '|' || label_key)) AS id, field, label_key, name FROM entries)"""


def _dictionary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The dictionary after three commits of labels, one a batch of papers, and all arrivals; each is written, as a commit's input and result are."""
    arrivals = cut(lib.labels(spark, d), "arrivals").withColumn("arrival", F.col("paper_id"))
    dictionary = spark.createDataFrame([], "id long, field string, label_key string, name string")
    for batch in range(3):
        dictionary = cut(state.extended_dictionary(dictionary, arrivals.where(F.col("paper_id") % 3 == batch)), "dictionary")
    return dictionary, arrivals


@query(_DICTIONARY + " SELECT id, field, label_key, name FROM dictionary")
def canonical_labels(spark: SparkSession, d: str) -> DataFrame:
    """A label's name is its first spelling over all commits, and its id stays."""
    return _dictionary(spark, d)[0]


@query(_DICTIONARY + " SELECT DISTINCT paper_id, field, value_source, id AS label_id FROM folded JOIN dictionary USING (field, label_key)")
def label_junction(spark: SparkSession, d: str) -> DataFrame:
    dictionary, arrivals = _dictionary(spark, d)
    return state.junction_ids(arrivals, dictionary)


@query(
    """, changes AS (SELECT event_id AS seq, user_id AS paper_id, event_type = 'click' AS is_favorite, CASE WHEN event_type = 'view' THEN true END AS read_later FROM events),
    new AS (SELECT paper_id, arg_max(is_favorite, seq) AS f, arg_max(read_later, CASE WHEN read_later IS NOT NULL THEN seq END) AS l FROM changes GROUP BY 1)
    SELECT coalesce(s.paper_id, n.paper_id) AS paper_id, coalesce(f, is_favorite, false) AS is_favorite, coalesce(l, read_later, false) AS read_later,
      coalesce(f, is_favorite, false) <> coalesce(is_favorite, false) OR coalesce(l, read_later, false) <> coalesce(read_later, false) AS changed
    FROM user_state s FULL JOIN new n ON s.paper_id = n.paper_id"""
)
def flag_upserts(spark: SparkSession, d: str) -> DataFrame:
    changes = read(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("paper_id"), (F.col("event_type") == "click").alias("is_favorite"), F.when(F.col("event_type") == "view", True).alias("read_later")
    )
    return state.upsert_flags(lib.user_state(spark, d), changes)


@query(
    """, changes AS (SELECT doc_id AS paper_id, doc_id AS seq, 'note ' || (doc_id - doc_id % 20) AS content, 'now' AS updated_at FROM documents WHERE doc_id % 5 = 0)
    SELECT coalesce(n.paper_id, c.paper_id) AS paper_id, coalesce(c.content, n.content) AS content,
      CASE WHEN c.content IS NULL OR n.content = c.content THEN 'before' ELSE 'now' END AS updated_at
    FROM notes n FULL JOIN changes c ON n.paper_id = c.paper_id"""
)
def note_upserts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    changes = read(spark, d, "documents").where(i % 5 == 0).select(
        i.alias("paper_id"), i.alias("seq"), F.concat(F.lit("note "), (i - i % 20).cast("string")).alias("content"), F.lit("now").alias("updated_at")
    )
    return state.upsert_notes(lib.notes(spark, d).withColumn("updated_at", F.lit("before")), changes)


@query("SELECT paper_id, folder_id FROM paper_folders WHERE folder_id NOT IN (3, 5)")
def folder_deletion(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([(3,), (5,)], "id long")
    return state.delete_folder(lib.folders(spark, d), lib.paper_folders(spark, d), gone)[1]


@query(
    """SELECT id AS paper_id FROM papers WHERE ai_primary_category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.paper_id = papers.id)"""
)
def run_backfill(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d).withColumn("classification_error", F.lit(None).cast("string"))
    return state.migrate(papers, lib.runs(spark, d))[1].select("paper_id")


@query(
    """SELECT p.id, CASE WHEN classification_status = 'pending' AND ai_primary_category IS NOT NULL THEN 'classified'
      WHEN classification_status = 'pending' AND id % 2 = 0 THEN 'failed' ELSE classification_status END AS classification_status,
      CASE WHEN manually_reviewed THEN primary_category END AS primary_category FROM papers p"""
)
def migration(spark: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("id") % 2 == 0, "timeout").otherwise("Classifier is not configured")
    papers = lib.papers(spark, d).withColumn("classification_error", error)
    return state.migrate(papers, lib.runs(spark, d))[0].select("id", "classification_status", "primary_category")


@query(
    """, a AS (SELECT id, sha256(filename || coalesce(title, '')) AS h FROM papers WHERE id % 4 < 3), b AS (SELECT id, sha256(filename || CASE WHEN id % 9 = 0 THEN 'x' ELSE coalesce(title, '') END) AS h FROM papers WHERE id % 10 > 0)
    SELECT id FROM a LEFT JOIN b USING (id) WHERE a.h IS DISTINCT FROM b.h"""
)
def append_only_check(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d)
    digest = F.sha2(F.concat("filename", F.coalesce("title", F.lit(""))), 256)
    changed = papers.withColumn("title", F.when(F.col("id") % 9 == 0, F.lit("x")).otherwise(F.col("title")))
    return state.appended_only(papers.where("id % 4 < 3"), changed.where("id % 10 > 0"), digest)


# --- evaluation ---

RATIOS = """CAST(tp + fn AS BIGINT) AS support, CAST(tp + fp AS BIGINT) AS predicted,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END::DOUBLE AS recall,
  CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END::DOUBLE AS f1"""
PAIRS = """, pairs AS (SELECT id, primary_category AS truth, ai_primary_category AS predicted FROM papers WHERE primary_category IS NOT NULL AND ai_primary_category IS NOT NULL)"""
COUNTED = (
    PAIRS
    + """, counted AS (SELECT label, CAST(count(*) FILTER (truth = label AND predicted = label) AS BIGINT) AS tp, CAST(count(*) FILTER (truth <> label AND predicted = label) AS BIGINT) AS fp,
    CAST(count(*) FILTER (truth = label AND predicted <> label) AS BIGINT) AS fn FROM (SELECT truth AS label FROM pairs UNION SELECT predicted FROM pairs), pairs GROUP BY 1)"""
)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return lib.papers(spark, d).select("id", F.col("primary_category").alias("truth"), F.col("ai_primary_category").alias("predicted"))


@query(COUNTED + f"SELECT label, tp, fp, fn, {RATIOS} FROM counted")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(_pairs(spark, d))[1]


@query(PAIRS + "SELECT count(*) AS evaluated, count(*) FILTER (truth = predicted) / count(*) AS accuracy FROM pairs")
def class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(_pairs(spark, d))[0]


@query(
    COUNTED
    + f""", r AS (SELECT tp, fp, fn, {RATIOS} FROM counted), s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf FROM r)
    SELECT tp, fp, fn, tp / (tp + fp) AS micro_precision, tp / (tp + fn) AS micro_recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS micro_f1,
      round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1 FROM s"""
)
def metric_averages(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.averages(metrics.evaluate(_pairs(spark, d))[1])
    return out.withColumns({c: F.round(c, 9) for c in ("macro_precision", "macro_recall", "macro_f1")})


CLASSES = ", ".join(f"'{c}'" for c in CATEGORIES)


@query(
    f""", pairs AS (SELECT primary_category AS truth, ai_primary_category AS predicted FROM papers WHERE primary_category IS NOT NULL AND ai_primary_category IS NOT NULL),
    classes AS (SELECT unnest([{CLASSES}]) AS label, CAST(unnest(range(8)) AS INTEGER) AS position),
    counted AS (SELECT position, label, CAST(count(*) FILTER (truth = label AND predicted = label) AS BIGINT) AS tp, CAST(count(*) FILTER (truth <> label AND predicted = label) AS BIGINT) AS fp,
    CAST(count(*) FILTER (truth = label AND predicted <> label) AS BIGINT) AS fn FROM classes, pairs GROUP BY ALL)
    SELECT position, label, tp, fp, fn, {RATIOS} FROM counted"""
)
def fixed_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fixed_classes(_pairs(spark, d).where("truth IS NOT NULL AND predicted IS NOT NULL"), CATEGORIES)


@query(
    """, pairs AS (SELECT relevance AS truth, ai_relevance AS predicted FROM papers WHERE relevance IS NOT NULL AND ai_relevance IS NOT NULL), c AS (SELECT unnest(['A', 'B', 'C']) AS truth, CAST(unnest(range(3)) AS INTEGER) AS position)
    SELECT position, c.truth, CAST(count(*) FILTER (predicted = 'A') AS BIGINT) AS "A", CAST(count(*) FILTER (predicted = 'B') AS BIGINT) AS "B", CAST(count(*) FILTER (predicted = 'C') AS BIGINT) AS "C" FROM c LEFT JOIN pairs ON pairs.truth = c.truth GROUP BY ALL"""
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = lib.papers(spark, d).where("relevance IS NOT NULL AND ai_relevance IS NOT NULL").select(F.col("relevance").alias("truth"), F.col("ai_relevance").alias("predicted"))
    return metrics.confusion(pairs, RELEVANCES)


@query(
    """, last AS (SELECT * FROM (SELECT coalesce(provider, 'unknown') AS provider, model, r.id, file_hash, coalesce(primary_category, '') AS truth, coalesce(json_extract_string(result_json, '$.primary_category'), '') AS predicted
      FROM runs r JOIN papers p ON p.id = r.paper_id WHERE manually_reviewed AND r.status = 'classified') QUALIFY row_number() OVER (PARTITION BY provider, model, file_hash ORDER BY id DESC) = 1)
    SELECT provider, model, count(*) AS evaluated, count(*) FILTER (truth = predicted) / count(*) AS accuracy FROM last WHERE truth <> '' AND predicted <> '' GROUP BY ALL"""
)
def provider_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate_providers(files.reviewed_runs(lib.runs(spark, d), lib.papers(spark, d)))[0]


LABEL_SETS = """, split AS (SELECT doc_id AS doc, [y for y in [trim(regexp_replace(x, '[\\s]+', ' ', 'g')) for x in string_split(text, ' ')] if y <> ''] AS words FROM documents),
  sets AS (SELECT doc, list_distinct(words[1:len(words) - 1]) AS truth, list_distinct(words[2:]) AS predicted FROM split)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    """Two label sets of each document: all words but the last, and all but the first."""
    words = F.filter(F.transform(F.split("text", " "), tx.collapse), lambda w: w != "")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), words.alias("words"))
    most = F.greatest(F.size("words") - 1, F.lit(0))
    return docs.select("doc", F.slice("words", F.lit(1), most).alias("truth"), F.slice("words", F.lit(2), most).alias("predicted"))


@query(
    LABEL_SETS
    + f""", t AS (SELECT doc, unnest(truth) AS label FROM sets), p AS (SELECT doc, unnest(predicted) AS label FROM sets), j AS (SELECT coalesce(t.label, p.label) AS label, t.doc IS NOT NULL AS a, p.doc IS NOT NULL AS b FROM t FULL JOIN p ON t.doc = p.doc AND t.label = p.label),
    counted AS (SELECT label, CAST(count(*) FILTER (a AND b) AS BIGINT) AS tp, CAST(count(*) FILTER (b AND NOT a) AS BIGINT) AS fp, CAST(count(*) FILTER (a AND NOT b) AS BIGINT) AS fn FROM j GROUP BY 1) SELECT label, tp, fp, fn, {RATIOS} FROM counted"""
)
def multilabel_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.multilabel(_sets(spark, d), "target_vulnerabilities")


@query(LABEL_SETS + "SELECT count(*) AS evaluated, count(*) FILTER (list_sort(truth) = list_sort(predicted)) / count(*) AS exact_match_accuracy FROM sets")
def multilabel_exact_match(spark: SparkSession, d: str) -> DataFrame:
    return metrics.exact_match(_sets(spark, d), "target_vulnerabilities")


@query(
    """, e AS (SELECT l_orderkey AS k, CAST(l_quantity % 4 AS INTEGER) AS priority, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem),
    t AS (SELECT k, max(priority) AS priority FROM e GROUP BY 1)
    SELECT k, CASE WHEN min(year) = max(year) THEN min(year) END AS year, priority FROM e JOIN t USING (k, priority) GROUP BY k, priority"""
)
def unanimous_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") % 4).cast("int").alias("priority"), F.year("l_shipdate").alias("year"))
    return metrics.unanimous_top(e, "k", "priority", "year")


# --- text functions ---


@query("SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS clean FROM documents", library=False)
def whitespace_collapse(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", tx.blank_to_null(F.col("text")).alias("clean"))


@query(
    "SELECT doc_id, len(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(len(regexp_replace(text, '\\P{L}', '', 'g')), 1) AS ratio FROM documents", library=False
)
def ascii_ratio(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", tx.ascii_letter_ratio(F.col("text")).alias("ratio"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages", library=False)
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", tx.collapse(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


@query("SELECT doc_id, CASE WHEN instr(text, '. ') > 0 THEN substr(text, 1, instr(text, '. ') - 1) ELSE text END AS head FROM documents", library=False)
def text_before_stop(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", tx.cut_at_first(F.col("text"), r"\. ").alias("head"))


@query("SELECT event_id, value >= 0 AND value < 50 AS good FROM events", library=False)
def duration_checks(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("value") >= 50, F.lit(float("inf"))).otherwise(F.col("value"))
    return read(spark, d, "events").select("event_id", tx.valid_seconds(v).alias("good"))


@query(
    """SELECT paper_id, string_agg(label, '|' ORDER BY pos) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, lower(label) ORDER BY pos) AS nth
      FROM (SELECT paper_id, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label, pos
        FROM (SELECT doc_id AS paper_id, unnest(string_split(text, ' ')) AS label, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents)) WHERE label <> '') WHERE nth = 1 GROUP BY 1""",
    library=False,
)
def first_spelling(spark: SparkSession, d: str) -> DataFrame:
    """First spelling of the words of each whole text that agree but for case, in order."""
    out = read(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.array_join(tx.clean_list(F.split("text", " ")), "|").alias("labels"))
    return out.where("labels <> ''")


# --- files, identity, mutations ---


@query("SELECT file_hash, count(*) AS copies, min(id) AS first_id FROM papers GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark: SparkSession, d: str) -> DataFrame:
    return lib.papers(spark, d).groupBy("file_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


@query(
    """, f AS (SELECT file_hash, filename AS path, row_number() OVER (PARTITION BY file_hash ORDER BY filename) AS nth, id % 13 <> 0 AS valid FROM papers)
    SELECT path, CASE WHEN NOT valid THEN 'invalid' WHEN nth > 1 THEN 'duplicate' END AS error FROM f"""
)
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    found = lib.papers(spark, d).select("file_hash", F.col("filename").alias("path"), (F.col("id") % 13 != 0).alias("valid"))
    return files.inventory(found).select("path", "error")


@query(
    """SELECT coalesce(a.file_hash, b.file_hash) AS file_hash, CASE WHEN a.file_hash IS NULL THEN 'missing' WHEN b.file_hash IS NULL THEN 'unexpected' ELSE 'present' END AS status
    FROM (SELECT DISTINCT file_hash FROM papers WHERE id % 3 > 0) a FULL JOIN (SELECT DISTINCT file_hash FROM papers WHERE id % 5 > 0) b ON a.file_hash = b.file_hash"""
)
def inventory_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d)
    return files.reconcile(papers.where("id % 3 > 0"), papers.where("id % 5 > 0"))


@query(
    """SELECT p.id, p.file_hash, arg_min(f.filename, (f.filename <> p.filename, f.filename)) AS path FROM papers p LEFT JOIN papers f ON f.file_hash = p.file_hash AND f.id % 4 > 0 GROUP BY ALL"""
)
def source_location(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d)
    on_disk = papers.where("id % 4 > 0").select("file_hash", F.col("filename").alias("path"), F.col("filename").alias("name"))
    return files.located(papers.withColumn("filepath", F.col("filename")), on_disk)


@query("SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'new' ELSE title END AS title FROM papers")
def guarded_metadata_update(spark: SparkSession, d: str) -> DataFrame:
    """Of the updates offered, those with a wrong hash (odd ids) change nothing."""
    papers = lib.papers(spark, d).select("id", "file_hash", "title")
    update = papers.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("file_hash")).otherwise("other").alias("file_hash"), F.lit("new").alias("title"))
    return state.guarded_update(papers, update, ["title"]).select("id", "title")


@query(
    """SELECT id, CASE WHEN id % 4 = 0 THEN 'Authorization' ELSE primary_category END AS primary_category, CASE WHEN id % 4 = 0 THEN 'B' ELSE relevance END AS relevance,
    CASE WHEN id % 8 = 0 THEN 'a reason' ELSE 'old' END AS relevance_reason, manually_reviewed OR id % 4 = 0 AS manually_reviewed FROM papers"""
)
def human_review(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d).withColumn("relevance_reason", F.lit("old"))
    reviews = papers.where("id % 4 = 0").select(
        F.col("id").alias("paper_id"), F.lit("Authorization").alias("primary_category"), F.lit("B").alias("relevance"), F.when(F.col("id") % 8 == 0, "  a \t reason ").alias("relevance_reason")
    )
    return state.review(papers, reviews).select("id", "primary_category", "relevance", "relevance_reason", "manually_reviewed")


@query(
    """, wanted AS (SELECT doc_id AS paper_id, CASE WHEN doc_id % 12 = 0 THEN NULL ELSE doc_id % 24 + 1 END AS folder_id FROM documents WHERE doc_id % 6 = 0)
    SELECT paper_id, folder_id FROM paper_folders WHERE paper_id NOT IN (SELECT paper_id FROM wanted) UNION ALL SELECT paper_id, folder_id FROM wanted WHERE folder_id IS NOT NULL"""
)
def folder_membership(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    wanted = read(spark, d, "documents").where(i % 6 == 0).select(i.alias("paper_id"), F.when(i % 12 != 0, i % 24 + 1).alias("folder_id"))
    return state.set_membership(lib.paper_folders(spark, d), wanted, lib.folders(spark, d))


@query("SELECT paper_id, field, value_source, label FROM paper_labels WHERE NOT (paper_id % 3 = 0 AND field = 'tags' AND value_source = 'ai') UNION ALL SELECT id, 'tags', 'ai', 'replaced' FROM papers WHERE id % 6 = 0")
def label_replacement(spark: SparkSession, d: str) -> DataFrame:
    changes = lib.papers(spark, d).where("id % 3 = 0").select(
        F.col("id").alias("paper_id"), F.lit("tags").alias("field"), F.lit("ai").alias("value_source"), F.when(F.col("id") % 6 == 0, "replaced").alias("label")
    )
    return state.replace_labels(lib.labels(spark, d), changes)


# --- projections ---


@query(
    """SELECT id, substr(coalesce(title, 'Unknown'), 1, 500) AS title, substr(nullif(abstract, ''), 1, 6000) AS abstract, CASE WHEN nullif(abstract, '') IS NULL THEN substr(nullif(coalesce(title, ''), ''), 1, 2500) END AS introduction_excerpt FROM papers"""
)
def classifier_payload(spark: SparkSession, d: str) -> DataFrame:
    no_words = F.array().cast("array<string>")
    p = ingest.payload(F.col("title"), F.col("abstract"), no_words, F.coalesce("title", F.lit("")))
    return lib.papers(spark, d).select("id", p.alias("p")).select("id", "p.title", "p.abstract", "p.introduction_excerpt")


@query("SELECT id, status, CASE status WHEN 'Unread' THEN '未読' WHEN 'Screened' THEN '確認済み' WHEN 'Read' THEN '既読' WHEN 'Important' THEN '重要' END AS status_name, coalesce(relevance, '') AS relevance, CASE relevance WHEN 'A' THEN 'A — directly relevant' WHEN 'C' THEN 'C — peripheral' ELSE '' END AS relevance_name FROM papers")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d).select("id", "status", F.coalesce("relevance", F.lit("")).alias("relevance"))
    return i18n.translated(i18n.translated(papers, "status", "ja"), "relevance", "ja")


@query(
    """SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1""", library=False
)
def ordered_history(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return c.groupBy("conv_id").agg(F.array_join(turns, ">").alias("roles"), F.max_by("text", "turn").alias("last_text"))


@query(
    """SELECT conv_id, turn, text || ' ' || following AS record FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations) WHERE len(text) < 160 AND len(following) < 160""",
    library=False,
)
def adjacent_records(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").withColumn("following", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where((F.length("text") < 160) & (F.length("following") < 160)).select("conv_id", "turn", F.concat_ws(" ", "text", "following").alias("record"))


@query(
    """SELECT l_orderkey AS k, arg_max(l_partkey, (4 * l_quantity - 8 * l_discount, -l_linenumber, -l_partkey)) AS best FROM lineitem GROUP BY 1""", library=False
)
def first_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Of equal scores the earliest candidate wins."""
    score = F.struct((4 * F.col("l_quantity") - 8 * F.col("l_discount")).alias("s"), (-F.col("l_linenumber")).alias("p"), (-F.col("l_partkey")).alias("k"))
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max_by("l_partkey", score).alias("best"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?:19|20)[0-9]{2}')) AS years, min(CAST(nullif(regexp_extract(text, '((?:19|20)[0-9]{2})', 1), '') AS INTEGER)) AS first_year FROM documents GROUP BY ALL", library=False)
def years_in_text(spark: SparkSession, d: str) -> DataFrame:
    pattern = "((?:19|20)[0-9]{2})"
    first = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    return read(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).cast("long").alias("years"), first.cast("int").alias("first_year"))


_LISTS = {"tags": (11, 30), "research_methods": (13, 20), "target_vulnerabilities": (15, 30)}


def _objections() -> str:
    out = []
    for f in ("primary_category", "tags", "research_methods", "target_vulnerabilities", "relevance", "relevance_reason", "relevance_confidence"):
        kind = f"json_type(j, '$.{f}')"
        out.append(f"CASE WHEN NOT json_exists(j, '$.{f}') THEN '{f}: missing' END")
        if f in _LISTS:
            out += [f"CASE WHEN {kind} <> 'ARRAY' OR len(list_filter(json_extract(j, '$.{f}[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN '{f}: not a list of texts' END", f"CASE WHEN json_array_length(j, '$.{f}') > {_LISTS[f][1]} THEN '{f}: over {_LISTS[f][1]}' END"]
        elif f == "relevance_confidence":
            out.append(f"CASE WHEN {kind} NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN '{f}: not a number' WHEN {kind} IS NOT NULL AND CAST(json_extract_string(j, '$.{f}') AS DOUBLE) NOT BETWEEN 0 AND 1 THEN '{f}: not between 0 and 1' END")
        elif f == "relevance_reason":
            out.append(f"CASE WHEN {kind} <> 'VARCHAR' THEN '{f}: not a text' WHEN trim(regexp_replace(json_extract_string(j, '$.{f}'), '\\s+', ' ', 'g')) = '' THEN '{f}: blank' WHEN length(json_extract_string(j, '$.{f}')) > 500 THEN '{f}: over 500' END")
        else:
            allowed = ", ".join(f"'{x}'" for x in (CATEGORIES if f == "primary_category" else RELEVANCES))
            out.append(f"CASE WHEN {kind} <> 'VARCHAR' THEN '{f}: not a text' WHEN json_extract_string(j, '$.{f}') NOT IN ({allowed}) THEN '{f}: not allowed' END")
    return ", ".join(out)


ANSWERS = f"""
WITH w AS (SELECT doc_id AS id, n_chars, list_filter(string_split(text, ' '), lambda x: true) AS split FROM documents),
d AS (SELECT id, n_chars, list_filter(split, lambda x, i: list_position(split, x) = i) AS words FROM w),
parts AS (
  SELECT id, [x for x in [
    '"primary_category":' || to_json([{", ".join(f"'{c}'" for c in (*CATEGORIES, "Unknown"))}][id % 9 + 1]),
    '"tags":' || CASE WHEN id % 8 = 1 THEN 'null' ELSE CAST(to_json(list_filter(words, lambda x: length(x) = 11)) AS VARCHAR) END,
    '"research_methods":' || to_json(list_filter(words, lambda x: length(x) = 13)), '"target_vulnerabilities":' || to_json(list_filter(words, lambda x: length(x) = 15)),
    CASE WHEN id % 8 <> 3 THEN '"relevance":' || to_json(['A', 'B', 'C', 'D'][id // 8 % 4 + 1]) END, '"relevance_reason":' || to_json(array_to_string(list_filter(words, lambda x: length(x) = 9), ' ')),
    '"relevance_confidence":' || CASE WHEN id % 8 = 0 THEN '"' || CAST(n_chars % 120 / 100 AS VARCHAR) || '"' ELSE CAST(n_chars % 120 / 100 AS VARCHAR) END, CASE WHEN id % 8 = 2 THEN '"note":1' END] if x IS NOT NULL] AS parts FROM d
), raw AS (
  SELECT id, CASE id % 8 WHEN 4 THEN '{{' || array_to_string(parts, ',') WHEN 5 THEN '[{{' || array_to_string(parts, ',') || '}}]' ELSE '{{' || array_to_string(parts, ',') || '}}' END AS answer FROM parts
), read AS (SELECT id, CASE WHEN json_valid(answer) THEN CAST(answer AS JSON) END AS j FROM raw),
judged AS (
  SELECT id, j, CASE WHEN j IS NULL THEN 'malformed' WHEN json_type(j) <> 'OBJECT' THEN 'not an object'
    ELSE array_to_string(list_concat([x for x in [{_objections()}] if x IS NOT NULL], [x || ': unknown' for x in list_sort(json_keys(j)) if x NOT IN ('primary_category', 'tags', 'research_methods', 'target_vulnerabilities', 'relevance', 'relevance_reason', 'relevance_confidence')]), '; ') END AS errors FROM read
), cleaned AS (
  SELECT *, {", ".join(f"[trim(regexp_replace(x, '\\s+', ' ', 'g')) for x in json_extract_string(j, '$.{f}[*]')] AS {f}" for f in _LISTS)} FROM judged
)
SELECT id, errors, CASE WHEN errors = '' THEN json_extract_string(j, '$.primary_category') END AS primary_category, CASE WHEN errors = '' THEN json_extract_string(j, '$.relevance') END AS relevance,
  {", ".join(f"CASE WHEN errors = '' THEN array_to_string(list_filter({f}, lambda x, i: x <> '' AND list_position(list_transform({f}, lambda y: lower(y)), lower(x)) = i), '|') END AS {f}" for f in _LISTS)},
  CASE WHEN errors = '' THEN trim(regexp_replace(json_extract_string(j, '$.relevance_reason'), '\\s+', ' ', 'g')) END AS relevance_reason,
  CASE WHEN errors = '' THEN CAST(json_extract_string(j, '$.relevance_confidence') AS DOUBLE) END AS relevance_confidence
FROM cleaned
"""


@query(ANSWERS, library=False)
def strict_answers(spark: SparkSession, d: str) -> DataFrame:
    """Raw answers read strictly: a classification, or every reason to refuse it."""
    read_ = lib.answers(spark, d).select("id", answers.parsed(F.col("answer")).alias("answer"))
    judged = read_.withColumn("errors", answers.errors(F.col("answer"))).select("id", "errors", answers.classification(F.col("answer"), F.col("errors")).alias("c"))
    lists = [F.array_join(f"c.{f}", "|").alias(f) for f in LABEL_FIELDS]
    return judged.select("id", F.array_join("errors", "; ").alias("errors"), "c.primary_category", "c.relevance", *lists, "c.relevance_reason", "c.relevance_confidence")


# --- evidence and layout as rows ---

_MONTHS = r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b"
_AFFILIATION = evidence.AFFILIATION.replace("(?iU)", "(?i)")
_BEFORE = evidence.BEFORE_KNOWN.replace("(?iUs)", "(?is)")
#: The known venues without a look ahead: what follows the name is a second group.
_KNOWN = [(r"USENIX Security Symposium", ""), (r"Symposium on Usable Privacy and Security", ""), (r"Network and Distributed System Security\s*\(NDSS\)\s*Symposium", ""), ("NDSS", r"\s+[’'']?\d{2,4}\b"), ("ESORICS", r"\s+20\d{2}\b"), ("Computer Security Symposium", ""), (r"情報処理学会第\d+回全国大会", ""), ("WWW", r"\s+20\d{2}\b")]


def _known_venue() -> str:
    parts = []
    for name, tail in _KNOWN:
        before = f"regexp_extract(r, '(?is)^(.*?)({name}){tail}', 1)"
        parts.append(f"WHEN len(r) <= 450 AND regexp_matches(r, '(?i){name}{tail}') AND regexp_matches(trim({before}), '{_BEFORE}') THEN {{'name': trim(regexp_extract(r, '(?is)^(.*?)({name}){tail}', 2)), 'source': '{evidence.HEADER}'}}")
    return " ".join(parts)


def _plain(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


PUBLISHED = rf"""
WITH d AS (
  SELECT doc_id AS key, CAST(1990 + doc_id % 35 AS VARCHAR) AS y, CAST(doc_id % 30 + 1 AS VARCHAR) AS n, coalesce(text, '') AS body, CASE WHEN doc_id % 4 = 0 THEN (1991 + doc_id % 35) || '-0' || doc_id % 11 END AS stated FROM documents
), pages AS (
  SELECT key, stated, CASE key % 10 WHEN 0 THEN 'Journal of Web Security, Vol. ' || n || ', ' || y WHEN 1 THEN '© ' || y || ' The Authors' WHEN 2 THEN 'Received: 2 May 1989; Published: 3 June ' || y
    WHEN 3 THEN 'Proceedings of the ' || n || 'th USENIX Security Symposium' || chr(10) || 'August 12, ' || y WHEN 4 THEN 'Paper published at Workshop on Web Security ' || y || '.' WHEN 5 THEN 'Copyright ' || y || chr(10) || '(c) 1989 Others'
    WHEN 6 THEN 'arXiv of ' || y WHEN 7 THEN 'International Conference on Web Safety ' || y WHEN 8 THEN 'Published ' || y ELSE 'NDSS ' || y END || chr(10) || body AS text FROM d
), split AS (
  SELECT key, text, [trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) for x in regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')] AS raw FROM pages
), lines AS (
  SELECT key, unnest(list_filter(raw, lambda x: x <> '')) AS line, generate_subscripts(list_filter(raw, lambda x: x <> ''), 1) AS pos FROM split
), paired AS (
  SELECT *, lead(line) OVER (PARTITION BY key ORDER BY pos) AS following FROM lines
), records AS (
  SELECT key, r, min(place) AS place FROM (SELECT key, line AS r, (0, pos) AS place FROM paired UNION ALL SELECT key, line || ' ' || following, (2, pos) FROM paired WHERE len(line) < 160 AND len(following) < 160) GROUP BY 1, 2
), covers AS (
  SELECT key, regexp_matches(text, '{_plain(evidence.PROCEEDINGS)}') AND len(list_filter(raw, lambda x: regexp_matches(x, '{_plain(evidence.FRONT_HEADING)}'))) = 0 AS cover FROM split
), read AS (
  SELECT records.*, cover, CASE WHEN regexp_matches(r, '{_plain(evidence.NO_DATE)}') OR regexp_matches(r, '{_plain(evidence.NO_VENUE)}') THEN NULL {_known_venue()}
    WHEN regexp_matches(p, '{_plain(evidence.MEETING_NAME)}') AND NOT regexp_matches(p, '{_plain(evidence.PUBLISHER)}') THEN {{'name': p, 'source': '{evidence.PUBLICATION}'}}
    WHEN regexp_matches(j, '{_plain(evidence.SERIAL)}') AND NOT regexp_matches(j, '{_AFFILIATION}') AND NOT regexp_matches(j, '{_plain(evidence.RIGHTS)}') THEN {{'name': j, 'source': '{evidence.JOURNAL}'}}
    WHEN m <> '' AND NOT regexp_matches(m, '{_plain(evidence.HOST)}') AND regexp_matches(m, '^(?:(?:(?i:on|of|the|and|in|for|conference|symposium|workshop)|\p{{Lu}}\S*)(?:\s+|$))+$') THEN {{'name': m, 'source': '{evidence.HEADER}'}} END AS v
  FROM (SELECT *, trim(regexp_extract(r, '{_plain(evidence.PUBLISHED_AT)}', 1)) AS p, trim(regexp_extract(r, '{_plain(evidence.VOLUME_OF)}', 1), ' ,;:-') AS j, trim(regexp_extract(r, '{_plain(evidence.MEETING)}', 1)) AS m FROM records) records JOIN covers USING (key)
), found AS (
  SELECT key, r, place, cover, v.name AS venue, CASE WHEN v.source = '{evidence.HEADER}' AND cover THEN 'first page proceedings cover' ELSE v.source END AS source FROM read
), venues AS (
  SELECT key, arg_min({{'venue': venue, 'source': source}}, (NOT regexp_matches(r, '{_plain(evidence.VOLUME)}'), place)) AS v FROM found WHERE venue IS NOT NULL GROUP BY key
), spans AS (
  SELECT key, place, 4 AS priority, '{evidence.PUBLICATION}' AS source, regexp_extract(r, '(?i)(?:^|;\s*)published\s*[:：]\s*(.*?)(?:;|copyright|©|$)', 1) AS span FROM found WHERE regexp_matches(r, '(?i)(?:^|;\s*)published\s*[:：]')
  UNION ALL
  SELECT key, place, CASE WHEN venue IS NOT NULL THEN CASE WHEN source = '{evidence.JOURNAL}' THEN 4 ELSE 3 END WHEN published THEN 4 WHEN on_cover THEN 3 ELSE 1 END,
    CASE WHEN venue IS NOT NULL THEN source WHEN published THEN '{evidence.PUBLICATION}' WHEN on_cover THEN '{evidence.DATED_COVER}' ELSE '{evidence.RIGHTS_LINE}' END, CASE WHEN venue IS NOT NULL THEN regexp_split_to_array(r, '{_plain(evidence.COPYRIGHT)}')[1] ELSE r END
  FROM (SELECT *, regexp_matches(r, '{_plain(evidence.PUBLISHED_YEAR)}') AS published, cover AND len(r) < 140 AND regexp_matches(r, '(?i){_MONTHS}') AND NOT regexp_matches(r, '(?i)copyright|©') AS on_cover, regexp_matches(r, '{_plain(evidence.COPYRIGHT_LINE)}') AS rights FROM found
    WHERE NOT regexp_matches(r, '{_plain(evidence.NO_DATE)}') AND regexp_matches(r, '\b(?:19|20)\d{{2}}\b')) WHERE venue IS NOT NULL OR published OR on_cover OR rights
), evidence AS (
  SELECT key, place, priority, source, CAST(unnest(regexp_extract_all(span, '\b(?:19|20)\d{{2}}\b')) AS INTEGER) AS year FROM spans
  UNION ALL SELECT key, (3, 1), 2, 'PDF metadata', CAST(substr(stated, 1, 4) AS INTEGER) FROM pages WHERE try_cast(stated || '-01' AS DATE) IS NOT NULL
), best AS (
  SELECT key, CASE WHEN min(year) = max(year) THEN min(year) END AS year, CASE WHEN min(year) = max(year) THEN arg_min(source, place) END AS source FROM evidence JOIN (SELECT key, max(priority) AS priority FROM evidence GROUP BY 1) USING (key, priority) GROUP BY 1
)
SELECT key AS doc_id, v.venue AS venue, v.source AS venue_source, year, best.source AS year_source FROM pages LEFT JOIN venues USING (key) LEFT JOIN best USING (key)
"""


@query(PUBLISHED, library=False)
def publication_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Venue and year of every document by rules over the records of its text, and what each rests on."""
    pages = lib.dated(spark, d)
    found = evidence.located(pages)
    years = evidence.agreed(evidence.evidence(pages, found)).withColumnRenamed("source", "year_source")
    out = pages.select("key").join(evidence.venues(found).withColumnRenamed("source", "venue_source"), "key", "left").join(years, "key", "left")
    return out.select(F.col("key").alias("doc_id"), "venue", "venue_source", "year", "year_source")


@query(
    """WITH rows AS (
      SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, CAST(l_partkey % 700 AS DOUBLE) AS y0, l_partkey % 700 + l_quantity * 3 AS y1, CAST(l_suppkey % 3 * 180 AS DOUBLE) AS x0, l_suppkey % 3 * 180 + 170 + l_quantity AS x1, l_extendedprice AS n FROM lineitem
    ), best AS (
      SELECT key, arg_max({'pos': pos, 'x0': x0, 'x1': x1}, (n, -y0, -x0, -pos)) AS b FROM rows GROUP BY 1
    ), fit AS (
      SELECT rows.*, pos = b.pos AS chosen FROM rows JOIN best USING (key) WHERE pos = b.pos OR abs(b.x0 - x0) <= greatest(18, (b.x1 - b.x0) * 0.1) AND x1 <= b.x1 + 25
    ), gaps AS (
      SELECT *, coalesce(y0 - lag(y1) OVER (PARTITION BY key ORDER BY y0, chosen DESC, x0, pos) > 32, false) AS apart FROM fit
    ), islands AS (
      SELECT *, sum(apart::INT) OVER (PARTITION BY key ORDER BY y0, chosen DESC, x0, pos ROWS UNBOUNDED PRECEDING) AS run FROM gaps
    )
    SELECT key, count(*) AS paragraphs, min(y0) AS top, max(y1) AS bottom, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY y0, chosen DESC, x0, pos) AS rows FROM islands WHERE (key, run) IN (SELECT (key, run) FROM islands WHERE chosen) GROUP BY 1""",
    library=False,
)
def paragraph_runs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that follow the weightiest of each page in its column without a large gap: islands of rows."""
    rows = lib.columns(spark, d)
    rank = F.struct("n", (-F.col("y0")).alias("y"), (-F.col("x0")).alias("x"), (-F.col("at")).alias("a"))
    ranked = rows.withColumn("best", F.max_by("at", rank).over(Window.partitionBy("key")))
    kept = layout.runs(ranked, ("key",), F.col("at") == F.col("best"))
    order = F.struct("y0", (~F.col("chosen")).alias("other"), "x0", "at")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["at"].cast("string")), " ")
    return kept.groupBy("key").agg(F.count(F.lit(1)).alias("paragraphs"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), listed.alias("rows"))


_BAD_TITLES = " OR ".join(f"regexp_matches(lower(clean), '{p.replace('(?U)', '').replace('(?=', '(?:')}')" for p in fields.BAD_TITLE)


@query(
    rf"""WITH rows AS (
      SELECT doc_id AS key, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents
    ), blocks AS (
      SELECT key, pos, text, 20.0 * pos AS y0, 20.0 * pos + 12 + len(text) % 7 AS y1, 12.0 + len(text) % 7 AS size, len(text) % 11 <> 0 AS flat, len(text) * 5.0 AS width,
        trim(trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g')), ' -–—|:：⋆∗†‡*') AS clean FROM rows
    ), fit AS (
      SELECT *, max(size) OVER (PARTITION BY key) AS largest FROM blocks WHERE flat AND y0 <= 200 AND size >= 13 AND width >= 2 * size AND len(clean) BETWEEN 5 AND 300 AND NOT contains(clean, '@') AND len(string_split(clean, ' ')) <= 42
        AND NOT ({_BAD_TITLES} OR len(clean) < 28 AND regexp_matches(clean, '^[^\pL]+$'))
        AND NOT regexp_matches(text, '(?i)^[ \t]*(?:abstract[ \t]*(?:$|[:：.–—-])|summary[ \t]*(?:$|[:：–—]))') AND NOT regexp_matches(trim(text), '(?i)^[ \t]*(?:(?:\d{{1,2}}(?:\.\d+)*[.)]?|[IVX]+[.)])[ \t]+[A-Za-z][^\n]{{0,100}}|(?:references|bibliography|acknowledge?ments)[ \t]*|(?:\d{{1,2}}[.)]?[ \t]*)?introduction[ \t]*:?)$')
    ), best AS (
      SELECT key, arg_max({{'y0': y0, 'y1': y1, 'size': size, 'pos': pos}}, (4 * size - y0 / 100, -y0, -pos)) AS b FROM fit WHERE size >= largest - 2.6 GROUP BY 1
    ), picked AS (
      SELECT fit.* FROM fit JOIN best USING (key) WHERE size >= largest - 2.6 AND (pos = b.pos OR y0 - b.y1 BETWEEN -1 AND greatest(25, b.size * 2.2) AND abs(size - b.size) <= 2.6)
    ), joined AS (
      SELECT key, string_agg(clean, ' ' ORDER BY y0, pos) AS clean, max(y1) AS bottom FROM picked GROUP BY 1
    )
    SELECT key AS doc_id, trim(clean, ' -–—|:：⋆∗†‡*') AS title, CAST(bottom AS DOUBLE) AS bottom FROM joined WHERE len(clean) BETWEEN 5 AND 300 AND len(string_split(clean, ' ')) <= 42 AND NOT ({_BAD_TITLES})""",
    library=False,
)
def layout_titles(spark: SparkSession, d: str) -> DataFrame:
    """The largest early line of each document with the lines of its size that follow it."""
    return layout.titles(layout.blocks(lib.printed(spark, d))).select(F.col("key").alias("doc_id"), "title", "bottom")


# --- refresh and audit ---


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    base = lib.papers(spark, d).select("id", "title", "abstract", "year", F.array("status").alias("keywords"), F.lit(None).cast("string").alias("introduction_excerpt"))
    new = base.withColumns(
        {"title": F.when(i % 5 == 0, F.lit("other")).otherwise(F.col("title")), "year": F.when(i % 3 == 0, F.lit(None)).otherwise(F.col("year")), "abstract": F.when(i % 4 == 0, F.concat(F.lit(". "), "abstract")).otherwise(F.col("abstract"))}
    )
    return base, new


DIFF = """, diff AS (SELECT id, id % 5 = 0 AND coalesce(title, '') <> 'other' AS t, id % 4 = 0 AND abstract IS NOT NULL AS a, id % 3 = 0 AND year IS NOT NULL AS y FROM papers)"""


@query("SELECT doc_id, CASE WHEN doc_id % 101 = 0 THEN 'removed' WHEN doc_id % 997 = 3 THEN 'changed' END AS change FROM documents WHERE doc_id % 101 = 0 OR doc_id % 997 = 3 UNION ALL SELECT -1 - doc_id, 'added' FROM documents WHERE doc_id % 499 = 7", library=False)
def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which a later version of the documents differs, by the buckets whose digests do."""
    old = read(spark, d, "documents")
    i = F.col("doc_id")
    new = old.where(i % 101 != 0).withColumn("text", F.when(i % 997 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text"))).unionByName(old.where(i % 499 == 7).withColumn("doc_id", -1 - i))
    folder = new_folder(spark, "tree")
    return Tree.write(old, f"{folder}/old", ["doc_id"]).changes(Tree.write(new, f"{folder}/new", ["doc_id"]), ["doc_id"])


@query(DIFF + " SELECT id, concat_ws(',', CASE WHEN t THEN 'title' END, CASE WHEN y THEN 'year' END, CASE WHEN a THEN 'abstract' END) AS changes, t OR a AS input_changed FROM diff")
def refresh_changes(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    out = refresh.changes(old, new, ("title", "year", "abstract", "keywords"))
    return out.withColumn("changes", F.array_join("changes", ","))


@query(
    DIFF
    + " SELECT count(*) AS papers, CAST(count(*) FILTER (t OR a OR y) AS BIGINT) AS changed, CAST(count(*) FILTER (t OR a) AS BIGINT) AS input_changed, CAST(count(*) FILTER (y AND NOT (t OR a)) AS BIGINT) AS bibliographic_only FROM diff"
)
def refresh_summary(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return refresh.summary(refresh.changes(old, new, ("title", "year", "abstract", "keywords")))


@query(DIFF + " SELECT id, NOT t AND (abstract IS NULL OR NOT a OR NOT starts_with(abstract, '. ')) AS format_only FROM diff JOIN papers USING (id)")
def format_only_changes(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return refresh.format_only(old, new)


@query(
    """SELECT id, unnest(CASE WHEN id % 7 = 0 THEN ['missing'] ELSE [x for x in [CASE WHEN id % 5 = 0 AND coalesce(title, '') <> 'x' THEN 'title' END, CASE WHEN id % 3 = 0 AND year IS NOT NULL THEN 'year' END] if x IS NOT NULL] END) AS field FROM papers"""
)
def evidence_disagreements(spark: SparkSession, d: str) -> DataFrame:
    a = lib.papers(spark, d).select("id", "title", "year")
    b = a.where("id % 7 > 0").withColumn("title", F.when(F.col("id") % 5 == 0, F.lit("x")).otherwise(F.col("title")))
    c = a.withColumn("year", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("year")))
    return refresh.disagreements(a, b, c, ("title", "year"))


@query(
    """, c AS (SELECT id, id % 2 = 0 AS target, CASE WHEN id % 3 = 0 THEN 'A' WHEN id % 3 = 1 THEN 'B' END AS verdict FROM papers)
    SELECT id, CASE WHEN target AND verdict IS NULL THEN 'no decision' WHEN NOT target AND verdict IS NOT NULL THEN 'not a candidate' WHEN target AND verdict = 'B' AND id % 4 > 0 THEN 'changes content' END AS error FROM c
    WHERE (target AND verdict IS NULL) OR (NOT target AND verdict IS NOT NULL) OR (target AND verdict = 'B' AND id % 4 > 0)"""
)
def audit_check(spark: SparkSession, d: str) -> DataFrame:
    papers = lib.papers(spark, d).select("id")
    i = F.col("id")
    decisions = papers.select("id", F.when(i % 3 == 0, "A").when(i % 3 == 1, "B").alias("verdict")).where("verdict IS NOT NULL")
    return refresh.audit_errors(papers.where("id % 2 = 0"), decisions, papers.select("id", (i % 4 == 0).alias("format_only")))


@query(
    """, index AS (SELECT id, file_hash FROM papers WHERE id <> 7), n AS (SELECT file_hash, count(*) AS n FROM index GROUP BY 1)
    SELECT CAST(i AS VARCHAR) AS what, 'id missing' AS error FROM range(1, 901) t(i) WHERE i NOT IN (SELECT id FROM index) UNION ALL SELECT CAST(id AS VARCHAR), 'id unexpected' FROM index WHERE id NOT BETWEEN 1 AND 900
    UNION ALL SELECT file_hash, 'hash twice' FROM n WHERE n > 1"""
)
def frozen_index_check(spark: SparkSession, d: str) -> DataFrame:
    """All papers but one, against a set that should hold ids 1 to 900."""
    return refresh.index_errors(lib.papers(spark, d).where("id <> 7").select("id", "file_hash"), 1, 900)


# --- further mutations, lookups, forms ---

INCOMING = """, incoming AS (SELECT *, row_number() OVER (ORDER BY file_hash) + 999 AS new_id FROM (SELECT DISTINCT file_hash, id % 3 AS kind FROM papers p WHERE id % 2 = 1 AND file_hash NOT IN (SELECT file_hash FROM papers WHERE id % 2 = 0)
  AND id = (SELECT min(id) FROM papers q WHERE q.file_hash = p.file_hash)))"""


def _added(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    papers = lib.papers(spark, d).select("id", "file_hash")
    stored = papers.where("id % 2 = 0")
    first = papers.groupBy("file_hash").agg(F.min("id").alias("id"))
    new = first.where("id % 2 = 1").join(stored.select("file_hash"), "file_hash", "left_anti")
    kind = F.col("id") % 3
    reasons = F.when(kind == 1, F.array(F.lit("no title"))).otherwise(F.array().cast("array<string>"))
    made = F.array(F.struct(F.lit("tags").alias("field"), F.lit("OAuth").alias("label")), F.struct(F.lit("research_methods").alias("field"), F.lit("survey").alias("label")))
    incoming = new.select("file_hash", reasons.alias("reasons"), made.alias("labels"), F.when(kind == 2, F.lit("{}")).alias("result_json"))
    return state.add_papers(incoming, stored, 1000)


@query(INCOMING + " SELECT new_id AS id, file_hash, CASE kind WHEN 2 THEN 'classified' WHEN 1 THEN 'needs_review' ELSE 'pending' END AS classification_status FROM incoming")
def added_papers(spark: SparkSession, d: str) -> DataFrame:
    return _added(spark, d)["papers"]


@query(INCOMING + " SELECT new_id AS paper_id, unnest(['tags', 'research_methods']) AS field, 'ai' AS value_source, unnest(['OAuth', 'survey']) AS label FROM incoming WHERE kind = 2")
def added_labels(spark: SparkSession, d: str) -> DataFrame:
    return _added(spark, d)["labels"]


@query(INCOMING + " SELECT new_id AS paper_id, 'classified' AS status, '{}' AS result_json FROM incoming WHERE kind = 2")
def added_runs(spark: SparkSession, d: str) -> DataFrame:
    return _added(spark, d)["runs"]


@query(
    """SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN NULL ELSE 'second' END ELSE title END AS title,
    CASE WHEN id % 3 = 0 THEN 'needs_review' ELSE classification_status END AS classification_status, CASE WHEN id % 3 = 0 THEN 'held' END AS classification_error FROM papers"""
)
def metadata_update(spark: SparkSession, d: str) -> DataFrame:
    """Of two updates the second holds, a null title included."""
    papers = lib.papers(spark, d).select("id", "title", "classification_status", F.lit(None).cast("string").alias("classification_error"))
    some = papers.where("id % 3 = 0")
    one = some.select("id", F.lit(1).alias("seq"), F.lit("first").alias("title"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"))
    two = some.select("id", F.lit(2).alias("seq"), F.when(F.col("id") % 2 == 1, "second").alias("title"), F.lit("needs_review").alias("status"), F.lit("held").alias("error"))
    return state.update_metadata(papers, one.unionByName(two), ["title"])


@query(
    """, w AS (SELECT doc_id AS id, [x for x in string_split(text, ' ') if length(x) = 5] AS keywords FROM documents)
    SELECT id, CASE WHEN len(keywords) = 0 THEN '[]' ELSE CAST(to_json(keywords) AS VARCHAR) END AS stored, CAST(len(keywords) AS INTEGER) AS parsed, array_to_string(keywords, ' ') AS keywords FROM w"""
)
def stored_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Lists as JSON text and back."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.filter(F.split("text", " "), lambda w: F.length(w) == 5).alias("keywords"))
    stored = state.metadata_values(rows, ("keywords",)).withColumn("stored", F.col("keywords"))
    return state.row_metadata(stored, ("keywords",)).select("id", "stored", F.size("keywords").alias("parsed"), F.array_join("keywords", " ").alias("keywords"))


@query("""SELECT paper_id, field, value_source, label FROM paper_labels WHERE NOT (paper_id % 4 = 0 AND value_source = 'current' AND (field = 'tags' OR field = 'research_methods' AND paper_id % 8 = 0))
    UNION ALL SELECT id, 'tags', 'current', unnest(['Web', 'OAuth']) FROM papers WHERE id % 4 = 0 UNION ALL SELECT id, 'research_methods', 'current', 'survey' FROM papers WHERE id % 8 = 0""")
def reviewed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Tags are always replaced, methods only where the review gives them; spellings that agree but for case are one label."""
    reviews = lib.papers(spark, d).where("id % 4 = 0").select(
        F.col("id").alias("paper_id"), F.array(F.lit(" Web "), F.lit("OAuth"), F.lit("web"), F.lit(" ")).alias("tags"), F.when(F.col("id") % 8 == 0, F.array(F.lit("survey"))).alias("research_methods"),
        F.lit(None).cast("array<string>").alias("target_vulnerabilities"),
    )
    return state.review_labels(lib.labels(spark, d), reviews)


@query("SELECT paper_id, field, value_source, label FROM paper_labels l JOIN papers p ON p.id = l.paper_id WHERE value_source = 'ai' OR manually_reviewed")
def migrated_labels(spark: SparkSession, d: str) -> DataFrame:
    return state.current_labels(lib.labels(spark, d), lib.papers(spark, d))


@query("SELECT id, name, name_key FROM folders UNION ALL SELECT 100 + row_number() OVER (ORDER BY r_name), 'Region ' || r_name, lower('Region ' || r_name) FROM region")
def folder_creation(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "region").select(F.concat(F.lit("  Region "), "r_name", F.lit(" ")).alias("name"))
    return state.create_folders(lib.folders(spark, d), names, 101)


@query("SELECT id, CASE WHEN id = 3 THEN 'Sessions' ELSE name END AS name, CASE WHEN id = 3 THEN 'sessions' ELSE name_key END AS name_key FROM folders")
def folder_renaming(spark: SparkSession, d: str) -> DataFrame:
    return state.rename_folder(lib.folders(spark, d), 3, " Sessions ")


@query("SELECT id AS paper_id, coalesce(is_favorite, false) AS is_favorite, coalesce(read_later, false) AS read_later FROM papers LEFT JOIN user_state ON paper_id = id")
def paper_flags(spark: SparkSession, d: str) -> DataFrame:
    return search.flags_of(lib.papers(spark, d), lib.user_state(spark, d))


@query("SELECT id, filename, year FROM papers WHERE id = 11")
def lookup_by_id(spark: SparkSession, d: str) -> DataFrame:
    return search.by_id(lib.papers(spark, d), 11).select("id", "filename", "year")


@query("SELECT id, year FROM papers")
def filter_whole_range(spark: SparkSession, d: str) -> DataFrame:
    """The whole known range chosen by a reader is no bound, so papers of unknown year stay."""
    low, high = search.bounded_years((1990, 2024), (1990, 2024))
    return search.search(lib.papers(spark, d), lib.labels(spark, d), year_min=low, year_max=high, ordered=False).select("id", "year")


@query("SELECT doc_id, array_to_string([y for y in [trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) for x in string_split(text, ',')] if y <> ''], '|') AS labels FROM documents", library=False)
def typed_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(tx.labels_typed(F.col("text")), "|").alias("labels"))


# --- rules that SQL cannot express: extraction and the scan ---


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    front = F.concat(F.lit("Abstract\n"), "text")
    document = F.struct(
        front.alias("text"), front.alias("first_page_text"), F.create_map(F.lit("title"), F.substring("text", 1, 60)).alias("metadata"), F.lit(1).alias("page_count"),
        F.array().cast(T.ArrayType(BLOCK)).alias("first_page_blocks"), F.lit(None).cast(SIZE).alias("first_page_size"), F.array().cast(T.ArrayType(PAGE)).alias("page_layouts"),
    )
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.sha2("text", 256).alias("file_hash"), document.alias("parsed")).withColumn("filepath", F.col("filename"))


@query()
def extracted_metadata(spark: SparkSession, d: str) -> DataFrame:
    out = extraction.extracted(_parsed(spark, d))
    return out.select("id", "metadata.title", "metadata.abstract", "metadata.year", F.array_join("metadata.review_reasons", "; ").alias("review_reasons"), "failure")


GATE = f"""
, clean AS (SELECT id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS t, abstract AS a FROM papers),
judged AS (SELECT id, length(t) < 8 OR regexp_matches(lower(t), '^(?:reprinted from|regular paper|abstractproxy)|^(?:abstract|keywords?|key words?|index terms?)\\b|received:|accepted:|^(?:unknown|untitled|paper|usenix association|the usenix association)$|^proceedings\\s+of\\b')
    OR regexp_matches(lower(t), '^arxiv\\s*:\\s*(?:\\d{{4}}\\.\\d{{4,5}}|[a-z-]+/\\d{{7}})(?:v\\d+)?(?:\\s|$)')
    OR regexp_matches(lower(t), '^(?:main|paper|manuscript|submission|draft|document|untitled|output)(?:[-_](?:[a-z]+\\d+|\\d+|final|draft|camera[-_]?ready|rev\\d*|copy))+(?:\\.(?:pdf|tex|dvi))?$|^(?:main|manuscript|submission|document|output)\\.(?:pdf|tex|dvi)$')
    OR length(t) < 28 AND regexp_matches(t, '^[^\\p{{L}}]+$') AS no_title,
  NOT (coalesce(length(a), 0) > 0 AND length(trim(a)) >= 80 AND NOT regexp_matches(lower(a), 'abstractproxy|httpxproxy|(?:\\bactivate\\s*\\(\\)\\s*close\\s*\\(\\)\\s*proxy\\b(?s:.*)){{2}}')) AS no_text FROM clean)
SELECT id, concat_ws('; ', CASE WHEN no_title THEN '{ingest.NO_TITLE}' END, CASE WHEN no_text THEN '{ingest.NO_TEXT}' END) AS issues FROM judged
"""


@query(GATE)
def input_gate(spark: SparkSession, d: str) -> DataFrame:
    issues = ingest.input_issues(F.col("title"), F.col("abstract"), F.lit(None).cast("string"))
    return lib.papers(spark, d).select("id", F.array_join(issues, "; ").alias("issues"))


@query()
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    stored = lib.papers(spark, d).where("id % 3 = 0").groupBy("file_hash").agg(F.min("id").alias("id"), F.min_by("classification_status", "id").alias("classification_status"))
    out = ingest.plan(_parsed(spark, d).drop("id"), stored, extraction.extracted, ingest.RuleClassifier())
    return out.select("filename", "status", "message", "paper_id", "classification.primary_category")
