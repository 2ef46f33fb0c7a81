"""A library made from the plain tables: documents as papers, labels as human reviews, events as runs.

The rules below are a stand-in for a scanned library: deterministic, without a language model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType

from lectern.model import BLOCK, CATEGORIES, CLASSIFICATION_STATUSES, STATUSES


#: Lengths of the words that stand for labels of each field, machine and human.
AI_LENGTHS = {"tags": (2, 3), "target_vulnerabilities": (14, 16), "research_methods": (12, 12)}
HUMAN_LENGTHS = {"tags": (3, 3), "research_methods": (13, 13)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    i, n = F.col("doc_id"), F.col("n_chars")
    reviewed = F.col("quality").isNotNull()
    ai = F.when(n % 9 < 8, pick(CATEGORIES, n % 9 % 8))
    return docs.join(labels, "doc_id", "left").select(
        i.alias("id"),
        F.sha2("text", 256).alias("file_hash"),
        F.concat(F.lit("doc_"), i.cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(i % 11 != 0, F.substring("text", 1, 60)).alias("title"),
        F.expr("substring(text, 61)").alias("abstract"),
        F.when(i % 7 != 0, 1990 + i % 35).cast("int").alias("year"),
        ai.alias("ai_primary_category"),
        F.when(F.col("quality") == 1, pick(CATEGORIES, i % 8)).alias("primary_category"),
        F.when(n % 9 < 8, pick(("A", "B", "C"), n % 3)).alias("ai_relevance"),
        F.when(reviewed, F.when(F.col("toxic") == 1, "C").otherwise("A")).alias("relevance"),
        ((n % 100) / 100.0).alias("ai_relevance_confidence"),
        F.lit(None).cast("double").alias("relevance_confidence"),
        pick(STATUSES, i % 4).alias("status"),
        reviewed.alias("manually_reviewed"),
        pick(CLASSIFICATION_STATUSES, n % 4).alias("classification_status"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the whole text, by their length: machine labels of every document, human ones of those reviewed."""
    docs, reviews = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")

    def rows(source: str, lengths: dict[str, tuple[int, int]]) -> Column:
        sets = [F.struct(F.lit(f).alias("field"), F.lit(source).alias("value_source"), F.filter("words", lambda w: F.length(w).between(*between)).alias("words")) for f, between in lengths.items()]
        return F.explode(F.array(*sets)).alias("r")

    words = docs.select(F.col("doc_id").alias("paper_id"), F.array_distinct(F.split("text", " ")).alias("words"))
    ai = words.select("paper_id", rows("ai", AI_LENGTHS))
    human = words.join(reviews.select(F.col("doc_id").alias("paper_id")), "paper_id").select("paper_id", rows("current", HUMAN_LENGTHS))
    return ai.unionByName(human).select("paper_id", "r.field", "r.value_source", F.explode("r.words").alias("label"))


def user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").where(i % 3 == 0).select(i.alias("paper_id"), (i % 5 == 0).alias("is_favorite"), (i % 6 == 0).alias("read_later"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("name_key"))


def paper_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").where((i % 2 == 0) & (i % 40 < 20)).select(i.alias("paper_id"), (i % 40 + 1).alias("folder_id"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").where(i % 10 == 0).select(i.alias("paper_id"), F.concat(F.lit("note "), i.cast("string")).alias("content"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    good = F.col("event_type") != "error"
    category = pick(CATEGORIES, e % 8)
    return read(spark, sf_dir, "events").select(
        e.alias("id"), F.col("user_id").alias("paper_id"),
        F.when(e % 5 == 0, F.lit(None)).when(e % 2 == 0, "local").otherwise("remote").alias("provider"),
        F.concat(F.lit("model-"), (e % 2).cast("string")).alias("model"),
        F.when(good, "classified").otherwise("failed").alias("status"),
        F.when(good, F.concat(F.lit('{"primary_category":"'), category, F.lit('"}'))).alias("result_json"),
        F.when(~good, "failed").alias("error"), F.col("value").alias("processing_seconds"),
    )


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, text, properties, blocks``: each document's whole text below a line that dates it, by id, and by id a property that does."""
    docs = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    year = (1990 + i % 35).cast("string")
    n = (i % 30 + 1).cast("string")
    heads = (
        F.concat(F.lit("Journal of Web Security, Vol. "), n, F.lit(", "), year), F.concat(F.lit("© "), year, F.lit(" The Authors")), F.concat(F.lit("Received: 2 May 1989; Published: 3 June "), year),
        F.concat(F.lit("Proceedings of the "), n, F.lit("th USENIX Security Symposium\nAugust 12, "), year), F.concat(F.lit("Paper published at Workshop on Web Security "), year, F.lit(".")), F.concat(F.lit("Copyright "), year, F.lit("\n(c) 1989 Others")),
        F.concat(F.lit("arXiv of "), year), F.concat(F.lit("International Conference on Web Safety "), year), F.concat(F.lit("Published "), year), F.concat(F.lit("NDSS "), year),
    )
    head = F.element_at(F.array(*heads), (i % 10 + 1).cast("int"))
    stated = F.when(i % 4 == 0, F.concat((1991 + i % 35).cast("string"), F.lit("-0"), (i % 11).cast("string")))
    properties = F.when(stated.isNotNull(), F.create_map(F.lit("publicationdate"), stated)).otherwise(F.create_map().cast("map<string,string>"))
    return docs.select(i.alias("key"), F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"), properties.alias("properties"), F.array().cast(ArrayType(BLOCK)).alias("blocks"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in columns, from the lines of an order: ``key, at, y0, y1, x0, x1, n``, several to a page."""
    lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").withColumn("at", F.row_number().over(lines))
    y0 = (F.col("l_partkey") % 700).cast("double")
    x0 = (F.col("l_suppkey") % 3 * 180).cast("double")
    return rows.select(F.col("l_orderkey").alias("key"), "at", y0.alias("y0"), (y0 + F.col("l_quantity") * 3).alias("y1"), x0.alias("x0"), (x0 + 170 + F.col("l_quantity")).alias("x1"), F.col("l_extendedprice").alias("n"))


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, page, blocks, height``: each document's lines as blocks down a page, their sizes by their lengths; some are set upright."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def block(line: Column, k: Column) -> Column:
        size = (12 + F.length(line) % 7).cast("double")
        y0 = (20 * k).cast("double")
        upright = (F.length(line) % 11 == 0).cast("double")
        box = [F.lit(60.0).alias("x0"), y0.alias("y0"), (F.lit(60.0) + F.length(line) * 5).cast("double").alias("x1"), (y0 + size).alias("y1"), size.alias("font_size")]
        return F.struct(line.alias("text"), *box, F.struct((1.0 - upright).alias("dx"), upright.alias("dy")).alias("direction"), F.array().cast(BLOCK["lines"].dataType).alias("lines"))

    return docs.select("key", F.lit(1).alias("page"), F.transform(F.split("text", "\n"), block).alias("blocks"), F.lit(800.0).alias("height"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` and a classifier's raw ``answer`` for each document, made of its whole text; by id some have a text for a number, a null, a further or a missing field, are cut off, or an array."""
    docs = read(spark, sf_dir, "documents")
    i, words = F.col("doc_id"), F.array_distinct(F.split("text", " "))
    quoted = lambda text: F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)
    of = lambda n: F.filter("words", lambda w: F.length(w) == n)
    share = (F.col("n_chars") % 120 / 100).cast("string")
    fields = {
        "primary_category": quoted(pick((*CATEGORIES, "Unknown"), i % 9)), "tags": F.when(i % 8 == 1, "null").otherwise(F.to_json(of(11))), "research_methods": F.to_json(of(13)),
        "target_vulnerabilities": F.to_json(of(15)), "relevance": F.when(i % 8 != 3, quoted(pick(("A", "B", "C", "D"), F.floor(i / 8) % 4))), "relevance_reason": quoted(F.array_join(of(9), " ")),
        "relevance_confidence": F.when(i % 8 == 0, quoted(share)).otherwise(share), "note": F.when(i % 8 == 2, "1"),
    }
    parts = F.array_compact(F.array(*[F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]))
    whole = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    answer = F.when(i % 8 == 4, F.left(whole, F.length(whole) - 1)).when(i % 8 == 5, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    return docs.select("doc_id", "n_chars", words.alias("words")).select(i.alias("id"), answer.alias("answer"))


_CATEGORIES = ", ".join(f"'{c}'" for c in CATEGORIES)
_STATUSES = ", ".join(f"'{c}'" for c in STATUSES)
_CLASSIFICATION = ", ".join(f"'{c}'" for c in CLASSIFICATION_STATUSES)

#: The same library as DuckDB SQL, to go before a query.
SQL = f"""
WITH papers AS (
  SELECT d.doc_id AS id, sha256(text) AS file_hash, 'doc_' || d.doc_id || '.pdf' AS filename,
    CASE WHEN d.doc_id % 11 <> 0 THEN substr(text, 1, 60) END AS title, substr(text, 61) AS abstract,
    CASE WHEN d.doc_id % 7 <> 0 THEN CAST(1990 + d.doc_id % 35 AS INTEGER) END AS year,
    CASE WHEN n_chars % 9 < 8 THEN [{_CATEGORIES}][n_chars % 9 % 8 + 1] END AS ai_primary_category,
    CASE WHEN quality = 1 THEN [{_CATEGORIES}][d.doc_id % 8 + 1] END AS primary_category,
    CASE WHEN n_chars % 9 < 8 THEN ['A', 'B', 'C'][n_chars % 3 + 1] END AS ai_relevance,
    CASE WHEN quality IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'C' ELSE 'A' END END AS relevance,
    (n_chars % 100) / 100.0::DOUBLE AS ai_relevance_confidence, CAST(NULL AS DOUBLE) AS relevance_confidence,
    [{_STATUSES}][d.doc_id % 4 + 1] AS status, quality IS NOT NULL AS manually_reviewed,
    [{_CLASSIFICATION}][n_chars % 4 + 1] AS classification_status
  FROM documents d LEFT JOIN labels USING (doc_id)
), words AS (
  SELECT doc_id AS paper_id, list_distinct(string_split(text, ' ')) AS words FROM documents
), paper_labels AS (
  SELECT paper_id, 'tags' AS field, 'ai' AS value_source, unnest(list_filter(words, lambda w: length(w) BETWEEN 2 AND 3)) AS label FROM words
  UNION ALL SELECT paper_id, 'target_vulnerabilities', 'ai', unnest(list_filter(words, lambda w: length(w) BETWEEN 14 AND 16)) FROM words
  UNION ALL SELECT paper_id, 'research_methods', 'ai', unnest(list_filter(words, lambda w: length(w) = 12)) FROM words
  UNION ALL SELECT paper_id, 'tags', 'current', unnest(list_filter(words, lambda w: length(w) = 3)) FROM words WHERE paper_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT paper_id, 'research_methods', 'current', unnest(list_filter(words, lambda w: length(w) = 13)) FROM words WHERE paper_id IN (SELECT doc_id FROM labels)
), effective AS (
  SELECT *, CASE WHEN manually_reviewed THEN primary_category ELSE ai_primary_category END AS effective_primary_category,
    CASE WHEN manually_reviewed THEN relevance ELSE ai_relevance END AS effective_relevance,
    CASE WHEN manually_reviewed THEN relevance_confidence ELSE ai_relevance_confidence END AS effective_relevance_confidence FROM papers
), effective_labels AS (
  SELECT l.paper_id, l.field, l.label FROM paper_labels l JOIN papers p ON p.id = l.paper_id AND l.value_source = CASE WHEN manually_reviewed THEN 'current' ELSE 'ai' END
), user_state AS (
  SELECT doc_id AS paper_id, doc_id % 5 = 0 AS is_favorite, doc_id % 6 = 0 AS read_later FROM documents WHERE doc_id % 3 = 0
), folders AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, lower(n_name) AS name_key FROM nation
), paper_folders AS (
  SELECT doc_id AS paper_id, doc_id % 40 + 1 AS folder_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 40 < 20
), notes AS (
  SELECT doc_id AS paper_id, 'note ' || doc_id AS content FROM documents WHERE doc_id % 10 = 0
), runs AS (
  SELECT event_id AS id, user_id AS paper_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'local' ELSE 'remote' END AS provider,
    'model-' || (event_id % 2) AS model, CASE WHEN event_type <> 'error' THEN 'classified' ELSE 'failed' END AS status,
    CASE WHEN event_type <> 'error' THEN '{{"primary_category":"' || [{_CATEGORIES}][event_id % 8 + 1] || '"}}' END AS result_json,
    CASE WHEN event_type = 'error' THEN 'failed' END AS error, value AS processing_seconds
  FROM events
)
"""
