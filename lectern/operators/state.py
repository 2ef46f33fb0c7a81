"""State as append-only logs and their projections: what an update-in-place store would hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import ascii_lower, collapse, distinct_by, folder_key, full_casefold, strip, valid_folder_name
from lectern.model import CATEGORIES, LABEL_FIELDS, RELEVANCES, RETRIED


def latest(log: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last values by ``order``: one aggregation with map-side combine, no sort."""
    last = F.max_by(F.struct(*columns), F.col(order)).alias("r")
    return log.groupBy(key).agg(last).select(key, "r.*")


def latest_given(log: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """For each column on its own the last value that is not null: what COALESCE(new, old) leaves."""
    return log.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def classification_projection(attempts: DataFrame) -> DataFrame:
    """State of each paper from its attempts: status and error of the last, machine values and provenance of the last success, the last known duration."""
    success = F.col("status") == "classified"
    at = F.when(success, F.col("id"))
    return attempts.groupBy("paper_id").agg(
        F.max_by("status", "id").alias("classification_status"),
        F.max_by("error", "id").alias("classification_error"),
        F.max_by("result_json", at).alias("result_json"),
        F.max_by("provider", at).alias("classification_provider"),
        F.max_by("model", at).alias("classification_model"),
        F.max_by("processing_seconds", F.when(F.col("processing_seconds").isNotNull(), F.col("id"))).alias("processing_seconds"),
        F.count_if(success).alias("successes"),
        F.count(F.lit(1)).alias("attempts"),
    )


def folded(attempts: DataFrame) -> DataFrame:
    """The mergeable state behind :func:`classification_projection`: for each paper the last attempt, success and duration with their ids, and counts."""
    success = F.col("status") == "classified"
    last = lambda names, given=None: F.max(F.when(F.lit(True) if given is None else given, F.struct("id", *names)))
    return attempts.groupBy("paper_id").agg(
        last(["status", "error"]).alias("attempt"), last(["result_json", "provider", "model"], success).alias("success"), last(["processing_seconds"], F.col("processing_seconds").isNotNull()).alias("duration"),
        F.count_if(success).alias("successes"), F.count(F.lit(1)).alias("attempts"),
    )


def merged(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """The state of a log from those of two parts of it, in any order: later ids win. Only the new part of the log is read."""
    both = stored.unionByName(delta)
    return both.groupBy("paper_id").agg(*[F.max(c).alias(c) for c in ("attempt", "success", "duration")], *[F.sum(c).alias(c) for c in ("successes", "attempts")])


def projected(states: DataFrame) -> DataFrame:
    """:func:`classification_projection` from its folded state."""
    return states.select(
        "paper_id", F.col("attempt.status").alias("classification_status"), F.col("attempt.error").alias("classification_error"), "success.result_json", F.col("success.provider").alias("classification_provider"),
        F.col("success.model").alias("classification_model"), "duration.processing_seconds", "successes", "attempts",
    )


def run_log(attempts: DataFrame) -> DataFrame:
    """Only successes and failures enter the run history."""
    return attempts.where(F.col("status").isin("classified", "failed"))


def new_papers(incoming: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to insert, one per hash, and those whose hash is there already."""
    known = papers.select("file_hash")
    order = Window.partitionBy("file_hash").orderBy("filepath")
    fresh = incoming.join(known, "file_hash", "left_anti").withColumn("__nth", F.row_number().over(order))
    return fresh.where("__nth = 1").drop("__nth"), incoming.join(known, "file_hash", "left_semi").unionByName(fresh.where("__nth > 1").drop("__nth"))


def default_status(has_classification: Column, reasons: Column) -> Column:
    return F.when(has_classification, "classified").when(F.size(reasons) > 0, "needs_review").otherwise("pending")


def add_papers(incoming: DataFrame, papers: DataFrame, first_id: int) -> dict[str, DataFrame]:
    """The rows that new papers add to ``papers``, ``labels`` and ``runs``, to be committed as one version.

    ``incoming`` has a paper's columns but its id, ``reasons`` and, where it is classified already, ``labels`` (an array of ``field,
    label``) and ``result_json``. A hash that is stored already, or comes twice, is an error. Ids follow ``first_id`` in order of the hash;
    a paper is classified, held for review if it has reasons, or pending; only a classified one has labels and a run.
    """
    known = papers.select("file_hash", F.lit(True).alias("__known")).distinct()
    copies = incoming.groupBy("file_hash").agg(F.count(F.lit(1)).alias("__copies"))
    checked = incoming.join(known, "file_hash", "left").join(copies, "file_hash")
    again = F.col("__known").isNotNull() | (F.col("__copies") > 1)
    hashed = checked.withColumn("file_hash", F.when(again, F.raise_error(F.lit("a paper with this hash exists")).cast("string")).otherwise(F.col("file_hash")))
    done = F.col("result_json").isNotNull()
    rows = numbered(hashed, F.col("file_hash"), first_id).withColumn("classification_status", default_status(done, F.col("reasons")))
    kept = [c for c in incoming.columns if c not in ("reasons", "labels", "result_json")]
    classified = rows.where(done)
    labels = classified.select(F.col("id").alias("paper_id"), F.explode("labels").alias("l")).select("paper_id", "l.field", F.lit("ai").alias("value_source"), "l.label")
    return {
        "papers": rows.select("id", *kept, "classification_status"), "labels": labels,
        "runs": classified.select(F.col("id").alias("paper_id"), F.lit("classified").alias("status"), "result_json"),
    }


def update_metadata(papers: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Papers with ``columns``, status and error from the last of their ``updates`` (``id, seq, status, error``, columns), nulls included; other rows as they are.

    An update of a paper that is not there is an error.
    """
    fields = [*columns, "classification_status", "classification_error"]
    new = updates.groupBy("id").agg(F.max_by(F.struct(*columns, F.col("status").alias("classification_status"), F.col("error").alias("classification_error")), "seq").alias("__new"))
    joined = papers.withColumn("__known", F.lit(True)).join(new, "id", "full")
    known = F.when(F.col("__known"), F.col("id")).otherwise(F.raise_error(F.lit("no paper has this id")).cast("long"))
    return joined.withColumn("id", known).withColumns({c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in fields if c in papers.columns}).select(*papers.columns)


def metadata_values(rows: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """Metadata as it is stored: lists and maps as JSON text, in the order given."""
    return rows.withColumns({c: F.to_json(F.coalesce(c, F.array().cast("array<string>"))) for c in lists})


def row_metadata(rows: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """Stored metadata with its JSON text parsed; a missing list is empty."""
    return rows.withColumns({c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in lists})


def guarded_update(papers: DataFrame, update: DataFrame, columns: list[str]) -> DataFrame:
    """Papers with ``columns`` from ``update`` where id and hash both agree; other rows as they are."""
    new = update.select("id", "file_hash", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    joined = papers.join(new, ["id", "file_hash"], "left")
    return joined.withColumns({c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*papers.columns)


def label_dictionary(arrivals: DataFrame) -> DataFrame:
    """Canonical spelling of each label: the first ever seen of those that agree but for ASCII case. Collapsed, at most 120 characters."""
    clean = F.substring(collapse(F.col("label")), 1, 120)
    rows = arrivals.withColumn("label", clean).where("label <> ''")
    return rows.groupBy("field", ascii_lower(F.col("label")).alias("label_key")).agg(F.min_by("label", F.struct("arrival", "label")).alias("name"))


def numbered(rows: DataFrame, by: Column, first: Column | int) -> DataFrame:
    """``rows`` with a gapless ``id`` from ``first`` in the order of ``by``, a hex hash: where the hashes with one beginning start, and the place among those, so no task sorts all rows."""
    keyed = rows.withColumn("__by", by).withColumn("__begin", F.left(F.col("__by"), F.lit(3)))
    sizes = keyed.groupBy("__begin").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__begin", F.coalesce(F.sum("__n").over(Window.orderBy("__begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__begin").orderBy("__by"))
    first = F.lit(first) if isinstance(first, int) else first
    return keyed.join(starts, "__begin").withColumn("id", (first + F.col("__start") + own - 1).cast("long")).drop("__by", "__begin", "__start")


def extended_dictionary(dictionary: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The dictionary ``(id, field, label_key, name)`` after a commit of ``arrivals`` (``field, label, arrival``): its entries as they are, then new ones.

    The first spelling ever seen stays the name, and an entry that no paper uses any more stays too, so an id means one label for ever. New ids follow the highest.
    """
    known = dictionary.select("field", "label_key")
    new = label_dictionary(arrivals).join(known, ["field", "label_key"], "left_anti")
    top = dictionary.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    rows = numbered(new, F.sha2(F.concat_ws("|", "field", "label_key"), 256), 1)
    return dictionary.unionByName(rows.withColumn("id", F.col("id") + top).select(*dictionary.columns))


def junction_ids(arrivals: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``paper_id, field, value_source, label_id``, each once: label sets by the dictionary's ids."""
    clean = F.substring(collapse(F.col("label")), 1, 120)
    rows = arrivals.withColumn("label_key", ascii_lower(clean)).where("label_key <> ''")
    return rows.join(dictionary.select("field", "label_key", F.col("id").alias("label_id")), ["field", "label_key"]).select("paper_id", "field", "value_source", "label_id").distinct()


def junction(arrivals: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``paper_id, field, value_source, name`` in canonical spelling, each once."""
    clean = F.substring(collapse(F.col("label")), 1, 120)
    rows = arrivals.withColumn("label_key", ascii_lower(clean)).where("label_key <> ''")
    return rows.join(dictionary, ["field", "label_key"]).select("paper_id", "field", "value_source", "name").distinct()


def replace_labels(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """Label sets ``(paper_id, field, value_source)`` that ``changes`` mention are replaced; a null label there empties the set."""
    keys = ["paper_id", "field", "value_source"]
    return labels.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.where("label IS NOT NULL").select(*labels.columns))


def review(papers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Human reviews set the human side and the mark; a missing reason keeps the old, at most 500 characters; confidence stays.

    A value outside its closed set is an error. Of several reviews of a paper the last by ``seq`` holds, if there is such a column, else the largest.
    """
    category, relevance = F.col("primary_category"), F.col("relevance")
    good = (category.isNull() | category.isin(*CATEGORIES)) & (relevance.isNull() | relevance.isin(*RELEVANCES))
    why = F.nullif(F.substring(collapse(F.col("relevance_reason")), 1, 500), F.lit(""))
    checked = reviews.withColumn("primary_category", F.when(good, category).otherwise(F.raise_error(F.lit("a review has a value that is not allowed")).cast("string")))
    one = F.struct("primary_category", "relevance", why.alias("relevance_reason"))
    new = checked.groupBy(F.col("paper_id").alias("id")).agg((F.max_by(one, "seq") if "seq" in reviews.columns else F.max(one)).alias("__new"))
    by_hand = F.col("__new").isNotNull()
    out = papers.join(new, "id", "left").withColumns(
        {
            "primary_category": F.when(by_hand, F.col("__new.primary_category")).otherwise(F.col("primary_category")),
            "relevance": F.when(by_hand, F.col("__new.relevance")).otherwise(F.col("relevance")),
            "relevance_reason": F.coalesce("__new.relevance_reason", "relevance_reason"),
            "manually_reviewed": by_hand | F.col("manually_reviewed"),
        }
    )
    return out.select(*papers.columns)


def review_labels(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Human label sets after ``reviews`` (``paper_id`` and an array a field): tags are always replaced, the other fields only if given."""
    sets = {f: F.coalesce(f, F.array().cast("array<string>")) if f == "tags" else F.col(f) for f in LABEL_FIELDS}
    given = reviews.select("paper_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), a.alias("labels")) for f, a in sets.items()])).alias("s"))
    rows = given.where("s.labels IS NOT NULL").select("paper_id", "s.field", F.lit("current").alias("value_source"), F.explode_outer(distinct_by(F.filter(F.transform("s.labels", lambda v: F.substring(collapse(v), 1, 120)), lambda v: v != ""), full_casefold)).alias("label"))
    return replace_labels(labels, rows)


def create_folders(folders: DataFrame, names: DataFrame, first_id: int) -> DataFrame:
    """``folders`` with the new ``names``: stripped, at most 100 characters, and none whose key there is already or comes twice."""
    wanted = names.select(strip(F.col("name")).alias("name"))
    keyed = wanted.withColumn("name_key", folder_key("name"))
    return folders.unionByName(_unique_folders(keyed, folders).withColumn("id", F.lit(first_id - 1).cast("long") + F.row_number().over(Window.orderBy("name_key"))).select(*folders.columns))


def rename_folder(folders: DataFrame, folder_id: int, name: str) -> DataFrame:
    """``folders`` with one renamed; a key that another folder has is an error, and so is an id that none has."""
    own = F.col("id") == F.lit(folder_id)
    asked = folders.sparkSession.range(1).select(F.lit(folder_id).cast("long").alias("id")).join(folders.select("id", F.lit(True).alias("__there")), "id", "left")
    there = F.when(F.col("__there"), strip(F.lit(name))).otherwise(F.raise_error(F.lit("no folder has this id")).cast("string"))
    renamed = asked.select("id", there.alias("name")).withColumn("name_key", folder_key("name"))
    return folders.where(~own).unionByName(_unique_folders(renamed, folders.where(~own)).select(*folders.columns))


def _unique_folders(rows: DataFrame, others: DataFrame) -> DataFrame:
    known = others.select("name_key", F.lit(True).alias("__known"))
    copies = rows.groupBy("name_key").agg(F.count(F.lit(1)).alias("__copies"))
    joined = rows.join(known, "name_key", "left").join(copies, "name_key")
    good = F.col("__known").isNull() & (F.col("__copies") == 1) & valid_folder_name(F.col("name")).isNotNull()
    return joined.withColumn("name", F.when(good, F.col("name")).otherwise(F.raise_error(F.lit("a folder name must be new and of 1 to 100 characters, none a control character")).cast("string"))).drop("__known", "__copies")


def current_labels(labels: DataFrame, papers: DataFrame) -> DataFrame:
    """Labels after a migration: human ones of papers that no one reviewed are dropped."""
    unreviewed = papers.where(~F.coalesce("manually_reviewed", F.lit(False))).select(F.col("id").alias("paper_id"), F.lit("current").alias("value_source"))
    return labels.join(unreviewed, ["paper_id", "value_source"], "left_anti").select(*labels.columns)


def upsert_flags(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Only the flags given change; ``changed`` tells rows that differ from before, so an equal write appends nothing."""
    new = latest_given(changes, "paper_id", "seq", "is_favorite", "read_later").withColumnsRenamed({"is_favorite": "__f", "read_later": "__l"})
    joined = state.join(new, "paper_id", "full")
    old = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = joined.select("paper_id", F.coalesce("__f", old("is_favorite")).alias("is_favorite"), F.coalesce("__l", old("read_later")).alias("read_later"), old("is_favorite").alias("__of"), old("read_later").alias("__ol"))
    return out.withColumn("changed", (F.col("is_favorite") != F.col("__of")) | (F.col("read_later") != F.col("__ol"))).drop("__of", "__ol")


def upsert_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """The last note of each paper; an equal one keeps its time. At most 10,000 characters, no NUL."""
    bad = (F.length("content") > 10_000) | F.contains("content", F.lit("\x00"))
    good = changes.withColumn("content", F.when(bad, F.raise_error(F.lit("a note has at most 10000 characters and no NUL")).cast("string")).otherwise(F.col("content")))
    new = latest(good, "paper_id", "seq", "content", "updated_at").withColumnsRenamed({"content": "__c", "updated_at": "__t"})
    joined = notes.join(new, "paper_id", "full")
    same = F.col("__c").isNull() | (F.col("content").isNotNull() & (F.col("__c") == F.col("content")))
    return joined.select("paper_id", F.coalesce("__c", "content").alias("content"), F.when(same, F.col("updated_at")).otherwise(F.col("__t")).alias("updated_at"))


def delete_folder(folders: DataFrame, paper_folders: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders and memberships without the folders listed; papers stay."""
    return folders.join(ids, "id", "left_anti"), paper_folders.join(ids.withColumnRenamed("id", "folder_id"), "folder_id", "left_anti").select(*paper_folders.columns)


def set_membership(paper_folders: DataFrame, wanted: DataFrame, folders: DataFrame) -> DataFrame:
    """Memberships with those of the papers in ``wanted`` replaced; an unknown folder is an error."""
    known = folders.select(F.col("id").alias("folder_id"), F.lit(True).alias("__known"))
    checked = wanted.join(known, "folder_id", "left").withColumn("folder_id", F.when(F.col("__known") | F.col("folder_id").isNull(), F.col("folder_id")).otherwise(F.raise_error(F.lit("unknown folder")).cast("long")))
    return paper_folders.join(wanted.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", "folder_id").unionByName(checked.where("folder_id IS NOT NULL").select("paper_id", "folder_id").distinct())


def migrate(papers: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legacy papers brought up to date, and the runs to add: one for each classified paper that has none."""
    ai = F.col("ai_primary_category").isNotNull()
    pending = F.col("classification_status") == "pending"
    broken = F.col("classification_error").isNotNull() & ~F.coalesce(F.lower("classification_error").like("%not configured%"), F.lit(False))
    status = F.when(pending & ai, "classified").when(pending & broken, "failed").otherwise(F.col("classification_status"))
    unreviewed = {c: F.when(F.col("manually_reviewed"), F.col(c)) for c in ("primary_category", "relevance", "relevance_reason", "relevance_confidence") if c in papers.columns}
    out = papers.withColumns({"classification_status": status, **unreviewed})
    missing = out.where(ai).join(runs.select(F.col("paper_id").alias("id")), "id", "left_anti").select(F.col("id").alias("paper_id"), F.lit("classified").alias("status"))
    return out, missing


def routed(files: DataFrame, papers: DataFrame, reclassify: bool = False) -> DataFrame:
    """What a scan does with each file: insert, retry or skip by the stored state; further copies of a hash are skipped."""
    known = papers.select("file_hash", F.col("id").alias("paper_id"), "classification_status")
    copy = F.row_number().over(Window.partitionBy("file_hash").orderBy("filepath")) > 1
    retry = F.lit(True) if reclassify else F.col("classification_status").isin(*RETRIED)
    route = F.when(copy, "Skipped").when(F.col("paper_id").isNull(), "Insert").when(retry, "Retry").otherwise("Skipped")
    return files.join(known, "file_hash", "left").withColumn("route", route)


def appended_only(old: DataFrame, new: DataFrame, digest: Column) -> DataFrame:
    """Rows of an append-only log that a later version changed or lacks: empty for a true continuation."""
    before = old.select("id", digest.alias("__old"))
    after = new.select("id", digest.alias("__new"))
    return before.join(after, "id", "left").where(~F.col("__old").eqNullSafe(F.col("__new"))).select("id")
