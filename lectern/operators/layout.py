"""What the setting of a page says: titles, columns below a label, paragraphs of a summary. Blocks are rows; what belongs together is an island between gaps.

A page's rows meet in windows on ``(key, page)``: the gap to the row above is a ``lag``, islands are numbered by a running sum of breaks, and an
island is put together by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean_body, join_cjk, normalize, strip
from lectern.operators.evidence import flat
from lectern.operators.fields import ABSTRACT_LIMIT, BODY_ENDS, COVER_ENDS, FRONT_NOISE, INTRODUCTION, affiliated, heading, mostly_latin, noisy, starts_with, title_or_null

# Fixed values, in points or shares of a page.
TITLE_SIZE, SAME_SIZE, TITLE_REGION, COVER_REGION = 13.0, 2.6, 0.25, 0.5
TITLE_GAP, TITLE_LEADING, TITLE_OVERLAP, COVER_OVERLAP = 25.0, 2.2, 1.0, 0.5
COLUMN_INDENT, COLUMN_SHARE, COLUMN_RIGHT, COLUMN_SLACK = 18.0, 0.1, 25.0, 3.0
PARAGRAPH_GAP, PARAGRAPH_LEADING, LARGER = 32.0, 3.0, 1.5
SUMMARY_LENGTH, SUMMARY_SIZE, SUMMARY_REGION, PAGE_HEIGHT = 180, 12.5, 0.85, 800.0

PAGE = ("key", "page")
PLACE = ("y0", "x0", "at")


def blocks(pages: DataFrame) -> DataFrame:
    """``key, page, at, text, x0, y0, x1, y1, font_size, flat`` and the page's ``height`` and ``full`` height, of pages ``(key, page, blocks, height)``, whose other columns pass through.

    ``height`` is the page's own or the lowest edge on it, ``full`` its own or the usual one.
    """
    own = F.nullif("height", F.lit(0.0))
    lowest = F.array_max(F.transform("blocks", lambda b: b["y1"]))
    others = [c for c in pages.columns if c not in (*PAGE, "blocks", "height")]
    rows = pages.select(*PAGE, *others, F.coalesce(own, lowest, F.lit(PAGE_HEIGHT)).alias("height"), F.coalesce(own, F.lit(PAGE_HEIGHT)).alias("full"), F.posexplode("blocks").alias("at", "b"))
    text = F.coalesce("b.text", F.lit(""))
    return rows.select(*PAGE, "at", text.alias("text"), "b.x0", "b.y0", "b.x1", "b.y1", "b.font_size", F.coalesce(flat(F.col("b")), F.lit(False)).alias("flat"), "height", "full", *others)


def islands(breaks: Column, keys: tuple[str, ...], order: tuple) -> Column:
    """Number of the island of each row, from 0: how many breaks there are up to it."""
    return F.sum(F.when(breaks, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def same_column(x0: Column, x1: Column, other_x0: Column, other_x1: Column) -> Column:
    """Whether a block stands in the column of the first: about its left edge, and not beyond its right one."""
    width = F.greatest(x1 - x0, F.lit(1.0))
    return (F.abs(x0 - other_x0) <= F.greatest(F.lit(COLUMN_INDENT), width * COLUMN_SHARE)) & (other_x1 <= x1 + COLUMN_RIGHT)


def titles(rows: DataFrame, cover: bool = False) -> DataFrame:
    """``key, page, title, bottom``: the largest early line of each page, joined with the lines of its size that follow it.

    Lines join within one leading of the first; on a cover, whose titles are longer, each within one of the last.
    """
    page, order = Window.partitionBy(*PAGE), [F.asc(c) for c in PLACE]
    clean = title_or_null(F.col("text"))
    early = rows.where(F.col("flat") & (F.col("y0") <= F.col("height") * (COVER_REGION if cover else TITLE_REGION)) & (F.col("font_size") >= TITLE_SIZE) & (F.col("x1") - F.col("x0") >= 2 * F.col("font_size")))
    fit = early.withColumn("clean", clean).where(F.col("clean").isNotNull() & ~heading(F.col("text")))
    large = fit.withColumn("largest", F.max("font_size").over(page)).where(F.col("font_size") >= F.col("largest") - SAME_SIZE)
    score = F.struct((4 * F.col("font_size") - 8 * F.col("y0") / F.greatest("height", F.lit(1.0))).alias("score"), *[(-F.col(c)).alias(c) for c in PLACE])
    best = F.max_by(F.struct(*PLACE, "y1", "font_size"), score).over(page)
    placed = large.withColumn("best", best).withColumn("mine", F.struct(*PLACE))
    first = F.col("mine") == F.struct(*[F.col(f"best.{c}") for c in PLACE])
    most = F.greatest(F.lit(TITLE_GAP), F.col("best.font_size") * TITLE_LEADING)
    like = F.abs(F.col("font_size") - F.col("best.font_size")) <= SAME_SIZE
    if cover:
        below = placed.where(first | (F.col("mine") > F.struct(*[F.col(f"best.{c}") for c in PLACE])) & like)
        gap = F.col("y0") - F.lag("y1").over(page.orderBy(*order))
        free = below.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= -F.col("best.font_size") * COVER_OVERLAP))
        picked = free.withColumn("island", islands(F.col("gap") > most, PAGE, tuple(order))).where("island = 0")
        shown = F.btrim(normalize(F.col("text")), F.lit(COVER_ENDS))
    else:
        gap = F.col("y0") - F.col("best.y1")
        picked, shown = placed.where(first | (gap.between(-TITLE_OVERLAP, most) & like)), F.col("clean")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*PLACE, shown.alias("shown")))), lambda x: x["shown"])
    joined = picked.groupBy(*PAGE).agg(F.array_join(F.filter(lines, lambda x: x != ""), " ").alias("joined"), F.max("y1").alias("bottom"))
    return joined.select(*PAGE, title_or_null(join_cjk(F.col("joined"))).alias("title"), "bottom").where("title IS NOT NULL")


def labelled(rows: DataFrame, pattern: str) -> DataFrame:
    """``key, page, place, text``: each block that begins with the label ``pattern``, with the paragraphs of its column below it, up to and with the heading that ends them.

    A label alone in its block may be narrower than its column: the first block below its middle is then the column's measure. A block
    that begins above the lowest edge so far stands beside the column and is left out.
    """
    set_flat = rows.where("flat")
    alone = F.btrim(clean_body(F.regexp_replace("text", pattern, "")), F.lit(BODY_ENDS.replace("：", ""))) == ""
    label = set_flat.where(starts_with(F.col("text"), pattern)).select(*PAGE, F.struct("at", "text", "x0", "y0", "x1", "y1", "font_size", alone.alias("alone")).alias("label"))
    order = [F.asc(c) for c in PLACE]
    w = Window.partitionBy(*PAGE, "of").orderBy(*order)
    item = set_flat.withColumn("stop", heading(F.col("text")) | starts_with(F.col("text"), FRONT_NOISE))
    pairs = label.join(item, list(PAGE)).where((F.col("at") != F.col("label.at")) & (F.col("y0") >= F.col("label.y1") - COLUMN_SLACK)).withColumn("of", F.col("label.at"))
    middle = (F.col("label.x0") + F.col("label.x1")) / 2
    under = middle.between(F.col("x0") - COLUMN_INDENT, F.col("x1") + COLUMN_INDENT)
    box = F.struct("x0", "x1", "font_size", *[c for c in PLACE if c != "x0"])
    measure = F.min_by(F.when(under & ~F.col("stop"), box), F.when(under & ~F.col("stop"), F.struct(*PLACE))).over(Window.partitionBy(*PAGE, "of"))
    measured = pairs.withColumn("measure", F.when(F.col("label.alone"), measure))
    is_measure = F.coalesce(F.struct(*PLACE) == F.struct("measure.y0", "measure.x0", "measure.at"), F.lit(False))
    past = F.coalesce(F.struct(*PLACE) > F.struct("measure.y0", "measure.x0", "measure.at"), F.lit(False))
    anchor = F.when(past, F.struct("measure.x0", "measure.x1", "measure.font_size")).otherwise(F.struct("label.x0", "label.x1", "label.font_size"))
    anchored = measured.withColumn("anchor", anchor)
    in_column = F.when(F.col("label.alone") & ~past, is_measure | (under & F.col("stop"))).otherwise(same_column(F.col("anchor.x0"), F.col("anchor.x1"), F.col("x0"), F.col("x1")))
    centred = ((F.col("x0") + F.col("x1")) / 2).between(F.col("anchor.x0") - COLUMN_INDENT, F.col("anchor.x1") + COLUMN_INDENT)
    ends = F.col("stop") & centred
    column = anchored.withColumn("ends", ends).where(in_column | ends)
    lowest = F.greatest(F.coalesce(F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("label.y1")), F.col("label.y1"))
    free = column.withColumn("lowest", lowest).where(F.col("y0") >= F.col("lowest") - COLUMN_SLACK)
    above = F.coalesce(F.lag(F.struct("y1", "font_size")).over(w), F.struct("label.y1", "label.font_size"))
    spaced = free.withColumn("above", above)
    apart = (F.col("y0") - F.col("above.y1") > F.greatest(F.lit(PARAGRAPH_GAP), F.col("above.font_size") * PARAGRAPH_LEADING)) | (F.col("font_size") > F.col("anchor.font_size") + LARGER)
    broken = spaced.withColumn("breaks", (apart & ~F.col("ends")) | F.coalesce(F.lag("stop").over(w), F.lit(False)))
    kept = broken.withColumn("island", islands(F.col("breaks"), (*PAGE, "of"), tuple(order))).where("island = 0")
    texts = kept.groupBy(*PAGE, "of").agg(F.transform(F.array_sort(F.collect_list(F.struct(*PLACE, "text"))), lambda x: x["text"]).alias("texts"))
    whole = label.withColumn("of", F.col("label.at")).join(texts, [*PAGE, "of"], "left")
    return whole.select(*PAGE, F.struct(*[F.col(f"label.{c}") for c in PLACE]).alias("place"), F.array_join(F.concat(F.array("label.text"), F.coalesce("texts", F.array().cast("array<string>"))), "\n").alias("text"))


def runs(paragraphs: DataFrame, keys: tuple[str, ...], chosen: Column, gap: float = PARAGRAPH_GAP) -> DataFrame:
    """Of the paragraphs in the column of the ``chosen`` one of each ``keys``, those that follow one another without a larger ``gap`` around it."""
    w = Window.partitionBy(*keys)
    rows = paragraphs.withColumn("chosen", chosen)
    box = F.max_by(F.struct("x0", "x1"), F.col("chosen").cast("int")).over(w)
    column = rows.withColumn("box", box).where(F.col("chosen") | same_column(F.col("box.x0"), F.col("box.x1"), F.col("x0"), F.col("x1")))
    order = (F.asc("y0"), F.desc("chosen"), F.asc("x0"), F.asc("at"))
    apart = F.col("y0") - F.lag("y1").over(w.orderBy(*order)) > gap
    numbered = column.withColumn("apart", F.coalesce(apart, F.lit(False))).withColumn("run", islands(F.col("apart"), keys, order))
    return numbered.withColumn("own", F.max(F.when(F.col("chosen"), F.col("run"))).over(w)).where("run = own").drop("box", "apart", "own")


def unlabelled(rows: DataFrame, bottoms: DataFrame) -> DataFrame:
    """``key, page, abstract``: the prose between a title that ends at ``bottom`` and the first heading, where an introduction or an affiliation shows that it is a summary."""
    w = Window.partitionBy(*PAGE)
    text = F.col("text")
    below = F.col("y0") >= F.col("bottom")
    page = rows.where("flat").join(bottoms, list(PAGE)).where("bottom > 0")
    marked = page.withColumns(
        {
            "opens": F.max(starts_with(strip(text), INTRODUCTION) | (below & affiliated(text))).over(w),
            "stop": F.coalesce(F.min(F.when(below & heading(text), F.col("y0"))).over(w), F.col("full") * SUMMARY_REGION),
            "clean": clean_body(text),
        }
    )
    prose = marked.where(F.col("opens") & below & (F.col("y0") < F.col("stop")) & (F.col("font_size") <= SUMMARY_SIZE) & (F.length("clean") >= SUMMARY_LENGTH))
    prose = prose.where(~affiliated(text) & ~heading(text) & ~noisy(text) & ~starts_with(text, FRONT_NOISE) & text.rlike("[.。]"))
    rank = F.struct(mostly_latin(text).alias("latin"), F.length("clean").alias("n"), *[(-F.col(c)).alias(c) for c in PLACE])
    ranked = prose.withColumn("first", F.max_by("at", rank).over(w))
    kept = runs(ranked, PAGE, F.col("at") == F.col("first"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", (~F.col("chosen")).alias("other"), "x0", "at", "text"))), lambda x: x["text"]), "\n")
    whole = kept.groupBy(*PAGE).agg(joined.alias("joined"))
    return whole.select(*PAGE, F.nullif(F.left(clean_body(F.col("joined")), F.lit(ABSTRACT_LIMIT)), F.lit("")).alias("abstract")).where("abstract IS NOT NULL")
