"""Text blocks of a page from its lines, as a plan over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block's text, at most.
LIMIT = 6000


def text_blocks(lines: DataFrame, *keys: str) -> DataFrame:
    """One row a block: ``keys, page, block, direction, text, x0, y0, x1, y1, font_size, lines``.

    ``lines`` has ``keys, page, block, line, kind, text, x0, y0, x1, y1, font_size, direction``. Blocks that are not text are left out, one
    with lines in several directions is split by direction, lines without text are dropped; the box spans the lines, the size is their largest.
    """
    kept = lines.where((F.col("kind") == "text") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    line = F.struct("line", "text", "x0", "y0", "x1", "y1", "font_size")
    grouped = kept.groupBy(*keys, "page", "block", "direction").agg(
        F.array_sort(F.collect_list(line)).alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("font_size").alias("font_size"),
    )
    text = F.substring(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), 1, LIMIT)
    return grouped.select(*keys, "page", "block", "direction", text.alias("text"), "x0", "y0", "x1", "y1", "font_size", F.transform("lines", lambda x: x.dropFields("line")).alias("lines"))
