"""Bounded samples of labelled rows, and folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled(labels: DataFrame, column: str, modulus: int, held: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (in order) and labels of at most ``most`` labelled rows outside the held-out fold.

    The rows are those with the smallest hash of their id, so a sample is the same on every run. The
    bound is a parameter of the classifiers; it bounds what reaches the driver.
    """
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(modulus) != held))
    rows = rows.groupBy("doc_id").agg(F.max(column).alias("y"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    picked.sort(key=lambda r: r.doc_id)
    return np.array([r.doc_id for r in picked], np.int64), np.array([r.y for r in picked], np.float64)


def rows_of(ids: np.ndarray, doc_ids) -> np.ndarray:
    """Places of a batch's rows whose id is in the sorted ``ids``."""
    at = doc_ids.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
    where = np.searchsorted(ids, at)
    where[where == len(ids)] = 0
    return np.flatnonzero(ids[where] == at) if len(ids) else np.zeros(0, np.int64)
