"""Reading order of boxes on a page: recursive cuts along white space, columns and rows competing.

Cuts depend on each other, so a page is one row of arrays in an Arrow kernel; a page's boxes are limited by its capture.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
DEPTH, ROW_GAP, GUTTER, GUTTER_SHARE, TALL = 24, 0.5, 24.0, 0.03, 0.55
OFFSETS = (1, 2, 3, 5, 8, 13, 21, 34)


def bands(lo: np.ndarray, hi: np.ndarray, least: float) -> tuple[list[np.ndarray], float]:
    """Places of the intervals, split at the widest gap in coverage and at those close to it; the gap (0: not split)."""
    order = np.lexsort((hi, lo))
    gaps = lo[order][1:] - np.maximum.accumulate(hi[order])[:-1]
    widest = float(gaps.max(initial=0.0))
    if widest < least:
        return [order], 0.0
    return np.split(order, np.flatnonzero(gaps >= max(0.9 * widest, widest - 4, least)) + 1), widest


class Page:
    """Boxes of one page: left, top, right, bottom, font size, checkpoint and whether they are table cells, in document order."""

    def __init__(self, x, y, w, h, size, checkpoint, cell, width):
        self.x, self.y, self.r, self.b = x, y, x + w, y + h
        self.size, self.checkpoint, self.cell = size, checkpoint, cell
        self.gutter = max(GUTTER, GUTTER_SHARE * width)
        self.ambiguous = 0

    def sorted(self, at: np.ndarray, by_checkpoint: bool = False) -> list[int]:
        """By line, then from left to right; boxes are on a line when their centres are within half a font size."""
        middle = (self.y + self.b) / 2

        def compare(i, j):
            if by_checkpoint and self.checkpoint[i] != self.checkpoint[j]:
                return self.checkpoint[i] - self.checkpoint[j]
            near = abs(middle[i] - middle[j]) <= max(6.0, 0.5 * max(self.size[i], self.size[j]))
            a, b = ((self.x[i], i), (self.x[j], j)) if near else (self.y[i], self.y[j])
            return int(a > b) - int(a < b)

        return sorted(at.tolist(), key=cmp_to_key(compare))

    def columns(self, at: np.ndarray) -> tuple[list[np.ndarray], float]:
        parts, gap = bands(self.x[at], self.r[at], self.gutter)
        return (parts, gap) if sum(len(p) > 1 for p in parts) > 1 else ([], 0.0)

    def by_columns(self, at: np.ndarray, columns: list[np.ndarray], gutter: float, row_gap: float) -> bool:
        """Whether two columns or more run down most of the region, with a gutter no narrower than the gaps of rows."""
        height = self.b[at].max() - self.y[at].min()
        if 2 * self.cell[at].sum() > len(at) or height <= 0:
            return False
        tall = sum(len(c) > 1 and np.ptp(np.concatenate([self.y[at][c], self.b[at][c]])) / height >= TALL for c in columns)
        return tall > 1 and gutter >= row_gap

    def cut(self, at: np.ndarray, depth: int = 0) -> list[int]:
        if len(at) > 1 and depth < DEPTH:
            rows, row_gap = bands(self.y[at], self.b[at], ROW_GAP)
            columns, gutter = self.columns(at)
            side_by_side = len(columns) > 1 and (len(rows) < 2 or self.by_columns(at, columns, gutter, row_gap))
            parts = columns if side_by_side else rows
            if len(parts) > 1:
                return [i for p in parts for i in self.cut(at[p], depth + 1)]
        if len(at) > 3:
            self.ambiguous += len(at)
        return self.sorted(at)

    def order(self) -> tuple[list[int], float, str, float]:
        """Places in reading order, confidence, basis, and how far appearance agrees with the cuts."""
        n = len(self.x)
        every = np.arange(n)
        if n >= 8 and self.checkpoint.max() >= 3 and self.b.max() - self.y.min() < 1500:
            return self.sorted(every, by_checkpoint=True), 0.55, "checkpoint", 1.0
        found = self.cut(every) if n else []
        a, b = np.empty(n, int), np.empty(n, int)
        a[found] = every
        b[np.argsort(self.checkpoint, kind="stable")] = every
        agree = [(a[:-k] < a[k:]) == (b[:-k] < b[k:]) for k in OFFSETS if k < n]
        agreement = float(np.concatenate(agree).mean()) if agree else 1.0
        sure = 1 - 0.5 * self.ambiguous / max(n, 1) - 0.5 * max(0.0, 0.9 - agreement)
        return found, int(max(sure, 0.3) / 0.01 + 0.5) * 0.01, "geometry", int(agreement / 0.01 + 0.5) * 0.01


_NUMBERS = ("x", "y", "w", "h", "size", "checkpoint", "cell")
_OUT = "page_id long, seq int, ord int, confidence double, basis string, agreement double"
_ARROW = pa.schema([("page_id", pa.int64()), ("seq", pa.int32()), ("ord", pa.int32()), ("confidence", pa.float64()), ("basis", pa.string()), ("agreement", pa.float64())])


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page_id, width, boxes in zip(*(batch.column(i).to_pylist() for i in range(3))):
            v = {k: np.array([b[k] for b in boxes], float) for k in _NUMBERS}
            found, sure, basis, agreement = Page(**v, width=width).order()
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([page_id] * n, pa.int64()), pa.array([boxes[i]["seq"] for i in found], pa.int32()), pa.array(range(n), pa.int32()), pa.array([sure] * n), pa.array([basis] * n), pa.array([agreement] * n)], schema=_ARROW)


def reading_order(boxes: DataFrame) -> DataFrame:
    """page_id, seq, ord, confidence, basis, agreement of boxes (page_id, page_width, seq, x, y, w, h, size, checkpoint, type),
    seq being their document order."""
    box = F.struct(F.col("seq").cast("int").alias("seq"), *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in _NUMBERS])
    rows = boxes.withColumn("cell", F.col("type").isin("table", "table_cell").cast("double"))
    pages = rows.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("page_width").cast("double").alias("width"), F.array_sort(F.collect_list(box)).alias("boxes"))
    return pages.select("page_id", F.coalesce("width", F.lit(0.0)).alias("width"), "boxes").mapInArrow(_kernel, _OUT)


def laid_out(frags: DataFrame, width: float = 1280.0) -> DataFrame:
    """Boxes of served fragments: a line each 40 apart, 7 a character, side by side on the line."""
    w = Window.partitionBy("page_id", "line").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    wide = F.length("text") * 7 + 1
    x = F.coalesce(F.sum(wide).over(w), F.lit(0))
    return frags.select("page_id", F.lit(width).alias("page_width"), "seq", x.alias("x"), (F.col("line") * 40).alias("y"), wide.alias("w"), F.lit(32).alias("h"), "size", F.lit(0).alias("checkpoint"), F.col("tag").alias("type"))


def interval_groups(rows: DataFrame, key: str, lo: str, hi: str, least: float) -> DataFrame:
    """rows with `part`, from 0: the same split of one axis, as windows, for keys with any number of rows."""
    every = Window.partitionBy(key)
    w = every.orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__gap", F.greatest(F.coalesce(F.col(lo) - reach, F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("__w", F.max("__gap").over(every))
    cut = (F.col("__w") >= least) & (F.col("__gap") >= F.greatest(F.col("__w") * F.lit(0.9).cast("double"), F.col("__w") - 4, F.lit(float(least))))
    return rows.withColumn("part", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap", "__w")
