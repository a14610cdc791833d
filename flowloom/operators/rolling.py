"""Medians, deviations and ranks over the last n rows, in blocks of rows that overlap by n - 1.

Rows are numbered by their place in a key, from counts per part of time; a block is a key's rows from one number to another, with the n - 1 rows before them. Within a
block a sorted window takes a value in and lets one go; its median, the median of the distances to it and a value's rank are looked up by binary search.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, key: str, order: str, part: int) -> DataFrame:
    """rows with __i, their place in the order of a whole number within the key, from 0: parts of time are numbered apart."""
    rows = rows.withColumn("__p", F.floor(F.col(order) / part))
    counts = rows.groupBy(key, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(key).alias("__k"), F.col("__p").alias("__q"), before.alias("__b"))
    inside = F.row_number().over(Window.partitionBy(key, "__p").orderBy(order))
    out = rows.withColumn("__r", inside).join(counts, F.col(key).eqNullSafe(F.col("__k")) & F.col("__p").eqNullSafe(F.col("__q")))
    return out.withColumn("__i", F.col("__b") + F.col("__r") - 1).drop("__p", "__q", "__k", "__b", "__r")


def kth(a: list[float], m: float, k: int) -> float:
    """The k-th smallest (from 0) distance to m of a sorted list: distances rise to both sides of m."""
    p = bisect_left(a, m)
    lo, hi = max(0, k + 1 - (len(a) - p)), min(k + 1, p)
    while lo < hi:  # how many of the k + 1 nearest lie below m
        i = (lo + hi) // 2
        if m - a[p - 1 - i] < a[p + k - i] - m:
            lo = i + 1
        else:
            hi = i
    left = m - a[p - lo] if lo else -1.0
    right = a[p + k - lo] - m if lo <= k else -1.0
    return max(left, right)


def middle(a: list[float]) -> float:
    n = len(a)
    return (a[(n - 1) // 2] + a[n // 2]) / 2


def sliding(values: list[float | None], n: int, first: int) -> Iterator[tuple[float | None, float | None, float | None]]:
    """For each value from the first-th on: median and median distance to it of the last n values, and the share of them at or below it; nothing before n values or with an unknown one."""
    window: list[float] = []
    unknown = 0
    for i, v in enumerate(values):
        if v is None:
            unknown += 1
        else:
            insort(window, v)
        if i >= n:
            old = values[i - n]
            if old is None:
                unknown -= 1
            else:
                del window[bisect_left(window, old)]
        if i >= first:
            if len(window) < n or unknown:
                yield None, None, None
            else:
                m = middle(window)
                far = (kth(window, m, (n - 1) // 2) + kth(window, m, n // 2)) / 2
                yield m, far, bisect_right(window, v) / n


def rolling(rows: DataFrame, key: str, order: str, value: str, contexts: dict[str, int], part: int) -> DataFrame:
    """(key, order, med_c, mad_c, pct_c for each context c of so many rows)."""
    most = max(contexts.values())
    size = max(most, 1 << 12)
    names = [f"{x}_{c}" for c in contexts for x in ("med", "mad", "pct")]
    rows = placed(rows.select(key, order, F.col(value).cast("double").alias("__v")), key, order, part)
    block = F.floor(F.col("__i") / size)
    ahead = F.floor((F.col("__i") + most - 1) / size)
    rows = rows.withColumn("__own", block).withColumn("__block", F.explode(F.sequence(block, ahead)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            at, values, own = (list(x) for x in zip(*held))
            first = own.index(True) if True in own else len(own)
            if first < len(own):
                found = [x for c in contexts.values() for x in zip(*sliding(values, c, first))]
                yield pa.RecordBatch.from_arrays([pa.array([of[0]] * (len(at) - first), pa.string()), pa.array(at[first:], pa.int64()), *(pa.array(x, pa.float64()) for x in found)], [key, order, *names])

        for b in batches:
            for k, block, own, t, v in zip(*(b[c].to_pylist() for c in (key, "__block", "__own", order, "__v"))):
                if (k, block) != of:
                    yield from done()
                    of, held = (k, block), []
                held.append((t, None if v is None or np.isnan(v) else v, own == block))
        yield from done()

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, key, "__block").sortWithinPartitions(key, "__block", "__i")
    return rows.select(key, "__block", "__own", order, "__v").mapInArrow(run, f"{key} string, {order} long, " + ", ".join(f"{n} double" for n in names))
