"""Average-rank percentiles and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_pct(rows: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Average rank of value among its key's non-null values, in percent. Counts per distinct value are summed first, so ties never meet in one sort."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(value)
    n = n.withColumn(name, (F.sum("__n").over(w) - F.col("__n") / 2 + 0.5) / F.sum("__n").over(Window.partitionBy(*keys)) * 100)
    return rows.join(n.drop("__n"), [*keys, value], "left")


def pressure_bucket(pct: Column) -> Column:
    """Bands of a percentile, closed above; the first closed below too."""
    return F.when((pct >= 0) & (pct <= 50), "0-50").when(pct <= 90, "50-90").when(pct <= 95, "90-95").when(pct <= 99, "95-99").when(pct <= 100, "99-100")


def half_open_bin(pct: Column) -> Column:
    return F.when((pct > 0) & (pct <= 25), "0-25").when((pct > 25) & (pct <= 50), "25-50").when((pct > 50) & (pct <= 75), "50-75").when((pct > 75) & (pct <= 90), "75-90").when((pct > 90) & (pct <= 100), "90-100")
