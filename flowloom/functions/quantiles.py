"""Exact quantiles without a buffer of all values.

A sketch of bounded size gives, for every wanted rank, two values that it must lie between (its error is known). Then values below the first are counted, and only those
between the two are told apart, by value; a running count over these few finds the ranks' values, between which is interpolated. A task holds at most about
6 / ACCURACY of a key's distinct values (and ACCURACY of them where a key has no more rows than that, which all count), however many rows the key has, and rows are
summed by value before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def quantiles(rows: DataFrame, keys: list[str], columns: list[str], ps: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, feature, n, q: the value of each p in order, by linear interpolation) of every column that has a value; null and NaN values do not count."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = rows.select(*keys, values.alias("x")).select(*keys, "x.*").where("v IS NOT NULL AND NOT isnan(v)")
    by = [*keys, "feature"]
    of = lambda t, side: t.select(*[F.col(c).alias(f"{side}{c}") for c in by], *[c for c in t.columns if c not in by])
    same = lambda side: [F.col(c).eqNullSafe(F.col(f"{side}{c}")) for c in by]
    slack = 3 / accuracy  # the sketch's error is a third of it, and two ranks are as much where n is above accuracy
    near = [max(0.0, p - slack) for p in ps] + [min(1.0, p + slack) for p in ps]
    ends = long.groupBy(*by).agg(F.count("v").alias("n"), F.percentile_approx("v", near, accuracy).alias("e"))
    few = F.col("n") <= accuracy
    low = [F.when(few | F.lit(p - slack <= 0), F.lit(float("-inf"))).otherwise(F.col("e")[i]) for i, p in enumerate(ps)]
    high = [F.when(few | F.lit(p + slack >= 1), F.lit(float("inf"))).otherwise(F.col("e")[len(ps) + i]) for i, p in enumerate(ps)]
    ends = of(ends.select(*by, "n", F.array(*low).alias("lo"), F.array(*high).alias("hi")), "__")
    met = long.groupBy(*by, "v").agg(F.count("v").alias("c")).join(ends, same("__")).drop(*[f"__{c}" for c in by])
    # a value within a rank's bounds stays itself; one below them is null, and all such are one group
    each = [F.when(F.col("v") <= F.col("hi")[i], F.struct(F.lit(i).alias("i"), F.when(F.col("v") >= F.col("lo")[i], F.col("v")).alias("v"))) for i in range(len(ps))]
    inside = met.select(*by, "n", "c", F.explode(F.array(*each)).alias("x")).where("x IS NOT NULL").select(*by, "n", "c", "x.i", "x.v")
    inside = inside.groupBy(*by, "n", "i", "v").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy(F.asc_nulls_first("v")))
    place = F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("i") + 1) * (F.col("n") - 1)
    inside = inside.withColumn("upto", upto).withColumn("place", place)
    holds = lambda rank: (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
    found = inside.groupBy(*by, "i", "n", "place").agg(F.max(F.when(holds(F.floor("place")), F.col("v"))).alias("a"), F.max(F.when(holds(F.ceil("place")), F.col("v"))).alias("b"))
    k, up = F.floor("place"), F.ceil("place")
    value = F.when((k == up) | (F.col("a") == F.col("b")), F.col("a")).otherwise((up - F.col("place")) * F.col("a") + (F.col("place") - k) * F.col("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a wanted rank lies outside its sketch's bounds"))).otherwise(value)
    got = found.select(*by, "n", "i", value.alias("q")).groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("q"))
    return got.select(*by, "n", F.transform("q", lambda x: x["q"]).alias("q"))


def wide(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(keys, a column for each name of wanted: the quantile p of a column)."""
    ps = sorted({p for _, p in wanted.values()})
    q = quantiles(rows, keys, sorted({c for c, _ in wanted.values()}), ps)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[ps.index(p)])).alias(n) for n, (c, p) in wanted.items()])


def beside(found: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """found, which has a row for each key, with wide()'s columns of rows; null where a key has no value. Null keys meet null keys."""
    q = wide(rows, keys, wanted).select(*[F.col(k).alias(f"__{k}") for k in keys], *wanted)
    return found.join(q, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
