"""What the figures draw, as tables: boxes, histograms by sign, and kernel densities from counts. Each is a few rows per key, whatever the number of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.ranking import rank_pct
from .report import KEYS
from .report_queries import FR, _rank, frame


def boxes(rows: DataFrame, columns: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Quartiles of each column and its whiskers: the furthest values within one and a half quartile ranges of the box, and no nearer than it. Two passes; unknown values do not count."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*keys, "x.*").where("v IS NOT NULL AND NOT isnan(v)")
    by = [*keys, "feature"]
    box = quantiles(rows, keys, columns, [0.25, 0.5, 0.75])
    box = box.select(*by, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    far = long.join(box, by).groupBy(*by).agg(F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("lo"), F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("hi"))
    out = box.join(far, by)
    return out.select(*by, "n", F.least(F.coalesce("lo", "q1"), "q1").alias("whisker_low"), "q1", "median", "q3", F.greatest(F.coalesce("hi", "q3"), "q3").alias("whisker_high"))


def signed_histogram(rows: DataFrame, pressure: str, net: str, column: str, bins: int = 30, above: float = 90) -> DataFrame:
    """Under high pressure, the density of a column in equal bins between its extremes, by the sign of net flow (exactly zero is neutral). Keys of under ten rows and signs of three or fewer are left out."""
    high = rank_pct(rows, pressure, KEYS, "pct").where(F.col("pct") > above).where(F.col(net).isNotNull())
    by = [*KEYS, "reaction"]
    high = high.withColumn("reaction", F.when(F.col(net) > 0, "adds").when(F.col(net) < 0, "cancels").otherwise("neutral")).withColumn("v", F.col(column).cast("double"))
    ends = high.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("n_all"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = ends.withColumn("n_key", F.sum("rows").over(Window.partitionBy(*KEYS))).where("rows > 3 AND n_key >= 10").drop("n_key")  # at most three rows a key
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(*by, "n_all", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    found = high.where("v IS NOT NULL").join(ends, by).groupBy(*by, at.alias("bin"), "lo", "hi", "n_all").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return found.select(*by, "bin", "n", (F.col("lo") + F.col("bin") * width).alias("left_edge"), (F.col("n") / (F.col("n_all") * width)).alias("density"))


def violins(rows: DataFrame, column: str, keys: list[str] = KEYS, points: int = 100, bins: int = 200, clip: bool = False, log: bool = False) -> DataFrame:
    """A Gaussian kernel density (bandwidth: deviation times n^(-1/5)) at equal points between the extremes, from counts in bins; with clip of values drawn in to the first and 99th percentile, with log of log1p.

    Keys of ten rows or fewer, or of equal values, have no density.
    """
    v = F.log1p(F.col(column).cast("double")) if log else F.col(column).cast("double")
    rows = rows.select(*keys, v.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    if clip:
        ends = quantiles(rows, keys, ["v"], [0.01, 0.99]).select(*keys, F.col("q").alias("e"))
        rows = rows.join(ends, keys).select(*keys, F.greatest(F.least("v", F.col("e")[1]), F.col("e")[0]).alias("v"))
    shape = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("std")).where("n > 10 AND hi > lo")
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    counts = rows.join(shape, keys).groupBy(*keys, "n", "lo", "hi", "std", at).agg(F.count(F.lit(1)).alias("c"))
    spots = counts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))  # at most bins * points rows for a key
    spots = spots.withColumn("x", F.expr(f"lo + (hi - lo) * point / {points - 1}")).withColumn("h", F.expr("std * pow(n, -0.2D)"))
    kernel = F.expr(f"c * exp(-0.5D * pow((x - (lo + (hi - lo) * (bin + 0.5D) / {bins})) / h, 2)) / (n * h * sqrt(2 * pi()))")
    return spots.groupBy(*keys, "point", "n", "x").agg(F.sum(kernel).alias("density"))


METRICS = ["pressure", "response", "ratio", "net", "executed"]


def s16_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity by symbol and label."""
    b = boxes(frame(spark, sf_dir), METRICS)
    return b.select("symbol", "label", "feature", "n", *[F.round(c, 6).alias(c) for c in ("whisker_low", "q1", "median", "q3", "whisker_high")])


def centred(rows: DataFrame) -> DataFrame:
    """Net flow in tenths, so that it is exactly zero for some."""
    return rows.withColumn("net", F.round(F.col("net") * 10))


def s16_signed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = signed_histogram(centred(frame(spark, sf_dir)), "pressure", "net", "response")
    return h.select("symbol", "label", "reaction", "bin", "n", F.round("left_edge", 4).alias("left_edge"), F.round(F.col("density") * 1e6, 6).alias("density_ppm"))


VIOLINS = {"pressure": (False, True), "ratio": (True, False), "response": (True, False)}


def s16_violins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration as logarithms, and two clipped comparisons."""
    f = frame(spark, sf_dir)
    parts = [violins(f, c, clip=clip, log=log).withColumn("feature", F.lit(c)) for c, (clip, log) in VIOLINS.items()]
    return reduce(DataFrame.unionByName, parts).select("symbol", "label", "feature", "point", "n", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 4).alias("density_ppm"))


QUERIES = [s16_boxes, s16_signed_histogram, s16_violins]


def _violin(c: str, clip: bool, log: bool) -> str:
    v = f"ln(1 + {c})" if log else c
    drawn = "greatest(least(v, quantile_cont(v, 0.99) OVER k), quantile_cont(v, 0.01) OVER k)" if clip else "v"
    return f"""SELECT symbol, label, '{c}' AS feature, point, n, round(x, 4) AS x, round(1e6 * sum(c * exp(-0.5 * pow((x - (lo + (hi - lo) * (bin + 0.5) / 200)) / h, 2)) / (n * h * sqrt(2 * pi()))), 4) AS density_ppm FROM (
 WITH b AS (SELECT symbol, label, {v} AS v FROM fr), w AS (SELECT symbol, label, {drawn} AS v FROM b WINDOW k AS (PARTITION BY symbol, label)),
 s AS (SELECT symbol, label, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM w GROUP BY 1, 2 HAVING count(*) > 10 AND max(v) > min(v)),
 g AS (SELECT symbol, label, n, lo, hi, h, CAST(least(floor((v - lo) / (hi - lo) * 200), 199) AS INT) AS bin, count(*) AS c FROM w JOIN s USING (symbol, label) GROUP BY ALL)
 SELECT g.*, CAST(p.i AS INT) AS point, lo + (hi - lo) * p.i / 99 AS x FROM g, range(100) p(i)) GROUP BY symbol, label, point, n, x"""


_long = " UNION ALL ".join(f"SELECT symbol, label, '{c}' AS feature, {c} AS v FROM fr WHERE {c} IS NOT NULL" for c in METRICS)
ORACLE = {
    "s16_boxes": f"""WITH {FR}, lg AS ({_long}), b AS (SELECT symbol, label, feature, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM lg GROUP BY 1, 2, 3)
SELECT symbol, label, feature, any_value(n) AS n, round(least(coalesce(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), any_value(q1)), any_value(q1)), 6) AS whisker_low, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
 round(any_value(q3), 6) AS q3, round(greatest(coalesce(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), any_value(q3)), any_value(q3)), 6) AS whisker_high FROM lg JOIN b USING (symbol, label, feature) GROUP BY 1, 2, 3""",
    "s16_signed_histogram": f"""WITH {FR}, h AS (SELECT *, count(*) OVER (PARTITION BY symbol, label) AS nk FROM (SELECT *, {_rank('pressure')} AS pct FROM fr) WHERE pct > 90),
g AS (SELECT symbol, label, CASE WHEN round(net * 10) > 0 THEN 'adds' WHEN round(net * 10) < 0 THEN 'cancels' ELSE 'neutral' END AS reaction, response AS v FROM h WHERE nk >= 10),
e AS (SELECT symbol, label, reaction, count(*) AS n_all, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM g GROUP BY 1, 2, 3 HAVING count(*) > 3),
b AS (SELECT symbol, label, reaction, n_all, lo, hi, CAST(least(floor((v - lo) / (hi - lo) * 30), 29) AS INT) AS bin, count(*) AS n FROM g JOIN e USING (symbol, label, reaction) GROUP BY ALL)
SELECT symbol, label, reaction, bin, n, round(lo + bin * ((hi - lo) / 30), 4) AS left_edge, round(n / (n_all * ((hi - lo) / 30)) * 1e6, 6) AS density_ppm FROM b""",
    "s16_violins": f"WITH {FR} " + " UNION ALL ".join(_violin(c, *how) for c, how in VIOLINS.items()),
}
