"""Descriptive reports over a feature frame keyed by symbol and label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import beside, quantiles, wide
from ..functions.ranking import half_open_bin, pressure_bucket, rank_pct
from ..operators.rolling import placed
from ..sources.shared import stored

KEYS = ["symbol", "label"]
EPS, EXACT = 1e-9, "decimal(28,10)"


def percentile_table(rows: DataFrame, columns: list[str], percents: list[float], keys: list[str] = KEYS) -> DataFrame:
    """n, share of nulls, mean, sample deviation and percentiles of each column."""
    aggs = []
    for c in columns:
        stats = [F.count(c).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")]
        aggs.append(F.struct(F.lit(c).alias("feature"), *stats))
    x = rows.groupBy(*keys).agg(F.array(*aggs).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")
    p = quantiles(rows, keys, columns, [p / 100 for p in percents]).drop("n").withColumnRenamed("q", "p")
    x = x.join(p, [*keys, "feature"], "left")
    return x.select(*keys, "feature", "n", (100 * F.col("missing") / (F.col("n") + F.col("missing"))).alias("nan_pct"), "mean", "std", *[F.col("p")[i].alias(f"p{str(p).replace('.', '_')}") for i, p in enumerate(percents)])


def cells(rows: DataFrame, by: list[str], columns: list[str], digits: int = 4) -> DataFrame:
    """n and p50, p90, mean of each column per cell. The mean's sum is one of decimals, so that it is the same in any order. The rows are written once, as several passes read them."""
    rows = stored(rows.select(*by, *columns))
    mean = lambda c: F.sum(F.col(c).cast(EXACT)).cast("double") / F.count(c)
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[mean(c).alias(f"{c}_mean") for c in columns])
    found = beside(found, rows, by, {f"{c}_p{p}": (c, p / 100) for c in columns for p in (50, 90)})
    return found.select(*by, "n", *[F.round(f"{c}_{k}", digits).alias(f"{c}_{k}") for c in columns for k in ("p50", "p90", "mean")])


def joint_state(rows: DataFrame, pressures: dict[str, str], columns: list[str]) -> DataFrame:
    """Responses by bucket of each side's pressure (side -> column), ranked within symbol and label."""
    parts = []
    for side, c in pressures.items():
        ranked = rank_pct(rows.withColumn("__v", F.col(c)), "__v", KEYS, "pct")
        parts.append(ranked.withColumn("side", F.lit(side)).withColumn("bucket", pressure_bucket(F.col("pct"))))
    return cells(reduce(DataFrame.unionByName, parts).where("bucket IS NOT NULL"), [*KEYS, "side", "bucket"], columns)


def conditional_split(rows: DataFrame, pressure: str, net: str, columns: list[str], above: float = 90, band: float = 0.1) -> DataFrame:
    """Under high pressure, responses by the sign of net passive flow; keys with under ten rows and cells with under three are left out."""
    high = rank_pct(rows, pressure, KEYS, "pct").where(F.col("pct") > above)
    kind = F.when(F.col(net) > band, "adds").when(F.col(net) < -band, "cancels").when(F.col(net).isNotNull(), "neutral")
    found = cells(high.withColumn("reaction", kind), [*KEYS, "reaction"], columns)
    found = found.withColumn("n_key", F.sum("n").over(Window.partitionBy(*KEYS)))  # at most four cells a key, those without net flow among them
    return found.where("n_key >= 10 AND n >= 3 AND reaction IS NOT NULL").drop("n_key")


def regularity(split: DataFrame, column: str) -> DataFrame:
    """Whether the response under adds is lower than under cancels."""
    a, c = (split.where(F.col("reaction") == k).select(*KEYS, F.col(column).alias(k)) for k in ("adds", "cancels"))
    return a.join(c, KEYS).withColumn("adds_vs_cancels", F.when(F.col("adds") < F.col("cancels"), "lower").when(F.col("adds") == F.col("cancels"), "equal").otherwise("higher"))


def by_execution(rows: DataFrame, executed: str, columns: list[str]) -> DataFrame:
    """Responses by bucket of executed quantity: nothing executed, and rank bands [lo, hi) of the rest, the last closed."""
    zero = F.col(executed) <= EPS
    pct = rank_pct(rows.where(~zero), executed, KEYS, "pct")
    p = F.col("pct")
    band = F.when(p < 50, "0-50").when(p < 75, "50-75").when(p < 90, "75-90").when(p < 99, "90-99").otherwise("99-100")
    both = pct.withColumn("bucket", band).unionByName(rows.where(zero).withColumn("pct", F.lit(None).cast("double")).withColumn("bucket", F.lit("zero")))
    return cells(both, [*KEYS, "bucket"], columns).where("n >= 3")


def bucket_totals(table: DataFrame, rows: DataFrame, executed: str) -> DataFrame:
    """Per key: its non-zero rows, what its non-zero buckets add up to, and whether that is the same."""
    have = table.where("bucket <> 'zero'").groupBy(*KEYS).agg(F.sum("n").alias("in_buckets"))
    want = rows.where(F.col(executed) > EPS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"))
    return want.join(have, KEYS, "left").withColumn("complete", F.col("in_buckets").eqNullSafe(F.col("rows")))


def buckets_complete(table: DataFrame, rows: DataFrame, executed: str) -> DataFrame:
    """Keys whose non-zero buckets do not add up to their non-zero rows (none, if all is well)."""
    return bucket_totals(table, rows, executed).where("NOT complete")


FAMILY_PERCENTS = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def distributions(rows: DataFrame, families: dict[str, list[str]], keys: list[str] = KEYS, percents: list[float] = FAMILY_PERCENTS) -> DataFrame:
    """Per key, family and feature: n, share of nulls, mean, deviation, percentiles and the largest value. Features that rows lack are left out."""
    named = {c: f for f, columns in families.items() for c in columns if c in rows.columns}
    p = percentile_table(rows, list(named), [*percents, 100], keys).withColumnRenamed("p100", "max")
    family = F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.col("feature"))
    names = {f"p{str(x).replace('.', '_')}": 6 for x in percents}
    return p.select(*keys, family.alias("family"), "feature", "n", F.round("nan_pct", 1).alias("nan_pct"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), *[F.round(c, d).alias(c) for c, d in names.items()], F.round("max", 6).alias("max"))


def densities(rows: DataFrame, column: str, bins: int, keys: list[str] = KEYS) -> DataFrame:
    """A histogram's counts with the bins' edges and densities, as a figure needs them."""
    edges = quantiles(rows, keys, [column], [0.01, 0.99]).select(*keys, F.col("q").alias("e"))
    h = histogram(rows, column, bins, keys).join(edges, keys)
    width = (F.col("e")[1] - F.col("e")[0]) / bins
    total = F.sum("n").over(Window.partitionBy(*keys))  # at most `bins` rows
    return h.select(*keys, "bin", "n", (F.col("e")[0] + F.col("bin") * width).alias("left_edge"), F.try_divide(F.col("n"), total * width).alias("density"))


def log_pairs(rows: DataFrame, x: str, y: str, bins: int, keys: list[str] = KEYS) -> DataFrame:
    """Counts on a grid of log1p(x) and log1p(y), each in equal bins from 0 to the key's largest, as behind a scatter plot."""
    a, b = F.log1p(F.greatest(F.col(x), F.lit(0.0))), F.log1p(F.greatest(F.col(y), F.lit(0.0)))
    most = rows.groupBy(*keys).agg(F.max(a).alias("__a"), F.max(b).alias("__b"))
    at = lambda v, m: F.least(F.floor(F.coalesce(F.try_divide(v, F.col(m)), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(most, keys).groupBy(*keys, at(a, "__a").alias("x_bin"), at(b, "__b").alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    r = rank_pct(rank_pct(rows, a, KEYS, "pa"), b, KEYS, "pb").withColumn("a_bin", half_open_bin(F.col("pa"))).withColumn("b_bin", half_open_bin(F.col("pb")))
    n = r.where("a_bin IS NOT NULL AND b_bin IS NOT NULL").groupBy(*KEYS, "a_bin", "b_bin").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*KEYS)), 4))


def ratio_medians(rows: DataFrame, over: str, under: str) -> DataFrame:
    """Median over labels of the ratio of medians, per symbol and over all."""
    m = beside(rows.select(*KEYS).distinct(), rows, KEYS, {"__over": (over, 0.5), "__under": (under, 0.5)})
    m = m.select(*KEYS, F.try_divide("__over", "__under").alias("ratio"))  # a row per label, so that the medians' buffers below are short
    return m.rollup("symbol").agg(F.percentile("ratio", 0.5).alias("median_ratio"), F.count("ratio").alias("n"))


def histogram(rows: DataFrame, column: str, bins: int, keys: list[str] = KEYS) -> DataFrame:
    """Counts in equal bins between the first and the 99th percentile of the key."""
    edges = quantiles(rows, keys, [column], [0.01, 0.99]).select(*keys, F.col("q").alias("e"))
    r = rows.join(edges, keys).where(F.col(column).between(F.col("e")[0], F.col("e")[1]))
    at = F.least(F.floor((F.col(column) - F.col("e")[0]) / ((F.col("e")[1] - F.col("e")[0]) / bins)), F.lit(bins - 1))
    return r.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_k(rows: DataFrame, column: str, tie: list[Column], k: int) -> DataFrame:
    return rows.orderBy(F.col(column).desc_nulls_last(), *tie).limit(k)


def drawn(key: list[str], seed: int) -> Column:
    """A hash that any engine can tell: of the seed and the key's values as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))


def sample_k(rows: DataFrame, key: list[str], k: int, seed: int = 42) -> DataFrame:
    """k rows by the least hash of their key: the same ones every time, as rows of one key go by their other columns."""
    others = [F.col(f"`{c}`") for c in rows.columns if c not in key]
    return rows.orderBy(drawn(key, seed), *key, *others).limit(k)


def episode_candidates(rows: DataFrame, sell: str, buy: str, response: str, executed: str, refill: str) -> DataFrame:
    """Rows of each mechanical set (kind): the largest percent of either side's flow, high selling with low and with high response, and much executed that was much refilled. Thresholds are of the key; a row may be in several sets."""
    cut = {"sell99": (sell, 0.99), "buy99": (buy, 0.99), "sell90": (sell, 0.9), "resp50": (response, 0.5), "exec90": (executed, 0.9), "refill90": (refill, 0.9)}
    q = wide(rows, KEYS, {f"__{n}": c for n, c in cut.items()})
    v, zero = F.col, lambda c: F.coalesce(F.col(c), F.lit(0.0))
    high = v(sell) > v("__sell90")
    kinds = {"top1pct_sell": v(sell) >= v("__sell99"), "top1pct_buy": v(buy) >= v("__buy99"), "high_flow_low_response": high & (zero(response) < v("__resp50")), "high_flow_high_response": high & (zero(response) >= v("__resp50")), "high_exec_high_repl": (v(executed) > v("__exec90")) & (zero(refill) > v("__refill90"))}
    kind = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()])))
    return rows.join(q, KEYS).withColumn("kind", kind).drop(*[f"__{n}" for n in cut])


def episodes(candidates: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """k of each kind and key by the least hash of their time."""
    least = F.array_sort(F.collect_list(F.struct(drawn(["ts"], seed).alias("h"), F.col("ts").alias("ts"))))
    part = F.pmod(F.xxhash64("ts"), F.lit(64))  # k of each part first: no set is held together
    some = candidates.withColumn("__h", drawn(["ts"], seed)).withColumn("__p", part)
    some = some.withColumn("__i", F.row_number().over(Window.partitionBy(*KEYS, "kind", "__p").orderBy("__h", "ts"))).where(F.col("__i") <= k)
    return some.groupBy(*KEYS, "kind").agg(F.slice(least, 1, k).alias("x")).select(*KEYS, "kind", F.posexplode("x").alias("i", "x")).select("kind", (F.col("i") + 1).alias("i"), "x.ts", *KEYS)


def slices(rows: DataFrame, chosen: DataFrame, reach: int = 30, part: int = 3_600_000) -> DataFrame:
    """The rows within reach places of each chosen anchor of its symbol and label. Places come from counts per part of time, so that no key is sorted in one task."""
    n = placed(rows.withColumn("__key", F.struct(*KEYS)), "__key", "ts", part).drop("__key").withColumnRenamed("__i", "n")
    at = chosen.join(n.select(*KEYS, "ts", "n"), [*KEYS, "ts"]).select(*KEYS, F.col("ts").alias("anchor"), F.explode(F.sequence(F.col("n") - reach, F.col("n") + reach)).alias("n"))
    return at.join(n, [*KEYS, "n"])


def closest(rows: DataFrame, column: str, percents: dict[str, float], tie: str) -> DataFrame:
    """For each label the row whose value is closest to the percentile, the first of equal ones."""
    q = wide(rows, [], {name: (column, p / 100) for name, p in percents.items()})
    e = rows.crossJoin(F.broadcast(q))  # q is one row
    return e.agg(F.array(*[F.struct(F.lit(n).alias("selected"), F.min_by(tie, F.struct(F.abs(F.col(column) - F.col(n)), F.col(tie))).alias(tie)) for n in percents]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def feature_quality(rows: DataFrame, numeric: list[str], ranges: list[tuple[str, float, float]]) -> DataFrame:
    """Per numeric column: nulls, distinct kinds and values out of the range its name asks for."""
    bound = lambda c: next(((lo, hi) for frag, lo, hi in ranges if frag in c), None)
    out = []
    for c in numeric:
        b, v = bound(c), F.col(c).cast("double")
        bad = F.count_if((v < b[0] - 1e-9) | (v > b[1] + 1e-9)) if b else F.lit(0).cast("long")
        out.append(F.struct(F.lit(c).alias("column"), F.count_if(v.isNull() | F.isnan(v)).alias("missing"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), bad.alias("out_of_range"), F.coalesce(F.max(v) == F.min(v), F.lit(True)).alias("constant")))
    return rows.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def monotonic_violations(stacked: DataFrame, columns: list[str]) -> DataFrame:
    """Anchors where a longer window holds less than a shorter one."""
    w = Window.partitionBy("symbol", "anchor").orderBy("w")
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False)) for c in columns])
    return stacked.withColumn("bad", bad).agg(F.count_if("bad").alias("violations"), F.count(F.lit(1)).alias("checked"))
