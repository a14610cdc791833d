"""Report and quality queries over lineitem as a feature frame; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import beside
from ..functions.ranking import half_open_bin, pressure_bucket, rank_pct
from ..operators import atoms, levels, lifecycle, windows
from ..sources import canonical, demo
from ..sources.shared import stored
from . import gates, report
from .flow_queries import GRID, PLAIN, STEP, TK, WINDOWS, _w1, d, over, r, stacked
from .book_queries import HORIZON, _lv, _rp


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda x: F.col(x).cast("double")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"), c("l_quantity").alias("pressure"), c("l_extendedprice").alias("response"), c("l_discount").alias("ratio"), (c("l_tax") * 10 - 0.4).alias("net"), F.when(F.col("l_linenumber") <= 2, 0.0).otherwise(c("l_quantity")).alias("executed"))


FR = "fr AS (SELECT l_returnflag AS symbol, l_linestatus AS label, l_orderkey * 10 + l_linenumber AS ts, CAST(l_quantity AS DOUBLE) AS pressure, CAST(l_extendedprice AS DOUBLE) AS response, CAST(l_discount AS DOUBLE) AS ratio, CAST(l_tax AS DOUBLE) * 10 - 0.4 AS net, CASE WHEN l_linenumber <= 2 THEN 0.0 ELSE CAST(l_quantity AS DOUBLE) END AS executed FROM lineitem)"
PCTS = [0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100]


def r1_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rank_pct(frame(spark, sf_dir), "pressure", ["symbol", "label"], "pct")
    return p.groupBy("symbol", "label", pressure_bucket(F.col("pct")).alias("bucket"), half_open_bin(F.col("pct")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("pct"), 6).alias("lo"), F.round(F.max("pct"), 6).alias("hi"))


def g5_percentile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = report.percentile_table(frame(spark, sf_dir), ["pressure", "response", "ratio"], PCTS)
    return t.select("symbol", "label", "feature", "n", *d("nan_pct", "mean", *[f"p{p}" for p in PCTS]), F.round("std", 3).alias("std"))


def g7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    rates = f.groupBy("symbol", "label").agg(F.avg("pressure").alias("mean"), F.max("pressure").alias("most"))
    rates = beside(rates, f, ["symbol", "label"], {f"p{p}": ("pressure", p / 100) for p in (50, 90, 99)})
    return rates.select("symbol", "label", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p90", "p99", "most")])


def g8_joint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.joint_state(frame(spark, sf_dir), {"SELL": "pressure", "BUY": "response"}, ["ratio", "net"])


def split(spark, sf_dir, pressure: str = "pressure") -> DataFrame:
    return report.conditional_split(frame(spark, sf_dir), pressure, "net", ["response"])


def g9_conditional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides: selling against one column's pressure, buying against the other's."""
    return split(spark, sf_dir).withColumn("aggressor", F.lit("SELL")).unionByName(split(spark, sf_dir, "response").withColumn("aggressor", F.lit("BUY")))


FAMILIES = {"FLOW": ["pressure", "executed"], "RESPONSE": ["response", "net"], "RATIO": ["ratio", "absent"]}


def g6_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distributions(frame(spark, sf_dir).withColumn("executed", F.nullif("executed", F.lit(0.0))), FAMILIES).withColumn("std", F.round("std", 2))


def v9_distribution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))
    return gates.distribution_status(rows, FAMILIES | {"NONE": ["nothing"]}, ["symbol", "label"])


def v9_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.inventory(frame(spark, sf_dir).withColumn("data_version", F.col("label")), ["symbol"])


def s16_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of 30, 50 and 60 bins."""
    f, columns = frame(spark, sf_dir), {"pressure": 30, "response": 50, "ratio": 60}
    parts = [report.densities(f, c, n).withColumn("feature", F.lit(c)) for c, n in columns.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("symbol", "label", "feature", "bin", "n", F.round("left_edge", 4).alias("left_edge"), F.round("density", 9).alias("density"))


def s16_log_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.log_pairs(frame(spark, sf_dir), "pressure", "response", 8)


def g10_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.regularity(split(spark, sf_dir), "response_p50")


def g11_by_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_execution(frame(spark, sf_dir), "executed", ["response"])


def g12_buckets_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    return report.bucket_totals(report.by_execution(f, "executed", ["response"]), f, "executed")


def near_market(rows: DataFrame, depths: dict[str, str], near: str, wide: str, distance: str) -> DataFrame:
    """Per key: p50 and p90 of each depth (name -> column), of the share of the wide depth that is near, and p10, p50 and p90 of the nearest level's distance."""
    share = F.col(near) / (F.col(wide) + 1e-12)
    wanted = [(n, F.col(c), (50, 90), 4) for n, c in depths.items()] + [("concentration", share, (50, 90), 3), ("distance", F.col(distance), (10, 50, 90), 1)]
    # a column behind several names is ranked once
    keys, columns = ["symbol", "label"], list(dict.fromkeys([*depths.values(), distance]))
    of = {n: f"v{columns.index(c)}" for n, c in depths.items()} | {"concentration": "share", "distance": f"v{columns.index(distance)}"}
    named = {f"{n}_p{p}": (of[n], p / 100) for n, _, ps, _ in wanted for p in ps}
    values = rows.select(*keys, *[F.col(c).alias(f"v{k}") for k, c in enumerate(columns)], share.alias("share"))
    found = beside(values.select(*keys).distinct(), values, keys, named)
    return found.select(*keys, *[F.round(f"{n}_p{p}", digits).alias(f"{n}_p{p}") for n, _, ps, digits in wanted for p in ps])


DEPTHS = {"bid_5bps": "pressure", "ask_5bps": "executed", "bid_10bps": "response", "ask_10bps": "ratio", "bid_25bps": "response", "ask_25bps": "net"}


def g13_near_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_market(frame(spark, sf_dir), DEPTHS, "pressure", "response", "response")


def g14_reprice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = rank_pct(frame(spark, sf_dir), "pressure", ["symbol", "label"], "pct").where("pct > 99")
    keys = ["symbol", "label"]
    h = stored(h.select(*keys, "response", "ratio"))
    m = beside(h.select(*keys).distinct(), h, keys, {"away": ("response", 0.5), "toward": ("ratio", 0.5)})
    m = m.select(*keys, F.round("away", 2).alias("away"), F.round("toward", 2).alias("toward"))
    return m.withColumn("away_to_toward", F.round(F.try_divide("away", "toward"), 4))


def g15_global_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir).where("executed > 1e-9")
    found = f.groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"), F.max("ratio").alias("most")).where("n >= 3")
    found = beside(found, f, ["symbol", "label"], {f"p{p}": ("ratio", p / 100) for p in (50, 90, 99)})
    return found.select("symbol", "label", "n", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (50, 90, 99)], "most")


def g16_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.contingency(frame(spark, sf_dir), "pressure", "response")


def g17_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cells(frame(spark, sf_dir), ["symbol"], ["pressure", "response"])


def g18_ratio_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ratio_medians(frame(spark, sf_dir), "response", "pressure").select("symbol", F.round("median_ratio", 6).alias("median_ratio"), "n")


def s16_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(frame(spark, sf_dir), "pressure", 10)


def o4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_k(frame(spark, sf_dir), "response", [F.col("ts")], 10).select("ts", "response")


def o6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sample_k(frame(spark, sf_dir), ["ts"], 20).select("ts", "symbol", "label")


def candidates(spark, sf_dir) -> DataFrame:
    return report.episode_candidates(frame(spark, sf_dir), "pressure", "response", "ratio", "executed", "net")


def o7_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("symbol", "label", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("ts").alias("sum_ts"))


def o7_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each set and key by hash."""
    return report.episodes(candidates(spark, sf_dir))


def o8_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir)
    top = report.top_k(f, "response", [F.col("ts")], 3)
    return report.slices(f, top, part=20_000).groupBy("symbol", "label", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def o9_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.closest(frame(spark, sf_dir), "response", {"LOW": 15, "MEDIAN": 50, "HIGH": 92}, "ts")


def o10_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of values at or below each value, from counts per value."""
    from pyspark.sql import Window

    n = frame(spark, sf_dir).groupBy("pressure").agg(F.count(F.lit(1)).alias("n"))
    return n.select("pressure", F.round(100 * F.sum("n").over(Window.orderBy("pressure")) / F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 6).alias("at_or_below_pct"))


def o11_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.events(spark, sf_dir)
    return e.where("event_type <> 'Execution'").select("symbol", F.lit("orders").alias("file")).unionByName(e.where("event_type = 'Execution'").select("symbol", F.lit("executions").alias("file"))).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def o13_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first execution of each timestamp."""
    return demo.events(spark, sf_dir).where("event_type = 'Execution'").groupBy("timestamp_ms").agg(F.min_by("maker_uid", "ingest_pos").alias("maker_uid"), F.min("ingest_pos").alias("ingest_pos"))


def v4_feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.feature_quality(frame(spark, sf_dir), ["pressure", "response", "ratio", "net", "executed"], [("ratio", 0.0, 0.05), ("net", -0.4, 0.4), ("pressure", 0.0, 1e9)])


def v6_window_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.events(spark, sf_dir)
    f = stacked(windows.aggressive_flow(atoms.taker(e), demo.anchors(e), WINDOWS, STEP), ["buy_taker_qty", "sell_taker_qty", "buy_taker_count", "ask_levels_consumed"])
    return report.monotonic_violations(f, ["buy_taker_qty", "sell_taker_qty", "buy_taker_count", "ask_levels_consumed"])


def s10_time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.time_bounds(demo.events(spark, sf_dir), ("symbol",))


def s17_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.content_hash(demo.events(spark, sf_dir))


REFILL = [15, 60, 120, 360]


def w11_replenishment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.events(spark, sf_dir)
    out = levels.refills(lifecycle.level_changes(e), demo.anchors(e), HORIZON, REFILL, STEP)
    return out.select("anchor", "w", *d("total_exec_qty", "total_refill_qty", "max_refill", "replenishment_ratio"), "refill_count")


QUERIES = [v9_distribution_status, v9_inventory, r1_rank_pct, g5_percentile_table, g7_rates, g8_joint_state, g9_conditional_split, g10_regularity, g11_by_execution, g12_buckets_complete, g6_distributions, s16_densities, s16_log_pairs, o7_candidates, g13_near_market, g14_reprice_summary, g15_global_ratio, g16_contingency, g17_comparison, g18_ratio_medians, s16_histogram, o4_top_k, o6_sample, o7_episodes, o8_slices, o9_closest, o10_ecdf, o11_union_all, o13_first_per_key, v4_feature_quality, v6_window_checks, s10_time_bounds, s17_content_hash, w11_replenishment]

_rank = lambda c, w="": f"(rank() OVER (PARTITION BY symbol, label ORDER BY {c}) + (count(*) OVER (PARTITION BY symbol, label, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol, label) * 100"
_bucket = "CASE WHEN pct <= 50 THEN '0-50' WHEN pct <= 90 THEN '50-90' WHEN pct <= 95 THEN '90-95' WHEN pct <= 99 THEN '95-99' ELSE '99-100' END"
_bin = lambda p: f"CASE WHEN {p} <= 25 THEN '0-25' WHEN {p} <= 50 THEN '25-50' WHEN {p} <= 75 THEN '50-75' WHEN {p} <= 90 THEN '75-90' ELSE '90-100' END"
_mean = lambda c: f"CAST(sum(CAST({c} AS DECIMAL(28,10))) AS DOUBLE) / count({c})"
_cells = lambda *cs: "count(*) AS n, " + ", ".join(f"round(quantile_cont({c}, 0.5), 4) AS {c}_p50, round(quantile_cont({c}, 0.9), 4) AS {c}_p90, round({_mean(c)}, 4) AS {c}_mean" for c in cs)
_split = f"hp AS (SELECT * FROM (SELECT *, {_rank('pressure')} AS pct FROM fr) WHERE pct > 90), hk AS (SELECT *, count(*) OVER (PARTITION BY symbol, label) AS nk FROM hp), cs AS (SELECT symbol, label, CASE WHEN net > 0.1 THEN 'adds' WHEN net < -0.1 THEN 'cancels' ELSE 'neutral' END AS reaction, response AS v FROM hk WHERE nk >= 10), ct AS (SELECT symbol, label, reaction, count(*) AS n, round(quantile_cont(v, 0.5), 4) AS response_p50, round(quantile_cont(v, 0.9), 4) AS response_p90, round({_mean('v')}, 4) AS response_mean FROM cs GROUP BY ALL HAVING count(*) >= 3)"
_vq = lambda c, lo, hi: f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, CAST(0 AS BIGINT) AS infinite, count(*) FILTER ({c} < {lo} - 1e-9 OR {c} > {hi} + 1e-9) AS out_of_range, max({c}) = min({c}) AS constant FROM fr"

_kinds = f"WITH {FR}, q AS (SELECT symbol, label, quantile_cont(pressure, 0.99) AS s99, quantile_cont(response, 0.99) AS b99, quantile_cont(pressure, 0.9) AS s90, quantile_cont(ratio, 0.5) AS r50, quantile_cont(executed, 0.9) AS e90, quantile_cont(net, 0.9) AS f90 FROM fr GROUP BY 1, 2), j AS (SELECT * FROM fr JOIN q USING (symbol, label)), k AS (" + " UNION ALL ".join(f"SELECT symbol, label, ts, '{k}' AS kind FROM j WHERE {c}" for k, c in (("top1pct_sell", "pressure >= s99"), ("top1pct_buy", "response >= b99"), ("high_flow_low_response", "pressure > s90 AND ratio < r50"), ("high_flow_high_response", "pressure > s90 AND ratio >= r50"), ("high_exec_high_repl", "executed > e90 AND net > f90")))
_hashed = ["symbol", "ingest_pos", "timestamp_ms", "event_type", "order_uid", "side", "price", "qty", "maker_uid", "taker_uid", "execution_price", "execution_qty", "order_type", "aggressor", "n_events_same_ms", "ordering_ambiguous"]
_fields = " || ',' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _hashed)
ORACLE = {
    "r1_rank_pct": f"WITH {FR}, p AS (SELECT *, {_rank('pressure')} AS pct FROM fr) SELECT symbol, label, {_bucket} AS bucket, {_bin('pct')} AS bin, count(*) AS n, round(min(pct), 6) AS lo, round(max(pct), 6) AS hi FROM p GROUP BY 1, 2, 3, 4",
    "g5_percentile_table": f"WITH {FR}, u AS (UNPIVOT fr ON pressure, response, ratio INTO NAME feature VALUE v) SELECT symbol, label, feature, count(v) AS n, CAST(0 AS DOUBLE) AS nan_pct, {r('avg(v)', 'mean')}, " + ", ".join(r(f"quantile_cont(v, {p / 100})", f"p{p}") for p in PCTS) + ", round(stddev_samp(v), 3) AS std FROM u GROUP BY 1, 2, 3",
    "g7_rates": f"WITH {FR} SELECT symbol, label, round(avg(pressure), 4) AS mean, round(quantile_cont(pressure, 0.5), 4) AS p50, round(quantile_cont(pressure, 0.9), 4) AS p90, round(quantile_cont(pressure, 0.99), 4) AS p99, round(max(pressure), 4) AS most FROM fr GROUP BY 1, 2",
    "g8_joint_state": f"WITH {FR}, p AS (SELECT 'SELL' AS side, *, {_rank('pressure')} AS pct FROM fr UNION ALL SELECT 'BUY', *, {_rank('response')} FROM fr) SELECT symbol, label, side, {_bucket} AS bucket, {_cells('ratio', 'net')} FROM p GROUP BY 1, 2, 3, 4",
    "g9_conditional_split": f"WITH {FR}, a AS (WITH {_split} SELECT *, 'SELL' AS aggressor FROM ct), b AS (WITH {_split.replace(_rank('pressure'), _rank('response'))} SELECT *, 'BUY' AS aggressor FROM ct) SELECT * FROM a UNION ALL SELECT * FROM b",
    "g10_regularity": f"WITH {FR}, {_split} SELECT a.symbol, a.label, a.response_p50 AS adds, c.response_p50 AS cancels, CASE WHEN a.response_p50 < c.response_p50 THEN 'lower' WHEN a.response_p50 = c.response_p50 THEN 'equal' ELSE 'higher' END AS adds_vs_cancels FROM ct a JOIN ct c USING (symbol, label) WHERE a.reaction = 'adds' AND c.reaction = 'cancels'",
    "g11_by_execution": f"WITH {FR}, p AS (SELECT *, {_rank('executed')} AS pct FROM fr WHERE executed > 1e-9), b AS (SELECT symbol, label, response, CASE WHEN pct < 50 THEN '0-50' WHEN pct < 75 THEN '50-75' WHEN pct < 90 THEN '75-90' WHEN pct < 99 THEN '90-99' ELSE '99-100' END AS bucket FROM p UNION ALL SELECT symbol, label, response, 'zero' FROM fr WHERE executed <= 1e-9) SELECT symbol, label, bucket, {_cells('response')} FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    "g12_buckets_complete": f"WITH {FR}, t AS (WITH p AS (SELECT *, {_rank('executed')} AS pct FROM fr WHERE executed > 1e-9), b AS (SELECT symbol, label, response, CASE WHEN pct < 50 THEN '0-50' WHEN pct < 75 THEN '50-75' WHEN pct < 90 THEN '75-90' WHEN pct < 99 THEN '90-99' ELSE '99-100' END AS bucket FROM p UNION ALL SELECT symbol, label, response, 'zero' FROM fr WHERE executed <= 1e-9) SELECT symbol, label, bucket, {_cells('response')} FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 3), h AS (SELECT symbol, label, sum(n) AS in_buckets FROM t WHERE bucket <> 'zero' GROUP BY 1, 2), w AS (SELECT symbol, label, count(*) AS rows FROM fr WHERE executed > 1e-9 GROUP BY 1, 2) SELECT symbol, label, rows, in_buckets, in_buckets IS NOT DISTINCT FROM rows AS complete FROM w LEFT JOIN h USING (symbol, label)",
    "g13_near_market": f"WITH {FR} SELECT symbol, label, " + ", ".join(f"round(quantile_cont({c}, {p / 100}), {digits}) AS {n}_p{p}" for n, c, ps, digits in [(n, c, (50, 90), 4) for n, c in DEPTHS.items()] + [("concentration", "pressure / (response + 1e-12)", (50, 90), 3), ("distance", "response", (10, 50, 90), 1)] for p in ps) + " FROM fr GROUP BY 1, 2",
    "g14_reprice_summary": f"WITH {FR}, p AS (SELECT *, {_rank('pressure')} AS pct FROM fr), m AS (SELECT symbol, label, round(quantile_cont(response, 0.5), 2) AS away, round(quantile_cont(ratio, 0.5), 2) AS toward FROM p WHERE pct > 99 GROUP BY 1, 2) SELECT *, round(away / nullif(toward, 0), 4) AS away_to_toward FROM m",
    "g15_global_ratio": f"WITH {FR} SELECT symbol, label, count(*) AS n, round(quantile_cont(ratio, 0.5), 6) AS p50, round(quantile_cont(ratio, 0.9), 6) AS p90, round(quantile_cont(ratio, 0.99), 6) AS p99, max(ratio) AS most FROM fr WHERE executed > 1e-9 GROUP BY 1, 2 HAVING count(*) >= 3",
    "g16_contingency": f"WITH {FR}, p AS (SELECT *, {_rank('pressure')} AS pa, {_rank('response')} AS pb FROM fr), n AS (SELECT symbol, label, {_bin('pa')} AS a_bin, {_bin('pb')} AS b_bin, count(*) AS n FROM p GROUP BY 1, 2, 3, 4) SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY symbol, label), 4) AS pct FROM n",
    "g17_comparison": f"WITH {FR} SELECT symbol, {_cells('pressure', 'response')} FROM fr GROUP BY 1",
    "g18_ratio_medians": f"WITH {FR}, m AS (SELECT symbol, label, quantile_cont(response, 0.5) / quantile_cont(pressure, 0.5) AS ratio FROM fr GROUP BY 1, 2) SELECT symbol, round(quantile_cont(ratio, 0.5), 6) AS median_ratio, count(ratio) AS n FROM m GROUP BY ROLLUP (symbol)",
    "s16_histogram": f"WITH {FR}, e AS (SELECT symbol, label, quantile_cont(pressure, 0.01) AS a, quantile_cont(pressure, 0.99) AS b FROM fr GROUP BY 1, 2) SELECT symbol, label, CAST(least(floor((pressure - a) / ((b - a) / 10)), 9) AS INT) AS bin, count(*) AS n FROM fr JOIN e USING (symbol, label) WHERE pressure BETWEEN a AND b GROUP BY 1, 2, 3",
    "o4_top_k": f"WITH {FR} SELECT ts, response FROM fr ORDER BY response DESC, ts LIMIT 10",
    "o8_slices": f"WITH {FR}, t AS (SELECT * FROM fr ORDER BY response DESC, ts LIMIT 3), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, label ORDER BY ts) AS n FROM fr), a AS (SELECT n.* FROM t JOIN n USING (symbol, label, ts)) SELECT a.symbol, a.label, a.ts AS anchor, count(*) AS n, min(n.ts) AS first_ts, max(n.ts) AS last_ts FROM a JOIN n ON n.symbol = a.symbol AND n.label = a.label AND n.n BETWEEN a.n - 30 AND a.n + 30 GROUP BY 1, 2, 3",
    "o9_closest": f"WITH {FR}, q AS (SELECT 'LOW' AS selected, quantile_cont(response, 0.15) AS v FROM fr UNION ALL SELECT 'MEDIAN', quantile_cont(response, 0.5) FROM fr UNION ALL SELECT 'HIGH', quantile_cont(response, 0.92) FROM fr) SELECT selected, (SELECT ts FROM fr ORDER BY abs(response - v), ts LIMIT 1) AS ts FROM q",
    "o10_ecdf": f"WITH {FR} SELECT DISTINCT pressure, round(100 * cume_dist() OVER (ORDER BY pressure), 6) AS at_or_below_pct FROM fr",
    "o11_union_all": f"WITH {PLAIN} SELECT CASE event_type WHEN 'Execution' THEN 'executions' ELSE 'orders' END AS file, count(*) AS n FROM ev GROUP BY 1",
    "o13_first_per_key": f"WITH {PLAIN} SELECT timestamp_ms, maker_uid, ingest_pos FROM (SELECT *, row_number() OVER (PARTITION BY timestamp_ms ORDER BY ingest_pos) AS i FROM ev WHERE event_type = 'Execution') WHERE i = 1",
    "v4_feature_quality": f"WITH {FR} {_vq('pressure', 0, 1e9)} UNION ALL {_vq('response', -1e300, 1e300)} UNION ALL {_vq('ratio', 0, 0.05)} UNION ALL {_vq('net', -0.4, 0.4)} UNION ALL {_vq('executed', -1e300, 1e300)}",
    "v6_window_checks": f"WITH {PLAIN}, {TK}, {GRID}, f AS ({over('tk', _w1)}) SELECT count(*) FILTER (bad) AS violations, count(*) AS checked FROM (SELECT coalesce(buy_taker_qty < lag(buy_taker_qty) OVER x, false) OR coalesce(sell_taker_qty < lag(sell_taker_qty) OVER x, false) OR coalesce(buy_taker_count < lag(buy_taker_count) OVER x, false) OR coalesce(ask_levels_consumed < lag(ask_levels_consumed) OVER x, false) AS bad FROM f WINDOW x AS (PARTITION BY anchor ORDER BY w))",
    "s10_time_bounds": f"WITH {PLAIN} SELECT symbol, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, count(*) AS n FROM ev GROUP BY 1",
    "w11_replenishment": f"WITH RECURSIVE {PLAIN}, {_lv}, {_rp}, {GRID.split(', ws AS')[0]}, ww AS (SELECT unnest({REFILL}) AS w), m AS (SELECT anchor, w, pr.*, row_number() OVER (PARTITION BY anchor, w, exec_ts ORDER BY side, price, exec_pos, add_ts) AS i FROM an CROSS JOIN ww JOIN pr ON exec_ts >= anchor - w AND exec_ts < anchor AND add_ts <= anchor AND delay_ms <= w) SELECT anchor, w, {r('sum(exec_qty) FILTER (i = 1)', 'total_exec_qty')}, {r('sum(refill_qty)', 'total_refill_qty')}, {r('max(refill_qty)', 'max_refill')}, {r('CAST(sum(refill_qty) AS DOUBLE) / CAST(sum(exec_qty) FILTER (i = 1) AS DOUBLE)', 'replenishment_ratio')}, count(*) AS refill_count FROM m GROUP BY 1, 2",
    "g6_distributions": f"WITH {FR}, u AS (SELECT symbol, label, unnest([struct_pack(f := 'FLOW', c := 'pressure', v := pressure), struct_pack(f := 'FLOW', c := 'executed', v := nullif(executed, 0.0)), struct_pack(f := 'RESPONSE', c := 'response', v := response), struct_pack(f := 'RESPONSE', c := 'net', v := net), struct_pack(f := 'RATIO', c := 'ratio', v := ratio)], recursive := true) FROM fr) SELECT symbol, label, f AS family, c AS feature, count(v) AS n, round(100.0 * (count(*) - count(v)) / count(*), 1) AS nan_pct, round(avg(v), 4) AS mean, round(stddev_samp(v), 2) AS std, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in report.FAMILY_PERCENTS) + ", round(max(v), 6) AS max FROM u GROUP BY 1, 2, 3, 4",
    "s16_densities": f"WITH {FR} " + " UNION ALL ".join(f"SELECT * FROM (WITH e AS (SELECT symbol, label, quantile_cont({c}, 0.01) AS a, quantile_cont({c}, 0.99) AS b FROM fr GROUP BY 1, 2), h AS (SELECT symbol, label, a, (b - a) / {n} AS w, CAST(least(floor(({c} - a) / ((b - a) / {n})), {n - 1}) AS INT) AS bin FROM fr JOIN e USING (symbol, label) WHERE {c} BETWEEN a AND b), g AS (SELECT symbol, label, a, w, bin, count(*) AS n FROM h GROUP BY ALL) SELECT symbol, label, '{c}' AS feature, bin, n, round(a + bin * w, 4) AS left_edge, round(n / (sum(n) OVER (PARTITION BY symbol, label) * w), 9) AS density FROM g)" for c, n in (("pressure", 30), ("response", 50), ("ratio", 60))),
    "s16_log_pairs": f"WITH {FR}, l AS (SELECT symbol, label, ln(1 + greatest(pressure, 0)) AS a, ln(1 + greatest(response, 0)) AS b FROM fr), m AS (SELECT symbol, label, max(a) AS ma, max(b) AS mb FROM l GROUP BY 1, 2) SELECT symbol, label, CAST(least(floor(a / ma * 8), 7) AS INT) AS x_bin, CAST(least(floor(b / mb * 8), 7) AS INT) AS y_bin, count(*) AS n FROM l JOIN m USING (symbol, label) GROUP BY 1, 2, 3, 4",
    "v9_distribution_status": f"WITH {FR}, c AS (SELECT symbol, label, " + ", ".join(f"count({c}) AS {c}" for c in ("pressure", "executed", "response", "net", "ratio")) + " FROM fr GROUP BY 1, 2) " + " UNION ALL ".join(f"SELECT symbol, label, '{f}' AS family, '{c}' AS feature, {c if c not in ('absent', 'nothing') else 0} AS n, {f"CASE WHEN {c} = 0 THEN 'ALL_NAN' ELSE 'ok' END" if c not in ("absent", "nothing") else "'MISSING'" if c == "absent" else "'ALL_NAN'"} AS status FROM c" for f, columns in (FAMILIES | {"NONE": ["nothing"]}).items() for c in columns),
    "v9_inventory": f"WITH {FR} SELECT symbol, count(*) AS n_rows, 9 AS n_columns, max(label) AS data_version FROM fr GROUP BY 1",
    "o7_candidates": _kinds + ") SELECT symbol, label, kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum(ts) AS sum_ts FROM k GROUP BY 1, 2, 3",
    "o7_episodes": _kinds + ") SELECT kind, CAST(i AS INT) AS i, ts, symbol, label FROM (SELECT *, row_number() OVER (PARTITION BY symbol, label, kind ORDER BY md5('42:' || ts), ts) AS i FROM k) WHERE i <= 3",
    "o6_sample": f"WITH {FR} SELECT ts, symbol, label FROM fr ORDER BY md5('42:' || ts), ts LIMIT 20",
    "s17_content_hash": f"WITH {PLAIN}, h AS (SELECT md5({_fields}) AS h FROM ev) SELECT count(*) AS rows, " + " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(4)) + " AS content_hash FROM h",
}
