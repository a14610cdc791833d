"""Queries of the quality gates, over the demo stream and over lineitem as a feature table; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atoms, book, levels, lifecycle, windows
from ..sources import demo
from . import gates
from .book_queries import HORIZON, KNOWN, WATCHED, XREC, _cls, _lv, _rp, intervals, zones
from .flow_queries import GRID, PLAIN, STEP, TK, s

RESEARCH, KEYS = 28_420_000, ["symbol", "label"]


def v1_download_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines against their own span, against a longer one, and with ids that repeat."""
    e = demo.events(spark, sf_dir)
    x = e.where("event_type = 'Execution'")
    lines = lambda uid: e.where("event_type <> 'Execution'").select(uid.cast("string").alias("uid"), F.col("timestamp_ms").alias("timestamp"), "ingest_pos")
    lo, hi = e.agg(F.min("timestamp_ms"), F.max("timestamp_ms")).collect()[0]
    cases = {"own": (F.col("ingest_pos"), lo, hi), "longer": (F.col("ingest_pos"), lo, hi + 10**6), "repeats": (F.col("order_uid"), lo, hi)}
    parts = [gates.download_truth(lines(uid), x, a, b).withColumn("case", F.lit(name)) for name, (uid, a, b) in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("reason")


def v2_market_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = gates.market_truth(demo.events(spark, sf_dir, True), RESEARCH, 500, RESEARCH - WATCHED)
    return m.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c.startswith(("comp_", "maker_", "taker_")) else F.col(c) for c in m.columns])


def b8_crossed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters over the stream whose books cross, with crossed and locked books."""
    e = demo.events(spark, sf_dir, True)
    return lifecycle.counters(lifecycle.transitions(e), e, book.batches_best(intervals(e), e, 500))


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem under names that the rules look for: some values out of range, a column of one value, one mostly missing, one that has to be empty."""
    c = lambda x: F.col(x).cast("double")
    n = F.col("l_linenumber")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("label"), (F.col("l_orderkey") * 10 + F.floor(n / 3)).alias("timestamp_ms"), ((c("l_tax") - 0.04) * 26).alias("afi_1s"), (c("l_discount") * 10.5).alias("activity_percentile"), (c("l_quantity") - 3).alias("spread"), c("l_extendedprice").alias("depth_bid_10bps"), F.when(n > 1, F.lit(None)).otherwise(c("l_quantity")).alias("buy_taker_qty_1s"), F.lit(7.0).alias("flat"), F.lit(None).cast("double").alias("context_120m"), F.when(n <= 3, "not_ready").otherwise("NORMAL").alias("regime_state"))


def v4_feature_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.feature_gate(table(spark, sf_dir), KEYS, 10, 60_000, 20)


def v5_range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.range_report(table(spark, sf_dir), KEYS)


SHORT = [f"{w}m" for w in (60, 120, 360)]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow, imbalance, accelerations and mid moves at every anchor."""
    e, ws = demo.events(spark, sf_dir), [60, 120, 360]
    grid = demo.anchors(e)
    flow = windows.aggressive_flow(atoms.taker(e), grid, ws, STEP)
    accel = windows.acceleration(flow, [(60, 120), (120, 360)])
    named = lambda c: F.col(c).cast("double")
    flow = flow.select("symbol", "anchor", *[named(f"{n}_{w}").alias(f"{n}_{w}m") for w in ws for n in ("buy_taker_qty", "sell_taker_qty", "afi")])
    accel = accel.select("symbol", "anchor", *[named(f"{q}_flow_accel_{a}_{b}").alias(f"{q}_flow_accel_{b}m") for q in ("buy", "sell") for a, b in ((60, 120), (120, 360))])
    return flow.join(accel, ["symbol", "anchor"])


def v6_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.sanity(features(spark, sf_dir), ["symbol"], SHORT)


def v6_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.causality(levels.refill_pairs(lifecycle.level_changes(demo.events(spark, sf_dir)), HORIZON))


LENGTH, PROBE, PERCENTS = 1_440, 240, {"LOW": 15, "MEDIAN": 50, "HIGH": 92}


def v7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.selected_sessions(gates.session_candidates(demo.events(spark, sf_dir), LENGTH, PROBE, 60), PERCENTS, LENGTH, LENGTH)


def v8_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.events(spark, sf_dir).select(F.col("timestamp_ms").alias("timestamp"), "ingest_pos", "event_type")
    lo, hi = e.agg(F.min("timestamp"), F.max("timestamp")).collect()[0]
    return gates.manifest(e.where("event_type <> 'Execution'"), "orders", lo, hi).unionByName(gates.manifest(e.where("event_type = 'Execution'"), "executions", lo, hi + 10**6))


def v9_anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of the largest values; the hashed one has no SQL."""
    f = features(spark, sf_dir).withColumnRenamed("anchor", "timestamp_ms")
    g = gates.anchor_groups(f, {"top5_buy_flow": "buy_taker_qty_60m", "top5_sell_flow": "sell_taker_qty_60m"})
    return g.where("group <> 'random_20'").select("group", "timestamp_ms", F.round("buy_taker_qty_60m", 6).alias("buy"), F.round("sell_taker_qty_60m", 6).alias("sell"))


QUERIES = [v1_download_truth, v2_market_truth, b8_crossed_counters, v4_feature_gate, v5_range_rules, v6_sanity, v6_causality, v7_sessions, v8_manifest, v9_anchor_groups]

_case = lambda name, uid, late: f"""SELECT '{name}' AS "case", (SELECT count(*) FROM o) AS ord_rows, (SELECT count(*) FROM ev WHERE event_type = 'Execution') AS exc_rows, f.ts AS first_ts, l.ts AS last_ts, (SELECT count(*) - count(DISTINCT {uid}) FROM o) AS dup_event_uid, k.k AS ts_order, k.k <> 'mixed' AS ts_monotonic, (SELECT round(sum(c) FILTER (c > 1) / sum(c), 4) FROM m) AS same_ms_share, (SELECT max(c) FROM m) AS max_events_same_ms, CASE WHEN greatest(f.ts, l.ts) < (SELECT max(ts) FROM a) + {late} - 300000 OR least(f.ts, l.ts) > (SELECT min(ts) FROM a) + 300000 OR (SELECT count(*) - count(DISTINCT {uid}) FROM o) > 0 OR k.k = 'mixed' THEN 'FAIL' ELSE 'PASS' END AS verdict FROM f, l, k"""
_odd = ("unknown_update", "unknown_cancel", "unknown_exec_maker", "unknown_exec_taker", "duplicate_active_uid", "negative_qty")
_counted = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in _odd) + ", (SELECT count(*) FROM (SELECT timestamp_ms FROM ev GROUP BY 1 HAVING count(*) > 1)) AS n_ambiguous_ms, (SELECT count(*) FROM cr WHERE cross_width > 0) AS crossed_book, (SELECT count(*) FROM cr WHERE cross_width = 0) AS locked_book"
_link = lambda q: f"(SELECT round(round(100.0 * count(*) FILTER (u IN (SELECT order_uid FROM ev WHERE order_uid IS NOT NULL)) / count(*), 2), 6) FROM (SELECT DISTINCT {q}_uid AS u FROM ev WHERE {q}_uid IS NOT NULL)) AS {q}_link_pct"
_bb, _ba = "max(price) FILTER (side = 'buy' AND price > 0)", "min(price) FILTER (side = 'sell' AND price > 0)"
_zones = zones(RESEARCH - WATCHED)
_comp = ", ".join(f"(SELECT {KNOWN} FROM zz WHERE side = '{q}' AND zone = '{z}') AS comp_{n}_{z}" for z in ("L1", "L5", "L10", "10bps", "25bps") for n, q in (("bid", "buy"), ("ask", "sell")))
_low = "concat_ws(', ', " + ", ".join(f"CASE WHEN (SELECT {KNOWN} FROM zz WHERE side = '{q}' AND zone = 'L1' AND total_qty > 0) < 99.9 THEN '{n}_L1' END" for n, q in (("bid", "buy"), ("ask", "sell"))) + ")"
TB = "tb AS (SELECT l_returnflag AS symbol, l_linestatus AS label, l_orderkey * 10 + l_linenumber // 3 AS timestamp_ms, (CAST(l_tax AS DOUBLE) - 0.04) * 26 AS afi_1s, CAST(l_discount AS DOUBLE) * 10.5 AS activity_percentile, CAST(l_quantity AS DOUBLE) - 3 AS spread, CAST(l_extendedprice AS DOUBLE) AS depth_bid_10bps, CASE WHEN l_linenumber > 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS buy_taker_qty_1s, 7.0::DOUBLE AS flat, CAST(NULL AS DOUBLE) AS context_120m, CASE WHEN l_linenumber <= 3 THEN 'not_ready' ELSE 'NORMAL' END AS regime_state FROM lineitem)"
COLUMNS = ["timestamp_ms", "afi_1s", "activity_percentile", "spread", "depth_bid_10bps", "buy_taker_qty_1s", "flat", "context_120m"]


def _broken(part: str, lo: float | None, hi: float | None) -> str:
    """What breaks a rule, as text."""
    terms = []
    for c in (c for c in COLUMNS if part in c):
        ends = [(f"<{lo}", f"{c} < {lo} - 1e-9")] * (lo is not None) + [(f">{hi}", f"{c} > {hi} + 1e-9")] * (hi is not None)
        terms += [f"CASE WHEN count(*) FILTER ({t}) > 0 THEN '{c}{name}:' || count(*) FILTER ({t}) END" for name, t in ends]
    return f"concat_ws('; ', {', '.join(terms)})" if terms else "''"


_missing = {c: f"count(*) FILTER ({c} IS NULL)" for c in COLUMNS}
_listed = lambda test: "[x FOR x IN [" + ", ".join(f"CASE WHEN {test(c)} THEN '{c}' END" for c in COLUMNS) + "] IF x IS NOT NULL]"
_high = _listed(lambda c: f"{_missing[c]} * 2 > count(*)" if "30m" not in c and "120m" not in c else "false")
_flat = _listed(lambda c: f"coalesce(min({c}) = max({c}), true) AND count({c}) > 10")
_ranges = "concat_ws('; ', " + ", ".join(f"CASE WHEN {_broken(*rule)} <> '' THEN '{rule[0]}: ' || {_broken(*rule)} END" for rule in gates.RANGES) + ")"
_flows = ", ".join(f"CAST({s('qty', f"aggressor = '{q}' AND ts > anchor - {w}")} AS DOUBLE) AS {q}_{w}" for q in ("buy", "sell") for w in (60, 120, 360))
FE = f"f0 AS (SELECT anchor, {_flows} FROM an LEFT JOIN tk x ON x.ts > anchor - 360 AND x.ts <= anchor GROUP BY anchor), fe AS (SELECT *, " + ", ".join(f"(buy_{w} - sell_{w}) / (buy_{w} + sell_{w} + 1e-12) AS afi_{w}" for w in (60, 120, 360)) + " FROM f0)"
_check = lambda section, name, about, bad: f"SELECT 'SYN' AS symbol, '{section}' AS section, '{name}' AS \"check\", count(*) FILTER ({about}) AS checked, count(*) FILTER (({about}) AND ({bad})) AS bad, count(*) FILTER (({about}) AND ({bad})) = 0 AS ok FROM fe"
_checks = [c for w in (60, 120, 360) for c in (
    _check("signs", f"strong sellers: afi_{w}m < 0", f"sell_{w} > 5 * buy_{w} + 1e-6", f"afi_{w} >= 0"), _check("signs", f"strong buyers: afi_{w}m > 0", f"buy_{w} > 5 * sell_{w} + 1e-6", f"afi_{w} <= 0"),
    _check("signs", f"sellers alone: afi_{w}m is -1", f"buy_{w} = 0 AND sell_{w} > 0", f"afi_{w} > -0.999999"), _check("signs", f"buyers alone: afi_{w}m is 1", f"sell_{w} = 0 AND buy_{w} > 0", f"afi_{w} < 0.999999"),
)]
_checks += [_check("ratios", f"{q}_flow_accel_{b}m below 1e6", f"{q}_{b} - {q}_{a} >= 1e-8", f"{q}_{a} / ({q}_{b} - {q}_{a} + 1e-12) > 1e6") for a, b in ((60, 120), (120, 360)) for q in ("buy", "sell")]
_checks += [_check("windows", f"{q}_taker_qty: {a}m within {b}m", "true", f"{q}_{b} < {q}_{a} - 1e-9") for q in ("buy", "sell") for a, b in ((60, 120), (120, 360))]
_checks += [_check("acceleration", f"{q}_flow_accel_{b}m by its formula", f"{q}_{b} - {q}_{a} > 1e-8", "false") for a, b in ((60, 120), (120, 360)) for q in ("buy", "sell")]
_checks.append(_check("ratios", "no infinite value", "true", "false"))
_top = lambda group, c: f"(SELECT '{group}' AS \"group\", anchor AS timestamp_ms, round(buy_60, 6) AS buy, round(sell_60, 6) AS sell FROM fe ORDER BY {c} DESC, anchor LIMIT 5)"

ORACLE = {
    "v1_download_truth": f"WITH {PLAIN}, a AS (SELECT timestamp_ms AS ts FROM ev), o AS (SELECT order_uid, ingest_pos, timestamp_ms AS ts FROM ev WHERE event_type <> 'Execution'), f AS (SELECT ts FROM o ORDER BY ingest_pos LIMIT 1), l AS (SELECT ts FROM o ORDER BY ingest_pos DESC LIMIT 1), m AS (SELECT ts, count(*) AS c FROM o GROUP BY 1), d AS (SELECT ts - lag(ts) OVER (ORDER BY ingest_pos) AS d FROM o), k AS (SELECT CASE WHEN coalesce(min(d), 0) >= 0 THEN 'asc' WHEN max(d) <= 0 THEN 'desc' ELSE 'mixed' END AS k FROM d) {_case('own', 'ingest_pos', 0)} UNION ALL {_case('longer', 'ingest_pos', 10**6)} UNION ALL {_case('repeats', 'order_uid', 0)}",
    "v2_market_truth": f"{XREC}, {_cls}, lv AS (SELECT * FROM sp WHERE from_ts <= {RESEARCH - 1} AND (to_ts IS NULL OR to_ts > {RESEARCH - 1})), md AS (SELECT ({_bb} + {_ba}) / 2 AS mid FROM lv), lz AS (SELECT lv.*, mid, dense_rank() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END) AS k FROM lv, md WHERE price > 0), zz AS ({_zones}), cn AS (SELECT {_counted} FROM f), ks AS (SELECT count(*) FILTER (classification = 'CROSS_STREAM_TS_AMBIGUITY') AS explained, count(*) FILTER (classification = 'UNEXPLAINED') AS unexplained, count(*) FILTER (persistent AND classification <> 'LOCKED_MARKET') AS persisting FROM cl), rs AS (SELECT concat_ws('; ', CASE WHEN negative_qty > 0 THEN 'negative_qty=' || negative_qty END, CASE WHEN duplicate_active_uid > 0 THEN 'duplicate_active_uid=' || duplicate_active_uid END, CASE WHEN unexplained > 0 THEN 'unexplained=' || unexplained END, CASE WHEN persisting > 0 THEN 'persisting=' || persisting END) AS t FROM cn, ks), lo AS (SELECT {_low} AS b) SELECT 'SYN' AS symbol, (SELECT count(*) FROM ev WHERE timestamp_ms < {RESEARCH}) AS warmup_events, (SELECT count(*) FROM ev WHERE timestamp_ms >= {RESEARCH}) AS research_events, {_comp}, cn.*, ks.*, (SELECT count(*) FROM sp WHERE to_ts IS NULL) AS n_active_final, (SELECT count(*) FROM ev WHERE event_type = 'Execution') AS n_executions, {_link('maker')}, {_link('taker')}, CASE WHEN b <> '' THEN 'known below 99.9%: ' || b ELSE nullif(t, '') END AS reason, CASE WHEN t = '' AND b = '' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM cn, ks, rs, lo",
    "b8_crossed_counters": f"{XREC}, {_cls.split(', xu AS')[0]} SELECT 'SYN' AS symbol, {_counted} FROM f",
    "v4_feature_gate": f"WITH {TB}, g AS (SELECT symbol, label, count(*) AS n_rows, 11 AS n_cols, count(*) = 3600 AS rows_ok, min(timestamp_ms) AS first_ts, max(timestamp_ms) AS last_ts, abs(min(timestamp_ms) - 10) <= 20 AS first_ts_ok, abs(max(timestamp_ms) - 60000) <= 20 AS last_ts_ok, count(*) - count(DISTINCT timestamp_ms) AS dup_ts, round(({' + '.join(_missing.values())}) / (count(*) * {len(COLUMNS)}.0), 4) AS nan_share, CAST(0 AS BIGINT) AS inf_count, {len(COLUMNS)} AS n_num_cols, len({_high}) AS high_nan_cols, array_to_string({_high}[1:5], '; ') AS high_nan_examples, round(count(*) FILTER (regime_state = 'not_ready') / count(*), 3) AS regime_not_ready_share, {_ranges} AS range_violations, len({_flat}) AS constant_cols, array_to_string({_flat}[1:5], '; ') AS constant_examples, count(context_120m) = 0 AS context_120m_all_nan FROM tb GROUP BY 1, 2) SELECT *, regime_not_ready_share BETWEEN 0.4 AND 0.6 AS regime_not_ready_ok, CASE WHEN NOT rows_ok OR dup_ts > 0 OR range_violations <> '' OR NOT context_120m_all_nan THEN 'FAIL' ELSE 'PASS' END AS verdict FROM g",
    "v5_range_rules": f"WITH {TB} " + " UNION ALL ".join(f"SELECT symbol, label, '{rule[0]}' AS rule, {sum(rule[0] in c for c in COLUMNS)} AS checked, {_broken(*rule)} AS violations FROM tb GROUP BY 1, 2" for rule in gates.RANGES),
    "v6_sanity": f"WITH {PLAIN}, {TK}, {GRID}, {FE} " + " UNION ALL ".join(_checks),
    "v6_causality": f"WITH RECURSIVE {PLAIN}, {_lv}, {_rp} SELECT 'SYN' AS symbol, count(*) AS checked, count(*) FILTER (exec_ts >= add_ts) AS bad_order, count(*) FILTER (delay_ms <= 0) AS bad_delay FROM pr",
    "v7_sessions": f"WITH {PLAIN}, n AS (SELECT timestamp_ms - timestamp_ms % {LENGTH} AS start, count(*) FILTER (timestamp_ms % {LENGTH} < {PROBE}) AS probe_events FROM ev GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(start) FROM n), (SELECT max(start) FROM n), {LENGTH})) AS start), c AS (SELECT start, coalesce(probe_events, 0) AS probe_events, round(coalesce(probe_events, 0) / ({PROBE} / 60.0), 1) AS eps FROM g LEFT JOIN n USING (start)), p AS (SELECT *, round(100 * cume_dist() OVER (ORDER BY eps), 1) AS pctl FROM c), b AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {i} AS i, (SELECT start FROM c ORDER BY abs(eps - (SELECT quantile_cont(eps, {p / 100}) FROM c)), start LIMIT 1) AS start" for i, (n, p) in enumerate(PERCENTS.items())) + f") SELECT p.*, coalesce((SELECT name FROM b WHERE b.start = p.start ORDER BY i DESC LIMIT 1), '') AS selected, start - {LENGTH} AS warmup_start, start + {LENGTH} AS research_end FROM p",
    "v8_manifest": f"WITH {PLAIN}, b AS (SELECT min(timestamp_ms) AS lo, max(timestamp_ms) AS hi FROM ev) " + " UNION ALL ".join(f"SELECT '{n}' AS stream, lo AS requested_since_ms, hi + {late} AS requested_before_ms, (SELECT timestamp_ms FROM ev WHERE {c} ORDER BY ingest_pos LIMIT 1) AS first_ts, (SELECT timestamp_ms FROM ev WHERE {c} ORDER BY ingest_pos DESC LIMIT 1) AS last_ts, 'COMPLETE_LEGACY_VERIFIED' AS status FROM b" for n, c, late in (("orders", "event_type <> 'Execution'", 0), ("executions", "event_type = 'Execution'", 10**6))),
    "v9_anchor_groups": f"WITH {PLAIN}, {TK}, {GRID}, {FE} {_top('top5_buy_flow', 'buy_60')} UNION ALL {_top('top5_sell_flow', 'sell_60')}",
}
