"""The causal feature table: every family on one anchor grid, under fixed names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atoms, book, levels, lifecycle, windows
from ..sources import canonical, demo
from ..sources.shared import bucketed, stored
from .book_queries import FOLD, HORIZON, LV, _legs, _rp, _ser, _series
from .flow_queries import AGGRESSIVE, GRID, OLD, PASSIVE, REGIME, REPRICE, TK, d, r, s

LABELS = ["100ms", "250ms", "500ms", "1s", "2s", "5s", "10s", "30s", "60s", "300s"]
MILLIS = [100, 250, 500, 1_000, 2_000, 5_000, 10_000, 30_000, 60_000, 300_000]
RESPONSE, REFILL, ACCEL = LABELS[:7], ["100ms", "500ms", "1s", "5s"], [("500ms", "1s"), ("1s", "2s"), ("2s", "5s"), ("5s", "10s")]
SUMMARY = ["n_levels", "total_qty", "max_qty", "p50_qty", "p75_qty", "p90_qty", "p95_qty", "max_qty_vs_median", "p95_qty_vs_median", "n_above_3x_median", "n_above_5x_median", "max_share", "top1_dist_ticks", "top1_dist_bps"]
ACTIVITY = [f"activity_{x}_{c}" for x in ("vs_trailing_median", "robust_z", "rolling_percentile") for c in ("5m", "30m")]
BOOK = ["best_bid", "best_ask", "spread", "mid", "n_active", *[f"{x}_{n}bps" for n in (5, 10, 25) for x in ("depth_bid", "depth_ask", "obi")], "near_book_depth"]
PRICE = ["signed_mid_change", "ticks_moved", "levels_crossed", *[f"{a}_per_{s}_{u}" for a, u in (("price_response", "qty"), ("ticks", "notional"), ("levels", "qty")) for s in ("buy", "sell")]]
PROVENANCE = {"source_session": "demo", "data_version": "1", "feature_version": "1", "book_semantics_version": "1"}


def build(events: DataFrame, grid: DataFrame, sizes: list[int] = MILLIS, step: int = 1_000, tick: float = 1.0, label: str = "LOW", contexts: tuple[int, int] = (300, 1_800)) -> DataFrame:
    """One row per symbol and anchor with 615 columns; sizes are the windows behind LABELS, contexts the anchors in five and thirty minutes. Families are written in buckets of (symbol, anchor), so that no exchange joins them."""
    of = dict(zip(LABELS, sizes))
    events, grid = stored(events), stored(grid)
    moved = stored(atoms.with_old(events, canonical.priority))
    taker = atoms.taker(events)
    spans = lifecycle.book_intervals(events)
    series = stored(book.series(spans, grid, step))
    seen = series.withColumnRenamed("anchor", "ts")
    named = lambda df, names, labels: df.selectExpr("symbol", "anchor", *[f"cast(`{n}_{of[w]}` AS double) AS `{n}_{w}`" for w in labels for n in names])
    flow = stored(windows.aggressive_flow(taker, grid, sizes, step))
    counts = stored(windows.regime_counts(events, grid, sizes, step))
    base = windows.relative_activity(counts, f"order_event_count_{of['1s']}", {"5m": contexts[0], "30m": contexts[1]})
    activity = base.select("symbol", "anchor", *ACTIVITY, F.col("activity_rolling_percentile_30m").alias("regime_percentile"), windows.regime_label(F.col("activity_rolling_percentile_30m")).alias("regime_state"))
    response = windows.price_response(seen.select("symbol", "ts", "mid"), flow, grid, [of[w] for w in RESPONSE], tick)
    level_atoms = stored(lifecycle.level_atoms(events))
    summary = levels.summary(level_atoms, grid, series, step, tick)
    sides = summary.groupBy("symbol", "anchor").agg(*[F.max(F.when(F.col("side") == k, F.col(c))).cast("double").alias(f"{s}_{c}") for s, k in (("bid", "buy"), ("ask", "sell")) for c in SUMMARY])
    refill = levels.refills(level_atoms, grid, max(10 * step, of["10s"]), [of[w] for w in REFILL], step)
    refill_names = ["total_exec_qty", "total_refill_qty", "replenishment_ratio", "refill_count"]
    refill = refill.groupBy("symbol", "anchor").agg(*[F.coalesce(F.max(F.when(F.col("w") == of[w], F.col(n))).cast("double"), F.lit(0.0)).alias(f"{n}_{w}") for w in REFILL for n in refill_names])
    accel = windows.acceleration(flow, [(of[a], of[b]) for a, b in ACCEL])
    accel = accel.select("symbol", "anchor", *[F.col(f"{s}_flow_accel_{of[a]}_{of[b]}").alias(f"{s}_flow_accel_{b}") for a, b in ACCEL for s in ("buy", "sell")])
    families = [
        named(counts, [*REGIME, "notional_per_sec"], LABELS), named(windows.bbo_changes(seen, grid, sizes, step), ["bbo_change_count"], LABELS), activity, named(flow, AGGRESSIVE, LABELS), named(windows.passive_flow(atoms.passive(moved), grid, sizes, step), PASSIVE, LABELS),
        named(windows.reprice_flow(atoms.reprice(moved), grid, sizes, step), REPRICE, LABELS), named(response, PRICE, RESPONSE),
        series.select("symbol", "anchor", *[F.col(c).cast("double").alias(c) for c in BOOK]), sides, refill, accel,
    ]
    out = bucketed(grid, "symbol", "anchor")
    for f in families:
        out = out.join(bucketed(f, "symbol", "anchor"), ["symbol", "anchor"], "left")
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in refill.columns[2:]}
    out = out.withColumns(filled)
    return out.select(F.col("anchor").alias("timestamp_ms"), *[c for c in out.columns if c not in ("symbol", "anchor")], "symbol", F.lit(label).alias("session_label"), *[F.lit(v).alias(k) for k, v in PROVENANCE.items()])


def j3_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo stream's feature table: a second of the names is one anchor step of sixty units."""
    e = demo.events(spark, sf_dir)
    return build(e, demo.anchors(e), [6, 15, 30, 60, 120, 300, 600, 1_800, 3_600, 18_000], 60, demo.TICK, contexts=(24, 168))


CORE = ["order_event_count_1s", "execution_qty_1s", "unique_order_uids_1s", "levels_touched_1s", "notional_per_sec_1s", "bbo_change_count_1s", "buy_taker_qty_1s", "sell_taker_count_1s", "afi_1s", "ask_levels_consumed_1s", "sell_notional_10s", "bid_add_qty_1s", "ask_net_passive_1s", "bid_reprice_net_1s", "ask_reprice_away_qty_1s", "signed_mid_change_1s", "ticks_moved_1s", "ticks_per_buy_notional_1s", "best_bid", "spread", "mid", "depth_bid_10bps", "near_book_depth", "n_active", "bid_n_levels", "ask_max_qty", "total_exec_qty_1s", "total_refill_qty_1s", "replenishment_ratio_1s", "refill_count_1s", "buy_flow_accel_1s"]


def j3_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every family of the feature table, which has the whole plan run."""
    return j3_feature_table(spark, sf_dir).select("timestamp_ms", *d(*CORE))


_at = lambda name, source, cols, w=60: f"{name} AS (SELECT anchor, {', '.join(cols)} FROM an LEFT JOIN {source} x ON x.ts > anchor - {w} AND x.ts <= anchor GROUP BY anchor)"
_double = lambda v, c, name: f"CAST({s(v, c)} AS DOUBLE) AS {name}"
_parts = [
    _at("ca", "(SELECT *, timestamp_ms AS ts FROM ev)", ["count(ts) AS order_event_count_1s", "CAST(coalesce(sum(execution_qty), 0) AS DOUBLE) AS execution_qty_1s", "count(DISTINCT order_uid) AS unique_order_uids_1s", "count(DISTINCT price) AS levels_touched_1s", "coalesce(sum(CAST(execution_qty AS DOUBLE) * execution_price), 0) / 0.06 AS notional_per_sec_1s"]),
    "bb AS (SELECT anchor AS ts, CAST(mid IS NULL OR mid IS DISTINCT FROM lag(mid) OVER (ORDER BY anchor) AS INT) AS c FROM bx)",
    _at("cb", "bb", ["coalesce(sum(c), 0) AS bbo_change_count_1s"]),
    _at("cc", "tk", [_double("qty", "aggressor = 'buy'", "buy_taker_qty_1s"), _double("qty", "aggressor = 'sell'", "sq"), "count(ts) FILTER (aggressor = 'sell') AS sell_taker_count_1s", "count(DISTINCT price) FILTER (aggressor = 'buy') AS ask_levels_consumed_1s", _double("notional", "aggressor = 'buy'", "bn"), _double("qty", "aggressor = 'buy' AND x.ts > anchor - 30", "b30")]),
    _at("cd", "tk", [_double("notional", "aggressor = 'sell'", "sell_notional_10s")], 600),
    _at("ce", "pa", [_double("qty", "book_side = 'bid' AND action = 'add'", "bid_add_qty_1s"), _double("CASE action WHEN 'add' THEN qty ELSE -qty END", "book_side = 'ask'", "ask_net_passive_1s")]),
    _at("cf", "rp", [_double("CASE action WHEN 'reprice_in' THEN qty ELSE -qty END", "book_side = 'bid'", "bid_reprice_net_1s"), _double("qty", "book_side = 'ask' AND action = 'reprice_out' AND direction = 'away'", "ask_reprice_away_qty_1s")]),
    "cg AS (SELECT b.*, b.mid - p.mid AS signed_mid_change_1s FROM bx b LEFT JOIN bx p ON p.anchor = b.anchor - 60)",
    "ls AS (SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY side, price ORDER BY i) AS nt FROM la) WHERE (nt IS NULL OR nt > ts) AND level_qty > 0)",
    "ch AS (SELECT anchor, count(*) FILTER (side = 'buy') AS nl, max(level_qty) FILTER (side = 'sell') AS ask_max_qty FROM an JOIN ls ON ts <= anchor AND (nt IS NULL OR nt > anchor) GROUP BY anchor)",
    "m AS (SELECT anchor, pr.*, row_number() OVER (PARTITION BY anchor, exec_ts ORDER BY side, price, exec_pos, add_ts) AS i FROM an JOIN pr ON exec_ts >= anchor - 60 AND exec_ts < anchor AND add_ts <= anchor AND delay_ms <= 60)",
    "ci AS (SELECT anchor, CAST(sum(exec_qty) FILTER (i = 1) AS DOUBLE) AS xq, CAST(sum(refill_qty) AS DOUBLE) AS rq, count(*) AS rc FROM m GROUP BY anchor)",
]
_values = {"afi_1s": "(buy_taker_qty_1s - sq) / (buy_taker_qty_1s + sq + 1e-12)", "ticks_moved_1s": "abs(signed_mid_change_1s)", "ticks_per_buy_notional_1s": "CASE WHEN buy_taker_qty_1s >= 1e-8 THEN signed_mid_change_1s / (bn + 1e-12) END", "bid_n_levels": "nullif(nl, 0)", "total_exec_qty_1s": "coalesce(xq, 0)", "total_refill_qty_1s": "coalesce(rq, 0)", "refill_count_1s": "coalesce(rc, 0)", "replenishment_ratio_1s": "coalesce(rq / xq, 0)", "buy_flow_accel_1s": "CASE WHEN buy_taker_qty_1s - b30 >= 1e-8 THEN b30 / (buy_taker_qty_1s - b30 + 1e-12) END"}

QUERIES = [j3_feature_table, j3_core]
ORACLE = {"j3_core": f"WITH RECURSIVE {OLD}, {FOLD}, {LV[len(_legs) + 2 :]}, {_rp.replace(str(HORIZON), '600')}, {_series(GRID, (5, 10, 25))}, {_ser}, {TK}, {', '.join(_parts)} SELECT anchor AS timestamp_ms, {', '.join(r(_values.get(c, c), c) for c in CORE)} FROM an {' '.join(f'LEFT JOIN {t} USING (anchor)' for t in ('ca', 'cb', 'cc', 'cd', 'ce', 'cf', 'cg', 'ch', 'ci'))}"}
