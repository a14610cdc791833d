"""Queries over the demo stream: canonical events, atoms, buckets and windows; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atoms, windows
from ..sources import canonical, demo
from ..sources.shared import private_dir

STEP, WINDOWS = demo.STEP, demo.WINDOWS
BUCKET = 360


def d(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def stacked(wide: DataFrame, names: list[str], ws: list[int] = WINDOWS) -> DataFrame:
    """Columns name_W as rows (symbol, anchor, w, names)."""
    rows = ", ".join(f"named_struct('w', {w}, " + ", ".join(f"'{n}', round(cast(`{n}_{w}` AS double), 6)" for n in names) + ")" for w in ws)
    return wide.selectExpr("symbol", "anchor", f"inline(array({rows}))")


def with_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.with_old(demo.events(spark, sf_dir), canonical.priority)


def e1_canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.events(spark, sf_dir).select("symbol", "ingest_pos", "timestamp_ms", "event_type", "order_uid", "side", *d("price", "qty"), "maker_uid", "taker_uid", *d("execution_price", "execution_qty"), "n_events_same_ms", "ordering_ambiguous")


def s1_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream written as raw JSON lines, orders and executions apart, then read and flattened again."""
    e = with_old(spark, sf_dir)
    order = lambda qty, price: F.struct(F.col("order_uid").alias("uid"), F.initcap("side").alias("direction"), price.cast("string").alias("limitPrice"), qty.cast("string").alias("quantity"), F.lit("0").alias("filled"), F.col("order_type").alias("orderType"))
    one = F.struct(order(F.col("qty"), F.col("price")).alias("order"), F.lit("r").alias("reason"))
    two = F.struct(order(F.col("old_qty"), F.col("old_price")).alias("oldOrder"), order(F.col("qty"), F.col("price")).alias("newOrder"), F.lit("r").alias("reason"))
    made = F.struct(F.struct(F.struct(F.col("maker_uid").alias("uid")).alias("makerOrder"), F.struct(F.col("taker_uid").alias("uid"), F.initcap("aggressor").alias("direction")).alias("takerOrder"), F.col("execution_qty").cast("string").alias("quantity"), F.col("execution_price").cast("string").alias("price")).alias("execution"))
    t = F.col("event_type")
    body = F.coalesce(*[F.when(t == k, F.concat(F.lit(f'{{"{k}":'), F.to_json(v), F.lit("}"))) for k, v in (("OrderPlaced", one), ("OrderCancelled", one), ("OrderRejected", one), ("OrderUpdated", two), ("Execution", made))])
    line = F.concat(F.lit('{"uid":"'), F.col("ingest_pos"), F.lit('","timestamp":'), F.col("timestamp_ms"), F.lit(',"event":'), body, F.lit("}"))
    top = private_dir(spark, "lines")
    parts = {"orders": t != "Execution", "executions": t == "Execution"}
    for name, m in parts.items():
        e.where(m).select(line.alias("value")).write.text(f"{top}/{name}")
    c = canonical.canonical(*[canonical.read_jsonl(spark, f"{top}/{name}") for name in parts])
    return c.select("timestamp_ms", "event_type", F.col("event_uid").cast("long").alias("event_uid"), "order_uid", "side", *d("price", "qty", "old_qty", "old_price", "filled_qty"), "maker_uid", "taker_uid", *d("execution_price", "execution_qty"), "reason", "aggressor", "n_events_same_ms", "ordering_ambiguous")


def e5_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.events(spark, sf_dir).groupBy("event_type").agg(F.count_if("ordering_ambiguous").alias("ambiguous"), F.max("n_events_same_ms").alias("most_in_one_ms"), F.count(F.lit(1)).alias("n"))


def inner(e: DataFrame) -> DataFrame:
    """Events with the half-open span [since, before) that leaves out the first and the last eighth of the stream's time."""
    eighth = F.expr("(max(timestamp_ms) - min(timestamp_ms)) div 8")
    span = e.agg((F.min("timestamp_ms") + eighth).alias("since"), (F.max("timestamp_ms") - eighth).alias("before"))
    return e.crossJoin(F.broadcast(span))  # one row


def e7_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inner(demo.events(spark, sf_dir)).where("timestamp_ms >= since AND timestamp_ms < before")
    return e.groupBy(F.when(F.expr("timestamp_ms < (since + before) div 2"), "warmup").otherwise("research").alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))


def e9_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of each order, in any role."""
    e = demo.events(spark, sf_dir)
    roles = F.explode(F.array(*[F.struct(F.col(f"{r}_uid").alias("uid"), F.lit(r).alias("role")) for r in ("order", "maker", "taker")]))
    return e.select(roles.alias("x"), "timestamp_ms", "event_type").where("x.uid IS NOT NULL").groupBy("x.uid", "x.role").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), F.count_distinct("event_type").alias("kinds"))


def e10_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within 5 of each large execution: both sides meet in buckets of the width, so no pair is compared that is further than two of them."""
    e = demo.events(spark, sf_dir).select("symbol", "timestamp_ms", "ingest_pos", "event_type")
    x = demo.events(spark, sf_dir).where("execution_qty > 100").select("symbol", F.col("timestamp_ms").alias("at"), F.col("ingest_pos").alias("execution"), F.explode(F.array(*[(F.floor(F.col("timestamp_ms") / 11) + i).cast("long") for i in (-1, 0, 1)])).alias("b"))
    e = e.withColumn("b", F.floor(F.col("timestamp_ms") / 11).cast("long"))
    return x.join(e, ["symbol", "b"]).where(F.abs(F.col("timestamp_ms") - F.col("at")) <= 5).groupBy("execution").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "OrderPlaced").alias("placed"), F.count_if(F.col("timestamp_ms").between(F.col("at") + 1, F.col("at") + 3)).alias("soon_after"))


def a1_taker_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.taker(demo.events(spark, sf_dir)).select("ts", "ingest_pos", "taker_uid", "aggressor", "sign", *d("qty", "price", "notional"))


def p1_passive_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.passive(with_old(spark, sf_dir)).select("ts", "ingest_pos", "order_uid", "book_side", "action", *d("qty", "price"))


def p3_reprice_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.reprice(with_old(spark, sf_dir)).select("ts", "ingest_pos", "order_uid", "book_side", "action", *d("qty", "old_price", "new_price"), "direction")


def g1_flow_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.flow_taxonomy(demo.events(spark, sf_dir), None, None, BUCKET)


def g2_ofi_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms.ofi_atoms(demo.events(spark, sf_dir), None, None, BUCKET)


AGGRESSIVE = ["buy_taker_qty", "sell_taker_qty", "buy_taker_count", "sell_taker_count", "buy_notional", "sell_notional", "afi", "ask_levels_consumed", "bid_levels_consumed"]


def w1_aggressive_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.events(spark, sf_dir)
    return stacked(windows.aggressive_flow(atoms.taker(e), demo.anchors(e), WINDOWS, STEP), AGGRESSIVE)


PASSIVE = [f"{s}_{x}" for s in ("bid", "ask") for x in ("add_qty", "add_orders", "cancel_qty", "cancel_orders", "net_passive")]


def w2_passive_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_old(spark, sf_dir)
    return stacked(windows.passive_flow(atoms.passive(e), demo.anchors(e), WINDOWS, STEP), PASSIVE)


REPRICE = [f"{s}_reprice_{x}" for s in ("bid", "ask") for x in ("out_qty", "in_qty", "net", "away_qty", "toward_qty", "away_count", "toward_count")]


def w3_reprice_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_old(spark, sf_dir)
    return stacked(windows.reprice_flow(atoms.reprice(e), demo.anchors(e), WINDOWS, STEP), REPRICE)


REGIME = ["order_event_count", "placed_count", "cancel_count", "update_count", "execution_count", "execution_qty", "execution_notional", "unique_order_uids", "levels_touched", "events_per_sec", "trades_per_sec", "qty_per_sec"]


def w4_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.events(spark, sf_dir)
    return stacked(windows.regime_counts(e, demo.anchors(e), WINDOWS, STEP), REGIME)


def w7_relative_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.events(spark, sf_dir)
    base = windows.windowed(e.withColumnRenamed("timestamp_ms", "ts"), demo.anchors(e), {"order_event_count": F.lit(1)}, [60], STEP)
    out = windows.relative_activity(base, "order_event_count_60", {"day": 24, "week": 168})
    names = [f"activity_{x}_{c}" for x in ("vs_trailing_median", "robust_z", "rolling_percentile") for c in ("day", "week")]
    return out.select("symbol", "anchor", *d("order_event_count_60", *names), windows.regime_label(F.col("activity_rolling_percentile_week")).alias("regime_state"))


def w10_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.events(spark, sf_dir)
    pairs = [(15, 30), (30, 60), (60, 120), (120, 360)]
    out = windows.acceleration(windows.aggressive_flow(atoms.taker(e), demo.anchors(e), WINDOWS, STEP), pairs)
    return out.select("symbol", "anchor", *d(*[f"{s}_flow_accel_{a}_{b}" for a, b in pairs for s in ("buy", "sell")]))


def v1_stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, repeated ids and how events share timestamps."""
    e = demo.events(spark, sf_dir)
    return e.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), (F.count(F.lit(1)) - F.count_distinct("ingest_pos")).alias("repeated"), F.round(100 * F.count_if("ordering_ambiguous") / F.count(F.lit(1)), 4).alias("same_ms_pct"), F.max("n_events_same_ms").alias("most_in_one_ms"))


def j7_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of orders named by executions that the order events know."""
    e = demo.events(spark, sf_dir)
    used = e.select(F.explode(F.array("maker_uid", "taker_uid")).alias("uid")).where("uid IS NOT NULL").distinct()
    known = e.where("order_uid IS NOT NULL").select(F.col("order_uid").alias("uid")).distinct().withColumn("k", F.lit(1))
    return used.join(known, "uid", "left").agg(F.count(F.lit(1)).alias("n_uids"), F.count("k").alias("n_known"), F.round(100 * F.count("k") / F.count(F.lit(1)), 2).alias("known_pct"))


QUERIES = [e1_canonical_events, s1_json_lines, e5_ambiguity, e7_phases, e9_lifecycle, e10_neighbourhood, a1_taker_atoms, p1_passive_atoms, p3_reprice_atoms, g1_flow_taxonomy, g2_ofi_atoms, w1_aggressive_flow, w2_passive_flow, w3_reprice_flow, w4_regime, w7_relative_activity, w10_acceleration, v1_stream_quality, j7_linkage]

EV = """raw AS (SELECT event_id AS ingest_pos, CAST(floor(epoch_ms(ts) / 60000) AS BIGINT) AS timestamp_ms, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id, event_type AS et, CAST(value AS DECIMAL(18,2)) AS v FROM events),
raw2 AS (SELECT *, CASE WHEN et IN ('signup','view') THEN 'OrderPlaced' WHEN et = 'click' THEN 'OrderUpdated' WHEN et = 'purchase' THEN 'Execution' WHEN k % 10 = 0 THEN 'OrderRejected' ELSE 'OrderCancelled' END AS event_type, user_id % 2 = 0 AS isbuy, CAST(CASE WHEN {cross} user_id % 2 = 0 THEN 1000 - k % 20 ELSE 1001 + k % 20 END AS DOUBLE) AS p FROM raw),
ev AS (SELECT 'SYN' AS symbol, ingest_pos, timestamp_ms, event_type, CASE WHEN et <> 'purchase' THEN CAST(user_id * 4 + k % 4 AS VARCHAR) END AS order_uid, CASE WHEN et <> 'purchase' THEN CASE WHEN isbuy THEN 'buy' ELSE 'sell' END END AS side, CASE WHEN et <> 'purchase' THEN p END AS price, CASE WHEN et <> 'purchase' THEN v END AS qty,
 CASE WHEN et = 'purchase' THEN CAST(user_id * 4 + k % 4 AS VARCHAR) END AS maker_uid, CASE WHEN et = 'purchase' THEN CAST((user_id + 1) * 4 + k % 4 AS VARCHAR) END AS taker_uid, CASE WHEN et = 'purchase' THEN p END AS execution_price, CASE WHEN et = 'purchase' THEN v END AS execution_qty,
 CASE WHEN et <> 'purchase' THEN CASE WHEN k % 7 = 0 THEN 'Market' WHEN k % 2 = 0 THEN 'Post' ELSE 'Limit' END END AS order_type, CASE WHEN et = 'purchase' THEN CASE WHEN isbuy THEN 'sell' ELSE 'buy' END END AS aggressor,
 count(*) OVER (PARTITION BY timestamp_ms) AS n_events_same_ms, count(*) OVER (PARTITION BY timestamp_ms) > 1 AS ordering_ambiguous,
 CASE event_type WHEN 'OrderPlaced' THEN 0 WHEN 'OrderUpdated' THEN 1 WHEN 'Execution' THEN 2 ELSE 3 END AS prio FROM raw2)"""
PLAIN, CROSSED = EV.replace("{cross} ", ""), EV.replace("{cross}", "user_id % 2 = 0 AND k >= 98 THEN 1003 WHEN")
OLD = PLAIN + """, eo AS (SELECT *, CASE WHEN event_type IN ('OrderPlaced','OrderUpdated') THEN lag(qty) OVER w END AS old_qty, CASE WHEN event_type IN ('OrderPlaced','OrderUpdated') THEN lag(price) OVER w END AS old_price FROM ev WINDOW w AS (PARTITION BY order_uid, event_type IN ('OrderPlaced','OrderUpdated') ORDER BY timestamp_ms, prio, ingest_pos)),
pa AS (SELECT timestamp_ms AS ts, ingest_pos, order_uid, CASE side WHEN 'buy' THEN 'bid' ELSE 'ask' END AS book_side, CASE WHEN event_type = 'OrderPlaced' THEN 'add' WHEN event_type = 'OrderCancelled' THEN 'cancel' WHEN qty > old_qty THEN 'add' ELSE 'cancel' END AS action, CASE WHEN event_type = 'OrderUpdated' THEN abs(qty - old_qty) ELSE greatest(qty, 0) END AS qty, price FROM eo
 WHERE (event_type = 'OrderPlaced' AND order_type IN ('Post','Limit')) OR event_type = 'OrderCancelled' OR (event_type = 'OrderUpdated' AND (old_price IS NULL OR price = old_price) AND qty <> old_qty)),
rp AS (SELECT timestamp_ms AS ts, ingest_pos, order_uid, CASE side WHEN 'buy' THEN 'bid' ELSE 'ask' END AS book_side, a AS action, CASE a WHEN 'reprice_out' THEN old_qty ELSE qty END AS qty, old_price, price AS new_price, CASE WHEN (side = 'buy' AND price < old_price) OR (side = 'sell' AND price > old_price) THEN 'away' ELSE 'toward' END AS direction FROM eo, (VALUES ('reprice_out'), ('reprice_in')) t(a) WHERE event_type = 'OrderUpdated' AND price <> old_price)"""
GRID = f"""an AS (SELECT unnest(generate_series(CAST(ceil(min(timestamp_ms) / {STEP}.0) * {STEP} AS BIGINT), CAST(ceil(max(timestamp_ms) / {STEP}.0) * {STEP} AS BIGINT), {STEP})) AS anchor FROM ev), ws AS (SELECT unnest({WINDOWS}) AS w)"""
TK = "tk AS (SELECT timestamp_ms AS ts, ingest_pos, taker_uid, aggressor, CASE aggressor WHEN 'buy' THEN 1 ELSE -1 END AS sign, execution_qty AS qty, execution_price AS price, CAST(execution_qty AS DOUBLE) * execution_price AS notional FROM ev WHERE event_type = 'Execution')"


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


def over(source: str, cols: list[str]) -> str:
    return f"SELECT 'SYN' AS symbol, anchor, w, {', '.join(cols)} FROM an CROSS JOIN ws LEFT JOIN {source} x ON x.ts > anchor - w AND x.ts <= anchor GROUP BY anchor, w"


s = lambda v, c: f"coalesce(sum({v}) FILTER ({c}), 0)"
_flow = {q: (s("qty", f"aggressor = '{q}'"), f"count(ts) FILTER (aggressor = '{q}')", s("notional", f"aggressor = '{q}'")) for q in ("buy", "sell")}
_w1 = [r(_flow["buy"][0], "buy_taker_qty"), r(_flow["sell"][0], "sell_taker_qty"), r(_flow["buy"][1], "buy_taker_count"), r(_flow["sell"][1], "sell_taker_count"), r(_flow["buy"][2], "buy_notional"), r(_flow["sell"][2], "sell_notional"), r(f"(CAST({_flow['buy'][0]} AS DOUBLE) - CAST({_flow['sell'][0]} AS DOUBLE)) / (CAST({_flow['buy'][0]} AS DOUBLE) + CAST({_flow['sell'][0]} AS DOUBLE) + 1e-12)", "afi"), r("count(DISTINCT price) FILTER (aggressor = 'buy')", "ask_levels_consumed"), r("count(DISTINCT price) FILTER (aggressor = 'sell')", "bid_levels_consumed")]
_w2 = [x for b in ("bid", "ask") for x in (*[r(e, f"{b}_{n}") for a in ("add", "cancel") for e, n in ((s("qty", f"book_side = '{b}' AND action = '{a}'"), f"{a}_qty"), (f"count(ts) FILTER (book_side = '{b}' AND action = '{a}')", f"{a}_orders"))], r(f"{s('qty', f"book_side = '{b}' AND action = 'add'")} - {s('qty', f"book_side = '{b}' AND action = 'cancel'")}", f"{b}_net_passive"))]
_w3 = [x for b in ("bid", "ask") for x in (r(s("qty", f"book_side = '{b}' AND action = 'reprice_out'"), f"{b}_reprice_out_qty"), r(s("qty", f"book_side = '{b}' AND action = 'reprice_in'"), f"{b}_reprice_in_qty"), r(s("CASE action WHEN 'reprice_in' THEN qty ELSE -qty END", f"book_side = '{b}'"), f"{b}_reprice_net"), *[y for y_ in ("away", "toward") for y in (r(s("qty", f"book_side = '{b}' AND action = 'reprice_out' AND direction = '{y_}'"), f"{b}_reprice_{y_}_qty"), r(f"count(ts) FILTER (book_side = '{b}' AND action = 'reprice_out' AND direction = '{y_}')", f"{b}_reprice_{y_}_count"))])]
_cnt = lambda t: f"count(ts) FILTER (event_type = '{t}')"
_w4 = [r("count(ts)", "order_event_count"), r(_cnt("OrderPlaced"), "placed_count"), r(_cnt("OrderCancelled"), "cancel_count"), r(_cnt("OrderUpdated"), "update_count"), r(_cnt("Execution"), "execution_count"), r("coalesce(sum(execution_qty), 0)", "execution_qty"), r("coalesce(sum(CAST(execution_qty AS DOUBLE) * execution_price), 0)", "execution_notional"), r("count(DISTINCT order_uid)", "unique_order_uids"), r("count(DISTINCT price)", "levels_touched"), r("count(ts) / (w / 1000.0)", "events_per_sec"), r(f"{_cnt('Execution')} / (w / 1000.0)", "trades_per_sec"), r("CAST(coalesce(sum(execution_qty), 0) AS DOUBLE) / (w / 1000.0)", "qty_per_sec")]
_evs = "(SELECT *, timestamp_ms AS ts FROM ev)"
_since, _before = ("(SELECT min(timestamp_ms) + (max(timestamp_ms) - min(timestamp_ms)) // 8 FROM ev)", "(SELECT max(timestamp_ms) - (max(timestamp_ms) - min(timestamp_ms)) // 8 FROM ev)")
_rng = f"timestamp_ms >= {_since} AND timestamp_ms < {_before}"
_whole = "timestamp_ms >= (SELECT min(timestamp_ms) FROM ev) AND timestamp_ms < (SELECT max(timestamp_ms) + 1 FROM ev)"
_b = f"timestamp_ms - timestamp_ms % {BUCKET}"
_q = lambda t, more="": f"CAST(coalesce(sum(qty) FILTER (event_type = '{t}'{more}), 0) AS DOUBLE)"
_n = lambda t, more="": f"count(*) FILTER (event_type = '{t}'{more})"
_acc = lambda q, a, b: f"CASE WHEN {q}_{b} - {q}_{a} >= 1e-8 THEN {q}_{a} / ({q}_{b} - {q}_{a} + 1e-12) END"


def _relative(name: str, n: int) -> str:
    return f"""(SELECT CASE WHEN z.i >= {n} THEN struct_pack(m := median(y.c), p := count(*) FILTER (y.c <= z.c) / {n}.0) END FROM nb y WHERE y.i > z.i - {n} AND y.i <= z.i) AS {name}, (SELECT CASE WHEN z.i >= {n} THEN median(abs(y.c - (SELECT median(q.c) FROM nb q WHERE q.i > z.i - {n} AND q.i <= z.i))) END FROM nb y WHERE y.i > z.i - {n} AND y.i <= z.i) AS {name}_mad"""


ORACLE = {
    "e1_canonical_events": f"WITH {PLAIN} SELECT symbol, ingest_pos, timestamp_ms, event_type, order_uid, side, {r('price', 'price')}, {r('qty', 'qty')}, maker_uid, taker_uid, {r('execution_price', 'execution_price')}, {r('execution_qty', 'execution_qty')}, n_events_same_ms, ordering_ambiguous FROM ev",
    "s1_json_lines": f"WITH {OLD} SELECT timestamp_ms, event_type, ingest_pos AS event_uid, order_uid, side, {r('price', 'price')}, {r('qty', 'qty')}, {r("CASE WHEN event_type = 'OrderUpdated' THEN old_qty END", 'old_qty')}, {r("CASE WHEN event_type = 'OrderUpdated' THEN old_price END", 'old_price')}, CASE WHEN event_type <> 'Execution' THEN CAST(0 AS DOUBLE) END AS filled_qty, maker_uid, taker_uid, {r('execution_price', 'execution_price')}, {r('execution_qty', 'execution_qty')}, CASE WHEN event_type <> 'Execution' THEN 'r' END AS reason, aggressor, n_events_same_ms, ordering_ambiguous FROM eo",
    "e5_ambiguity": f"WITH {PLAIN} SELECT event_type, count(*) FILTER (ordering_ambiguous) AS ambiguous, max(n_events_same_ms) AS most_in_one_ms, count(*) AS n FROM ev GROUP BY 1",
    "e7_phases": f"WITH {PLAIN} SELECT CASE WHEN timestamp_ms < ({_since} + {_before}) // 2 THEN 'warmup' ELSE 'research' END AS phase, count(*) AS n, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM ev WHERE {_rng} GROUP BY 1",
    "e9_lifecycle": f"WITH {PLAIN}, u AS (SELECT order_uid AS uid, 'order' AS role, timestamp_ms, event_type FROM ev UNION ALL SELECT maker_uid, 'maker', timestamp_ms, event_type FROM ev UNION ALL SELECT taker_uid, 'taker', timestamp_ms, event_type FROM ev) SELECT uid, role, count(*) AS n, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, count(DISTINCT event_type) AS kinds FROM u WHERE uid IS NOT NULL GROUP BY 1, 2",
    "e10_neighbourhood": f"WITH {PLAIN} SELECT x.ingest_pos AS execution, count(*) AS n, count(*) FILTER (e.event_type = 'OrderPlaced') AS placed, count(*) FILTER (e.timestamp_ms BETWEEN x.timestamp_ms + 1 AND x.timestamp_ms + 3) AS soon_after FROM ev x JOIN ev e ON e.timestamp_ms BETWEEN x.timestamp_ms - 5 AND x.timestamp_ms + 5 WHERE x.execution_qty > 100 GROUP BY 1",
    "a1_taker_atoms": f"WITH {PLAIN}, {TK} SELECT ts, ingest_pos, taker_uid, aggressor, sign, {r('qty', 'qty')}, {r('price', 'price')}, {r('notional', 'notional')} FROM tk",
    "p1_passive_atoms": f"WITH {OLD} SELECT ts, ingest_pos, order_uid, book_side, action, {r('qty', 'qty')}, {r('price', 'price')} FROM pa",
    "p3_reprice_atoms": f"WITH {OLD} SELECT ts, ingest_pos, order_uid, book_side, action, {r('qty', 'qty')}, {r('old_price', 'old_price')}, {r('new_price', 'new_price')}, direction FROM rp",
    "g1_flow_taxonomy": f"WITH {PLAIN}, x AS (SELECT {_b} AS b, CAST(coalesce(sum(execution_qty), 0) AS DOUBLE) AS executed_qty, {_n('Execution')} AS executions FROM ev WHERE {_whole} GROUP BY 1) SELECT symbol, {_b} AS bucket_ms, side, {_q('OrderPlaced')} AS placed_qty, {_n('OrderPlaced')} AS placed_orders, {_q('OrderCancelled')} AS cancelled_qty, {_n('OrderCancelled')} AS cancelled_orders, {_q('OrderUpdated')} AS updated_qty, {_n('OrderUpdated')} AS updates, count(*) FILTER (ordering_ambiguous) AS n_ambiguous_events, any_value(executed_qty) AS executed_qty, any_value(executions) AS executions FROM ev JOIN x ON x.b = {_b} WHERE {_whole} GROUP BY 1, 2, 3",
    "g2_ofi_atoms": f"WITH {PLAIN} SELECT symbol, {_b} AS bucket_ms, " + ", ".join(f"{_q(t, f" AND side = '{sd}'")} AS {b}_{w}_qty, {_n(t, f" AND side = '{sd}'")} AS {b}_{w}_orders" for b, sd in (("bid", "buy"), ("ask", "sell")) for w, t in (("new", "OrderPlaced"), ("cancel", "OrderCancelled"))) + f", CAST(coalesce(sum(execution_qty), 0) AS DOUBLE) AS bid_executed_qty, CAST(coalesce(sum(execution_qty), 0) AS DOUBLE) AS ask_executed_qty, {_n('OrderUpdated')} AS n_updates, count(*) FILTER (ordering_ambiguous) AS n_ambiguous FROM ev WHERE {_whole} GROUP BY 1, 2",
    "w1_aggressive_flow": f"WITH {PLAIN}, {TK}, {GRID} {over('tk', _w1)}",
    "w2_passive_flow": f"WITH {OLD}, {GRID} {over('pa', _w2)}",
    "w3_reprice_flow": f"WITH {OLD}, {GRID} {over('rp', _w3)}",
    "w4_regime": f"WITH {PLAIN}, {GRID} {over(_evs, _w4)}",
    "w7_relative_activity": f"WITH {PLAIN}, {GRID}, nb AS (SELECT anchor, count(ts) AS c, row_number() OVER (ORDER BY anchor) AS i FROM an LEFT JOIN {_evs} x ON x.ts > anchor - 60 AND x.ts <= anchor GROUP BY anchor), q AS (SELECT anchor, c, {_relative('d', 24)}, {_relative('k', 168)} FROM nb z) SELECT 'SYN' AS symbol, anchor, CAST(c AS DOUBLE) AS order_event_count_60, " + ", ".join(f"round(c / nullif({v}.m, 0), 6) AS activity_vs_trailing_median_{n}, round((c - {v}.m) / nullif(1.4826 * {v}_mad, 0), 6) AS activity_robust_z_{n}, round({v}.p, 6) AS activity_rolling_percentile_{n}" for v, n in (("d", "day"), ("k", "week"))) + ", CASE WHEN k IS NULL THEN 'not_ready' WHEN k.p >= 0.98 THEN 'EXTREME' WHEN k.p >= 0.9 THEN 'BURST' WHEN k.p >= 0.7 THEN 'ACTIVE' WHEN k.p >= 0.2 THEN 'NORMAL' ELSE 'QUIET' END AS regime_state FROM q",
    "w10_acceleration": f"WITH {PLAIN}, {TK}, {GRID}, f AS (SELECT anchor, " + ", ".join(f"CAST({s('qty', f"aggressor = '{q}' AND ts > anchor - {w}")} AS DOUBLE) AS {q}_{w}" for q in ("buy", "sell") for w in (15, 30, 60, 120, 360)) + " FROM an LEFT JOIN tk x ON x.ts > anchor - 360 AND x.ts <= anchor GROUP BY anchor) SELECT 'SYN' AS symbol, anchor, " + ", ".join(f"round({_acc(q, a, b)}, 6) AS {q}_flow_accel_{a}_{b}" for a, b in ((15, 30), (30, 60), (60, 120), (120, 360)) for q in ("buy", "sell")) + " FROM f",
    "v1_stream_quality": f"WITH {PLAIN} SELECT count(*) AS n, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, count(*) - count(DISTINCT ingest_pos) AS repeated, round(100.0 * count(*) FILTER (ordering_ambiguous) / count(*), 4) AS same_ms_pct, max(n_events_same_ms) AS most_in_one_ms FROM ev",
    "j7_linkage": f"WITH {PLAIN}, u AS (SELECT maker_uid AS uid FROM ev WHERE maker_uid IS NOT NULL UNION SELECT taker_uid FROM ev WHERE taker_uid IS NOT NULL) SELECT count(*) AS n_uids, count(*) FILTER (uid IN (SELECT order_uid FROM ev WHERE order_uid IS NOT NULL)) AS n_known, round(100.0 * count(*) FILTER (uid IN (SELECT order_uid FROM ev WHERE order_uid IS NOT NULL)) / count(*), 2) AS known_pct FROM u",
}
