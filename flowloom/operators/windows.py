"""Backward windows (t - W, t] at anchors, and as-of lookups.

Atoms are summed once per anchor step, with map-side combine, before any window runs: a window of several steps is then a range frame over the short anchor
table, one shorter than a step is a conditional sum of the same pass, and any other is one of each. The anchor table is taken in spans of time.
Distinct counts use intervals: a row is the newest of its key from its time until the next of its key or W later, so the count is a running sum of +1 and -1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .atoms import EPS
from .rolling import rolling

KEY = "symbol"


def ceil_to(ts: Column, step: int) -> Column:
    return (F.ceil(ts / step) * step).cast("long")


def deltas(rows: DataFrame, distinct: dict[str, tuple[str | None, str]], windows: list[int], step: int, span: int) -> DataFrame:
    """rows (symbol, ts, ..) -> (symbol, anchor, __name_W): how many more keys count in the window W from an anchor on.

    distinct: name -> (condition, key) as SQL. A row is the newest of its key from its time until the next of its key, or W later. What reaches into the next span of
    time (spans are no shorter than windows) starts once more with it, so that a span's sums need nothing from the one before. Starts and ends are narrow rows, summed
    by window and anchor before they become columns, so what goes on does not grow with the keys.
    """
    keyed = ", ".join(f"named_struct('n', '{n}', 'k', CASE WHEN {c or 'true'} THEN cast({k} AS string) END)" for n, (c, k) in distinct.items())
    r = rows.selectExpr(KEY, "ts", f"inline(array({keyed})) AS (n, k)").where("k IS NOT NULL")
    r = r.withColumn("next", F.lead("ts").over(Window.partitionBy(KEY, "n", "k").orderBy("ts")))
    up = lambda x: f"cast(ceil(({x}) / {step}) * {step} AS bigint)"
    ends = ", ".join(f"named_struct('w', {w}, 'e', {up(f'least(coalesce(next, ts + {w}), ts + {w})')})" for w in windows)
    r = r.selectExpr(KEY, "n", f"{up('ts')} AS a", f"inline(array({ends})) AS (w, e)").where("e > a")
    r = r.selectExpr(KEY, "n", "w", "a", "e", f"(cast(floor(a / {span}) AS bigint) + 1) * {span} AS b")
    moves = "array(named_struct('anchor', a, 'd', 1), named_struct('anchor', e, 'd', -1), named_struct('anchor', CASE WHEN e >= b THEN b END, 'd', 1))"
    r = r.selectExpr(KEY, "n", "w", f"inline({moves}) AS (anchor, d)").where("anchor IS NOT NULL").groupBy(KEY, "anchor", "n", "w").agg(F.sum("d").alias("d"))
    return r.selectExpr(KEY, "anchor", *[f"CASE WHEN n = '{n}' AND w = {w} THEN d END AS `__{n}_{w}`" for n in distinct for w in windows])


def windowed(atoms: DataFrame, anchors: DataFrame, values: dict[str, Column | str], windows: list[int], step: int, distinct: dict[str, tuple[str | None, str]] | None = None, length: int = 1 << 12) -> DataFrame:
    """Sums of values over (t - W, t] at each anchor, as columns name_W; zero where nothing falls in. anchors (symbol, anchor) lie on multiples of step. Rows without a time count nowhere.

    distinct (name -> condition and key, as SQL) adds how many distinct non-null keys fall in. Atoms, changes of these counts and anchors are summed in one
    exchange; one pass over the short table of anchors then gives all windows: one of k steps and a rest is a frame of k steps and the rest's sum at the anchor k steps
    back. The pass takes spans of at least `length` anchors apart, each with the anchors of the longest window before it.
    """
    atoms, distinct = atoms.where("ts IS NOT NULL"), distinct or {}
    rests = sorted({w % step for w in windows} - {0}) if values else []
    reach = max(windows)
    span = step * max(length, -(-reach // step) + 1)
    of = lambda v: F.expr(v) if isinstance(v, str) else v
    parts = [anchors.selectExpr(KEY, "anchor", "1 AS __on")]
    if values:
        parts.append(atoms.select(KEY, "ts", ceil_to(F.col("ts"), step).alias("anchor"), *[of(v).alias(f"__{n}") for n, v in values.items()]))
    else:
        parts[0] = parts[0].withColumn("ts", F.lit(None).cast("long"))
    if distinct:
        parts.append(deltas(atoms, distinct, windows, step, span))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    whole = any(w >= step for w in windows)
    sums = ["max(__on) AS __on", *[f"coalesce(sum(CASE WHEN ts > anchor - {w} THEN `__{n}` END), 0) AS `__{n}_r{w}`" for w in rests for n in values]]
    sums += [f"coalesce(sum(`__{n}`), 0) AS `__{n}`" for n in values] * whole + [f"coalesce(sum(`__{n}_{w}`), 0) AS `__{n}_{w}`" for n in distinct for w in windows]
    frame = f"OVER (PARTITION BY {KEY}, __c ORDER BY anchor"
    wide = []
    for w in windows:
        k, rest = w // step * step, w % step
        for n in values:
            at = f"sum(`__{n}_r{rest}`) {frame} RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)" if k else f"`__{n}_r{rest}`"
            steps = f"sum(`__{n}`) {frame} RANGE BETWEEN {k - step} PRECEDING AND CURRENT ROW)"
            wide.append(f"{f'{steps} + coalesce({at}, 0)' if k and rest else steps if k else at} AS `{n}_{w}`")
    wide += [f"sum(CASE WHEN __own THEN `__{n}_{w}` END) {frame} ROWS UNBOUNDED PRECEDING) AS `{n}_{w}`" for n in distinct for w in windows]
    out = rows.groupBy(KEY, "anchor").agg(*map(F.expr, sums))
    own, ahead = (f"cast(floor((anchor + {x}) / {span}) AS bigint)" for x in (0, reach))
    out = out.selectExpr("*", f"explode(sequence({own}, {ahead})) AS __c").selectExpr("*", f"__c = {own} AS __own")
    return out.selectExpr(KEY, "anchor", "__on", "__own", *wide).where("__on = 1 AND __own").drop("__on", "__own")


def distinct_counts(rows: DataFrame, anchors: DataFrame, name: str, key: Column, windows: list[int], step: int) -> DataFrame:
    """How many distinct non-null keys rows (symbol, ts, ..) have in (t - W, t], as columns name_W."""
    return windowed(rows.select(KEY, "ts", key.alias("__key")), anchors, {}, windows, step, {name: (None, "__key")})


def as_of(points: DataFrame, observed: DataFrame, at: str, columns: list[str], chunk: int = 3_600_000) -> DataFrame:
    """points (symbol, at, ..) with the columns of the last observation (symbol, ts) at or before at, its nulls included; ties by order of columns' values.

    Time is cut into chunks, which are sorted apart; what a chunk starts with is the last observation of the chunks before it, one row for each of them.
    """
    left = points.select(*points.columns, F.col(at).alias("__t"), F.lit(1).alias("__src"), F.lit(None).cast(observed.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("__s"))
    right = observed.where("ts IS NOT NULL").select(KEY, F.col("ts").alias("__t"), F.lit(0).alias("__src"), F.struct(*columns).alias("__s"))
    both = right.unionByName(left, allowMissingColumns=True).withColumn("__c", F.floor(F.col("__t") / chunk))
    so_far = Window.partitionBy(KEY, "__c").orderBy("__t", "__src", "__s").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(KEY, "__c").agg(F.max(F.when(F.col("__src") == 0, F.struct("__t", "__s"))).alias("e"))
    earlier = F.last("e", ignorenulls=True).over(Window.partitionBy(KEY).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    start = ends.select(F.col(KEY).alias("__k"), F.col("__c").alias("__d"), earlier["__s"].alias("__e"))
    rows = both.withColumn("__l", F.last("__s", ignorenulls=True).over(so_far)).where("__src = 1")
    rows = rows.join(start, F.col(KEY).eqNullSafe(F.col("__k")) & F.col("__c").eqNullSafe(F.col("__d")), "left").withColumn("__l", F.coalesce("__l", "__e"))
    return rows.select(*[F.col(c) for c in points.columns], *[F.col(f"__l.{c}").alias(c) for c in columns])


def aggressive_flow(taker: DataFrame, anchors: DataFrame, windows: list[int], step: int) -> DataFrame:
    of = {side: f"aggressor = '{side}'" for side in ("buy", "sell")}
    values = {f"{side}_{name}": f"CASE WHEN {c} THEN {v} END" for name, v in (("taker_qty", "qty"), ("taker_count", "1"), ("notional", "notional")) for side, c in of.items()}
    out = windowed(taker, anchors, values, windows, step, {"ask_levels_consumed": (of["buy"], "price"), "bid_levels_consumed": (of["sell"], "price")})
    b, s = (lambda w, side=side: f"cast(`{side}_taker_qty_{w}` AS double)" for side in ("buy", "sell"))
    return out.selectExpr("*", *[f"({b(w)} - {s(w)}) / ({b(w)} + {s(w)} + {EPS}D) AS `afi_{w}`" for w in windows])


def passive_flow(atoms: DataFrame, anchors: DataFrame, windows: list[int], step: int) -> DataFrame:
    values = {}
    for side in ("bid", "ask"):
        for action in ("add", "cancel"):
            m = f"book_side = '{side}' AND action = '{action}'"
            values |= {f"{side}_{action}_qty": f"CASE WHEN {m} THEN qty END", f"{side}_{action}_orders": f"CASE WHEN {m} THEN 1 END"}
    out = windowed(atoms, anchors, values, windows, step)
    return out.selectExpr("*", *[f"`{s}_add_qty_{w}` - `{s}_cancel_qty_{w}` AS `{s}_net_passive_{w}`" for w in windows for s in ("bid", "ask")])


def reprice_flow(atoms: DataFrame, anchors: DataFrame, windows: list[int], step: int) -> DataFrame:
    values = {}
    for side in ("bid", "ask"):
        at = f"book_side = '{side}' AND action = "
        values |= {f"{side}_reprice_{way}_qty": f"CASE WHEN {at} 'reprice_{way}' THEN qty END" for way in ("out", "in")}
        for way in ("away", "toward"):
            leaves = f"{at} 'reprice_out' AND direction = '{way}'"
            values |= {f"{side}_reprice_{way}_qty": f"CASE WHEN {leaves} THEN qty END", f"{side}_reprice_{way}_count": f"CASE WHEN {leaves} THEN 1 END"}
    out = windowed(atoms, anchors, values, windows, step)
    return out.selectExpr("*", *[f"`{s}_reprice_in_qty_{w}` - `{s}_reprice_out_qty_{w}` AS `{s}_reprice_net_{w}`" for w in windows for s in ("bid", "ask")])


def regime_counts(events: DataFrame, anchors: DataFrame, windows: list[int], step: int) -> DataFrame:
    """Activity per window: counts by type, executed quantity and notional, distinct orders and prices, rates per unit of time (windows are in ms)."""
    e = events.withColumnRenamed("timestamp_ms", "ts")
    one = lambda t: f"CASE WHEN event_type = '{t}' THEN 1 END"
    done = lambda v: f"CASE WHEN event_type = 'Execution' THEN {v} END"
    values = {"order_event_count": "1", "placed_count": one("OrderPlaced"), "cancel_count": one("OrderCancelled"), "update_count": one("OrderUpdated"), "execution_count": one("Execution"), "execution_qty": done("execution_qty"), "execution_notional": done("cast(execution_qty AS double) * execution_price")}
    out = windowed(e, anchors, values, windows, step, {"unique_order_uids": (None, "order_uid"), "levels_touched": (None, "price")})
    rates = {"events_per_sec": "order_event_count", "trades_per_sec": "execution_count", "qty_per_sec": "execution_qty", "notional_per_sec": "execution_notional"}
    return out.selectExpr("*", *[f"cast(`{c}_{w}` AS double) / {w / 1000}D AS `{r}_{w}`" for w in windows for r, c in rates.items()])


def bbo_changes(book: DataFrame, anchors: DataFrame, windows: list[int], step: int) -> DataFrame:
    """Observations whose mid differs from the one before; the first one counts, and so does every unknown mid."""
    w = Window.partitionBy(KEY).orderBy("ts")
    changed = book.withColumn("c", F.when(F.col("mid").isNull() | ~F.col("mid").eqNullSafe(F.lag("mid").over(w)), 1))
    return windowed(changed, anchors, {"bbo_change_count": F.col("c")}, windows, step)


def price_response(book: DataFrame, flow: DataFrame, anchors: DataFrame, windows: list[int], tick: float) -> DataFrame:
    """How far the mid moved over each window, per unit of aggressive flow (columns of aggressive_flow)."""
    asked = anchors.select(KEY, "anchor", F.explode(F.array(*[F.lit(w).cast("long") for w in (0, *windows)])).alias("w")).withColumn("t", F.col("anchor") - F.col("w"))
    mids = as_of(asked, book.select(KEY, "ts", "mid"), "t", ["mid"])
    now = mids.groupBy(KEY, "anchor").agg(*[F.max(F.when(F.col("w") == w, F.col("mid"))).alias(n) for n, w in (("m0", 0), *((f"m_{w}", w) for w in windows))])
    out = now.join(flow, [KEY, "anchor"])
    cols = []
    for w in windows:
        # ticks are signed in the ratios, a magnitude in ticks_moved and levels_crossed
        move = f"(m0 - m_{w})"
        ticks = f"({move} / {float(tick)}D)"
        levels = f"abs(rint({ticks}))"
        cols += [f"{move} AS `signed_mid_change_{w}`", f"abs({ticks}) AS `ticks_moved_{w}`", f"{levels} AS `levels_crossed_{w}`"]
        for side in ("buy", "sell"):
            q, n = (f"cast(`{side}_{x}_{w}` AS double)" for x in ("taker_qty", "notional"))
            per = lambda a, b, q=q: f"CASE WHEN {q} >= 1e-8D THEN {a} / ({b} + {EPS}D) END"
            cols += [f"{per(move, q)} AS `price_response_per_{side}_qty_{w}`", f"{per(ticks, n)} AS `ticks_per_{side}_notional_{w}`", f"{per(levels, q)} AS `levels_per_{side}_qty_{w}`"]
    return out.selectExpr(KEY, "anchor", *cols)


def acceleration(flow: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Flow of the short window against the earlier part of the long one; null where that part is empty."""
    cols = []
    for a, b in pairs:
        for side in ("buy", "sell"):
            short, prior = (F.col(f"{side}_taker_qty_{a}").cast("double"), F.col(f"{side}_taker_qty_{b}").cast("double") - F.col(f"{side}_taker_qty_{a}").cast("double"))
            cols.append(F.when(prior >= 1e-8, short / (prior + EPS)).alias(f"{side}_flow_accel_{a}_{b}"))
    return flow.select(KEY, "anchor", *cols)


def relative_activity(series: DataFrame, value: str, contexts: dict[str, int], part: int = 3_600_000) -> DataFrame:
    """Activity against the last n anchors: ratio to their median, robust z and percentile; null until n anchors are there. Anchors are parted by `part` of time to be numbered."""
    found = rolling(series, KEY, "anchor", value, contexts, part)
    v = F.col(value).cast("double")
    cols = {}
    for c in contexts:
        med = F.col(f"med_{c}")
        cols |= {f"activity_vs_trailing_median_{c}": F.try_divide(v, med), f"activity_robust_z_{c}": F.try_divide(v - med, 1.4826 * F.col(f"mad_{c}")), f"activity_rolling_percentile_{c}": F.col(f"pct_{c}")}
    return series.join(found, [KEY, "anchor"]).withColumns(cols).drop(*[f"{x}_{c}" for c in contexts for x in ("med", "mad", "pct")])


def regime_label(percentile: Column) -> Column:
    # fixed values: lower edges of the bands
    bands = [(0.98, "EXTREME"), (0.90, "BURST"), (0.70, "ACTIVE"), (0.20, "NORMAL"), (0.0, "QUIET")]
    out = F.when(percentile.isNull(), "not_ready")
    for edge, name in bands:
        out = out.when(percentile >= edge, name)
    return out.otherwise("not_ready")
