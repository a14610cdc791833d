"""Quality gates with verdicts: raw files, market state, feature tables, and which sessions to take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import book, lifecycle
from ..sources.shared import stored

#: Fixed values of the gates: tolerances, least known share of the best level, and what features may be.
TOLERANCE_MS, MIN_L1_PCT, EXPECTED_ROWS = 300_000, 99.9, 3_600
RANGES: list[tuple[str, float | None, float | None]] = [
    ("afi_", -1.0, 1.0),
    ("_percentile", 0.0, 1.0),
    ("spread", 0.0, None),
    ("depth_bid", 0.0, None),
    ("depth_ask", 0.0, None),
    ("execution_qty_", 0.0, None),
    ("execution_count_", 0.0, None),
    ("order_event_count_", 0.0, None),
    ("placed_count_", 0.0, None),
    ("cancel_count_", 0.0, None),
    ("buy_taker_qty_", 0.0, None),
    ("sell_taker_qty_", 0.0, None),
]
SLACK, CHUNK_BITS = 1e-9, 20


def one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each, side by side."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def line_order(rows: DataFrame) -> DataFrame:
    """rows (ts, ingest_pos) -> one row: n, first_ts and last_ts as they stand, ts_order asc, desc or mixed. Neighbours are compared within chunks of places, chunks by their ends."""
    chunk = F.shiftright("ingest_pos", CHUNK_BITS)
    step = F.col("ts") - F.lag("ts").over(Window.partitionBy("chunk").orderBy("ingest_pos"))
    inside = rows.withColumn("chunk", chunk).withColumn("step", step).groupBy("chunk")
    ends = inside.agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"), F.min_by("ts", "ingest_pos").alias("first"), F.max_by("ts", "ingest_pos").alias("last"))
    between = ends.withColumn("gap", F.col("first") - F.lag("last").over(Window.orderBy("chunk")))  # a row for each 2^20 lines
    lo, hi = F.least(F.min("lo"), F.min("gap")), F.greatest(F.max("hi"), F.max("gap"))
    kind = F.when(F.coalesce(lo, F.lit(0)) >= 0, "asc").when(F.coalesce(hi, F.lit(0)) <= 0, "desc").otherwise("mixed")
    return between.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min_by("first", "chunk").alias("first_ts"), F.max_by("last", "chunk").alias("last_ts"), kind.alias("ts_order"))


def first_of(*pairs: tuple[Column, Column]) -> Column:
    """The reason of the first condition that holds; null where none does."""
    return F.coalesce(*[F.when(c, r) for c, r in pairs])


def download_truth(orders: DataFrame, executions: DataFrame, since: int, before: int, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """Stage 1, one row: whether raw order lines (uid, timestamp, ingest_pos) span the interval, in one order, without repeated ids (a missing id repeats), with verdict and reason."""
    o = orders.select(F.nullif("uid", F.lit("")).alias("uid"), F.coalesce(F.col("timestamp"), F.lit(0)).alias("ts"), "ingest_pos")
    same = o.groupBy("ts").agg(F.count(F.lit(1)).alias("c"))
    same = same.agg(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("shared"), F.coalesce(F.max("c"), F.lit(0)).alias("max_events_same_ms"))
    row = one_row(line_order(o), o.agg((F.count(F.lit(1)) - F.count_distinct("uid")).alias("dup_event_uid")), same, executions.agg(F.count(F.lit(1)).alias("exc_rows")))
    lo, hi = F.least("first_ts", "last_ts"), F.greatest("first_ts", "last_ts")
    reason = first_of(
        ((F.col("n") == 0) | (F.col("exc_rows") == 0), F.lit("missing or empty file")),
        (hi < before - tolerance, F.format_string(f"newest %d is before {before - tolerance}", hi)),
        (lo > since + tolerance, F.format_string(f"oldest %d is after {since + tolerance}", lo)),
        (F.col("dup_event_uid") > 0, F.format_string("%d repeated event ids", "dup_event_uid")),
        (F.col("ts_order") == "mixed", F.lit("times rise and fall")),
    )
    out = row.select(F.col("n").alias("ord_rows"), "exc_rows", "first_ts", "last_ts", "dup_event_uid", "ts_order", (F.col("ts_order") != "mixed").alias("ts_monotonic"), F.round(F.coalesce("shared", F.lit(0)) / F.greatest("n", F.lit(1)), 4).alias("same_ms_share"), "max_events_same_ms", reason.alias("reason"))
    return out.withColumn("verdict", F.when(F.col("reason").isNull(), "PASS").otherwise("FAIL"))


def manifest(orders: DataFrame, stream: str, since: int, before: int, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """What a manifest says of a file without one: its bounds and COMPLETE_LEGACY_VERIFIED. No row for an empty file, or for orders that do not span the interval."""
    m = line_order(orders.select(F.col("timestamp").alias("ts"), "ingest_pos")).where("first_ts IS NOT NULL AND last_ts IS NOT NULL")
    if stream == "orders":
        m = m.where((F.least("first_ts", "last_ts") <= since + tolerance) & (F.greatest("first_ts", "last_ts") >= before - tolerance))
    return m.select(F.lit(stream).alias("stream"), F.lit(since).alias("requested_since_ms"), F.lit(before).alias("requested_before_ms"), "first_ts", "last_ts", F.lit("COMPLETE_LEGACY_VERIFIED").alias("status"))


def linkage(events: DataFrame) -> DataFrame:
    """Per symbol: executions, and the share of distinct maker and taker ids that the orders know."""
    known = events.where("order_uid IS NOT NULL").select("symbol", F.col("order_uid").alias("uid")).distinct().withColumn("k", F.lit(1))
    used = events.where("event_type = 'Execution'").select("symbol", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_uid").alias("uid")) for r in ("maker", "taker")])).alias("x")).select("symbol", "x.*")
    per = used.where("uid IS NOT NULL").distinct().join(known, ["symbol", "uid"], "left").groupBy("symbol").agg(*[F.round(F.coalesce(F.try_divide(100 * F.count(F.when(F.col("role") == r, F.col("k"))), F.count_if(F.col("role") == r)), F.lit(0.0)), 2).alias(f"{r}_link_pct") for r in ("maker", "taker")])
    n = events.groupBy("symbol").agg(F.count_if(F.col("event_type") == "Execution").alias("n_executions"))
    return n.join(per, "symbol", "left").fillna(0.0, ["maker_link_pct", "taker_link_pct"])


ZONES = [f"{s}_{z}" for z in ("L1", "L5", "L10", "10bps", "25bps") for s in ("bid", "ask")]


def market_truth(events: DataFrame, research: int, chunk: int = 10_000, watched: int | None = None) -> DataFrame:
    """Stage 2, a row per symbol: known quantity near the touch when research starts, odd transitions, crossings by kind, linkage, verdict and reason.

    watched: from when on placings were seen, if not from the first event on. The gate on the best levels comes first; then no negative quantity, no second Placed of an active order, and no crossing that is unexplained or lasts.
    """
    events = stored(events)
    moves = stored(lifecycle.transitions(events))
    spans = stored(lifecycle.intervals(moves))
    top = stored(book.batches_best(spans, events, chunk))
    t = F.col("timestamp_ms")
    out = events.groupBy("symbol").agg(F.count_if(t < research).alias("warmup_events"), F.count_if(t >= research).alias("research_events"))
    known = spans if watched is None else book.watched(spans, watched)
    comp = book.completeness(book.levels(book.at_time(known, research - 1)))
    side = F.when(F.col("side") == "buy", "bid").otherwise("ask")
    comp = comp.withColumn("z", F.concat_ws("_", side, "zone")).groupBy("symbol").agg(*[F.max(F.when(F.col("z") == z, F.col("pct_known"))).alias(f"comp_{z}") for z in ZONES], *[F.max(F.when(F.col("z") == z, F.col("total_qty") > 0)).alias(f"held_{z}") for z in ZONES[:2]])
    crossed = book.crossed(top)
    kinds = book.kinds(crossed, book.explained(crossed, spans, events)).groupBy("symbol").agg(*[F.count_if(F.col("classification") == k).alias(n) for n, k in (("explained", "CROSS_STREAM_TS_AMBIGUITY"), ("unexplained", "UNEXPLAINED"))], F.count_if(F.col("persistent") & (F.col("classification") != "LOCKED_MARKET")).alias("persisting"))
    active = spans.where("to_ts IS NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_active_final"))
    for more in (comp, lifecycle.counters(moves, events, top), kinds, active, linkage(events)):
        out = out.join(more, "symbol", "left")
    out = out.fillna(0, ["explained", "unexplained", "persisting", "n_active_final"])
    low = [F.coalesce(F.col(f"held_{z}"), F.lit(False)) & (F.coalesce(f"comp_{z}", F.lit(0.0)) < MIN_L1_PCT) for z in ZONES[:2]]
    odd = F.concat_ws("; ", *[F.when(F.col(c) > 0, F.format_string(f"{c}=%d", c)) for c in ("negative_qty", "duplicate_active_uid", "unexplained", "persisting")])
    reason = first_of((reduce(lambda a, b: a | b, low), F.concat(F.lit(f"known below {MIN_L1_PCT}%: "), F.concat_ws(", ", *[F.when(c, F.lit(z)) for c, z in zip(low, ZONES)]))), (odd != "", odd))
    return out.withColumn("reason", reason).drop("held_bid_L1", "held_ask_L1").withColumn("verdict", F.when(F.col("reason").isNull(), "PASS").otherwise("FAIL"))


def session_gate(orders: DataFrame, executions: DataFrame, events: DataFrame, since: int, research: int, before: int) -> DataFrame:
    """Both stages in one row per symbol of events; the market is looked at only where the files pass."""
    first = download_truth(orders, executions, since, before).select(F.col("verdict").alias("dl_verdict"), F.col("reason").alias("dl_reason"))
    passed = first.collect()[0]["dl_verdict"] == "PASS"  # one row
    symbols = events.select("symbol").distinct()
    second = market_truth(events, research).select("symbol", F.col("verdict").alias("mkt_verdict"), F.col("reason").alias("mkt_reason")) if passed else symbols.select("symbol", F.lit("SKIPPED").alias("mkt_verdict"), F.lit(None).cast("string").alias("mkt_reason"))
    return second.crossJoin(first).withColumn("final_verdict", F.when(F.col("mkt_verdict") == "PASS", "PASS").otherwise("FAIL"))


def numeric_columns(rows: DataFrame, keys: list[str]) -> list[str]:
    return [f.name for f in rows.schema.fields if f.name not in keys and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]


def column_facts(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, n, missing, infinite, constant, lowest, highest) and, for every rule that the name falls under, how many values lie below and above it; one pass over rows."""
    facts = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(x), x)
        rules = [F.struct(F.lit(i).alias("rule"), (F.count_if(v < lo - SLACK) if lo is not None else F.lit(0).cast("long")).alias("below"), (F.count_if(v > hi + SLACK) if hi is not None else F.lit(0).cast("long")).alias("above")) for i, (part, lo, hi) in enumerate(RANGES) if part in c]
        none = F.array().cast("array<struct<rule:int,below:bigint,above:bigint>>")
        facts.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("missing"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.coalesce(F.min(v) == F.max(v), F.lit(True)).alias("constant"), (F.array(*rules) if rules else none).alias("rules")))
    return rows.groupBy(*keys).agg(F.array(*facts).alias("f"))


def bound_text(i: int, side: str) -> str:
    return f"<{RANGES[i][1]}" if side == "below" else f">{RANGES[i][2]}"


def rule_text(i: int) -> Column:
    """What breaks rule i, column by column, from the facts f; empty where nothing does."""
    def texts(side: str, x: Column) -> Column:
        n = F.element_at(F.filter(x["rules"], lambda y: y["rule"] == i), 1)[side]
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(x["column"], F.lit(f"{bound_text(i, side)}:"), n.cast("string")))

    def of(x: Column) -> Column:
        broken = F.exists(x["rules"], lambda y: (y["rule"] == i) & (y["below"] + y["above"] > 0))
        return F.when(broken, F.concat_ws("; ", texts("below", x), texts("above", x)))

    return F.concat_ws("; ", F.transform("f", of))


def feature_gate(rows: DataFrame, keys: list[str], first: int | None = None, last: int | None = None, step: int = 1_000, expected: int = EXPECTED_ROWS) -> DataFrame:
    """A row per key over a feature table (timestamp_ms, numeric columns, regime_state): its size and coverage, repeated times, missing and infinite values, ranges, constants, verdict.

    Five things fail it: the number of rows, repeated times, infinite values, broken ranges, and values in a 120-minute context, which an hour cannot fill.
    """
    columns = numeric_columns(rows, keys)
    facts = column_facts(rows, keys, columns)
    ts = F.col("timestamp_ms")
    state = F.col("regime_state") if "regime_state" in rows.columns else F.lit(None).cast("string")
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), (F.count(F.lit(1)) - F.count_distinct(ts) - F.when(F.count(ts) < F.count(F.lit(1)), 1).otherwise(0)).alias("dup_ts"), F.round(F.count_if(state == "not_ready") / F.count(F.lit(1)), 3).alias("regime_not_ready_share"))
    out = size.join(facts, keys)
    total = lambda name: F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x[name])
    named = lambda test: F.transform(F.filter("f", test), lambda x: x["column"])
    high = named(lambda x: (x["missing"] * 2 > x["n"]) & ~x["column"].contains("30m") & ~x["column"].contains("120m"))
    flat = named(lambda x: x["constant"] & (x["n"] - x["missing"] > 10))
    long = F.filter("f", lambda x: x["column"].contains("120m"))
    ranges = F.concat_ws("; ", *[F.when(rule_text(i) != "", F.concat(F.lit(f"{part}: "), rule_text(i))) for i, (part, _, _) in enumerate(RANGES)])
    near = lambda c, want: (F.abs(c - want) <= step) if want is not None else F.lit(None).cast("boolean")
    out = out.select(*keys, "n_rows", F.lit(len(rows.columns)).alias("n_cols"), (F.col("n_rows") == expected).alias("rows_ok"), "first_ts", "last_ts", near(F.col("first_ts"), first).alias("first_ts_ok"), near(F.col("last_ts"), last).alias("last_ts_ok"), "dup_ts",
        F.round(F.coalesce(F.try_divide(total("missing"), F.col("n_rows") * len(columns)), F.lit(0.0)), 4).alias("nan_share"), total("infinite").alias("inf_count"), F.lit(len(columns)).alias("n_num_cols"), F.size(high).alias("high_nan_cols"), F.concat_ws("; ", F.slice(high, 1, 5)).alias("high_nan_examples"),
        "regime_not_ready_share", F.col("regime_not_ready_share").between(0.4, 0.6).alias("regime_not_ready_ok"), ranges.alias("range_violations"), F.size(flat).alias("constant_cols"), F.concat_ws("; ", F.slice(flat, 1, 5)).alias("constant_examples"),
        F.when(F.size(long) > 0, F.forall(long, lambda x: x["missing"] == x["n"])).alias("context_120m_all_nan"))
    bad = ~F.col("rows_ok") | (F.col("dup_ts") > 0) | (F.col("inf_count") > 0) | (F.col("range_violations") != "") | F.coalesce(~F.col("context_120m_all_nan"), F.lit(False))
    return out.withColumn("verdict", F.when(bad, "FAIL").otherwise("PASS"))


def range_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, checked, violations): every rule, how many columns it covers and what breaks it."""
    columns = numeric_columns(rows, keys)
    each = F.array(*[F.struct(F.lit(part).alias("rule"), F.lit(sum(part in c for c in columns)).alias("checked"), rule_text(i).alias("violations")) for i, (part, _, _) in enumerate(RANGES)])
    return column_facts(rows, keys, columns).select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def sanity(rows: DataFrame, keys: list[str], labels: list[str], tick: float = 1.0) -> DataFrame:
    """(keys, section, check, checked, bad, ok): what must hold in every row of a feature table whose windows, short to long, are named by labels; one pass.

    Signs of the flow imbalance and of ticks, ratios where nothing was executed, longer windows that hold no less, and accelerations against their formula.
    """
    has = lambda *cs: all(c in rows.columns for c in cs)
    v = lambda c: F.col(f"`{c}`").cast("double")
    checks: list[tuple[str, str, Column, Column]] = []  # section, name, which rows it is about, what is bad
    add = lambda section, name, about, bad: checks.append((section, name, F.coalesce(about, F.lit(False)), F.coalesce(bad, F.lit(False))))
    for w in labels:
        if has(f"afi_{w}", f"buy_taker_qty_{w}", f"sell_taker_qty_{w}"):
            b, s, afi = v(f"buy_taker_qty_{w}"), v(f"sell_taker_qty_{w}"), v(f"afi_{w}")
            add("signs", f"strong sellers: afi_{w} < 0", s > 5 * b + 1e-6, ~(afi < 0))
            add("signs", f"strong buyers: afi_{w} > 0", b > 5 * s + 1e-6, ~(afi > 0))
            add("signs", f"sellers alone: afi_{w} is -1", (b == 0) & (s > 0), afi > -1 + 1e-6)
            add("signs", f"buyers alone: afi_{w} is 1", (s == 0) & (b > 0), afi < 1 - 1e-6)
        if has(f"ticks_moved_{w}", f"signed_mid_change_{w}"):
            ticks, move = v(f"ticks_moved_{w}"), v(f"signed_mid_change_{w}")
            add("signs", f"ticks_moved_{w} is no less than 0", ticks.isNotNull(), ticks < -1e-9)
            add("signs", f"ticks_moved_{w} is the move in ticks", ticks.isNotNull() & move.isNotNull(), F.abs(ticks - F.abs(move) / tick) > 1e-6)
        if has(f"total_exec_qty_{w}", f"replenishment_ratio_{w}"):
            add("ratios", f"replenishment_ratio_{w} is 0 without executions", v(f"total_exec_qty_{w}") == 0, ~v(f"replenishment_ratio_{w}").eqNullSafe(F.lit(0.0)))
        for side in ("buy", "sell"):
            if has(f"price_response_per_{side}_qty_{w}", f"{side}_taker_qty_{w}"):
                add("ratios", f"price_response_per_{side}_qty_{w} is small or null without flow", v(f"{side}_taker_qty_{w}") < 1e-8, F.abs(v(f"price_response_per_{side}_qty_{w}")) > 1e6)
            if has(f"{side}_flow_accel_{w}"):
                add("ratios", f"{side}_flow_accel_{w} below 1e6", v(f"{side}_flow_accel_{w}").isNotNull(), v(f"{side}_flow_accel_{w}") > 1e6)
    for name in ("buy_taker_qty", "sell_taker_qty", "bid_add_qty", "bid_cancel_qty", "total_refill_qty"):
        held = [w for w in labels if has(f"{name}_{w}")]
        for a, b in zip(held, held[1:]):
            add("windows", f"{name}: {a} within {b}", F.lit(True), v(f"{name}_{b}") < v(f"{name}_{a}") - 1e-9)
    for a, b in zip(labels, labels[1:]):
        for side in ("buy", "sell"):
            q = f"{side}_taker_qty"
            if has(f"{q}_{a}", f"{q}_{b}", f"{side}_flow_accel_{b}"):
                prior = F.greatest(v(f"{q}_{b}") - v(f"{q}_{a}"), F.lit(0.0))
                add("acceleration", f"{side}_flow_accel_{b} by its formula", prior > 1e-8, F.coalesce(F.abs(v(f"{q}_{a}") / (prior + 1e-12) - v(f"{side}_flow_accel_{b}")) > 1e-4, F.lit(True)))
    infinite = sum((F.when(F.abs(v(c)) == float("inf"), 1).otherwise(0) for c in numeric_columns(rows, keys)), F.lit(0))
    add("ratios", "no infinite value", F.lit(True), infinite > 0)
    facts = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(name).alias("check"), F.count_if(about).alias("checked"), F.count_if(about & bad).alias("bad")) for section, name, about, bad in checks])
    return rows.groupBy(*keys).agg(facts.alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*").withColumn("ok", F.col("bad") == 0)


def inventory(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, columns and the versions that the rows carry."""
    versions = [c for c in ("feature_version", "data_version", "book_semantics_version") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(rows.columns)).alias("n_columns"), *[F.max(c).alias(c) for c in versions])


def distribution_status(rows: DataFrame, families: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Per key, family and feature: how many values there are, and MISSING (no such column), ALL_NAN or ok."""
    wanted = [(f, c) for f, columns in families.items() for c in columns]
    count = lambda c: F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))) if c in rows.columns else F.lit(None).cast("long")
    each = [F.struct(F.lit(f).alias("family"), F.lit(c).alias("feature"), count(c).alias("n")) for f, c in wanted]
    out = rows.groupBy(*keys).agg(F.array(*each).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")
    return out.withColumn("status", F.when(F.col("n").isNull(), "MISSING").when(F.col("n") == 0, "ALL_NAN").otherwise("ok")).fillna(0, ["n"])


def causality(pairs: DataFrame) -> DataFrame:
    """Refill pairs per symbol whose add does not follow its execution, or whose delay is not positive."""
    return pairs.groupBy("symbol").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("exec_ts") >= F.col("add_ts")).alias("bad_order"), F.count_if(F.col("delay_ms") <= 0).alias("bad_delay"))


def verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """PASS where every check of the key holds."""
    return checks.groupBy(*keys).agg(F.count_if(~F.col("ok")).alias("violations")).withColumn("verdict", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def anchor_groups(rows: DataFrame, tops: dict[str, str], k: int = 5, n: int = 20, seed: int = 42) -> DataFrame:
    """Anchors to look at: n by the least hash of their time, and the k largest of each column of tops (group -> column), the earlier of equal ones first."""
    parts = [rows.orderBy(F.xxhash64(F.lit(seed), "timestamp_ms"), "timestamp_ms").limit(n).withColumn("group", F.lit(f"random_{n}"))]
    parts += [rows.orderBy(F.col(c).desc_nulls_last(), "timestamp_ms").limit(k).withColumn("group", F.lit(g)) for g, c in tops.items()]
    return reduce(DataFrame.unionByName, parts)


def session_candidates(events: DataFrame, length: int, probe: int, second: int = 1_000) -> DataFrame:
    """(start, probe_events, eps, pctl): the rate in the first `probe` of every window of `length`, and the share of windows that are no faster. Windows without an event count as well."""
    start = F.col("timestamp_ms") - F.pmod("timestamp_ms", F.lit(length))
    n = events.where("timestamp_ms IS NOT NULL").groupBy(start.alias("start")).agg(F.count_if(F.col("timestamp_ms") < start + probe).alias("probe_events"))
    span = n.agg(F.min("start").alias("a"), F.max("start").alias("b")).where("a IS NOT NULL")
    grid = span.select(F.explode(F.sequence("a", "b", F.lit(length).cast("long"))).alias("start"))
    rate = F.round(F.col("probe_events") / (probe / second), 1)
    rates = grid.join(n, "start", "left").select("start", F.coalesce("probe_events", F.lit(0)).alias("probe_events")).withColumn("eps", rate)
    by = rates.groupBy("eps").agg(F.count(F.lit(1)).alias("n"))
    below = by.select("eps", (F.sum("n").over(Window.orderBy("eps")) / F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("share"))  # a row per distinct rate
    return rates.join(below, "eps").select("start", "probe_events", "eps", F.round(100 * F.col("share"), 1).alias("pctl"))


def selected_sessions(candidates: DataFrame, percents: dict[str, float], length: int, warmup: int) -> DataFrame:
    """Candidates with `selected`: the one whose rate is closest to each percentile (the first of equal ones; a later label takes over), and their warmup and research bounds."""
    q = candidates.agg(*[F.percentile("eps", p / 100).alias(f"__{name}") for name, p in percents.items()])
    e = candidates.crossJoin(F.broadcast(q))  # q is one row
    best = e.agg(*[F.min_by("start", F.struct(F.abs(F.col("eps") - F.col(f"__{n}")), F.col("start"))).alias(f"__at_{n}") for n in percents])
    label = F.coalesce(*[F.when(F.col("start") == F.col(f"__at_{n}"), F.lit(n)) for n in reversed(percents)], F.lit(""))
    out = candidates.crossJoin(F.broadcast(best))  # one row
    return out.select(*candidates.columns, label.alias("selected"), (F.col("start") - warmup).alias("warmup_start"), (F.col("start") + length).alias("research_end"))
