"""Small fixtures of our own for what the demo stream does not hit."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.functions.quantiles import quantiles
from flowloom.functions.ranking import rank_pct
from flowloom.operators import atoms, book, levels, lifecycle, rolling, sweep, windows
from flowloom.plans import features, gates, report
from flowloom.sources import canonical, runlog
from flowloom.streaming import flows

EVENT = "symbol string, ingest_pos long, timestamp_ms long, event_type string, order_uid string, side string, price double, qty double, maker_uid string, taker_uid string, execution_price double, execution_qty double, order_type string, aggressor string"


def place(pos, t, uid, side, price, qty):
    return ("X", pos, t, "OrderPlaced", uid, side, price, qty, None, None, None, None, "Limit", None)


def change(pos, t, uid, side, price, qty, kind="OrderUpdated"):
    return ("X", pos, t, kind, uid, side, price, qty, None, None, None, None, "Limit", None)


def execute(pos, t, maker, taker, price, qty, aggressor="buy"):
    return ("X", pos, t, "Execution", None, None, None, None, maker, taker, price, qty, None, aggressor)


def states(spark, rows):
    e = spark.createDataFrame(rows, EVENT)
    m = lifecycle.transitions(e)
    assert sorted(map(str, lifecycle.book_intervals(e).collect())) == sorted(map(str, lifecycle.intervals(m).collect()))
    return m, {r["uid"]: r for r in lifecycle.intervals(m).where("to_ts IS NULL").collect()}


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_place_and_cancel_in_one_batch_leaves_nothing(spark, order):
    rows = [place(0, 5, "a", "buy", 10.0, 1.0), change(1, 5, "a", "buy", 10.0, 1.0, "OrderCancelled")]
    assert states(spark, [rows[i] for i in order])[1] == {}


def test_partial_fill_taker_and_replacement(spark):
    m, live = states(spark, [place(0, 1, "a", "buy", 10.0, 5.0), place(1, 1, "t", "sell", 12.0, 9.0), execute(2, 2, "a", "t", 10.0, 2.0), change(3, 3, "a", "buy", None, 4.0), change(4, 4, "z", "buy", 1.0, 1.0, "OrderCancelled")])
    assert set(live) == {"a"} and live["a"]["qty"] == 4.0 and live["a"]["price"] == 10.0
    assert m.where("outcome = 'unknown_cancel'").count() == 1


def test_maker_is_taker_and_place_again(spark):
    _, live = states(spark, [place(0, 1, "a", "buy", 10.0, 5.0), execute(1, 2, "a", "a", 10.0, 1.0), place(2, 3, "a", "sell", 11.0, 2.0)])
    assert live["a"]["side"] == "sell" and live["a"]["placed_ms"] == 3


def test_negative_quantity_and_null_price(spark):
    m, live = states(spark, [place(0, 1, "a", "buy", None, -1.0)])
    assert live["a"]["price"] == 0.0 and m.where("outcome = 'negative_qty'").count() == 1
    assert book.best(book.levels(book.at_time(lifecycle.intervals(m), 1))).collect()[0]["best_bid"] is None


def test_crossed_and_locked(spark):
    e = spark.createDataFrame([place(0, 1, "a", "buy", 10.0, 1.0), place(1, 2, "b", "sell", 10.0, 1.0), place(2, 3, "c", "buy", 11.0, 1.0), execute(3, 5, "c", "b", 11.0, 1.0)], EVENT)
    s = lifecycle.intervals(lifecycle.transitions(e))
    got = {r["ts"]: r for r in book.classified(book.crossings(book.batches_best(s, e, 2), s), e).collect()}
    assert got[2]["classification"] == "LOCKED_MARKET"
    assert got[3]["classification"] == "CROSS_STREAM_TS_AMBIGUITY" and got[3]["explained_dt"] == 2


def test_level_episodes_and_refills(spark):
    e = spark.createDataFrame([place(0, 1, "a", "buy", 10.0, 2.0), execute(1, 2, "a", "t", 10.0, 2.0), place(2, 3, "b", "buy", 10.0, 1.0), place(3, 90, "c", "buy", 10.0, 1.0)], EVENT)
    a = lifecycle.level_atoms(e)
    assert [(r["action"], r["level_qty"], r["episode_id"]) for r in a.orderBy("ts").collect()] == [("add", 2.0, 1), ("exec_reduce", 0.0, 1), ("add", 1.0, 2), ("add", 2.0, 2)]
    p = levels.refill_pairs(a, 10)
    assert [(r["exec_ts"], r["add_ts"]) for r in p.collect()] == [(2, 3)]
    grid = spark.createDataFrame([("X", t) for t in range(2, 14)], "symbol string, anchor long")
    assert {r["anchor"]: r["refill_count"] for r in levels.replenishment(p, grid, [10], 1).collect()} == {t: 1 for t in range(3, 13)}


@pytest.mark.parametrize("length", [1, 4, 4096])
def test_window_edges_match_brute_force(spark, length):
    """Windows shorter than a step, of whole steps and of neither, over spans of few anchors and in one."""
    import random

    rnd = random.Random(3)
    rows = [("X", rnd.randint(1, 300), rnd.randint(0, 5), float(rnd.randint(1, 9))) for _ in range(400)]
    a = spark.createDataFrame(rows, "symbol string, ts long, k int, qty double")
    grid = spark.createDataFrame([("X", t) for t in range(0, 330, 10)], "symbol string, anchor long")
    sizes = [3, 10, 25, 40]
    got = windows.windowed(a, grid, {"q": F.col("qty")}, sizes, 10, {"d": (None, "k")}, length).collect()
    assert sorted(map(str, got)) == sorted(map(str, windows.windowed(a, grid, {"q": F.col("qty")}, sizes, 10, length=length).join(windows.distinct_counts(a, grid, "d", F.col("k"), sizes, 10), ["symbol", "anchor"]).select(got[0].__fields__).collect()))
    assert len(got) == 33
    for r in got:
        for w in sizes:
            inside = [x for x in rows if r["anchor"] - w < x[1] <= r["anchor"]]
            assert r[f"q_{w}"] == sum(x[3] for x in inside) and r[f"d_{w}"] == len({x[2] for x in inside})


def test_empty_input(spark):
    e = spark.createDataFrame([], EVENT)
    grid = spark.createDataFrame([("X", 10)], "symbol string, anchor long")
    r = windows.aggressive_flow(atoms.taker(e), grid, [10], 10).collect()[0]
    assert r["buy_taker_qty_10"] == 0 and r["afi_10"] == 0
    assert lifecycle.level_atoms(e).count() == 0 and lifecycle.intervals(lifecycle.transitions(e)).count() == 0


def test_as_of_takes_the_last_row_with_its_null(spark):
    obs = spark.createDataFrame([("X", 5, 1.0), ("X", 8, None)], "symbol string, ts long, mid double")
    pts = spark.createDataFrame([("X", 4), ("X", 5), ("X", 9)], "symbol string, anchor long")
    assert {r["anchor"]: r["mid"] for r in windows.as_of(pts, obs, "anchor", ["mid"]).collect()} == {4: None, 5: 1.0, 9: None}


def test_price_response_keeps_its_sign(spark):
    """A falling mid gives negative ratios; ticks moved and levels crossed are magnitudes."""
    mids = spark.createDataFrame([("X", 0, 100.0), ("X", 10, 97.0)], "symbol string, ts long, mid double")
    flow = spark.createDataFrame([("X", 10, 2.0, 4.0, 200.0, 400.0)], "symbol string, anchor long, buy_taker_qty_10 double, sell_taker_qty_10 double, buy_notional_10 double, sell_notional_10 double")
    r = windows.price_response(mids, flow, flow.select("symbol", "anchor"), [10], 0.5).collect()[0]
    assert (r["signed_mid_change_10"], r["ticks_moved_10"], r["levels_crossed_10"]) == (-3.0, 6.0, 6.0)
    assert r["ticks_per_buy_notional_10"] == pytest.approx(-6 / 200) and r["ticks_per_sell_notional_10"] == pytest.approx(-6 / 400)
    assert r["price_response_per_buy_qty_10"] == pytest.approx(-1.5) and r["levels_per_sell_qty_10"] == pytest.approx(1.5)


def test_completeness_zones_have_one_side(spark):
    """In a crossed book the best bid lies above the mid, so it is in no zone in basis points."""
    m, _ = states(spark, [place(0, 1, "a", "buy", 1000.5, 1.0), place(1, 1, "b", "buy", 999.9, 2.0), place(2, 1, "c", "sell", 999.5, 4.0), place(3, 1, "d", "sell", 1000.2, 8.0)])
    got = {(r["side"], r["zone"]): r["total_qty"] for r in book.completeness(book.levels(book.at_time(lifecycle.intervals(m), 1))).collect()}
    assert (got["buy", "L1"], got["sell", "L1"]) == (1.0, 4.0)
    assert (got["buy", "10bps"], got["sell", "10bps"], got["buy", "25bps"]) == (2.0, 8.0, 2.0)


def test_passive_flow_needs_an_exact_direction(spark):
    rows = [(i, 5, d, "buy", 1.0) for i, d in enumerate(["Buy", "Sell", "buy", "", None])]
    e = spark.createDataFrame(rows, "ingest_pos long, timestamp_ms long, direction string, side string, qty double").selectExpr("'X' AS symbol", "*", "'OrderPlaced' AS event_type", "'o' AS order_uid", "10.0D AS price", "'Limit' AS order_type", "CAST(NULL AS DOUBLE) AS old_qty", "CAST(NULL AS DOUBLE) AS old_price")
    assert sorted((r["ingest_pos"], r["book_side"]) for r in atoms.passive(e).collect()) == [(0, "bid"), (1, "ask")]
    moved = e.withColumn("event_type", F.lit("OrderUpdated")).withColumn("old_price", F.lit(9.0)).withColumn("old_qty", F.lit(1.0))
    assert sorted((r["ingest_pos"], r["direction"]) for r in atoms.reprice(moved).collect()) == [(0, "toward"), (0, "toward"), (1, "away"), (1, "away")]


def test_events_without_a_time_do_nothing(spark):
    rows = [place(0, None, "a", "buy", 10.0, 5.0), place(1, 4, "a", "buy", 11.0, 2.0), change(2, None, "a", "buy", 11.0, 2.0, "OrderCancelled")]
    m, live = states(spark, rows)
    assert m.count() == 1 and live["a"]["price"] == 11.0
    e = spark.createDataFrame(rows, EVENT)
    grid = spark.createDataFrame([("X", 10)], "symbol string, anchor long")
    assert windows.regime_counts(e, grid, [5, 10], 10).collect()[0]["order_event_count_10"] == 1
    assert lifecycle.level_atoms(e).count() == 1


def test_second_session_is_written_and_first_stays(spark, tmp_path):
    path, of = str(tmp_path / "features"), lambda label, v: spark.createDataFrame([("X", label, 1, v)], "symbol string, session_label string, timestamp_ms long, x double")
    for frame, kw in ((of("LOW", 1.0), {}), (of("HIGH", 2.0), {}), (of("LOW", 3.0), {}), (of("HIGH", 4.0), {"skip_existing": False})):
        canonical.write_features(frame, path, **kw)
    assert {(r["session_label"], r["x"]) for r in canonical.read_features(spark, path).collect()} == {("LOW", 1.0), ("HIGH", 4.0)}


def test_content_hash_counts_repeated_rows(spark):
    h = lambda rows: canonical.content_hash(spark.createDataFrame(rows, "a long, b string")).collect()[0]
    assert h([(1, "x"), (2, None)]) == h([(2, None), (1, "x")])
    assert len({h(r)["content_hash"] for r in ([(1, "x")], [(1, "x")] * 2, [(1, "x")] * 3, [(2, "x")] * 2)}) == 4


def test_intervals_in_one_pass(spark):
    """Random legs of a few orders of two symbols, many in one timestamp, in one and in many batches."""
    import random

    rnd = random.Random(2)
    rows = []
    for i in range(600):
        t, uid, side = rnd.randint(0, 60), f"u{rnd.randint(0, 8)}", rnd.choice(["buy", "sell"])
        r = rnd.choice([place(i, t, uid, side, 10.0 + rnd.randint(0, 3), float(rnd.randint(1, 4))), change(i, t, uid, side, rnd.choice([None, 11.0]), float(rnd.randint(0, 4))), change(i, t, uid, side, 10.0, 1.0, "OrderCancelled"), execute(i, t, uid, f"u{rnd.randint(0, 8)}", 10.0, float(rnd.randint(0, 3)))])
        rows.append((rnd.choice("XY"), *r[1:]))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in ("7", batch):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        states(spark, rows)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_average_rank(spark):
    r = rank_pct(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None)], "k string, v double"), "v", ["k"], "p")
    assert sorted(x["p"] for x in r.where("v IS NOT NULL").collect()) == [50.0, 50.0, 100.0]


def test_percentile_table_without_rows(spark):
    assert report.percentile_table(spark.createDataFrame([], "symbol string, label string, x double"), ["x"], [50]).count() == 0


def test_jsonl_to_canonical(spark, tmp_path):
    order = {"uid": "o1", "direction": "Buy", "limitPrice": "10.5", "quantity": "2", "filled": "0", "orderType": "Limit"}
    lines = [{"uid": "e1", "timestamp": 5, "event": {"OrderPlaced": {"order": order, "reason": "new"}}}, {"uid": "e2", "timestamp": 6, "event": {"OrderUpdated": {"oldOrder": order, "newOrder": {**order, "quantity": "bad", "direction": "", "side": "sell"}}}}]
    (tmp_path / "orders.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "exec.jsonl").write_text(json.dumps({"uid": "x1", "timestamp": 6, "event": {"Execution": {"execution": {"makerOrder": {"uid": "o1"}, "takerOrder": {"uid": "o2", "direction": "Sell"}, "quantity": "1", "price": "10.5", "usdValue": ""}}}}))
    c = canonical.canonical(canonical.read_jsonl(spark, str(tmp_path / "orders.jsonl")), canonical.read_jsonl(spark, str(tmp_path / "exec.jsonl"))).orderBy("timestamp_ms", "file").collect()
    assert [r["event_type"] for r in c] == ["OrderPlaced", "OrderUpdated", "Execution"] and len({r["ingest_pos"] for r in c}) == 3
    assert (c[0]["side"], c[0]["price"], c[0]["reason"]) == ("buy", 10.5, "new") and (c[1]["side"], c[1]["qty"], c[1]["old_qty"]) == ("sell", None, 2.0)
    assert (c[2]["aggressor"], c[2]["execution_qty"], c[2]["usd_value"], c[2]["ordering_ambiguous"]) == ("sell", 1.0, None, True)


def test_lines_of_several_files(spark, tmp_path):
    """A small file before a large one of many splits: numbers run on in the order of names, so a session parted over files keeps its order."""
    line = lambda t: json.dumps({"uid": f"e{t}", "timestamp": t, "event": {}})
    (tmp_path / "a.jsonl").write_text("\n".join(map(line, range(3))))
    (tmp_path / "b.jsonl").write_text("\n".join(f"{line(t)}\n" for t in range(3, 300)))
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = canonical.read_jsonl(spark, str(tmp_path))
        assert sorted((r["ingest_pos"], r["timestamp"]) for r in rows.collect()) == [(i, i) for i in range(300)]
        assert gates.line_order(rows.select("ingest_pos", F.col("timestamp").alias("ts"))).collect()[0]["ts_order"] == "asc"
        for c in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{c}")
    (tmp_path / "none.jsonl").write_text("\n \n")
    assert canonical.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_aggressor_needs_an_exact_direction(spark, tmp_path):
    made = lambda d: json.dumps({"uid": d, "timestamp": 1, "event": {"Execution": {"execution": {"takerOrder": {"uid": "t", "direction": d}, "quantity": "1", "price": "2"}}}})
    (tmp_path / "x.jsonl").write_text("\n".join(map(made, ["Buy", "Sell", "BUY", "sell", ""])))
    x = canonical.read_jsonl(spark, str(tmp_path / "x.jsonl"))
    got = atoms.taker(canonical.canonical(x.limit(0), x).withColumn("symbol", F.lit("X")))
    assert sorted((r["ingest_pos"], r["aggressor"]) for r in got.collect()) == [(1, "buy"), (3, "sell")]


def test_executions_of_one_time_count_as_their_first(spark):
    """5 and 2 executed in one ms at one level, 3 added after each: six refilled over the first five."""
    rows = [place(0, 1, "a", "buy", 10.0, 50.0), execute(1, 5, "a", "t", 10.0, 5.0), execute(2, 5, "a", "t", 10.0, 2.0), place(3, 6, "b", "buy", 10.0, 3.0)]
    pairs = levels.refill_pairs(lifecycle.level_atoms(spark.createDataFrame(rows, EVENT)), 100)
    r = levels.level_refill(pairs, 50, 100).collect()[0]
    assert (r["refilled_qty"], r["refill_count"]) == (6.0, 2) and r["replenishment_ratio"] == pytest.approx(6 / 5)


@pytest.mark.parametrize("chunk", [1, 7, 1_000])
def test_running_levels_are_the_loop(spark, chunk):
    """Levels that empty, stay empty and refill, in chunks of a few times: the quantity never falls below zero, and an add to an empty level starts an episode."""
    import random

    rnd = random.Random(chunk)
    rows = sorted((rnd.choice("XY"), rnd.randint(0, 60), 0, i, 0, 0, rnd.choice(["buy", "sell"]), float(rnd.randint(1, 2)), rnd.choice(["add", "cancel", "exec_reduce"]), float(rnd.randint(1, 4)), "u") for i in range(500))
    a = spark.createDataFrame(rows, "symbol string, ts long, prio int, ingest_pos long, leg int, emit int, side string, price double, action string, qty double, order_uid string")
    held, episode, want = {}, {}, set()
    for r in rows:
        key = (r[0], r[6], r[7])
        if r[8] == "add":
            episode[key] = episode.get(key, 0) + (held.get(key, 0) <= 0)
            held[key] = held.get(key, 0) + r[9]
        else:
            held[key] = max(0.0, held.get(key, 0) - r[9])
        want.add((r[3], held[key], episode.get(key, 0)))
    got = lifecycle.running_levels(a.repartition(3), chunk)
    assert got.columns == [*a.columns, "level_qty", "episode_id"] and {(r["ingest_pos"], r["level_qty"], r["episode_id"]) for r in got.collect()} == want


def test_rolling_windows_match_numpy(spark):
    """Ties, unknown values and keys of a few rows; blocks of the longest context, so that a key has many."""
    import random

    import numpy as np

    rnd = random.Random(1)
    rows = [(k, t * 10, None if rnd.random() < 0.01 else float(rnd.randint(0, 9))) for k, n in (("X", 400), ("Y", 5)) for t in range(n)]
    series = spark.createDataFrame(rows, "symbol string, anchor long, v double").repartition(4)
    for n in (1, 2, 7, 30):
        values = [r[2] for r in rows[:400]]
        for i, (m, far, share) in zip(range(50, 400), rolling.sliding(values, n, 50)):
            w = values[i - n + 1 : i + 1]
            want = (None, None, None) if None in w else (np.median(w), np.median(np.abs(np.array(w) - np.median(w))), sum(x <= w[-1] for x in w) / n)
            assert (m, far, share) == want
    got = {(r["symbol"], r["anchor"]): r for r in rolling.rolling(series, "symbol", "anchor", "v", {"a": 7, "b": 30}, 700).collect()}
    assert len(got) == 405 and got["Y", 40]["med_a"] is None
    for i in range(400):
        for c, n in (("a", 7), ("b", 30)):
            w = [r[2] for r in rows[max(0, i - n + 1) : i + 1]]
            assert got["X", i * 10][f"med_{c}"] == (None if len(w) < n or None in w else np.median(w))


def test_rolling_over_blocks(spark):
    """More rows than a block has: the first of each block see those before it."""
    series = spark.range(10_000).select(F.lit("X").alias("symbol"), (F.col("id") * 5).alias("anchor"), (F.col("id") % 101).cast("double").alias("v"))
    got = {r["anchor"] // 5: r for r in rolling.rolling(series, "symbol", "anchor", "v", {"a": 101}, 3_000).collect()}
    assert len(got) == 10_000 and got[99]["med_a"] is None and all(got[i]["med_a"] == 50.0 and got[i]["mad_a"] == 25.0 for i in range(100, 10_000))
    assert got[4_096 + 7]["pct_a"] == pytest.approx(((4_103 % 101) + 1) / 101)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    """Ties, nulls, NaN, keys of one row and of none with a value, a null key, infinities and skew; with a coarse sketch most values lie outside its bounds."""
    import random

    rnd = random.Random(accuracy)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, float("nan"), 0.0, float(rnd.randint(-5, 5)), rnd.expovariate(1) ** 9, -1e300]), float(i % 3)) for i in range(3_000)]
    rows += [("one", 7.5, 1.0), ("none", None, None), ("inf", float("inf"), 1.0), ("inf", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r["k"], r["feature"]): (r["n"], r["q"]) for r in quantiles(df, ["k"], ["x", "y"], ps, accuracy).collect()}
    long = df.select("k", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in "xy"])).alias("z")).select("k", "z.*").where("v IS NOT NULL AND NOT isnan(v)")
    want = {(r["k"], r["f"]): (r["n"], r["q"]) for r in long.groupBy("k", "f").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, ps))).alias("q")).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12, nan_ok=True) for k in want)
    assert quantiles(df.limit(0), ["k"], ["x"], ps).count() == 0


def test_unknown_placings_are_censored(spark):
    rows = [place(0, 1, "a", "buy", 10.0, 2.0), place(1, 5, "b", "buy", 10.0, 1.0), place(2, 6, "c", "sell", 11.0, 1.0)]
    live = book.at_time(book.watched(lifecycle.book_intervals(spark.createDataFrame(rows, EVENT)), 5), 9)
    got = {(r["side"], r["zone"]): r["pct_known"] for r in book.completeness(book.levels(live)).collect()}
    assert got["buy", "L1"] == 33.33 and got["sell", "L1"] == 100.0
    ages = {r["side"]: (r["n_known_age"], r["n_censored_age"], r["oldest_age_ms"]) for r in book.snapshot(live).collect()}
    assert ages == {"buy": (1, 1, 4), "sell": (1, 0, 3)}


def test_unknown_event_type_keeps_its_name(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"uid": "e1", "timestamp": 5, "event": {"MarginCall": {"order": {"uid": "o"}}}}\n\n{"uid": "e2", "timestamp": null, "event": {}}\n')
    o = canonical.read_jsonl(spark, str(tmp_path / "o.jsonl"))
    c = canonical.canonical(o, o.limit(0)).orderBy("event_uid").collect()
    assert [(r["event_type"], r["order_uid"], r["timestamp_ms"]) for r in c] == [("MarginCall", None, 5), (None, None, None)]
    assert lifecycle.transitions(canonical.canonical(o, o.limit(0)).withColumn("symbol", F.lit("X"))).count() == 0


def test_stream_gives_the_batch_rows(spark, tmp_path):
    rows = [place(i, i * 7, f"u{i % 5}", "buy" if i % 2 else "sell", 10.0 + i % 3, float(i % 4 + 1)) for i in range(40)] + [execute(100 + i, i * 20 + 3, f"u{i % 5}", "t", 10.0, 1.0) for i in range(10)]
    batch = spark.createDataFrame(rows, EVENT)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))

    def ran(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = {(r["bucket_ms"], r["bid_new_qty"], r["executed_qty"]) for r in ran(flows.ofi_buckets(stream, 50, 1000), "buckets", "complete").collect()}
    want = {(r["bucket_ms"], r["bid_new_qty"], r["bid_executed_qty"]) for r in atoms.ofi_atoms(canonical.with_ambiguity(batch, ("symbol",)), 0, 10_000, 50).collect()}
    assert got == want


@pytest.mark.parametrize("kind", ["book", "level"])
def test_a_time_parted_over_micro_batches_is_one_batch(spark, tmp_path, kind):
    """Events of one ms arrive in any split over micro-batches, cancels before their places: the stream gives the batch rows."""
    import random

    rnd = random.Random(4)
    rows = []
    for i in range(150):
        t, uid = 1_000 + i // 10 * 5, f"u{rnd.randint(0, 4)}"
        rows.append(rnd.choice([place(i, t, uid, "buy", 10.0 + rnd.randint(0, 1), float(rnd.randint(1, 3))), change(i, t, uid, "buy", None, float(rnd.randint(0, 3))), change(i, t, uid, "buy", 10.0, 1.0, "OrderCancelled"), execute(i, t, uid, f"u{rnd.randint(0, 4)}", 10.0, 1.0)]))
    last = place(999, 99_999, "zz", "buy", 1.0, 1.0)  # moves the watermark past all others
    parts = [[], [], []]
    for r in rows:
        parts[rnd.randrange(3) if r[2] == rows[75][2] else min(2, r[1] // 60)].append(r)
    for n, part in enumerate([*parts, [last]]):
        rnd.shuffle(part)
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={n}"))
        for f in (tmp_path / "in" / f"n={n}").glob("part-*"):
            import os

            os.utime(f, (n * 1_000 + 1_000_000_000,) * 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(spark.createDataFrame(rows, EVENT).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
    fed, batch = (flows.book_transitions, lifecycle.transitions) if kind == "book" else (flows.level_changes, lifecycle.level_changes)
    q = fed(stream, 500).writeStream.format("memory").queryName(f"fed_{kind}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(200)
    want = batch(spark.createDataFrame(rows, EVENT))
    assert len(q.recentProgress) >= 4
    assert sorted(map(str, spark.table(f"fed_{kind}").where("ts < 90000").select(want.columns).collect())) == sorted(map(str, want.collect()))


def feature_names():
    """The 615 names by their rule: families by windows, families by sides, and single columns."""
    every, sides = features.LABELS, ("bid", "ask")
    by_window = ["order_event_count", "placed_count", "cancel_count", "update_count", "execution_count", "execution_qty", "execution_notional", "unique_order_uids", "levels_touched", "events_per_sec", "trades_per_sec", "qty_per_sec", "notional_per_sec", "bbo_change_count"]
    by_window += [f"{s}_{x}" for s in ("buy", "sell") for x in ("taker_qty", "taker_count", "notional")] + ["afi", "ask_levels_consumed", "bid_levels_consumed"]
    by_window += [f"{s}_{x}" for s in sides for x in ("add_qty", "add_orders", "cancel_qty", "cancel_orders", "net_passive", "reprice_out_qty", "reprice_in_qty", "reprice_net", "reprice_away_qty", "reprice_toward_qty", "reprice_away_count", "reprice_toward_count")]
    names = {f"{n}_{w}" for n in by_window for w in every}
    moves = ["signed_mid_change", "ticks_moved", "levels_crossed", *[f"{a}_{s}_{b}" for a, b in (("price_response_per", "qty"), ("ticks_per", "notional"), ("levels_per", "qty")) for s in ("buy", "sell")]]
    names |= {f"{n}_{w}" for n in moves for w in every[:7]}
    names |= {f"{n}_{w}" for n in ("total_exec_qty", "total_refill_qty", "replenishment_ratio", "refill_count") for w in ("100ms", "500ms", "1s", "5s")}
    names |= {f"{s}_flow_accel_{w}" for s in ("buy", "sell") for w in ("1s", "2s", "5s", "10s")}
    levels_ = ["n_levels", "total_qty", "max_qty", "p50_qty", "p75_qty", "p90_qty", "p95_qty", "max_qty_vs_median", "p95_qty_vs_median", "n_above_3x_median", "n_above_5x_median", "max_share", "top1_dist_ticks", "top1_dist_bps"]
    names |= {f"{s}_{n}" for s in sides for n in levels_} | {f"activity_{x}_{c}" for x in ("vs_trailing_median", "robust_z", "rolling_percentile") for c in ("5m", "30m")}
    names |= {"timestamp_ms", "symbol", "session_label", "source_session", "data_version", "feature_version", "book_semantics_version", "regime_percentile", "regime_state", "best_bid", "best_ask", "spread", "mid", "n_active", "near_book_depth"}
    return names | {f"{x}_{n}bps" for x in ("depth_bid", "depth_ask", "obi") for n in (5, 10, 25)}


def test_feature_names(spark):
    """The plan itself has them, each once; it is only analysed here."""
    rows = [place(i, i * 700, f"u{i}", "buy" if i % 2 else "sell", 10.0 + i % 3, 1.0) for i in range(6)] + [execute(9, 2_500, "u1", "u2", 10.0, 1.0)]
    e = canonical.with_ambiguity(spark.createDataFrame(rows, EVENT), ("symbol",))
    grid = spark.createDataFrame([("X", 1_000), ("X", 2_000), ("X", 3_000)], "symbol string, anchor long")
    columns = features.build(e, grid).columns
    assert len(columns) == len(set(columns)) == 615 and set(columns) == feature_names()


def test_samples_and_episodes(spark):
    """The same rows every time, no more than asked for, each from its own set."""
    rows = spark.createDataFrame([("X", "LOW", i, float(i), float(i % 10), float(i % 7), float(i % 50), float(i % 40)) for i in range(400)], "symbol string, label string, ts long, sell double, buy double, resp double, done double, refill double")
    a, b = (report.sample_k(rows.repartition(n), ["ts"], 20).select("ts").collect() for n in (2, 5))
    assert a == b and len(a) == 20
    c = report.episode_candidates(rows, "sell", "buy", "resp", "done", "refill")
    held = {}
    for r in c.select("kind", "ts").collect():
        held.setdefault(r["kind"], set()).add(r["ts"])
    assert set(held) == {"top1pct_sell", "top1pct_buy", "high_flow_low_response", "high_flow_high_response", "high_exec_high_repl"}
    assert held["top1pct_sell"] == {396, 397, 398, 399} and held["high_flow_low_response"] | held["high_flow_high_response"] == set(range(360, 400))
    got = [report.episodes(c.repartition(n)).collect() for n in (2, 5)]
    assert sorted(got[0]) == sorted(got[1]) and all(r["ts"] in held[r["kind"]] and r["i"] <= 3 for r in got[0]) and len(got[0]) == 15


def test_session_gate_and_manifest(spark):
    """Stage two runs where the files pass; a late interval, a repeated id or times that rise and fall stop it."""
    lines = lambda ts: spark.createDataFrame([(f"e{i}", t, i) for i, t in enumerate(ts)], "uid string, timestamp long, ingest_pos long")
    e = canonical.with_ambiguity(spark.createDataFrame([place(0, 1_000, "a", "buy", 10.0, 1.0), place(1, 1_000, "b", "sell", 11.0, 1.0), execute(2, 3_000, "a", "b", 10.0, 1.0)], EVENT), ("symbol",))
    gate = lambda ts, before=5_000: gates.session_gate(lines(ts), lines([1]), e, 0, 2_000, before).collect()[0]
    good = gate([3_000, 2_000, 2_000, 1_000])
    assert (good["dl_verdict"], good["mkt_verdict"], good["final_verdict"]) == ("PASS", "PASS", "PASS")
    bad = gate([3_000, 1_000, 2_000])
    assert (bad["dl_verdict"], bad["mkt_verdict"], bad["final_verdict"], bad["dl_reason"]) == ("FAIL", "SKIPPED", "FAIL", "times rise and fall")
    assert gate([1_000, 2_000], 10**9)["dl_reason"].startswith("newest 2000")
    twice = spark.createDataFrame([("x", 1, 0), ("x", 2, 1), (None, 3, 2)], "uid string, timestamp long, ingest_pos long")
    assert gates.download_truth(twice, lines([1]), 0, 10).collect()[0]["dup_event_uid"] == 2
    m = gates.manifest(lines([9, 5, 1]), "orders", 0, 10).collect()[0]
    assert (m["first_ts"], m["last_ts"], m["status"]) == (9, 1, "COMPLETE_LEGACY_VERIFIED") and gates.manifest(lines([9]), "orders", 0, 10**9).count() == 0
    far = lines([*range(2_000_000, 2_000_010)]).withColumn("ingest_pos", F.col("ingest_pos") * (1 << 20)).withColumnRenamed("timestamp", "ts")
    assert gates.line_order(far).collect()[0]["ts_order"] == "asc"


def test_reports_as_text(spark, tmp_path):
    rows = spark.createDataFrame([("LOW", 1.5), (None, 2.0)], "label string, x double").coalesce(1)
    lines = canonical.markdown(rows)
    assert lines == ["| label | x |", "|---|---|", "| LOW | 1.5 |", "|  | 2.0 |"]
    with pytest.raises(ValueError, match="more than 1 rows"):
        canonical.markdown(rows, 1)
    canonical.write_text(lines, str(tmp_path / "r"), spark)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()] == lines
    canonical.write_report(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    (tmp_path / "m.csv").write_text("selected,warmup_start,research_end\nHIGH,2026-01-01T02:00:00Z,2026-01-01T04:00:00Z\n,x,y\nLOW,2026-01-01T00:00:00Z,2026-01-01T02:00:00Z\n")
    s = canonical.read_sessions(spark, str(tmp_path / "m.csv")).collect()
    assert [r["selected"] for r in s] == ["LOW", "HIGH"] and s[0]["before_ms"] - s[0]["since_ms"] == 7_200_000


def test_run_log_and_provenance(spark, tmp_path):
    """A row for each session, with what was counted while it was written; hashes follow the files' bytes."""
    import hashlib

    path, log = str(tmp_path / "features"), str(tmp_path / "log")
    of = lambda label, n: spark.range(n).select(F.lit("X").alias("symbol"), F.lit(label).alias("session_label"), F.col("id").alias("timestamp_ms"), F.lit("2").alias("feature_version"), F.lit("1").alias("book_semantics_version")).repartition(1)
    got = {r["session_label"]: r for r in runlog.run_sessions([of("LOW", 50), of("HIGH", 70), of("NONE", 0)], path, log).collect()}
    assert {k: (r["n_rows"], r["n_cols"]) for k, r in got.items()} == {"LOW": (50, 5), "HIGH": (70, 5)}
    assert all(r["wall_s"] > 0 and r["tasks"] > 0 and r["parquet_mb"] > 0 and r["spilled_mb"] == 0 for r in got.values())
    p = {r["session_label"]: r for r in runlog.provenance(spark, path).collect()}
    files = list((tmp_path / "features" / "symbol=X" / "session_label=LOW").glob("*.parquet"))
    assert len(files) == 1 and p["LOW"]["parquet_sha256_16"] == hashlib.sha256(files[0].read_bytes()).hexdigest()[:16]
    assert (p["HIGH"]["n_rows"], p["HIGH"]["feature_version"], p["HIGH"]["files"]) == (70, "2", 1)


def test_spans_are_half_open(spark):
    """An event at since counts, one at before does not; buckets start at multiples of their width."""
    e = canonical.with_ambiguity(spark.createDataFrame([place(i, t, f"u{i}", "buy", 10.0, 1.0) for i, t in enumerate((99, 100, 149, 150, 199, 200))], EVENT), ("symbol",))
    assert {r["bucket_ms"]: r["placed_orders"] for r in atoms.flow_taxonomy(e, 100, 200, 50).collect()} == {100: 2, 150: 2}
    assert {r["bucket_ms"]: r["bid_new_orders"] for r in atoms.ofi_atoms(e, 100, 200, 50).collect()} == {100: 2, 150: 2}


def test_as_of_over_chunks(spark):
    """An observation is carried over chunks that have none."""
    obs = spark.createDataFrame([("X", 5, 1.0), ("X", 42, None), ("X", 95, 3.0), ("Y", 1, 9.0)], "symbol string, ts long, mid double")
    pts = spark.createDataFrame([("X", t) for t in (0, 5, 39, 42, 90, 300)] + [("Y", 300), ("Z", 5)], "symbol string, anchor long")
    got = {(r["symbol"], r["anchor"]): r["mid"] for r in windows.as_of(pts, obs, "anchor", ["mid"], 10).collect()}
    assert got == {("X", 0): None, ("X", 5): 1.0, ("X", 39): 1.0, ("X", 42): None, ("X", 90): None, ("X", 300): 3.0, ("Y", 300): 9.0, ("Z", 5): None}


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_swept_states_are_those_of_live_orders(spark, chunk):
    """best(), depth() and top_levels() of the orders alive at each anchor, in crossed, one-sided, empty and odd-priced books of two symbols, over many chunks and in one; in doubles and in decimals."""
    import random

    rnd = random.Random(chunk)
    rows = []
    for i in range(160):
        t, uid = rnd.randint(0, 60), f"u{rnd.randint(0, 50)}"
        r = place(i, t, uid, rnd.choice(["buy", "sell", "odd"]), rnd.choice([0.0, -1.0, *(100 + x / 100 for x in range(-30, 30, 7))]), rnd.randint(1, 9) / 4) if rnd.random() < 0.7 else change(i, t, uid, None, None, None, "OrderCancelled")
        rows.append((rnd.choice("XXY"), *r[1:]))
    grid = spark.createDataFrame([("X", t) for t in range(10, 90, 5)] + [("Y", t) for t in range(-5, 30, 5)] + [("Z", 5)], "symbol string, anchor long")
    for kind in ("double", "decimal(18,2)"):
        e = spark.createDataFrame(rows, EVENT).withColumn("qty", F.col("qty").cast(kind))
        spans = lifecycle.book_intervals(e)
        l = book.levels(book.at_anchors(spans, grid, 5))
        top = book.best(l)
        apart = top.join(book.depth(l, top, [5, 10, 25]), ["symbol", "anchor"]).join(book.top_levels(l), ["symbol", "anchor"]).drop("best_bid_qty", "best_ask_qty")
        got = sweep.book_states(spans, grid, 5, (5, 10, 25), (1, 5, 10), chunk)
        assert set(got.columns) == set(apart.columns) and got.count() == grid.count()
        names = sorted(got.columns)
        assert sorted(map(str, got.where("n_active > 0").select(names).collect())) == sorted(map(str, apart.withColumn("n_active", F.col("n_active").cast("long")).select(names).collect()))


@pytest.mark.parametrize("chunk", [1, 4, 256])
def test_swept_levels_match_brute_force(spark, chunk):
    import random

    import numpy as np

    rnd = random.Random(chunk)
    rows = sorted((rnd.choice("XY"), rnd.choice(["buy", "sell"]), 10.0 + rnd.randint(0, 12), rnd.randint(0, 90), i, rnd.choice([0.0, 0.5, 1.0, 2.0, 7.0, 30.0])) for i in range(400))
    atoms_ = spark.createDataFrame(rows, "symbol string, side string, price double, ts long, ingest_pos long, level_qty double").selectExpr("*", "0 AS prio", "0 AS leg", "0 AS emit")
    grid = spark.createDataFrame([("X", t) for t in range(0, 100, 5)] + [("Y", t) for t in range(40, 70, 5)], "symbol string, anchor long")
    got = {(r["symbol"], r["anchor"], r["side"]): r for r in sweep.level_states(atoms_, grid, 5, 1e-12, chunk).collect()}
    want = 0
    for symbol, anchor in [tuple(r) for r in grid.collect()]:
        for side in ("buy", "sell"):
            last = {}
            for r in sorted((r for r in rows if r[0] == symbol and r[1] == side and r[3] <= anchor), key=lambda r: (r[3], r[4])):
                last[r[2]] = r[5]
            q = {p: v for p, v in last.items() if v > 0}
            if q:
                want += 1
                r, v = got[symbol, anchor, side], list(q.values())
                assert (r["n_levels"], r["total_qty"], r["max_qty"], r["nearest"]) == (len(v), sum(v), max(v), (max if side == "buy" else min)(q))
                assert [r[f"{p}_qty"] for p in sweep.QUANTILES] == pytest.approx(np.quantile(v, list(sweep.QUANTILES.values())).tolist())
                assert (r["n_above_3x_median"], r["n_above_5x_median"]) == tuple(sum(x > k * (np.median(v) + 1e-12) for x in v) for k in (3, 5))
    assert want == len(got)
