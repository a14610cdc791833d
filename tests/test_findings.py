"""What a review found: each test failed before its finding was settled."""

import os
import random

import duckdb
import pytest
from oracle import TABLES, compare
from pyspark.sql import functions as F
from test_queries import SF

from flowloom.operators import book, levels, lifecycle, windows
from flowloom.plans import registry, report, report_queries
from flowloom.sources import demo


def whole_stream(spark, name, placed):
    """The query's buckets reach over the whole stream, and its placed orders are all there are."""
    e = demo.events(spark, SF)
    bucket = F.col("timestamp_ms") - F.col("timestamp_ms") % 360
    want = e.agg(F.min(bucket), F.max(bucket), F.count_if(F.col("event_type") == "OrderPlaced")).collect()[0]
    got = registry.queries()[name](spark, SF).agg(F.min("bucket_ms"), F.max("bucket_ms"), F.sum(F.expr(placed))).collect()[0]
    assert tuple(got) == tuple(want)


def test_flow_taxonomy_counts_the_whole_stream(spark):
    whole_stream(spark, "g1_flow_taxonomy", "placed_orders")


def test_ofi_atoms_count_the_whole_stream(spark):
    whole_stream(spark, "g2_ofi_atoms", "bid_new_orders + ask_new_orders")


def random_crossings(spark):
    """A stream whose book crosses often: many orders at few prices, with ids that come again, moves and executions."""
    rnd, rows = random.Random(7), []
    for i in range(900):
        ts, uid, side = rnd.randint(1, 400), str(rnd.randint(1, 60)), rnd.choice(["buy", "sell"])
        kind = rnd.choice(["OrderPlaced"] * 3 + ["OrderUpdated", "OrderCancelled", "Execution"])
        price, qty = float(rnd.randint(9, 12)), float(rnd.randint(1, 5))
        rows.append(("X", i, ts, kind, None, None, None, None, uid, str(rnd.randint(1, 60)), price, qty) if kind == "Execution" else ("X", i, ts, kind, uid, side, price, qty, None, None, None, None))
    e = spark.createDataFrame(rows, "symbol string, ingest_pos long, timestamp_ms long, event_type string, order_uid string, side string, price double, qty double, maker_uid string, taker_uid string, execution_price double, execution_qty double")
    s = lifecycle.book_intervals(e)
    top = book.batches_best(s, e, 50)
    return e, s, top, book.crossings(top, s, 50)


def test_crossings_are_classified_without_lists_of_their_orders(spark):
    e, s, top, listed = random_crossings(spark)
    c = book.crossed(top)
    got = {tuple(r) for r in book.kinds(c, book.explained(c, s, e)).collect()}
    assert got == {tuple(r) for r in book.classified(listed, e).collect()} and len({r[5] for r in got}) == 3


def test_chunks_of_best_prices_start_from_levels(spark):
    """The sweep's input has a row per level and chunk, not one per order and chunk."""
    e = spark.createDataFrame([("X", i, 1, "OrderPlaced", str(i), "buy", 10.0, 1.0) for i in range(2_000)] + [("X", 2_000, 1_000, "OrderPlaced", "last", "buy", 10.0, 1.0)], "symbol string, ingest_pos long, timestamp_ms long, event_type string, order_uid string, side string, price double, qty double")
    e = e.selectExpr("*", "cast(null AS string) AS maker_uid", "cast(null AS string) AS taker_uid", "cast(null AS double) AS execution_price", "cast(null AS double) AS execution_qty")
    top = book.batches_best(lifecycle.book_intervals(e), e, 10)
    assert {(r["ts"], r["best_bid"], r["n_bid"]) for r in top.collect()} == {(1, 10.0, 2_000), (1_000, 10.0, 2_001)}


def test_first_orders_of_crossings_without_lists_of_all(spark):
    e, s, top, listed = random_crossings(spark)
    c = book.crossed(top)
    got = {tuple(r) for r in c.join(book.first_uids(c, s), ["symbol", "ts"]).select("ts", "n_bid", "n_ask", "first_bid_uid", "first_ask_uid").collect()}
    want = {tuple(r) for r in listed.selectExpr("ts", "size(bid_uids)", "size(ask_uids)", "bid_uids[0]", "ask_uids[0]").collect()}
    assert got == want and len(got) > 100


def test_refills_are_those_of_the_pairs(spark):
    """Windows below, at and off the step, up to the horizon; anchors that end before the last refill."""
    rnd = random.Random(3)
    rows = [(rnd.choice("XY"), rnd.randint(0, 90), i, rnd.choice(["buy", "sell"]), rnd.choice([1.0, 2.0, None]), rnd.choice(["add", "exec_reduce", "cancel"]), float(rnd.randint(1, 9))) for i in range(600)]
    a = spark.createDataFrame(rows, "symbol string, ts long, ingest_pos long, side string, price double, action string, qty double")
    grid = spark.createDataFrame([(s, t) for s in "XY" for t in range(6, 80, 6)], "symbol string, anchor long")
    columns = ["symbol", "anchor", "w", "total_exec_qty", "total_refill_qty", "refill_count", "max_refill", "replenishment_ratio"]
    want = {tuple(r) for r in levels.replenishment(levels.refill_pairs(a, 30), grid, [4, 6, 15, 30], 6).select(*columns).collect()}
    assert {tuple(r) for r in levels.refills(a, grid, 30, [4, 6, 15, 30], 6).select(*columns).collect()} == want and len(want) > 80


def test_near_market_ranks_a_column_once(spark, monkeypatch):
    """Eight names stand for six columns."""
    asked, beside = [], report_queries.beside
    monkeypatch.setattr(report_queries, "beside", lambda found, rows, keys, wanted: asked.append(wanted) or beside(found, rows, keys, wanted))
    assert registry.queries()["g13_near_market"](spark, SF).count() > 0
    assert len({c for c, _ in asked[0].values()}) == 6


def test_changes_of_distinct_counts_do_not_grow_with_the_keys(spark):
    """Windows below, at and off the step, over several spans: counts are those of brute force, and what reaches the anchors is a row for each anchor, key column and window."""
    rnd = random.Random(5)
    rows = [("X", rnd.randint(1, 400), str(rnd.randint(1, 300)), rnd.choice(["a", "b", "c", None])) for _ in range(4_000)]
    e = spark.createDataFrame(rows, "symbol string, ts long, uid string, price string")
    grid = spark.createDataFrame([("X", t) for t in range(10, 410, 10)], "symbol string, anchor long")
    sizes, names = [3, 10, 25, 60], {"uids": (None, "uid"), "prices": ("uid > '2'", "price")}
    got = {tuple(r) for r in windows.windowed(e, grid, {}, sizes, 10, names, length=8).select("anchor", *[f"{n}_{w}" for n in names for w in sizes]).collect()}
    seen = lambda a, w: [r for r in rows if a - w < r[1] <= a]
    want = {(a, *[len({r[2] for r in seen(a, w)}) for w in sizes], *[len({r[3] for r in seen(a, w) if r[2] > "2"} - {None}) for w in sizes]) for a in range(10, 410, 10)}
    assert got == want
    # anchors up to the longest window's end, for two key columns
    assert windows.deltas(e, names, sizes, 10, 80).count() <= (400 + 60) // 10 * len(names) * len(sizes)


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """The tables with times within a millisecond of the next minute, some before 1970."""
    out = tmp_path_factory.mktemp("edges")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SF}/{t}.parquet", out / f"{t}.parquet")
    part = "CASE event_id % 4 WHEN 0 THEN 59999499 WHEN 1 THEN 59999500 WHEN 2 THEN 59999999 ELSE 30000000 END"
    ts = f"date_trunc('minute', ts) - to_years(CASE WHEN event_id % 50 < 4 THEN 60 ELSE 0 END) + to_microseconds({part})"
    duckdb.sql(f"COPY (SELECT * REPLACE ({ts} AS ts) FROM '{SF}/events.parquet') TO '{out}/events.parquet'")
    return str(out)


ROUNDED = "e1_canonical_events a1_taker_atoms b1_transitions b5_intervals e10_neighbourhood e9_lifecycle j2_refill_pairs l1_level_atoms o13_first_per_key p1_passive_atoms p3_reprice_atoms s17_content_hash s1_json_lines".split()


@pytest.mark.parametrize("name", ROUNDED)
def test_times_are_rounded_to_milliseconds_as_in_the_sql(spark, edges, name):
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], edges) == ""


def test_samples_of_rows_with_one_key_do_not_depend_on_their_order(spark):
    """Where the k-th place falls among rows of one key, the same rows are taken however the input lies."""
    rows = [(ts, s, x) for ts in range(8) for s in "ANR" for x in (1.0, 2.0)]
    tables = [spark.createDataFrame(r, "ts long, symbol string, x double").coalesce(1) for r in (rows, rows[::-1])]
    for k in (1, 7, 20):
        a, b = ([tuple(r) for r in report.sample_k(t, ["ts"], k).collect()] for t in tables)
        assert a == b and len(a) == k


def test_refill_pairs_are_found_in_short_buckets_and_not_rounded_one_by_one(spark):
    """Horizons below, at and off the number of buckets, times before and after 0."""
    rnd = random.Random(9)
    rows = [("X", rnd.randint(-60, 60), i, rnd.choice(["buy", "sell"]), rnd.choice([1.0, 2.0]), rnd.choice(["add", "exec_reduce"]), float(i)) for i in range(200)]
    a = spark.createDataFrame(rows, "symbol string, ts long, ingest_pos long, side string, price double, action string, qty double")
    for horizon in (1, 7, 8, 9, 30):
        got = sorted(tuple(r) for r in levels.refill_pairs(a, horizon).select("exec_qty", "refill_qty", "delay_ms").collect())
        assert got == sorted((x[6], y[6], y[1] - x[1]) for x in rows for y in rows if x[5] == "exec_reduce" and y[5] == "add" and x[3:5] == y[3:5] and 0 < y[1] - x[1] <= horizon)
    plan = registry.queries()["j2_refill_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[: plan.index("Join")] and "round(" in plan
