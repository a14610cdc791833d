"""Book states from order intervals: snapshots, best prices, depth, completeness, the anchor series and crossings."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sweep
from .windows import ceil_to


def at_anchors(spans: DataFrame, grid: DataFrame, step: int) -> DataFrame:
    """Rows with from_ts, to_ts once for every anchor in [from_ts, to_ts)."""
    last = grid.groupBy("symbol").agg(F.min("anchor").alias("a0"), F.max("anchor").alias("a1"))
    rows = spans.join(last, "symbol")
    a, b = F.greatest(ceil_to(F.col("from_ts"), step), F.col("a0")), F.least(F.coalesce(ceil_to(F.col("to_ts"), step) - step, F.col("a1")), F.col("a1"))
    return rows.withColumn("a", a).withColumn("b", b).where("a <= b").withColumn("anchor", F.explode(F.sequence("a", "b", F.lit(step).cast("long")))).drop("a", "b", "a0", "a1")


def at_time(spans: DataFrame, t: int) -> DataFrame:
    return spans.where((F.col("from_ts") <= t) & (F.col("to_ts").isNull() | (F.col("to_ts") > t))).withColumn("anchor", F.lit(t).cast("long"))


def watched(spans: DataFrame, since: int) -> DataFrame:
    """Spans as known to one who has watched from `since` on: when older orders were placed is unknown."""
    return spans.withColumn("placed_ms", F.when(F.col("placed_ms") >= since, F.col("placed_ms")))


def levels(live: DataFrame) -> DataFrame:
    """Live orders (at_anchors, at_time) per side and price; first_qty is that of the order placed first."""
    age = F.col("anchor") - F.col("placed_ms")
    return live.groupBy("symbol", "anchor", "side", "price").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n_orders"), F.min_by("qty", F.struct("placed_ms", "placed_pos")).alias("first_qty"), F.max(age).alias("oldest_age_ms"), F.min(age).alias("newest_age_ms"), F.count("placed_ms").alias("n_known_age"), F.sum(F.when(F.col("placed_ms").isNotNull(), F.col("qty"))).alias("known_qty"))


def snapshot(live: DataFrame) -> DataFrame:
    l = levels(live)
    buy = F.col("side") == "buy"
    return l.select("symbol", "anchor", "side", "price", F.when(buy, F.col("qty")).alias("bid_qty"), F.when(~buy, F.col("qty")).alias("ask_qty"), "n_orders", (F.col("qty") / F.col("n_orders")).alias("mean_size"), "oldest_age_ms", "newest_age_ms", "n_known_age", (F.col("n_orders") - F.col("n_known_age")).alias("n_censored_age"))


def best(l: DataFrame) -> DataFrame:
    """Best prices per anchor; prices of 0 and below count as active orders but never as best."""
    bid, ask = (F.when((F.col("side") == s) & (F.col("price") > 0), F.col("price")) for s in ("buy", "sell"))
    out = l.groupBy("symbol", "anchor").agg(F.max(bid).alias("best_bid"), F.min(ask).alias("best_ask"), F.max_by("first_qty", bid).alias("best_bid_qty"), F.min_by("first_qty", ask).alias("best_ask_qty"), F.sum("n_orders").alias("n_active"))
    return out.withColumn("spread", F.col("best_ask") - F.col("best_bid")).withColumn("mid", (F.col("best_ask") + F.col("best_bid")) / 2)


def within(bps: int) -> Column:
    """Whether a level of its side (columns side, price, mid) lies from the mid to so many basis points beyond it: bids below, asks above."""
    return F.expr(f"CASE WHEN side = 'buy' THEN price BETWEEN mid * {1 - bps / 1e4}D AND mid ELSE price BETWEEN mid AND mid * {1 + bps / 1e4}D END")


def depth(l: DataFrame, top: DataFrame, bps: list[int]) -> DataFrame:
    """Quantity within so many basis points of the mid on each side, and their imbalance."""
    rows = l.join(top.select("symbol", "anchor", "mid"), ["symbol", "anchor"])
    aggs = []
    for n in bps:
        aggs += [F.sum(F.when(within(n) & (F.col("side") == s), F.col("qty"))).alias(f"__{name}{n}") for name, s in (("bid", "buy"), ("ask", "sell"))]
    out = rows.groupBy("symbol", "anchor", "mid").agg(*aggs)
    known = [f"CASE WHEN mid IS NOT NULL THEN coalesce(cast(__{s}{n} AS double), 0D) END AS depth_{s}_{n}bps" for n in bps for s in ("bid", "ask")]
    share = lambda n: f"try_divide(depth_bid_{n}bps - depth_ask_{n}bps, depth_bid_{n}bps + depth_ask_{n}bps)"
    out = out.selectExpr("symbol", "anchor", "mid", *known)
    return out.selectExpr("symbol", "anchor", *[x for n in bps for x in (f"depth_bid_{n}bps", f"depth_ask_{n}bps", f"CASE WHEN mid IS NOT NULL THEN round(coalesce({share(n)}, 0D), 4) END AS obi_{n}bps")])


def series(spans: DataFrame, grid: DataFrame, step: int, bps: tuple[int, ...] = (5, 10, 25)) -> DataFrame:
    """Best prices and depth at every anchor."""
    out = grid.join(sweep.book_states(spans, grid, step, bps), ["symbol", "anchor"], "left")
    near = F.coalesce("depth_bid_10bps", F.lit(0.0)) + F.coalesce("depth_ask_10bps", F.lit(0.0))
    return out.withColumn("n_active", F.coalesce("n_active", F.lit(0))).withColumn("near_book_depth", near)


def top_levels(l: DataFrame, counts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Quantity of the first levels of each side from the touch, prices of 0 included."""
    rank = F.dense_rank().over(Window.partitionBy("symbol", "anchor", "side").orderBy(F.when(F.col("side") == "buy", -F.col("price")).otherwise(F.col("price"))))
    r = l.withColumn("r", rank)
    return r.groupBy("symbol", "anchor").agg(*[F.coalesce(F.sum(F.when((F.col("side") == s) & (F.col("r") <= n), F.col("qty"))), F.lit(0)).cast("double").alias(f"{name}_l{n}_qty") for n in counts for name, s in (("bid", "buy"), ("ask", "sell"))])


def market_state(spans: DataFrame, grid: DataFrame, step: int) -> DataFrame:
    """Best prices, depth and first levels at every anchor of the grid; several grids whose steps are multiples of step may be one."""
    return sweep.book_states(spans, grid, step, (5, 10, 25, 50), (1, 5, 10))


def completeness(l: DataFrame, n_levels: int = 10) -> DataFrame:
    """Per side: quantity near the touch and how much of it belongs to orders whose placing was seen. Zones in basis points reach from the mid outwards, and need one."""
    top = best(l).select("symbol", "anchor", "mid")
    r = l.where("price > 0").withColumn("r", F.dense_rank().over(Window.partitionBy("symbol", "anchor", "side").orderBy(F.when(F.col("side") == "buy", -F.col("price")).otherwise(F.col("price"))))).join(top, ["symbol", "anchor"])
    zones = [("L1", F.col("r") <= 1), ("L5", F.col("r") <= 5), (f"L{n_levels}", F.col("r") <= n_levels), *[(f"{b}bps", within(b)) for b in (10, 25)]]
    inside = r.withColumn("zone", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(z)) for z, c in zones]))))
    out = inside.groupBy("symbol", "anchor", "side", "zone").agg(F.sum("qty").alias("total_qty"), F.coalesce(F.sum("known_qty"), F.lit(0)).alias("known_qty"))
    return out.withColumn("pct_known", F.round(F.try_divide(F.col("known_qty").cast("double") * 100, F.col("total_qty").cast("double")), 2))


def batches_best(spans: DataFrame, events: DataFrame, chunk: int) -> DataFrame:
    """(symbol, ts, best_bid, best_ask, n_bid, n_ask) after each timestamp's batch, n the orders at the best price. Time is cut into chunks; a chunk starts from the levels alive at its start and sweeps on alone."""
    times = events.where("timestamp_ms IS NOT NULL").select("symbol", F.floor(F.col("timestamp_ms") / chunk).alias("c"), F.col("timestamp_ms").alias("ts")).distinct().withColumn("d", F.lit(0).cast("long"))
    ends = F.array(F.struct(F.col("from_ts").alias("ts"), F.lit(1).alias("d")), F.struct(F.col("to_ts").alias("ts"), F.lit(-1).alias("d")))
    moves = spans.where("price > 0").select("symbol", "side", "price", F.explode(ends).alias("m")).where("m.ts IS NOT NULL")
    moves = moves.groupBy("symbol", "side", "price", F.col("m.ts").alias("ts")).agg(F.sum("m.d").alias("d")).where("d <> 0").withColumn("c", F.floor(F.col("ts") / chunk))
    # a chunk starts with a row for each level alive, whatever the number of its orders
    held = Window.partitionBy("symbol", "side", "price").orderBy("c")
    left = moves.groupBy("symbol", "side", "price", "c").agg(F.sum("d").alias("d")).select("symbol", "side", "price", "c", F.sum("d").over(held.rowsBetween(Window.unboundedPreceding, 0)).alias("d"), F.lead("c").over(held).alias("until"))
    left = left.where("d > 0").join(events.groupBy("symbol").agg(F.floor(F.max("timestamp_ms") / chunk).alias("last")), "symbol").withColumn("until", F.least(F.coalesce("until", "last"), "last"))
    start = left.where("c < until").select("symbol", "side", "price", "d", F.explode(F.sequence(F.col("c") + 1, "until")).alias("c")).withColumn("ts", F.col("c") * chunk)
    both = moves.unionByName(start).unionByName(times, allowMissingColumns=True)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, live, heaps = None, ({}, {}), ([], [])

        def best(ask: bool) -> tuple[float | None, int]:
            """The best price alive and its orders; prices that are gone leave the heap when they come up."""
            heap, sign = heaps[ask], 1 if ask else -1
            while heap and sign * heap[0] not in live[ask]:
                heappop(heap)
            return (sign * heap[0], live[ask][sign * heap[0]]) if heap else (None, 0)

        for b in found:
            out = []
            for symbol, c, ts, d, side, price in zip(*(b[n].to_pylist() for n in ("symbol", "c", "ts", "d", "side", "price"))):
                if (symbol, c) != now:
                    now, live, heaps = (symbol, c), ({}, {}), ([], [])
                if d:
                    ask = side != "buy"
                    book = live[ask]
                    if price not in book:
                        heappush(heaps[ask], price if ask else -price)
                    book[price] = book.get(price, 0) + d
                    if not book[price]:
                        del book[price]
                else:
                    (bid, n_bid), (ask, n_ask) = best(False), best(True)
                    out.append((symbol, ts, bid, ask, n_bid, n_ask))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))], ["symbol", "ts", "best_bid", "best_ask", "n_bid", "n_ask"])

    width = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(width, "symbol", "c").sortWithinPartitions("symbol", "c", "ts", F.col("d") == 0).mapInArrow(run, "symbol string, ts long, best_bid double, best_ask double, n_bid long, n_ask long")


def crossed(top: DataFrame) -> DataFrame:
    """Timestamps after which the book is crossed or locked."""
    return top.where("best_bid >= best_ask").withColumn("cross_width", F.col("best_bid") - F.col("best_ask"))


def best_levels(c: DataFrame) -> DataFrame:
    """The two levels (symbol, ts, side, price) at the best prices of each crossing."""
    price = F.explode(F.array(F.struct(F.lit("buy").alias("side"), F.col("best_bid").alias("price")), F.struct(F.lit("sell").alias("side"), F.col("best_ask").alias("price"))))
    return c.select("symbol", "ts", price.alias("x")).select("symbol", "ts", "x.side", "x.price")


def at_best(c: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The levels of crossings with the first and last time each is a best one, and the spans of orders there, clipped to these times."""
    at = best_levels(c)
    reach = at.groupBy("symbol", "side", "price").agg(F.min("ts").alias("first"), (F.max("ts") + 1).alias("last"))
    here = spans.select("symbol", "side", "price", "uid", "from_ts", "to_ts").join(reach, ["symbol", "side", "price"])
    here = here.withColumns({"a": F.greatest("from_ts", "first"), "b": F.least(F.coalesce("to_ts", "last"), "last")}).where("a < b")
    return at.join(reach, ["symbol", "side", "price"]), here.select("symbol", "side", "price", "uid", "a", "b")


def first_uids(c: DataFrame, spans: DataFrame) -> DataFrame:
    """(symbol, ts, first_bid_uid, first_ask_uid): the smallest ids alive at the best prices of each crossing.

    A span is cut into spans of powers of two, each from a multiple of its length, of which it needs twice as many as its length has bits; a time lies in one span of
    each length. So neither side has a row for each order and crossing.
    """
    at, here = at_best(c, spans)
    bits = lambda length: f"cast(floor(log2({length})) AS int) + 1"
    ends = f"transform(sequence(0, {bits('b - a')}), k -> struct(k, -shiftright(-a, k) AS l, shiftright(b, k) AS r))"
    cut = f"flatten(transform(filter({ends}, x -> x.l < x.r), x -> filter(array(IF(x.l % 2 <> 0, struct(x.k, x.l AS i), NULL), IF(x.r % 2 <> 0, struct(x.k, x.r - 1 AS i), NULL)), y -> y IS NOT NULL)))"
    parts = here.selectExpr("symbol", "side", "price", "uid", f"explode({cut}) AS x").groupBy("symbol", "side", "price", "x.k", "x.i").agg(F.min("uid").alias("uid"))
    asked = at.selectExpr("symbol", "side", "price", "ts", f"explode(transform(sequence(0, {bits('last - first')}), k -> struct(k, shiftright(ts, k) AS i))) AS x").select("symbol", "side", "price", "ts", "x.k", "x.i")
    found = asked.join(parts, ["symbol", "side", "price", "k", "i"])
    return found.groupBy("symbol", "ts").agg(*[F.min(F.when(F.col("side") == s, F.col("uid"))).alias(f"first_{n}_uid") for n, s in (("bid", "buy"), ("ask", "sell"))])


def explained(c: DataFrame, spans: DataFrame, events: DataFrame, look_ahead: int = 3) -> DataFrame:
    """(symbol, ts, explained_dt): how soon, in the next timestamps, an order at a crossing's best prices is executed.

    Executions look back: each asks whether its orders were at the best price of a crossing, by the span that an order had then, so no crossing lists its orders.
    """
    x = c.where("cross_width > 0")
    used = events.where("event_type = 'Execution'").select("symbol", F.col("timestamp_ms").alias("at"), F.explode(F.array("maker_uid", "taker_uid")).alias("uid")).where("uid IS NOT NULL")
    asked = used.withColumn("dt", F.explode(F.sequence(F.lit(1), F.lit(look_ahead)))).withColumn("ts", F.col("at") - F.col("dt")).join(x.select("symbol", "ts", "best_bid", "best_ask"), ["symbol", "ts"])
    here = at_best(x, spans)[1].select("symbol", "uid", F.col("a").alias("ts"), F.struct("side", "price", "b").alias("s"))
    both = asked.select("symbol", "uid", "ts", "dt", "best_bid", "best_ask").unionByName(here, allowMissingColumns=True)
    w = Window.partitionBy("symbol", "uid").orderBy("ts", F.col("dt").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("s", F.last("s", ignorenulls=True).over(w)).where("dt IS NOT NULL AND s.b > ts AND s.price = IF(s.side = 'buy', best_bid, best_ask)")
    return held.groupBy("symbol", "ts").agg(F.min("dt").alias("explained_dt"))


def crossings(top: DataFrame, spans: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Timestamps after which the book is crossed or locked, with lists of the orders at the best prices. Both sides meet by price and chunk of time; its rows grow with orders times crossings, so what asks for less takes crossed(), first_uids() and explained()."""
    c = crossed(top)
    at = best_levels(c).withColumn("c", F.floor(F.col("ts") / chunk))
    ends = c.groupBy("symbol").agg(F.max("ts").alias("end"))
    held = spans.join(ends, "symbol").where("from_ts <= end").select("symbol", "side", "price", "uid", "from_ts", "to_ts", F.explode(F.sequence(F.floor(F.col("from_ts") / chunk), F.floor(F.least(F.coalesce("to_ts", "end"), "end") / chunk))).alias("c"))
    orders = at.join(held, ["symbol", "side", "price", "c"]).where("from_ts <= ts AND (to_ts IS NULL OR to_ts > ts)")
    uids = orders.groupBy("symbol", "ts").agg(*[F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("uid")))).alias(f"{n}_uids") for n, s in (("bid", "buy"), ("ask", "sell"))])
    return c.join(uids, ["symbol", "ts"])


def kinds(crossed: DataFrame, first: DataFrame) -> DataFrame:
    """Crossings explained (first: symbol, ts, explained_dt) by an execution of one of their orders in the next timestamps, else unexplained; persistent where the next timestamp is crossed too."""
    x = crossed.where("cross_width > 0")
    after = x.select("symbol", (F.col("ts") - 1).alias("ts"), F.lit(True).alias("persistent")).distinct()
    out = crossed.join(first, ["symbol", "ts"], "left").join(after, ["symbol", "ts"], "left")
    kind = F.when(F.col("cross_width") == 0, "LOCKED_MARKET").when(F.col("explained_dt").isNotNull(), "CROSS_STREAM_TS_AMBIGUITY").otherwise("UNEXPLAINED")
    return out.select("symbol", "ts", "best_bid", "best_ask", "cross_width", kind.alias("classification"), "explained_dt", F.coalesce("persistent", F.lit(False)).alias("persistent"))


def classified(crossed: DataFrame, events: DataFrame, look_ahead: int = 3) -> DataFrame:
    """kinds() of crossings that list their orders."""
    x = crossed.where("cross_width > 0")
    used = events.where("event_type = 'Execution'").select("symbol", F.col("timestamp_ms").alias("at"), F.explode(F.array("maker_uid", "taker_uid")).alias("uid")).where("uid IS NOT NULL").distinct()
    asked = x.select("symbol", "ts", F.explode(F.array_union("bid_uids", "ask_uids")).alias("uid")).withColumn("dt", F.explode(F.sequence(F.lit(1), F.lit(look_ahead)))).withColumn("at", F.col("ts") + F.col("dt"))
    return kinds(crossed, asked.join(used, ["symbol", "at", "uid"]).groupBy("symbol", "ts").agg(F.min("dt").alias("explained_dt")))
