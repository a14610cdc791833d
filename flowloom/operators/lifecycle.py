"""Per-order folds: every transition of an order book touches one order only, so the book is a table of order intervals and no global replay is needed.

Events become legs of one order (an execution has a maker leg and a taker leg). Legs of an order stream through one task in batch-terminal order with a state
of constant size, whatever the order's length; quantities keep their type, so decimals stay exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.canonical import priority
from ..sources.shared import stored
from . import fold

ORDER_BY = ["symbol", "uid", "ts", "prio", "ingest_pos", "leg"]


def legs(events: DataFrame) -> DataFrame:
    """The events of known types and times as legs of single orders."""
    t = F.col("event_type")
    kind = F.when(t == "OrderPlaced", "place").when(t == "OrderUpdated", "update").when(t.isin("OrderCancelled", "OrderRejected"), "cancel")
    part = lambda uid, leg, kind, qty: F.struct(F.coalesce(uid, F.lit("")).alias("uid"), F.lit(leg).alias("leg"), kind.alias("kind"), F.col(qty).alias("qty"))
    two = F.filter(F.array(part(F.col("maker_uid"), 0, F.lit("maker"), "execution_qty"), part(F.col("taker_uid"), 1, F.lit("taker"), "execution_qty")), lambda x: x["uid"] != "")
    each = F.when(t == "Execution", two).otherwise(F.array(part(F.col("order_uid"), 0, kind, "qty")))
    rows = events.select("symbol", F.col("timestamp_ms").alias("ts"), priority(t).alias("prio"), "ingest_pos", "side", "price", F.explode(each).alias("x"))
    return rows.select("symbol", "x.uid", "ts", "prio", "ingest_pos", "x.leg", "x.kind", "side", "price", "x.qty").where("kind IS NOT NULL AND ts IS NOT NULL")


def folded(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """run over the legs of each order, in order, one task for all of an order's."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ids go first: their first bytes part most rows, where those of a symbol part none
    order = ["uid", "symbol", *ORDER_BY[2:]]
    return rows.select(*ORDER_BY, "kind", "side", "price", "qty").repartition(width, "symbol", "uid").sortWithinPartitions(*order).mapInArrow(run, schema)


def transitions(events: DataFrame) -> DataFrame:
    """A row per leg: what it did (outcome) and the order's state after it."""
    rows = legs(events)
    null = lambda t: F.lit(None).cast(t)
    schema = rows.select(*ORDER_BY, "kind", null("string").alias("outcome"), null("boolean").alias("active"), "side", null("double").alias("price"), "qty", null("long").alias("placed_ms"), null("long").alias("placed_pos")).schema
    return folded(rows, fold.streamed(fold.book, fold.transitions, lambda _: None), schema)


def intervals(moves: DataFrame) -> DataFrame:
    """Active orders as (symbol, uid, from_ts, to_ts, side, price, qty, placed_ms, placed_pos), to_ts exclusive and null while it lasts; only the state after a timestamp's whole batch counts."""
    w = Window.partitionBy("symbol", "uid").orderBy("ts", "prio", "ingest_pos", "leg")
    nxt = moves.withColumn("to_ts", F.lead("ts").over(w))
    return nxt.where("active AND (to_ts IS NULL OR to_ts > ts)").select("symbol", "uid", F.col("ts").alias("from_ts"), "to_ts", "side", "price", "qty", "placed_ms", "placed_pos")


def book_intervals(events: DataFrame) -> DataFrame:
    """intervals(transitions(events)) in one pass, for where the transitions themselves are not asked for."""
    rows = legs(events)
    null = lambda t: F.lit(None).cast(t)
    schema = rows.select("symbol", "uid", F.col("ts").alias("from_ts"), null("long").alias("to_ts"), "side", null("double").alias("price"), "qty", null("long").alias("placed_ms"), null("long").alias("placed_pos")).schema
    return folded(rows, fold.streamed(fold.book, fold.spans, lambda held: held), schema)


def counters(moves: DataFrame, events: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """Counts of odd transitions, of timestamps with several events and, with the best prices after each timestamp (symbol, best_bid, best_ask), of crossed and locked books."""
    odd = ["unknown_update", "unknown_cancel", "unknown_exec_maker", "unknown_exec_taker", "duplicate_active_uid", "negative_qty"]
    shared = events.groupBy("symbol", "timestamp_ms").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(F.count_if(F.col("n") > 1).alias("n_ambiguous_ms"))
    out = moves.groupBy("symbol").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in odd]).join(shared, "symbol")
    if top is not None:
        met = top.groupBy("symbol").agg(F.count_if(F.col("best_bid") > F.col("best_ask")).alias("crossed_book"), F.count_if(F.col("best_bid") == F.col("best_ask")).alias("locked_book"))
        out = out.join(met, "symbol", "left").fillna(0, ["crossed_book", "locked_book"])
    return out


def level_changes(events: DataFrame) -> DataFrame:
    """(symbol, ts, .., side, price, action, qty, order_uid): what each leg adds to a level or takes from one."""
    rows = legs(events)
    null = lambda t: F.lit(None).cast(t)
    schema = rows.select("symbol", "ts", "prio", "ingest_pos", "leg", null("int").alias("emit"), "side", null("double").alias("price"), null("string").alias("action"), "qty", F.col("uid").alias("order_uid")).schema
    return folded(rows, fold.streamed(fold.level, fold.changes, lambda _: None), schema)


def level_atoms(events: DataFrame, chunk: int = 3_600_000) -> DataFrame:
    """level_changes() with the level's running quantity and its episode: a level that was empty starts a new one."""
    return running_levels(level_changes(events), chunk)


def running_levels(atoms: DataFrame, chunk: int) -> DataFrame:
    """level_qty, a running sum that never falls below zero, and episode_id, in chunks of time.

    In a chunk with running sums P and their least so far M, a level that starts with q holds max(q + P, P - M), so chunks compose by (P, M): what a chunk starts with
    comes from one row for each chunk before it. An episode starts with an add at the least sum so far, P = M, once -P reaches q; these sums only fall, so all
    such adds of a chunk count but the first ones, whose number follows from q and the chunk's list of them. The rows are written once, as two passes read them.
    """
    key = ["symbol", "side", "price", "c"]
    w = Window.partitionBy(*key).orderBy("ts", "prio", "ingest_pos", "leg", "emit")
    run, before = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key[:-1]).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    signed = F.when(F.col("action") == "add", F.col("qty")).otherwise(-F.col("qty"))
    rows = atoms.withColumn("c", F.floor(F.col("ts") / chunk)).withColumn("x", signed).withColumn("p", F.sum("x").over(run))
    zero = F.lit(0).cast(rows.schema["p"].dataType)
    rows = rows.withColumn("m", F.least(zero, F.min("p").over(run))).withColumns({"p0": F.coalesce(F.lag("p").over(w), zero), "m0": F.coalesce(F.lag("m").over(w), zero)})
    rows = rows.withColumn("down", F.when((F.col("action") == "add") & (F.col("p0") == F.col("m0")), -F.col("p0")))
    rows = stored(rows.withColumn("k", F.count("down").over(run)).drop("p0", "m0"))
    ends = rows.groupBy(*key).agg(F.sum("x").alias("sum"), F.min("m").alias("least"), F.collect_list("down").alias("down"))
    ends = ends.withColumn("s", F.coalesce(F.sum("sum").over(before), zero))
    ends = ends.withColumn("q", F.col("s") - F.coalesce(F.least(zero, F.min(F.col("s") + F.col("least")).over(before)), zero))
    ends = ends.withColumn("early", F.size(F.filter("down", lambda d: d < F.col("q"))))
    ends = ends.withColumn("first", F.coalesce(F.sum(F.size("down") - F.col("early")).over(before), F.lit(0)))
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in key], "q", "early", "first")
    out = rows.join(ends, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    return out.select(*atoms.columns, F.greatest(F.col("q") + F.col("p"), F.col("p") - F.col("m")).alias("level_qty"), (F.col("first") + F.greatest(F.col("k") - F.col("early"), F.lit(0))).alias("episode_id"))
