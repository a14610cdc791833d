"""Signed liquidity changes from canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
RESTING = ("Post", "Limit")


def with_old(events: DataFrame, priority) -> DataFrame:
    """old_qty and old_price of updates from the same order's event before, where the source has none."""
    w = Window.partitionBy("symbol", "order_uid").orderBy("timestamp_ms", priority(F.col("event_type")), "ingest_pos")
    rows = events.where(F.col("event_type").isin("OrderPlaced", "OrderUpdated"))
    old = rows.withColumn("old_qty", F.lag("qty").over(w)).withColumn("old_price", F.lag("price").over(w))
    rest = events.where(~F.col("event_type").isin("OrderPlaced", "OrderUpdated"))
    return old.unionByName(rest, allowMissingColumns=True)


def taker(events: DataFrame) -> DataFrame:
    """Executions with a known aggressor: sign +1 for a buyer, notional (the dollar value, else quantity x price, else 0)."""
    usd = F.col("usd_value") if "usd_value" in events.columns else F.lit(None).cast("double")
    q = F.coalesce(F.col("execution_qty").cast("double"), F.lit(0.0))
    known = events.where((F.col("event_type") == "Execution") & F.col("aggressor").isin("buy", "sell"))
    return known.select(
        "symbol",
        F.col("timestamp_ms").alias("ts"),
        "ingest_pos",
        "taker_uid",
        "aggressor",
        F.when(F.col("aggressor") == "buy", 1).otherwise(-1).alias("sign"),
        F.coalesce("execution_qty", F.lit(0)).alias("qty"),
        F.col("execution_price").alias("price"),
        F.coalesce(usd, q * F.col("execution_price"), F.lit(0.0)).alias("notional"),
    )


def book_side(events: DataFrame) -> Column:
    """bid or ask from the raw direction, exactly Buy or Sell; else the event is no passive flow. Streams without raw directions have their side."""
    if "direction" in events.columns:
        return F.when(F.col("direction") == "Buy", "bid").when(F.col("direction") == "Sell", "ask")
    return F.when(F.col("side") == "buy", "bid").when(F.col("side") == "sell", "ask")


def passive(events: DataFrame) -> DataFrame:
    """Adds and cancels of resting liquidity. Placed (resting types only) adds what is not filled, Cancelled takes what is left, an update at an unchanged or unknown price adds or takes the difference; updates that move the price and rejections are no passive flow."""
    t, filled = F.col("event_type"), F.coalesce(F.col("filled_qty"), F.lit(0)) if "filled_qty" in events.columns else F.lit(0)
    left, change = F.greatest(F.col("qty") - filled, F.lit(0)), F.col("qty") - F.col("old_qty")
    same = F.col("price").isNull() | F.col("old_price").isNull() | (F.abs(F.col("price") - F.col("old_price")) < 1e-9)
    action = F.when((t == "OrderPlaced") & F.col("order_type").isin(*RESTING), "add").when(t == "OrderCancelled", "cancel").when((t == "OrderUpdated") & same & (F.abs(change) >= 1e-9), F.when(change > 0, "add").otherwise("cancel"))
    return events.where(book_side(events).isNotNull() & F.col("timestamp_ms").isNotNull()).select("symbol", F.col("timestamp_ms").alias("ts"), "ingest_pos", "order_uid", book_side(events).alias("book_side"), action.alias("action"), F.when(t == "OrderUpdated", F.abs(change)).otherwise(left).alias("qty"), "price").where(F.col("action").isNotNull())


def reprice(events: DataFrame) -> DataFrame:
    """Two atoms per update that moves the price: the old quantity out, the new one in. Away from the touch: bids down, asks up."""
    moved = events.where((F.col("event_type") == "OrderUpdated") & book_side(events).isNotNull() & F.col("timestamp_ms").isNotNull() & (F.abs(F.col("price") - F.col("old_price")) >= 1e-9))
    moved = moved.withColumn("book_side", book_side(events))
    away = F.when(F.col("book_side") == "bid", F.col("price") < F.col("old_price")).otherwise(F.col("price") > F.col("old_price"))
    two = F.array(F.struct(F.lit("reprice_out").alias("action"), F.col("old_qty").alias("qty")), F.struct(F.lit("reprice_in").alias("action"), F.col("qty").alias("qty")))
    rows = moved.withColumn("atom", F.explode(two))
    return rows.select("symbol", F.col("timestamp_ms").alias("ts"), "ingest_pos", "order_uid", "book_side", "atom.action", "atom.qty", "old_price", F.col("price").alias("new_price"), F.when(away, "away").otherwise("toward").alias("direction"))


def inside(since: int | Column | None, before: int | Column | None) -> Column:
    """Known times in [since, before); None leaves its side open."""
    t = F.col("timestamp_ms")
    return t.isNotNull() & (F.lit(True) if since is None else t >= since) & (F.lit(True) if before is None else t < before)


def flow_taxonomy(events: DataFrame, since: int | Column | None, before: int | Column | None, bucket_ms: int) -> DataFrame:
    """Counts and quantities per bucket and side; execution totals of the bucket stand on each of its side rows."""
    rows = events.where(inside(since, before)).withColumn("bucket_ms", F.col("timestamp_ms") - F.pmod("timestamp_ms", F.lit(bucket_ms)))
    t = F.col("event_type")
    gone = t == "OrderCancelled"
    qty = lambda c: F.coalesce(F.sum(F.when(c, F.col("qty"))), F.lit(0)).cast("double")
    n = lambda c: F.count_if(c)
    out = rows.groupBy("symbol", "bucket_ms", "side").agg(qty(t == "OrderPlaced").alias("placed_qty"), n(t == "OrderPlaced").alias("placed_orders"), qty(gone).alias("cancelled_qty"), n(gone).alias("cancelled_orders"), qty(t == "OrderUpdated").alias("updated_qty"), n(t == "OrderUpdated").alias("updates"), n(F.col("ordering_ambiguous")).alias("n_ambiguous_events"), F.coalesce(F.sum("execution_qty"), F.lit(0)).alias("x"), n(t == "Execution").alias("xn"))
    w = Window.partitionBy("symbol", "bucket_ms")
    return out.withColumn("executed_qty", F.sum("x").over(w).cast("double")).withColumn("executions", F.sum("xn").over(w)).drop("x", "xn")


def ofi_atoms(events: DataFrame, since: int | Column | None, before: int | Column | None, bucket_ms: int) -> DataFrame:
    rows = events.where(inside(since, before)).withColumn("bucket_ms", F.col("timestamp_ms") - F.pmod("timestamp_ms", F.lit(bucket_ms)))
    t, aggs = F.col("event_type"), []
    for name, s in (("bid", "buy"), ("ask", "sell")):
        for what, c in (("new", t == "OrderPlaced"), ("cancel", t == "OrderCancelled")):
            m = c & (F.col("side") == s)
            aggs += [F.coalesce(F.sum(F.when(m, F.col("qty"))), F.lit(0)).cast("double").alias(f"{name}_{what}_qty"), F.count_if(m).alias(f"{name}_{what}_orders")]
    done = F.coalesce(F.sum("execution_qty"), F.lit(0)).cast("double")
    return rows.groupBy("symbol", "bucket_ms").agg(*aggs, done.alias("bid_executed_qty"), done.alias("ask_executed_qty"), F.count_if(t == "OrderUpdated").alias("n_updates"), F.count_if(F.col("ordering_ambiguous")).alias("n_ambiguous"))
