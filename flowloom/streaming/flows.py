"""Structured Streaming forms of the bucketed flows, refill pairs and the order book's fold.

Events carry event_time (a timestamp). Late events within the watermark are counted; a bucket or pair comes out once. The batch forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import fold
from ..operators.lifecycle import legs


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_millis("timestamp_ms"))


def ofi_buckets(events: DataFrame, bucket_ms: int, late_ms: int) -> DataFrame:
    """New and cancelled quantity and executed quantity per symbol and tumbling bucket."""
    t, w = F.col("event_type"), F.window("event_time", f"{bucket_ms} milliseconds")
    q = lambda kind, side: F.coalesce(F.sum(F.when((t == kind) & (F.col("side") == side), F.col("qty"))), F.lit(0)).cast("double")
    rows = timed(events).withWatermark("event_time", f"{late_ms} milliseconds").groupBy("symbol", w)
    out = rows.agg(*[q(k, s).alias(f"{b}_{n}_qty") for b, s in (("bid", "buy"), ("ask", "sell")) for n, k in (("new", "OrderPlaced"), ("cancel", "OrderCancelled"))], F.coalesce(F.sum("execution_qty"), F.lit(0)).cast("double").alias("executed_qty"), F.count_if(t == "OrderUpdated").alias("n_updates"))
    return out.withColumn("bucket_ms", F.unix_millis("window.start")).drop("window")


def sliding_activity(events: DataFrame, size_ms: int, slide_ms: int, late_ms: int) -> DataFrame:
    w = F.window("event_time", f"{size_ms} milliseconds", f"{slide_ms} milliseconds")
    return timed(events).withWatermark("event_time", f"{late_ms} milliseconds").groupBy("symbol", w).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "Execution").alias("executions"))


def refill_pairs(executions: DataFrame, adds: DataFrame, horizon_ms: int, late_ms: int) -> DataFrame:
    """Stream-stream join of level atoms: adds in (t, t + horizon] after an execution at the same level; state is dropped once the watermark passes it."""
    x = executions.select("symbol", "side", "price", F.col("ts").alias("exec_ts"), F.col("qty").alias("exec_qty"), F.timestamp_millis("ts").alias("exec_time")).withWatermark("exec_time", f"{late_ms} milliseconds")
    a = adds.select(F.col("symbol").alias("s2"), F.col("side").alias("side2"), F.col("price").alias("price2"), F.col("ts").alias("add_ts"), F.col("qty").alias("refill_qty"), F.timestamp_millis("ts").alias("add_time")).withWatermark("add_time", f"{late_ms} milliseconds")
    on = F.expr(f"symbol = s2 AND side = side2 AND price = price2 AND add_time > exec_time AND add_time <= exec_time + INTERVAL {horizon_ms / 1000} SECONDS")
    return x.join(a, on).select("symbol", "side", "price", "exec_ts", "add_ts", "exec_qty", "refill_qty", (F.col("add_ts") - F.col("exec_ts")).alias("delay_ms"))


LEG = "symbol string, uid string, ts long, prio int, ingest_pos long, leg int, kind string, side string, price double, qty double"
MOVES = "symbol string, uid string, ts long, prio int, ingest_pos long, leg int, kind string, outcome string, active boolean, side string, price double, qty double, placed_ms long, placed_pos long"
CHANGES = "symbol string, ts long, prio int, ingest_pos long, leg int, emit int, side string, price double, action string, qty double, order_uid string"
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
LEG_TYPES = pa.schema([(n, TYPES[t]) for n, t in (c.split() for c in LEG.split(", "))])


class Released(StatefulProcessor):
    """A fold whose legs wait until the watermark passes their time.

    State of an order: the place that stands for it, and a list of its open legs. A time's legs are an unordered batch until no more of them can come; a timer at that
    time then applies them in batch-terminal order, however many micro-batches brought them.
    """

    def __init__(self, rule: Callable, out: Callable) -> None:
        self.rule, self.out = rule, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order, self.open = handle.getValueState("order", LEG), handle.getListState("open", LEG)

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues: TimerValues) -> Iterator:
        for frame in rows:
            legs_ = pa.RecordBatch.from_pandas(frame[LEG_TYPES.names], LEG_TYPES, preserve_index=False)
            self.open.appendList([tuple(r.values()) for r in legs_.to_pylist()])
            for ts in set(legs_["ts"].to_pylist()):
                self.handle.registerTimer(ts)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = sorted(self.open.get(), key=lambda r: r[2:6])
        ready = [r for r in rows if r[2] <= now]
        if not ready:
            return
        if len(ready) < len(rows):
            self.open.put(rows[len(ready) :])
        else:
            self.open.clear()
        of = lambda found: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), LEG_TYPES)], schema=LEG_TYPES)
        b = fold.Batch(of(ready), of([self.order.get()]) if self.order.exists() else None)
        f = self.rule(b)
        made, state = self.out(b, f, None)[0], b.state(f)
        if state is None:
            self.order.clear()
        else:
            self.order.update(tuple(state.to_pylist()[0].values()))
        yield made.to_pandas()

    def close(self) -> None:
        pass


def _released(events: DataFrame, late_ms: int, rule: Callable, out: Callable, schema: str) -> DataFrame:
    rows = legs(events).withColumn("qty", F.col("qty").cast("double")).withColumn("event_time", F.timestamp_millis("ts"))
    rows = rows.withWatermark("event_time", f"{late_ms} milliseconds").groupBy("symbol", "uid")
    return rows.transformWithStateInPandas(Released(rule, out), schema, "Append", "EventTime")


def book_transitions(events: DataFrame, late_ms: int) -> DataFrame:
    """The order book's fold over a stream, with one state per order. The session's state store is RocksDB's (spark.sql.streaming.stateStore.providerClass)."""
    return _released(events, late_ms, fold.book, fold.transitions, MOVES)


def level_changes(events: DataFrame, late_ms: int) -> DataFrame:
    """Signed changes at price levels over a stream, in the same way."""
    return _released(events, late_ms, fold.level, fold.changes, CHANGES)
