"""Level snapshots and summaries, and replenishment after executions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import rank_pct
from . import sweep
from .atoms import EPS

LEVEL = ["symbol", "side", "price"]


def snapshot(atoms: DataFrame, t: int, top: DataFrame | None = None, tick: float = 1.0) -> DataFrame:
    """Active levels at t: quantity (the whole sum, floored at 0), episode and its age, share, percentile and ratio to the median of the side; with best prices (symbol, best_bid, best_ask, mid), distances."""
    past = atoms.where(F.col("ts") <= t)
    signed = F.when(F.col("action") == "add", F.col("qty")).otherwise(-F.col("qty"))
    lvl = past.groupBy(*LEVEL).agg(F.greatest(F.sum(signed), F.lit(0)).alias("level_qty"), F.max("episode_id").alias("episode_id"), F.min(F.struct((-F.col("episode_id")).alias("e"), F.col("ts").alias("ts")))["ts"].alias("start"))
    lvl = lvl.where("level_qty > 0").withColumn("age_ms", F.lit(t) - F.col("start")).drop("start")
    w = Window.partitionBy("symbol", "side")
    q = F.col("level_qty").cast("double")
    out = rank_pct(lvl.withColumn("q", q), "q", ["symbol", "side"], "qty_percentile").withColumn("qty_percentile", F.col("qty_percentile") / 100)
    out = out.withColumn("share_of_side_depth", F.col("q") / F.greatest(F.sum("q").over(w), F.lit(EPS))).withColumn("qty_vs_nearby_median", F.col("q") / (F.percentile("q", 0.5).over(w) + EPS)).drop("q")
    if top is not None:
        out = out.join(top, "symbol", "left")
        ref = F.when(F.col("side") == "buy", F.col("best_bid")).otherwise(F.col("best_ask"))
        out = out.withColumn("distance_bps", F.when(F.col("mid") > 0, F.round(F.abs(F.col("price") - F.col("mid")) / F.col("mid") * 10_000, 2))).withColumn("distance_ticks", F.when(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull(), F.abs(F.col("price") - ref) / tick)).drop("best_bid", "best_ask", "mid")
    return out


def summary(atoms: DataFrame, grid: DataFrame, book: DataFrame, step: int, tick: float) -> DataFrame:
    """Per anchor and side: the distribution of active levels' quantities, and how far the nearest level is from the mid."""
    key, med = ["symbol", "anchor", "side"], F.col("p50_qty") + EPS
    s = sweep.level_states(atoms, grid, step, EPS).join(book.select("symbol", "anchor", "mid"), ["symbol", "anchor"], "left")
    away = F.abs(F.col("nearest") - F.col("mid"))
    high = F.when(F.col("n_levels") >= 20, F.col("p95_qty")).otherwise(F.col("max_qty"))
    return s.select(
        *key,
        "n_levels",
        "total_qty",
        "max_qty",
        *[f"{p}_qty" for p in sweep.QUANTILES],
        (F.col("max_qty") / med).alias("max_qty_vs_median"),
        (high / med).alias("p95_qty_vs_median"),
        "n_above_3x_median",
        "n_above_5x_median",
        (F.col("max_qty") / (F.col("total_qty") + EPS)).alias("max_share"),
        (away / tick).alias("top1_dist_ticks"),
        (away / F.col("mid") * 10_000).alias("top1_dist_bps"),
    )


#: Time buckets in a horizon: an execution meets the adds of one bucket more than these, of which those of one are in vain.
PARTS = 8


def refill_pairs(atoms: DataFrame, horizon: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Executions at a level with every add there in (t, t + horizon], and the execution's carried columns. Both sides meet in time buckets, so the join is by equality."""
    width = -(-horizon // PARTS)
    bucket = lambda c: F.floor(c / width)
    met = F.explode(F.sequence(bucket(F.col("exec_ts") + 1), bucket(F.col("exec_ts") + horizon)))
    x = atoms.where("action = 'exec_reduce'").select(*LEVEL, F.col("ts").alias("exec_ts"), F.col("ingest_pos").alias("exec_pos"), F.col("qty").alias("exec_qty"), *carried).withColumn("b", met)
    a = atoms.where("action = 'add'").select(*LEVEL, F.col("ts").alias("add_ts"), F.col("qty").alias("refill_qty")).withColumn("b", bucket(F.col("add_ts")))
    return x.join(a, [*LEVEL, "b"]).where(F.col("add_ts").between(F.col("exec_ts") + 1, F.col("exec_ts") + horizon)).drop("b").withColumn("delay_ms", F.col("add_ts") - F.col("exec_ts"))


def replenishment(pairs: DataFrame, grid: DataFrame, windows: list[int], step: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per anchor and window: executed quantity (once per execution time), refills seen by then within the window, their ratio. The window is [t - W, t) on execution times."""
    parts = []
    span = grid.groupBy("symbol").agg(F.min("anchor").alias("a0"), F.max("anchor").alias("a1"))
    for w in windows:
        p = pairs.where(F.col("delay_ms") <= w).join(span, "symbol")
        lo = F.greatest((F.ceil(F.greatest(F.col("add_ts"), F.col("exec_ts") + 1) / step) * step).cast("long"), F.col("a0"))
        hi = F.least((F.floor((F.col("exec_ts") + w) / step) * step).cast("long"), F.col("a1"))
        p = p.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("anchor", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))))
        once = p.groupBy("symbol", *keys, "anchor", "exec_ts").agg(F.sum("refill_qty").alias("r"), F.count(F.lit(1)).alias("n"), F.max("refill_qty").alias("m"), F.min_by("exec_qty", F.struct("side", "price", "exec_pos")).alias("x"))
        got = once.groupBy("symbol", *keys, "anchor").agg(F.sum("x").cast("double").alias("total_exec_qty"), F.sum("r").cast("double").alias("total_refill_qty"), F.sum("n").alias("refill_count"), F.max("m").cast("double").alias("max_refill"))
        parts.append(got.withColumn("w", F.lit(w)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("replenishment_ratio", F.coalesce(F.try_divide("total_refill_qty", "total_exec_qty"), F.lit(0.0)))


def refills(atoms: DataFrame, grid: DataFrame, horizon: int, windows: list[int], step: int) -> DataFrame:
    """replenishment(refill_pairs(atoms, horizon), ..) without a row for each pair, for windows up to the horizon.

    For an execution at e and an anchor A up to e + W, all adds of the level in (e, A] count, whatever W. They are those after e in the step that e lies in and those
    of the whole steps from there up to A; so adds are summed by time and step, and each time of a level with executions has a row for each anchor in its reach.
    """
    if max(windows) > horizon:
        raise ValueError(f"a window of {max(windows)} is longer than the horizon of {horizon}")
    rows = atoms.where("action IN ('add', 'exec_reduce') AND side IS NOT NULL AND price IS NOT NULL")
    add, up = F.col("action") == "add", (F.ceil(F.col("ts") / step) * step).cast("long")
    # a step's executions come before its end, its adds up to it
    cells = rows.groupBy(*LEVEL, "ts", add.alias("add")).agg(F.sum("qty").alias("s"), F.max("qty").alias("m"), F.count(F.lit(1)).alias("n"), F.min_by("qty", "ingest_pos").alias("x"))
    cells = cells.withColumn("b", F.when(F.col("add"), up).otherwise((F.floor(F.col("ts") / step) * step + step).cast("long")))
    zero = F.lit(0).cast(cells.schema["s"].dataType)
    later = Window.partitionBy(*LEVEL, "b").orderBy(F.col("ts").desc(), F.col("add").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    after = [F.coalesce(F.sum(F.when(F.col("add"), F.col("s"))).over(later), zero).alias("s0"), F.max(F.when(F.col("add"), F.col("m"))).over(later).alias("m0"), F.sum(F.when(F.col("add"), F.col("n")).otherwise(0)).over(later).alias("n0")]
    done = cells.select(*LEVEL, "ts", "b", "add", "x", F.col("n").alias("times"), *after).where("NOT add").drop("add")
    whole = cells.where("add").groupBy(*LEVEL, F.col("b").alias("anchor")).agg(F.sum("s").alias("s"), F.max("m").alias("m"), F.sum("n").alias("n"))
    reach = cells.where("NOT add").select(*LEVEL, "b").distinct().withColumn("anchor", F.explode(F.sequence("b", F.col("b") + max(windows), F.lit(step).cast("long"))))
    more = Window.partitionBy(*LEVEL, "b").orderBy("anchor").rowsBetween(Window.unboundedPreceding, 0)
    met, beyond = reach.join(whole, [*LEVEL, "anchor"], "left"), F.col("anchor") > F.col("b")
    met = met.select(*LEVEL, "b", "anchor", *[f(F.when(beyond, F.col(c))).over(more).alias(c) for c, f in (("s", F.sum), ("m", F.max), ("n", F.sum))])
    span = grid.groupBy("symbol").agg(F.min("anchor").alias("a0"), F.max("anchor").alias("a1"))
    seen = done.join(met, [*LEVEL, "b"]).join(span, "symbol").where((F.col("anchor") <= F.col("ts") + max(windows)) & F.col("anchor").between(F.col("a0"), F.col("a1")))
    n = F.col("n0") + F.coalesce("n", F.lit(0))
    seen = seen.select("symbol", "anchor", F.col("ts").alias("exec_ts"), "side", "price", "x", ((F.col("s0") + F.coalesce("s", zero)) * F.col("times")).alias("r"), (n * F.col("times")).alias("n"), F.greatest("m0", "m").alias("m")).where("n > 0")
    once = seen.groupBy("symbol", "anchor", "exec_ts").agg(F.sum("r").alias("r"), F.sum("n").alias("n"), F.max("m").alias("m"), F.min_by("x", F.struct("side", "price")).alias("x"))
    each = once.withColumn("w", F.explode(F.array(*map(F.lit, windows)))).where("exec_ts >= anchor - w")
    out = each.groupBy("symbol", "anchor", "w").agg(F.sum("x").cast("double").alias("total_exec_qty"), F.sum("r").cast("double").alias("total_refill_qty"), F.sum("n").alias("refill_count"), F.max("m").cast("double").alias("max_refill"))
    return out.withColumn("replenishment_ratio", F.coalesce(F.try_divide("total_refill_qty", "total_exec_qty"), F.lit(0.0)))


def level_refill(pairs: DataFrame, t: int, w: int) -> DataFrame:
    """Replenishment of every level at time t: refills of executions in [t - w, t), known by t. Executions of one time count once, as the first of them."""
    p = pairs.where((F.col("exec_ts") >= t - w) & (F.col("exec_ts") < t) & (F.col("add_ts") <= t) & (F.col("delay_ms") <= w))
    x = p.groupBy(*LEVEL, "exec_ts").agg(F.min_by("exec_qty", "exec_pos").alias("x")).groupBy(*LEVEL).agg(F.sum("x").alias("x"))
    out = p.groupBy(*LEVEL).agg(F.sum("refill_qty").alias("refilled_qty"), F.count(F.lit(1)).alias("refill_count"), F.max("refill_qty").alias("max_refill"), F.percentile("delay_ms", 0.5).alias("median_refill_delay"))
    return out.join(x, LEVEL).withColumn("replenishment_ratio", F.coalesce(F.try_divide(F.col("refilled_qty").cast("double"), F.col("x").cast("double")), F.lit(0.0))).drop("x")
