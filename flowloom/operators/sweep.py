"""States of price levels at anchors, without a row for each order or level that is alive at one.

Only what differs from anchor to anchor counts: changes of a level are summed up to the next anchor, and time is cut into chunks of anchors. A chunk starts from the
levels that the chunks before it leave, one row for each level, and is then one table of anchors by levels in a task's memory, a block of anchors at a time: running
sums over time give the levels' quantities, running sums over prices the order statistics (best prices, depths, first levels), sorted rows the quantiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import ceil_to

LEVEL = ["symbol", "side", "price"]
CELLS = 1 << 21
#: anchors, prices by side, quantities and numbers of orders by side and anchor -> columns
Summary = Callable[[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray], dict[str, np.ndarray]], list[np.ndarray]]


def unit_of(df: DataFrame, name: str) -> tuple[Column, float]:
    """A quantity as whole units of its last digit, if it is a decimal, and how many of them are one."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType):
        return (F.col(name) * 10**kind.scale).cast("long"), float(10**kind.scale)
    return F.col(name).cast("double"), 1.0


def chunked(changes: DataFrame, grid: DataFrame, span: int, adding: bool) -> DataFrame:
    """changes (symbol, side, price, anchor, q, n), where q and n are added to a level or (not adding) are its new ones, with the anchors (side null) and what each chunk starts with, before its first anchor."""
    c = F.floor(F.col("anchor") / span).cast("long")
    by = [*LEVEL, "c"]
    changes, marks = changes.withColumn("c", c), grid.select("symbol", "anchor").distinct().withColumn("c", c)
    held = Window.partitionBy(*LEVEL).orderBy("c")
    if adding:
        so_far = held.rowsBetween(Window.unboundedPreceding, 0)
        ends = changes.groupBy(*by).agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
        ends = ends.select(*by, F.sum("q").over(so_far).alias("q"), F.sum("n").over(so_far).alias("n"), F.lead("c").over(held).alias("until"))
    else:
        last = changes.groupBy(*by).agg(F.max_by(F.struct("q", "n"), "anchor").alias("x"))
        ends = last.select(*by, "x.q", "x.n", F.lead("c").over(held).alias("until"))
    reach = marks.groupBy("symbol").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    lo, hi = F.greatest(F.col("c") + 1, F.col("c0")), F.least(F.coalesce("until", "c1"), F.col("c1"))
    start = ends.where("n > 0").join(reach, "symbol").withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    start = start.select(*LEVEL, "q", "n", F.explode(F.sequence("lo", "hi")).alias("c")).withColumn("anchor", F.col("c") * span - 1)
    return changes.unionByName(start).unionByName(marks, allowMissingColumns=True)


def swept(rows: DataFrame, adding: bool, summary: Summary, out: dict[str, str]) -> DataFrame:
    """chunked() rows -> (symbol, anchor, out) for each anchor: summary over blocks of anchors by levels."""
    sides = ["buy", "sell", ""]
    types = {"long": pa.int64(), "double": pa.float64()}

    def table(symbol: str, at: np.ndarray, side: np.ndarray, price: np.ndarray, q: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchors = at[side < 0]
        row = np.searchsorted(anchors, at)
        prices, cell, now = {}, {}, {}
        for k, s in enumerate(sides):
            m = np.flatnonzero((side == k) & (row < len(anchors)))
            prices[s], col = np.unique(price[m], return_inverse=True)
            cell[s] = row[m], col, q[m], n[m]
            now[s] = np.zeros(len(prices[s]), q.dtype), np.zeros(len(prices[s]), np.int64)
        block = max(1, CELLS // max(1, *(len(p) for p in prices.values())))
        for a in range(0, len(anchors), block):
            b = min(a + block, len(anchors))
            many, count = {}, {}
            for s in sides:
                r, col, dq, dn = cell[s]
                m = slice(*np.searchsorted(r, [a, b]))  # rows come in the order of time
                for x, d, held, k in ((many, dq, now[s][0], 0), (count, dn, now[s][1], 1)):
                    grid = np.zeros((b - a, len(prices[s])), d.dtype)
                    if adding:
                        np.add.at(grid, (r[m] - a, col[m]), d[m])
                        grid[0] += held
                        x[s] = np.cumsum(grid, axis=0)
                    else:
                        last = np.zeros((b - a, len(prices[s])), np.int32)
                        last[r[m] - a, col[m]] = np.arange(1, m.stop - m.start + 1)  # of equal cells the last
                        last = np.maximum.accumulate(last, axis=0)
                        x[s] = np.where(last > 0, np.append(0, d[m])[last].astype(d.dtype), held)
                now[s] = many[s][-1].copy(), count[s][-1].copy()
                many[s] = np.where(count[s] > 0, many[s], 0)
            found = summary(anchors[a:b], prices, many, count)
            reps = len(found[0]) // (b - a)
            lead = [pa.array([symbol] * len(found[0]), pa.string()), pa.array(np.repeat(anchors[a:b], reps))]
            yield pa.RecordBatch.from_arrays([*lead, *(x if isinstance(x, pa.Array) else pa.array(x, types.get(t), from_pandas=True) for x, t in zip(found, out.values()))], ["symbol", "anchor", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from table(of[0], *(np.concatenate(x) for x in zip(*held)))

        for b in batches:
            key = np.array(list(zip(b["symbol"].to_pylist(), b["c"].to_pylist())), object).reshape(-1, 2)
            side = np.array([-1 if s is None else sides.index(s) if s in sides else 2 for s in b["side"].to_pylist()], int)
            columns = [b["anchor"].to_numpy(), side, *(b[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("price", "q", "n"))]
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(key)]):
                if i < j and tuple(key[i]) != of:
                    yield from done()
                    of, held = tuple(key[i]), []
                held.append([x[i:j] for x in columns])
        yield from done()

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("symbol", "c", "anchor", "side", "price", "q", "n").repartition(width, "symbol", "c").sortWithinPartitions("symbol", "c", "anchor")
    return rows.mapInArrow(run, "symbol string, anchor long, " + ", ".join(f"{n} {t}" for n, t in out.items()))


def picked(values: np.ndarray, at: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.where(found, values[np.where(found, at, 0)] if len(values) else np.nan, np.nan)


def book_states(spans: DataFrame, grid: DataFrame, step: int, bps: tuple[int, ...], counts: tuple[int, ...] = (), chunk: int = 256) -> DataFrame:
    """Best prices, orders, depth within basis points of the mid (bids below, asks above) and quantity of the first levels of each side at every anchor.

    Prices of 0 and below count as active orders and levels but never as best. Anchors are multiples of step. Quantities that are decimals are exact.
    """
    qty, unit = unit_of(spans, "qty")
    a, b = ceil_to(F.col("from_ts"), step), ceil_to(F.col("to_ts"), step)
    both = F.array(F.struct(a.alias("anchor"), qty.alias("q"), F.lit(1).alias("n")), F.struct(b.alias("anchor"), (-qty).alias("q"), F.lit(-1).alias("n")))
    moves = spans.where(b.isNull() | (a < b)).select(*LEVEL, F.explode(both).alias("x")).select(*LEVEL, "x.*").where("anchor IS NOT NULL")
    moves = moves.groupBy(*LEVEL, "anchor").agg(F.sum("q").alias("q"), F.sum("n").alias("n"))

    def summary(anchors: np.ndarray, prices: dict, many: dict, count: dict) -> list[np.ndarray]:
        top, out = {}, []
        for s in ("buy", "sell"):
            alive = (count[s] > 0) & (prices[s] > 0)
            last = alive.shape[1] - 1 - np.argmax(alive[:, ::-1], axis=1) if s == "buy" and alive.size else np.argmax(alive, axis=1) if alive.size else np.zeros(len(anchors), int)
            top[s] = picked(prices[s], last, alive.any(axis=1))
        out += [top["buy"], top["sell"], sum(c.sum(axis=1) for c in count.values())]
        mid = (top["sell"] + top["buy"]) / 2
        sums = {s: np.concatenate([np.zeros((len(anchors), 1), many[s].dtype), np.cumsum(many[s], axis=1)], axis=1) for s in top}
        at = np.arange(len(anchors))
        for n in bps:
            for s, lo, hi in (("buy", mid * (1 - n / 1e4), mid), ("sell", mid, mid * (1 + n / 1e4))):
                i, j = np.searchsorted(prices[s], lo, "left"), np.searchsorted(prices[s], hi, "right")
                out.append(np.where(np.isnan(mid), np.nan, (sums[s][at, np.maximum(i, j)] - sums[s][at, i]) / unit))
        for n in counts:
            for s in ("buy", "sell"):
                alive = count[s] > 0
                rank = np.cumsum(alive[:, ::-1], axis=1)[:, ::-1] if s == "buy" else np.cumsum(alive, axis=1)
                out.append(np.where(alive & (rank <= n), many[s], 0).sum(axis=1) / unit)
        return out

    names = [f"depth_{s}_{n}bps" for n in bps for s in ("bid", "ask")] + [f"{s}_l{n}_qty" for n in counts for s in ("bid", "ask")]
    out = {"best_bid": "double", "best_ask": "double", "n_active": "long"} | dict.fromkeys(names, "double")
    got = swept(chunked(moves, grid, step * chunk, True), True, summary, out)
    got = got.selectExpr("*", "best_ask - best_bid AS spread", "(best_ask + best_bid) / 2 AS mid")
    share = lambda n: f"try_divide(depth_bid_{n}bps - depth_ask_{n}bps, depth_bid_{n}bps + depth_ask_{n}bps)"
    return got.selectExpr("*", *[f"CASE WHEN mid IS NOT NULL THEN round(coalesce({share(n)}, 0D), 4) END AS obi_{n}bps" for n in bps])


QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def level_states(atoms: DataFrame, grid: DataFrame, step: int, eps: float, chunk: int = 256) -> DataFrame:
    """Per anchor and side with active levels: their number, total and largest quantity, quantiles, the price nearest to the other side, and how many levels hold more than 3 and 5 medians."""
    order = F.struct("ts", "prio", "ingest_pos", "leg", "emit")
    last = atoms.groupBy(*LEVEL, ceil_to(F.col("ts"), step).alias("anchor")).agg(F.max_by(F.col("level_qty").cast("double"), order).alias("q"))
    values = last.withColumn("n", (F.col("q") > 0).cast("int"))

    def summary(anchors: np.ndarray, prices: dict, many: dict, count: dict) -> list[np.ndarray]:
        parts = []
        for s in ("buy", "sell"):
            alive = count[s] > 0
            n = alive.sum(axis=1)
            rows = np.sort(np.where(alive, many[s], np.inf), axis=1) if alive.size else np.zeros((len(anchors), 1))
            at, place = np.arange(len(anchors)), lambda p, n=n: p * np.maximum(n - 1, 0)
            quantile = []
            for p in QUANTILES.values():
                i = np.floor(place(p)).astype(int)
                low, high, part = rows[at, i], rows[at, np.minimum(i + 1, np.maximum(n - 1, 0))], place(p) - i
                quantile.append(np.where(part > 0, (1 - part) * low + part * np.where(part > 0, high, 0), low))
            big = many[s].max(axis=1, initial=0)
            over = [(alive & (many[s] > k * (quantile[0] + eps)[:, None])).sum(axis=1) for k in (3, 5)]
            first = alive.shape[1] - 1 - np.argmax(alive[:, ::-1], axis=1) if s == "buy" and alive.size else np.argmax(alive, axis=1) if alive.size else np.zeros(len(anchors), int)
            parts.append([np.full(len(anchors), s), n, many[s].sum(axis=1), big, *quantile, *over, picked(prices[s], first, n > 0)])
        both = [np.stack(x, axis=1).reshape(-1) for x in zip(*parts)]
        return [pa.array(both[0]), *both[1:]]

    out = {"side": "string", "n_levels": "long", "total_qty": "double", "max_qty": "double", **{f"{p}_qty": "double" for p in QUANTILES}, "n_above_3x_median": "long", "n_above_5x_median": "long", "nearest": "double"}
    return swept(chunked(values, grid, step * chunk, False), False, summary, out).where("n_levels > 0")
