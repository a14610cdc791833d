"""All pairs of 64-bit codes within a Hamming distance, by the generalised pigeonhole principle.

Correlated bits are grouped into m partitions. If thresholds t_1 .. t_m sum to tau - m + 1, two codes within tau differ by at most t_i bits in some
partition i (t_i = -1 skips a partition). m and the thresholds minimise the estimated work: probes to send and candidates to verify, the latter from how
often all codes at hand set each bit. Every code sends itself as an index entry and its variants within t_i as probes to the value's bucket; candidates are
verified there, in vector code. Buckets above BLOCK entries are parted into blocks that meet block by block. Where links are dense a task sends a spanning
forest of what it found, so a group of n copies costs about n rows, never n^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest

BLOCK, CHUNK, ROW_COST, PAIR_COST = 4096, 1 << 18, 2e-6, 6e-9


def bit_counts(codes: DataFrame, column: str) -> np.ndarray:
    """How often each pair of bits is set together, over all codes (64 x 64; the diagonal has the single bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            x = _bits(b[0].to_numpy()).astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.ravel())], ["i", "n"])

    out = np.zeros(4096)
    for r in codes.select(column).mapInArrow(run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():  # 4,096 rows
        out[r["i"]] = r["n"]
    return out.reshape(64, 64)


def _bits(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(counts: np.ndarray, n: float, m: int) -> list[list[int]]:
    """Bits in m partitions: each starts from the bit most tied to the rest and takes the bits most correlated with it."""
    p = np.diag(counts) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(tie, 0)
    free, out = list(range(64)), []
    for i in range(m):
        size = len(free) // (m - i)
        part = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (tie[b, part].sum(), -b)))
            free.remove(part[-1])
        out.append(sorted(part))
    return out


def chances(p: np.ndarray, part: list[int]) -> np.ndarray:
    """Chance that two codes differ in 0, 1, .. bits of the partition."""
    d = np.array([1.0])
    for b in part:
        q = 2 * p[b] * (1 - p[b])
        d = np.append(d * (1 - q), 0) + np.append(0, d * q)
    return d


def balls(size: int, t: int) -> int:
    from math import comb

    return sum(comb(size, i) for i in range(t + 1))


def thresholds(counts: np.ndarray, n: float, tau: int) -> list[tuple[list[int], int]]:
    """The partitions and their thresholds of least estimated work, by dynamic programming over partitions for each m."""
    p = np.diag(counts) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(2, tau + 2):
        if 64 / m > 32 or tau - m + 1 < -m:
            continue
        parts = grouped_bits(counts, n, m)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            seen, new = np.cumsum(chances(p, part)), {}
            for used, (cost, ts) in state.items():
                for t in range(-1, min(4, len(part)) + 1):
                    extra = 0.0 if t < 0 else n * (1 + balls(len(part), t) * (t > 0)) * ROW_COST + n * n / 2 * seen[t] * PAIR_COST
                    if used + t not in new or cost + extra < new[used + t][0]:
                        new[used + t] = (cost + extra, [*ts, t])
            state = new
        if tau - m + 1 in state and state[tau - m + 1][0] < best[0]:
            cost, ts = state[tau - m + 1]
            best = (cost, [(part, t) for part, t in zip(parts, ts) if t >= 0])
    return best[1]


def _values(codes: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for j, b in enumerate(part):
        out |= ((codes >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def _masks(size: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for i in range(t + 1) for c in combinations(range(size), i)], np.uint64)


def entries(codes: DataFrame, column: str, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(k, role, code): role 0 index, 1 probe, 2 both. k is the partition and its value."""
    masks = [_masks(len(part), t) for part, t in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch[0].to_numpy().view(np.uint64)
            for lo in range(0, len(whole), 2048):
                c = whole[lo : lo + 2048]
                for i, ((part, t), mask) in enumerate(zip(plan, masks)):
                    v = _values(c, part) | np.uint64(i << 58)
                    if t == 0:
                        sent = [(v, 2, c)]
                    else:
                        sent = [(v, 0, c), ((v[:, None] ^ mask[None, :]).ravel(), 1, np.repeat(c, len(mask)))]
                    for k, role, code in sent:
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(k), role, np.int8)), pa.array(code.view(np.int64))], ["k", "role", "code"])

    return codes.select(column).mapInArrow(run, "k long, role byte, code long")


def _verified(k: np.ndarray, role: np.ndarray, code: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of whole buckets (rows sorted by k), a < b."""
    order = np.lexsort((role == 1, k))
    k, role, code = k[order], role[order], code[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    group = np.cumsum(np.bincount(starts, minlength=len(k))) - 1
    n_index = np.bincount(group[role != 1], minlength=len(starts))
    probes = np.flatnonzero(role != 0)
    count = n_index[group[probes]]
    probes, count = probes[count > 0], count[count > 0]
    at, ends = 0, np.cumsum(count)
    while at < len(probes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        p, c = probes[at:to], count[at:to]
        left = np.repeat(p, c)
        right = np.repeat(starts[group[p]], c) + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
        x, y = code[left], code[right]
        m = (x < y) & (np.bitwise_count(x ^ y) <= tau)
        if m.any():
            yield x[m], y[m]
        at = to


def sent_edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(codes: DataFrame, column: str, tau: int, dense: bool = True) -> DataFrame:
    """codes (distinct longs in `column`) -> edges (a, b) among codes within tau; with dense, a spanning forest for each task's finds."""
    n = codes.count()
    plan = thresholds(bit_counts(codes, column), max(n, 2), tau)
    sent = entries(codes, column, plan)
    heavy = entries(codes, column, [(part, 0) for part, _ in plan]).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(F.col("k").alias("hk"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sent = sent.join(heavy, F.col("k") == F.col("hk"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda i, p: F.struct(i.alias("i"), p.alias("p"), F.col("role").alias("role"))
    flat = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("p"), F.col("role").alias("role"))))
    flat = flat.when(F.col("role") == 1, F.transform(every, lambda b: F.struct(b.alias("i"), own.alias("p"), F.lit(1).cast("byte").alias("role"))))
    as_index = F.transform(every, lambda b: F.struct(own.alias("i"), b.alias("p"), F.lit(0).cast("byte").alias("role")))
    as_probe = F.transform(every, lambda b: F.struct(b.alias("i"), own.alias("p"), F.lit(1).cast("byte").alias("role")))
    flat = flat.when(F.col("role") == 0, as_index).otherwise(F.concat(as_index, as_probe))
    sent = sent.select("k", "code", F.explode(flat).alias("x")).select(F.when((F.col("x.i") == 0) & (F.col("x.p") == 0), F.col("k")).otherwise(F.xxhash64("k", "x.i", "x.p")).alias("k"), F.col("x.role").alias("role"), "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)]

        def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for x, y in _verified(*rows, tau) if len(rows[0]) else ():
                held.append(forest(x, y) if dense else (x, y))
                size += len(held[-1][0])
                if size > CHUNK:
                    a, b = (np.concatenate(c) for c in zip(*held))
                    yield sent_edges(*(forest(a, b) if dense else (a, b)))
                    held, size = [], 0
            if held:
                a, b = (np.concatenate(c) for c in zip(*held))
                yield sent_edges(*(forest(a, b) if dense else (a, b)))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([x, y]) for x, y in zip(left, (batch["k"].to_numpy(), batch["role"].to_numpy(), batch["code"].to_numpy().view(np.uint64)))]
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last bucket may go on
            yield from found([r[:cut] for r in rows])
            left = [r[cut:] for r in rows]
        yield from found(left)

    width = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(width, "k").sortWithinPartitions("k").mapInArrow(run, "a long, b long").distinct()
