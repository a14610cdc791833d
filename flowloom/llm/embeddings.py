"""Embedding near-duplicates: codes by iterative quantisation, retrieval through multi-index Hamming tables, reranking by the original vectors.

A rotation that makes balanced binary codes is learned from at most SAMPLE vectors (chosen by hash; a documented bound); every vector gets a 64-bit code.
The code is cut into TABLES pieces; a piece's table is entered under the piece and all pieces one bit away, so two vectors meet where pieces differ in two
bits or fewer. A pair is looked at only where it meets first (lowest table, least meeting value), kept if its codes differ in RADIUS bits or fewer, and then
compared by cosine in double precision. Equal vectors are one representative, with how many they are; large buckets are parted into blocks. Where a block has
many pairs to a vector, its vectors meet in one matrix product instead, and what it sends is a number of links for each vector and a spanning forest: a
cluster of n vectors costs rows in proportion to n, not to its pairs.

Recall: at cosine 0.97 a piece of 16 bits differs in 1.25 bits on average and four such pieces miss about 3 pairs in 10,000; at exactly 0.9, 3 in 100.

Vectors of different lengths have no cosine: each length has a quantiser of its own and is taken apart (vectors of one model have one length).

Defined results: null and zero vectors, and vectors with null or non-finite components, link with nothing; repeated rows link with each other; ties do not
matter; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, width, written

COSINE, SAMPLE, TABLES, BITS, RADIUS, ROUNDS, BLOCK, DENSE, FEW, SEED = 0.9, 20_000, 4, 64, 20, 30, 2048, 4, 64, 70_001
PIECE = BITS // TABLES


class Quantiser:
    """Centre, projection and rotation; code() gives sign bits."""

    def __init__(self, sample: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        d = sample.shape[1]
        self.mean = sample.mean(0) if len(sample) else np.zeros(d)
        x = sample - self.mean
        if d >= BITS and len(sample) > BITS:
            _, vectors = np.linalg.eigh(x.T @ x)
            projection = vectors[:, ::-1][:, :BITS]
        else:
            projection = rng.standard_normal((d, BITS)) / np.sqrt(d)
        v = x @ projection
        r, _ = np.linalg.qr(rng.standard_normal((BITS, BITS)))
        for _ in range(ROUNDS if len(sample) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.turn = projection @ r

    def code(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.turn >= 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def unit(rows: pa.Array, d: int) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(e: Column) -> Column:
    """Whether a vector can link: it is known, finite and not zero."""
    return F.coalesce(e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))


def candidates(coded: DataFrame) -> DataFrame:
    """(rep, code) -> as kind 0 pairs (a, b) of reps whose codes meet in a table and differ in RADIUS bits or fewer, each once; as kind 1 the rows (a: rep, b: task, ..) of tasks that have more than DENSE pairs for each row."""
    flips = np.array([0, *(1 << i for i in range(PIECE))], np.uint64)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, code = b[0].to_numpy(), b[1].to_numpy().view(np.uint64)
            for t in range(TABLES):
                piece = (code >> np.uint64(PIECE * t)) & np.uint64((1 << PIECE) - 1)
                k = (piece[:, None] ^ flips[None, :]).ravel() | np.uint64(t << PIECE)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.repeat(rep, len(flips))), pa.array(np.repeat(code, len(flips)).view(np.int64))], ["k", "rep", "code"])

    sent = coded.mapInArrow(entries, "k long, rep long, code long")
    heavy = sent.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(F.col("k").alias("hk"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sent = sent.join(heavy, F.col("k") == F.col("hk"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
    sent = sent.select("k", "rep", "code", own.alias("own"), F.explode(meets).alias("at")).select(F.when(F.col("at.j") == 0, F.col("k")).otherwise(F.xxhash64("k", "at.i", "at.j")).alias("task"), "k", "rep", "code", (F.col("at.i") == F.col("at.j")).alias("alone"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool), np.zeros(0, np.int32)]

        def sent(kind: int, a: np.ndarray, b: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), *map(pa.array, rows)], ["kind", "a", "b", "k", "code", "alone", "own"])

        def small(task: np.ndarray, k: np.ndarray, rep: np.ndarray, code: np.ndarray, alone: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The pairs of many tasks of few rows each."""
            start = np.concatenate([[True], task[1:] != task[:-1]])
            first = np.maximum.accumulate(np.where(start, np.arange(len(task)), 0))
            before = np.arange(len(task)) - first  # each row meets the rows of its task before it
            ends, lo = np.cumsum(before), 0
            while lo < len(task):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 18), "right")))
                n = before[lo:hi]
                i = np.repeat(np.arange(lo, hi), n)
                j = np.repeat(first[lo:hi], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                m = alone[i] | (own[i] != own[j])
                i, j = i[m], j[m]
                m = first_met(i, j, k, code)
                if m.any():
                    a, b = rep[i[m]], rep[j[m]]
                    none = np.zeros(len(a), np.int64)
                    yield sent(0, np.minimum(a, b), np.maximum(a, b), [none, none, none > 0, none.astype(np.int32)])
                lo = hi

        def of_task(task: int, k: np.ndarray, rep: np.ndarray, code: np.ndarray, alone: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            """The pairs of one task; where they are more than DENSE for each row, its rows."""
            rows, found, n = np.arange(len(rep)), [], 0
            ends, lo = np.cumsum(rows), 0
            while lo < len(rep) and n <= DENSE * len(rep):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 18), "right")))
                i = np.repeat(rows[lo:hi], rows[lo:hi])
                j = np.arange(len(i)) - np.repeat(np.cumsum(rows[lo:hi]) - rows[lo:hi], rows[lo:hi])
                m = alone[i] | (own[i] != own[j])
                i, j = i[m], j[m]
                m = first_met(i, j, k, code)
                found.append((rep[i[m]], rep[j[m]]))
                n += int(m.sum())
                lo = hi
            if n > DENSE * len(rep):
                return sent(1, rep, np.full(len(rep), task), [k, code.view(np.int64), alone, own])
            a, b = (np.concatenate(x) for x in zip(*found))
            none = np.zeros(len(a), np.int64)
            return sent(0, np.minimum(a, b), np.maximum(a, b), [none, none, none > 0, none.astype(np.int32)])

        def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not len(rows[0]):
                return
            cuts = np.concatenate([[0], np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1, [len(rows[0])]])
            size = np.diff(cuts)
            few = np.repeat(size <= FEW, size)
            task, k, rep, code, alone, own = rows
            yield from small(task[few], k[few], rep[few], code[few].view(np.uint64), alone[few], own[few])
            for lo, hi in zip(cuts[:-1][size > FEW].tolist(), cuts[1:][size > FEW].tolist()):
                out = of_task(task[lo], k[lo:hi], rep[lo:hi], code[lo:hi].view(np.uint64), alone[lo:hi], own[lo:hi])
                if out.num_rows:
                    yield out

        for b in batches:
            if b.num_rows:
                held = [np.concatenate([x, b[i].to_numpy(zero_copy_only=False)]) for i, x in enumerate(held)]
                last = int(np.searchsorted(held[0], held[0][-1], "left"))
                yield from found([x[:last] for x in held])
                held = [x[last:] for x in held]
        yield from found(held)

    return sent.repartition(width(coded.sparkSession), "task").sortWithinPartitions("task").select("task", "k", "rep", "code", "alone", "own").mapInArrow(run, "kind byte, a long, b long, k long, code long, alone boolean, own int")


def first_met(i: np.ndarray, j: np.ndarray, k: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether rows i and j of a table's bucket are near in all bits, and meet here first: in the lowest table where they can, at the least value."""
    x = code[i] ^ code[j]
    near = np.bitwise_count(x) <= RADIUS
    out = np.zeros(len(i), bool)
    some = np.flatnonzero(near)
    i, j, x = i[some], j[some], x[some]
    table = (k[i] >> PIECE).astype(np.uint64)
    at, first = np.zeros(len(i), np.uint64), np.full(len(i), TABLES, np.uint64)
    for t in range(TABLES - 1, -1, -1):  # the lowest table with two bits or fewer apart
        part = (x >> np.uint64(PIECE * t)) & np.uint64((1 << PIECE) - 1)
        close = np.bitwise_count(part) <= 2
        first[close], at[close] = t, part[close]
    a, b = ((code[z] >> (np.uint64(PIECE) * table)) & np.uint64((1 << PIECE) - 1) for z in (i, j))
    one = at & (~at + np.uint64(1))  # least bit apart
    n = np.bitwise_count(at)
    meet = np.where(n == 0, a, np.where(n == 1, np.minimum(a, b), np.minimum(a ^ one, a ^ (at ^ one))))
    out[some] = (first == table) & ((k[i].view(np.uint64) & np.uint64((1 << PIECE) - 1)) == meet)
    return out


def dense(rows: DataFrame, cosine: float, d: int) -> DataFrame:
    """Rows of dense tasks (task, rep, k, code, alone, own, copies, v) -> (kind, a, b): links found as kind 0, rep and how many vectors it links to; kind 1, edges that connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rep, k, code, own, copies = (b[c].to_numpy() for c in ("rep", "k", "code", "own", "copies"))
            alone, u, code = b["alone"].to_numpy(zero_copy_only=False), unit(b["v"], d), code.view(np.uint64)
            others, edges = np.zeros(len(rep), np.int64), []
            for lo in range(0, len(rep), 256):
                i, j = np.nonzero(u[lo : lo + 256] @ u[: lo + 256].T >= cosine)
                i += lo
                m = (j < i) & (alone[i] | (own[i] != own[j]))
                i, j = i[m], j[m]
                m = first_met(i, j, k, code)
                i, j = i[m], j[m]
                np.add.at(others, i, copies[j])
                np.add.at(others, j, copies[i])
                edges.append(forest(rep[i], rep[j]))
            x, y = forest(*(np.concatenate(e) for e in zip(*edges)))
            some = others > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(some.sum(), np.int8), np.ones(len(x), np.int8)])), pa.array(np.concatenate([rep[some], x])), pa.array(np.concatenate([others[some], y]))], ["kind", "a", "b"])

        held = None
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
                task = t["task"].to_numpy()
                cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist()]
                for lo, hi in zip(cuts, cuts[1:]):
                    yield from found(t.slice(lo, hi - lo))
                held = t.slice(cuts[-1])
        if held is not None:
            yield from found(held)

    return rows.select("task", "rep", "k", "code", "alone", "own", "copies", "v").repartition(width(rows.sparkSession), "task").sortWithinPartitions("task").mapInArrow(run, "kind byte, a long, b long")


def linked(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept) for every row."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    e = F.col("embedding")
    links = vectors.where(usable(e))
    lengths = sorted(r["d"] for r in links.select(F.size(e).alias("d")).distinct().collect())  # a row for each length
    v = F.transform(e, lambda x: x.cast("double") + 0.0).alias("v")
    alone = vectors.where(~usable(e)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    parts = [of_length(links.where(F.size(e) == d).select("vec_id", v), d, cosine) for d in lengths]
    return reduce(DataFrame.unionByName, [alone, *parts]).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def of_length(vectors: DataFrame, d: int, cosine: float) -> DataFrame:
    """Usable vectors (vec_id, v) of one length -> (vec_id, n_links, component_id). Distinct vectors are numbered when they are written."""
    vectors = vectors.withColumn("h", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))
    ids = written(vectors.select("vec_id", "h"))
    reps = written(vectors.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).withColumn("rid", F.monotonically_increasing_id()))
    n = reps.count()
    sample = reps.where(F.pmod(F.xxhash64(F.lit(SEED), "h"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE / max(n, 1)))).select("v").toArrow()["v"].combine_chunks() if n else None
    quantiser = vectors.sparkSession.sparkContext.broadcast(Quantiser(unit(sample, d) if n and len(sample) else np.zeros((0, max(d, 1)))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b[0], pa.array(quantiser.value.code(unit(b[1], d)).view(np.int64))], ["rep", "code"])

    near = written(candidates(written(reps.select("rid", "v").mapInArrow(encode, "rep long, code long"))))
    side = lambda name: reps.select(F.col("rid").alias(name), F.col("v").alias(f"v{name}"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = pa.array((unit(b[2], d) * unit(b[3], d)).sum(1) >= cosine)
                yield pa.RecordBatch.from_arrays([b[0].filter(m), b[1].filter(m)], ["a", "b"])

    links = written(near.where("kind = 0").select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(rerank, "a long, b long"))
    rows = near.where("kind = 1").select(F.col("b").alias("task"), F.col("a").alias("rep"), "k", "code", "alone", "own")
    thick = written(dense(rows.join(reps.select(F.col("rid").alias("rep"), "copies", "v"), "rep"), cosine, d))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    many = reps.select(F.col("rid").alias("b"), "copies")
    count = both.join(many, "b").select("a", F.col("copies").alias("n")).unionByName(thick.where("kind = 0").select("a", F.col("b").alias("n")))
    count = count.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rid")
    edges = links.unionByName(thick.where("kind = 1").select("a", "b"))
    group = components(edges).withColumnRenamed("node", "rid").join(reps.select("rid", "rep"), "rid")
    group = group.join(group.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("rid", "component_id")
    result = reps.select("rid", "h", "rep", "copies").join(count, "rid", "left").join(group, "rid", "left")
    result = result.select("h", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    return ids.join(result, "h").select("vec_id", "n_links", "component_id")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
