"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each of the 255 decision nodes has its own tree of byte contexts of depth 0 .. DEPTH. A context keeps the counts of
zeros and ones; its Krichevsky-Trofimov estimate is mixed half and half with the product of its children's mixtures, over all depths. The corpus gives
counts of (DEPTH + 1)-byte strings, summed by the cluster; subtrees below two context bytes are weighted in parallel, and the two levels above them are at
most 65,536 nodes. The scores are those of the trained trees, held fixed: log10 of the probability of the text's bytes and of the end mark.

Strings of texts that are scored but not learned from are counted as 0 times seen, so the table has the value of every string that scoring meets. A table of
up to MODEL_ROWS rows is broadcast. A larger one is cut into slices by a hash of the string, and each slice scores the positions it knows in a pass of its
own over the texts, so memory is bounded and no context is dropped.

Defined results: a null text counts as empty (its end mark is scored); an untrained model gives each binary decision one half; repeated rows are scored
each; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import width, written

DEPTH, START, END, MODEL_ROWS, BLOCK_ROWS, PART = 5, 0xFE, 0xFF, 8_000_000, 8192, 1 << 19


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each position's string (last byte of context first, the byte itself lowest) and where each text's positions start."""
    pad, mark = bytes([START]) * depth, bytes([END])
    b = np.frombuffer(b"".join([x for t in texts for x in (pad, t, mark)]), np.uint8)
    n = len(b) - depth
    k = np.zeros(n, np.int64)
    for j in range(1, depth + 1):
        k |= b[depth - j : depth - j + n].astype(np.int64) << (8 * (depth - j + 1))
    k |= b[depth:]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    keep = np.ones(n, bool)
    for j in range(depth):  # the pad before each later text is no symbol
        keep[starts[1:] - depth + j] = False
    return k[keep], np.cumsum(sizes) - sizes


def parts(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lists of texts of about PART bytes; one longer text stays whole."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def counted(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(train boolean, text binary) -> (k, n): how often each (depth + 1)-byte string occurs in training texts, 0 where only others have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return u, np.bincount(at, np.concatenate([n for _, n in held]), len(u)).astype(np.int64)

        for b in batches:
            taught = b[0].to_numpy(zero_copy_only=False)
            for train in (True, False):
                for some in parts(t.as_py() or b"" for t in b[1].filter(pa.array(taught == train))):
                    u, c = np.unique(grams(some, depth)[0], return_counts=True)
                    held.append((u, c if train else np.zeros_like(c)))
                    size += len(u)
                    if size > 800_000:
                        held = [merged()]
                        size = 0
                        if len(held[0][0]) > 800_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["k", "n"])
                            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["k", "n"])

    return texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def lgamma(x: np.ndarray) -> np.ndarray:
    y, p = x + 8, np.ones_like(x)
    for i in range(8):
        p = p * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(p)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - log(np.pi) - lgamma(n0 + n1 + 1.0)


def weighted(log_estimate: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node's mixture, and the weight of its own estimate in it."""
    mix = np.logaddexp(log_estimate, log_children) - log(2)
    return mix, np.exp(log_estimate - log(2) - mix)


def subtrees(k: np.ndarray, n: np.ndarray, depth: int) -> list[dict[str, np.ndarray]]:
    """For depths 2 .. depth the nodes (key: context and decision node) with counts, mixtures, weights and their parent's place. k is sorted."""
    s = (k & 255).astype(np.int64)
    node = np.concatenate([(1 << j) | (s >> (8 - j)) for j in range(8)])
    bit = np.concatenate([(s >> (7 - j)) & 1 for j in range(8)])
    full = np.tile((k >> 8) << 8, 8) | node
    key, at = np.unique(full, return_inverse=True)
    count = np.tile(n, 8).astype(np.float64)
    n1 = np.bincount(at, count * bit, len(key))
    n0 = np.bincount(at, count, len(key)) - n1
    levels = [{"key": key, "n0": n0, "n1": n1, "of_gram": at}]
    for _ in range(depth - 2):
        below = levels[0]
        up = ((below["key"] >> 16) << 8) | (below["key"] & 255)
        key, parent = np.unique(up, return_inverse=True)
        below["parent"] = parent
        levels.insert(0, {"key": key, "n0": np.bincount(parent, below["n0"], len(key)), "n1": np.bincount(parent, below["n1"], len(key))})
    children = None
    for level in reversed(levels):
        own = log_kt(level["n0"], level["n1"])
        if children is None:
            level["mix"], level["w"] = own, np.ones(len(own))
        else:
            level["mix"], level["w"] = weighted(own, children)
        if "parent" in level:
            children = np.bincount(level["parent"], level["mix"])
    return levels


def by_subtree(table: DataFrame, depth: int, f, schema: str) -> DataFrame:
    """f(k, n) over whole subtrees of two context bytes, many of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # joined once, when a subtree ends after enough rows
        size, shift = 0, 8 * (depth - 1)
        whole = lambda: f(*(np.concatenate(x) for x in zip(*held)))
        for b in batches:
            k, n = b[0].to_numpy(), b[1].to_numpy()
            if not len(k):
                continue
            if size > 100_000:
                cut = int(np.searchsorted(k, k[-1] >> shift << shift))  # the subtree at the end may go on
                if k[-1] >> shift != held[-1][0][-1] >> shift:
                    held.append((k[:cut], n[:cut]))
                    yield whole()
                    held, size, k, n = [], 0, k[cut:], n[cut:]
            held.append((k, n))
            size += len(k)
        if held:
            yield whole()

    return table.repartition(width(table.sparkSession), F.shiftright("k", 8 * (depth - 1))).sortWithinPartitions("k").mapInArrow(run, schema)


class Model:
    """table (k, value): the log10 probability of each string's last byte after the bytes before it."""

    def __init__(self, depth: int, table: DataFrame, slices: int) -> None:
        self.depth, self.table, self.slices = depth, table, slices


def train(table: DataFrame, depth: int = DEPTH, model_rows: int = MODEL_ROWS) -> Model:
    """table (k, n) of counted(), written -> the model."""
    spark = table.sparkSession

    def tops(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        t = subtrees(k, n, depth)[0]
        return pa.RecordBatch.from_arrays([pa.array(((t["key"] >> 16) << 8) | (t["key"] & 255)), pa.array(t["n0"]), pa.array(t["n1"]), pa.array(t["mix"])], ["key", "n0", "n1", "mix"])

    n0, n1, below = (np.zeros(65_536) for _ in range(3))
    for r in by_subtree(table, depth, tops, "key long, n0 double, n1 double, mix double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "mix")]).collect():  # at most 65,536 rows
        n0[r["key"]], n1[r["key"]], below[r["key"]] = r["n0"], r["n1"], r["mix"]
    mix, w1 = weighted(log_kt(n0, n1), below)
    mix[n0 + n1 == 0] = 0
    s0, s1 = n0.reshape(256, 256).sum(0), n1.reshape(256, 256).sum(0)
    _, w0 = weighted(log_kt(s0, s1), mix.reshape(256, 256).sum(0))
    a0, b0 = np.tile(w0 * (s1 + 0.5) / (s0 + s1 + 1), 256), np.tile(1 - w0, 256)
    seen = n0 + n1 > 0
    a = np.where(seen, a0 + b0 * w1 * (n1 + 0.5) / (n0 + n1 + 1), a0 + b0 / 2)
    b = np.where(seen, b0 * (1 - w1), 0.0)
    top = spark.sparkContext.broadcast((a, b))

    def rows(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        levels, (a, b) = subtrees(k, n, depth), top.value
        up = ((levels[0]["key"] >> 16) << 8) | (levels[0]["key"] & 255)
        a, b = a[up], b[up]
        for d, t in enumerate(levels, 2):
            if d > 2:
                a, b = a[t["parent"]], b[t["parent"]]
            a, b = a + b * t["w"] * (t["n1"] + 0.5) / (t["n0"] + t["n1"] + 1), b * (1 - t["w"])
        s, p = k & 255, a[levels[-1]["of_gram"]].reshape(8, -1)
        bits = np.stack([(s >> (7 - j)) & 1 for j in range(8)])
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.log10(np.where(bits == 1, p, 1 - p)).sum(0))], ["k", "value"])

    out = written(by_subtree(table, depth, rows, "k long, value double"))
    return Model(depth, out, max(1, -(-out.count() // model_rows)))


class Scorer:
    """A slice of the model in memory, as a hash table of strings."""

    def __init__(self, depth: int, keys: np.ndarray, values: np.ndarray) -> None:
        self.depth = depth
        self.bits = max(10, int(len(keys) * 2).bit_length())
        self.slot, self.value, self.hops = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits), 0
        left = np.arange(len(keys))
        while len(left):
            at = self.place(keys[left], self.hops)
            free = np.flatnonzero(self.slot[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.slot[at[first]], self.value[at[first]] = keys[left[first]], values[left[first]]
            left = np.delete(left, first)
            self.hops += 1

    def place(self, k: np.ndarray, hop: int) -> np.ndarray:
        h = (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(hop)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, from the positions this slice knows."""
        k, starts = grams(texts, self.depth)
        out, left = np.zeros(len(k)), np.arange(len(k))
        for hop in range(self.hops):
            kk = k[left]
            at = self.place(kk, hop)
            held = self.slot[at]
            hit = held == kk
            out[left[hit]] = self.value[at[hit]]
            left = left[~hit & (held >= 0)]  # an empty place ends the search
            if not len(left):
                break
        return np.add.reduceat(out, starts)


def scorers(model: Model) -> Iterator[tuple]:
    """One broadcast after the other, each of a slice of about MODEL_ROWS rows."""
    spark = model.table.sparkSession
    for part in range(model.slices):
        t = model.table.where(F.pmod(F.xxhash64("k"), F.lit(model.slices)) == part).toArrow()
        yield uuid.uuid4().hex, spark.sparkContext.broadcast((model.depth, t["k"].to_numpy(), t["value"].to_numpy()))


_scorer: dict[str, Scorer] = {}


def scorer_of(shared: tuple) -> Scorer:
    """One Scorer per worker process and slice."""
    name, value = shared
    if name not in _scorer:
        _scorer.clear()
        _scorer[name] = Scorer(*value.value)
    return _scorer[name]


def text_scores(texts: list[bytes], score: Scorer) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(score(p) for p in parts(iter(texts)))])


def add_scores(rows: DataFrame, shared) -> DataFrame:
    """rows (.., score double, text binary) with this slice's part added to score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer_of(shared)
        for b in batches:
            if b.num_rows:
                i = b.schema.get_field_index("score")
                yield b.set_column(i, "score", pa.array(b["score"].to_numpy() + text_scores([t or b"" for t in b["text"].to_pylist()], score)))

    return rows.mapInArrow(run, rows.schema)


def lm_scores(docs: DataFrame, learn_from: Column, depth: int = DEPTH, text_col: str = "text", model_rows: int = MODEL_ROWS) -> DataFrame:
    """docs with score, the model's log10 probability of the whole text; learn_from says which rows teach it."""
    rows = docs.withColumn(text_col, F.col(text_col).cast("binary")).withColumnRenamed(text_col, "text")
    model = train(written(counted(rows.select(learn_from.alias("train"), "text"), depth)), depth, model_rows)
    rows = rows.withColumn("score", F.lit(0.0))
    for i, shared in enumerate(scorers(model)):
        rows = add_scores(rows, shared)
        if i + 1 < model.slices:
            rows = written(rows)
    return rows.withColumn("text", F.col("text").cast("string")).withColumnRenamed("text", text_col)


def blocks(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with block, a number shared by neighbouring rows of one file; for rows that come from no file, by rows of equal hash, dealt out by it."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / block_rows)).alias("block"))
    except Exception as e:  # the rows come from no file
        if "UNRESOLVED" not in str(e) and "cannot be resolved" not in str(e) and "METADATA" not in str(e).upper():
            raise
    n = max(1, -(-docs.count() // block_rows))
    return docs.withColumn("block", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(n))).repartition(width(docs.sparkSession), "block")


def block_words(rows: DataFrame) -> DataFrame:
    """(block, train, text) -> (block, word, n): the words of each block and how often its training texts have them. The word null stands for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taught, other, ends = None, Counter(), set(), 0

        def out() -> Iterator[pa.RecordBatch]:
            other.difference_update(taught)
            words, n = [None, *taught, *other], [ends, *taught.values(), *([0] * len(other))]
            for i in range(0, len(words), 50_000):
                w = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(w), pa.int64()), pa.array(w, pa.binary()), pa.array(n[i : i + 50_000], pa.int64())], ["block", "word", "n"])

        for b in batches:
            for block, train, text in zip(b[0].to_pylist(), b[1].to_pylist(), b[2]):
                if block != now or len(taught) + len(other) > 300_000:
                    if now is not None:
                        yield from out()
                    now, taught, other, ends = block, Counter(), set(), 0
                w = (text.as_py() or b"").lower().split()
                if train:
                    taught.update(w)
                    ends += 1
                else:
                    other.update(w)
        if now is not None:
            yield from out()

    return rows.select("block", "train", "text").mapInArrow(run, "block long, word binary, n long")


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = blocks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return scored_with_base(docs.select("block", "doc_id", (fold != 1).alias("train"), F.col("text").cast("binary").alias("text")))


def scored_with_base(rows: DataFrame, depth: int = DEPTH, model_rows: int = MODEL_ROWS) -> DataFrame:
    """rows (block, doc_id, train, text binary) with the model's score and the word-count score that it is held against."""
    spark = rows.sparkSession
    model = train(written(counted(rows.select("train", "text"), depth)), depth, model_rows)
    held = written(block_words(rows))
    counts = held.groupBy("word").agg(F.sum("n").alias("c"))
    sums = held.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).collect()[0]
    distinct = counts.where("c > 0").count()
    n, ends, base = sums["n"] or 0, sums["ends"] or 0, np.log10((sums["n"] or 0) + 0.5 * (distinct + 1))
    known = held.where("word IS NOT NULL").select("block", "word").join(counts, "word").select("block", F.lit(0).alias("kind"), "word", "c", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(None).cast("binary").alias("text"))
    both = known.unionByName(rows.select("block", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("c"), F.col("doc_id").cast("long").alias("doc_id"), "train", "text"))
    shared = scorers(model)
    first, end_value = next(shared), float(np.log10(ends + 0.5))
    keep_text = model.slices > 1
    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double" + (", text binary" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, value, now = scorer_of(first), {}, None
        for b in batches:
            block, kind = b["block"].to_numpy(), b["kind"].to_numpy()
            for lo, hi in zip(cuts := [0, *(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(block)], cuts[1:]):
                if lo == hi:
                    continue
                if block[lo] != now:
                    now, value = block[lo], {}
                x = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    value.update(zip(x["word"].to_pylist(), np.log10(x["c"].to_numpy() + 0.5).tolist()))
                    continue
                texts = [t or b"" for t in x["text"].to_pylist()]
                tokens, knowns, sums_ = [], [], []
                for t in texts:
                    v = np.fromiter(map(value.__getitem__, t.lower().split()), np.float64)
                    tokens.append(len(v) + 1)
                    knowns.append(int((v > 0).sum()) + (ends > 0))
                    sums_.append(float(v.sum()) + end_value - (len(v) + 1) * base)
                yield pa.RecordBatch.from_arrays([x["doc_id"], x["train"], pa.array(tokens, pa.int64()), pa.array(knowns, pa.int64()), pa.array(sums_), pa.array(text_scores(texts, score)), *([x["text"]] if keep_text else [])], [f.split()[0] for f in schema.split(", ")])

    out = both.repartition(width(spark), "block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)
    for s in shared:
        out = add_scores(written(out), s)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
