"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are taken from whole texts. Those of labelled documents (at most MAX_LABELLED, chosen by hash; a documented bound) are written as a lean table and
fit the model: moments for scaling, then each partition's sums of the normal equations of ridge scores on 2 x FEATURES random Fourier features of a
Gaussian kernel, then pool-adjacent-violators on rows that the ridge fit has not seen (a fifth of the training rows). The model is a few hundred numbers, sent
to one pass over all documents that measures and scores (or filters) them where they lie.

Defined results: null and empty texts have the statistics of an empty text and get a score; documents without label, or with a null label, are scored but
not learned from; of labelled documents that share an id one teaches; with labels of one kind only (or none) every score is that kind's share (or 0.5); without calibration rows (a handful of labels) the
ridge score is clipped to 0..1, with none but these every score is the share of ones; repeated ids are scored each; an empty table gives an
empty table; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, written

MAX_LABELLED, FEATURES, RIDGE, SEED, CUT = 200_000, 192, 1e-3, 50_021, 0.3
STATISTICS = ["log_bytes", "log_words", "word_length", "distinct_words", "top_word", "upper", "lower", "digit", "space", "non_ascii", "punctuation", "other_symbol", "bar", "exclamation", "entropy", "log_lines", "distinct_lines", "line_words", "all_upper_words", "symbol_words", "stop_ends", "short_words"]

_byte = np.arange(256)
_is = {
    "upper": (_byte >= 65) & (_byte <= 90), "lower": (_byte >= 97) & (_byte <= 122), "digit": (_byte >= 48) & (_byte <= 57), "space": np.isin(_byte, [9, 10, 11, 12, 13, 32]), "non_ascii": _byte >= 128,
    "punctuation": np.isin(_byte, list(b".,;:'\"()-?")), "other_symbol": np.isin(_byte, list(b"#$%&*+/<=>@[\\]^_`{}~")), "bar": _byte == 124, "exclamation": _byte == 33,
}
CLASSES = np.stack(list(_is.values())).astype(np.float64)
_odd = re.compile(rb"[^\w\s.,;:'\"()?\x80-\xff-]")


def statistics(text: bytes) -> list[float]:
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    share = CLASSES @ count / max(n, 1)
    p = count[count > 0] / max(n, 1)
    words, lines = text.split(), text.split(b"\n")
    m = len(words)
    many: dict[bytes, int] = {}
    for w in words:
        many[w] = many.get(w, 0) + 1
    mm = max(m, 1)
    return [
        np.log1p(n), np.log1p(m), (n - count[[9, 10, 11, 12, 13, 32]].sum()) / mm, len(many) / mm, max(many.values(), default=0) / mm, *share, float(-(p * np.log2(p)).sum()),
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(m / len(lines)), sum(c for w, c in many.items() if w.isupper()) / mm, sum(c for w, c in many.items() if _odd.search(w)) / mm,
        sum(c for w, c in many.items() if w[-1:] in b".,;:?!") / mm, sum(c for w, c in many.items() if len(w) <= 3) / mm,
    ]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with x, the statistics of the whole text (array of float); every other column is kept."""
    columns = [c for c in docs.columns if c != text_col]
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn("x", F.array(F.lit(1.0).cast("float"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py() or b"") for t in b.column(b.num_columns - 1)], np.float32).reshape(-1, len(STATISTICS))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], flat], [*b.schema.names[:-1], "x"])

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).cast("binary").alias("__t")).mapInArrow(run, schema)


class Model:
    def __init__(self, d: int) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.zeros(d), np.ones(d)
        self.w, self.beta = rng.standard_normal((d, FEATURES)) / np.sqrt(d), np.zeros(2 * FEATURES + d + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def z(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -6, 6)
        p = s @ self.w
        return np.hstack([np.cos(p), np.sin(p), s, np.ones((len(s), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0.0, 1.0)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function of score nearest to y, as (block centres, block values)."""
    blocks: list[list[float]] = []
    for s, v in sorted(zip(score.tolist(), y.tolist())):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)


def fit(labelled: DataFrame) -> Model:
    """From (key long, x, y double), which are few (learned() bounds them). key is a hash of the id: it chooses the fifth that calibrates."""
    spark, d = labelled.sparkSession, len(STATISTICS)
    model = Model(d)
    n = labelled.count()
    kinds = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        model.value = np.array([float(next(iter(kinds), 0.5))])
        return model
    rows = labelled.withColumn("late", F.pmod(F.xxhash64("key"), F.lit(5)) == 0).repartition(max(1, min(16, n // 5_000)), "key")
    learn = rows.where(~F.col("late"))
    if not learn.limit(1).count():
        model.value = np.array([sum(y * k for y, k in kinds.items()) / sum(kinds.values())])
        return model
    moments = learn.select(*[f(F.col("x")[i].cast("double")).alias(f"{k}{i}") for k, f in (("m", F.mean), ("s", F.stddev_pop)) for i in range(d)]).collect()[0]
    model.mean = np.array([moments[f"m{i}"] for i in range(d)])
    model.scale = np.array([moments[f"s{i}"] if moments[f"s{i}"] > 1e-9 else 1.0 for i in range(d)])
    start = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 2 * FEATURES + d + 1
        a, v = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            z = start.value.z(_rows(b))
            a += z.T @ z
            v += z.T @ b["y"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([a, v]).tobytes()])], ["sums"])

    total = sum(np.frombuffer(r["sums"]).reshape(-1, 2 * FEATURES + d + 1) for r in learn.select("x", "y").coalesce(8).mapInArrow(sums, "sums binary").collect())  # at most 8 rows, of a size that the features fix
    a, v = total[:-1], total[-1]
    model.beta = np.linalg.solve(a + RIDGE * a[-1, -1] * np.eye(len(a)), v)
    fitted = spark.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(fitted.value.raw(_rows(b))), b["y"]], ["s", "y"])

    held = rows.where("late").select("x", "y").mapInArrow(scores, "s double, y double").toPandas()  # at most a fifth of max_labelled
    model.at, model.value = isotonic(held["s"].to_numpy(), held["y"].to_numpy()) if len(held) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def learned(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality). Labels are chosen by a hash of the id, max_labelled of them at most, and sent to the documents, so no text moves."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("double").alias("y")).withColumn("key", F.xxhash64(F.lit(SEED), "__id"))
    with Scratch(docs.sparkSession):
        known = written(known)
        n = known.count()
        if n > max_labelled:  # so much less that chance does not pass the bound: 13 deviations
            known = known.where(F.pmod("key", F.lit(1_000_003)) < int(1_000_003 * 0.97 * max_labelled / n))
        rows = docs.select(F.col("doc_id").alias("__doc"), "text").join(F.broadcast(known), F.col("__doc") == F.col("__id"))
        rows = measured(rows.select("key", "y", F.xxhash64("text").alias("tie"), "text"))
        return fit(written(rows.groupBy("key").agg(F.min_by("x", "tie").alias("x"), F.first("y").alias("y"))))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with the text's score (double) in place of the text; a column named score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in (text_col, "score")]
    kept = [F.col(f"`{c}`") for c in names]
    schema = docs.select(*kept, F.lit(1.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores(shared.value, b.column(b.num_columns - 1)))], [*names, "score"])

    return docs.select(*kept, F.col(f"`{text_col}`").cast("binary").alias("__text")).mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the cut."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(shared.value, b.column(at).cast(pa.large_binary())) >= cut))

    return docs.mapInArrow(run, docs.schema)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    x = np.array([statistics(t.as_py() or b"") for t in texts], np.float32).reshape(-1, len(STATISTICS))
    return model.score(x.astype(np.float64)) if len(x) else np.zeros(0)


def id_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def quality_scores(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """doc_id and score for every row of docs; labels (doc_id, quality) where learn_from (of doc_id) holds teach it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(docs, learned(docs, labels.where(learn_from if learn_from is not None else F.lit(True))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels, id_fold(F.col("doc_id")) != 0)
    return out.select("doc_id", (id_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
