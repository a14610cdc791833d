"""Tools shared by the operators: written tables and when they go, ranks without large windows, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

Made = list[tuple[DataFrame, str]]
_open: ContextVar[tuple[Made, ...]] = ContextVar("open", default=())


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again: it is computed once and survives lost executors. Within a Scratch it goes with that."""
    out = _write(df)
    for made in _open.get()[-1:]:
        made.append(out)
    return out[0]


class Scratch:
    """A span after which the tables that written() has made within it are deleted, but for those of outlive(), which go with the span around it, if any."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.made = spark, []

    def __enter__(self) -> Scratch:
        self.outer = _open.get()
        _open.set((*self.outer, self.made))
        return self

    def outlive(self, df: DataFrame) -> DataFrame:
        out = _write(df)
        for made in self.outer[-1:]:
            made.append(out)
        return out[0]

    def keep(self, table: DataFrame) -> None:
        """Gives a table made here to the span around it."""
        for made in self.outer[-1:]:
            made.extend(x for x in self.made if x[0] is table)
        self.made[:] = [x for x in self.made if x[0] is not table]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these now."""
        for path in [p for df, p in self.made if any(df is t for t in tables)]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.made[:] = [x for x in self.made if not any(x[0] is t for t in tables)]

    def __exit__(self, *_: object) -> None:
        _open.set(self.outer)
        self.drop(*(df for df, _ in self.made))


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Batches that go to Python and back hold about `size` of data, unless the session has a setting of its own: texts pass in and out, on both sides, in several copies."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "64m"):  # Spark's own setting
        spark.conf.set(key, size)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parted(wide: DataFrame, keys: DataFrame, on: list[Column], buckets: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """wide -> (rows that may have one of the keys, rows that have none), with a column __hit that is null for the latter, so that only the former have to move.

    on: the expressions of wide that the columns of keys stand for, in order. What is sent to all rows are the hashes' buckets that keys fall into, `buckets` rows at
    most, whatever the input. Where keys are so many that they fill all buckets, all rows may have one.
    """
    bucket = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
    hit = keys.select(bucket(keys.columns).alias("__hit")).distinct()
    wide = wide.withColumn("__b", bucket(on)).join(F.broadcast(hit), F.col("__b") == F.col("__hit"), "left").drop("__b")
    return wide.where("__hit IS NOT NULL"), wide.where("__hit IS NULL")


def buckets_for(rows: int, each: int = 10_000) -> int:
    """How many buckets keep about `each` rows in one."""
    return max(1, -(-rows // each))


def ranked(df: DataFrame, group: list[str], order: list[Column], spread: Column, buckets: int, rank: str, weight: str | None = None, before: str | None = None) -> DataFrame:
    """Numbers the rows of each group from 0 in the order (bucket, *order), without ever sorting a group in one task.

    spread is a hash of the row; its bucket's counts (groups x buckets rows) are summed up in a window, and only the rows of one bucket are sorted together. With `weight`, `before` gets the sum of weight over the rows before this one.
    """
    b = "__bucket"
    df = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int"))
    key = [*group, b]
    aggs = [F.count(F.lit(1)).alias("__n")] + ([F.sum(weight).alias("__w")] if weight else [])
    w = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    at = df.groupBy(*key).agg(*aggs)
    at = at.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__n0"), *([F.coalesce(F.sum("__w").over(w), F.lit(0)).alias("__w0")] if weight else []))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    out = df.join(at, on, "inner")
    inside = Window.partitionBy(*key).orderBy(*order)
    out = out.withColumn(rank, (F.col("__n0") + F.row_number().over(inside) - 1).cast("long"))
    if weight:
        out = out.withColumn(before, (F.col("__w0") + F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"))
    return out.drop(*[f"__k{i}" for i in range(len(key))], "__n0", "__w0", b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what a-b connect; at most one per node where that is fewer."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) <= len(nodes):
        return a, b
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    m = label != np.arange(len(nodes))
    return nodes[m], nodes[label[m]]


def thinned(edges: DataFrame, each: int = 1 << 18) -> DataFrame:
    """edges (a, b) -> fewer that connect the same: a spanning forest of every `each` edges of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, b = forest(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append((batch[0].to_numpy(), batch[1].to_numpy()))
            if sum(len(x[0]) for x in held) >= each:
                yield out()
                held = []
        if held:
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long), as (node, component): the smallest node reachable. Nodes without an edge to another node are left out.

    Labels start as the smallest neighbour. Each round takes the smallest label among neighbours, then follows labels of labels (pointer jumping), so a
    chain of n nodes takes about log n rounds. Edges are thinned to forests first; a hub's edges are parted by the skew join, as the sum after it is by the
    other end. Each round is a written table, and the one before is deleted.
    """
    with Scratch(edges.sparkSession) as made:
        both = thinned(edges.where("a <> b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c"))
        table = written(label.select(F.col("u").alias("node"), F.col("c").alias("component")))
        while True:
            label = table.select("node", "component")
            seen = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("m"))
            new = label.join(seen.withColumnRenamed("u", "node"), "node").select("node", F.least("component", "m").alias("l"), F.col("component").alias("old"))
            jump = label.select(F.col("node").alias("l"), F.col("component").alias("far"))
            new = written(new.join(jump, "l", "left").select("node", F.least("l", F.coalesce("far", "l")).alias("component"), "old"))
            made.drop(table)
            table = new
            if not new.where("component <> old").limit(1).count():
                return made.outlive(new.select("node", "component"))
