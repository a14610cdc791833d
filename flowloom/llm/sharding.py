"""Sharding by histogram sort: shards of nearly equal bytes from exact counts below candidate boundaries, and one exchange.

Rows are ordered by a hash of their text, so equal texts are one group and stay together. Exact bytes below 4,096 candidate boundaries are counted over all
partitions; each further round puts 4,096 probes into the intervals that hold a splitter, until every splitter is within `tolerance` of its quota. Groups
above 1 % of a shard (at most 100 x shards of them) are placed whole beforehand, largest first into the emptiest shard, and the quotas of the rest make
up for them. The law is even bytes; where it and whole groups cannot both hold, it goes first: a group above half a shard is dealt out row by row by a hash
of the id, at every size of the input.

Defined results: a null text has size 1 (no bytes plus 1) and crc 0, and shares a group with other null texts; an empty table gives an empty table;
repeated rows are separate rows; other columns are kept by sharded(), but for shard, slot and names that start with "shard_" or "__shard_", which are its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, ranked, written

SEED = 40_009
BITS = 12
TOLERANCE = 0.001


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.withColumns({
        "shard_size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "shard_group": F.xxhash64(F.lit(SEED), text),
        "shard_row": F.xxhash64(F.lit(SEED + 1), F.col(id_col), text),
    })


def placement(lean: DataFrame, shards: int) -> tuple[dict[int, int], list[int], list[float]]:
    """From lean rows: the shard of each large group, the groups to deal out singly, and the bytes each shard has left for the rest."""
    total = lean.agg(F.sum("shard_size").alias("n")).collect()[0]["n"] or 0
    large = lean.groupBy("shard_group").agg(F.sum("shard_size").alias("n")).where(F.col("n") > max(1.0, total / shards / 100))  # fewer than 100 x shards
    found = sorted(((r["n"], r["shard_group"]) for r in large.collect()), reverse=True)
    single = [g for n, g in found if n > total / shards / 2]
    whole, held = {}, [0] * shards
    for n, g in found:
        if g not in single:
            k = min(range(shards), key=lambda i: (held[i], i))
            whole[g], held[k] = k, held[k] + n
    rest = total - sum(held)
    level, open_ = 0.0, sorted(held)
    for i in range(shards):  # the level to which the rest fills the shards
        level = (rest + sum(open_[: i + 1])) / (i + 1)
        if i + 1 == shards or level <= open_[i + 1]:
            break
    return whole, single, [max(0.0, level - h) for h in held]


def splitters(rest: DataFrame, quotas: list[float], tolerance: float = TOLERANCE) -> list[int]:
    """Keys k_1 <= k_2 <= ...: a row of key >= k_i lies in shard i or later. rest has shard_key, unsigned order as a number from 0 to 2^63 - 1."""
    goals = [sum(quotas[: i + 1]) for i in range(len(quotas) - 1)]
    slack, high = max(1.0, tolerance * max(quotas, default=1.0)), 63
    lo, below = [0] * len(goals), [0] * len(goals)  # each splitter lies in [lo, lo + 2^high]
    done: list[int | None] = [None] * len(goals)
    while high and any(d is None for d in done):
        bits = max(0, high - BITS)
        at = sorted({x for x, d in zip(lo, done) if d is None})
        near = rest if high == 63 else rest.where(F.shiftright("shard_key", high).isin([x >> high for x in at]))
        got: dict[int, dict[int, int]] = {x: {} for x in at}
        for r in near.groupBy(F.shiftright("shard_key", bits).alias("k")).agg(F.sum("shard_size").alias("n")).collect():  # at most 4,096 for each splitter
            k = r["k"] << bits
            got[k >> high << high][k] = r["n"]
        for i, goal in enumerate(goals):
            if done[i] is None:
                n, start = below[i], lo[i]
                for k, size in sorted(got[start].items()):
                    if n + size > goal:
                        lo[i], below[i] = k, n
                        if goal - n <= slack:
                            done[i] = k
                        elif n + size - goal <= slack or bits == 0:
                            done[i] = min(k + (1 << bits), 2**63 - 1)
                        break
                    n += size
                else:
                    done[i] = min(start + (1 << high), 2**63 - 1)
        high = bits
    return [d if d is not None else x for d, x in zip(done, lo)]


def law(lean: DataFrame, shards: int, tolerance: float) -> tuple[DataFrame, Column, list[int], int]:
    """From lean rows: the table of groups that are placed beforehand (-1: dealt out singly), the key that orders the rest, its splitters, and how many buckets number a shard."""
    whole, single, quotas = placement(lean, shards)
    table = lean.sparkSession.createDataFrame([(g, k) for g, k in whole.items()] + [(g, -1) for g in single], "__shard_g long, __shard_place int")
    key = F.shiftrightunsigned(F.when(F.col("__shard_place") == -1, F.xxhash64("shard_row", "shard_group")).otherwise(F.col("shard_group")), 1)
    placed = lean.join(F.broadcast(table), F.col("shard_group") == F.col("__shard_g"), "left")  # below 100 x shards rows
    rest = placed.where("__shard_place IS NULL OR __shard_place = -1").select(key.alias("shard_key"), "shard_size")
    return table, key, splitters(rest, quotas, tolerance), buckets_for(lean.count() // shards)


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """docs with shard (int) and slot (its place in the shard, gapless from 0). The rows move once, to (shard, bucket of a hash)."""
    wide = keyed(docs.drop("shard", "slot"), id_col, text_col)
    with Scratch(docs.sparkSession):
        lean = written(wide.select("shard_size", "shard_group", "shard_row"))
        table, key, cuts, buckets = law(lean, shards, tolerance)
    by_key: Column = reduce(lambda a, b: a + b, [(F.col("__shard_key") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    out = wide.join(F.broadcast(table), F.col("shard_group") == F.col("__shard_g"), "left").withColumn("__shard_key", key)  # below 100 x shards rows
    out = out.withColumn("shard", F.when(F.col("__shard_place") >= 0, F.col("__shard_place")).otherwise(by_key).cast("int"))
    out = ranked(out, ["shard"], [F.col("__shard_key"), F.col("shard_row"), F.col(f"`{id_col}`")], F.xxhash64("shard_row"), buckets, "slot")
    return out.drop("__shard_g", "__shard_place", "__shard_key")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return sharded(docs).select("doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
