"""Mixing sources to target weights by weighted fair queueing.

Every document is put into a random but fixed order within its source. Its virtual finish time is the number of its source's words up to and with it,
divided by the source's target. All documents, with up to `repeats` passes over each source, are then range-sorted by that time and the order is cut at
the total budget; a document that would start at or after its source's target waits for ever, so one source's long document never becomes another source's
surplus. Native DataFrame code; no source is ever sorted in one task.

Defined results: a null text has size 0; a source of null is a source of its own, ordered last; documents of size 0 are never taken (taken 0); an empty
table gives an empty table; rows equal in id and text are separate documents, at one place of the order; other columns of docs stay, whatever their names
(but for names that start with "__mix_").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, ranked, written

SEED = 20_011
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], budget: int | None = None, repeats: int = REPEATS) -> DataFrame:
    """sizes (mix_source, mix_size) -> a row per source (mix_source, source_size, target, target_budget).

    Sources by code point, null last, take the weights in turn. Targets share the budget (all sizes, unless given) by weight; one that would pass
    repeats x its source's size stops there and the excess is shared again by weight. With sources sorted by limit / weight the stopped ones are a
    prefix, so the water level is the largest of the levels after each prefix: two running sums over the sources, no loop.
    """
    s = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", turn).withColumn("limit", F.col("source_size") * float(repeats))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("target_budget", F.least(F.lit(float(budget)) if budget is not None else F.sum("source_size").over(whole).cast("double"), F.sum("limit").over(whole)))
    full = Window.orderBy(F.col("limit") / F.col("w"), F.col("mix_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", F.try_divide(F.col("target_budget") - F.coalesce(F.sum("limit").over(full), F.lit(0.0)), F.sum("w").over(whole) - F.coalesce(F.sum("w").over(full), F.lit(0.0))))
    s = s.withColumn("level", F.max("level").over(whole))
    return s.select("mix_source", "source_size", F.least("limit", F.col("level") * F.col("w")).alias("target"), "target_budget")


def shuffled(id_col: str, text_col: str) -> Column:
    """The place in the shuffle: equal rows get equal places."""
    return F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def spread(shuffle: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(shuffle), F.lit(buckets)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A lean row per document: mix_id, mix_source, mix_size, mix_hash."""
    return docs.select(F.col(f"`{id_col}`").alias("mix_id"), F.col(f"`{source_col}`").alias("mix_source"), words_in(F.col(f"`{text_col}`")).alias("mix_size"), shuffled(id_col, text_col).alias("mix_hash"))


def placed(rows: DataFrame, goal: DataFrame, buckets: int) -> DataFrame:
    """rows of sized() with their source's target and mix_end, the words of the source up to and with the row."""
    goal = goal.withColumnRenamed("mix_source", "mix_goal")
    rows = rows.join(goal, F.col("mix_source").eqNullSafe(F.col("mix_goal"))).drop("mix_goal")
    rows = ranked(rows, ["mix_source"], [F.col("mix_hash"), F.col("mix_id").asc_nulls_last(), F.col("mix_size")], F.xxhash64("mix_hash"), buckets, "mix_rank", "mix_size", "mix_before")
    return rows.withColumn("mix_end", F.col("mix_before") + F.col("mix_size")).drop("mix_before")


def finish(copy: int) -> Column:
    """Virtual finish time of the copy-th pass over a document."""
    return F.try_divide(F.lit(copy) * F.col("source_size") + F.col("mix_end"), F.col("target"))


def early(copy: int) -> Column:
    """Whether the pass starts before the source has its target."""
    return F.lit(copy) * F.col("source_size") + F.col("mix_end") - F.col("mix_size") < F.col("target")


def cut(plan: DataFrame, repeats: int = REPEATS) -> tuple[float, int] | None:
    """The last (finish time, tie) within the budget in the global order, or None where nothing fits.

    The order is dealt out by ranges of the finish time; counts of words per range find the range the budget ends in, and only that one range is summed
    up row by row. Ties of the finish time go by the source's and the row's place.
    """
    spark = plan.sparkSession
    v = plan.where("mix_size > 0 AND target > 0").select(F.explode(F.array(*[F.struct(finish(c).alias("v"), early(c).alias("early")) for c in range(repeats)])).alias("x"), F.xxhash64("mix_source", "mix_rank").alias("tie"), "mix_size", "target_budget")
    v = v.where("x.early").select("x.v", "tie", "mix_size", "target_budget")
    dealt = written(v.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "v", "tie").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("mix_size").alias("n"), F.max("target_budget").alias("budget"), F.max(F.struct("v", "tie")).alias("last"))
    sums = sums.withColumn("to", F.sum("n").over(Window.orderBy("part"))).withColumn("over", F.col("to") > F.col("budget"))
    first = sums.where("over").orderBy("part").limit(1).collect()
    if not first:
        last = sums.agg(F.max("last").alias("m")).collect()[0]["m"]
        return (last["v"], last["tie"]) if last else None
    f = first[0]
    run = F.sum("mix_size").over(Window.orderBy("v", "tie").rowsBetween(Window.unboundedPreceding, 0))
    kept = dealt.where(F.col("part") == f["part"]).withColumn("run", run + F.lit(f["to"] - f["n"])).where(F.col("run") <= F.col("target_budget"))
    last = kept.agg(F.max(F.struct("v", "tie")).alias("m")).collect()[0]["m"]
    if last is None:
        last = sums.where(F.col("part") < f["part"]).agg(F.max("last").alias("m")).collect()[0]["m"]
    return (last["v"], last["tie"]) if last else None


def taken(plan: DataFrame, at: tuple[float, int] | None, repeats: int = REPEATS) -> DataFrame:
    """plan with mix_copies: how many of the document's passes lie within the cut."""
    if at is None:
        return plan.withColumn("mix_copies", F.lit(0))
    tie = F.xxhash64("mix_source", "mix_rank")
    one = lambda c: F.coalesce(((finish(c) < at[0]) | ((finish(c) == at[0]) & (tie <= at[1]))) & early(c) & (F.col("mix_size") > 0), F.lit(False)).cast("int")
    return plan.withColumn("mix_copies", sum((one(c) for c in range(1, repeats)), one(0)))


def planned(docs: DataFrame, weights: list[float], budget: int | None, repeats: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, int]:
    """The mix as lean rows (sized(), source_size, target, mix_end, mix_copies), and how many buckets order a source."""
    lean = written(sized(docs, id_col, text_col, source_col))
    buckets = buckets_for(lean.count())
    plan = written(placed(lean, targets(lean, weights, budget, repeats), buckets))
    return taken(plan, cut(plan, repeats), repeats), buckets


def mix(docs: DataFrame, weights: list[float], budget: int | None = None, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A lean row per document: id, mix_size, mix_source, source_size, target, mix_copies."""
    with Scratch(docs.sparkSession) as made:
        rows, _ = planned(docs, weights, budget, repeats, id_col, text_col, source_col)
        return made.outlive(rows.select(F.col("mix_id").alias(id_col), "mix_size", "mix_source", "source_size", "target", "mix_copies"))


def bounds(rows: DataFrame, buckets: int, repeats: int) -> DataFrame:
    """Lean rows with mix_copies -> (__mix_source, __mix_to, __mix_n): a row per source, with the last place that each pass takes, and how many rows it takes there."""
    rows = rows.where("mix_copies > 0").withColumn("at", place(spread(F.col("mix_hash"), buckets), F.col("mix_hash"), F.col("mix_id")))
    rows = rows.select("mix_source", "at", "mix_copies")
    to = rows.groupBy(F.col("mix_source").alias("__mix_source")).agg(F.array(*[F.max(F.when(F.col("mix_copies") > c, F.col("at"))) for c in range(repeats)]).alias("__mix_to"))
    last = rows.join(to, F.col("mix_source").eqNullSafe(F.col("__mix_source"))).where(F.exists("__mix_to", lambda x: x == F.col("at")))
    return last.groupBy("__mix_source", "__mix_to").agg(F.array(*[F.count_if((F.col("mix_copies") > c) & (F.col("__mix_to")[c] == F.col("at"))) for c in range(repeats)]).alias("__mix_n"))


def place(bucket: Column, shuffle: Column, ident: Column) -> Column:
    return F.struct(bucket.alias("bucket"), shuffle.alias("shuffle"), ident.isNull().alias("none"), ident.alias("id"))


def mixed(docs: DataFrame, weights: list[float], budget: int | None = None, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: whole rows of docs, each as often as it is taken.

    The rows do not move: what a pass takes of a source is a prefix of the source's order, so its last place is all that they have to meet. Of rows equal
    in id and text at such a place, as many are taken as the plan says; only these are numbered.
    """
    with Scratch(docs.sparkSession) as made:
        rows, buckets = planned(docs, weights, budget, repeats, id_col, text_col, source_col)
        goal = made.outlive(bounds(rows, buckets, repeats))
    wide = docs.where(F.col(f"`{text_col}`").rlike(WORD)).withColumn("__mix_hash", shuffled(id_col, text_col))
    wide = wide.withColumn("__mix_at", place(spread(F.col("__mix_hash"), buckets), F.col("__mix_hash"), F.col(f"`{id_col}`")))
    wide = wide.join(goal, F.col(f"`{source_col}`").eqNullSafe(F.col("__mix_source")))
    edge = F.coalesce(F.exists("__mix_to", lambda x: x == F.col("__mix_at")), F.lit(False))
    inner = F.size(F.filter("__mix_to", lambda x: F.col("__mix_at") < x))
    turn = F.row_number().over(Window.partitionBy("__mix_source", "__mix_at").orderBy(F.lit(1)))
    here = F.size(F.filter(F.arrays_zip("__mix_to", "__mix_n"), lambda x: (x["__mix_to"] == F.col("__mix_at")) & (F.col("__mix_turn") <= x["__mix_n"])))
    rows = wide.where(~edge).withColumn("__mix_copies", inner)
    rows = rows.unionByName(wide.where(edge).withColumn("__mix_turn", turn).withColumn("__mix_copies", inner + here).drop("__mix_turn"))
    return rows.where("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, [1, 2, 3]).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"), F.col("mix_source").alias("source"), F.col("mix_copies").cast("int").alias("copies"))
