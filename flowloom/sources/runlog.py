"""What a feature run leaves besides its table: how long it took and what it needed, by session, and the hashes of the files that reports were made from."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .canonical import SESSION, write_features

LOG = "symbol string, session_label string, n_rows long, n_cols int, parquet_mb double, wall_s double, rows_per_sec double, peak_memory_mb double, spilled_mb double, tasks long"


def stage_needs(spark: SparkSession, group: str) -> tuple[float, float, int]:
    """Largest execution memory of a stage's tasks together and what was spilled, in MB, and the number of tasks, over the stages of a job group."""
    context = spark.sparkContext
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = {s for j in jobs if j for s in j.stageIds if tracker.getStageInfo(s)}
    data = [store.lastStageAttempt(s) for s in sorted(stages)]
    mb = lambda x: round(x / (1 << 20), 3)
    return mb(max([d.peakExecutionMemory() for d in data], default=0)), mb(sum(d.memoryBytesSpilled() + d.diskBytesSpilled() for d in data)), sum(d.numTasks() for d in data)


def run_sessions(sessions: list[DataFrame], path: str, log: str) -> DataFrame:
    """Writes the feature table of each session and appends a row for each to the log, a Parquet table; the log is returned. Rows are counted while they are written."""
    for features in sessions:
        spark, seen, group = features.sparkSession, Observation(), uuid.uuid4().hex
        context, start = spark.sparkContext, time.time()
        context.setJobGroup(group, "features of a session")
        try:
            counted = features.observe(seen, F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in SESSION])
            write_features(counted, path, skip_existing=False)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        wall, got = time.time() - start, seen.get
        if not got["n"]:
            continue
        files = session_files(spark, path).where((F.col("symbol") == got["symbol"]) & (F.col("session_label") == got["session_label"]))
        size = files.agg(F.sum("length")).collect()[0][0]
        memory, spilled, tasks = stage_needs(spark, group)
        row = (got["symbol"], got["session_label"], got["n"], len(features.columns), round(size / (1 << 20), 3), round(wall, 3), round(got["n"] / max(wall, 0.1), 1), memory, spilled, tasks)
        spark.createDataFrame([row], LOG).write.mode("append").parquet(log)
    return spark.read.schema(LOG).parquet(log)


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a feature table: symbol, session_label, path, length, content (each of a few MB; none may pass 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    part = lambda c: F.nullif(F.regexp_extract("path", f"/{c}=([^/]*)/", 1), F.lit("")).alias(c)
    return files.select(*map(part, SESSION), "path", "length", "content")


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Per session: rows, versions and the first 16 digits of a SHA-256, of its one file or, where it has several, of their digests in order."""
    each = session_files(spark, path).select(*SESSION, F.sha2("content", 256).alias("h"))
    hashes = each.groupBy(*SESSION).agg(F.count("h").alias("files"), F.array_sort(F.collect_list("h")).alias("h"))
    whole = F.when(F.col("files") == 1, F.col("h")[0]).otherwise(F.sha2(F.array_join("h", ""), 256))
    rows = spark.read.parquet(path)
    versions = [c for c in ("feature_version", "book_semantics_version") if c in rows.columns]
    facts = rows.groupBy(*[F.col(c).cast("string").alias(c) for c in SESSION]).agg(F.count(F.lit(1)).alias("n_rows"), *[F.max(c).alias(c) for c in versions])
    return facts.join(hashes.select(*SESSION, "files", F.substring(whole, 1, 16).alias("parquet_sha256_16")), SESSION)
