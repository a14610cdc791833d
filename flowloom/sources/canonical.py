"""Raw order and execution events (JSON lines) -> the canonical event table, and the table's sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import rank_pct

ORDER = "struct<uid string, direction string, side string, limitPrice string, quantity string, filled string, orderType string, reduceOnly boolean>"
RAW = (
    "uid string, timestamp long, event struct<"
    f"OrderPlaced: struct<order: {ORDER}, reason string>, OrderCancelled: struct<order: {ORDER}, reason string>, OrderRejected: struct<order: {ORDER}, reason string>, "
    f"OrderUpdated: struct<oldOrder: {ORDER}, newOrder: {ORDER}, reason string>, "
    f"Execution: struct<execution: struct<uid string, makerOrder: {ORDER}, takerOrder: {ORDER}, quantity string, price string, usdValue string>>>"
)
TYPES = ["OrderPlaced", "OrderUpdated", "Execution", "OrderCancelled", "OrderRejected"]
#: Within one timestamp events count as an unordered batch and are applied in this order.
PRIORITY = {"OrderPlaced": 0, "OrderUpdated": 1, "Execution": 2, "OrderCancelled": 3, "OrderRejected": 3}


def priority(event_type: Column) -> Column:
    out = F.lit(9)
    for t, p in PRIORITY.items():
        out = F.when(event_type == t, p).otherwise(out)
    return out


def number(x: Column) -> Column:
    """A number, or null: text that is no number, NaN and blanks are null."""
    v = x.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def side_of(order: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(order["direction"], F.lit("")), order["side"]))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value, ingest_pos) of raw events as columns, with event_key, the name of the line's event even where it is of no known type. Lines that are no JSON have null columns."""
    key = F.nullif(F.regexp_extract("value", r'"event"\s*:\s*\{\s*"([^"]*)"', 1), F.lit(""))
    return lines.select(F.from_json("value", RAW).alias("x"), key.alias("event_key"), "ingest_pos").select("x.*", "event_key", "ingest_pos")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of raw events with ingest_pos, their number from 0: files by name, then lines as they stand. Empty lines do not count."""
    return parsed(line_numbers(spark.read.text(path).where("trim(value) <> ''")))


def line_numbers(lines: DataFrame) -> DataFrame:
    """Lines of text files (value) with ingest_pos. A split of a file is read in order by one task, so a line's number is what the splits before it hold, and its place among its own.

    The table of splits has a row for each. A split is cut alike in both scans; if the cluster has changed so that it is not, the lines fail rather than get no number.
    """
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    files = splits.groupBy("file").agg(F.sum("n").alias("in_file"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(F.col("file").alias("f"), before("in_file", Window.orderBy("file")).alias("files"))
    inside = before("n", Window.partitionBy("file").orderBy("start"))
    splits = splits.select(F.col("file").alias("f"), F.col("start").alias("s"), "first", "last", inside.alias("inside")).join(files, "f")
    out = rows.join(splits, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")), "left")
    found = F.col("at").between(F.col("first"), F.col("last"))
    return out.select("value", F.when(found, F.col("files") + F.col("inside") + F.col("at") - F.col("first")).otherwise(F.raise_error(F.lit("splits of the files changed between two scans"))).alias("ingest_pos"))


#: The selected sessions, in the order of reports.
LABELS = ["LOW", "MEDIAN", "HIGH"]


def read_sessions(spark: SparkSession, path: str, labels: list[str] = LABELS) -> DataFrame:
    """The manifest's selected sessions in the labels' order, with since and before in ms (a CSV with selected, warmup_start, research_end)."""
    rows = spark.read.option("header", True).csv(path).where(F.col("selected").isin(*labels))
    ms = lambda c: F.unix_millis(F.to_timestamp(F.col(c)))
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("selected"))
    return rows.withColumns({"since_ms": ms("warmup_start"), "before_ms": ms("research_end")}).orderBy(place)


def canonical(orders: DataFrame, executions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Raw orders and executions -> canonical events. ingest_pos interleaves the two files, so it is unique; events of no known type keep their name (event_key)
    and have no fields; keys (symbol, session) are carried."""
    e = F.col("event")
    known = [*TYPES[:2], *TYPES[3:]]
    kind = F.coalesce(*[F.when(e[t].isNotNull(), F.lit(t)) for t in known], F.col("event_key") if "event_key" in orders.columns else F.lit(None))
    body = F.coalesce(*[e[t]["order"] for t in ("OrderPlaced", "OrderCancelled", "OrderRejected")], e["OrderUpdated"]["newOrder"])
    null = F.lit(None)
    a = orders.select(
        *keys, (F.col("ingest_pos") * 2).alias("ingest_pos"), F.lit(0).alias("file"), F.col("timestamp").cast("long").alias("timestamp_ms"), kind.alias("event_type"), F.col("uid").alias("event_uid"), body["uid"].alias("order_uid"), side_of(body).alias("side"),
        number(body["limitPrice"]).alias("price"), number(body["quantity"]).alias("qty"), number(e["OrderUpdated"]["oldOrder"]["quantity"]).alias("old_qty"), number(e["OrderUpdated"]["oldOrder"]["limitPrice"]).alias("old_price"), number(body["filled"]).alias("filled_qty"),
        null.cast("string").alias("maker_uid"), null.cast("string").alias("taker_uid"), null.cast("double").alias("execution_price"), null.cast("double").alias("execution_qty"), null.cast("double").alias("usd_value"),
        F.coalesce(*[e[t]["reason"] for t in known]).alias("reason"), body["orderType"].alias("order_type"), body["direction"].alias("direction"), null.cast("string").alias("aggressor"),
    )
    x = e["Execution"]["execution"]
    taker = x["takerOrder"]["direction"]  # exactly Buy or Sell
    aggressor = F.when(taker == "Buy", "buy").when(taker == "Sell", "sell")
    b = executions.select(
        *keys, (F.col("ingest_pos") * 2 + 1).alias("ingest_pos"), F.lit(1).alias("file"), F.col("timestamp").cast("long").alias("timestamp_ms"), F.lit("Execution").alias("event_type"), F.coalesce("uid", x["uid"]).alias("event_uid"), null.cast("string").alias("order_uid"), null.cast("string").alias("side"),
        *[null.cast("double").alias(c) for c in ("price", "qty", "old_qty", "old_price", "filled_qty")], x["makerOrder"]["uid"].alias("maker_uid"), x["takerOrder"]["uid"].alias("taker_uid"), number(x["price"]).alias("execution_price"), number(x["quantity"]).alias("execution_qty"),
        number(x["usdValue"]).alias("usd_value"), null.cast("string").alias("reason"), null.cast("string").alias("order_type"), null.cast("string").alias("direction"), aggressor.alias("aggressor"),
    )
    return with_ambiguity(a.unionByName(b), keys)


def with_ambiguity(events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """n_events_same_ms and ordering_ambiguous: how many events share the timestamp."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "timestamp_ms"))
    return events.withColumn("n_events_same_ms", n).withColumn("ordering_ambiguous", F.col("n_events_same_ms") > 1)


def time_bounds(events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return events.groupBy(*keys).agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))


SESSION = ["symbol", "session_label"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_features(features: DataFrame, path: str, skip_existing: bool = True) -> None:
    """Parquet by symbol and session. Sessions that are there already stay with skip_existing, else they are replaced; others are never touched."""
    spark = features.sparkSession
    if skip_existing and _exists(spark, path):
        done = spark.read.parquet(path).select(*[F.col(c).cast("string").alias(f"__{c}") for c in SESSION]).distinct()
        on = [F.col(c).cast("string").eqNullSafe(F.col(f"__{c}")) for c in SESSION]
        features = features.join(F.broadcast(done), on, "left_anti")  # a row per session
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SESSION).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The feature table of all sessions, with {side}_pressure_pct: the average rank of a second's aggressive quantity within its session, in percent."""
    rows = spark.read.parquet(path)
    for side in ("buy", "sell"):
        if f"{side}_taker_qty_1s" in rows.columns:
            rows = rank_pct(rows, f"{side}_taker_qty_1s", SESSION, f"{side}_pressure_pct")
    return rows


def write_text(lines: list[str], path: str, spark: SparkSession) -> None:
    """A report's few lines as one text file, in their order."""
    spark.createDataFrame(list(enumerate(lines)), "n long, value string").coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def markdown(rows: DataFrame, limit: int = 1_000) -> list[str]:
    """A report table as lines of Markdown; one of more than `limit` rows is no report, and an error."""
    text = lambda x: "" if x is None else str(x).replace("|", "\\|")
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows to render")
    return ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *["| " + " | ".join(map(text, r)) + " |" for r in found]]


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def content_hash(rows: DataFrame) -> DataFrame:
    """Row count and an order-free hash of the rows, in which repeated rows count: the sums of the four words of each row's MD5, over its fields as text with their lengths."""
    text = [F.col(f"`{c}`").cast("string") for c in rows.columns]
    row = F.md5(F.concat_ws(",", *[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"))
    word = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    return rows.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *[F.coalesce(F.sum(word(i)), F.lit(0)).cast("string") for i in range(4)]).alias("content_hash"))
