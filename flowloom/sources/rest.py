"""Paged histories over HTTP as a Spark data source, and an idempotent download of sessions.

A stream of a session is read in one partition or, with the option `ranges`, in so many: a few pages asked for on the way tell how dense it is, and its time is cut
into ranges of about equally many rows. Each is read page by page, as each page names the next. A request is tried again where that can help (timeouts, 429, 5xx,
answers that are no JSON), with waits that double up to a minute; other client errors end the read at once, and so does a history of more pages than the fuse
allows: a read that ends early gives an error, never fewer rows. Rows are written by Spark's committer: a task that is killed and made again doubles and loses none.

The same source read as a stream follows the live end of a history: an offset holds, for each stream, the time before which all rows have been read.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .canonical import _exists
from .shared import _delete

#: Fixed values of the service: names of parameters and fields, rows of a page.
CURSOR_PARAMETER, CURSOR_FIELD, ROWS_FIELD, PAGE_ROWS = "continuation_token", "continuationToken", "elements", 1_000
MAX_PAGES, MAX_TRIES, LONGEST_WAIT = 50_000, 8, 60.0


class Refused(RuntimeError):
    """A client error that trying again does not mend."""


def fetched(url: str, tries: int = MAX_TRIES, wait: float = 1.0, timeout: float = 60.0) -> dict:
    """The JSON object behind url."""
    last: Exception | None = None
    for n in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429:
                raise Refused(f"status {e.code} of {url}") from e
            last = e
        except (OSError, ValueError) as e:
            last = e
        if n + 1 < tries:
            time.sleep(min(wait * 2**n, LONGEST_WAIT))
    raise RuntimeError(f"no answer after {tries} tries: {last}")


@dataclass
class Stream(InputPartition):
    """One stream of one session: orders or executions of a symbol from since up to before."""

    symbol: str
    session_label: str
    stream: str
    since_ms: int
    before_ms: int


@dataclass
class Range(InputPartition):
    """A part of a stream's time, the rank-th from the newest; bounds are None where they are the stream's own."""

    of: Stream
    rank: int = 0
    since_ms: int | None = None
    before_ms: int | None = None


def page_of(base: str, of: Stream, since: int, before: int, wait: float, cursor: str | None = None) -> dict:
    asked = {"since": since, "before": before, "count": PAGE_ROWS, "sort": "desc"} | ({CURSOR_PARAMETER: cursor} if cursor else {})
    return fetched(f"{base}/{of.symbol}/{of.stream}?{urllib.parse.urlencode(asked)}", wait=wait)


def rows_of(base: str, part: Range, max_pages: int, wait: float) -> Iterator[tuple[int, str]]:
    """A range's rows in the order of the service, the newest first, as (page, JSON text). A border belongs to the newer range, whatever the service takes it for."""
    of = part.of
    since, before = (own if cut is None else cut for cut, own in ((part.since_ms, of.since_ms), (part.before_ms, of.before_ms)))
    cursor: str | None = None
    for n in range(max_pages):
        page = page_of(base, of, since if part.since_ms is None else since - 1, before, wait, cursor)
        rows = page.get(ROWS_FIELD) or []
        for row in rows:
            ts = row.get("timestamp")
            if ts is None or ((part.since_ms is None or ts >= since) and (part.before_ms is None or ts < before)):
                yield n, json.dumps(row, separators=(",", ":"), ensure_ascii=False)
        cursor = page.get(CURSOR_FIELD)
        if not cursor or not rows:
            return
    raise RuntimeError(f"more than {max_pages} pages of {of.symbol} {of.stream}: the read is not complete")


def ranges_of(base: str, of: Stream, n: int, wait: float, probes: int = 4) -> list[Range]:
    """A stream's time in n ranges of about equally many rows, the newest first, from `probes` pages for each range."""
    if n <= 1:
        return [Range(of)]
    width = (of.before_ms - of.since_ms) / (n * probes)
    edges = [of.since_ms + i * width for i in range(n * probes + 1)]
    rates = []
    for t in edges[1:]:
        times = [r["timestamp"] for r in page_of(base, of, of.since_ms, int(t), wait).get(ROWS_FIELD) or [] if r.get("timestamp") is not None]
        rates.append(len(times) / max(1.0, t - min(times)) if times else 0.0)
    total, cuts, held = sum(rates) or 1.0, [], 0.0
    for t, rate in zip(edges, rates):
        while rate and len(cuts) < n - 1 and held + rate >= total * (len(cuts) + 1) / n:
            cuts.append(int(t + width * (total * (len(cuts) + 1) / n - held) / rate))
        held += rate
    cuts = sorted({c for c in cuts if of.since_ms < c < of.before_ms})
    bounds = list(zip([None, *cuts], [*cuts, None]))[::-1]
    return [Range(of, i, lo, hi) for i, (lo, hi) in enumerate(bounds)]


class History(DataSource):
    """spark.read.format("history").option("base", url).option("streams", JSON list of streams).load(): a row per event, with its place."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return "symbol string, session_label string, stream string, ingest_pos long, page long, value string"

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        n, wait = int(self.options.get("ranges", 1)), float(self.options.get("wait", 1.0))
        return [r for s in json.loads(self.options["streams"]) for r in ranges_of(self.options["base"], Stream(**s), n, wait)]

    def read(self, partition: Range) -> Iterator[tuple]:
        max_pages, wait = int(self.options.get("max_pages", MAX_PAGES)), float(self.options.get("wait", 1.0))
        of, first = partition.of, partition.rank << 40
        for i, (page, value) in enumerate(rows_of(self.options["base"], partition, max_pages, wait)):
            yield of.symbol, of.session_label, of.stream, first + i, first + page, value


class TailReader(DataSourceStreamReader):
    """What has come since the last micro-batch, up to `settle` ms before a stream's newest row, as rows of the newest times may still be missing.

    A micro-batch reads times [start, end) of a stream in `ranges` partitions, so that a long backlog is shared. A batch that is made again asks for the same times
    and gets the same rows. Places count down with time: the newest row has the least, as in one read of the whole history.
    """

    def __init__(self, options: dict) -> None:
        self.base, self.wait = options["base"], float(options.get("wait", 1.0))
        self.max_pages, self.n, self.settle = int(options.get("max_pages", MAX_PAGES)), int(options.get("ranges", 1)), int(options.get("settle", 1_000))
        self.streams = [Stream(**s) for s in json.loads(options["streams"])]

    @staticmethod
    def key(of: Stream) -> str:
        return json.dumps([of.symbol, of.session_label, of.stream])

    def initialOffset(self) -> dict:
        return {self.key(s): s.since_ms for s in self.streams}

    def latestOffset(self) -> dict:
        return {self.key(s): self.settled(s) for s in self.streams}

    def settled(self, of: Stream) -> int:
        rows = page_of(self.base, of, of.since_ms, of.before_ms, self.wait).get(ROWS_FIELD) or []
        newest = max((r["timestamp"] for r in rows if r.get("timestamp") is not None), default=of.since_ms)
        return max(of.since_ms, newest - self.settle)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for s in self.streams:
            lo, hi = start.get(self.key(s), s.since_ms), end[self.key(s)]
            if lo < hi:
                cuts = ranges_of(self.base, replace(s, since_ms=lo, before_ms=hi), self.n, self.wait)
                out += [replace(r, since_ms=lo if r.since_ms is None else r.since_ms, before_ms=hi if r.before_ms is None else r.before_ms) for r in cuts]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        of, first = partition.of, -(partition.before_ms << 20)  # up to 2^20 rows for each ms of the range
        for i, (page, value) in enumerate(rows_of(self.base, partition, self.max_pages, self.wait)):
            yield of.symbol, of.session_label, of.stream, first + i, first + page, value


KEYS = ["symbol", "session_label", "stream"]


def read_history(spark: SparkSession, base: str, streams: list[Stream], **options: object) -> DataFrame:
    spark.dataSource.register(History)
    return spark.read.format("history").options(base=base, streams=json.dumps([asdict(s) for s in streams]), **options).load()


def follow_history(spark: SparkSession, base: str, streams: list[Stream], **options: object) -> DataFrame:
    """read_history() as a stream: each micro-batch has the rows that came since the one before."""
    spark.dataSource.register(History)
    return spark.readStream.format("history").options(base=base, streams=json.dumps([asdict(s) for s in streams]), **options).load()


def download(spark: SparkSession, base: str, streams: list[Stream], path: str, **options: object) -> list[Stream]:
    """Streams that have no manifest under path are read, written by symbol, session and stream, and get one; the others stay. Returns those read.

    A manifest is written after all rows: a download that was cut off is made again, and what it left is deleted first. pages counts those that have rows;
    pagination_exhausted is true of every manifest, as a read that ends early has none; wall_clock_s is the whole download's.
    """
    start = time.time()
    rows_at, manifests = f"{path}/rows", f"{path}/manifests"
    done = {tuple(r[k] for k in KEYS) for r in spark.read.json(manifests).where("status = 'COMPLETE'").select(*KEYS).collect()} if _exists(spark, manifests) else set()  # a row per session and stream
    missing = [s for s in streams if (s.symbol, s.session_label, s.stream) not in done]
    if missing:
        for s in missing:
            _delete(spark, f"{rows_at}/symbol={s.symbol}/session_label={s.session_label}/stream={s.stream}")
        rows = read_history(spark, base, missing, **options)
        rows.write.mode("append").partitionBy(*KEYS).parquet(rows_at)
        asked = spark.createDataFrame([tuple(asdict(s).values()) for s in missing], "symbol string, session_label string, stream string, requested_since_ms long, requested_before_ms long")
        t = F.get_json_object("value", "$.timestamp").cast("long")
        facts = spark.read.parquet(rows_at).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("page").alias("pages"), F.min_by(t, "ingest_pos").alias("first_ts"), F.max_by(t, "ingest_pos").alias("last_ts"))
        facts = asked.join(facts, KEYS, "left").fillna(0, ["n_rows", "pages"])
        facts = facts.withColumns({"pagination_exhausted": F.lit(True), "wall_clock_s": F.lit(round(time.time() - start, 1)), "status": F.lit("COMPLETE")})
        facts.coalesce(1).write.mode("append").json(manifests)
    return missing


def downloaded(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """The lines of one stream of all sessions, for canonical.parsed()."""
    return spark.read.parquet(f"{path}/rows").where(F.col("stream") == stream).select("symbol", "session_label", "ingest_pos", "value")
