"""The paged source against a server of our own: pages, tries, refusals, the fuse, and a second download that reads nothing."""

import json
import os
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from flowloom.operators import lifecycle, levels
from flowloom.sources import rest, shared
from flowloom.streaming import flows


@pytest.fixture(scope="module")
def server():
    asked = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            asked.append(self.path)
            page = int(q.get(rest.CURSOR_PARAMETER, 0))
            if "gone" in u.path or ("busy" in u.path and sum("busy" in p for p in asked) < 3):
                self.send_response(404 if "gone" in u.path else 429)
                self.end_headers()
                return
            n = 3 if "endless" not in u.path else 10**6
            body = {"elements": [{"uid": f"e{page}-{i}", "timestamp": int(q["before"]) - 10 * page - i, "event": {}} for i in range(2)]} | ({"continuationToken": str(page + 1)} if page + 1 < n else {})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_pages_of_sessions(spark, server, tmp_path):
    base, asked = server
    streams = [rest.Stream("X", label, name, 0, before) for label, before in (("LOW", 1000), ("HIGH", 2000)) for name in ("orders", "executions")]
    got = rest.read_history(spark, base, streams).collect()
    assert len(got) == 24 and {(r["session_label"], r["stream"]) for r in got} == {(s.session_label, s.stream) for s in streams}
    times = [json.loads(r["value"])["timestamp"] for r in sorted(got, key=lambda r: r["ingest_pos"]) if (r["session_label"], r["stream"]) == ("LOW", "orders")]
    assert times == [1000, 999, 990, 989, 980, 979]
    path = str(tmp_path / "raw")
    assert rest.download(spark, base, streams[:2], path) == streams[:2]
    assert rest.download(spark, base, streams, path) == streams[2:] and rest.download(spark, base, streams, path) == []
    m = {(r["session_label"], r["stream"]): r for r in spark.read.json(f"{path}/manifests").collect()}
    assert len(m) == 4 and (m["LOW", "orders"]["first_ts"], m["LOW", "orders"]["last_ts"], m["LOW", "orders"]["n_rows"]) == (1000, 979, 6)
    assert (m["LOW", "orders"]["pages"], m["LOW", "orders"]["pagination_exhausted"]) == (3, True) and m["LOW", "orders"]["wall_clock_s"] >= 0
    assert rest.downloaded(spark, path, "orders").count() == 12


@pytest.fixture(scope="module")
def busy():
    """A history that is dense at its end: by cursor, newest first, before inclusive; the first request of some pages fails."""
    times = sorted([*range(0, 9_000, 90), *range(9_000, 10_000)], reverse=True)
    failed = set()

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            if "empty" not in u.path and int(q["before"]) % 7 == 0 and self.path not in failed:
                failed.add(self.path)
                self.send_response(503)
                self.end_headers()
                return
            at = int(q.get(rest.CURSOR_PARAMETER, 0))
            found = [] if "empty" in u.path else [t for t in times if int(q["since"]) < t <= int(q["before"]) or (t == 0 and q["since"] == "0")]
            body = {"elements": [{"uid": f"e{t}", "timestamp": t, "event": {}} for t in found[at : at + 40]]} | ({"continuationToken": str(at + 40)} if at + 40 < len(found) else {})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", times
    s.shutdown()


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ranges_of_a_stream_have_all_rows_once(spark, busy, n):
    base, times = busy
    of = rest.Stream("X", "LOW", "orders", 0, 10_000)
    cuts = rest.ranges_of(base, of, n, 0.01)
    assert len(cuts) == n
    sizes = [sum((c.since_ms or 0) <= t < (c.before_ms or 10_001) for t in times) for c in cuts]
    assert sum(sizes) == len(times) and (n == 1 or max(sizes) < 0.75 * len(times))
    rows = rest.read_history(spark, base, [of], ranges=n, wait=0.01).orderBy("ingest_pos").collect()
    assert [json.loads(r["value"])["timestamp"] for r in rows] == times


def test_an_interrupted_download_leaves_nothing(spark, busy, tmp_path):
    base, times = busy
    of, path = rest.Stream("empty", "LOW", "orders", 0, 10_000), str(tmp_path / "raw")
    left = rest.read_history(spark, base, [rest.Stream("X", "LOW", "orders", 0, 10_000)], wait=0.01).withColumn("symbol", F.lit("empty"))
    left.write.partitionBy(*rest.KEYS).parquet(f"{path}/rows")  # rows without a manifest
    rest.download(spark, base, [of, rest.Stream("X", "LOW", "orders", 0, 10_000)], path, ranges=3, wait=0.01)
    m = {r["symbol"]: (r["n_rows"], r["status"]) for r in spark.read.json(f"{path}/manifests").collect()}
    assert m == {"empty": (0, "COMPLETE"), "X": (len(times), "COMPLETE")} and rest.downloaded(spark, path, "orders").count() == len(times)


@pytest.fixture()
def growing():
    """A history that grows while it is read; a page of the stream `broken` is refused twice."""
    times, refused = list(range(0, 3_000, 10)), []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            at = int(q.get(rest.CURSOR_PARAMETER, 0))
            if "broken" in u.path and at == 80 and len(refused) < 2:
                refused.append(self.path)
                self.send_response(404)
                self.end_headers()
                return
            found = [t for t in sorted(times, reverse=True) if int(q["since"]) < t <= int(q["before"]) or (t == 0 and q["since"] == "0")]
            body = {"elements": [{"uid": f"e{t}", "timestamp": t, "event": {}} for t in found[at : at + 40]]} | ({"continuationToken": str(at + 40)} if at + 40 < len(found) else {})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", times, refused
    s.shutdown()


@pytest.mark.parametrize("ranges", [1, 3])
def test_a_growing_history_is_followed(spark, growing, tmp_path, ranges):
    """Runs that go on from a checkpoint have each settled row once; places follow time over micro-batches; rows that came late within `settle` are there."""
    base, times, _ = growing
    of, path = rest.Stream("X", "LOW", "orders", 0, 100_000), str(tmp_path / "rows")

    def run():
        rows = rest.follow_history(spark, base, [of], ranges=ranges, settle=100, wait=0.01)
        q = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [json.loads(r["value"])["timestamp"] for r in spark.read.parquet(path).orderBy("ingest_pos").collect()]

    assert run() == list(range(0, 2_890, 10))[::-1]
    times += [2_895, 2_985, *range(3_000, 4_000, 10)]
    assert run() == sorted([t for t in times if t < 3_890], reverse=True)
    assert run() == sorted([t for t in times if t < 3_890], reverse=True)


KILLED = """
import sys
from pyspark.sql import SparkSession
from flowloom.sources import rest
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rest.download(spark, sys.argv[1], [rest.Stream("X", "LOW", n, 0, 10_000) for n in ("broken", "orders")], sys.argv[2], wait=0.01)
"""


def test_a_task_that_fails_midway_doubles_and_loses_no_row(spark, growing, tmp_path):
    """A read that is refused after two pages fails its task, which Spark makes again, in a session that allows it."""
    base, times, refused = growing
    root, path = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), str(tmp_path / "raw")
    done = subprocess.run([sys.executable, "-c", KILLED, base, path], cwd=root, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2_000:]
    assert len(refused) == 2
    for stream in ("broken", "orders"):
        got = [json.loads(r["value"])["timestamp"] for r in rest.downloaded(spark, path, stream).orderBy("ingest_pos").collect()]
        assert got == times[::-1]
    m = {r["stream"]: (r["n_rows"], r["pages"], r["status"]) for r in spark.read.json(f"{path}/manifests").collect()}
    assert m == {n: (300, 8, "COMPLETE") for n in ("broken", "orders")}


def test_tries_and_refusals(server):
    base, asked = server
    page = rest.fetched(f"{base}/busy/orders?before=5", wait=0.01)
    assert len(page["elements"]) == 2 and sum("busy" in p for p in asked) == 3
    with pytest.raises(rest.Refused):
        rest.fetched(f"{base}/gone/orders?before=5")
    assert sum("gone" in p for p in asked) == 1
    with pytest.raises(RuntimeError, match="no answer after 2 tries"):
        rest.fetched("http://127.0.0.1:9/x", tries=2, wait=0.01)
    with pytest.raises(RuntimeError, match="not complete"):
        list(rest.rows_of(base, rest.Range(rest.Stream("endless", "L", "orders", 0, 9)), 5, 0.01))


EVENT = "symbol string, ingest_pos long, timestamp_ms long, event_type string, order_uid string, side string, price double, qty double, maker_uid string, taker_uid string, execution_price double, execution_qty double, order_type string, aggressor string"


def test_sliding_activity_and_refill_pairs_as_streams(spark, tmp_path):
    """The streams' rows are those of the batch forms."""
    rows = [("X", i, 10 * i, "OrderPlaced", f"u{i}", "buy", 10.0 + i % 2, 2.0, None, None, None, None, "Limit", None) for i in range(40)]
    rows += [("X", 100 + i, 25 * i + 5, "Execution", None, None, None, None, f"u{2 * i}", "t", 10.0, 1.0, None, "sell") for i in range(14)]
    batch = spark.createDataFrame(rows, EVENT)

    def streamed(df, name):
        df.repartition(2).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / name))

    def ran(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = {(round(r["window"]["start"].timestamp() * 1000), r["events"], r["executions"]) for r in ran(flows.sliding_activity(streamed(batch, "e"), 100, 50, 1000), "activity", "complete").collect()}
    want = {}
    for r in rows:
        for start in range((r[2] // 50) * 50 - 50, r[2] + 1, 50):
            if start <= r[2] < start + 100:
                a, b = want.get(start, (0, 0))
                want[start] = (a + 1, b + (r[3] == "Execution"))
    assert got == {(k, *v) for k, v in want.items()}
    atoms = lifecycle.level_atoms(batch)
    pairs = levels.refill_pairs(atoms, 60)
    x, a = (streamed(atoms.where(F.col("action") == k).select("symbol", "side", "price", "ts", "qty"), k) for k in ("exec_reduce", "add"))
    columns = ["side", "price", "exec_ts", "add_ts", "exec_qty", "refill_qty", "delay_ms"]
    found = sorted(tuple(r) for r in ran(flows.refill_pairs(x, a, 60, 10_000), "pairs", "append").select(*columns).collect())
    assert found and found == sorted(tuple(r) for r in pairs.select(*columns).collect())


def test_bucketed_tables_join_without_an_exchange(spark):
    """Tables written by the same keys meet bucket by bucket; rows, nulls among the values and other columns stay as they are."""
    a = spark.range(5_000).selectExpr("concat('s', id % 3) AS symbol", "id AS anchor", "if(id % 7 = 0, null, id) AS x")
    b = a.where("anchor % 2 = 0").selectExpr("symbol", "anchor", "anchor * 2 AS y")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = shared.bucketed(a, "symbol", "anchor").join(shared.bucketed(b, "symbol", "anchor"), ["symbol", "anchor"], "left")
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, met.collect()), key=str) == sorted(map(tuple, a.join(b, ["symbol", "anchor"], "left").collect()), key=str)
        assert shared.bucketed(a.limit(0), "symbol", "anchor").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
