"""Commits of stores under two writers and writers that die; calls in flight."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lectern.operators import hooks
from lectern.operators.gates import GateError
from lectern.streaming.commits import CommitLog
from lectern.streaming.incremental import bind, load_vectors, save_vectors, score_pending

SCHEMA = "key long, value double, seq int"


def rows(spark, keys, seq=0):
    return spark.createDataFrame([(k, float(k), seq) for k in keys], SCHEMA)


def keys(df):
    return sorted(r.key for r in df.collect())


def test_commits_in_order(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/s", SCHEMA)
    assert log.commits() == [] and log.read().count() == 0 and log.lost() == []
    assert [log.append(rows(spark, [i]), {"n": i}).version for i in range(3)] == [0, 1, 2]
    assert keys(log.read()) == [0, 1, 2] and keys(log.read(1)) == [0, 1] and [c.note["n"] for c in log.commits()] == [0, 1, 2]


def test_two_writers(spark, tmp_path):
    """Many writers at once: every commit is there once, none is lost, and numbers have no gap."""
    log = CommitLog(spark, f"file://{tmp_path}/s", SCHEMA)
    seen, errors = [], []

    def write(k):
        try:
            for i in range(4):
                seen.append(log.append(rows(spark, [10 * k + i])).version)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(seen) == list(range(16))
    assert keys(log.read()) == sorted(10 * k + i for k in range(4) for i in range(4)) and log.lost() == []


def test_the_loser_looks_at_what_came_between(spark, tmp_path, monkeypatch):
    log, other = (CommitLog(spark, f"file://{tmp_path}/s", SCHEMA) for _ in range(2))
    create = log._create

    def late(name, text):
        if not other.commits():
            other.append(rows(spark, [1]), {"by": "other"})
        return create(name, text)

    monkeypatch.setattr(log, "_create", late)
    between = []
    assert log.append(rows(spark, [2]), check=between.extend).version == 1
    assert [c.note for c in between] == [{"by": "other"}] and keys(log.read()) == [1, 2]

    def refuse(commits):
        raise GateError("not after these")

    monkeypatch.setattr(log, "_create", lambda name, text: False)
    with pytest.raises(GateError):
        log.append(rows(spark, [3]), check=refuse)
    assert keys(other.read()) == [1, 2] and len(other.lost()) == 1


def test_a_killed_writer_leaves_no_rows(spark, tmp_path):
    """A job that fails half-way, and a writer that dies before its manifest: readers see neither."""
    log = CommitLog(spark, f"file://{tmp_path}/s", SCHEMA)
    log.append(rows(spark, [1]))
    bad = rows(spark, range(50)).repartition(8).withColumn("value", F.when(F.col("key") == 37, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="killed"):
        log.append(bad)
    rows(spark, [9]).write.parquet(f"file://{tmp_path}/s/data/died")
    assert keys(log.read()) == [1] and "died" in log.lost() and len(log.commits()) == 1
    assert keys(CommitLog(spark, f"file://{tmp_path}/s", SCHEMA).read()) == [1]
    (tmp_path / "s" / "log" / "000000000002.json").write_text("{}")
    with pytest.raises(GateError):
        log.commits()


def test_pending_rows_of_two_runs(spark, tmp_path):
    store = f"file://{tmp_path}/s"
    score = lambda df: df.select("key", F.when(F.col("key") != 3, F.col("key") * 2.0).alias("value"), F.lit(0).alias("seq"))
    ask = spark.range(5).withColumnRenamed("id", "key")
    got = score_pending(ask, store, "key", score, SCHEMA)
    assert {r.key: r.value for r in got.collect()} == {k: 2.0 * k for k in (0, 1, 2, 4)}
    asked = []
    again = score_pending(ask, store, "key", lambda df: (asked.extend(keys(df)), score(df))[1], SCHEMA)
    assert asked == [3] and again.count() == 4
    with pytest.raises(GateError):
        bind(spark, store, {"model": "late"})


def test_vectors_of_two_writes(spark, tmp_path):
    store, made = f"file://{tmp_path}/v", {"model": "m"}
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<double>")
    save_vectors(df.where("chunk_id = 'a'"), store, made)
    save_vectors(df.where("chunk_id = 'b'"), store, made)
    assert sorted(r.chunk_id for r in load_vectors(spark, store, made).collect()) == ["a", "b"]
    with pytest.raises(GateError):
        load_vectors(spark, store, {"model": "other"})
    with pytest.raises(GateError):
        load_vectors(spark, store, made, spark.createDataFrame([("c",)], "chunk_id string"))


class _Server(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self):
        self.now = self.most = self.calls = 0
        self.lock = threading.Lock()
        super().__init__(("127.0.0.1", 0), _Handler)


class _Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        s = self.server
        with s.lock:
            s.now, s.calls = s.now + 1, s.calls + 1
            s.most = max(s.most, s.now)
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
        time.sleep(0.05)
        with s.lock:
            s.now -= 1
        good = prompt != "p13"
        self.send_response(200 if good else 500)
        self.end_headers()
        if good:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": prompt.upper()}}]}).encode())

    def log_message(self, *args):
        pass


def test_calls_in_flight(spark, tmp_path):
    """The server sees as many requests at once as are asked for, never more; replies are in their rows; what failed is asked again later, and only that."""
    server = _Server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = hooks.chat_client(f"http://127.0.0.1:{server.server_port}", "m", at_once=6)
    ask = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "key long, prompt string").coalesce(1)
    got = {r.key: r.value for r in hooks.completed_pending(ask, f"file://{tmp_path}/c", "key", client, parallel=2, retries=0).collect()}
    assert got == {i: f"P{i}" for i in range(40) if i != 13}
    assert 6 < server.most <= 12 and server.calls == 40
    hooks.completed_pending(ask, f"file://{tmp_path}/c", "key", client, parallel=1, retries=0)
    assert server.calls == 41
    server.shutdown()
    order = hooks.in_flight(lambda p: (time.sleep(0.02 if p == "a" else 0), p * 2)[1], 4)
    assert order(["a", "b", "c"]) == ["aa", "bb", "cc"] and hooks.in_flight(lambda p: 1 // 0, 2)(["x", "y"]) == [None, None]
