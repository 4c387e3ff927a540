"""The durable producer: lost tasks, cancelled hosts, held backends, and what a transport is told."""

import json
import sys
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verdictlake.sources import judge, producer, readers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test


def slate(spark, **more):
    fast = {"rpm": 60_000_000, "eval_only": False, "model_id": "m"}
    backends = [{"name": "a", "base_url": "https://one.example/v1"}, {"name": "b", "base_url": "https://two.example/v1"}, {"name": "c/d", "base_url": "https://two.example/v1"}]
    return spark.createDataFrame([readers._backend(x | fast | more) for x in backends], readers.SLATE)


def todo(spark, n):
    return spark.createDataFrame([(f"p{i}", 0, f"o{i};", "A", None, None, i) for i in range(n)], "pair_id string, run_index int, original string, enriched string, brand string, mpn string, pos long")


class Marking:
    """A transport that leaves a file for each call; `dies` names a call that kills its worker once."""

    def __init__(self, folder, dies=None, wait=0.0):
        self.folder, self.dies, self.wait = str(folder), dies, wait

    def __call__(self, settings, body):
        import os
        import tempfile
        import time

        call = f"{settings['backend'].replace('/', '_')}-{body[body.index('ORIGINAL: o') + 11 : body.index(';')]}"
        tempfile.mkstemp(prefix=f"{call}-", dir=self.folder)
        dead = os.path.join(self.folder, "dead")
        if call == self.dies and not os.path.exists(dead):
            Path(dead).touch()
            os._exit(1)
        time.sleep(self.wait)
        return 200, json.dumps({"choices": [{"message": {"content": '{"verdict": "approve", "reason": "ok"}'}}]})

    def calls(self):
        return Counter(p.name.rsplit("-", 1)[0] for p in Path(self.folder).iterdir() if p.name != "dead")


@pytest.fixture
def asked(tmp_path):
    (tmp_path / "asked").mkdir()
    return tmp_path / "asked"


def test_a_lost_task_repeats_no_answer(spark, tmp_path, asked):
    """A worker dies in the middle of a host: the other host ends, and the next run asks only for what has no answer."""
    s, folder, transport = slate(spark), str(tmp_path / "run"), Marking(asked, dies="b-7")
    producer.enqueue(todo(spark, 12), s, folder, batch=8)
    failed = producer.run(s, transport, folder)
    assert set(failed) == {"two.example"}
    log = producer.read_log(spark, folder)
    assert log.where("backend = 'a'").count() == 12
    before = sum(transport.calls().values())
    assert before < 36
    assert producer.run(s, transport, folder) == {}
    assert {(r.backend, r.ok): r["count"] for r in producer.read_log(spark, folder).groupBy("backend", "ok").count().collect()} == {("a", 1): 12, ("b", 1): 12, ("c/d", 1): 12}
    calls = transport.calls()
    assert calls.pop("b-7") == 2
    assert set(calls.values()) == {1} and len(calls) == 35
    producer.enqueue(todo(spark, 12), s, folder)
    assert producer.run(s, transport, folder) == {} and sum(transport.calls().values()) == 37


def test_a_new_launch_takes_over_kept_answers(spark, tmp_path, asked):
    """What a batch that never ended has answered is in the log of the next launch."""
    s, folder, transport = slate(spark).where("name = 'b'"), str(tmp_path / "run"), Marking(asked, dies="b-5")
    producer.enqueue(todo(spark, 9), s, folder)
    assert producer.run(s, transport, folder)
    producer.enqueue(todo(spark, 9), s, folder)
    assert producer.read_log(spark, folder).count() == 5
    assert producer.run(s, transport, folder) == {}
    assert producer.read_log(spark, folder).where("ok = 1").count() == 9
    assert transport.calls() == Counter({f"b-{i}": 1 + (i == 5) for i in range(9)})


def test_one_host_is_cancelled_alone(spark, tmp_path, asked):
    s, folder, transport = slate(spark), str(tmp_path / "run"), Marking(asked, wait=0.2)
    producer.enqueue(todo(spark, 15).withColumn("backend", F.when(F.col("pos") < 5, "a").otherwise("b")), s, folder, batch=100)
    queries = producer.start(s, transport, folder)
    while not any(c.startswith("b-") for c in transport.calls()):
        time.sleep(0.1)
    queries["two.example"].stop()
    queries["one.example"].awaitTermination()
    done = producer.read_log(spark, folder)
    assert done.where("backend = 'a'").count() == 5 and done.where("backend = 'b'").count() == 0
    assert producer.run(s, transport, folder) == {}
    assert producer.read_log(spark, folder).where("ok = 1").count() == 15
    assert sum(n - 1 for n in transport.calls().values()) <= 1


def test_a_held_backend(spark, tmp_path, asked):
    s, folder, transport = slate(spark), str(tmp_path / "run"), Marking(asked)
    producer.hold(spark, folder, "c/d")
    producer.enqueue(todo(spark, 4), s, folder)
    assert producer.run(s, transport, folder, concurrency=3) == {}
    rows = producer.read_log(spark, folder)
    assert {(r.backend, r.error_kind): r["count"] for r in rows.groupBy("backend", "error_kind").count().collect()} == {("a", None): 4, ("b", None): 4, ("c/d", "Held"): 4}
    producer.release(spark, folder, "c/d")
    producer.enqueue(todo(spark, 4), s, folder)
    assert producer.run(s, transport, folder) == {}
    assert producer.read_log(spark, folder).where("ok = 1").count() == 12 and set(transport.calls().values()) == {1}


def test_nothing_to_do(spark, tmp_path, asked):
    s, folder = slate(spark), str(tmp_path / "run")
    assert producer.run(s, Marking(asked), folder) == {} and producer.read_log(spark, folder).count() == 0
    producer.enqueue(todo(spark, 3).where("pos > 5"), s, folder)
    assert producer.run(s, Marking(asked), folder) == {} and producer.read_log(spark, folder).count() == 0


def test_later_batches_wait_their_turn():
    now, slept = [5.0], []
    limit = judge.Limiter(60, lambda: now[0], lambda t: (slept.append(t), now.__setitem__(0, now[0] + t)), rested=False)
    limit.wait()
    assert slept == [1.0]


class Server(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["content-length"])).decode()
        self.seen.append((self.path, {k.lower(): v for k, v in self.headers.items()}, json.loads(body)))
        if "slow" in body:
            time.sleep(1.5)
        status = 429 if "busy" in body else 200
        said = json.dumps({"choices": [{"message": {"content": "hello"}}]}).encode()
        self.send_response(status)
        self.send_header("Retry-After", "0")
        self.send_header("content-length", str(len(said)))
        self.end_headers()
        self.wfile.write(said)

    def log_message(self, *args):
        pass


def test_timeout_and_headers_reach_the_server(spark, monkeypatch):
    """The connector over real HTTP: path, body, key and version headers, timeout, status and retry-after."""
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    monkeypatch.setenv("A_API_KEY", "secret-a")
    try:
        settings = {"base_url": url, "path": "/chat/completions", "headers": judge.headers("openai", "k"), "timeout_s": 5.0}
        status, payload, told = judge.http(settings, '{"x": 1}')
        assert (status, judge.content_of("openai", payload), told["retry-after"]) == (200, "hello", "0")
        assert judge.http(settings, '{"x": "busy"}')[0] == 429
        with pytest.raises(TimeoutError):
            judge.http(settings | {"timeout_s": 0.3}, '{"x": "slow"}')
        path, headers, body = Server.seen[0]
        assert (path, headers["authorization"], headers["content-type"], body) == ("/v1/chat/completions", "Bearer k", "application/json", {"x": 1})
        host = judge._Host(60_000_000, judge.http)
        row = {"backend": "a", "pair_id": "p", "run_index": 0, "api": "anthropic", "model_id": "m", "base_url": url, "said": json.dumps([{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]), "temperature": None, "reasoning_effort": None, "structured_output": False, "timeout_s": 5.0, "api_key_env": "A_API_KEY"}
        host.call(row)
        path, headers, body = Server.seen[-1]
        assert (path, headers["x-api-key"], headers["anthropic-version"], body["system"]) == ("/v1/messages", "secret-a", judge.ANTHROPIC_VERSION, "s")
        slow = row | {"timeout_s": 0.3, "said": json.dumps([{"role": "system", "content": "slow"}, {"role": "user", "content": "u"}])}
        assert host.call(slow)[6] == "TimeoutError"
    finally:
        server.shutdown()


def test_settings_reach_the_transport(spark):
    def told(settings, body):
        return 200, json.dumps({"choices": [{"message": {"content": json.dumps({k: settings[k] for k in ("timeout_s", "headers", "path")})}}]})

    got = {json.loads(r.reply)["timeout_s"] for r in judge.judge(todo(spark, 2), slate(spark, timeout_s=7), told).collect()}
    assert got == {7.0}
