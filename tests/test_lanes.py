"""One host's calls from several tasks: one rate, one bar, no call twice."""

import json
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from verdictlake.operators.guards import GuardError
from verdictlake.sources import judge, producer, readers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test

RPM = 600


def slate(spark, rpm=RPM, names=("a",)):
    return spark.createDataFrame([readers._backend({"name": n, "base_url": "https://one.example/v1", "rpm": rpm, "eval_only": False, "model_id": "m"}) for n in names], readers.SLATE)


def todo(spark, n):
    return spark.createDataFrame([(f"p{i}", 0, f"o{i};", "A", None, None, i) for i in range(n)], "pair_id string, run_index int, original string, enriched string, brand string, mpn string, pos long")


class Noting:
    """A transport that notes when each call left, and from which task; `busy` calls are throttled, `broke` ones cannot be billed, `dies` kills its worker once."""

    def __init__(self, folder, busy=None, dies=None, broke=False):
        self.folder, self.busy, self.dies, self.broke = str(folder), busy, dies, broke

    def __call__(self, settings, body):
        import os
        import time
        import uuid

        from pyspark import TaskContext

        left = time.time()
        call = body[body.index("ORIGINAL: o") + 11 : body.index(";")]
        task = TaskContext.get()
        Path(self.folder, uuid.uuid4().hex).write_text(json.dumps([left, call, task.partitionId() if task else -1]))
        dead = Path(self.folder, "dead")
        if call == self.dies and not dead.exists():
            dead.write_text("")
            os._exit(1)
        if self.broke:
            return 429, json.dumps({"error": {"type": "insufficient_quota"}})
        if call == self.busy:
            return 429, "{}", {"retry-after": "2.5"}
        return 200, json.dumps({"choices": [{"message": {"content": "hello"}}]})

    def calls(self):
        return sorted(json.loads(p.read_text()) for p in Path(self.folder).iterdir() if p.name != "dead")


@pytest.fixture
def asked(tmp_path):
    (tmp_path / "asked").mkdir()
    return tmp_path / "asked"


class Clock:
    def __init__(self):
        self.now = 1_000.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


@settings(deadline=None, max_examples=30)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(0, 5), st.one_of(st.none(), st.floats(0, 9))), max_size=25), st.integers(1, 4))
def test_slots_of_lanes(tmp_path_factory, steps, lanes):
    """Lanes with nothing in common but the clock and a folder never share a slot, and take none that is barred, once they have looked."""
    folder, clock = str(tmp_path_factory.mktemp("bars")), Clock()
    each = [judge.Slots(30, k, lanes, judge.Bars(folder, 0.5, clock), "host h", clock.sleep) for k in range(lanes)]
    bars, taken = [], []
    for lane, pause, penalty in steps:
        clock.sleep(pause)
        limiter = each[lane % lanes]
        asked_at = clock()
        barred = max([until for put, by, until in bars if by == lane % lanes or put <= asked_at - 0.5], default=0.0)
        slot = limiter.wait()
        assert slot % lanes == lane % lanes and slot * 2.0 > max(barred, asked_at) - 1e-9 and clock() >= slot * 2.0 - 1e-9
        assert clock() <= max([until for *_, until in bars] + [asked_at]) + 2.0 * lanes + 1e-6
        taken.append(slot)
        if penalty is not None:
            limiter.penalize(penalty)
            bars.append((clock(), lane % lanes, clock() + penalty))
    assert len(set(taken)) == len(taken)


def test_bars_that_are_long_over_go(tmp_path):
    clock = Clock()
    bars = judge.Bars(str(tmp_path / "bars"), 1.0, clock)
    assert bars.look("host h") and bars.until("host h") == 0.0
    bars.put("host h", clock() + 1)
    bars.put("host h", clock() + 0.5)  # says nothing new
    assert len(list((tmp_path / "bars").rglob("*-*"))) == 1
    clock.sleep(3600)
    other = judge.Bars(str(tmp_path / "bars"), 1.0, clock)
    other.put("host h", clock() + 2)
    assert len(list((tmp_path / "bars").rglob("*-*"))) == 1
    assert bars.look("host h") and bars.until("host h") == clock() + 2 and not bars.look("host h")


def test_four_tasks_keep_one_rate(spark, tmp_path, asked):
    """Departures of four tasks of one host are in different slots, and together as many as the rate allows."""
    transport = Noting(asked)
    producer.enqueue(todo(spark, 40), slate(spark), str(tmp_path / "run"))
    assert producer.run(slate(spark), transport, str(tmp_path / "run"), lanes=4) == {}
    calls = transport.calls()
    assert len(calls) == 40 and {c[2] for c in calls} == {0, 1, 2, 3}
    gap = 60 / RPM
    slots = [int(left / gap) for left, _, _ in calls]
    assert len(set(slots)) == 40
    assert calls[-1][0] - calls[0][0] < 2 * 40 * gap  # the fullest lane has less than twice its share
    assert producer.read_log(spark, str(tmp_path / "run")).where("ok = 1").count() == 40


def test_a_penalty_bars_all_lanes(spark, tmp_path, asked):
    transport = Noting(asked, busy="3")
    keeping = judge.Keeping(str(tmp_path / "answers"), None, str(tmp_path / "bars"), look_s=0.2)
    log = judge.judge(todo(spark, 30), slate(spark), transport, keeping=keeping, lanes=3).collect()
    assert sorted((r.ok, r.status) for r in log) == [(0, 429)] + [(1, 200)] * 29
    calls = transport.calls()
    at = next(left for left, call, _ in calls if call == "3")
    assert not [c for c in calls if at + 1.0 < c[0] < at + 2.5]  # what is under way when the bar is put down still leaves
    later = {c[2] for c in calls if c[0] >= at + 2.5}
    assert len(later) >= 2


def test_a_bill_refused_in_one_lane_holds_in_all(spark, tmp_path, asked):
    transport = Noting(asked, broke=True)
    keeping = judge.Keeping(str(tmp_path / "answers"), None, str(tmp_path / "bars"), look_s=0.1)
    log = judge.judge(todo(spark, 60), slate(spark), transport, keeping=keeping, lanes=3).collect()
    assert {r.error_kind for r in log} == {"QuotaExhausted"} and len(log) == 60
    assert len(transport.calls()) <= 12
    again = judge.judge(todo(spark, 10), slate(spark), transport, keeping=keeping, lanes=2).collect()  # within HOLD_S
    assert len(again) == 10 and len(transport.calls()) <= 12


def test_a_lost_lane_repeats_no_answer(spark, tmp_path, asked):
    folder, transport = str(tmp_path / "run"), Noting(asked, dies="7")
    s = slate(spark, 60_000, ("a", "b"))
    producer.enqueue(todo(spark, 20), s, folder)
    assert set(producer.run(s, transport, folder, lanes=3)) == {"one.example"}
    assert producer.run(s, transport, folder, lanes=3) == {}
    assert producer.read_log(spark, folder).where("ok = 1").count() == 40
    counts = [c[1] for c in transport.calls()]
    assert len(counts) <= 43  # what was under way in three lanes is asked again at most


def test_lanes_need_a_shared_folder(spark):
    with pytest.raises(GuardError, match="share"):
        judge.judge(todo(spark, 1), slate(spark), Noting("x"), lanes=2)
    keeping = judge.Keeping("/tmp/none")
    with pytest.raises(GuardError, match="share"):
        judge.judge(todo(spark, 1), slate(spark), Noting("x"), keeping=keeping, lanes=2)
