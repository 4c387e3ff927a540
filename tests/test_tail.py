"""Growing files as a stream: torn lines, restarts, ranges, and what goes on while it is read."""

import io
import json
import threading
import time
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from verdictlake.operators import journal
from verdictlake.sources import readers, sinks
from verdictlake.streaming import tail, twins


def read(spark, folder, places, size=tail.RANGE, source=tail.tail_lines, **more):
    return [r.asDict() for r in twins.run_to_end(spark, source(spark, str(folder), range_bytes=size, **more), "append", str(places)).collect()]


def values(rows):
    return [r["value"] for r in sorted(rows, key=lambda r: (r["file"], r["start"]))]


@given(st.binary(max_size=60).map(lambda b: b.replace(b"\x01", b"\n")), st.integers(0, 60), st.integers(1, 9))
def test_last_whole_line(data, size, block):
    size = min(size, len(data))
    assert tail.whole_lines(io.BytesIO(data), size, block) == data[:size].rfind(b"\n") + 1


@given(st.lists(st.text("aé\r", max_size=5), max_size=8), st.integers(1, 7), st.integers(0, 60))
def test_ranges_give_each_line_once(tmp_path_factory, lines, size, cut):
    """Ranges of any size, over any growth, against splitting the whole."""
    file = tmp_path_factory.mktemp("r") / "a"
    data = "".join(x + "\n" for x in lines).encode()
    file.write_bytes(data)
    reader = tail.TailReader({"path": str(file.parent)})
    first = data[:cut].rfind(b"\n") + 1
    got = []
    for before, after in ((0, first), (first, len(data))):
        for s in tail.stretches({str(file): before}, {str(file): after}, size):
            for batch in reader.read(s):
                got += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
    at, want = 0, []
    for line in data.split(b"\n")[:-1]:
        want.append((at, line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    assert sorted(got) == want


def test_a_torn_line_waits(spark, tmp_path):
    """Cuts in a line and in a character; a query that starts again; a second file; what never gets a newline."""
    folder, places = tmp_path / "log", tmp_path / "places"
    assert read(spark, folder, places) == []
    (folder / "b").mkdir(parents=True)
    lines = [f'{{"n": {i}, "t": "{"ä" * (i % 5)}"}}' for i in range(30)]
    data = "\n".join(lines).encode() + b"\n"
    inside = data.index("ä".encode()) + 1
    got = []
    for cut in (inside, 300, 300, len(data)):
        (folder / "a.jsonl").write_bytes(data[:cut])
        now = read(spark, folder, places, 64)
        got += values(now)
        assert got == data[:cut].decode(errors="ignore").split("\n")[:-1]
    (folder / "b" / "c.jsonl").write_bytes(b"\r\n\xff\nlast")
    (folder / "b" / "d.jsonl").write_bytes(b"")
    (folder / "b" / "_e.jsonl").write_bytes(b"x\n")
    (folder / "b" / "f.txt").write_bytes(b"x\n")
    assert values(read(spark, folder, places)) == ["", "�"]
    (folder / "a.jsonl").unlink()
    assert read(spark, folder, places) == []


def test_a_file_that_shrinks_is_an_error(spark, tmp_path):
    folder, places = tmp_path / "log", tmp_path / "places"
    folder.mkdir()
    (folder / "a.jsonl").write_text("one\ntwo\n")
    assert len(read(spark, folder, places)) == 2
    (folder / "a.jsonl").write_text("one\n")
    with pytest.raises(Exception, match="was read up to byte 8 and now ends at 4"):
        read(spark, folder, places)


def test_writer_and_reader_together(spark, tmp_path):
    """A writer that flushes torn pieces while one query runs: every line once, in time."""
    folder = tmp_path / "log"
    folder.mkdir()
    data = "".join(json.dumps({"n": i, "pad": "x" * (i % 90)}) + "\n" for i in range(1500)).encode()
    taken = []

    def write():
        with Path(folder / "a.jsonl").open("ab", buffering=0) as f:
            for at in range(0, len(data), 997):
                f.write(data[at : at + 997])
                time.sleep(0.02)

    def take(batch, n):
        taken.append([r.value for r in batch.orderBy("file", "start").collect()])

    writer = threading.Thread(target=write)
    writer.start()
    query = tail.tail_lines(spark, str(folder)).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "places")).start()
    try:
        deadline = time.monotonic() + 60
        while sum(map(len, taken)) < 1500 and time.monotonic() < deadline and query.isActive:
            time.sleep(0.1)
    finally:
        query.stop()
        writer.join()
    assert [json.loads(v)["n"] for batch in taken for v in batch] == list(range(1500))
    assert len(taken) > 1


def vote(pair, **more):
    return json.dumps({"pair_id": pair, "verdict": "approve", "reason": "ok", "model_id": "m", "prompt_version": "v", "temperature": 0.0} | more)


def test_votes(spark, tmp_path):
    """Plain files and folders of backends, as `read_votes` reads them; a bad whole line ends the query."""
    folder = tmp_path / "votes"
    folder.mkdir()
    (folder / "m-1.jsonl").write_text(vote("p1") + "\n\n" + vote("p2", run_index=2, usage={"cached_tokens": 7}) + "\n")
    part = folder / "backend=a%2Fb+c" / "part-0.jsonl"
    part.parent.mkdir()
    part.write_text(vote("p3") + "\n")
    key = lambda r: (r["backend"], r["pair_id"], r["run_index"], r["cached_tokens"], r["verdict"])
    got = sorted(map(key, read(spark, folder, tmp_path / "places", source=tail.tail_votes)), key=str)
    assert got == sorted([("m-1", "p1", 0, None, "approve"), ("m-1", "p2", 2, 7, "approve"), ("a/b+c", "p3", 0, None, "approve")], key=str)
    with (folder / "m-1.jsonl").open("a") as f:
        f.write(vote("p4", more=1) + "\n")
    with pytest.raises(Exception, match="unknown more"):
        read(spark, folder, tmp_path / "places", source=tail.tail_votes)


def test_votes_written_by_spark(spark, tmp_path):
    folder = str(tmp_path / "votes")
    rows = spark.createDataFrame([(b, f"p{i}", "approve", "ok", "m", "v", 0.0, 0) for i in range(9) for b in ("x y", "ü")], "backend string, pair_id string, verdict string, reason string, model_id string, prompt_version string, temperature double, run_index long")
    sinks.append_votes(rows, folder)
    got = read(spark, folder, tmp_path / "places", source=tail.tail_votes, suffix=".json")
    want = [r.asDict() for r in readers.read_votes(spark, folder).collect()]
    assert sorted((r["backend"], r["pair_id"]) for r in got) == sorted((r["backend"], r["pair_id"]) for r in want)


def record(i, action, pair=None):
    return json.dumps({"session": "s", "pair_id": pair, "action": action} | ({"ground_truth": "approve", "reason": "ok", "notes": str(i)} if action == "rule" else {}))


def test_journal_into_keyed_state(spark, tmp_path):
    """A journal file that grows, torn, into `stream_replay`: the standing rulings of `replay` over the whole."""
    folder = tmp_path / "journal"
    folder.mkdir()
    lines = [record(i, "undo" if i % 4 == 3 else "rule", None if i % 4 == 3 else f"p{i % 5}") for i in range(22)]
    data = "".join(x + "\n" for x in lines).encode()
    changes = None
    for cut in (301, 900, len(data)):
        (folder / "s.jsonl").write_bytes(data[:cut])
        records = tail.tail_journal(spark, str(folder), ".jsonl")
        new = twins.run_to_end(spark, twins.stream_replay(records), "update", str(tmp_path / "places"))
        changes = new if changes is None else changes.union(new)
    got = [r.pair_id for r in twins.standing(changes).orderBy("place").collect()]
    whole = spark.createDataFrame([("s", i, x["action"], x["pair_id"], x.get("ground_truth"), x.get("reason")) for i, x in enumerate(map(json.loads, lines))], "session string, seq long, action string, pair_id string, ground_truth string, reason string")
    assert got == [r.pair_id for r in journal.replay(whole).orderBy("place").collect()] and len(got) > 2


def test_a_glued_journal_line_is_named(spark, tmp_path):
    folder = tmp_path / "journal"
    folder.mkdir()
    (folder / "s.jsonl").write_text(record(0, "rule", "p0") + "\n" + record(1, "rule", "p1")[:20] + record(2, "rule", "p2") + "\n")
    with pytest.raises(Exception, match="journal line at byte"):
        read(spark, folder, tmp_path / "places", source=tail.tail_journal, suffix=".jsonl")
