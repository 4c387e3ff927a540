"""Answers that a judge's tasks keep, and how a host's calls are dealt to them."""

from pathlib import Path

from pyspark.sql import functions as F

from verdictlake.plans import file_queries
from verdictlake.sources import judge

ROW = ("a", "p", 0, 1, 200, 0.5, None, "yes")


def row(i: int) -> tuple:
    return ("a", f"p{i}", *ROW[2:])


def test_answers_of_a_try_share_a_file(tmp_path):
    keeping = judge.Keeping(str(tmp_path / "answers"))
    first = judge._Kept(keeping)
    for i in range(100):
        first.add(row(i))  # readable at once, though the file is open
        assert len(judge._Kept(keeping).rows) == i + 1
    assert len(list(Path(keeping.answers).iterdir())) == 1
    file = next(Path(keeping.answers).iterdir())
    file.write_bytes(file.read_bytes()[:-5])  # died in its last line
    again = judge._Kept(keeping)
    assert set(again.rows.values()) == {row(i) for i in range(99)}
    again.add(row(99))
    assert set(judge._Kept(keeping).rows.values()) == {row(i) for i in range(100)}


def test_a_lane_reads_its_own_answers(tmp_path):
    keeping = judge.Keeping(str(tmp_path / "answers"))
    for lane in range(3):
        judge._Kept(keeping, "h/1", lane, 3).add(row(lane))
    assert [set(judge._Kept(keeping, "h/1", lane, 3).rows.values()) for lane in range(3)] == [{row(0)}, {row(1)}, {row(2)}]
    assert len(judge._Kept(keeping, "h/1", 0, 2).rows) == 3 and not judge._Kept(keeping, "h/2", 0, 3).rows


def test_a_host_is_called_by_several_tasks(spark, sf):
    for query in (file_queries.judge_calls, file_queries.judge_in_lanes):
        rows = query(spark, sf).select("backend", F.spark_partition_id().alias("task"))
        tasks = rows.groupBy("backend").agg(F.count_distinct("task").alias("tasks")).collect()
        assert {r.backend: r.tasks for r in tasks} == {b: file_queries.LANES for b in "abc"}
