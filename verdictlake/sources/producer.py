"""A durable producer of verdicts: a queue for each host, answers kept as they come, a log that repeats nothing.

`enqueue` writes the votes that have no answer yet as a queue of small files, host by
host. `start` works each host's queue off with a streaming query of its own: a batch is
one file, its place in the queue is checkpointed, and the batch's log replaces what an
earlier try of the same batch left. So hosts run side by side, fail alone and are
cancelled alone (`StreamingQuery.stop` cancels the job group of its batch), and a driver
that starts again goes on with the batch that it was in.

Within a batch each answer is written as soon as it comes, a line of its lane's file, and a task that is tried
again, in the same run or in the next, asks only for what has no answer yet. At most the
calls under way are paid twice. A host's batch may be worked off in several lanes, tasks
that keep the host's one rate together (`judge.Slots`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import StreamingQueryException

from ..operators.reliability import host_of
from . import judge
from .readers import _fs, exists

KEYS = ["backend", "pair_id", "run_index"]
TODO = "backend string, pair_id string, run_index int, original string, enriched string, brand string, mpn string, pos long"
#: Calls of a batch, which is one file of the queue.
BATCH = 200


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _delete(spark: SparkSession, folder: str) -> None:
    fs, p = _fs(spark, folder)
    fs.delete(p, True)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per call of all launches; of an answer that was logged twice one row counts."""
    rows = spark.createDataFrame([], judge.LOG)
    if _names(spark, f"{folder}/log"):
        rows = spark.read.schema(judge.LOG).option("recursiveFileLookup", True).json(f"{folder}/log")
    return rows.where("ok = 1").dropDuplicates(KEYS).union(rows.where("ok = 0"))


def gather(spark: SparkSession, folder: str) -> None:
    """Move answers of batches that never ended into the log."""
    left = f"{folder}/answers"
    if _names(spark, left):
        rows = spark.read.schema(judge.LOG).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "DROPMALFORMED").json(left)
        rows.where("ok = 1").write.json(f"{folder}/log/gathered-{uuid.uuid4().hex}")
        _delete(spark, left)


def enqueue(todo: DataFrame, slate: DataFrame, folder: str, batch: int = BATCH) -> None:
    """A new launch: all of `todo` that has no answer yet. What is left of earlier launches is dropped; not while one runs.

    todo: pair_id, run_index, original, enriched, brand, mpn, pos, and backend where not all are asked.
    """
    spark = todo.sparkSession
    gather(spark, folder)
    hosts = F.broadcast(slate.select(F.col("name").alias("backend"), host_of(F.col("base_url")).alias("host")))  # a handful of rows
    each = todo.join(hosts, "backend") if "backend" in todo.columns else todo.join(hosts)
    if exists(spark, f"{folder}/log"):
        each = each.join(read_log(spark, folder).where("ok = 1").select(*KEYS), KEYS, "left_anti")
    number = len(_names(spark, f"{folder}/launches"))
    # a host's queue is written in order by one task; a batch is as many rows as a file may hold
    rows = each.select("host", *[c.split()[0] for c in TODO.split(", ")]).repartition("host").sortWithinPartitions("host", "pos", "run_index", "backend")
    rows.write.partitionBy("host").option("maxRecordsPerFile", batch).parquet(f"{folder}/launches/{number:06d}")


def hold(spark: SparkSession, folder: str, backend: str) -> None:
    """No call to this backend begins from now on, in whatever task; others of its host go on."""
    fs, p = _fs(spark, f"{folder}/held/{quote(backend, safe='')}")
    fs.create(p, True).close()


def release(spark: SparkSession, folder: str, backend: str) -> None:
    _delete(spark, f"{folder}/held/{quote(backend, safe='')}")


def start(slate: DataFrame, transport: judge.Transport, folder: str, concurrency: int = 1, stop: Callable[[], bool] | None = None, lanes: int = 1) -> dict[str, StreamingQuery]:
    """Queries, by host, that work the latest launch off and end; those of an earlier start must have ended."""
    spark = slate.sparkSession
    launch = (_names(spark, f"{folder}/launches") or [None])[-1]
    if launch is None:
        return {}

    def one(name: str) -> StreamingQuery:
        def take(rows: DataFrame, n: int) -> None:
            answers = f"{folder}/answers/{launch}/{name}/{n:09d}"
            calls = judge.judge(rows, slate, transport, concurrency, stop, judge.Keeping(answers, f"{folder}/held", f"{folder}/bars"), n == 0, lanes)
            calls.write.mode("overwrite").json(f"{folder}/log/{launch}/{name}/{n:09d}")
            _delete(spark, answers)

        queue = spark.readStream.schema(TODO).option("maxFilesPerTrigger", 1).parquet(f"{folder}/launches/{launch}/{name}")
        writer = queue.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoints/{launch}/{name}")
        return writer.trigger(availableNow=True).start()

    return {unquote(h.removeprefix("host=")): one(h) for h in _names(spark, f"{folder}/launches/{launch}") if h.startswith("host=")}


def run(slate: DataFrame, transport: judge.Transport, folder: str, concurrency: int = 1, stop: Callable[[], bool] | None = None, lanes: int = 1) -> dict[str, str]:
    """Work the latest launch off, all hosts side by side; what ended badly, by host. A failing host leaves the others alone."""
    failed = {}
    for host, query in start(slate, transport, folder, concurrency, stop, lanes).items():
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            failed[host] = str(e)
    return failed

