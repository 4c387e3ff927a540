"""Streaming twins of batch queries: the same columns over append-only logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tally import tally
from ..sources.shared import shared_dir


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Read all that is there, then stop; the result as tables of the shared folder, batch by batch (complete: the last one)."""
    folder, done = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{n}")
        done.append(n)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint or f"{folder}/checkpoint").start().awaitTermination()
    out = spark.createDataFrame([], stream.schema)
    for n in done[-1:] if mode == "complete" else done:
        out = out.union(spark.read.schema(stream.schema).parquet(f"{folder}/{n}"))
    return out


def stream_tally(votes: DataFrame, keys: tuple[str, ...] = ("backend", "pair_id")) -> DataFrame:
    """Running tally: one row of counters of state per pair, whatever the order of arrival."""
    return tally(votes, keys)


def stream_health(calls: DataFrame) -> DataFrame:
    return calls.groupBy("backend").agg(
        F.count_if(F.col("ok") == 1).alias("calls_ok"),
        F.count_if(F.col("ok") == 0).alias("calls_failed"),
        F.min(F.when(F.col("ok") == 1, F.col("latency_s"))).alias("latency_min"),
        F.max(F.when(F.col("ok") == 1, F.col("latency_s"))).alias("latency_max"),
    )


def stream_dedupe(votes: DataFrame, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each (backend, pair, run) once, so a resumed writer may repeat itself; with an event time, state is bounded."""
    keys = ["backend", "pair_id", "run_index"]
    return votes.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if ts else votes.dropDuplicates(keys)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Exactly-once sink: `write` must be idempotent by batch id."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGES = "session string, version long, pair_id string, place long, ground_truth string, reason string"
#: Keyed state lives in a store that reads and writes single keys.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JournalState(StatefulProcessor):
    """Standing rulings of one journal as keyed state.

    `past` holds the rulings of a pair by their number, `pairs` a pair's place and how
    many rulings it holds, and `places` the pair at a place with the places before and
    after it, a linked list whose end is in `ends`. A ruling moves its pair to the end, an
    undo takes back the one at the end: either touches a handful of keys, however long
    the journal.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "last long, next long, version long")
        self.pairs = handle.getMapState("pairs", "pair_id string", "place long, held long")
        self.places = handle.getMapState("places", "place long", "pair_id string, before long, after long")
        self.past = handle.getMapState("past", "pair_id string, number long", "ground_truth string, reason string")

    def _unlink(self, place: int, last: int) -> int:
        """Takes a place out of the list; returns the list's end."""
        _, before, after = self.places.getValue((place,))
        self.places.removeKey((place,))
        for at, side, other in ((before, 2, after), (after, 1, before)):
            if at >= 0:
                row = list(self.places.getValue((at,)))
                row[side] = other
                self.places.updateValue((at,), tuple(row))
        return before if place == last else last

    def _append(self, pair: str, last: int, place: int, held: int) -> None:
        self.places.updateValue((place,), (pair, last, -1))
        if last >= 0:
            of, before, _ = self.places.getValue((last,))
            self.places.updateValue((last,), (of, before, place))
        self.pairs.updateValue((pair,), (place, held))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, place, version = self.ends.get() or (-1, 0, 0)
        touched: dict[str, None] = {}
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.action == "rule" and r.pair_id is not None:
                pair, held = r.pair_id, 0
                if self.pairs.containsKey((pair,)):
                    at, held = self.pairs.getValue((pair,))
                    last = self._unlink(at, last)
                self.past.updateValue((pair, held), (r.ground_truth, r.reason))
                self._append(pair, last, place, held + 1)
                last, place = place, place + 1
            elif r.action == "undo" and last >= 0:
                pair = self.places.getValue((last,))[0]
                _, held = self.pairs.getValue((pair,))
                self.past.removeKey((pair, held - 1))
                if held > 1:
                    self.pairs.updateValue((pair,), (last, held - 1))
                else:
                    self.pairs.removeKey((pair,))
                    last = self._unlink(last, last)
            else:
                continue
            touched[pair] = None
        version += 1
        self.ends.update((last, place, version))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        out = []
        for pair in touched:
            if self.pairs.containsKey((pair,)):
                at, held = self.pairs.getValue((pair,))
                out.append((key[0], version, pair, at, *self.past.getValue((pair, held - 1))))
            else:
                out.append((key[0], version, pair, None, None, None))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])
        yield frame.astype({"place": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A journal without records for `idle_ms` is forgotten whole."""
        for state in (self.ends, self.pairs, self.places, self.past):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_replay(records: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Replay of growing journals: what each batch changes, session, version, pair_id and where it stands now (null: no ruling of it stands).

    A journal is appended to in order, so records of a batch follow those before it. The
    work of a batch follows the batch. `standing` makes the rulings of the changes.
    """
    spark = records.sparkSession
    if spark.conf.get(STORE, "") != ROCKS:
        spark.conf.set(STORE, ROCKS)
    rows = records.where(F.col("action").isin("rule", "undo")).select(F.col("session").cast("string").alias("session"), "seq", "action", "pair_id", "ground_truth", "reason")
    processor = JournalState(idle_ms)
    return rows.groupBy("session").transformWithStateInPandas(processor, CHANGES, "update", "none" if idle_ms is None else "processingTime")


def standing(changes: DataFrame) -> DataFrame:
    """The last change of each pair, where a ruling stands: session, place (in order, with gaps), pair_id, ground_truth, reason."""
    last = changes.groupBy("session", "pair_id").agg(F.max_by(F.struct("place", "ground_truth", "reason"), "version").alias("r"))
    return last.select("session", "r.place", "pair_id", "r.ground_truth", "r.reason").where("place is not null")
