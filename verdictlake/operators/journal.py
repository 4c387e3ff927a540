"""Replay of append-only ruling journals, pending rows, merge of rulings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .guards import GuardError

RULING = ("pair_id", "ground_truth", "reason")


class Standing:
    """Rulings of one journal that stand, last decided last.

    A ruling moves its pair to the end; an undo takes back the last pair's latest ruling
    and leaves that pair, if an older ruling stands, at the end. Every event takes the
    same time, however long the journal.
    """

    def __init__(self, held: list | None = None):
        self.past: dict[str, list] = {pair: past for pair, past in held or []}

    def take(self, action: str, pair: str | None, truth: str | None, reason: str | None) -> None:
        if action == "rule" and pair is not None:
            past = self.past.pop(pair, [])
            past.append([truth, reason])
            self.past[pair] = past
        elif action == "undo" and self.past:
            pair, past = self.past.popitem()
            past.pop()
            if past:
                self.past[pair] = past

    def rows(self) -> list[tuple]:
        return [(place, pair, *past[-1]) for place, (pair, past) in enumerate(self.past.items())]


def _folded(kind: pa.DataType, name: str):
    """Events sorted by journal and place in it -> what stands at each journal's end; of a journal only that is held."""
    types = [kind, pa.int32(), pa.string(), pa.string(), pa.string()]

    def batch(journal, standing: Standing) -> pa.RecordBatch:
        rows = [(journal, *r) for r in standing.rows()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [name, "place", *RULING])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, standing = None, None
        for events in batches:
            for journal, _, *event in zip(*(c.to_pylist() for c in events.columns), strict=True):
                if standing is None or journal != at:
                    if standing is not None:
                        yield batch(at, standing)
                    at, standing = journal, Standing()
                standing.take(*event)
        if standing is not None:
            yield batch(at, standing)

    return run


def replay(records: DataFrame, journal: str = "session") -> DataFrame:
    """(journal, seq, action, pair_id, ground_truth, reason) -> standing rulings: journal, place, pair_id, ground_truth, reason.

    A journal is sequential, so its rulings and undos pass through one task, in order;
    journals are independent and run side by side. Only rulings and undos move.
    """
    e = records.where(F.col("action").isin("rule", "undo")).select(journal, "seq", "action", *RULING)
    key = T.StructType([e.schema[journal]])
    schema = T.StructType([e.schema[journal], T.StructField("place", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in RULING]])
    ordered = e.repartition(journal).sortWithinPartitions(journal, "seq", "action", *RULING)
    return ordered.mapInArrow(_folded(to_arrow_schema(key).field(0).type, journal), schema)


def notes(records: DataFrame, journal: str = "session") -> DataFrame:
    """Last note of each pair; undo touches none."""
    rows = records.where("action in ('rule', 'note') and pair_id is not null and notes <> ''")
    return rows.groupBy(journal, "pair_id").agg(F.max_by("notes", "seq").alias("notes"))


def skipped(records: DataFrame, journal: str = "session") -> DataFrame:
    """Pairs whose last skip no ruling follows."""
    rows = records.where("action in ('rule', 'skip') and pair_id is not null")
    return rows.groupBy(journal, "pair_id").agg(F.max_by("action", "seq").alias("last")).where("last = 'skip'").drop("last")


def pending_rows(template: DataFrame, rulings: DataFrame) -> DataFrame:
    return template.join(rulings.select(F.col("pair_id").alias("id")), "id", "left_anti")


def unknown_rulings(template: DataFrame, rulings: DataFrame) -> DataFrame:
    """Rulings of rows that the template does not have."""
    return rulings.join(template, "id", "left_anti")


def merge_rulings(template: DataFrame, rulings: DataFrame) -> DataFrame:
    """Template rows with their rulings; unknown, half and missing rulings are refused."""
    unknown = unknown_rulings(template, rulings).limit(3).collect()
    if unknown:
        raise GuardError("rulings of unknown rows: " + ", ".join(r["id"] for r in unknown))
    missing = template.join(rulings.where("ground_truth is not null and reason is not null"), "id", "left_anti").limit(3).collect()
    if missing:
        raise GuardError("rows without a ruling: " + ", ".join(r["id"] for r in missing))
    return template.drop("ground_truth", "reason").join(rulings.select("id", "ground_truth", "reason"), "id")


def last_per_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that repeat a key the last in `order`."""
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("r")).select(key, "r.*")


def session_tallies(records: DataFrame, journal: str = "session") -> DataFrame:
    """Decisions of a session net of undos, and their pace."""
    n = lambda a: F.count_if(F.col("action") == a)
    by = records.groupBy(journal).agg(n("rule").alias("ruled"), n("skip").alias("skipped"), n("undo").alias("undone"), n("note").alias("noted"), F.sum("elapsed_ms").alias("elapsed_ms"))
    net = F.greatest(F.col("ruled") - F.col("undone"), F.lit(0))
    return by.withColumns({"decisions": net, "decisions_per_minute": F.coalesce(net / F.nullif(F.col("elapsed_ms") / 60000.0, F.lit(0.0)), F.lit(0.0))})
