"""Views of a small table that becomes many rows are made by several tasks."""

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import kept_tally
from verdictlake.operators.ranking import placed
from verdictlake.operators.tally import tally
from verdictlake.plans import catalog
from verdictlake.sources import fixtures


def test_view_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "PARTS", 100, raising=False)
    key = F.col("id")
    part = spark.range(1, 1001).select(key.alias("p_partkey"), F.concat(F.lit("name "), key).alias("p_name"), F.lit("type").alias("p_type"), F.lit("brand").alias("p_brand"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("votes", "pairs"):
        rows = fixtures.view(spark, str(tmp_path), name)
        sizes = rows.groupBy(F.spark_partition_id()).count().collect()
        with monkeypatch.context() as m:
            m.setattr(fixtures, "PARTS", 10_000)
            whole = fixtures.view(spark, str(tmp_path), name)
        n = whole.count()
        assert len(sizes) == 10 and max(r["count"] for r in sizes) < 0.2 * n
        assert rows.exceptAll(whole).isEmpty() and rows.count() == n


def test_few_parts_stay(spark, sf):
    assert fixtures.view(spark, sf, "votes").rdd.getNumPartitions() == 1


@pytest.fixture
def parts(spark, tmp_path, monkeypatch):
    """A folder whose 1,000 parts are dealt to ten tasks; the session's shuffles have four."""
    monkeypatch.setattr(fixtures, "PARTS", 100)
    key = F.col("id")
    part = spark.range(1, 1001).select(key.alias("p_partkey"), F.concat(F.lit("name "), key).alias("p_name"), F.lit("type").alias("p_type"), F.lit("brand").alias("p_brand"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def whole(query, spark, parts, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(fixtures, "PARTS", 10_000)
        return query(spark, parts)


def test_contention_stays_in_the_tasks_of_the_votes(spark, parts, monkeypatch):
    got = catalog.contention_ranking(spark, parts)
    assert got.rdd.getNumPartitions() == 10
    assert got.count() == 1000 and got.exceptAll(whole(catalog.contention_ranking, spark, parts, monkeypatch)).isEmpty()


def test_unstable_pairs_are_placed_by_as_many_tasks(spark, parts, monkeypatch):
    got = catalog.unstable_pairs(spark, parts)
    assert got.rdd.getNumPartitions() == 10
    assert got.count() > 0 and got.exceptAll(whole(catalog.unstable_pairs, spark, parts, monkeypatch)).isEmpty()


def test_places_of_null_groups(spark):
    rows = spark.createDataFrame([(None, None, 2), (None, None, 1), (None, "x", 3), ("k", None, 4), ("k", "a", 5)], "k string, g string, v int")
    for tasks in (None, 3):
        got = placed(rows, [("g", False)], ["v"], keys=("k",), total="n", tasks=tasks)
        assert {(r["v"], r["place"], r["n"]) for r in got.collect()} == {(1, 1, 3), (2, 2, 3), (3, 3, 3), (4, 1, 2), (5, 2, 2)}


def test_kept_counters_are_added_by_their_number_of_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept_tally, "ROWS", 50)
    votes = lambda run: spark.range(300).select(F.concat(F.lit("m"), F.col("id") % 2).alias("backend"), F.concat(F.lit("p"), F.col("id")).alias("pair_id"), F.lit("approve").alias("verdict"), F.lit("ok").alias("reason"), F.lit(run).alias("run_index"))
    folder = f"{tmp_path}/kept"
    for run in (0, 1):
        kept_tally.add_votes(votes(run), folder, run)
    want = tally(votes(0).union(votes(1)))
    got = kept_tally.read_tally(spark, folder)
    assert got.rdd.getNumPartitions() == 12 and got.count() == 300 and got.exceptAll(want).isEmpty()
    kept_tally.fold(spark, folder)
    got = kept_tally.read_tally(spark, folder)
    assert got.rdd.getNumPartitions() == 6 and got.count() == 300 and got.exceptAll(want).isEmpty()
