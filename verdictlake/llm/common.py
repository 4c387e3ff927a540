"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Words, which ASCII white space alone separates.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/verdictlake-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that `save` made in this application, once no result that reads them is needed any more."""
    _delete(spark, run_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage in a way that outlives any executor, and gives the
    optimizer the true size, so that it broadcasts only what is small.
    With `free`, the shuffle files of the write go as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by `save` that nothing reads any more."""
    _delete(df.sparkSession, df._saved_at)


BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with smaller batches than by default (in bytes), unless the session sets a size itself.

    Several batches and what is derived from them are in memory at a time.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) == BATCH_DEFAULT:
        conf.set(BATCH_KEY, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def whole_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """Rows of `docs` in the column `row`, beside their id and other keys: names inside and outside cannot clash.

    Undo it by select("row.*").
    """
    return docs.select(F.struct(*docs.columns).alias("row"), *id_keys(), *[c.alias(n) for n, c in keys.items()])


def id_keys(doc_id: str = "doc_id") -> list[Column]:
    """`id` and `none`: a key that joins and deals nulls like values."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")).alias("id"), F.col(doc_id).isNull().alias("none")]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds)
