"""Writers: atomic part files instead of one guarded file handle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import VERDICT


def append_votes(rows: DataFrame, folder: str) -> None:
    """Verdict lines; a commit appears whole or not at all. Nulls are spelled out: the strict reader asks for keys."""
    rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in VERDICT.fields], "backend").write.mode("append").partitionBy("backend").option("ignoreNullFields", False).json(folder)


def append_journal(records: DataFrame, folder: str, order: str = "seq") -> None:
    """Records at the end of a journal, numbered on from its last one in order of the numeric column `order`.

    A single record needs no such column. One writer at a time.
    """
    from ..operators.guards import GuardError
    from ..operators.ranking import placed, ranges
    from .readers import read_journal

    if order not in records.columns:
        if len(records.take(2)) > 1:
            raise GuardError(f"several records need a column {order} to say their order")
        records = records.withColumn(order, F.lit(0).cast("long"))
    last = read_journal(records.sparkSession, folder).agg(F.max("seq")).first()[0]
    rows = placed(records.withColumn("_range", ranges(order)), [("_range", False)], [order], "_place")
    rows = rows.withColumn("seq", (F.col("_place") + (-1 if last is None else last)).cast("long"))
    rows.drop("_range", "_place", *({order} - {"seq"})).write.mode("append").option("ignoreNullFields", True).json(folder)


def template(rows: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """Pack rows as ruling templates: id first, rulings null and spelled out, brand and mpn only where known."""
    from ..functions.text import row_id
    from ..operators.journal import last_per_id

    out = rows.withColumn("id", row_id(F.col("before"), F.col("after")))
    if attributes is not None:
        out = out.join(last_per_id(attributes.select("id", "brand", "mpn", "pos"), "id", "pos").select("id", "brand", "mpn"), "id", "left")
    else:
        out = out.withColumns({"brand": F.lit(None).cast("string"), "mpn": F.lit(None).cast("string")})
    empty = F.lit(None).cast("string")
    fixed = F.struct("id", F.col("before").alias("original"), F.col("after").alias("enriched"), "cohort", "source", "stages", empty.alias("ground_truth"), empty.alias("reason"))
    extra = F.struct(F.nullif("brand", F.lit("")).alias("brand"), F.nullif("mpn", F.lit("")).alias("mpn"))
    head, tail = F.to_json(fixed, {"ignoreNullFields": "false"}), F.to_json(extra, {"ignoreNullFields": "true"})
    line = F.when(tail == "{}", head).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substring(tail, F.lit(2), F.length(tail))))
    return out.select("id", "cohort", line.alias("value"))


def deadlock_lines(rows: DataFrame, version: int = 1) -> DataFrame:
    """Audit lines with keys in alphabetical order."""
    return rows.select(F.to_json(F.struct("backend", "kind", "leg", "n_votes", "pair_id", F.lit(version).alias("record_version"), "split")).alias("value"))


def export_rulings(standing: DataFrame, folder: str) -> None:
    """One file for people: as many rows as they decided."""
    standing.select(F.col("pair_id").alias("id"), "ground_truth", "reason").coalesce(1).write.mode("overwrite").json(folder)


def export_notes(noted: DataFrame, folder: str) -> None:
    noted.select(F.col("pair_id").alias("id"), "notes").coalesce(1).write.mode("overwrite").json(folder)


def pair_lines(pairs: DataFrame) -> DataFrame:
    """Calibration pairs in file order; brand, mpn and missing rulings are left out."""
    bare = {c: F.nullif(c, F.lit("")) for c in ("brand", "mpn")}
    fields = F.struct("id", "original", "enriched", *[bare[c].alias(c) for c in bare], "ground_truth", "reason")
    return pairs.select("pos", F.to_json(fields, {"ignoreNullFields": "true"}).alias("value"))


def write_manifests(runs: DataFrame, folder: str) -> None:
    """Each backend's manifest, history and all, beside its results; a rewrite replaces the file whole. As many rows as backends."""
    spark = runs.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in runs.select("backend", F.to_json(F.struct(*sorted(runs.columns))).alias("value")).toLocalIterator():
        target, fresh = (fs_path(f"{folder}/{row['backend']}.manifest.json{end}") for end in ("", ".new"))
        out = fs.create(fresh, True)
        out.write(bytearray(row["value"], "utf-8"))
        out.close()
        fs.delete(target, False)
        fs.rename(fresh, target)


def manifest_line(run: DataFrame) -> DataFrame:
    return run.select(F.to_json(F.struct(*sorted(run.columns))).alias("value"))
