"""Readers of judge data: JSON lines, manifests, markdown tables, journals, slates."""

from __future__ import annotations

import tomllib
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.guards import GuardError
from ..operators.ranking import placed, ranges
from ..schema import JOURNAL, MANIFEST, PAIR, REASONS, VERDICT, VERDICT_KEYS
from .files import _fs

#: Folders of a backend's votes begin so.
PART = "backend="


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _listed(spark: SparkSession, folder: str, suffix: str) -> tuple[list[str], list[str]]:
    """Backends that have a file of their own, and those that have a folder, as `append_votes` makes them."""
    fs, p = _fs(spark, folder)
    files, folders = [], []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if s.isFile() and name.endswith(suffix):
            files.append(name.removesuffix(suffix))
        elif s.isDirectory() and name.startswith(PART):
            folders.append(unquote(name.removeprefix(PART)))
    return sorted(files), sorted(folders)


def roster(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """Backends by file stem or folder, from a listing: files without rows count, and readers skip them."""
    files, folders = _listed(spark, folder, suffix)
    return spark.createDataFrame([(n,) for n in sorted({*files, *folders})], "backend string")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, file, modified, value): lines that are not blank, numbered over all files by name and place. No file is read by one task alone."""
    meta = F.col("_metadata")
    rows = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_modification_time"].alias("modified"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"))
    rows = placed(rows, [("file", False), ("block", False)], ["id"], "seq").where(strip(F.col("value")) != "")
    return rows.select((F.col("seq") - 1).alias("seq"), "file", "modified", "value")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with their file position; blank lines are skipped, half rulings refused."""
    rows = _lines(spark, path).select(F.col("seq").cast("long").alias("pos"), F.from_json("value", PAIR, {"mode": "FAILFAST"}).alias("p")).select("p.*", "pos")
    half = F.assert_true(F.col("ground_truth").isNull() == F.col("reason").isNull(), F.lit("ground_truth and reason go together"))
    return rows.where(half.isNull())


def pair_order(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, rank): nothing but ids is parsed."""
    ids = _lines(spark, path).select("seq", F.get_json_object("value", "$.id").alias("pair_id")).withColumn("range", ranges("seq"))
    return placed(ids, [("range", False)], ["seq"]).select("pair_id", (F.col("place") - 1).alias("rank"))


def strict_verdict(line: Column) -> Column:
    """A verdict row of a JSON line; a line with keys that are not known, without one that has no default, or with a reason that never was, is an error."""
    keys = F.json_object_keys(line)
    known, needed = (F.array(*[F.lit(k) for k in names]) for names in (VERDICT.fieldNames(), VERDICT_KEYS))
    odd = F.array_join(F.concat(F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown "), k)), F.transform(F.array_except(needed, keys), lambda k: F.concat(F.lit("missing "), k))), ", ")
    row = F.from_json(line, VERDICT, {"mode": "FAILFAST"})
    said = F.when(keys.isNull(), F.lit("no object")).when(odd != "", odd).when(~F.coalesce(row["reason"].isin(*REASONS), F.lit(False)), F.lit("reason"))
    return F.when(said.isNotNull(), F.raise_error(F.concat(F.lit("verdict line: "), said, F.lit(" in "), F.substring(line, 1, 80))).cast(VERDICT)).otherwise(row)


def read_votes(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """All results of a folder: files, whose stem is the backend, and what `append_votes` wrote. Not strictly: keys that are not known are ignored, missing ones null."""
    files, folders = _listed(spark, folder, ".jsonl")
    schema = T.StructType([*VERDICT.fields, T.StructField("backend", T.StringType())])
    plain = spark.read.schema(VERDICT).option("mode", "FAILFAST")
    parts = []
    if files:
        beside = f"{folder}/*.jsonl"
        source = spark.read.text(beside) if strict else plain.json(beside)
        parts.append(source.withColumn("backend", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "")))
    if folders:
        below = f"{folder}/{PART}*"
        lines = spark.read.schema("value string, backend string").option("basePath", folder)
        parts.append(lines.text(below) if strict else plain.schema(schema).option("basePath", folder).json(below))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("cached_tokens", F.col("usage.cached_tokens"))
    rows = reduce(DataFrame.unionByName, parts)
    if strict:
        rows = rows.where(strip(F.col("value")) != "").select(strict_verdict(F.col("value")).alias("v"), "backend").select("v.*", "backend")
    return rows.withColumns({"run_index": F.coalesce("run_index", F.lit(0).cast("long")), "cached_tokens": F.col("usage.cached_tokens")})


TOLERANT = "pair_id string, verdict string, reason string, model_id string"


def read_votes_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    """Four fields of whatever parses, in all folders below; a missing folder is empty."""
    if not exists(spark, folder):
        return spark.createDataFrame([], TOLERANT)
    rows = spark.read.schema(TOLERANT).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder)
    return rows.dropna()


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Provenance fields, with unreadable lines kept in `_corrupt`."""
    schema = "base_url string, config_digest string, code_version string, _corrupt string"
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("backend", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", ""))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per `*.manifest.json`; what cannot be read is all null."""
    if not _listed(spark, folder, ".manifest.json")[0]:
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.manifest.json").json(folder)
    return rows.withColumn("backend", F.coalesce("backend", F.regexp_replace(F.col("_metadata.file_name"), r"\.manifest\.json$", "")))


def qa_pack(lines: DataFrame) -> DataFrame:
    """(value) lines of markdown -> cohort, source, before, after, stages. A table row has pipes at both ends and five cells."""
    line = strip(F.col("value"))
    cells = F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|", -1), strip)
    rows = lines.select("*", line.alias("_line"), cells.alias("_cells")).where(F.col("_line").rlike(r"^\|.*\|$") & (F.length("_line") > 1) & (F.size("_cells") == 5))
    rule = F.forall("_cells", lambda c: c.rlike("^[-:]+$"))
    rows = rows.where(~rule & (F.lower(F.col("_cells")[0]) != "cohort"))
    names = ("cohort", "source", "before", "after")
    parts = F.filter(F.transform(F.split(F.col("_cells")[4], ","), strip), lambda x: x != "")
    stages = F.when(F.col("_cells")[4] == "—", F.array().cast("array<string>")).otherwise(parts)
    kept = [c for c in lines.columns if c != "value"]
    return rows.select(*kept, *[F.col("_cells")[i].alias(n) for i, n in enumerate(names)], stages.alias("stages"))


def read_qa_pack(spark: SparkSession, path: str) -> DataFrame:
    return qa_pack(_lines(spark, path).withColumnRenamed("seq", "pos"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal records with `seq`, their order. A torn last line of a file is dropped, a bad line before it is an error, no file is empty.

    Records that `append_journal` wrote carry their seq. Others follow each other by
    file, oldest first, and line.
    """
    schema = T.StructType([T.StructField("seq", T.LongType()), *JOURNAL.fields])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = _lines(spark, path).withColumn("good", F.try_parse_json("value").isNotNull())
    files = lines.groupBy("file").agg(F.max("seq").alias("last"), F.min("seq").alias("first"), F.min("modified").alias("modified"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("modified", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.withColumn("size", F.col("last") - F.col("first") + 1).withColumn("start", before).select("file", "first", "last", "start")  # a row per file
    lines = lines.join(starts, "file")
    bad = lines.where("not good and seq < last").select((F.col("seq") - F.col("first") + 1).alias("n"), "value").limit(1).collect()
    if bad:
        raise GuardError(f"journal line {bad[0]['n']} cannot be read: {bad[0]['value'][:80]}")
    place = F.coalesce(F.get_json_object("value", "$.seq").try_cast("long"), F.col("seq") - F.col("first") + F.col("start"))
    return lines.where("good").select(place.alias("seq"), F.from_json("value", JOURNAL).alias("r")).select("seq", "r.*")


def manifest_beside(spark: SparkSession, results: str) -> DataFrame:
    """The manifest beside one results file, as a row; no row if there is none or it cannot be read."""
    path = results.removesuffix(".jsonl") + ".manifest.json"
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.greatest(*[F.col(f.name).isNotNull().cast("int") for f in MANIFEST.fields]) > 0)


# What a backend may say of itself, and what holds when it does not.
APIS, ROLES, EFFORTS = ("openai", "anthropic"), ("contender", "floor"), ("none", "low", "medium", "high", "xhigh", "max")
SLATE = "name string, base_url string, model_id string, rpm int, eval_only boolean, api_key_env string, api string, role string, timeout_s double, temperature double, reasoning_effort string, structured_output boolean"


def _backend(b: dict) -> tuple:
    url = b["base_url"].rstrip("/")
    key = b.get("api_key_env", b["name"].upper().replace("-", "_") + "_API_KEY")
    api, role, effort, heat = b.get("api", APIS[0]), b.get("role", ROLES[0]), b.get("reasoning_effort"), b.get("temperature")
    for what, ok in (("base_url must be https", url.startswith("https://")), (f"api {api}", api in APIS), (f"role {role}", role in ROLES), (f"reasoning_effort {effort}", effort is None or effort in EFFORTS)):
        if not ok:
            raise GuardError(f"backend {b['name']}: {what}")
    return b["name"], url, b["model_id"], int(b["rpm"]), bool(b["eval_only"]), key, api, role, float(b.get("timeout_s", 180)), None if heat is None else float(heat), effort, bool(b.get("structured_output", False))


def read_slate(spark: SparkSession, path: str) -> DataFrame:
    """Backends of a TOML slate, with defaults; a handful of rows."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame([_backend(b) for b in tomllib.loads(text)["backends"]], SLATE)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)
