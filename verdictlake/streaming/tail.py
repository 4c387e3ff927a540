"""Files that grow, read line by line as a stream: what came since the last batch, and nothing twice.

Spark's own file source takes each file once, as it is when it is first seen. This source
keeps a place in bytes for each file. A batch ends behind the last newline that is there,
so a torn last line waits until its newline comes, wherever the writer was cut off, in
the middle of a character too. Places are checkpointed as Spark's offsets, so a query
that starts again goes on where it was, and a batch that is repeated reads the same bytes.

The driver lists the files and looks back from the end of those that grew for their last
newline; what lies between two places is cut into ranges of `RANGE` bytes, a task each. A
line belongs to the range that it begins in. The offset has an entry for each file: a
folder of results has one for each backend.

Defined results: a missing folder and empty files have no lines; a last line without a
newline waits for good; bytes that are no UTF-8 become U+FFFD; `\\r` before a newline goes;
a file that is gone yields nothing more, one that is shorter than what was read of it is
an error. Names that begin with `_` or `.` are passed over. Folders are opened by
`pyarrow.fs` (local, HDFS, S3), on the driver and on executors.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.text import strip
from ..schema import JOURNAL
from ..sources.readers import PART, strict_verdict

LINES = "file string, start long, value string"
RANGE = 32 << 20
BLOCK = 1 << 20


class Stretch(InputPartition):
    """Lines of a file that begin from `start` on and before `end`; `cut` says that a line may have begun before."""

    def __init__(self, file: str, start: int, end: int, cut: bool):
        self.file, self.start, self.end, self.cut = file, start, end, cut


def whole_lines(f, size: int, block: int = BLOCK) -> int:
    """The place behind the last newline among the first `size` bytes, looked for from the end."""
    while size > 0:
        begin = max(0, size - block)
        f.seek(begin)
        if (at := f.read(size - begin).rfind(b"\n")) >= 0:
            return begin + at + 1
        size = begin
    return 0


def stretches(start: dict[str, int], end: dict[str, int], size: int = RANGE) -> list[Stretch]:
    """What lies between two offsets, in ranges."""
    out = []
    for file, last in sorted(end.items()):
        first = start.get(file, 0)
        if last < first:
            raise ValueError(f"{file} was read up to byte {first} and now ends at {last}")
        out += [Stretch(file, at, min(at + size, last), at > first) for at in range(first, last, size)]
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix = options["path"], options.get("suffix", "")
        self.range = int(options.get("range", RANGE))
        self.seen: dict[str, tuple[int, int]] = {}  # file -> its size when last looked at, and its last place

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, folder = files.FileSystem.from_uri(self.folder)
        known = {}
        for info in fs.get_file_info(files.FileSelector(folder, allow_not_found=True, recursive=True)):
            below = info.path[len(folder) :].strip("/").split("/")
            if info.type != files.FileType.File or not info.path.endswith(self.suffix) or any(name[0] in "_." for name in below):
                continue
            known[info.path] = self.seen.get(info.path, (-1, 0))
            if known[info.path][0] != info.size:
                with fs.open_input_file(info.path) as f:
                    known[info.path] = (info.size, whole_lines(f, info.size))
        self.seen = known
        return {file: known[file][1] for file in sorted(known)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return stretches(start, end, self.range)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, _ = files.FileSystem.from_uri(self.folder)
        with io.BufferedReader(fs.open_input_file(partition.file), BLOCK) as f:
            at = partition.start
            if partition.cut:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                starts, values, begin = [], [], at
                while at < partition.end and at - begin < BLOCK:
                    line = f.readline()
                    if not line.endswith(b"\n"):
                        raise ValueError(f"{partition.file} ends at byte {at + len(line)}, before its last place")
                    starts.append(at)
                    values.append(line.removesuffix(b"\n").removesuffix(b"\r").decode(errors="replace"))
                    at += len(line)
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.string())], ["file", "start", "value"])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl", range_bytes: int = RANGE) -> DataFrame:
    """A stream of (file, start, value): lines of all files below a folder, each with its first byte's place."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).option("suffix", suffix).option("range", range_bytes).load(folder)


def _backend() -> Column:
    """A backend's folder, as `append_votes` names it, or the file's stem."""
    of_folder = F.regexp_extract("file", rf"(?:^|/){PART}([^/]*)/", 1)
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.jsonl)?$", 1)
    return F.when(of_folder != "", F.url_decode(F.replace(of_folder, F.lit("+"), F.lit("%2B")))).otherwise(stem)


def tail_votes(spark: SparkSession, folder: str, suffix: str = ".jsonl", range_bytes: int = RANGE) -> DataFrame:
    """The stream's twin of `read_votes`, strict: a whole line that is no verdict ends the query. Blank lines are skipped."""
    lines = tail_lines(spark, folder, suffix, range_bytes).where(strip(F.col("value")) != "")
    rows = lines.select(strict_verdict(F.col("value")).alias("v"), _backend().alias("backend")).select("v.*", "backend")
    return rows.withColumns({"run_index": F.coalesce("run_index", F.lit(0).cast("long")), "cached_tokens": F.col("usage.cached_tokens")})


def tail_journal(spark: SparkSession, folder: str, suffix: str = ".json", range_bytes: int = RANGE) -> DataFrame:
    """The stream's twin of `read_journal`, for `stream_replay`.

    Records without a number have their first byte's place for one, which orders the
    records of a file; sessions must not be spread over such files. A torn line that a
    record was written straight behind is a whole line that cannot be read, and ends the query.
    """
    lines = tail_lines(spark, folder, suffix, range_bytes).where(strip(F.col("value")) != "")
    told = F.concat(F.lit("journal line at byte "), F.col("start").cast("string"), F.lit(" of "), F.col("file"), F.lit(" cannot be read: "), F.substring("value", 1, 80))
    line = F.when(F.try_parse_json("value").isNull(), F.raise_error(told).cast("string")).otherwise(F.col("value"))
    place = F.coalesce(F.get_json_object("value", "$.seq").try_cast("long"), F.col("start"))
    return lines.select(place.alias("seq"), F.from_json(line, JOURNAL).alias("r")).select("seq", "r.*")
