"""A tally that is kept: counters per pair in a folder, added to batch by batch.

`batch-<n>` holds what batch n adds to the counters of its pairs, `base-<n>` the sums
of all batches up to n. Either counts only once it is written whole, and a batch that
was written is not added again, so a stream or a run that starts over may repeat
its batches. Counters are added by key when they are read; adding a batch
costs what the batch costs, whatever is there already.

Batches are numbered upwards, by one writer at a time. A vote belongs to one batch:
votes that a producer may repeat go through `stream_dedupe` first.

Defined results: null keys are keys like others, values outside an axis' domain count
as votes without a ruling, an empty batch adds nothing, a folder that does not exist
is an empty tally, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AXES
from ..sources.files import delete, named
from .guards import GuardError
from .tally import KEYS, ROWS, counted, counters, ruled

DONE = "_SUCCESS"


def _standing(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """The number of the newest base (-1: none) and of the batches behind it, of those that are whole."""
    bases, batches = (sorted(int(n.removeprefix(kind)) for n in named(spark, folder, kind, DONE)) for kind in ("base-", "batch-"))
    base = bases[-1] if bases else -1
    return base, [n for n in batches if n > base]


def _parts(spark: SparkSession, folder: str, keys: tuple[str, ...], until: int | None = None) -> DataFrame:
    base, batches = _standing(spark, folder)
    paths = [f"{folder}/base-{base}"] * (base >= 0) + [f"{folder}/batch-{n}" for n in batches if until is None or n <= until]
    schema = ", ".join([*[f"{k} string" for k in keys], *[f"{c} long" for c in counters(AXES)]])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _summed(parts: DataFrame, keys: tuple[str, ...], rows: int) -> DataFrame:
    """The counters by key, in as many tasks as that number of rows needs; a key has a row for each batch at most."""
    if rows > ROWS:
        parts = parts.repartition(-(-rows // ROWS), *keys)
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters(AXES)])


def add_votes(votes: DataFrame, folder: str, batch: int, keys: tuple[str, ...] = KEYS) -> bool:
    """Add the votes as batch number `batch`; False if that batch was added before."""
    base, batches = _standing(votes.sparkSession, folder)
    if batch <= base or batch in batches:
        return False
    if batches and batch < batches[-1]:
        raise GuardError(f"batch {batch} comes after batch {batches[-1]}")
    counted(votes.withColumns({k: F.col(k).cast("string") for k in keys}), keys).write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
    return True


def read_tally(spark: SparkSession, folder: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """What `tally` gives for all votes added so far: one shuffle of counters."""
    parts = _parts(spark, folder, keys)
    return ruled(_summed(parts, keys, parts.count()))


def changed(spark: SparkSession, folder: str, batch: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same for the pairs of one batch alone, as they stand with all batches; the batch must not be folded yet."""
    if batch not in _standing(spark, folder)[1]:
        raise GuardError(f"batch {batch} is not there")
    parts = _parts(spark, folder, keys)
    touched = spark.read.schema(parts.schema).parquet(f"{folder}/batch-{batch}").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return ruled(_summed(parts.join(touched, same, "left_semi"), keys, parts.count()))


def fold(spark: SparkSession, folder: str, keys: tuple[str, ...] = KEYS) -> None:
    """Sum up the base and the batches behind it into a new base.

    What the base before it had replaced is deleted, so tables read before one call still
    stand, and a call that fails leaves all as it was.
    """
    base, batches = _standing(spark, folder)
    if not batches:
        return
    parts = _parts(spark, folder, keys, batches[-1])
    _summed(parts, keys, parts.count()).write.mode("overwrite").parquet(f"{folder}/base-{batches[-1]}")
    for kind, last in (("base-", base - 1), ("batch-", base)):
        for name in named(spark, folder, kind):
            if int(name.removeprefix(kind)) <= last:
                delete(spark, f"{folder}/{name}")


def keep(stream: DataFrame, folder: str, checkpoint: str, keys: tuple[str, ...] = KEYS):
    """Add a stream of votes, micro-batch by micro-batch, each of them once; runs to the end of what is there."""
    from ..streaming.twins import each_batch

    return each_batch(stream, lambda votes, n: add_votes(votes, folder, n, keys), checkpoint)
