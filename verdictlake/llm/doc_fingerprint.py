"""SimHash document fingerprints and block tables, with DataFrame functions only.

Every occurrence of a term (two words in a row) votes with the bits of its hash,
so a term weighs as often as it occurs; a bit of the fingerprint is set when more
than half of the votes are for it. Votes are counted in packed longs: eight
counters of 8 bits each for up to 127 votes, then two of 32 bits each, which keeps
the sums in generated code and 20 bytes wide per term instead of a thousand.

`with_next` gives each document the one that follows in descending order of
doc_id. Documents are dealt once, by ranges of doc_id with about equally many
rows; the head of the range below joins each range as an extra last row. All the
counting happens where that deal has put the rows: nothing else moves but
fingerprints.

Defined results: a null text is empty; a text without terms has fingerprint zero
(one word is a term of its own); a null doc_id sorts after all others; rows that
repeat a doc_id are ordered by a hash of their texts; a table of one row has itself
as next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, text_or_empty

LONGS = 2  # of 64 bits
#: Fingerprints are searched for within RADIUS bits of those of documents whose id EVERY divides.
RADIUS, BLOCKS, EVERY = 3, 5, 20
VOTES = 127
RANGE_ROWS, MAX_RANGES = 512, 65_535
_BYTE = 0x0101010101010101


def terms(text: Column) -> Column:
    """Hashes of all terms of a text, one for each occurrence."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text) -> (keys, fp0, fp1). `keys` identify a row; their first should be what rows are dealt by, so that nothing moves."""
    t = rows.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("_at", "_term"))
    t = t.withColumn("_part", F.coalesce(F.floor(F.col("_at") / VOTES), F.lit(0)))
    hashes = {f"_h{i}": F.xxhash64("_term", F.lit(i)) for i in range(LONGS)}
    packed = [F.sum(F.shiftrightunsigned(F.col(f"_h{i}"), s).bitwiseAND(F.lit(_BYTE))).alias(f"_p{i}_{s}") for i in range(LONGS) for s in range(8)]
    parts = t.withColumns(hashes).groupBy(*keys, "_part").agg(F.count("_term").alias("_n"), *packed)
    # counter j of the sum for shift s counts bit 8 * j + s; counters j and j + 4 share a long now
    wide = 0x000000FF000000FF
    sums = [F.sum(F.shiftrightunsigned(F.col(f"_p{i}_{s}"), 8 * j).bitwiseAND(F.lit(wide))).alias(f"_w{i}_{8 * j + s}") for i in range(LONGS) for s in range(8) for j in range(4)]
    whole = parts.groupBy(*keys).agg(F.sum("_n").alias("_n"), *sums)

    def bits(i: int) -> Column:
        out = F.lit(0).cast("long")
        for b in range(32):
            low = F.col(f"_w{i}_{b}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(F.col(f"_w{i}_{b}"), 32)
            for at, votes in ((b, low), (b + 32, high)):
                one = 1 << at if at < 63 else -(1 << 63)
                out = out.bitwiseOR(F.when((votes * 2 > F.col("_n")) & (F.col("_n") > 0), F.lit(one)).otherwise(F.lit(0)).cast("long"))
        return out

    return whole.select(*keys, *[bits(i).alias(f"fp{i}") for i in range(LONGS)])


def _range_of(bounds: list[int]) -> Column:
    """Number of bounds (sorted) at or below doc_id, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, len(bounds)).bit_length() - 1, -1, -1)])
    held = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")  # one literal, however many
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) <= F.col("doc_id"), F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(range, doc_id, h, text, next_id, next_h, next_text)."""
    d = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    n = d.count()
    k = min(MAX_RANGES, n // range_rows)
    shares = [i / (k + 1) for i in range(1, k + 1)]
    bounds = sorted(set(d.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] or [])) if shares else []
    d = d.withColumn("range", _range_of(bounds))
    heads = d.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("head"))  # at most MAX_RANGES + 1 rows
    order = Window.orderBy("range")
    ends = Window.partitionBy()
    heads = heads.select(F.col("head.*"), F.coalesce(F.lead("range").over(order), F.min("range").over(ends)).alias("into"))
    extra = d.join(F.broadcast(heads.withColumnsRenamed({"doc_id": "_id", "h": "_h"})), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    extra = extra.select("doc_id", "text", "h", F.col("into").alias("range"), F.lit(1).alias("extra")).dropDuplicates(["doc_id", "h", "range"])
    both = d.withColumn("extra", F.lit(0)).select("doc_id", "text", "h", "range", "extra").union(extra)
    after = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return both.withColumns({f"next_{name}": F.lead(c).over(after) for name, c in (("id", "doc_id"), ("h", "h"), ("text", "text"))}).where("extra = 0").drop("extra")


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    off = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    return 1 - off / F.lit(64.0 * LONGS)


def hexed(*parts: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(p)), 16, "0") for p in parts]))


def near_counts(fps: DataFrame, every: int = EVERY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp0, fp1) -> (fp0, fp1, n_near): rows within the radius, itself left out, for the fingerprints of ids that `every` divides.

    Equal fingerprints are searched for once and stand in the block tables once, with their number.
    """
    index = save(fps.groupBy("fp0", "fp1").agg(F.count("*").alias("n")).withColumn("id", F.struct("fp0", "fp1")), "fingerprint-index")
    queries = fps.where(F.col("doc_id") % every == 0).select("fp0", "fp1").distinct().withColumn("id", F.struct("fp0", "fp1"))
    found = search(queries, index, radius, blocks).join(index.select("id", "n"), "id")
    return found.groupBy("query_id").agg((F.sum("n") - 1).alias("n_near")).select("query_id.*", "n_near")


def fingerprint_pairs(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    n_near: other documents whose fingerprints the block tables find within RADIUS bits; null for ids that `every` does not divide.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    # `row` keeps rows apart that repeat all else; it lives only in the stage that makes it
    keys = ["range", "doc_id", "h", "next_id", "next_h", "n_chars", "sha", "side"]
    rows = rows.withColumns({"sha": F.unhex(F.sha2("edited", 256)), "row": F.monotonically_increasing_id()})
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))
    sides = rows.select(*keys[:-1], "row", F.inline(sides))
    fps = simhash(sides, [*keys, "row"], "t")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    fps = fps.groupBy(*keys[:-1], "row").agg(*[pick(s, f"fp{i}").alias(f"{name}{i}") for s, name in enumerate(("own", "edited")) for i in range(LONGS)])
    fps = save(fps, "fingerprints")
    own, edited, after = (tuple(f"{name}{i}" for i in range(LONGS)) for name in ("own", "edited", "after"))
    of_next = fps.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), *[F.col(o).alias(a) for o, a in zip(own, after, strict=True)]).dropDuplicates(["_id", "_h"])
    out = fps.join(of_next, F.col("next_id").eqNullSafe(F.col("_id")) & (F.col("next_h") == F.col("_h")), "left")
    near = save(near_counts(fps.select("doc_id", *[F.col(o).alias(f"fp{i}") for i, o in enumerate(own)]), every), "fingerprint-near")
    out = out.join(near, (F.col("doc_id") % every == 0) & (F.col(own[0]) == F.col("fp0")) & (F.col(own[1]) == F.col("fp1")), "left")
    return out.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        hexed(*own).alias("fingerprint"),
        hexed(*edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, after).alias("near_next"),
        "n_near",
    )


def block_tables(fps: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """(id, fp0, fp1) -> a row for each table and fingerprint: table, key, and all columns.

    The bits are cut into `blocks` blocks; each table puts another `blocks - radius`
    of them first. Two fingerprints within the radius differ in at most `radius`
    blocks, so the first blocks of some table agree.
    """
    from itertools import combinations

    blocks = blocks or radius + 1
    width = 64 * LONGS // blocks

    def block(b: int) -> Column:
        text = F.concat(*[F.lpad(F.conv(F.hex(F.col(f"fp{i}")), 16, 2), 64, "0") for i in range(LONGS)])
        return F.substring(text, b * width + 1, width if b < blocks - 1 else 64 * LONGS)

    tables = [F.struct(F.lit(t).alias("table"), F.xxhash64(*[block(b) for b in chosen]).alias("key")) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    return fps.select("*", F.inline(F.array(*tables)))


def search(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All index entries within `radius` bits of each query: query_id, id, distance. Both: (id, fp0, fp1)."""
    q = block_tables(queries, radius, blocks).withColumnsRenamed({"id": "query_id", "fp0": "q0", "fp1": "q1"})
    i = block_tables(index, radius, blocks)
    off = F.bit_count(F.col("fp0").bitwiseXOR(F.col("q0"))) + F.bit_count(F.col("fp1").bitwiseXOR(F.col("q1")))
    return q.join(i, ["table", "key"]).withColumn("distance", off).where(F.col("distance") <= radius).select("query_id", "id", "distance").distinct()
