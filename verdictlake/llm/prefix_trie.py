"""The trie of conversations that share their first turns.

A conversation is told by 128-bit digests of its prefixes. Of each prefix the least
conversation that has it owns it; owning one, a conversation owns all longer ones of
its own, so what it owns is a chain, from its first owned depth to its end. That depth
is searched by halving: every round joins one prefix of each conversation with the
table of prefix minima. Chains form a tree (a chain hangs on the node above its first),
whose sums are made from the ends up, each round over paths twice as long, so that
rounds grow with the logarithm of the depth. What is left is a running sum along each
chain.

No text moves beyond its own conversation, and nothing is gathered per node: counts and
minima are summed up before they are shuffled, a chain is a sorted run of rows, and the
hash of many equal conversations streams over their sorted ids.

`rebuilt` gives each conversation the first turns of the one that its hundred starts
with, as the query asks.

Defined results: rows without conv_id are no conversation; turns that repeat a turn
number (nulls come first) follow by role and text, repeated rows count as turns; null
role or text is empty; an empty table gives no rows, not even a root; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, in_arrow, save

BLOCK, SHARES = 100, 6
_NODE = ["depth", "x", "y"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, x, y: digest of the turn, chars)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    lanes = (F.xxhash64(F.lit(n), "role", "text").alias(c) for n, c in enumerate("xy"))
    return t.select("conv_id", F.row_number().over(in_order).cast("long").alias("pos"), *lanes, F.char_length("text").cast("long").alias("chars"))


def rebuilt(t: DataFrame, block: int = BLOCK, shares: int = SHARES) -> tuple[DataFrame, DataFrame]:
    """Turns of all rebuilt conversations, (conv_id, depth, x, y, chars), and their lengths, (conv_id, len).

    The first h turns come from the conversation that the block of ids starts with.
    """
    own = t.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.col("conv_id") - F.col("conv_id") % block
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares
    convs = own.select("conv_id", "n", head.alias("head"), share.alias("share"))
    heads = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    convs = convs.join(heads, "head", "left").select("conv_id", "n", "head", "share", F.least("share", F.coalesce("head_n", F.lit(0).cast("long"))).alias("given"))
    first = t.where((F.col("conv_id") % block == 0) & (F.col("pos") < shares)).withColumnRenamed("conv_id", "head")
    given = first.join(convs, "head").where("pos <= given").select("conv_id", F.col("pos").alias("depth"), "x", "y", "chars")
    rest = t.join(convs, "conv_id").where("pos > share").select("conv_id", (F.col("pos") - F.col("share") + F.col("given")).alias("depth"), "x", "y", "chars")
    return given.union(rest), convs.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("share"), F.lit(0))).alias("len"))


def prefixes(t: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth from 0, x, y: digest of the prefix, chars of its last turn, len)."""
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("x", "y", "chars")])
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    placed = (F.when(F.col("depth") > 0, F.xxhash64(F.lit(n), "depth", "x", "y")).otherwise(F.lit(0).cast("long")) for n in range(2))
    p = root.union(t.select(*root.columns)).select("conv_id", "depth", "chars", *[c.alias(n) for n, c in zip("xy", placed, strict=True)])
    return p.select("conv_id", "depth", *[F.bit_xor(c).over(so_far).alias(c) for c in "xy"], "chars", F.max("depth").over(Window.partitionBy("conv_id")).alias("len"))


def first_owned(p: DataFrame, minima: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, len, low): the least depth at which a conversation is the least of its prefix; len + 1 where at none."""
    owners = minima.select(*_NODE, "owner")
    state = save(p.where("depth = len").select("conv_id", "len", F.lit(0).cast("long").alias("low"), (F.col("len") + 1).alias("high")), "trie-search")
    for _ in range((deepest + 1).bit_length()):
        mid = state.withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        probe = mid.where("low < high").join(p.select("conv_id", *_NODE), ["conv_id", "depth"]).join(owners, _NODE)
        found = probe.select("conv_id", "depth", (F.col("owner") == F.col("conv_id")).alias("owned"))
        after = state.join(found, "conv_id", "left").select(
            "conv_id", "len", F.when(~F.col("owned"), F.col("depth") + 1).otherwise(F.col("low")).alias("low"), F.when(F.col("owned"), F.col("depth")).otherwise(F.col("high")).alias("high")
        )
        after = save(after, "trie-search")
        forget(state)
        state = after
    return state.select("conv_id", "len", "low")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, x, y, conv_id), sorted -> hash of the ids of each node, read as a stream."""
    at, digest = None, hashlib.sha256()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in at] + [pa.array([digest.hexdigest()])], [*_NODE, "sha"])

    for batch in batches:
        if not batch.num_rows:
            continue
        node, ids = np.stack([c.to_numpy() for c in batch.columns[:3]]), batch.column(3).to_pylist()
        edges = [0, *(np.flatnonzero((node[:, 1:] != node[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key, part = tuple(node[:, a].tolist()), ",".join(map(str, ids[a:b]))
            if key == at:
                part = "," + part
            elif at is not None:
                yield out()
            if key != at:
                at, digest = key, hashlib.sha256()
            digest.update(part.encode())
    if at is not None:
        yield out()


def ends(p: DataFrame, minima: DataFrame) -> DataFrame:
    """(depth, x, y, sha): hash of the ids of the conversations that end at a node, where several do."""
    several = minima.where("n_ends > 1").select(*_NODE)
    rows = p.where("depth = len").join(several, _NODE, "left_semi").select(*_NODE, "conv_id")
    return in_arrow(rows.repartition(*_NODE).sortWithinPartitions(*_NODE, "conv_id"), _hashed, "depth long, x long, y long, sha string")


def chain_sums(chains: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, parent, leaf, saved) -> the same with sums over all chains below, over paths twice as long each round."""
    for _ in range((deepest + 1).bit_length()):
        below = chains.where("parent is not null").groupBy(F.col("parent").alias("conv_id")).agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
        above = chains.where("parent is not null").select(F.col("conv_id").alias("parent"), F.col("parent").alias("next"))
        after = chains.join(below, "conv_id", "left").join(above, "parent", "left")
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaf", "saved")]
        after = save(after.select("conv_id", F.col("next").alias("parent"), *sums), "trie-sums")
        if hasattr(chains, "_saved_at"):
            forget(chains)
        chains = after
    return chains.select("conv_id", "leaf", "saved")


def trie(t: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns and lengths of conversations -> one row for each node.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (what equal prefixes repeat, in code points), ends_sha256.
    """
    p = save(prefixes(t, convs), "trie-prefixes")
    end = F.when(F.col("depth") == F.col("len"), F.col("conv_id"))
    minima = save(p.groupBy(*_NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.count(end).alias("n_ends"), F.min(end).alias("end")), "trie-minima")
    deepest = p.agg(F.max("len")).first()[0] or 0
    first = save(first_owned(p, minima, deepest).where("low <= len"), "trie-first")
    nodes = p.join(first.select("conv_id", "low"), "conv_id").where("depth >= low").join(minima, _NODE)
    nodes = save(nodes.select("conv_id", "depth", "x", "y", "len", "low", "n_convs", "n_ends", "end", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-nodes")
    # where chains hang: the owner of the prefix above the first owned one
    hangs = first.where("low > 0").select("conv_id", "low", (F.col("low") - 1).alias("depth")).join(p.select("conv_id", *_NODE), ["conv_id", "depth"])
    hangs = save(hangs.join(minima.select(*_NODE, "owner"), _NODE).select("conv_id", F.col("owner").alias("parent"), "depth"), "trie-hangs")
    held = hangs.groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count("*").alias("held"))
    own = nodes.join(held, ["conv_id", "depth"], "left")
    last = (F.col("depth") == F.col("len")) & F.col("held").isNull()
    own = own.groupBy("conv_id").agg(F.sum(last.cast("long")).alias("leaf"), F.sum("saved").alias("saved"))
    sums = chain_sums(own.join(hangs.select("conv_id", "parent"), "conv_id", "left").select("conv_id", "parent", "leaf", "saved"), deepest)
    below = hangs.join(sums, "conv_id").groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count("*").alias("held"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("more"))
    joined = nodes.join(below, ["conv_id", "depth"], "left").join(ends(p, minima), _NODE, "left")
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)

    def number(c: Column | str) -> Column:
        return F.coalesce(c, F.lit(0).cast("long"))

    leaf = F.when((F.col("depth") == F.col("len")) & F.col("held").isNull(), 1).otherwise(number("leaf"))
    parent = joined.join(hangs.select("conv_id", "parent"), "conv_id", "left")
    sha = F.when(F.col("n_ends") > 1, F.col("sha")).otherwise(F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256))
    return parent.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("low"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        (number("held") + F.when(F.col("depth") < F.col("len"), 1).otherwise(0)).alias("n_children"),
        F.sum(leaf).over(from_end).alias("n_leaves"),
        F.sum(F.col("saved") + number("more")).over(from_end).alias("saved_tokens"),
        sha.alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    t = save(turns(conversations), "trie-turns")
    return trie(*rebuilt(t))
