"""The trie of the turns that conversations begin with, and what sharing them saves.

Conversations that begin with the same turns share the nodes of these turns. A
node is told by its depth and 128 bits that are the exclusive-or of a hash of
each turn with its depth, so the nodes of a path are a running aggregate, and a
long conversation is worked out by many tasks (``scans``).

Sums over subtrees go up by bands of ``BAND`` depths. Within a band a node adds
its own figures to its ancestors of the band only, which are on the path of any
conversation below it; nodes of one conversation are added up first, so no more
rows come of it than there are turns. The first nodes of all bands are a trie
themselves, as many times lower as a band is high, and are summed by the same
rule; a total of theirs is final then, and goes to the ancestors in the band
above. So rounds grow with the logarithm of the depth, and rows not at all.

Rows without a conversation id take no part. Null roles and texts are empty.
Turns are ordered by number, null first; equal numbers by a hash of role and
text, so repeated rows stand next to each other and are turns of their own.
Texts of any length become a hash and a length at once. An empty table has no
nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from .lookups import look_up
from .workspace import drop, written

#: Depths of a band.
BAND = 16
#: Conversation ids of one piece of a list of ids lie in a range of so many.
ID_RANGE = 4096
#: A conversation begins with up to so many turns less one of the first of its hundred.
HEADS, GROUP = 6, 100

_NODE = ["depth", "p", "q"]


def _head_length(conv: str | Column) -> Column:
    return F.crc32(F.col(conv).cast("string").cast("binary")) % HEADS


def _hashes(*what: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), *what), F.xxhash64(F.lit(2), *what)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, size): the hash of role and text in two halves, the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    a, b = _hashes(role, text)
    known = conversations.where("conv_id is not null")
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", a.alias("a"), b.alias("b"), F.length(text).cast("long").alias("size"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Turns with their place ``pos`` in the conversation, from 1, and the partition they were worked out in."""
    order = [F.asc_nulls_first("turn"), "a", "b"]
    dealt = scans.ranged(turns, ["conv_id"], order)
    out = written(scans.accumulate(dealt, ["conv_id"], order, {"pos": ("sum", F.lit(1).cast("long"))}).drop("turn"), "turns")
    drop(dealt)
    return out


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Turns of conversations rebuilt to begin like the first of their hundred: conv_id, depth, a, b, size, ends.

    Depth 0 is the beginning, which every conversation has; ``ends`` marks a
    conversation's last row. At most five turns of a first conversation are
    gathered in one row.
    """
    head = F.array_sort(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("head")
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(head)
    pieces = turns.groupBy("conv_id", scans.PART).agg(F.max("pos").alias("upto"))
    convs = pieces.groupBy("conv_id").agg(F.max("upto").alias("n")).withColumns({"h": _head_length("conv_id"), "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    convs = convs.join(first, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(first.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("k", F.size("head").cast("long")).withColumn("last", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "h", "k", "last", "head"), "convs")
    shift = pieces.select("conv_id", scans.PART).join(convs.select("conv_id", "h", "k", "last"), "conv_id")
    depth = F.col("k") + F.col("pos") - F.col("h")
    own = turns.join(shift, ["conv_id", scans.PART]).where("pos > h").select("conv_id", scans.PART, depth.alias("depth"), "a", "b", "size", (depth == F.col("last")).alias("ends"))
    zero = F.lit(0).cast("long")
    start = F.array(F.struct(zero.alias("pos"), zero.alias("a"), zero.alias("b"), zero.alias("size")))
    taken = convs.select("conv_id", "last", F.explode(F.concat(start, "head")).alias("t"))
    taken = taken.select("conv_id", F.lit(-1).alias(scans.PART), F.col("t.pos").alias("depth"), "t.a", "t.b", "t.size", (F.col("t.pos") == F.col("last")).alias("ends"))
    return own.unionByName(taken)


def paths_of(rebuilt: DataFrame) -> DataFrame:
    """Every turn with its node (depth, p, q) and that of the turn before (p and q of ``up_p``, ``up_q``)."""
    mixed = F.when(F.col("depth") > 0, F.xxhash64(F.lit(1), "depth", "a", "b")).otherwise(0), F.when(F.col("depth") > 0, F.xxhash64(F.lit(2), "depth", "a", "b")).otherwise(0)
    rows = rebuilt.select("conv_id", scans.PART, "depth", "size", "ends", mixed[0].alias("x"), mixed[1].alias("y"))
    rows = scans.accumulate(rows, ["conv_id"], ["depth"], {"p": ("xor", F.col("x")), "q": ("xor", F.col("y"))})
    up = [F.col(p).bitwiseXOR(F.col(x)).alias(f"up_{p}") for p, x in (("p", "x"), ("q", "y"))]
    return rows.select("conv_id", *_NODE, *up, "size", "ends")


def nodes_of(paths: DataFrame) -> DataFrame:
    """A row per node: its smallest conversation, members, the last text's length, and its parent."""
    same = lambda c: F.min(c).alias(c)
    return paths.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), same("size"), same("up_p"), same("up_q"))


def _in_band(values: DataFrame, paths: DataFrame, step: int, first_only: bool = False) -> DataFrame:
    """Values of (conv_id, band, depth, leaves, saved) added up at the nodes of the conversation's path in the band.

    A value counts for nodes at its own depth and above. ``step`` is the
    distance of the depths in question; ``first_only`` asks for the first node
    of each band alone.
    """
    band = F.floor(F.col("depth") / (step * BAND)).alias("band")
    on = paths.where(F.col("depth") % (step * BAND if first_only else step) == 0)
    path = on.select("conv_id", band, F.struct(*_NODE).alias("node")).groupBy("conv_id", "band").agg(F.collect_list("node").alias("path"))
    given = values.groupBy("conv_id", "band").agg(F.collect_list(F.struct("depth", "leaves", "saved")).alias("given"))  # one at most of a depth
    at = given.join(path, ["conv_id", "band"]).select("given", F.explode("path").alias("n"))
    below = lambda c: F.aggregate("given", F.lit(0).cast("long"), lambda s, v: s + F.when(v["depth"] >= F.col("n.depth"), v[c]).otherwise(0)).alias(c)
    sums = at.select("n.*", below("leaves"), below("saved"))
    return sums.groupBy(*_NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_sums(nodes: DataFrame, paths: DataFrame, deepest: int, step: int = 1) -> DataFrame:
    """``leaves`` and ``saved`` of nodes (depth, p, q, conv_id) at multiples of ``step``, summed over their subtrees."""
    height = step * BAND
    own = nodes.select("conv_id", F.floor(F.col("depth") / height).alias("band"), "depth", "leaves", "saved")
    if deepest < height:  # a single band
        return _in_band(own, paths, step)
    firsts = nodes.where(F.col("depth") % height == 0).select(*_NODE, "conv_id")
    within = written(firsts.join(_in_band(own, paths, step, first_only=True), _NODE), "bands")
    done = subtree_sums(within, paths, deepest, height)
    done = written(firsts.join(done, _NODE), "totals")
    drop(within)
    upward = done.where("depth > 0").select("conv_id", (F.col("depth") / height - 1).cast("long").alias("band"), "depth", "leaves", "saved")
    return _in_band(own.unionByName(upward), paths, step)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of texts that come in pieces, in order, a node's one after the other."""
    node, digest = None, None
    out = lambda: pa.RecordBatch.from_pylist([dict(zip(_NODE, node, strict=True)) | {"ends_sha256": digest.hexdigest()}], pa.schema([(c, pa.int64()) for c in _NODE] + [("ends_sha256", pa.string())]))
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*_NODE, "ids"]), strict=True):
            if key != node:
                if node is not None:
                    yield out()
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield out()


def ends_digests(paths: DataFrame) -> DataFrame:
    """The digest of the ids of the conversations that end at a node, for each node that has some.

    Ids are put together in ranges of ``ID_RANGE``, side by side. A node whose
    ids lie in several ranges has its pieces pass through one task in order,
    one after the other, as a digest must, never as one text.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = written(paths.where("ends").groupBy(*_NODE, F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(ids.alias("ids")), "ids")
    many = chunks.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n"), F.min("range").alias("range"))
    short = chunks.join(many.where("n = 1"), [*_NODE, "range"], "left_semi")
    long = chunks.join(many.where("n > 1").select(*_NODE), _NODE, "left_semi")
    in_order = long.repartition(*_NODE).sortWithinPartitions(*_NODE, "range").select(*_NODE, "ids")
    streamed = in_order.mapInArrow(_digests, "depth long, p long, q long, ends_sha256 string")
    return short.select(*_NODE, F.sha2("ids", 256).alias("ends_sha256")).unionByName(streamed)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = numbered_turns(turns_of(conversations))
    paths = written(paths_of(with_shared_heads(turns)), "paths")
    drop(turns)
    nodes = written(nodes_of(paths), "nodes")
    found = nodes.agg(F.max("depth").alias("deepest"), F.count(F.lit(1)).alias("n")).first()
    below = nodes.where("depth > 0")
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("size")
    leaves = F.when(F.col("n_children") > 0, 0).otherwise(1).cast("long")
    known = nodes.join(children, _NODE, "left").fillna({"n_children": 0}).withColumns({"leaves": leaves, "saved": saved})
    known = written(known, "nodes")
    drop(nodes)
    parents = known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("uses"))
    linked = look_up(known.drop("leaves", "saved"), parents, found.n, ["depth", "up_p", "up_q"])
    sums = subtree_sums(known, paths, found.deepest or 0)
    sums = sums.select(*_NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    rows = linked.join(sums, _NODE).join(ends_digests(paths), _NODE, "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))
