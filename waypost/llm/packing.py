"""Best-fit packing of documents into bins of equal capacity, under conflicts.

A document longer than a bin fills whole bins alone; what is left of it is an
item like any shorter document. Items go, longest first, into the open bin with
the least room that still holds them and whose documents they do not conflict
with: a bin takes one member of a duplicate cluster, and a bounded number of
one source. Bins are kept by the room they have left; each carries bitmaps of
its clusters and, per permitted repetition, of its sources. The search starts
at the smallest sufficient room and goes on to the next larger until a
compatible bin is found; only then a new one is opened.

Documents are dealt by a hash of their id, cluster and size into shards of a bounded
number of documents, each packed in one task, so the hottest source or cluster is spread
evenly. Equal rows are counted, and dealt by ``EQUAL_ROWS`` of them, so that any number
of them spreads too. Conflicts concern one bin, so shards do not weaken them.

Defined cases: a document without words has one row with no bin. Null sources
are one source; a null cluster conflicts with nothing. Ties in size go by
doc_id, null first, then by cluster. Repeated rows are packed each, none with another.
A very long text fills bins by its number of words alone. An empty table gives
no rows. Only doc_id, source and text (or cluster and size) are read, so further
columns may bear any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import WORD
from .near_dup import near_duplicates
from .workspace import written

CAPACITY = 2048
SHARD_DOCUMENTS = 4096
PER_SOURCE = 2
#: Equal rows that go into a shard together.
EQUAL_ROWS = 256
_PACKED = "doc_id long, source string, first_word long, words long, bin_id long, bin_words long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int = PER_SOURCE) -> list[int]:
    """The bin of every item, items taken in the order given; clusters below 0 conflict with nothing."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    some = 0  # bit r: a bin has room r
    cluster_bits: list[int] = []
    source_bits: list[list[int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        rest, found = some >> size, -1
        room = size - 1
        while rest and found < 0:
            step = (rest & -rest).bit_length()
            rest >>= step
            room += step
            found = next((b for b in rooms[room] if not (cluster_bits[b] & c or source_bits[b][-1] & s)), -1)
        if found < 0:
            found, room = len(cluster_bits), capacity
            cluster_bits.append(0)
            source_bits.append([0] * per_source)
        else:
            rooms[room].remove(found)
            if not rooms[room]:
                some &= ~(1 << room)
        cluster_bits[found] |= c
        for k, plane in enumerate(source_bits[found]):  # the first plane that lacks the source gets it
            if not plane & s:
                source_bits[found][k] |= s
                break
        left = room - size
        if left:
            rooms[left].append(found)
            some |= 1 << left
        out.append(found)
    return out


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """All pieces of one shard's documents: doc_id, first_word, words and number of the bin in the shard."""
    rows = rows.sort_values(["doc_id", "size", "cluster", "source"], na_position="first", kind="stable").reset_index(drop=True)
    size = rows["size"].to_numpy(dtype=np.int64)
    whole, rest = size // capacity, size % capacity
    owner = np.repeat(np.arange(len(rows)), whole)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
    items = np.flatnonzero(rest)
    items = items[np.argsort(-rest[items], kind="stable")]
    sources = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    repeated = rows["cluster"].notna() & rows["cluster"].duplicated(keep=False)
    clusters = pd.factorize(rows["cluster"].where(repeated))[0]  # a cluster of one needs no bit
    bins = best_fit(rest[items].tolist(), sources[items].tolist(), clusters[items].tolist(), capacity, per_source)
    owner, first = np.concatenate([owner, items]), np.concatenate([first, (whole * capacity)[items]])
    words = np.concatenate([np.full(len(owner) - len(items), capacity), rest[items]])
    number = np.concatenate([np.arange(len(owner) - len(items)), np.array(bins, dtype=np.int64) + len(owner) - len(items)])
    total = np.bincount(number, weights=words) if len(number) else np.zeros(0)
    out = pd.DataFrame({"row": owner, "first_word": first, "words": words, "bin_id": number, "bin_words": total[number].astype(np.int64)})
    return rows[["doc_id", "source"]].iloc[out["row"]].reset_index(drop=True).join(out.drop(columns="row"))


def pack(items: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """items (doc_id, source, cluster, size) -> doc_id, source, first_word, words, bin_id, bin_words; a row per piece."""
    rows = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "cluster", "size")
    rows = written(rows, "items")
    filled = rows.where("size > 0")
    shards = max(1, -(-filled.count() // shard_documents))
    # a row for each kind and each block of its equal rows; most kinds have one row
    kinds = filled.groupBy("doc_id", "source", "cluster", "size").agg(F.count(F.lit(1)).alias("rows"))
    blocks = kinds.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / EQUAL_ROWS))))
    of = F.xxhash64("doc_id", "cluster", "size", F.lit(4))
    sharded = blocks.select(
        "doc_id", "source", "cluster", "size",
        F.least(F.col("rows") - F.col("block") * EQUAL_ROWS, F.lit(EQUAL_ROWS)).alias("rows"),
        F.pmod(F.when(F.col("block") == 0, of).otherwise(F.xxhash64(of, "block")), F.lit(shards)).alias("shard"),
    )

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.loc[own.index.repeat(own["rows"])].drop(columns="rows")
        out = pack_shard(own, capacity, per_source)
        out["bin_id"] += int(key[0]) << 32
        return out

    packed = sharded.groupBy("shard").applyInPandas(run, _PACKED)
    none = F.lit(None).cast("long")
    empty = rows.where("size <= 0 or size is null").select(
        "doc_id", "source", F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("words"), none.alias("bin_id"), none.alias("bin_words")
    )
    return packed.unionByName(empty)


def items_key() -> Column:
    """The same for equal texts."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text, F.length(text))


def items_of(documents: DataFrame) -> DataFrame:
    """documents (doc_id, source, text) as items: sizes in words, exact copies as clusters."""
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return documents.select("doc_id", "source", items_key().alias("cluster"), size.alias("size"))


def near_items_of(documents: DataFrame) -> DataFrame:
    """Items whose clusters are the components of near duplicates (``near_dup``), by text: also of rows without an id."""
    items = items_of(documents)
    texts = documents.select(items_key().alias("doc_id"), "text").where("text is not null").dropDuplicates(["doc_id"])
    groups = near_duplicates(written(texts, "texts")).select(F.col("doc_id").alias("cluster"), "component_id")
    joined = items.join(groups, "cluster", "left")
    return joined.select("doc_id", "source", F.coalesce("component_id", "cluster").alias("cluster"), "size")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    return pack(items_of(documents), capacity, per_source)
