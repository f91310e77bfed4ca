"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

1. Sources, by code point with null last, get weights 5, 2, 1, 5, 2, 1, ...
   and share a multiple of all words. A target stops at twice its source's
   size; what it leaves is shared by weight among the others until none is
   above (water filling, in closed form over the sources by cap / weight).
2. The mix is a number of equal blocks of words. Sainte-Lague gives each source
   the blocks with the highest quotients target / (2k - 1), and by its size each
   group of shards of a source, and each shard of a group, the highest quotients
   of what is above it; a shard gets two passes over its blocks at most, and what
   it leaves goes to the next quotients.
3. A shard lays its documents in seeded order as one stream and cuts it into
   blocks. Every block is taken quota // blocks times; of the quota % blocks left
   each falls on a block of its own, evenly spaced over the stream from a seeded
   start. A document's taken words are its overlaps with taken blocks, so none
   exceeds twice its size.

A shard is a hash of the document's id and text within its source and holds a
bounded number of words on average, a group a bounded number of shards, so a
source of any share is many shards and many windows. Only the table of sources
is ordered in one place.

Defined cases: a null text, or one without words, has size 0 and takes 0. Rows
of a null source are a source of their own, the last. Rows of one id, or of
none, are told apart by their text. A source without words has target 0. Equal
rows may swap; nothing else in the result depends on the order in which rows
arrive. A very long text counts as any other, its words lie in many blocks. An
empty table gives an empty result. ``keep`` names columns to carry along; other
columns are not read, so they may bear any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 2
SHARD_WORDS = 1 << 17
#: Shards of a group.
GROUP_SHARDS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size) -> source, source_size, target; one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    # In order of cap / weight, those before the first that keeps below its cap are capped.
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rate = (F.sum("source_size").over(every) * (percent / 100.0) - capped) / weight_left
    table = table.withColumn("rate", rate).withColumn("open", F.col("rate") * F.col("weight") < F.col("cap"))
    rate = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rate").alias("rate")))).over(every)["rate"]
    target = F.when(F.col("rate0").isNull(), F.col("cap")).otherwise(F.least(F.col("rate0") * F.col("weight"), "cap"))
    return table.withColumn("rate0", rate).select("source", "source_size", target.alias("target"))


def sainte_lague(table: DataFrame, groups: list[str], weight: str, seats: Column, key: list[str], out: str, most: Column | None = None) -> DataFrame:
    """Share ``seats`` whole units of every group among its rows; adds column ``out``.

    A row's k-th unit has the quotient weight / (2k - 1) and the highest
    quotients win; ties go by ``key``. With n rows, the units that the divisors
    total / (seats - n/2) and total / (seats + n/2) give bracket the result, so
    only the at most 2n quotients between them are ranked. ``key`` with
    ``groups`` must tell the rows apart. A row gets ``most`` units at most; the
    units that it leaves win the next quotients of the other rows.
    """
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    held = table.withColumn("_seats", seats.cast("long")).withColumn("_half", F.count(F.lit(1)).over(own) / 2)
    if most is None:
        full = F.sum(weight).over(own)
        rate = lambda s: F.when(full > 0, s / full).otherwise(F.lit(0.0))
        bounded = lambda n: n
    else:
        # rows that are full hold their bound, the others have units in proportion: the largest of the rates
        # at which the first rows by bound / weight are full
        held = held.withColumn("_most", F.greatest(most, F.lit(0)).cast("long"))
        filled = own.orderBy(F.when(F.col(weight) > 0, F.col("_most") / F.col(weight)).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in key))
        held = held.withColumn("_full", F.coalesce(F.sum("_most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        held = held.withColumn("_rest", F.sum(weight).over(filled.rowsBetween(0, Window.unboundedFollowing)))
        rate = lambda s: F.coalesce(F.max(F.when(F.col("_rest") > 0, (s - F.col("_full")) / F.col("_rest"))).over(own), F.lit(0.0))
        bounded = lambda n: F.least(n, F.col("_most"))
    held = held.withColumn("_slow", rate(F.col("_seats") - F.col("_half"))).withColumn("_fast", rate(F.col("_seats") + F.col("_half")))
    low = bounded(F.greatest(F.floor(F.col(weight) * F.col("_slow") + 0.5 - 1e-9), F.lit(0))).cast("long")
    held = held.withColumn("_low", F.when(F.col("_seats") > 0, low).otherwise(F.lit(0).cast("long")))
    high = bounded(F.floor(F.col(weight) * F.col("_fast") + 0.5 + 1e-9)).cast("long")
    held = held.withColumn("_high", F.when(F.col("_seats") > 0, F.greatest(high, F.col("_low"))).otherwise(F.col("_low")))
    held = held.withColumn("_open", F.col("_seats") - F.sum("_low").over(own))
    units = held.where("_high > _low").select("*", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    order = [(F.col(weight) / (2 * F.col("_k") - 1)).desc(), *(F.col(c).asc_nulls_last() for c in key), F.col("_k")]
    won = units.withColumn("_rank", F.row_number().over(own.orderBy(*order))).where("_rank <= _open")
    names = [*groups, *key]
    won = won.groupBy(*names).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*(F.col(c).alias(f"_{c}") for c in names), "_won")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    joined = held.join(won, same, "left")
    return joined.select(*table.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias(out))


def mix_sources(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = 150,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 17,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """documents (doc_id, source, text and those to keep) -> doc_id, size, source_size, target, taken and those kept."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.xxhash64("text").alias("text_hash"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        *keep,
    )
    rows = written(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, percent)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words)
    plan = written(sainte_lague(targets, [], "target", seats, ["source"], "blocks"), "plan")

    plan_s = plan.select(F.col("source").alias("name"), "source_size", "target", "blocks")
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    place = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), shards)
    known = rows.join(plan_s, F.col("source").eqNullSafe(F.col("name")))
    known = known.select("doc_id", "text_hash", "size", "name", "source_size", "target", "blocks", place.alias("shard"), *keep)
    placed = known.where("size > 0")
    shard = (
        placed.groupBy("name", "shard")
        .agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
        .withColumn("shard_blocks", F.ceil(F.col("shard_size") / block_words))
        .withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    )
    twice = 2 * F.col("shard_blocks")
    group = shard.groupBy("name", "group").agg(F.sum("shard_size").alias("group_size"), F.sum(twice).alias("group_most"), F.first("blocks").alias("blocks"))
    group = sainte_lague(group, ["name"], "group_size", F.col("blocks"), ["group"], "group_quota", F.col("group_most"))
    group = group.select(F.col("name").alias("g_name"), F.col("group").alias("g"), "group_quota")
    shard = shard.join(group, F.col("name").eqNullSafe(F.col("g_name")) & (F.col("group") == F.col("g"))).drop("g_name", "g")
    quotas = written(sainte_lague(shard, ["name", "group"], "shard_size", F.col("group_quota"), ["shard"], "quota", twice), "quotas")

    q = quotas.select(F.col("name").alias("q_name"), F.col("shard").alias("q_shard"), "shard_blocks", "quota")
    by_shard = placed.join(q, F.col("name").eqNullSafe(F.col("q_name")) & (F.col("shard") == F.col("q_shard")))
    seeded = F.xxhash64("doc_id", "text_hash", F.lit(seed + 1))
    stream = Window.partitionBy("name", "shard").orderBy(seeded, "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = by_shard.withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size"))
    laid = laid.withColumn("shift", F.pmod(F.xxhash64("name", "shard", F.lit(seed + 2)), F.col("shard_blocks")))
    laid = laid.withColumn("extra", F.col("quota") % F.col("shard_blocks"))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words)
    # whole blocks from the first to the last, less what of these two lies outside the document
    whole = (_upto(last + 1) - _upto(first)) * block_words
    before = (_upto(first + 1) - _upto(first)) * (F.col("start") - first * block_words)
    behind = (_upto(last + 1) - _upto(last)) * ((last + 1) * block_words - F.col("end"))
    passes = F.floor(F.col("quota") / F.col("shard_blocks"))
    taken = passes * F.col("size") + whole - before - behind
    out = ["doc_id", "size", "source_size", F.col("target").cast("double").alias("target")]
    empty = known.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"), *keep)
    return laid.select(*out, taken.cast("long").alias("taken"), *keep).unionAll(empty)


def _upto(block: Column) -> Column:
    """How many of the blocks before ``block`` are taken once more.

    Exactly ``extra`` of any ``shard_blocks`` consecutive steps cross a multiple
    of ``shard_blocks`` when each step is ``extra`` long; ``shift`` is the start.
    """
    return F.floor((block + F.col("shift")) * F.col("extra") / F.col("shard_blocks"))
