"""A corpus-cleaning pipeline over ``documents``, built from the corpus operators.

Each stage takes and returns a table with the columns of ``documents``, any
further columns included, whatever their names; the last one returns the packed
pieces.

Defined cases: documents with a null, empty or blank text hold no letter and go
in the first stage. Rows with a null doc_id lose no lines, are never taken for
duplicates and are mixed and packed like others. Rows of one doc_id with
different texts are different documents; equal rows are one document, of which
near-dedup keeps one. A null source is a source, a null lang is not learnt from.
Ties go to the smallest doc_id, then to a hash of the text. Very long texts are
treated whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.llm.language import ADDED, fit, identify, is_held_out
from waypost.llm.line_dedup import dedup_lines
from waypost.llm.mixing import mix_sources
from waypost.llm.near_dup import near_duplicates
from waypost.llm.packing import pack_documents
from waypost.llm.workspace import drop, fresh, written

#: A document of which less than this share of letters is in scripts of the languages learnt, all together, is rejected.
LEAST_SHARE = 0.3
_SEED = 23


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter or with hardly any in a script of the languages learnt go."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~is_held_out()).select("doc_id", "lang", "text"))
    added = fresh(docs.columns, *ADDED)
    labelled = identify(docs, model, added=tuple(added))
    letters, known = (F.aggregate(f"{added[2]}.{c}", F.lit(0).cast("long"), lambda done, n: done + n) for c in ("letters", "known_letters"))
    return labelled.where((letters > 0) & (known >= LEAST_SHARE * letters)).drop(*added)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that match an earlier one go; n_chars follows the text."""
    added = fresh(docs.columns, "n_lines", "removed_lines")
    cleaned = dedup_lines(docs, added=tuple(added)).drop(*added)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def _first_of_equal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``, the first by a hash of all of its columns: any order of the rows gives the same."""
    (own,) = fresh(rows.columns, "_own")
    whole = F.struct(*(f"`{c}`" for c in rows.columns))
    return rows.groupBy(*keys).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(own)).select(f"{own}.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each connected group the document with the smallest id stays, once; rows without an id all stay."""
    of, of_hash, own_hash, rows = fresh(docs.columns, "_of", "_of_hash", "_text_hash", "_rows")
    decided = near_duplicates(docs.select("doc_id", "text")).where("kept and text_hash = first_hash")
    decided = decided.groupBy(F.col("doc_id").alias(of), F.col("text_hash").alias(of_hash)).agg(F.count(F.lit(1)).alias(rows))
    same = (F.col("doc_id") == F.col(of)) & (F.col(own_hash) == F.col(of_hash))
    kept = docs.withColumn(own_hash, F.xxhash64("text")).join(decided, same)
    one = kept.where(F.col(rows) == 1).unionAll(_first_of_equal(kept.where(F.col(rows) > 1), ["doc_id", own_hash]))
    return one.select(*(f"`{c}`" for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document appears as often as its taken words ask for, the fraction rounded by a seeded draw.

    A document without words takes part with no words and goes. Rows are told
    apart by id, source and text; of equal rows each has its own share.
    """
    of, of_source, of_hash, own_hash, copies, rows, copy = fresh(docs.columns, "_of", "_of_source", "_of_hash", "_text_hash", "_copies", "_rows", "_copy")
    read = docs.select("doc_id", "source", "text", F.col("source").alias(of_source), F.xxhash64("text").alias(own_hash))
    taken = mix_sources(read, keep=(of_source, own_hash))
    draw = F.pmod(F.xxhash64("doc_id", own_hash, F.lit(_SEED)), F.lit(1 << 30)) / (1 << 30)
    times = F.floor(F.col("taken") / F.col("size") + draw).cast("int")
    # equal rows may have different shares, so the copies of all come from one of them
    kind = taken.where("size > 0").groupBy("doc_id", of_source, own_hash).agg(F.sum(times).alias(copies), F.count(F.lit(1)).alias(rows))
    kind = kind.where(F.col(copies) > 0).select(F.col("doc_id").alias(of), of_source, F.col(own_hash).alias(of_hash), copies, rows)
    same = F.col("doc_id").eqNullSafe(F.col(of)) & F.col("source").eqNullSafe(F.col(of_source)) & (F.col(own_hash) == F.col(of_hash))
    found = docs.withColumn(own_hash, F.xxhash64("text")).join(kind, same)
    one = found.where(F.col(rows) == 1).unionAll(_first_of_equal(found.where(F.col(rows) > 1), ["doc_id", "source", own_hash]))
    mixed = one.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return mixed.select(*(f"`{c}`" for c in docs.columns))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: doc_id, source, first_word, words, bin_id, bin_words; exact copies, which mixing makes, share no bin."""
    return pack_documents(docs)


STAGES = [
    ("language", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_to_weights),
    ("packing", pack_bins),
]

#: Language models are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out, name)
            drop(docs)  # the last stage's table; what was given stays
        docs = out
    return docs
