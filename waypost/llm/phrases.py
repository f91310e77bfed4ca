"""Phrases whose words stand together more often than their parts would by chance.

Phrases of up to five words are counted by dynamic itemset counting. The corpus
is dealt row by row to ``SHARDS`` shards, which are scanned in a circle. Single
words are counted from the start. A longer phrase is counted from the scan after
both of its parts, the phrase without its last and without its first word, have
reached the threshold, whichever shard that happens in; so phrases of all lengths
are counted side by side. A phrase that has been counted in every shard once is
done: its count is exact and it is kept if it reached the threshold.

What tells a scan which phrases to count is a table of ``2**TABLE_BITS`` bytes,
16 MB whatever the corpus: the scan in which a phrase of that hash first reached
the threshold. Phrases that share a hash can only make others be counted that
need not be; whether and from when a phrase is counted depends on it and its
parts alone, so it is counted in each shard once all the same. With very many frequent
phrases the table fills, which costs time and no result; ``table_bits`` sets it.
A scan counts by exact word numbers in pieces of bounded size, not by hashes.

A-Z are lower-cased, texts split at ``. , ; : ! ?`` and line ends into pieces and
at spaces and tabs into words. Null and empty texts have no words, a null
language is ``und``, repeated rows count each time, long texts are taken whole,
an empty table has no phrases, other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import pieces
from .lookups import look_up
from .words import WordHasher, mix64
from .workspace import drop, written

#: Occurrences of a phrase that counts, its most words, phrases returned per language.
LEAST, LONGEST, TOP = 100, 5, 2000
SHARDS = 3
TABLE_BITS = 24
#: Bytes of text that are counted together.
PIECE_BYTES = 1 << 22
#: A candidate goes if a longer one that holds it has this share of its occurrences, in percent.
INSIDE_PERCENT = 100

_NEVER = 255
_END = b"\n"  # between the texts of a batch, as between the pieces of one
#: Kinds of bytes: of a word, between words, between pieces.
_KIND = bytes(2 if c in b".,;:!?\n\x0b\x0c\r" else c in b" \t" for c in range(256))
_LINE, _SPACE = (pa.scalar(c, pa.large_binary()) for c in (b"\n", b" "))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("since", pa.int32()), ("count", pa.int64())])
_COUNTS_DDL = "lang string, phrase string, n_words int, since int, count long"
#: Parts of a language that are ranked side by side first.
_SALTS = 32


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in order, and the number of the piece that each is in."""
    whole = _END.join(texts).lower() + _END
    data, kind = np.frombuffer(whole, dtype=np.uint8), np.frombuffer(whole.translate(_KIND), dtype=np.uint8)
    word = kind == 0
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), piece


def _groups(ids: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the places ``at`` of each distinct sequence of ``width`` ids there, and how often it stands."""
    key = ids[at].astype(np.int64)
    for k in range(1, width):
        known = np.unique(key, return_inverse=True)[1] if k > 1 else key
        key = (known << 32) | ids[at + k]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return at[first], count


class Codes:
    """Hashes of words of a language, and of phrases by those of their words."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def words(self, lang: str, lines: bytes, n: int) -> np.ndarray:
        """The hashes of ``n`` words, each on a line."""
        hashes = self.hasher.words([(lang.encode() or b"-") + b"\n" + lines])[0]
        own = np.sum(hashes[: len(hashes) - n] * _BASE, dtype=np.uint64)  # of the words of the language's own name
        return mix64(hashes[len(hashes) - n :] + own)

    @staticmethod
    def longer(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix64(phrase * _BASE + word)

    def phrases(self, lang: str, phrases: list[str], width: int) -> np.ndarray:
        """The hashes of phrases of ``width`` words."""
        words = self.words(lang, "\n".join(phrases).replace(" ", "\n").encode(), len(phrases) * width).reshape(-1, width)
        out = words[:, 0]
        for k in range(1, width):
            out = self.longer(out, words[:, k])
        return out


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.int64)


class Counter:
    """Counts the phrases of one scan in batches of texts."""

    def __init__(self, step: int, table: np.ndarray, shards: int, longest: int) -> None:
        self.step, self.table, self.shards, self.longest = step, table, shards, longest
        self.codes = Codes()

    def count(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n_words, since, count) of the phrases that this scan counts."""
        words, piece = _words(texts)
        coded = words.dictionary_encode()
        vocabulary, ids = coded.dictionary, coded.indices.to_numpy()
        del words, coded
        lines = pc.binary_join_element_wise(vocabulary, pa.scalar(b"", pa.large_binary()), _LINE)
        hashes = self.codes.words(lang, b"".join(lines.buffers()[2:]), len(vocabulary))
        if self.step < self.shards:
            yield self._batch(lang, None, 0, [0], [len(ids)])
            if len(ids):
                yield self._batch(lang, vocabulary, 1, np.zeros(len(vocabulary)), np.bincount(ids, minlength=len(vocabulary)))
        reached, code = self.table[_slots(hashes, len(self.table))][ids], hashes[ids]
        spelled = code
        for width in range(2, self.longest + 1):
            if len(reached) < 2:
                break
            since = np.maximum(reached[:-1], reached[1:]).astype(np.int32) + 1
            # longer phrases are made of two that overlap, so only pairs of words need to be told to share a piece
            at = np.flatnonzero((since <= self.step) & (piece[:-1] == piece[1:]) if width == 2 else since <= self.step)
            if not len(at):
                break
            joined = Codes.longer(spelled[at], code[at + width - 1])
            open_ = since[at] + self.shards > self.step
            if open_.any():
                first, times = _groups(ids, at[open_], width)
                phrase = pc.binary_join_element_wise(*(vocabulary.take(pa.array(ids[first + k])) for k in range(width)), _SPACE)
                yield self._batch(lang, phrase, width, since[first], times)
            reached = np.full(len(since), _NEVER, dtype=np.uint8)
            # another phrase may have marked the place, but none reaches the threshold before it is counted
            reached[at] = np.maximum(self.table[_slots(joined, len(self.table))], np.minimum(since[at], _NEVER))
            spelled = np.zeros(len(since), dtype=np.uint64)
            spelled[at] = joined

    @staticmethod
    def _batch(lang: str, phrase: pa.Array | None, width: int, since, count) -> pa.RecordBatch:
        n = len(count)
        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
        text = pa.nulls(n, pa.string()) if phrase is None else phrase.cast(pa.string())
        columns = [same(lang, pa.string()), text, same(width, pa.int32()), pa.array(np.asarray(since), pa.int32(), safe=False), pa.array(np.asarray(count), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


def _scan(shard: DataFrame, step: int, table, shards: int, longest: int) -> DataFrame:
    """The phrases that a scan counts in a shard of (lang, text); ``table`` is a broadcast variable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(step, np.frombuffer(table.value, dtype=np.uint8), shards, longest)
        for batch in batches:
            for part in pieces(batch, 1, PIECE_BYTES, batch.num_rows):
                texts: dict[str, list[bytes]] = defaultdict(list)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    texts[lang].append(text)
                for lang, own in texts.items():
                    yield from counter.count(lang, own)

    return shard.select("lang", "text").mapInArrow(run, _COUNTS_DDL)


def _slots_of(phrases: DataFrame, size: int) -> DataFrame:
    """The places in a table of ``size`` of (lang, phrase, n_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            own: dict[tuple[str, int], list[str]] = defaultdict(list)
            for lang, phrase, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own[lang, width].append(phrase)
            for (lang, width), some in own.items():
                yield pa.RecordBatch.from_arrays([pa.array(_slots(codes.phrases(lang, some, width), size))], names=["slot"])

    return phrases.select("lang", "phrase", "n_words").mapInArrow(run, "slot long")


def _marked(table: np.ndarray, reached: DataFrame, step: int) -> bool:
    """Write the scan into the table where phrases reached the threshold in it; whether any did.

    Places arrive as bitmaps, 2 MB in all for the table's 16.
    """
    place = F.col("slot") + 1
    maps = _slots_of(reached, len(table)).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    for bucket, bits in zip(maps.column("bucket").to_pylist(), maps.column("bits").to_pylist(), strict=True):
        places = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little"))
        places += (bucket - 1) * 8 * len(bits)
        places = places[places < len(table)]
        table[places[table[places] == _NEVER]] = step
    return maps.num_rows > 0


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, table_bits: int = TABLE_BITS) -> DataFrame:
    """(lang, phrase, n_words, count) of all phrases of ``longest`` words or fewer that stand ``least`` times.

    A row without a phrase has each language's number of words.
    """
    context = documents.sparkSession.sparkContext
    lang, text = (F.coalesce(F.col(c).cast("string"), F.lit(other)).alias(c) for c, other in (("lang", "und"), ("text", "")))
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard")
    dealt = written(documents.select(lang, text, shard), "shards", partition_by=["shard"])
    table = np.full(1 << table_bits, _NEVER, dtype=np.uint8)
    state, done, last, step = None, [], -1, 0
    while step < shards or step <= last + shards:
        sent = context.broadcast(table.tobytes())
        counts = _scan(dealt.where(F.col("shard") == step % shards), step, sent, shards, longest).withColumn("reached", F.lit(None).cast("int"))
        if state is not None:
            counts = counts.unionByName(state.where(F.col("since") + shards > step))
        own = [F.min(c).alias(c) for c in ("n_words", "since", "reached")]
        merged = counts.groupBy("lang", "phrase").agg(F.sum("count").alias("count"), *own)
        merged = written(merged.withColumn("reached", F.coalesce("reached", F.when(F.col("count") >= least, step))), "state")
        if state is not None:
            drop(state)
        sent.destroy()
        state = merged
        ended = state.where((F.col("since") + shards == step + 1) & (F.col("reached").isNotNull() | F.col("phrase").isNull()))
        done.append(written(ended.select("lang", "phrase", "n_words", "count"), "done"))
        if _marked(table, state.where((F.col("reached") == step) & F.col("n_words").between(1, longest - 1)), step):
            last = step
        step += 1
    drop(state, dealt)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    out = written(whole, "phrases")
    drop(*done)
    return out


def _exact(*factors: str | Column) -> Column:
    """The product of whole numbers as a decimal of 38 digits."""
    out = F.lit(1).cast("decimal(1,0)")
    for f in factors:
        out = (out * (F.col(f) if isinstance(f, str) else f).cast("decimal(18,0)")).cast("decimal(38,0)")
    return out


def _joined(words: Column, start: Column | int, n: Column | int) -> Column:
    whole = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.array_join(F.slice(words, whole(start), whole(n)), " ")


def _uses(rows: DataFrame, on: list[str], values: DataFrame) -> DataFrame:
    """``values`` by key with how many rows ask for each."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("uses")).join(values, on)


def scored(phrases: DataFrame) -> DataFrame:
    """Phrases of two words or more with the cut that scores least: lang, phrase, n_words, a, l, r, n, score."""
    counts = phrases.where("phrase is not null")
    words, k = F.split("phrase", " "), F.col("k")
    cuts = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = written(cuts.withColumns({"left": _joined(words, 1, k), "right": _joined(words, k + 1, F.col("n_words") - k)}), "cuts")
    total = cuts.count()
    for side, name in (("left", "l"), ("right", "r")):
        values = counts.select("lang", F.col("phrase").alias(side), F.col("count").alias(name))
        met = written(look_up(cuts, _uses(cuts, ["lang", side], values), total, ["lang", side], "inner"), "cuts")
        drop(cuts)
        cuts = met
    sizes = phrases.where("phrase is null").select("lang", F.col("count").alias("n"))
    cuts = look_up(cuts, _uses(cuts, ["lang"], sizes), total, ["lang"], "inner")
    score = cuts.withColumns({"above": _exact(F.lit(1000), "a", "n"), "below": _exact("l", "r")}).withColumn("score", F.expr("above div below"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return score.groupBy("lang", "phrase", "n_words", "a", "n").agg(least).select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "n", "cut.score")


def maximal(candidates: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """``candidates`` but those inside a longer one that stands nearly as often: ``percent`` of their times or more."""
    n, words = F.col("n_words"), F.split("phrase", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda at: _joined(words, at, m))))
    inside = candidates.where("n_words > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    met = candidates.join(inside, ["lang", "phrase"], "left")
    return met.where(F.coalesce(F.col("longer") * 100 < F.col("a") * percent, F.lit(True))).drop("longer")


def best(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` of each language with ``rank``; parts of a language are ranked first, so no task ranks all of it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    part = candidates.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    few = part.where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top)


def mine_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = INSIDE_PERCENT, shards: int = SHARDS) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases = frequent_phrases(documents, least, longest, shards)
    candidates = written(scored(phrases), "candidates")
    drop(phrases)
    return best(maximal(candidates, percent), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
