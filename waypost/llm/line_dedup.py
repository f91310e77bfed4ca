"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line's set holds its distinct words, A to Z as a to z; with ``ignore_case``
off, which is narrower, as they are written. Two lines match if the
Jaccard similarity of their sets is at least ``NUMERATOR / DENOMINATOR``; a
line is removed if an earlier line, by (doc_id, line number), matches it,
whether or not that line is removed too.

The join: words are ordered by rarity, by counts over the whole corpus in a
table of fixed size (words share its entries by hash; any order gives the same
result, a good one makes it fast). The words of all lines are written once as
hashes, from which both these counts and the sets are made, and dropped then. Lines of equal sets are one row throughout.
If two sets match, the first n - ceil(0.9 n) + 1 words of both share one, so a
set has an entry for each word of its prefix. Entries of a word with more than
``HOT`` of them are dealt further: matching sets of a and b words differ in
d = floor((a + b) / 19) words at most, so if the words are cut into d + 1 parts
by hash, one part is the same in both. Such an entry is repeated for every part
and meets only those whose 128-bit parity sketch is the same in that part.

Entries that meet are compared by semi joins, so that a set costs a few rows
however many others it resembles; no table holds pairs:

1. Sets stay that have a partner by lengths, by the word's positions (those of a
   first shared word) and by the sketches of rare and of frequent words: a bit that
   differs is a word that only one of them has.
2. Of the entries of those sets, the ones stay whose word is the first that a
   pair of partners shares.
3. The whole word sets of these lines are read from the texts again (a Bloom
   filter of fixed size keeps other lines out of the shuffle), and a set is
   matched if that of an earlier line is similar enough.

Words are compared by 63 bits of a hash, of which the rank stands for 18, sets by 128 bits, but by 64 of
these where entries of prefixes meet.

Defined cases: lines without words stay. Documents with a null doc_id take no
part and stay as they are, a null text stays null. Equal rows are one document
and are treated alike; rows that share a doc_id only are ordered by a hash of
their text. A document that loses all lines stays with an empty text. An empty
table gives an empty result. A very long line is one array of numbers in one
row, so it must fit in a task's memory; from 64 differing words on (576 words in
a line) entries of a frequent word are not dealt by parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import drop, fresh, written

#: As a fraction of integers, so that comparisons are exact.
NUMERATOR, DENOMINATOR = 9, 10
RARITY_BITS = 18
#: Entries of one prefix word that meet as they are: comparing one with so many costs about as much as its parts do.
HOT = 1024
#: Words of 64 bits in the filter of candidate lines.
FILTER_WORDS = 1 << 17
#: Words of the most frequent entries of the rarity table have a sketch of their own.
FREQUENT = 1 << 10
#: White space within a line, besides the space itself.
_BLANKS = "\t\x0b\x0c\r"


def _cased(text: str, ignore_case: bool) -> Column:
    """A text, if case is ignored with A to Z as a to z.

    What is not ASCII is then read byte by byte as Latin-1. Lower case turns a leading byte there into one that no
    character with as many bytes starts with otherwise, so different characters stay different.
    """
    c = F.col(text)
    if not ignore_case:
        return c
    return F.lower(F.when(F.octet_length(c) == F.length(c), c).otherwise(F.decode(c.cast("binary"), "ISO-8859-1")))


def _folded(text: str, ignore_case: bool) -> Column:
    """The same with all white space but line breaks as spaces."""
    c = F.col(text)
    odd = F.lit(False)
    for blank in _BLANKS:
        odd |= c.contains(blank)
    cased = _cased(text, ignore_case)
    return F.when(odd, F.regexp_replace(cased, f"[{_BLANKS}]", " ")).otherwise(cased)


def _word_hashes(line: str) -> Column:
    """The distinct words of a line as hashes; two spaces side by side have an empty word between them, which is none."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))


def rarity_table(words: DataFrame) -> DataFrame:
    """One row with ``ranks``: for each hash entry its place, in the high bits, when entries are ordered by how many words of lines fall there."""
    counts = words.select(F.explode("words").alias("word")).groupBy(_entry(F.col("word")).alias("entry")).agg(F.count(F.lit(1)).alias("n"))
    every = words.sparkSession.range(1 << RARITY_BITS).withColumnRenamed("id", "entry").join(counts, "entry", "left")
    pairs = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "entry")))
    placed = every.agg(pairs.alias("p")).select(F.array_sort(F.transform("p", lambda x, i: F.struct(x["entry"], i.alias("rank")))).alias("q"))
    return written(placed.select(F.transform("q", lambda x: F.shiftleft(x["rank"].cast("long"), 63 - RARITY_BITS)).alias("ranks")), "rarity")


def _entry(word: Column) -> Column:
    return word.bitwiseAND((1 << RARITY_BITS) - 1)


def _tokens(words: DataFrame, ranks: Column) -> DataFrame:
    """at, ``tokens`` of lines (at, words): the words as numbers, the rank of the entry before the other bits; sorted they are rarest first."""

    def number(w: Column) -> Column:
        return F.coalesce(F.get("ranks", _entry(w)).bitwiseOR(F.shiftrightunsigned(w, RARITY_BITS + 1)), F.lit(0))

    return words.select("at", "words", ranks.alias("ranks")).select("at", F.transform("words", number).alias("tokens"))


def _parity(tokens: Column) -> Column:
    """64 bits, of which each word flips the one that six of its bits name."""

    def flip(x: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))

    return F.aggregate(tokens, F.lit(0).cast("long"), lambda done, x: done.bitwiseXOR(flip(x)))


def _bit(key: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k)), F.lit(64 * FILTER_WORDS))


def _filter_of(keys: DataFrame, key: str) -> DataFrame:
    """One row with ``bits``: a Bloom filter with two hashes of a column."""
    bits = keys.select(F.explode(F.array(_bit(F.col(key), 1), _bit(F.col(key), 2))).alias("bit"))
    masks = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    every = keys.sparkSession.range(FILTER_WORDS).withColumnRenamed("id", "word").join(masks, "word", "left")
    ordered = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")))).alias("p"))
    return written(ordered.select(F.transform("p", lambda x: x["mask"]).alias("bits")), "filter")


def _in_filter(key: Column, bits: Column) -> Column:
    def one(k: int) -> Column:
        b = _bit(key, k)
        mask = F.get(bits, F.shiftright(b, 6).cast("int"))
        return mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63).cast("int"))) != 0

    return one(1) & one(2)


def _lines(documents: DataFrame, text: Column) -> DataFrame:
    """doc_id, text_hash, line_no, line of every line of documents with an id and a text; lines are cut from ``text``."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"))
    return rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _at() -> Column:
    return F.struct("doc_id", "text_hash", "line_no")


def _words(documents: DataFrame, ignore_case: bool) -> DataFrame:
    """at, ``words`` of every line that has words, as hashes; texts are cut into words only here, and again for lines that may match."""
    filled = _lines(documents, _folded("text", ignore_case)).where(F.trim("line") != "")
    return written(filled.select(_at().alias("at"), _word_hashes("line").alias("words")), "words", "lz4")


def _sets(words: DataFrame, ranks: Column) -> tuple[DataFrame, DataFrame]:
    """Every line with words by the id of its set; and the sets with their first line, prefix and sketches."""
    # among the words in order stands a mark, from which on they are frequent
    mark = F.lit(((1 << RARITY_BITS) - FREQUENT) << (63 - RARITY_BITS)).cast("long")
    marked = _tokens(words, ranks).select("at", F.sort_array(F.array_append("tokens", mark)).alias("marked"))
    marked = marked.select("at", "marked", (F.size("marked") - 1).alias("n"), F.array_position("marked", mark).cast("int").alias("place"))
    n, place = F.col("n"), F.col("place")
    length = n - F.ceil(n * NUMERATOR / DENOMINATOR).cast("int") + 1
    rarest = F.slice(F.when(length < place, F.col("marked")).otherwise(F.array_remove("marked", mark)), F.lit(1), length)
    cut = marked.select(
        "at",
        F.xxhash64("marked").alias("id"),
        F.xxhash64(F.lit(1), "marked").alias("id_b"),
        "n",
        rarest.alias("rarest"),
        F.slice("marked", F.lit(1), place - 1).alias("rare"),
        F.slice("marked", place + 1, n).alias("frequent"),
    )
    # a smaller set matches equal ones only; asked of the parts, which are then used twice and so cut before
    # functions run over them: within such a function, cutting turns all numbers of a line into objects
    joins = (F.size("rare") + F.size("frequent")) * (DENOMINATOR - NUMERATOR) >= NUMERATOR
    lines = cut.select(
        "at",
        "id",
        "id_b",
        "n",
        F.when(joins, F.transform("rarest", lambda x: F.hash(x))).alias("prefix"),  # 32 bits do to find candidates
        F.when(joins, _parity(F.col("rare"))).alias("rare_bits"),
        F.when(joins, _parity(F.col("frequent"))).alias("frequent_bits"),
    )
    lines = written(lines, "lines", "lz4")
    drop(words)
    # of equal sets all but the place is the same
    head = F.min(F.struct("at", "n", "prefix", "rare_bits", "frequent_bits")).alias("head")
    sets = lines.groupBy("id", "id_b").agg(head, F.count(F.lit(1)).alias("lines")).select("id", "id_b", "head.*", "lines")
    return lines, written(sets, "sets", "lz4")


def _dealt(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries with the ``key`` on which they meet: the word, or for those of a hot word one for every part of the sketch."""
    total = NUMERATOR + DENOMINATOR
    n = F.col("n")
    least = F.floor((n + F.ceil(n * NUMERATOR / DENOMINATOR)) * (DENOMINATOR - NUMERATOR) / total)
    most = F.floor((n + F.floor(n * DENOMINATOR / NUMERATOR)) * (DENOMINATOR - NUMERATOR) / total)
    joined = entries.join(hot.select(F.col("token").alias("hot")), F.col("token") == F.col("hot"), "left")
    kept = [c for c in entries.columns if c != "token"]
    cold = joined.where("hot is null").select(F.col("token").cast("long").alias("key"), *kept)
    # beyond 63 a sketch has no bits for so many parts
    whole = F.lit(64).cast("long")
    parts = joined.where("hot is not null").select(*entries.columns, F.explode(F.sequence(F.least(least, whole), F.least(most, whole))).alias("d"))
    parts = parts.select("*", F.explode(F.when(F.col("d") < whole, F.sequence(F.lit(0).cast("long"), F.col("d"))).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"))
    low, high = (F.floor((F.col("part") + k) * 64 / (F.col("d") + 1)).cast("int") for k in (0, 1))
    mask = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - (high - low)), low)
    own = lambda c: F.when(F.col("part") < 0, 0).otherwise(F.col(c).bitwiseAND(mask))
    parts = parts.select(F.xxhash64("token", "d", "part", own("rare_bits"), own("frequent_bits")).alias("key"), *kept)
    return cold.unionAll(parts)


def _partnered(left: DataFrame, right: DataFrame, *also: Column) -> DataFrame:
    """Rows of ``left`` for which ``right`` has a row of another set that may match; ``also`` has them as w and o."""
    a, b, x, y = F.col("w.n"), F.col("o.n"), F.col("w.i"), F.col("o.i")
    length = (F.least(a, b) * DENOMINATOR) >= (F.greatest(a, b) * NUMERATOR)
    most = F.least(a - x, b - y)  # if it is the first word they share: this one and those after
    place = most * (DENOMINATOR + NUMERATOR) >= (a + b) * NUMERATOR
    differ = [F.bit_count(F.col(f"w.{c}").bitwiseXOR(F.col(f"o.{c}"))) for c in ("rare_bits", "frequent_bits")]
    apart = (differ[0] + differ[1]) * (DENOMINATOR + NUMERATOR) <= (a + b) * (DENOMINATOR - NUMERATOR)
    test = (F.col("w.key") == F.col("o.key")) & (F.col("w.id") != F.col("o.id")) & length & place & apart
    for more in also:
        test &= more
    # by aliases and not by new names, and with all columns in the test, so that a table that meets itself is shuffled once
    return left.alias("w").join(right.alias("o"), test, "left_semi")


def _first_shared() -> Column:
    """Whether the word of two entries is the first of both prefixes; most others are ruled out by a few comparisons."""
    p, q, token = F.col("w.prefix"), F.col("o.prefix"), F.get("w.prefix", F.col("w.i"))
    earlier = F.lit(False)
    for i in range(3):
        for j in range(3):
            earlier |= (F.col("w.i") > i) & (F.col("o.i") > j) & (F.get(p, F.lit(i)) == F.get(q, F.lit(j)))
    ordered = F.when(F.col("w.id") < F.col("o.id"), F.array_intersect(p, q)).otherwise(F.array_intersect(q, p))
    return ~earlier & (F.get(ordered, F.lit(0)) == token)


def _matched(sets: DataFrame, documents: DataFrame, ranks: Column, ignore_case: bool) -> DataFrame:
    """``at`` of the sets that an earlier one matches."""
    own = ["id", "n", "rare_bits", "frequent_bits"]
    entries = sets.where("prefix is not null").select(*own, F.posexplode("prefix").alias("i", "token"))
    hot = written(entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT), "hot", "lz4")
    dealt = _dealt(entries, hot)
    near = written(_partnered(dealt, dealt), "near", "lz4")
    drop(hot)

    known = near.join(sets.where("prefix is not null").select("id", "at", "prefix"), "id")
    firsts = written(_partnered(known, known, F.col("w.at") != F.col("o.at"), _first_shared()).drop("prefix"), "firsts", "lz4")
    drop(near)

    wanted = firsts.select("at").distinct()
    key = F.xxhash64("doc_id", "text_hash", "line_no")
    found = _filter_of(wanted.select(F.xxhash64("at.doc_id", "at.text_hash", "at.line_no").alias("key")), "key")
    lines = _lines(documents, F.col("text")).where(_in_filter(key, found.select("bits").scalar()))
    lines = lines.select(_at().alias("at"), "line").join(wanted, "at", "left_semi").dropDuplicates(["at"])
    lines = lines.select("at", _folded("line", ignore_case).alias("line"))
    tokens = _tokens(lines.select("at", _word_hashes("line").alias("words")), ranks)
    whole = written(firsts.join(tokens, "at"), "whole", "lz4")
    drop(firsts, found)
    both = F.size(F.array_intersect("w.tokens", "o.tokens")) * (DENOMINATOR + NUMERATOR) >= (F.col("w.n") + F.col("o.n")) * NUMERATOR
    out = written(_partnered(whole, whole, F.col("o.at") < F.col("w.at"), both).select("at").distinct(), "matched")
    drop(whole)
    return out


def later_matches(documents: DataFrame, ignore_case: bool = True) -> DataFrame:
    """documents (doc_id, text) -> doc_id, text_hash, line_no of the lines to remove, once for each equal row."""
    words = _words(documents, ignore_case)
    rarity = rarity_table(words)
    ranks = rarity.select("ranks").scalar()
    lines, sets = _sets(words, ranks)
    matched = _matched(sets, documents, ranks, ignore_case)
    gone = sets.select("id", "id_b", "at", "lines").join(matched.withColumn("matched", F.lit(True)), "at", "left").where("lines > 1 or matched")
    gone = gone.select("id", "id_b", F.col("at").alias("first_at"), F.coalesce("matched", F.lit(False)).alias("matched"))
    decided = lines.select("at", "id", "id_b").join(gone, ["id", "id_b"])
    out = written(decided.where((F.col("at") > F.col("first_at")) | F.col("matched")).select("at.*"), "removed")
    drop(rarity, lines, sets, matched)
    return out


def dedup_lines(documents: DataFrame, ignore_case: bool = True, added: tuple[str, str] = ("n_lines", "removed_lines")) -> DataFrame:
    """``documents`` with an id and text, later matching lines removed; adds n_lines and removed_lines, or two other names.

    Columns of these two names in the input are replaced, all others stay.
    """
    removed = later_matches(documents.select("doc_id", "text"), ignore_case)
    rows = documents.drop(*added)
    own_hash, of, of_hash, lost = fresh([*rows.columns, *added], "_text_hash", "_of", "_of_hash", "_lost")
    lists = removed.groupBy(F.col("doc_id").alias(of), F.col("text_hash").alias(of_hash)).agg(F.collect_set("line_no").alias(lost))
    lists = written(lists, "lists")
    drop(removed)
    bits = _filter_of(lists.select(F.xxhash64(of, of_hash).alias("key")), "key").select("bits").scalar()
    hit = F.coalesce(_in_filter(F.xxhash64("doc_id", F.xxhash64("text")), bits), F.lit(False))
    same = (F.col("doc_id") == F.col(of)) & (F.col(own_hash) == F.col(of_hash))
    joined = rows.where(hit).withColumn(own_hash, F.xxhash64("text")).join(lists, same, "left").select(*(f"`{c}`" for c in rows.columns), lost)
    # documents that surely lose no line need not be shuffled
    joined = joined.unionAll(rows.where(~hit).select("*", F.lit(None).cast("array<int>").alias(lost)))
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda _, i: ~F.array_contains(lost, i))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines, gone = F.coalesce(F.size(split), F.lit(0)), F.coalesce(F.size(lost), F.lit(0))
    out = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in rows.columns]
    counts = F.when(F.col("text").isNull(), 0).otherwise(n_lines), F.when(F.col(lost).isNull(), 0).otherwise(gone)
    return joined.select(*out, *(c.alias(name) for c, name in zip(counts, added, strict=True)))
