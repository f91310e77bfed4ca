"""Finding texts that contain a term, by an inverted index of their character grams.

A term of three characters or more can only stand in a text that has all of its
trigrams, shorter terms in one that has them as a gram. Each term is looked up by
the one of its grams that fewest texts have, so texts meet terms in a join on a
gram and are compared only then. What each term looks up is written first, so
that Spark knows how little it is: the far more numerous grams of the texts are
not the side that is sent to all tasks. A gram that very many texts have is dealt
to ``SALTS`` keys; how many such grams there are is bounded by the length of a
text, not by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

GRAM = 3
#: A gram of one text in ``HOT`` or more is dealt to ``SALTS`` keys.
HOT, SALTS = 64, 64
#: So many terms are sorted and not sent to all tasks, however small they may look.
MANY = 50_000


def _grams(text: Column, width: int) -> Column:
    last = F.length(text) - (width - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(width)))
    return F.when(last > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _grams_of_all(texts: list[Column], widths: list[int]) -> Column:
    every = [F.coalesce(_grams(t, w), F.array().cast("array<string>")) for t in texts for w in widths]
    return F.array_distinct(F.flatten(F.array(*every)))


def contain(rows: DataFrame, texts: list[Column], terms: DataFrame, shortest: int = 1) -> DataFrame:
    """``rows`` joined to the ``terms`` (term_id, _term) that one of their ``texts`` contains.

    Terms of fewer than ``shortest`` characters find nothing. The join is on
    grams; a row comes once for each term.
    """
    widths = list(range(min(shortest, GRAM), GRAM + 1))
    asked = terms.where(F.length("_term") >= max(shortest, 1))
    grams_of_term = F.when(F.length("_term") >= GRAM, _grams(F.col("_term"), GRAM)).otherwise(F.array("_term"))
    parts = asked.select("term_id", "_term", F.explode(grams_of_term).alias("_gram"))
    index = rows.select(F.explode(_grams_of_all(texts, widths)).alias("_gram"))
    frequent = index.join(parts.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a term with a gram that no text has finds nothing
    rarest = parts.join(frequent, "_gram", "left").groupBy("term_id", "_term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("r"))
    found = written(rarest.where("r.n > 0").select("term_id", "_term", F.col("r.gram").alias("_gram"), F.col("r.n").alias("_n")), "terms")
    limit = F.greatest(rows.agg((F.count(F.lit(1)) / HOT).alias("n")).scalar(), F.lit(SALTS))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    keyed = found.select("term_id", "_term", "_gram", F.explode(F.when(F.col("_n") >= limit, every).otherwise(F.array(F.lit(0)))).alias("_salt"))
    hot = found.where(F.col("_n") >= limit).agg(F.collect_set("_gram")).scalar()  # at most HOT times the grams of a text
    own = F.pmod(F.xxhash64(*texts), F.lit(SALTS)).cast("int")
    spread = rows.withColumn("_own", own).withColumn("_gram", F.explode(_grams_of_all(texts, widths)))
    if found.count() > MANY:
        spread = spread.hint("merge")
    met = spread.withColumn("_salt", F.when(F.array_contains(hot, F.col("_gram")), F.col("_own")).otherwise(0)).drop("_own").join(keyed, ["_gram", "_salt"])
    hit = F.lit(False)
    for t in texts:
        hit |= F.coalesce(F.contains(t, F.col("_term")), F.lit(False))
    return met.where(hit).drop("_gram", "_salt")
