from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_line_dedup import brute as lines_brute
from test_near_dup import brute as groups_brute

from waypost.llm.packing import CAPACITY, PER_SOURCE


def test_stages_on_documents(spark, documents, small):
    docs, given = documents, documents.columns
    assert [n for n, _ in pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mixing", "packing"]
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        seen[name] = docs
        if name != "packing":
            assert docs.columns == given and docs.dtypes == documents.dtypes
    rows = lambda name: sorted((r.doc_id, r.text) for r in seen[name].select("doc_id", "text").collect())
    first, second, third, fourth = (rows(n) for n in ("language", "line_dedup", "near_dedup", "mixing"))
    assert {i for i, t in first} == {r.doc_id for r in documents.collect() if any(c.isalpha() for c in r.text)}
    expected = lines_brute(first)
    assert second == sorted((i, t) for i, (t, _, _) in expected.items())
    kept = {i for i, (_, c) in groups_brute(second).items() if i == c}
    assert third == [x for x in second if x[0] in kept]
    copies = Counter(fourth)
    assert set(copies) <= set(third) and max(copies.values()) <= 2
    words = lambda xs: sum(len(t.split()) * n for (_, t), n in xs)
    assert abs(words(copies.items()) / words((x, 1) for x in third) - 1.5) < 0.1
    bins = seen["packing"].toPandas()
    assert sum(bins.words) == words(copies.items())
    assert bins.bin_words.max() <= CAPACITY and bins.groupby(["bin_id", "source"]).size().max() <= PER_SOURCE
    again = pipeline.run(spark, small).toPandas()
    order = ["doc_id", "bin_id", "first_word"]
    assert again.sort_values(order).reset_index(drop=True).equals(bins.sort_values(order).reset_index(drop=True))


def test_even_mixtures_are_kept(spark, monkeypatch):
    """Four languages with a script each and a quarter of the letters each; a text in no script of theirs goes."""
    own = {"en": "hello world how are you", "ru": "привет мир как твои дела", "el": "γεια σου κοσμε τι κανεις", "he": "שלום עולם מה שלומך היום"}
    rows = [(4 * i + k, text, lang, "a", 1) for i in range(8) for k, (lang, text) in enumerate(own.items())]
    rows += [(1000, " ".join(w for t in own.values() for w in [t] * 3), "en", "a", 1), (1001, "日本語の文章" * 9 + " hello", "en", "a", 1)]
    monkeypatch.setattr(pipeline, "is_held_out", lambda: F.col("doc_id") >= 1000)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = {r.doc_id for r in pipeline.keep_identified(spark, df, "").collect()}
    assert ids == {r[0] for r in rows} - {1001}


def test_rows_without_an_id_stay(spark, odd, small):
    docs = odd.unionByName(odd.where("doc_id is null").withColumn("text", F.lit("another row without an id and more words"))).cache()
    texts = lambda df: {r.text for r in df.where("doc_id is null").collect()}
    own = texts(docs) - {None}
    third = pipeline.keep_one_of_each_group(spark, docs, small).cache()
    assert texts(third) == own | {None} and third.where("doc_id is null").count() == docs.where("doc_id is null").count()
    fourth = pipeline.mix_to_weights(spark, third.where("doc_id is null"), small).cache()
    assert texts(fourth) == own and fourth.columns == docs.columns
    assert pipeline.pack_bins(spark, fourth, small).count() == fourth.count()


def test_own_columns_keep_their_values(spark, documents, small):
    """Columns with the names of the operators' own pass through all stages, with the rows that keep their text."""
    own = {"lang_pred": "mine", "lang_score": "7", "lang_spans": "s", "n_lines": "77", "removed_lines": "78", "size": "5", "taken": "6", "kept": "k", "_of": "o", "_text_hash": "h", "_copies": "c", "with space": "w"}
    given = documents.limit(60).withColumns({c: F.concat(F.lit(v), F.col("doc_id").cast("string")) for c, v in own.items()}).cache()
    docs = given
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == given.columns
    rows = docs.collect()
    assert rows and all(r[c] == f"{v}{r.doc_id}" for r in rows for c, v in own.items())


def test_one_id_with_two_texts_and_repeated_rows(spark, small):
    """Different texts under one id are different documents; of equal rows near-dedup keeps one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (5, b, "en", "s"), (6, b, "en", "t"), (7, c, "en", None), (None, c, "en", None), (None, c, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    third = pipeline.keep_one_of_each_group(spark, docs, small).cache()
    assert sorted((str(r.doc_id), r.text) for r in third.collect()) == [("5", a), ("5", b), ("7", c), ("None", c), ("None", c)]
    fourth = Counter((r.doc_id, r.text) for r in pipeline.mix_to_weights(spark, third, small).collect())
    assert set(fourth) <= {(5, a), (5, b), (7, c), (None, c)} and fourth[None, c] <= 4 and 5 <= sum(fourth.values()) <= 10


def test_odd_rows(spark, odd, none, small):
    for start in (odd, none):
        docs = start
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, small)
            assert name == "packing" or docs.columns == start.columns
        docs.collect()


def test_equal_id_and_text_but_other_columns(spark, small):
    """Which of such rows stays does not depend on their order."""
    text = "some words that stand in all of these rows and in no other one"
    rows = [(1, text, lang, source, n) for lang in ("en", "fr", None) for source in ("a", "b") for n in (1, 2)] + [(2, "quite another text of a few words here", "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, other = (spark.createDataFrame(r, schema).repartition(k) for r, k in ((rows, 2), (rows[::-1], 3)))
    for stage in (pipeline.keep_one_of_each_group, pipeline.mix_to_weights):
        got, again = (sorted(map(str, stage(spark, df, small).collect())) for df in (one, other))
        assert got == again and got
    assert pipeline.keep_one_of_each_group(spark, one, small).count() == 2
