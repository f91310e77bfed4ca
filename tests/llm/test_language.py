import zlib

import numpy as np
import pytest

from waypost.llm import language


@pytest.fixture(scope="module")
def model(documents):
    return language.fit(documents)


@pytest.mark.parametrize("window", [1, 7, 64, 1000])
def test_viterbi_is_optimal(window):
    rng = np.random.default_rng(window)
    counts = np.array([0, 1, 5, 300, 3, 0, 90])
    scores = -rng.exponential(3, (counts.sum(), 3)).astype(np.float32)
    path, at = language.viterbi(scores, counts, switch=4.0, window=window), 0
    for n in counts:
        own, got = scores[at : at + n].astype(float), path[at : at + n]
        at += n
        if n:
            best = own[0].copy()
            for row in own[1:]:
                best = np.maximum(best, best.max() - 4.0) + row
            assert own[np.arange(n), got].sum() - 4.0 * (got[1:] != got[:-1]).sum() == pytest.approx(best.max(), abs=1e-2)


def test_held_out_accuracy(documents):
    rows = language.predict_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_mixed_text_gives_spans(documents, model):
    de, fr = (documents.where(f"lang = '{x}' and n_chars > 500").first().text for x in ("de", "fr"))
    mixed = " ".join(de.split()[:60] + fr.split()[:40])
    names, score, spans = language.label_texts([mixed, de], model)
    assert names == ["de", "de"] and 0.4 < score[0] < 0.8 and score[1] > 0.95
    long = [s for s in spans[0] if s["words"] > 20]
    assert [s["lang"] for s in long] == ["de", "fr"]
    w = language.words_of([mixed])
    assert sum(s["words"] for s in spans[0]) == w.counts[0]


def test_scripts_narrow(spark):
    rows = [(i, "привет мир как дела", "ru") for i in range(8)] + [(i + 8, "hello world how are you", "en") for i in range(8)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language.label_texts(["незнакомое", "unknown", "123 !?", "", "日本"], model)[0] == ["ru", "en", "und", "und", "en"]
    assert language.label_texts(["日本"], model)[1].tolist() == [0.0]


def test_rare_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "LEAST_ROWS", 5)
    rows = [(i, "hello world how are you", "en") for i in range(3000)] + [(i + 3000, "привет мир как дела", "ru") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, sample_rows=20)
    assert model.languages == ["en", "ru"]
    assert language.label_texts(["незнакомое"], model)[1].tolist() == [1.0]
    assert language.rows_per_language([3, 3000], 20) == 17
    assert language.rows_per_language([6, 7, 8], 21) >= 8 and language.rows_per_language([1000] * 10, 20) == 5 and language.rows_per_language([], 20) == 5


def test_words_of_many_lines():
    w = language.words_of(["a b\nc", "", "\n", "dé, x2y", "ß"])
    assert w.counts.tolist() == [3, 0, 0, 3, 1]
    assert len(w.widths) == w.distinct.max() + 1


def test_odd_rows(odd, none):
    rows = language.predict_languages(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert language.predict_languages(none).count() == 0
    again = language.identify(odd, language.fit(none))
    assert {r.lang_pred for r in again.collect()} == {"und"}
