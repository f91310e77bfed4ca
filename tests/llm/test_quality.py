import zlib

import numpy as np

from waypost.llm import quality


def test_held_out_accuracy(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.predict_quality(documents, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    long = {r.doc_id for r in documents.where("length(text) > 6000").select("doc_id").collect()}
    own = [r for r in rows if r.doc_id in long]
    assert len(own) >= 10 and sum(r.predicted == r.quality for r in own) >= 0.9 * len(own)


def plain_score(net, text):
    """The network one place at a time."""
    data = text.ljust(max(2, -(-(len(text) + quality._PADDING) // quality.HALF)) * quality.HALF, b"\0")
    before = bytes(quality.HALF) + data
    here = lambda k: before[k + quality.HALF - 7 : k + quality.HALF + 1]
    repeats = [any(here(k) == here(k - lag) for lag in quality.LAGS) for k in range(len(data))]
    at = lambda k: data[k] + 256 * repeats[k]
    responses = {
        k: sum(net.filters[j, at(k + j)].astype(float) for j in range(quality.WIDTH))
        for k in range(0, len(data) - quality.WIDTH + 1, quality.STRIDE)
        if k < len(data) - quality.WIDTH
    }
    chunks = []
    for start in range(0, len(data) - quality.HALF, quality.HALF):
        own = [r for k, r in responses.items() if start <= k < start + 2 * quality.HALF]
        chunks.append(np.maximum(np.max(own, axis=0) + net.bias, 0))
    inputs = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + np.exp(-(inputs @ net.weights + net.offset)))


def test_scores_against_plain_loops():
    rng = np.random.default_rng(4)
    net = quality.fit_network([b"abc " * 50, b"xyz!" * 60] * 4, np.array([1, 0] * 4), steps=20)
    texts = [b"", b"a", b"ab " * 90, bytes(rng.integers(97, 123, 208, dtype=np.uint8)), bytes(rng.integers(97, 123, 209, dtype=np.uint8)), "déjà vu. ".encode() * 70]
    texts.append(bytes(rng.integers(32, 123, 1500, dtype=np.uint8)))
    assert np.allclose(quality.score_bytes(net, texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(3)
    net = quality.fit_network([b"abc " * 50, b"xyz!" * 60] * 4, np.array([1, 0] * 4), steps=20)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (0, 1, 5, 255, 256, 257, 1000, 90_000)]
    together = quality.score_bytes(net, texts)
    assert np.allclose(together, np.concatenate([quality.score_bytes(net, [t]) for t in texts]), atol=1e-5)


def test_the_end_of_a_long_text_counts():
    net = quality.fit_network([b"good words here " * 20, b"#### %%%% #### " * 20] * 8, np.array([1, 0] * 8), steps=80)
    clean = b"good words here " * 400
    assert quality.score_bytes(net, [clean])[0] > quality.score_bytes(net, [clean + b"#### %%%% #### " * 400])[0]


def test_repeats_are_marked():
    marked = quality.symbols_of(np.frombuffer(b"abcdefgh ab ab ab ab ab ab", dtype=np.uint8)) >= 256
    assert not marked[:18].any() and marked[20:].all()


def test_the_sample_is_bounded_and_fixed(spark, monkeypatch):
    """At most so many rows, the same ones however they are partitioned, with whole texts."""
    seen = []
    monkeypatch.setattr(quality, "fit_network", lambda texts, labels: seen.append((texts, labels.tolist())))
    rows = [(i // 2, f"text {i} " * (i * 50)) for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] * 2, "doc_id long, quality int")
    for parts in (1, 5):
        quality.fit(documents.repartition(parts), labels.repartition(parts), 60)
    assert seen[0] == seen[1] and len(seen[0][0]) == 60 and set(seen[0][0]) <= {t.encode() for _, t in rows}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 0, 1), (3, None, 0), (None, 1, 0), (7, 5, 0)], "doc_id long, quality int, toxic int")
    rows = quality.predict_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.predict_quality(none, labels).count() == 0
    assert {r.score for r in quality.predict_quality(odd, labels.where("quality = 9")).collect()} == {0.5}
