import hashlib
import random
import zlib

import numpy as np
import pytest

from waypost.llm import media


def expected(text):
    data = (text or "").encode()
    payload = data + b" " * (-len(data) % 192 if data else 192)
    stored = media.wav_header(len(payload)) + payload
    level = [b - 128 for b in payload]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(level[:-1], level[1:], strict=True))
    feature = f"n={len(level)};sum={sum(level)};energy={sum(x * x for x in level)};crossings={crossings};min={min(level)};max={max(level)}"
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def described(df, **more):
    rows = media.media_columns(df, **more).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in rows)


def test_round_trip(documents):
    rows = documents.select("doc_id", "text").collect()
    assert described(documents) == sorted((str(r.doc_id), *expected(r.text)) for r in rows)


@pytest.mark.parametrize("bits", [1 << 6, 1 << 20])
def test_odd_rows_with_any_filter(odd, bits):
    """A filter that is full sends every chunk to the pool; the result is the same."""
    rows = odd.select("doc_id", "text").collect()
    assert described(odd, filter_bits=bits) == sorted((str(r.doc_id), *expected(r.text)) for r in rows)


def test_empty_table(none):
    assert media.media_columns(none).count() == 0


def test_equal_passages_give_equal_chunks():
    rng = random.Random(1)
    shared = bytes(rng.randrange(256) for _ in range(60_000))
    a, b = media.chunked([bytes(range(256)) * 3 + shared, b"other" * 77 + shared])
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert b"".join(a).endswith(shared) and max(map(len, a)) <= media.MAX_CHUNK


def test_gear_hash_equals_the_rolling_one():
    data = np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8)
    h, cuts = 0, []
    for i, byte in enumerate(data.tolist()):
        h = (h * 2 + int(media._GEAR[byte])) % 2**32
        if h >> (32 - media.CUT_BITS) == 0:
            cuts.append(i + 1)
    assert [c for c in media.gear_cuts(data).tolist() if c > 32] == [c for c in cuts if c > 32]


def test_repeated_chunks_are_stored_once(spark):
    rng = random.Random(2)
    body = " ".join(str(rng.random()) for _ in range(3000))
    df = spark.createDataFrame([(i, f"start {i} {body}") for i in range(5)], "doc_id long, text string")
    store = media.store_media(df)
    pooled = store["pool"].selectExpr("sum(length(body)) n").collect()[0].n
    assert pooled < 1.2 * len(body)
    assert store["pool"].count() == store["pool"].select("digest").distinct().count()


def test_a_damaged_store_is_noticed(spark, documents):
    store = media.store_media(documents.limit(20))
    store["inline"] = store["inline"].selectExpr("payload_sha", "header", "n_chunks", "places", "transform(bodies, b -> concat(b, b)) bodies")
    with pytest.raises(Exception, match="differs from its digest"):
        media.read_media(store).collect()
