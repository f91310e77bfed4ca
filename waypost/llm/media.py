"""Media columns stored as deduplicated content-defined chunks.

A text becomes a media value: its UTF-8 bytes, filled up with spaces to a
multiple of 192, are the 8-bit samples of a mono WAV stream. The payload is
cut where a rolling gear hash of the last 32 bytes has its top bits zero, so
equal passages give equal chunks wherever they stand. The store has

* ``manifests``: per document its payload digest and ordered chunk digests;
* ``pool``: each chunk that occurs more than once, stored once, by digest;
* ``inline``: per payload the chunks that occur nowhere else.

Which digests repeat is found by grouping all of them in Spark. A Bloom filter
of fixed size tells the writing tasks, so the bytes of chunks that occur once
are never shuffled: a false hit only moves a chunk to the pool, where it is
still stored once. The filter is the only thing sent to all tasks; its size is
a parameter and does not depend on the data.

Reading joins the chunk lists with the pool, puts the chunks in order, checks
the digest of the whole payload and computes features, once for each distinct
payload; documents then look up their payload's row.

Defined cases: null and empty texts are one block of spaces. Repeated rows and
null doc_ids are kept, row by row; equal texts are one payload. A very long text
is cut like any other, in windows, and restored whole in one task. An empty
table gives an empty result. Only doc_id and text are read, so further columns
may bear any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import pieces
from .workspace import written

BLOCK = 192
SAMPLE_RATE = 8000
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 8192, 10
#: Bits of the filter of repeated chunks, a power of two: 8 MB for any corpus.
FILTER_BITS = 1 << 26
_GEAR = np.random.default_rng(192).integers(0, 2**32, 256, dtype=np.uint32)
_BATCH_BYTES = 1 << 20
_MANIFEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha binary, header binary, chunks array<binary>"
_INLINE = "payload_sha binary, header binary, n_chunks int, places array<int>, bodies array<binary>"
_MEDIA = "payload_sha binary, media_bytes long, media_sha256 string, tail_crc32 long, feature string"


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def wav_header(payload_bytes: int) -> bytes:
    """The 44 bytes before 8-bit mono PCM samples."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + payload_bytes, b"WAVE") + form + struct.pack("<4sI", b"data", payload_bytes)


def gear_cuts(data: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Positions after which the rolling hash of the last 32 bytes permits a cut."""
    total = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # sums of 2, 4, .. 32 shifted terms
        longer = total.copy()
        longer[shift:] += total[:-shift] << np.uint32(shift)
        total = longer
    return np.flatnonzero(total >> np.uint32(32 - bits) == 0) + 1


def chunk_bounds(size: int, cuts: list[int], smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of a payload of ``size`` bytes, given its permitted cuts in order."""
    ends, start = [], 0
    for cut in cuts:
        while cut - start > largest:
            start += largest
            ends.append(start)
        if cut - start >= smallest and cut < size:
            start = cut
            ends.append(cut)
    while size - start > largest:
        start += largest
        ends.append(start)
    return [*ends, size]


def chunked(payloads: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each payload."""
    at = 0
    while at < len(payloads):
        to, size = at, 0
        while to < len(payloads) and (to == at or size + len(payloads[to]) <= _BATCH_BYTES):
            size += len(payloads[to])
            to += 1
        cuts, base = gear_cuts(np.frombuffer(b"".join(payloads[at:to]), dtype=np.uint8)), 0
        for p in payloads[at:to]:
            lo, hi = np.searchsorted(cuts, [base + 32, base + len(p)])
            ends = chunk_bounds(len(p), (cuts[lo:hi] - base).tolist())
            yield [p[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            base += len(p)
        at = to


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _payloads(batch: pa.RecordBatch, column: int) -> tuple[list[int], list[bytes]]:
    texts = [t or b"" for t in batch.column(column).to_pylist()]
    return [len(t) for t in texts], [payload_of(t) for t in texts]


def _manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in pieces(batch, 1, _BATCH_BYTES)):
        sizes, payloads = _payloads(part, 1)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(sizes, pa.int64()),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()),
                pa.array([wav_header(len(p)) for p in payloads], pa.binary()),
                pa.array([[chunk_digest(c) for c in x] for x in chunked(payloads)], pa.list_(pa.binary())),
            ],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha", "header", "chunks"],
        )


def repeated_filter(manifests: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A Bloom filter with four hashes of the chunk digests that occur more than once."""
    repeated = manifests.select(F.explode("chunks").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = [F.conv(F.hex(F.substring("digest", 1 + 4 * k, 4)), 16, 10).cast("long").bitwiseAND(bits - 1) for k in range(4)]
    places = repeated.select(F.explode(F.array(*words)).alias("place"))
    table = places.groupBy(F.shiftright("place", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 31 as int))")).alias("mask")
    )
    filled = np.zeros(bits // 32, dtype="<u4")
    found = table.toArrow()
    filled[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return filled.tobytes()


def _hits(filled: np.ndarray, digests: list[bytes]) -> np.ndarray:
    places = np.frombuffer(b"".join(digests), dtype=">u4").astype(np.int64).reshape(-1, 4) & (32 * len(filled) - 1)
    return (filled[places >> 5] >> (places & 31).astype(np.uint32) & 1).all(axis=1)


def _split(shared, pooled: bool):
    """(text) -> the chunks that the filter knows, by digest, or the others, by payload."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(shared.value, dtype="<u4")
        for part in (p for batch in batches for p in pieces(batch, 0, _BATCH_BYTES)):
            _, payloads = _payloads(part, 0)
            digests, bodies, rows = [], [], []
            for p, chunks in zip(payloads, chunked(payloads), strict=True):
                own = [chunk_digest(c) for c in chunks]
                hits = _hits(filled, own)
                if pooled:
                    for k in np.flatnonzero(hits).tolist():
                        digests.append(own[k])
                        bodies.append(chunks[k])
                elif not hits.all():
                    left = np.flatnonzero(~hits).tolist()
                    rows.append((hashlib.sha256(p).digest(), wav_header(len(p)), len(chunks), left, [chunks[k] for k in left]))
            if pooled:
                first = {d: b for d, b in zip(digests, bodies, strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), pa.array(list(first.values()), pa.binary())], names=["digest", "body"])
            else:
                kinds = [pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary())]
                columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=["payload_sha", "header", "n_chunks", "places", "bodies"],
                )

    return split


def features(samples: np.ndarray) -> str:
    """Level, loudness, sign changes about the middle and range of 8-bit samples."""
    level = samples.astype(np.int64) - 128
    changes = int(np.count_nonzero((level[1:] >= 0) != (level[:-1] >= 0)))
    return f"n={len(level)};sum={level.sum()};energy={(level * level).sum()};crossings={changes};min={level.min()};max={level.max()}"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their places -> the media value, checked, and what is computed from it."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):  # one payload at a time
            row = batch.slice(i, 1).to_pylist()[0]
            places = [*(row["places"] or []), *(x["place"] for x in row["refs"] or [])]
            bodies = [*(row["bodies"] or []), *(x["body"] for x in row["refs"] or [])]
            payload = b"".join(b for _, b in sorted(zip(places, bodies, strict=True)))
            if hashlib.sha256(payload).digest() != row["payload_sha"]:
                raise ValueError(f"a stored payload differs from its digest {row['payload_sha'].hex()}")
            media = row["header"] + payload
            samples = np.frombuffer(media, dtype=np.uint8, offset=44)
            out.append((row["payload_sha"], len(media), hashlib.sha256(media).hexdigest(), zlib.crc32(payload[-16:]), features(samples)))
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            names=["payload_sha", "media_bytes", "media_sha256", "tail_crc32", "feature"],
        )


def store_media(documents: DataFrame, filter_bits: int = FILTER_BITS) -> dict[str, DataFrame]:
    """Write manifests, pool and inline chunks of ``documents`` (doc_id, text)."""
    spark: SparkSession = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    manifests = written(source.mapInArrow(_manifests, _MANIFEST), "manifests")
    shared = spark.sparkContext.broadcast(repeated_filter(manifests, filter_bits))
    texts = source.select("text")
    pool = texts.mapInArrow(_split(shared, True), "digest binary, body binary").groupBy("digest").agg(F.first("body").alias("body"))
    return {
        "manifests": manifests,
        "pool": written(pool, "pool"),
        "inline": written(texts.mapInArrow(_split(shared, False), _INLINE), "inline"),
    }


def read_media(store: dict[str, DataFrame]) -> DataFrame:
    """Per distinct payload its restored and checked media value's digests and features."""
    manifests, pool, inline = store["manifests"], store["pool"], store["inline"]
    payloads = manifests.groupBy("payload_sha").agg(F.first("header").alias("header"), F.first("chunks").alias("chunks"))
    listed = payloads.select("payload_sha", "header", F.posexplode("chunks").alias("place", "digest"))
    refs = listed.join(pool, "digest").groupBy("payload_sha").agg(
        F.first("header").alias("header"), F.collect_list(F.struct("place", "body")).alias("refs")
    )
    none = F.lit(None).cast("array<struct<place:int,body:binary>>")
    whole = inline.where(F.size("bodies") == F.col("n_chunks")).select("payload_sha", "header", "places", "bodies", none.alias("refs"))
    rest = inline.where(F.size("bodies") < F.col("n_chunks")).select("payload_sha", "places", "bodies")
    mixed = refs.join(rest, "payload_sha", "left").select("payload_sha", "header", "places", "bodies", "refs")
    return whole.union(mixed).mapInArrow(_restore, _MEDIA)


def media_columns(documents: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Store, read back and describe the media value of every row of ``documents``."""
    store = store_media(documents, filter_bits)
    media = written(read_media(store), "media")
    rows = store["manifests"].select("doc_id", "n_bytes", "payload_bytes", "payload_sha")
    out = rows.join(media, "payload_sha")
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload_sha")).alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
