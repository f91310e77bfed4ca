"""Quality of whole texts by a byte-level convolutional network in numpy.

Input symbols are the UTF-8 bytes, each with one extra bit that says whether
the eight bytes up to here repeat those a few bytes before (a filter of fixed
width cannot see a repetition of unknown length). Filters of learned weights
for every symbol at every place of their width slide over the text with a
stride of two. Their responses are max-pooled over chunks of 256 bytes that
overlap by half and together cover the whole text; the mean and the maximum
over all chunks enter a logistic unit.

The network is fitted on the driver on whole texts of at most ``SAMPLE_ROWS``
labelled rows, those whose id has the smallest hash. Scoring reads whole texts,
some half chunks at a time, so memory does not grow with a text beyond itself.

Defined cases: a null or empty text is one chunk of padding. Labels other than
0 and 1 are not used. Repeated labels and repeated rows count each, in an order
that does not depend on their partitions. Without labels of both kinds every
score is the share of label 1, or 0.5 without any label. Rows with a null
doc_id are scored, never used for fitting and count as not held out. An empty
table gives an empty result. Only doc_id and text are read, so further columns
may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import pieces

#: Labelled rows that the network is fitted on at most.
SAMPLE_ROWS = 3000
WIDTH, STRIDE, FILTERS, HALF = 8, 2, 24, 128
SYMBOLS = 512
LAGS = range(2, 33)
_PADDING = 48
STEPS, BATCH, RATE = 500, 32, 0.01
_SLICE_BYTES, _SLICE_ROWS = 1 << 19, 1024
#: Half chunks whose responses are held at a time, to stay in the processor's cache.
_HALVES = 1 << 9


def symbols_of(data: np.ndarray) -> np.ndarray:
    """Bytes, plus 256 where the last eight equal those some lag before."""
    repeated = np.zeros(len(data), dtype=bool)
    for lag in LAGS:
        same = data[lag:] == data[:-lag]
        for step in (1, 2, 4):
            same = same[step:] & same[:-step]
        if len(same):
            repeated[lag + 7 :] |= same
    return data.astype(np.int16) + 256 * repeated.astype(np.int16)


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x SYMBOLS x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # of the mean and the maximum of each filter
    offset: float


def _halves(n: int) -> int:
    return max(2, -(-(n + _PADDING) // HALF))


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each filled up to whole half chunks, and their numbers of half chunks.

    Every text has padding before and behind it that is longer than what a
    symbol looks back and a filter looks ahead, so texts do not see each other.
    """
    halves = np.fromiter((_halves(len(t)) for t in texts), dtype=np.int64, count=len(texts))
    joined = b"".join(t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves, strict=True))
    return symbols_of(np.frombuffer(bytes(HALF) + joined + bytes(WIDTH), dtype=np.uint8))[HALF:], halves


def _responses(net: Network, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Half chunks x places x FILTERS responses at every STRIDE-th place; ``last`` marks the last halves of texts."""
    per = HALF // STRIDE
    count = len(last) * per
    out = np.zeros((count, net.filters.shape[2]), dtype=np.float32)
    for j in range(WIDTH):
        out += net.filters[j].take(symbols[j : j + count * STRIDE : STRIDE], axis=0)
    out = out.reshape(len(last), per, -1)
    out[last, -(WIDTH // STRIDE) :] = -np.inf  # there the filter would reach the next text
    return out


def _last(halves: np.ndarray) -> np.ndarray:
    out = np.zeros(int(halves.sum()), dtype=bool)
    out[np.cumsum(halves) - 1] = True
    return out


def _pooled(net: Network, symbols: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per half chunk the largest response of each filter, and its place."""
    total, last = int(halves.sum()), _last(halves)
    best = np.empty((total, net.filters.shape[2]), dtype=np.float32)
    place = np.empty(best.shape, dtype=np.int64)
    for at in range(0, total, _HALVES):
        to = min(total, at + _HALVES)
        r = _responses(net, symbols[at * HALF : to * HALF + WIDTH], last[at:to])
        place[at:to] = r.argmax(1)
        best[at:to] = np.take_along_axis(r, place[at:to, None, :], 1)[:, 0]
    return best, place


def _chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first half of every chunk, and the chunks of each text."""
    n, starts = halves - 1, np.cumsum(halves) - halves
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    return first, n


def score_bytes(net: Network, texts: list[bytes]) -> np.ndarray:
    symbols, halves = padded(texts)
    total, last = int(halves.sum()), _last(halves)
    best = np.empty((total, net.filters.shape[2]), dtype=np.float32)
    for at in range(0, total, _HALVES):
        to = min(total, at + _HALVES)
        best[at:to] = _responses(net, symbols[at * HALF : to * HALF + WIDTH], last[at:to]).max(1)
    first, n = _chunks(halves)
    active = np.maximum(np.maximum(best[first], best[first + 1]) + net.bias, 0)
    begin = np.cumsum(n) - n
    inputs = np.concatenate([np.add.reduceat(active, begin) / n[:, None], np.maximum.reduceat(active, begin)], 1)
    return 1 / (1 + np.exp(-np.clip(inputs.astype(np.float64) @ net.weights + net.offset, -30, 30)))


def fit_network(texts: list[bytes], labels: np.ndarray, seed: int = 8, steps: int = STEPS) -> Network:
    """Adam on the logistic loss over batches of as many texts of label 0 as of label 1."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, dtype=np.float32),
        rng.normal(0, 0.1, 2 * FILTERS),
        0.0,
    )
    zero, one = np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)
    if not len(zero) or not len(one):
        rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
        net.weights[:] = 0
        net.offset = float(np.log(rate / (1 - rate)))
        return net
    moments = [[np.zeros_like(np.asarray(p, dtype=np.float64)) for p in (net.filters, net.bias, net.weights, net.offset)] for _ in range(2)]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(zero, BATCH // 2), rng.choice(one, BATCH // 2)])
        own = [texts[i] for i in rows]
        symbols, halves = padded(own)
        best, place = _pooled(net, symbols, halves)
        first, n = _chunks(halves)
        second = best[first + 1] > best[first]
        raw = np.where(second, best[first + 1], best[first]) + net.bias
        active = np.maximum(raw, 0)
        begin = np.cumsum(n) - n
        mean = np.add.reduceat(active, begin) / n[:, None]
        top = np.maximum.reduceat(active, begin)
        inputs = np.concatenate([mean, top], 1).astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(inputs @ net.weights + net.offset, -30, 30)))
        error = (p - labels[rows]) / len(rows)
        d_inputs = error[:, None] * net.weights
        owner = np.repeat(np.arange(len(rows)), n)
        d_active = (d_inputs[:, :FILTERS] / n[:, None])[owner]
        d_active += np.where(active == top[owner], d_inputs[owner, FILTERS:], 0)
        d_raw = np.where(raw > 0, d_active, 0)
        half = first[:, None] + second
        at = half * HALF + place[half, np.arange(FILTERS)] * STRIDE
        columns = np.broadcast_to(np.arange(FILTERS), at.shape)
        d_filters = np.zeros(net.filters.shape)
        for j in range(WIDTH):
            np.add.at(d_filters[j], (symbols[at + j], columns), d_raw)
        grads = (d_filters + 1e-5 * net.filters, d_raw.sum(0), inputs.T @ error + 1e-4 * net.weights, error.sum())
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        moved = []
        for k, (value, g) in enumerate(zip((net.filters, net.bias, net.weights, net.offset), grads, strict=True)):
            moments[0][k] = 0.9 * moments[0][k] + 0.1 * g
            moments[1][k] = 0.99 * moments[1][k] + 0.01 * g * g
            update = moments[0][k] / (1 - 0.9**step) / (np.sqrt(moments[1][k] / (1 - 0.99**step)) + 1e-8)
            moved.append(value - rate * update)
        net = Network(moved[0].astype(np.float32), moved[1].astype(np.float32), moved[2], float(moved[3]))
    return net


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Fit on rows of ``documents`` (doc_id, text) with a quality in ``labels`` (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("label_id"), "quality")
    share = min(1.0, 2 * sample_rows / max(1, known.count()))  # about twice as many, of which the first are taken
    hashed = F.pmod(F.xxhash64("label_id", F.lit(8)), F.lit(1 << 40))
    known = known.select("*", hashed.alias("place")).where(F.col("place") < F.lit(round(share * (1 << 40))))
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(known, F.col("doc_id") == F.col("label_id"))
    picked = rows.select("place", "doc_id", F.xxhash64("text").alias("text_hash"), F.col("quality").cast("int").alias("quality"), "text")
    table = picked.orderBy("place", "doc_id", "text_hash", "quality").limit(sample_rows).toArrow()
    return fit_network([t or b"" for t in table.column("text").to_pylist()], table.column("quality").to_numpy())


def score_texts(documents: DataFrame, net: Network) -> DataFrame:
    """documents (doc_id, text) -> doc_id, held_out, score."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, _SLICE_BYTES, _SLICE_ROWS):
                scores = score_bytes(shared.value, [t or b"" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores)], names=["doc_id", "held_out", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double")


def predict_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the rows that are not held out and score all: doc_id, held_out, score, predicted."""
    trusted = documents.where(F.col("doc_id").isNotNull() & ~is_held_out())
    open_labels = labels.where(F.col("doc_id").isNotNull() & ~is_held_out())
    scored = score_texts(documents, fit(trusted, open_labels, sample_rows))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
