"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document's set holds the hashes of its distinct five-word shingles. Two
permutations make the signature: the first places a shingle on a ring of 2**32
positions, the second, shifted along the ring by k, ranks it for coordinate k.
Documents that agree on all coordinates of a band are candidates; each
candidate link is confirmed on the full sets.

Work is done on classes (documents of one set), not on documents, so that any
number of copies costs one row. Candidates are confirmed in steps:

1. Within a band's bucket every class is compared with one representative, the
   class that shares most buckets with others. Large groups of true near copies
   are one component after that.
2. In buckets whose classes still lie in different components, classes of sizes
   in proportion meet in blocks of bounded size. What meets is a parity sketch of
   ``SKETCH_BITS``: a bit that differs is a shingle that only one set has, so the
   sketch rules pairs out and never loses one. For two components the pair with
   the nearest sketches is confirmed first; then, where components are still
   apart, all pairs that the sketches leave.

Pairs inside one component cannot change the result, so every candidate link
counts, without a row for each pair of a bucket. Texts are fetched for the pairs
to confirm only.

Defined cases: a null or wordless text has an empty set, is linked with nothing
and is its own component. A row with a null doc_id is linked with nothing, its
component is null and it is not kept. Repeated rows are one class and get equal
results. Rows of one doc_id with different texts are told apart and need not be
in one component. A very long text is hashed in windows; its set has to fit in
a task. An empty table gives an empty result; only doc_id and text are read, so
further columns may bear any name. Shingle hashes have 64 bits: two of a pair's
shingles collide with a probability below 1e-10 even for texts of 20,000 words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces
from .components import connected_components
from .words import WordHasher, mix64, shingle_hashes
from .workspace import drop, written

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
#: 32 bands of 4 rows miss a pair of similarity 0.75 with a probability of 5e-6.
BANDS, ROWS = 32, 4
SKETCH_BITS = 2048
#: Sets whose sketches are made together.
_SKETCH_ROWS = 128
#: Classes of a block.
BLOCK = 1024
#: Classes are dealt by the logarithm of their size to this base, a little more than the ratio of sizes that can match.
_SIZE_BASE = 1.34
_BATCH_BYTES = 1 << 20
_SCHEMA = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def _second_permutation(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit values, in place."""
    np.multiply(x, np.uint32(0x7FEB352D), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(0x846CA68B), out=x)
    return x


def signatures(shingles: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` minima per set; ``sizes`` must be positive."""
    first = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(sizes), coordinates), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    step = 1 << 15  # elements that stay in the processor's cache
    for at in range(0, len(first), step):
        part = first[at : at + step]
        lo = np.searchsorted(bounds, at, side="right") - 1
        hi = np.searchsorted(bounds, at + len(part), side="left")
        cuts = np.maximum(bounds[lo:hi] - at, 0)
        x, spare = np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.add(part, np.uint32(k), out=x)
            least = np.minimum.reduceat(_second_permutation(x, spare), cuts)
            np.minimum(out[lo:hi, k], least, out=out[lo:hi, k])
    return out


def _distinct(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each set, and their numbers."""
    out, n, at = [], np.zeros(len(sizes), dtype=np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        if size:
            own = np.sort(shingles[at : at + size])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            out.append(own)
            n[i] = len(own)
            at += size
    return np.concatenate(out) if out else shingles[:0], n


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def sketches(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of SKETCH_BITS bits for every set, each flipped by the shingles that fall on it."""
    out = np.zeros((len(sizes), SKETCH_BITS // 8), dtype=np.uint8)
    place = (mix64(shingles ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, len(sizes), _SKETCH_ROWS):
        to = min(len(sizes), at + _SKETCH_ROWS)
        owner = np.repeat(np.arange(to - at), sizes[at:to])
        odd = np.bincount(owner * SKETCH_BITS + place[ends[at] : ends[to]], minlength=(to - at) * SKETCH_BITS) & 1
        out[at:to] = np.packbits(odd.astype(bool).reshape(to - at, SKETCH_BITS), axis=1)
    return out


def sign(batches: Iterator[pa.RecordBatch], bands: int = BANDS, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text as binary) -> set size, 128-bit set digest, band digests, sketch."""
    hasher = WordHasher()
    for batch in batches:
        for part in pieces(batch, 2, _BATCH_BYTES):
            texts = [t or b"" for t in part.column(2).to_pylist()]
            words, counts = hasher.words(texts)
            shingles, n = _distinct(*shingle_hashes(words, counts, WIDTH))
            a, b = _sums(mix64(shingles), n), _sums(mix64(shingles ^ np.uint64(0xD6E8FEB86659FD93)), n)
            digest = np.zeros((len(texts), bands), dtype=np.uint64)
            full = n > 0
            sig = signatures(shingles, n[full], bands * rows).astype(np.uint64).reshape(-1, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
            for r in range(rows):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            digest[full] = key
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(n),
                    pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(digest.ravel().view(np.int64))),
                    pa.array([x.tobytes() for x in sketches(shingles, n)], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> the pairs (a, b) whose sets are similar enough."""
    hasher = WordHasher()
    for batch in batches:
        for part in pieces(batch, 2, _BATCH_BYTES):
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts = dict(zip([*a, *b], [*part.column(2).to_pylist(), *part.column(3).to_pylist()], strict=True))  # each class once
            words, counts = hasher.words([t or b"" for t in texts.values()])
            values, n = _distinct(*shingle_hashes(words, counts, WIDTH))
            sets = dict(zip(texts, np.split(values, np.cumsum(n)[:-1]), strict=True))
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
            total = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(a, b, strict=True)])
            keep = (DENOMINATOR * both >= NUMERATOR * (total - both)) & (both > 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("class_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return written(joined.mapInArrow(_confirm, "a long, b long"), "links")


def possible_pairs(ids: np.ndarray, component: np.ndarray, n: np.ndarray, own: np.ndarray, block: np.ndarray, bits: np.ndarray, nearest: bool) -> list[tuple[int, int]]:
    """The pairs of a unit of work that sizes and sketches leave; with ``nearest`` one for every two components."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    every = []
    one_block = (block == block[0]).all()
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        fits = (component[rest] != component[i]) & (own[rest] | own[i])
        fits &= np.minimum(n[rest], n[i]) * DENOMINATOR >= np.maximum(n[rest], n[i]) * NUMERATOR
        if not one_block:
            fits &= block[rest] != block[i]
        near = np.flatnonzero(fits) + i + 1
        if not len(near):
            continue
        apart = np.bitwise_count(bits[near] ^ bits[i]).sum(1, dtype=np.int64)
        passed = apart * (DENOMINATOR + NUMERATOR) <= (n[near] + n[i]) * (DENOMINATOR - NUMERATOR)
        for j, d in zip(near[passed].tolist(), apart[passed].tolist(), strict=True):
            a, b = sorted((int(ids[i]), int(ids[j])))
            if nearest:
                key = tuple(sorted((int(component[i]), int(component[j]))))
                found[key] = min(found.get(key, (d, a, b)), (d, a, b))
            else:
                every.append((a, b))
    return [(a, b) for _, a, b in found.values()] if nearest else every


def _compare(nearest: bool):
    """Sorted (group key, x, y, class_id, component, n, own, block, sketch) -> pairs that may be similar."""

    def unit(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({r[0]: r for r in sorted(rows, key=lambda r: r[3])}.values())  # a class once, as its own where it is both
        if len(rows) < 2:
            return []
        ids, component, n, own, block = (np.array(c) for c in list(zip(*rows, strict=True))[:5])
        bits = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint64).reshape(len(rows), -1)
        return possible_pairs(ids, component, n, own, block, bits, nearest)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        pairs = lambda found: pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for batch in batches:
            found: list[tuple[int, int]] = []
            for *own_key, class_id, component, n, own, block, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != own_key:
                    found += unit(rows)
                    key, rows = own_key, []
                rows.append((class_id, component, n, own, block, sketch))
            yield pairs(found)
        yield pairs(unit(rows))

    return compare


def _across(members: DataFrame, found: DataFrame, classes: DataFrame, nearest: bool) -> DataFrame:
    """Pairs of different components that may be similar: members (bucket, class_id, n), found (node, component)."""
    labelled = members.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    size = F.floor(F.log(F.col("n")) / math.log(_SIZE_BASE))
    meets = F.explode(F.array(F.struct(size.alias("size"), F.lit(True).alias("own")), F.struct((size + 1).alias("size"), F.lit(False).alias("own"))))
    labelled = labelled.select("bucket", "class_id", "n", F.coalesce("component", "class_id").alias("component"), meets.alias("m"))
    labelled = labelled.select("bucket", F.col("m.size").alias("size"), "class_id", "n", "component", F.col("m.own").alias("own"))
    labelled = written(labelled, "labelled")
    groups = labelled.groupBy("bucket", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if("own").alias("owns"), F.count(F.lit(1)).alias("m"))
    groups = groups.where("lo <> hi and owns > 0").select("bucket", "size", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    units = labelled.join(groups, ["bucket", "size"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["bucket", "size", "x", "y"]
    units = units.select("bucket", "size", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "class_id", "component", "n", "own", "block")
    dealt = units.join(classes.select("class_id", "sketch"), "class_id").select(*keys, "class_id", "component", "n", "own", "block", "sketch")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    out = written(dealt.mapInArrow(_compare(nearest), "a long, b long").distinct(), "across")
    drop(labelled)
    return out


def near_duplicates(documents: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id, kept; and text_hash, first_hash: of the row, and of the first row of its component."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    signed = written(source.mapInArrow(lambda it: sign(it, bands, rows), _SCHEMA), "signed")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(first, F.first(F.struct("bands", "sketch")).alias("s"))
    classes = classes.select(F.monotonically_increasing_id().alias("class_id"), "set_a", "set_b", F.col("n_shingles").alias("n"), "first", "s.bands", "s.sketch")
    classes = written(classes, "classes")  # the ids hold for this table

    entries = classes.select("class_id", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = written(entries.join(shared, "bucket").select("bucket", "class_id", "n", "m"), "members")
    weights = members.groupBy("class_id").agg(F.sum("m").alias("weight"))
    named = classes.join(weights, "class_id", "left_semi").select("class_id", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = written(source.join(named, ["doc_id", "text_hash"]).select("class_id", "text"), "texts")

    weighed = members.join(weights, "class_id")
    central = F.max(F.struct("weight", (-F.col("class_id")).alias("c"), "n"))
    reps = weighed.groupBy("bucket").agg(central.alias("r")).select("bucket", (-F.col("r.c")).alias("rep"), F.col("r.n").alias("rep_n"))
    # DENOMINATOR * intersection >= NUMERATOR * union needs sizes in that ratio
    fits = F.least("n", "rep_n") * DENOMINATOR >= F.greatest("n", "rep_n") * NUMERATOR
    stars = members.join(reps, "bucket").where((F.col("class_id") != F.col("rep")) & fits)
    stars = written(stars.select(F.least("class_id", "rep").alias("a"), F.greatest("class_id", "rep").alias("b")).distinct(), "stars")
    links = _verified(stars, texts)
    found = written(connected_components(links), "found")
    for nearest in (True, False):
        more = _across(members, found, classes, nearest)
        if more.isEmpty():
            break
        linked = _verified(more, texts)
        if not linked.isEmpty():
            links = links.union(linked)
            found = written(connected_components(links), "found")

    grouped = found.join(classes.select(F.col("class_id").alias("node"), "first"), "node")
    firsts = grouped.groupBy("component").agg(F.min("first").alias("of_all"))
    grouped = grouped.join(firsts, "component").select(F.col("node").alias("class_id"), "of_all")
    labels = classes.select("class_id", "set_a", "set_b", F.col("n").alias("n_shingles"), "first").join(grouped, "class_id", "left")
    labels = labels.select("set_a", "set_b", "n_shingles", F.coalesce("of_all", "first").alias("head"))
    rows_of = ["doc_id", "text_hash", "n_shingles"]
    linked = signed.where("n_shingles > 0 and doc_id is not null").select(*rows_of, "set_a", "set_b").join(labels, ["set_a", "set_b", "n_shingles"])
    linked = linked.select(*rows_of, F.col("head.doc_id").alias("component_id"), F.col("head.text_hash").alias("first_hash"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select(*rows_of, F.col("doc_id").alias("component_id"), F.col("text_hash").alias("first_hash"))
    out = linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))
    out = written(out.select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "first_hash"), "components")
    drop(signed, classes, members, texts, stars, found)
    return out
