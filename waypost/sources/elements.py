"""Objects inside JSON documents, read by as many tasks as a document has blocks.

A document is one JSON value, often on one line, and may be larger than a task.
It is read as text that ends at closing braces, so Spark cuts it into blocks as
it would cut lines. A task goes through its blocks in order, batch by batch: what
is within a string follows from the quotes before it, how deep it is from the
brackets. A ``{`` under a key of the document's own object, or in an array there,
starts an element, which goes on until that depth is reached again.

A document of one block starts with nothing open, so it is done in one pass and
its text is never shuffled. Blocks of a larger one give their figures in that
pass; running aggregates of these tell what is open where a block starts, and a
second pass reads such documents again. An element that several blocks hold is
put together from its pieces.

Elements are numbered in file order: by the documents' paths, then by place. For
this, only the numbers of elements in a block and key are added up.

Limits: an element must fit in a row, and the name of a key that has a closing
brace in it must not be cut by the border of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scans
from ..storage import written

#: Kinds of rows that a pass gives.
_WHOLE, _BEGUN, _CONTINUED, _BLOCK, _FIGURES = range(5)
_FOUND = {
    "kind": "int", "path": "string", "block": "long", "key": "string", "place": "long", "text": "string", "list_key": "string", "size": "long",
    "read": "long", "inside": "int", "braces": "long", "brackets": "long", "braces_in": "long", "brackets_in": "long",
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.binary()}
_STRUCTURAL = np.zeros(256, dtype=bool)
_STRUCTURAL[list(b"{}[]")] = True
_BRACE, _BRACKET = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
_BRACE[list(b"{}")] = _BRACKET[list(b"[]")] = 1, -1


def _quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    quotes, slashes = np.flatnonzero(data == ord('"')), np.flatnonzero(data == ord("\\"))
    if not len(slashes):
        return quotes
    first = np.diff(slashes, prepend=-2) != 1
    escapes = (slashes - slashes[first][np.cumsum(first) - 1]) % 2 == 0
    escaped = np.zeros(len(data) + 1, dtype=bool)
    escaped[slashes[escapes] + 1] = True
    return quotes[~escaped[quotes]]


def _brackets(data: np.ndarray, quotes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of braces and brackets, and whether an odd number of quotes stands before each."""
    at = np.flatnonzero(_STRUCTURAL[data])
    return at, np.searchsorted(quotes, at) % 2 == 1


class _Figures:
    """What a block adds to quotes, braces and brackets, if it starts outside or within a string."""

    def __init__(self) -> None:
        self.inside, self.read, self.sums = 0, 0, np.zeros((2, 2), dtype=np.int64)

    def feed(self, data: bytes) -> Iterator[dict]:
        codes = np.frombuffer(data, dtype=np.uint8)
        quotes = _quotes(codes)
        at, odd = _brackets(codes, quotes)
        for within in (0, 1):  # within a string by the block's own quotes: outside if the block starts in one
            own = codes[at[odd == bool(within ^ self.inside)]]
            self.sums[within] += _BRACE[own].sum(), _BRACKET[own].sum()
        self.inside ^= len(quotes) % 2
        self.read += len(data)
        return iter(())

    def finish(self) -> Iterator[dict]:
        (braces, brackets), (braces_in, brackets_in) = self.sums.tolist()
        yield {"kind": _FIGURES, "inside": self.inside, "braces": braces, "brackets": brackets, "braces_in": braces_in, "brackets_in": brackets_in}


class _Elements:
    """The elements of a block, of which it is known what is open at its start."""

    def __init__(self, inside: int = 0, braces: int = 0, brackets: int = 0) -> None:
        self.inside, self.braces, self.brackets, self.read = inside, braces, brackets, 0
        self.list_key: bytes | None = None  # of the array opened last in this block
        self.counts: dict[bytes | None, int] = {}
        #: The row of an object that is open, without its text, and its pieces.
        self.open: dict = {"kind": _CONTINUED}
        self.pieces: list[bytes] = []
        self.held = b""  # a string of the document's own object that has not ended, so that a key is seen whole

    def _row(self, key: bytes | None) -> dict:
        place = self.counts.get(key, 0)
        self.counts[key] = place + 1
        return {"kind": _WHOLE, "key": key, "place": place}

    def feed(self, data: bytes) -> Iterator[dict]:
        self.read += len(data)
        data, self.held = self.held + data, b""
        codes = np.frombuffer(data, dtype=np.uint8)
        quotes = _quotes(codes)
        at, odd = _brackets(codes, quotes)
        at = at[odd == bool(self.inside)]
        kind = codes[at]
        braces, brackets = self.braces + np.cumsum(_BRACE[kind]), self.brackets + np.cumsum(_BRACKET[kind])
        opening, closing = (kind == ord("{")) & (braces == 2), (kind == ord("}")) & (braces == 1)  # these alternate
        starts, depths, ends = at[opening], brackets[opening], (at[closing] + 1).tolist()
        lists = at[(kind == ord("[")) & (braces == 1) & (brackets == 1)]

        def key_before(place: int) -> bytes | None:
            j = int(np.searchsorted(quotes, place))
            return data[int(quotes[j - 2]) + 1 : int(quotes[j - 1])] if j > 1 else None

        if self.braces > 1:
            self.pieces.append(data[: ends[0]] if ends else data)
            if ends:
                yield from self._closed()
                ends = ends[1:]
        keys = [self.list_key, *map(key_before, lists.tolist())]
        for k, (start, depth, array) in enumerate(zip(starts.tolist(), depths.tolist(), np.searchsorted(lists, starts).tolist(), strict=True)):
            if depth in (0, 1):
                row = self._row(keys[array] if depth else key_before(start))
            else:  # an object in an array of arrays is no element
                row = {"kind": _WHOLE, "place": -1}
            if k == len(ends):
                self.open, self.pieces = row, [data[start:]]
            elif row["place"] >= 0:
                yield row | {"text": data[start : ends[k]]}
        self.list_key = keys[-1]
        self.inside ^= len(quotes) % 2
        if len(at):
            self.braces, self.brackets = int(braces[-1]), int(brackets[-1])
        if self.inside and self.braces == 1 and len(quotes):
            self.held, self.inside = data[int(quotes[-1]) :], 0

    def _closed(self) -> Iterator[dict]:
        if self.open.get("place", 0) >= 0:
            yield self.open | {"text": b"".join(self.pieces)}
        self.open, self.pieces = {"kind": _CONTINUED}, []

    def finish(self) -> Iterator[dict]:
        if self.pieces:  # also of an object that is no element, so that pieces in later blocks are known as its own
            yield self.open | {"kind": max(self.open["kind"], _BEGUN), "text": b"".join(self.pieces)}
        inside = self.inside or int(self.held != b"")
        yield {"kind": _BLOCK, "list_key": self.list_key, "inside": inside, "braces": self.braces, "brackets": self.brackets}


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows of the same block."""
    ends = {len(batch)}
    for name in ("path", "block"):
        ends.update(pc.run_end_encode(batch[name]).run_ends.to_pylist())
    at = 0
    for end in sorted(ends):
        yield at, end
        at = end


def _found_in(start: Callable[[dict], _Figures | _Elements]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over fragments in order; ``start`` gives the reader of a block from the first row's other columns."""

    def row_batch(rows: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([r.get(name) for r in rows], _ARROW[kind]) for name, kind in _FOUND.items()]
        return pa.RecordBatch.from_arrays([a.view(pa.string()) if a.type == pa.binary() else a for a in arrays], list(_FOUND))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reader = None, None

        def finished() -> list[dict]:
            return [r | own | {"read": reader.read} for r in reader.finish()] if reader else []

        for batch in batches:
            rows: list[dict] = []
            values = pc.binary_join_element_wise(batch["value"], "", "}")
            bounds = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset :]
            rest = batch.drop_columns("value")
            for a, b in _runs(batch) if len(batch) else ():
                first = rest.slice(a, 1).to_pylist()[0]
                block = {"path": first["path"].encode(), "block": first["block"], "size": first["size"]}
                if block != own:
                    rows += finished()
                    own, reader = block, start(first)
                rows += [r | own for r in reader.feed(values.buffers()[2][bounds[a] : bounds[b]].to_pybytes())]
            yield row_batch(rows)
        yield row_batch(finished())

    return read


def _first_pass(row: dict) -> _Figures | _Elements:
    return _Elements() if row["length"] == row["size"] else _Figures()


def _second_pass(row: dict) -> _Elements:
    return _Elements(row["inside"], row["braces"], row["brackets"])


def _read(fragments: DataFrame, start: Callable[[dict], _Figures | _Elements]) -> DataFrame:
    return written(fragments.mapInArrow(_found_in(start), ", ".join(f"{n} {t}" for n, t in _FOUND.items())), "found")


def _states(figures: DataFrame) -> DataFrame:
    """What is open at the start of each block of documents that have several."""
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = figures.withColumn("begins", F.coalesce(F.bit_xor("inside").over(earlier), F.lit(0)))
    adds = [F.when(F.col("begins") == 0, F.col(c)).otherwise(F.col(f"{c}_in")).alias(c) for c in ("braces", "brackets")]
    sums = [F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long")).alias(c) for c in ("braces", "brackets")]
    return rows.select("path", "block", "begins", *adds).select("path", "block", F.col("begins").alias("inside"), *sums)


def _check(blocks: DataFrame) -> None:
    """An error if a document ends within a string, an object or an array."""
    last = F.max_by(F.struct("braces", "brackets", "inside"), "block").alias("end")
    ends = blocks.groupBy("path", "size").agg(last, F.sum("read").alias("read"))
    # the last fragment had no brace behind it if one byte more was counted than the file has
    open_ = F.col("end.braces") + (F.col("read") > F.col("size")).cast("int")
    bad = ends.where((open_ != 0) | (F.col("end.brackets") != 0) | (F.col("end.inside") != 0)).select("path").head(1)
    if bad:
        raise ValueError(f"not a whole JSON document: {bad[0].path}")


def _joined(pieces: DataFrame) -> DataFrame:
    """Elements that several blocks hold; a block has two pieces at most, the end of one object and the start of another."""
    upto = Window.partitionBy("path").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.withColumn("element", F.sum((F.col("kind") == _BEGUN).cast("int")).over(upto))
    begun = F.min(F.when(F.col("kind") == _BEGUN, F.struct("block", "key", "place"))).alias("own")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])
    whole = numbered.groupBy("path", "element").agg(begun, F.array_join(texts, "").alias("text"))
    return whole.where("own.place >= 0").select("path", "own.*", "text")


def _firsts(found: DataFrame) -> DataFrame:
    """For the elements of a block under a key, the key's name, and the ordinal of the first of them.

    ``key`` is null where the array was opened in an earlier block.
    """
    groups = found.where(F.col("kind").isin(_WHOLE, _BEGUN) & (F.col("place") >= 0)).groupBy("path", "block", "key").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lists = found.where(F.col("kind") == _BLOCK).select("path", "block", F.last("list_key", True).over(earlier).alias("before"))
    named = groups.join(lists, ["path", "block"]).withColumns({"named": F.col("key").isNotNull(), "name": F.coalesce("key", "before")}).where("name is not null")
    order = ["path", "block", "named"]
    placed = scans.accumulate(scans.ranged(named, ["name"], order), ["name"], order, {"upto": ("sum", F.col("n"))})
    return written(placed.select("path", "block", "key", "name", (F.col("upto") - F.col("n")).alias("first")), "firsts")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(key, ordinal, text) of the objects in a document, or in all documents of a folder.

    These are the objects that stand under a key of the document's own object,
    and those in arrays there. ``ordinal`` counts from 0 for each key, in file
    order over all documents. Other values than objects are left out. Only
    documents that end before they should are an error here.
    """
    names = {"path": "file_path", "size": "file_size", "block": "file_block_start", "length": "file_block_length"}
    raw = spark.read.option("lineSep", "}").text(path).select(*(F.col(f"_metadata.{v}").alias(k) for k, v in names.items()), "value")
    found = _read(raw, _first_pass)
    figures = found.where(F.col("kind") == _FIGURES)
    least = figures.agg(F.min("size")).head()[0]
    elements = found.where(F.col("kind") == _WHOLE)
    if least is not None:  # the smallest document of several blocks
        states = F.broadcast(_states(figures))  # a row for each of their blocks
        again = _read(raw.where((F.col("size") >= least) & (F.col("length") < F.col("size"))).join(states, ["path", "block"]), _second_pass)
        found = found.unionByName(again)
        elements = found.where(F.col("kind") == _WHOLE)
        columns = ["path", "block", "key", "place", "text"]
        elements = elements.select(*columns).unionByName(_joined(again.where(F.col("kind").isin(_BEGUN, _CONTINUED))).select(*columns))
    _check(found.where(F.col("kind") == _BLOCK))
    firsts = _firsts(found).alias("f")
    same = (F.col("e.path") == F.col("f.path")) & (F.col("e.block") == F.col("f.block")) & F.col("e.key").eqNullSafe(F.col("f.key"))
    return elements.alias("e").join(firsts, same).select(F.col("f.name").alias("key"), (F.col("first") + F.col("place")).alias("ordinal"), "text")
