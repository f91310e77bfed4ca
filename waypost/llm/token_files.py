"""Token ids of documents in flat binary files, written and read by Spark tasks.

Format of a part, three files in a folder of the shared workspace:

* ``ids``      unsigned little-endian integers, 2 bytes wide where every id
               fits, else 4, all documents one after another;
* ``offsets``  64-bit unsigned: the first id of each document, and the end;
* ``doc_ids``  64-bit signed: the document of each offset; the first ``nulls``
               of a part, a column of the table of parts, have none.

Documents are range-partitioned and sorted by doc_id and a hash of the text, so
parts in order hold all documents in order and rows of one id, or of none, may
fill any number of parts. Part sizes are known after writing; their prefix sums
give each part's base, and base + offset is a document's place in the corpus.
Reading memory-maps the three files where the shared folder is a mounted file
system, and fetches ranges of bounded size where it is not.

A task writes under a name of its own attempt and the table of parts lists the
files of the attempts that succeeded, so a retried or lost task leaves no
half-written part behind in the result.

Defined cases: a null or empty text yields only the end id. Rows with a null
doc_id come first. Rows of one doc_id are all kept, ordered by a hash of the
text, then by the text; equal rows are equal documents. An empty table gives no
parts and no rows. Only doc_id and text are read, so further columns may bear any
name. A very long text is encoded by the task that writes it, a
slice of texts at a time, and its ids are summed piece by piece when read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import pieces
from .workspace import new_folder, written

_PARTS = "part int, path string, width int, docs long, nulls long, tokens long, first_doc long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Words whose ids one worker remembers; beyond that it forgets them all and starts again.
_MEMORY = 800_000
_SLICE_BYTES = 1 << 21
#: Documents read back at a time, and ids of one.
_READ_DOCS, _PIECE_IDS = 4096, 1 << 20
_SEPARATOR = "\x01"
_TOKENIZERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts by encoding each distinct word once.

    The tokenizer drops white space before it forms tokens, so the ids of a
    text are those of its pieces between ASCII white space, in order. It also
    lower-cases, so pieces are told apart without the case of A-Z; texts that
    may hold a special token, which is found before lower-casing, keep theirs.

    New pieces are encoded many at a time, with a separator between them whose
    ids occur in none of them.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._type = np.dtype(f"<u{self.width}")
        alone = self._tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self._separator = alone[0] if len(alone) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._bounds = np.zeros(1, dtype=np.int64)
        self._ids = np.empty(0, dtype=self._type)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        plain = [i for i, w in enumerate(words) if _SEPARATOR not in w] if self._separator is not None else []
        sizes = np.zeros(len(words), dtype=np.int64)
        joined = [" ".join(f"{_SEPARATOR} {words[i]}" for i in plain[at : at + 256]) for at in range(0, len(plain), 256)]
        parts = [np.array(e.ids, dtype=self._type) for e in self._tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.empty(0, dtype=self._type)
        cuts = np.flatnonzero(ids == self._separator) if parts else np.empty(0, dtype=np.int64)
        sizes[plain] = np.diff(np.append(cuts, len(ids))) - 1
        if len(plain) == len(words):
            return np.delete(ids, cuts), sizes
        rest = sorted(set(range(len(words))) - set(plain))
        own = {i: self._tokenizer.encode(words[i], add_special_tokens=False).ids for i in rest}
        together = np.split(np.delete(ids, cuts), np.cumsum(sizes[plain])[:-1]) if plain else []
        own |= dict(zip(plain, together, strict=True))
        sizes[rest] = [len(own[i]) for i in rest]
        return np.concatenate([np.asarray(own[i], dtype=self._type) for i in range(len(words))]), sizes

    def _rows(self, words: list[str]) -> np.ndarray:
        """The places of words among those known; unknown ones are learnt."""
        known = self._place.get
        rows = [known(w, -1) for w in words]
        new = [w for w, r in zip(words, rows, strict=True) if r < 0]
        if not new:
            return np.array(rows, dtype=np.int64)
        if self._place and len(self._place) + len(new) > _MEMORY:
            self._forget()
            return self._rows(words)
        ids, sizes = self._encoded(new)
        first = len(self._place)
        self._place.update(zip(new, range(first, first + len(new)), strict=True))
        self._bounds = np.concatenate([self._bounds, self._bounds[-1] + np.cumsum(sizes)])
        self._ids = np.concatenate([self._ids, ids])
        out = np.array(rows, dtype=np.int64)
        out[out < 0] = np.arange(first, first + len(new))
        return out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has; null counts as empty."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        texts = pc.if_else(special, texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(texts)
        upto = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        coded = pc.dictionary_encode(lists.flatten())
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        starts, sizes = self._bounds[rows], self._bounds[rows + 1] - self._bounds[rows]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._ids[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]
        return ids, np.diff(total[np.concatenate([[0], upto])])


def _encoder(path: str) -> WordEncoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordEncoder(path)
    return _TOKENIZERS[path]


class Blob:
    """Numbers of one file of the workspace, read by ranges: mapped where it is mounted, else fetched range by range."""

    def __init__(self, path: str, kind: str) -> None:
        files, name = _file_system(path)
        self._kind = np.dtype(kind)
        if isinstance(files, pafs.LocalFileSystem):
            size = os.path.getsize(name)
            self._mapped = np.memmap(name, dtype=kind, mode="r") if size else np.empty(0, dtype=kind)
        else:
            self._mapped, self._remote = None, files.open_input_file(name)

    def read(self, start: int, stop: int) -> np.ndarray:
        if self._mapped is not None:
            return self._mapped[start:stop]
        wide = self._kind.itemsize
        return np.frombuffer(self._remote.read_at((stop - start) * wide, start * wide), dtype=self._kind)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    uri = "s3://" + path.removeprefix("s3a://") if path.startswith("s3a://") else path
    try:
        return pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"token files can't be kept at {path}: Python tasks open local, hdfs, s3 and gs folders only") from e


def _created(path: str):
    files, name = _file_system(path)
    files.create_dir(os.path.dirname(name))
    return files.open_output_stream(name)


def _writer(tokenizer: str, end_id: int, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}"
        kind = np.dtype(f"<u{encoder.width}")
        at, docs, nulls, first, outs = 0, 0, 0, None, None
        for batch in batches:
            for piece in pieces(batch, 1, _SLICE_BYTES, batch.num_rows):
                if outs is None:
                    first = piece.column(0)[0].as_py()
                    outs = [_created(f"{path}/{x}") for x in ("ids", "offsets", "doc_ids")]
                docs += piece.num_rows
                nulls += piece.column(0).null_count
                outs[2].write(pc.fill_null(piece.column(0), 0).to_numpy().astype("<i8").tobytes())
                ids, counts = encoder.encode(piece.column(1).cast(pa.string()))
                ids = np.insert(ids, np.cumsum(counts), kind.type(end_id))
                outs[0].write(ids.astype(kind, copy=False).tobytes())
                ends = at + np.cumsum(counts + 1)
                outs[1].write(np.concatenate([[at], ends[:-1]]).astype("<u8").tobytes())
                at = int(ends[-1])
        if outs is not None:
            outs[1].write(np.array([at], dtype="<u8").tobytes())
            for x in outs:
                x.close()
            row = {"part": part, "path": path, "width": encoder.width, "docs": docs, "nulls": nulls, "tokens": at, "first_doc": first}
            yield pa.RecordBatch.from_pylist([row], schema=_PARTS_ARROW)

    return write


_PARTS_ARROW = pa.schema(
    [("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), *((c, pa.int64()) for c in ("docs", "nulls", "tokens", "first_doc"))]
)


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Encode and write ``documents`` (doc_id, text); return the table of parts with their bases."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ordered = ordered.sortWithinPartitions(*order, "text")
    parts = written(ordered.mapInArrow(_writer(tokenizer, end_id, new_folder(spark, "tokens")), _PARTS), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    return parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _checksum(ids: Blob, start: int, stop: int) -> int:
    crc = 0
    for at in range(start, stop, _PIECE_IDS):
        crc = zlib.crc32(ids.read(at, min(stop, at + _PIECE_IDS)).astype("<u4").tobytes(), crc)
    return crc


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for table in parts:
        for row in table.itertuples():
            offsets, doc_ids = Blob(f"{row.path}/offsets", "<u8"), Blob(f"{row.path}/doc_ids", "<i8")
            ids = Blob(f"{row.path}/ids", f"<u{row.width}")
            for at in range(0, row.docs, _READ_DOCS):
                to = min(row.docs, at + _READ_DOCS)
                own = offsets.read(at, to + 1).astype(np.int64)
                known = np.arange(at, to) >= row.nulls
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series(doc_ids.read(at, to).astype(np.int64), dtype="Int64").where(known),
                        "start": row.base + own[:-1],
                        "n_tokens": np.diff(own),
                        "ids_crc32": [_checksum(ids, a, b) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)],
                    }
                )


def read_token_files(parts: DataFrame) -> DataFrame:
    """Per document, from the mapped files: its place, length and checksum of ids as 32-bit integers. A task reads a part."""
    count = parts.count()  # a row per part
    return parts.repartitionByRange(max(1, count), "part").mapInPandas(_read, _READ)
