import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waypost.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def expected(plain, df):
    """The rows in order: without an id first, then by id, hash of the text and text."""
    start, out = 0, []
    for r in df.select("doc_id", "text").orderBy("doc_id", F.xxhash64("text"), "text").collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def result(df, **more):
    rows = token_files.read_token_files(token_files.write_token_files(df, PATH, **more)).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1])


def test_documents(documents, plain):
    assert result(documents) == expected(plain, documents)


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_rows(odd, plain, partitions):
    rows = result(odd, partitions=partitions)
    assert rows == expected(plain, odd) and [r[0] for r in rows[:3]] == [None, None, 1]


def test_many_rows_without_an_id(spark, plain):
    rows = [(None if i % 3 else i, f"text {i} of some") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = token_files.write_token_files(df, PATH, partitions=6)
    assert parts.where("nulls > 0").count() >= 4 and token_files.read_token_files(parts).rdd.getNumPartitions() == parts.count() == 6
    assert result(df, partitions=6) == expected(plain, df)


def test_checksum_in_pieces(monkeypatch):
    monkeypatch.setattr(token_files, "_PIECE_IDS", 7)
    ids = np.arange(100, dtype="<u2")

    class Whole:
        def read(self, a, b):
            return ids[a:b]

    assert token_files._checksum(Whole(), 3, 90) == zlib.crc32(ids[3:90].astype("<u4").tobytes())


def test_unknown_stores_are_named(tmp_path):
    with pytest.raises(ValueError, match="can't be kept at viewfs"):
        token_files._file_system("viewfs://store/tokens")
    assert token_files._file_system(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x"


def test_empty_table(none):
    assert result(none) == []


TEXTS = [
    "Hello<|endoftext|>x don't ﬁ Ｅ wide é a ́b 12345 ΣΑΣ. İi \x85 ​ x﻿", "", " \n", None, "日本語 テスト ١٢ 🙂🙂 a\x1cb \x1d\x0b\x0c  it's 'Tis we'LL",
    "a b　c᠎d", "<|start of|> <|startoftext|>", "x\x00y", "ab\x01c d \x01 e\x01", "<|ENDOFTEXT|> A", "  z ", "q" * 5000,
]


@pytest.mark.parametrize("memory", [1, 5, 1000])
def test_words_give_the_ids_of_the_text(plain, monkeypatch, memory):
    monkeypatch.setattr(token_files, "_MEMORY", memory)
    encoder = token_files.WordEncoder(PATH)
    for texts in (TEXTS, TEXTS[::-1], TEXTS[:3]):
        ids, counts = encoder.encode(pa.array(texts))
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_files(documents, plain):
    """The documented format, read without this library."""
    parts = token_files.write_token_files(documents, PATH, partitions=3).orderBy("first_doc").collect()
    ids, base = [], 0
    for p in parts:
        folder = p.path.removeprefix("file:")
        folder = "/" + folder.lstrip("/")
        own = np.fromfile(f"{folder}/ids", dtype=f"<u{p.width}")
        offsets, docs = np.fromfile(f"{folder}/offsets", dtype="<u8"), np.fromfile(f"{folder}/doc_ids", dtype="<i8")
        assert p.base == base and len(docs) == p.docs and offsets[-1] == len(own) == p.tokens and (np.diff(docs) >= 0).all()
        base += len(own)
        ids += own.tolist()
    texts = [r.text for r in documents.orderBy("doc_id").collect()]
    assert ids == [i for t in texts for i in [*plain.encode(t, add_special_tokens=False).ids, 1]]
