"""Files of token ids: exact round trips, places of documents, random access."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import PythonFile
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwork.llm import bitpack
from tarnwork.llm.packing import load

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_widths():
    assert [bitpack.bits_needed(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("width", [1, 3, 7, 8, 9, 13, 16, 17, 24, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype("<u4")
        data = bitpack.pack(ids, width)
        assert len(data) == (n * width + 7) // 8
        assert (bitpack.unpack(data, width, n) == ids).all()
        bits = "".join(f"{x:0{width}b}"[::-1] for x in ids.tolist())
        assert data == bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    if width < 32:
        with pytest.raises(ValueError):
            bitpack.pack(np.array([1 << width], "<u4"), width)


@pytest.mark.parametrize("block_ids", [8, 64, 1 << 14])
def test_files(block_ids):
    rng, out = random.Random(3), io.BytesIO()
    docs = [(None if i == 2 else i * 7, np.array([rng.randrange(49408) for _ in range(rng.choice((0, 1, 5, 300, 3000)))], "<u4")) for i in range(60)]
    writer = bitpack.IdWriter(type("Kept", (), {"write": staticmethod(out.write), "close": lambda self: None})(), 16, block_ids)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    file = bitpack.IdFile(PythonFile(io.BytesIO(out.getvalue()), "r"))
    every = np.concatenate([ids for _, ids in docs])
    assert file.n_ids == len(every) and len(file.offsets) - 1 == -(-len(every) // block_ids)
    at = 0
    for (doc_id, start, n, parts), (expected, ids) in zip(file.documents(), docs, strict=True):
        assert (doc_id, start, n) == (expected, at, len(ids))
        assert (np.concatenate([np.empty(0, "<u4"), *parts]) == ids).all()
        at += n
    for _ in range(200):
        a, n = rng.randrange(len(every) + 5), rng.randrange(400)
        assert (file.ids(a, n) == every[a : a + n]).all()
    with pytest.raises(ValueError):
        bitpack.IdFile(PythonFile(io.BytesIO(out.getvalue()[:-3]), "r"))


def _expected(texts):
    """By the library, in ascending doc_id order; those of one doc_id as a multiset."""
    tokenizer, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [bitpack.FILE_BYTES, 20_000])
def test_data_set(spark, docs, texts, tmp_path, file_bytes):
    path = f"file://{tmp_path}/set"
    bitpack.write_ids(docs, path, lambda: load(WORDS).ids, 49408, block_ids=1024, file_bytes=file_bytes)
    expected = _expected(texts)  # the only repeated doc_id repeats its text
    assert sorted(map(tuple, bitpack.read_digests(spark, path).collect())) == expected
    rows = bitpack.read_ids(spark, path).orderBy("start").collect()
    every = np.array([x for r in rows for x in r.ids])
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows] == expected
    assert len(list((tmp_path / "set").glob("*.ids"))) == spark.read.parquet(f"{path}/index").count() > (10 if file_bytes < 1 << 20 else 0)
    for start, n in ((0, 5), (len(every) - 3, 10), (len(every) // 2, 50_000), (10**9, 4)):
        assert (bitpack.read_span(spark, path, start, n) == every[start : start + n]).all()


def test_odd_tables(spark, none, tmp_path):
    path = f"file://{tmp_path}/none"
    bitpack.write_ids(none, path, lambda: load(WORDS).ids, 49408)
    assert bitpack.read_digests(spark, path).count() == 0 and len(bitpack.read_span(spark, path, 0, 9)) == 0
    rows = [(5, "a"), (None, "b c"), (5, "b"), (5, None), (-2, "zz " * 40_000), (5, "a")]
    path = f"file://{tmp_path}/odd"
    bitpack.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, lambda: load(WORDS).ids, 49408, block_ids=64)
    found = bitpack.read_digests(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, -2, 5, 5, 5, 5]
    ends = np.cumsum([r.n_tokens for r in found]).tolist()
    assert [r.start for r in found] == [0, *ends[:-1]]
    by_crc = {r[3] for r in _expected([(i, t or "") for i, t in rows])}
    assert {r.ids_crc32 for r in found} == by_crc


def test_query_reads_its_files(spark):
    found = bitpack.op12_bit_packed_ids(spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert sorted(map(tuple, found)) == _expected(sorted(map(tuple, texts)))
