"""Token ids in files of fixed-width bits.

A data set is a folder with files of ids and a Parquet table ``index``, one row per file: where it lies and how many ids
of the whole set come before it. A file holds whole documents in ascending doc_id order: a mark, blocks of ids, each id
in the fewest bits that tell the vocabulary's ids apart, lowest bit first, then the blocks' offsets, the documents' ids
and ends, and sizes. Each block but the last holds the same number of ids, a multiple of eight, so blocks begin at whole
bytes, runs of blocks are unpacked by a few vector operations, and any id is found by its block's offset.

Writing shuffles the texts once, by ranges of doc_id; each task then encodes its range and streams it into files, so
memory doesn't grow with the range. Files are named by attempt, and the index names those of the attempts that Spark has
kept; a lost executor's or a repeated task's files are never read. Ties of doc_id are ordered by a hash of the text, so
repeated doc_ids, however many, spread over ranges.

Defined results: a null text counts as empty; rows without a doc_id come first; repeated rows are written each; an empty
table gives an empty index and no files; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm._common import discard, documents, materialize, slices, work_dir
from tarnwork.llm.packing import load

MARK = b"TWIDS001"
#: The last bytes of a file: width, ids of a block, ids, blocks, documents, and the mark.
SIZES = struct.Struct("<IIQQQ8s")
BLOCK_IDS = 1 << 14
#: Blocks that are unpacked at once.
STRETCH = 32
FILE_BYTES, FILE_DOCS = 128 << 20, 1 << 20
INDEX = "part long, number long, path string, n_docs long, n_ids long"


def bits_needed(vocabulary: int) -> int:
    """The width of ids from 0 to ``vocabulary - 1``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits of each id, lowest first, filled up to a whole byte. An id that needs more raises ValueError."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id of {int(ids.max())} has more than {width} bits")
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), width), np.uint8)  # eight ids take as many bytes as an id has bits
    for k in range(8):
        first, shift = divmod(k * width, 8)
        shifted = groups[:, k] << np.uint64(shift)
        for b in range((shift + width + 7) // 8):
            out[:, first + b] |= (shifted >> np.uint64(8 * b)).astype(np.uint8)
    return out.tobytes()[: (len(ids) * width + 7) // 8]


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids of what ``pack`` has made, as unsigned 32-bit integers."""
    groups = np.zeros((-(-count // 8), width), np.uint8)
    groups.reshape(-1)[: min(len(data), groups.size)] = np.frombuffer(data, np.uint8)[: groups.size]
    out = np.empty((len(groups), 8), "<u4")
    for k in range(8):
        first, shift = divmod(k * width, 8)
        bits = np.zeros(len(groups), np.uint64)
        for b in range((shift + width + 7) // 8):
            bits |= groups[:, first + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, k] = (bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:count]


class IdWriter:
    """Writes one file; holds a block of ids and what tells the documents apart."""

    def __init__(self, stream, width: int, block_ids: int = BLOCK_IDS):
        if block_ids % 8:
            raise ValueError("a block's ids must be a multiple of eight")
        self.stream, self.width, self.block_ids = stream, width, block_ids
        self.offsets, self.doc_ids, self.ends, self.n_ids = [len(MARK)], [], [], 0
        self.held, self.n_held = [], 0
        stream.write(MARK)

    @property
    def size(self) -> int:
        return self.offsets[-1]

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        full = self.block_ids * self.width // 8
        start = self.offsets[-1]
        self.offsets += [min(start + at, start + len(data)) for at in range(full, len(data) + full, full)]
        self.stream.write(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held, self.n_ids = self.n_held + len(ids), self.n_ids + len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n_ids)
        if self.n_held >= self.block_ids:
            joined = np.concatenate(self.held)
            whole = self.n_held - self.n_held % self.block_ids
            self._write(joined[:whole])
            self.held, self.n_held = [joined[whole:]], self.n_held - whole

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held))
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        for part in (np.array(self.offsets, "<u8"), np.array([d or 0 for d in self.doc_ids], "<i8"), np.array(self.ends, "<u8"), known):
            self.stream.write(part.tobytes())
        self.stream.write(SIZES.pack(self.width, self.block_ids, self.n_ids, len(self.offsets) - 1, len(self.ends), MARK))
        self.stream.close()


class IdFile:
    """Random access to the ids of one file, by places in it."""

    def __init__(self, file):
        self.file, size = file, file.size()
        *sizes, mark = SIZES.unpack(self._bytes(size - SIZES.size, SIZES.size))
        if mark != MARK or self._bytes(0, len(MARK)) != MARK:
            raise ValueError("not a file of token ids, or cut off")
        self.width, self.block_ids, self.n_ids, blocks, docs = sizes
        n = 8 * (blocks + 1) + 17 * docs
        table = self._bytes(size - SIZES.size - n, n)
        self.offsets = np.frombuffer(table, "<u8", blocks + 1)
        doc_ids, self.ends = (np.frombuffer(table, kind, docs, 8 * (blocks + 1) + at * docs) for kind, at in (("<i8", 0), ("<u8", 8)))
        known = np.frombuffer(table, np.uint8, docs, 8 * (blocks + 1) + 16 * docs)
        self.doc_ids = [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist(), strict=True)]

    def _bytes(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n - 1``; only their blocks are read."""
        n = max(0, min(n, self.n_ids - start))
        if not n:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        data = self._bytes(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        return unpack(data, self.width, start + n - first * self.block_ids)[start - first * self.block_ids :]

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """``(doc_id, start, n, parts)`` of each document in turn; ``parts`` are its ids, and are to be taken before the next."""
        most, at, held = self.block_ids * STRETCH, 0, np.empty(0, "<u4")

        def parts(start: int, end: int) -> Iterator[np.ndarray]:
            nonlocal at, held
            while start < end:
                if start >= at + len(held):
                    at = start - start % self.block_ids
                    held = self.ids(at, most)
                part = held[start - at : end - at]
                start += len(part)
                yield part

        start = 0
        for doc_id, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            yield doc_id, start, end - start, parts(start, end)
            start = end


def write_ids(docs: DataFrame, path: str, encode: Callable[[], Callable[[pa.StringArray], list[np.ndarray]]], vocabulary: int, *, block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every row of ``docs(doc_id, text)`` to a new data set at ``path``, in ascending doc_id order.

    Args:
        path: a URI of a folder that all executors reach.
        encode: called in each task; gives the function that turns texts into arrays of ids.
        vocabulary: the number of different ids.
        file_bytes: about the size of a file; documents stay whole.
    """
    width = bits_needed(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids_of, number, writer, target = TaskContext.get(), encode(), 0, None, ""
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)

        def close() -> pa.RecordBatch:
            writer.close()
            row = (task.partitionId(), number, target, len(writer.ends), writer.n_ids)
            return pa.record_batch([pa.array([x]) for x in row], [c.split()[0] for c in INDEX.split(", ")])

        for batch in slices(batches):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), ids_of(batch["text"]), strict=True):
                if writer is None:
                    target = f"{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.ids"
                    writer = IdWriter(store.open_output_stream(f"{folder}/{target}"), width, block_ids)
                writer.add(doc_id, ids)
                if writer.size >= file_bytes or len(writer.ends) >= FILE_DOCS:
                    yield close()
                    writer, number = None, number + 1
        if writer is not None:
            yield close()

    text = F.coalesce("text", F.lit(""))
    order = "doc_id", "tie"
    dealt = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    files = materialize(dealt.select("doc_id", "text").mapInArrow(write, INDEX), "ids-files")
    # What lies before a range: a row for each range; and before a file: the files of one range.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before.alias("before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = files.withColumn("within", within).join(ranges, "part").withColumn("start", F.col("before") + F.col("within"))
    index.drop("before", "within").write.parquet(f"{path}/index")
    discard(files)


def _opened(folder: str, name: str) -> IdFile:
    store, path = fs.FileSystem.from_uri(folder)
    return IdFile(store.open_input_file(f"{path}/{name}"))


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{INDEX}, start long").parquet(f"{path}/index")


def _read(spark: SparkSession, path: str, schema: str, value: Callable[[int, Iterator[np.ndarray]], object], kind: pa.DataType, most: int) -> DataFrame:
    """Rows of ``(doc_id, start, n_tokens, value(n, parts))``; batches end after ``most`` ids."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), kind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, start, n, parts in _opened(path, name).documents():
                    rows.append((doc_id, base + start, n, value(n, parts)))
                    held += n
                    if held >= most or len(rows) >= 10_000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    index = _index(spark, path)
    files = index.count()
    # A given number, so that small rows aren't put together: each stands for a file.
    return index.select("part", "number", "path", "start").repartitionByRange(max(1, min(files, 20_000)), "part", "number").mapInArrow(read, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of a data set; ``start`` counts the ids of all documents before it."""
    join = lambda n, parts: np.concatenate([np.empty(0, "<u4"), *parts]).astype(np.int64)
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids array<long>", join, pa.list_(pa.int64()), 1 << 20)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: as ``read_ids``, with the CRC-32 of the ids as little-endian 32-bit integers."""

    def crc(n: int, parts: Iterator[np.ndarray]) -> int:
        value = 0
        for part in parts:
            value = zlib.crc32(part.tobytes(), value)
        return value

    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", crc, pa.int64(), 1 << 62)


def read_span(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n - 1`` of a whole data set; only their blocks are read."""
    files = _index(spark, path).where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start)).orderBy("start").collect()
    return np.concatenate([np.empty(0, "<u4"), *(_opened(path, f.path).ids(max(0, start - f.start), start + n - max(start, f.start)) for f in files)])


def op12_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as 16-bit ids and read back: ``doc_id, start, n_tokens, ids_crc32``.

    A null text counts as empty (its closing id alone); rows without a doc_id come first, repeated rows each; an empty
    table gives no rows. The files stay in the shared folder, as the result is read from them.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, path = public_tokenizers.path("word_bpe_49k.json"), f"{work_dir(spark)}/tarnwork/ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), path, lambda: load(tokenizer).ids, Tokenizer.from_file(tokenizer).get_vocab_size())
    return read_digests(spark, path)
