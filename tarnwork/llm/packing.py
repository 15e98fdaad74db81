"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention within it does. Documents are packed in
windows of bounded size within each partition, so no text is shuffled. In a window each document first gives up its
full-length pieces, each a sequence by itself; what is left goes, in descending order of length, to the sequence of
lowest cost that has room for it. The number of these sequences is the largest that the tokens fill; what finds no
room as a whole fills the gaps, cut to fit, and less than one sequence of tokens is left over.

What the windows leave over is packed the same way in a second pass, in groups of windows of about ``window_tokens``
tokens in all. So all sequences are full but for one in each of these groups, however the input is parted.

Defined results: a null text is packed like an empty one (its closing id alone); repeated rows are packed each; an
empty table gives no rows; further columns of the input are ignored; long documents are cut, never truncated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm._common import documents, materialize, slices

CAPACITY = 2048
CLOSING_ID = 1
#: Letters up to U+00FF, which have one lower case each.
LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"
#: Bytes of words that the table doesn't keep.
LONG_WORD = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Ids of whole texts: white space separates what the tokenizer sees, so the ids of a word are looked up once.

    Words of letters lose their case, and the pattern parts them from commas and full stops that follow; so these are
    looked up by themselves. The table of words is made of arrays, and has ``kept`` words at most: beyond that the half
    that was used last stays.
    """

    def __init__(self, path: str, kept: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.turn = Tokenizer.from_file(path), kept, 0
        self.merge = self.tokenizer.model.tokenize
        # Bytes as the byte-level vocabularies write them: printable ones as themselves, the others from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
        # The first word is the empty one, without ids; pool[ends[i]:ends[i + 1]] are those of word i.
        self.words, self.pool, self.ends, self.used = pa.array([""]), np.empty(0, np.int32), np.zeros(2, np.int64), np.zeros(1, np.int64)

    def _alone(self, word: str) -> tuple[int, ...]:
        """Of letters that the normalizer and the pattern leave as they are: merged at once; else by the whole tokenizer."""
        if word.isalpha() and word.islower() and (word.isascii() or max(word) <= "\xff"):
            return tuple([x.id for x in self.merge(word.encode().decode("latin-1").translate(self.shown))])
        return tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _keep(self, at: np.ndarray) -> None:
        """Only the words ``at`` these places stay, and the first."""
        at = np.union1d(0, at)
        n = np.diff(self.ends)[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        self.pool = self.pool[np.repeat(self.ends[at] - ends[:-1], n) + np.arange(ends[-1])]
        self.words, self.ends, self.used = self.words.take(pa.array(at)), ends, self.used[at]

    def places(self, words: pa.StringArray) -> np.ndarray:
        """Where distinct words are in the table, to which new ones are added."""
        self.turn += 1
        if len(self.words) > self.kept:
            self._keep(np.argsort(self.used, kind="stable")[-self.kept // 2 :])
        at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.words) + np.arange(len(new))
            added = words.take(pa.array(new))
            ids = [self._alone(w) for w in added.to_pylist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.words = pa.concat_arrays([self.words, added])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[at] = self.turn
        return at

    def ids(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text, with the closing one."""
        split = pc.ascii_split_whitespace(texts)
        words, offsets = split.flatten(), split.offsets.to_numpy()
        core = pc.utf8_rtrim(words, ",.")
        letters = pc.match_substring_regex(core, LETTERS)
        ended = np.flatnonzero(pc.and_(letters, pc.less(pc.binary_length(core), pc.binary_length(words))).to_numpy(zero_copy_only=False))
        tails = pc.replace_substring_regex(words.take(pa.array(ended)), r"^.*?([,.]+)$", r"\1").dictionary_encode()
        cores = pc.if_else(letters, pc.utf8_lower(core), words).dictionary_encode()
        known = pc.unique(pa.concat_arrays([cores.dictionary, tails.dictionary]))
        at = self.places(known)
        of = lambda coded: at[pc.index_in(coded.dictionary, known).to_numpy(zero_copy_only=False)][coded.indices.to_numpy(zero_copy_only=False)]
        # Each word's letters and then its tail, or the empty word.
        parts = np.zeros(2 * len(words), np.int64)
        parts[::2] = of(cores)
        parts[2 * ended + 1] = of(tails)
        n = np.diff(self.ends)[parts]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.ends[parts] - ends[:-1], n) + np.arange(ends[-1])]
        if len(long := np.flatnonzero(pc.binary_length(known).to_numpy(zero_copy_only=False) > LONG_WORD)):
            self._keep(np.setdiff1d(np.arange(len(self.words)), at[long]))
        cuts = ends[2 * (offsets - offsets[0])]
        return [np.append(ids[a:b], CLOSING_ID).astype("<u4") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    """Kept from task to task."""
    return WordTokens(path)


def balance(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 1024) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """One window of documents: the pieces ``(document, start, length, sequence, offset)`` of full sequences, and those ``(document, start, length)`` left over.

    See the module's docstring. What is left over is shorter than one sequence.
    """
    pieces = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((doc, start, capacity, len(pieces), 0))
    first, rest = len(pieces), sorted(((n % capacity, doc) for doc, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    count = sum(n for n, _ in rest) // capacity
    cost, filled, cut, over = np.zeros(count), np.zeros(count, np.int64), [], []

    def place(doc: int, start: int, n: int, at: int) -> None:
        pieces.append((doc, start, n, first + at, int(filled[at])))
        filled[at] += n
        cost[at] += linear * n + quadratic * n * n

    for n, doc in rest:
        fits = np.flatnonzero(filled + n <= capacity)
        if len(fits):
            place(doc, lengths[doc] - n, n, int(fits[cost[fits].argmin()]))
        else:
            cut.append((n, doc))
    for n, doc in cut:
        start = lengths[doc] - n
        while n and len(room := np.flatnonzero(filled < capacity)):
            at = int(room[filled[room].argmin()])
            part = min(n, capacity - int(filled[at]))
            place(doc, start, part, at)
            start, n = start + part, n - part
        if n:
            over.append((doc, start, n))
    return pieces, over


def _flat(rows: list[tuple], ids: list[bytes | None]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    return pa.record_batch([*columns, pa.array(ids, pa.binary())], [*PIECES.replace(" long", "").split(", "), "ids"])


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, window: int = 1024, window_tokens: int = 2_000_000) -> DataFrame:
    """Pack every row of ``docs(doc_id, text)``; one row per piece.

    Args:
        tokenizer: path of the tokenizer's file, on each executor.
        window: documents that are packed together at most; ``window_tokens`` bounds their tokens, but for one document.

    ``sequence_id`` holds the partition's number in its upper bits, and counts up within the partition; that of the second
    pass has bit 62 set. Full sequences are written before it, with the ids of what is left over, so texts are read once.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, used = load(tokenizer), TaskContext.get().partitionId() << 36, 0
        held, tokens = [], 0

        def flush() -> pa.RecordBatch:
            """The pieces of a window; one that is left over has the window's number as its sequence, and its ids."""
            nonlocal used, tokens
            pieces, over = balance([len(ids) for _, ids in held], capacity)
            rows, kept = [], [None] * len(pieces)
            for doc, start, n, sequence, offset in pieces:
                doc_id, ids = held[doc]
                rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + used + sequence, offset))
            for doc, start, n in over:
                doc_id, ids = held[doc]
                rows.append((doc_id, start, n, 0, len(ids), base + used, len(kept) - len(pieces)))
                kept.append(ids[start : start + n].tobytes())
            # A window without a full sequence has a number as well.
            used, tokens = used + max((p[3] + 1 for p in pieces), default=1), 0
            held.clear()
            return _flat(rows, kept)

        for batch in slices(batches):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.ids(batch["text"]), strict=True):
                held.append((doc_id, ids))
                tokens += len(held[-1][1])
                if len(held) >= window or tokens >= window_tokens:
                    yield flush()
        if held:
            yield flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used, held, tokens = 1 << 62 | TaskContext.get().partitionId() << 36, 0, [], 0

        def flush(last: bool) -> pa.RecordBatch:
            """The full sequences of what is held; at last the one that isn't full, too."""
            nonlocal used, tokens, held
            pieces, over = balance([x["length"] for x in held], capacity)
            if last:
                sequence, offset = max((p[3] + 1 for p in pieces), default=0), 0
                for doc, start, n in over:
                    pieces.append((doc, start, n, sequence, offset))
                    offset += n
            rows, left = [], []
            for doc, start, n, sequence, offset in pieces:
                x = held[doc]
                rows.append((x["doc_id"], x["start"] + start, n, zlib.crc32(x["ids"][4 * start : 4 * (start + n)]), x["doc_tokens"], base + used + sequence, offset))
            for doc, start, n in [] if last else over:
                x = held[doc]
                left.append({**x, "start": x["start"] + start, "length": n, "ids": x["ids"][4 * start : 4 * (start + n)]})
            used, held, tokens = used + max((p[3] + 1 for p in pieces), default=0), left, sum(x["length"] for x in left)
            return _flat(rows, [None] * len(rows)).drop_columns(["ids"])

        for batch in batches:
            for x in batch.to_pylist():
                held.append(x)
                tokens += x["length"]
                if len(held) >= 8 * window or tokens >= window_tokens:
                    if tokens >= capacity:
                        yield flush(False)
        if held:
            yield flush(True)

    placed = materialize(docs.select("doc_id", "text").mapInArrow(fill, f"{PIECES}, ids binary"), "packed")
    over = placed.where("ids IS NOT NULL")
    groups = -(-(over.agg(F.sum("length")).first()[0] or 0) // window_tokens)
    # A window leaves less than one sequence, so groups of whole windows are of like size.
    parted = over.repartition(max(1, groups), "sequence_id").sortWithinPartitions("sequence_id", "offset")
    return placed.where("ids IS NULL").drop("ids").unionByName(parted.mapInArrow(join, PIECES))


def op10_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents``: the columns of ``PIECES``, in sequences of 2,048 tokens.

    A null text is packed like an empty one, repeated rows each; an empty table gives no rows.
    """
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
