"""Byte-level BPE by monoid tree reduction.

The encoding of a piece of bytes is the reduction of its halves: each half is encoded by itself, and two neighbours are
joined by encoding a window around their boundary anew. The window grows until both of its seams are stable. A seam
between two tokens is stable if their two byte strings, encoded together, give the same two tokens; a token sequence
whose neighbours are all stable is the encoding of its bytes, so nothing outside the window can change. Joining is
associative, and decoding concatenates byte strings up the same tree.

A text is first cut into the matches of the vocabulary's pattern, and each match is encoded separately. Within a task
the encodings of short stretches between white space are kept in a bounded table, since a corpus repeats them.

Defined results: a null text is encoded like an empty one (no tokens); repeated rows give repeated results; an empty
table gives no rows; further columns of the input are not carried; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm._common import Lately, documents, ids_of_lists, slices

#: White space that is neither space, tab nor a line break: texts with it are cut by the pattern alone.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Every pattern match lies within one such stretch: a match can't go on from other characters to white space.
#: White space before a space, such as the pattern may take together; also what isn't told apart by a mark.
UNEVEN_SPACE = "[\\s\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] |\x00"
STRETCH = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


class ByteBPE:
    """The encoder for one vocabulary: ``ranks`` gives each token's bytes and id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 16, kept: int = 300_000):
        import regex

        self.ranks, self.find, self.leaf = ranks, regex.compile(pattern).findall, leaf
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.vocabulary = pa.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], pa.binary())
        self.decimals = pa.array(map(str, range(len(self.vocabulary))), pa.string())
        self._seams, self._pieces = Lately(kept), Lately(kept)

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a few bytes: merge the neighbours of lowest rank, the leftmost first, as long as any merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 64:
            return self._merged_by_heap(parts)
        rank, never = self.ranks.get, 1 << 62
        ranks = [rank(data[i : i + 2], never) for i in range(len(parts) - 1)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ranks.pop(i)
            parts[i] += parts.pop(i + 1)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], never)
        return [self.ranks[p] for p in parts]

    def _merged_by_heap(self, parts: list[bytes | None]) -> list[int]:
        """The same for many bytes, in time n log n."""
        after, before = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)]
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if (rank := self.ranks.get(both)) is not None:
                    heapq.heappush(heap, (rank, i, len(both)))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has changed since
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[p] for p in parts if p is not None]

    def stable(self, left: int, right: int) -> bool:
        try:
            return self._seams[left, right]
        except KeyError:
            self._seams.put((left, right), known := self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right])
            return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings one after the other."""
        i, j = min(1, len(left)), min(1, len(right))
        if not i or not j or self.stable(left[-1], right[0]):
            return left + right
        while True:
            window = self.merged(self.decode(chain(left[len(left) - i :], right[:j])))
            sure_left = i == len(left) or self.stable(left[-i - 1], window[0])
            sure_right = j == len(right) or self.stable(window[-1], right[j])
            if sure_left and sure_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = min(len(left), i * (2 - sure_left)), min(len(right), j * (2 - sure_right))

    def reduce(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def piece(self, text: str) -> tuple[int, ...]:
        try:
            return self._pieces[text]
        except KeyError:
            data = text.encode()
            own = self.ranks.get(data)
            ids = (own,) if own is not None else tuple(self.reduce(data))
            if len(text) <= 64:
                self._pieces.put(text, ids)
            return ids

    def stretch(self, text: str) -> tuple[int, ...]:
        """The ids of a text whose first and last characters are no part of matches beyond it."""
        core = text.rstrip(",.")
        if core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):  # letters, and what the pattern parts from them
            return self.piece(core) + self.piece(text[len(core) :]) if len(core) < len(text) else self.piece(text)
        return tuple(chain.from_iterable(map(self.piece, self.find(text))))

    def encode(self, text: str) -> list[int]:
        if RARE_SPACE.search(text):
            return list(chain.from_iterable(map(self.piece, self.find(text))))
        return list(chain.from_iterable(map(self.stretch, STRETCH.findall(text))))

    def encode_all(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text.

        Where a text's single spaces all follow other characters than white space, matches begin there: such texts
        are cut at them, and each distinct stretch of a batch is encoded once.
        """
        plain = pc.and_(pc.invert(pc.match_substring_regex(texts, UNEVEN_SPACE)), pc.not_equal(texts, ""))
        rows = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        # What follows a space is marked by one of its own; only a text's first stretch has none.
        words = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rows)), " ", "\x00 "), "\x00")
        ids, at = ids_of_lists(words, lambda found: [self.stretch(x) for x in found])
        if len(rows) == len(texts):
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
        out: list = [None] * len(texts)
        for i, row in enumerate(rows):
            out[row] = ids[at[i] : at[i + 1]]
        for row in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)):
            out[row] = np.array(self.encode(texts[int(row)].as_py()), np.int32)
        return pa.array(out, pa.list_(pa.int32()))

    def decode_all(self, ids: pa.ListArray) -> pa.BinaryArray:
        parts = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), self.vocabulary.take(ids.flatten()))
        return pc.binary_join(parts, b"")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """From a file with a token's bytes in base 64 and its rank in each line; kept from task to task."""
    with open(path, "rb") as lines:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row of ``docs(doc_id, text)``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for part in slices(batches):
            yield pa.record_batch([part["doc_id"], bpe.encode_all(part["text"])], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, text`` for every row of ``encoded(doc_id, ids)``; bytes that aren't UTF-8 become U+FFFD."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or ()).decode(errors="replace") for ids in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode and decode each text where it lies, and return digests of both instead of the tokens."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        digests = lambda data: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in data], pa.string())
        for part in slices(batches):
            ids = bpe.encode_all(part["text"])
            numbers = pc.binary_join(pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), bpe.decimals.take(ids.flatten())), " ")
            columns = [part["doc_id"], pc.list_value_length(ids).cast(pa.int64()), digests(numbers), digests(bpe.decode_all(ids))]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
