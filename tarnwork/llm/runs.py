"""Periodic runs of words by Lyndon arrays on ordered alphabets, in linear time.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. It is found at one of
its roots: the longest Lyndon word that begins there is one period long, in the order of words or in the reverse one. So
for each order a single scan finds for every position the next smaller suffix (where its longest Lyndon word ends) and
how far both agree. The scan keeps the stretch that reaches furthest and is known to repeat an earlier one. Inside it,
agreements are looked up at the earlier copy or follow from suffixes between which a suffix lies; words are only
compared beyond its end. Words are ranked by sorting; there is neither a suffix structure nor a hash.

Each text is one row's work, in memory linear in its words; rows are never gathered, so hot groups don't matter.

Defined results: a null text has no words and no run; empty texts likewise; repeated rows are treated each; an empty
table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm._common import documents, slices

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
#: Words beyond which positions are kept as machine integers instead of Python's.
LONG = 1 << 17


def ranked_words(texts: pa.StringArray) -> Iterator[np.ndarray]:
    """For each text the ranks of its words among the distinct words of all ``texts``, in byte order."""
    split = pc.ascii_split_whitespace(texts)
    words, offsets = split.flatten(), split.offsets.to_numpy()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    ends = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    ranks = pc.rank(words, tiebreaker="dense").to_numpy().astype(np.int64)[real]
    return (ranks[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def lyndon(s: list[int]) -> tuple[list[int], list[int]]:
    """For each position where the next smaller suffix begins (its longest Lyndon word ends), and how many symbols both suffixes share.

    Suffixes before ``j`` of which none smaller has followed yet form a chain, through ``before``. ``j`` ends those that
    are greater. ``shared[c]`` is what c shares with ``before[c]``. ``s[left:left + end - right] == s[right:end]``, and
    both differ after that.
    """
    n = len(s)
    after, agree, before, shared = [n] * n, [0] * n, [-1] * n, [0] * n
    if n > LONG:
        after, agree, before, shared = (array("q", x) for x in (after, agree, before, shared))
    left = right = end = 0
    for j in range(1, n):
        x, c, popped, m = s[j], j - 1, -1, 0
        while c >= 0:
            y = s[c]
            if y > x:
                after[c] = j
                popped, m, c = c, 0, before[c]
                continue
            if y < x:
                before[j] = c
                break
            # What the suffix popped last shares with c and with j decides, unless both are equal.
            told = shared[popped] if popped >= 0 else 0
            if popped >= 0 and told != m:
                if told < m:
                    before[j], shared[j] = c, told
                    break
            else:
                m = m or 1
                if j + m < end:
                    at, exact = _copied(c, j, right - left, right, end, after, agree, before, shared)
                    m = max(m, at)
                else:
                    exact = False
                if not exact:
                    while j + m < n and s[c + m] == s[j + m]:
                        m += 1
                    if j + m > end:
                        left, right, end = c, j, j + m
                if j + m < n and s[c + m] < s[j + m]:
                    before[j], shared[j] = c, m
                    break
            after[c], agree[c] = j, m
            popped, c = c, before[c]
    return after, agree


def _copied(c: int, j: int, shift: int, right: int, end: int, after: list[int], agree: list[int], before: list[int], shared: list[int]) -> tuple[int, bool]:
    """What the suffixes at c and j < end share by the earlier copy of ``right:end``: a number, and whether that's all."""
    j0, inside = j - shift, end - j
    if c >= right:
        c0 = c - shift
        if after[c0] == j0:
            found = agree[c0]
        elif before[j0] == c0:
            found = shared[j0]
        else:
            return 0, False
        return min(found, inside), found != inside
    # All suffixes between c and j are greater than both: a greater c lies between j and j0, which agree to the end.
    if c < j0 and before[j0] == c:
        return min(shared[j0], inside), shared[j0] < inside
    return 0, False


def runs(s: list[int], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``length >= max(least_length, least_exponent * period)``, by start and period.

    Args:
        s: integers whose order is that of the symbols.
        least_exponent: at least 2.
    """
    found, most = set(), max(s, default=0)
    for symbols in (s, [most - x for x in s]):
        after, agree = lyndon(symbols)
        if max(agree, default=0) < max(1, least_exponent - 1):
            continue
        ends, common = np.array(after, np.int64), np.array(agree, np.int64)
        periods = ends - np.arange(len(s))
        # From its first root on, a run lacks less than one period.
        for i in np.flatnonzero(common > np.maximum(least_length, least_exponent * periods) - 2 * periods).tolist():
            period = int(periods[i])
            if i >= period and after[i - period] == i and agree[i - period] >= period:
                continue
            start = i
            while start and s[start - 1] == s[start - 1 + period]:
                start -= 1
            length = i + period + agree[i] - start
            if length >= max(least_length, least_exponent * period):
                found.add((start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is collapsed to its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def find_runs(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, change: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: the columns of ``RUNS`` and ``runs``, all runs as structs.

    ``start`` to ``exponent_milli`` tell the longest run (then the first, then that of the smallest period), null if
    there is none. ``collapsed_sha256`` is of the words that ``kept`` leaves, joined by spaces. No row is shuffled.

    Args:
        change: gives the numbers of the words to look at instead (None: all), from a row's doc_id and number of words.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, ranks in zip(batch["doc_id"].to_pylist(), batch["text"], ranked_words(batch["text"]), strict=True):
                words = text.as_buffer().to_pybytes().split()
                if change and (at := change(doc_id, len(words))) is not None:
                    words, ranks = [words[i] for i in at.tolist()], ranks[at]
                found = runs(ranks.tolist(), least_length, least_exponent)
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
                left = list(compress(words, kept(len(words), found))) if found else words
                start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
                digests = (hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(left)))
                rows.append((doc_id, len(found), start, length, period, 1000 * length // period if found else None, *digests, found))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = [c.split()[0] for c in RUNS.split(", ")] + ["runs"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))]
    # Python's bytes and Arrow's ASCII white space are both space, tab and the controls 0x0A to 0x0D.
    return docs.select("doc_id", "text").mapInArrow(find, RUNS + ", runs array<struct<start: long, length: long, period: long>>")


def collapse_runs(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` with each run collapsed to its first period; a text without runs stays as it is."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, ranks in zip(batch["text"].to_pylist(), ranked_words(batch["text"]), strict=True):
                found = runs(ranks.tolist(), least_length, least_exponent)
                out.append(b" ".join(compress(text.encode().split(), kept(len(ranks), found))).decode() if found else text)
            yield pa.record_batch([batch["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(collapse, "doc_id long, text string")


def _with_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's change: in a tenth of the documents the words from some place on become periodic. Rows without a doc_id stay as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % period)


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all ``documents``, some of whose ends are made periodic first: the columns of ``RUNS``.

    A null or empty text has no runs, and so four nulls; repeated rows are treated each; an empty table gives no rows.
    """
    return find_runs(documents(spark, sf_dir), change=_with_tail).drop("runs")
