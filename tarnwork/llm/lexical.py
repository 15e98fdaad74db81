"""Ranked lexical search by WAND, shard by shard of the documents.

Two passes over the documents, neither of which shuffles texts. The first counts documents, terms, and the documents
that hold each term of the queries; the second cuts each partition into shards of bounded size, inverts each shard for
the queries' terms, with the greatest impact of each term there, and walks the postings of each query: the terms whose
next documents come first are added up until their greatest impacts could reach the worst of the best so far; the
document where that happens is the pivot, and all before it are skipped unseen. The heaps are carried from shard to
shard of a partition and merged at last, first by salted item, then by item.

Queries are taken in blocks, so what is sent to the tasks is bounded whatever their number: a block holds about
``block_items`` queries and ``block_terms`` terms, since queries fall into blocks by hash.

Scores are integers, equal in every engine. Defined results: rows of a null text and texts without a term are no
documents; a query without a term finds nothing; repeated documents are ranked each, repeated queries share one list;
among equal scores documents without a doc_id come last, and those of equal doc_ids have an arbitrary order; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm._common import documents, materialize, slices, table

#: ASCII letters in lower case and digits as they are, other ASCII as a space; bytes beyond ASCII as they are.
TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
SHARD_BYTES = 16_000_000
NO_DOC_ID = (1 << 63) - 1


def terms_of(text: str | None) -> list[str]:
    return (text or "").encode().translate(TERM_BYTES).decode().split(" ") if text else []


def _terms(texts: pa.StringArray, vocabulary: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of terms of each text; and of each term that is in ``vocabulary`` its text and its number there."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    folded = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes().translate(TERM_BYTES) if data and len(texts) else b""
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(folded))
    split = pc.ascii_split_whitespace(plain)
    words, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    real = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)])
    number = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False)
    known = np.flatnonzero(number >= 0)
    return np.diff(real[ends]), np.repeat(np.arange(len(texts)), np.diff(ends))[known], number[known].astype(np.int64)


def _block(queries: DataFrame) -> list[tuple[int, dict[str, int]]]:
    """Each query of a block with its terms and how often they occur; of repeated ids the first."""
    rows = queries.select("item_id", "text").distinct().toArrow().to_pylist()
    return [(r["item_id"], Counter(t for t in terms_of(r["text"]) if t)) for r in rows]


def count_terms(docs: DataFrame, vocabulary: list[str]) -> tuple[int, int, list[int]]:
    """The number of ``docs`` with a term, of all their terms, and of the docs that hold each term of ``vocabulary``."""
    known = pa.array(vocabulary, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, length = np.zeros(len(known), np.int64), 0, 0
        for batch in slices(batches, SHARD_BYTES):
            n, doc, term = _terms(batch["text"], known)
            held += np.bincount(np.unique(term * len(batch) + doc) // max(1, len(batch)), minlength=len(known))
            found, length = found + int((n > 0).sum()), length + int(n.sum())
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([found, length, *held[at].tolist()], pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    of = dict(zip(rows["term"], rows["n"], strict=True))
    return of.get(-2, 0), of.get(-1, 0), [of.get(t, 0) for t in range(len(known))]


def wand(postings: list[tuple[array, array, int]], doc_ids: list[int], best: list[tuple[int, int]], k: int) -> None:
    """Put the documents of one shard with the k highest scores above 0 into the heap ``best`` of ``(score, -doc_id)``.

    Args:
        postings: for each term its documents (numbers in the shard, ascending), their impacts, and the greatest impact.
    """
    # Cursors [document, place, documents, impacts, greatest impact], the next document first.
    cursors = sorted([docs[0], i, 0, docs, impacts, most] for i, (docs, impacts, most) in enumerate(postings))
    while cursors:
        least = best[0][0] if len(best) == k else 1
        bound = pivot = 0
        for pivot, cursor in enumerate(cursors):  # noqa: B007
            bound += cursor[5]
            if bound >= least:
                break
        else:
            return
        doc = cursors[pivot][0]
        if cursors[0][0] == doc:
            score, ahead = 0, 0
            for cursor in cursors:
                if cursor[0] != doc:
                    break
                score += cursor[4][cursor[2]]
                ahead += 1
            entry = (score, -doc_ids[doc])
            if score > 0 and len(best) < k:
                heapq.heappush(best, entry)
            elif score > 0 and entry > best[0]:
                heapq.heapreplace(best, entry)
            doc += 1
        else:
            ahead = pivot
        for cursor in cursors[:ahead]:
            cursor[2] = bisect_left(cursor[3], doc, cursor[2])
            cursor[0] = cursor[3][cursor[2]] if cursor[2] < len(cursor[3]) else -1
        cursors = sorted(c for c in cursors if c[0] >= 0)


def _search_block(docs: DataFrame, queries: list[tuple[int, dict[str, int]]], k: int) -> DataFrame:
    vocabulary = sorted({t for _, terms in queries for t in terms})
    numbers = {t: i for i, t in enumerate(vocabulary)}
    wanted = [(item, [(numbers[t], times) for t, times in terms.items()]) for item, terms in queries]
    known = pa.array(vocabulary, pa.string())
    all_docs, all_terms, held = count_terms(docs, vocabulary)
    weights = [math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df + 1))) for df in held]

    def inverted(batch: pa.RecordBatch) -> dict[int, tuple[array, array, int]]:
        """The documents of each term with a weight, their impacts, and the greatest of these."""
        n, doc, term = _terms(batch["text"], known)
        keys, tf = np.unique(term * len(batch) + doc, return_counts=True)
        term, doc = np.divmod(keys, max(1, len(batch)))
        m = 25 + 75 * n[doc] * all_docs // max(1, all_terms)
        impact = np.array(weights, np.int64)[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        cuts = np.flatnonzero(np.diff(term, prepend=-1)).tolist() + [len(term)]
        out = {}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if most := int(impact[a:b].max()):
                out[int(term[a])] = array("q", doc[a:b].tobytes()), array("q", impact[a:b].tobytes()), most
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]
        for batch in slices(batches, SHARD_BYTES):
            postings = inverted(batch)
            # Without a doc_id: as the greatest, so last among equal scores.
            doc_ids = pc.fill_null(batch["doc_id"], NO_DOC_ID).to_pylist()
            for heap, (_, terms) in zip(best, wanted, strict=True):
                parts = [(postings[t], times) for t, times in terms if t in postings]
                wand([p if times == 1 else (p[0], array("q", (times * x for x in p[1])), times * p[2]) for p, times in parts], doc_ids, heap, k)
        rows = [(item, -doc if doc != -NO_DOC_ID else None, score) for (item, _), heap in zip(wanted, best, strict=True) for score, doc in heap]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_id", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(search, "item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, block_items: int = 10_000, block_terms: int = 500_000) -> DataFrame:
    """The k best of ``docs(doc_id, text)`` for each of ``queries(item_id, text)``: ``item_id, rank, doc_id, score``.

    Args:
        block_items, block_terms: about how many queries, and terms of queries, are searched for in one pass.
    """
    letters = F.length(F.coalesce("text", F.lit("")))
    size = queries.agg(F.count("*").alias("n"), F.sum(letters).alias("letters")).first()
    # A term takes two letters at least, with what parts it from the next.
    blocks = max(1, -(-size.n // block_items), -(-(size.letters or 0) // (2 * block_terms)))
    found = None
    for block in range(blocks):
        rows = _search_block(docs, _block(queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)), k)
        found = rows if found is None else found.union(rows)
    # What each partition has found: up to k rows for each query, read thrice below if it weren't written.
    found = materialize(found, "lexical-found")
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    salted = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k).drop("rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each ``benchmark`` item: ``item_id, rank, doc_id, score``.

    Items without a term or a document give no rows; repeated documents are ranked each; an empty table gives no rows.
    """
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT d.id, d.doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS id FROM documents) d
), asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), lengths AS (SELECT id, count(*) AS n FROM words GROUP BY id
), whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), held AS (SELECT id, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term
), scores AS (
  SELECT item_id, id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (id), whole
  GROUP BY item_id, id, doc_id
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
