"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from tarnwork.llm import lexical

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def plain_search(docs, queries, k=10):
    """All ``(item, rank, doc_id, score)``, by the definition."""
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, length = len(counted), sum(x for _, _, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(queries):
        asked, scores = Counter(_terms(text)), []
        for doc_id, c, x in counted:
            m = 100 - 75 + (75 * x * n) // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    return rows + [(1001, None), (1002, ""), (1003, " ,.;"), (1004, "the the THE and"), (1005, "Ünïcödé 世界 FIVE"), (1005, "Ünïcödé 世界 FIVE"), (1006, "nowhere-to-be found0")]


def test_terms():
    for text in ("A-b_c9", "", "ÀB c d\u0085e 　f", "x" * 9, "\x00a\x7fb", " lead", "trail "):
        assert [t for t in lexical.terms_of(text) if t] == _terms(text)


@pytest.mark.parametrize("sizes", [{}, {"block_items": 10}, {"k": 3}])
def test_search_equals_scoring_all(spark, docs, texts, benchmark, monkeypatch, sizes):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 60_000)
    queries = spark.createDataFrame([(*r, 1) for r in benchmark], "item_id long, text string, score int")
    found = sorted(map(tuple, lexical.search(docs, queries, **sizes).collect()))
    assert found == plain_search(texts, benchmark, sizes.get("k", 10))


def test_empty_tables_and_rows_without_ids(spark, docs, none, benchmark):
    queries = spark.createDataFrame(benchmark, "item_id long, text string")
    assert lexical.search(none, queries).count() == 0
    assert lexical.search(docs, queries.where("false")).count() == 0
    rows = [(None, "one two"), (7, "one two"), (None, "three"), (8, "four four"), (8, "four"), (9, None)]
    asked = [(1, "one"), (2, "four"), (3, "three three two")]
    found = lexical.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_search(rows, asked), key=str)


def test_documents_are_skipped():
    """Pivots pass over documents that can't reach the heap's worst; ties go to smaller doc_ids."""
    rng = random.Random(6)
    for _ in range(300):
        n, k = rng.randrange(1, 60), rng.randrange(1, 6)
        ids = rng.sample(range(1000), n)
        postings, scores = [], Counter()
        for _ in range(rng.randrange(1, 8)):
            docs = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
            impacts = [rng.randrange(1, rng.choice((3, 50))) for _ in docs]
            postings.append((docs, impacts, max(impacts)))
            scores.update(dict(zip(docs, impacts)))
        best = []
        lexical.wand(postings, ids, best, k)
        assert sorted(best, reverse=True) == sorted(((s, -ids[d]) for d, s in scores.items()), reverse=True)[:k]

    class Watched(list):
        seen = 0

        def __getitem__(self, at):
            Watched.seen += 1
            return super().__getitem__(at)

    common = (list(range(10_000)), Watched([1] * 10_000), 1)
    rare = (list(range(0, 10_000, 1000)), Watched([100] * 10), 100)
    best = []
    lexical.wand([common, rare], list(range(10_000)), best, 5)
    assert [s for s, _ in best] == [101] * 5 and Watched.seen < 2100 * 2
