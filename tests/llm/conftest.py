import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
#: A null, empty and blank texts, ties, a repeated row, a long word, and text without spaces between words.
ODD = [
    (900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "one"), (900_005, "one two\tthree\nfour  five six"), (900_006, "one two three four five six"),
    (900_006, "one two three four five six"), (900_007, "x" * 5000), (900_008, "Ünïcödé  ß 世界 \U0001f600 password = 'abcdefgh12'"), (900_009, " one two three four five six "),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Real texts, near copies of some of them, and odd rows; with columns whose names operators might use."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    rng, near = random.Random(7), []
    for i, (_, text) in enumerate(real[:40]):
        words = text.split(" ")
        for _ in range(max(1, len(words) // 40)):
            words[rng.randrange(len(words))] = "changed"
        near.append((800_000 + i, " ".join(words)))
    rows = [(a, b, "x", "y", 1, 2) for a, b in real + near + ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, key string, n int, component int").repartition(3).cache()


@pytest.fixture(scope="session")
def texts(docs):
    """``(doc_id, text)`` rows by doc_id, nulls as empty."""
    return sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: r[0])


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
