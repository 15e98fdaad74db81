"""Batches for Python are of bounded size, and a worker holds one copy of the permutation."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnwork import session
from tarnwork.llm import minhash


def test_batches_of_written_tables_are_bounded(spark):
    def told(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([len(batch)], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["n", "size"])

    before = spark.conf.get(session.BATCH, None)
    texts = spark.range(0, 3_000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    found = session.materialize(texts.mapInArrow(told, "n long, size long"), "told").collect()
    assert sum(r.n for r in found) == 3_000 and max(r.size for r in found) < 2 * session.BATCH_BYTES
    assert spark.conf.get(session.BATCH, None) == before


def test_the_permutation_is_the_same_in_place():
    rng = np.random.default_rng(minhash.SEED)
    rng.integers(1, 1 << 62, dtype=np.uint64)
    expected = rng.permutation(minhash.CIRCLE)
    found = minhash.circulant().shifted
    assert (found[:, 0][: minhash.CIRCLE] == expected).all() and (found[minhash.CIRCLE] == expected[: minhash.SIZE]).all()
    assert found.base is not None and found.dtype == np.int32
