"""Helpers that several corpus operators share."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.session import discard, materialize, small, work_dir  # noqa: F401

#: The white space of the contracts: space and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def quoted(column: str) -> str:
    """A column's name as Spark parses it, whatever it is made of."""
    return "`" + column.replace("`", "``") + "`"


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case; all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Lately(dict):
    """A table of results, of bounded size: what wasn't asked for in a while goes."""

    def __init__(self, half: int):
        self.half, self.old = half, {}

    def __missing__(self, key):
        """From the older half; KeyError if it isn't there either."""
        value = self.old[key]
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value


def slices(batches, size: int = 4_000_000):
    """Arrow batches cut into runs of rows with about ``size`` bytes of column ``text`` at most, but for single rows; null texts are empty there."""
    for batch in batches:
        text = pc.fill_null(batch["text"], "")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield pa.record_batch([text.slice(at, end - at) if name == "text" else batch[name].slice(at, end - at) for name in batch.schema.names], batch.schema.names)
            at = end


def ids_of_lists(words: pa.ListArray, ids_of) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lists of strings, one after the other, and where those of each list begin and end.

    ``ids_of`` gives the ids of the distinct strings.
    """
    coded = words.flatten().dictionary_encode()
    table, codes = ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    pool = np.fromiter(chain.from_iterable(table), np.int32, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    offsets = words.offsets.to_numpy()
    return pool[np.repeat(begins[codes] - ends[:-1], n) + np.arange(ends[-1])], ends[offsets - offsets[0]]
