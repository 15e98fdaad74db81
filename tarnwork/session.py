"""A session with the settings that the operators expect, and tables that are kept for a while in its shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def build_session(name: str = "tarnwork", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, ANSI mode and adaptive execution; ``settings`` come last, with ``_`` for ``.`` in their names."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in {**fixed, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which every executor shares.

    Only where that setting is absent (local sessions, tests) a temporary folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tarnwork-"))
    return f"file://{_own_dir[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, and survives lost executors.

    What the write has shuffled is removed when it ends. ``discard`` removes the table itself. Meanwhile batches for
    Python have ``BATCH_BYTES`` at most (and a row at least): else they are whole partitions, which the JVM and Python
    hold several times over in each task.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tarnwork/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = {key: spark.conf.get(key, None) for key in (cleanup, BATCH)}
    spark.conf.set(cleanup, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` gave, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, size: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint where a count shows that it has at most ``rows`` rows; else as it is.

    With ``size``, these may also take no more bytes, as JSON. Give a materialised ``df``: the count reads it.
    """
    if size is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    taken = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, taken = df.limit(rows + 1).agg(F.count("*"), taken).first()
    return F.broadcast(df) if n <= rows and (taken or 0) <= size else df
