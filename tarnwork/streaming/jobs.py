"""Job handling on event streams: state with fencing and timeouts, throttled progress, idempotent batches.

These are this library's streaming counterparts of queues and workers; batches run the same code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Phases of a streamed reply, in order.
PHASES = ("waiting", "thinking", "writing")
ORDER = {"queued": "PENDING", "started": "PROCESSING", "finished": "COMPLETED", "failed": "FAILED"}


def job_states(events: DataFrame, *, timeout_ms: int = 3_600_000, queued_ms: int = 86_400_000) -> DataFrame:
    """``job_id, run_id, status`` of each job after each batch of ``events(job_id long, run_id long, event, ts)``.

    Events of an older run than the newest are ignored. A running job without events for ``timeout_ms`` fails, and so does
    one that has waited in the queue for ``queued_ms``; its state goes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, status = state.get if state.exists else (-1, "PENDING")
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], run, "FAILED")], columns=["job_id", "run_id", "status"])
            return
        rows = sorted((r for b in batches for r in b[["ts", "run_id", "event"]].itertuples(index=False)), key=lambda r: (r.ts, r.run_id))
        for r in rows:
            if r.run_id >= run:
                run, status = int(r.run_id), ORDER.get(r.event, status)
        if status in ("COMPLETED", "FAILED"):
            state.remove() if state.exists else None
        else:
            state.update((run, status))
            state.setTimeoutDuration(timeout_ms if status == "PROCESSING" else queued_ms)
        yield pd.DataFrame([(key[0], run, status)], columns=["job_id", "run_id", "status"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, run_id long, status string", "run_id long, status string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def throttled_progress(events: DataFrame, *, seconds: float = 2.0) -> DataFrame:
    """Those of ``events(job_id long, phase string, ts timestamp)`` that are told: a new phase, or ``seconds`` after the last one told.

    A job keeps its last phase and time alone. Within a batch, events go by time and
    then in the order of phases, unknown ones last. Rows without a phase or time tell nothing.
    """

    def place(r: tuple) -> tuple:
        return r.ts, PHASES.index(r.phase) if r.phase in PHASES else len(PHASES), r.phase

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, told = state.get if state.exists else (None, None)
        out = []
        for r in sorted((r for b in batches for r in b[["ts", "phase"]].itertuples(index=False)), key=place):
            if r.phase != phase or (r.ts - told).total_seconds() >= seconds:
                phase, told = r.phase, r.ts
                out.append((key[0], phase, told))
        if told is not None:
            state.update((phase, told))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "phase", "ts"])

    schema = "job_id long, phase string, ts timestamp"
    return events.where("phase IS NOT NULL AND ts IS NOT NULL").groupBy("job_id").applyInPandasWithState(step, schema, "phase string, ts timestamp", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, *, ts: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Events by window and key; rows later than ``late`` behind the newest are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def write_idempotently(stream: DataFrame, path: str, checkpoint: str, *, by: str):
    """Each batch replaces the partitions of the parents it has, so a repeated batch changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
