"""Keeps an index fresh with a Structured Streaming query.

Each micro-batch is a listing of the tree, taken when one differs from the last
by a size or a time. What changed is found by a join with the index's own table,
so the query's offsets stay small, a batch that fails is read again from the
checkpoint, and applying it twice ends in the same state.
"""

from __future__ import annotations

import os
import signal
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.sources import files as source

IDLE_MINUTES = 15.0


def watch(engine, checkpoint: str, every: str = "2 seconds", once: bool = False, done: Callable[[dict[str, int]], None] | None = None) -> StreamingQuery:
    """Starts the query; ``once`` applies what there is and ends."""
    stream = engine.spark.readStream.format("cairn_files").options(**source.options(engine.root, engine.ignore_text, engine.profiles)).load()

    def apply(batch: DataFrame, _: int) -> None:
        told = engine.refresh(full=False, listed=batch.where("path is not null").drop("content"))
        if done and any(told.values()):
            done(told)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def idle_minutes(override: str | None = None) -> float:
    """Minutes without a use after which a query stops: ``override``, or CAIRN_IDLE_MINUTES, or 15. 0 is never; what is no number, or negative, is ignored."""
    given = os.environ.get("CAIRN_IDLE_MINUTES") if override is None else override
    try:
        minutes = float(given or "")
    except ValueError:
        return IDLE_MINUTES
    return minutes if 0 <= minutes < float("inf") else IDLE_MINUTES


def stop_when_idle(query: StreamingQuery, last_use: Callable[[], float], minutes: float | None = None, check: float = 60.0) -> threading.Thread:
    """Stops the query once ``last_use()`` (seconds, as time.time) lies ``minutes`` back; 0 never stops it."""
    limit = idle_minutes() if minutes is None else minutes

    def run():
        while limit and query.isActive:
            if time.time() - last_use() >= 60 * limit:
                query.stop()
                return
            time.sleep(check)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread


def stop_on_signal(query: StreamingQuery, signals: tuple[int, ...] = (signal.SIGINT, signal.SIGTERM)) -> None:
    """Stops the query gracefully at one of ``signals``; to be called from the main thread. A second one acts as before."""
    before = {s: signal.getsignal(s) for s in signals}

    def stop(number, frame):
        for s, handler in before.items():
            signal.signal(s, handler)
        query.stop()

    for s in signals:
        signal.signal(s, stop)
