"""Streams of changes, with keyed state.

``changed`` turns a stream of whole listings into one of the paths that are new,
different or missing: the state holds each path's signature, so it goes on after a
restart from the checkpoint and tells nothing twice. ``debounced`` gathers changes
into batches, each from its first event on for a fixed time that later events don't
extend, with equal paths once. Both keep their state in RocksDB, one entry for each
path or each key, and take all time from the rows: no clock and no sleep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairn.shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "path string, type string, sig string, ts timestamp"
BATCHES = "key string, path string, started timestamp"


class _Signatures(StatefulProcessor):
    """Of one path: its last signature and when it was listed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sig = handle.getValueState("sig", T.StructType([T.StructField("sig", T.StringType()), T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("ts")
        was = self.sig.get()[0] if self.sig.exists() else None
        out = []
        for sig, ts in zip(seen["sig"], seen["ts"], strict=True):
            if sig != was:
                out.append((key[0], "modified" if was is not None else "added", sig, ts))
            was = sig
        last = int(seen["ts"].iloc[-1].value // 1_000_000)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        # a listing after this one, and without the path, moves the time beyond it
        self.handle.registerTimer(last + 1)
        self.sig.update((was, last))
        yield pd.DataFrame(out, columns=["path", "type", "sig", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sig.exists():
            self.sig.clear()
            yield pd.DataFrame([(key[0], "deleted", None, pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms"))], columns=["path", "type", "sig", "ts"])

    def close(self) -> None:
        pass


class _Batches(StatefulProcessor):
    """Of one key: when its open batch began, and the paths in it."""

    def __init__(self, pause: int):
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", T.StructType([T.StructField("ms", T.LongType())]))
        self.paths = handle.getMapState("paths", T.StructType([T.StructField("path", T.StringType())]), T.StructType([T.StructField("ms", T.LongType())]))

    def _closed(self, key, started: int) -> pd.DataFrame:
        names = sorted(k[0] for k in self.paths.keys())
        self.paths.clear()
        self.first.clear()
        return pd.DataFrame([(key[0], p, pd.Timestamp(started, unit="ms")) for p in names], columns=["key", "path", "started"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts", "path"])
        for path, ts in zip(seen["path"], seen["ts"], strict=True):
            ms = int(ts.value // 1_000_000)
            started = self.first.get()[0] if self.first.exists() else None
            if started is not None and ms >= started + self.pause:
                self.handle.deleteTimer(started + self.pause)
                yield self._closed(key, started)
                started = None
            if started is None:
                self.first.update((ms,))
                self.handle.registerTimer(ms + self.pause)
            self.paths.updateValue((path,), (ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.first.exists() and expiredTimerInfo.getExpiryTimeInMs() == self.first.get()[0] + self.pause:
            yield self._closed(key, self.first.get()[0])

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """What these operators need of a session: state in RocksDB, and this package in the workers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ship(spark)


def changed(listings: DataFrame) -> DataFrame:
    """(path, type, sig, ts) of paths that are added, modified or deleted from one listing to the next.

    ``listings`` is a stream of (path, sig, ts): every path of a listing, with the time of the listing. A
    deletion is told once a later listing has been read. Two signatures in one listing: the later one holds.
    """
    prepare(listings.sparkSession)
    timed = listings.select("path", "sig", "ts").where("path is not null and sig is not null").withWatermark("ts", "0 seconds")
    return timed.groupBy("path").transformWithStateInPandas(_Signatures(), T._parse_datatype_string(CHANGES), outputMode="Append", timeMode="EventTime")


def debounced(events: DataFrame, pause: int = 500) -> DataFrame:
    """(key, path, started) of a stream of (key, path, ts): each batch of a key's paths, as soon as the time has passed its first event by ``pause`` ms.

    ``key`` is what is refreshed as one, as a tree's root; keys are dealt over the tasks. A batch holds the distinct paths of its events.
    """
    prepare(events.sparkSession)
    timed = events.select(F.col("key").cast("string"), "path", "ts").where("key is not null and path is not null").withWatermark("ts", "0 seconds")
    return timed.groupBy("key").transformWithStateInPandas(_Batches(pause), T._parse_datatype_string(BATCHES), outputMode="Append", timeMode="EventTime")
