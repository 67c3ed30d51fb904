"""Streams of changes, batch by batch."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cairn.streaming import changes

DAY = dt.datetime(2024, 1, 1)


def at(ms):
    return DAY + dt.timedelta(milliseconds=ms)


class Feed:
    """A folder of Parquet files as a stream, one file a batch, run to its end after each."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.path, self.schema, self.make, self.n = spark, tmp_path, schema, make, 0
        self.kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        os.makedirs(tmp_path / "in")

    def batch(self, rows):
        """What comes out once the rows are read."""
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"file://{self.path}/in")
        self.n += 1
        stream = self.spark.readStream.schema(self.schema).parquet(f"file://{self.path}/in")
        out = f"file://{self.path}/out{self.n}"
        writer = self.make(stream).writeStream.foreachBatch(lambda d, _: d.write.mode("append").parquet(out)).option("checkpointLocation", f"file://{self.path}/cp")
        writer.trigger(availableNow=True).start().awaitTermination(300)
        return [r for r in self.spark.read.parquet(out).collect()] if os.path.exists(out.removeprefix("file://")) else []


@pytest.fixture
def fewer(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_changes_of_listings(spark, tmp_path, fewer):
    """Each batch is a listing and another run of the query: what comes out are the differences."""
    feed = Feed(spark, tmp_path, "path string, sig string, ts timestamp", changes.changed)
    told = lambda rows: sorted((r.path, r.type, r.sig) for r in rows)
    many = {f"f{i}": "1:1" for i in range(50)}
    assert len(told(feed.batch([(p, s, at(0)) for p, s in many.items()]))) == 50
    many["f7"] = "2:2"
    assert told(feed.batch([(p, s, at(2_000)) for p, s in many.items()])) == [("f7", "modified", "2:2")]
    assert told(feed.batch([(p, s, at(4_000)) for p, s in many.items()])) == []
    many.pop("f9")
    many["new"] = "3:3"
    first = told(feed.batch([(p, s, at(6_000)) for p, s in many.items()]))
    then = told(feed.batch([(p, s, at(8_000)) for p, s in many.items()]))
    assert sorted(first + then) == [("f9", "deleted", None), ("new", "added", "3:3")]
    many["f9"] = "1:1"
    assert told(feed.batch([(p, s, at(10_000)) for p, s in many.items()])) == [("f9", "added", "1:1")]


def test_batches_begin_at_their_first_event(spark, tmp_path, fewer):
    """Events at 0, 100, 450 and 600 ms: the last is 600 ms after the first and begins a batch of its own."""
    feed = Feed(spark, tmp_path, "key string, path string, ts timestamp", changes.debounced)
    told = lambda rows: sorted((r.key, r.path, (r.started - DAY).total_seconds() * 1000) for r in rows)
    first = told(feed.batch([("t", "a", at(0)), ("t", "b", at(100)), ("u", "z", at(90))]))
    second = told(feed.batch([("t", "a", at(450)), ("t", "c", at(600)), (None, "x", at(600)), ("t", None, at(600))]))
    third = told(feed.batch([("u", "y", at(5_000))]))
    assert first == [] and sorted(second + third) == [("t", "a", 0.0), ("t", "b", 0.0), ("t", "c", 600.0), ("u", "z", 90.0)]
