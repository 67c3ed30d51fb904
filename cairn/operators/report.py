"""Figures over timings and hits."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The sketch that brackets a percentile is off by one in so many places at most.
ACCURACY = 10_000
#: Values of brackets that the driver looks at; wider brackets are narrowed by further passes, which count SPANS spans each.
MOST, SPANS = 1_000_000, 1_024


def ranked(rows: DataFrame, values: str, places: list[int], brackets: list[tuple[int, int]], low: int, high: int) -> list[int]:
    """The values (integers from ``low`` to ``high``) at ``places`` of the sorted ones, from 0.

    ``brackets`` should hold them. One pass counts what lies between the brackets, and each value inside;
    that settles all places, unless a bracket is wrong or has too many values.
    """
    cuts = sorted({x for a, b in brackets for x in (a, b + 1)})
    inside = reduce(Column.__or__, [F.col(values).between(a, b) for a, b in brackets])
    span = sum((F.col(values) >= c).cast("int") for c in cuts)
    seen = rows.where(F.col(values).isNotNull()).groupBy(span.alias("span"), F.when(inside, F.col(values)).alias("v")).count()
    got = seen.limit(MOST + 1).collect()
    if len(got) <= MOST:
        got.sort(key=lambda r: (r.span, r.v is not None, r.v or 0))
        ends = list(accumulate(r["count"] for r in got))
        found = [got[bisect_right(ends, p)].v for p in places]
        if None not in found:
            return found
    return [_narrowed(rows, values, p, low, high) for p in places]


def _narrowed(rows: DataFrame, values: str, place: int, a: int, b: int) -> int:
    """As ``ranked``, for one place: each pass counts SPANS equal spans of what is left and goes on in the one that holds it."""
    before = 0
    while a < b:
        width = (b - a) // SPANS + 1
        counts = rows.where(F.col(values).between(a, b)).groupBy(F.expr(f"({values} - {a}L) div {width}L").alias("span")).count().orderBy("span").collect()
        for r in counts:
            if before + r["count"] > place:
                a, b = a + r.span * width, min(b, a + r.span * width + width - 1)
                break
            before += r["count"]
    return a


def search_summary(timings: DataFrame, ns: str = "ns", shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """mean (whole), p50, p90 and max: a percentile p is the value at place min(n - 1, floor(p * n)), from 0; all are 0 for none.

    Two passes for any number of percentiles: one for the sums and a mergeable sketch that brackets all places, one that counts.
    """
    margin = 3 / ACCURACY
    bounds = [min(1.0, max(0.0, x)) for p in shares for x in (p - margin, p + margin)]
    n, total, low, high, sketch = timings.agg(F.count(ns), F.sum(ns), F.min(ns), F.max(ns), F.percentile_approx(ns, bounds, ACCURACY)).first()
    found = [0] * len(shares)
    if n:
        brackets = [(low if p <= margin else sketch[2 * i], high if p >= 1 - margin else sketch[2 * i + 1]) for i, p in enumerate(shares)]
        found = ranked(timings, ns, [min(n - 1, int(p * n)) for p in shares], brackets, low, high)
    mean = abs(total) // n * (1 if total >= 0 else -1) if n else 0
    names = ["mean", *[f"p{round(100 * p)}" for p in shares], "max"]
    return timings.sparkSession.createDataFrame([(mean, *found, high or 0)], ", ".join(f"{x} bigint" for x in names))


def phase_means(phases: DataFrame) -> DataFrame:
    """Whole mean time of each phase over the runs after the first (run 0 warms up)."""
    return phases.where("run > 0").groupBy("name").agg(F.expr("sum(ns) div count(*)").alias("ns"))


def total_time(phases: DataFrame) -> DataFrame:
    """The time of phases without a parent, by run."""
    return phases.where("parent is null").groupBy("run").agg(F.sum("ns").alias("ns"))


def histogram(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(name).agg(F.count("*").alias("n"))


def hits_match(hits: DataFrame, needle: str, path: str = "file_path") -> DataFrame:
    """Whether a hit's path contains the needle, in any case."""
    return hits.agg(F.coalesce(F.bool_or(F.contains(F.lower(path), F.lit(needle.lower()))), F.lit(False)).alias("found"))


def answer_has(answers: DataFrame, terms: list[str], answer: str = "answer") -> DataFrame:
    """``answers`` with ``missing``, the terms that an answer lacks in any case, and ``verified``, that it lacks none."""
    lacks = F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: ~F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(t)))
    return answers.withColumn("missing", lacks).withColumn("verified", F.size("missing") == 0)


SCENARIO = "name string, repo string, revision string, query string, expectations struct<pathSubstring: string, answerMustInclude: array<string>>"


def scenarios(spark: SparkSession, folder: str, target: str = "all") -> DataFrame:
    """The scenarios of a folder of JSON files, one a file, or the one of that name (none if there is no such)."""
    every = spark.read.schema(SCENARIO).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return every if target == "all" else every.where(F.col("name") == target.removesuffix(".json"))


def report(scenario: DataFrame, phases: DataFrame, tree: DataFrame, search: DataFrame, top_k: int) -> DataFrame:
    """One row, to be written as JSON: scenario, phases, tree (files, bytes), search and totalMs, from the figures of one run.

    ``phases`` has name, ns and parent (null at the top, whose times make the total); the others are one row each.
    """
    parts = {
        "scenario": scenario.limit(1).select(F.struct("*")),
        "phases": phases.agg(F.collect_list(F.struct("name", "ns", "parent"))),
        "tree": tree.limit(1).select(F.struct("files", "bytes")),
        "search": search.limit(1).select(F.struct("*", F.lit(top_k).alias("topK"))),
        "totalMs": phases.where("parent is null").agg(F.expr("coalesce(sum(ns), 0) div 1000000")),
    }
    schema = T.StructType([T.StructField(k, d.schema[0].dataType) for k, d in parts.items()])
    return phases.sparkSession.createDataFrame([tuple((d.first() or [None])[0] for d in parts.values())], schema)


def idle_periods(events: DataFrame, minutes: int = 15) -> DataFrame:
    """Runs of events of a user without a gap of ``minutes``: user_id, started, last, n."""
    w = F.session_window("ts", f"{minutes} minutes")
    return events.groupBy("user_id", w).agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")
