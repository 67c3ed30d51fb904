"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are of whole texts. Training reads a bounded sample of labelled
rows; scoring reads every row and no label. Null texts count as empty, and the
statistics of an empty text are zeros. Texts of any length are read whole.
Repeated rows each get a score and train once; a document that has both labels
trains with both. Of the kept columns, one named score or predicted gives way to
the new one; other columns are neither read nor changed.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import gbt
from cairn.llm.common import unit, with_columns

#: Labelled rows that training reads, about: a bound on the sample, not on what is scored.
TRAIN_ROWS = 20_000
#: Below this score a document is rejected.
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_chars", "upper", "digit", "symbol", "punctuation", "exclamation", "pipe", "white",
    "beyond_ascii", "distinct_words", "top_word", "repeat_threes", "dup_lines", "log_lines", "line_words", "short_lines",
    "ended_lines", "compressed",
)
_GROUPS = tuple(np.frombuffer(x, np.uint8) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}=\\^~", b".,;:?'\"()-", b"!", b"|", b" \t\r\n"))


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES."""
    words = (text or "").split()
    if not text or not words:
        return [float(np.log1p(len(text or "")))] + [0.0] * (len(FEATURES) - 1)
    n, w = len(text), len(words)
    counts = Counter(words)
    threes = max(1, w - 2)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    line_words = [x.count(" ") + 1 for x in lines]
    raw = text.encode("utf-8", "replace")
    each = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    groups = [float(each[g].sum()) / n for g in _GROUPS]
    return [
        float(np.log1p(n)), float(np.log1p(w)), (n - w) / w, *groups, (len(raw) - n) / n, len(counts) / w, max(counts.values()) / w,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / threes, 1 - len(set(lines)) / len(lines), float(np.log1p(len(lines))),
        sum(line_words) / len(lines), sum(x < 5 for x in line_words) / len(lines), sum(x.rstrip()[-1] in ".?!" for x in lines) / len(lines),
        len(zlib.compress(raw, 1)) / len(raw),
    ]


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> gbt.Trees:
    """Trees from about ``rows`` labelled documents that ``learn`` admits.

    An id has two rows of the sample at most, so it is small enough to broadcast,
    and only the sample's texts are worked on. If many documents have one id, they
    are thinned out to ``rows`` again. Null labels don't train.
    """
    able = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") > 0).alias("good")).distinct()
    n = able.count()
    if n > rows:
        able = able.where(unit(F.col("doc_id"), 4) < rows / n)
    sample = docs.select("doc_id", "text").join(F.broadcast(able), "doc_id")
    n = sample.count()
    if n > 2 * rows:
        sample = sample.where(unit(F.struct("doc_id", "text"), 5) < rows / n)
    sample = sample.dropDuplicates(["doc_id", "good", "text"])

    def make():
        return lambda texts: {"x": [statistics(t) for t in texts]}

    got = with_columns(sample, ["doc_id", "good"], "text", make, "x array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.good, r.x))
    return gbt.fit(np.array([r.x for r in got], float).reshape(-1, len(FEATURES)), np.array([r.good for r in got], float), trees=80)


def score(docs: DataFrame, trees: gbt.Trees, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score`` and ``predicted``."""

    def make():
        def step(texts):
            s = trees.score(np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES)))
            return {"score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}

        return step

    return with_columns(docs, keep, "text", make, "score double, predicted int")
