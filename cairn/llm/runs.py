"""Periodic runs of words, by partition refinement (Crochemore).

A run is a stretch of consecutive words with smallest period q whose length is at
least LEAST and TIMES * q, and which no neighbouring word extends keeping the
period. Positions whose next ``level`` words are equal make a class; classes of
one level split into those of the next by the classes of the words that follow.
Two neighbours in a class whose distance is the level begin a square, and squares
of one period that begin side by side are one run. Only the smaller parts of a
split class split others at the next level, so a text of n words takes
O(n log n) moves, also where it is one long repeat.

Words are stretches without ASCII white space. Null, empty and wordless texts
have no run and collapse to the empty text. A text of any length is worked on
whole, in one task; texts don't meet, so repeated rows give equal results. Kept
columns named runs or collapsed give way to the new ones; other columns are
neither read nor changed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import with_columns

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3
#: Texts of about so many words are refined together.
GROUP = 50_000
#: A level at which one in so many members moves, or more, is done by one sort of all members.
DENSE = 16


def runs(docs: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs, by start, then period."""
    # no two documents share a class, and a word that occurs once ends each document
    names, starts, n = [], [], 0
    for words in docs:
        seen: dict[bytes, int] = {}
        starts.append(n)
        names += [seen.setdefault(w, len(seen)) + n for w in words]
        names.append(n + len(seen))
        n += len(words) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    deepest = max((len(w) for w in docs), default=0) // times
    first = np.array(starts, np.int64)
    for level, begins in squares(np.array(names, np.int64), deepest):
        begins = np.sort(begins)
        breaks = np.flatnonzero(np.diff(begins) != 1)
        low, high = begins[np.concatenate(([0], breaks + 1))], begins[np.concatenate((breaks, [len(begins) - 1]))]
        length = high - low + 2 * level
        long = length >= max(least, times * level)
        for s, m in zip(low[long].tolist(), length[long].tolist(), strict=True):
            d = int(np.searchsorted(first, s, "right")) - 1
            out[d].append((s - starts[d], m, level))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def squares(classes: np.ndarray, deepest: int):
    """(level, places) of neighbours in a class that lie ``level`` apart, for each level up to ``deepest`` that has some."""
    members = np.argsort(classes, kind="stable")
    fresh, level = int(classes.max(initial=0)) + 1, 1
    while level <= deepest:
        own = classes[members]
        edge = np.concatenate(([True], own[1:] != own[:-1]))
        alone = edge & np.concatenate((edge[1:], [True]))
        members, own, edge = members[~alone], own[~alone], edge[~alone]
        if not len(members):
            return
        gap = np.where(np.concatenate((edge[1:], [True])), 0, np.concatenate((members[1:] - members[:-1], [0])))
        if len(at := members[gap == level]):
            yield level, at
        if level == deepest:
            return
        # the next level, by one sort: members of a class by the class of the word after theirs
        after = np.unique(classes[members + 1], return_inverse=True)[1]
        group = np.cumsum(edge) - 1
        key = group * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        key, parent, members = key[order], group[order], members[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        classes[members] = fresh + np.repeat(np.arange(len(begin)), size)
        fresh, level = fresh + len(begin), level + 1
        # the largest part of each class is no splitter
        by_size = np.lexsort((size, parent[begin]))
        largest = by_size[np.flatnonzero(np.concatenate((np.diff(parent[begin][by_size]) != 0, [True])))]
        small = np.delete(np.arange(len(begin)), largest)
        if size[small].sum() * DENSE < len(members):
            yield from _by_halves(classes, members, begin, size, small, level, deepest)
            return


def _by_halves(classes: np.ndarray, members: np.ndarray, begin: np.ndarray, size: np.ndarray, small: np.ndarray, level: int, deepest: int):
    """As ``squares``, from ``level`` on. Class k has the ``size[k]`` members from ``begin[k]``, ascending; ``small`` are those that split others."""
    n = len(classes)
    own, after, before = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    own[members] = np.where(np.repeat(size, size) > 1, np.repeat(np.arange(len(size)), size), -1)
    joined = np.delete(np.arange(1, len(members)), begin[1:] - 1)  # members with another one of their class before them
    after[members[joined - 1]], before[members[joined]] = members[joined], members[joined - 1]
    splitters = [members[begin[k] : begin[k] + size[k]].tolist() for k in small]
    head, count = members[begin].tolist(), size.tolist()
    own, after, before = own.tolist(), after.tolist(), before.tolist()
    #: Places by the distance to the next of their class; some of an older state, which are looked at again before use.
    waiting: dict[int, list[int]] = {}
    gaps = members[joined] - members[joined - 1]
    keep = (gaps >= level) & (gaps <= deepest)
    for g, i in zip(gaps[keep].tolist(), members[joined - 1][keep].tolist(), strict=True):
        waiting.setdefault(g, []).append(i)
    while True:
        if level in waiting:
            found = {i for i in waiting.pop(level) if after[i] - i == level}
            if found:
                yield level, np.array(list(found), np.int64)
        if level == deepest or not splitters:
            return
        level += 1
        made: dict[tuple[int, int], list[int]] = {}
        parts: dict[int, list[tuple[int, list[int]]]] = {}
        for k, places in enumerate(splitters):
            for q in places:
                p = q - 1
                c = own[p]  # the last place is a closing word, alone in its class, so place -1 is skipped
                if c < 0:
                    continue
                a, b = before[p], after[p]
                if a >= 0:
                    after[a] = b
                    if b >= 0 and level <= b - a <= deepest:
                        waiting.setdefault(b - a, []).append(a)
                else:
                    head[c] = b
                if b >= 0:
                    before[b] = a
                count[c] -= 1
                part = made.get((c, k))
                if part is None:
                    made[c, k] = part = []
                    parts.setdefault(c, []).append((len(head), part))
                    head.append(p)
                    count.append(0)
                    before[p] = -1
                else:
                    last = part[-1]
                    after[last], before[p] = p, last
                    if level <= p - last <= deepest:
                        waiting.setdefault(p - last, []).append(last)
                after[p] = -1
                part.append(p)
        splitters = []
        for c, split in parts.items():
            rest = count[c]
            largest = max(range(len(split)), key=lambda j: len(split[j][1]))
            if rest >= len(split[largest][1]):
                largest = -1
            elif rest:
                at, left = head[c], []
                while at >= 0:
                    left.append(at)
                    at = after[at]
                splitters.append(left)
            if rest == 1:
                own[head[c]] = -1
            for j, (name, part) in enumerate(split):
                count[name] = len(part)
                for p in part:
                    own[p] = name if len(part) > 1 else -1
                if j != largest:
                    splitters.append(part)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of a run, the first period stays."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g])


def find(docs: DataFrame, keep: list[str], text: Column | str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with ``runs`` and the ``collapsed`` text, its words joined by single spaces."""

    def make():
        def step(texts):
            words, found, out = [(t or "").encode("utf-8", "replace").split() for t in texts], [], []
            at = 0
            while at < len(words):
                end, total = at + 1, len(words[at])
                while end < len(words) and total + len(words[end]) <= GROUP:
                    total += len(words[end])
                    end += 1
                found += runs(words[at:end])
                at = end
            for w, r in zip(words, found, strict=True):
                out.append(collapsed(w, r).decode())
            return {"runs": [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in found], "collapsed": out}

        return step

    return with_columns(docs, keep, text, make, "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, where one id in ten gets a text whose words go round from a place on.

    By h, the crc32 of the decimal id, and g = h div 10: where h % 10 is 0 and there are n words, each from a = g % n on
    becomes word a + (i - a) % p, with p = 1 + (n - a) div (3 + g % 8). A text without id stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    led = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    placed = led.withColumn("a", F.expr("g % nullif(size(w), 0)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    gone_round = F.expr("array_join(transform(w, (x, i) -> if(i >= a, w[cast(a + (i - a) % p as int)], x)), ' ')")
    return placed.select("doc_id", F.coalesce(gone_round, "text").alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the one that repeats most (the first of equals, then the shorter period), and digests of all runs and of the collapsed text."""
    found = find(docs, ["doc_id"])
    better = "x.length * best.period > best.length * x.period"  # runs come by start, then period, so the first of equals stays
    most = F.expr(f"aggregate(runs, runs[0], (best, x) -> if({better}, x, best))")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    led = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.when(F.size("runs") > 0, most).alias("m"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return led.select("doc_id", "n_runs", "m.start", "m.length", "m.period", F.expr("1000 * m.length div m.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
