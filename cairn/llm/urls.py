"""URL filters by a bit-parallel automaton over wildcard rules.

All glob rules together are one bit vector of several 64-bit words: a rule of m
symbols takes m + 1 bits, of which the first is its start. Reading a symbol
shifts the vector by one, keeps the bits whose rule has that symbol there, and
keeps besides the bits before a ``*``. All rules advance at once, and all urls
of a batch with them, each column of the batch one step at a time.

The automaton reads a dot, the host, a boundary symbol that occurs nowhere else,
the path. Symbols are code points; all that no rule names are one. A host rule
is ``*.host<boundary>/path*`` and can match neither a part of a label nor the
path; it reads the host and path as they stand in the url. Globs read the
canonical ones: without user, port and last dot, percent escapes decoded, dot
segments resolved, in lower case. Null urls and those without ``://`` have an empty host and
path, no rule, and are allowed. Urls of any length are read whole. Repeated rows
each get a verdict. Of the key columns, one that has the name of a result gives
way to it; other columns are neither read nor changed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import with_columns

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Verdict, host with its path. The longest that fits decides.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Where no host rule fits: globs over host and path that block. ``*`` is any run of characters, ``?`` any one; the host
#: begins after a dot, so that ``*.x.*`` means the label x, and a glob without a slash holds for every path.
BLOCK_GLOBS = (
    # advertising and tracking
    "*.ads.*", "*.ad?.*", "*.adserver*.*", "*.banner?.*", "*.pixel.*", "*.track.*", "*.tracker*.*", "*-ads.*", "*ads-track*",
    # gambling, drugs, adult content, fraud
    "*.casino*.*", "*-casino.*", "*-casino-*", "*.bets.*", "*-bets.*", "*.poker*.*", "*.pills.*", "*-pills.*", "*.viagra*.*", "*-viagra*", "*.porn*.*", "*.xxx",
    "*-porn*", "*.phish*.*", "*-phishing*", "*.malware*.*", "*.spam*.*",
    # pages without prose
    "*/wp-login.php*", "*/xmlrpc.php*", "*/cgi-bin/*", "*/wp-admin/*", "*/cart/*", "*/checkout/*",
    # files that are no pages
    "*/*.jpg", "*/*.jpeg", "*/*.png", "*/*.gif", "*/*.svg", "*/*.css", "*/*.js", "*/*.zip", "*/*.gz", "*/*.exe", "*/*.mp3", "*/*.mp4", "*/*.avi", "*/*.iso",
)
#: Bits of all rules together, at most: what a worker holds grows with it.
MOST_BITS = 1 << 20


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII letters in lower case) and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :])
    return rest[1].translate(_UPPER), rest[2]


def canonical(host: str, path: str) -> tuple[str, str]:
    host = re.sub(r":[0-9]*\Z", "", unquote(host[host.rfind("@") + 1 :], errors="replace")).rstrip(".").lower()
    out: list[str] = []
    parts = unquote(path, errors="replace").lower().split("/")
    for k, part in enumerate(parts):
        if part == ".." and len(out) > 1:
            out.pop()
        if part not in (".", "..") and (part or k in (0, len(parts) - 1)):
            out.append(part)
        elif k == len(parts) - 1:
            out.append("")
    return host, "/".join(out)


ANY, STAR, BOUNDARY = -2, -1, 0x110000


def points(text: str) -> list[int]:
    return [ord(c) for c in text]


def host_glob(rule: str) -> list[int]:
    """A host rule as symbols."""
    host, slash, path = rule.partition("/")
    return [STAR, *points(f".{host}"), BOUNDARY, *points(slash + path), STAR]


def glob(rule: str) -> list[int]:
    """A glob over host and path, split at its first slash; without one it holds for every path."""
    host, slash, path = rule.partition("/")
    read = lambda s: [STAR if c == "*" else ANY if c == "?" else ord(c) for c in s]
    return [*([] if host[:1] == "*" else [ord(".")]), *read(host), BOUNDARY, *(read(slash + path) if slash else [STAR])]


def symbols_of(host: str, path: str) -> np.ndarray:
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in ("." + host, path))
    return np.concatenate((a, [BOUNDARY], b)).astype(np.int64)


def rules_of(table: DataFrame) -> tuple[tuple[tuple[str, str], ...], tuple[str, ...]]:
    """Host rules and globs from a table of (kind: ``host`` or ``glob``, verdict, rule): rules are a stated list, of MOST_BITS symbols at most."""
    size = table.agg(F.sum(F.length("rule") + 4)).first()[0] or 0
    if size > MOST_BITS:
        raise ValueError(f"{size} symbols of rules are more than {MOST_BITS}")
    rows = table.select("kind", "verdict", "rule").distinct().orderBy("kind", "rule", "verdict").collect()
    return tuple((r.verdict, r.rule) for r in rows if r.kind == "host"), tuple(r.rule for r in rows if r.kind == "glob")


@dataclass(frozen=True)
class Automaton:
    """Words of 64 bits: ``fits[class]`` where a rule has a symbol of the class, ``loops`` before a ``*``, ``starts``; ``ends``: the bit of each rule's end."""

    known: np.ndarray
    fits: np.ndarray
    loops: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rules: list[list[int]]) -> Automaton:
        known = np.array(sorted({x for r in rules for x in r if x >= 0} | {BOUNDARY}), np.int64)
        class_of = {int(x): k for k, x in enumerate(known)}
        words = max(1, -(-sum(1 + sum(x != STAR for x in r) for r in rules) // 64))
        fits = np.zeros((len(known) + 1, words), np.uint64)
        loops, starts = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        ends, at = [], 0
        put = lambda into, i: into.__setitem__(i // 64, into[i // 64] | np.uint64(1 << i % 64))
        for rule in rules:
            put(starts, at)
            for x in rule:
                if x == STAR:
                    put(loops, at)
                    continue
                at += 1
                for k in range(len(known) + 1) if x == ANY else (class_of[x],):
                    if x != ANY or k != class_of[BOUNDARY]:
                        put(fits[k], at)
            ends.append(at)
            at += 1
        return cls(known, fits, loops, starts, np.array(ends, np.int64))

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        """The place of each symbol among those that rules name, or the one for all others."""
        at = np.minimum(np.searchsorted(self.known, symbols), len(self.known) - 1)
        return np.where(self.known[at] == symbols, at, len(self.known))

    def matches(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows of texts, columns of rules. Texts are read in order of length, so that each step has those that go on first."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        state = np.tile(self.starts, (len(texts), 1))
        offsets = np.concatenate(([0], np.cumsum(sizes[order])))[:-1]
        flat = self.classes(np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.int64))
        going = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
        one, top = np.uint64(1), np.uint64(63)
        for step, n in enumerate(going):
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.fits[flat[offsets[:n] + step]]) | (now & self.loops)
        found = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & one
        out = np.empty((len(texts), len(self.ends)), bool)
        out[order] = found.astype(bool)
        return out


def judge(pages: DataFrame, key: str = "page_id", host_rules=HOST_RULES, globs=BLOCK_GLOBS, url: Column | None = None) -> DataFrame:
    """``key``, host, path, the longest host rule that fits, the verdict, and the globs that match."""
    by_length = sorted(host_rules, key=lambda r: -len(r[1]))
    globs = tuple(globs)

    def make():
        hosts, wild = Automaton.of([host_glob(r) for _, r in by_length]), Automaton.of([glob(g.lower()) for g in globs])

        def step(urls):
            parts = [split_url(u) for u in urls]
            found, hit = hosts.matches([symbols_of(h, p) for h, p in parts]), wild.matches([symbols_of(*canonical(h, p)) for h, p in parts])
            rules, verdicts, hits = [], [], []
            for row, more, (host, _) in zip(found, hit, parts, strict=True):
                fit = next((k for k in range(len(by_length)) if row[k]), None)
                those = [g for g, m in zip(globs, more, strict=True) if m and host]
                rules.append(None if fit is None else by_length[fit][1])
                verdicts.append(by_length[fit][0] if fit is not None else "block" if those else "allow")
                hits.append(those)
            return {"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": rules, "verdict": verdicts, "globs": hits}

        return step

    return with_columns(pages, [key], F.col("url") if url is None else url, make, "host string, path string, rule string, verdict string, globs array<string>")


def _globs_regex(globs: tuple[str, ...]) -> str:
    parts = ("".join({STAR: ".*", ANY: "[^\x01]", BOUNDARY: "\x01"}.get(x) or re.escape(chr(x)) for x in glob(g.lower())) for g in globs)
    return "(?s)^(?:" + "|".join(parts) + ")$"


#: The same for DuckDB, for urls without dot segments.
SQL = f"""WITH parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules AS (SELECT * FROM (VALUES {", ".join("('" + "', '".join((v, r, r.partition("/")[0], "/" + r.partition("/")[2])) + "')" for v, r in HOST_RULES)}) t(verdict, rule, on_host, on_path)),
fit AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM split JOIN rules ON ends_with('.' || host, '.' || on_host) AND starts_with(path, on_path) GROUP BY 1),
plain AS (SELECT page_id, lower(rtrim(regexp_replace(url_decode(regexp_replace(host, '^.*@', '')), ':[0-9]*$', ''), '.')) AS h, lower(url_decode(path)) AS p FROM split)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' AND regexp_matches('.' || h || chr(1) || p, '{_globs_regex(BLOCK_GLOBS)}') THEN 'block' ELSE 'allow' END) AS verdict
FROM split JOIN plain USING (page_id) LEFT JOIN fit USING (page_id)"""
