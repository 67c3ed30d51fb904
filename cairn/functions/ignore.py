"""Ignore rules as one predicate over all prefixes of a path.

A rule is a name (it fits any segment or a whole prefix) or, if it holds one of
``* ? [ {``, a glob over the last segment or the whole prefix, in which only
``*`` (any characters, slashes too) and ``?`` (one character) are special. There
is no negation and no anchor.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an index of sources has no use for.
DEFAULT = """\
# the index itself
.cairn/
# version control
.git/
.hg/
.svn/
# fetched dependencies and environments
node_modules/
bower_components/
site-packages/
.venv/
.tox/
# made by tools
__pycache__/
*.pyc
.mypy_cache/
.pytest_cache/
.ruff_cache/
.gradle/
build/
dist/
target/
htmlcov/
*.min.js
*.map
# editors and systems
.idea/
.vscode/
*.swp
.DS_Store
Thumbs.db
# output of runs
*.log
*.tmp
"""
#: Segments that a poll never enters, whatever the rules say: changes there are a tool's own.
SKIPPED = (".cairn", ".git", ".hg", ".svn", "node_modules", "__pycache__")
#: A file of rules in the root of a tree.
FILE = ".cairnignore"


def read_rules(root: str) -> str:
    """The text of the tree's own rules; empty if it has none."""
    try:
        with open(os.path.join(root, FILE), encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return ""


def merged(*texts: str) -> str:
    """Rules of several texts as one, each once."""
    return "\n".join(dict.fromkeys(r for t in texts for r in t.splitlines()))


def parse(text: str) -> tuple[list[str], list[str]]:
    """Names and globs of an ignore file."""
    rules = [r.strip() for r in text.splitlines()]
    rules = [r.removesuffix("/") for r in rules if r and not r.startswith("#")]
    is_glob = re.compile(r"[*?\[{]").search
    return [r for r in rules if r and not is_glob(r)], [r for r in rules if is_glob(r)]


def ignored(path: Column, text: str) -> Column:
    """True if the path or a directory above it fits a rule."""
    names, globs = parse(text)
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    named = F.lit(False)
    if names:
        whole = [n for n in names if "/" in n]
        named = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
        if whole:
            named = named | F.arrays_overlap(prefixes, F.array(*[F.lit(n) for n in whole]))
    wild = F.lit(False)
    if globs:
        rx = "^(?:" + "|".join("".join({"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c, re.escape(c)) for c in g) for g in globs) + ")$"
        wild = F.exists(prefixes, lambda p: p.rlike(rx)) | F.exists(parts, lambda p: p.rlike(rx))
    return named | wild


def skipped(path: Column) -> Column:
    """Is a segment of the path one that a poll never enters?"""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(s) for s in SKIPPED]))
