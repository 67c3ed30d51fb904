"""Files to chunks of lines.

Plain files become overlapping windows in built-in functions. Files of a
language with known declarations are cut at those first, which depends on the
chunk before and so runs as a small function for each file.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths, text

WINDOW, STEP, SHORTEST, LONGEST = 48, 40, 4, 60
SCHEMA = "file_path string, content string, chunk_hash string, start_line int, end_line int, language string"
#: A boundary provider: text and language to 0-based half-open line ranges of declarations, or None where it knows nothing.
Boundaries = Callable[[str, str], list[tuple[int, int]] | None]


def windows(files: DataFrame) -> DataFrame:
    """Windows of WINDOW lines, a new one every STEP lines, for ``file_path`` and ``content``. An empty file has none."""
    split = files.select("file_path", text.lines(F.col("content")).alias("ls")).where("size(ls) > 0")
    window = lambda at: F.struct(
        F.array_join(F.slice("ls", at + 1, F.lit(WINDOW)), "").alias("content"), (at + 1).alias("start_line"), F.least(at + WINDOW, F.size("ls")).alias("end_line"),
    )
    made = split.select("file_path", F.inline(F.transform(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(STEP)), window)))
    return made.select("file_path", "content", text.content_hash(F.col("content")).alias("chunk_hash"), "start_line", "end_line", paths.language(F.col("file_path")).alias("language"))


def spans_of(n: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Declarations and what lies between, before and after them, as line spans. Ranges that overlap repeat lines; what
    follows goes on after the last range, also if an earlier one reaches further."""
    spans, at = [], 0
    for start, end in ranges:
        if start > at:
            spans.append((at, start))
        at = min(end, n)
        spans.append((start, at))
    return [*spans, (at, n)] if at < n else spans


def arrange(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans under SHORTEST lines join the next one, once; others over LONGEST lines are cut into windows."""
    out, i = [], 0
    while i < len(spans):
        (start, end), i = spans[i], i + 1
        if end - start < SHORTEST and i < len(spans):
            out.append((start, spans[i][1]))
            i += 1
        elif end - start > LONGEST:
            out += [(s, min(s + WINDOW, end)) for s in range(start, end, STEP)]
        else:
            out.append((start, end))
    return out


def python_boundaries(source: str, language: str) -> list[tuple[int, int]] | None:
    """Top-level functions and classes of Python, with decorators and the comment lines right above."""
    if language != "python":
        return None
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    rows = source.split("\n")
    found = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
            above = start
            while above and (not (row := rows[above - 1].strip()) or row.startswith("#")):
                above -= 1
                if row:
                    start = above
            found.append((start, node.end_lineno))
    return found


#: How a declaration at the top of a file begins, by language, for those whose bodies stand in braces. Its words may follow modifiers.
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|async|unsafe|extern|partial|open|data|override|inline|virtual|pub(?:\([^)]*\))?)\s+)*"
BRACED = {
    "typescript": r"(?:export\b|(?:default\s+|declare\s+|abstract\s+|async\s+)*(?:function|class|interface|type|enum|const|let|namespace)\b)",
    "javascript": r"(?:export\b|(?:default\s+|async\s+)*(?:function|class|const|let|var)\b)",
    "go": r"(?:func|type)\b",
    "rust": _MODIFIERS + r"(?:fn|impl|struct|enum|trait|mod|union)\b",
    "java": _MODIFIERS + r"(?:class|interface|enum|record|@interface)\b",
    "kotlin": _MODIFIERS + r"(?:fun|class|interface|object|enum)\b",
    "csharp": _MODIFIERS + r"(?:namespace|class|interface|struct|enum|record)\b",
    "swift": _MODIFIERS + r"(?:func|class|struct|enum|protocol|extension|actor)\b",
    "php": _MODIFIERS + r"(?:function|class|interface|trait|enum)\b",
    "bash": r"(?:function\s+[\w:-]+|[\w:-]+\s*\(\s*\))",
    "c": r"(?:struct|enum|union|typedef|static|extern|[A-Za-z_][\w\s*]*\()",
    "cpp": r"(?:namespace|template|class|struct|enum|union|typedef|static|extern|[A-Za-z_][\w\s*&:<>,]*\()",
}
BRACED["tsx"] = BRACED["typescript"]
_BEGINS = {lang: re.compile(rx) for lang, rx in BRACED.items()}
#: What may hold a brace that isn't one: comments and strings.
_NO_CODE = re.compile(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\[\s\S])*+`""")
_SHELL_NO_CODE = re.compile(r"""(?<!\S)#[^\n]*|"(?:[^"\\]|\\[\s\S])*+"|'[^']*+'|\$\{[^}\n]*+\}""")


def brace_boundaries(source: str, language: str) -> list[tuple[int, int]] | None:
    """Declarations at the top of a file whose bodies stand in braces, with the comment lines right above.

    A declaration begins on an unindented line and ends with the line where its braces
    close, or, without braces, at a line that ends in a semicolon, or is followed by a blank one.
    """
    if language not in _BEGINS:
        return None
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    rows = source.split("\n")
    code = (_SHELL_NO_CODE if language == "bash" else _NO_CODE).sub(blank, source).split("\n")
    found, i, depth = [], 0, 0
    while i < len(code):
        if depth <= 0 and code[i][:1].strip() and _BEGINS[language].match(code[i]):
            start, depth, opened, j = i, 0, False, i
            while j < len(code):
                depth += code[j].count("{") - code[j].count("}")
                opened |= "{" in code[j]
                if depth <= 0 and (opened or code[j].rstrip().endswith(";") or j + 1 == len(code) or not code[j + 1].strip()):
                    break
                j += 1
            end = min(j + 1, len(code))
            while start and rows[start - 1].lstrip().startswith(("//", "/*", "*", "#", "@")) and not (found and found[-1][1] >= start):
                start -= 1
            found.append((start, end))
            i, depth = end, 0
            continue
        depth = max(0, depth + code[i].count("{") - code[i].count("}"))
        i += 1
    return found


def boundaries(source: str, language: str) -> list[tuple[int, int]] | None:
    """Those of Python by its parser, those of languages with braces by their patterns."""
    return python_boundaries(source, language) if language == "python" else brace_boundaries(source, language)


def by_declarations(files: DataFrame, provider: Boundaries = boundaries) -> DataFrame:
    """Chunks at declarations; a file without any, or that the provider can't read, gets windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, lang in zip(batch.file_path, batch.content, batch.language, strict=True):
                ls = content.splitlines(True)
                ranges = provider(content, lang)
                spans = arrange(spans_of(len(ls), ranges)) if ranges else [(s, min(s + WINDOW, len(ls))) for s in range(0, len(ls), STEP)]
                rows += [(path, "".join(ls[s:e]), s + 1, e, lang) for s, e in spans]
            yield pd.DataFrame(rows, columns=["file_path", "content", "start_line", "end_line", "language"])

    known = files.where("content is not null").select("file_path", "content", paths.language(F.col("file_path")).alias("language"))
    made = known.mapInPandas(run, "file_path string, content string, start_line int, end_line int, language string")
    return made.select("file_path", "content", text.content_hash(F.col("content")).alias("chunk_hash"), "start_line", "end_line", "language").where("content != ''")


def chunk(files: DataFrame, provider: Boundaries = boundaries, languages: tuple[str, ...] = ("python", *BRACED)) -> DataFrame:
    """Declarations where the provider knows the language, windows elsewhere."""
    known = paths.language(F.col("file_path")).isin(*languages)
    return by_declarations(files.where(known), provider).unionByName(windows(files.where(~known)))


def last_written(chunks: DataFrame) -> DataFrame:
    """One row for each chunk_hash: the one of the greatest (file_path, start_line)."""
    others = [c for c in chunks.columns if c != "chunk_hash"]
    best = chunks.groupBy("chunk_hash").agg(F.max_by(F.struct(*others), F.struct("file_path", "start_line")).alias("r"))
    return best.select("chunk_hash", "r.*").select(*chunks.columns)
