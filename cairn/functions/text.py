"""Lines, previews and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a line ends, without taking its end away: as Python's splitlines does.
_LINE_END = "(?<=\\n)|(?<=\\r)(?!\\n)|(?<=[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])"
_OTHER_END = "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def lines(text: Column) -> Column:
    """The lines of a text with their ends; none for an empty text."""

    def ended(parts):
        whole = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.concat(x, F.lit("\n")))
        return F.concat(whole, F.slice(parts, F.lit(-1), F.lit(1)))

    # most texts end lines by line feeds alone, which needs no regular expression
    plain = F.transform(F.array(F.split(text, "\n", -1)), ended)[0]
    return F.array_remove(F.when(text.rlike(_OTHER_END), F.split(text, _LINE_END, -1)).otherwise(plain), "")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def preview(content: Column, start_line: Column, most: int = 8, width: int = 200) -> Column:
    """The first lines with their numbers, long ones cut, and how many follow."""
    whole = F.struct(F.rtrim(content, F.lit("\n")).alias("text"), start_line.alias("start"))
    cut = lambda r: F.when(F.length(r) > width, F.concat(F.substring(r, 1, width - 1), F.lit("…"))).otherwise(r)

    def shown(w):
        head = F.split(F.substring_index(w.text, "\n", most), "\n", -1)
        more = F.length(w.text) - F.length(F.replace(w.text, F.lit("\n"))) + 1 - most
        return F.struct(head.alias("lines"), more.alias("more"), w.start.alias("start"), F.length((w.start + F.size(head) - 1).cast("string")).alias("digits"))

    def numbered(b):
        rows = F.transform(b.lines, lambda r, i: F.concat(F.lpad((b.start + i).cast("string"), b.digits, F.lit(" ")), F.lit(" │ "), cut(r)))
        more = F.concat(F.lpad(F.lit(""), b.digits, F.lit(" ")), F.lit(" │ … "), b.more.cast("string"), F.lit(" more"))
        return F.array_join(F.when(b.more > 0, F.array_append(rows, more)).otherwise(rows), "\n")

    # bound by arrays of one, so that the text is cut and counted once
    return F.transform(F.transform(F.array(whole), shown), numbered)[0]


def format_bytes(n: Column, bench: bool = False) -> Column:
    """With a space and up to GB; for bench reports without a space and up to MB."""
    gap = "" if bench else " "
    scaled = lambda power, unit: F.format_string(f"%.1f{gap}{unit}", n / float(1024**power))
    small = F.when(n < 1024, F.format_string(f"%d{gap}B", n)).when(n < 1024**2, scaled(1, "KB"))
    return small.otherwise(scaled(2, "MB")) if bench else small.when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%.0fms", ms.cast("double"))).otherwise(F.format_string("%.2fs", ms / 1000.0))


def format_duration_ns(ns: Column) -> Column:
    return F.when(ns < 10**6, F.format_string("%dns", ns)).when(ns < 10**9, F.format_string("%.0fms", ns / 1e6)).otherwise(F.format_string("%.2fs", ns / 1e9))


def format_score(score: Column) -> Column:
    return F.format_string("%.3f", score)
