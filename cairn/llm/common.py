"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.shared import staged  # noqa: F401  for the operators
from cairn.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no helper column can clash with any."""
    return F.struct(*[quoted(c) for c in docs.columns])


def unpacked(docs: DataFrame, row: str = "_row", replace: dict[str, Column] | None = None) -> list[Column]:
    """The columns that ``packed`` put into ``row``, those in ``replace`` anew."""
    return [(replace or {}).get(c, F.col(row).getField(c)).alias(c) for c in docs.columns]


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once per row and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def unit(col: Column, seed: int = 0) -> Column:
    """A fixed pseudo-random number in [0, 1) for each value of ``col``."""
    return (F.xxhash64(col, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the decimal text of ``col``, modulo ``n``; null where ``col`` is null."""
    return F.crc32(col.cast("string").cast("binary")) % n


def with_columns(df: DataFrame, keep: list[str], source: Column | str, make: Callable[[], Callable[[list], dict]], adds: str) -> DataFrame:
    """``keep`` columns of ``df``, untouched, and those of the DDL ``adds``, made from ``source`` (one of ``keep``, or a column of its own) in Python workers.

    ``make()`` runs once a task and returns a function from a list of values to
    the new columns (lists or Arrow arrays of that length). A kept column that has the name of a
    new one is left out: the new one stands for it.
    """
    ship(df.sparkSession)
    added = T.StructType.fromDDL(adds)
    new = {f.name.lower() for f in added}
    names = [c for c in keep if c.lower() not in new]
    own = source not in names if isinstance(source, str) else True
    columns = [quoted(c) for c in names] + ([quoted(source) if isinstance(source, str) else source] if own else [])
    kept = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    n, read = len(names), len(names) if own else names.index(source)
    out = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(names, kept.schema, strict=False)], *added.fields])
    arrow = list(to_arrow_schema(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in pieces(batch):
                made = step(piece.column(read).to_pylist())
                arrays = [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], *arrays], schema=pa.schema([*[f.with_name(c) for c, f in zip(names, piece.schema, strict=False)], *arrow]))

    return kept.mapInArrow(run, out)


def pieces(batch: pa.RecordBatch, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``size`` bytes, so that long texts don't pile up."""
    step = max(1, min(rows, int(size * batch.num_rows / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
