"""Small helpers that the operators share: table access, the shared checkpoint folder, bounded samples."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, use_checkpoints  # noqa: F401

#: Separator class of the word contracts: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables that are sent to all executors are measured first and have at most so many MB.
SMALL_MB = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> list[Column]:
    """All columns of a table under names of their own (c0, c1, ...), so that none meets a name of the operator; back by named()."""
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]


def named(df: DataFrame, but: tuple[str, ...] = (), **new: Column) -> list[Column]:
    """The columns that numbered() renamed under the names of df, without some, and with new values for others."""
    return [new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns) if c not in but]


def unit_hash(*cols: Column | str) -> Column:
    """A deterministic number in [0, 1) from the given columns, the same on every run and partitioning."""
    h = F.xxhash64(F.lit(20411), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def _release() -> None:
    """Give free memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def frees(task):
    """A function from Arrow batches to Arrow batches that leaves no free memory behind: Python workers live on between tasks."""

    @functools.wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            _release()

    return run
