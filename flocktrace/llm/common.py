"""What the operators share: words, tables, batches for Python, and the core's intermediate storage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import dropped, new_dir, running_totals, shared_dir, staged, written

__all__ = ["BLANK", "WORD", "bounded", "cache", "checked", "dropped", "fresh", "lean", "new_dir", "running_totals", "shared_dir", "staged", "table", "words", "written"]

#: A word: no space and none of the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


#: Rows of text that go to Python in one batch.
BATCH = 1000


def bounded(df: DataFrame) -> DataFrame:
    """df, after seeing to it that the session sends at most BATCH rows to Python at once: batches are counted in rows, and texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH:
        df.sparkSession.conf.set(key, str(BATCH))
    return df


#: Bytes of values of a table that is broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 8 << 20


def _width(kind: T.DataType, column: Column) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(column), F.lit(0)) * 16 + 16
    return F.lit(8)


def checked(small: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """small to be broadcast if its values take few bytes, which are counted here, else as it is."""
    total = small.agg(F.sum(sum((_width(f.dataType, F.col(f.name)).cast("long") for f in small.schema), F.lit(16).cast("long")))).first()[0]
    return F.broadcast(small) if (total or 0) <= most else small


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


_caches: dict[str, dict] = {}


def cache(name: str) -> dict:
    """A memory of a Python worker that is emptied when the worker turns to another operator."""
    return _caches.setdefault(name, {})


def release() -> None:
    """Gives freed memory back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def within(run: Callable[[Iterator], Iterator], batches: Iterator, keeps: str) -> Iterator:
    """run over batches in a worker that has first forgotten all memories but `keeps`."""
    for name, known in _caches.items():
        if name != keeps:
            known.clear()
    try:
        yield from run(batches)
    finally:
        release()


def lean(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """run as a function for mapInArrow that keeps no memory of other operators, and of its own only the one named."""

    def wrapped(batches: Iterator) -> Iterator:
        # by its name, so that it is the worker's own module that forgets
        return within(run, batches, keeps)

    return wrapped


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] = ()) -> DataFrame:
    """One of the given tables, pruned to the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
