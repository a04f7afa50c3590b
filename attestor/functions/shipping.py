"""Python functions of this package on executors that do not have it installed; rows on all cores."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import cache, lru_cache, partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()
#: Of a Python worker: the function of its last task, and what its functions keep from task to task.
_last: list[tuple[str, str]] = []
_kept: list = []


@cache
def _trim():
    """The C library's function that returns free memory to the system, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return memory that a batch has freed: a worker serves many tasks, and two share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def kept(function: Callable, most: int | None = None) -> Callable:
    """``function``, whose last ``most`` results (all if None) a worker keeps until it gets a task of another function."""
    _kept.append(found := lru_cache(maxsize=most)(function))
    return found


def _task(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task of ``function``: what other functions keep in this worker goes before it, its own free memory after it."""
    own = getattr(function, "func", function)
    if _last != [(own.__module__, own.__qualname__)]:
        _last[:] = [(own.__module__, own.__qualname__)]
        for each in _kept:
            each.cache_clear()
        give_back()
    try:
        yield from function(batches)
    finally:
        give_back()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parents[1]
        target = Path(tempfile.mkdtemp(prefix="attestor-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_task, function), schema)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table of fewer partitions than cores over all cores.

    A file of one row group is read by one task; what follows would run on one core.  Inputs of more
    partitions, and so all large ones, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
