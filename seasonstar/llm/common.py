"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonstar.sources.tables import shared_folder

#: A word is a maximal run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a Parquet table on the storage all executors share: cuts lineage durably."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def sent_by_value(name: str) -> None:
    """Functions of module ``name`` travel to the executors whole, so the package need not be
    installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def lean(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` for a Python worker that gives memory back, after each batch and at its end.

    Workers serve one task after the other, of any stage; what an allocator keeps for later is
    memory that the next stage's own workers do not have.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            for made in step(batches):
                yield made
                del made
                pa.default_memory_pool().release_unused()
        finally:
            give_back()

    return run


def lean_group(step: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``step`` on one group, whose memory is given back; it leaves no cycles of objects."""

    def run(rows: pa.Table) -> pa.Table:
        try:
            return step(rows)
        finally:
            give_back(cycles=False)

    return run


def lean_cogroup(
    step: Callable[[pa.Table, pa.Table], pa.Table],
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a step on two groups of one key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return step(left, right)
        finally:
            give_back(cycles=False)

    return run


def give_back(cycles: bool = True) -> None:
    """Free memory of this process goes back to the system; ``cycles`` are looked for, which
    takes longer than the rest."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


# the wrapped steps run where this package need not be installed
sent_by_value(__name__)
