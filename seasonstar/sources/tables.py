"""CSV input with every column as text, and Parquet tables that are rebuilt or refreshed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


#: Column that holds the raw text of a malformed record.
MALFORMED = "_malformed"
ON_MALFORMED = ("fail", "capture")


def read_text_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    empty_as_null: bool = True,
    on_malformed: str = "fail",
    multi_line: bool = False,
) -> DataFrame:
    """Read headed CSV files with nothing coerced: every column is STRING.

    The header of every file is checked against the first one, so files with
    another column order fail instead of being read by position. A record with
    too many or too few fields, as a broken quote or a line break inside one
    leaves it, ends the read, or with ``on_malformed="capture"`` comes with its
    raw text in the column ``MALFORMED``, which is NULL for good records.

    Files stay splittable (one record per line) unless ``multi_line`` allows
    line breaks inside quotes.
    """
    if on_malformed not in ON_MALFORMED:
        raise ValueError(f"on_malformed must be one of {ON_MALFORMED}, got {on_malformed!r}")
    reader = spark.read.options(
        header=True, encoding="UTF-8", quote='"', escape='"', multiLine=multi_line
    )
    names = reader.csv(path).columns
    missing = [name for name in columns or () if name not in names]
    if missing:
        raise ValueError(f"columns not in {path}: {missing}")
    fields = [StructField(name, StringType()) for name in names]
    capture = on_malformed == "capture"
    if capture:
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED)
        fields.append(StructField(MALFORMED, StringType()))
    else:
        reader = reader.options(mode="FAILFAST")
    # without pruning every field of a record is looked at, also those nobody asked for
    reader = reader.options(enforceSchema=False, columnPruning=False)
    frame = reader.schema(StructType(fields)).csv(path)
    if columns:
        kept = [*columns, MALFORMED] if capture else columns
        frame = frame.select(*[F.col(f"`{name}`") for name in kept])
    return frame if empty_as_null else frame.fillna("", subset=[n for n in frame.columns if n != MALFORMED])


def rebuild_table(
    frame: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    refresh: bool = False,
) -> DataFrame:
    """Replace the Parquet table at ``path`` and return it as read back.

    With ``refresh`` only the partitions present in ``frame`` are replaced.
    ``sort_by`` orders rows within each file for row-group pruning; a table has
    no global order. Rows of a partitioned table are rebalanced first: each
    partition goes to as many files as its size asks for, however many tasks
    read the source. Reading back cuts the lineage on durable storage.
    """
    if partition_by:
        frame = frame.hint("rebalance", *partition_by)
    if partition_by or sort_by:
        frame = frame.sortWithinPartitions(*partition_by, *sort_by)
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
        writer = writer.option("partitionOverwriteMode", "dynamic" if refresh else "static")
    elif refresh:
        raise ValueError("refresh needs partition_by")
    writer.parquet(path)
    reader = frame.sparkSession.read
    if partition_by:  # without rows there is no file to take the schema from
        reader = reader.schema(frame.schema)
    return reader.parquet(path)


@cache
def _local_folder() -> str:
    """One scratch folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="seasonstar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` on the storage all executors share.

    The cluster names that storage in ``spark.checkpoint.dir``. Only a local
    session without the setting gets a scratch folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
