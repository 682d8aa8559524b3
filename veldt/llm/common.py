"""What the operators of this subpackage share: materialised cuts of lineage, bounded Arrow slices, key checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast may hold; what has more is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Text bytes that one vectorised step works on.
SLICE_BYTES = 1 << 21
#: The same for steps that hash every byte or word, which take about 50 bytes of memory for each.
WORD_SLICE_BYTES = 1 << 18
#: Bytes of rows that are brought to a Python worker at once. Spark's own bound, 10,000 rows, is 20 MB of usual documents.
BATCH_BYTES, BATCH_SETTING = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a temporary one if driver and
    executors are one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veldt-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import this package, whatever folder they start in."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [env.get("PYTHONPATH")])])


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile batches for Python workers hold BATCH_BYTES at most, and one row at least; a session's own bound stays."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veldt-{uuid.uuid4().hex}"
    with bounded_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veldt_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize wrote for these frames: only those whose every use has been written elsewhere since."""
    for df in frames:
        if path := getattr(df, "_veldt_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else df as it is."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_key(column: Column) -> Column:
    """A document id as a long; null ids count as one document that is smaller than all others."""
    return F.coalesce(column.cast("long"), F.lit(-(2**63)))


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows of about limit bytes of text (one row at least).

    Yields (first row, end row, the run's bytes, offsets of the rows in them). Null texts are empty.
    """
    column = batch.column(text)
    n = len(column)
    if not n:
        return
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.view(pa.large_binary()) if pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
