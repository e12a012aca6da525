"""Sparse matrices in archives of arrays (``.npz``), as long rows; one archive or a folder of shards, each some rows of the matrix.

An archive is the parallel unit and must fit a task; no dense row is made.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries of a batch that leaves a task.
BATCH = 1 << 20


def decode(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Rows, columns, values and shape of a matrix by rows, by columns or by entries; entries of one place are summed, zeros left out."""
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as a:
            part = {k: a[k] for k in a.files}
    except (ValueError, OSError, EOFError, zipfile.BadZipFile, zlib.error) as e:
        raise ValueError("not an archive of arrays") from e
    kind = part["format"].item() if "format" in part else None
    kind = kind.decode() if isinstance(kind, bytes) else kind
    if kind not in ("csr", "csc", "coo"):
        raise ValueError(f"a matrix of format {kind}")
    shape = tuple(int(x) for x in part["shape"])
    if kind == "coo":
        row, column = part["row"].astype(np.int64), part["col"].astype(np.int64)
    else:
        own, other = np.repeat(np.arange(len(part["indptr"]) - 1), np.diff(part["indptr"])), part["indices"].astype(np.int64)
        row, column = (own, other) if kind == "csr" else (other, own)
    place, at = np.unique(row * max(shape[1], 1) + column, return_inverse=True)
    value = np.bincount(at, part["data"].astype(float), len(place))
    some = value != 0
    row, column = np.divmod(place[some], max(shape[1], 1))
    return row, column, value[some], shape


def read(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of an archive, or of a folder's archives one below the other, in the order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in _archives(batches):
            row, column, value, _ = _named(name, content)
            for a in range(0, len(row), BATCH):
                cut = slice(a, a + BATCH)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(row[cut])), pa.array(row[cut]), pa.array(column[cut]), pa.array(value[cut])], ["path", "row", "column", "value"])

    def heights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in _archives(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_named(name, content)[3][0]])], ["path", "n"])

    # a row an archive
    above = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    first = files.mapInArrow(heights, "path string, n long").select("path", F.coalesce(above, F.lit(0)).alias("_above_"))
    return files.mapInArrow(entries, "path string, row long, column long, value double").join(first, "path").select((F.col("row") + F.col("_above_")).alias("row"), "column", "value")


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        for name, content in zip(b.column("path"), b.column("content"), strict=True):
            yield name.as_py(), content.as_py()


def _named(name: str, content: bytes):
    try:
        return decode(content)
    except ValueError as e:
        raise ValueError(f"{name}: {e}") from e


def numbered(rows: DataFrame, name: str = "row") -> DataFrame:
    """Rows read from one text or table file with their place in it, from 0.

    Spark reads a file by blocks: a row's place is its place in the block and the rows of the blocks before, so no order goes over all rows.
    """
    kept = rows.columns
    rows = rows.select("*", F.col("_metadata.file_block_start").alias("_block_"), F.monotonically_increasing_id().alias("_at_"))
    inside = F.row_number().over(Window.partitionBy("_block_").orderBy("_at_")) - 1
    before = F.sum("count").over(Window.orderBy("_block_").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("_block_").count().select("_block_", F.coalesce(before, F.lit(0)).alias("_before_"))
    return rows.withColumn("_inside_", inside).join(blocks, "_block_").select(*kept, (F.col("_inside_") + F.col("_before_")).alias(name))
