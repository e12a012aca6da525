"""Helpers shared by the corpus operators: tables, shared storage, hashing."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space below.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_THREAD = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back.

    This cuts the lineage, so a lost executor costs no recomputation of what
    came before, and later passes read only the columns that they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"
    # what was shuffled for the table is of no use once it stands
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    written(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables that ``materialize`` has written in this session and thread, in order; queries in other threads have their own."""
    if not hasattr(_THREAD, "tables"):
        _THREAD.tables = {}
    return _THREAD.tables.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, since: int) -> None:
    """Delete tables written after the first ``since``, but not the last one. What is left to compute must not need them."""
    paths = written(spark)
    for path in paths[since:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths[since:] = paths[since:][-1:]


#: Most rows of a table that is sent to all tasks, and tasks over which one key's rows are dealt where it is not.
MOST_SENT, SALTS = 100_000, 32


def bounded(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """``df``, written, and marked for broadcast if it has at most ``most`` rows; beyond that it stays an ordinary side of a join."""
    small = materialize(df, name)
    return F.broadcast(small) if small.count() <= (MOST_SENT if most is None else most) else small


def look_up(rows: DataFrame, small: DataFrame, on: str, key: str) -> DataFrame:
    """Left join of ``rows``, by ``on``, with a table of at most one row for each ``key``; null equals null.

    A table that may be sent (by ``bounded``) is. A larger one is copied SALTS times, and
    the rows of one key are dealt over as many tasks, by hashes of the rows, so a task that
    is run again deals them alike.
    """
    if small.count() <= MOST_SENT:
        return rows.join(F.broadcast(small), F.col(on).eqNullSafe(F.col(key)), "left")
    many = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_copy_"))
    dealt = rows.withColumn("_salt_", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int"))
    return dealt.join(many, F.col(on).eqNullSafe(F.col(key)) & (F.col("_salt_") == F.col("_copy_")), "left").drop("_salt_", "_copy_")


def with_text(docs: DataFrame, keep: list[str], text: Column | str) -> DataFrame:
    """The kept columns as _0, _1, ... and the text as _text, so that no name of theirs can clash."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], (F.col(text) if isinstance(text, str) else text).alias("_text"))


def ship(spark: SparkSession) -> None:
    """Send this subpackage to Python workers that could not import it otherwise."""
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.realpath(p) == str(root) for p in known) or getattr(spark.sparkContext, "_corpus_code", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}-corpus.zip"
    with zipfile.ZipFile(archive, "w") as z:
        package = Path(__file__).resolve().parents[1]
        for p in [package / "__init__.py", *(package / "llm").glob("*.py")]:
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._corpus_code = True


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % F.lit(n)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def uniform(*keys: Column) -> Column:
    """A reproducible number in (0, 1) from the keys: 52 bits of an md5."""
    digest = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
