"""Multiple-comparison correction in log space."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bonferroni(rows: DataFrame, column: str = "nlogp") -> DataFrame:
    """min(ln p + ln m, 0), nulls left out of m."""
    m = rows.agg(F.count(column).alias("_m_"))
    return rows.crossJoin(F.broadcast(m)).withColumn("corrected", F.least(F.col(column) + F.log(F.col("_m_").cast("double")), F.lit(0.0))).drop("_m_")


def fdr(rows: DataFrame, method: str = "bh", column: str = "nlogp", blocks: int | None = None) -> DataFrame:
    """Benjamini-Hochberg or -Yekutieli step-up by ranks and a running minimum from the largest p.

    The rank and the running minimum go over ranges of about as many values first and
    then within each range, so no task orders all tests.
    """
    if method not in ("bh", "by"):
        raise ValueError(f"unknown method: {method}")
    from quillmap.operators.cbma import in_ranges

    live = in_ranges(rows.where(F.col(column).isNotNull()), column, blocks)
    m = live.count()
    # ln of the harmonic number: its first terms, and beyond them the usual expansion
    extra = 0.0
    if method == "by" and m:
        extra = math.log(sum(1 / i for i in range(1, m + 1)) if m < 1000 else math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m))
    sizes = live.groupBy("_b_").agg(F.count("*").alias("n")).withColumn("_skip_", F.coalesce(F.sum("n").over(Window.orderBy("_b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b_", "_skip_")
    up = Window.partitionBy("_b_").orderBy(column)
    ranked = live.join(sizes, "_b_").withColumn("_r_", F.row_number().over(up) + F.col("_skip_"))
    ranked = ranked.withColumn("_a_", F.col(column) - F.log(F.col("_r_") / m) + extra)
    lows = ranked.groupBy("_b_").agg(F.min("_a_").alias("low")).withColumn("_next_", F.min("low").over(Window.orderBy(F.desc("_b_")).rowsBetween(Window.unboundedPreceding, -1))).select("_b_", "_next_")
    down = Window.partitionBy("_b_").orderBy(F.desc("_r_")).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.join(lows, "_b_").withColumn("corrected", F.least(F.min("_a_").over(down), F.coalesce("_next_", F.lit(0.0)), F.lit(0.0)))
    out = out.drop("_b_", "_skip_", "_r_", "_a_", "_next_")
    return out.unionByName(rows.where(F.col(column).isNull()).withColumn("corrected", F.lit(None).cast("double")))


METHODS = {"bonferroni": bonferroni, "indep": lambda r, **k: fdr(r, "bh", **k), "negcorr": lambda r, **k: fdr(r, "by", **k), "bh": lambda r, **k: fdr(r, "bh", **k), "by": lambda r, **k: fdr(r, "by", **k)}


def correct(maps: DataFrame, method: str | None, column: str = "nlogp") -> DataFrame:
    """Apply a named correction; None leaves values; an unknown name is an error."""
    if method is None:
        return maps.withColumn("corrected", F.col(column))
    if method not in METHODS:
        raise ValueError(f"unknown correction: {method}")
    return METHODS[method](maps, column=column)


def suffix(name: str, kind: str, method: str) -> str:
    return f"{name}_corr-{kind.upper()}_method-{method}"


def max_stat_p(observed: DataFrame, maxima: DataFrame) -> DataFrame:
    """Family-wise p of (voxel, stat): the share of iterations whose maximum is at least as large, clipped to [1/n, 1 - 1/n]."""
    from quillmap.operators.cbma import null_to_p

    p = null_to_p(observed.select(F.col("voxel").cast("long").alias("key"), F.col("stat").alias("value")), maxima.select(F.col("max_stat").alias("value")))
    return p.select(F.col("key").alias("voxel"), F.col("value").alias("stat"), "p")


def critical_value(maxima: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The exact (1 - alpha) percentile of maxima, linearly interpolated."""
    return maxima.agg(F.percentile("max_stat", 1 - alpha).alias("critical"))
