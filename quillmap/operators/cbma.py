"""Coordinate-based meta-analysis: statistics of voxels and their nulls."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.functions import special
from quillmap.operators import kernels
from quillmap.operators.text import checkpointed
from quillmap.plans.studyset import Grid


def union_probability(value: Column) -> Column:
    """1 - prod(1 - v) as a sum of logarithms; a value of 1 makes it 1."""
    return F.when(F.max(value) >= 1, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.log1p(-F.when(value < 1, value).otherwise(F.lit(0.0))))))


def ale_logs(ma: DataFrame, mask: DataFrame) -> DataFrame:
    """(voxel, log_none): the sum of ln(1 - value), which still tells voxels apart whose statistic rounds to 1."""
    total = ma.groupBy("voxel").agg(F.sum(F.log1p(-F.least("value", F.lit(1 - 1e-16)))).alias("log_none"))
    return mask.select("voxel").join(total, "voxel", "left").fillna(0.0, ["log_none"])


def ale_stat(ma: DataFrame, mask: DataFrame) -> DataFrame:
    """(voxel, stat) over the whole mask; 0 where no analysis reaches."""
    stat = ma.groupBy("voxel").agg(union_probability(F.col("value")).alias("stat"))
    return mask.select("voxel").join(stat, "voxel", "left").fillna(0.0, ["stat"])


def mkda_density(ma: DataFrame, weights: DataFrame, mask: DataFrame) -> DataFrame:
    """Weighted share of analyses active at each voxel; ``weights`` has (id, weight)."""
    stat = with_ids(ma, weights).groupBy("voxel").agg(F.sum(F.col("weight") * F.col("value")).alias("stat"))
    return mask.select("voxel").join(stat, "voxel", "left").fillna(0.0, ["stat"])


def with_ids(rows: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of activations with a table of ids. What a task of Python makes of few points looks small to the planner, so a join by its sizes would send all of it to the driver."""
    return rows.join(ids.hint("merge"), "id", how)


def mkda_density_points(point: DataFrame, weights: DataFrame, grid: Grid, r: float, mask: DataFrame) -> DataFrame:
    """``mkda_density`` from points: weights meet them by id, and are summed where the spheres are."""
    total = kernels.mkda_sums(point.select("id", *"ijk").join(weights.select("id", "weight"), "id"), grid, r, "weight")
    return mask.select("voxel").join(total.withColumnRenamed("total", "stat"), "voxel", "left").fillna(0.0, ["stat"])


def mkda_weights(analysis: DataFrame, point: DataFrame) -> DataFrame:
    """(id, weight) of analyses with points: their number, times sqrt(n) x inference factor over its sum.

    ``sample_size`` and ``inference`` (ffx counts 0.75) are columns of ``analysis``; absent ones count 1.
    """
    factor = F.when(F.col("inference") == "ffx", 0.75).otherwise(1.0) if "inference" in analysis.columns else F.lit(1.0)
    size = F.col("sample_size").cast("double") if "sample_size" in analysis.columns else F.lit(1.0)
    raw = analysis.select("id", (F.sqrt(size) * factor).alias("raw")).join(point.select("id").distinct(), "id", "left_semi")
    total = raw.agg(F.sum("raw").alias("total"), F.count("*").alias("n"))
    return raw.crossJoin(F.broadcast(total)).select("id", (F.col("n") * F.col("raw") / F.col("total")).alias("weight"))


def kda_stat(ma: DataFrame, mask: DataFrame) -> DataFrame:
    stat = ma.groupBy("voxel").agg(F.sum("value").alias("stat"))
    return mask.select("voxel").join(stat, "voxel", "left").fillna(0.0, ["stat"])


def one_way(x: Column, n: Column, mean: Column) -> Column:
    return F.try_divide((x - mean) * (x - mean) * n, mean * (n - mean))


def two_way(a: Column, b: Column, n1: Column, n2: Column) -> Column:
    """2 x 2 chi-square of counts; 2.0 where its denominator is 0."""
    n = n1 + n2
    den = (a + b) * (n - a - b) * n1 * n2
    top = a * n2 - b * n1
    return F.when(den == 0, F.lit(2.0)).otherwise(F.try_divide(n * top * top, den))


def mkda_chi2(active: DataFrame, group1: DataFrame, ids: DataFrame, mask: DataFrame, prior: float = 0.5) -> DataFrame:
    """The maps of the chi-square analysis from ``active`` (id, voxel).

    One pass counts both groups at each voxel; all else is arithmetic over the mask. With a column ``g`` (1 in
    the group, else 2) ``active`` has the analyses of ``ids`` only, and nothing is joined.
    """
    flagged = ids.select("id").distinct().join(group1.select("id").distinct().withColumn("one", F.lit(1)), "id", "left")
    sizes = flagged.agg(F.count("one").cast("double").alias("n1"), F.sum(F.when(F.col("one").isNull(), 1).otherwise(0)).cast("double").alias("n2"))
    own = active.withColumn("one", F.when(F.col("g") == 1, 1)) if "g" in active.columns else with_ids(active, flagged)
    counts = own.groupBy("voxel").agg(F.count("one").cast("double").alias("a"), F.sum(F.when(F.col("one").isNull(), 1).otherwise(0)).cast("double").alias("b"))
    return chi2_maps(counts, sizes, mask, prior)


def mkda_chi2_of(labelled: DataFrame, mask: DataFrame, prior: float = 0.5) -> DataFrame:
    """The maps of the chi-square analysis from ``kernels.mkda_labelled``, where the group has the only label there is."""
    own = checkpointed(labelled)  # one number for each group and voxel, used three times
    some, every = (F.coalesce(F.sum(F.when(F.col("label").isNotNull() if one else F.col("label").isNull(), F.col("n"))), F.lit(0)).cast("double") for one in (True, False))
    counts = own.where("voxel >= 0").groupBy("voxel").agg(some.alias("a"), (every - some).alias("b"))
    sizes = own.where("voxel = -1").agg(some.alias("n1"), (every - some).alias("n2"))
    return chi2_maps(counts, sizes, mask, prior)


def chi2_maps(counts: DataFrame, sizes: DataFrame, mask: DataFrame, prior: float = 0.5) -> DataFrame:
    """The maps from (voxel, a, b), numbers of active analyses of the group and of the others, and one row (n1, n2) of all there are."""
    v = mask.select("voxel").join(counts, "voxel", "left").fillna(0.0, ["a", "b"])
    mean = v.agg(F.avg("a").alias("mean_a"))
    v = v.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(mean))
    a, b, n1, n2 = (F.col(c) for c in ("a", "b", "n1", "n2"))
    p_a, f, u = (a + b) / (n1 + n2), a / n1, b / n2
    f_prior = prior * f + (1 - prior) * u
    uni, ass = one_way(a, n1, F.col("mean_a")), two_way(a, b, n1, n2)
    return v.select(
        "voxel",
        "a",
        "b",
        p_a.alias("p_a"),
        f.alias("p_agf"),
        u.alias("p_agu"),
        F.try_divide(f * (n1 / (n1 + n2)), p_a).alias("p_fga"),
        f_prior.alias("p_agf_prior"),
        F.try_divide(f * prior, f_prior).alias("p_fga_prior"),
        uni.alias("chi2_uniformity"),
        ass.alias("chi2_association"),
        (F.sqrt(uni) * F.signum(a - F.col("mean_a"))).alias("z_uniformity"),
        (F.sqrt(ass) * F.signum(f - u)).alias("z_association"),
    )


def ale_histograms(ma: DataFrame, n_voxels: int, step: float = 1e-5) -> DataFrame:
    """(id, bin, share): how many of the mask's voxels have an analysis' value in each bin of width ``step``; bin 0 has the rest."""
    hit = ma.groupBy("id", F.floor(F.col("value") / step + 0.5).alias("bin")).agg(F.count("*").alias("n"))
    rest = hit.groupBy("id").agg((F.lit(n_voxels) - F.sum("n")).alias("n")).withColumn("bin", F.lit(0).cast("long"))
    return hit.unionByName(rest.select("id", "bin", "n")).groupBy("id", "bin").agg((F.sum("n") / n_voxels).alias("share"))


#: Analyses that one task folds, distributions that one task merges, and products of two of them that are formed one by one.
FOLD_ANALYSES, FOLD_MERGES, FOLD_DIRECT = 256, 8, 20_000_000


def convolve(x: np.ndarray, y: np.ndarray, most: int | None = None) -> np.ndarray:
    """The sum of two independent numbers of bins; shares below 1e-16 of the largest are noise of the transform and set to 0.

    Sums beyond ``most`` are kept together in the bin after it.
    """
    if most is not None and len(x) + len(y) - 2 > most:
        out = convolve(x, y)
        return np.concatenate([out[: most + 1], [out[most + 1 :].sum()]])
    n = len(x) + len(y) - 1
    if np.count_nonzero(x) * np.count_nonzero(y) <= FOLD_DIRECT:
        out = np.zeros(n)
        few, many = (x, y) if np.count_nonzero(x) < np.count_nonzero(y) else (y, x)
        for i in np.flatnonzero(few):
            out[i : i + len(many)] += few[i] * many
        return out
    size = 1 << (n - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[:n]
    return np.where(out > out.max() * 1e-16, out, 0.0)


def combine_unions(x: np.ndarray, y: np.ndarray, step: float) -> np.ndarray:
    """The distribution of 1 - (1 - a)(1 - b) on bins of ``step``.

    Few products are formed one by one, with exact tails. Many are a convolution over
    -ln(1 - a), in bins that are as narrow, and what lies in the last bin stays there.
    """
    i, j = np.flatnonzero(x), np.flatnonzero(y)
    if len(i) * len(j) <= FOLD_DIRECT:
        if len(i) < len(j):
            i, j, x, y = j, i, y, x
        out = np.zeros(int(round(1 / step)) + 1)
        for at in j:
            to = np.rint((1 - (1 - i * step) * (1 - at * step)) / step).astype(np.int64)
            out += np.bincount(to, x[i] * y[at], len(out))
        return out[: np.flatnonzero(out)[-1] + 1]
    last = int(np.ceil(-np.log(step / 2) / step))

    def logs(h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(h)
        with np.errstate(divide="ignore"):
            t = np.minimum(-np.log1p(-np.minimum(at * step, 1.0)) / step, last)
        return np.bincount(np.rint(t).astype(np.int64), h[at])

    out = convolve(logs(x), logs(y))
    at = np.flatnonzero(out)
    to = np.rint(-np.expm1(-np.minimum(at, last) * step) / step).astype(np.int64)
    return np.bincount(to, out[at])


def fold_histograms(hist: DataFrame, step: float = 1e-5, additive: bool = False, most: int | None = None) -> np.ndarray:
    """Null distribution of the statistic on bins 0, 1, ...: independent analyses combined by 1-(1-a)(1-b), or by sums.

    Combination is associative: blocks of analyses are folded on the executors, and
    then some blocks at a time, until one distribution, of a fixed length, is left for the
    driver. Sums have as many bins as the largest one, or as ``most``, the largest that is observed: all
    beyond it share a bin, so no tail that is asked for changes, and the length is that of the data's own range.
    """
    combine = (lambda x, y: convolve(x, y, most)) if additive else (lambda x, y: combine_unions(x, y, step))
    schema = "block long, bins binary"

    def fold(key, rows):
        total = np.ones(1)
        for _, own in rows.groupby("id", sort=True):
            h = np.zeros(int(own["bin"].max()) + 1)
            h[own["bin"]] = own["share"]
            total = combine(total, h)
        return pd.DataFrame({"block": [key[0]], "bins": [total.tobytes()]})

    def merge(key, rows):
        total = np.ones(1)
        for raw in rows.sort_values("block")["bins"]:
            total = combine(total, np.frombuffer(raw))
        return pd.DataFrame({"block": [key[0]], "bins": [total.tobytes()]})

    n = hist.select("id").distinct().count()
    if additive and n > FOLD_EXACT:
        own = hist.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bin", "share"))).alias("h"))
        return fold_kinds(own.groupBy("h").agg(F.count("*").alias("times")), most)
    blocks = max(1, -(-n // FOLD_ANALYSES))
    parts = hist.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInPandas(fold, schema)
    while blocks > 1:
        blocks = -(-blocks // FOLD_MERGES)
        parts = parts.groupBy((F.floor(F.col("block") / FOLD_MERGES)).alias("part")).applyInPandas(merge, schema)
    rows = parts.collect()
    return np.frombuffer(rows[0]["bins"]) if rows else np.ones(1)


#: Analyses up to which sums are folded one by one, with exact tails.
FOLD_EXACT = 8192


def fold_kinds(kinds: DataFrame, most: int | None = None) -> np.ndarray:
    """The distribution of the sum over many analyses by the product of their histograms' transforms.

    ``kinds`` has (h, times): analyses with the same histogram, a sorted array of (bin, share), count as one kind, many times. A transform is of the distance from a histogram's mean, and
    as long as the range outside which Bernstein's inequality leaves less than 1e-18, so it grows with the root of the number of analyses.
    As in ``convolve``, shares below 1e-16 of the largest are noise and set to 0, and sums beyond ``most`` share a bin.
    """
    # few bytes, so they are dealt to all cores by number
    kinds = kinds.repartition(2 * kinds.sparkSession.sparkContext.defaultParallelism).persist()

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, times in zip(b["h"], b["times"], strict=True):
                at, share = (np.array([r[c] for r in h], float) for c in ("bin", "share"))
                mean = float(at @ share)
                out.append((times * mean, times * float((at - mean) ** 2 @ share), float(np.abs(at - mean).max())))
            yield pd.DataFrame(out, columns=["mean", "var", "far"])

    m = kinds.mapInPandas(moments, "mean double, var double, far double").agg(F.sum("mean").alias("mean"), F.sum("var").alias("var"), F.max("far").alias("far")).first()
    bound = 42.0  # exp(-42) is 6e-19
    reach = m["far"] * bound / 3 + np.sqrt((m["far"] * bound / 3) ** 2 + 2 * bound * m["var"]) + 1
    size = 1 << int(np.ceil(np.log2(2 * reach + 4)))
    low = int(np.floor(m["mean"] - reach))
    omega = 2 * np.pi * np.arange(size // 2 + 1) / size

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        real, imag = np.zeros(len(omega)), np.zeros(len(omega))
        for b in batches:
            for h, times in zip(b["h"], b["times"], strict=True):
                at, share = (np.array([r[c] for r in h], float) for c in ("bin", "share"))
                x, y = np.zeros(len(omega)), np.zeros(len(omega))  # the transform less 1, without loss near 0
                for d, w in zip(at - at @ share, share, strict=True):
                    x -= w * 2 * np.sin(omega * (d / 2)) ** 2
                    y -= w * np.sin(omega * d)
                with np.errstate(divide="ignore"):
                    real += times * 0.5 * np.log1p(np.maximum(2 * x + x * x + y * y, -1.0))
                imag += times * np.arctan2(y, 1 + x)
        yield pd.DataFrame({"real": [real.tobytes()], "imag": [imag.tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        return pd.DataFrame({c: [sum(map(np.frombuffer, rows[c])).tobytes()] for c in ("real", "imag")})

    # a number for each frequency from each task, and one of all for the driver
    parts = kinds.mapInPandas(transform, "real binary, imag binary").withColumn("task", F.spark_partition_id())
    row = parts.groupBy(F.lit(0).alias("all")).applyInPandas(add, "real binary, imag binary").first()
    log = np.frombuffer(bytes(row["real"])) + 1j * np.frombuffer(bytes(row["imag"]))
    kinds.unpersist()
    out = np.fft.irfft(np.exp(log - 1j * omega * (m["mean"] - low)), size)
    out = np.where(out > out.max() * 1e-16, out, 0.0)
    found = np.flatnonzero(out)
    at = np.maximum(found + low, 0)
    if most is not None:
        at = np.minimum(at, most + 1)
    return np.bincount(at, out[found])


def ale_null(point: DataFrame, grid: Grid, step: float = 1e-5, fwhm: float | None = None) -> np.ndarray:
    """The null distribution of the union statistic of Gaussian kernels on bins of ``step``, from points.

    Sums of -ln(1 - value) only grow, and what reaches the last bin stays there. Chernoff's inequality over all analyses tells
    whether less than 1e-18 stays below it; then the distribution is that bin, and else histograms are folded.
    """
    mask, last = grid.mask_array(), int(np.ceil(-np.log(step / 2) / step)) * step
    rates = np.array([1.0, 4.0, 16.0, 64.0, 256.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, n, total = kernels.Gaussians(grid, fwhm), int(mask.sum()), np.zeros(len(rates))
        for _, t in kernels.analyses_of(batches):
            if (box := work.stamp(kernels.cells_of(t), t["sample_size"][0].as_py())) is not None:
                at = np.floor(work.best[box][mask[box]] / step + 0.5) * step
                logs = np.minimum(-np.log1p(-np.minimum(at, 1 - 1e-16)), last)
                total += np.log1p(np.expm1(-rates[:, None] * logs).sum(1) / n)
                work.clear(box)
        yield pa.RecordBatch.from_arrays([pa.array(rates), pa.array(total)], ["rate", "log"])

    sums = kernels.gaussian_rows(point, fwhm).mapInArrow(run, "rate double, log double").groupBy("rate").agg(F.sum("log").alias("log")).collect()
    if sums and min(r["rate"] * last + r["log"] for r in sums) < np.log(1e-18):
        out = np.zeros(int(round(1 / step)) + 1)
        out[-1] = 1.0
        return out
    return fold_histograms(ale_histograms(kernels.ale_gaussian(point, grid, fwhm), int(mask.sum()), step), step)


def null_table(spark: SparkSession, dist: np.ndarray) -> DataFrame:
    """(bin, p): the upper tail of a null distribution, over its largest value."""
    tail = np.cumsum(dist[::-1])[::-1]
    return spark.createDataFrame(pd.DataFrame({"bin": np.arange(len(tail)), "p": tail / tail.max()}))


def stat_to_p(stat: DataFrame, null: DataFrame, step: float) -> DataFrame:
    """p of each statistic by its bin (half away from zero), beyond the last bin the smallest; a statistic of 0 or less has p 1."""
    last = null.agg(F.max("bin").alias("last"), F.min(F.when(F.col("p") > 0, F.col("p"))).alias("least"))
    rows = stat.crossJoin(F.broadcast(last)).withColumn("bin", F.least(F.round(F.col("stat") / step).cast("long"), F.col("last")))
    # a table of bins, which Spark sends only if it is small
    out = rows.join(null, "bin", "left")
    return out.withColumn("p", F.when(F.col("stat") <= 0, F.lit(1.0)).otherwise(F.greatest("p", "least"))).drop("bin", "last", "least")


def with_z(rows: DataFrame) -> DataFrame:
    return rows.withColumn("z", special.p_to_z_udf("p"))


def in_ranges(rows: DataFrame, column: str, blocks: int | None = None) -> DataFrame:
    """Add ``_b_``: the range of values that a row is in, of ranges with about as many rows each, in order. Equal values share one.

    The rows are computed once, and dealt by Spark's range partitioning.
    """
    from quillmap.operators.text import checkpointed

    n = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(checkpointed(rows).repartitionByRange(n, column).withColumn("_b_", F.spark_partition_id()))


def null_to_p(value: DataFrame, null: DataFrame, tail: str = "upper", blocks: int | None = None) -> DataFrame:
    """Empirical p of (key, value) against null values: counts by a merged order of both, clipped to [1/n, 1 - 1/n].

    Values are ordered within ranges of about as many each; totals of the ranges before and after come from a small table,
    so no task orders all. ``symmetric`` is for nulls that mirror around 0: both tails count by absolute value.
    """
    if tail == "symmetric":
        value, null = value.withColumns({"_own_": F.col("value"), "value": F.abs("value")}), null.select(F.abs("value").alias("value"))
    both = value.select("key", "value", F.lit(0).alias("is_null"), F.col("_own_" if tail == "symmetric" else "value").alias("own")).unionByName(null.select(F.lit(None).cast("long").alias("key"), "value", F.lit(1).alias("is_null"), F.lit(None).cast("double").alias("own")))
    n = null.count() or 1
    both = in_ranges(both, "value", blocks)
    totals = both.groupBy("_b_").agg(F.sum("is_null").alias("t"))
    before = Window.orderBy("_b_").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("_b_")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_b_", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("below"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("above"))
    up = Window.partitionBy("_b_").orderBy(F.col("value").desc()).rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_b_").orderBy(F.col("value").asc()).rangeBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("ge", F.sum("is_null").over(up)).withColumn("le", F.sum("is_null").over(down)).where("is_null = 0").join(totals, "_b_")
    upper, lower = (F.col("ge") + F.col("above")) / n, (F.col("le") + F.col("below")) / n
    p = {"upper": upper, "lower": lower, "two": F.least(F.lit(1.0), 2 * F.least(upper, lower)), "symmetric": upper}[tail]
    return rows.select("key", F.col("own").alias("value"), F.greatest(F.lit(1 / n), F.least(F.lit(1 - 1 / n), p)).alias("p"))


def p_to_stat(null: DataFrame, p: float, step: float) -> float:
    """The statistic at which the null's tail first falls to ``p``: the bin before the first with a tail of at most p."""
    first = null.where(F.col("p") <= p).agg(F.min("bin").alias("b")).first()["b"]
    last = null.agg(F.max("bin").alias("b")).first()["b"]
    return step * (max(first - 1, 0) if first is not None else last)


def most_observed(ma: DataFrame, value: Column | None = None) -> int:
    """The largest sum over analyses at any voxel, rounded up."""
    found = ma.groupBy("voxel").agg(F.sum(F.lit(1.0) if value is None else value).alias("s")).agg(F.max("s")).first()[0]
    return int(np.ceil(found or 0))


def mkda_null(ma: DataFrame, n_voxels: int, weights: DataFrame | None = None, step: float = 1.0) -> np.ndarray:
    """Distribution of the number of analyses active at a voxel, each active at its own share of the mask at random.

    With ``weights`` (id, weight), of the sum of their weights, on bins of ``step``: the null of the weighted
    statistic. Without, unequal weights make p approximate, as the weighted sum is held against a count.
    """
    if weights is not None:
        ma = with_ids(ma, weights)
        at, most = F.round(F.first("weight") / step).cast("long"), int(np.ceil(most_observed(ma, F.col("weight")) / step)) + 1
    else:
        at, most = F.lit(1).cast("long"), most_observed(ma) + 1
    on = ma.groupBy("id").agg((F.count("*") / n_voxels).alias("on"), at.alias("at"))
    hist = on.select("id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("bin"), (1 - F.col("on")).alias("share")), F.struct(F.col("at").alias("bin"), F.col("on").alias("share")))).alias("h"))
    hist = hist.select("id", "h.*").groupBy("id", "bin").agg(F.sum("share").alias("share"))
    return fold_histograms(hist, step, additive=True, most=most)


def sphere_null(point: DataFrame, grid: Grid, r: float, most: int, once: bool = False) -> np.ndarray:
    """``kda_null``, or with ``once`` ``mkda_null``, from points, with sums up to ``most``: analyses are counted by their histogram where they are."""
    kinds = checkpointed(kernels.histogram_kinds(point, grid, r, once))
    if (kinds.agg(F.sum("times")).first()[0] or 0) > FOLD_EXACT:
        return fold_kinds(kinds, most)
    if once:
        return mkda_null(kernels.mkda(point, grid, r), int(grid.mask_array().sum()))
    return fold_histograms(kernels.kda_histograms(point, grid, r), 1.0, additive=True, most=most)


def kda_null(ma: DataFrame, n_voxels: int, value: float = 1.0) -> np.ndarray:
    """Distribution of the sum of spheres at a voxel, on bins of one sphere's value."""
    return fold_histograms(ale_histograms(ma, n_voxels, value), value, additive=True, most=most_observed(ma, F.col("value") / value) + 1)


#: Foci that one task draws for an iteration, iterations of one task, volumes that one task adds, and bytes of marks of analyses' spheres.
DRAW_FOCI, DRAW_ITERATIONS, ADD_VOLUMES, MARK_BYTES = 100_000, 10, 8, 32 << 20


#: Sums of ln(1 - value) below which 1 less the product is 1.0 as a double, whatever is still added, and blocks of an iteration that one task draws to find out.
NONE_LEFT, FIRST_BLOCKS = -40.0, 16


#: Bytes of a table of what each cell of a pool gives.
TABLE_BYTES = 256 << 20


def bit_sums(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit set, of rows of numbers of 64 bits: sums by carries, of 1, 2, 4, ..."""
    total, weight = np.zeros(rows.shape[1] * 64, np.int64), 1
    while len(rows):
        carries = []
        while len(rows) > 2:
            third = len(rows) // 3
            a, b, c, rest = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third], rows[3 * third :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rest])
        total += weight * np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        rows = np.concatenate(carries) if carries else rows[:0]
        weight *= 2
    return total


def united(table: np.ndarray, picked: np.ndarray, least: bool) -> np.ndarray:
    """Sums over rows of ``picked`` of the union of the table's bits, or of its least numbers."""
    width = table.shape[1]
    total = np.zeros(width if least else width * 64)
    for lo in range(0, len(picked), step := max(1, (1 << 18) // width)):
        own = picked[lo : lo + step]
        if own.shape[1] > len(own):  # few analyses of many foci
            found = np.stack([(np.minimum if least else np.bitwise_or).reduce(table[np.unique(x)], axis=0) for x in own])
        else:
            found = table[own[:, 0]]
            for j in range(1, own.shape[1]):
                (np.minimum if least else np.bitwise_or)(found, table[own[:, j]], out=found)
        total += found.sum(0) if least else bit_sums(found)
    return total


class Kinds:
    """Analyses as how many there are of each number of foci and sample size, which is all that random foci depend on."""

    def __init__(self, foci: DataFrame) -> None:
        size = F.col("sample_size").cast("double") if "sample_size" in foci.columns else F.lit(0.0)
        rows = foci.select(F.col("id").alias("_id_"), F.col("n").cast("long").alias("n"), size.alias("size")).where("n > 0").groupBy("n", "size").agg(F.count("*").alias("times"), F.min("_id_").alias("first"))
        # a row for each kind, not for each analysis, in the order of their first ids
        rows = [(r["n"], r["size"] if r["size"] is not None else 0.0, r["times"]) for r in rows.orderBy("first").collect()]
        self.n, self.size, self.times = (np.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (np.int64, float, np.int64), strict=True))
        self.upto = np.cumsum(self.n * self.times)

    @property
    def foci(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def sample(self, n: int, rng: np.random.Generator) -> Kinds:
        """``n`` analyses at random, without replacement."""
        out = object.__new__(Kinds)
        out.n, out.size, out.times = self.n, self.size, rng.multivariate_hypergeometric(self.times, n, method="marginals")
        out.upto = np.cumsum(out.n * out.times)
        return out

    def block(self, i: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """(foci, sample size) of each analysis of a block: those whose last focus falls in its share of all foci."""
        lo, hi = self.foci * i // blocks, self.foci * (i + 1) // blocks
        before = self.upto - self.n * self.times
        # of a kind, the analyses that end after lo and not after hi
        first, last = (np.clip((edge - before) // self.n, 0, self.times) for edge in (lo, hi))
        return np.repeat(self.n, last - first), np.repeat(self.size, last - first)


def simulated(spark: SparkSession, foci: DataFrame, pool: np.ndarray, grid: Grid, n_iters: int, kind: str = "mkda", r: float = 10.0, fwhm: float | None = None, seed: int = 0, subset: int | None = None, least: float | None = None) -> DataFrame:
    """(iteration, part): the summed activation of random foci, one volume as bytes for each iteration.

    With ``subset``, each iteration takes so many of the analyses, at random. Sums of kind ``ale`` only fall; with ``least`` an iteration
    ends once all voxels of the mask are below it, for callers to whom such sums are the same (see ``NONE_LEFT``).

    ``foci`` has (id, n) and for kind ``ale`` a sample_size (unless there is a ``fwhm``);
    foci are drawn from the cells of ``pool``. A block of analyses and some iterations are
    a task, which draws from (seed, iteration, block) and returns sums over its
    analyses: of spheres (``mkda``: once an analysis, ``kda``: all) or of ln(1 - value). Only the
    numbers of analyses of each kind go to tasks, so no analysis is a row here, and volumes
    of one iteration are added some at a time, as a tree, so no task holds more than ADD_VOLUMES.
    """
    if kind not in ("mkda", "kda", "ale"):
        raise ValueError(f"unknown kind: {kind}")
    kinds = Kinds(foci)
    sent = spark.sparkContext.broadcast((np.ascontiguousarray(pool), grid.mask_array(), kinds))
    steps, shape = np.array(kernels.sphere(r, grid.metric)), grid.shape
    blocks = max(1, -(-kinds.foci // DRAW_FOCI))
    chunks = -(-n_iters // DRAW_ITERATIONS)

    # a margin around the volume takes what falls outside, so offsets are one addition each
    margin = np.abs(steps).max(0) if len(steps) else np.zeros(3, np.int64)
    wide = tuple(int(n + 2 * m) for n, m in zip(shape, margin, strict=True))
    offsets = steps @ np.array([wide[1] * wide[2], wide[2], 1])
    size_wide = int(np.prod(wide))
    inner = tuple(slice(int(m), int(m) + n) for m, n in zip(margin, shape, strict=True))
    # analyses that are marked at once: their marks are added in bytes
    together = max(1, min(255, MARK_BYTES // size_wide))
    n_inside = int(grid.mask_array().sum())

    def spheres(picks: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
        total = np.zeros(size_wide, np.int64)
        first = np.ravel_multi_index(tuple((picks + margin).T), wide)
        if kind == "kda":
            first, times = np.unique(first, return_counts=True)
            for lo in range(0, len(first), 20_000):
                at = first[lo : lo + 20_000, None] + offsets[None]
                total += np.bincount(at.ravel(), np.repeat(times[lo : lo + 20_000], len(offsets)), size_wide).astype(np.int64)
            return total
        for a in range(0, len(ends) - 1, together):
            b = min(a + together, len(ends) - 1)
            row = np.repeat(np.arange(b - a) * size_wide, np.diff(ends[a : b + 1]))
            at = ((first[ends[a] : ends[b]] + row)[:, None] + offsets[None]).ravel()
            marks.ravel()[at] = 1
            total += marks[: b - a].sum(0, dtype=np.uint8)
            marks.ravel()[at] = 0
        return total

    def sphere_bits(cells: np.ndarray) -> np.ndarray:
        """The mask's voxels of each cell's sphere, as bits in numbers of 64."""
        mask, out = np.flatnonzero(np.pad(sent.value[1], [(int(m), int(m)) for m in margin]).ravel()), []
        for lo in range(0, len(cells), 1000):
            first = np.ravel_multi_index(tuple((cells[lo : lo + 1000] + margin).T), wide)
            on = np.zeros((len(first), size_wide), np.uint8)
            np.put_along_axis(on, first[:, None] + offsets[None], 1, 1)
            bits = np.zeros((len(first), -(-n_inside // 64) * 64), np.uint8)
            bits[:, :n_inside] = on[:, mask]
            out.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        return np.concatenate(out)

    def gaussian_terms(cells: np.ndarray, work: kernels.Gaussians, sample_size: float) -> np.ndarray:
        """ln(1 - value) at the mask's voxels of each cell's kernel."""
        out = np.zeros((len(cells), n_inside))
        for i, cell in enumerate(cells):
            if (box := work.stamp(cell[None], sample_size)) is not None:
                out[i] = np.log1p(-np.minimum(work.best[sent.value[1]], 1 - 1e-16))
                work.clear(box)
        return out

    def drawing() -> Callable[[int, int, np.ndarray | None], np.ndarray | None]:
        """What gives the volume of a block in an iteration, where some of the iteration is there already, or None if it has no analyses."""
        cells, inside, kinds = sent.value
        work, tables = kernels.Gaussians(grid, fwhm), {}
        # what each cell gives, where a table of this fits: an analysis then is a union, or a minimum, of its cells' rows
        by_table = len(cells) and (len(cells) * size_wide <= TABLE_BYTES if kind == "mkda" else kind == "ale" and len(cells) * n_inside * 8 <= TABLE_BYTES // 4)
        marks = np.zeros((together, size_wide), np.uint8) if kind == "mkda" and not by_table else np.zeros((0, size_wide), np.uint8)

        def by_tables(n: np.ndarray, sizes: np.ndarray, ends: np.ndarray, picked: np.ndarray, before: np.ndarray | None) -> np.ndarray:
            found = np.zeros(n_inside)
            before = 0.0 if before is None else before[inside.ravel()]
            for size in np.unique(sizes) if kind == "ale" and fwhm is None else (0.0,):
                if size not in tables:
                    if len(tables) * len(cells) * n_inside * 8 > TABLE_BYTES:
                        tables.clear()
                    tables[size] = sphere_bits(cells) if kind == "mkda" else gaussian_terms(cells, work, size)
                of = np.ones(len(n), bool) if kind == "mkda" or fwhm is not None else sizes == size
                for foci in np.unique(n[of]):
                    found += united(tables[size], picked[ends[:-1][of & (n == foci)][:, None] + np.arange(foci)], kind == "ale")[:n_inside]
                    if least is not None and (before + found).max(initial=-np.inf) < least:
                        return found
            return found

        def volume(it: int, block: int, before: np.ndarray | None = None) -> np.ndarray | None:
            own = kinds.block(block, blocks)
            # all blocks of an iteration take the same subset
            n, sizes = own if subset is None else kinds.sample(subset, np.random.default_rng([seed, it, 1 << 31])).block(block, blocks)
            if block and not len(n):
                return None
            ends = np.concatenate([[0], np.cumsum(n)])
            rng = np.random.default_rng([seed, it, block])
            picked = rng.integers(len(cells), size=ends[-1])
            if by_table and len(n):
                total = np.zeros(int(np.prod(shape)))
                total[inside.ravel()] = by_tables(n, sizes, ends, picked, before)
            elif kind == "ale":
                picks, total = cells[picked], np.zeros(shape)
                for a, b, s in zip(ends[:-1], ends[1:], sizes, strict=True):
                    if (box := work.stamp(picks[a:b], s)) is not None:
                        total[box] += np.log1p(-np.minimum(work.best[box], 1 - 1e-16))
                        work.clear(box)
                total = total.ravel()
            else:
                total = spheres(cells[picked], ends, marks).reshape(wide)[inner].ravel().astype(float)
            return np.where(inside.ravel(), total, 0.0)

        return volume

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        volume = drawing()
        for unit in (int(u) for b in batches for u in b["id"]):
            chunk, block = divmod(unit, blocks)
            for it in range(chunk * DRAW_ITERATIONS, min((chunk + 1) * DRAW_ITERATIONS, n_iters)):
                if (total := volume(it, block)) is not None:
                    yield pd.DataFrame({"iteration": [it], "block": [block], "part": [total.tobytes()]})

    def draw_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        volume, at = drawing(), np.flatnonzero(sent.value[1].ravel())
        for it in (int(u) for b in batches for u in b["id"]):
            total, ended = np.zeros(int(np.prod(shape))), False
            for block in range(min(blocks, FIRST_BLOCKS)):
                if (more := volume(it, block, total)) is not None:
                    total += more
                if ended := bool(total[at].max(initial=-np.inf) < least):
                    break
            yield pd.DataFrame({"iteration": [it], "block": [0], "part": [total.tobytes()], "ended": [ended or blocks <= FIRST_BLOCKS]})

    def add(key, parts):
        total = np.zeros(int(np.prod(shape)))
        for x in parts.sort_values("block")["part"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"iteration": [key[0]], "block": [key[1]], "part": [total.tobytes()]})

    def drawn(units: int, how: Callable, more: str = "") -> DataFrame:
        tasks = max(1, min(units, max(4 * spark.sparkContext.defaultParallelism, units // 64)))
        return spark.range(0, units, 1, tasks).mapInPandas(how, f"iteration long, block long, part binary{more}")

    def added(parts: DataFrame, left: int) -> DataFrame:
        while left > 1:
            left = -(-left // ADD_VOLUMES)
            parts = parts.groupBy("iteration", F.floor(F.col("block") / ADD_VOLUMES).alias("into")).applyInPandas(add, "iteration long, block long, part binary")
        return parts.select("iteration", "part")

    if least is None or kind != "ale":
        return added(drawn(blocks * chunks, draw), blocks)
    first = checkpointed(drawn(n_iters, draw_first, ", ended boolean"))
    # of each iteration a bit
    rest = np.array(sorted(r["iteration"] for r in first.where("not ended").select("iteration").collect()), np.int64)
    out = first.where("ended").select("iteration", "part")
    if not len(rest):
        return out

    def draw_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        volume = drawing()
        for unit in (int(u) for b in batches for u in b["id"]):
            i, block = divmod(unit, blocks - FIRST_BLOCKS)
            if (total := volume(int(rest[i]), block + FIRST_BLOCKS)) is not None:
                yield pd.DataFrame({"iteration": [int(rest[i])], "block": [block + 1], "part": [total.tobytes()]})

    left = blocks - FIRST_BLOCKS
    return out.unionByName(added(first.where("not ended").select("iteration", "block", "part").unionByName(drawn(len(rest) * left, draw_rest)), left + 1))


def _statistic(raw: bytes, kind: str, n_ids: int) -> np.ndarray:
    total = np.frombuffer(raw)
    return -np.expm1(total) if kind == "ale" else total / max(n_ids, 1) if kind == "mkda" else total


def monte_carlo(spark: SparkSession, foci: DataFrame, mask: DataFrame, grid: Grid, r: float, n_iters: int, seed: int = 0, kind: str = "mkda", threshold: float | None = None, fwhm: float | None = None, subset: int | None = None) -> DataFrame:
    """(iteration, max_stat, max_size, max_mass): random foci in the mask, one reduction for each iteration (see ``simulated``)."""
    pool = np.argwhere(grid.mask_array())
    n_ids = foci.select("id").distinct().count() if subset is None else subset
    shape = grid.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quillmap.operators.clusters import label

        for batch in batches:
            out = []
            for it, raw in zip(batch["iteration"], batch["part"], strict=True):
                stat = _statistic(raw, kind, n_ids)
                size, mass = 0, 0.0
                if threshold is not None:
                    marks = label(stat.reshape(shape) > threshold).ravel()
                    if marks.max():
                        size = int(np.bincount(marks)[1:].max())
                        mass = float(np.bincount(marks, stat - threshold)[1:].max())
                out.append((int(it), float(stat.max()), size, mass))
            yield pd.DataFrame(out, columns=["iteration", "max_stat", "max_size", "max_mass"])

    sims = simulated(spark, foci, pool, grid, n_iters, kind, r, fwhm, seed, subset)
    return sims.mapInPandas(run, "iteration long, max_stat double, max_size long, max_mass double")


def monte_carlo_null(spark: SparkSession, foci: DataFrame, grid: Grid, r: float, n_iters: int, step: float, seed: int = 0, kind: str = "mkda", fwhm: float | None = None) -> DataFrame:
    """(bin, p): the upper tail of all voxels' statistics under random foci, over all iterations."""
    inside = np.flatnonzero(grid.mask_array().ravel())
    n_ids = foci.select("id").distinct().count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["part"]:
                found, n = np.unique(np.rint(_statistic(raw, kind, n_ids)[inside] / step).astype(np.int64), return_counts=True)
                yield pd.DataFrame({"bin": found, "n": n})

    sims = simulated(spark, foci, np.argwhere(grid.mask_array()), grid, n_iters, kind, r, fwhm, seed)
    return tail_of(sims.mapInPandas(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")))


def tail_of(counts: DataFrame) -> DataFrame:
    """(bin, p) of (bin, n): the share at or above each bin; bins between take the next one's by ``stat_to_p`` over all of them."""
    total = counts.agg(F.sum("n").alias("total"))
    # a table of bins, of fixed length
    up = counts.withColumn("tail", F.sum("n").over(Window.orderBy(F.desc("bin"))))
    up = up.withColumn("from", F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.lit(0).cast("long")))
    full = up.select(F.explode(F.sequence(F.least("from", "bin"), F.col("bin"))).alias("bin"), "tail")
    return full.crossJoin(F.broadcast(total)).select("bin", (F.col("tail") / F.col("total")).alias("p"))


def reduced_null(spark: SparkSession, hist: DataFrame, n_iters: int, step: float, additive: bool = False, seed: int = 0, dealt: bool = False) -> DataFrame:
    """(bin, p): each iteration takes the value of one random voxel of each analysis, by its histogram (id, bin, share), and combines them.

    A task gives one sum for each iteration (for unions of ln(1 - value)). Histograms that are
    ``dealt``, as those of ``kernels.kda_histograms``, are drawn from where they are made.
    """
    if not dealt:
        hist = hist.repartition("id").sortWithinPartitions("id", "bin")

    def draw(batches):
        total, some = np.zeros(n_iters), False
        for t, own in kernels.whole_analyses(batches):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            names, bins, share = t["id"].take(pa.array(first)).to_pylist(), t["bin"].to_numpy(), t["share"].to_numpy()
            for name, lo, hi in zip(names, first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
                upto = np.cumsum(share[lo:hi])
                rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
                at = bins[lo:hi][np.searchsorted(upto, rng.random(n_iters) * share[lo:hi].sum(), "right").clip(0, hi - lo - 1)] * step
                total += at if additive else np.log1p(-np.minimum(at, 1 - 1e-16))
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_iters)), pa.array(total)], ["iteration", "total"])

    sums = hist.select("id", "bin", "share").mapInArrow(draw, "iteration long, total double").groupBy("iteration").agg(F.sum("total").alias("total"))
    value = F.col("total") if additive else 1 - F.exp("total")
    return tail_of(sums.groupBy(F.round(value / step).cast("long").alias("bin")).agg(F.count("*").alias("n")))


# ---- permuted labels
def _draws(ids: np.ndarray, its: np.ndarray, seed: int) -> np.ndarray:
    """A 63-bit number for each id (hashed) and iteration."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] ^ (its.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


#: Counts of ranges that a task keeps, rather than give those of each thousand ids.
LABEL_COUNTS = 1 << 22


def label_cuts(ids: DataFrame, size: int, n_iters: int, seed: int = 0, member: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """For each iteration the number that ``size`` ids have at most, so that an id's label needs no order of all ids.

    ``ids`` may be hashes already, ``h``, each once. ``member`` (of hashed ids and iterations) limits an iteration to some ids. Ranges of the numbers are counted first, and only the range that holds the cut is ordered.
    """
    its, ranges = np.arange(n_iters), 1 << 12
    hashed = ids.select("h") if "h" in ids.columns else ids.select("id").distinct().select(F.xxhash64("id").alias("h"))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = n_iters * ranges <= LABEL_COUNTS
        total = np.zeros(n_iters * ranges if dense else 0, np.int64)
        for b in batches:
            for lo in range(0, len(b), 1000):
                h = b["h"].to_numpy()[lo : lo + 1000]
                x = its * ranges + (_draws(h, its, seed) >> np.uint64(51)).astype(np.int64)
                x = x.ravel() if member is None else x[member(h, its)]
                if dense:
                    np.add.at(total, x, 1)
                    continue
                found, n = np.unique(x, return_counts=True)
                yield pd.DataFrame({"it": found // ranges, "part": found % ranges, "n": n})
        found = np.flatnonzero(total)
        yield pd.DataFrame({"it": found // ranges, "part": found % ranges, "n": total[found]})

    spread = hashed.mapInPandas(counts, "it long, part long, n long").groupBy("it", "part").agg(F.sum("n").alias("n"))
    spread = spread.withColumn("upto", F.sum("n").over(Window.partitionBy("it").orderBy("part")))
    cut = {r["it"]: (r["part"], size - r["upto"] + r["n"]) for r in spread.where((F.col("upto") >= size) & (F.col("upto") - F.col("n") < size)).collect()}
    where = np.array([cut.get(i, (-1, 0))[0] for i in its])

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                h = b["h"].to_numpy()[lo : lo + 1000]
                x = _draws(h, its, seed)
                hit = (x >> np.uint64(51)).astype(np.int64) == where
                at, it = np.nonzero(hit if member is None else hit & member(h, its))
                yield pd.DataFrame({"it": it, "x": x[at, it].astype(np.int64)})

    own = hashed.mapInPandas(inside, "it long, x long").withColumn("r", F.row_number().over(Window.partitionBy("it").orderBy("x")))
    if not n_iters:
        return np.zeros(0, np.int64)
    need = ids.sparkSession.createDataFrame([(int(i), int(cut.get(i, (-1, 0))[1])) for i in its], "it long, need int")
    found = {r["it"]: r["x"] for r in own.join(F.broadcast(need), "it").where("r = need").select("it", "x").collect()}
    return np.array([found.get(i, -1) for i in its], np.int64)


def by_voxels(rows: DataFrame, task_rows: int = 1_000_000) -> DataFrame:
    """Rows with a ``block`` of voxels, of about ``task_rows`` rows each."""
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // task_rows))
    return rows.withColumn("block", F.pmod(F.xxhash64("voxel"), F.lit(blocks)))


def label_permutations(terms: DataFrame, group1: DataFrame, group2: DataFrame, n_iters: int, statistic, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(voxel, stat, ge, le, n) and (iteration, max_stat) when labels of two groups are permuted.

    ``terms`` has (id, voxel, term), what an analysis adds to its group's sum;
    ``statistic`` makes the statistic of two arrays of sums. A task computes an id's label from a hash of
    (id, iteration) and sums its own terms for each labelling, so neither labels nor permuted activations are rows;
    where the volumes of all labellings do not fit a task, blocks of voxels are the tasks. Terms with a
    column ``g`` (1 or 2) are of analyses of the groups only. Of absolute values, the largest of each iteration is returned.
    """
    from quillmap.operators import pairwise

    ids = group1.select("id", F.lit(1).alias("g")).unionByName(group2.select("id", F.lit(2).alias("g"))).distinct()
    own = terms if "g" in terms.columns else with_ids(terms, ids)
    sums = own.groupBy("voxel").agg(F.sum(F.abs("term")).alias("t")).toArrow()
    voxels = np.sort(sums["voxel"].to_numpy().astype(np.int64))
    size = int(voxels[-1]) + 1 if len(voxels) else 1
    if 8 * size * (n_iters + 1) > pairwise.TASK_BYTES:
        return _permuted_blocks(own, ids, group1, n_iters, statistic, seed)
    cuts = label_cuts(ids, group1.select("id").distinct().count(), n_iters, seed)
    # terms in steps of a power of two that makes every sum exact, so that equal sums are equal in any order
    most = max(np.array(sums["t"].to_numpy()).max(initial=0.0), 1e-300)
    step = 2.0 ** (np.ceil(np.log2(most)) - 51)
    rows = own.select(F.xxhash64("id").alias("h"), F.col("voxel").cast("long").alias("voxel"), (F.rint(F.col("term") / F.lit(float(step))) * F.lit(float(step))).alias("term"), F.col("g") == 1)
    volumes = pairwise.small_volumes(rows, lambda h, it: _draws(h, np.array([it]), seed)[:, 0].astype(np.int64) <= cuts[it], n_iters, size, labelled=True)
    return _from_volumes(volumes, voxels, n_iters, statistic)


def _from_volumes(volumes: DataFrame, voxels: np.ndarray | None, n_iters: int, statistic) -> tuple[DataFrame, DataFrame]:
    """What ``label_permutations`` gives from the volumes of all labellings, of the first group and of both; ``voxels`` are those above 0 in the last without a list."""
    from quillmap.operators.text import checkpointed

    spark = volumes.sparkSession
    volumes = checkpointed(volumes)
    if voxels is None:
        voxels = np.flatnonzero(sum(np.frombuffer(bytes(r["part"])) for r in volumes.where(F.col("iteration") == n_iters + 1).collect()))
    # volumes of all labellings fit a task, so one is no burden; the last two are of the observed groups and of all
    found = {r["iteration"]: np.frombuffer(bytes(r["part"]))[voxels] for r in volumes.where(F.col("iteration") >= n_iters).collect()}
    seen1, total = (found.get(n_iters + i, np.zeros(len(voxels))) for i in (0, 1))
    seen = statistic(seen1, total - seen1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ge, le = np.zeros(len(voxels), np.int64), np.zeros(len(voxels), np.int64)
        for b in batches:
            for it, raw in zip(b["iteration"], b["part"], strict=True):
                s1 = np.frombuffer(raw)[voxels]
                perm = statistic(s1, total - s1)
                ge += perm >= seen
                le += perm <= seen
                yield pd.DataFrame({"voxel": [-1], "ge": [0], "le": [0], "iteration": [int(it)], "max_stat": [float(np.abs(perm).max(initial=0.0))]})
        yield pd.DataFrame({"voxel": voxels, "ge": ge, "le": le, "iteration": -1, "max_stat": 0.0})

    both = checkpointed(volumes.where(F.col("iteration") < n_iters).mapInPandas(run, "voxel long, ge long, le long, iteration long, max_stat double"))
    counts = both.where("voxel >= 0").groupBy("voxel").agg(F.sum("ge").alias("ge"), F.sum("le").alias("le"))
    stats = spark.createDataFrame(pd.DataFrame({"voxel": voxels, "stat": seen}), "voxel long, stat double")
    return stats.join(counts, "voxel").select("voxel", "stat", "ge", "le", F.lit(n_iters).alias("n")), both.where("voxel < 0").select("iteration", "max_stat")


def _permuted_blocks(own: DataFrame, ids: DataFrame, group1: DataFrame, n_iters: int, statistic, seed: int) -> tuple[DataFrame, DataFrame]:
    """``label_permutations`` where the volumes of all labellings do not fit a task: terms are dealt by voxels."""
    cuts = label_cuts(ids, group1.select("id").distinct().count(), n_iters, seed)
    rows = by_voxels(own.select(F.xxhash64("id").alias("h"), "g", "voxel", "term"))

    def run(key, own):
        own = own.sort_values(["voxel", "h"])
        names, at = np.unique(own["h"].to_numpy(), return_inverse=True)
        voxels, first = np.unique(own["voxel"].to_numpy(), return_index=True)
        term, one = own["term"].to_numpy(), own["g"].to_numpy() == 1
        total = np.add.reduceat(term, first)
        seen1 = np.add.reduceat(np.where(one, term, 0.0), first)
        seen = statistic(seen1, total - seen1)
        ge, le = np.zeros(len(voxels), np.int64), np.zeros(len(voxels), np.int64)
        out = []
        for it in range(n_iters):
            label = _draws(names, np.array([it]), seed)[:, 0].astype(np.int64) <= cuts[it]
            s1 = np.add.reduceat(np.where(label[at], term, 0.0), first)
            perm = statistic(s1, total - s1)
            ge += perm >= seen
            le += perm <= seen
            out.append(float(np.abs(perm).max()))
        volume = pd.DataFrame({"voxel": voxels, "stat": seen, "ge": ge, "le": le, "iteration": -1, "max_stat": 0.0})
        maxima = pd.DataFrame({"voxel": -1, "stat": 0.0, "ge": 0, "le": 0, "iteration": np.arange(n_iters), "max_stat": out})
        return pd.concat([volume, maxima])

    both = rows.groupBy("block").applyInPandas(run, "voxel long, stat double, ge long, le long, iteration long, max_stat double")
    return both.where("voxel >= 0").select("voxel", "stat", "ge", "le", F.lit(n_iters).alias("n")), both.where("voxel < 0").groupBy("iteration").agg(F.max("max_stat").alias("max_stat"))


def two_sided(ge: Column, le: Column, n: Column) -> Column:
    """Twice the smaller tail, clipped to [1/n, 1 - 1/n]."""
    return F.greatest(1 / n, F.least(1 - 1 / n, 2 * F.least(ge, le) / n))


def _log_terms(ma: DataFrame, *more: str) -> DataFrame:
    return ma.select("id", "voxel", *more, F.log1p(-F.least("value", F.lit(1 - 1e-12))).alias("term"))


def apart(group1: DataFrame, group2: DataFrame) -> None:
    """Two groups that share an analysis are an error."""
    if not group1.select("id").join(group2.select("id"), "id", "left_semi").isEmpty():
        raise ValueError("the groups share analyses")


def ale_difference(ma: DataFrame, group1: DataFrame, group2: DataFrame, mask: DataFrame, n_iters: int = 100, seed: int = 0, within: DataFrame | None = None) -> DataFrame:
    """(voxel, stat, p, z): ALE of one group less that of the other, with p by permuted labels.

    ``within`` (voxel, sign) limits each direction to voxels of that sign, as a directional mask does.
    """
    apart(group1, group2)
    seen, _ = label_permutations(_log_terms(ma, *[c for c in ma.columns if c == "g"]), group1, group2, n_iters, lambda a, b: np.exp(b) - np.exp(a), seed)
    out = mask.select("voxel").join(seen, "voxel", "left").select("voxel", F.coalesce("stat", F.lit(0.0)).alias("stat"), F.coalesce(two_sided(F.col("ge"), F.col("le"), F.col("n")), F.lit(1.0)).alias("p"))
    if within is not None:
        out = out.join(within.select("voxel", "sign"), "voxel", "left")
        hit = F.col("sign") * F.col("stat") > 0
        out = out.select("voxel", F.when(hit, F.col("stat")).otherwise(0.0).alias("stat"), F.when(hit, F.col("p")).otherwise(1.0).alias("p"))
    return out.withColumn("z", F.signum("stat") * special.p_to_z_udf("p"))


def difference_maxima(ma: DataFrame, group1: DataFrame, group2: DataFrame, n_iters: int = 100, seed: int = 0) -> DataFrame:
    """(iteration, max_stat): the largest absolute difference of the groups' ALE under permuted labels."""
    apart(group1, group2)
    return label_permutations(_log_terms(ma, *[c for c in ma.columns if c == "g"]), group1, group2, n_iters, lambda a, b: np.exp(b) - np.exp(a), seed)[1]


def association(a: np.ndarray, b: np.ndarray, n1: float, n2: float) -> np.ndarray:
    """``two_way`` of arrays."""
    den = (a + b) * (n1 + n2 - a - b) * n1 * n2
    return np.where(den == 0, 2.0, (n1 + n2) * (a * n2 - b * n1) ** 2 / np.where(den == 0, 1.0, den))


def chi2_maxima_points(point: DataFrame, group1: DataFrame, group2: DataFrame, grid: Grid, r: float, n_iters: int = 100, seed: int = 0) -> DataFrame:
    """``chi2_maxima`` of spheres around points, for the groups' analyses that have a point: labels meet points by id, and volumes are summed where the points are."""
    from quillmap.operators import pairwise

    stamps = kernels.Stamps(grid, kernels.sphere(r, grid.metric))
    if 8 * stamps.size * (n_iters + 2) > pairwise.TASK_BYTES:
        one, two = (g.join(point, "id", "left_semi") for g in (group1, group2))
        return chi2_maxima(kernels.mkda(pairwise.grouped(point, one, two), grid, r, keep=["g"]), one, two, n_iters, seed)
    rows, ids = pairwise.group_ids(point, group1, group2, grid, stamps)
    n = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n2 = (n.get(g, 0) for g in (1, 2))
    cuts = label_cuts(ids, n1, n_iters, seed)
    volumes = pairwise.permuted_counts(rows, lambda h, it: _draws(h, np.array([it]), seed)[:, 0].astype(np.int64) <= cuts[it], n_iters, stamps)
    return _from_volumes(volumes, None, n_iters, lambda a, b: association(a, b, float(n1), float(n2)))[1]


def chi2_maxima(active: DataFrame, group1: DataFrame, group2: DataFrame, n_iters: int = 100, seed: int = 0) -> DataFrame:
    """(iteration, max_stat): the largest association chi-square under permuted labels."""
    apart(group1, group2)
    n1, n2 = (float(g.select("id").distinct().count()) for g in (group1, group2))
    chi2 = lambda a, b: association(a, b, n1, n2)
    return label_permutations(active.select("id", "voxel", *[c for c in active.columns if c == "g"], F.lit(1.0).alias("term")), group1, group2, n_iters, chi2, seed)[1]


def scale(ma: DataFrame, foci: DataFrame, pool: DataFrame, grid: Grid, mask: DataFrame, n_iters: int = 50, fwhm: float | None = None, seed: int = 0) -> DataFrame:
    """(voxel, stat, p, z): the union statistic against foci drawn from a pool of coordinates (i, j, k), each as often as it is listed.

    The pool is a user's table of coordinates; it must fit a task. ``ma`` has (id, voxel, value), or (voxel, stat) of the
    mask where the statistic is there already.
    """
    spark = ma.sparkSession
    if (n := pool.count()) > 20_000_000:
        raise ValueError(f"a pool of {n} coordinates does not fit a task")
    cells = pool.select(*[F.col(c).cast("long").alias(c) for c in "ijk"]).toArrow()
    cells = np.stack([cells[c].to_numpy() for c in "ijk"], 1)
    seen = ma if "stat" in ma.columns else ale_stat(ma, mask)
    sims = simulated(spark, foci, cells, grid, n_iters, "ale", fwhm=fwhm, seed=seed, least=NONE_LEFT)
    # the observed map has the grid's size
    own = np.zeros(int(np.prod(grid.shape)))
    for r in seen.where("stat > 0").toLocalIterator():
        own[r["voxel"]] = r["stat"]
    sent = spark.sparkContext.broadcast(own)

    def exceed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ge = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for raw in b["part"]:
                ge += -np.expm1(np.frombuffer(raw)) >= sent.value
        at = np.flatnonzero(ge)
        yield pd.DataFrame({"voxel": at, "ge": ge[at]})

    hits = sims.mapInPandas(exceed, "voxel long, ge long").groupBy("voxel").agg(F.sum("ge").alias("ge"))
    p = F.when(F.col("stat") <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0 / n_iters), F.least(F.lit(1 - 1.0 / n_iters), F.coalesce("ge", F.lit(0)) / n_iters)))
    return seen.join(hits, "voxel", "left").select("voxel", "stat", p.alias("p")).withColumn("z", special.p_to_z_udf("p"))


def balanced_difference(ma: DataFrame, group1: DataFrame, group2: DataFrame, mask: DataFrame, target: int, n_subsamples: int = 50, seed: int = 0) -> DataFrame:
    """(voxel, mean1, mean2, conjunction, difference): means over subsamples of ``target`` analyses of each group."""
    apart(group1, group2)
    ids = group1.select("id", F.lit(1).alias("g")).unionByName(group2.select("id", F.lit(2).alias("g"))).distinct()
    cuts = {1: label_cuts(group1, target, n_subsamples, seed), 2: label_cuts(group2, target, n_subsamples, seed)}
    cuts = {g: np.where(c < 0, np.iinfo(np.int64).max, c) for g, c in cuts.items()}
    rows = by_voxels(with_ids(_log_terms(ma), ids).select(F.xxhash64("id").alias("h"), "g", "voxel", "term"))

    def run(key, own):
        own = own.sort_values(["voxel", "h"])
        voxels, first = np.unique(own["voxel"].to_numpy(), return_index=True)
        term, g, h = (own[c].to_numpy() for c in ("term", "g", "h"))
        mean = {1: np.zeros(len(voxels)), 2: np.zeros(len(voxels))}
        names, at = np.unique(h, return_inverse=True)
        for it in range(n_subsamples):
            x = _draws(names, np.array([it]), seed)[:, 0].astype(np.int64)[at]
            for k in (1, 2):
                mean[k] -= np.expm1(np.add.reduceat(np.where((g == k) & (x <= cuts[k][it]), term, 0.0), first)) / n_subsamples
        return pd.DataFrame({"voxel": voxels, "mean1": mean[1], "mean2": mean[2]})

    found = rows.groupBy("block").applyInPandas(run, "voxel long, mean1 double, mean2 double")
    out = mask.select("voxel").join(found, "voxel", "left").fillna(0.0, ["mean1", "mean2"])
    return out.withColumn("conjunction", F.least("mean1", "mean2")).withColumn("difference", F.col("mean1") - F.col("mean2"))


def balanced_null(spark: SparkSession, foci1: DataFrame, foci2: DataFrame, grid: Grid, n_iters: int, fwhm: float | None = None, seed: int = 0) -> DataFrame:
    """(iteration, largest, least): extremes of the difference of two groups' ALE when all foci are random."""
    pool = np.argwhere(grid.mask_array())
    one, two = (simulated(spark, f, pool, grid, n_iters, "ale", fwhm=fwhm, seed=seed + n) for n, f in enumerate((foci1, foci2)))

    def extremes(key, a, b):
        value = lambda t: -np.expm1(np.frombuffer(t["part"].iloc[0])) if len(t) else 0.0
        d = value(a) - value(b)
        return pd.DataFrame({"iteration": [key[0]], "largest": [float(np.max(d))], "least": [float(np.min(d))]})

    return one.groupBy("iteration").cogroup(two.groupBy("iteration")).applyInPandas(extremes, "iteration long, largest double, least double")
