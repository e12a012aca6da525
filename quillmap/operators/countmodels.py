"""Over-dispersed and penalised regression of foci on splines, by Newton steps on sums that executors form.

The data are a table of voxels (voxel, y), the foci of all analyses, and a table of analyses (n, moderators).
Each step sends the coefficients, forms gradient and Hessian on blocks of voxels and of analyses, where the
rows of the spline basis are made from three one-dimensional ones, and adds the blocks as a tree; the driver gets one
matrix of as many rows as there are coefficients, and solves for the step.

With mu_j = exp(x_j beta) a voxel's rate and e_i = exp(z_i gamma) an analysis' factor:

negative binomial: a voxel's total has mean A mu_j, A = sum e_i, and size A**2 / (alpha B), B = sum e_i**2
(moments of a sum of negative binomials). Totals say nothing of gamma that alpha and beta don't, so gamma is the Poisson model's.

clustered negative binomial: an analysis' foci share a gamma-distributed factor of mean 1 and variance alpha.

Firth: the Poisson likelihood with half the log-determinant of beta's information added, so that estimates are finite
where no focus lies. The determinant's derivative is a sum over voxels too, of half their leverages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.operators.cbmr import spline_1d
from quillmap.plans.studyset import Grid

#: Voxels and analyses of a block, and sums that are added at once.
BLOCK_VOXELS, BLOCK_ANALYSES, ADD = 8192, 100_000, 8
#: The least ln alpha: below it the models are the Poisson model to all digits.
LEAST = -16.0


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of ln gamma at positive numbers: raised by recurrence, then an asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] += 1 / (x[low] * x[low])
        x[low] += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def ln_gamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= np.log(x[low])
        x[low] += 1
    f = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / x


def summed(table: DataFrame, parts: int, block: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of an array that ``block`` makes of a table's batches; ``parts`` is the table's number of partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                own = block(b)
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "raw": [total.tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "raw": [sum(np.frombuffer(x) for x in rows.sort_values("part")["raw"]).tobytes()]})

    kind = "part long, raw binary"
    out = table.mapInPandas(run, kind)
    while parts > 1:
        parts = -(-parts // ADD)
        out = out.groupBy(F.floor(F.col("part") / ADD).alias("into")).applyInPandas(add, kind)
    rows = out.collect()
    return np.frombuffer(rows[0]["raw"]) if rows else np.zeros(0)


@dataclass
class Splines:
    """Rows of a tensor product of splines for any voxels, of the columns that the mask supports."""

    grid: Grid
    spacing: int
    keep: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    def full(self, voxel: np.ndarray) -> np.ndarray:
        axes = [spline_1d(n, self.spacing) for n in self.grid.shape]
        i, j, k = np.unravel_index(voxel, self.grid.shape)
        return np.einsum("va,vb,vc->vabc", axes[0][i], axes[1][j], axes[2][k]).reshape(len(voxel), -1)

    def rows(self, voxel: np.ndarray) -> np.ndarray:
        return self.full(voxel)[:, self.keep]


@dataclass
class Data:
    voxels: DataFrame
    voxel_parts: int
    analyses: DataFrame
    analysis_parts: int
    splines: Splines
    columns: list[str]
    n_voxels: int
    n_analyses: int
    foci: float

    def over_voxels(self, block: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sums over blocks of (basis rows, counts)."""
        splines = self.splines

        def run(b: pd.DataFrame) -> np.ndarray:
            return block(splines.rows(b["voxel"].to_numpy()), b["y"].to_numpy(float))

        return summed(self.voxels, self.voxel_parts, run)

    def over_analyses(self, block: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sums over blocks of (moderators, foci)."""
        columns = self.columns

        def run(b: pd.DataFrame) -> np.ndarray:
            return block(b[columns].to_numpy(float).reshape(len(b), len(columns)), b["n"].to_numpy(float))

        return summed(self.analyses, self.analysis_parts, run)


def prepare(point: DataFrame, moderators: DataFrame, grid: Grid, columns: list[str] | None = None, spacing: int = 4) -> Data:
    """The two tables, kept, and the basis' columns. ``moderators`` has a row (id, columns) for each analysis."""
    from quillmap.operators.text import checkpointed

    columns = columns or []
    spark = point.sparkSession
    inside = point.where(grid.inside(F.col("i"), F.col("j"), F.col("k")) & grid.in_mask(F.col("i"), F.col("j"), F.col("k"))).withColumn("voxel", grid.flat(F.col("i"), F.col("j"), F.col("k")).cast("long"))
    counts = inside.groupBy("voxel").agg(F.count("*").alias("y"))
    mask = grid.mask(spark).select(F.col("voxel").cast("long").alias("voxel"))
    n_voxels = mask.count()
    voxel_parts = max(1, -(-n_voxels // BLOCK_VOXELS))
    voxels = checkpointed(mask.join(counts, "voxel", "left").fillna(0, ["y"]).repartition(voxel_parts, "voxel"))
    per = inside.groupBy("id").agg(F.count("*").alias("n"))
    n_analyses = moderators.count()
    analysis_parts = max(1, -(-n_analyses // BLOCK_ANALYSES))
    analyses = checkpointed(moderators.select("id", *columns).join(per, "id", "left").fillna(0, ["n"]).repartition(analysis_parts, "id"))
    splines = Splines(grid, spacing)
    support = summed(voxels, voxel_parts, lambda b: splines.full(b["voxel"].to_numpy()).sum(0))
    splines = Splines(grid, spacing, np.flatnonzero(support > 0.1))
    foci = float(voxels.agg(F.coalesce(F.sum("y"), F.lit(0))).first()[0])
    return Data(voxels, voxel_parts, analyses, analysis_parts, splines, columns, n_voxels, n_analyses, foci)


def triangle(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ((x * w[:, None]).T @ x).ravel()


def climb(value_at: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: np.ndarray, steps: int = 60, tolerance: float = 1e-9, last: float | None = None, gain: float = 1e-9) -> tuple[np.ndarray, float, np.ndarray]:
    """Newton's ascent: (point, value, negative Hessian). A step that doesn't climb, or overflows, is halved; a Hessian that is not definite is shifted until it is.

    ``last`` is the most that the last coordinate moves in a step; ``gain``, of the value, is what may be left to gain before the last step.
    """
    at = start
    value, gradient, curve = value_at(at)
    for _ in range(steps):
        low = np.linalg.eigvalsh(curve)[0]
        scale = np.abs(np.diag(curve)).max()
        shifted = curve + max(0.0, 1e-9 * scale - low) * 1.5 * np.eye(len(at)) if low < 1e-9 * scale else curve
        step = np.linalg.solve(shifted, gradient)
        size = 1.0 if last is None else min(1.0, last / max(abs(step[-1]), 1e-300))
        near = gradient @ step < gain * (1 + abs(value))  # twice what is left to gain: one more step squares the distance
        while True:
            with np.errstate(over="ignore", invalid="ignore"):
                found = value_at(at + size * step)
            if found[0] >= value - 1e-10 * abs(value) or size < 1e-4 or near:
                break
            size /= 2
        at, (value, gradient, curve) = at + size * step, found
        if near or np.abs(size * step).max() < tolerance * (1 + np.abs(at).max()):
            break
    return at, value, curve


def poisson_start(data: Data) -> tuple[np.ndarray, np.ndarray]:
    """Zero factors, and an even rate as the splines can give it."""
    k, q = len(data.splines.keep), len(data.columns)
    rate = np.log(max(data.foci, 1.0) / (data.n_voxels * max(data.n_analyses, 1)))
    flat = data.over_voxels(lambda x, y: np.concatenate([triangle(x, np.ones(len(x))), x.sum(0)]))
    gram = flat[: k * k].reshape(k, k)
    return np.linalg.solve(gram + 1e-8 * np.trace(gram) / k * np.eye(k), rate * flat[k * k :]), np.zeros(q)


def poisson(data: Data, ridge: float = 1e-3, firth: bool = False) -> dict[str, np.ndarray]:
    """Coefficients of the Poisson model, with Firth's penalty on beta if asked for.

    With the penalty the score has half of each voxel's leverage added to its count, and steps are Fisher's.
    """
    k, q = len(data.splines.keep), len(data.columns)

    def pieces(at: np.ndarray) -> tuple:
        beta, gamma = at[:k], at[k:]
        v = data.over_voxels(lambda x, y: np.concatenate([[np.exp(x @ beta).sum(), y @ (x @ beta)], x.T @ y, x.T @ np.exp(x @ beta), triangle(x, np.exp(x @ beta))]))
        a = data.over_analyses(lambda z, n: np.concatenate([[np.exp(z @ gamma).sum(), n @ (z @ gamma)], z.T @ n, z.T @ np.exp(z @ gamma), triangle(z, np.exp(z @ gamma))]))
        return v[0], v[1], v[2 : 2 + k], v[2 + k : 2 + 2 * k], v[2 + 2 * k :].reshape(k, k), a[0], a[1], a[2 : 2 + q], a[2 + q : 2 + 2 * q], a[2 + 2 * q :].reshape(q, q)

    def value_at(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        m, fit, xy, xm, xmx, e, mod, zn, ze, zez = pieces(at)
        beta = at[:k]
        gradient = np.concatenate([xy - e * xm - ridge * beta, zn - m * ze])
        cross = np.outer(xm, ze)
        curve = np.block([[e * xmx + ridge * np.eye(k), cross], [cross.T, m * zez]])
        value = fit + mod - m * e - 0.5 * ridge * beta @ beta
        if firth:
            information = e * xmx + ridge * np.eye(k)
            inverse = np.linalg.inv(information)
            half = data.over_voxels(lambda x, y: x.T @ (0.5 * e * np.exp(x @ beta) * np.einsum("vi,ij,vj->v", x, inverse, x)))
            gradient[:k] += half
            gradient[k:] += 0.5 * np.trace(inverse @ xmx) * ze
            value += 0.5 * np.linalg.slogdet(information)[1]
        return value, gradient, curve

    at, value, curve = climb(value_at, np.concatenate(poisson_start(data)), gain=1e-13 if firth else 1e-9)  # Fisher's steps close in linearly
    return {"beta": at[:k], "gamma": at[k:], "loglik": np.array(value), "information": curve, "covariance": np.linalg.inv(curve)}


def negative_binomial(data: Data, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """beta and alpha of the negative binomial model of voxels' totals; gamma is the Poisson model's."""
    k = len(data.splines.keep)
    start = poisson(data, ridge)
    gamma = start["gamma"]
    a, b = data.over_analyses(lambda z, n: np.array([np.exp(z @ gamma).sum(), np.exp(2 * z @ gamma).sum()]))

    def value_at(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        beta, r = at[:k], a * a / (np.exp(max(at[k], LEAST)) * b)

        def block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            m = a * np.exp(x @ beta)
            t = r + m
            size = np.full(len(y), r)
            ell = ln_gamma(y + r) - ln_gamma(size) - ln_gamma(y + 1) + r * np.log(r / t) + y * np.log(m / t)
            of_r = digamma(y + r) - digamma(size) + np.log(r / t) + 1 - (r + y) / t
            of_rr = trigamma(y + r) - trigamma(size) + 1 / r - 1 / t - (m - y) / (t * t)
            return np.concatenate([[ell.sum(), of_r.sum(), of_rr.sum()], x.T @ (y - (y + r) * m / t), x.T @ (m * (y - m) / (t * t)), triangle(x, (y + r) * m * r / (t * t))])

        s = data.over_voxels(block)
        of_r, of_rr, of_beta, cross, curve = s[1], s[2], s[3 : 3 + k], s[3 + k : 3 + 2 * k], s[3 + 2 * k :].reshape(k, k)
        # r falls by r for each unit of ln alpha
        gradient = np.concatenate([of_beta - ridge * beta, [-r * of_r]])
        second = r * r * of_rr + r * of_r
        full = np.block([[curve + ridge * np.eye(k), (r * cross)[:, None]], [(r * cross)[None], np.array([[-second]])]])
        return float(s[0] - 0.5 * ridge * beta @ beta), gradient, full

    at, value, curve = climb(value_at, np.concatenate([start["beta"], [np.log(0.1)]]), last=2.0)
    return {"beta": at[:k], "gamma": gamma, "alpha": np.exp(at[k]), "loglik": np.array(value), "information": curve, "covariance": np.linalg.inv(curve)}


def clustered_negative_binomial(data: Data, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """beta, gamma and alpha when the foci of an analysis share a random factor."""
    k, q = len(data.splines.keep), len(data.columns)
    start = poisson(data, ridge)

    def value_at(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        beta, gamma, v = at[:k], at[k : k + q], float(np.exp(-max(at[k + q], LEAST)))
        s = data.over_voxels(lambda x, y: np.concatenate([[np.exp(x @ beta).sum(), y @ (x @ beta)], x.T @ y, x.T @ np.exp(x @ beta), triangle(x, np.exp(x @ beta))]))
        m, fit, xy, xm, xmx = s[0], s[1], s[2 : 2 + k], s[2 + k : 2 + 2 * k], s[2 + 2 * k :].reshape(k, k)

        def block(z: np.ndarray, n: np.ndarray) -> np.ndarray:
            e = np.exp(z @ gamma)
            t = m * e + v
            one = np.full(len(n), v)
            ell = v * np.log(v) - ln_gamma(one) + ln_gamma(n + v) - (n + v) * np.log(t) + n * (z @ gamma)
            of_v = np.log(v) + 1 - digamma(one) + digamma(n + v) - np.log(t) - (n + v) / t
            of_vv = 1 / v - trigamma(one) + trigamma(n + v) - 1 / t - (m * e - n) / (t * t)
            gap = (m * e - n) / (t * t)
            sums = [ell.sum(), of_v.sum(), of_vv.sum(), ((n + v) * e / t).sum(), ((n + v) * e * e / (t * t)).sum(), (e * gap).sum()]
            return np.concatenate([sums, z.T @ (n - (n + v) * m * e / t), z.T @ ((n + v) * v * e / (t * t)), z.T @ (m * e * gap), triangle(z, (n + v) * m * e * v / (t * t))])

        a = data.over_analyses(block)
        ell, of_v, of_vv, d, dd, by_v = a[:6]
        of_gamma, mixed, gamma_v, zz = a[6 : 6 + q], a[6 + q : 6 + 2 * q], a[6 + 2 * q : 6 + 3 * q], a[6 + 3 * q :].reshape(q, q)
        gradient = np.concatenate([xy - d * xm - ridge * beta, of_gamma, [-v * of_v]])
        beta_v, gamma_v = xm * by_v, gamma_v  # of the negative Hessian; v falls by v for each unit of ln alpha
        full = np.zeros((k + q + 1, k + q + 1))
        full[:k, :k] = d * xmx - dd * np.outer(xm, xm) + ridge * np.eye(k)
        full[:k, k : k + q] = np.outer(xm, mixed)
        full[k : k + q, k : k + q] = zz
        full[:k, -1] = -v * beta_v
        full[k : k + q, -1] = -v * gamma_v
        full[-1, -1] = -(v * v * of_vv + v * of_v)
        full = np.triu(full) + np.triu(full, 1).T
        return float(fit + ell - 0.5 * ridge * beta @ beta), gradient, full

    at, value, curve = climb(value_at, np.concatenate([start["beta"], start["gamma"], [np.log(0.1)]]), last=2.0)
    return {"beta": at[:k], "gamma": at[k : k + q], "alpha": np.exp(at[k + q]), "loglik": np.array(value), "information": curve, "covariance": np.linalg.inv(curve)}


MODELS = {"poisson": poisson, "negative_binomial": negative_binomial, "clustered_negative_binomial": clustered_negative_binomial, "firth": lambda data, ridge=0.0: poisson(data, ridge, firth=True)}


def intensity(data: Data, model: dict[str, np.ndarray]) -> DataFrame:
    """(voxel, y, intensity, se): a voxel's rate for an analysis without moderators, and the standard error of its log."""
    splines, beta = data.splines, model["beta"]
    cov = model["covariance"][: len(beta), : len(beta)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = splines.rows(b["voxel"].to_numpy())
            yield pd.DataFrame({"voxel": b["voxel"], "y": b["y"], "intensity": np.exp(x @ beta), "se": np.sqrt(np.maximum(np.einsum("vi,ij,vj->v", x, cov, x), 0.0))})

    return data.voxels.mapInPandas(run, "voxel long, y long, intensity double, se double")
