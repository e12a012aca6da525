"""Coordinate-based meta-regression: a spatial Poisson model on cubic B-splines, by Newton steps on sufficient sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.plans.studyset import Grid


def spline_1d(n: int, spacing: int) -> np.ndarray:
    """Cubic B-splines with knots every ``spacing`` voxels, a margin of one beyond each end; weak columns (sum below 0.1) dropped."""
    knots = np.arange(-4 * spacing, n + 4 * spacing + 1, spacing, dtype=float)
    x = np.arange(n, dtype=float)
    basis = [((x >= a) & (x < b)).astype(float) for a, b in zip(knots[:-1], knots[1:], strict=True)]
    for degree in (1, 2, 3):
        basis = [(x - knots[i]) / (knots[i + degree] - knots[i]) * basis[i] + (knots[i + degree + 1] - x) / (knots[i + degree + 1] - knots[i + 1]) * basis[i + 1] for i in range(len(basis) - 1)]
    out = np.stack(basis, 1)
    return out[:, out.sum(0) > 0.1]


def spline_basis(grid: Grid, spacing: int, mask_voxels: np.ndarray) -> np.ndarray:
    """Tensor product over the axes, rows of the mask's voxels."""
    b = [spline_1d(n, spacing) for n in (grid.nx, grid.ny, grid.nz)]
    i, j, k = np.unravel_index(mask_voxels, (grid.nx, grid.ny, grid.nz))
    full = np.einsum("va,vb,vc->vabc", b[0][i], b[1][j], b[2][k]).reshape(len(mask_voxels), -1)
    return full[:, full.sum(0) > 0.1]


def sums(point: DataFrame, moderators: DataFrame, grid: Grid, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mask voxels, foci at each, each design row of moderators with its number of analyses and foci.

    Foci are counted on the executors; what comes back is one number for each
    voxel and one row for each distinct combination of moderators.
    """
    mask = np.sort(np.array([r[0] for r in grid.mask(point.sparkSession).select("voxel").collect()]))
    inside = point.where(grid.in_mask(F.col("i"), F.col("j"), F.col("k"))).withColumn("voxel", grid.flat(F.col("i"), F.col("j"), F.col("k")))
    counts = {r["voxel"]: r["n"] for r in inside.groupBy("voxel").agg(F.count("*").alias("n")).collect()}
    per = inside.groupBy("id").agg(F.count("*").alias("n"))
    rows = moderators.join(per, "id", "left").groupBy(*columns).agg(F.count("*").alias("m"), F.sum(F.coalesce("n", F.lit(0))).alias("n")).collect() if columns else []
    z = np.array([[float(r[c]) for c in columns] for r in rows]).reshape(len(rows), len(columns))
    m, n = np.array([r["m"] for r in rows], float), np.array([r["n"] for r in rows], float)
    return mask, np.array([counts.get(v, 0) for v in mask], float), z, m, n


def fit(point: DataFrame, moderators: DataFrame, grid: Grid, columns: list[str] | None = None, spacing: int = 4, ridge: float = 1e-3, steps: int = 60) -> dict[str, np.ndarray]:
    """Coefficients and covariance of ln rate(voxel, analysis) = X beta + Z gamma.

    The log-likelihood is y.X beta + sum n Z gamma - sum exp(X beta) x sum m exp(Z gamma).
    """
    columns = columns or []
    mask, y, z, m, n = sums(point, moderators, grid, columns)
    if not columns:
        total = float(moderators.count())
        z, m, n = np.zeros((1, 0)), np.array([total]), np.array([y.sum()])
    x = spline_basis(grid, spacing, mask)
    start = np.log(max(y.sum(), 1.0) / (len(mask) * max(m.sum(), 1.0)))
    beta = np.linalg.lstsq(x, np.full(len(mask), start), rcond=None)[0]
    gamma = np.zeros(z.shape[1])

    def value(b, g):
        return y @ (x @ b) + n @ (z @ g) - np.exp(x @ b).sum() * (m * np.exp(z @ g)).sum() - 0.5 * ridge * (b @ b)

    for _ in range(steps):
        mu, nu = np.exp(x @ beta), m * np.exp(z @ gamma)
        gb = x.T @ y - x.T @ mu * nu.sum() - ridge * beta
        gg = z.T @ n - z.T @ nu * mu.sum()
        hbb = (x * mu[:, None]).T @ x * nu.sum() + ridge * np.eye(len(beta))
        hgg = (z * nu[:, None]).T @ z * mu.sum()
        hbg = np.outer(x.T @ mu, z.T @ nu)
        h = np.block([[hbb, hbg], [hbg.T, hgg]])
        step = np.linalg.solve(h + 1e-9 * np.eye(len(h)), np.concatenate([gb, gg]))
        size, now = 1.0, value(beta, gamma)
        while size > 1e-6 and not value(beta + size * step[: len(beta)], gamma + size * step[len(beta) :]) >= now - 1e-12:
            size /= 2
        beta, gamma = beta + size * step[: len(beta)], gamma + size * step[len(beta) :]
        if np.abs(size * step).max() < 1e-9:
            break
    return {"mask": mask, "x": x, "beta": beta, "gamma": gamma, "covariance": np.linalg.inv(h), "intensity": np.exp(x @ beta), "loglik": np.array(value(beta, gamma))}


def contrast_matrix(text: str, groups: list[str]) -> np.ndarray:
    """``A``, ``A-B`` or ``A+B`` as a row over groups, scaled by the sum of its absolute values."""
    row, sign, name = np.zeros(len(groups)), 1.0, ""
    for ch in f"{text}+":
        if ch in "+-":
            if name.strip():
                row[groups.index(name.strip())] += sign
            sign, name = (1.0 if ch == "+" else -1.0), ""
        else:
            name += ch
    return row / np.abs(row).sum()


def compare_groups(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Wald z of the difference of two groups' log intensities at each voxel."""
    k = len(a["beta"])
    va = np.einsum("vi,ij,vj->v", a["x"], a["covariance"][:k, :k], a["x"])
    vb = np.einsum("vi,ij,vj->v", b["x"], b["covariance"][:k, :k], b["x"])
    return (a["x"] @ a["beta"] - b["x"] @ b["beta"]) / np.sqrt(va + vb)


def moderator_z(model: dict[str, np.ndarray]) -> np.ndarray:
    k = len(model["beta"])
    return model["gamma"] / np.sqrt(np.diag(model["covariance"])[k:])


def contrast_rows(rows: np.ndarray) -> np.ndarray:
    """Contrast rows scaled by the sum of their absolute values, without zero or repeated rows."""
    rows = np.atleast_2d(np.asarray(rows, float))
    size = np.abs(rows).sum(1)
    rows = rows[size > 0] / size[size > 0, None]
    if not len(rows):
        raise ValueError("all rows of the contrast are zero")
    return rows[np.sort(np.unique(rows, axis=0, return_index=True)[1])]


def general_linear(model: dict[str, np.ndarray], rows: np.ndarray) -> tuple[float, int, float]:
    """Chi-square, its degrees of freedom and ln p that all contrasts of moderators are 0."""
    from quillmap.functions import special

    c, k = contrast_rows(rows), len(model["beta"])
    value = c @ model["gamma"]
    chi2 = float(value @ np.linalg.pinv(c @ model["covariance"][k:, k:] @ c.T) @ value)
    dof = int(np.linalg.matrix_rank(c))
    return chi2, dof, float(special.chi2_to_nlogp(np.array([chi2]), dof)[0])


def group_contrast(models: list[dict[str, np.ndarray]], rows: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """For each voxel the chi-square that all contrasts of groups' log intensities are 0, its degrees of freedom and ln p.

    A row with one entry that is not 0 tests that group against an even spread of its foci.
    """
    from quillmap.functions import special

    c = contrast_rows(rows)
    logs = np.stack([m["x"] @ m["beta"] for m in models])
    var = np.stack([np.einsum("vi,ij,vj->v", m["x"], m["covariance"][: len(m["beta"]), : len(m["beta"])], m["x"]) for m in models])
    if (np.count_nonzero(c, axis=1) == 1).all():
        logs = logs - np.log(np.exp(logs).mean(1, keepdims=True))
    value = c @ logs
    spread = np.einsum("ra,av,sa->vrs", c, var, c)
    chi2 = np.einsum("rv,vrs,sv->v", value, np.linalg.pinv(spread), value)
    dof = int(np.linalg.matrix_rank(c))
    return chi2, dof, special.chi2_to_nlogp(chi2, dof)
