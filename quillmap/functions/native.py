"""Scalar functions that are plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of the published affine from MNI to Talairach space, as for any package (fixed values).
MNI_TO_TAL = (
    (0.9357, 0.0029, -0.0072, -1.0423),
    (-0.0065, 0.9396, -0.0726, -1.3940),
    (0.0103, 0.0752, 0.8967, 3.6475),
)


def mni_to_tal(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(a * x + b * y + c * z + d for a, b, c, d in MNI_TO_TAL)


def tal_to_mni(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    import numpy as np

    inverse = np.linalg.inv(np.array([*MNI_TO_TAL, (0.0, 0.0, 0.0, 1.0)]))
    return tuple(float(a) * x + float(b) * y + float(c) * z + float(d) for a, b, c, d in inverse[:3])


def t_to_d(t: Column, n: Column) -> Column:
    return t / F.sqrt(n)


def d_to_g(d: Column, n: Column) -> tuple[Column, Column]:
    """Hedges' g and its variance."""
    h = 1 - 3 / (4 * (n - 1) - 1)
    return d * h, F.try_divide((n - 1) * (1 + n * d * d) * h * h, n * (n - 3)) - d * d


def sd_to_varcope(sd: Column, n: Column) -> Column:
    return sd * sd / n


def samplevar_to_varcope(v: Column, n: Column) -> Column:
    return v / n


def se_to_varcope(se: Column) -> Column:
    return se * se


def t_and_beta_to_varcope(t: Column, beta: Column) -> Column:
    return F.try_divide(beta * beta, t * t)


def t_and_varcope_to_beta(t: Column, varcope: Column) -> Column:
    return t * F.sqrt(varcope)


def sizes_to_dof(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) - F.size(sizes)


def sizes_to_n(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def clip_p(p: Column) -> Column:
    """Between the smallest single-precision number and 1; NaN becomes null first."""
    return F.greatest(F.lit(1.401298464324817e-45), F.least(F.lit(1.0), F.nanvl(p, F.lit(None).cast("double"))))


def round_half_away(x: Column) -> Column:
    return F.round(x)


def image_type(name: Column) -> Column:
    """Trimmed and lower-cased without a final " map"; variance is varcope; others than the known ones are null."""
    t = F.regexp_replace(F.lower(F.trim(name)), " map$", "")
    t = F.when(t == "variance", "varcope").otherwise(t)
    return F.when(t.isin("z", "t", "p", "beta", "varcope", "se", "d", "g"), t)


def sample_size(analysis_value: Column, study_value: Column) -> Column:
    """A list of numbers, else one number as a list, else null; the analysis goes before the study."""

    def coerce(v: Column) -> Column:
        listed = F.from_json(v, "array<double>")
        single = v.try_cast("double")
        return F.coalesce(F.when(F.size(listed) > 0, listed), F.when(single > 0, F.array(single)))

    return F.coalesce(coerce(analysis_value), coerce(study_value))


def group_name(*parts: Column) -> Column:
    """Each part capitalised, all joined."""
    return F.concat(*[F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))) for p in parts])
