"""A studyset: long tables of studies' analyses, points, images, annotations and texts, with a grid.

Every edit gives a new studyset of lazily planned DataFrames; nothing is
materialised until a result is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A volume of nx x ny x nz voxels, with a size and an offset (in mm) for all axes or for each, or with any affine.

    ``with_affine`` gives rotated and sheared grids; size and origin are then those of its columns.
    Its mask is a range of planes k, or any set of voxels (``with_mask``) kept as bits in
    numbers of 64, so that testing a voxel is an expression and needs no join.
    """

    nx: int
    ny: int
    nz: int
    size: float | tuple[float, float, float] = 2.0
    origin: float | tuple[float, float, float] = 0.0
    k_mask: tuple[int, int] = (1, 7)
    bits: tuple[int, ...] | None = None
    affine: tuple[float, ...] | None = None

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    @property
    def sizes(self) -> tuple[float, float, float]:
        return self.size if isinstance(self.size, tuple) else (self.size,) * 3

    @property
    def origins(self) -> tuple[float, float, float]:
        return self.origin if isinstance(self.origin, tuple) else (self.origin,) * 3

    @property
    def matrix(self) -> np.ndarray:
        """Voxels to millimetres, 3 x 4."""
        if self.affine is not None:
            return np.array(self.affine, float).reshape(3, 4)
        return np.c_[np.diag(self.sizes), self.origins].astype(float)

    @property
    def metric(self) -> float | tuple[float, float, float] | np.ndarray:
        """What distances between voxels take: sizes, or 3 x 3 where the axes are not at right angles."""
        if self.affine is None:
            return self.size
        m = self.matrix[:, :3]
        gram = m.T @ m
        return self.sizes if np.allclose(gram, np.diag(np.diag(gram)), atol=1e-9 * gram.max()) else m

    def with_affine(self, affine: np.ndarray) -> Grid:
        """The grid with an affine of 3 x 4 (or 4 x 4); one without an inverse is an error."""
        m = np.asarray(affine, float)[:3, :4]
        if abs(np.linalg.det(m[:, :3])) < 1e-12:
            raise ValueError("an affine without an inverse")
        return replace(self, size=tuple(np.sqrt((m[:, :3] ** 2).sum(0)).tolist()), origin=tuple(m[:, 3].tolist()), affine=tuple(m.ravel().tolist()))

    def with_mask(self, on: np.ndarray) -> Grid:
        """The grid with the mask of a boolean volume."""
        flat = np.zeros(-(-on.size // 64) * 64, np.uint8)
        flat[: on.size] = on.ravel()
        return replace(self, bits=tuple(np.packbits(flat, bitorder="little").view(np.int64).tolist()))

    @classmethod
    def of(cls, fields: dict) -> Grid:
        """The grid of a manifest, whose lists were tuples."""
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})

    def mask_array(self) -> np.ndarray:
        """The mask as a boolean volume."""
        if self.bits is not None:
            return np.unpackbits(np.array(self.bits, np.int64).view(np.uint8), bitorder="little")[: self.nx * self.ny * self.nz].astype(bool).reshape(self.shape)
        on = np.zeros(self.shape, bool)
        on[:, :, self.k_mask[0] : self.k_mask[1] + 1] = True
        return on

    def to_voxel(self, mm: Column, axis: int | str = 0) -> Column:
        """Millimetres to voxels, cut off towards zero; one axis of a grid without rotation."""
        self._straight()
        a = "xyz".index(axis) if isinstance(axis, str) else axis
        return ((mm - self.origins[a]) / self.sizes[a]).cast("int")

    def to_mm(self, voxel: Column, axis: int | str = 0) -> Column:
        self._straight()
        a = "xyz".index(axis) if isinstance(axis, str) else axis
        return voxel * self.sizes[a] + self.origins[a]

    def _straight(self) -> None:
        if self.affine is not None:
            raise ValueError("a rotated grid has no axis by itself: use voxels or places")

    def voxels(self, x: Column, y: Column, z: Column) -> list[Column]:
        """Millimetres to voxels (i, j, k), cut off towards zero. A rotated grid first takes places within 1e-9 of a voxel for it."""
        if self.affine is None:
            return [self.to_voxel(c, a) for a, c in enumerate((x, y, z))]
        back, moved = np.linalg.inv(self.matrix[:, :3]), [c - o for c, o in zip((x, y, z), self.origins, strict=True)]
        return [F.round(sum(float(w) * c for w, c in zip(row, moved, strict=True)), 9).cast("int") for row in back]

    def places(self, i: Column, j: Column, k: Column) -> list[Column]:
        """Voxels to millimetres (x, y, z)."""
        if self.affine is None:
            return [self.to_mm(c, a) for a, c in enumerate((i, j, k))]
        return [sum(float(w) * c for w, c in zip(row, (i, j, k), strict=False)) + float(row[3]) for row in self.matrix]

    def flat(self, i: Column, j: Column, k: Column) -> Column:
        return i * (self.ny * self.nz) + j * self.nz + k

    def inside(self, i: Column, j: Column, k: Column) -> Column:
        return i.between(0, self.nx - 1) & j.between(0, self.ny - 1) & k.between(0, self.nz - 1)

    def in_mask(self, i: Column, j: Column, k: Column) -> Column:
        """Whether a voxel is in the mask; one outside the volume is not."""
        if self.bits is None:
            return k.between(*self.k_mask)
        table = F.expr(f"array({','.join(f'{x}L' for x in self.bits)})")  # of literals, so Spark makes one of it
        voxel = self.flat(i, j, k).cast("long")
        word = F.get(table, F.call_function("div", voxel, F.lit(64)).cast("int"))
        return self.inside(i, j, k) & F.coalesce(F.call_function("getbit", word, (voxel % 64).cast("int")) == 1, F.lit(False))

    def mask(self, spark: SparkSession) -> DataFrame:
        """(i, j, k, voxel) of the mask, generated on the executors."""
        v = spark.range(self.nx * self.ny * self.nz).select(F.col("id").alias("voxel"))
        v = v.select(F.floor(F.col("voxel") / (self.ny * self.nz)).alias("i"), (F.floor(F.col("voxel") / self.nz) % self.ny).alias("j"), (F.col("voxel") % self.nz).alias("k"), "voxel")
        return v.where(self.in_mask(F.col("i"), F.col("j"), F.col("k")))


@dataclass(frozen=True)
class Studyset:
    analysis: DataFrame
    point: DataFrame | None = None
    annotation: DataFrame | None = None
    image: DataFrame | None = None
    text: DataFrame | None = None
    grid: Grid | None = None
    space: str = "MNI"
    study: DataFrame | None = None

    def select(self, ids: DataFrame) -> Studyset:
        """Only the analyses of ``ids`` and their children."""
        return self._each(lambda t: t.join(ids.select("id").distinct(), "id", "left_semi"))

    def drop(self, ids: DataFrame) -> Studyset:
        return self._each(lambda t: t.join(ids.select("id").distinct(), "id", "left_anti"))

    def _each(self, f) -> Studyset:
        return replace(self, **{n: f(t) for n in ("analysis", "point", "annotation", "image", "text") if (t := getattr(self, n)) is not None})

    def with_(self, **tables) -> Studyset:
        return replace(self, **tables)

    def keep(self, table: str, condition: Column) -> Studyset:
        """Only the rows of a child table (point, image, annotation, text) that satisfy a condition; analyses stay."""
        return replace(self, **{table: getattr(self, table).where(condition)})

    def add_annotations(self, rows: DataFrame, annotation_id: str | None = None, dense: bool = False) -> Studyset:
        """Add values (id, label, value), or with ``dense`` a table of id and one column for each label, whose zeros are not kept."""
        if dense:
            labels = [c for c in rows.columns if c != "id"]
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").cast("double").alias("value")) for c in labels])).alias("v")
            rows = rows.select("id", pairs).select("id", "v.*").where("value <> 0")
        if annotation_id is not None:
            rows = rows.withColumn("annotation_id", F.lit(annotation_id))
        return replace(self, annotation=rows if self.annotation is None else self.annotation.unionByName(rows, allowMissingColumns=True))

    def add_metadata(self, name: str, rows: DataFrame) -> Studyset:
        """Add or replace a field of the analyses by (id, value); analyses without one get null."""
        return replace(self, analysis=self.analysis.drop(name).join(rows.select("id", F.col("value").alias(name)), "id", "left"))

    def field(self, name: str) -> DataFrame:
        """(id, field) of the analyses; an unknown field is an error."""
        if name not in self.analysis.columns:
            raise ValueError(f"unknown field: {name}")
        return self.analysis.select("id", name)

    def labels(self, group: str | None = None) -> DataFrame:
        """The labels there are, of one group (a prefix) or all."""
        rows = self.annotation if group is None else self.annotation.where(F.col("label").startswith(f"{group}__"))
        return rows.select("label").distinct()

    def texts(self, field: str) -> DataFrame:
        """(id, text) of one field; a field that no analysis has is an error."""
        rows = self.text.where(F.col("field") == field).select("id", "text")
        if rows.isEmpty():
            raise ValueError(f"unknown text: {field}")
        return rows

    def images(self, kind: str) -> DataFrame:
        """Images of one type; a type that no analysis has is an error."""
        rows = self.image.where(F.col("value_type") == kind)
        if rows.isEmpty():
            raise ValueError(f"unknown image type: {kind}")
        return rows

    def in_order(self) -> Studyset:
        """Rows in canonical order (study, analysis, place), for sinks."""
        study = self.analysis.select("id", F.col("study_id").alias("_study_"))
        def one(t: DataFrame) -> DataFrame:
            place = [c for c in ("point_pos", "image_pos", "label", "field") if c in t.columns]
            return t.join(study, "id", "left").orderBy("_study_", "id", *place).drop("_study_")
        return self._each(one)

    def check(self) -> dict[str, int]:
        """Broken invariants: repeated analyses, and children without one."""
        out = {"repeated": self.analysis.groupBy("id").count().where("count > 1").count()}
        for n in ("point", "annotation", "image"):
            if (t := getattr(self, n)) is not None:
                out[f"orphan_{n}"] = t.join(self.analysis, "id", "left_anti").count()
        return out

    def require(self, *validities: DataFrame, drop_invalid: bool = True) -> Studyset:
        """Narrow to the ids valid in every requirement; none at all, or partly none without ``drop_invalid``, is an error."""
        ids = self.analysis.select("id")
        for v in validities:
            if v.isEmpty():
                raise ValueError("a requirement has no valid analysis")
            ids = ids.join(v.select("id").distinct(), "id", "left_semi")
        if not drop_invalid and not self.analysis.join(ids, "id", "left_anti").isEmpty():
            raise ValueError("some analyses do not satisfy all requirements")
        return self.select(ids)
