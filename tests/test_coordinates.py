"""Peaks of images and the modes of merging them with points."""

import numpy as np
import pytest

from quillmap.operators import coordinates, diagnostics
from quillmap.plans.studyset import Grid, Studyset

GRID = Grid(8, 8, 8, 2.0, -7.0, (0, 7))


def volumes(spark, n=4):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(i, v, float(x)) for i in range(n) for v, x in enumerate(rng.normal(0, 2, 512))], "id long, voxel long, value double")


def test_peaks_are_those_of_one_volume_at_a_time(spark):
    image = volumes(spark)
    got = coordinates.image_peaks(image, GRID, 2.0).collect()
    for i in range(4):
        want = diagnostics.peaks(image.where(f"id = {i}").select("voxel", "value"), GRID, 2.0, most=1 + coordinates.MOST).collect()
        assert {(r["cluster"], r["rank"], r["voxel"], r["value"]) for r in got if r["id"] == i} == {tuple(r) for r in want}
    only = coordinates.image_peaks(image, GRID, 2.0, subpeaks=False).collect()
    assert {tuple(r) for r in only} == {tuple(r) for r in got if r["rank"] == 1}
    both = coordinates.image_peaks(image, GRID, 2.0, two_sided=True).where("value < 0").collect()
    turned = coordinates.image_peaks(image.selectExpr("id", "voxel", "-value as value"), GRID, 2.0).collect()
    assert {(*r[:4], -r[4]) for r in both} == {tuple(r) for r in turned}
    large = coordinates.image_peaks(image, GRID, 2.0, least=4, subpeaks=False)
    assert 0 < large.count() < len(only)


def test_modes(spark):
    analysis = spark.createDataFrame([(i,) for i in range(5)], "id long")
    point = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (4, 2.0, 2.0, 2.0)], "id long, x double, y double, z double")
    ss = Studyset(analysis=analysis, point=point, grid=GRID)
    image = volumes(spark)
    made = {r["id"]: r["count"] for r in coordinates.image_peaks(image, GRID, 3.0).groupBy("id").count().collect()}
    counts = lambda s: {r["id"]: r["count"] for r in s.point.groupBy("id").count().collect()}
    source = lambda s: {r["id"] for r in s.analysis.where("coordinate_source = 'generated'").collect()}
    filled, replaced, demolished = (coordinates.images_to_coordinates(ss, image, GRID, m, 3.0) for m in coordinates.MODES)
    assert counts(filled) == {**made, 0: 1, 4: 1} and source(filled) == {1, 2, 3}
    assert counts(replaced) == {**made, 4: 1} and source(replaced) == {0, 1, 2, 3}
    assert counts(demolished) == made and source(demolished) == {0, 1, 2, 3}
    r = demolished.point.where("id = 1 and point_pos = 0").first()
    assert r["kind"] == "center of mass" and r["values"]["z_stat"] > 3 and all(-7 <= r[c] <= 7 for c in "xyz")
    none = coordinates.images_to_coordinates(ss, image, GRID, "replace", 99.0)
    assert counts(none) == {0: 1, 4: 1} and source(none) == set()
    with pytest.raises(ValueError, match="unknown mode"):
        coordinates.images_to_coordinates(ss, image, GRID, "mix")
