"""Files of volumes: round trips, headers of all kinds, resampling against plain code, and what is not a volume."""

import gzip
import struct

import numpy as np
import pytest

from quillmap.operators import coordinates, diagnostics, kernels, selection
from quillmap.plans.studyset import Grid, Studyset
from quillmap.sources import tables, volumes

RNG = np.random.default_rng(11)
GRID = Grid(5, 4, 6, 2.0, -4.0, (1, 4))
TURNED = np.array([[1.5, -0.75, 0.25, -3.5], [0.75, 1.5, 0.0, -4.0], [-0.125, 0.25, 2.0, -4.5]])


def header(shape, code, bits, end="<", pixdim=(1, 2, 3, 4), codes=(0, 0), quatern=(0, 0, 0), offset=(0, 0, 0), srow=(0,) * 12, scl=(0, 0), start=352):
    head = bytearray(start)
    struct.pack_into(f"{end}i", head, 0, 348)
    struct.pack_into(f"{end}8h", head, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into(f"{end}2h", head, 70, code, bits)
    struct.pack_into(f"{end}4f", head, 76, *pixdim)
    struct.pack_into(f"{end}3f", head, 108, start, *scl)
    struct.pack_into(f"{end}2h18f", head, 252, *codes, *quatern, *offset, *srow)
    head[344:348] = b"n+1\0"
    return bytes(head)


@pytest.mark.parametrize("end", "<>")
@pytest.mark.parametrize(("code", "kind"), volumes.TYPES.items())
def test_types_and_byte_orders(code, kind, end):
    values = RNG.integers(0, 100, (4, 3, 2)).astype(end + kind)
    raw = header((4, 3, 2), code, 8 * values.itemsize, end, scl=(0.5, 3), start=400) + values.tobytes(order="F")
    for content in (raw, gzip.compress(raw)):
        got, affine = volumes.decode(content)
        assert got.shape == (1, 4, 3, 2) and np.array_equal(got[0], values * 0.5 + 3.0)
        assert np.array_equal(affine, np.c_[np.diag([2, 3, 4]), np.zeros(3)])


def test_affines():
    values = np.zeros(24, "f4").tobytes()
    rows = volumes.decode(header((4, 3, 2), 16, 32, codes=(1, 1), srow=TURNED.ravel()) + values)[1]
    assert np.array_equal(rows, TURNED)
    half = np.sqrt(0.5)  # a quarter turn about the third axis, whose direction is turned too
    turn = volumes.decode(header((4, 3, 2), 16, 32, pixdim=(-1, 2, 3, 4), codes=(1, 0), quatern=(0, 0, half), offset=(5, 6, 7)) + values)[1]
    assert np.allclose(turn, [[0, -3, 0, 5], [2, 0, 0, 6], [0, 0, -4, 7]], atol=1e-6)


def test_what_is_not_a_volume():
    good = header((4, 3, 2), 16, 32) + np.zeros(24, "f4").tobytes()
    for bad in (b"", b"text", good[:-1], gzip.compress(good)[:-9], gzip.compress(good)[:20], header((4, 3, 2), 128, 24) + bytes(72), header((4, 0, 2), 16, 32), good[:344] + b"ni1\0" + good[348:]):
        with pytest.raises(ValueError):
            volumes.decode(bad)


def plain(volume, affine, grid):
    """Trilinear values voxel by voxel."""
    out = []
    for i, j, k in np.argwhere(grid.mask_array()):
        at = np.linalg.inv(affine[:, :3]) @ (grid.matrix @ [i, j, k, 1] - affine[:, 3])
        if (at < -1e-6).any() or (at > np.array(volume.shape) - 1 + 1e-6).any():
            out.append(0.0)
            continue
        total = 0.0
        for cell in np.argwhere(np.isfinite(volume)):
            total += volume[tuple(cell)] * np.prod(np.maximum(0, 1 - np.abs(cell - at)))
        near = volume[tuple(np.minimum(np.floor(np.maximum(at, 0) + 0.5).astype(int), np.array(volume.shape) - 1))]
        out.append(total if np.isfinite(near) else np.nan)
    return np.array(out)


@pytest.mark.parametrize("affine", [TURNED, np.array([[3.0, 0, 0, -5], [0, 3, 0, -5], [0, 0, 3, -5]]), np.array([[-2.0, 0, 0, 4], [0, 2, 0, -4], [0, 0, 2, -4]])])
def test_resampling_is_that_of_plain_code(affine):
    volume = RNG.normal(size=(5, 6, 4))
    volume[2, 2, 2], volume[0, 1, 1] = np.nan, np.inf
    (got,) = volumes.frames_on(volumes.encode(volume, affine, "f8"), GRID)
    want = plain(volume, affine, GRID)
    assert np.allclose(got, want, atol=1e-9, equal_nan=True) and 0 < (want != 0).sum() < len(want) + 1
    (near,) = volumes.frames_on(volumes.encode(volume, affine, "f8"), GRID, nearest=True)
    assert set(near[np.isfinite(near)].tolist()) <= {0.0, *volume.ravel().tolist()}


def test_flat_volumes_and_the_grid_itself():
    flat = RNG.normal(size=(5, 4, 1))
    (got,) = volumes.frames_on(volumes.encode(flat, np.c_[np.diag([2.0, 2, 2]), [-4.0, -4, 0]], "f8"), GRID)
    want = np.zeros(GRID.shape)
    want[:, :, 2] = flat[:, :, 0]
    assert np.allclose(got, want[GRID.mask_array()])
    own = RNG.normal(size=GRID.shape)
    own[1, 1, 2] = np.nan
    (got,) = volumes.frames_on(volumes.encode(own, GRID.matrix, "f8"), GRID)
    assert np.array_equal(got, own[GRID.mask_array()], equal_nan=True)


def test_files_of_a_studyset(spark, tmp_path):
    folder = tmp_path / "images it's"
    image = spark.createDataFrame([(f"s/{i}", v, float(RNG.normal())) for i in range(3) for v in range(120) if v % 7], "id string, voxel long, value double")
    volumes.save(volumes.volumes(image, GRID, "f8"), str(folder))
    volumes.save(volumes.volumes(image, GRID, "f8"), str(folder))  # again, the same files
    (folder / "sub").mkdir()
    (folder / "sub" / "turned.nii").write_bytes(gzip.decompress(volumes.encode(RNG.normal(size=(2, 5, 6, 4)), TURNED)))
    (folder / "notes.txt").write_text("no volume")
    found = volumes.files(spark, str(folder))
    assert {r["name"] for r in found.select("name").collect()} == {"s%2F0.nii.gz", "s%2F1.nii.gz", "s%2F2.nii.gz", "sub/turned.nii"}
    back = volumes.on_grid(found.where("name like 's%2F%'").withColumn("extra", volumes.F.lit(7)), GRID)
    assert back.columns == ["name", "extra", "path", "frame", "voxel", "value"]
    kept = {(r["id"].split("/")[1], r["voxel"]): r["value"] for r in image.collect()}
    mask = set(np.flatnonzero(GRID.mask_array()).tolist())
    rows = back.collect()
    assert len(rows) == 3 * len(mask) and {r["voxel"] for r in rows} == mask
    assert all(r["value"] == kept.get((r["name"][4], r["voxel"]), 0.0) for r in rows)
    assert volumes.on_grid(found.where("name like 'sub%'"), GRID).groupBy("frame").count().count() == 2

    table = [("a", 0, None, "s%2F0.nii.gz", "z"), ("a", 1, "http://x/y/s%2F1.nii.gz", None, "varcope"), ("b", 0, None, "s%2F0.nii.gz", "z"), ("c", 0, None, "sub/turned.nii", "z"), ("d", 0, None, "gone.nii", "z"), ("e", 0, None, None, "z")]
    ss = Studyset(analysis=spark.createDataFrame([(c,) for c in "abcde"], "id string"), image=spark.createDataFrame(table, "id string, image_pos int, url string, filename string, value_type string"), grid=GRID)
    long = volumes.images(ss, found)
    assert {(r["id"], r["value_type"]): r["count"] for r in long.groupBy("id", "value_type").count().collect()} == {k: len(mask) for k in [("a", "z"), ("a", "varcope"), ("b", "z"), ("c", "z")]}
    assert {tuple(r) for r in volumes.missing(ss, found).collect()} == {("d", "z", "gone.nii"), ("e", "z", None)}
    w = {(r["id"], r["voxel"]): r for r in volumes.wide(long).collect()}
    assert w["a", 1]["z"] == kept["0", 1] and w["a", 1]["varcope"] == kept["1", 1] and w["b", 1]["varcope"] is None and w["b", 1]["t"] is None


def test_errors_name_the_file(spark, tmp_path):
    (tmp_path / "broken.nii.gz").write_bytes(gzip.compress(b"no"))
    with pytest.raises(Exception, match=r"broken\.nii\.gz: not a NIfTI-1"):
        volumes.on_grid(volumes.files(spark, str(tmp_path)), GRID).count()
    none = spark.createDataFrame([(1, None)], "id long, content binary")
    assert volumes.on_grid(none, GRID).count() == 0 and volumes.on_grid(none.limit(0), GRID).count() == 0
    with pytest.raises(ValueError, match="frame"):
        volumes.on_grid(none.withColumn("frame", none.id), GRID)


OBLIQUE = Grid(7, 6, 5, k_mask=(1, 3)).with_affine(np.array([[1.9, -0.7, 0.2, -6.0], [0.5, 2.1, 0.0, -5.5], [0.1, 0.3, 2.2, -5.0]]))


def test_oblique_grid(spark, tmp_path):
    xyz = [(n % 9, *map(float, row)) for n, row in enumerate(RNG.uniform(-10, 10, (300, 3)))]
    centres = [(9, *map(float, OBLIQUE.matrix @ [*v, 1])) for v in np.ndindex(3, 3, 3)]
    point = spark.createDataFrame(xyz + centres, "id long, x double, y double, z double")
    inverse = np.linalg.inv(OBLIQUE.matrix[:, :3])
    cell = {r: np.trunc(np.round(inverse @ (np.array(r[1:]) - OBLIQUE.matrix[:, 3]), 9)).astype(int) for r in xyz + centres}
    assert [tuple(cell[r]) for r in centres] == list(np.ndindex(3, 3, 3))
    on = OBLIQUE.mask_array()
    inside = {r for r, c in cell.items() if (c >= 0).all() and (c < OBLIQUE.shape).all() and on[tuple(c)]}
    assert {tuple(r) for r in selection.focus_filter(point, OBLIQUE).select("id", "x", "y", "z").collect()} == inside
    clamped = {r[0] for r, c in cell.items() if on[tuple(np.clip(c, 0, np.array(OBLIQUE.shape) - 1))]}
    assert {r[0] for r in selection.by_mask(point, OBLIQUE).collect()} == clamped

    ijk = point.withColumns(dict(zip("ijk", OBLIQUE.voxels(point.x, point.y, point.z))))
    metric = OBLIQUE.metric
    want, best = set(), {}
    for r, c in cell.items():
        for v in np.argwhere(on):
            away = np.linalg.norm(metric @ (v - c))
            flat = int(np.ravel_multi_index(v, OBLIQUE.shape))
            if away <= 4.0:
                want.add((r[0], flat))
    assert {(r["id"], r["voxel"]) for r in kernels.mkda(ijk, OBLIQUE, 4.0).collect()} == want
    k = kernels.ale_kernel(3.0, metric)
    half = np.array(k.shape) // 2
    for r, c in cell.items():
        for v in np.argwhere(on):
            o = v - c + half
            if (o >= 0).all() and (o < k.shape).all():
                key = (r[0], int(np.ravel_multi_index(v, OBLIQUE.shape)))
                best[key] = max(best.get(key, 0.0), k[tuple(o)])
    got = {(r["id"], r["voxel"]): r["value"] for r in kernels.ale_gaussian(ijk, OBLIQUE, 3.0).collect()}
    assert got.keys() == best.keys() and all(got[b] == pytest.approx(v, abs=1e-12) for b, v in best.items())
    straight = Grid(7, 6, 5).with_affine(np.c_[np.diag([2.0, 3.0, 2.5]), [0, 0, 0]])
    assert straight.metric == (2.0, 3.0, 2.5) and kernels.ale_kernel(6.0, np.diag(straight.metric)) == pytest.approx(kernels.ale_kernel(6.0, straight.metric))
    assert sorted(kernels.sphere(5.0, np.diag([2.0, 3.0, 2.5]))) == sorted(kernels.sphere(5.0, (2.0, 3.0, 2.5)))

    voxels = spark.createDataFrame([(int(np.ravel_multi_index(v, OBLIQUE.shape)), int(v[0]) % 2) for v in np.argwhere(on)], "voxel long, cluster int")
    hits = {}
    for r in cell:
        at = inverse @ (np.array(r[1:]) - OBLIQUE.matrix[:, 3])
        for cluster in {int(v[0]) % 2 for v in np.argwhere(on) if ((v - at) ** 2).sum() < 1 - 1e-9}:
            hits[r[0], cluster] = hits.get((r[0], cluster), 0) + 1
    assert {(r["id"], r["cluster"]): r["n"] for r in diagnostics.focus_counter(point, voxels, OBLIQUE).collect()} == hits

    peak = spark.createDataFrame([(1, 0, 1, 72, 4.0)], "id long, cluster long, rank int, voxel long, value double")
    r = coordinates.points_of(peak, OBLIQUE, "MNI").first()
    assert [r[c] for c in "xyz"] == pytest.approx(OBLIQUE.matrix @ [*np.unravel_index(72, OBLIQUE.shape), 1])
    with pytest.raises(ValueError, match="rotated"):
        OBLIQUE.to_voxel(point.x)
    with pytest.raises(ValueError, match="inverse"):
        OBLIQUE.with_affine(np.zeros((3, 4)))
    ss = Studyset(analysis=point.select("id").distinct(), point=point, grid=OBLIQUE)
    tables.write(ss, str(tmp_path / "s"))
    assert tables.read(spark, str(tmp_path / "s")).grid == OBLIQUE
