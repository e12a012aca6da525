"""Images in NIfTI-1 files, plain or gzipped: read, masked and resampled to a grid, and written.

Spark's source of binary files lists and reads them, so they may lie in any store that Spark
reaches, and a file is the parallel unit: it is decoded, resampled and masked where it was read,
and only voxels of the mask leave the task. Nothing is shuffled. A file must fit a task (and 2 GB,
the limit of a binary value). A file that is not a volume is an error that names it.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.plans.studyset import Grid, Studyset

#: The header's fields that are used, as the public format has them: place, type, count (fixed values).
FIELDS = {
    "sizeof_hdr": (0, "i4", 1),
    "dim": (40, "i2", 8),
    "datatype": (70, "i2", 1),
    "bitpix": (72, "i2", 1),
    "pixdim": (76, "f4", 8),
    "vox_offset": (108, "f4", 1),
    "scl": (112, "f4", 2),
    "xyzt_units": (123, "u1", 1),
    "codes": (252, "i2", 2),
    "quatern": (256, "f4", 3),
    "qoffset": (268, "f4", 3),
    "srow": (280, "f4", 12),
}
#: Codes of the types of real numbers (fixed values).
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER, START = 348, 352
#: Voxels by which a place may lie outside of a volume and still be taken for one at its edge.
EDGE = 1e-6


def affine_of(field: dict[str, np.ndarray]) -> np.ndarray:
    """Voxels to millimetres, 3 x 4: the given rows, else the rotation of a quaternion, else sizes alone."""
    qform, sform = field["codes"]
    if sform > 0:
        return field["srow"].astype(float).reshape(3, 4)
    size = field["pixdim"][1:4].astype(float)
    if qform <= 0:
        return np.c_[np.diag(size), np.zeros(3)]
    b, c, d = field["quatern"].astype(float)
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    turn = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])
    size[2] *= -1 if field["pixdim"][0] < 0 else 1
    return np.c_[turn * size, field["qoffset"].astype(float)]


def decode(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A file's values by (frame, i, j, k), scaled as it says, and its affine."""
    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (EOFError, OSError, zlib.error) as e:
            raise ValueError("a compressed file that is cut off or damaged") from e
    if len(content) < HEADER or content[344:347] != b"n+1":
        raise ValueError("not a NIfTI-1 file with its data")
    end = next((e for e in "<>" if np.frombuffer(content, f"{e}i4", 1)[0] == HEADER), None)
    if end is None:
        raise ValueError("a header of an unknown length")
    field = {n: np.frombuffer(content, end + t, count, at) for n, (at, t, count) in FIELDS.items()}
    kind, dim = TYPES.get(int(field["datatype"][0])), field["dim"]
    if kind is None or not 1 <= dim[0] <= 7 or (dim[1 : 1 + dim[0]] < 1).any():
        raise ValueError("a type or a shape that is not supported")
    shape = [int(x) for x in dim[1 : 1 + dim[0]]] + [1] * (3 - min(int(dim[0]), 3))
    start, count = max(int(field["vox_offset"][0]), START), int(np.prod(shape))
    if len(content) < start + count * np.dtype(kind).itemsize:
        raise ValueError("fewer values than its shape has")
    values = np.frombuffer(content, end + kind, count, start)
    slope, shift = (float(x) for x in field["scl"])
    values = values.astype(float)
    if np.isfinite(slope) and slope != 0:
        values = values * slope + (shift if np.isfinite(shift) else 0.0)
    # the first axis is the fastest; all above the third are frames
    return values.reshape((-1, *shape[2::-1])).transpose(0, 3, 2, 1), affine_of(field)


def encode(values: np.ndarray, affine: np.ndarray, kind: str = "f4") -> bytes:
    """A gzipped file of a volume, or of (frame, i, j, k); the same bytes each time."""
    frames = values if values.ndim == 4 else values[None]
    n, *shape = frames.shape
    sizes = np.sqrt((affine[:, :3] ** 2).sum(0))
    own = {
        "sizeof_hdr": HEADER,
        "dim": [3 if n == 1 else 4, *shape, n, 1, 1, 1],
        "datatype": next(code for code, t in TYPES.items() if t == kind),
        "bitpix": 8 * np.dtype(kind).itemsize,
        "pixdim": [1, *sizes, 0, 0, 0, 0],
        "vox_offset": START,
        "scl": [1, 0],
        "xyzt_units": 2,  # millimetres
        "codes": [0, 2],
        "srow": affine.ravel(),
    }
    head = bytearray(START)
    for name, x in own.items():
        at, t, count = FIELDS[name]
        head[at : at + count * np.dtype(t).itemsize] = np.broadcast_to(np.asarray(x), count).astype(f"<{t}").tobytes()
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + frames.transpose(0, 3, 2, 1).astype(f"<{kind}").tobytes(), 6, mtime=0)


def places(grid: Grid, affine: np.ndarray) -> np.ndarray:
    """Where the voxels of a grid's mask lie in a volume of another affine, 3 x voxels, in its voxels."""
    ijk = np.argwhere(grid.mask_array()).T
    mm = grid.matrix[:, :3] @ ijk + grid.matrix[:, 3:]
    return np.linalg.solve(affine[:, :3], mm - affine[:, 3:])


def sample(volume: np.ndarray, at: np.ndarray, nearest: bool = False) -> np.ndarray:
    """Values at places by trilinear weights, or of the nearest voxel; 0 outside the volume.

    Values that are not finite count as 0 between finite ones; where the nearest one is not finite, the result is NaN.
    """
    top = np.array(volume.shape)[:, None] - 1
    inside = ((at >= -EDGE) & (at <= top + EDGE)).all(0)
    at = np.clip(at, 0, top)
    close = np.minimum(np.floor(at + 0.5).astype(int), top)
    here = volume[tuple(close)]
    if nearest:
        return np.where(inside, here, 0.0)
    low = np.floor(at).astype(int)
    high, part = np.minimum(low + 1, top), at - low
    finite = np.where(np.isfinite(volume), volume, 0.0)
    total = np.zeros(at.shape[1])
    for corner in np.ndindex(2, 2, 2):
        pick = np.array(corner, bool)[:, None]
        total += np.where(pick, part, 1 - part).prod(0) * finite[tuple(np.where(pick, high, low))]
    return np.where(inside, np.where(np.isfinite(here), total, np.nan), 0.0)


def frames_on(content: bytes, grid: Grid, nearest: bool = False) -> Iterator[np.ndarray]:
    """The mask's values of each frame of a file; a file on the grid itself is only masked."""
    values, affine = decode(content)
    if values.shape[1:] == grid.shape and np.allclose(affine, grid.matrix, atol=1e-5):
        yield from values[:, grid.mask_array()]
        return
    if abs(np.linalg.det(affine[:, :3])) < 1e-12:
        raise ValueError("an affine without an inverse")
    at = places(grid, affine)
    for volume in values:
        yield sample(volume, at, nearest)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, content) of the folder's volumes, with those of folders within; a name is the path inside the folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{nii,nii.gz}").load(folder)
    root = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return rows.select("path", F.expr("substring(path, locate(:root, path) + length(:root))".replace(":root", "'" + root.replace("'", "\\'") + "'")).alias("name"), "content")


def on_grid(rows: DataFrame, grid: Grid, nearest: bool = False) -> DataFrame:
    """Each frame of each file as values at the mask's voxels: all columns but ``content``, then frame, voxel, value.

    A file whose shape or affine differs from the grid's is resampled (``sample``); a null content gives no rows.
    """
    keys = [f for f in rows.schema.fields if f.name not in ("path", "content")]
    taken = {"frame", "voxel", "value"} & {f.name for f in keys}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the result's")
    with_path = "path" in rows.columns
    keys += [f for f in rows.schema.fields if f.name == "path"]
    names = [f.name for f in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voxels = pa.array(np.flatnonzero(grid.mask_array()))
        for batch in batches:
            for n, content in enumerate(batch.column("content")):
                if not content.is_valid:
                    continue
                try:
                    for frame, values in enumerate(frames_on(content.as_py(), grid, nearest)):
                        row = pa.array(np.full(len(values), n))
                        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in names], pa.array(np.full(len(values), frame, np.int32)), voxels, pa.array(values)], [*names, "frame", "voxel", "value"])
                except ValueError as e:
                    raise ValueError(f"{batch.column('path')[n] if with_path else 'a volume'}: {e}") from e

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys)
    return rows.select(*[F.col(f"`{n}`") for n in names], "content").mapInArrow(run, f"{fields}frame int, voxel long, value double")


def images(ss: Studyset, rows: DataFrame, grid: Grid | None = None, nearest: bool = False) -> DataFrame:
    """(id, value_type, voxel, value) of a studyset's images, whose file names are names of ``files``; the first frame of each.

    A name is the table's ``filename``, else the last part of its ``url``. Images without a file give no rows, see ``missing``.
    The table of names is what a join sends, as it is the smaller; a file's content is not shuffled where Spark can send that.
    """
    named = ss.image.select("id", "value_type", _name())
    found = rows.select("name", "path", "content").join(named, "name").drop("name")
    return on_grid(found, grid or ss.grid, nearest).where("frame = 0").select("id", "value_type", "voxel", "value")


def missing(ss: Studyset, rows: DataFrame) -> DataFrame:
    """(id, value_type, name) of images whose file is not there."""
    return ss.image.select("id", "value_type", _name()).join(rows.select("name"), "name", "left_anti").select("id", "value_type", "name")


def _name():
    return F.coalesce("filename", F.substring_index("url", "/", -1)).alias("name")


def wide(rows: DataFrame, kinds: tuple[str, ...] = ("z", "t", "p", "beta", "varcope", "se", "sd")) -> DataFrame:
    """(id, voxel, a column for each kind), null where an analysis has no such image; of several of one kind, the largest value."""
    return rows.groupBy("id", "voxel").agg(*[F.max(F.when(F.col("value_type") == k, F.col("value"))).alias(k) for k in kinds])


def volumes(image: DataFrame, grid: Grid, kind: str = "f4") -> DataFrame:
    """(id, content): a file for each id of (id, voxel, value), 0 where it has no row; ids are the groups, of at most the grid's voxels."""
    shape, matrix = grid.shape, grid.matrix
    name = image.schema["id"].dataType.simpleString()

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        volume = np.zeros(shape)
        volume.ravel()[own["voxel"].to_numpy()] = own["value"].to_numpy()
        return pd.DataFrame({"id": [key[0]], "content": [encode(volume, matrix, kind)]})

    return image.select("id", "voxel", "value").groupBy("id").applyInPandas(run, f"id {name}, content binary")


def save(rows: DataFrame, folder: str) -> None:
    """Each (id, content) as ``<id>.nii.gz`` in a folder that all executors reach.

    A file appears under its name when it is whole, and a task that runs again writes the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for key, content in zip(batch.column("id"), batch.column("content"), strict=True):
                path = f"{root}/{quote(str(key.as_py()), safe='')}.nii.gz"
                with fs.open_output_stream(f"{path}.{attempt}", compression=None) as out:
                    out.write(content.as_py())
                fs.move(f"{path}.{attempt}", path)
            yield batch.select(["id"])

    rows.select("id", "content").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}").write.format("noop").mode("overwrite").save()
