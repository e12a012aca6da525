"""Columnar studysets, feature tables, results and synthetic data."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.plans.studyset import Grid, Studyset
from quillmap.sources import sparse

TABLES = ("analysis", "point", "annotation", "image", "text", "study")


def write(ss: Studyset, path: str, overwrite: bool = False) -> None:
    """One Parquet folder for each table and a manifest with the space and the grid; an existing folder is an error unless overwritten."""
    names = [n for n in TABLES if getattr(ss, n) is not None]
    for n in names:
        getattr(ss, n).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/{n}")
    spark = ss.analysis.sparkSession
    spark.createDataFrame([(json.dumps({"tables": names, "space": ss.space, "grid": None if ss.grid is None else asdict(ss.grid)}),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(f"{path}/studyset")


def read(spark: SparkSession, path: str) -> Studyset:
    """Tables of the manifest; points without an analysis are dropped."""
    manifest = json.loads(spark.read.text(f"{path}/studyset").first()[0])
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}
    if "point" in tables:
        tables["point"] = tables["point"].join(tables["analysis"].select("id"), "id", "left_semi")
    return Studyset(**tables, space=manifest["space"], grid=Grid.of(manifest["grid"]) if manifest.get("grid") else None)


def convert(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> Studyset:
    """Nested JSON to Parquet; every analysis needs an id of its own."""
    from quillmap.sources import nimads

    ss = nimads.read(spark, source)
    if ss.check()["repeated"]:
        raise ValueError("analyses with the same id")
    write(ss, target, overwrite)
    return read(spark, target)


def read_feature_tables(spark: SparkSession, coordinates: str, metadata: str, features: str | None = None, vocabulary: str | None = None, group: str = "terms", sparse_archive: bool | None = None) -> Studyset:
    """Tab-separated coordinates (id, x, y, z) and metadata (id, ...), features and a vocabulary, one word a line; labels get the group as a prefix.

    Features are triples (id, column, value) in Parquet, or sparse matrices in ``.npz`` (one, or a folder of them, with ``sparse_archive``),
    whose rows are those of the metadata, in order.
    """
    point = spark.read.option("sep", "\t").option("header", True).csv(coordinates).select("id", *[F.col(c).cast("double") for c in "xyz"])
    meta = spark.read.option("sep", "\t").option("header", True).csv(metadata)
    analysis = meta.withColumn("study_id", F.col("id")).withColumn("contrast_id", F.lit("1"))
    annotation = None
    if features and vocabulary:
        words = spark.read.text(vocabulary, wholetext=True).select(F.posexplode(F.split(F.trim("value"), "\n")).alias("column", "word"))
        if sparse_archive if sparse_archive is not None else features.endswith(".npz"):
            rows = sparse.read(spark, features).join(sparse.numbered(meta).select("row", "id"), "row")
        else:
            rows = spark.read.parquet(features)
        # left to Spark, which sends the vocabulary only if it is small
        annotation = rows.join(words, "column").select("id", F.concat(F.lit(f"{group}__"), "word").alias("label"), "value")
    return Studyset(analysis=analysis, point=point, annotation=annotation)


def write_maps(maps: DataFrame, path: str) -> None:
    """(map_name, voxel, value), one folder for each map, single precision as results are kept."""
    maps.select("map_name", "voxel", F.col("value").cast("float").alias("value")).write.partitionBy("map_name").parquet(path)


def write_table(table: DataFrame, path: str) -> None:
    table.write.option("sep", "\t").option("header", True).csv(path)


def synthetic(spark: SparkSession, foci: list[tuple[float, float, float]], n_studies: int = 30, fwhm: float = 10.0, n_noise: int = 0, sample_size: int = 30, extent: float = 70.0, seed: int = 1) -> Studyset:
    """Studies that report each true focus with normal jitter, and uniform noise foci. Draws depend on (seed, study, focus) only, not on partitioning."""
    sigma = fwhm / 2.3548200450309493
    ids = spark.range(n_studies).select(F.concat(F.lit("study-"), F.col("id").cast("string")).alias("id"))

    def unit(*keys):
        return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    def normal(axis: str):
        return F.sqrt(-2 * F.log(unit(F.col("id"), F.col("n"), F.lit(f"{axis}a")))) * F.cos(2 * 3.141592653589793 * unit(F.col("id"), F.col("n"), F.lit(f"{axis}b")))

    truth = spark.createDataFrame([(n, *map(float, f)) for n, f in enumerate(foci)], "n long, tx double, ty double, tz double")
    own = ids.crossJoin(F.broadcast(truth)).select("id", *[(F.col(f"t{a}") + sigma * normal(a)).alias(a) for a in "xyz"])
    noise = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(n_noise))).alias("n")) if n_noise else ids.select("id", F.lit(0).alias("n")).limit(0)
    noise = noise.select("id", *[((2 * unit(F.col("id"), F.col("n"), F.lit(f"noise{a}")) - 1) * extent).alias(a) for a in "xyz"])
    analysis = ids.select("id", F.col("id").alias("study_id"), F.lit(sample_size).alias("sample_size"))
    return Studyset(analysis=analysis, point=own.unionByName(noise))
