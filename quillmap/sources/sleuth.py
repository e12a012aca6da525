"""Sleuth text files: foci with a reference space, study headers and sample sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions.native import mni_to_tal, tal_to_mni
from quillmap.plans.studyset import Studyset

SPACES = {"mni": "MNI", "tal": "TAL", "talairach": "TAL"}
SCHEMA = "study string, contrast string, sample_size int, x double, y double, z double, space string, path string, experiment int, focus int"


def split_name(name: str) -> tuple[str, str]:
    """Study and contrast, divided at the first ``;`` or ``:`` after the year."""
    found = re.match(r"^(.*?\b\d{4}\w?)\s*[;:]\s*(.*)$", name) or re.match(r"^([^;:]*)[;:]\s*(.*)$", name)
    return (found[1].strip(), found[2].strip()) if found else (name.strip(), "analysis_1")


def parse(text: str) -> Iterator[tuple]:
    """(study, contrast, sample_size, x, y, z, space, experiment, focus) of one file; several headers may share a block's foci."""
    space, heads, size, number, open_block = None, [], None, 0, False
    focus = 0
    for raw in text.splitlines():
        line = raw.strip()
        if not line:
            heads, size, open_block = [], None, False
            continue
        if line.startswith("//"):
            body = line[2:].strip()
            if "=" in body and body.lower().startswith("reference"):
                key = body.split("=", 1)[1].strip().lower()
                if key not in SPACES:
                    raise ValueError(f"unknown space: {key}")
                space = SPACES[key]
            elif body.lower().startswith("subjects"):
                size = int(body.split("=", 1)[1])
            elif body:
                if open_block:
                    heads, open_block = [], False
                heads.append(split_name(body))
            continue
        parts = line.split()
        if len(parts) < 3 or not heads:
            raise ValueError(f"not a focus of a study: {line}")
        if not open_block:
            number, open_block, focus = number + 1, True, 0
        for study, contrast in heads:
            yield study, contrast, size, *map(float, parts[:3]), space, number, focus
        focus += 1


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each focus of each experiment. A file is the unit of parallel work, as its lines depend on those before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:7], path, *r[7:]) for path, t in zip(b["path"], b["value"], strict=True) for r in parse(t)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    files = spark.read.text(list(paths), wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.mapInPandas(run, SCHEMA)


def blocks(point: DataFrame, analysis: DataFrame) -> DataFrame:
    """(id, value): one text block for each analysis, the smallest of its sample sizes given, or none if it has no size."""
    size = F.array_min("sample_size") if dict(analysis.dtypes)["sample_size"].startswith("array") else F.col("sample_size")
    foci = point.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y", "z"))), lambda p: F.concat_ws("\t", *[F.format_string("%.2f", p[c]) for c in "xyz"])), "\n").alias("foci"))
    head = F.concat(F.lit("// "), F.col("study_id").cast("string"), F.lit(": "), F.col("id").cast("string"), F.coalesce(F.concat(F.lit("\n// Subjects="), size.cast("int").cast("string")), F.lit("")), F.lit("\n"))
    return analysis.join(foci, "id").select("id", F.concat(head, "foci", F.lit("\n")).alias("value"))


def write(point: DataFrame, analysis: DataFrame, path: str, space: str = "MNI", group: DataFrame | None = None) -> None:
    """A folder of text files, one partition of it for each group (id, group) if given. Each file starts with the space."""
    rows = blocks(point, analysis)
    rows = rows.join(group, "id") if group is not None else rows.withColumn("group", F.lit("all"))

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for b in batches:
            if first and len(b):
                yield pd.DataFrame({"group": sorted(b["group"].unique()), "value": f"// Reference={space}\n"})
                first = False
            yield b[["group", "value"]]

    dealt = rows.select("group", "value").repartition("group").sortWithinPartitions("group")
    (dealt.mapInPandas(head, "group string, value string").sortWithinPartitions("group") if group is None else dealt.select("group", F.concat(F.lit(f"// Reference={space}\n"), "value").alias("value"))).write.partitionBy("group").text(path)


def to_studyset(rows: DataFrame) -> Studyset:
    """The studyset of parsed files: an analysis for each study and contrast."""
    key = F.concat_ws("-", "study", "contrast")
    sizes = rows.groupBy(key.alias("id"), F.col("study").alias("study_id"), F.col("contrast").alias("contrast_id")).agg(F.max("sample_size").alias("sample_size"), F.max("space").alias("space"))
    return Studyset(analysis=sizes, point=rows.select(key.alias("id"), F.col("focus").alias("point_pos"), "x", "y", "z", "space"))


def in_space(point: DataFrame, target: str) -> DataFrame:
    """Points of MNI or TAL moved to one of them by the published affine; other or unknown spaces are an error where they occur."""
    moves = {("MNI", "TAL"): mni_to_tal, ("TAL", "MNI"): tal_to_mni}
    other = next(a for a, b in moves if b == target)
    moved = moves[other, target](F.col("x"), F.col("y"), F.col("z"))
    known = F.when(F.col("space").isin(target, other), F.col("space")).otherwise(F.raise_error(F.concat(F.lit("unknown space: "), F.coalesce("space", F.lit("none")))))
    place = lambda i, c: F.when(known == target, F.col(c)).otherwise(moved[i])
    out = point.withColumns({f"_{c}_": place(i, c) for i, c in enumerate("xyz")})
    return out.withColumns({**{c: F.col(f"_{c}_") for c in "xyz"}, "space": F.lit(target)}).drop("_x_", "_y_", "_z_")
