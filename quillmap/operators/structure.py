"""Joins, unions, upserts, merges and re-keying of studyset tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_sample_size(point: DataFrame, analysis: DataFrame) -> DataFrame:
    """Left join of each analysis' (mean) sample size onto its points; a list is averaged first."""
    size = F.col("sample_size")
    if dict(analysis.dtypes)["sample_size"].startswith("array"):
        size = F.try_divide(F.aggregate(size, F.lit(0.0), lambda a, x: a + x), F.size(size))
    sizes = analysis.groupBy("id").agg(F.avg(size).alias("sample_size"))
    return point.join(sizes, "id", "left")


def align(index: DataFrame, *tables: DataFrame) -> DataFrame:
    """Full outer join of tables on id."""
    for t in tables:
        index = index.join(t, "id", "outer")
    return index


def texts_of_studies(text: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Left join by study; of several abstracts the first by text."""
    one = abstracts.groupBy("study_id").agg(F.min("abstract").alias("abstract"))
    return text.join(one, "study_id", "left")


def tails(a: DataFrame, b: DataFrame) -> DataFrame:
    """Outer join of two contribution tables, absent values as 0."""
    both = a.withColumnRenamed("value", "positive").join(b.withColumnRenamed("value", "negative"), "id", "outer")
    return both.fillna(0, ["positive", "negative"])


def resolve_notes(notes: DataFrame, analysis: DataFrame) -> DataFrame:
    """Notes to analyses by (study, analysis), else by full id, else by a short id that only one analysis has."""
    full = analysis.select(F.concat_ws("-", "study_id", "id").alias("full_id"), F.col("study_id").cast("string").alias("study"), F.col("id").cast("string").alias("short"))
    alone = full.withColumn("n", F.count("*").over(Window.partitionBy("short"))).where("n = 1").select(F.col("short").alias("s3"), F.col("full_id").alias("f3"))
    out = notes.join(full.select(F.col("study").alias("s1"), F.col("short").alias("a1"), F.col("full_id").alias("f1")), (F.col("study") == F.col("s1")) & (F.col("analysis") == F.col("a1")), "left")
    out = out.join(full.select(F.col("full_id").alias("f2")), F.col("analysis") == F.col("f2"), "left")
    out = out.join(alone, F.col("analysis") == F.col("s3"), "left")
    return out.withColumn("resolved", F.coalesce("f1", "f2", "f3")).drop("s1", "a1", "f1", "f2", "s3", "f3")


def merge(left: DataFrame, right: DataFrame, key: str = "id", prefer_left: bool = True) -> DataFrame:
    """Rows of both; for a key in both, the preferred side's, with its nulls filled from the other."""
    a, b = (left, right) if prefer_left else (right, left)
    rest = [c for c in left.columns if c != key]
    other = b.select(F.col(key), *[F.col(c).alias(f"_{c}_") for c in rest])
    return a.join(other, key, "outer").select(key, *[F.coalesce(F.col(c), F.col(f"_{c}_")).alias(c) for c in rest])


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", value: str = "text") -> DataFrame:
    """New values replace old ones; null ones do not."""
    return old.select(key, F.col(value).alias("_o_")).join(new.select(key, F.col(value).alias("_n_")), key, "outer").select(key, F.coalesce("_n_", "_o_").alias(value))


def combine_analyses(analysis: DataFrame, point: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One analysis for each study: ids joined by ``_`` and names (if there are) by ``; `` in order, points re-keyed.

    A study's analyses are few; ``rekey`` moves other children.
    """
    keyed = analysis.groupBy("study_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), "_").alias("combined"), *([F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), "; ").alias("name")] if "name" in analysis.columns else []))
    return keyed, rekey(point, analysis, keyed)


def rekey(point: DataFrame, analysis: DataFrame, keyed: DataFrame) -> DataFrame:
    """Children of analyses (points, images, texts) as children of their study's one analysis."""
    moved = point.join(analysis.select("id", "study_id").join(keyed, "study_id").select("id", "combined"), "id")
    return moved.drop("id").withColumnRenamed("combined", "id")


def unique_labels(annotation: DataFrame) -> DataFrame:
    """A label that several annotations use gets its annotation's name before it, except in the first annotation."""
    names = annotation.select("annotation_id", "label").distinct()
    names = names.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("annotation_id")))
    names = names.withColumn("unique_label", F.when(F.col("n") > 1, F.concat_ws(".", "annotation_id", "label")).otherwise(F.col("label"))).drop("n")
    return annotation.join(names, ["annotation_id", "label"])


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n_ = 1").drop("_n_")


def top_k(rows: DataFrame, group: str, value: str, tie: str, k: int = 3) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), tie))).where(F.col("rank") <= k)


def standardize(rows: DataFrame, group: str, value: str) -> DataFrame:
    """z-scores by the population standard deviation of each group."""
    stats = rows.groupBy(group).agg(F.avg(value).alias("_m_"), F.stddev_pop(value).alias("_s_"))
    return rows.join(stats, group).withColumn("z", F.try_divide(F.col(value) - F.col("_m_"), F.col("_s_"))).drop("_m_", "_s_")


def one_hot(rows: DataFrame, column: str, reference: str | None = None) -> DataFrame:
    """0/1 columns for all levels but the reference, by default the first in case-insensitive order. The levels are few by nature and are read first."""
    levels = sorted((r[0] for r in rows.select(column).distinct().where(F.col(column).isNotNull()).collect()), key=lambda x: (str(x).lower(), str(x)))
    drop = levels[0] if reference is None else reference
    return rows.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in levels if v != drop])
