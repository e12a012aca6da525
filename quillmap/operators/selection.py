"""Selections of analyses, points and images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.plans.studyset import Grid


def short_id(c: Column) -> Column:
    """What follows the last hyphen."""
    return F.element_at(F.split(c.cast("string"), "-"), -1)


def by_ids(rows: DataFrame, ids: list, column: str = "id", drop: bool = False) -> DataFrame:
    """Rows whose full or short id is listed, or with ``drop`` the others."""
    hit = F.col(column).cast("string").isin([str(i) for i in ids]) | short_id(F.col(column)).isin([str(i) for i in ids])
    return rows.where(~hit if drop else hit)


def by_study(analysis: DataFrame, studies: list, exclude: bool = False) -> DataFrame:
    hit = F.coalesce(F.col("study_id").isin(studies), F.lit(False))
    return analysis.where(~hit if exclude else hit)


OPS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "contains": lambda c, v: c.cast("string").rlike(v),
}
ALIASES = {"eq": "==", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


def by_metadata(analysis: DataFrame, field: str, op: str, value) -> DataFrame:
    """Null never satisfies a comparison; an unknown field or operator is an error."""
    op = ALIASES.get(op, op)
    if field not in analysis.columns or op not in OPS:
        raise ValueError(f"unknown field or operator: {field} {op}")
    return analysis.where(F.coalesce(OPS[op](F.col(field), value), F.lit(False)))


def by_labels(analysis: DataFrame, annotation: DataFrame, labels: list[str], threshold: float = 0.001, match: str = "all") -> DataFrame:
    """Ids with all or any of the labels at the threshold or above. An absent label counts as 0, so at a threshold of 0 or less only explicit smaller values fail."""
    labels = sorted(set(labels))
    own = annotation.where(F.col("label").isin(labels))
    need = len(labels) if match == "all" else 1
    if threshold > 0:
        hits = own.where(F.col("value") >= threshold).groupBy("id").agg(F.countDistinct("label").alias("n"))
        return hits.where(F.col("n") >= need).select("id").join(analysis.select("id"), "id", "left_semi")
    misses = own.where(~(F.col("value") >= threshold)).groupBy("id").agg(F.countDistinct("label").alias("n"))
    out = analysis.select("id").join(misses, "id", "left")
    return out.where(len(labels) - F.coalesce("n", F.lit(0)) >= need).select("id")


def by_mask(point: DataFrame, grid: Grid) -> DataFrame:
    """Ids with a point in the mask; points outside the volume are moved to its edge first."""
    i, j, k = (F.greatest(F.lit(0), F.least(v, F.lit(n - 1))) for v, n in zip(grid.voxels(*map(F.col, "xyz")), grid.shape, strict=True))
    return point.where(grid.in_mask(i, j, k)).select("id").distinct()


def _squared(a: tuple, b: tuple) -> Column:
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)])


def by_radius(point: DataFrame, centres: list[tuple[float, float, float]], r: float = 20.0) -> DataFrame:
    """Ids with a point at most r from a centre; the bounding box of all balls reaches the scan."""
    lo = [min(c[a] for c in centres) - r for a in range(3)]
    hi = [max(c[a] for c in centres) + r for a in range(3)]
    box = reduce(lambda p, q: p & q, [F.col(n).between(lo[a], hi[a]) for a, n in enumerate("xyz")])
    near = reduce(lambda p, q: p | q, [_squared((F.col("x"), F.col("y"), F.col("z")), tuple(map(F.lit, c))) <= r * r for c in centres])
    return point.where(box & near).select("id").distinct()


#: Queries of one place in a list (about).
LISTED = 10_000


def range_join(point: DataFrame, query: DataFrame, r: float) -> DataFrame:
    """Pairs (id, query_id) at most r apart, by cells of edge r: each query's place goes to the 27 cells around its own, so the join is on equal cells.

    Places are joined, not points with queries: an id meets a place once, and the place's queries are listed where it is, so pairs are not shuffled.
    """
    places = [F.col(f"q{a}") for a in "xyz"]
    q = query.select("query_id", *[F.col(a).alias(f"q{a}") for a in "xyz"]).distinct()
    # queries at one place are one class; those with several places may meet an id twice, so their pairs are made distinct
    several = q.groupBy("query_id").agg(F.count("*").alias("_n_")).where("_n_ > 1 and query_id is not null")
    once = q.join(several, "query_id", "left_anti")
    most = once.groupBy(*places).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("query_id"), F.lit(1 + most // LISTED)).alias("_part_")
    lists = once.groupBy(*places, part).agg(F.collect_list("query_id").alias("_ids_"), F.max(F.col("query_id").isNull()).alias("_null_"))
    near = _near_places(point, once.select(*places).distinct(), r)
    out = near.join(lists, ["qx", "qy", "qz"])
    listed = out.select("id", F.explode("_ids_").alias("query_id")).unionByName(out.where("_null_").select("id", F.lit(None).cast(query.schema["query_id"].dataType).alias("query_id")).distinct())
    rest = q.join(several, "query_id", "left_semi")
    return listed.unionByName(_near_places(point, rest.select(*places).distinct(), r).join(rest, ["qx", "qy", "qz"]).select("id", "query_id").distinct())


def _near_places(point: DataFrame, place: DataFrame, r: float) -> DataFrame:
    """(id, qx, qy, qz), distinct: places at most r from a point of the id, by cells of edge r."""
    around = place
    for a in "xyz":
        around = around.select("*", F.explode(F.array(*[F.floor(F.col(f"q{a}") / r) + d for d in (-1, 0, 1)])).alias(f"c{a}"))
    own = point.select("x", "y", "z").distinct().select("*", *[F.floor(F.col(a) / r).alias(f"c{a}") for a in "xyz"])
    near = _squared((F.col("x"), F.col("y"), F.col("z")), (F.col("qx"), F.col("qy"), F.col("qz"))) <= r * r
    pairs = own.join(around, ["cx", "cy", "cz"]).where(near).select("x", "y", "z", "qx", "qy", "qz")
    return point.select("id", "x", "y", "z").join(pairs, ["x", "y", "z"]).select("id", "qx", "qy", "qz").distinct()


def nearest(point: DataFrame, centre: tuple[float, float, float], n: int) -> DataFrame:
    """Ids of the n nearest points; ties by id and place."""
    d = _squared((F.col("x"), F.col("y"), F.col("z")), tuple(map(F.lit, centre)))
    return point.withColumn("d", d).orderBy("d", "id", "x", "y", "z").limit(n).select("id").distinct()


def focus_filter(point: DataFrame, grid: Grid) -> DataFrame:
    """Points inside the volume and its mask; others go, without being moved."""
    i, j, k = grid.voxels(*map(F.col, "xyz"))
    return point.where(grid.inside(i, j, k) & grid.in_mask(i, j, k))


def first_image(image: DataFrame, policy: str = "first", order: str = "image_pos") -> DataFrame:
    """all, the first by position, or an error if an analysis has several."""
    if policy == "all":
        return image
    if policy == "error" and not image.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("an analysis has several images")
    return image.withColumn("_n_", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("_n_ = 1").drop("_n_")


def threshold_image(value: Column, level: float, tail: str = "upper", fill: float = 0.0) -> Column:
    test = {"upper": value >= level, "lower": value <= level, "two-sided": F.abs(value) >= level}[tail]
    return F.when(test, value).otherwise(F.lit(fill))


def used_labels(annotation: DataFrame, group: str | None = None, threshold: float = 0.001) -> DataFrame:
    """Labels of a group (a prefix) with at least one value above the threshold; this comparison is strict."""
    rows = annotation.where(F.col("label").startswith(f"{group}__")) if group else annotation
    return rows.where(F.col("value") > threshold).select("label").distinct()


def with_text(text: DataFrame, column: str = "text") -> DataFrame:
    return text.where(F.coalesce(F.col(column), F.lit("")) != "")


def by_annotation(annotation: DataFrame, key: str) -> DataFrame:
    """The key may name an annotation or a label."""
    name = F.col("annotation_id") == key if "annotation_id" in annotation.columns else F.lit(False)
    return annotation.where(name | (F.col("label") == key)).select("id").distinct()


def field_or_study_field(analysis: DataFrame, study: DataFrame, field: str) -> DataFrame:
    """A field at analysis level, or at study level if no analysis has it."""
    if field in analysis.columns and not analysis.where(F.col(field).isNotNull()).isEmpty():
        return analysis.select("id", field)
    if field in study.columns:
        return analysis.select("id", "study_id").join(study.select("study_id", field), "study_id").select("id", field)
    raise ValueError(f"unknown field: {field}")
