"""The test tables bound to the shapes of a studyset, and the same projections as SQL.

analysis = orders, point = lineitem on a 10 x 10 x 10 grid of 2 mm voxels,
annotation = share of an order's lines by brand, selection = urgent orders,
image = embeddings on a 4 x 4 x 4 grid, text = documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.plans.studyset import Grid, Studyset

GRID = Grid(10, 10, 10, 2.0, -9.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def analyses(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("study_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (10 + F.col("o_orderkey") % 40).alias("sample_size"))


def points(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem")
    p = p.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 10).alias("i"), (F.col("l_suppkey") % 10).alias("j"), (F.col("l_linenumber") % 10).cast("long").alias("k"))
    return p.select("id", "i", "j", "k", *[(2.0 * F.col(c) - 9.0).alias(n) for c, n in (("i", "x"), ("j", "y"), ("k", "z"))])


def annotations(spark: SparkSession, d: str, label: str = "p_brand") -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p_partkey"))
    hits = lines.join(table(spark, d, "part").select("p_partkey", F.col(label).alias("label")), "p_partkey").groupBy("id", "label").agg(F.count("*").alias("n"))
    every = lines.groupBy("id").agg(F.count("*").alias("all"))
    return hits.join(every, "id").select("id", "label", (F.col("n") / F.col("all")).alias("value"))


def selected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))


def images(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("label").alias("study_id"), F.posexplode("embedding").alias("voxel", "v"))
    return v.select("id", "study_id", F.col("voxel").cast("long").alias("voxel"), F.col("v").cast("double").alias("value"), (F.lit(0.01) + F.col("v").cast("double") * F.col("v").cast("double")).alias("varcope"))


def studyset(spark: SparkSession, d: str) -> Studyset:
    return Studyset(analysis=analyses(spark, d), point=points(spark, d), annotation=annotations(spark, d), image=images(spark, d), text=table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), grid=GRID)


#: The same projections for DuckDB, to begin a WITH list.
ANALYSIS = "analysis AS (SELECT o_orderkey AS id, o_custkey AS study_id, o_orderstatus AS status, o_orderpriority AS priority, 10 + o_orderkey % 40 AS sample_size FROM orders)"
POINT = "point AS (SELECT l_orderkey AS id, l_partkey % 10 AS i, l_suppkey % 10 AS j, (l_linenumber % 10)::BIGINT AS k, 2.0::DOUBLE * (l_partkey % 10) - 9 AS x, 2.0::DOUBLE * (l_suppkey % 10) - 9 AS y, 2.0::DOUBLE * (l_linenumber % 10) - 9 AS z FROM lineitem)"
ANNOTATION = "annotation AS (SELECT h.id, h.label, h.n::DOUBLE / e.n AS value FROM (SELECT l_orderkey AS id, p_brand AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) h JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY ALL) e USING (id))"
SELECTION = "ids AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')"
IMAGE = "image AS (SELECT vec_id AS id, label AS study_id, generate_subscripts(embedding, 1) - 1 AS voxel, unnest(embedding)::DOUBLE AS value FROM embeddings)"
MASK = "mask_voxel AS (SELECT a.range AS i, b.range AS j, c.range AS k, a.range * 100 + b.range * 10 + c.range AS voxel FROM range(10) a, range(10) b, range(1, 8) c)"
