"""Mixing sources to target weights by Pareto order sampling.

Sources share the total number of words by weight; a target stops at
``most`` times its source's size and the excess is shared again by weight
(water filling, solved in closed form over the small table of sources).

A source that is to give f times its words takes floor(f) whole copies of
every document for certain. For the rest, documents have inclusion
probabilities of their own: their odds are those of the remaining share of the
source, times the document's size over the source's mean size, to the power
``tilt``. So long texts, which carry more of a source for each file that is read,
are likelier; a tilt of 0 makes all alike. Documents are ranked by Pareto's
ratio, the odds of a uniform random number over the odds of inclusion, and taken
in that order until the remaining words are reached, which fixes the sample's size. The cut is found from word totals of narrow ranges of that ratio, and
only the range that holds it is put in order, so no source is sorted or summed
in one task. What is then missing of a target is filled by the one
untaken document whose size is nearest to the gap.

All random numbers are md5 digests of doc_id and a seed, so reruns agree.
Defined results: a null text has size 0 and is never needed; a null source is
a source of its own, last in order; rows that repeat a doc_id and size have one
ratio, and of those at the cut as many are taken as fit, whichever they are (each row has
a number for that, and where one doc_id has many rows they are counted by hashes of
it, so they are not put in order in one task); an empty table gives an empty mix; extra columns pass through ``mix``, but ones named as its results
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, look_up, materialize, uniform

MOST_COPIES, RANGES, TILT = 3, 4096, 0.5
#: The column that numbers rows.
ROW = "_mix_row_"
OUT = ("source_size", "target", "copies", "taken")


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of each whole text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Add ``target`` to rows (source, weight, source_size); one row for each source."""
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = sources.withColumn("cap", most * F.col("source_size"))
    rows = rows.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    # the level if this source and all of a larger ratio were below their caps; the largest consistent one is right
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    rows = rows.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    capped = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return rows.select("source", "weight", "source_size", capped.alias("target"))


def repeating_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights 1, 2, 3, repeating, over sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1))


def mix(rows: DataFrame, planned: DataFrame, seed: int = 0, tilt: float = TILT) -> DataFrame:
    """Rows with doc_id, source, size; plans with source, source_size, target. Adds source_size, target, copies and taken.

    ``rows`` should be a written table: it is read for word totals and again for the result.
    """
    rows = rows.drop(*OUT)
    if ROW not in rows.columns:
        rows = materialize(numbered(rows), "rows")
    own = [c for c in rows.columns if c != ROW]
    used = rows.groupBy("source").agg(F.count(F.when(F.col("size") > 0, 1)).alias("_used_")).select(F.col("source").alias("_us_"), "_used_")
    plan = planned.join(used, F.col("source").eqNullSafe(F.col("_us_"))).withColumn("_fold_", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("_sure_", F.floor("_fold_")).withColumn("_share_", F.col("_fold_") - F.floor("_fold_"))
    plan = plan.withColumn("_rest_", F.col("target") - F.col("_sure_") * F.col("source_size")).withColumn("_mean_", F.try_divide(F.col("source_size"), F.col("_used_")))
    # tables of one row for each source are written and, if their size allows, sent to all tasks: a hot source then stays where its rows are
    plan = bounded(plan.select(F.col("source").alias("_s_"), "source_size", "target", "_sure_", "_share_", "_rest_", "_mean_"), "plan")
    # Pareto's ratio, mapped to (0, 1) in the same order, so that its ranges are known beforehand
    u, live_row = F.col("_u_"), (F.col("_share_") > 0) & (F.col("size") > 0)
    odds = F.col("_share_") / (1 - F.col("_share_")) * F.pow(F.col("size") / F.col("_mean_"), F.lit(tilt))
    ratio = (u / (1 - u)) / odds
    ranked = with_plan(rows.withColumn("_u_", uniform(F.col("doc_id"), F.lit(seed))), plan, "_s_")
    ranked = ranked.withColumn("_q_", F.when(live_row, ratio / (1 + ratio)).otherwise(1.0)).withColumn("_r_", F.floor(F.col("_q_") * RANGES).cast("int"))
    live = ranked.where(live_row)
    key = ["_q_", "doc_id", "size"]

    def up_to(col: str, *by: str):
        return F.sum(col).over(Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))

    # words of each range; the range in which the remaining words are reached
    totals = live.groupBy("source", "_r_", "_rest_").agg(F.sum("size").alias("_words_"))
    totals = totals.withColumn("_before_", F.coalesce(up_to("_words_", "_r_"), F.lit(0)))
    cut = totals.where((F.col("_before_") < F.col("_rest_")) & (F.col("_before_") + F.col("_words_") >= F.col("_rest_")))
    cut = bounded(cut.select(F.col("source").alias("_cs_"), F.col("_r_").alias("_cr_"), "_before_"), "cut")
    # order only that range, by its different keys; documents go in as long as they fit, of one key as many as do
    inside = with_plan(live, cut, "_cs_").where(F.col("_r_") == F.col("_cr_"))
    keys = inside.groupBy("source", *key, "_before_", "_rest_").agg(F.count("*").alias("_n_"))
    keys = keys.withColumn("_all_", F.col("size") * F.col("_n_"))
    keys = keys.withColumn("_at_", F.col("_before_") + F.coalesce(up_to("_all_", *key), F.lit(0)))
    keys = keys.withColumn("_fit_", F.least(F.col("_n_"), F.floor((F.col("_rest_") - F.col("_at_")) / F.col("size")))).where("_fit_ > 0")
    last = keys.groupBy("source").agg(F.max(F.struct(F.struct(*key).alias("key"), "_fit_", "_n_")).alias("_m_")).select(F.col("source").alias("_ls_"), F.col("_m_.key").alias("_last_"), F.when(F.col("_m_._fit_") < F.col("_m_._n_"), F.col("_m_._fit_")).alias("_fit_"))
    mark = cut.join(last, F.col("_cs_").eqNullSafe(F.col("_ls_")), "left")
    mark = bounded(mark.select("_cs_", "_cr_", "_last_", "_fit_"), "mark")
    # where not all of the last key fit: their order by hashes of the rows' numbers, counted first, and in the hash at the cut by the numbers
    part = F.pmod(F.xxhash64(ROW), F.lit(RANGES)).cast("int")
    tied = with_plan(live, mark.where("_fit_ is not null"), "_cs_").where((F.col("_r_") == F.col("_cr_")) & (F.struct(*key) == F.col("_last_"))).select("source", "_fit_", ROW, part.alias("_p_"))
    parts = tied.groupBy("source", "_p_", "_fit_").agg(F.count("*").alias("_n_")).withColumn("_upto_", F.coalesce(up_to("_n_", "_p_"), F.lit(0)))
    parts = bounded(parts.where((F.col("_upto_") < F.col("_fit_")) & (F.col("_upto_") + F.col("_n_") >= F.col("_fit_"))).select(F.col("source").alias("_ps_"), F.col("_p_").alias("_cp_"), (F.col("_fit_") - F.col("_upto_")).alias("_need_")), "parts")
    least = with_plan(tied, parts, "_ps_").where(F.col("_p_") == F.col("_cp_")).withColumn("_place_", F.row_number().over(Window.partitionBy("source").orderBy(ROW))).where(F.col("_place_") == F.col("_need_"))
    least = bounded(least.select(F.col("source").alias("_ts_"), "_cp_", F.col(ROW).alias("_cw_")), "ties")
    # the cut is known for each source: what is taken so far, and the best filler of the gap
    marked = with_plan(with_plan(ranked, mark, "_cs_"), least, "_ts_")
    of_last = F.col("_fit_").isNull() | (part < F.col("_cp_")) | ((part == F.col("_cp_")) & (F.col(ROW) <= F.col("_cw_")))
    goes_in = live_row & (F.col("_cr_").isNull() | (F.col("_r_") < F.col("_cr_")) | ((F.col("_r_") == F.col("_cr_")) & ((F.struct(*key) < F.col("_last_")) | ((F.struct(*key) == F.col("_last_")) & of_last))))
    marked = marked.withColumn("_in_", F.coalesce(goes_in, F.lit(False)))
    had = marked.groupBy("source").agg((F.first("_rest_") - F.sum(F.when(F.col("_in_"), F.col("size")).otherwise(0))).alias("_gap_")).select(F.col("source").alias("_gs_"), "_gap_")
    had = bounded(had, "gaps")
    open_ = with_plan(marked.where(~F.col("_in_") & live_row), had, "_gs_")
    off = F.abs(F.col("_gap_") - F.col("size"))
    fill = open_.where((F.col("_gap_") > 0) & (off < F.col("_gap_"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), *key, ROW)).alias("_fill_"))
    fill = bounded(fill.select(F.col("source").alias("_fs_"), F.col(f"_fill_.{ROW}").alias("_fill_")), "fill")
    marked = with_plan(marked, fill, "_fs_")
    is_fill = F.coalesce(~F.col("_in_") & (F.col(ROW) == F.col("_fill_")), F.lit(False))
    copies = F.coalesce(F.col("_sure_"), F.lit(0)) + F.when(F.col("_in_") | is_fill, 1).otherwise(0)
    marked = marked.withColumn("copies", copies.cast("int")).withColumn("taken", (copies * F.col("size")).cast("long"))
    return marked.select(*[F.col(f"`{c}`") for c in own], *OUT)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number each; they have to be written before the numbers are used."""
    return rows.withColumn(ROW, F.monotonically_increasing_id())


def with_plan(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with a ``bounded`` table of at most one row for each source."""
    return look_up(rows, plan, "source", key)


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, seed: int = 0, keep: list[str] | None = None, tilt: float = TILT) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (and ``keep`` columns)."""
    keep = [c for c in keep or [] if c not in ("doc_id", "source", "size", ROW, *OUT)]
    rows = materialize(numbered(docs.select("doc_id", "source", sizes(docs).alias("size"), *keep)), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = materialize(targets(repeating_weights(sources, weights), most), "targets")
    return mix(rows, planned, seed, tilt)


#: DuckDB: the same mix over documents, with the same digests and the same order.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (WHERE size > 0) AS used FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lev
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, max(CASE WHEN lev * weight <= cap THEN lev END) OVER () AS level FROM l),
p AS (SELECT source, source_size, used, least(coalesce(level * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM t),
f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS fold FROM p),
g AS (SELECT *, floor(fold) AS sure, fold - floor(fold) AS share, target - floor(fold) * source_size AS rest FROM f),
u AS (SELECT d.row, d.doc_id, d.source, d.size, g.source_size, g.target, g.sure, g.share, g.rest, g.source_size / g.used AS mean,
      (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, CASE WHEN share > 0 AND size > 0 THEN (u / (1 - u)) / (share / (1 - share) * pow(size / mean, 0.5)) END AS ratio FROM u),
q AS (SELECT *, CASE WHEN share > 0 AND size > 0 THEN ratio / (1 + ratio) ELSE 1.0 END AS q FROM r),
a AS (SELECT *, CASE WHEN share > 0 AND size > 0 THEN coalesce(sum(size) FILTER (WHERE size > 0) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS reached FROM q),
i AS (SELECT *, share > 0 AND size > 0 AND reached + size <= rest AS fits FROM a),
k AS (SELECT *, fits AS goes_in FROM i),
h AS (SELECT source, first(rest) - coalesce(sum(size) FILTER (WHERE goes_in), 0) AS gap FROM k GROUP BY source),
e AS (SELECT k.source, arg_min(row, row(abs(gap - size), q, doc_id IS NOT NULL, doc_id, size, row)) AS fill FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source
      WHERE NOT goes_in AND share > 0 AND size > 0 AND gap > 0 AND abs(gap - size) < gap GROUP BY k.source)
SELECT k.doc_id, k.size, k.source_size, k.target,
  ((k.sure + CASE WHEN k.goes_in OR coalesce(k.row = e.fill, false) THEN 1 ELSE 0 END) * k.size)::BIGINT AS taken
FROM k LEFT JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""
