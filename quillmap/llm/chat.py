"""Chat formatting with cumulative-snapshot collapse.

Logged conversations often hold earlier snapshots of longer ones. A rolling
hash of a conversation's first k turns, for every k, tells whether another
conversation is one of its prefixes; an anti-join keeps the maximal ones (and
of equal conversations the one with the least conv_id), which are then rendered.

The hash of a prefix is the exclusive or of 128-bit hashes of (place, role,
text). All of this is done on hashes alone: distinct turns are dealt by ranges of
(conversation, number, hashes), so a very long conversation, and also one whose
turns all have one number, is spread over many tasks; places and prefixes are
found inside each range's part of a conversation and carried over by totals of those
parts. Texts are joined by their hashes, once, for the conversations that stay.
Rendering makes one row for each 256 turns.

Defined results: turns without a conv_id belong to no conversation and are left
out; a null turn number sorts as -1; exact repeats of a turn (same number, role
and text) count once; different turns with one number are ordered by their
hashes; null roles render as ``unknown`` and null texts as empty ones; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SEGMENT = 256


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, role, text) of turns that belong to a conversation."""
    said = [F.coalesce(F.col("role"), F.lit("")), F.col("role").isNull(), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()]
    return turns.where("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit("second"), *said).alias("h2"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, part, turn, h1, h2, place, n_turns, p1, p2): each distinct turn with its place from 1 and the hash of the prefix that ends with it."""
    rows = hashed(turns).select("conv_id", "turn", "h1", "h2").distinct()
    rows = materialize(rows.repartitionByRange("conv_id", "turn", "h1", "h2").withColumn("part", F.spark_partition_id()), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    offsets = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("n_turns"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "h1", "h2")
    placed = rows.withColumn("at", F.row_number().over(inside)).join(offsets, ["conv_id", "part"]).withColumn("place", F.col("at") + F.col("skip"))
    placed = placed.withColumn("x1", F.xxhash64("place", "h1", "h2")).withColumn("x2", F.xxhash64("h2", "place", "h1"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(placed.select("conv_id", "part", "turn", "h1", "h2", "place", "n_turns", "skip", F.bit_xor("x1").over(upto).alias("y1"), F.bit_xor("x2").over(upto).alias("y2")), "placed")
    # a part's last prefix carries over to the parts after it
    last = placed.groupBy("conv_id", "part").agg(F.max(F.struct("place", "y1", "y2")).alias("l")).select("conv_id", "part", "l.*")
    carry = last.select("conv_id", "part", F.coalesce(F.bit_xor("y1").over(before), F.lit(0)).alias("c1"), F.coalesce(F.bit_xor("y2").over(before), F.lit(0)).alias("c2")).where("c1 <> 0 or c2 <> 0")
    out = placed.join(carry, ["conv_id", "part"], "left")
    return out.select("conv_id", "part", "turn", "h1", "h2", "place", "n_turns", F.col("y1").bitwiseXOR(F.coalesce("c1", F.lit(0))).alias("p1"), F.col("y2").bitwiseXOR(F.coalesce("c2", F.lit(0))).alias("p2"))


def maximal(marked: DataFrame) -> DataFrame:
    """conv_id of conversations that are no proper prefix of another and first among equal ones."""
    ends = marked.where("place = n_turns").groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    inner = marked.where("place < n_turns").select("place", "p1", "p2").distinct()
    return ends.join(inner, ["place", "p1", "p2"], "left_anti").select("conv_id")


def render(turns: DataFrame, marked: DataFrame, kept: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, n_turns, text): turns between role markers, one row for each ``segment`` turns."""
    parts = marked.select("conv_id", "part").distinct().join(kept, "conv_id", "left_semi")
    own = marked.join(parts, ["conv_id", "part"], "left_semi").select("conv_id", "turn", "h1", "h2", "place", "n_turns", F.floor((F.col("place") - 1) / segment).alias("segment"))
    # a turn that is repeated is one before it is shuffled
    key = ["conv_id", "turn", "h1", "h2"]
    texts = hashed(turns).groupBy(*key).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    turn = lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>\n"))
    # a group has at most ``segment`` turns
    grouped = texts.join(own, key).groupBy("conv_id", "segment").agg(F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    return grouped.select("conv_id", "segment", "n_turns", F.array_join(F.transform("turns", turn), "").alias("text"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    marked = materialize(prefixes(turns), "prefixes")
    return render(turns, marked, materialize(maximal(marked), "maximal"))


#: DuckDB: whole prefixes, as strings, in place of hashes.
SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER o AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
      string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) || chr(3), '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE place = n_turns GROUP BY prefix),
k AS (SELECT conv_id FROM e WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n_turns))
SELECT conv_id, ((place - 1) // 256)::BIGINT AS segment, any_value(n_turns)::BIGINT AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM p WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id, (place - 1) // 256
"""
