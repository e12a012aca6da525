"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity.

A window of an item's own number of words is laid over a document wherever the
two share a word shingle, with the shingle's places in both lined up; a window
that shares no shingle with an item has similarity 0 to it, so nothing is lost
by this. Each window and each item get a 64-bit SimHash of their words, cut into
four blocks of 16 bits. Fingerprints that differ in at most RADIUS bits differ in at
most a quarter of those in some block; each item asks for all values that near its
own in each block, so joining on (size, block, value) finds all pairs within the
radius, and only ids and fingerprints travel. Those pairs are verified by the
exact weighted Jaccard similarity of their shingle multisets.

The radius decides what can be missed. At a similarity of 0.8, at most a tenth of a
window's words differ, which turns 9 of 64 bits on average; RADIUS lies 3.7
standard deviations above.

All of it is DataFrame operations. Items come in blocks of bounded size, the
stated query set; each block is sent to all tasks and meets all documents.

Defined results: words are lower-cased runs other than ASCII white space; a
null or empty document is clean; an item of fewer words than a shingle counts as
one shingle; an item without words matches nothing; an empty benchmark leaves
all clean; an item is its item_id and words, so rows that share an item_id, or have
none, are all searched for, and n_items counts item_ids, or without one the texts;
repeated rows get equal results; extra columns pass through ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, materialize

SHINGLE, PERCENT, RADIUS, BITS, BLOCKS = 5, 80, 19, 64, 4
#: Shingles of items that are sent to tasks at once (about 24 bytes each).
BLOCK_SHINGLES = 400_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingles(seq: Column, k: int) -> Column:
    """Hash of each run of k words; none if there are fewer."""
    return F.when(F.size(seq) >= k, F.transform(F.sequence(F.lit(1), F.size(seq) - k + 1), lambda i: F.xxhash64(F.slice(seq, i, k)))).otherwise(F.array().cast("array<bigint>"))


def simhash(seq: Column) -> Column:
    """Each bit is the majority over the words' hashes, a word counting as often as it occurs."""
    hashes = F.transform(seq, lambda w: F.xxhash64(w))

    def vote(acc: Column, h: Column) -> Column:
        return F.transform(acc, lambda v, i: v + 2 * F.call_function("getbit", h, i) - 1)

    def spell(votes: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, i: F.when(F.element_at(votes, i + 1) > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(acc))

    return F.aggregate(hashes, F.array_repeat(F.lit(0), BITS), vote, spell)


def hamming_blocks(print_: Column, blocks: int = BLOCKS) -> Column:
    """One (block, bits) number for each block."""
    width = BITS // blocks
    return F.array(*[(F.lit(i << width) + F.shiftrightunsigned(print_, i * width).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for i in range(blocks)])


def hamming_probes(print_: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """All (block, bits) numbers that a fingerprint within the radius may have in a block that differs least."""
    width = BITS // blocks
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= radius // blocks)
    return F.flatten(F.transform(hamming_blocks(print_, blocks), lambda b: F.transform(near, lambda m: b.bitwiseXOR(m.cast("long")))))


def items(benchmark: DataFrame, k: int) -> DataFrame:
    rows = benchmark.select(F.col("item_id"), words(F.col("text")).alias("seq")).withColumn("item_key", F.xxhash64("seq")).withColumn("m", F.size("seq")).where("m > 0").withColumn("k", F.least("m", F.lit(k)))
    return rows


def windows(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Distinct windows (doc_id, text_key, start, m, k, seq) of ``docs`` (doc_id, text_key, seq) that share a k-word shingle with an item, aligned by it."""
    probes = wanted.select("m", F.posexplode(shingles(F.col("seq"), k)).alias("offset", "h")).distinct()
    # the outer form, as the inner one would push a filter on the size of the array, which splits texts again for every element
    at = docs.withColumn("hashes", shingles(F.col("seq"), k)).select("doc_id", "text_key", "seq", F.posexplode_outer("hashes").alias("pos", "h"))
    hit = at.join(F.broadcast(probes), "h")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.size("seq") - F.col("m")))
    hit = hit.select("doc_id", "text_key", start.alias("start"), "m", F.slice("seq", start + 1, F.col("m")).alias("seq"))
    return hit.distinct().withColumn("k", F.lit(k))


def matches(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, item_id, item_key, start, similarity) for every verified pair of a window and an item."""
    bench = materialize(items(benchmark, k), "items")
    total = bench.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    kinds = sorted(r[0] for r in bench.select("k").distinct().collect())  # 1 to k
    parts = max(1, -(-total // BLOCK_SHINGLES))
    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("seq"))
    found = None
    for part in range(parts):
        block = bench.where(F.pmod(F.xxhash64("item_id", "item_key"), F.lit(parts)) == part)
        for n in kinds:
            own = block.where(F.col("k") == n)
            laid = windows(source, own, n)
            found = laid if found is None else found.unionByName(laid)
    if found is None:
        found = source.select("doc_id", "text_key", F.lit(0).alias("start"), F.lit(0).alias("m"), "seq", F.lit(k).alias("k")).limit(0)
    # windows of the same words are compared once
    found = materialize(found.withColumns({"w1": F.xxhash64("seq"), "w2": F.xxhash64(F.lit(1), "seq")}), "laid")
    window, item = ["m", "k", "w1", "w2"], ["item_id", "item_key"]
    distinct = materialize(found.select(*window, "seq").dropDuplicates(window).withColumn("print", simhash(F.col("seq"))), "windows")
    queries = materialize(bench.select(*item, "m", "k", F.col("seq").alias("item_seq"), simhash(F.col("seq")).alias("item_print")).dropDuplicates(item), "prints")
    left = distinct.select(*window, "print", F.explode(hamming_blocks(F.col("print"))).alias("block"))
    right = queries.select(*item, "m", "k", "item_print", F.explode(hamming_probes(F.col("item_print"), radius)).alias("block"))
    # probes are many for each item, so they are never sent whole
    near = left.join(right.hint("merge"), ["m", "k", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    pair = [*window, *item]
    near = materialize(near.select(*pair).distinct(), "near")
    # the words of both, for pairs within the radius alone
    near = near.join(distinct.select(*window, "seq"), window)
    near = near.join(queries.select(F.col("item_id").alias("_i_"), F.col("item_key").alias("_ik_"), "item_seq"), F.col("item_id").eqNullSafe(F.col("_i_")) & (F.col("item_key") == F.col("_ik_")))
    both = None
    for n in kinds or [k]:
        own = near.where(F.col("k") == n)
        tag = lambda seq, a, b: own.select(*pair, F.explode(shingles(F.col(seq), n)).alias("h"), F.lit(a).alias("x"), F.lit(b).alias("y"))  # noqa: B023, E731
        rows = tag("seq", 1, 0).unionByName(tag("item_seq", 0, 1))
        both = rows if both is None else both.unionByName(rows)
    counts = both.groupBy(*pair, "h").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    scored = counts.groupBy(*pair).agg(F.sum(F.least("x", "y")).alias("common"), F.sum(F.greatest("x", "y")).alias("all"))
    passed = materialize(scored.where(100 * F.col("common") >= percent * F.col("all")).select(*pair, (F.col("common") / F.col("all")).alias("similarity")), "passed")
    return found.select("doc_id", "text_key", "start", *window).join(passed, window).select("doc_id", "text_key", *item, "start", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``keep`` columns of every document, with contaminated, n_items and similarity (the largest)."""
    keep = docs.columns if keep is None else keep
    item = F.struct("item_id", F.when(F.col("item_id").isNull(), F.col("item_key")).alias("item_key"))
    best = matches(docs, benchmark, k, percent).groupBy("doc_id", "text_key").agg(F.countDistinct(item).alias("n_items"), F.max("similarity").alias("similarity"))
    best = materialize(best.select(F.col("doc_id").alias("_id_"), F.col("text_key").alias("_tk_"), "n_items", "similarity"), "contaminated")
    left = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("doc_id").alias("_d_"), F.xxhash64("text").alias("_k_"))
    out = left.join(best, F.col("_d_").eqNullSafe(F.col("_id_")) & (F.col("_k_") == F.col("_tk_")), "left")
    return out.select(*[left[f"`{c}`"] for c in keep], F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce(best["similarity"], F.lit(0.0)).alias("similarity"))


#: DuckDB: windows where a shingle is shared, then the exact similarity of all of them.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS seq FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS seq FROM benchmark),
ds AS (SELECT doc_id, len(seq) AS n, unnest(range(1, len(seq) - 3)) AS pos, seq FROM d WHERE len(seq) >= 5),
dp AS (SELECT doc_id, n, pos, array_to_string(seq[pos : pos + 4], ' ') AS h FROM ds),
bs AS (SELECT item_id, len(seq) AS m, unnest(range(1, len(seq) - 3)) AS pos, seq FROM b WHERE len(seq) >= 5),
bp AS (SELECT item_id, m, pos, array_to_string(seq[pos : pos + 4], ' ') AS h FROM bs),
w AS (SELECT DISTINCT doc_id, item_id, m, greatest(1, least(dp.pos - bp.pos + 1, n - m + 1)) AS start FROM dp JOIN bp USING (h)),
x AS (SELECT w.doc_id, w.item_id, w.start, dp.h, count(*) AS x, 0 AS y FROM w JOIN dp ON w.doc_id = dp.doc_id AND dp.pos BETWEEN w.start AND w.start + w.m - 5 GROUP BY ALL
      UNION ALL SELECT w.doc_id, w.item_id, w.start, bp.h, 0, count(*) FROM w JOIN bp ON w.item_id = bp.item_id GROUP BY ALL),
c AS (SELECT doc_id, item_id, start, h, sum(x) AS x, sum(y) AS y FROM x GROUP BY ALL),
s AS (SELECT doc_id, item_id, start, sum(least(x, y)) AS common, sum(greatest(x, y)) AS every FROM c GROUP BY ALL HAVING 100 * sum(least(x, y)) >= 80 * sum(greatest(x, y))),
r AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(common::DOUBLE / every::DOUBLE) AS similarity FROM s GROUP BY doc_id)
SELECT d.doc_id, r.n_items IS NOT NULL AS contaminated, coalesce(r.n_items, 0)::BIGINT AS n_items, coalesce(r.similarity, 0.0) AS similarity FROM documents d LEFT JOIN r USING (doc_id)
"""
