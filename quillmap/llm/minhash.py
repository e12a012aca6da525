"""Near-duplicate detection by circulant MinHash, bands and exact Jaccard verification.

Two permutations make a whole signature: the first scatters shingles over a
universe of 2**18 places, the second, circularly shifted by k, ranks them for
coordinate k. A row of shifted ranks is contiguous in memory, so all
coordinates of a shingle are one read.

Documents with equal shingle sets form a class and are linked outright. Class
representatives that share a band are compared, first with one member of each
bucket (a star around the member that meets most others), and then, for buckets
that still hold more than one component, across those components. Such a pair is
emitted only if its odd sketches allow the similarity: a bit of the sketch is the
parity of the shingles that fall on it, so bits that differ never outnumber the
shingles that differ, and the test loses no link. So every pair that shares a
band is compared on its full sets, proven too different, or known to be in one
component already, and no bucket emits all its pairs. A large bucket's pairs are dealt
over a square of cells by hashes of both members.

The graph's nodes are classes, named by a hash of the doc_id and text of their
first row, so texts that share a doc_id are separate. A component is named by its
least doc_id only at the end, and its first row by (doc_id, text) is the one to keep.

Defined results: null or empty texts (or ones of white space) have 0 shingles,
are their own component and link with nothing; rows with a null doc_id come last
in their component, so ``groups`` gives a first row to them too, and
``near_duplicates`` a null component and kept; repeated rows share a component and
its mark; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize
from .graph import connected_components

UNIVERSE = 1 << 18
#: Rows of a band, and the chance that a pair right at the threshold shares none.
ROWS, MISS = 5, 2e-5
#: Longs of an odd sketch, and members on a side of a cell of pairs (about).
SKETCH, CELL = 32, 512
_CACHE: dict = {}


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the ranking one as rows: row i holds its values at i, i + 1, ... around the circle."""
    if coordinates not in _CACHE:
        rng = np.random.default_rng(20240229)
        first, second = rng.permutation(UNIVERSE), rng.permutation(UNIVERSE).astype(np.uint32)
        ring = np.concatenate([second, second[:coordinates]])
        _CACHE[coordinates] = first, np.lib.stride_tricks.sliding_window_view(ring, coordinates)
    return _CACHE[coordinates]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    first, rows = permutations(coordinates)
    places = first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    best = np.full(coordinates, UNIVERSE, np.uint32)
    for a in range(0, len(places), 4096):
        np.minimum(best, rows[places[a : a + 4096]].min(0), out=best)
    return best


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = K.mix(key ^ sign[j::rows][:bands].astype(np.uint64)) * np.uint64(0xD1342543DE82EF95)
    return K.mix(key).view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a sorted shingle set."""
    i = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    parts = [int(np.bitwise_xor.reduce(K.mix(shingles * np.uint64(m) + i))) for m in (0x9FB21C651E98DF25, 0xA24BAED4963EE407)]
    return b"".join(p.to_bytes(8, "big") for p in parts)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    places = (shingles >> np.uint64(40)).astype(np.int64) % (64 * SKETCH)
    return np.packbits((np.bincount(places, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, prints, keys, odd = [], [], [], []
            for _, _, buf, offsets in K.slices(b.column(2)):
                for s in K.shingle_sets(buf, offsets, k):
                    sizes.append(len(s))
                    odd.append(odd_sketch(s))
                    prints.append(fingerprint(s) if len(s) else None)
                    keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1) * SKETCH, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *odd])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists, sketches], ["doc_id", "text_key", "n_shingles", "print", "bands", "sketch"])

    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return inputs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, print binary, bands array<long>, sketch array<long>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            a, b, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for lo in range(0, len(a), 200):
                part = batch.slice(lo, 200)
                theirs = [s for _, _, buf, offsets in K.slices(part.column(3)) for s in K.shingle_sets(buf, offsets, k)]
                for i, other in enumerate(theirs):
                    if (a[lo + i], part.column(2)[i].as_py()) != last:
                        own = part.column(2).slice(i, 1)
                        last = (a[lo + i], own[0].as_py())
                        kept = next(s for _, _, buf, offsets in K.slices(own) for s in K.shingle_sets(buf, offsets, k))
                    common = len(np.intersect1d(kept, other, assume_unique=True))
                    good.append(100 * common >= percent * (len(kept) + len(other) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    full = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text")
    return full.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles and first (lost, doc_id, text_key), the first row of its component; null for a class of one row without links."""
    bands = bands_for(percent, rows, miss)
    node = F.xxhash64("doc_id", "text_key").alias("node")
    signed = materialize(signatures(docs, k, bands, rows, id_col, text), "signatures")
    own = [F.col("doc_id").isNull().alias("lost"), F.col("doc_id"), F.col("text_key")]
    classes = signed.where("print is not null").groupBy("print").agg(F.min(F.struct(*own, "n_shingles", "bands", "sketch")).alias("m"), F.count("*").alias("copies"))
    classes = materialize(classes.select("print", "copies", "m.*").select("*", node), "classes")

    # buckets with more than one class; the member with the largest buckets in all is the centre of a star.
    # What is grouped by bucket is written before it is joined, so that Spark can split a large bucket in the join.
    placed = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = materialize(placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    members = materialize(placed.join(shared, "bucket"), "members")
    degree = members.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = members.join(degree, "node")
    close = F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    heads = ranked.groupBy("bucket").agg(F.max(F.struct("degree", F.struct(F.col("node").alias("a"), F.col("n").alias("a_n")).alias("head"))).alias("m")).select("bucket", "m.head.*")
    heads = materialize(heads, "heads")
    star = members.select("bucket", F.col("node").alias("b"), F.col("n").alias("b_n")).join(heads, "bucket").where("a <> b")
    star = star.where(close).select("a", "b").distinct()
    wanted = members.select("node").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")).select(node, "text")
    # by a merge at every size, so that what is shuffled grows with the input
    texts = materialize(texts.join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "texts")
    links = materialize(verify(star, texts, k, percent), "links")
    found = connected_components(links)

    # buckets that still hold several components: compare what is outside the largest one with all that is in another
    named = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select("bucket", "component", "node", "n"), "named")
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("m"), F.sum("size").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    main = materialize(main.select("bucket", F.col("m.component").alias("main"), F.ceil(F.col("members") / CELL).cast("int").alias("cells")), "main")
    mixed = materialize(named.join(main, "bucket").join(classes.select("node", "sketch"), "node"), "mixed")
    # a bucket's pairs form a square of cells, each compared by itself, so none is a task's whole work
    own, every = F.pmod(F.xxhash64("node"), F.col("cells")), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("across")
    one = mixed.where("component <> main").select("bucket", own.alias("row"), every, F.col("component").alias("p"), F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    two = mixed.select(F.col("bucket").alias("b_bucket"), own.alias("column"), every, F.col("component").alias("q"), "main", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    two = two.withColumnRenamed("across", "b_row")
    differ = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    # similarity t allows (1 - t) / (1 + t) of both sizes to differ
    allowed = (100 + percent) * differ <= (100 - percent) * (F.col("a_n") + F.col("b_n"))
    cell = (F.col("bucket") == F.col("b_bucket")) & (F.col("row") == F.col("b_row")) & (F.col("across") == F.col("column"))
    apart = cell & (F.col("p") != F.col("q")) & ((F.col("q") == F.col("main")) | (F.col("a") < F.col("b")))
    more = one.join(two, apart & close & allowed)
    more = materialize(verify(more.select("a", "b").distinct(), texts, k, percent), "links")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))

    named = classes.join(found, "node", "left").where("copies > 1 or component is not null")
    named = materialize(named.select("print", F.coalesce("component", "node").alias("component"), F.struct("lost", "doc_id", "text_key").alias("own")), "components")
    first = materialize(named.groupBy("component").agg(F.min("own").alias("first")), "first")
    return signed.select("doc_id", "text_key", "n_shingles", "print").join(named.join(first, "component").select("print", "first"), "print", "left").drop("print")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (the component's first row by doc_id and text)."""
    out = groups(docs, k, percent, rows, miss, id_col, text)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    kept = F.col("doc_id").isNull() | F.col("first").isNull() | is_first()
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def is_first() -> Column:
    """Whether a row of ``groups`` is the first of its component; null without one."""
    return F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
