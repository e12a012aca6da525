"""Ranked lexical search: postings in windows of doc_ids, scattered into small arrays, harvested into heaps.

The index holds every term of every document. It is a table of windows: up to WINDOW
documents in the order of their doc_ids, with their ids and numbers of terms, and for each of
their different terms a posting list of places in the window and frequencies. It is
built in one pass over the texts, without a shuffle, written once and read for all blocks
of queries; document frequencies come from the lengths of its lists alone.

A block of query items, bounded by its number of terms, goes to all tasks. A task
takes window after window: it reads the posting lists of the block's terms, turns them
to scores, and for each item scatter-adds the item's lists into an array of one
window, which a core's first cache holds, and marks in a bitset which places were met. Marked
places that beat the least of the item's heap go into it. A task gives at most ``k``
documents for each item, and the best of them are found in two rounds, so no key gathers more
than its share. Windows, not keys, are the unit of work, so no doc_id or term is hot.

Defined results: a null or empty text has no term and is never found; rows that share a
doc_id are documents of their own; a null doc_id comes last among equal scores; rows of
queries that share an item_id, or have none, are one item with the terms of all; an
item without terms, or with none that occurs, gives no rows; scores are 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

TOP, WINDOW = 50, 4096
#: Pairs of item and term in a block of queries (about), windows in a file of the index, and parts that an item's best are first ranked in.
BLOCK_TERMS, FILE_WINDOWS, PARTS = 200_000, 64, 32
#: The score's numbers: a term's weight, the length's part in the norm, the frequency's scale.
SCALE, LENGTH_PERCENT, SATURATION, UNIT = 1000, 50, 20, 1_000_000_000
IS_TERM = np.zeros(256, bool)
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True
INDEX = "ids array<long>, sizes array<int>, terms array<long>, ends array<int>, places array<short>, freqs array<int>, n_docs long, n_terms long"


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of the texts of a slice, and for each text the index of its first."""
    low = K.TO_LOWER[buf]
    starts, ends, first = K.spans(IS_TERM[low], offsets)
    return K.span_hashes(low, starts, ends), first


def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows, written: a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, buf, offsets in K.slices(b.column(1)):
                hashes, first = terms_of(buf, offsets)
                n = np.diff(first)
                own = ids.slice(lo, hi - lo)
                order = np.array(pc.sort_indices(own), np.int64)  # nulls last
                order = order[n[order] > 0]
                for a in range(0, len(order), WINDOW):
                    docs = order[a : a + WINDOW]
                    at = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(n[docs])[:-1]]), n[docs]) + np.arange(n[docs].sum())
                    terms, number = np.unique(hashes[at], return_inverse=True)
                    pair, freq = np.unique(number * WINDOW + np.repeat(np.arange(len(docs)), n[docs]), return_counts=True)
                    ends = np.searchsorted(pair, np.arange(1, len(terms) + 1) * WINDOW)
                    row = [own.take(pa.array(docs)), n[docs].astype(np.int32), terms.view(np.int64), ends.astype(np.int32), (pair % WINDOW).astype(np.int16), freq.astype(np.int32)]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in row]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([len(docs)], pa.int64()), pa.array([int(n[docs].sum())], pa.int64())], ["ids", "sizes", "terms", "ends", "places", "freqs", "n_docs", "n_terms"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, INDEX), "index", maxRecordsPerFile=FILE_WINDOWS)


def query_terms(queries: DataFrame, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the different terms of each item."""
    kind = queries.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, buf, offsets in K.slices(b.column(1)):
                hashes, first = terms_of(buf, offsets)
                owner = np.repeat(np.arange(lo, lo + len(offsets) - 1), np.diff(first))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    rows = queries.select(F.col(item_col).alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, term long").distinct()


class Block:
    """Items (each with the numbers of its terms) and the sorted terms, as one small object that tasks get."""

    def __init__(self, pairs: list) -> None:
        self.items = sorted({r["item_id"] for r in pairs}, key=lambda i: (i is not None, i if i is not None else 0))
        number = {x: i for i, x in enumerate(self.items)}
        self.terms = np.array(sorted({r["term"] & K.MASK for r in pairs}), np.uint64)
        place = {int(t): i for i, t in enumerate(self.terms)}
        held: list[list[int]] = [[] for _ in self.items]
        for r in pairs:
            held[number[r["item_id"]]].append(place[r["term"] & K.MASK])
        self.held = [np.array(sorted(x), np.int64) for x in held]
        self.weights = np.zeros(len(self.terms), np.int64)


def met(terms: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The wanted terms that a window has, and where their posting lists begin and end."""
    if not len(terms):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    has = np.flatnonzero(terms[at] == wanted)
    at = at[has]
    return has, np.where(at > 0, ends[at - 1], 0), ends[at]


def frequencies(index: DataFrame, block: Block) -> dict[int, int]:
    """Documents that hold each of the block's terms."""
    wanted = block.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                has, lo, hi = met(b.column(0)[i].values.to_numpy().view(np.uint64), b.column(1)[i].values.to_numpy(), wanted)
                total[has] += hi - lo
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    per = index.select("terms", "ends").mapInArrow(run, "term long, df long")
    return {r["term"]: r["df"] for r in per.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def best(index: DataFrame, block: Block, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """(item_id, doc_id, score): each task's best ``k`` for each item of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        heaps: list[list[tuple]] = [[] for _ in own.items]
        scores, seen = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].values  # noqa: B023, E731
                ids = get("ids")
                has, lo, hi = met(get("terms").to_numpy().view(np.uint64), get("ends").to_numpy(), own.terms)
                places, freqs = get("places").to_numpy().astype(np.int64), get("freqs").to_numpy().astype(np.int64)
                norm = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * get("sizes").to_numpy().astype(np.int64) * n_docs) // n_terms
                # posting lists of the block's terms, with each posting's part of a score
                lists: list = [None] * len(own.terms)
                for t, x, y in zip(has.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    at, f = places[x:y], freqs[x:y]
                    lists[t] = at, own.weights[t] * ((UNIT * f) // (SCALE * f + SATURATION * norm[at]))
                for item, terms in enumerate(own.held):
                    for t in terms.tolist():
                        if lists[t] is not None:
                            at, part = lists[t]
                            scores[at] += part  # a list has a place once
                            seen[at] = True
                    found = np.flatnonzero(seen)
                    if not len(found):
                        continue
                    heap = heaps[item]
                    good = found[scores[found] >= (heap[0][0] if len(heap) >= k else 1)]
                    if len(good) > k:  # no more than k of a window can stay
                        good = good[np.lexsort((good, -scores[good]))[:k]]
                    for j in good.tolist():
                        doc = ids[j].as_py()
                        entry = (int(scores[j]), -doc if doc is not None else -math.inf, doc)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry[:2] > heap[0][:2]:
                            heapq.heapreplace(heap, entry)
                    scores[found], seen[found] = 0, False
        rows = [(own.items[i], doc, score) for i, heap in enumerate(heaps) for score, _, doc in heap]
        for a in range(0, len(rows), 10_000):
            part = list(zip(*rows[a : a + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], kinds), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], ["item_id", "doc_id", "score"])

    kinds = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    return index.select("ids", "sizes", "terms", "ends", "places", "freqs").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = TOP, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, among those of a score above 0."""
    pairs = materialize(query_terms(queries, item_col, text), "queries")
    kind = pairs.schema["item_id"].dataType.simpleString()
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    found = None
    for part in range(blocks):
        block = Block(pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == part).collect())
        df = frequencies(index, block)
        block.weights = np.array([math.floor(SCALE * math.log((2 * total["docs"] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(block.terms))], np.int64)
        own = best(index, block, total["docs"], total["terms"], k, kind)
        found = own if found is None else found.unionByName(own)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: DuckDB: every term of every document, joined with the items' terms.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
b AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
n AS (SELECT row, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM d GROUP BY row),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
t AS (SELECT row, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM b) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, docs),
m AS (SELECT row, doc_id, 50 + (50 * n * docs) // terms AS m FROM n, s),
x AS (SELECT item_id, m.row, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM b JOIN t USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
