"""Reversible line deduplication: cuckoo filters in shards, backed by exact reference counts.

The state is a table of line keys (128 bits) with the number of documents that
hold each, and for each shard of keys a cuckoo filter of those keys whose count
has reached the threshold. Inserting documents adds to counts and deleting them
subtracts, and keys that cross the threshold enter or leave their shard's
filter; so a deletion undoes an insertion. A filter that is full is made anew,
larger, from its shard's frequent keys; when shards hold more than SHARD_KEYS on
average, all filters are made anew from the counts, over more shards.

To clean documents, each line asks the filters first: they go to all tasks up to
a bounded size, and beyond it lines and filters are grouped by shard. What the
filters let through is checked against the exact counts, so false positives
never drop a line. A key is two independent 64-bit hashes; with 10**12 different
lines, the chance that any two share a key is below 10**-14.

Defined results: a null or empty text has one empty line, which is never
dropped as its key has no character; white space at the ends and the case of
A-Z do not matter; a document is a row, so rows that repeat a doc_id each count
as one, whether or not their texts are equal; null doc_ids are kept as they are;
extra columns pass through ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

LEAST_DOCS = 10
#: Keys of a shard (about), most bytes of filters that are sent to all tasks, and lines of a group beyond that (about).
SHARD_KEYS, BLOCK_BYTES, GROUP_LINES = 200_000, 32 << 20, 1_000_000
#: Slots of a bucket, and parts that a line's copies are dealt over when checked.
SLOTS, SALTS = 4, 16
KEY = ["key1", "key2"]


class Cuckoo:
    """A filter of 64-bit keys: 16-bit prints in buckets of four, each print in one of two buckets."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.84))))), SLOTS), np.uint16))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = K.mix(keys.view(np.uint64) + np.uint64(0x51ED270B7F4A7C15))
        prints = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        mask = len(self.table) - 1
        first = (h & np.uint64(mask)).astype(np.int64)
        return prints, first, first ^ self.hop(prints)

    def hop(self, prints: np.ndarray) -> np.ndarray:
        """Distance between a print's two buckets; a function of the print alone."""
        return (K.mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(keys)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray, seed: int = 1) -> bool:
        """False if the filter is too full; it must then be rebuilt larger from the exact counts.

        All keys go at once, as far as their buckets have room; then to their other
        bucket; then one key of each full bucket takes the place of a random print, and
        what is left over moves on.
        """
        rng = np.random.default_rng(seed)
        prints, at, _ = self.places(keys)
        for turn in range(500):
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            new = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            room = np.cumsum(self.table[at] == 0, 1)
            fits = rank < room[:, -1]
            slot = np.argmax(room[fits] == rank[fits, None] + 1, 1)
            self.table[at[fits], slot] = prints[fits]
            prints, at = prints[~fits], at[~fits]
            if not len(prints):
                return True
            if turn:
                own = np.unique(at, return_index=True)[1]
                j = rng.integers(SLOTS, size=len(own))
                prints[own], self.table[at[own], j] = self.table[at[own], j], prints[own]
            at = at ^ self.hop(prints)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted; one print of each goes."""
        for p, a, b in zip(*self.places(keys), strict=True):
            for i in (a, b):
                hit = np.flatnonzero(self.table[i] == p)
                if len(hit):
                    self.table[i, hit[0]] = 0
                    break

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        room = len(keys)
        while not (made := cls.sized(room)).insert(keys):
            room *= 2
        return made


def with_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and a hash of the text name a row; rows that share both have the same lines."""
    return docs.withColumn("_key_", F.xxhash64(text))


def line_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line with a key: doc_id, text_key, line (from 0), key1, key2, and first (the key's first line in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in K.slices(b.column(2)):
                low = K.TO_LOWER[buf]
                starts, ends, first = K.lines(low, offsets)
                number = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))
                owner = np.repeat(np.arange(lo, hi), np.diff(first))
                starts, ends = K.stripped(low, starts, ends)
                some = ends > starts
                starts, ends, number, owner = starts[some], ends[some], number[some], owner[some]
                one = K.span_hashes(low, starts, ends)
                two = K.span_hashes(low, starts, ends, 1)
                order = np.lexsort((number, two, one, owner))
                new = np.ones(len(order), bool)
                new[1:] = (owner[order[1:]] != owner[order[:-1]]) | (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
                is_first = np.zeros(len(order), bool)
                is_first[order[new]] = True
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(number, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(is_first)], ["doc_id", "text_key", "line", "key1", "key2", "first"])

    inputs = with_key(docs, text).select(F.col(id_col).cast("long").alias("doc_id"), F.col("_key_").alias("text_key"), F.col(text).alias("text"))
    return inputs.mapInArrow(run, "doc_id long, text_key long, line int, key1 long, key2 long, first boolean")


class LineIndex:
    """Reference counts of line keys and the filters of frequent ones. Each change gives a new index; earlier ones stay readable."""

    def __init__(self, counts: DataFrame, filters: DataFrame, shards: int, least_docs: int) -> None:
        self.counts, self.filters, self.shards, self.least_docs = counts, filters, shards, least_docs

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 16, least_docs: int = LEAST_DOCS) -> LineIndex:
        return cls(spark.createDataFrame([], "key1 long, key2 long, n long"), spark.createDataFrame([], "shard int, filter binary"), shards, least_docs)

    @classmethod
    def build(cls, lines: DataFrame, least_docs: int = LEAST_DOCS) -> LineIndex:
        return cls.of_counts(materialize(lines.where("first").groupBy(*KEY).agg(F.count("*").alias("n")), "counts"), least_docs)

    @classmethod
    def of_counts(cls, counts: DataFrame, least_docs: int = LEAST_DOCS, room: int = 1) -> LineIndex:
        """An index with filters made from the counts; ``room`` times as many shards as the keys need now."""
        often = counts.where(F.col("n") >= least_docs)
        shards = max(1, -(-often.count() * room // SHARD_KEYS))

        def make(key, group):
            keys = np.sort(group.column("key1").to_numpy())
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([Cuckoo.of(keys).dump()], pa.binary())})

        sharded = often.select("key1", shard_of(shards))
        filters = materialize(sharded.groupBy("shard").applyInArrow(make, "shard int, filter binary"), "filters")
        return cls(counts, filters, shards, least_docs)

    def insert(self, lines: DataFrame) -> LineIndex:
        return self._change(lines, 1)

    def delete(self, lines: DataFrame) -> LineIndex:
        return self._change(lines, -1)

    def _change(self, lines: DataFrame, sign: int) -> LineIndex:
        delta = lines.where("first").groupBy(*KEY).agg((F.count("*") * sign).alias("d"))
        both = self.counts.select(*KEY, F.col("n").alias("old"), F.lit(0).cast("long").alias("d")).unionByName(delta.select(*KEY, F.lit(0).cast("long").alias("old"), "d"))
        changed = materialize(both.groupBy(*KEY).agg(F.sum("old").alias("old"), F.greatest(F.sum("old") + F.sum("d"), F.lit(0)).alias("n")), "counts")
        counts = changed.where("n > 0").select(*KEY, "n")
        least, shards = self.least_docs, self.shards
        if counts.where(F.col("n") >= least).count() > SHARD_KEYS * shards:
            return LineIndex.of_counts(counts, least, room=2)
        # a shard's frequent keys of both times: what crosses changes the filter, and all of them make a larger one if it is full
        often = changed.where((F.col("old") >= least) | (F.col("n") >= least)).select("key1", (F.col("old") >= least).alias("was"), (F.col("n") >= least).alias("now"), shard_of(shards))

        def update(key, old, moves):
            table = Cuckoo.load(old.column("filter")[0].as_py()) if old.num_rows else Cuckoo.sized(1024)
            keys = moves.column("key1").to_numpy()
            was, now = (moves.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("was", "now"))
            table.delete(keys[was & ~now])
            if not table.insert(keys[now & ~was]):
                table = Cuckoo.of(np.sort(keys[now]))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([table.dump()], pa.binary())})

        filters = materialize(self.filters.groupBy("shard").cogroup(often.groupBy("shard")).applyInArrow(update, "shard int, filter binary"), "filters")
        return LineIndex(counts, filters, shards, least)

    def frequent(self, lines: DataFrame) -> DataFrame:
        """The lines whose key is in at least ``least_docs`` documents.

        Filters of up to BLOCK_BYTES in all go to the tasks, so most lines never leave
        theirs. Beyond that, lines meet their shard's filter in a grouping of both, a
        shard's lines dealt over as many groups as keep each at about GROUP_LINES.
        """
        r = self.filters.agg(F.sum(F.length("filter")).alias("size"), F.count("*").alias("n")).first()
        if not r["n"]:
            return lines.select("doc_id", "text_key", "line").limit(0)
        asked = lines.select("doc_id", "text_key", "line", *KEY, shard_of(self.shards))
        passed = self._ask_sent(asked) if r["size"] <= BLOCK_BYTES else self._ask_grouped(asked)
        # what passed is checked against the exact counts; a very common line is dealt over SALTS tasks
        exact = self.counts.where(F.col("n") >= self.least_docs).select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        passed = passed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "line"), F.lit(SALTS)).cast("int"))
        return passed.join(exact, [*KEY, "salt"]).select("doc_id", "text_key", "line")

    def _ask_sent(self, asked: DataFrame) -> DataFrame:
        raw = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}
        sent = asked.sparkSession.sparkContext.broadcast(raw)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = {s: Cuckoo.load(x) for s, x in sent.value.items()}
            for b in batches:
                keys = b.column("key1").to_numpy()
                shard = b.column("shard").to_numpy()
                hit = np.zeros(len(keys), bool)
                for s, t in tables.items():
                    own = np.flatnonzero(shard == s)
                    hit[own] = t.has(keys[own])
                yield b.filter(pa.array(hit))

        return asked.mapInArrow(ask, asked.schema)

    def _ask_grouped(self, asked: DataFrame) -> DataFrame:
        parts = max(1, -(-asked.count() // (self.shards * GROUP_LINES)))
        part = F.pmod(F.xxhash64("doc_id", "text_key", "line"), F.lit(parts)).cast("int").alias("part")
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "filter")

        def ask(key, old: pa.Table, rows: pa.Table) -> pa.Table:
            hit = Cuckoo.load(old.column("filter")[0].as_py()).has(rows.column("key1").to_numpy()) if old.num_rows else np.zeros(rows.num_rows, bool)
            return rows.filter(pa.array(hit)).drop_columns(["part"])

        return filters.groupBy("shard", "part").cogroup(asked.select("*", part).groupBy("shard", "part")).applyInArrow(ask, asked.schema)


def shard_of(shards: int):
    return F.pmod(F.col("key1"), F.lit(shards)).cast("int").alias("shard")


def clean(docs: DataFrame, index: LineIndex, lines: DataFrame, keep: list[str], text: str = "text", id_col: str = "doc_id", texts: bool = True) -> DataFrame:
    """``keep`` columns, n_lines, n_dropped, kept_sha256 and, if asked for, kept_text: every text without its frequent lines."""
    dropped = index.frequent(lines).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("_drop_")).select(F.col("doc_id").alias("_id_"), F.col("text_key").alias("_tk_"), "_drop_")
    left = with_key(docs, text)
    joined = left.join(dropped, left[id_col].cast("long").eqNullSafe(F.col("_id_")) & F.col("_key_").eqNullSafe(F.col("_tk_")), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in keep], "_drop_", F.col(text).alias("_text_"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema), "n_lines long, n_dropped long, kept_sha256 string", *(["kept_text string"] if texts else [])])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, digests, out = [], [], [], []
            for raw, drop in zip(b.column(width + 1), b.column(width), strict=True):
                t = raw.as_py() or ""
                gone = set(drop.as_py() or ())
                n_lines.append(t.count("\n") + 1)
                n_dropped.append(len(gone))
                if gone:
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
                digests.append(hashlib.sha256(t.encode()).hexdigest())
                if texts:
                    out.append(t)
            arrays = [*b.columns[:width], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string()), *([pa.array(out, pa.string())] if texts else [])]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names[:width], "n_lines", "n_dropped", "kept_sha256", *(["kept_text"] if texts else [])])

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, keep: list[str], least_docs: int = LEAST_DOCS, texts: bool = True) -> DataFrame:
    """Index all documents and clean them: the whole operator in one call."""
    lines = materialize(line_table(docs), "lines")
    return clean(docs, LineIndex.build(lines, least_docs), lines, keep, texts=texts)
