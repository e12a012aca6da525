"""Substring dedup: fixed blocks as anchors, probed by every rolling window, extended to maximal exact repeats.

A document's words are cut into non-overlapping blocks of (W + 1) / 2 words, 18 for
windows of W = 35, so every window of W words holds one whole block. Blocks are the
index. All runs of 18 words at every position probe it. If two windows are equal,
the block inside one is met by a run at the same place inside the other, so each of
them holds a hit; and what holds no hit repeats nowhere. Hits are extended to both sides
as far as a window that holds one reaches, those windows are compared by 96 bits of
their words, and the equal ones, put together, are the maximal repeats.

What travels is small: a run of 18 words as four bytes in the shard of its hash
(another run with the same bytes only makes a candidate more, which the 96 bits
decide), with two bytes for its place; texts move once. A shard meets its blocks
first, keeps them sorted, and lets the probes pass as a stream, so no group is held
whole. A document sends a run or window that it repeats once, and marks it itself, so no
text of one word over and over makes a shard hot; nothing emits pairs.

Defined results: words are runs other than ASCII white space, compared as they are; a
null, empty or short text loses nothing and has the digest of its words joined;
rows that repeat another are repeats of it, so both lose what windows cover; rows
are told apart by doc_id and text alone, so null doc_ids need no care; other columns
pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

WINDOW = 35
#: Bytes of texts for a shard (about), words of a chunk (places in it take two bytes), bytes of texts that are handled at once.
SHARD_BYTES, CHUNK, SLICE = 64 << 20, 1 << 16, 400_000
#: Kinds of rows that go to a shard: indexed entries, probes, and what only passes through: places known to repeat, and a chunk's documents.
INDEXED, PROBE, KNOWN, TABLE = 0, 1, 2, 3
ENTRIES = "shard int, kind int, c1 long, c2 long, prints binary, places binary"
_U = np.uint64


def rolling(h: np.ndarray, k: int, by: int = 0xAF251AF3B0F025B5) -> np.ndarray:
    """A hash of each run of k successive hashes, put together from runs of powers of two."""
    out, done, power, width = None, 0, h, 1
    while k:
        if k & 1:
            n = max(0, len(power) - done)
            out = power if out is None else K.mix(out[:n] * _U(by) + power[done : done + n])
            done += width
        k >>= 1
        if k:
            n = max(0, len(power) - width)
            power, width = K.mix(power[:n] * _U(by ^ 0x2545F4914F6CDD1D) + power[width : width + n]), 2 * width
    return out


class Words:
    """Word hashes of the texts of a slice, with each word's text and place in it."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, self.first = K.words(buf, offsets)
        self.hashes = K.span_hashes(buf, starts, ends)
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        self.pos = np.arange(len(self.hashes)) - self.first[self.owner]

    def fits(self, k: int, of: int | None = None) -> np.ndarray:
        """Places at which k words follow in texts of at least ``of`` words."""
        return np.flatnonzero((self.pos + k <= self.count[self.owner]) & (self.count[self.owner] >= (of or k)))


def once(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of equal values of one owner, and how often it has them."""
    _, first, n = np.unique(K.mix(values ^ K.mix(owner.astype(_U) + _U(1))), return_index=True, return_counts=True)
    return first, n


def binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The array's bytes between cuts (counted in elements), each as a binary value."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize * (data.size // max(len(data), 1) or 1)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def send(w: Words, keys: np.ndarray, at: np.ndarray, shard: np.ndarray, prints: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the entries at places ``at`` of a slice, and for each chunk of it the documents it has entries of.

    A chunk is named by a digest of its documents, so it has the same name whenever it is made again.
    """
    chunk = at // CHUNK
    for c in np.unique(chunk):
        own = np.flatnonzero(chunk == c)
        docs, lead = np.unique(w.owner[at[own]], return_index=True)
        first = np.maximum(w.first[docs], c * CHUNK)
        table = np.concatenate([keys[docs], np.stack([first - c * CHUNK, w.pos[first]], 1)], 1).astype(np.int64)
        name = np.frombuffer(hashlib.blake2b(table.tobytes(), digest_size=16).digest(), np.int64)
        order = own[np.lexsort((at[own], shard[own], kind[own]))]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(shard[order]) != 0) | (np.diff(kind[order]) != 0)]))
        cuts = np.concatenate([new, [len(order)]])
        n = len(new)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([shard[order[new]], [name[0] & 0x7FFFFFFF]]).astype(np.int32)),
                pa.array(np.concatenate([kind[order[new]], [TABLE]]).astype(np.int32)),
                pa.array(np.full(n + 1, name[0])),
                pa.array(np.full(n + 1, name[1])),
                pa.concat_arrays([binaries(prints[order], cuts), pa.array([table.tobytes()], pa.binary())]),
                pa.concat_arrays([binaries((at[order] - c * CHUNK).astype(np.uint16), cuts), pa.array([b""], pa.binary())]),
            ],
            ["shard", "kind", "c1", "c2", "prints", "places"],
        )


def runs_of(docs: DataFrame, window: int, shards: int) -> DataFrame:
    """Entries of all runs of half a window: those on a block's place are the index, the others probes."""
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.stack([b.column(i).to_numpy() for i in (0, 1)], 1)
            for lo, hi, buf, offsets in K.slices(b.column(2), SLICE):
                w = Words(buf, offsets)
                at = w.fits(block, window)
                if not len(at):
                    continue
                value = rolling(w.hashes, block)
                aligned = w.pos[at] % block == 0
                at = np.concatenate([at[aligned], at[~aligned]])  # of equal runs of a text, one on a block's place is kept
                first, n = once(value[at], w.owner[at])
                own, is_block = at[first], w.pos[at[first]] % block == 0
                kind = np.where(is_block, INDEXED, np.where(n > 1, KNOWN, PROBE))
                again = own[is_block & (n > 1)]
                own, kind = np.concatenate([own, again]), np.concatenate([kind, np.full(len(again), KNOWN)])
                yield from send(w, names[lo:hi], own, (value[own] >> _U(33)).astype(np.int64) % shards, (value[own] & _U(0xFFFFFFFF)).astype(np.uint32), kind)

    return docs.select("k1", "k2", "_text").mapInArrow(run, ENTRIES)


def windows_of(docs: DataFrame, window: int, shards: int) -> DataFrame:
    """Entries of the windows that hold a hit; ``docs`` has the list of hits of each row."""
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.stack([b.column("k1").to_numpy(), b.column("k2").to_numpy()], 1)
            hits = b.column("hits")
            for lo, hi, buf, offsets in K.slices(b.column("_text"), SLICE):
                w = Words(buf, offsets)
                value = rolling(w.hashes, block)
                hit = np.zeros(len(w.hashes) + 1, np.int64)
                hit[marked(w, w.fits(block, window), value, hits.slice(lo, hi - lo))] = 1
                held = np.concatenate([[0], np.cumsum(hit)])
                at = w.fits(window)
                at = at[held[at + window - block + 1] > held[at]]
                if not len(at):
                    continue
                one, two = rolling(w.hashes, window), rolling(w.hashes, window, 0xC2B2AE3D27D4EB4F)
                first, n = once(one[at] ^ K.mix(two[at]), w.owner[at])
                own = at[first]
                kind, again = np.full(len(own), INDEXED), own[n > 1]
                own, kind = np.concatenate([own, again]), np.concatenate([kind, np.full(len(again), KNOWN)])
                prints = np.empty((len(own), 3), np.uint32)
                prints[:, :2] = one[own].view(np.uint32).reshape(-1, 2)
                prints[:, 2] = (two[own] & _U(0xFFFFFFFF)).astype(np.uint32)
                yield from send(w, names[lo:hi], own, (two[own] >> _U(33)).astype(np.int64) % shards, prints, kind)

    return docs.mapInArrow(run, ENTRIES)


def marked(w: Words, at: np.ndarray, value: np.ndarray, lists: pa.Array) -> np.ndarray:
    """The places among ``at`` whose value stands at one of their text's listed places."""
    flat = lists.flatten().to_numpy()
    n = lists.value_lengths().fill_null(0).to_numpy()
    owner = np.repeat(np.arange(len(n)), n)
    name = lambda v, o: K.mix(v ^ K.mix(o.astype(_U) + _U(1)))
    return at[np.isin(name(value[at], w.owner[at]), name(value[w.first[owner] + flat], owner))]


def answer(entries: DataFrame, width: int, shards: int) -> DataFrame:
    """(c1, c2, table, places): places whose print stands among another entry's indexed ones of the shard. ``width``: numbers of a print."""

    def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = column.cast(pa.large_binary())
        _, where, data = lists.buffers()
        where = np.frombuffer(where, np.int64)[lists.offset : lists.offset + len(lists) + 1]
        data = np.frombuffer(data, np.uint8)[where[0] : where[-1]] if data is not None else np.zeros(0, np.uint8)
        return data, np.diff(where)

    def prints_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, n = numbers(column)
        raw = data.view(np.uint32)
        if width == 1:
            return raw, n // 4
        out = np.empty(len(raw) // 3, [("a", _U), ("b", np.uint32)])
        raw = raw.reshape(-1, 3)
        out["a"] = raw[:, 0].astype(_U) | (raw[:, 1].astype(_U) << _U(32))
        out["b"] = raw[:, 2]
        return out, n // 12

    def told(rows: pa.RecordBatch, hit: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        data, _ = numbers(rows.column("places"))
        per = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(n)])]
        some = np.flatnonzero(np.diff(per))
        if len(some):
            cuts = np.concatenate([per[some], [per[-1]]])
            yield pa.RecordBatch.from_arrays([rows.column("c1").take(pa.array(some)), rows.column("c2").take(pa.array(some)), pa.nulls(len(some), pa.binary()), binaries(data.view(np.uint16)[hit], cuts)], ["c1", "c2", "table", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, shard = [], None, None

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal index
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
            held.clear()
            if rows is None:
                index = np.zeros(0, np.uint32)
                return
            prints, n = prints_of(rows.column("prints"))
            if width == 1:
                index, back, count = np.unique(prints, return_inverse=True, return_counts=True)
                yield from told(rows, count[back] > 1, n)
            else:
                order = np.lexsort((prints["b"], prints["a"]))
                same = (prints["a"][order][1:] == prints["a"][order][:-1]) & (prints["b"][order][1:] == prints["b"][order][:-1])
                hit = np.zeros(len(prints), bool)
                hit[order[1:][same]] = True
                hit[order[:-1][same]] = True
                yield from told(rows, hit, n)

        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch.column("shard").to_numpy() * 4 + batch.column("kind").to_numpy())) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                here, kind = part.column("shard")[0].as_py(), part.column("kind")[0].as_py()
                if here != shard:
                    if index is None and shard is not None:
                        yield from settle()
                    shard, index = here, None
                if kind == INDEXED:
                    held.append(part.select(["c1", "c2", "prints", "places"]))
                elif kind == PROBE:
                    if index is None:
                        yield from settle()
                    prints, n = prints_of(part.column("prints"))
                    if len(index):
                        at = np.minimum(np.searchsorted(index, prints), len(index) - 1)
                        yield from told(part, index[at] == prints, n)
                elif kind == KNOWN:
                    yield pa.RecordBatch.from_arrays([part.column("c1"), part.column("c2"), pa.nulls(part.num_rows, pa.binary()), part.column("places")], ["c1", "c2", "table", "places"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("c1"), part.column("c2"), part.column("prints"), pa.nulls(part.num_rows, pa.binary())], ["c1", "c2", "table", "places"])
        if index is None and shard is not None:
            yield from settle()

    dealt = entries.withColumn("shard", F.pmod("shard", F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "c1 long, c2 long, table binary, places binary")


def places(answers: DataFrame) -> DataFrame:
    """(k1, k2, hits): the places in each document that were answered, put together from its chunks."""

    def run(rows: pa.Table) -> pa.Table:
        tables = {t for t in rows.column("table").to_pylist() if t is not None}
        hits = [np.frombuffer(p, np.uint16) for p in rows.column("places").to_pylist() if p]
        found = np.unique(np.concatenate(hits)).astype(np.int64) if hits else np.zeros(0, np.int64)
        docs = np.frombuffer(next(iter(tables)), np.int64).reshape(-1, 4)
        mine = np.searchsorted(docs[:, 2], found, "right") - 1
        have, first = np.unique(mine, return_index=True)
        at = (found - docs[mine, 2] + docs[mine, 3]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(at)]]), pa.int32()), pa.array(at))
        return pa.table({"k1": docs[have, 0], "k2": docs[have, 1], "part": lists})

    per = answers.groupBy("c1", "c2").applyInArrow(run, "k1 long, k2 long, part array<int>")
    # rows that repeat a document give the same lists, which a set keeps once
    return per.groupBy("k1", "k2").agg(F.flatten(F.collect_set("part")).alias("hits"))


def cut_out(joined: DataFrame, keep: list[str], window: int, texts: bool) -> DataFrame:
    """``joined`` has k1, k2, _0.., _text and the places of repeated windows; each text without the words they cover."""
    fields = [f"`{c}` {joined.schema[f'_{i}'].dataType.simpleString()}" for i, c in enumerate(keep)]
    schema = ", ".join([*fields, "n_words long", "n_removed long", "kept_sha256 string", *(["kept_text string"] if texts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("hits")
            total, gone, digests, out = [], [], [], []
            for lo, hi, buf, offsets in K.slices(b.column("_text"), SLICE):
                gap = None
                part = lists.slice(lo, hi - lo)
                if part.null_count < len(part):
                    w = Words(buf, offsets)
                    value = rolling(w.hashes, window) ^ K.mix(rolling(w.hashes, window, 0xC2B2AE3D27D4EB4F))
                    at = marked(w, w.fits(window), value, part)
                    edge = np.zeros(len(w.hashes) + window + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gap = np.cumsum(edge)[: len(w.hashes)] > 0
                raw = buf.tobytes()
                for i in range(hi - lo):
                    seq = raw[offsets[i] : offsets[i + 1]].split()
                    total.append(len(seq))
                    if gap is not None:
                        own = gap[w.first[i] : w.first[i + 1]]
                        if own.any():
                            seq = [x for x, no in zip(seq, own.tolist(), strict=True) if not no]
                    gone.append(total[-1] - len(seq))
                    kept = b" ".join(seq)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        out.append(kept.decode())
            own = [b.column(f"_{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), *([pa.array(out, pa.string())] if texts else [])], [*keep, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])])

    return joined.mapInArrow(run, schema)


def row_keys(text: str, id_col: str) -> list[Column]:
    """128 bits that name a row by its doc_id and text."""
    return [F.xxhash64(id_col, text).alias("k1"), F.xxhash64(F.lit("substrings"), text, id_col).alias("k2")]


def dedup_substrings(docs: DataFrame, keep: list[str], window: int = WINDOW, texts: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, n_removed, kept_sha256 and, if asked for, kept_text: every text without repeated passages of ``window`` words."""
    named = docs.select(*row_keys(text, id_col), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    hits = materialize(places(answer(runs_of(named, window, shards), 1, shards)), "hits")
    # both joins read the same exchange of the texts
    near = named.join(hits.hint("shuffle_hash"), ["k1", "k2"])
    again = places(answer(windows_of(near, window, shards), 3, shards))
    joined = named.join(again.hint("shuffle_hash"), ["k1", "k2"], "left")
    return cut_out(joined, keep, window, texts)


#: DuckDB: every window of a document as a string, and the words that the repeated ones cover; a document is a row.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS seq FROM documents),
w AS (SELECT row, unnest(range(1, len(seq) - 33)) AS p, seq FROM d WHERE len(seq) >= 35),
h AS (SELECT row, p, array_to_string(seq[p : p + 34], ' ') AS words FROM w),
r AS (SELECT words FROM h GROUP BY words HAVING count(*) > 1),
c AS (SELECT DISTINCT row, unnest(range(p, p + 35)) AS p FROM h SEMI JOIN r USING (words)),
x AS (SELECT row, p, c.p IS NOT NULL AS gone, seq[p] AS word FROM (SELECT row, unnest(range(1, len(seq) + 1)) AS p, seq FROM d) LEFT JOIN c USING (row, p)),
k AS (SELECT row, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM x GROUP BY row)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row)
"""
