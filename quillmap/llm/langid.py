"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent character n-grams (1 to 3) in
order. A document's own most frequent n-grams are compared with each profile
by the out-of-place distance: the sum of rank differences, with the profile's
length for n-grams that it lacks. The nearest profile gives the language.

Letters are code points of 16 bits, in lower case, so every script has n-grams of
its own; all else separates words. Profiles come from exact counts over all training
texts. Defined results: a text that is null or has no letter is ``und`` with score 0;
ties between n-grams go by code, ties between languages by name; without any profile
every text is ``und``; repeated rows get equal results; extra columns pass through
``predict``, but ones named as its results are replaced; letters beyond 16 bits share
symbols by their low bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import with_text

#: Length of a profile, n-gram lengths, bits of a symbol, and parts of a language in which its profile's candidates are found.
RANKS, ORDERS, BITS, PARTS = 300, (1, 2, 3), 16, 64
_CACHE: dict = {}


def symbols() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter."""
    if "symbols" not in _CACHE:
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _CACHE["symbols"] = np.where(letters, np.maximum(np.arange(0x110000) % (1 << BITS), 1), 0)
    return _CACHE["symbols"]


def gram_codes(column: pa.Array) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """For slices of texts: codes of each order (symbols of 16 bits each, the order above them), and the texts' cuts in them."""
    for _, _, buf, offsets in K.slices(pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))):
        points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        where = heads[offsets]
        n = len(where) - 1
        # every text gets a separator before it, and one ends the slice
        s = np.zeros(len(points) + n + 1, np.int64)
        keep = np.ones(len(s), bool)
        marks = where + np.arange(n + 1)
        keep[marks] = False
        s[keep] = symbols()[points]
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)  # a run of separators is one
        keep[marks] = True
        place = np.concatenate([[0], np.cumsum(keep)])
        s, marks = s[keep], place[marks]
        codes, cuts = [], []
        for k in ORDERS:
            c = np.zeros(max(len(s) - k + 1, 0), np.int64)
            for j in range(k):
                c = (c << BITS) | s[j : j + len(c)]
            ok = c > 0
            inner = np.ones(len(c), bool)
            for j in range(1, k - 1):
                inner &= s[j : j + len(c)] > 0
            at = np.flatnonzero(ok & inner)
            codes.append(c[at] | (k << BITS * len(ORDERS)))
            cuts.append(np.searchsorted(at, marks))
        yield codes, cuts


def ranked(codes: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent codes, by falling count, then by code."""
    if not len(codes):
        return np.zeros(0, np.int64)
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:ranks]]


def profiles(train: DataFrame, text: str = "text", lang: str = "lang", ranks: int = RANKS) -> DataFrame:
    """(lang, code, rank) of the ``ranks`` most frequent n-grams of each language, counted over all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = K.Tally()
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            for name in sorted(set(names.tolist())):
                for codes, _ in gram_codes(b.column(1).filter(pa.array(names == name))):
                    tally.add(name, np.concatenate(codes))
            if tally.held > K.MOST_HELD:
                yield from tally.take()
        yield from tally.take()

    rows = train.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # first in parts of a language, so that no task orders all its n-grams
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "code")) - 1
    best = counts.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(PARTS))).withColumn("rank", place("part")).where(F.col("rank") < ranks)
    return best.withColumn("rank", place()).where(F.col("rank") < ranks).select("lang", "code", "rank")


def distances(column: pa.Array, known: np.ndarray, table: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of each text to each profile, as a share of the largest, and whether the text has a letter."""
    out, some = [], []
    for codes, cuts in gram_codes(column):
        for i in range(len(cuts[0]) - 1):
            own = ranked(np.concatenate([c[k[i] : k[i + 1]] for c, k in zip(codes, cuts, strict=True)]), ranks)
            some.append(len(own) > 0)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            theirs = np.where((known[place] == own)[:, None], table[place], -1)
            gaps = np.where(theirs >= 0, np.abs(theirs - np.arange(len(own), dtype=np.int32)[:, None]), ranks)
            out.append(gaps.sum(0) / (ranks * max(len(own), 1)))
    return np.array(out).reshape(-1, table.shape[1]), np.array(some, bool)


def predict(docs: DataFrame, learned: DataFrame, keep: list[str], text: str = "text", ranks: int = RANKS) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (1 less the nearest distance).

    The profiles hold ``ranks`` codes for each language; that table alone goes to the driver and to the tasks.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    rows = learned.collect()
    names = sorted({r["lang"] for r in rows})
    found = sorted({r["code"] for r in rows}) or [-1]
    # (n-gram, language): its rank, -1 if the profile lacks it
    table = np.full((len(found), max(len(names), 1)), -1, np.int32)
    column, row = {n: i for i, n in enumerate(names)}, {c: i for i, c in enumerate(found)}
    for r in rows:
        table[row[r["code"]], column[r["lang"]]] = r["rank"]
    sent = docs.sparkSession.sparkContext.broadcast((np.array(found), table))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            d, some = distances(b.column(b.num_columns - 1), known, table, ranks)
            best = d.argmin(1)
            if not names:
                some[:] = False
            found = [names[k] if s else "und" for k, s in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, 1 - d[np.arange(len(d)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return with_text(docs, keep, text).mapInArrow(run, schema)
