"""Quality rules by tokeniser fertility.

A public byte-level vocabulary encodes every word of a whole text (with the
space before it). Per document: characters per token, the share of tokens
that hold only part of a character (byte fallback) and the entropy of the
tokens. Rejection bands for each language (for rows without one, each main
script) come from quartiles over all documents. Simple base rules on counts
of words, symbols, repeated lines and repeated 8-word windows come first.

Words repeat far more often than they differ, so each task encodes a distinct
word once and expands the result by the words' positions.

Defined results: a null or empty text has zero counts and fails the base
rules; repeated rows get equal rows; extra columns pass through ``measure``, but
ones named as its results are replaced;
bands of a group with no usable document are open.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded, look_up, materialize, with_text

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits text before merges, as the vocabulary's authors publish it (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How far beyond the quartiles a band reaches, in quartile distances.
REACH = 4.0
#: Most distinct words that a task keeps encoded.
MOST_KEPT = 400_000
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string"
#: First code points of script blocks, in order (fixed values of the Unicode standard, coarse).
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0x1100, "hangul"), (0x1E00, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other")]


class WordCodes:
    """Tokens of distinct words, found by the words' hashes."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.partial = np.zeros(max(ranks.values()) + 1, bool)
        for piece, rank in ranks.items():
            try:
                piece.decode()
            except UnicodeDecodeError:
                self.partial[rank] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slots(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word its index into ``start`` and ``count``; new words are encoded and kept."""
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > MOST_KEPT:
            self.clear()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            raw = buf.tobytes()
            texts = [" " + raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            coded = [self.encoding.encode_ordinary(t) for t in texts]
            counts = np.fromiter(map(len, coded), np.int64, len(coded))
            self.start = np.insert(self.start, place[new], len(self.tokens) + np.cumsum(counts) - counts)
            self.count = np.insert(self.count, place[new], counts)
            self.known = np.insert(self.known, place[new], distinct[new])
            self.tokens = np.concatenate([self.tokens, np.fromiter((x for c in coded for x in c), np.int32)])
        return np.searchsorted(self.known, distinct)[back]


def spread(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[0], firsts[0] + 1, ... (counts[0] numbers), then the same for the next."""
    if not len(counts) or not counts.sum():
        return np.zeros(0, np.int64)
    total = np.cumsum(counts)
    return np.arange(total[-1]) + np.repeat(firsts - (total - counts), counts)


def main_script(text_bytes: bytes) -> str:
    """The script of most letters among the first of each word's characters; ``none`` without letters."""
    cps = np.frombuffer(text_bytes.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    cps = cps[cps >= 0x41]
    if not len(cps):
        return "none"
    where = np.searchsorted(np.array([a for a, _ in SCRIPTS]), cps, "right") - 1
    return SCRIPTS[int(np.bincount(where).argmax())][1]


def measure_texts(column: pa.Array, codes: WordCodes) -> dict[str, np.ndarray]:
    out: dict[str, list] = {f.split()[0]: [] for f in FIELDS.split(", ")}
    for _, _, buf, offsets in K.slices(column):
        n = len(offsets) - 1
        starts, ends, of = K.words(buf, offsets)
        hashes = K.span_hashes(buf, starts, ends)
        n_words = np.diff(of)
        out["n_words"].append(n_words)
        solid = ~K.IS_SPACE[buf] & ((buf & 0xC0) != 0x80)
        chars = sums(solid, offsets)
        out["word_chars"].append(chars)
        out["n_symbols"].append(sums(SYMBOLS[buf], offsets))
        a, b, first = K.lines(buf, offsets)
        sa, sb = K.stripped(buf, a, b)
        full = sb > sa
        line_hash = K.span_hashes(buf, a, b)
        slot = codes.slots(hashes, buf, starts, ends) if len(hashes) else np.zeros(0, np.int64)
        counts = codes.count[slot] if len(slot) else np.zeros(0, np.int64)
        tokens = codes.tokens[spread(codes.start[slot], counts)] if len(slot) else np.zeros(0, np.int32)
        cut = np.concatenate([[0], np.cumsum(counts)])[of]
        partial = sums(codes.partial[tokens], cut)
        n_tokens = np.diff(cut)
        dup, rep, ent, script = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), []
        for i in range(n):
            h = line_hash[first[i] : first[i + 1]][full[first[i] : first[i + 1]]]
            dup[i] = len(h) - len(np.unique(h)) if len(h) > 1 else 0
            if n_words[i] > WINDOW:
                w = K.runs(hashes[of[i] : of[i + 1]], WINDOW)
                order = np.argsort(w)
                same = w[order[1:]] == w[order[:-1]]
                if same.any():
                    hit = np.zeros(len(w) + WINDOW, np.int64)
                    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
                    hit[again] += 1
                    hit[again + WINDOW] -= 1
                    rep[i] = int((np.cumsum(hit)[: n_words[i]] > 0).sum())
            if n_tokens[i]:
                t = np.sort(tokens[cut[i] : cut[i + 1]])
                c = np.diff(np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])))
                ent[i] = np.log2(n_tokens[i]) - float((c * np.log2(c)).sum()) / n_tokens[i]
            script.append(main_script(buf[offsets[i] : offsets[i + 1]].tobytes()) if len(buf) else "none")
        out["n_dup_lines"].append(dup)
        out["n_repeat_words"].append(rep)
        out["n_tokens"].append(n_tokens)
        out["chars_per_token"].append(chars / np.maximum(n_tokens, 1))
        out["fallback_share"].append(partial / np.maximum(n_tokens, 1))
        out["token_entropy"].append(ent)
        out["script"].append(np.array(script, object))
    return {k: np.concatenate(v) for k, v in out.items()}


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns with counts and fertility of each whole text. The vocabulary file, of about a megabyte, goes to each task."""
    spark = docs.sparkSession
    names = [f.split()[0] for f in FIELDS.split(", ")]
    keep = [c for c in keep if c not in names]
    # a path without a scheme is read by the driver, so executors need no copy of the file
    raw = bytes(spark.read.format("binaryFile").load(vocabulary).select("content").first()[0]) if "://" in vocabulary else Path(vocabulary).read_bytes()
    sent = spark.sparkContext.broadcast(raw)
    head = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head] + [FIELDS])
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(sent.value)
        for b in batches:
            if b.num_rows:
                found = measure_texts(b.column(b.num_columns - 1), codes)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(found[n], t) for n, t in zip(names, types, strict=True)]], [*keep, *names])

    return with_text(docs, keep, text).mapInArrow(run, schema)


def judge(measured: DataFrame, lang: str | None = "lang", reach: float = REACH) -> DataFrame:
    """Add ``base_failed`` and ``kept``. Bands are quartiles plus or minus ``reach`` times their distance, over all rows of a group that pass the base rules.

    Bands are one row for each language or script, a table whose size is checked before it is sent to all tasks.
    """
    group = F.coalesce(F.col(lang), F.concat(F.lit("script:"), F.col("script"))) if lang else F.concat(F.lit("script:"), F.col("script"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = measured.withColumn("band_group", group).withColumn("base_failed", failed)
    # entropy grows with length, so what is banded is its distance from the logarithm of the number of tokens, per unit of that logarithm
    rows = rows.withColumn("_flat_", F.col("token_entropy") / F.log2(F.greatest(F.col("n_tokens"), F.lit(2))))
    ok = rows.where(~F.col("base_failed"))
    q = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f"q_{c}")
    bands = bounded(ok.groupBy("band_group").agg(q("chars_per_token"), q("fallback_share"), q("_flat_")), "bands")
    out = look_up(rows, bands.withColumnRenamed("band_group", "_group_"), "band_group", "_group_").drop("_group_")

    def wide(c: str, least: float):
        return F.greatest((F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]) * reach, F.lit(least))

    inside = F.col("chars_per_token").between(F.col("q_chars_per_token")[1] - wide("chars_per_token", 0.5), F.col("q_chars_per_token")[1] + wide("chars_per_token", 0.5))
    inside &= F.col("fallback_share") <= F.col("q_fallback_share")[1] + wide("fallback_share", 0.02)
    inside &= F.col("_flat_") >= F.col("q__flat_")[1] - wide("_flat_", 0.1)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def fertility_rules(docs: DataFrame, vocabulary: str = VOCABULARY, reach: float = REACH) -> DataFrame:
    """One row per document (doc_id) with counts, fertility and verdict; tokenising happens once, its numbers are written to the shared folder."""
    return judge(materialize(measure(docs, ["doc_id", "lang"], vocabulary=vocabulary), "fertility"), reach=reach)
