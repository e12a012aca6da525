"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text's features are its byte n-grams of 3 to 5, taken inside words with a
boundary mark at either end, so an unseen misspelling shares most n-grams
with the word it comes from. The embeddings and the softmax layer are trained
jointly in numpy on a bounded sample of labelled texts, in one task. A whole text is then
scored in one vectorised pass: as the model is linear after averaging, each
hashed n-gram has one number, its embedding times the difference of the two
softmax columns.

Defined results: a null or empty text (or one without a letter or digit) has
the score of the bias alone; extra columns pass through ``score`` untouched, but
one named as its result is replaced; repeated rows get equal scores; an empty training set gives the score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, with_text

#: Documented bounds: hash buckets, embedding width, and labelled texts and bytes of each class used in training.
BITS, WIDTH, MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 17, 4, 2500, 7000, 32 << 20
ORDERS = (3, 4, 5)
#: Averaged n-gram weights are small; this factor brings them to the scale that the optimiser expects.
GAIN = 60.0
#: So many empty n-grams are averaged with a text's own, so a few chance n-grams of a very short text weigh little.
EMPTY = 60
#: Decoupled weight decay: n-grams without a steady tie to a class shrink to zero.
DECAY = 0.5
#: Least number of optimiser steps, for small training sets.
STEPS = 1200


@dataclass
class Model:
    bits: int
    bias: float
    weights: np.ndarray  # one number for each bucket

    @property
    def size(self) -> int:
        return self.weights.nbytes


def _solid() -> np.ndarray:
    """Bytes kept in n-grams: letters, digits and all bytes of non-ASCII characters; others are boundaries."""
    keep = np.zeros(256, np.uint64)
    for b in range(256):
        if chr(b).isalnum() and b < 128 or b >= 128:
            keep[b] = b
    return keep


def grams(buf: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: positions of the n-grams, and their buckets. ``buf`` must begin and end with a space."""
    x = _solid()[buf]
    on = x > 0
    inner = np.ones(len(x), bool)
    code = x.copy()
    for n in range(2, max(ORDERS) + 1):
        # code[i] holds bytes i..i+n-1; inner[i] tells that bytes i+1..i+n-2 are all inside a word
        code = (code[:-1] << np.uint64(8)) | x[n - 1 :]
        inner = inner[:-1] if n == 2 else inner[:-1] & on[n - 2 : len(x) - 1]
        if n in ORDERS:
            at = np.flatnonzero(inner)
            yield at, (K.mix(code[at] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)


def padded(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of lower-cased texts, each with a space before it and a last one at the end; offsets of those spaces."""
    for _, _, buf, offsets in K.slices(pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))):
        n = len(offsets) - 1
        out = np.full(len(buf) + n + 1, 32, np.uint8)
        keep = np.ones(len(out), bool)
        starts = offsets + np.arange(n + 1)
        keep[starts] = False
        out[keep] = buf
        yield out, starts


def features(texts: pa.Array | list[str | None], bits: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each text the distinct buckets, their counts, and what one n-gram weighs.

    Counts take two bytes if they can, and the bags of a slice share two arrays, as all
    bags stay in memory while training.
    """
    out = []
    for buf, starts in padded(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts):
        parts = list(grams(buf, bits))
        cuts = [np.searchsorted(at, starts) for at, _ in parts]
        bags, sizes = [], []
        for i in range(len(starts) - 1):
            own = np.concatenate([b[c[i] : c[i + 1]] for (_, b), c in zip(parts, cuts, strict=True)])
            bags.append(np.unique(own, return_counts=True))
            sizes.append(len(own))
        ids, counts = np.concatenate([b[0] for b in bags]).astype(np.int32), np.concatenate([b[1] for b in bags])
        counts = counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32)
        ends = np.cumsum([0, *(len(b[0]) for b in bags)])
        out += [(ids[x:y], counts[x:y], GAIN / (EMPTY + n)) for x, y, n in zip(ends[:-1], ends[1:], sizes, strict=True)]
    return out


def fit(rows: list[tuple[str | None, int]], prior: float, bits: int = BITS, **options) -> Model:
    """Train on (text, label) rows. ``prior`` is the share of toxic texts among all labelled ones."""
    return fit_bags(features([t for t, _ in rows], bits), np.array([y for _, y in rows], np.int64), prior, bits, **options)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray, float]], labels: np.ndarray, prior: float, bits: int = BITS, width: int = WIDTH, epochs: int = 6, seed: int = 7) -> Model:
    """Train embeddings and softmax together by Adam."""
    if not len(labels) or labels.min() == labels.max():
        return Model(bits, -30.0 if not labels.any() else 30.0, np.zeros(1 << bits, np.float32))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    top = rng.normal(0, 0.3, (width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, top, bias)]
    step, size = 0, 32
    epochs = max(epochs, min(60, STEPS * size // len(bags)))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 0.02 * (1 - epoch / epochs)
        for a in range(0, len(order), size):
            pick = order[a : a + size]
            ids = np.concatenate([bags[i][0] for i in pick])
            vals = np.concatenate([bags[i][1] * np.float32(bags[i][2]) for i in pick])
            lens = np.array([len(bags[i][0]) for i in pick])
            own = np.repeat(np.arange(len(pick)), lens)
            used, slot = np.unique(ids, return_inverse=True)
            rows_ = emb[used]
            hidden = np.stack([np.bincount(own, vals * rows_[slot, j], len(pick)) for j in range(width)], 1).astype(np.float32)
            z = hidden @ top + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            g = p * weight[pick, None] / len(pick)
            back = g @ top.T
            g_emb = np.stack([np.bincount(slot, vals * back[own, j], len(used)) for j in range(width)], 1).astype(np.float32)
            step += 1
            emb[used] *= 1 - rate * DECAY
            for param, grad, (m, v), at in ((emb, g_emb, state[0], used), (top, hidden.T @ g, state[1], slice(None)), (bias, g.sum(0), state[2], slice(None))):
                m[at] = 0.9 * m[at] + 0.1 * grad
                v[at] = 0.99 * v[at] + 0.01 * grad * grad
                param[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)
    return Model(bits, float(bias[1] - bias[0]), (emb @ (top[:, 1] - top[:, 0])).astype(np.float32) * np.float32(GAIN))


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    out = []
    for buf, starts in padded(column):
        total, count = np.zeros(len(starts) - 1), np.zeros(len(starts) - 1)
        for at, bucket in grams(buf, model.bits):
            cut = np.searchsorted(at, starts)
            sums = np.concatenate([[0.0], np.cumsum(model.weights[bucket], dtype=np.float64)])
            total += sums[cut[1:]] - sums[cut[:-1]]
            count += np.diff(cut)
        out.append(1 / (1 + np.exp(-np.clip(model.bias + total / (count + EMPTY), -40, 40))))
    return np.concatenate(out) if out else np.zeros(0)


def sampled(docs: DataFrame, labels: DataFrame, seen: Column | None = None, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, float]:
    """(doc_id, h, text, y) of labelled texts, and the share of toxic ones among all: see ``train``."""
    fits = F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 100
    name = [F.col("doc_id"), F.xxhash64("text").alias("h")]
    ids = docs.where(fits if seen is None else fits & seen).select(*name, F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    marked = labels.select("doc_id", F.col("label").cast("int").alias("y")).where("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    # a text of a doc_id counts once, however often its row is repeated
    known = materialize(ids.join(marked, "doc_id").groupBy("doc_id", "h").agg(F.max("bytes").alias("bytes"), F.max("y").alias("y")), "known")
    counts = {r["y"]: r for r in known.groupBy("y").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    pos, neg = (counts[y]["n"] if y in counts else 0 for y in (1, 0))
    part = lambda y, most: F.lit(min(most / counts[y]["n"], most_bytes / max(counts[y]["bytes"], 1)) if y in counts else 0.0)
    draw = F.pmod(F.xxhash64("doc_id", "h", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = materialize(known.where(draw < F.when(F.col("y") == 1, part(1, most_toxic)).otherwise(part(0, most_clean))).select("doc_id", "h", "y"), "picked")
    rows = docs.where(fits).select(*name, "text").join(F.broadcast(picked), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    return rows, pos / max(pos + neg, 1)


def sample(docs: DataFrame, labels: DataFrame, seen: Column | None = None, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_BYTES) -> tuple[pa.Table, float]:
    """The rows of ``sampled``, in order, on the driver, and the share."""
    rows, share = sampled(docs, labels, seen, most_toxic, most_clean, most_bytes)
    return rows.orderBy("doc_id", "h").toArrow(), share


def train(docs: DataFrame, labels: DataFrame, seen: Column | None = None, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_bytes: int = MOST_BYTES) -> Model:
    """Fit on texts of ``docs`` with a 0/1 label in ``labels`` (doc_id, label), among rows that satisfy ``seen``.

    The sample is at most about ``most_toxic`` and ``most_clean`` texts, and of each class about
    ``most_bytes``, picked by a hash of doc_id and text, each such pair once, so rows that share a doc_id
    are bounded too; no single text of it is longer than a hundredth of that. So its ids may be
    broadcast, and its texts fit a task, which trains; the driver gets the model alone. Of several
    labels the largest holds.
    """
    rows, share = sampled(docs, labels, seen, most_toxic, most_clean, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, bags = [np.zeros(0, np.int64)], []
        for b in batches:
            marks.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            for lo in range(0, b.num_rows, 500):  # some at a time, as each step copies its texts
                bags += features(b.column(0).slice(lo, 500), BITS)
        model = fit_bags(bags, np.concatenate(marks), share)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias], pa.float64()), pa.array([model.weights.tobytes()], pa.binary())], ["bias", "weights"])

    made = rows.repartition(1).sortWithinPartitions("doc_id", "h").select("text", "y").mapInArrow(run, "bias double, weights binary").collect()
    if not made:  # Spark runs no task over a plan that it finds empty
        return fit_bags([], np.zeros(0, np.int64), share)
    return Model(BITS, made[0]["bias"], np.frombuffer(made[0]["weights"], np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, to: str = "score") -> DataFrame:
    """``keep`` columns (all by default) with the toxicity score of every whole text added.

    The model is a table of 2**bits numbers, so what each task receives has a fixed bound.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != to]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(to, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array(score_texts(b.column(b.num_columns - 1), sent.value), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], [*keep, to])

    return with_text(docs, keep, text).mapInArrow(run, schema)
