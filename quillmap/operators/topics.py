"""Topics over words and coordinates, by distributed collapsed Gibbs sampling.

Each round, blocks of documents sample the topics of their word tokens and
coordinates against the same global counts, and the new counts are summed by
Spark: the usual approximate distributed sampler. What goes to tasks is the
topic-word table and each topic's Gaussian, of fixed size; documents and their
assignments stay in written tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a block of documents, which one task samples (about).
BLOCK_TOKENS = 200_000
STATE = "doc long, kind int, word long, x double, y double, z double, topic int"


def tokens(counts: DataFrame, point: DataFrame) -> DataFrame:
    """One row for each word token (kind 0) and coordinate (kind 1) of documents that have both."""
    both = counts.select("id").distinct().join(point.select("id").distinct(), "id")
    words = counts.join(both, "id", "left_semi").select(F.col("id").alias("doc"), F.lit(0).alias("kind"), "word", *[F.lit(0.0).alias(c) for c in "xyz"], F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("r"))
    peaks = point.join(both, "id", "left_semi").select(F.col("id").alias("doc"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("word"), "x", "y", "z", F.monotonically_increasing_id().alias("r"))
    return words.withColumn("r", F.col("r").cast("long")).unionByName(peaks)


def sampler(r: int, seed: int, n_topics: int, alpha: float, gamma: float, sent):
    """A function that samples all topics of a block of documents, given the global tables."""

    def sample(rows: pd.DataFrame) -> pd.DataFrame:
        phi, mean, var = sent.value
        rows = rows.sort_values(["doc", "kind", "word", "x", "y", "z", "topic"])
        rng = np.random.default_rng([seed, r, int(rows["doc"].min()) & 0xFFFFFFFF])
        out = []
        for _, own in rows.groupby("doc", sort=True):
            kind, topic = own["kind"].to_numpy(), own["topic"].to_numpy()
            n_words_in = np.bincount(topic[kind == 0], minlength=n_topics)
            n_peaks_in = np.bincount(topic[kind == 1], minlength=n_topics)
            p = np.empty((len(own), n_topics))
            w = kind == 0
            p[w] = phi[:, own["word"].to_numpy()[w]].T * (n_peaks_in + gamma)
            d = own[["x", "y", "z"]].to_numpy()[~w][:, None, :] - mean[None]
            logs = -0.5 * (d * d / var[None]).sum(2) - 0.5 * np.log(var).sum(1)
            p[~w] = np.exp(logs - logs.max(1, keepdims=True)) * (n_words_in + alpha)
            p /= p.sum(1, keepdims=True)
            own = own.assign(topic=(p.cumsum(1) < rng.random((len(own), 1))).sum(1).clip(0, n_topics - 1))
            out.append(own)
        return pd.concat(out)[[c.split()[0] for c in STATE.split(", ")]]

    return sample


def fit(counts: DataFrame, point: DataFrame, n_topics: int, n_words: int, rounds: int = 10, alpha: float = 0.1, beta: float = 0.01, gamma: float = 0.01, sigma0: float = 50.0, blocks: int | None = None, seed: int = 1, write=None) -> dict[str, np.ndarray]:
    """Topic-word probabilities, Gaussians of topics and the state table. ``write`` cuts the lineage of each round's state."""
    from quillmap.operators.text import checkpointed

    keep = write or checkpointed
    state = keep(tokens(counts, point).withColumn("topic", F.pmod(F.xxhash64("doc", "word", "x", "y", "z", "r", F.lit(seed)), F.lit(n_topics)).cast("int")).drop("r").select(*[c.split()[0] for c in STATE.split(", ")]))
    likelihood = []
    blocks = blocks or max(16, -(-state.count() // BLOCK_TOKENS))
    for r in range(rounds):
        words, mean, var, share = summaries(state, n_topics, n_words, sigma0)
        if r:
            before.unpersist()
        before = state
        phi = (words + beta) / (words.sum(1, keepdims=True) + beta * n_words)
        sent = state.sparkSession.sparkContext.broadcast((phi, mean, var))
        dealt = state.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)))
        state = keep(dealt.groupBy("block").applyInPandas(sampler(r, seed, n_topics, alpha, gamma, sent), STATE))
        likelihood.append(float((words * np.log(phi)).sum()))
    words, mean, var, share = summaries(state, n_topics, n_words, sigma0)
    return {"word_given_topic": (words + beta) / (words.sum(1, keepdims=True) + beta * n_words), "mean": mean, "variance": var, "topic": share, "likelihood": np.array(likelihood), "state": state}


def summaries(state: DataFrame, n_topics: int, n_words: int, sigma0: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of topics x words, and each topic's mean and variance (shrunk towards a wide prior): sums made by Spark."""
    words = np.zeros((n_topics, n_words))
    for r in state.where("kind = 0").groupBy("topic", "word").count().toLocalIterator():
        words[r["topic"], r["word"]] = r["count"]
    mean, var, share = np.zeros((n_topics, 3)), np.full((n_topics, 3), sigma0), np.zeros(n_topics)
    for r in state.where("kind = 1").groupBy("topic").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.var_pop(c).alias(f"v{c}") for c in "xyz"]).collect():
        n = r["n"]
        share[r["topic"]] = n
        mean[r["topic"]] = [r[f"m{c}"] * n / (n + 1) for c in "xyz"]
        var[r["topic"]] = [(r[f"v{c}"] * n + sigma0) / (n + 1) for c in "xyz"]
    return words, mean, var, (share + words.sum(1)) / max((share + words.sum(1)).sum(), 1)


def topic_given_voxel(model: dict[str, np.ndarray], xyz: np.ndarray) -> np.ndarray:
    """Densities of topics at coordinates, normalised over topics; 0 where all vanish."""
    d = xyz[:, None, :] - model["mean"][None]
    dens = np.exp(-0.5 * (d * d / model["variance"][None]).sum(2)) / np.sqrt(model["variance"].prod(1)) * model["topic"]
    return np.nan_to_num(dens / np.maximum(dens.sum(1, keepdims=True), 1e-300))


def weight_priors(priors: np.ndarray, weight: float) -> np.ndarray:
    """Priors brought to mean 1 and mixed with a flat prior."""
    return weight * priors / priors.mean() + (1 - weight)


def decode(model: dict[str, np.ndarray], xyz: np.ndarray, values: np.ndarray, priors: np.ndarray | None = None) -> np.ndarray:
    """Word weights of a region or map."""
    topics = topic_given_voxel(model, xyz).T @ values
    return model["word_given_topic"].T @ (topics if priors is None else topics * priors)


def encode(model: dict[str, np.ndarray], word_counts: np.ndarray, xyz: np.ndarray, priors: np.ndarray | None = None) -> np.ndarray:
    """A map of a text: p(topic | word) of its words, spread by topics' densities."""
    p = model["word_given_topic"] * model["topic"][:, None]
    p = p / np.maximum(p.sum(0, keepdims=True), 1e-300)
    topics = p @ word_counts
    return topic_given_voxel(model, xyz) @ (topics if priors is None else topics * priors)
