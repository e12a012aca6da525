"""Topics over words and coordinates whose spatial part is several Gaussian regions each, mirrored in pairs if asked.

Words and coordinates of a document share its topics: a coordinate's topic and region are drawn by its
density, the region's share of the topic, the document's other coordinates and its words; a word's topic by
the word's counts and the document's coordinates. A round draws all of them against the counts of the
round before, the usual distributed approximation. A document of at most ``MOST_TOKENS`` words and coordinates is a
row that holds them, so its counts are at hand where it is drawn, and a round is a pass over such rows without a shuffle;
counts by word go with the task. Larger documents, and all of them where words by topics are more than ``MOST_COUNTS``,
have a row for each word and coordinate, joined with tables of the counts by word and by document. Gaussians, and totals of
topics, are of the size of the parameters and go with the task. A draw depends on (seed, round, document, word or
coordinate, copy) only, so both ways draw the same, and so does a task that runs again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.operators.text import checkpointed

#: Most words and coordinates (with copies) of a document that is one row, and most counts of words by topic that go with a task.
MOST_TOKENS, MOST_COUNTS = 512, 1 << 20
#: Numbers that a task holds of the documents that it draws at once (about): one for each word and topic, coordinate and region.
SLICE = 1 << 18


@dataclass(frozen=True)
class Priors:
    """Counts added to topics of a document (alpha), words of a topic (beta), a document's coordinates when words are drawn
    (gamma) and regions of a topic (delta); a covariance of ``size`` on its diagonal weighs ``weight`` coordinates."""

    alpha: float = 0.1
    beta: float = 0.01
    gamma: float = 0.01
    delta: float = 1.0
    size: float = 50.0
    weight: float = 25.0


@dataclass(frozen=True)
class Regions:
    """Counts (topics x regions), means (... x 3) and covariances (... x 3 x 3)."""

    n: np.ndarray
    mean: np.ndarray
    sigma: np.ndarray

    def log_density(self, xyz: np.ndarray) -> np.ndarray:
        """Coordinates x topics x regions."""
        off = [xyz[:, a, None, None] - self.mean[..., a] for a in range(3)]
        inverse = np.linalg.inv(self.sigma)
        square = sum(off[a] * sum(inverse[..., a, b] * off[b] for b in range(3)) for a in range(3))
        return -0.5 * (square + np.linalg.slogdet(self.sigma)[1] + 3 * np.log(2 * np.pi))

    def log_share(self, delta: float) -> np.ndarray:
        """Log of each region's share of its topic."""
        n = self.n + delta
        return np.log(n / n.sum(1, keepdims=True))


def _unit(*keys: Column | str) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _dense(counts: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """(key, array of n counts) of (key, topic, count)."""
    own = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("topic", "count"))).alias("m"))
    return own.select(key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.coalesce(F.col("m")[t], F.lit(0)).cast("double")).alias(name))


def _matrix(a: pa.Array, n: int) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _numbers(a: pa.Array) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False)


def _picked(weight: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The column that ``u`` draws from each row."""
    upto = weight.cumsum(1)
    return np.minimum((upto / upto[:, -1:] < u[:, None]).sum(1), weight.shape[1] - 1)


def _places(parts: np.ndarray, rest: np.ndarray, words: np.ndarray, prior: Priors, u: np.ndarray) -> np.ndarray:
    """Topic and region, as one number, of coordinates with densities ``parts`` whose documents have ``rest`` other coordinates and ``words`` by topic."""
    logs = parts + (np.log(rest + prior.alpha) + words * np.log1p(1 / (rest + prior.gamma)))[..., None]
    logs = logs.reshape(len(rest), -1)
    return _picked(np.exp(logs - logs.max(1, keepdims=True)), u)


def _peak_score(parts: np.ndarray, own: np.ndarray, prior: Priors) -> np.ndarray:
    n = own + prior.alpha
    logs = (parts + np.log(n / n.sum(1, keepdims=True))[..., None]).reshape(len(n), -1)
    top = logs.max(1)
    return top + np.log(np.exp(logs - top[:, None]).sum(1))


def documents(counts: DataFrame, point: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, word, i, x, y, z, copy), arrays over the copies of a document's words and of its coordinates, of documents with both and at
    most ``MOST_TOKENS`` copies; (doc) of those with more."""
    words = counts.where("n > 0 and word is not null").select(F.col("id").alias("doc"), "word", *[F.lit(None).cast("double").alias(c) for c in "xyz"], "n")
    peaks = point.where("x is not null and y is not null and z is not null").select(F.col("id").alias("doc"), F.lit(None).cast(words.schema["word"].dataType).alias("word"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.lit(1).alias("n"))
    every = words.unionByName(peaks).where("doc is not null")
    large = checkpointed(every.groupBy("doc").agg(F.sum("n").alias("n")).where(F.col("n") > MOST_TOKENS).select("doc"))
    if not large.isEmpty():
        every = every.join(large, "doc", "left_anti")
    # one exchange by document serves both groupings
    rows = every.repartition("doc").groupBy("doc", "word", *"xyz").agg(F.sum("n").cast("int").alias("n"))
    rows = rows.groupBy("doc").agg(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "n"))).alias("w"), F.collect_list(F.when(F.col("word").isNull(), F.struct(*"xyz", "n"))).alias("p"))
    copies = lambda of, columns, name: F.flatten(F.transform(of, lambda a: F.transform(F.sequence(F.lit(1), a["n"]), lambda i: F.struct(*[a[c].alias(c) for c in columns], i.alias(name)))))
    rows = rows.where("size(w) > 0 and size(p) > 0").select("doc", copies("w", ["word"], "i").alias("w"), copies("p", "xyz", "copy").alias("p"))
    return rows.select("doc", *[F.col(f"w.{c}").alias(c) for c in ("word", "i")], *[F.col(f"p.{c}").alias(c) for c in (*"xyz", "copy")]), large


def _each_peak(docs: DataFrame, n_regions: int) -> DataFrame:
    """(doc, x, y, z, copy, topic, region) of rows of documents."""
    rows = docs.select("doc", F.explode(F.arrays_zip(*"xyz", "copy", "place")).alias("p")).select("doc", "p.*")
    return rows.select("doc", *"xyz", "copy", F.floor(F.col("place") / n_regions).cast("int").alias("topic"), (F.col("place") % n_regions).alias("region"))


def _each_word(docs: DataFrame, n_topics: int) -> DataFrame:
    """(doc, word, n, topics) of rows of documents."""
    rows = docs.select("doc", F.explode(F.arrays_zip("word", "i", "pairs")).alias("w")).select("doc", "w.word", F.struct("w.i", (F.col("w.pairs") % n_topics).alias("topic")).alias("t"))
    return rows.groupBy("doc", "word").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list("t"))["topic"].alias("topics"))


def tokens(counts: DataFrame, point: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, word, n) and (doc, x, y, z, copy) of the documents that have words and coordinates; rows of null or no count, or without a place, are none."""
    words = counts.where("n > 0 and word is not null").groupBy(F.col("id").alias("doc"), "word").agg(F.sum("n").cast("int").alias("n"))
    peaks = point.where("x is not null and y is not null and z is not null").groupBy(F.col("id").alias("doc"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).agg(F.count("*").cast("int").alias("n"))
    both = words.select("doc").distinct().join(peaks.select("doc").distinct(), "doc")
    peaks = peaks.select("doc", *"xyz", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    return words.join(both, "doc", "left_semi"), peaks.join(both, "doc", "left_semi")


def estimate(peaks: DataFrame, n_topics: int, n_regions: int, symmetric: bool, prior: Priors) -> Regions:
    """Gaussians of the regions from sums that Spark makes. In a pair of mirrored regions both means come from both
    regions' coordinates, the first axis turned; covariances stay each region's own."""
    products = [(a, b) for a in range(3) for b in range(a, 3)]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xyz"], *[F.sum(F.col("xyz"[a]) * F.col("xyz"[b])).alias(f"s{a}{b}") for a, b in products]]
    n, total, cross = np.zeros((n_topics, n_regions)), np.zeros((n_topics, n_regions, 3)), np.zeros((n_topics, n_regions, 3, 3))
    for r in peaks.groupBy("topic", "region").agg(*sums).collect():  # a row a region
        at = r["topic"], r["region"]
        n[at], total[at] = r["n"], [r[c] for c in "xyz"]
        for a, b in products:
            cross[(*at, a, b)] = cross[(*at, b, a)] = r[f"s{a}{b}"]
    some = np.maximum(n, 1)[..., None]
    centre = total / some
    mean = centre
    if symmetric:
        turn = np.array([-1.0, 1.0, 1.0])
        first = total[:, 0::2] + total[:, 1::2] * turn
        half = first / np.maximum(n[:, 0::2] + n[:, 1::2], 1)[..., None]
        mean = np.stack([half, half * turn], 2).reshape(centre.shape)
    wide = prior.size * np.eye(3)
    own = cross / some[..., None] - centre[..., :, None] * centre[..., None, :]
    own *= (some / np.maximum(some - 1, 1))[..., None]  # unbiased
    own = np.where((n > 1)[..., None, None], own, wide)
    share = (n / (n + prior.weight))[..., None, None]
    return Regions(n, mean, share * own + (1 - share) * wide)


def draw_words(words: DataFrame, by_word: DataFrame, by_doc: DataFrame, totals: np.ndarray, prior: Priors, n_words: int, keys: list[Column]) -> DataFrame:
    """(doc, word, n, topics, score): a topic for each copy of a word, and the log likelihood of all copies."""
    n_topics = len(totals)

    def weights(counts: pa.Array, peaks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        given = (_matrix(counts, n_topics) + prior.beta) / (totals + n_words * prior.beta)
        return given, _matrix(peaks, n_topics) + prior.gamma

    def draw(counts: pa.Array, peaks: pa.Array, u: pa.Array) -> pa.Array:
        given, own = weights(counts, peaks)
        length = u.value_lengths().to_numpy(zero_copy_only=False)
        topic = _picked(np.repeat(given * own, length, 0), _numbers(u))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, length.cumsum()].astype(np.int32)), pa.array(topic.astype(np.int32)))

    def score(counts: pa.Array, peaks: pa.Array, n: pa.Array) -> pa.Array:
        given, own = weights(counts, peaks)
        return pa.array(np.log((given * own).sum(1) / own.sum(1)) * n.to_numpy(zero_copy_only=False))

    none = F.array_repeat(F.lit(0.0), n_topics)
    rows = words.select("doc", "word", "n").join(by_word, "word", "left").join(by_doc.select("doc", "peak_topics"), "doc", "left")
    rows = rows.withColumns({"counts": F.coalesce("counts", none), "peak_topics": F.coalesce("peak_topics", none)})
    rows = rows.withColumn("u", F.transform(F.sequence(F.lit(1), "n"), lambda i: _unit(*keys, F.col("doc"), F.col("word"), i)))
    return rows.select("doc", "word", "n", F.arrow_udf(draw, "array<int>")("counts", "peak_topics", "u").alias("topics"), F.arrow_udf(score, "double")("counts", "peak_topics", "n").alias("score"))


def draw_peaks(peaks: DataFrame, by_doc: DataFrame, regions: Regions, prior: Priors, keys: list[Column]) -> DataFrame:
    """(doc, x, y, z, copy, topic, region, score): a topic and region for each coordinate, and its log likelihood."""
    n_topics, n_regions = regions.n.shape
    share = regions.log_share(prior.delta)

    def parts(x: pa.Array, y: pa.Array, z: pa.Array) -> np.ndarray:
        return regions.log_density(np.stack([c.to_numpy(zero_copy_only=False) for c in (x, y, z)], 1)) + share

    def draw(x: pa.Array, y: pa.Array, z: pa.Array, words: pa.Array, others: pa.Array, topic: pa.Array, u: pa.Array) -> pa.Array:
        n = _matrix(others, n_topics).copy()
        n[np.arange(len(n)), topic.to_numpy(zero_copy_only=False)] -= 1  # without itself
        return pa.array(_places(parts(x, y, z), n, _matrix(words, n_topics), prior, u.to_numpy(zero_copy_only=False)).astype(np.int32))

    def score(x: pa.Array, y: pa.Array, z: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array(_peak_score(parts(x, y, z), _matrix(own, n_topics), prior))

    none = F.array_repeat(F.lit(0.0), n_topics)
    rows = peaks.join(by_doc, "doc", "left").withColumns({c: F.coalesce(c, none) for c in ("word_topics", "peak_topics")})
    place = F.arrow_udf(draw, "int")(*"xyz", "word_topics", "peak_topics", "topic", _unit(*keys, F.col("doc"), *map(F.col, "xyz"), F.col("copy")))
    rows = rows.select("doc", *"xyz", "copy", place.alias("place"), F.arrow_udf(score, "double")(*"xyz", "peak_topics").alias("score"))
    return rows.select("doc", *"xyz", "copy", F.floor(F.col("place") / n_regions).cast("int").alias("topic"), (F.col("place") % n_regions).alias("region"), "score")


def draw_documents(docs: DataFrame, sent: Broadcast, regions: Regions, prior: Priors, keys: list[Column]) -> DataFrame:
    """``docs`` with new ``place`` (topic * regions + region of each coordinate), ``pairs`` (a word's number in the vocabulary * topics +
    its topic), word_score and peak_score (log likelihoods). ``sent``: the vocabulary, and each topic's share for its words."""
    n_topics, n_regions = regions.n.shape
    share = regions.log_share(prior.delta)

    def draw(given: np.ndarray, word: np.ndarray, of_word: np.ndarray, u: np.ndarray, xyz: np.ndarray, place: np.ndarray, of_peak: np.ndarray, v: np.ndarray, size: int) -> tuple:
        topic = place // n_regions
        tally = lambda of, t: np.bincount(of * n_topics + t, minlength=size * n_topics).reshape(size, n_topics).astype(float)
        peaks = tally(of_peak, topic)
        own = (peaks + prior.gamma)[of_word]
        weight = given[word] * own
        drawn = _picked(weight, u)
        parts, rest = regions.log_density(xyz) + share, peaks[of_peak]
        score = np.log(weight.sum(1) / own.sum(1)), _peak_score(parts, rest, prior)
        rest[np.arange(len(topic)), topic] -= 1  # without itself
        moved = _places(parts, rest, tally(of_word, drawn)[of_peak], prior, v)
        return word * n_topics + drawn, moved, np.bincount(of_word, score[0], size), np.bincount(of_peak, score[1], size)

    def run(word: pa.Array, u: pa.Array, x: pa.Array, y: pa.Array, z: pa.Array, place: pa.Array, v: pa.Array) -> pa.Array:
        vocabulary, given = sent.value
        words, peaks = (np.r_[0, a.value_lengths().to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)] for a in (word, place))
        index = pc.index_in(word.flatten(), vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        u, place, v, xyz = _numbers(u), _numbers(place), _numbers(v), np.stack([_numbers(a) for a in (x, y, z)], 1)
        part = (words[1:] + peaks[1:] * n_regions) * n_topics // SLICE
        ends, out = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)], []
        for a, b in zip(ends[:-1], ends[1:]):
            w, p = slice(words[a], words[b]), slice(peaks[a], peaks[b])
            of_word, of_peak = (np.repeat(np.arange(b - a), np.diff(at[a : b + 1])) for at in (words, peaks))
            out.append(draw(given, index[w], of_word, u[w], xyz[p], place[p], of_peak, v[p], b - a))
        pairs, moved, *scores = (np.concatenate(each) for each in zip(*out))
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(each.astype(np.int32))) for at, each in ((words, pairs), (peaks, moved))]
        return pa.StructArray.from_arrays([*lists, *map(pa.array, scores)], ["pairs", "place", "word_score", "peak_score"])

    units = lambda *of: F.transform(F.arrays_zip(*of), lambda t: _unit(*keys, F.col("doc"), *[t[c] for c in of]))
    drawn = F.arrow_udf(run, "struct<pairs array<int>, place array<int>, word_score double, peak_score double>")("word", units("word", "i"), *"xyz", "place", units(*"xyz", "copy"))
    return docs.select("doc", "word", "i", *"xyz", "copy", drawn.alias("drawn")).select("doc", "word", "i", *"xyz", "copy", "drawn.*")


def _start(at: list[Column], n_topics: int, n_regions: int, symmetric: bool, seed: int) -> tuple[Column, Column]:
    """The first topic and region of a coordinate (doc, x, y, z, copy)."""
    drawn = F.xxhash64(*at, F.lit(seed + 1))
    region = 2 * F.pmod(drawn, F.lit(max(n_regions // 2, 1))).cast("int") + (at[1] > 0).cast("int") if symmetric else F.pmod(drawn, F.lit(n_regions)).cast("int")
    return F.pmod(F.xxhash64(*at, F.lit(seed)), F.lit(n_topics)).cast("int"), region


def fit(counts: DataFrame, point: DataFrame, n_topics: int = 100, n_regions: int = 2, symmetric: bool = True, rounds: int = 100, prior: Priors | None = None, seed: int = 1) -> dict:
    """A model of counts (id, word, n) and points (id, x, y, z).

    Gives ``words`` (word, topic, count), ``regions``, ``totals`` of words by topic, ``likelihood`` (log, of words and of coordinates before
    each round's draws) and the state, ``word_state`` and ``peak_state``. Symmetric regions come in pairs; an odd
    number of them is an error. Documents lacking words or coordinates are left out; without any, all counts are 0.
    """
    prior = prior or Priors()
    if symmetric and n_regions % 2:
        raise ValueError("mirrored regions come in pairs")
    if not rounds:
        raise ValueError("at least one round")
    spark, key = counts.sparkSession, (*"xyz", "copy")
    docs, large = documents(counts, point)
    first = lambda p: _start([F.col("doc"), *[p[c] for c in key]], n_topics, n_regions, symmetric, seed)
    docs = checkpointed(docs.withColumn("place", F.transform(F.arrays_zip(*key), lambda p: first(p)[0] * n_regions + first(p)[1])))
    names, words = docs.select(F.explode("word").alias("word")), None
    if not large.isEmpty():
        words, peaks = map(checkpointed, tokens(*(t.join(large.select(F.col("doc").alias("id")), "id", "left_semi") for t in (counts, point))))
        names = names.unionByName(words.select("word"))
    names = checkpointed(names.distinct())
    n_words = max(names.count(), 1)
    if n_words * n_topics <= MOST_COUNTS:
        vocabulary = names.toArrow()["word"].combine_chunks()
    else:
        docs, words, peaks = None, *map(checkpointed, tokens(counts, point))
    if words is not None:
        topic, region = _start([F.col("doc"), *map(F.col, key)], n_topics, n_regions, symmetric, seed)
        peaks = checkpointed(peaks.withColumns({"topic": topic, "region": region}))
        by_word = words.select("word").limit(0).withColumn("counts", F.array_repeat(F.lit(0.0), n_topics))
    both = lambda of_docs, others: others if docs is None else of_docs if words is None else of_docs.unionByName(others)
    every_peak = lambda: both(docs is not None and _each_peak(docs, n_regions), words is not None and peaks.select("doc", *key, "topic", "region"))
    matrix, totals, likelihood, before = np.zeros((len(vocabulary), n_topics)) if docs is not None else None, np.zeros(n_topics), [], []
    for r in range(rounds):
        keys = [F.lit(seed), F.lit(r)]
        regions, now, scores = estimate(every_peak(), n_topics, n_regions, symmetric, prior), [], np.zeros(2)
        if docs is not None:
            sent = spark.sparkContext.broadcast((vocabulary, (matrix + prior.beta) / (totals + n_words * prior.beta)))
            docs = checkpointed(draw_documents(docs, sent, regions, prior, keys))
            now.append(docs)
            scores += [x or 0.0 for x in docs.agg(F.sum("word_score"), F.sum("peak_score")).first()]
            matrix = np.zeros(matrix.shape)
            t = docs.select(F.explode("pairs").alias("pair")).groupBy("pair").count().toArrow()
            matrix.ravel()[t["pair"].to_numpy()] = t["count"].to_numpy()
        if words is not None:
            by_doc = _dense(peaks.groupBy("doc", "topic").count(), "doc", n_topics, "peak_topics")
            drawn = checkpointed(draw_words(words, by_word, by_doc, totals, prior, n_words, keys))
            table = checkpointed(drawn.select("doc", "word", F.explode("topics").alias("topic")).groupBy("doc", "word", "topic").count())
            by_doc = by_doc.join(_dense(table.groupBy("doc", "topic").agg(F.sum("count").alias("count")), "doc", n_topics, "word_topics"), "doc", "left")
            moved = checkpointed(draw_peaks(peaks, by_doc, regions, prior, keys))
            now += [drawn, table, moved]
            scores += [x.agg(F.sum("score")).first()[0] or 0.0 for x in (drawn, moved)]
            of_word = table.groupBy("word", "topic").agg(F.sum("count").alias("count"))
            peaks = moved.drop("score")
        likelihood.append(scores)
        for old in before:
            old.unpersist()
        before = now
        if docs is not None:
            if words is not None:
                t = of_word.toArrow()
                np.add.at(matrix, (pc.index_in(t["word"], vocabulary).to_numpy(), t["topic"].to_numpy()), t["count"].to_numpy())
            totals, (word, topic) = matrix.sum(0), np.nonzero(matrix)
            rows = pa.table({"word": vocabulary.take(pa.array(word)), "topic": pa.array(topic.astype(np.int32)), "count": pa.array(matrix[word, topic].astype(np.int64))})
            of_word = spark.createDataFrame(rows)
        else:
            totals = np.zeros(n_topics)
            for row in of_word.groupBy("topic").agg(F.sum("count").alias("n")).collect():  # a row a topic
                totals[row["topic"]] = row["n"]
        if words is not None:
            by_word = _dense(of_word, "word", n_topics, "counts")
    word_state = both(docs is not None and _each_word(docs, n_topics), words is not None and drawn.select("doc", "word", "n", "topics"))
    return {"words": of_word, "regions": estimate(every_peak(), n_topics, n_regions, symmetric, prior), "totals": totals, "likelihood": np.array(likelihood), "word_state": word_state, "peak_state": every_peak()}


def word_given_topic(model: dict) -> DataFrame:
    """(word, topic, p); words that a topic never drew are not rows."""
    totals = F.array(*[F.lit(float(max(t, 1.0))) for t in model["totals"]])
    return model["words"].select("word", "topic", (F.col("count") / totals[F.col("topic")]).alias("p"))


def topic_given_word(model: dict) -> DataFrame:
    """(word, topic, p); topics that a word never had are not rows."""
    every = model["words"].groupBy("word").agg(F.sum("count").alias("every"))
    return model["words"].join(every, "word").select("word", "topic", (F.col("count") / F.col("every")).alias("p"))


def topic_given_place(model: dict, places: DataFrame) -> DataFrame:
    """All columns of ``places`` (x, y, z and others), topic, density and p: the topic's summed densities of its regions, and that as a share of all topics' (0 where all vanish)."""
    regions = model["regions"]

    def run(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        density = np.exp(regions.log_density(np.stack([c.to_numpy(zero_copy_only=False) for c in (x, y, z)], 1))).sum(2)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(density) + 1, dtype=np.int32) * density.shape[1]), pa.array(density.ravel()))

    rows = places.withColumn("_density_", F.arrow_udf(run, "array<double>")(*[F.col(c).cast("double") for c in "xyz"]))
    every = F.aggregate("_density_", F.lit(0.0), lambda a, d: a + d)
    rows = rows.withColumn("_every_", every).select(*places.columns, "_every_", F.posexplode("_density_").alias("topic", "density"))
    return rows.withColumn("p", F.coalesce(F.try_divide("density", "_every_"), F.lit(0.0))).drop("_every_")


def place_given_topic(model: dict, places: DataFrame) -> DataFrame:
    """All columns of ``places``, topic and p: the place's share of the topic's density over all places."""
    rows = topic_given_place(model, places)
    every = rows.groupBy("topic").agg(F.sum("density").alias("_every_"))
    return rows.join(every, "topic").withColumn("p", F.coalesce(F.try_divide("density", "_every_"), F.lit(0.0))).select(*places.columns, "topic", "p")
