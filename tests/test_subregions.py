"""Topics with regions: planted regions are found, likelihoods and estimates are those of plain code, draws are the same again."""

import numpy as np
import pytest

from quillmap.operators import subregions as s

P = s.Priors()


@pytest.fixture(scope="module")
def planted(spark):
    """Two topics; each has two mirrored regions and four words of its own."""
    rng = np.random.default_rng(3)
    centre = np.array([[[-40.0, 20, 10], [40, 20, 10]], [[-20.0, -50, 30], [20, -50, 30]]])
    counts, point = [], []
    for d in range(60):
        t = d % 2
        counts += [(d, f"w{w + 4 * t}", int(rng.integers(1, 4))) for w in rng.choice(4, 3, replace=False)]
        point += [(d, *map(float, rng.normal(centre[t, rng.integers(2)], 3))) for _ in range(6)]
    counts += [(100, "w1", 3), (1, None, 2), (1, "w9", 0)]
    point += [(101, 1.0, 1.0, 1.0), (2, None, 0.0, 0.0), point[0], point[0]]
    return centre, spark.createDataFrame(counts, "id long, word string, n int"), spark.createDataFrame(point, "id long, x double, y double, z double")


def test_planted_regions_are_found(spark, planted):
    centre, counts, point = planted
    model = s.fit(counts, point, 2, 2, rounds=12, seed=4)
    total = model["likelihood"].sum(1)
    assert total[-1] > total[1] > total[0]
    regions = model["regions"]
    assert regions.mean[:, 0] == pytest.approx(regions.mean[:, 1] * [-1, 1, 1])
    order = [0, 1] if regions.mean[0, 0, 1] > 0 else [1, 0]
    assert np.abs(regions.mean[order] - centre).max() < 2.0 and regions.n.sum() == 60 * 6 + 2
    assert (regions.n > 60).all()
    p = {(r["word"], r["topic"]): r["p"] for r in s.word_given_topic(model).collect()}
    assert sum(v for (w, t), v in p.items() if t == order[0] and w < "w4") > 0.95
    assert {t: pytest.approx(1.0) for t in (0, 1)} == {t: sum(v for (_, u), v in p.items() if u == t) for t in (0, 1)}
    back = s.topic_given_word(model).groupBy("word").sum("p").collect()
    assert len(back) == 8 and all(r[1] == pytest.approx(1.0) for r in back)
    at = spark.createDataFrame([(n, *map(float, c)) for n, c in enumerate(centre.reshape(4, 3))], "voxel long, x double, y double, z double")
    got = {(r["voxel"], r["topic"]): r["p"] for r in s.topic_given_place(model, at).collect()}
    assert all(got[v, order[v // 2]] > 0.99 for v in range(4))
    share = s.place_given_topic(model, at).groupBy("topic").sum("p").collect()
    assert all(r[1] == pytest.approx(1.0) for r in share)
    assert s.topic_given_place(model, spark.createDataFrame([(0, 1e6, 0.0, 0.0)], at.schema)).agg({"p": "sum"}).first()[0] == 0


def test_estimates_are_those_of_plain_code(spark):
    rng = np.random.default_rng(5)
    rows = [(*map(float, rng.normal(0, 20, 3)), int(rng.integers(3)), int(rng.integers(4))) for _ in range(80)]
    rows = [r for r in rows if r[3:] not in ((1, 2), (2, 0))] + [(1.0, 2.0, 3.0, 1, 2)]  # one region with one, one with none
    df = spark.createDataFrame(rows, "x double, y double, z double, topic int, region int")
    for symmetric in (False, True):
        got = s.estimate(df, 3, 4, symmetric, P)
        for t, r in np.ndindex(3, 4):
            own = np.array([x[:3] for x in rows if x[3:] == (t, r)]).reshape(-1, 3)
            n = len(own)
            assert got.n[t, r] == n
            other = np.array([x[:3] for x in rows if x[3:] == (t, r ^ 1)]).reshape(-1, 3) * [-1, 1, 1]
            both = np.concatenate([own, other]) if symmetric else own
            assert got.mean[t, r] == pytest.approx(both.mean(0) if len(both) else np.zeros(3))
            cov = np.cov(own.T) if n > 1 else 50.0 * np.eye(3)
            assert got.sigma[t, r] == pytest.approx((n * cov + 25 * 50.0 * np.eye(3)) / (n + 25))


def test_likelihoods_and_draws_are_those_of_plain_code(spark, planted):
    _, counts, point = planted
    model = s.fit(counts, point, 3, 2, rounds=2, seed=7)
    again = s.fit(counts.repartition(7), point.repartition(5), 3, 2, rounds=2, seed=7)
    key = ["doc", "x", "y", "z", "copy"]
    assert sorted(map(tuple, model["peak_state"].select(*key, "topic", "region").collect())) == sorted(map(tuple, again["peak_state"].select(*key, "topic", "region").collect()))
    words, peaks = model["word_state"].collect(), model["peak_state"].collect()
    assert all(len(r["topics"]) == r["n"] for r in words) and {r["doc"] for r in words} == {r["doc"] for r in peaks} == set(range(60))
    T, vocabulary = 3, sorted({r["word"] for r in words})
    by_word, by_doc = np.zeros((len(vocabulary), T)), {d: np.zeros(T) for d in range(60)}
    word_doc = {d: np.zeros(T) for d in range(60)}
    for r in words:
        for t in r["topics"]:
            by_word[vocabulary.index(r["word"]), t] += 1
            word_doc[r["doc"]][t] += 1
    for r in peaks:
        by_doc[r["doc"]][r["topic"]] += 1
    doc_rows = spark.createDataFrame([(d, by_doc[d].tolist(), word_doc[d].tolist()) for d in range(60)], "doc long, peak_topics array<double>, word_topics array<double>")
    word_rows = spark.createDataFrame([(w, by_word[n].tolist()) for n, w in enumerate(vocabulary)], "word string, counts array<double>")
    keys = [s.F.lit(7), s.F.lit(9)]
    drawn = s.draw_words(model["word_state"].select("doc", "word", "n"), word_rows, doc_rows, by_word.sum(0), P, len(vocabulary), keys)
    for r in drawn.collect():
        given = (by_word[vocabulary.index(r["word"])] + P.beta) / (by_word.sum(0) + len(vocabulary) * P.beta)
        own = (by_doc[r["doc"]] + P.gamma) / (by_doc[r["doc"]] + P.gamma).sum()
        assert r["score"] == pytest.approx(r["n"] * np.log((given * own).sum()))
    regions = model["regions"]
    moved = s.draw_peaks(model["peak_state"], doc_rows, regions, P, keys).collect()
    share = (regions.n + P.delta) / (regions.n + P.delta).sum(1, keepdims=True)
    before = {tuple(r[c] for c in key): r["topic"] for r in peaks}
    units = {tuple(r[c] for c in key): r["u"] for r in model["peak_state"].withColumn("u", s._unit(*keys, *map(s.F.col, key))).collect()}
    for r in moved:
        x, n, k = np.array([r[c] for c in "xyz"]), by_doc[r["doc"]], tuple(r[c] for c in key)
        density = np.array([[np.exp(-0.5 * (x - m) @ np.linalg.inv(v) @ (x - m)) / np.sqrt(np.linalg.det(2 * np.pi * v)) for m, v in zip(a, b)] for a, b in zip(regions.mean, regions.sigma)])
        p = (n + P.alpha) / (n + P.alpha).sum()
        assert r["score"] == pytest.approx(np.log((p[:, None] * share * density).sum()))
        rest = n - np.eye(T)[before[k]]
        weight = (density * share * ((rest + P.alpha) * ((rest + P.gamma + 1) / (rest + P.gamma)) ** word_doc[r["doc"]])[:, None]).ravel()
        assert r["topic"] * 2 + r["region"] == int((weight.cumsum() / weight.sum() < units[k]).sum())


def test_edges(spark, planted):
    _, counts, point = planted
    with pytest.raises(ValueError, match="pairs"):
        s.fit(counts, point, 2, 3)
    odd = s.fit(counts, point, 2, 3, symmetric=False, rounds=1)
    assert odd["regions"].n.shape == (2, 3) and odd["regions"].n.sum() == 362
    none = s.fit(counts.limit(0), point, 2, 2, rounds=1)
    assert none["words"].count() == 0 and none["regions"].n.sum() == 0 and none["likelihood"].tolist() == [[0, 0]]


@pytest.mark.parametrize(("tokens", "numbers", "sizes"), [(12, 1 << 20, 1 << 18), (0, 1 << 20, 1 << 18), (512, 0, 1 << 18), (512, 1 << 20, 1)])
def test_documents_as_rows_and_by_joins_draw_the_same(spark, planted, monkeypatch, tokens, numbers, sizes):
    """Some documents, all of them, or all words too many for a row or task; slices of one document."""
    _, counts, point = planted
    state = lambda m: [sorted(map(tuple, m[k].collect()), key=repr) for k in ("word_state", "peak_state", "words")]
    want = s.fit(counts, point, 3, 2, rounds=3, seed=7)
    before = state(want)
    monkeypatch.setattr(s, "MOST_TOKENS", tokens)
    monkeypatch.setattr(s, "MOST_COUNTS", numbers)
    monkeypatch.setattr(s, "SLICE", sizes)
    got = s.fit(counts, point, 3, 2, rounds=3, seed=7)
    assert state(got) == before
    assert got["totals"].tolist() == want["totals"].tolist() and got["likelihood"] == pytest.approx(want["likelihood"])


def test_a_round_over_rows_of_documents_shuffles_nothing(spark, planted):
    _, counts, point = planted
    docs, large = s.documents(counts, point)
    assert large.count() == 0 and docs.count() == 60
    held = docs.withColumn("place", s.F.transform("copy", lambda _: s.F.lit(0)))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    zero = s.Regions(np.zeros((3, 2)), np.zeros((3, 2, 3)), np.tile(50.0 * np.eye(3), (3, 2, 1, 1)))
    sent = spark.sparkContext.broadcast((s.pa.array(sorted(r[0] for r in counts.where("word is not null").select("word").distinct().collect())), np.ones((9, 3))))
    drawn = s.draw_documents(held, sent, zero, P, [s.F.lit(1), s.F.lit(0)])
    assert drawn._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert all(len(r["pairs"]) == len(r["word"]) and len(r["place"]) == len(r["x"]) for r in drawn.collect())
