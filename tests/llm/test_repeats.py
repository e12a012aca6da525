"""Rows that share a doc_id, ties, and what threads leave alone."""

import collections
import threading

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmap.llm import common, mixing, toxicity


def by_source(rows):
    out = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        out[r["source"]][0] += r["taken"]
        out[r["source"]][1] = r["target"]
        out[r["source"]][2] = max(out[r["source"]][2], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    return out


def test_ties_at_the_cut_stay_within_the_target(spark):
    docs = spark.createDataFrame([(7, "a", 3)] * 1000, "doc_id long, source string, size long")
    planned = spark.createDataFrame([("a", 3000, 2000.0)], "source string, source_size long, target double")
    rows = mixing.mix(docs, planned).collect()
    assert len(rows) == 1000 and abs(sum(r["taken"] for r in rows) - 2000) <= 3


@pytest.mark.parametrize("sent", [common.MOST_SENT, 1])
def test_one_doc_id_on_a_third_of_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "MOST_SENT", sent)
    monkeypatch.setattr(mixing, "RANGES", 16)
    rows = [(None if i % 11 == 0 else 5 if i % 3 == 0 else i, " ".join(["w"] * (4 if i % 3 == 0 else 1 + i % 9)), "en", ("a", "b", None)[i % 2 if i % 5 else 2], 0) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_documents(docs).collect()
    assert len(got) == 900
    for taken, target, largest in by_source(got).values():
        assert abs(taken - target) <= largest
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]))
    mine = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=str)
    assert mine == sorted(((*r[:3], round(r[3], 6), r[4]) for r in con.sql(mixing.SQL).fetchall()), key=str)
    again = mixing.mix_documents(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_a_null_doc_id_fills_a_gap_once(spark):
    docs = spark.createDataFrame([(None, "a", 5)] * 3 + [(1, "a", 50)], "doc_id long, source string, size long")
    planned = spark.createDataFrame([("a", 65, 12.0)], "source string, source_size long, target double")
    rows = mixing.mix(docs, planned).collect()
    # two fit where they come before the long document; where it comes first nothing fits, and one row, not all three of its kind, fills the gap
    assert sum(r["taken"] for r in rows) in (5, 10)


def test_toxicity_sample_is_bounded_where_doc_ids_repeat(spark):
    rows = [(1, f"text number {i}") for i in range(3000)] + [(1, "text number 0")] * 500 + [(10 + i, f"other {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)] + [(10 + i, i % 2) for i in range(400)], "doc_id long, label int")
    got, share = toxicity.sample(docs, labels, None, 50, 100)
    assert 20 < got.num_rows < 250 and share == pytest.approx(200 / 3400)
    assert len(set(zip(got["doc_id"].to_pylist(), got["h"].to_pylist(), strict=True))) == got.num_rows


def test_toxicity_trains_in_a_task(spark, monkeypatch):
    rows = [(i, f"word{i % 7} text {i}" + (" vilescum" if i % 3 == 0 else "")) for i in range(120)] + [(0, None), (None, "text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, label int")
    got, share = toxicity.sample(docs, labels)
    own = toxicity.fit(list(zip(got["text"].to_pylist(), got["y"].to_pylist(), strict=True)), share)

    def here(*_):
        raise AssertionError("the sample came to the driver")

    monkeypatch.setattr(toxicity, "grams", here)  # workers import their own
    model = toxicity.train(docs, labels)
    assert got.num_rows == 121 and model.bias == own.bias and np.array_equal(model.weights, own.weights)
    assert not toxicity.train(docs, labels.limit(0)).weights.any()


def test_release_leaves_other_threads_tables(spark):
    made, ready, done = {}, threading.Event(), threading.Event()

    def other():
        made["df"] = common.materialize(spark.range(5).toDF("x"), "other")
        ready.set()
        done.wait(60)
        made["n"] = made["df"].count()

    t = threading.Thread(target=other)
    since = len(common.written(spark))
    common.materialize(spark.range(3).toDF("x"), "one")
    t.start()
    ready.wait(60)
    last = common.materialize(spark.range(4).toDF("x"), "two")
    common.release(spark, since)
    done.set()
    t.join(60)
    assert made["n"] == 5 and last.count() == 4


def test_dealing_of_a_large_table_is_a_function_of_the_row(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_SENT", 0)
    rows = spark.createDataFrame([(i, f"k{i % 3}") for i in range(50)], "v long, k string")
    small = spark.createDataFrame([("k0", 1), ("k1", 2)], "name string, w long")
    out = common.look_up(rows, small, "k", "name")
    assert "rand(" not in out._jdf.queryExecution().toString()
    assert out.agg(F.sum("w")).first()[0] == 17 + 2 * 17 and out.count() == 50


def test_scores_and_training_step_match_plain_code(spark):
    import numpy as np

    from quillmap.llm import kernels as K

    def bucket(gram):
        code = 0
        for byte in gram:
            code = code << 8 | byte
        return int(K.mix(np.array([(code + len(gram)) & K.MASK], np.uint64))[0] >> np.uint64(64 - 12))

    def plain(text, model):
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).encode()
        found = [w for w in words.split(b" ") if w]
        total, n = 0.0, 0
        for w in found:
            marked = b"\0" + w + b"\0"
            for size in toxicity.ORDERS:
                for i in range(len(marked) - size + 1):
                    total += float(model.weights[bucket(marked[i : i + size])])
                    n += 1
        return 1 / (1 + np.exp(-(model.bias + total / (n + toxicity.EMPTY)))), n

    rng = np.random.default_rng(2)
    model = toxicity.Model(12, -0.4, rng.normal(0, 30, 1 << 12).astype(np.float32))
    texts = ["some Words, and MORE words", "", None, "a", "x-y z9", "\u00e9t\u00e9 \u00c9T\u00c9 ok", "word " * 3000]
    got = toxicity.score_texts(pa.array(texts), model)
    assert got == pytest.approx([plain(t, model)[0] for t in texts], abs=1e-6)
    # a model learnt from few texts separates them, and its bags hold the n-grams counted plainly
    bags = toxicity.features(texts, 12)
    assert [int(b[1].sum()) for b in bags] == [plain(t, model)[1] for t in texts]
