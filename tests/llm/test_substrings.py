"""Substring dedup against brute force, SQL aside (which tests/llm/test_corpus.py compares)."""

import hashlib
import random
import re
from collections import Counter

import pytest

from quillmap.llm import substrings


def brute(rows, window):
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for (d, _), s in zip(rows, seqs, strict=True):
        gone = set()
        for i in range(len(s) - window + 1):
            if n[tuple(s[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(s) if i not in gone)
        out.append((d, len(s), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, window):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in substrings.dedup_substrings(docs, ["doc_id"], window).collect()), key=str)


@pytest.mark.parametrize("window", [35, 7, 4, 1])
def test_same_as_brute_force(spark, window):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for d in range(60):
        s = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            a = rng.randint(0, 20)
            at = rng.randint(0, len(s))
            s[at:at] = passage[a : a + rng.randint(30, 40)]
        rows.append((d, " ".join(s)))
    rows += [(7, rows[7][1]), (None, rows[9][1]), (None, None), (None, ""), (200, None), (201, " \n\t"), (202, "w " * 300), (203, "w " * 34), (204, "x y " * 40), (204, "x y " * 40), (205, "é ü ß " * 30)]
    assert run(spark, rows, window) == brute(rows, window)


def test_long_text_over_chunks(spark, monkeypatch):
    rng = random.Random(5)
    s = [f"w{rng.randint(0, 10**6)}" for _ in range(150_000)]
    shared = s[65_500:65_600]
    rows = [(1, " ".join(s)), (2, " ".join(["a", "b", *shared, "c"])), (3, " ".join(shared[20:54]))]
    assert run(spark, rows, 35) == brute(rows, 35)


def test_empty_table_and_names(spark):
    assert run(spark, [], 35) == []
    docs = spark.createDataFrame([(1, "a b c a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, hits int, k1 string").withColumnRenamed("hits", "n_words_")
    out = substrings.dedup_substrings(docs, ["doc_id", "n_words_", "k1"], 3, texts=False)
    assert sorted(map(tuple, out.select("doc_id", "n_words_", "k1", "n_words", "n_removed").collect())) == [(1, 5, "x", 6, 6), (2, 6, "y", 3, 3)]


def test_one_passage_in_a_third_of_rows(spark):
    rng = random.Random(9)
    passage = " ".join(f"q{i}" for i in range(50))
    rows = [(d, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40)) + (" " + passage if d % 3 == 0 else "")) for d in range(600)]
    assert run(spark, rows, 35) == brute(rows, 35)
