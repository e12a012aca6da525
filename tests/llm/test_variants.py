"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from quillmap.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top and counts[top] >= 10 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return sorted(out)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in variants.spelling_variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect())


def corpus(seed, n=150):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcéÿ") for _ in range(rng.randint(7, 10))) for _ in range(25)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 80)):
            w = stems[min(int(rng.expovariate(0.4)), 24)]
            if rng.random() < 0.15:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + "z" + w[i + 1 :], w.capitalize()])
            words.append(w)
        rows.append((d, rng.choice([" ", "-", "\n"]).join(words)))
    return rows


def test_same_as_brute_force(spark):
    rows = corpus(1)
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, None), (900, None), (901, ""), (902, "1234 !!"), (903, "Éabcdefg éabcdefg ×÷abcdef Āabcdefghij"), (904, ("q" * 5000 + " ") * 2 + "q" * 5001 + " " + "q" * 5001), (905, "aaaaaaaa aaaaaaa aaaaaaaaa " * 3)]
    want = brute(brute_counts(rows))
    assert sum(r[3] is not None for r in want) > 20
    assert run(spark, rows) == want


def test_chains_and_shared_halves(spark, monkeypatch):
    monkeypatch.setattr(variants, "SHARD_WORDS", 40)
    monkeypatch.setattr(variants, "PART_WORDS", 5)
    monkeypatch.setattr(variants, "ASKED", 16)
    rng = random.Random(8)
    words = {"abcdefghij": 4000, "abcdefghiX".lower(): 300, "abcdefghyx": 20, "abcdefgyyx": 2}
    words |= {"abcdef" + "".join(rng.choice("klm") for _ in range(4)): rng.choice([2, 3, 30]) for _ in range(70)}
    words |= {"".join(rng.choice("klm") for _ in range(4)) + "uvwxyz": rng.choice([2, 3, 30]) for _ in range(70)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = variants.group_variants(variants.materialize(table, "words"))
    got = sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == brute(words)
    assert dict((r[0], r[5]) for r in got)["abcdefgyyx"] == "abcdefghij"


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []
