"""Ranked lexical search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb

from quillmap.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in bags for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in wanted.items():
        found = []
        for (d, bag), n in zip(bags, sizes, strict=True):
            score = 0
            for t in words:
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 50 + (50 * n * n_docs) // total
                    score += w * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search.search(search.build(d.repartition(3)), b, k).collect()), key=str)


def corpus(rng, n):
    return [(d, " ".join(rng.choice(["Alpha", "beta", "gamma-ray", "délta", "x1", "zeta", "eta.", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 60)))) for d in range(n)]


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    docs = corpus(rng, 300)
    docs += [(5, docs[5][1]), (5, "other beta"), (None, docs[7][1]), (None, None), (900, None), (901, ""), (902, "--- ..."), (903, "beta " * 5000), *[(1000, docs[8][1])] * 30]
    items = [(1, "alpha beta ALPHA"), (2, "w1 w2 w3 gamma"), (3, "délta Délta"), (4, "nothing-here-occurs qq"), (5, ""), (6, None), (7, "zeta"), (7, "eta"), (None, "x1"), (None, "w5")]
    assert run(spark, docs, items, 50) == brute(docs, items, 50)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_small_windows_files_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 7)
    monkeypatch.setattr(search, "BLOCK_TERMS", 3)
    monkeypatch.setattr(search, "FILE_WINDOWS", 2)
    rng = random.Random(4)
    docs = corpus(rng, 120)
    items = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(3))) for i in range(9)]
    assert run(spark, docs, items, 10) == brute(docs, items, 10)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")], 5) == []
    assert run(spark, [(1, "a b")], [], 5) == []
    assert run(spark, [(1, None)], [(1, None)], 5) == []


def test_same_as_sql(spark, tiny):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    docs, items = (spark.read.parquet(f"{tiny}/{x}.parquet") for x in ("documents", "benchmark"))
    got = search.search(search.build(docs), items).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(search.SQL).fetchall())
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
