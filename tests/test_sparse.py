"""Sparse archives: each format, shards, what is not one, and a studyset whose features come from them."""

import numpy as np
import pytest

from quillmap.sources import sparse, tables

RNG = np.random.default_rng(2)


def dense(n, m):
    return np.where(RNG.random((n, m)) < 0.2, RNG.normal(size=(n, m)), 0.0)


def save(path, x, kind="csr"):
    row, column = np.nonzero(x)
    if kind == "coo":
        np.savez_compressed(path, row=row, col=column, data=x[row, column], format=np.array(b"coo"), shape=np.array(x.shape))
        return
    turned = x if kind == "csr" else x.T
    own, other = np.nonzero(turned)
    np.savez_compressed(path, indices=other.astype(np.int32), indptr=np.searchsorted(own, np.arange(len(turned) + 1)).astype(np.int32), data=turned[own, other], format=np.array(kind.encode()), shape=np.array(x.shape))


def cells(df):
    return {(r["row"], r["column"]): r["value"] for r in df.collect()}


def want(x):
    return {(int(i), int(j)): x[i, j] for i, j in zip(*np.nonzero(x))}


@pytest.mark.parametrize("kind", ["csr", "csc", "coo"])
def test_formats(spark, tmp_path, kind):
    x = dense(30, 12)
    x[7] = 0
    save(tmp_path / "f.npz", x, kind)
    assert cells(sparse.read(spark, str(tmp_path / "f.npz"))) == want(x)


def test_shards_repeats_and_empty(spark, tmp_path):
    parts = [dense(n, 5) for n in (4, 0, 9, 1)]
    for n, p in enumerate(parts):
        save(tmp_path / f"part{n}.npz", p)
    (tmp_path / "readme.txt").write_text("no archive")
    assert cells(sparse.read(spark, str(tmp_path))) == want(np.concatenate(parts))
    again = dict(row=np.array([1, 1, 0, 2, 2]), col=np.array([2, 2, 0, 1, 1]), data=np.array([1.0, 2, 0, 4, -4]), format=np.array("coo"), shape=np.array([3, 3]))
    (tmp_path / "again").mkdir()
    np.savez(tmp_path / "again" / "a.npz", **again)
    assert cells(sparse.read(spark, str(tmp_path / "again"))) == {(1, 2): 3.0}
    (tmp_path / "again" / "b.npz").write_bytes(b"PK no")
    with pytest.raises(Exception, match=r"b\.npz: not an archive"):
        sparse.read(spark, str(tmp_path / "again")).count()
    with pytest.raises(ValueError, match="format bsr"):
        save(tmp_path / "again" / "c.npz", np.eye(2), "bsr")
        sparse.decode((tmp_path / "again" / "c.npz").read_bytes())


def test_a_studyset_from_an_archive(spark, tmp_path):
    n = 2000
    ids = [f"id{i * 7919 % n}" for i in range(n)]
    (tmp_path / "meta.tsv").write_text("id\tyear\n" + "".join(f"{i}\t2001\n" for i in ids))
    (tmp_path / "coordinates.tsv").write_text("id\tx\ty\tz\nid0\t1\t2\t3\n")
    (tmp_path / "words.txt").write_text("pain\nfear\nhand\n")
    x = dense(n, 3)
    save(tmp_path / "features.npz", x)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several blocks of the metadata
    try:
        ss = tables.read_feature_tables(spark, str(tmp_path / "coordinates.tsv"), str(tmp_path / "meta.tsv"), str(tmp_path / "features.npz"), str(tmp_path / "words.txt"))
        got = {(r["id"], r["label"]): r["value"] for r in ss.annotation.collect()}
        assert sparse.numbered(spark.read.option("header", True).csv(str(tmp_path / "meta.tsv"))).select("row").distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    words = ["terms__pain", "terms__fear", "terms__hand"]
    assert got == {(ids[i], words[j]): v for (i, j), v in want(x).items()}
