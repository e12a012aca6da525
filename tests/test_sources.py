"""Studysets keep everything through JSON and Parquet, from whatever source they come."""

import json

import numpy as np
from pyspark.sql import functions as F

from quillmap.operators import selection
from quillmap.plans.studyset import Grid
from quillmap.sources import nimads, sleuth, tables

DOC = {
    "studies": [
        {
            "id": "b", "name": "B", "authors": "X, Y", "publication": "J", "doi": "10/1", "pmid": "77", "year": 2001, "metadata": {"sample_size": "9", "lab": "q"},
            "analyses": [
                {
                    "id": "2", "name": "two", "description": "d", "metadata": {"sample_sizes": "[4, 6]"}, "texts": {"abstract": 'say "hi"'}, "annotations": {"n": {"l": "1", "m": None}, "o": {"l": "0.5"}},
                    "conditions": [{"name": "c1"}, {"name": "c2", "description": "x"}], "weights": [0.5, -0.5],
                    "points": [{"coordinates": [1.0, 2.0, 3.0], "space": "MNI", "kind": "peak", "values": [{"kind": "z", "value": 3.5}]}, {"coordinates": [4.0, 5.0, 6.0], "space": "TAL"}],
                    "images": [{"url": "u", "filename": "f", "value_type": "z", "space": "MNI"}],
                },
                {"id": "1", "name": "one"},
            ],
        },
        {"id": "a", "analyses": [{"id": "1"}]},
        {"id": "none", "name": "no analyses", "year": 1999, "analyses": []},
    ]
}


def bare(x):
    """Without empty lists and maps and nulls, which mean the same as nothing."""
    if isinstance(x, dict):
        return {k: bare(v) for k, v in x.items() if v not in (None, [], {}) or k == "m"}
    return [bare(v) for v in x] if isinstance(x, list) else x


def document(spark, path):
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))


def read_doc(spark, tmp_path, doc=DOC):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(doc))
    return nimads.read(spark, str(path))


def test_json_to_parquet_to_json_is_equal_field_by_field(spark, tmp_path):
    grid = Grid(4, 5, 6, (2.0, 3.0, 2.0), (-1.0, 0.0, 1.0)).with_mask(np.arange(120).reshape(4, 5, 6) % 3 == 0)
    ss = read_doc(spark, tmp_path).with_(grid=grid, space="TAL")
    tables.write(ss, str(tmp_path / "t"))
    again = tables.read(spark, str(tmp_path / "t"))
    assert again.grid == grid and again.space == "TAL" and (again.grid.mask_array() == grid.mask_array()).all()
    nimads.write(again, str(tmp_path / "out"))
    got = document(spark, str(tmp_path / "out"))["studies"]
    assert [bare(s) for s in got] == [bare(s) for s in DOC["studies"]]
    converted = tables.convert(spark, str(tmp_path / "s.json"), str(tmp_path / "c"))
    assert {(r["study_id"], r["authors"], r["doi"], r["pmid"], r["year"]) for r in converted.study.collect()} == {("b", "X, Y", "10/1", "77", 2001), ("a", None, None, None, None), ("none", None, None, None, 1999)}
    assert converted.study.where("study_id = 'b'").first()["metadata"] == {"sample_size": "9", "lab": "q"}


def test_sleuth_to_json_and_back(spark, tmp_path):
    (tmp_path / "a.txt").write_text("// Reference=Talairach\n// Smith et al., 2001: task\n// Subjects=12\n1 2 3\n4 5 6\n\n// Lee 2010; go\n// Subjects=8\n-1 0 2.5\n")
    ss = sleuth.to_studyset(sleuth.read(spark, str(tmp_path / "a.txt")))
    nimads.write(ss, str(tmp_path / "out"))
    again = nimads.read(spark, str(tmp_path / "out"))
    point = lambda s: sorted((r["id"], r["x"], r["y"], r["z"], r["space"]) for r in s.point.collect())
    assert point(again) == point(ss) and len(point(ss)) == 3
    assert {r["id"]: r["sample_size"] for r in again.analysis.collect()} == {"Smith et al., 2001-task": [12.0], "Lee 2010-go": [8.0]}
    tables.write(ss, str(tmp_path / "t"))
    nimads.write(tables.read(spark, str(tmp_path / "t")), str(tmp_path / "out2"))
    assert document(spark, str(tmp_path / "out2")) == document(spark, str(tmp_path / "out"))


def test_feature_tables_to_json(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("id\tx\ty\tz\n1\t1\t2\t3\n1\t4\t5\t6\n2\t0\t0\t1\n")
    (tmp_path / "m.tsv").write_text("id\tyear\ttitle\n1\t2001\tone\n2\t2002\ttwo\n3\t2003\t\n")
    (tmp_path / "v.txt").write_text("pain\nface\n")
    spark.createDataFrame([("1", 0, 0.5), ("2", 1, 0.25)], "id string, column int, value double").write.parquet(str(tmp_path / "f"))
    ss = tables.read_feature_tables(spark, *[str(tmp_path / n) for n in ("c.tsv", "m.tsv", "f", "v.txt")])
    nimads.write(ss, str(tmp_path / "out"))
    again = nimads.read(spark, str(tmp_path / "out"))
    assert {(r["id"], r["label"], r["value"]) for r in again.annotation.collect()} == {("1-1", "terms__pain", 0.5), ("2-1", "terms__face", 0.25)}
    assert {r["id"]: r["metadata"] for r in again.analysis.collect()} == {"1-1": {"year": "2001", "title": "one"}, "2-1": {"year": "2002", "title": "two"}, "3-1": {"year": "2003"}}
    assert {r["space"] for r in again.point.collect()} == {"MNI"} and again.point.count() == 3


def test_a_studyset_of_bare_tables_to_json(spark, tmp_path):
    from quillmap.plans.studyset import Studyset

    ss = Studyset(analysis=spark.createDataFrame([("x",), ("y",)], "id string"), text=spark.createDataFrame([("x", None), ("y", "t")], "id string, text string"))
    ss = ss.add_annotations(spark.createDataFrame([("x", "l", 1.5)], "id string, label string, value double"))
    nimads.write(ss, str(tmp_path / "out"))
    got = {s["id"]: s["analyses"][0] for s in document(spark, str(tmp_path / "out"))["studies"]}
    assert got["x"]["annotations"] == {"annotation": {"l": "1.5"}} and got["y"]["texts"] == {"text": "t"}


def test_a_mask_of_bits_is_one_literal(spark):
    on = np.random.default_rng(1).random((11, 13, 9)) < 0.4
    grid = Grid(11, 13, 9).with_mask(on)
    cells = spark.range(-50, 11 * 13 * 9 + 50).select("id", (F.floor(F.col("id") / 117)).alias("i"), (F.floor(F.col("id") / 9) % 13).alias("j"), (F.pmod("id", F.lit(9))).alias("k"))
    got = cells.where(grid.in_mask(F.col("i"), F.col("j"), F.col("k")))
    assert sorted(r["id"] for r in got.collect()) == np.flatnonzero(on.ravel()).tolist()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "transform(" not in plan and "array(" not in plan
    points = spark.createDataFrame([(1, 2.0 * i, 2.0 * j, 2.0 * k) for i, j, k in ((0, 0, 0), (3, 4, 5), (20, 0, 0))], "id long, x double, y double, z double")
    assert selection.focus_filter(points, grid).count() == int(on[0, 0, 0]) + int(on[3, 4, 5])
