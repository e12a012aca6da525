"""Nested studyset JSON: study, analysis, {point, image, condition, text, annotation}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions.native import sample_size
from quillmap.plans.studyset import Studyset

POINT = "struct<coordinates:array<double>,space:string,kind:string,values:array<struct<kind:string,value:double>>>"
IMAGE = "struct<url:string,filename:string,value_type:string,space:string>"
ANALYSIS = f"struct<id:string,name:string,description:string,metadata:map<string,string>,texts:map<string,string>,annotations:map<string,map<string,string>>,conditions:array<struct<name:string,description:string>>,weights:array<double>,points:array<{POINT}>,images:array<{IMAGE}>>"
STUDY = f"struct<id:string,name:string,authors:string,publication:string,doi:string,pmid:string,year:int,metadata:map<string,string>,analyses:array<{ANALYSIS}>>"
SCHEMA = f"id string, name string, studies array<{STUDY}>"


def denull(c: Column) -> Column:
    """The text ``None`` is null."""
    return F.when(c != "None", c)


def read(spark: SparkSession, path: str, lines: bool = False) -> Studyset:
    """Tables of one or more JSON documents, each a file or a line; missing ids become study-{i} and analysis-{i}."""
    root = spark.read.schema(SCHEMA).option("multiLine", not lines).json(path)
    study = root.select(F.posexplode_outer("studies").alias("study_pos", "s")).where("s is not null")
    study = study.select("study_pos", F.coalesce("s.id", F.format_string("study-%d", "study_pos")).alias("study_id"), *[denull(F.col(f"s.{c}")).alias(c) for c in ("name", "authors", "publication", "doi", "pmid")], F.col("s.year").alias("year"), F.col("s.metadata").alias("metadata"), F.col("s.analyses").alias("analyses"))
    a = study.select("study_id", "study_pos", F.posexplode("analyses").alias("analysis_pos", "a"))
    a = a.select("study_id", F.coalesce("a.id", F.format_string("analysis-%d", "analysis_pos")).alias("contrast_id"), "study_pos", "analysis_pos", F.col("a.name").alias("name"), F.col("a.description").alias("description"), F.col("a.metadata").alias("metadata"), F.col("a.texts").alias("texts"), F.col("a.annotations").alias("annotations"), F.arrays_zip(F.col("a.conditions").alias("condition"), F.coalesce("a.weights", F.transform("a.conditions", lambda c: F.lit(1.0))).alias("weight")).alias("conditions"), F.col("a.points").alias("points"), F.col("a.images").alias("images"))
    a = a.withColumn("id", F.concat_ws("-", "study_id", "contrast_id"))
    p = a.select("id", F.posexplode("points").alias("point_pos", "p"))
    point = p.select("id", "point_pos", *[F.element_at("p.coordinates", n + 1).alias(c) for n, c in enumerate("xyz")], F.col("p.space").alias("space"), F.col("p.kind").alias("kind"), F.map_from_entries(F.transform("p.values", lambda v: F.struct(v["kind"], v["value"]))).alias("values"))
    image = a.select("id", F.posexplode("images").alias("image_pos", "i")).select("id", "image_pos", "i.*")
    notes = a.select("id", F.explode("annotations").alias("annotation_id", "n")).select("id", "annotation_id", F.explode("n").alias("label", "text_value"))
    annotation = notes.withColumn("value", F.col("text_value").try_cast("double"))
    text = a.select("id", F.explode("texts").alias("field", "text"))
    analysis = a.drop("points", "images", "annotations", "texts")
    of_study = study.select("study_id", "study_pos", F.col("metadata").alias("study_metadata"))
    analysis = analysis.join(of_study, ["study_id", "study_pos"], "left")
    size = lambda m: F.coalesce(F.col(m)["sample_sizes"], F.col(m)["sample_size"])
    analysis = analysis.withColumn("sample_size", sample_size(size("metadata"), size("study_metadata"))).drop("study_metadata")
    return Studyset(analysis=analysis, point=point, annotation=annotation, image=image, text=text, study=study.drop("analyses"))


#: Columns of analyses with a place of their own; others are kept as metadata.
OWN = ("id", "study_id", "contrast_id", "study_pos", "analysis_pos", "name", "description", "metadata", "conditions", "sample_size")


def as_text(c: Column, kind: str) -> Column:
    """A value as text; lists, maps and structs as JSON."""
    return F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")


def nested(ss: Studyset) -> DataFrame:
    """One JSON text for each study, children in their source order.

    Children are gathered for each analysis, and analyses for each study. Any studyset
    can be written: what has no places comes in the order of its JSON, notes without a
    set go into ``annotation``, points without a space take the studyset's, analyses without a
    study are studies of their own, and further columns of analyses become metadata, as does a
    sample size that no metadata gave.
    """
    def field(t: DataFrame, name: str, default: Column) -> Column:
        return F.col(name) if name in t.columns else default

    def children(table: DataFrame, place: str, fields: list[Column], name: str) -> DataFrame:
        rows = table.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(field(table, place, F.lit(0)).alias("place"), F.to_json(F.struct(*fields)).alias("j")))).alias("c"))
        return rows.select("id", F.concat(F.lit(f'"{name}":['), F.array_join(F.transform("c", lambda x: x["j"]), ","), F.lit("]")).alias(f"_{name}_"))

    own = ss.analysis
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    further = [c for c in own.columns if c not in OWN] + (["sample_size"] if "sample_size" in kinds and "metadata" not in kinds else [])
    entries_of = F.filter(F.array(*[F.struct(F.lit("sample_sizes" if c == "sample_size" else c).alias("k"), as_text(F.col(f"`{c}`"), kinds[c]).alias("v")) for c in further]), lambda e: e["v"].isNotNull()) if further else None
    metadata = F.col("metadata") if "metadata" in kinds else None
    if entries_of is not None:
        own_names = F.map_keys(metadata) if metadata is not None else F.array()
        more = F.map_from_entries(entries_of if metadata is None else F.filter(entries_of, lambda e: ~F.coalesce(F.array_contains(own_names, e["k"]), F.lit(False))))
        metadata = more if metadata is None else F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), more)
        metadata = F.when(F.size(metadata) > 0, metadata)
    a = own.select(
        "id", field(own, "study_id", F.col("id")).alias("study_id"), field(own, "contrast_id", F.col("id")).alias("contrast_id"), field(own, "study_pos", F.lit(0)).alias("study_pos"), field(own, "analysis_pos", F.lit(0)).alias("analysis_pos"),
        *[c for c in ("name", "description", "conditions") if c in kinds], *([metadata.alias("metadata")] if metadata is not None else []),
    )
    parts = []
    if ss.point is not None:
        p = ss.point
        values = [F.transform(F.map_entries("values"), lambda e: F.struct(e["key"].alias("kind"), e["value"].alias("value"))).alias("values")] if "values" in p.columns else []
        fields = [F.array("x", "y", "z").alias("coordinates"), field(p, "space", F.lit(ss.space)).alias("space"), field(p, "kind", F.lit(None).cast("string")).alias("kind"), *values]
        a, parts = a.join(children(p, "point_pos", fields, "points"), "id", "left"), ["_points_"]
    if ss.image is not None:
        a, parts = a.join(children(ss.image, "image_pos", [F.col(c) for c in ss.image.columns if c not in ("id", "image_pos")], "images"), "id", "left"), [*parts, "_images_"]
    key = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    entries = lambda rows, k, v, name: rows.groupBy("id").agg(F.sort_array(F.collect_list(F.concat(key(F.col(k)), F.lit(":"), v))).alias("c")).select("id", F.concat(F.lit(f'"{name}":{{'), F.array_join("c", ","), F.lit("}")).alias(f"_{name}_"))
    if ss.annotation is not None:
        t = ss.annotation
        # a note's own text is kept, or its value as text
        value = F.coalesce(*[F.col(c).cast("string") for c in ("text_value", "value") if c in t.columns])
        t = t.select("id", F.coalesce(field(t, "annotation_id", F.lit(None).cast("string")), F.lit("annotation")).alias("annotation_id"), "label", value.alias("text_value"))
        notes = t.groupBy("id", "annotation_id").agg(F.sort_array(F.collect_list(F.concat(key(F.col("label")), F.lit(":"), F.coalesce(key(F.col("text_value")), F.lit("null"))))).alias("n"))
        notes = notes.select("id", "annotation_id", F.concat(F.lit("{"), F.array_join("n", ","), F.lit("}")).alias("n"))
        a, parts = a.join(entries(notes, "annotation_id", F.col("n"), "annotations"), "id", "left"), [*parts, "_annotations_"]
    if ss.text is not None:
        text = ss.text.select("id", field(ss.text, "field", F.lit("text")).alias("field"), "text")
        a, parts = a.join(entries(text, "field", F.coalesce(key(F.col("text")), F.lit("null")), "texts"), "id", "left"), [*parts, "_texts_"]
    if "conditions" in kinds:
        listed = F.to_json(F.struct(F.transform("conditions", lambda c: c["condition"]).alias("conditions"), F.transform("conditions", lambda c: c["weight"]).alias("weights")))
        a, parts = a.withColumn("conditions", listed.substr(F.lit(2), F.length(listed) - 2)), [*parts, "conditions"]
    head = F.to_json(F.struct(F.col("contrast_id").cast("string").alias("id"), *[c for c in ("name", "description", "metadata") if c in a.columns]))
    body = F.concat_ws(",", head.substr(F.lit(2), F.length(head) - 2), *[F.when(F.col(c) != "", F.col(c)) for c in parts])
    rows = a.select("study_id", "study_pos", "analysis_pos", F.concat(F.lit("{"), body, F.lit("}")).alias("j"))
    grouped = rows.groupBy("study_id", "study_pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("analysis_pos", "j"))), lambda x: x["j"]), ",").alias("analyses"))
    head = F.to_json(F.struct(F.col("study_id").cast("string").alias("id")))
    if ss.study is not None:
        on = [c for c in ("study_id", "study_pos") if c in ss.study.columns and c in (*own.columns, "study_id")]
        study = ss.study if on == ["study_id", "study_pos"] else ss.study.drop("study_pos")
        grouped = grouped.join(study, on, "full")  # a study may have no analysis
        if "study_pos" not in on:
            grouped = grouped.withColumn("study_pos", F.coalesce("study_pos", F.lit(0)))
        head = F.to_json(F.struct(F.col("study_id").cast("string").alias("id"), *[c for c in study.columns if c not in ("study_id", "study_pos")]))
    return grouped.select("study_id", "study_pos", F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"analyses":['), F.coalesce("analyses", F.lit("")), F.lit("]}")).alias("value"))


def write(ss: Studyset, path: str, whole: bool = True) -> None:
    """A JSON document. As one document has one file, ``whole`` gathers its studies at the end; otherwise each line of a
    folder's files is a document of one study, written where its rows are, which ``read`` takes too (``lines``)."""
    rows = nested(ss)
    if not whole:
        rows.select(F.concat(F.lit('{"studies":['), "value", F.lit("]}")).alias("value")).write.text(path)
        return
    doc = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("study_pos", "value"))), lambda r: r["value"]), ",").alias("s"))
    doc.select(F.concat(F.lit('{"studies":['), "s", F.lit("]}")).alias("value")).write.text(path)
