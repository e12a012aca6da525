"""Decoding: a selection of analyses, or a map, against every label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions import special
from quillmap.operators import kernels
from quillmap.operators.cbma import one_way, two_way
from quillmap.operators.correction import correct
from quillmap.operators.text import checkpointed
from quillmap.plans.studyset import Grid


def contingency(point: DataFrame, annotation: DataFrame, ids: DataFrame, ids2: DataFrame | None = None, threshold: float = 0.001) -> DataFrame:
    """(label, a, b, n1, n2): selected and unselected analyses with the label. The universe is that of analyses with a point.

    Labels meet a narrow table of (id, is selected); the two sizes are one row.
    """
    universe = point.select("id").distinct()
    flag = universe.join(ids.select("id").distinct().withColumn("s", F.lit(1)), "id", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    if ids2 is not None:
        flag = flag.join(ids2.select("id").distinct().withColumn("u", F.lit(1)), "id", "left").where("s = 1 or u = 1").drop("u")
    sizes = flag.agg(F.sum("s").cast("double").alias("n1"), F.sum(1 - F.col("s")).cast("double").alias("n2"))
    rows = annotation.join(flag, "id")
    hit = F.when(F.col("value") >= threshold, 1).otherwise(0)
    per = rows.groupBy("label").agg(F.sum(hit * F.col("s")).cast("double").alias("a"), F.sum(hit * (1 - F.col("s"))).cast("double").alias("b"), F.sum(F.col("s")).cast("double").alias("seen1"), F.sum(1 - F.col("s")).cast("double").alias("seen2"))
    out = per.crossJoin(F.broadcast(sizes))
    if threshold <= 0:  # an absent value counts as 0
        out = out.withColumn("a", F.col("a") + F.col("n1") - F.col("seen1")).withColumn("b", F.col("b") + F.col("n2") - F.col("seen2"))
    return out.drop("seen1", "seen2")


def neurosynth_counts(table: DataFrame, prior: float | None = 0.5) -> DataFrame:
    """Chi-squares, signs and posterior probabilities of a contingency table."""
    a, b, n1, n2 = (F.col(c) for c in ("a", "b", "n1", "n2"))
    mean = table.agg(F.avg("a").alias("mean_a"))
    t = table.crossJoin(F.broadcast(mean))
    n_term, n_noterm = a + b, (n1 - a) + (n2 - b)
    p_term = n_term / (n_term + n_noterm)
    with_term, without = F.try_divide(a, n_term), F.try_divide(n1 - a, n_noterm)
    pr: Column = p_term if prior is None else F.lit(float(prior))
    forward = pr * with_term + (1 - pr) * without
    return t.select(
        "label",
        "a",
        "b",
        one_way(a, n_term, F.col("mean_a")).alias("chi2_forward"),
        F.signum(a - F.col("mean_a")).alias("sign_forward"),
        two_way(a, b, n1, n2).alias("chi2_reverse"),
        F.signum(with_term - without).alias("sign_reverse"),
        forward.alias("prob_forward"),
        F.try_divide(with_term * pr, forward).alias("prob_reverse"),
    )


def _log_p_and_z(rows: DataFrame, chi2: str, sign: str, name: str, correction: str | None) -> DataFrame:
    if correction not in (None, "bh", "by", "bonferroni"):
        raise ValueError(f"unknown correction: {correction}")
    rows = rows.withColumn("_n_", special.chi2_to_nlogp_udf(F.col(chi2)))
    rows = correct(rows, correction, "_n_")
    return rows.withColumn(f"p_{name}", F.exp("corrected")).withColumn(f"z_{name}", F.col(sign) * special.nlogp_to_z_udf("corrected")).drop("_n_", "corrected")


def decode_neurosynth(point, annotation, ids, ids2=None, threshold: float = 0.001, prior: float | None = 0.5, correction: str | None = None) -> DataFrame:
    """label, pForward, zForward, probForward, pReverse, zReverse, probReverse."""
    rows = neurosynth_counts(contingency(point, annotation, ids, ids2, threshold), prior)
    rows = _log_p_and_z(rows, "chi2_forward", "sign_forward", "forward", correction)
    rows = _log_p_and_z(rows, "chi2_reverse", "sign_reverse", "reverse", correction)
    return rows.select("label", "p_forward", "z_forward", "prob_forward", "p_reverse", "z_reverse", "prob_reverse")


def brainmap_counts(point: DataFrame, annotation: DataFrame, ids: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Foci in place of analyses: (label, foci with the term, selected ones, and totals)."""
    n = point.groupBy("id").agg(F.count("*").alias("foci"))
    flag = n.join(ids.select("id").distinct().withColumn("s", F.lit(1)), "id", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    totals = flag.agg(F.sum("foci").cast("double").alias("n_foci"), F.sum(F.col("foci") * F.col("s")).cast("double").alias("n_selected_foci"), F.sum("s").cast("double").alias("n1"), F.sum(1 - F.col("s")).cast("double").alias("n2"))
    hits = annotation.where(F.col("value") >= threshold).join(flag, "id")
    per = hits.groupBy("label").agg(F.sum("foci").cast("double").alias("term_foci"), F.sum(F.col("foci") * F.col("s")).cast("double").alias("selected_term_foci"), F.sum("s").cast("double").alias("a"), F.sum(1 - F.col("s")).cast("double").alias("b"))
    return per.crossJoin(F.broadcast(totals))


def brainmap_tests(table: DataFrame, least: int = 5) -> DataFrame:
    """Likelihoods, signs and uncorrected ln p of the two inferences from counts.

    Forward: among the foci of analyses with a term, as many selected analyses with it as a
    binomial with the share of selected analyses to all foci would give. Reverse: the
    two-way chi-square of selected analyses and those with the term. Terms of fewer
    than ``least`` selected analyses have p 1.
    """
    a, b, foci = F.col("a"), F.col("b"), F.col("term_foci")
    uses = table.agg(F.sum(a + b).alias("uses"), F.avg("a").alias("mean_a"))
    t = table.crossJoin(F.broadcast(uses))
    selected = F.col("n1") / F.col("n_foci")
    with_term, without = F.try_divide(a, foci), F.try_divide(F.col("n1") - a, F.col("n_foci") - foci)
    posterior = with_term * (a + b) / F.col("uses") / selected
    rare = a < least
    t = t.select("label", "a", "term_foci", selected.alias("share"), F.try_divide(with_term, selected).alias("likelihood_forward"), posterior.alias("posterior"), F.signum(a - F.col("mean_a")).alias("sign_forward"), F.signum(with_term - without).alias("sign_reverse"), two_way(a, b, F.col("n1"), F.col("n2")).alias("chi2_reverse"), rare.alias("rare"))
    every = t.agg(F.sum("posterior").alias("every"))
    t = t.crossJoin(F.broadcast(every)).withColumn("prob_reverse", F.try_divide("posterior", "every"))
    t = t.withColumn("nlogp_forward", F.when(F.col("rare"), F.lit(0.0)).otherwise(special.binom_logsf_udf("a", "term_foci", "share")))
    return t.withColumn("nlogp_reverse", F.when(F.col("rare"), F.lit(0.0)).otherwise(special.chi2_to_nlogp_udf("chi2_reverse"))).drop("posterior", "every")


def decode_brainmap(point, annotation, ids, threshold: float = 0.001, correction: str | None = None) -> DataFrame:
    """label, p and signed z of both inferences, the forward likelihood ratio, the reverse probability, which sums to 1 over labels, and the forward sign, which z loses where p is 1."""
    if correction not in (None, "bh", "by", "bonferroni"):
        raise ValueError(f"unknown correction: {correction}")
    t = brainmap_tests(brainmap_counts(point, annotation, ids, threshold))
    for name in ("forward", "reverse"):
        t = correct(t, correction, f"nlogp_{name}").withColumn(f"p_{name}", F.exp("corrected")).withColumn(f"z_{name}", F.col(f"sign_{name}") * special.nlogp_to_z_udf("corrected")).drop("corrected")
    return t.select("label", "p_forward", "z_forward", "likelihood_forward", "p_reverse", "z_reverse", "prob_reverse", "sign_forward")


@dataclass
class Decoder:
    """A decoder of selections that remembers its studyset: ``fit`` chooses labels, ``transform`` decodes ids.

    ``method`` is neurosynth or brainmap; ``group`` (a prefix) or ``features`` limit the
    labels to those with a value at the threshold, and none left is an error.
    """

    method: str = "neurosynth"
    group: str | None = None
    features: list[str] | None = None
    threshold: float = 0.001
    prior: float | None = 0.5
    correction: str | None = "bh"

    def fit(self, point: DataFrame, annotation: DataFrame) -> Decoder:
        if self.method not in ("neurosynth", "brainmap"):
            raise ValueError(f"unknown method: {self.method}")
        rows = annotation
        if self.group is not None:
            rows = rows.where(F.col("label").startswith(f"{self.group}__"))
        if self.features is not None:
            names = [f"{self.group}__{f}" if self.group and not f.startswith(f"{self.group}__") else f for f in self.features]
            rows = rows.where(F.col("label").isin(names))
        used = rows.where(F.col("value") >= self.threshold).select("label").distinct()
        if used.isEmpty():
            raise ValueError("no label has a value at the threshold")
        self.point, self.annotation = point, rows.join(used, "label", "left_semi")
        return self

    def transform(self, ids: DataFrame, ids2: DataFrame | None = None) -> DataFrame:
        if self.method == "brainmap":
            return decode_brainmap(self.point, self.annotation, ids, self.threshold, self.correction)
        return decode_neurosynth(self.point, self.annotation, ids, ids2, self.threshold, self.prior, self.correction)


def roi_association(ma: DataFrame, roi: DataFrame, ids: DataFrame, annotation: DataFrame) -> DataFrame:
    """Pearson's r of each label's values, absent ones as 0, with an analysis' mean activation in a region.

    From sums: only analyses with the label are joined; the zeros are in the totals.
    """
    n_roi = roi.select(F.countDistinct("voxel").cast("double").alias("n_roi"))
    mean = ma.join(roi.select("voxel").distinct(), "voxel", "left_semi").groupBy("id").agg(F.sum("value").alias("s"))
    x = ids.select("id").distinct().join(mean, "id", "left").crossJoin(F.broadcast(n_roi)).select("id", (F.coalesce("s", F.lit(0.0)) / F.col("n_roi")).alias("x"))
    total = x.agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    per = annotation.join(x, "id").groupBy("label").agg(F.sum("value").alias("sy"), F.sum(F.col("value") * F.col("value")).alias("syy"), F.sum(F.col("x") * F.col("value")).alias("sxy"))
    n, sx, sxx, sy, syy, sxy = (F.col(c) for c in ("n", "sx", "sxx", "sy", "syy", "sxy"))
    r = F.try_divide(n * sxy - sx * sy, F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy))
    return per.crossJoin(F.broadcast(total)).select("label", r.alias("r"))


def correlation_decoder(active: DataFrame, annotation: DataFrame, ids: DataFrame, target: DataFrame, mask: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Pearson's r of a map (voxel, value) with each label's association z map, all labels in one grouped pass.

    Counts for (label, voxel) come from one join; labels without analyses on both sides are skipped.
    """
    universe = ids.select("id").distinct()
    n = universe.agg(F.count("*").cast("double").alias("n"))
    has = annotation.where(F.col("value") >= threshold).select("id", "label").join(universe, "id", "left_semi")
    own = active.join(universe, "id", "left_semi")
    with_label = own.join(has, "id").groupBy("label", "voxel").agg(F.count("*").cast("double").alias("a"))
    every = own.groupBy("voxel").agg(F.count("*").cast("double").alias("all"))
    return _correlations(has.groupBy("label").agg(F.count("*").cast("double").alias("n1")), n, with_label, every, target, mask)


def correlation_decoder_points(point: DataFrame, annotation: DataFrame, grid: Grid, r: float, target: DataFrame, threshold: float = 0.001) -> DataFrame:
    """``correlation_decoder`` of spheres around points, for the analyses that have a point.

    Analyses are counted by label and voxel where their points and labels meet, so their voxels are never rows.
    """
    n = checkpointed(kernels.mkda_labelled(point, annotation.where(F.col("value") >= threshold).select("id", "label"), grid, r).withColumn("n", F.col("n").cast("double")))
    sizes, at = n.where("voxel = -1"), n.where("voxel >= 0")
    return _correlations(
        sizes.where("label is not null").select("label", F.col("n").alias("n1")),
        sizes.where("label is null").select("n"),
        at.where("label is not null").select("label", "voxel", F.col("n").alias("a")),
        at.where("label is null").select("voxel", F.col("n").alias("all")),
        target,
        grid.mask(point.sparkSession),
    )


def _correlations(sizes: DataFrame, n: DataFrame, with_label: DataFrame, every: DataFrame, target: DataFrame, mask: DataFrame) -> DataFrame:
    sizes = sizes.crossJoin(F.broadcast(n)).withColumn("n2", F.col("n") - F.col("n1")).where("n1 > 0 and n2 > 0").select("label", "n1", "n2")
    # labels x mask is the size of the result's maps, so it may be formed
    grid = sizes.crossJoin(F.broadcast(mask.select("voxel"))).join(with_label, ["label", "voxel"], "left").join(every, "voxel", "left").fillna(0.0, ["a", "all"])
    b = F.col("all") - F.col("a")
    z = F.sqrt(two_way(F.col("a"), b, F.col("n1"), F.col("n2"))) * F.signum(F.col("a") / F.col("n1") - b / F.col("n2"))
    return grid.withColumn("z", z).join(target.select("voxel", "value"), "voxel").groupBy("label").agg(F.corr("z", "value").alias("r"))


def correlation_distribution(image: DataFrame, annotation: DataFrame, target: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Mean and population deviation of Fisher's z of each label's images' correlations with a map."""
    r = image.join(target.select("voxel", F.col("value").alias("t")), "voxel").groupBy("id").agg(F.corr("value", "t").alias("r"))
    labelled = annotation.where(F.col("value") >= threshold).select("id", "label")
    return labelled.join(r, "id").groupBy("label").agg(F.avg(F.atanh("r")).alias("mean"), F.stddev_pop(F.atanh("r")).alias("std"))


def decode_by_topics(weights: DataFrame, region: DataFrame, word_given_topic: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Term weights of a region or map: p(topic | voxel) summed by the region's values, then p(word | topic)."""
    topics = weights.join(region.select("voxel", F.col("value").alias("v")), "voxel").groupBy("topic").agg(F.sum(F.col("p") * F.col("v")).alias("w"))
    if priors is not None:
        topics = topics.join(priors, "topic").select("topic", (F.col("w") * F.col("prior")).alias("w"))
    return word_given_topic.join(topics, "topic").groupBy("word").agg(F.sum(F.col("p") * F.col("w")).alias("weight"))
