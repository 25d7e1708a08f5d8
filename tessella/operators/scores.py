"""Scores of candidate partitions and the gates that they pass.

Candidates are label maps over one grid: pixels (image, candidate, r, c, label, ...). Fits are rows (image, candidate, label,
samples, rmse, median_abs), from any of the fits of ``fits``; a region without a row, or with a null error, is not fitted.

Defined cases: an image or candidate without pixels has no row; without a fit the terms of the errors are 0; without a border
inside the roof the support is 0; a null evidence counts for nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import raster

KEYS = ["image", "candidate"]


def least_region(roof_pixels: Column, percentage: float) -> Column:
    """The fewest pixels of a region: a percentage of the roof (halves to the even side), 20 at least."""
    return F.greatest(F.lit(20), F.bround(roof_pixels * percentage / 100.0).cast("long"))


def _one_image(px: DataFrame) -> DataFrame:
    """Pixels with (image, candidate) as their image, as the raster operators want them."""
    return px.withColumn("image", F.struct("image", "candidate"))


def _both_again(df: DataFrame) -> DataFrame:
    return df.withColumns({"candidate": F.col("image.candidate"), "image": F.col("image.image")})


def border_support(px: DataFrame, evidence: str) -> DataFrame:
    """image, candidate, support: mean evidence on the pixels beside a border between two regions."""
    whole = _one_image(px)
    on = raster.internal_boundary(whole).join(whole.select("image", "r", "c", evidence), ["image", "r", "c"])
    return _both_again(on.groupBy("image").agg(F.coalesce(F.avg(evidence), F.lit(0.0)).alias("support")))


def candidate_metrics(px: DataFrame, fits: DataFrame, evidence: str, least: Column) -> DataFrame:
    """One row for each candidate: planes, coverage, fitted_coverage, support, small, rmse, median_abs and score.

    ``least`` may use the column ``roof`` (pixels of the candidate's grid, which is the roof).
    """
    roof = px.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("roof"))
    sizes = px.where("label > 0").groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"))
    fit = fits.where("rmse is not null").select(*KEYS, "label", "samples", "rmse", "median_abs")
    each = sizes.join(fit, [*KEYS, "label"], "left").join(roof, KEYS).withColumn("least", least)
    weight = F.sum("samples")
    per = each.groupBy(*KEYS, "roof").agg(
        F.count(F.lit(1)).alias("planes"),
        (F.sum("n") / F.col("roof")).alias("coverage"),
        (F.coalesce(F.sum(F.when(F.col("rmse").isNotNull(), F.col("n"))), F.lit(0)) / F.col("roof")).alias("fitted_coverage"),
        (F.coalesce(F.sum(F.when(F.col("n") < F.col("least"), F.col("n"))), F.lit(0)) / F.col("roof")).alias("small"),
        (F.sum(F.col("samples") * F.col("rmse")) / weight).alias("rmse"),
        (F.sum(F.col("samples") * F.col("median_abs")) / weight).alias("median_abs"),
    )
    per = per.join(border_support(px, evidence), KEYS, "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    falling = lambda x, scale: F.coalesce(F.exp(-F.col(x) / scale), F.lit(0.0))
    few = 1.0 - F.least(F.greatest(F.col("planes") - 30, F.lit(0)) / 45.0, F.lit(1.0))
    #: The weights of the terms.
    terms = [(0.28, falling("rmse", 0.45)), (0.25, falling("median_abs", 0.25)), (0.20, F.col("support")), (0.12, F.col("coverage")), (0.10, F.col("fitted_coverage")), (0.05, few), (-0.15, F.col("small"))]
    return per.withColumn("score", sum((term * w for w, term in terms), F.lit(0.0)))


def path_scores(vertices: Column, original_vertices: Column, paths: Column, mean_drift: Column) -> tuple[Column, Column]:
    """Simplicity (which part of the removable vertices is gone) and drift score (1 at 0 pixels, 0 from 16 on)."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    removable = F.greatest(original_vertices - 2 * F.greatest(paths, F.lit(1)), F.lit(1))
    return unit((original_vertices - vertices) / removable), unit(1.0 - mean_drift / 16.0)


def composite(base: Column, support: Column, simplicity: Column, drift: Column) -> Column:
    return base + 0.04 * support + 0.03 * simplicity + 0.03 * drift


def hypothesis_score(coverage: Column, expected: Column, missing: Column, unexpected: Column, support: Column, planar: Column, disconnected: Column, planes: Column) -> Column:
    """The score of a topology hypothesis: counts of pairs, support in [0, 1], coverage in [0, 1]."""
    recall = 1.0 - missing / F.greatest(expected, F.lit(1))
    many = F.greatest(F.lit(0), planes - 22) / 22
    return 0.22 * coverage + 0.22 * recall + 0.24 * support + 0.32 * planar - 0.025 * unexpected - 0.05 * disconnected - 0.04 * many


def planarity(inlier_ratio: Column, rmse: Column) -> Column:
    """What a fitted region adds to the mean planarity of its candidate."""
    return inlier_ratio * F.greatest(F.lit(0.0), 1.0 - 5.0 * rmse)


def enrichment(split: DataFrame, most_parts: int = 6, least_support: float = 0.0, gain: float = 0.018, ratio: float = 0.07) -> DataFrame:
    """Add improvement, improvement_ratio and accepted to rows with parts, fitted_parts, support, single_rmse and split_rmse:
    a region is split if it has two parts at least and not too many, all of them fitted, the new borders are supported, and
    the error falls by an amount or by a share."""
    better = F.coalesce(F.col("single_rmse") - F.col("split_rmse"), F.lit(0.0))
    share = F.coalesce(better / F.greatest(F.col("single_rmse"), F.lit(1e-8)), F.lit(0.0))
    ok = F.col("parts").between(2, most_parts) & (F.col("fitted_parts") == F.col("parts")) & (F.coalesce("support", F.lit(0.0)) >= least_support) & ((better >= gain) | (share >= ratio))
    return split.withColumns({"improvement": better, "improvement_ratio": share, "accepted": ok})


def refinement_gate(df: DataFrame, most_complexity: float = 1.08) -> DataFrame:
    """Add the four rules and ``accepted`` to rows with registered, baseline_rmse, refined_rmse, baseline_labels and
    refined_labels (arrays), baseline_complexity and refined_complexity."""
    kept = F.size(F.array_except("baseline_labels", "refined_labels")) == 0
    rules = {
        "residual_improved": F.coalesce(F.col("refined_rmse") <= F.col("baseline_rmse") + 1e-6, F.lit(False)),
        "labels_preserved": kept,
        "complexity_accepted": F.col("refined_complexity") / F.greatest(F.col("baseline_complexity"), F.lit(1)) <= most_complexity,
    }
    df = df.withColumns(rules)
    return df.withColumn("accepted", F.col("registered") & F.col("residual_improved") & F.col("labels_preserved") & F.col("complexity_accepted"))
