"""Partitions made over again: rounds of planar merges, and borders snapped to evidence by a watershed."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .fits import normal_angles
from .graph import intersection_partition, planar_merges, union_labels
from .raster import adjacency_statistics, convolve, dense_relabel, gaussian_kernel, internal_boundary, nearest_fill
from .vector import watershed


def merge_planar(px: DataFrame, fit: Callable[[DataFrame], DataFrame], height: str, valid: str, evidence: str, max_angle: float, max_step: float, max_evidence: float = 1.0, rounds: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """Merge touching regions of one plane until a round unites nothing: the pixels with new labels, and the records
    (round, image, a, b, angle, samples, median_step, mean_evidence, merged) of all pairs with two fits, None without a round.

    ``fit`` gives (image, label, sx, sy, ...) of the valid pixels. Every round fits and measures again, on labels 1..k in
    the order of the least label merged; only pairs of labels are joined, and the driver learns whether there are any.
    """
    records = None
    for n in range(1, rounds + 1):
        px = cut(px, "labels")
        fits = cut(fit(px.where(F.col(valid) & (F.col("label") > 0))).select("image", "label", "sx", "sy").where("sx is not null"), "fits")
        stats = adjacency_statistics(px, height, F.col(valid), evidence)
        told = cut(normal_angles(stats, fits, ["image"]).where("angle is not null"), "pairs")
        accepted = planar_merges(told, max_angle, max_step, max_evidence)
        yes = accepted.select("image", "a", "b").withColumn("merged", F.lit(True))
        made = told.join(yes, ["image", "a", "b"], "left").withColumns({"merged": F.coalesce("merged", F.lit(False)), "round": F.lit(n)})
        records = made if records is None else records.unionByName(made)
        if accepted.isEmpty():
            break
        px = dense_relabel(union_labels(px, accepted))
    return px, records


def region_markers(px: DataFrame, inset: int, pixel: str) -> DataFrame:
    """Add ``marker``: the connected parts (four neighbours) of what is left of each label ``inset`` rows and columns from its
    border, 1..k by label and first pixel, 0 elsewhere. A label with nothing left has its pixel farthest from other labels, of
    equal ones the first by rows.

    The edge of the image is no border, so pixels with label 0 must be given. ``pixel`` as for ``intersection_partition``.
    """
    rows = W.partitionBy("image", "r").orderBy("c").rangeBetween(-inset, inset)
    cols = W.partitionBy("image", "c").orderBy("r").rangeBetween(-inset, inset)
    near = px.withColumns({"__lo": F.min("label").over(rows), "__hi": F.max("label").over(rows)})
    near = cut(near.withColumn("__seed", (F.min("__lo").over(cols) == F.max("__hi").over(cols)) & (F.col("label") > 0)).drop("__lo", "__hi"), "seeds")
    bare = near.where("label > 0").groupBy("image", "label").agg(F.max("__seed").alias("__any")).where("not __any").drop("__any")
    # Each pixel of such a label has another label within the inset, so its nearest one is within its diagonal.
    reach = -(-inset * 3 // 2)
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    thin = near.join(bare, ["image", "label"], "left_semi").select("image", "label", "r", "c")
    wide = thin.withColumn("__i", steps).withColumn("__j", steps)
    other = near.select("image", F.col("r").alias("__r"), F.col("c").alias("__c"), F.col("label").alias("__o"))
    met = wide.withColumns({"__r": F.col("r") + F.col("__i"), "__c": F.col("c") + F.col("__j")}).join(other, ["image", "__r", "__c"]).where("__o <> label")
    far = met.groupBy("image", "label", "r", "c").agg(F.min(F.expr("__i * __i + __j * __j")).alias("d"))
    peak = far.groupBy("image", "label").agg(F.min(F.struct((-F.col("d")).alias("d"), "r", "c")).alias("m")).select("image", "m.r", "m.c", F.lit(True).alias("__peak"))
    told = near.join(peak, ["image", "r", "c"], "left").withColumn("__seed", F.col("__seed") | F.coalesce("__peak", F.lit(False))).drop("__peak")
    told = cut(told, "markers")
    found = intersection_partition(told.where("__seed").withColumn("__same", F.lit(1)), "label", "__same", pixel).select("image", "r", "c", F.col("region").alias("marker"))
    return told.drop("__seed").join(found, ["image", "r", "c"], "left").withColumn("marker", F.coalesce("marker", F.lit(0)))


def blurred_boundary(px: DataFrame, flag: str, sigma: float, out: str) -> DataFrame:
    """A flag blurred and divided by its greatest value in the image; 0 where nothing is flagged."""
    px = cut(convolve(px.withColumn(out, F.col(flag).cast("double")), out, gaussian_kernel(sigma), out), "blurred")
    tops = px.groupBy("image").agg(F.max(out).alias("__top"))
    return px.join(F.broadcast(tops), "image").withColumn(out, F.when(F.col("__top") > 0, F.col(out) / F.col("__top")).otherwise(F.col(out))).drop("__top")


def snap_partition(px: DataFrame, pixel: str, metric: str, visual: str, supported: str, weights: tuple[float, float, float], inset: int) -> DataFrame:
    """(image, r, c, barrier, label): regions grown again from their insides over a barrier of their own blurred borders, the
    evidence (0.72 metric, 0.28 visual) and the blurred ``supported`` borders, by these three ``weights``; label 0 is outside.

    The whole image must be given, without gaps. The watershed is a kernel that holds one image (``vector.watershed``).
    """
    own = internal_boundary(px).withColumn("__own", F.lit(True))
    px = cut(px.join(own, ["image", "r", "c"], "left").withColumn("__own", F.coalesce("__own", F.lit(False))), "borders")
    px = blurred_boundary(blurred_boundary(px, "__own", 1.6, "__fusion"), supported, 1.35, "__base")
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    barrier = unit(weights[0] * F.col("__fusion") + weights[1] * unit(0.72 * F.col(metric) + 0.28 * F.col(visual)) + weights[2] * F.col("__base"))
    px = cut(convolve(px.withColumn("barrier", barrier), "barrier", gaussian_kernel(0.65), "barrier").select("image", "r", "c", "label", pixel, "barrier"), "barrier")
    grown = watershed(region_markers(px, inset, pixel).where("label > 0"), "barrier", "marker")
    out = px.select("image", "r", "c", "barrier", (F.col("label") > 0).alias("__on")).join(grown, ["image", "r", "c"], "left").withColumn("label", F.coalesce("label", F.lit(0).cast("long")))
    whole = nearest_fill(out.where("__on"), 3)
    return whole.unionByName(out.where("not __on")).drop("__on")
