"""Paths as tables of corners (image, id, pos, x, y): aligned with lines, joined where they end, put back on the mask.

Corners are few beside pixels: the pixels that a corner asks for are listed and met by equal coordinates, so no image is held.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .graph import cluster_points
from .raster import _fill_far
from .vector import nearest_lines, project


def aligned(corners: DataFrame, lines: DataFrame, angle: float, distance: float, strength: float) -> DataFrame:
    """Corners move by ``strength`` towards the mean of their feet on the lines nearest to the segments they belong to.

    ``lines`` are (image, line_id, lx1, ly1, lx2, ly2); a segment without a line within ``angle`` degrees and ``distance``
    moves nothing.
    """
    if strength <= 0:
        return corners
    along = W.partitionBy("image", "id").orderBy("pos")
    ends = F.lead(F.struct("pos", "x", "y")).over(along)
    segments = corners.withColumn("__to", ends).where("__to is not null").select("image", F.struct("id", "pos", F.col("__to.pos").alias("next")).alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("__to.x").alias("x2"), F.col("__to.y").alias("y2"))
    chosen = nearest_lines(segments, lines, angle, distance).join(lines, ["image", "line_id"])
    asked = chosen.select("image", "id.id", F.explode(F.array("id.pos", "id.next")).alias("pos"), "lx1", "ly1", "lx2", "ly2").join(corners.select("image", "id", "pos", "x", "y"), ["image", "id", "pos"])
    fx, fy = project(F.col("x"), F.col("y"), F.col("lx1"), F.col("ly1"), F.col("lx2"), F.col("ly2"))
    feet = asked.groupBy("image", "id", "pos").agg(F.avg(fx).alias("__x"), F.avg(fy).alias("__y"))
    moved = lambda k: F.when(F.col(f"__{k}").isNull(), F.col(k)).otherwise((1 - strength) * F.col(k) + strength * F.col(f"__{k}"))
    return corners.join(feet, ["image", "id", "pos"], "left").withColumns({k: moved(k) for k in "xy"}).drop("__x", "__y")


def _joined(stretches: DataFrame) -> DataFrame:
    """Stretches (image, r, c0, c1) of rows, those that touch or overlap as one."""
    row = W.partitionBy("image", "r").orderBy("c0", "c1")
    new = F.coalesce(F.col("c0") > F.max("c1").over(row.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True))
    told = stretches.withColumn("__new", new.cast("long")).withColumn("__n", F.sum("__new").over(row.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return told.groupBy("image", "r", "__n").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("__n")


def _around(px: DataFrame, mask: Column, steps: int) -> DataFrame:
    """Stretches of what is at most ``steps`` moves to a neighbour side by side away from the mask, whether there is a pixel or not."""
    on = px.where(mask).select("image", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c0"), F.col("c").cast("long").alias("c1")).dropna()
    wide = _joined(on).withColumn("__i", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn("__j", steps - F.abs("__i"))
    return _joined(wide.select("image", (F.col("r") + F.col("__i")).alias("r"), (F.col("c0") - F.col("__j")).alias("c0"), (F.col("c1") + F.col("__j")).alias("c1")))


def _near_mask(asked: DataFrame, around: DataFrame) -> DataFrame:
    """Those of ``asked`` (image, r, c) that are on a stretch of ``_around``, once each."""
    asked = asked.select("image", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.lit(None).cast("long").alias("__end")).distinct()
    both = asked.unionByName(around.select("image", "r", F.col("c0").alias("c"), F.col("c1").alias("__end"))).withColumn("__asked", F.col("__end").isNull())
    upto = F.max("__end").over(W.partitionBy("image", "r").orderBy("c").rangeBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("__upto", upto).where("__asked and __upto >= c").select("image", "r", "c")


def _nearest(asked: DataFrame, seen: DataFrame, first: int = 3, most: int = 16) -> DataFrame:
    """(image, r, c, __r, __c): the pixel of ``seen`` nearest to each of ``asked`` (both image, r, c), however far; of equal ones
    the first by rows.

    In a row the nearest stand beside the place that is asked for. The rows within ``first`` bound how far others have to be looked at;
    beyond ``most``, or without a bound, ``_fill_far`` takes over. Both set the cost and not the result.
    """

    def of_rows(asked: DataFrame, reach: Column) -> DataFrame:
        rows = asked.select("image", "r", "c", F.explode(F.sequence(F.col("r") - reach, F.col("r") + reach)).alias("__r"), F.lit(None).cast("long").alias("__c"))
        both = rows.unionByName(seen.select("image", F.lit(None).cast("long").alias("r"), "c", F.col("r").alias("__r"), F.col("c").alias("__c")))
        beside = [F.last("__c", True).over(W.partitionBy("image", "__r").orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow)) for o in (F.asc("c"), F.desc("c"))]
        both = both.withColumns(dict(zip(("__one", "__two"), beside))).where("r is not null")
        far = lambda k: (F.col("__r") - F.col("r")) * (F.col("__r") - F.col("r")) + (F.col(k) - F.col("c")) * (F.col(k) - F.col("c"))
        hit = [F.when(F.col(k).isNotNull(), F.struct(far(k).alias("d"), F.col("__r").alias("r"), F.col(k).alias("c"))) for k in ("__one", "__two")]
        return both.groupBy("image", "r", "c").agg(F.min(F.least(*hit)).alias("m"))

    found = lambda df: df.select("image", "r", "c", F.col("m.r").alias("__r"), F.col("m.c").alias("__c"))
    near = cut(of_rows(asked, F.lit(first).cast("long")), "near")
    out = found(near.where(f"m.d < {(first + 1) ** 2}"))
    out = out.unionByName(found(of_rows(near.where(f"m.d >= {(first + 1) ** 2} and m.d <= {most * most}"), F.floor(F.sqrt("m.d")))))
    left = near.where(f"m is null or m.d > {most * most}").select("image", "r", "c")
    if left.isEmpty():
        return out
    far = _fill_far(left, seen.select("image", F.col("r").alias("r2"), F.col("c").alias("c2"), F.struct("r", "c").alias("found")))
    return out.unionByName(far.select("image", "r", "c", F.col("__f.r").alias("__r"), F.col("__f.c").alias("__c")))


def _inside(px: DataFrame) -> DataFrame:
    """(image, __h, __w): last row and column of each image."""
    return px.groupBy("image").agg(F.max("r").alias("__h"), F.max("c").alias("__w"))


def _pixel(k: str, last: str) -> Column:
    return F.least(F.greatest(F.bround(k).cast("long"), F.lit(0).cast("long")), F.col(last).cast("long"))


def best_evidence(points: DataFrame, px: DataFrame, evidence: str, mask: Column, radius: int, steps: int = 5) -> DataFrame:
    """(image, id, x, y) with each point put on the pixel around it, within ``radius`` rows and columns and ``steps`` of the mask,
    that has the most evidence less 0.025 of its distance; of equal ones the first by rows. Without such a pixel the point
    is rounded and moved into the image."""
    at = points.join(F.broadcast(_inside(px)), "image").withColumns({"__r": F.bround("y").cast("long"), "__c": F.bround("x").cast("long")})
    window = lambda name, last: F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col(name) - radius), F.greatest(F.lit(0).cast("long"), F.least(F.col(last).cast("long"), F.col(name) + radius))))
    near = at.withColumn("r", window("__r", "__h")).withColumn("c", window("__c", "__w")).where(f"abs(r - __r) <= {radius} and abs(c - __c) <= {radius}")
    near = near.join(_near_mask(near, _around(px, mask, steps)), ["image", "r", "c"]).join(px.select("image", "r", "c", F.col(evidence).alias("__e")), ["image", "r", "c"])
    quality = F.col("__e") - 0.025 * F.sqrt((F.col("c") - F.col("x")) ** 2 + (F.col("r") - F.col("y")) ** 2)
    best = near.groupBy("image", "id").agg(F.min(F.struct((-quality).alias("q"), "r", "c")).alias("m")).select("image", "id", "m.r", "m.c")
    out = at.join(best, ["image", "id"], "left")
    return out.select("image", "id", F.coalesce(F.col("c").cast("double"), _pixel("x", "__w").cast("double")).alias("x"), F.coalesce(F.col("r").cast("double"), _pixel("y", "__h").cast("double")).alias("y"))


def joined_ends(corners: DataFrame, px: DataFrame, evidence: str, mask: Column, radius: float) -> tuple[DataFrame, DataFrame]:
    """The corners, with ends that hang together by distances of at most ``radius`` put on one place (``best_evidence`` around
    their mean), and the junctions (image, junction, x, y, members). Paths of one corner take no part."""
    along = W.partitionBy("image", "id")
    ends = corners.withColumns({"__a": F.min("pos").over(along), "__b": F.max("pos").over(along)}).where("__a < __b and (pos = __a or pos = __b)")
    ends = cut(ends.select("image", F.struct("id", "pos").alias("id"), F.when(F.col("pos") == F.col("__a"), "start").otherwise("end").alias("endpoint"), "x", "y"), "ends")
    groups = cut(cluster_points(ends, radius, ["image"]), "junctions")
    middles = groups.groupBy("image", F.col("root").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    put = cut(best_evidence(middles, px, evidence, mask, max(3, round(radius / 2))), "places")
    moved = groups.join(put.select("image", F.col("id").alias("root"), F.col("x").alias("__x"), F.col("y").alias("__y")), ["image", "root"])
    junctions = moved.groupBy("image", F.col("root").alias("junction")).agg(F.first("__x").alias("x"), F.first("__y").alias("y"), F.sort_array(F.collect_list(F.struct("id.id", "endpoint"))).alias("members"))
    to = moved.select("image", "id.id", "id.pos", "__x", "__y")
    return corners.join(to, ["image", "id", "pos"], "left").withColumns({k: F.coalesce(f"__{k}", k) for k in "xy"}).drop("__x", "__y"), junctions


def on_mask(corners: DataFrame, px: DataFrame, mask: Column, steps: int = 5) -> DataFrame:
    """(image, id, pos, x, y) with whole pixels: rounded, moved into the image and, beyond ``steps`` of the mask, on the nearest
    pixel that is not (of equal ones the first by rows). Corners equal to the one before go, and so do paths left with one."""
    at = corners.join(F.broadcast(_inside(px)), "image").select("image", "id", "pos", _pixel("x", "__w").alias("c"), _pixel("y", "__h").alias("r"))
    at = cut(at, "corners")
    around = cut(_around(px, mask, steps), "around")
    lost = at.select("image", "r", "c").distinct().join(_near_mask(at, around), ["image", "r", "c"], "left_anti")
    # The nearest allowed pixel is one of those around the mask; all of them are asked, but only where a corner is lost.
    lost = cut(lost, "lost")
    images = F.broadcast(lost.select("image").distinct())
    rim = around.join(images, "image", "left_semi").select("image", "r", F.explode(F.sequence("c0", "c1")).alias("c")).join(px.select("image", "r", "c"), ["image", "r", "c"], "left_semi")
    best = _nearest(lost, cut(rim, "rim"))
    out = at.join(best, ["image", "r", "c"], "left").select("image", "id", "pos", F.coalesce("__c", "c").alias("x"), F.coalesce("__r", "r").alias("y"))
    along = W.partitionBy("image", "id")
    before = F.lag(F.struct("x", "y")).over(along.orderBy("pos"))
    out = out.withColumn("__same", before.eqNullSafe(F.struct("x", "y"))).where("not __same").drop("__same")
    return out.withColumn("__n", F.count(F.lit(1)).over(along)).where("__n > 1").drop("__n")


def optimise(corners: DataFrame, lines: DataFrame, px: DataFrame, evidence: str, mask: Column, angle: float, distance: float, strength: float, radius: float) -> tuple[DataFrame, DataFrame]:
    """Simplified paths (``vector.simplify_paths``) aligned, joined at their ends and put on the mask; and their junctions."""
    moved, junctions = joined_ends(cut(aligned(corners, lines, angle, distance, strength), "aligned"), px, evidence, mask, radius)
    return on_mask(moved, px, mask), junctions
