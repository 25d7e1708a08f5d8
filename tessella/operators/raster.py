"""Rasters as tables (image, r, c, ...): neighbours, boundaries, stencils, overlays.

Horizontal neighbours come from a window over (image, r), vertical ones from a window over (image, c), so a large image
is dealt out by its rows and columns and no pixel is joined with another.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fixed, stretched
from ..plans.scratch import cut


def neighbours(px: DataFrame, values: Sequence[str]) -> DataFrame:
    """Pairs of 4-neighbours: image, r, c, down (false: to the right), one and two (structs of ``values``)."""
    both, values = [], list(dict.fromkeys(values))
    for line, pos, down in (("r", "c", False), ("c", "r", True)):
        here = F.struct(F.col(pos).alias("at"), *values)
        after = px.select("image", "r", "c", F.struct(*values).alias("one"), F.lead(here).over(W.partitionBy("image", line).orderBy(pos)).alias("two"))
        both.append(after.where(F.col("two.at") == F.col(pos) + 1).select("image", "r", "c", F.lit(down).alias("down"), "one", F.struct(*[F.col(f"two.{v}").alias(v) for v in values]).alias("two")))
    return both[0].unionByName(both[1])


def differing(px: DataFrame, label: str = "label", values: Sequence[str] = ()) -> DataFrame:
    """Neighbours with different labels above 0: a < b."""
    pairs = neighbours(px, [label, *values]).where((F.col(f"one.{label}") != F.col(f"two.{label}")) & (F.col(f"one.{label}") > 0) & (F.col(f"two.{label}") > 0))
    return pairs.withColumns({"a": F.least(f"one.{label}", f"two.{label}"), "b": F.greatest(f"one.{label}", f"two.{label}")})


def adjacency(px: DataFrame) -> DataFrame:
    """image, a, b of touching regions."""
    return differing(px).select("image", "a", "b").distinct()


def adjacency_statistics(px: DataFrame, height: str, valid: Column, evidence: str) -> DataFrame:
    """For each touching pair with valid sides: samples, median height step, mean of the stronger evidence."""
    pairs = differing(px.where(valid), values=[height, evidence])
    return pairs.groupBy("image", "a", "b").agg(
        F.count(F.lit(1)).alias("samples"),
        F.median(F.abs(F.col(f"one.{height}") - F.col(f"two.{height}"))).alias("median_step"),
        F.avg(F.greatest(f"one.{evidence}", f"two.{evidence}")).alias("mean_evidence"),
    )


def barriers(px: DataFrame, strength: str, line: str, threshold: float) -> DataFrame:
    """For each touching pair: 75th percentile of the stronger side, whether a line runs there, whether it is blocked."""
    pairs = differing(px, values=[strength, line])
    out = pairs.groupBy("image", "a", "b").agg(
        F.percentile(F.greatest(f"one.{strength}", f"two.{strength}"), F.lit(0.75)).alias("score"), F.bool_or(F.col(f"one.{line}") | F.col(f"two.{line}")).alias("hard_line")
    )
    return out.withColumn("blocked", F.col("hard_line") | (F.col("score") >= threshold))


def internal_boundary(px: DataFrame) -> DataFrame:
    """image, r, c of pixels on either side of a border between regions."""
    d = differing(px)
    far = d.select("image", (F.col("r") + F.col("down").cast("int")).alias("r"), (F.col("c") + (~F.col("down")).cast("int")).alias("c"))
    return d.select("image", "r", "c").unionByName(far).distinct()


def boundary_complexity(px: DataFrame) -> DataFrame:
    return differing(px).groupBy("image").agg(F.count(F.lit(1)).alias("complexity"))


def around(px: DataFrame, value: str, low: str, high: str, border: str = "clip") -> DataFrame:
    """Least and greatest value of the 3x3 neighbourhood (inside the image)."""
    rows = W.partitionBy("image", "r").orderBy("c").rangeBetween(-1, 1)
    cols = W.partitionBy("image", "c").orderBy("r").rangeBetween(-1, 1)
    px = px.withColumns({low: F.min(value).over(rows), high: F.max(value).over(rows)})
    return px.withColumns({low: F.min(low).over(cols), high: F.max(high).over(cols)})


def boundary_support(px: DataFrame, evidence: str) -> DataFrame:
    """Mean evidence where the 3x3 neighbourhood holds more than one label; 0 without such pixels."""
    edge = around(px, "label", "__lo", "__hi").withColumn("__on", F.col("__hi") > F.col("__lo"))
    return edge.groupBy("image").agg(F.count_if("__on").alias("pixels"), F.coalesce(F.avg(F.when(F.col("__on"), F.col(evidence))), F.lit(0.0)).alias("support"))


def _shift(value: str, line: str, pos: str) -> tuple[Column, Column]:
    """Value before and behind along a line, mirrored at the ends without repeating the border."""
    w = W.partitionBy("image", line).orderBy(pos)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.coalesce(before, after, F.col(value)), F.coalesce(after, before, F.col(value))


def sobel(px: DataFrame, value: str) -> DataFrame:
    """Add gx, gy and magnitude of the 3x3 Sobel operator, borders mirrored (the border pixel itself is not repeated)."""
    left, right = _shift(value, "r", "c")
    px = px.withColumns({"__dx": right - left, "__sx": left + 2 * F.col(value) + right})
    up, down = _shift("__dx", "c", "r")
    above, below = _shift("__sx", "c", "r")
    px = px.withColumns({"gx": up + 2 * F.col("__dx") + down, "gy": below - above})
    return px.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).drop("__dx", "__sx")


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of a sampled Gaussian, four deviations wide on each side together, with an odd number of them."""
    size = round(sigma * 8 + 1) | 1
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [x / sum(raw) for x in raw]


def convolve(px: DataFrame, value: str, kernel: Sequence[float], out: str) -> DataFrame:
    """A separable filter with an odd number of weights, along the rows and then along the columns.

    Borders are mirrored (the border pixel is not repeated). Rows and columns must have no gaps (``nearest_fill`` and
    ``fill_invalid`` fill them) and be longer than half the kernel; a window holds as many values as the kernel.
    """
    half, weights = len(kernel) // 2, F.array(*[F.lit(float(k)) for k in kernel])
    for line, pos in (("r", "c"), ("c", "r")):
        whole = W.partitionBy("image", line)
        near = F.collect_list(F.struct(F.col(pos).alias("at"), F.col(value).alias("v"))).over(whole.orderBy(pos).rangeBetween(-half, half))
        px = px.withColumns({"__near": near, "__lo": F.min(pos).over(whole), "__hi": F.max(pos).over(whole)})
        steps = F.sequence(F.lit(-half), F.lit(half))
        at = lambda k, pos=pos: F.col(pos) + k
        mirrored = lambda q: F.when(q < F.col("__lo"), 2 * F.col("__lo") - q).when(q > F.col("__hi"), 2 * F.col("__hi") - q).otherwise(q)
        index = lambda k: (mirrored(at(k)) - F.element_at("__near", 1)["at"] + 1).cast("int")
        taken = F.transform(steps, lambda k: F.element_at(F.col("__near"), index(k))["v"] * F.element_at(weights, (k + half + 1).cast("int")))
        px = px.withColumn(out, F.aggregate(taken, F.lit(0.0), lambda s, x: s + x)).drop("__near", "__lo", "__hi")
        value = out
    return px


def laplacian(px: DataFrame, value: str, out: str) -> DataFrame:
    """Twice the four corners less eight times the pixel, borders mirrored."""
    left, right = _shift(value, "r", "c")
    px = px.withColumn("__sides", left + right)
    up, down = _shift("__sides", "c", "r")
    return px.withColumn(out, 2 * (up + down) - 8 * F.col(value)).drop("__sides")


def gradient_map(px: DataFrame, value: str, out: str) -> DataFrame:
    """The Sobel magnitude, stretched between its 2nd and 98th percentile in the image."""
    return stretched(sobel(px, value), "magnitude", ["image"], out, 0.5).drop("gx", "gy", "magnitude")


def elevation_evidence(px: DataFrame, value: str, m: Sequence[float], out: str, sigma: float = 1.15) -> DataFrame:
    """Add ``smooth``, its world slopes sx and sy, and the evidence of edges: 0.72 of how the slopes change and 0.28 of the
    curvature, each stretched to [0, 1]. Heights must have no gaps (``fill_invalid``)."""
    px = gradients(convolve(px, value, gaussian_kernel(sigma), "smooth"), "smooth", m)
    px = sobel(px.withColumn("__slope", F.col("sx") + F.col("sy")), "__slope").withColumn("__change", F.col("magnitude"))
    px = laplacian(px, "smooth", "__curve").withColumn("__curve", F.abs("__curve"))
    for name in ("__change", "__curve"):
        px = stretched(px, name, ["image"], name + "u", 0.0, finite_only=True)
    return px.withColumn(out, 0.72 * F.col("__changeu") + 0.28 * F.col("__curveu")).drop("__slope", "gx", "gy", "magnitude", "__change", "__curve", "__changeu", "__curveu")


def combined_evidence(visual: Column, metric: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.44 * visual + 0.56 * metric))


def shared_support(px: DataFrame, evidence: str, label: str = "label") -> DataFrame:
    """image, a, b (a < b), contacts, support: the mean evidence of the pixels of b that have a pixel of a among their eight
    neighbours. Each such pixel counts once; pairs that do not touch have no row (their support is 1 by definition)."""
    rows = W.partitionBy("image", "r").orderBy("c").rangeBetween(-1, 1)
    cols = W.partitionBy("image", "c").orderBy("r").rangeBetween(-1, 1)
    near = px.withColumn("__s", F.collect_set(label).over(rows)).withColumn("__s", F.array_distinct(F.flatten(F.collect_list("__s").over(cols))))
    met = near.where(F.col(label) > 0).select("image", F.col(label).alias("b"), evidence, F.explode("__s").alias("a")).where("a > 0 and a < b")
    return met.groupBy("image", "a", "b").agg(F.count(F.lit(1)).alias("contacts"), F.avg(evidence).alias("support"))


def gradients(px: DataFrame, value: str, m: Sequence[float]) -> DataFrame:
    """Add world slopes sx and sy: central differences (one-sided at the ends), through the inverse of the affine map."""
    a, b, _, d, e, _ = m
    det = a * e - b * d
    if abs(det) < 1e-12:
        raise ValueError("the affine map is singular")

    def central(line: str, pos: str) -> Column:
        w = W.partitionBy("image", line).orderBy(pos)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        v = F.col(value)
        return F.coalesce((after - before) / 2, after - v, v - before, F.lit(0.0))

    px = px.withColumn("__dc", central("r", "c")).withColumn("__dr", central("c", "r"))
    return px.withColumns({"sx": (F.col("__dc") * e - F.col("__dr") * d) / det, "sy": (F.col("__dr") * a - F.col("__dc") * b) / det}).drop("__dc", "__dr")


def overlay(px: DataFrame, one: str, two: str) -> DataFrame:
    """Pixels in each combination of two label maps."""
    return px.where((F.col(one) > 0) & (F.col(two) > 0)).groupBy("image", one, two).agg(F.count(F.lit(1)).alias("pixels"))


def mask_scores(px: DataFrame, predicted: Column, target: Column) -> DataFrame:
    """IoU, precision and recall of two masks on the same grid; 0 where nothing is there."""
    both, p, t = F.count_if(predicted & target), F.count_if(predicted), F.count_if(target)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return px.groupBy("image").agg(share(both, F.count_if(predicted | target)).alias("iou"), share(both, p).alias("precision"), share(both, t).alias("recall"))


def label_iou(px: DataFrame, one: str, two: str) -> DataFrame:
    """IoU of every overlapping pair of labels."""
    o = overlay(px, one, two)
    by = lambda k: W.partitionBy("image", k)
    sized = px.where(F.col(one) > 0).groupBy("image", one).agg(F.count(F.lit(1)).alias("n1"))
    other = px.where(F.col(two) > 0).groupBy("image", two).agg(F.count(F.lit(1)).alias("n2"))
    return o.join(sized, ["image", one]).join(other, ["image", two]).withColumn("iou", F.col("pixels") / (F.col("n1") + F.col("n2") - F.col("pixels"))).drop("n1", "n2")


def dilate(px: DataFrame, flag: str, radius: int, out: str) -> DataFrame:
    """Square dilation: whether a flagged pixel is within ``radius`` rows and columns."""
    rows = W.partitionBy("image", "r").orderBy("c").rangeBetween(-radius, radius)
    cols = W.partitionBy("image", "c").orderBy("r").rangeBetween(-radius, radius)
    return px.withColumn(out, F.max(F.col(flag).cast("int")).over(rows)).withColumn(out, F.max(out).over(cols) > 0)


def boundary_f1(px: DataFrame, one: str, two: str, radius: int = 3) -> DataFrame:
    """Precision, recall and F1 of two label maps' boundaries within a tolerance."""
    for name, label in (("__b1", one), ("__b2", two)):
        px = around(px, label, "__lo", "__hi").withColumn(name, F.col("__hi") > F.col("__lo")).drop("__lo", "__hi")
    px = dilate(dilate(px, "__b1", radius, "__w1"), "__b2", radius, "__w2")
    p = F.count_if(F.col("__b1") & F.col("__w2")) / F.greatest(F.count_if("__b1"), F.lit(1))
    r = F.count_if(F.col("__b2") & F.col("__w1")) / F.greatest(F.count_if("__b2"), F.lit(1))
    out = px.groupBy("image").agg(p.alias("precision"), r.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def exact_quantile(df: DataFrame, value: str, q: float, width: float = 0.001) -> DataFrame:
    """(image, __q): what ``percentile`` gives of the values that are not null, without one buffer of an image's values.

    A sketch gives two bounds ``width`` beside the quantile; what lies below is counted and only what lies between is sorted.
    A bound that turns out to leave the quantile outside is left away, so the result is exact whatever the sketch says.
    """
    told = df.where(F.col(value).isNotNull()).select("image", F.col(value).cast("double").alias("v"))
    sketch = F.percentile_approx("v", [max(0.0, q - width), min(1.0, q + width)], 10_000)
    asked = told.groupBy("image").agg(F.count(F.lit(1)).alias("n"), sketch.alias("b")).withColumn("at", (F.col("n") - 1) * F.lit(q))
    asked = cut(asked.select("image", "at", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi")), "bounds")
    counted = told.join(F.broadcast(asked), "image").groupBy("image", "at", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v") <= F.col("hi")).alias("upto"))
    low, high = F.col("below") <= F.floor("at"), F.col("upto") > F.ceil("at")
    counted = cut(counted.select("image", "at", F.when(low, F.col("lo")).alias("lo"), F.when(high, F.col("hi")).alias("hi"), F.when(low, F.col("below")).otherwise(0).alias("below")), "bounds")
    near = told.join(F.broadcast(counted), "image").where("(lo is null or v >= lo) and (hi is null or v <= hi)").groupBy("image", "at", "below", "v").agg(F.count(F.lit(1)).alias("k"))
    ranked = near.withColumn("__upto", F.col("below") + F.sum("k").over(W.partitionBy("image").orderBy("v")))
    ends = ranked.groupBy("image", "at").agg(*[F.min(F.when(F.col("__upto") > f("at"), F.col("v"))).alias(name) for name, f in (("one", F.floor), ("two", F.ceil))])
    return ends.select("image", F.when(F.col("one") == F.col("two"), F.col("one")).otherwise((F.ceil("at") - F.col("at")) * F.col("one") + (F.col("at") - F.floor("at")) * F.col("two")).alias("__q"))


def weighted_evidence(px: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """A weighted sum of edge maps, each divided by its 98th percentile and cut at 1."""
    told = cut(px.select("image", *weights), "evidence")
    for n in weights:
        top = exact_quantile(told, n, 0.98).withColumnRenamed("__q", f"__t_{n}")
        px = px.where("image is not null").join(F.broadcast(top), "image", "left")  # one row for each image
    total = sum((F.when(F.col(f"__t_{n}") > 1e-6, F.least(F.col(n) / F.col(f"__t_{n}"), F.lit(1.0))).otherwise(0.0) * w for n, w in weights.items()), F.lit(0.0))
    return px.withColumn(out, total).drop(*[f"__t_{n}" for n in weights])


def summary(px: DataFrame) -> DataFrame:
    """For each label: area, its percentage of the labelled area, bounding box, centroid."""
    per = px.where("label > 0").groupBy("image", "label").agg(
        F.count(F.lit(1)).alias("area_pixels"), F.min("c").alias("x_min"), F.min("r").alias("y_min"), F.max("c").alias("x_max"), F.max("r").alias("y_max"),
        F.avg("c").alias("mx"), F.avg("r").alias("my"),
    )
    share = 100.0 * F.col("area_pixels") / F.sum("area_pixels").over(W.partitionBy("image"))
    return per.select("image", F.col("label").alias("id"), "area_pixels", F.round(share, 3).alias("area_percentage"), "x_min", "y_min", "x_max", "y_max", F.round("mx", 2).alias("centroid_x"), F.round("my", 2).alias("centroid_y"))


def region_features(px: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted means of the given fields by label."""
    return px.where("label > 0").groupBy("image", "label").agg(*[fixed(F.avg(n) * w).alias(n) for n, w in weights.items()])


def bbox(px: DataFrame, margin: int, width: int, height: int) -> DataFrame:
    """Box with a margin, ends exclusive, inside the image."""
    return px.groupBy("image").agg(
        F.greatest(F.min("c") - margin, F.lit(0)).alias("x0"), F.greatest(F.min("r") - margin, F.lit(0)).alias("y0"),
        F.least(F.max("c") + margin + 1, F.lit(width)).alias("x1"), F.least(F.max("r") + margin + 1, F.lit(height)).alias("y1"),
    )


def mask_center(px: DataFrame, mask: Column) -> DataFrame:
    """The mean column and row of a mask's pixels; an image whose mask is empty has no row."""
    return px.where(mask).groupBy("image").agg(F.avg(F.col("c").cast("double")).alias("x"), F.avg(F.col("r").cast("double")).alias("y"))


def changed(px: DataFrame, one: str, two: str) -> DataFrame:
    """Pixels whose label changed, and their share of the roof."""
    roof, diff = F.count_if((F.col(one) > 0) | (F.col(two) > 0)), F.count_if(F.col(one) != F.col(two))
    return px.groupBy("image").agg(diff.alias("changed"), fixed(100.0 * diff / F.greatest(roof, F.lit(1))).alias("percentage"))


def dense_relabel(px: DataFrame, label: str = "label") -> DataFrame:
    """Labels as 1..k in their order, 0 as 0; the labels themselves are few and ranked apart from the pixels."""
    found = px.where(F.col(label) > 0).select("image", label).distinct()
    ranks = found.withColumn("__new", F.dense_rank().over(W.partitionBy("image").orderBy(label)))
    return px.join(ranks, ["image", label], "left").withColumn(label, F.coalesce("__new", F.lit(0))).drop("__new")


def nearest_hit(holes: DataFrame, seen: DataFrame, radius: int) -> DataFrame:
    """(image, r, c, __f, __d) for ``holes`` (image, r, c): ``found`` of the nearest of ``seen`` (image, r2, c2, found), however
    far, and the square of its distance; ties: first row, then column. An image without ``seen`` has no rows.

    What is within ``radius`` is found by a join by equal coordinates with the pixels of the window; the radius sets the
    cost and not the result, as the others go to ``_fill_far``.
    """
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    near = holes.withColumn("dr", steps).withColumn("dc", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    near = near.where(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc") <= radius * radius)
    hit = near.withColumns({"r2": F.col("r") + F.col("dr"), "c2": F.col("c") + F.col("dc")}).join(seen, ["image", "r2", "c2"])
    far = (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("long")
    best = hit.groupBy("image", "r", "c").agg(F.min(F.struct(far.alias("d"), "r2", "c2", "found")).alias("m"))
    best = cut(best.select("image", "r", "c", F.col("m.found").alias("__f"), F.col("m.d").alias("__d")), "near")
    left = cut(holes.join(best, ["image", "r", "c"], "left_anti"), "far")
    return best if left.isEmpty() else best.unionByName(_fill_far(left, seen))


def nearest_fill(px: DataFrame, radius: int) -> DataFrame:
    """Label 0 takes the label of the nearest labelled pixel, however far (``nearest_hit``). Only an image without any label
    keeps its zeros."""
    seen = px.where("label > 0").select("image", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("label").alias("found"))
    best = nearest_hit(px.where("label = 0").select("image", "r", "c"), seen, radius).drop("__d")
    return px.join(best, ["image", "r", "c"], "left").withColumn("label", F.coalesce("__f", "label")).drop("__f")


def fill_invalid(px: DataFrame, value: str, valid: str, radius: int = 3) -> DataFrame:
    """Values that are not valid become that of the nearest valid pixel; an image without one is an error."""
    seen = px.where(F.col(valid)).select("image", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col(value).alias("found"))
    bad = ~F.coalesce(F.col(valid), F.lit(False))
    best = nearest_hit(px.where(bad).select("image", "r", "c"), seen, radius).withColumn("__hit", F.lit(True)).drop("__d")
    none = F.raise_error(F.lit("an image has no valid pixel")).cast(dict(px.dtypes)[value])
    return px.join(best, ["image", "r", "c"], "left").withColumn(value, F.when(~bad, F.col(value)).when(F.col("__hit"), F.col("__f")).otherwise(none)).drop("__f", "__hit")


def absorb_tiny(px: DataFrame, percentage: float, radius: int = 3) -> DataFrame:
    """Regions below a percentage of the labelled pixels (16 at least) take the label of the nearest larger region, pixel by
    pixel; labels 1..k afterwards. Where no region is large enough, all stay."""
    sizes = px.where("label > 0").groupBy("image", "label").agg(F.count(F.lit(1)).alias("__n"))
    all_of = W.partitionBy("image")
    least = F.greatest(F.lit(16), F.floor(F.sum("__n").over(all_of) * percentage / 100.0))
    tiny = sizes.withColumn("__tiny", F.col("__n") < least).withColumn("__tiny", F.col("__tiny") & ~F.min("__tiny").over(all_of)).select("image", "label", "__tiny")
    told = px.join(tiny, ["image", "label"], "left").withColumn("__tiny", F.coalesce("__tiny", F.lit(False)))
    seen = told.where("label > 0 and not __tiny").select("image", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("label").alias("found"))
    best = nearest_hit(told.where("__tiny").select("image", "r", "c"), seen, radius).drop("__d")
    out = told.join(best, ["image", "r", "c"], "left").withColumn("label", F.coalesce("__f", "label")).drop("__f", "__tiny")
    return dense_relabel(out)


def boundary_distance(px: DataFrame, flag: str, out: str, radius: int = 3) -> DataFrame:
    """The exact distance of each pixel to the nearest flagged one of its image; infinite in an image without any."""
    seen = px.where(F.col(flag)).select("image", F.col("r").alias("r2"), F.col("c").alias("c2"), F.lit(1).alias("found"))
    best = nearest_hit(px.where(~F.coalesce(F.col(flag), F.lit(False))).select("image", "r", "c"), seen, radius).drop("__f")
    far = F.when(F.col(flag), 0.0).otherwise(F.coalesce(F.sqrt("__d"), F.lit(float("inf"))))
    return px.join(best, ["image", "r", "c"], "left").withColumn(out, far).drop("__d")


def displacement(px: DataFrame, boundary: str, baseline: str, radius: int = 3) -> DataFrame:
    """image, pixels, distance: the mean distance of one boundary's pixels to another boundary; 0 without pixels."""
    far = boundary_distance(px, baseline, "__far", radius)
    return far.groupBy("image").agg(F.count_if(boundary).alias("pixels"), F.coalesce(F.avg(F.when(F.col(boundary), F.col("__far"))), F.lit(0.0)).alias("distance"))


def within(px: DataFrame, flag: str, most: float, out: str) -> DataFrame:
    """Whether a flagged pixel is at most ``most`` away: a disc put together of a stretch of each of its rows, by windows."""
    on, reach = F.coalesce(F.col(flag), F.lit(False)).cast("int"), math.floor(most)
    halves = {dr: math.isqrt(math.floor(most * most) - dr * dr) for dr in range(reach + 1)} if most >= 0 else {}
    rows = {w: W.partitionBy("image", "r").orderBy("c").rangeBetween(-w, w) for w in set(halves.values())}
    px = px.withColumns({f"__w{w}": F.max(on).over(at) for w, at in rows.items()})
    line = W.partitionBy("image", "c").orderBy("r")
    met = [F.max(f"__w{w}").over(line.rangeBetween(dr, dr)) for half, w in halves.items() for dr in {half, -half}]
    near = F.coalesce(F.greatest(*met, F.lit(0), F.lit(0)) > 0, F.lit(False))
    return px.withColumn(out, near).drop(*[f"__w{w}" for w in rows])


def supported_boundary(px: DataFrame, boundary: str, other: str, evidence: str, most: float, out: str) -> DataFrame:
    """Flag the boundary's pixels that are within ``most`` of another boundary, or whose evidence reaches the 62nd percentile
    of the evidence on the boundary (1 without such pixels)."""
    px = cut(px, "boundaries")
    limits = exact_quantile(px.where(F.col(boundary)), evidence, 0.62).withColumnRenamed("__q", "__limit")
    near = within(px, other, most, "__near").join(F.broadcast(limits), "image", "left")
    ok = F.col(boundary) & (F.col("__near") | (F.col(evidence) >= F.coalesce("__limit", F.lit(1.0))))
    return near.withColumn(out, F.coalesce(ok, F.lit(False))).drop("__near", "__limit")


def _fill_far(holes: DataFrame, seen: DataFrame) -> DataFrame:
    """(image, r, c, __f, __d) by an exact distance transform: the nearest labelled pixel of each column, for the rows that
    have holes, and then for each hole the nearest of its row's columns."""
    columns = seen.select("image", F.col("c2").alias("c")).distinct()
    asked = holes.select("image", "r").distinct().join(columns, "image").withColumn("hit", F.lit(None).cast(f"struct<r2:{dict(seen.dtypes)['r2']},found:{dict(seen.dtypes)['found']}>"))
    told = seen.select("image", F.col("r2").alias("r"), F.col("c2").alias("c"), F.struct("r2", "found").alias("hit"))
    # Both windows run forwards: for a frame that begins at the current row and has no end, Spark goes through all of it again
    # for every row.
    up, down = (F.last("hit", True).over(W.partitionBy("image", "c").orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)) for order in (F.asc("r"), F.desc("r")))
    both = asked.withColumn("asked", F.lit(True)).unionByName(told.withColumn("asked", F.lit(False))).withColumns({"up": up, "down": down}).where("asked")
    far = lambda x: F.abs(F.col(f"{x}.r2") - F.col("r"))
    hit = F.when(F.col("down").isNull() | (far("up") <= far("down")), F.col("up")).otherwise(F.col("down"))
    lines = both.withColumn("hit", hit).groupBy("image", "r").agg(F.collect_list(F.struct("c", "hit.r2", "hit.found")).alias("line"))
    wide = lambda x: x.cast("long") * x.cast("long")
    near = F.transform("line", lambda x: F.struct((wide(x["c"] - F.col("c")) + wide(x["r2"] - F.col("r"))).alias("d"), x["r2"].alias("r2"), x["c"].alias("c2"), x["found"].alias("found")))
    return holes.join(lines, ["image", "r"]).select("image", "r", "c", F.array_min(near).alias("m")).select("image", "r", "c", F.col("m.found").alias("__f"), F.col("m.d").alias("__d"))


def nearest_valid(px: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (image, id, x, y) the valid pixel nearest to it: first in row-major order."""
    at = px.join(points, "image").withColumn("d", (F.col("c") - F.col("x")) ** 2 + (F.col("r") - F.col("y")) ** 2)
    return at.groupBy("image", "id").agg(F.min(F.struct("d", "r", "c")).alias("m")).select("image", "id", "m.r", "m.c")
