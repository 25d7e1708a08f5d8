"""The registered queries over the tables, and the SQL that gives the same rows.

``embeddings`` is read as a raster: row = vec_id, column = position, height = value; labels are bands of the value or
stripes of columns; the mesh has two triangles for each cell of the raster.
"""
from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import documents as D
from ..operators import fits, graph, mesh, outlines, partition, paths, raster, scores, vector, visibility

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AFFINE = (0.5, 0.1, 100.0, 0.0, -0.5, 200.0)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql if sql.startswith("WITH") else f"WITH {PX} {sql}"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, r, c, v, label (bands of v), stripe (columns), evidence, line."""
    e = table(spark, sf_dir, "embeddings")
    px = e.select(F.lit("e").alias("image"), F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "f")).select("image", "r", "c", F.col("f").cast("double").alias("v"))
    band = F.when(F.col("v") < -0.1, 1).when(F.col("v") < 0, 2).when(F.col("v") < 0.1, 3).otherwise(4)
    return px.withColumns({"label": band, "stripe": F.floor(F.col("c") / 16).cast("int") + 1, "evidence": F.abs("v"), "line": F.col("v") > 0.3})


PX = """px AS (
  SELECT 'e' AS image, vec_id AS r, c, v, CASE WHEN v < -0.1 THEN 1 WHEN v < 0 THEN 2 WHEN v < 0.1 THEN 3 ELSE 4 END AS label,
    CAST(c // 16 AS INTEGER) + 1 AS stripe, abs(v) AS evidence, v > 0.3 AS line
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)),
pairs AS (
  SELECT a.*, b.label AS l2, b.v AS v2, b.evidence AS e2, b.line AS line2, b.stripe AS stripe2, b.r AS r2, b.c AS c2
  FROM px a JOIN px b ON b.r = a.r AND b.c = a.c + 1
  UNION ALL SELECT a.*, b.label, b.v, b.evidence, b.line, b.stripe, b.r, b.c FROM px a JOIN px b ON b.c = a.c AND b.r = a.r + 1),
diff AS (SELECT *, least(label, l2) AS a, greatest(label, l2) AS b FROM pairs WHERE label <> l2)"""


# Regions and their neighbours.
@query("region_summary", """SELECT image, label AS id, count(*) AS area_pixels, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS area_percentage,
  min(c) AS x_min, min(r) AS y_min, max(c) AS x_max, max(r) AS y_max, round(avg(c), 2) AS centroid_x, round(avg(r), 2) AS centroid_y FROM px GROUP BY image, label""")
def region_summary(spark, sf):
    return raster.summary(pixels(spark, sf))


@query("region_features", "SELECT image, label, round(avg(v) * 1.5, 6) + 0.0 AS v, round(avg(evidence) * 3.0, 6) + 0.0 AS evidence, round(avg(c) * 0.45, 6) + 0.0 AS c FROM px GROUP BY image, label")
def region_features(spark, sf):
    return raster.region_features(pixels(spark, sf), {"v": 1.5, "evidence": 3.0, "c": 0.45})


@query("region_adjacency", "SELECT DISTINCT image, a, b FROM diff")
def region_adjacency(spark, sf):
    return raster.adjacency(pixels(spark, sf))


@query("adjacency_statistics", """, ok AS (SELECT * FROM diff WHERE v > -0.2 AND v2 > -0.2)
  SELECT image, a, b, count(*) AS samples, round(median(abs(v - v2)), 6) AS median_step, round(avg(greatest(evidence, e2)), 6) AS mean_evidence FROM ok GROUP BY image, a, b""")
def adjacency_statistics(spark, sf):
    # Validity holds for both sides of a pair, as invalid pixels are left out before neighbours are looked up.
    out = raster.adjacency_statistics(pixels(spark, sf), "v", F.col("v") > -0.2, "evidence")
    return out.withColumns({"median_step": F.round("median_step", 6), "mean_evidence": F.round("mean_evidence", 6)})


@query("barrier_connectivity", """, s AS (SELECT image, a, b, quantile_cont(greatest(evidence, e2), 0.75) AS score, bool_or(line OR line2) AS hard_line FROM diff GROUP BY image, a, b)
  SELECT image, a, b, round(score, 4) AS score, hard_line, hard_line OR score >= 0.17 AS blocked FROM s""")
def barrier_connectivity(spark, sf):
    return raster.barriers(pixels(spark, sf), "evidence", "line", 0.17).withColumn("score", F.round("score", 4))


@query("internal_boundary", "SELECT image, r, c FROM diff UNION SELECT image, r2, c2 FROM diff")
def internal_boundary(spark, sf):
    return raster.internal_boundary(pixels(spark, sf))


@query("boundary_complexity", "SELECT image, count(*) AS complexity FROM diff GROUP BY image")
def boundary_complexity(spark, sf):
    return raster.boundary_complexity(pixels(spark, sf))


@query("boundary_support", """, h AS (SELECT *, min(label) OVER w AS lo, max(label) OVER w AS hi FROM px WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
  g AS (SELECT *, min(lo) OVER w AS lo2, max(hi) OVER w AS hi2 FROM h WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
  SELECT image, count(*) FILTER (WHERE hi2 > lo2) AS pixels, round(coalesce(avg(evidence) FILTER (WHERE hi2 > lo2), 0), 6) AS support FROM g GROUP BY image""")
def boundary_support(spark, sf):
    return raster.boundary_support(pixels(spark, sf), "evidence").withColumn("support", F.round("support", 6))


# Pixels and their eight neighbours, as offsets.
AROUND = "near8(dr, dc) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))"


@query("mean_shared_boundary", f""", {AROUND}, met AS (SELECT DISTINCT q.image, p.label AS a, q.label AS b, q.r, q.c, q.evidence FROM px q CROSS JOIN near8 JOIN px p ON p.r = q.r + dr AND p.c = q.c + dc WHERE p.label < q.label)
  SELECT image, a, b, count(*) AS contacts, round(avg(evidence), 6) AS support FROM met GROUP BY image, a, b""")
def mean_shared_boundary(spark, sf):
    return raster.shared_support(pixels(spark, sf), "evidence").withColumn("support", F.round("support", 6))


# Fields.
@query("normalize_p2_p98", """, b AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM px)
  SELECT image, label, count(*) AS n, round(avg(CASE WHEN hi - lo < 1e-6 THEN 0.5 ELSE least(greatest((v - lo) / (hi - lo), 0), 1) END), 6) AS mean_unit FROM px, b GROUP BY image, label""")
def normalize_p2_p98(spark, sf):
    out = S.stretched(pixels(spark, sf), "v", ["image"], "u", 0.5)
    return out.groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 6).alias("mean_unit"))


@query("robust_unit", """WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(CASE WHEN hi - lo < 1e-6 THEN 0 ELSE least(greatest((l_extendedprice - lo) / (hi - lo), 0), 1) END), 6) AS mean_unit
  FROM lineitem JOIN b USING (l_returnflag) GROUP BY ALL""")
def robust_unit(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    out = S.stretched(li, "l_extendedprice", ["l_returnflag"], "u", 0.0, finite_only=True)
    return out.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 6).alias("mean_unit"))


@query("metric_gradients", """, g AS (SELECT image, r, c,
    CASE WHEN lc IS NOT NULL AND nc IS NOT NULL THEN (nc - lc) / 2 WHEN nc IS NOT NULL THEN nc - v WHEN lc IS NOT NULL THEN v - lc ELSE 0 END AS dc,
    CASE WHEN lr IS NOT NULL AND nr IS NOT NULL THEN (nr - lr) / 2 WHEN nr IS NOT NULL THEN nr - v WHEN lr IS NOT NULL THEN v - lr ELSE 0 END AS dr
    FROM (SELECT *, lag(v) OVER (PARTITION BY r ORDER BY c) AS lc, lead(v) OVER (PARTITION BY r ORDER BY c) AS nc, lag(v) OVER (PARTITION BY c ORDER BY r) AS lr, lead(v) OVER (PARTITION BY c ORDER BY r) AS nr FROM px))
  SELECT image, r, c, round((dc * -0.5) / -0.25, 6) + 0.0 AS sx, round((dr * 0.5 - dc * 0.1) / -0.25, 6) + 0.0 AS sy FROM g""")
def metric_gradients(spark, sf):
    g = raster.gradients(pixels(spark, sf), "v", AFFINE)
    return g.select("image", "r", "c", S.fixed(F.col("sx")).alias("sx"), S.fixed(F.col("sy")).alias("sy"))


SOBEL = """, h AS (SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w, v) AS l, coalesce(lead(v) OVER w, lag(v) OVER w, v) AS n FROM px WINDOW w AS (PARTITION BY r ORDER BY c)),
  d AS (SELECT *, n - l AS dx, l + 2 * v + n AS s FROM h),
  g AS (SELECT *, coalesce(lag(dx) OVER w, lead(dx) OVER w, dx) + 2 * dx + coalesce(lead(dx) OVER w, lag(dx) OVER w, dx) AS gx, coalesce(lead(s) OVER w, lag(s) OVER w, s) - coalesce(lag(s) OVER w, lead(s) OVER w, s) AS gy
    FROM d WINDOW w AS (PARTITION BY c ORDER BY r)),
  sobel AS (SELECT *, sqrt(gx * gx + gy * gy) AS magnitude FROM g)"""


@query("sobel_gradient", f"{SOBEL} SELECT image, r, c, round(magnitude, 6) + 0.0 AS magnitude FROM sobel")
def sobel_gradient(spark, sf):
    return raster.sobel(pixels(spark, sf), "v").select("image", "r", "c", S.fixed(F.col("magnitude")).alias("magnitude"))


@query("structural_evidence", f"""{SOBEL}, t AS (SELECT quantile_cont(magnitude, 0.98) AS tm, quantile_cont(evidence, 0.98) AS te FROM sobel)
  SELECT image, label, count(*) AS n, round(avg(CASE WHEN line THEN 1.0 ELSE 0.65 * least(magnitude / tm, 1) + 0.35 * least(evidence / te, 1) END), 6) AS mean_evidence FROM sobel, t GROUP BY image, label""")
def structural_evidence(spark, sf):
    px = raster.weighted_evidence(raster.sobel(pixels(spark, sf), "v"), {"magnitude": 0.65, "evidence": 0.35}, "e")
    px = px.withColumn("e", F.when(F.col("line"), 1.0).otherwise(F.col("e")))
    return px.groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean_evidence"))


@query("dilated_boundary", """, f AS (SELECT *, max(CAST(line AS INTEGER)) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM px),
  g AS (SELECT *, max(w) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w2 FROM f) SELECT image, label, count(*) FILTER (WHERE w2 > 0) AS near_line FROM g GROUP BY image, label""")
def dilated_boundary(spark, sf):
    return raster.dilate(pixels(spark, sf), "line", 2, "near").groupBy("image", "label").agg(F.count_if("near").alias("near_line"))


KERNEL = ", ".join(f"({k - 5}, {w!r}::DOUBLE)" for k, w in enumerate(raster.gaussian_kernel(1.15)))
BLUR = f""", ends AS (SELECT max(r) AS rmax, max(c) AS cmax FROM px), kernel(k, w) AS (VALUES {KERNEL}),
  wide AS (SELECT p.r, p.c, sum(w * n.v) AS h FROM px p CROSS JOIN kernel CROSS JOIN ends JOIN px n ON n.r = p.r AND n.c = CASE WHEN p.c + k < 0 THEN -(p.c + k) WHEN p.c + k > cmax THEN 2 * cmax - p.c - k ELSE p.c + k END GROUP BY p.r, p.c),
  blur AS (SELECT p.r, p.c, sum(w * n.h) AS s FROM wide p CROSS JOIN kernel CROSS JOIN ends JOIN wide n ON n.c = p.c AND n.r = CASE WHEN p.r + k < 0 THEN -(p.r + k) WHEN p.r + k > rmax THEN 2 * rmax - p.r - k ELSE p.r + k END GROUP BY p.r, p.c)"""


@query("gaussian_blur", f"{BLUR} SELECT 'e' AS image, r, c, round(s, 6) + 0.0 AS smooth FROM blur")
def gaussian_blur(spark, sf):
    out = raster.convolve(pixels(spark, sf), "v", raster.gaussian_kernel(1.15), "smooth")
    return out.select("image", "r", "c", S.fixed(F.col("smooth")).alias("smooth"))


def _mirrored(table: str, value: str, out: str, combine: str) -> str:
    """A 3x3 stencil over mirrored borders: ``combine`` may use nw, n, ne, w, m, e, sw, s_, se."""
    names = iter(("nw", "n", "ne", "w", "m", "e", "sw", "s_", "se"))
    picks = ", ".join(f"max(CASE WHEN dr = {dr} AND dc = {dc} THEN q.{value} END) AS {next(names)}" for dr in (-1, 0, 1) for dc in (-1, 0, 1))
    return f"""st_{out} AS (SELECT p.r, p.c, {picks} FROM {table} p CROSS JOIN (SELECT i - 1 AS dr, j - 1 AS dc FROM range(3) x(i), range(3) y(j)) CROSS JOIN ends
    JOIN {table} q ON q.r = CASE WHEN p.r + dr < 0 THEN 1 WHEN p.r + dr > rmax THEN rmax - 1 ELSE p.r + dr END AND q.c = CASE WHEN p.c + dc < 0 THEN 1 WHEN p.c + dc > cmax THEN cmax - 1 ELSE p.c + dc END GROUP BY p.r, p.c),
  {out} AS (SELECT r, c, {combine} AS {out} FROM st_{out})"""


@query("laplacian", f""", ends AS (SELECT max(r) AS rmax, max(c) AS cmax FROM px), {_mirrored("px", "v", "lap", "2 * (nw + ne + sw + se) - 8 * m")} SELECT 'e' AS image, r, c, round(lap, 6) + 0.0 AS lap FROM lap""")
def laplacian(spark, sf):
    return raster.laplacian(pixels(spark, sf), "v", "lap").select("image", "r", "c", S.fixed(F.col("lap")).alias("lap"))


@query("gradient_map", f"{SOBEL}, b AS (SELECT quantile_cont(magnitude, 0.02) AS lo, quantile_cont(magnitude, 0.98) AS hi FROM sobel) SELECT image, r, c, round(CASE WHEN hi - lo < 1e-6 THEN 0.5 ELSE least(greatest((magnitude - lo) / (hi - lo), 0), 1) END, 6) + 0.0 AS strength FROM sobel, b")
def gradient_map(spark, sf):
    return raster.gradient_map(pixels(spark, sf), "v", "strength").select("image", "r", "c", S.fixed(F.col("strength")).alias("strength"))


@query("elevation_evidence", f"""{BLUR}, slopes AS (SELECT r, c, (dc * -0.5) / -0.25 + (dr * 0.5 - dc * 0.1) / -0.25 AS slope FROM (
    SELECT p.r, p.c, CASE WHEN p.c = 0 THEN e.s - p.s WHEN p.c = cmax THEN p.s - w.s ELSE (e.s - w.s) / 2 END AS dc, CASE WHEN p.r = 0 THEN d.s - p.s WHEN p.r = rmax THEN p.s - u.s ELSE (d.s - u.s) / 2 END AS dr
    FROM blur p CROSS JOIN ends LEFT JOIN blur e ON e.r = p.r AND e.c = p.c + 1 LEFT JOIN blur w ON w.r = p.r AND w.c = p.c - 1 LEFT JOIN blur u ON u.c = p.c AND u.r = p.r - 1 LEFT JOIN blur d ON d.c = p.c AND d.r = p.r + 1)),
  {_mirrored("slopes", "slope", "change", "sqrt((ne + 2 * e + se - nw - 2 * w - sw) ** 2 + (sw + 2 * s_ + se - nw - 2 * n - ne) ** 2)")},
  {_mirrored("blur", "s", "curve", "abs(2 * (nw + ne + sw + se) - 8 * m)")},
  fields AS (SELECT r, c, change, curve FROM change JOIN curve USING (r, c)),
  q AS (SELECT quantile_cont(change, 0.02) AS l1, quantile_cont(change, 0.98) AS h1, quantile_cont(curve, 0.02) AS l2, quantile_cont(curve, 0.98) AS h2 FROM fields)
  SELECT 'e' AS image, r, c, round(0.72 * least(greatest((change - l1) / (h1 - l1), 0), 1) + 0.28 * least(greatest((curve - l2) / (h2 - l2), 0), 1), 5) + 0.0 AS edge FROM fields, q""")
def elevation_evidence(spark, sf):
    return raster.elevation_evidence(pixels(spark, sf), "v", AFFINE, "edge").select("image", "r", "c", S.fixed(F.col("edge"), 5).alias("edge"))


@query("combined_evidence", "SELECT image, label, round(avg(least(greatest(0.44 * evidence + 0.56 * v, 0), 1)), 6) AS combined FROM px GROUP BY image, label")
def combined_evidence(spark, sf):
    return pixels(spark, sf).groupBy("image", "label").agg(F.round(F.avg(raster.combined_evidence(F.col("evidence"), F.col("v"))), 6).alias("combined"))


@query("minimum_region", "WITH n AS (SELECT o_custkey, sum(o_totalprice) AS a FROM orders GROUP BY 1) SELECT o_custkey, CAST(greatest(20, round_even(a * 0.05 / 100.0, 0)) AS BIGINT) AS least FROM n")
def minimum_region(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("a"))
    return n.select("o_custkey", scores.least_region(F.col("a"), 0.05).alias("least"))


def _within(holes: str, seen: str, found: str) -> str:
    """The nearest pixel within five rows and columns: enough for these tables, whose pixels are noise."""
    return f"""off AS (SELECT i - 5 AS dr, j - 5 AS dc FROM range(11) a(i), range(11) b(j)),
  hit AS (SELECT h.r, h.c, f.{found} AS found, sqrt(off.dr * off.dr + off.dc * off.dc) AS far FROM {holes} h CROSS JOIN off JOIN {seen} f ON f.r = h.r + off.dr AND f.c = h.c + off.dc
    QUALIFY row_number() OVER (PARTITION BY h.r, h.c ORDER BY off.dr * off.dr + off.dc * off.dc, f.r, f.c) = 1)"""


@query("fill_invalid", f""", good AS (SELECT * FROM px WHERE evidence >= 0.04), bad AS (SELECT * FROM px WHERE evidence < 0.04), {_within("bad", "good", "v")}
  SELECT px.image, px.r, px.c, round(coalesce(found, v), 6) + 0.0 AS v FROM px LEFT JOIN hit USING (r, c)""")
def fill_invalid(spark, sf):
    px = pixels(spark, sf).withColumn("ok", F.col("evidence") >= 0.04)
    return raster.fill_invalid(px, "v", "ok").select("image", "r", "c", S.fixed(F.col("v")).alias("v"))


@query("absorb_tiny", f""", fine AS (SELECT image, r, c, CASE WHEN v > 0.3 THEN 100 + r % 3 WHEN v < 0 THEN 1 ELSE 2 END AS l FROM px), n AS (SELECT l, count(*) AS n FROM fine GROUP BY l),
  kept AS (SELECT l, n >= greatest(16, floor(sum(n) OVER () * 20.0 / 100)) AS large FROM n), big AS (SELECT fine.* FROM fine JOIN kept USING (l) WHERE large), small AS (SELECT fine.* FROM fine JOIN kept USING (l) WHERE NOT large), {_within("small", "big", "l")},
  put AS (SELECT fine.image, coalesce(found, l) AS l FROM fine LEFT JOIN hit USING (r, c)) SELECT image, label, count(*) AS n FROM (SELECT image, dense_rank() OVER (ORDER BY l) AS label FROM put) GROUP BY image, label""")
def absorb_tiny(spark, sf):
    px = pixels(spark, sf).withColumn("label", F.when(F.col("v") > 0.3, 100 + F.col("r") % 3).when(F.col("v") < 0, 1).otherwise(2))
    return raster.absorb_tiny(px.select("image", "r", "c", "label"), 20.0).groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"))


LINES = """, border AS (SELECT r, c FROM diff UNION SELECT r2, c2 FROM diff), sdiff AS (SELECT * FROM pairs WHERE stripe <> stripe2), sborder AS (SELECT r, c FROM sdiff UNION SELECT r2, c2 FROM sdiff)"""


def _borders(spark, sf):
    px = pixels(spark, sf)
    for name, label in (("one", "stripe"), ("two", "label")):
        on = raster.internal_boundary(px.withColumn("label", F.col(label))).withColumn(name, F.lit(True))
        px = px.join(on, ["image", "r", "c"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return px


@query("boundary_displacement", f"{LINES}, lit AS (SELECT r, c, 1 AS one FROM border), {_within('sborder', 'lit', 'one')} SELECT 'e' AS image, count(*) AS pixels, round(avg(far), 6) AS distance FROM hit")
def boundary_displacement(spark, sf):
    return raster.displacement(_borders(spark, sf), "one", "two").withColumn("distance", F.round("distance", 6))


@query("supported_boundary", f"""{LINES}, lit AS (SELECT r, c, 1 AS one FROM sborder), own AS (SELECT px.* FROM px JOIN border USING (r, c)), lim AS (SELECT quantile_cont(evidence, 0.62) AS t FROM own), {_within('own', 'lit', 'one')}
  SELECT own.image, count(*) AS pixels, count(*) FILTER (WHERE coalesce(far, 99) <= 2.0 OR evidence >= t) AS supported FROM own CROSS JOIN lim LEFT JOIN hit USING (r, c) GROUP BY own.image""")
def supported_boundary(spark, sf):
    out = raster.supported_boundary(_borders(spark, sf), "two", "one", "evidence", 2.0, "ok")
    return out.groupBy("image").agg(F.count_if("two").alias("pixels"), F.count_if("ok").alias("supported"))


# Overlays.
@query("overlay_partition", "SELECT image, label, stripe, count(*) AS pixels FROM px GROUP BY image, label, stripe")
def overlay_partition(spark, sf):
    return raster.overlay(pixels(spark, sf), "label", "stripe")


@query("mask_iou", """, m AS (SELECT image, count(*) FILTER (WHERE v > -0.2 AND v > 0) AS b, count(*) FILTER (WHERE v > -0.2 OR c < 32) AS u, count(*) FILTER (WHERE v > -0.2 AND c < 32) AS i, count(*) FILTER (WHERE v > -0.2) AS p, count(*) FILTER (WHERE c < 32) AS t FROM px GROUP BY image)
  SELECT image, round(i / u, 6) AS iou, round(i / p, 6) AS "precision", round(i / t, 6) AS recall FROM m""")
def mask_iou(spark, sf):
    out = raster.mask_scores(pixels(spark, sf), F.col("v") > -0.2, F.col("c") < 32)
    return out.select("image", *[F.round(k, 6).alias(k) for k in ("iou", "precision", "recall")])


@query("label_iou_matrix", """, o AS (SELECT image, label, stripe, count(*) AS pixels FROM px GROUP BY ALL), a AS (SELECT label, count(*) AS n1 FROM px GROUP BY label), b AS (SELECT stripe, count(*) AS n2 FROM px GROUP BY stripe)
  SELECT image, label, stripe, pixels, round(pixels / (n1 + n2 - pixels), 6) AS iou FROM o JOIN a USING (label) JOIN b USING (stripe)""")
def label_iou_matrix(spark, sf):
    return raster.label_iou(pixels(spark, sf), "label", "stripe").select("image", "label", "stripe", "pixels", F.round("iou", 6).alias("iou"))


def _edge_sql(label: str, n: int) -> str:
    return (f", h{n} AS (SELECT image, r, c, min({label}) OVER w AS lo, max({label}) OVER w AS hi FROM px WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))"
            f", b{n} AS (SELECT image, r, c, (max(hi) OVER w > min(lo) OVER w) AS b FROM h{n} WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))"
            f", w{n} AS (SELECT image, r, c, b, max(CAST(b AS INTEGER)) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM b{n})"
            f", d{n} AS (SELECT image, r, c, b, max(w) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) > 0 AS near FROM w{n})")


@query("boundary_f1", _edge_sql("stripe", 1) + _edge_sql("label", 2) + """, m AS (SELECT d1.image, count(*) FILTER (WHERE d1.b AND d2.near) / greatest(count(*) FILTER (WHERE d1.b), 1) AS p, count(*) FILTER (WHERE d2.b AND d1.near) / greatest(count(*) FILTER (WHERE d2.b), 1) AS q FROM d1 JOIN d2 USING (r, c) GROUP BY d1.image)
  SELECT image, round(p, 6) AS "precision", round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM m""")
def boundary_f1(spark, sf):
    return raster.boundary_f1(pixels(spark, sf), "stripe", "label").select("image", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")])


@query("changed_pixels", "SELECT image, count(*) FILTER (WHERE label <> stripe) AS changed, round(100.0 * count(*) FILTER (WHERE label <> stripe) / count(*), 6) AS percentage FROM px GROUP BY image")
def changed_pixels(spark, sf):
    return raster.changed(pixels(spark, sf), "label", "stripe")


@query("dense_relabel", "SELECT image, label, count(*) AS n FROM (SELECT image, dense_rank() OVER (ORDER BY l) AS label FROM (SELECT image, r, c, label * 10 + stripe AS l FROM px WHERE v < 0.2)) GROUP BY image, label")
def dense_relabel(spark, sf):
    px = pixels(spark, sf).where("v < 0.2").withColumn("label", F.col("label") * 10 + F.col("stripe"))
    return raster.dense_relabel(px).groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"))


@query("nearest_fill", """, s AS (SELECT image, r, c, CASE WHEN evidence < 0.05 THEN 0 ELSE label END AS label FROM px),
  o AS (SELECT i - 3 AS dr, j - 3 AS dc FROM range(7) a(i), range(7) b(j)),
  hit AS (SELECT h.r, h.c, f.label, row_number() OVER (PARTITION BY h.r, h.c ORDER BY o.dr * o.dr + o.dc * o.dc, f.r, f.c) AS n FROM s h CROSS JOIN o JOIN s f ON f.r = h.r + o.dr AND f.c = h.c + o.dc WHERE h.label = 0 AND f.label > 0)
  SELECT s.image, s.r, s.c, coalesce(hit.label, s.label) AS label FROM s LEFT JOIN hit ON s.r = hit.r AND s.c = hit.c AND hit.n = 1""")
def nearest_fill(spark, sf):
    px = pixels(spark, sf).select("image", "r", "c", F.when(F.col("evidence") < 0.05, 0).otherwise(F.col("label")).alias("label"))
    return raster.nearest_fill(px, 3).select("image", "r", "c", "label")


# Fits.
FITS = """, f AS (SELECT image, label, count(*) AS samples, avg(c) AS mx, avg(r) AS my, avg(v) AS mz, var_pop(c) AS vx, var_pop(r) AS vy, var_pop(v) AS vz, covar_pop(c, r) AS cxy, covar_pop(c, v) AS cxz, covar_pop(r, v) AS cyz FROM px GROUP BY image, label),
  s AS (SELECT *, (cxz * vy - cyz * cxy) / (vx * vy - cxy * cxy) AS sx, (cyz * vx - cxz * cxy) / (vx * vy - cxy * cxy) AS sy FROM f),
  fit AS (SELECT *, mz - sx * mx - sy * my AS "offset", sqrt(greatest(vz - sx * cxz - sy * cyz, 0)) AS rmse FROM s)"""


def _fits(spark, sf):
    return fits.ols(pixels(spark, sf), ["image", "label"], "c", "r", "v")


@query("plane_fit_ols", f'{FITS} SELECT image, label, samples, round(sx, 8) + 0.0 AS sx, round(sy, 8) + 0.0 AS sy, round("offset", 6) + 0.0 AS "offset", round(rmse, 6) AS rmse FROM fit')
def plane_fit_ols(spark, sf):
    return _fits(spark, sf).select("image", "label", "samples", S.fixed(F.col("sx"), 8).alias("sx"), S.fixed(F.col("sy"), 8).alias("sy"), S.fixed(F.col("offset")).alias("offset"), F.round("rmse", 6).alias("rmse"))


@query("plane_fit_suppliers", """WITH f AS (SELECT l_suppkey, count(*) AS samples, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz, var_pop(l_quantity) AS vx, var_pop(l_discount) AS vy, covar_pop(l_quantity, l_discount) AS cxy, covar_pop(l_quantity, l_extendedprice) AS cxz, covar_pop(l_discount, l_extendedprice) AS cyz FROM lineitem GROUP BY l_suppkey)
  SELECT l_suppkey, samples, CASE WHEN vx * vy - cxy * cxy > 1e-12 THEN round((cxz * vy - cyz * cxy) / (vx * vy - cxy * cxy), 4) + 0.0 END AS sx, CASE WHEN vx * vy - cxy * cxy > 1e-12 THEN round((cyz * vx - cxz * cxy) / (vx * vy - cxy * cxy), 2) + 0.0 END AS sy FROM f""")
def plane_fit_suppliers(spark, sf):
    out = fits.ols(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount", "l_extendedprice")
    return out.select("l_suppkey", "samples", S.fixed(F.col("sx"), 4).alias("sx"), S.fixed(F.col("sy"), 2).alias("sy"))


@query("plane_fit_robust")
def plane_fit_robust(spark, sf):
    px = pixels(spark, sf).withColumns({"x": F.col("c") / 63, "y": F.col("r") / 1000})
    return fits.robust(px, ["image", "stripe"], "x", "y", "v")


@query("plane_fit_ransac")
def plane_fit_ransac(spark, sf):
    return fits.robust(pixels(spark, sf).withColumns({"x": F.col("c") * 0.5, "y": F.col("r") * 0.5}), ["image", "stripe"], "x", "y", "v", method="ransac", threshold=0.18)


@query("fit_aggregate", f"{FITS} SELECT image, CAST(sum(samples) AS BIGINT) AS samples, count(*) AS fits, round(sum(samples * rmse) / sum(samples), 6) AS rmse FROM fit GROUP BY image")
def fit_aggregate(spark, sf):
    return fits.aggregate_fits(_fits(spark, sf), ["image"], "samples", ["rmse"]).withColumn("rmse", F.round("rmse", 6))


@query("plane_pitch_aspect", f"{FITS}, a AS (SELECT *, degrees(atan2(-sx, -sy)) AS d FROM fit) SELECT image, label, round(degrees(atan(sqrt(sx * sx + sy * sy))), 5) AS pitch, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 3) AS aspect FROM a")
def plane_pitch_aspect(spark, sf):
    f = _fits(spark, sf)
    return f.select("image", "label", F.round(S.pitch(F.col("sx"), F.col("sy")), 5).alias("pitch"), F.round(S.aspect(F.col("sx"), F.col("sy")), 3).alias("aspect"))


ANGLES = f"""{FITS}, n AS (SELECT label, -sx * 100 / sqrt(10000 * (sx * sx + sy * sy) + 1) AS nx, -sy * 100 / sqrt(10000 * (sx * sx + sy * sy) + 1) AS ny, 1 / sqrt(10000 * (sx * sx + sy * sy) + 1) AS nz FROM fit),
  ang AS (SELECT p.image, p.a, p.b, degrees(acos(least(greatest(x.nx * y.nx + x.ny * y.ny + x.nz * y.nz, -1), 1))) AS angle FROM (SELECT DISTINCT image, a, b FROM diff) p JOIN n x ON x.label = p.a JOIN n y ON y.label = p.b)"""


def _angles(spark, sf):
    steep = _fits(spark, sf).withColumns({"sx": F.col("sx") * 100, "sy": F.col("sy") * 100})
    return fits.normal_angles(raster.adjacency(pixels(spark, sf)), steep, ["image"])


@query("normal_angle_pairs", f"{ANGLES} SELECT image, a, b, round(angle, 4) AS angle FROM ang")
def normal_angle_pairs(spark, sf):
    return _angles(spark, sf).withColumn("angle", F.round("angle", 4))


@query("planar_merge_round", f"""{ANGLES}, st AS (SELECT a, b, median(abs(v - v2)) AS median_step, avg(greatest(evidence, e2)) AS mean_evidence FROM diff GROUP BY a, b)
  SELECT ang.image, ang.a, ang.b FROM ang JOIN st USING (a, b) WHERE angle <= 6.0 AND median_step <= 0.15 AND mean_evidence <= 0.72""")
def planar_merge_round(spark, sf):
    stats = raster.adjacency_statistics(pixels(spark, sf), "v", F.lit(True), "evidence")
    both = _angles(spark, sf).join(stats, ["image", "a", "b"])
    return graph.planar_merges(both, 6.0, 0.15, 0.72).select("image", "a", "b")


@query("planar_merge")
def planar_merge(spark, sf):
    px = pixels(spark, sf).withColumns({"label": F.col("label") * 10 + F.col("stripe"), "ok": F.col("v") > -0.3})
    out, _ = partition.merge_planar(px.drop("stripe"), lambda p: fits.ols(p, ["image", "label"], "c", "r", "v"), "v", "ok", "evidence", 1.0, 0.12, 0.9)
    return out.groupBy("image", "label").agg(F.count(F.lit(1)).alias("pixels"))


@query("snapped_partition")
def snapped_partition(spark, sf):
    px = pixels(spark, sf).withColumns({"label": F.when(F.col("c") < 60, F.col("stripe")).otherwise(0), "pixel": F.col("r") * 64 + F.col("c")})
    out = partition.snap_partition(px.select("image", "r", "c", "label", "pixel", "evidence", "line"), "pixel", "evidence", "evidence", "line", (0.35, 0.5, 0.25), 2)
    return out.groupBy("image", "label").agg(F.count(F.lit(1)).alias("pixels"))


# Candidates, scores, gates.
VARIANTS = ("label", "stripe", "mixed")


def _variants(spark, sf):
    px = pixels(spark, sf).withColumn("mixed", F.col("label") * 10 + F.col("stripe"))
    return px.select("image", "r", "c", "v", "evidence", F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(i).alias("position"), F.col(n).alias("label")) for i, n in enumerate(VARIANTS)])).alias("k")).select("image", "r", "c", "v", "evidence", "k.candidate", "k.position", "k.label")


def _candidate_fits(px):
    fit = fits.ols(px.where("label > 0"), ["image", "candidate", "label"], "c", "r", "v")
    return fits.median_residuals(px, fit, ["image", "candidate", "label"], "c", "r", "v")


def _scores(spark, sf):
    px = _variants(spark, sf)
    made = scores.candidate_metrics(px, _candidate_fits(px), "evidence", scores.least_region(F.col("roof"), 0.9))
    return made.join(px.select("image", "candidate", "position").distinct(), ["image", "candidate"])


SCORES = """, k AS (SELECT image, 'label' AS candidate, 0 AS position, label, r, c, v, evidence FROM px UNION ALL SELECT image, 'stripe', 1, stripe, r, c, v, evidence FROM px UNION ALL SELECT image, 'mixed', 2, label * 10 + stripe, r, c, v, evidence FROM px),
  per AS (SELECT image, candidate, position, label, count(*) AS n, regr_count(v, c) AS samples, avg(c) AS mx, avg(r) AS my, avg(v) AS mz, var_pop(c) AS vx, var_pop(r) AS vy, covar_pop(c, r) AS cxy, covar_pop(c, v) AS cxz, covar_pop(r, v) AS cyz FROM k GROUP BY image, candidate, position, label),
  solved AS (SELECT *, CASE WHEN vx * vy - cxy * cxy > 1e-12 THEN (cxz * vy - cyz * cxy) / (vx * vy - cxy * cxy) END AS sx, CASE WHEN vx * vy - cxy * cxy > 1e-12 THEN (cyz * vx - cxz * cxy) / (vx * vy - cxy * cxy) END AS sy FROM per),
  err AS (SELECT s.candidate, s.label, sqrt(avg((v - mz - sx * (c - mx) - sy * (r - my)) ** 2)) AS rmse, median(abs(v - mz - sx * (c - mx) - sy * (r - my))) AS med FROM k JOIN solved s ON s.candidate = k.candidate AND s.label = k.label GROUP BY s.candidate, s.label),
  edge AS (SELECT p.candidate, p.r, p.c, q.r AS r2, q.c AS c2 FROM k p JOIN k q ON p.candidate = q.candidate AND ((q.r = p.r AND q.c = p.c + 1) OR (q.c = p.c AND q.r = p.r + 1)) AND p.label <> q.label),
  lit AS (SELECT candidate, r, c FROM edge UNION SELECT candidate, r2, c2 FROM edge),
  sup AS (SELECT lit.candidate, avg(evidence) AS support FROM lit JOIN px USING (r, c) GROUP BY lit.candidate),
  roof AS (SELECT candidate, sum(n) AS roof, greatest(20, round_even(sum(n) * 0.9 / 100.0, 0)) AS least FROM per GROUP BY candidate),
  m AS (SELECT s.image, s.candidate, s.position, count(*) AS planes, sum(n) / any_value(roof) AS coverage, sum(n) FILTER (WHERE rmse IS NOT NULL) / any_value(roof) AS fitted_coverage, coalesce(sum(n) FILTER (WHERE n < least), 0) / any_value(roof) AS small,
    sum(samples * rmse) / sum(samples) AS rmse, sum(samples * med) / sum(samples) AS median_abs FROM solved s JOIN err ON err.candidate = s.candidate AND err.label = s.label JOIN roof ON roof.candidate = s.candidate GROUP BY s.image, s.candidate, s.position),
  scored AS (SELECT m.*, coalesce(support, 0) AS support, 0.28 * exp(-rmse / 0.45) + 0.25 * exp(-median_abs / 0.25) + 0.20 * coalesce(support, 0) + 0.12 * coverage + 0.10 * fitted_coverage
    + 0.05 * least(greatest(1 - greatest(planes - 30, 0) / 45.0, 0), 1) - 0.15 * small AS score FROM m LEFT JOIN sup USING (candidate))"""


@query("candidate_score", f"{SCORES} SELECT image, candidate, planes, round(coverage, 6) AS coverage, round(fitted_coverage, 6) AS fitted_coverage, round(support, 6) AS support, round(small, 6) AS small, round(rmse, 6) AS rmse, round(median_abs, 6) AS median_abs, round(score, 6) AS score FROM scored")
def candidate_score(spark, sf):
    return _scores(spark, sf).select("image", "candidate", "planes", *[F.round(k, 6).alias(k) for k in ("coverage", "fitted_coverage", "support", "small", "rmse", "median_abs", "score")])


@query("composite_score", f"{SCORES} SELECT image, candidate, round(score + 0.04 * support + 0.03 * least(greatest((64 - planes) / greatest(64 - 2 * 4, 1), 0), 1) + 0.03 * least(greatest(1 - 20 * small / 16, 0), 1), 6) AS composite FROM scored")
def composite_score(spark, sf):
    # A candidate's planes stand for the vertices left of 64 in four paths, its small share for a drift of up to 20 pixels.
    simplicity, drift = scores.path_scores(F.col("planes"), F.lit(64), F.lit(4), 20 * F.col("small"))
    return _scores(spark, sf).select("image", "candidate", F.round(scores.composite(F.col("score"), F.col("support"), simplicity, drift), 6).alias("composite"))


@query("hypothesis_score", """WITH h AS (SELECT l_orderkey, count(*) AS planes, count(*) FILTER (WHERE l_returnflag = 'R') AS missing, count(*) FILTER (WHERE l_linestatus = 'O') AS unexpected, avg(l_discount) * 10 AS support, least(avg(l_tax) * 12, 1) AS coverage,
    avg(l_discount * 10 * greatest(0, 1 - 5 * l_tax)) AS planar, count(DISTINCT l_returnflag) AS modes FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, round(0.22 * coverage + 0.22 * (1 - missing / greatest(planes, 1)) + 0.24 * support + 0.32 * planar - 0.025 * unexpected - 0.05 * (planes - modes) - 0.04 * greatest(0, planes - 22) / 22, 6) + 0.0 AS score FROM h""")
def hypothesis_score(spark, sf):
    li = table(spark, sf, "lineitem")
    h = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("planes"), F.count_if(F.col("l_returnflag") == "R").alias("missing"), F.count_if(F.col("l_linestatus") == "O").alias("unexpected"), (F.avg("l_discount") * 10).alias("support"),
        F.least(F.avg("l_tax") * 12, F.lit(1.0)).alias("coverage"), F.avg(scores.planarity(F.col("l_discount") * 10, F.col("l_tax"))).alias("planar"), F.count_distinct("l_returnflag").alias("modes"),
    )
    c = F.col
    made = scores.hypothesis_score(c("coverage"), c("planes"), c("missing"), c("unexpected"), c("support"), c("planar"), c("planes") - c("modes"), c("planes"))
    return h.select("l_orderkey", S.fixed(made).alias("score"))


@query("select_winner", f"{SCORES} SELECT image, candidate, planes FROM scored QUALIFY row_number() OVER (PARTITION BY image ORDER BY round(score, 9) DESC, position) = 1")
def select_winner(spark, sf):
    return D.winner(_scores(spark, sf).withColumn("score", F.round("score", 9)), ["image"], "score", "position").select("image", "candidate", "planes")


def _gain_sql(keys: str, name: str) -> str:
    return f"""{name} AS (SELECT {keys}, n, CASE WHEN vx * vy - cxy * cxy > 1e-12 THEN sqrt(greatest(vz - ((cxz * vy - cyz * cxy) * cxz + (cyz * vx - cxz * cxy) * cyz) / (vx * vy - cxy * cxy), 0)) END AS rmse
    FROM (SELECT {keys}, count(*) AS n, var_pop(c) AS vx, var_pop(r) AS vy, var_pop(v) AS vz, covar_pop(c, r) AS cxy, covar_pop(c, v) AS cxz, covar_pop(r, v) AS cyz FROM px GROUP BY {keys}))"""


@query("enrichment_gate", f""", {_gain_sql("label", "whole")}, {_gain_sql("label, stripe", "part")},
  inner_edge AS (SELECT label, r, c FROM pairs WHERE label = l2 AND stripe <> stripe2 UNION SELECT label, r2, c2 FROM pairs WHERE label = l2 AND stripe <> stripe2),
  sup AS (SELECT e.label, avg(evidence) AS support FROM inner_edge e JOIN px USING (r, c) GROUP BY e.label),
  g AS (SELECT label, count(*) AS parts, count(rmse) AS fitted, sum(n * rmse) / sum(n) FILTER (WHERE rmse IS NOT NULL) AS split FROM part GROUP BY label)
  SELECT 'e' AS image, g.label, parts, round(whole.rmse - split, 6) + 0.0 AS improvement, parts BETWEEN 2 AND 6 AND fitted = parts AND coalesce(support, 0) >= 0.05 AND (whole.rmse - split >= 0.018 OR (whole.rmse - split) / greatest(whole.rmse, 1e-8) >= 0.07) AS accepted
  FROM g JOIN whole USING (label) LEFT JOIN sup USING (label)""")
def enrichment_gate(spark, sf):
    px = pixels(spark, sf)
    whole = fits.ols(px, ["image", "label"], "c", "r", "v").select("image", "label", F.col("rmse").alias("single_rmse"))
    parts = fits.ols(px, ["image", "label", "stripe"], "c", "r", "v").where("rmse is not null")
    split = fits.aggregate_fits(parts, ["image", "label"], "samples", ["rmse"]).select("image", "label", F.col("fits").alias("fitted_parts"), F.col("rmse").alias("split_rmse"))
    count = px.groupBy("image", "label").agg(F.count_distinct("stripe").alias("parts"))
    inside = px.select(F.struct("image", "label").alias("image"), "r", "c", F.col("stripe").alias("label"), "evidence")
    on = raster.internal_boundary(inside).join(inside.select("image", "r", "c", "evidence"), ["image", "r", "c"]).groupBy("image.image", "image.label").agg(F.avg("evidence").alias("support"))
    both = count.join(whole, ["image", "label"]).join(split, ["image", "label"], "left").join(on, ["image", "label"], "left")
    return scores.enrichment(both, least_support=0.05).select("image", "label", "parts", S.fixed(F.col("improvement")).alias("improvement"), "accepted")


@query("acceptance_gate", f"""{SCORES}, cx AS (SELECT candidate, count(*) AS complexity FROM edge GROUP BY candidate), ls AS (SELECT candidate, list(DISTINCT label) AS labels FROM k GROUP BY candidate),
  reg AS (SELECT count(*) FILTER (WHERE v > -0.2 AND c < 60) / count(*) FILTER (WHERE v > -0.2 OR c < 60) >= 0.42 AS ok FROM px),
  r AS (SELECT s.candidate, reg.ok AS registered, s.rmse <= b.rmse + 1e-6 AS residual_improved, list_has_all(ls.labels, bl.labels) AS labels_preserved, cx.complexity / greatest(bc.complexity, 1) <= 1.08 AS complexity_accepted
    FROM scored s CROSS JOIN reg JOIN scored b ON b.candidate = 'label' JOIN ls ON ls.candidate = s.candidate JOIN ls bl ON bl.candidate = 'label' JOIN cx ON cx.candidate = s.candidate JOIN cx bc ON bc.candidate = 'label')
  SELECT candidate, residual_improved, labels_preserved, complexity_accepted, registered AND residual_improved AND labels_preserved AND complexity_accepted AS accepted FROM r""")
def acceptance_gate(spark, sf):
    px = _variants(spark, sf)
    fitted = fits.aggregate_fits(_candidate_fits(px).where("rmse is not null"), ["candidate"], "samples", ["rmse"]).select("candidate", F.col("rmse").alias("refined_rmse"))
    labels = px.groupBy("candidate").agg(F.collect_set("label").alias("refined_labels"))
    complexity = raster.boundary_complexity(px.withColumn("image", F.col("candidate"))).select(F.col("image").alias("candidate"), F.col("complexity").alias("refined_complexity"))
    each = fitted.join(labels, "candidate").join(complexity, "candidate")
    base = each.where("candidate = 'label'").select(*[F.col(f"refined_{k}").alias(f"baseline_{k}") for k in ("rmse", "labels", "complexity")])
    iou = raster.mask_scores(pixels(spark, sf), F.col("v") > -0.2, F.col("c") < 60).select((F.col("iou") >= 0.42).alias("registered"))
    made = scores.refinement_gate(each.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(iou)))  # one row each
    return made.select("candidate", "residual_improved", "labels_preserved", "complexity_accepted", "accepted")


@query("mask_quality", """, q AS (SELECT image, max(c) + 1 AS w, max(r) + 1 AS h, count(*) FILTER (WHERE v > 0.15) AS area, count(*) AS n, count(*) FILTER (WHERE v > 0.15 AND (c = 0 OR r = 0)) AS edge_contacts,
    max(c) FILTER (WHERE v > 0.15) - min(c) FILTER (WHERE v > 0.15) + 1 AS bw, max(r) FILTER (WHERE v > 0.15) - min(r) FILTER (WHERE v > 0.15) + 1 AS bh, avg(c) FILTER (WHERE v > 0.15) AS mx, avg(r) FILTER (WHERE v > 0.15) AS my FROM px GROUP BY image)
  SELECT image, area, round(area / n, 6) AS share, edge_contacts, concat_ws(',', CASE WHEN area = 0 THEN 'empty' END, CASE WHEN area > 0 AND area / n < 0.05 THEN 'too_small' END, CASE WHEN area / n > 0.85 THEN 'too_large' END,
    CASE WHEN least(bw / w, bh / h) < 0.12 THEN 'too_thin' END, CASE WHEN abs(mx / w - 0.5) > 0.3 OR abs(my / h - 0.5) > 0.4 THEN 'off_centre' END) AS reasons FROM q""")
def mask_quality(spark, sf):
    return D.mask_quality(pixels(spark, sf), F.col("v") > 0.15)


@query("select_prediction", """WITH d AS (SELECT user_id AS image, event_id AS idx, value AS score, event_type = 'purchase' AS covers, value > 50 AS holds FROM events)
  SELECT image, idx, round(score, 6) AS score, CASE WHEN covers THEN 0 WHEN holds THEN 1 ELSE 2 END AS tier FROM d
  QUALIFY row_number() OVER (PARTITION BY image ORDER BY CASE WHEN covers THEN 0 WHEN holds THEN 1 ELSE 2 END, score DESC NULLS LAST, idx) = 1""")
def select_prediction(spark, sf):
    found = table(spark, sf, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("idx"), F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("covers_centre"), (F.col("value") > 50).alias("box_holds_centre"))
    return D.select_prediction(found, ["image"]).select("image", "idx", F.round("score", 6).alias("score"), "tier")


# Topology documents and plans.
@query("topology_validation", """, e AS (SELECT DISTINCT image, least(stripe, label + 1) AS a, greatest(stripe, label + 1) AS b FROM px WHERE stripe <> label + 1 AND c % 16 < 8), g AS (SELECT DISTINCT image, a, b FROM diff)
  SELECT *, 'missing' AS state FROM (SELECT * FROM e EXCEPT SELECT * FROM g) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM g EXCEPT SELECT * FROM e)""")
def topology_validation(spark, sf):
    px = pixels(spark, sf)
    expected = px.withColumn("other", F.col("label") + 1).where("stripe <> other and c % 16 < 8").select("image", F.least("stripe", "other").alias("a"), F.greatest("stripe", "other").alias("b")).distinct()
    return D.topology_validation(expected, raster.adjacency(px))


@query("plan_apply", """WITH l AS (SELECT DISTINCT p_size AS label FROM part), c(k, plane_id, pos, label) AS (VALUES (0, 'A', 0, 1), (0, 'A', 1, 2), (0, 'A', 2, 99), (1, 'B', 0, 2), (1, 'B', 1, 3), (1, 'B', 2, 7)),
  s(label) AS (VALUES (7), (98)), ruled AS (SELECT c.label, c.plane_id, CASE WHEN l.label IS NULL THEN 'rejected_unknown' WHEN s.label IS NOT NULL THEN 'rejected_split' WHEN row_number() OVER (PARTITION BY c.label ORDER BY k, pos) > 1 THEN 'rejected_used' ELSE 'merged' END AS action
    FROM c LEFT JOIN l ON l.label = c.label LEFT JOIN s ON s.label = c.label)
  SELECT 'e' AS image, label, action, plane_id FROM ruled UNION ALL SELECT 'e', s.label, 'split', NULL FROM s JOIN l ON l.label = s.label
  UNION ALL SELECT 'e', label, 'preserved', NULL FROM l WHERE label NOT IN (SELECT label FROM ruled WHERE action = 'merged') AND label NOT IN (SELECT label FROM s)""")
def plan_apply(spark, sf):
    labels = table(spark, sf, "part").select(F.lit("e").alias("image"), F.col("p_size").alias("label")).distinct()
    said = '{"analysis_summary":"", "roof_planes":[{"plane_id":"A","candidate_ids":[1,2,99],"confidence":0.9,"reason":""},{"plane_id":"B","candidate_ids":[2,3,7],"confidence":0.8,"reason":""}],"split_requests":[{"candidate_id":7,"boundary_type":"ridge","line":{"x1":0,"y1":0,"x2":1,"y2":1},"confidence":0.5,"reason":""},{"candidate_id":98,"boundary_type":"hip","line":{"x1":0,"y1":0,"x2":1,"y2":1},"confidence":0.5,"reason":""}],"uncertain_candidate_ids":[]}'
    plan = D.parse(spark.range(1).select(F.lit("e").alias("image"), F.lit(said).alias("said")), "said", D.PLAN, "plan")
    return D.apply_plan(labels, plan)


@query("latest_run", """WITH f AS (SELECT o_orderpriority AS experiment, o_custkey AS run, o_orderstatus AS file, o_orderdate AS modified FROM orders), g AS (SELECT experiment, run, max(modified) AS modified, count(DISTINCT file) FILTER (WHERE file IN ('F', 'O')) AS have FROM f GROUP BY ALL)
  SELECT experiment, run, strftime(modified, '%Y-%m-%d') AS modified FROM g WHERE have = 2 QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY g.modified DESC, run DESC) = 1""")
def latest_run(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("experiment"), F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("file"), F.col("o_orderdate").alias("modified"))
    return D.latest_run(f, ["F", "O"]).select("experiment", "run", F.date_format("modified", "yyyy-MM-dd").alias("modified"))


@query("affine_world", "SELECT image, label, round(avg(0.5 * c + 0.1 * r + 100), 6) AS x, round(avg(-0.5 * r + 200), 6) AS y FROM px GROUP BY image, label")
def affine_world(spark, sf):
    x, y = S.affine(F.col("c"), F.col("r"), AFFINE)
    return pixels(spark, sf).groupBy("image", "label").agg(F.round(F.avg(x), 6).alias("x"), F.round(F.avg(y), 6).alias("y"))


@query("geojson_bbox", """, b AS (SELECT label, min(c) AS x0, min(r) AS y0, max(c) + 1 AS x1, max(r) + 1 AS y1 FROM px WHERE evidence > 0.3 GROUP BY label)
  SELECT label, '{"type":"Feature","properties":{"label":' || label || '},"geometry":{"type":"Polygon","coordinates":[[[' || x0 || '.0,' || y0 || '.0],[' || x1 || '.0,' || y0 || '.0],[' || x1 || '.0,' || y1 || '.0],[' || x0 || '.0,' || y1 || '.0],[' || x0 || '.0,' || y0 || '.0]]]}}' AS geojson FROM b""")
def geojson_bbox(spark, sf):
    b = pixels(spark, sf).where("evidence > 0.3").groupBy("label").agg(F.min("c").alias("x0"), F.min("r").alias("y0"), (F.max("c") + 1).alias("x1"), (F.max("r") + 1).alias("y1"))
    return D.box_geojson(b, "label").select("label", "geojson")


@query("mask_center", "SELECT image, round(avg(c), 6) AS x, round(avg(r), 6) AS y FROM px WHERE v > 0.1 GROUP BY image")
def mask_center(spark, sf):
    return raster.mask_center(pixels(spark, sf), F.col("v") > 0.1).select("image", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("label_matching", """, o AS (SELECT label, stripe, count(*) AS n FROM px GROUP BY ALL), a AS (SELECT label, count(*) AS n1 FROM px GROUP BY label), b AS (SELECT stripe, count(*) AS n2 FROM px GROUP BY stripe),
  m AS (SELECT label, stripe, coalesce(n, 0) / (n1 + n2 - coalesce(n, 0)) AS iou FROM a CROSS JOIN b LEFT JOIN o USING (label, stripe)),
  t AS (SELECT p.iou + q.iou + s.iou + u.iou AS total FROM m p JOIN m q ON q.label = 2 AND q.stripe <> p.stripe JOIN m s ON s.label = 3 AND s.stripe NOT IN (p.stripe, q.stripe) JOIN m u ON u.label = 4 AND u.stripe NOT IN (p.stripe, q.stripe, s.stripe) WHERE p.label = 1)
  SELECT 'e' AS image, 4 AS pairs, round(max(total) / 4, 6) AS matched_mean_iou FROM t""")
def label_matching(spark, sf):
    px = pixels(spark, sf)
    pairs = graph.matched_labels(raster.label_iou(px, "label", "stripe"), px, "label", "stripe")
    return pairs.groupBy("image").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("iou"), 6).alias("matched_mean_iou"))


@query("contour_features")
def contour_features(spark, sf):
    px = pixels(spark, sf)
    return outlines.pixel_features(px, raster.summary(px))


@query("world_features")
def world_features(spark, sf):
    return outlines.world_features(pixels(spark, sf), AFFINE, _fits(spark, sf).select("image", "label", "samples", F.round("rmse", 8).alias("rmse")))


# Components.
TILE = 10


@query("connected_components", f""", m AS (SELECT r // {TILE} AS image, r, c, r * 64 + c AS id FROM px WHERE v > 0.16),
  e AS (SELECT a.id AS x, b.id AS y FROM m a JOIN m b ON a.image = b.image AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
  closure AS (WITH RECURSIVE t(x, y) AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x) SELECT x, min(y) AS root FROM t GROUP BY x)
  SELECT m.image, count(DISTINCT root) AS components, count(*) AS pixels FROM m JOIN closure ON closure.x = m.id GROUP BY m.image""")
def connected_components(spark, sf):
    px = pixels(spark, sf).withColumn("image", F.floor(F.col("r") / TILE))
    return graph.label_components(px.withColumn("on", F.col("v") > 0.16), "on").groupBy("image").agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("pixels"))


@query("raster_components")
def raster_components(spark, sf):
    """``connected_components`` without its strips: the whole raster is one image."""
    px = pixels(spark, sf).withColumns({"on": F.col("v") > 0.16, "pixel": F.col("r") * 64 + F.col("c")})
    return graph.raster_components(px, "on", "pixel").groupBy("image").agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("pixels"))


@query("small_region_merge")
def small_region_merge(spark, sf):
    px = pixels(spark, sf).withColumns({"on": F.col("v") > 0, "pixel": F.col("r") * 64 + F.col("c")})
    parts = graph.raster_components(px, "on", "pixel", diagonal=False).withColumn("label", F.col("component") + 1)
    return graph.merge_small_regions(parts, 4).groupBy("image").agg(F.max("label").alias("regions"), F.count(F.lit(1)).alias("pixels"))


@query("junction_clusters", """WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 20.0 AS y FROM customer), e AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9.0),
  t AS (WITH RECURSIVE t(x, y) AS (SELECT x, y FROM e UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x) SELECT x, min(y) AS root FROM t GROUP BY x)
  SELECT t.root, count(*) AS n, round(avg(p.x), 6) + 0.0 AS x, round(avg(p.y), 6) AS y FROM t JOIN p ON p.id = t.x GROUP BY t.root""")
def junction_clusters(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 20.0).alias("y"))
    return graph.cluster_points(p, 3.0).groupBy("root").agg(F.count(F.lit(1)).alias("n"), S.fixed(F.avg("x")).alias("x"), F.round(F.avg("y"), 6).alias("y"))


# Lines and paths.
@query("line_projection", """, l AS (SELECT a.r, a.v AS x1, b.v AS y1, c.v AS x2, d.v AS y2, e.v AS px_, f.v AS py FROM px a JOIN px b ON b.r = a.r AND b.c = 1 JOIN px c ON c.r = a.r AND c.c = 2 JOIN px d ON d.r = a.r AND d.c = 3 JOIN px e ON e.r = a.r AND e.c = 4 JOIN px f ON f.r = a.r AND f.c = 5 WHERE a.c = 0),
  k AS (SELECT *, ((px_ - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS t FROM l)
  SELECT r, round(x1 + t * (x2 - x1), 6) + 0.0 AS x, round(y1 + t * (y2 - y1), 6) + 0.0 AS y FROM k""")
def line_projection(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("r"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2", "px", "py"))])
    x, y = vector.project(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return e.select("r", S.fixed(x).alias("x"), S.fixed(y).alias("y"))


@query("simplified_paths")
def simplified_paths(spark, sf):
    path = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v, i: F.struct(i.cast("double").alias("x"), (v * 100).cast("double").alias("y"))).alias("points"))
    return vector.simplify_paths(path, 10.0).select("id", F.size("points").alias("vertices"))


@query("target_component")
def target_component(spark, sf):
    px = pixels(spark, sf).withColumns({"on": F.col("v") > 0.05, "pixel": F.col("r") * 64 + F.col("c")})
    return graph.target_component(px, "on", "pixel", 20.0, 30.0, least=2).groupBy("image", "component").agg(F.count(F.lit(1)).alias("pixels"))


@query("optimised_paths")
def optimised_paths(spark, sf):
    """Each row's values as a path across the raster, aligned with a line along the row."""
    px = pixels(spark, sf)
    corners = px.where("c % 8 = 0").select("image", F.col("r").alias("id"), F.col("c").alias("pos"), F.col("c").cast("double").alias("x"), (F.col("r") + 4 * F.col("v")).alias("y"))
    lines = px.where("c = 0 and r % 40 = 0").select("image", F.col("r").alias("line_id"), F.lit(0.0).alias("lx1"), F.col("r").cast("double").alias("ly1"), F.lit(63.0).alias("lx2"), F.col("r").cast("double").alias("ly2"))
    return paths.optimise(corners, lines, px, "evidence", F.col("v") > 0.3, 8.0, 6.0, 0.5, 0.6)[0].groupBy("image", "id").agg(F.count(F.lit(1)).alias("corners"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query("watershed_partition")
def watershed_partition(spark, sf):
    px = pixels(spark, sf)
    px = px.withColumn("marker", F.when((F.col("r") % 25 == 12) & (F.col("c") % 16 == 8), F.floor(F.col("c") / 16) + 1 + 4 * F.floor(F.col("r") / 25)).otherwise(0))
    return vector.watershed(px, "evidence", "marker").groupBy("image", "label").agg(F.count(F.lit(1)).alias("pixels"))


@query("routed_boundaries")
def routed_boundaries(spark, sf):
    px = pixels(spark, sf)
    long = F.lit(2).cast("long"), F.lit(60).cast("long")
    ends = px.groupBy("image").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).select("image", F.lit(0).cast("long").alias("route"), "r0", long[0].alias("c0"), "r1", long[1].alias("c1"))
    short = px.where("c = 0 and r % 100 = 0 and r + 40 <= 100 * floor(r / 100) + 99").select("image", (F.col("r") / 100 + 1).cast("long").alias("route"), F.col("r").alias("r0"), long[0].alias("c0"), (F.col("r") + 40).alias("r1"), long[1].alias("c1"))
    return vector.route(px, "evidence", ends.unionByName(short)).groupBy("image", "route").agg(F.count(F.lit(1)).alias("steps"))


@query("intersection_regions")
def intersection_regions(spark, sf):
    px = pixels(spark, sf).withColumn("pixel", F.col("r") * 64 + F.col("c"))
    return graph.intersection_partition(px, "label", "stripe", "pixel").groupBy("image", "label", "stripe").agg(F.count_distinct("region").alias("regions"), F.count(F.lit(1)).alias("pixels"))


# Meshes.
def _mesh(spark, sf):
    px = pixels(spark, sf)
    vertices = px.select(F.lit("m").alias("mesh"), (F.col("r") * 64 + F.col("c")).alias("vid"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), F.col("v").alias("z"))
    cells = px.crossJoin(F.broadcast(px.agg(F.max("r").alias("last")))).where((F.col("c") < 63) & (F.col("r") < F.col("last")))
    a = F.col("r") * 64 + F.col("c")
    two = F.array(F.struct((a * 2).alias("fid"), a.alias("a"), (a + 1).alias("b"), (a + 64).alias("c")), F.struct((a * 2 + 1).alias("fid"), (a + 65).alias("a"), (a + 64).alias("b"), (a + 1).alias("c")))
    faces = cells.select(F.explode(two).alias("f")).select(F.lit("m").alias("mesh"), "f.fid", "f.a", "f.b", "f.c")
    return faces, vertices


MESH = """, tri AS (SELECT (r * 64 + c) * 2 AS fid, r * 64 + c AS a, r * 64 + c + 1 AS b, r * 64 + c + 64 AS c FROM px WHERE c < 63 AND r < (SELECT max(r) FROM px)
    UNION ALL SELECT (r * 64 + c) * 2 + 1, r * 64 + c + 65, r * 64 + c + 64, r * 64 + c + 1 FROM px WHERE c < 63 AND r < (SELECT max(r) FROM px)),
  vert AS (SELECT r * 64 + c AS vid, c::DOUBLE AS x, r::DOUBLE AS y, v AS z FROM px),
  raw AS (SELECT t.*, (p.x + q.x + s.x) / 3 AS cx, (p.y + q.y + s.y) / 3 AS cy, (p.z + q.z + s.z) / 3 AS cz,
    (q.y - p.y) * (s.z - p.z) - (q.z - p.z) * (s.y - p.y) AS ux, (q.z - p.z) * (s.x - p.x) - (q.x - p.x) * (s.z - p.z) AS uy, (q.x - p.x) * (s.y - p.y) - (q.y - p.y) * (s.x - p.x) AS uz
    FROM tri t JOIN vert p ON p.vid = t.a JOIN vert q ON q.vid = t.b JOIN vert s ON s.vid = t.c),
  geo AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) / 2 AS area, ux / sqrt(ux * ux + uy * uy + uz * uz) AS nx, uy / sqrt(ux * ux + uy * uy + uz * uz) AS ny, uz / sqrt(ux * ux + uy * uy + uz * uz) AS nz FROM raw),
  cand AS (SELECT * FROM geo WHERE nz >= cos(radians(12.0)))"""


def _geometry(spark, sf):
    faces, vertices = _mesh(spark, sf)
    return mesh.face_geometry(faces, vertices)


def _candidates(spark, sf):
    return mesh.roof_candidates(_geometry(spark, sf), "+Z", 12.0)


@query("face_normals", f"{MESH} SELECT fid, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) AS nz, round(area, 6) AS area FROM geo")
def face_normals(spark, sf):
    return _geometry(spark, sf).select("fid", S.fixed(F.col("nx")).alias("nx"), S.fixed(F.col("ny")).alias("ny"), F.round("nz", 6).alias("nz"), F.round("area", 6).alias("area"))


@query("roof_candidates", f"{MESH} SELECT count(*) AS faces, round(sum(area), 4) AS area FROM cand")
def roof_candidates(spark, sf):
    return _candidates(spark, sf).agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("area"), 4).alias("area"))


GROUPED = f"""{MESH}, side AS (SELECT fid, unnest([least(a, b), least(b, c), least(c, a)]) AS u, unnest([greatest(a, b), greatest(b, c), greatest(c, a)]) AS w FROM cand),
  near AS (SELECT x.fid AS f, y.fid AS g FROM side x JOIN side y ON x.u = y.u AND x.w = y.w AND x.fid <> y.fid JOIN cand p ON p.fid = x.fid JOIN cand q ON q.fid = y.fid WHERE p.nx * q.nx + p.ny * q.ny + p.nz * q.nz >= cos(radians(1.0))),
  roots AS (WITH RECURSIVE t(f, g) AS (SELECT f, g FROM near UNION SELECT t.f, near.g FROM t JOIN near ON t.g = near.f) SELECT f, least(f, min(g)) AS root FROM t GROUP BY f),
  grouped AS (SELECT cand.*, coalesce(root, fid) AS grp FROM cand LEFT JOIN roots ON roots.f = cand.fid)"""


def _grouped(spark, sf):
    return mesh.group_faces(_candidates(spark, sf), 1.0)


@query("face_grouping", f'{GROUPED} SELECT grp AS "group", count(*) AS faces FROM grouped GROUP BY grp')
def face_grouping(spark, sf):
    return _grouped(spark, sf).groupBy("group").agg(F.count(F.lit(1)).alias("faces"))


PLANES = f"""{GROUPED}, sums AS (SELECT grp, count(*) AS faces, sum(area) AS area, sum(area * cx) / sum(area) AS cx, sum(area * cy) / sum(area) AS cy, sum(area * cz) / sum(area) AS cz, sum(area * nx) AS sx, sum(area * ny) AS sy, sum(area * nz) AS sz FROM grouped GROUP BY grp),
  plane AS (SELECT *, sx / sqrt(sx * sx + sy * sy + sz * sz) AS nx, sy / sqrt(sx * sx + sy * sy + sz * sz) AS ny, sz / sqrt(sx * sx + sy * sy + sz * sz) AS nz FROM sums),
  used AS (SELECT DISTINCT grp, unnest([a, b, c]) AS vid FROM grouped),
  res AS (SELECT used.grp, used.vid, abs((x - cx) * nx + (y - cy) * ny + (z - cz) * nz) AS d, sqrt(greatest((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2 - ((x - cx) * nx + (y - cy) * ny + (z - cz) * nz) ** 2, 0)) AS along FROM used JOIN vert USING (vid) JOIN plane ON plane.grp = used.grp),
  fitted AS (SELECT plane.*, r.vertices, r.rms, r.worst, r.p95, r.reach FROM plane JOIN (SELECT grp, count(*) AS vertices, sqrt(avg(d * d)) AS rms, max(d) AS worst, quantile_cont(d, 0.95) AS p95, max(along) AS reach FROM res GROUP BY grp) r ON r.grp = plane.grp)"""


def _planes(spark, sf):
    return mesh.fit_planes(_grouped(spark, sf), _mesh(spark, sf)[1], "+Z")


@query("mesh_plane_fit", f'{PLANES} SELECT grp AS "group", faces, vertices, round(area, 6) AS area, round(nz, 6) AS nz, round(rms, 5) + 0.0 AS rms, round(worst, 5) + 0.0 AS worst, round(p95, 5) + 0.0 AS p95 FROM fitted')
def mesh_plane_fit(spark, sf):
    return _planes(spark, sf).select("group", "faces", "vertices", F.round("area", 6).alias("area"), F.round("nz", 6).alias("nz"), *[S.fixed(F.col(k), 5).alias(k) for k in ("rms", "worst", "p95")])


@query("rejection_counts", f"{PLANES} SELECT CASE WHEN faces < 2 THEN 'min_faces' WHEN area < 1.2 THEN 'min_area' WHEN rms > 0.0005 THEN 'max_rms' ELSE 'accepted' END AS reason, count(*) AS planes FROM fitted GROUP BY 1")
def rejection_counts(spark, sf):
    return _planes(spark, sf).groupBy(mesh.gates(2, 1.2, 0.0005).alias("reason")).agg(F.count(F.lit(1)).alias("planes"))


@query("numbered_planes", f"""{PLANES} SELECT grp AS "group", 'roof_plane_' || lpad(CAST(row_number() OVER (ORDER BY round(area, 9) DESC, grp) AS VARCHAR), 3, '0') AS plane_id FROM fitted""")
def numbered_planes(spark, sf):
    return mesh.numbered(_planes(spark, sf).withColumn("area", F.round("area", 9))).select("group", "plane_id")


@query("boundary_vertices", f"""{GROUPED}, s2 AS (SELECT grp, unnest([least(a, b), least(b, c), least(c, a)]) AS u, unnest([greatest(a, b), greatest(b, c), greatest(c, a)]) AS w FROM grouped), once AS (SELECT grp, u, w FROM s2 GROUP BY ALL HAVING count(*) = 1),
  b AS (SELECT DISTINCT grp, unnest([u, w]) AS vid FROM once) SELECT grp AS "group", count(*) AS vertices FROM b GROUP BY grp""")
def boundary_vertices(spark, sf):
    return mesh.boundary_vertices(_grouped(spark, sf)).groupBy("group").agg(F.count(F.lit(1)).alias("vertices"))


@query("coplanar_pairs", f"""{PLANES} SELECT a.grp AS a, b.grp AS b FROM fitted a JOIN fitted b ON a.grp < b.grp AND abs(a.cx - b.cx) <= 30 AND abs(a.cy - b.cy) <= 30 WHERE a.nx * b.nx + a.ny * b.ny + a.nz * b.nz >= cos(radians(3.0))
    AND least(abs((b.cx - a.cx) * a.nx + (b.cy - a.cy) * a.ny + (b.cz - a.cz) * a.nz), abs((b.cx - a.cx) * b.nx + (b.cy - a.cy) * b.ny + (b.cz - a.cz) * b.nz)) <= 0.05
    AND sqrt(greatest((b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2 + (b.cz - a.cz) ** 2 - ((b.cx - a.cx) * a.nx + (b.cy - a.cy) * a.ny + (b.cz - a.cz) * a.nz) ** 2, 0)) <= a.reach + b.reach + 0.5""")
def coplanar_pairs(spark, sf):
    return mesh.coplanar_pairs(_planes(spark, sf), 3.0, 0.05, 0.5).select("a", "b")


@query("merge_modes", f"""{PLANES}, s3 AS (SELECT grp, unnest([least(a, b), least(b, c), least(c, a)]) AS u, unnest([greatest(a, b), greatest(b, c), greatest(c, a)]) AS w FROM grouped), open_edge AS (SELECT grp, u, w FROM s3 GROUP BY ALL HAVING count(*) = 1), rim AS (SELECT DISTINCT grp, unnest([u, w]) AS vid FROM open_edge),
  t AS (SELECT res.grp, avg((d <= 0.002)::INTEGER) AS inlier_ratio, count(*) FILTER (WHERE d > 0.002) AS outliers, count(*) FILTER (WHERE d > 0.002 AND rim.vid IS NOT NULL) AS rim_out, max(d) AS most, quantile_cont(d, 0.95) AS high FROM res LEFT JOIN rim ON rim.grp = res.grp AND rim.vid = res.vid GROUP BY res.grp)
  SELECT CASE WHEN most <= 0.002 THEN 'strict' WHEN high <= 0.002 AND inlier_ratio >= 0.95 AND most <= 0.1 AND (outliers = 0 OR rim_out / outliers >= 0.8) THEN 'robust' ELSE 'rejected' END AS mode, count(*) AS planes, CAST(sum(outliers) AS BIGINT) AS outliers, CAST(sum(rim_out) AS BIGINT) AS edge_outliers FROM t GROUP BY 1""")
def merge_modes(spark, sf):
    grouped, vertices = _grouped(spark, sf), _mesh(spark, sf)[1]
    planes = mesh.fit_planes(grouped, vertices, "+Z")
    out = mesh.robust_merge(planes, mesh.vertex_residuals(grouped, planes, vertices), mesh.boundary_vertices(grouped), 0.002)
    return out.groupBy("mode").agg(F.count(F.lit(1)).alias("planes"), F.sum("outliers").alias("outliers"), F.sum("edge_outliers").alias("edge_outliers"))


@query("scene_summary", f"{MESH} SELECT 'm' AS mesh, count(*) AS vertices, (SELECT count(*) FROM tri) AS triangles, min(x) AS least_x, min(y) AS least_y, min(z) AS least_z, max(x) AS most_x, max(y) AS most_y, max(z) AS most_z FROM vert")
def scene_summary(spark, sf):
    return mesh.scene_summary(*_mesh(spark, sf))


@query("used_vertices", f'{GROUPED} SELECT grp AS "group", count(DISTINCT vid) AS vertices FROM (SELECT grp, unnest([a, b, c]) AS vid FROM grouped) GROUP BY grp')
def used_vertices(spark, sf):
    return mesh.used_vertices(_grouped(spark, sf), ["group"])


@query("plane_basis", f"""{MESH}, h AS (SELECT fid, nx, ny, nz, CASE WHEN abs(nz) > 0.9 THEN 1.0 ELSE 0.0 END AS hx, CASE WHEN abs(nz) > 0.9 THEN 0.0 ELSE 1.0 END AS hz FROM geo), u AS (SELECT *, -hz * ny AS ux, hz * nx - hx * nz AS uy, hx * ny AS uz FROM h),
  n AS (SELECT *, ux / sqrt(ux * ux + uy * uy + uz * uz) AS a, uy / sqrt(ux * ux + uy * uy + uz * uz) AS b, uz / sqrt(ux * ux + uy * uy + uz * uz) AS d FROM u)
  SELECT fid, round(a, 6) + 0.0 AS ux, round(b, 6) + 0.0 AS uy, round(d, 6) + 0.0 AS uz, round(ny * d - nz * b, 6) + 0.0 AS vx, round(nz * a - nx * d, 6) + 0.0 AS vy, round(nx * b - ny * a, 6) + 0.0 AS vz FROM n""")
def plane_basis(spark, sf):
    u, v = mesh.plane_basis(F.col("nx"), F.col("ny"), F.col("nz"))
    return _geometry(spark, sf).select("fid", *[S.fixed(x).alias(f"{n}{k}") for n, xs in (("u", u), ("v", v)) for k, x in zip("xyz", xs)])


# Of groups that are one disc (as many rim vertices as rim edges, and V - E + F = 1) the area inside the loop is that of the
# faces laid into the plane; others have no area here.
@query("face_outlines", f"""{PLANES}, s4 AS (SELECT grp, unnest([least(a, b), least(b, c), least(c, a)]) AS u, unnest([greatest(a, b), greatest(b, c), greatest(c, a)]) AS w FROM grouped), e AS (SELECT grp, u, w, count(*) AS n FROM s4 GROUP BY ALL),
  k AS (SELECT grp, count(*) AS edges, count(*) FILTER (WHERE n = 1) AS rim FROM e GROUP BY grp), v AS (SELECT grp, count(DISTINCT x) AS rim_vertices FROM (SELECT grp, unnest([u, w]) AS x FROM e WHERE n = 1) GROUP BY grp),
  flat AS (SELECT g.grp, sum(g.area * (g.nx * p.nx + g.ny * p.ny + g.nz * p.nz)) AS area FROM grouped g JOIN plane p ON p.grp = g.grp GROUP BY g.grp)
  SELECT f.grp AS "group", rim, CASE WHEN rim = rim_vertices AND vertices - edges + faces = 1 THEN round(flat.area, 5) END AS area FROM fitted f JOIN k ON k.grp = f.grp JOIN v ON v.grp = f.grp JOIN flat ON flat.grp = f.grp""")
def face_outlines(spark, sf):
    grouped, vertices = _grouped(spark, sf), _mesh(spark, sf)[1]
    found = outlines.loops(grouped, vertices, mesh.fit_planes(grouped, vertices, "+Z"), 0.0)
    simple = (F.count(F.lit(1)) == 1) & F.bool_and(F.size(F.array_distinct("points")) == F.col("raw_vertices"))
    return found.groupBy("group").agg(F.sum("raw_vertices").alias("rim"), F.when(simple, F.round(F.sum(F.abs("area")), 5)).alias("area"))


@query("plane_documents")
def plane_documents(spark, sf):
    grouped, vertices = _grouped(spark, sf), _mesh(spark, sf)[1]
    planes = mesh.fit_planes(grouped, vertices, "+Z")
    return outlines.plane_documents(mesh.numbered(planes), outlines.loops(grouped, vertices, planes, 0.02), 0.12, 0.05)


# From +X only faces of the same row of cells can hide a face.
@query("visible_faces", f"""{MESH}, t3 AS (SELECT fid, (fid // 2) // 64 AS strip, p.x AS x1, p.y AS y1, p.z AS z1, q.x AS x2, q.y AS y2, q.z AS z2, s.x AS x3, s.y AS y3, s.z AS z3 FROM tri JOIN vert p ON p.vid = tri.a JOIN vert q ON q.vid = tri.b JOIN vert s ON s.vid = tri.c),
  own AS (SELECT fid, (fid // 2) // 64 AS strip, cx, cy, cz FROM geo WHERE nx > 1e-6),
  hit AS (SELECT own.fid, t3.fid AS other, x1 + ((cy - y1) * (z3 - z1) - (y3 - y1) * (cz - z1)) / det * (x2 - x1) + ((y2 - y1) * (cz - z1) - (cy - y1) * (z2 - z1)) / det * (x3 - x1) AS depth FROM own JOIN (SELECT *, (y2 - y1) * (z3 - z1) - (y3 - y1) * (z2 - z1) AS det FROM t3) t3 ON t3.strip = own.strip
    WHERE abs(det) > 1e-18 AND ((cy - y1) * (z3 - z1) - (y3 - y1) * (cz - z1)) / det >= -1e-9 AND ((y2 - y1) * (cz - z1) - (cy - y1) * (z2 - z1)) / det >= -1e-9 AND ((cy - y1) * (z3 - z1) - (y3 - y1) * (cz - z1) + (y2 - y1) * (cz - z1) - (cy - y1) * (z2 - z1)) / det <= 1 + 1e-9),
  top AS (SELECT fid, max(depth) AS depth FROM hit GROUP BY fid)
  SELECT hit.fid FROM hit JOIN top USING (fid) WHERE hit.other = hit.fid AND hit.depth >= top.depth - 1e-9""")
def visible_faces(spark, sf):
    faces, vertices = _mesh(spark, sf)
    return visibility.visible_faces(mesh.face_geometry(faces, vertices), faces, vertices, "+X").select("fid")


@query("plane_visibility")
def plane_visibility(spark, sf):
    faces, vertices = _mesh(spark, sf)
    grouped = _grouped(spark, sf)
    out = visibility.directional_visibility(grouped, mesh.fit_planes(grouped, vertices, "+Z"), faces, vertices, "+X")
    return out.select("group", F.round("visibility", 6).alias("visibility"))


@query("reduction_percent", f"{PLANES} SELECT faces, count(*) AS planes, round(avg(100.0 * (1 - vertices / (3.0 * faces))), 6) + 0.0 AS reduction FROM fitted GROUP BY faces")
def reduction_percent(spark, sf):
    cutted = mesh.reduction(3.0 * F.col("faces"), F.col("vertices"))
    return _planes(spark, sf).groupBy("faces").agg(F.count(F.lit(1)).alias("planes"), S.fixed(F.avg(cutted)).alias("reduction"))


@query("rotate_planes", f"""{PLANES}, big AS (SELECT * FROM fitted) SELECT grp AS "group", rotation, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z FROM (
  SELECT grp, 'x+90' AS rotation, cx AS x, 20 - cz AS y, cy - 20 AS z FROM big UNION ALL SELECT grp, 'z-90', 10 + cy - 20, 20 - (cx - 10), cz FROM big UNION ALL SELECT grp, 'y+90', 10 + cz, cy, 0 - (cx - 10) FROM big)""")
def rotate_planes(spark, sf):
    out = mesh.rotate(_planes(spark, sf), [("cx", "cy", "cz")], (10.0, 20.0, 0.0), ["x+90", "z-90", "y+90"])
    return out.select("group", "rotation", *[S.fixed(F.col(f"c{k}"), 4).alias(k) for k in "xyz"])


@query("axis_split", f"{MESH} SELECT CASE WHEN x < 31.5 - 1e-6 THEN 'below' WHEN x > 31.5 + 1e-6 THEN 'above' ELSE 'on' END AS side, count(*) AS vertices, round(max(z), 6) AS top FROM vert GROUP BY 1")
def axis_split(spark, sf):
    vertices = _mesh(spark, sf)[1]
    middle = vertices.groupBy("mesh").agg(((F.min("x") + F.max("x")) / 2).alias("at"))
    return mesh.split_side(vertices.join(F.broadcast(middle), "mesh"), "x", F.col("at"), 1e-6).groupBy("side").agg(F.count(F.lit(1)).alias("vertices"), F.round(F.max("z"), 6).alias("top"))


@query("mesh_manifold", f"""{MESH}, s AS (SELECT unnest([least(a, b), least(b, c), least(c, a)]) AS u, unnest([greatest(a, b), greatest(b, c), greatest(c, a)]) AS w FROM tri), n AS (SELECT u, w, count(*) AS n FROM s GROUP BY u, w)
  SELECT 'm' AS mesh, bool_and(n = 2) AS manifold, count(*) FILTER (WHERE n = 1) AS open_edges, count(*) FILTER (WHERE n > 2) AS shared_edges FROM n""")
def mesh_manifold(spark, sf):
    return mesh.manifold(_mesh(spark, sf)[0])


@query("angle_sweep", f"{MESH}, t AS (SELECT unnest([2, 4, 6, 8]) AS pitch) SELECT pitch, count(*) FILTER (WHERE nz >= cos(radians(pitch))) AS faces FROM geo, t GROUP BY pitch")
def angle_sweep(spark, sf):
    g = _geometry(spark, sf).where("valid").select("nz", F.explode(F.array(*[F.lit(p) for p in (2, 4, 6, 8)])).alias("pitch"))
    return g.groupBy("pitch").agg(F.count_if(F.col("nz") >= F.cos(F.radians("pitch"))).alias("faces"))
