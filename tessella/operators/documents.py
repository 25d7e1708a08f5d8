"""Detections, topology documents, merge plans, run listings, GeoJSON."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
#: Schemas of recorded model responses.
TOPOLOGY = (
    "analysis_summary STRING, orientation_summary STRING,"
    f" junctions ARRAY<STRUCT<junction_id: STRING, point: {POINT}, junction_type: STRING, confidence: DOUBLE>>,"
    f" boundaries ARRAY<STRUCT<boundary_id: STRING, boundary_type: STRING, points: ARRAY<{POINT}>, plane_ids: ARRAY<INT>, confidence: DOUBLE, reason: STRING>>,"
    f" planes ARRAY<STRUCT<plane_id: INT, name: STRING, seed: {POINT}, outline: ARRAY<{POINT}>, slope_direction_degrees: DOUBLE, adjacent_plane_ids: ARRAY<INT>, confidence: DOUBLE, reason: STRING>>,"
    f" uncertainties ARRAY<STRUCT<description: STRING, region: ARRAY<{POINT}>, severity: STRING>>"
)
PLAN = (
    "analysis_summary STRING, roof_planes ARRAY<STRUCT<plane_id: STRING, candidate_ids: ARRAY<INT>, confidence: DOUBLE, reason: STRING>>,"
    " split_requests ARRAY<STRUCT<candidate_id: INT, boundary_type: STRING, line: STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>, confidence: DOUBLE, reason: STRING>>,"
    " uncertain_candidate_ids ARRAY<INT>"
)


def parse(df: DataFrame, text: str, schema: str, out: str) -> DataFrame:
    """Recorded JSON as a struct; text that does not fit the schema is an error."""
    return df.withColumn(out, F.from_json(text, schema, {"mode": "FAILFAST"}))


def select_prediction(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the detections (idx, score, covers_centre, box_holds_centre) of an image one: those whose mask covers the image
    centre first, then those whose box holds it, then any; the best score of these, a missing one last, then the first."""
    tier = F.when(F.col("covers_centre"), 0).when(F.col("box_holds_centre"), 1).otherwise(2)
    best = W.partitionBy(*keys).orderBy("tier", F.desc_nulls_last("score"), "idx")
    return found.withColumn("tier", tier).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def mask_quality(px: DataFrame, inside: Column, low: float = 0.05, high: float = 0.85, least_side: float = 0.12, offset_x: float = 0.30, offset_y: float = 0.40) -> DataFrame:
    """Share, box, centre and edge contacts of a mask, and the reasons against it."""
    m = F.when(inside, 1)
    out = px.groupBy("image").agg(
        F.max("c").alias("w"), F.max("r").alias("h"), F.count(m).alias("area"), F.count(F.lit(1)).alias("all"), F.min(F.when(inside, F.col("c"))).alias("x0"), F.max(F.when(inside, F.col("c"))).alias("x1"),
        F.min(F.when(inside, F.col("r"))).alias("y0"), F.max(F.when(inside, F.col("r"))).alias("y1"), F.avg(F.when(inside, F.col("c"))).alias("mx"), F.avg(F.when(inside, F.col("r"))).alias("my"),
        F.count_if(inside & ((F.col("c") == 0) | (F.col("r") == 0))).alias("edge_contacts"),
    )
    share = F.col("area") / F.col("all")
    wide, tall = (F.col("x1") - F.col("x0") + 1) / (F.col("w") + 1), (F.col("y1") - F.col("y0") + 1) / (F.col("h") + 1)
    dx, dy = F.abs(F.col("mx") / (F.col("w") + 1) - 0.5), F.abs(F.col("my") / (F.col("h") + 1) - 0.5)
    reasons = F.concat_ws(
        ",", F.when(F.col("area") == 0, "empty"), F.when((F.col("area") > 0) & (share < low), "too_small"), F.when(share > high, "too_large"), F.when(F.least(wide, tall) < least_side, "too_thin"), F.when((dx > offset_x) | (dy > offset_y), "off_centre")
    )
    return out.select("image", "area", F.round(share, 6).alias("share"), "edge_contacts", reasons.alias("reasons"))


def topology_validation(expected: DataFrame, realised: DataFrame) -> DataFrame:
    """(image, a, b) of both sides: pairs expected but missing, and realised but unexpected."""
    missing = expected.select("image", "a", "b").exceptAll(realised.select("image", "a", "b")).withColumn("state", F.lit("missing"))
    return missing.unionByName(realised.select("image", "a", "b").exceptAll(expected.select("image", "a", "b")).withColumn("state", F.lit("unexpected")))


def apply_plan(labels: DataFrame, plan: DataFrame) -> DataFrame:
    """Every candidate label with what a plan does to it.

    Candidates to be split are not merged; of several planes that claim a candidate the first counts; claims on unknown
    labels are rejected; what is left over is preserved. (image, label) and plan (image, plan): image, label, action, plane.
    """
    claims = plan.select("image", F.posexplode("plan.roof_planes").alias("at", "p")).select("image", "at", "p.plane_id", F.posexplode("p.candidate_ids").alias("pos", "label"))
    splits = plan.select("image", F.explode("plan.split_requests").alias("s")).select("image", F.col("s.candidate_id").alias("label")).distinct()
    first = F.row_number().over(W.partitionBy("image", "label").orderBy("at", "pos"))
    known = labels.select("image", "label", F.lit(True).alias("known"))
    ruled = claims.withColumn("n", first).join(known, ["image", "label"], "left").join(splits.withColumn("split", F.lit(True)), ["image", "label"], "left")
    action = F.when(F.col("known").isNull(), "rejected_unknown").when(F.col("split"), "rejected_split").when(F.col("n") > 1, "rejected_used").otherwise("merged")
    ruled = ruled.select("image", "label", action.alias("action"), "plane_id")
    split = splits.join(known, ["image", "label"]).select("image", "label", F.lit("split").alias("action"), F.lit(None).cast("string").alias("plane_id"))
    used = ruled.where("action = 'merged'").select("image", "label").unionByName(split.select("image", "label"))
    rest = labels.select("image", "label").join(used, ["image", "label"], "left_anti").select("image", "label", F.lit("preserved").alias("action"), F.lit(None).cast("string").alias("plane_id"))
    return ruled.unionByName(split).unionByName(rest)


def latest_run(files: DataFrame, required: Sequence[str], by: str = "modified") -> DataFrame:
    """Of the runs (experiment, run, file, modified) that hold all required files the newest of each experiment, by time or name."""
    runs = files.groupBy("experiment", "run").agg(F.collect_set(F.when(F.col("file").isin(*required), F.col("file"))).alias("have"), F.max("modified").alias("modified"))
    whole = runs.where(F.size("have") == len(set(required)))
    order = [F.desc("modified"), F.desc("run")] if by == "modified" else [F.desc("run")]
    return whole.withColumn("__n", F.row_number().over(W.partitionBy("experiment").orderBy(*order))).where("__n = 1").drop("__n", "have")


def box_geojson(boxes: DataFrame, ident: str) -> DataFrame:
    """Boxes (x0, y0, x1, y1) as GeoJSON polygons, closed and counter-clockwise."""
    ring = F.array(*[F.array(F.col(x).cast("double"), F.col(y).cast("double")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col(ident)).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return boxes.select("*", F.to_json(feature).alias("geojson"))


def acceptance(rules: dict[str, Column]) -> tuple[Column, Column]:
    """Whether all rules hold, and the names of those that do not."""
    ok = F.lit(True)
    for rule in rules.values():
        ok = ok & F.coalesce(rule, F.lit(False))
    return ok, F.concat_ws(",", *[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])


def winner(scored: DataFrame, keys: Sequence[str], score: str, order: str) -> DataFrame:
    """The row with the best score; of equal ones the first in ``order``."""
    return scored.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), order))).where("__n = 1").drop("__n")
