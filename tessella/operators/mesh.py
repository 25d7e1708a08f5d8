"""Triangle meshes as tables: vertices (mesh, vid, x, y, z) and faces (mesh, fid, a, b, c)."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clean_number
from ..plans.scratch import cut
from .joins import components

UP = {"+X": (1, 0, 0), "-X": (-1, 0, 0), "+Y": (0, 1, 0), "-Y": (0, -1, 0), "+Z": (0, 0, 1), "-Z": (0, 0, -1)}


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Add unit normal, area, centre and whether the face has an area."""
    for k in "abc":
        side = vertices.select("mesh", F.col("vid").alias(k), F.struct("x", "y", "z").alias(f"p{k}"))
        faces = faces.join(side, ["mesh", k])
    e1 = [F.col(f"pb.{k}") - F.col(f"pa.{k}") for k in "xyz"]
    e2 = [F.col(f"pc.{k}") - F.col(f"pa.{k}") for k in "xyz"]
    cross = [e1[1] * e2[2] - e1[2] * e2[1], e1[2] * e2[0] - e1[0] * e2[2], e1[0] * e2[1] - e1[1] * e2[0]]
    faces = faces.withColumns({f"n{k}": v for k, v in zip("xyz", cross)})
    faces = faces.withColumn("twice", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))).withColumn("valid", F.col("twice") > 1e-12)
    unit = {f"n{k}": F.when(F.col("valid"), F.col(f"n{k}") / F.col("twice")).otherwise(0.0) for k in "xyz"}
    centre = {f"c{k}": (F.col(f"pa.{k}") + F.col(f"pb.{k}") + F.col(f"pc.{k}")) / 3 for k in "xyz"}
    faces = faces.withColumns(unit | centre | {"area": F.col("twice") / 2}).drop("pa", "pb", "pc", "twice")
    # A generator keeps filters on normals from being pushed down, which would write all these terms out again and again, in
    # methods too long to be compiled.
    return faces.select(F.inline(F.array(F.struct(*faces.columns))))


def up_dot(up: str) -> Column:
    return sum((F.col(f"n{k}") * float(u) for k, u in zip("xyz", UP[up])), F.lit(0.0))


def roof_candidates(geometry: DataFrame, up: str, max_pitch: float, two_sided: bool = False) -> DataFrame:
    """Valid faces within ``max_pitch`` degrees of up; two-sided faces are turned towards it first."""
    if two_sided:
        turn = F.when(up_dot(up) < 0, -1.0).otherwise(1.0)
        geometry = geometry.withColumn("__t", turn).withColumns({f"n{k}": F.col(f"n{k}") * F.col("__t") for k in "xyz"}).drop("__t")
    return geometry.where(F.col("valid") & (up_dot(up) >= math.cos(math.radians(max_pitch))))


def edges(faces: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(mesh, fid, u, v), u < v: the three edges of each face, with the columns to ``keep``."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    return faces.withColumn("e", F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a")))).select("mesh", "fid", *keep, "e.u", "e.v")


def group_faces(candidates: DataFrame, angle_tolerance: float) -> DataFrame:
    """Add ``group``: the least face id of the faces connected over edges whose normals differ by at most the tolerance.

    On an edge with more than two faces every face is compared with the first one only. Face ids are told apart by mesh.
    """
    sides = edges(candidates, ["nx", "ny", "nz"])
    first = F.min(F.struct("fid", "nx", "ny", "nz")).over(W.partitionBy("mesh", "u", "v"))
    pairs = sides.withColumn("f", first).where(F.col("fid") != F.col("f.fid"))
    dot = F.col("nx") * F.col("f.nx") + F.col("ny") * F.col("f.ny") + F.col("nz") * F.col("f.nz")
    near = pairs.where(dot >= math.cos(math.radians(angle_tolerance))).selectExpr("struct(mesh, fid) as a", "struct(mesh, f.fid as fid) as b")
    roots = components(near).select("node.mesh", "node.fid", F.col("root.fid").alias("group"))
    return candidates.join(roots, ["mesh", "fid"], "left").withColumn("group", F.coalesce("group", "fid"))


def fit_planes(grouped: DataFrame, vertices: DataFrame, up: str) -> DataFrame:
    """For each group: faces, area, area-weighted centroid and normal (towards up), the residuals of its vertices, and
    tangent_radius, the farthest that a vertex is from the centroid along the plane."""
    weight = F.sum("area")
    grouped = cut(grouped, "grouped")  # read twice
    per = grouped.groupBy("mesh", "group").agg(
        F.count(F.lit(1)).alias("faces"), weight.alias("area"),
        *[(F.sum(F.col("area") * F.col(f"c{k}")) / weight).alias(f"c{k}") for k in "xyz"], *[F.sum(F.col("area") * F.col(f"n{k}")).alias(f"s{k}") for k in "xyz"],
    )
    length = F.greatest(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz")), F.lit(1e-12))
    side = F.when(sum((F.col(f"s{k}") * float(u) for k, u in zip("xyz", UP[up])), F.lit(0.0)) < 0, -1.0).otherwise(1.0)
    per = per.withColumns({"__l": length, "__s": side}).withColumns({f"n{k}": F.col(f"s{k}") * F.col("__s") / F.col("__l") for k in "xyz"}).drop("sx", "sy", "sz", "__l", "__s")
    used = grouped.withColumn("vid", F.explode(F.array("a", "b", "c"))).select("mesh", "group", "vid").distinct()
    off = used.join(vertices, ["mesh", "vid"]).join(per.select("mesh", "group", "cx", "cy", "cz", "nx", "ny", "nz"), ["mesh", "group"])
    d = F.abs(sum(((F.col(k) - F.col(f"c{k}")) * F.col(f"n{k}") for k in "xyz"), F.lit(0.0)))
    across = [(F.col(k) - F.col(f"c{k}")) - F.col("__along") * F.col(f"n{k}") for k in "xyz"]
    along = sum(((F.col(k) - F.col(f"c{k}")) * F.col(f"n{k}") for k in "xyz"), F.lit(0.0))
    off = off.withColumn("__along", along).withColumn("reach", F.sqrt(sum((x * x for x in across), F.lit(0.0))))
    residuals = off.withColumn("d", d).groupBy("mesh", "group").agg(
        F.max("reach").alias("tangent_radius"),
        F.count(F.lit(1)).alias("vertices"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.max("d").alias("worst"), F.percentile("d", F.lit(0.95)).alias("p95"), F.percentile("d", F.lit(0.99)).alias("p99")
    )
    return per.join(residuals, ["mesh", "group"])


def gates(min_faces: int, min_area: float, max_rms: float) -> Column:
    """The first rule that a plane fails, or ``accepted``."""
    return F.when(F.col("faces") < min_faces, "min_faces").when(F.col("area") < min_area, "min_area").when(F.col("rms") > max_rms, "max_rms").otherwise("accepted")


def numbered(planes: DataFrame) -> DataFrame:
    """Add ``plane_id``: roof_plane_001 for the largest area; of equal ones the lower group."""
    n = F.row_number().over(W.partitionBy("mesh").orderBy(F.desc("area"), "group"))
    return planes.withColumn("plane_id", F.concat(F.lit("roof_plane_"), F.lpad(n.cast("string"), 3, "0")))


def boundary_vertices(grouped: DataFrame) -> DataFrame:
    """Vertices on edges that one face of the group alone has."""
    once = edges(grouped, ["group"]).groupBy("mesh", "group", "u", "v").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.withColumn("vid", F.explode(F.array("u", "v"))).select("mesh", "group", "vid").distinct()


def coplanar_pairs(planes: DataFrame, angle_tolerance: float, plane_distance: float, gap: float, reach: str = "tangent_radius") -> DataFrame:
    """Pairs of planes whose normals agree, whose centroids are near one of their planes, and whose distance along the first
    plane (the lower group) is at most both reaches and the gap.

    Planes are put into cells by levels of reach: level k has cells twice as wide as level k - 1, and a plane stands in the
    level of its own reach. Each plane stands once in its cell of its own level and of every wider one; it is dealt into the
    cells of its own level that any plane of this or a lower level can be in that is near enough: two along an axis at most or,
    seldom, three, and none outside the box of the mesh. So few rows are made of a plane, and one large plane does not put all
    others into one cell. A pair is found by its plane of the higher level (of equal levels the higher group), whose distance
    from the other in space is bounded: the offset from the plane is at most ``plane_distance`` for one of the two, and the
    normals differ by at most the tolerance.
    """
    planes = cut(planes.select("mesh", "group", *[f"{a}{k}" for a in "cn" for k in "xyz"], F.col(reach).alias("reach")), "planes")  # read twice
    # A pair is apart by less than the reaches, the gap and the offset; for angles up to 60 degrees the offset from the other
    # plane adds at most as much again as the tangential part.
    turn = 1.0 + math.tan(math.radians(min(angle_tolerance, 60.0)))
    width = lambda reach: (2 * reach + gap + plane_distance) * turn
    unit = gap + plane_distance + 1e-6
    level = F.greatest(F.lit(0), F.ceil(F.log2(width(F.col("reach")) / unit)))
    planes = planes.where(" and ".join(f"abs(c{k}) < double('infinity')" for k in "xyz")).withColumn("__level", level.cast("int"))
    box = [f(f"c{k}").alias(f"__{n}{k}") for n, f in (("l", F.min), ("h", F.max)) for k in "xyz"]
    box = cut(planes.groupBy("mesh").agg(F.max("__level").alias("__top"), *box), "boxes")
    held = [k for k in planes.columns if k != "mesh"]
    put = planes.join(F.broadcast(box), "mesh")
    # Twice as wide as the farthest that two planes of a level can be apart.
    side = lambda level: 2.0 * unit * F.pow(F.lit(2.0), F.col(level))
    cell = lambda x, k, level: F.floor((x - F.col(f"__l{k}")) / side(level))
    one = put.withColumn("level", F.explode(F.sequence("__level", "__top"))).select("mesh", F.struct(*held).alias("a"), "level", *[cell(F.col(f"c{k}"), k, "level").alias(f"g{k}") for k in "xyz"])
    far = ((F.col("reach") + (gap + plane_distance) / 2) * turn + side("__level") / 4) * (1 + 1e-9) + F.greatest(*[F.abs(f"__{n}{k}") for n in "lh" for k in "xyz"]) * 1e-12
    for k in "xyz":
        low, high = F.greatest(F.col(f"c{k}") - far, F.col(f"__l{k}")), F.least(F.col(f"c{k}") + far, F.col(f"__h{k}"))
        put = put.withColumn(f"g{k}", F.explode(F.sequence(cell(low, k, "__level"), cell(high, k, "__level"))))
    many = put.select("mesh", F.struct(*held).alias("b"), F.col("__level").alias("level"), "gx", "gy", "gz")
    both = one.join(many, ["mesh", "level", "gx", "gy", "gz"]).where("a.__level < b.__level or a.group < b.group")
    both = both.select("mesh", F.when(F.col("a.group") < F.col("b.group"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("a.group") < F.col("b.group"), F.col("b")).otherwise(F.col("a")).alias("b"))
    delta = {k: F.col(f"b.c{k}") - F.col(f"a.c{k}") for k in "xyz"}
    dot = sum((F.col(f"a.n{k}") * F.col(f"b.n{k}") for k in "xyz"), F.lit(0.0))
    off = lambda s: sum((delta[k] * F.col(f"{s}.n{k}") for k in "xyz"), F.lit(0.0))
    along = F.sqrt(sum(((delta[k] - F.col("a").getField(f"n{k}") * off("a")) ** 2 for k in "xyz"), F.lit(0.0)))
    ok = (dot >= math.cos(math.radians(angle_tolerance))) & (F.least(F.abs(off("a")), F.abs(off("b"))) <= plane_distance) & (along <= F.col("a.reach") + F.col("b.reach") + gap)
    return both.where(ok).select("mesh", F.col("a.group").alias("a"), F.col("b.group").alias("b"))


def robust_merge(planes: DataFrame, residuals: DataFrame, edge: DataFrame, tolerance: float, percentile: float = 0.95, least_inliers: float = 0.95, worst: float = 0.1, least_edge: float = 0.8) -> DataFrame:
    """Whether a fitted plane may stand for what was merged into it: mesh, group, inlier_ratio, outliers, edge_outliers,
    edge_ratio, mode (``strict``: no residual beyond the tolerance; ``robust``: few, small and at the border; else
    ``rejected``). ``residuals`` are (mesh, group, vid, d), ``edge`` the rows of ``boundary_vertices``."""
    told = residuals.join(edge.withColumn("__edge", F.lit(True)), ["mesh", "group", "vid"], "left")
    out = F.col("d") > tolerance
    per = told.groupBy("mesh", "group").agg(
        F.avg((~out).cast("double")).alias("inlier_ratio"), F.count_if(out).alias("outliers"), F.count_if(out & F.col("__edge")).alias("edge_outliers"),
        F.max("d").alias("most"), F.percentile("d", F.lit(percentile)).alias("high"),
    )
    per = planes.select("mesh", "group").join(per, ["mesh", "group"]).withColumn("edge_ratio", F.when(F.col("outliers") > 0, F.col("edge_outliers") / F.col("outliers")).otherwise(1.0))
    fine = (F.col("high") <= tolerance) & (F.col("inlier_ratio") >= least_inliers) & (F.col("most") <= worst) & (F.col("edge_ratio") >= least_edge)
    return per.withColumn("mode", F.when(F.col("most") <= tolerance, "strict").when(fine, "robust").otherwise("rejected")).drop("most", "high")


def vertex_residuals(grouped: DataFrame, planes: DataFrame, vertices: DataFrame) -> DataFrame:
    """(mesh, group, vid, d): the distance of each vertex of a group from its plane."""
    used = grouped.select("mesh", "group", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    off = used.join(vertices, ["mesh", "vid"]).join(planes.select("mesh", "group", "cx", "cy", "cz", "nx", "ny", "nz"), ["mesh", "group"])
    return off.select("mesh", "group", "vid", F.abs(sum(((F.col(k) - F.col(f"c{k}")) * F.col(f"n{k}") for k in "xyz"), F.lit(0.0))).alias("d"))


def scene_summary(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """For each mesh: vertices, triangles, and the corners of its box."""
    box = [f(k).alias(f"{n}_{k}") for n, f in (("least", F.min), ("most", F.max)) for k in "xyz"]
    return vertices.groupBy("mesh").agg(F.count(F.lit(1)).alias("vertices"), *box).join(faces.groupBy("mesh").agg(F.count(F.lit(1)).alias("triangles")), "mesh", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))


def used_vertices(faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many vertices the faces of each group use, each counted once."""
    return faces.select(*keys, F.explode(F.array("a", "b", "c")).alias("vid")).groupBy(*keys).agg(F.count_distinct("vid").alias("vertices"))


def plane_basis(nx: Column, ny: Column, nz: Column) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Two unit vectors that span the plane of a unit normal: the first is square to the normal and to z (to x where the
    normal is within about 26 degrees of z), the second square to both."""
    steep = F.abs(nz) > 0.9
    helper = (F.when(steep, 1.0).otherwise(0.0), F.lit(0.0), F.when(steep, 0.0).otherwise(1.0))
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    u = cross(helper, (nx, ny, nz))
    size = F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])
    u = tuple(x / size for x in u)
    return u, cross((nx, ny, nz), u)


def reduction(before: Column, after: Column) -> Column:
    """By how many percent a count fell; null without one before."""
    return F.when(before > 0, 100.0 * (1.0 - after / before))


ROTATIONS = {name: (axis, sign) for name, axis, sign in (("x+90", 0, 1), ("x-90", 0, -1), ("y+90", 1, 1), ("y-90", 1, -1), ("z+90", 2, 1), ("z-90", 2, -1))}


def rotate(df: DataFrame, points: list[tuple[str, str, str]], pivot: tuple[float, float, float], names: list[str]) -> DataFrame:
    """Every row once for each named quarter turn: positions turn about the pivot."""
    out = df.withColumn("rotation", F.explode(F.array(*[F.lit(n) for n in names])))
    for cols in points:
        moved = [F.col(c) - p for c, p in zip(cols, pivot)]
        made = []
        for k in range(3):
            value = None
            for n in names:
                axis, sign = ROTATIONS[n]
                i, j = (axis + 1) % 3, (axis + 2) % 3
                got = moved[axis] if k == axis else (moved[j] * -sign if k == i else moved[i] * sign)
                value = F.when(F.col("rotation") == n, got) if value is None else value.when(F.col("rotation") == n, got)
            made.append(clean_number(value + pivot[k]))
        out = out.withColumns({f"__r{k}": v for k, v in enumerate(made)}).withColumns({c: F.col(f"__r{k}") for k, c in enumerate(cols)}).drop("__r0", "__r1", "__r2")
    return out


def split_side(vertices: DataFrame, axis: str, at: Column, tolerance: float) -> DataFrame:
    """Vertices on each side of an axis plane."""
    side = F.when(F.col(axis) < at - tolerance, "below").when(F.col(axis) > at + tolerance, "above").otherwise("on")
    return vertices.withColumn("side", side)


def manifold(faces: DataFrame) -> DataFrame:
    """Whether every edge of a mesh has two faces, and how often not."""
    per = edges(faces).groupBy("mesh", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("mesh").agg(F.bool_and(F.col("n") == 2).alias("manifold"), F.count_if(F.col("n") == 1).alias("open_edges"), F.count_if(F.col("n") > 2).alias("shared_edges"))
