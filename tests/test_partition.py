"""Merging rounds, markers, snapped borders and visibility against plain versions."""
import numpy as np

from pyspark.sql import functions as F

from tessella.operators import fits, graph, mesh, partition, visibility


def table(spark, **grids):
    names = sorted(grids)
    h, w = next(iter(grids.values())).shape
    rows = [("i", r, c, r * w + c, *(grids[n][r, c].item() for n in names)) for r in range(h) for c in range(w)]
    kind = {"i": "int", "f": "double", "b": "boolean"}
    return spark.createDataFrame(rows, "image string, r long, c int, pixel long, " + ", ".join(f"{n} {kind[grids[n].dtype.kind]}" for n in names))


def back(df, name, shape):
    out = np.zeros(shape, int)
    for x in df.select("r", "c", name).collect():
        out[x.r, x.c] = x[name]
    return out


def test_rounds_unite_what_lies_in_one_plane(spark):
    r, c = np.mgrid[0:12, 0:40]
    label = (c // 8 + 1).astype(int)
    label[0] = 0
    height = np.where(c < 24, 0.1 * c, 2.4 - 0.5 * (c - 24))
    px = table(spark, label=label, h=height, ok=np.ones_like(label, bool), e=np.full(label.shape, 0.5))
    fit = lambda p: fits.ols(p, ["image", "label"], "c", "r", "h")
    out, records = partition.merge_planar(px, fit, "h", "ok", "e", 2.0, 0.6)
    assert (back(out, "label", label.shape) == np.where(label == 0, 0, np.where(c < 24, 1, 2))).all()
    told = sorted((x["round"], x.a, x.b, x.merged) for x in records.collect())
    assert told == [(1, 1, 2, True), (1, 2, 3, True), (1, 3, 4, False), (1, 4, 5, True), (2, 1, 2, False)]
    same, records = partition.merge_planar(px, fit, "h", "ok", "e", 2.0, 0.6, max_evidence=0.4)
    assert (back(same, "label", label.shape) == label).all() and records.where("merged").count() == 0


def markers_by_hand(label, inset):
    h, w = label.shape
    out, n = np.zeros_like(label), 0
    for k in range(1, label.max() + 1):
        spots = [tuple(p) for p in np.argwhere(label == k).tolist()]
        seed = np.zeros((h, w), bool)
        for r, c in spots:
            seed[r, c] = (label[max(0, r - inset) : r + inset + 1, max(0, c - inset) : c + inset + 1] == k).all()
        if spots and not seed.any():
            others = np.argwhere(label != k)
            seed[max(spots, key=lambda p: (((others - p) ** 2).sum(1).min(), -p[0], -p[1]))] = True
        parts = graph.label_grid(seed, False)
        for part in sorted(set(parts[seed].tolist()), key=lambda x: np.argwhere(parts == x)[0].tolist()):
            n += 1
            out[parts == part] = n
    return out


def test_markers_and_snapped_borders(spark):
    draw = np.random.default_rng(8)
    label = np.kron(draw.integers(0, 5, (4, 5)), np.ones((4, 5), int))
    label[10:12, 3:20], label[5, 5] = 5, 3
    for inset in (1, 2, 3):
        got = partition.region_markers(table(spark, label=label), inset, "pixel")
        assert (back(got, "marker", label.shape) == markers_by_hand(label, inset)).all(), inset
    two = np.where(np.mgrid[0:16, 0:24][1] < 12, 1, 2)
    two[:, 22:] = 0
    ridge = np.zeros(two.shape)
    ridge[:, 15] = 1.0
    px = table(spark, label=two, e=ridge, line=np.zeros(two.shape, bool))
    out = back(partition.snap_partition(px, "pixel", "e", "e", "line", (0.1, 1.0, 0.1), 5), "label", two.shape)
    assert ((out > 0) == (two > 0)).all() and set(out[:, :14].ravel()) == {1} and set(out[:, 17:22].ravel()) == {2}


def test_faces_hide_each_other(spark):
    draw = np.random.default_rng(6)
    corners = draw.uniform(0, 10, (120, 1, 3)) + draw.uniform(-1, 1, (120, 3, 3)) * draw.choice([0.3, 1.0, 4.0], (120, 1, 1))
    vertices = spark.createDataFrame([("m", 3 * f + k, *map(float, p)) for f, t in enumerate(corners) for k, p in enumerate(t)], "mesh string, vid long, x double, y double, z double")
    faces = spark.createDataFrame([("m", f, 3 * f, 3 * f + 1, 3 * f + 2) for f in range(120)], "mesh string, fid long, a long, b long, c long")
    geo = mesh.face_geometry(faces, vertices)
    normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    for view in ("+Z", "-X", "+Y"):
        v = np.array(mesh.UP[view], float)
        first = []
        for t in corners:
            # Where the ray through the centre crosses each face's plane: solve for two sides and the way along the view.
            crossing = [np.linalg.solve(np.column_stack([o[1] - o[0], o[2] - o[0], -v]), t.mean(0) - o[0]) for o in corners]
            first.append(max((w, f) for f, (a, b, w) in enumerate(crossing) if a >= -1e-9 and b >= -1e-9 and a + b <= 1 + 1e-9)[1])
        want = {f for f in range(120) if first[f] == f and normal[f] @ v > 1e-6}
        assert {x.fid for x in visibility.visible_faces(geo, faces, vertices, view).collect()} == want
        grouped = geo.withColumn("group", F.when(F.col("fid") < 60, 0).otherwise(F.col("fid")))
        facing = {0} | {f for f in range(60, 120) if normal[f] @ v > 1e-6}
        planes = spark.createDataFrame([("m", g, *map(float, v if g == 0 else normal[g])) for g in [0, *range(60, 120)]], "mesh string, group long, nx double, ny double, nz double")
        got = {x.group: x.visibility for x in visibility.directional_visibility(grouped, planes, faces, vertices, view).collect()}
        sampled = np.linspace(0, 59, 24, dtype=int)
        assert abs(got.pop(0) - np.mean([first[f] < 60 for f in sampled])) < 1e-12
        assert got == {f: float(f in facing and first[f] == f) for f in range(60, 120)}


def test_regions_over_many_tiles(spark, monkeypatch):
    """A region that winds through the whole image, and random ones, in tiles of five rows and columns."""
    monkeypatch.setattr(graph, "TILE", 5)
    draw = np.random.default_rng(8)
    h, w = 23, 17
    one, two = draw.integers(1, 3, (h, w)), draw.integers(0, 2, (h, w))
    one[::2], two[::2] = 7, 0
    for r in range(1, h, 2):
        one[r], one[r, -1 if r % 4 == 1 else 0] = 8, 7
        two[r, -1 if r % 4 == 1 else 0] = 0
    px = table(spark, one=one, two=two).where("r <> 9 or c > 14").withColumn("r", F.col("r") - 3)
    px = px.unionByName(px.limit(1).select(F.lit(None).cast("string").alias("image"), "r", "c", F.lit(9999).cast("long").alias("pixel"), "one", "two"))
    got = graph.intersection_partition(px.withColumn("two", F.when(F.col("pixel") != 40, F.col("two"))), "one", "two", "pixel").where("image = 'i'").collect()
    codes = one * 10 + two
    codes[9, :15] = -1
    codes[40 // w, 40 % w] = -1
    want, parts = np.zeros((h, w), int), []
    for code in np.unique(codes[codes >= 0]):
        grid = graph.label_grid(codes == code, False)
        parts += [(code, np.argwhere(grid == k)) for k in range(1, grid.max() + 1)]
    seen = {}
    for x in got:
        seen.setdefault(x.region, set()).add((x.r + 3, x.c))
    lone = {(40 // w, 40 % w)}
    assert {frozenset(s) for s in seen.values()} == {frozenset(map(tuple, p.tolist())) for _, p in parts} | {frozenset(lone)}
    order = [int(x.one) * 10 + (x.two or 0) for x in sorted(got, key=lambda x: x.region) if x.pixel != 40]
    assert order == sorted(order)


def test_a_long_strip_takes_few_rounds(spark):
    px = spark.range(3000).select(F.lit("i").alias("image"), F.col("id").alias("r"), F.lit(0).alias("c"), F.col("id").alias("pixel"), F.lit(1).alias("one"), F.lit(1).alias("two"))
    sc = spark.sparkContext
    sc.setJobGroup("strip", "")
    try:
        assert graph.intersection_partition(px, "one", "two", "pixel").agg(F.min("region"), F.max("region"), F.count("*")).first()[:] == (1, 1, 3000)
        jobs = len(sc.statusTracker().getJobIdsForGroup("strip"))
    finally:
        sc.setJobGroup("", "")
    assert jobs <= 60, jobs
