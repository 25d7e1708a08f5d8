"""Small hand-checked label maps, kernels against plain versions, properties."""
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.operators import documents, fits, graph, mesh, raster, vector


def grid(spark, rows, extra=""):
    data = [("i", r, c, v, float(r + c)) for r, line in enumerate(rows) for c, v in enumerate(line)]
    return spark.createDataFrame(data, "image string, r long, c int, label int, v double")


def test_two_halves(spark):
    px = grid(spark, [[1, 1, 2, 2]] * 4)
    assert {(r.id, r.area_pixels, r.area_percentage, r.x_min, r.x_max, r.centroid_x) for r in raster.summary(px).collect()} == {(1, 8, 50.0, 0, 1, 0.5), (2, 8, 50.0, 2, 3, 2.5)}
    one = raster.adjacency_statistics(px, "v", F.lit(True), "v").first()
    assert (one.a, one.b, one.samples, one.median_step) == (1, 2, 4, 1.0)
    assert raster.internal_boundary(px).count() == 8
    assert raster.boundary_complexity(px).first().complexity == 4


def test_gaps_are_no_neighbours(spark):
    px = spark.createDataFrame([("i", 0, 0, 1), ("i", 0, 2, 2), ("i", 2, 0, 3)], "image string, r long, c int, label int")
    assert raster.adjacency(px).count() == 0


def test_constant_field(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, x double")
    assert {r.u for r in scalars.stretched(df, "x", ["k"], "u", 0.5).collect()} == {0.5}
    df = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, 3.0)], "k int, x double")
    assert sorted(r.u for r in scalars.stretched(df, "x", ["k"], "u", 0.0, finite_only=True).collect()) == [0.0, 0.0, 1.0]


def test_rounding_and_locations(spark):
    df = spark.createDataFrame([("0.5, 7",), ("91, 0",), ("a, b",), ("1",)], "t string")
    assert [r.p and tuple(r.p) for r in df.select(scalars.parse_location(df.t).alias("p")).collect()] == [(0.5, 7.0), None, None, None]
    assert [r.p for r in spark.range(1).select(scalars.normalized_pixel(F.lit(0.5), 6).alias("p")).collect()] == [2]


def test_affine_maps_compose():
    a, b = (2, 0.5, 3, -1, 4, 5), (0.1, 0.2, 1, 0.3, 0.4, 2)
    got = scalars.compose(a, b)
    x, y = 2 * 7 + 0.5 * 9 + 3, -1 * 7 + 4 * 9 + 5
    assert np.allclose([got[0] * 7 + got[1] * 9 + got[2], got[3] * 7 + got[4] * 9 + got[5]], [0.1 * x + 0.2 * y + 1, 0.3 * x + 0.4 * y + 2])


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_against_flooding(diagonal):
    draw = np.random.default_rng(3)
    for _ in range(30):
        mask = draw.random((9, 11)) < 0.45
        labels = graph.label_grid(mask, diagonal)
        seen, n = np.zeros_like(labels), 0
        for r, c in zip(*np.nonzero(mask)):
            if seen[r, c]:
                continue
            n += 1
            work = [(r, c)]
            seen[r, c] = n
            while work:
                y, x = work.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (diagonal or not (dy and dx)) and 0 <= y + dy < 9 and 0 <= x + dx < 11 and mask[y + dy, x + dx] and not seen[y + dy, x + dx]:
                            seen[y + dy, x + dx] = n
                            work.append((y + dy, x + dx))
        assert (labels == seen).all()


def test_graph_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == least


def test_small_regions_go_to_the_commonest_neighbour():
    labels = np.array([[1, 1, 1, 2, 2], [1, 3, 1, 2, 2], [1, 1, 1, 2, 2], [4, 4, 4, 2, 2]])
    assert (graph.merge_small(labels, 2) == np.where(labels == 3, 1, labels)).all()
    tie = np.array([[2, 2, 2], [1, 5, 2], [1, 1, 1]])
    assert graph.merge_small(tie, 2)[1, 1] == 1


def trimmed_by_hand(x, y, z):
    """The trimmed fit with a solver for one region."""
    if len(z) < 12:
        return None
    keep = np.ones(len(z), bool)
    for _ in range(5):
        a = np.column_stack([x, y, np.ones(len(z))])
        coef = np.linalg.solve(a[keep].T @ a[keep], a[keep].T @ z[keep])
        off = np.abs(z - a @ coef)
        mid = np.median(off[keep])
        ok = off <= max(mid + 2.8 * 1.4826 * np.median(np.abs(off[keep] - mid)), 0.008)
        if (ok == keep).all() or ok.sum() < 8:
            break
        keep = ok
    return [*coef, np.sqrt(np.mean(off[keep] ** 2)), int(keep.sum()), np.median(off)]


def test_tilted_plane_and_outliers(spark):
    draw = np.random.default_rng(0)
    groups = {}
    for k in range(8):
        n = [400, 400, 5, 12, 60, 300, 11, 200][k]
        x, y = draw.random(n), draw.random(n)
        z = 0.5 * x - 0.25 * y + 3 + draw.normal(0, [0, 0, 1, 0.3, 0.05, 0.2, 0, 1][k], n)
        if k in (1, 5):
            z[: n // 10] += 2
        groups[k] = x, y, z
    df = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, g in groups.items() for a, b, c in zip(*g)] + [(0, 0.5, 0.5, None), (7, 0.5, 0.5, float("nan"))], "k int, x double, y double, z double")
    by = {r.k: r for r in fits.robust(df, ["k"], "x", "y", "z").collect()}
    assert len(by) == 8 and not by[2].valid and not by[6].valid and by[2].samples == 5
    for k, g in groups.items():
        if by[k].valid:
            assert np.allclose([by[k].sx, by[k].sy, by[k].offset, by[k].rmse, by[k].inliers, by[k].median_abs], trimmed_by_hand(*g), atol=1e-6), k
    x, y, z = groups[1]
    got = fits.ransac_fit(x, y, z, 0.05, trials=100, share=0.02)
    assert np.allclose([got["sx"], got["sy"], got["offset"]], [0.5, -0.25, 3], atol=1e-3) and got["inliers"] == by[1].inliers == 360
    assert fits.robust(df.limit(0), ["k"], "x", "y", "z").count() == 0
    df = spark.createDataFrame([(1, float(i % 7), float(i // 7), 0.5 * (i % 7) - 0.25 * (i // 7) + 3) for i in range(49)] + [(2, 1.0, float(i), 1.0) for i in range(9)], "k int, x double, y double, z double")
    by = {r.k: r for r in fits.ols(df, ["k"], "x", "y", "z").collect()}
    assert np.allclose([by[1].sx, by[1].sy, by[1].offset, by[1].rmse], [0.5, -0.25, 3, 0], atol=1e-7) and by[2].sx is None


def test_quad_mesh(spark):
    vertices = spark.createDataFrame([("m", i, x, y, z) for i, (x, y, z) in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (0.0, 1.0, 0.0), (2.0, 0.5, 0.6)])], "mesh string, vid long, x double, y double, z double")
    faces = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 0, 2, 3), ("m", 2, 1, 4, 2), ("m", 3, 1, 1, 2)], "mesh string, fid long, a long, b long, c long")
    geo = mesh.face_geometry(faces, vertices)
    assert {r.fid for r in geo.where("not valid").collect()} == {3}
    grouped = mesh.group_faces(mesh.roof_candidates(geo, "+Z", 60.0), 5.0)
    assert {r.fid: r.group for r in grouped.collect()} == {0: 0, 1: 0, 2: 2}
    planes = {r.group: r for r in mesh.fit_planes(grouped, vertices, "+Z").collect()}
    assert planes[0].faces == 2 and planes[0].vertices == 4 and abs(planes[0].area - 1) < 1e-9 and planes[0].rms < 1e-12 and planes[0].nz == 1
    assert {(r.group, r.vid) for r in mesh.boundary_vertices(grouped).collect()} >= {(0, 0), (0, 1), (0, 2), (0, 3)}


def test_quarter_turns_compose_to_identity(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    for name, back in (("x+90", "x-90"), ("y+90", "y-90"), ("z+90", "z-90")):
        there = mesh.rotate(df, [("x", "y", "z")], (0.5, 0.0, 1.0), [name]).drop("rotation")
        assert tuple(mesh.rotate(there, [("x", "y", "z")], (0.5, 0.0, 1.0), [back]).drop("rotation").first()) == (1.0, 2.0, 3.0)
    assert tuple(mesh.rotate(df, [("x", "y", "z")], (0, 0, 0), ["z+90"]).drop("rotation").first()) == (-2.0, 1.0, 3.0)


def test_watershed_covers_and_paths_connect():
    draw = np.random.default_rng(2)
    cost = draw.random((12, 15))
    markers = np.zeros((12, 15), np.int64)
    markers[2, 2], markers[9, 12] = 1, 2
    out = vector.flood(cost, markers, np.ones_like(cost, bool))
    assert set(np.unique(out)) == {1, 2} and out[2, 2] == 1 and out[9, 12] == 2
    path = vector.cheapest_path(cost, (0, 0), (11, 14))
    assert path[0] == (0, 0) and path[-1] == (11, 14) and all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(path, path[1:]))


def test_simplify_keeps_within_tolerance():
    draw = np.random.default_rng(5)
    points = np.column_stack([np.arange(200.0), np.cumsum(draw.normal(size=200))])
    kept = vector.simplify(points, 1.5)
    assert kept[0] == 0 and kept[-1] == 199
    for a, b in zip(kept, kept[1:]):
        along = points[b] - points[a]
        t = np.clip((points[a : b + 1] - points[a]) @ along / (along @ along), 0, 1)
        assert np.hypot(*(points[a : b + 1] - points[a] - t[:, None] * along).T).max() <= 1.5 + 1e-9


def test_broken_documents_are_refused(spark):
    df = spark.createDataFrame([('{"roof_planes": 5}',)], "t string")
    with pytest.raises(Exception):
        documents.parse(df, "t", documents.PLAN, "plan").collect()


def test_nearest_fill_leaves_no_hole(spark):
    draw = random.Random(3)
    wide = [[0] * 24 for _ in range(20)]
    for _ in range(7):
        wide[draw.randrange(20)][draw.randrange(24)] = draw.randint(1, 9)
    corner = [[0] * 5 for _ in range(4)]
    corner[3][3], corner[0][4] = 1, 2
    for rows, holed in ((wide, False), (wide, True), (corner, False)):
        px = grid(spark, rows).where("not (c between 3 and 15 and r > 4 and label = 0 and (r * 7 + c) % 3 = 0)" if holed else "true")
        told = [(r.r, r.c, r.label) for r in px.collect()]
        seen = [x for x in told if x[2]]
        want = {(r, c): v or min(((r - a) ** 2 + (c - b) ** 2, a, b, w) for a, b, w in seen)[3] for r, c, v in told}
        assert {(r.r, r.c): r.label for r in raster.nearest_fill(px, 3).collect()} == want
    assert raster.nearest_fill(grid(spark, [[0, 0]]), 3).where("label = 0").count() == 2


def test_components_of_a_whole_raster(spark):
    """Held against flood fill; regions cross every strip of ten rows."""
    draw = random.Random(4)
    rows = [[int(draw.random() < 0.45) for _ in range(12)] for _ in range(40)]
    px = grid(spark, rows).withColumns({"on": F.col("label") > 0, "pixel": F.col("r") * 12 + F.col("c")})
    for diagonal in (True, False):
        want = {}
        for r, c in [(r, c) for r in range(40) for c in range(12) if rows[r][c]]:
            todo = [(r, c)] if (r, c) not in want else []
            while todo:
                y, x = todo.pop()
                if 0 <= y < 40 and 0 <= x < 12 and rows[y][x] and (y, x) not in want:
                    want[y, x] = r * 12 + c
                    todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not (a and b)]
        assert {(p.r, p.c): p.component for p in graph.raster_components(px, "on", "pixel", diagonal).collect()} == want


def test_strips_are_gone(spark, sf_dir):
    from tessella.plans import catalogue

    n = catalogue.pixels(spark, sf_dir).count()
    steps = {r.route: r.steps for r in catalogue.QUERIES["routed_boundaries"](spark, sf_dir).collect()}
    assert steps[0] >= n // 64 and len(steps) > 1 and all(59 <= k for r, k in steps.items() if r)
    assert {r.image for r in catalogue.QUERIES["watershed_partition"](spark, sf_dir).collect()} == {"e"}
    assert [r.image for r in catalogue.QUERIES["small_region_merge"](spark, sf_dir).collect()] == ["e"]


def test_merge_small_agrees_with_whole_masks():
    for seed in range(20):
        draw = np.random.default_rng(seed)
        labels = graph.label_grid(draw.random((14, 11)) < 0.6, False)
        want, sizes = labels.copy(), np.bincount(labels.ravel())
        for label in sorted((i for i in range(1, len(sizes)) if 0 < sizes[i] < 4)):
            region = want == label
            if region.sum() >= 4:
                continue
            wide = np.zeros((16, 13), bool)
            for r, c in zip(*np.nonzero(region)):
                wide[r : r + 3, c : c + 3] = True
            ring = want[wide[1:-1, 1:-1] & ~region]
            ring = ring[ring > 0]
            if len(ring):
                want[region] = np.bincount(ring).argmax()
        assert (graph.merge_small(labels, 4) == want).all()


def test_joined_labels_and_points_stay_in_their_image(spark):
    px = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 2), ("b", 0, 0, 1), ("b", 0, 1, 2), (None, 0, 0, 2)], "image string, r long, c long, label long")
    got = graph.union_labels(px, spark.createDataFrame([("a", 1, 2)], "image string, a long, b long")).collect()
    assert sorted((r.image or "", r.c, r.label) for r in got) == [("", 0, 2), ("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("b", 1, 2)]
    points = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 0.5, 0.0), ("b", 1, 0.0, 0.0), ("b", 2, 9.0, 0.0)], "image string, id long, x double, y double")
    got = graph.cluster_points(points, 1.0, ["image"]).collect()
    assert sorted((r.image, r.id, r.root) for r in got) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("b", 2, 2)]
    assert graph.cluster_points(points.limit(0), 1.0, ["image"]).count() == 0


def test_hubs_meet_their_minimum(spark):
    edges = [(1, x) for x in range(2, 400)] + [(x, x + 1) for x in range(500, 560)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 1 for x in range(1, 400)} | {x: 500 for x in range(500, 561)}


def raster_of(spark, arrays, names, image="a"):
    h, w = arrays[0].shape
    rows = [(image, r, c, *(x[r, c].item() for x in arrays)) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, ["image", "r", "c", *names])


def test_two_meshes_stay_apart(spark):
    faces = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 1, 0, 2, 3), ("a", 2, 5, 6, 7), ("b", 0, 0, 1, 2), ("b", 1, 5, 6, 7), ("b", 2, 5, 7, 8)], "mesh string, fid long, a long, b long, c long")
    spots = [(0, 0), (1, 0), (1, 1), (0, 1), None, (5, 0), (6, 0), (6, 1), (5, 1)]
    vertices = spark.createDataFrame([(m, i, float(p[0]), float(p[1]), 0.0) for m in "ab" for i, p in enumerate(spots) if p], "mesh string, vid long, x double, y double, z double")
    grouped = mesh.group_faces(mesh.face_geometry(faces, vertices), 5.0)
    assert {(r.mesh, r.fid): r.group for r in grouped.collect()} == {("a", 0): 0, ("a", 1): 0, ("a", 2): 2, ("b", 0): 0, ("b", 1): 1, ("b", 2): 1}
    planes = mesh.fit_planes(grouped, vertices, "+Z")
    assert {(r.mesh, r.a, r.b) for r in mesh.coplanar_pairs(planes, 3.0, 0.05, 5.0).collect()} == {("a", 0, 2), ("b", 0, 1)}
    assert mesh.coplanar_pairs(planes, 3.0, 0.05, 1.0).count() == 0 and mesh.group_faces(mesh.face_geometry(faces.limit(0), vertices), 5.0).count() == 0


def test_coplanar_pairs_by_hand(spark):
    draw = np.random.default_rng(3)
    rows = []
    for g in range(120):
        n = np.array([0.0, 0.0, 1.0]) + draw.normal(0, 0.04, 3)
        n /= np.linalg.norm(n)
        rows.append(("m", g, *map(float, draw.normal(0, [8, 8, 0.1])), *map(float, n), float(draw.choice([0.1, 0.5, 6.0]))))
    planes = spark.createDataFrame(rows, "mesh string, group long, cx double, cy double, cz double, nx double, ny double, nz double, tangent_radius double")
    want = set()
    for _, g, *p in rows:
        for _, h, *q in rows:
            c, n, m = np.subtract(q[:3], p[:3]), np.array(p[3:6]), np.array(q[3:6])
            if g < h and n @ m >= np.cos(np.radians(3)) and min(abs(c @ n), abs(c @ m)) <= 0.05 and np.linalg.norm(c - n * (c @ n)) <= p[6] + q[6] + 0.5:
                want.add((g, h))
    got = [(r.a, r.b) for r in mesh.coplanar_pairs(planes, 3.0, 0.05, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_routes_are_told_apart(spark):
    draw = np.random.default_rng(4)
    e = draw.random((12, 14))
    may = draw.random((12, 14)) < 0.9
    px = raster_of(spark, [e, may], ["e", "may"]).unionByName(raster_of(spark, [draw.random((6, 6)), np.ones((6, 6), bool)], ["e", "may"], "b"))
    ends = [("a", 1, 0, 0, 11, 13), ("a", 2, 5, 1, 5, 9), ("b", 1, 0, 0, 5, 5), ("a", 3, 2, 2, 2, 2), ("a", 4, 0, 0, 40, 40)]
    got = {}
    for r in vector.route(px, "e", spark.createDataFrame(ends, "image string, route long, r0 long, c0 long, r1 long, c1 long"), margin=2, allowed="may").collect():
        got.setdefault((r.image, r.route), []).append((r.seq, r.r, r.c))
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("a", 3)}

    def cost_of(path, start, end):
        (y0, x0), (y1, x1) = start, end
        def at(r, c):
            t = np.clip(((c - x0) * (x1 - x0) + (r - y0) * (y1 - y0)) / max((x1 - x0) ** 2 + (y1 - y0) ** 2, 1), 0, 1)
            far = np.hypot(c - x0 - t * (x1 - x0), r - y0 - t * (y1 - y0))
            return 1 + 14 * (1 - e[r, c]) + 5 * min(far / 2, 2) + (0 if may[r, c] else 35)
        return sum((at(*p) + at(*q)) / 2 * np.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(path, path[1:])), at

    for _, route, r0, c0, r1, c1 in ends[:2]:
        path = [(r, c) for _, r, c in sorted(got["a", route])]
        assert path[0] == (r0, c0) and path[-1] == (r1, c1)
        found, at = cost_of(path, (r0, c0), (r1, c1))
        box = [(r, c) for r in range(max(0, min(r0, r1) - 2), min(12, max(r0, r1) + 3)) for c in range(max(0, min(c0, c1) - 2), min(14, max(c0, c1) + 3))]
        best = dict.fromkeys(box, np.inf) | {(r0, c0): 0.0}
        for _ in box:
            for r, c in box:
                for p in box:
                    if max(abs(p[0] - r), abs(p[1] - c)) == 1:
                        best[r, c] = min(best[r, c], best[p] + (at(r, c) + at(*p)) / 2 * np.hypot(p[0] - r, p[1] - c))
            if best[r1, c1] <= found + 1e-9:
                break
        assert abs(best[r1, c1] - found) < 1e-9


def test_nearest_by_hand(spark):
    draw = np.random.default_rng(6)
    value, ok, flag = draw.random((15, 18)), draw.random((15, 18)) < 0.04, draw.random((15, 18)) < 0.03
    ok[3, 4] = flag[9, 9] = True
    px = raster_of(spark, [value, ok, flag], ["v", "ok", "on"])
    spots, lit = np.argwhere(ok), np.argwhere(flag)
    got = {(r.r, r.c): r for r in raster.boundary_distance(raster.fill_invalid(px, "v", "ok"), "on", "far").collect()}
    for (r, c), row in got.items():
        d = ((spots - (r, c)) ** 2).sum(1)
        assert row.v == value[tuple(spots[d.argmin()])]
        assert abs(row.far - np.sqrt(((lit - (r, c)) ** 2).sum(1).min())) < 1e-9
    with pytest.raises(Exception, match="no valid pixel"):
        raster.fill_invalid(px.withColumn("ok", F.lit(False)), "v", "ok").collect()
    assert raster.boundary_distance(px.withColumn("on", F.lit(False)), "on", "far").where("far < 1e9").count() == 0


def test_intersections_split_into_components(spark):
    draw = np.random.default_rng(7)
    one, two = draw.integers(1, 3, (9, 10)), draw.integers(1, 3, (9, 10))
    px = raster_of(spark, [one, two], ["one", "two"]).withColumn("pixel", F.col("r") * 10 + F.col("c"))
    got = {(r.r, r.c): r.region for r in graph.intersection_partition(px, "one", "two", "pixel").collect()}
    want, n = {}, 0
    for a in (1, 2):
        for b in (1, 2):
            labels = graph.label_grid((one == a) & (two == b), False)
            for r, c in np.argwhere(labels):
                want[r, c] = n + labels[r, c]
            n += labels.max()
    assert got == want


def test_clusters_link_cells_and_not_all_pairs(spark):
    """A heap of copies is one place and a cell one node; the links that decide are still measured. Held against all pairs."""
    rng = random.Random(3)
    places = [(rng.uniform(-6, 6), rng.uniform(-6, 6)) for _ in range(150)]
    rows = [(im, 10 * i + j, *p) for im in "ab" for i, p in enumerate(places[: 150 if im == "a" else 60]) for j in range(3)]
    rows += [("a", 5000 + k, 0.25, 0.25) for k in range(3000)] + [("b", 6000, float("inf"), 0.0), ("b", 6001, float("inf"), 0.0), ("b", 6002, None, 0.0), ("b", 6003, float("nan"), 0.0)]
    rows += [("b", 6004, 3e14, 0.0), ("b", 6005, 3e14 + 0.5, 0.0), ("b", 6006, 3e14 + 9, 0.0), ("b", 6007, 50.0, 0.0), ("b", 6008, 51.0, 0.0), ("b", 6009, 60.0, 0.0), ("b", 6009, 52.5, 0.0), ("b", 6010, 60.0, 0.9)]
    points = spark.createDataFrame(rows, "image string, id long, x double, y double")
    root = {(im, i): i for im, i, *_ in rows}

    def find(im, i):
        while root[im, i] != i:
            i = root[im, i]
        return i

    once = sorted({(im, x, y): (im, i, x, y) for im, i, x, y in sorted(rows, key=repr, reverse=True) if i < 5001 or i >= 6000}.values(), key=repr)
    heap = find("a", 5000)
    for a in rows:
        if 5000 < a[1] < 6000:
            root["a", a[1]] = heap
    for im, i, x, y in [r for r in rows if r[1] <= 5000 or r[1] >= 6000]:
        for jm, j, x2, y2 in once:
            if im == jm and None not in (x, x2) and (x - x2) ** 2 + (y - y2) ** 2 <= 1.0:
                p, q = sorted((find(im, i), find(im, j)))
                root[im, q] = p
    got = graph.cluster_points(points, 1.0, ["image"])
    assert "FlatMap" not in got._jdf.queryExecution().toString()
    assert sorted((r.image, r.id, r.root) for r in got.collect()) == sorted((im, i, find(im, i)) for im, i, *_ in rows)


def test_quantiles_and_discs_need_no_buffer_of_an_image(spark):
    rng = random.Random(9)
    rows = [("a", r, c, rng.choice([rng.gauss(0, 1), 0.5, 1e9 * rng.random()]), rng.random() < 0.03) for r in range(90) for c in range(70) if (r, c) != (3, 3)]
    rows += [("b", 0, 0, 2.0, True), ("b", 0, 1, None, False), ("c", 0, 0, 1.0, None), ("c", 0, 1, 4.0, False)]
    px = spark.createDataFrame(rows, "image string, r long, c long, v double, on boolean").cache()
    for q in (0.0, 0.02, 0.62, 0.98, 1.0):
        want = {r.image: r.p for r in px.groupBy("image").agg(F.percentile("v", F.lit(q)).alias("p")).collect()}
        for width in (0.001, 0.0):
            assert {r.image: pytest.approx(r["__q"]) for r in raster.exact_quantile(px, "v", q, width).collect()} == want
    lit = [r[:3] for r in rows if r[4]]
    for most in (0.0, 1.5, 2.0, 3.2):
        want = {r[:3] for r in rows if any(r[0] == x[0] and (r[1] - x[1]) ** 2 + (r[2] - x[2]) ** 2 <= most * most for x in lit)}
        assert {(r.image, r.r, r.c) for r in raster.within(px, "on", most, "near").where("near").collect()} == want
    for df in (raster.supported_boundary(px, "on", "on", "v", 2.0, "ok"), raster.weighted_evidence(px, {"v": 1.0}, "e")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "Generate explode" not in plan
    px.unpersist()


def test_coplanar_pairs_deal_few_rows(spark):
    """Reaches of all sizes, far from 0, against all pairs; a plane makes few rows of the join."""
    draw = np.random.default_rng(5)
    rows = [("m", g, *map(float, draw.normal([900, -40, 3], [25, 25, 0.05])), 0.0, 0.0, 1.0, float(draw.choice([0.01, 0.4, 0.8, 1.1, 30.0], p=[0.2, 0.3, 0.3, 0.19, 0.01]))) for g in range(1500)]
    rows += [("m", 2000, float("nan"), 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), ("m", 2001, None, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)]
    planes = spark.createDataFrame(rows, "mesh string, group long, cx double, cy double, cz double, nx double, ny double, nz double, tangent_radius double")
    c, reach = np.array([r[2:5] for r in rows[:-2]]), np.array([r[8] for r in rows[:-2]])
    d = c[None] - c[:, None]
    ok = (abs(d[..., 2]) <= 0.05) & (np.hypot(d[..., 0], d[..., 1]) <= reach[:, None] + reach[None] + 0.5)
    found = mesh.coplanar_pairs(planes, 3.0, 0.05, 0.5)
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in np.argwhere(ok).tolist() if i < j}
    join = found._jdf.queryExecution().optimizedPlan()
    while "Join" not in join.nodeName():
        join = join.children().head()
    sides = [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(found.sparkSession._jsparkSession, join.children().apply(i)).count() for i in (0, 1)]
    assert sum(sides) < 15 * len(rows), sides
