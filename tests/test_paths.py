"""Paths, matchings and target components against plain versions."""
import itertools
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.operators import graph, paths, raster, vector


def test_assignment_is_the_best_of_all():
    draw = np.random.default_rng(1)
    for rows, columns in [(1, 1), (2, 5), (5, 2), (4, 4), (3, 6), (6, 5)] * 8:
        score = np.round(draw.random((rows, columns)) * (draw.random((rows, columns)) < 0.6), 2)
        pairs = graph.assignment(score)
        few, many = min(rows, columns), max(rows, columns)
        best = max(sum(score[(i, c) if rows <= columns else (c, i)] for i, c in enumerate(p)) for p in itertools.permutations(range(many), few))
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs) == few
        assert math.isclose(sum(score[p] for p in pairs), best, abs_tol=1e-9)


def test_labels_are_matched_image_by_image(spark):
    rows = [(i, 0, c, a, b) for i, one, two in (("x", [1, 1, 1, 2, 2, 3], [7, 7, 8, 8, 8, 0]), ("y", [5, 5, 0], [0, 0, 0])) for c, (a, b) in enumerate(zip(one, two))]
    px = spark.createDataFrame(rows, "image string, r long, c int, one int, two int")
    got = {tuple(r) for r in graph.matched_labels(raster.label_iou(px, "one", "two"), px, "one", "two").collect()}
    assert {(i, a, b, round(v, 6)) for i, a, b, v in got} == {("x", 1, 7, round(2 / 3, 6)), ("x", 2, 8, round(2 / 3, 6))}
    assert graph.matched_labels(raster.label_iou(px.limit(0), "one", "two"), px.limit(0), "one", "two").count() == 0


def test_target_component_and_center(spark):
    on = np.random.default_rng(4).random((12, 20)) < 0.45
    labels = graph.label_grid(on, True)
    px = spark.createDataFrame([("i", r, c, r * 20 + c, bool(on[r, c])) for r in range(12) for c in range(20)], "image string, r long, c int, pixel long, on boolean")
    spots = {k: np.argwhere(labels == k) for k in range(1, labels.max() + 1)}
    for r, c in ((3.2, 7.0), (0.0, 0.0), (-4.0, 40.0), (11.0, 10.0)):
        here = labels[min(max(round(r), 0), 11), min(max(round(c), 0), 19)]
        want = here or min(spots, key=lambda k: (round(float(((spots[k].mean(0) - (r, c)) ** 2).sum()), 9), spots[k].min(0).tolist()))
        got = {(x.r, x.c) for x in graph.target_component(px, "on", "pixel", r, c, least=1).collect()}
        assert got == {tuple(p) for p in spots[want].tolist()}, (r, c)
    with pytest.raises(Exception, match="less than 1000 pixels"):
        graph.target_component(px, "on", "pixel", 3.0, 7.0, least=1000).collect()
    assert graph.target_component(px.withColumn("on", F.lit(False)), "on", "pixel", 3.0, 7.0).count() == 0
    middle = raster.mask_center(px, F.col("on")).first()
    assert np.allclose([middle.y, middle.x], np.argwhere(on).mean(0))


def wide(mask, steps):
    for _ in range(steps):
        out = mask.copy()
        out[1:] |= mask[:-1]
        out[:-1] |= mask[1:]
        out[:, 1:] |= mask[:, :-1]
        out[:, :-1] |= mask[:, 1:]
        mask = out
    return mask


def by_hand(found, lines, evidence, mask, angle, distance, strength, radius):
    """The whole optimiser for one image, over lists."""
    foot = lambda p, q: q[:2] + (q[2:] - q[:2]) * ((p - q[:2]) @ (q[2:] - q[:2])) / ((q[2:] - q[:2]) @ (q[2:] - q[:2]))
    moved = {}
    for key, pts in found.items():
        feet = [[] for _ in pts]
        for i, (a, b) in enumerate(zip(pts, pts[1:])):
            if np.hypot(*(b - a)) < 3:
                continue
            ranked = []
            for n, q in enumerate(lines):
                turn = abs(math.atan2(*(b - a)[::-1]) % math.pi - math.atan2(*(q[2:] - q[:2])[::-1]) % math.pi)
                turn, off = math.degrees(min(turn, math.pi - turn)), np.hypot(*(foot((a + b) / 2, q) - (a + b) / 2))
                if turn <= angle and off <= distance:
                    ranked.append((turn / max(angle, 1) + off / max(distance, 1), n))
            if ranked:
                for k in (i, i + 1):
                    feet[k].append(foot(pts[k], lines[min(ranked)[1]]))
        moved[key] = [p if not f else (1 - strength) * p + strength * np.mean(f, 0) for p, f in zip(pts, feet)]
    ends = [(k, i) for k in moved if len(moved[k]) > 1 for i in (0, len(moved[k]) - 1)]
    left, allowed, h, w = set(ends), wide(mask, 5), *mask.shape
    places, n_junctions = {}, 0
    while left:
        group, work = [], [left.pop()]
        while work:
            k, i = work.pop()
            group.append((k, i))
            near = {e for e in left if np.hypot(*(moved[e[0]][e[1]] - moved[k][i])) <= radius}
            left -= near
            work += near
        if len(group) > 1:
            n_junctions += 1
            m, reach = np.mean([moved[k][i] for k, i in group], 0), max(3, round(radius / 2))
            x, y = round(m[0]), round(m[1])
            near = [(-(evidence[r, c] - 0.025 * math.hypot(c - m[0], r - m[1])), r, c) for r in range(max(0, y - reach), min(h, y + reach + 1)) for c in range(max(0, x - reach), min(w, x + reach + 1)) if allowed[r, c]]
            put = min(near)[:0:-1] if near else (min(max(x, 0), w - 1), min(max(y, 0), h - 1))
            places.update(dict.fromkeys(group, put))
    out = {}
    for k, pts in moved.items():
        path = []
        for i, p in enumerate(pts):
            x, y = places.get((k, i), p)
            x, y = min(max(round(x), 0), w - 1), min(max(round(y), 0), h - 1)
            if not allowed[y, x]:
                y, x = min(np.argwhere(allowed).tolist(), key=lambda q: ((q[0] - y) ** 2 + (q[1] - x) ** 2, q))
            if not path or path[-1] != (x, y):
                path.append((x, y))
        if len(path) > 1:
            out[k] = path
    return out, n_junctions


def test_paths_are_optimised_as_by_hand(spark):
    draw = np.random.default_rng(9)
    pixels, corners, lines, want = [], [], [], {}
    for image in ("a", "b"):
        evidence, mask = draw.random((40, 50)), np.zeros((40, 50), bool)
        mask[8:30, 10:38] = draw.random((22, 28)) < 0.2
        found = {k: draw.uniform((-2, -2), (52, 42), (int(draw.integers(1, 6)), 2)) for k in range(14)}
        found[0] = np.array([(12.0, 12.0), (12.4, 12.2), (12.1, 12.0)])
        found[1] = np.array([(12.5, 13.0), (30.0, 20.0)])
        here = np.array([(*p, *q) for p, q in draw.uniform(0, 40, (6, 2, 2))])
        want[image], n = by_hand(found, here, evidence, mask, 35.0, 12.0, 0.7, 4.0)
        want[image, "n"] = n
        pixels += [(image, r, c, float(evidence[r, c]), bool(mask[r, c])) for r in range(40) for c in range(50)]
        corners += [(image, k, i, float(x), float(y)) for k, pts in found.items() for i, (x, y) in enumerate(pts)]
        lines += [(image, n, *map(float, q)) for n, q in enumerate(here)]
    px = spark.createDataFrame(pixels, "image string, r long, c int, e double, m boolean")
    corners = spark.createDataFrame(corners, "image string, id long, pos int, x double, y double")
    lines = spark.createDataFrame(lines, "image string, line_id int, lx1 double, ly1 double, lx2 double, ly2 double")
    out, junctions = paths.optimise(corners, lines, px, "e", F.col("m"), 35.0, 12.0, 0.7, 4.0)
    got = {}
    for x in sorted(out.collect(), key=lambda x: x.pos):
        got.setdefault(x.image, {}).setdefault(x.id, []).append((x.x, x.y))
    met = {x.image: x["n"] for x in junctions.groupBy("image").agg(F.count(F.lit(1)).alias("n")).collect()}
    for image in ("a", "b"):
        assert got[image] == want[image] and met.get(image, 0) == want[image, "n"] > 0
    assert paths.optimise(corners.limit(0), lines, px, "e", F.col("m"), 35.0, 12.0, 0.7, 4.0)[0].count() == 0


def test_nearest_lines_of_many(spark):
    """Lines that cross the image in all directions, or have no length, against all pairs."""
    draw = np.random.default_rng(12)
    segments = [("i", k, x, y, x + float(dx), y + float(dy)) for k, (x, y, dx, dy) in enumerate(zip(*draw.uniform([[0], [-400]], [[40], [900]], (2, 400)).tolist(), *draw.normal(0, 6, (2, 400))))]
    lines = [("i", k, *map(float, np.append(p, p + d))) for k, (p, d) in enumerate(zip(draw.uniform([-60, -500], [90, 1000], (150, 2)), draw.normal(0, 1, (150, 2)) * draw.choice([1e-3, 1, 500], (150, 1))))]
    lines += [("i", 150, 3.0, 5.0, 9.0, 5.0), ("i", 151, 4.0, 900.0, 4.0, -3.0), ("i", 152, 7.0, 7.0, 7.0, 7.0), ("i", 149, 800.0, 7.0, 800.0, 7.0), ("j", 1, 0.0, 0.0, 5.0, 5.0), ("i", 153, None, 0.0, 1.0, 1.0), ("i", 154, float("inf"), 0.0, 1.0, 1.0)]
    segments += [("j", 1, 0.0, 0.0, 4.0, 4.1), ("k", 1, 0.0, 0.0, 4.0, 4.0), ("i", 900, 0.0, 0.0, float("nan"), 4.0)]
    a = spark.createDataFrame(segments, "image string, id long, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame(lines, "image string, line_id long, lx1 double, ly1 double, lx2 double, ly2 double")
    for angle, distance in ((20.0, 15.0), (8.0, 0.4), (90.0, 3000.0), (180.0, 0.0)):
        best = {}
        for i, n, x1, y1, x2, y2 in segments:
            for j, m, *q in lines:
                if i != j or None in q or not np.isfinite([x1, y1, x2, y2, *q]).all() or (x2 - x1) ** 2 + (y2 - y1) ** 2 < 9:
                    continue
                dx, dy, mx, my = q[2] - q[0], q[3] - q[1], (x1 + x2) / 2, (y1 + y2) / 2
                turn = (math.degrees(math.atan2(y2 - y1, x2 - x1)) - math.degrees(math.atan2(dy, dx))) % 180
                turn, off = min(turn, 180 - turn), abs((mx - q[0]) * dy - (my - q[1]) * dx) / math.hypot(dx, dy) if dx or dy else 0.0
                if turn <= angle and off <= distance:
                    best[i, n] = min(best.get((i, n), (9e9, 0)), (turn / max(angle, 1) + off / max(distance, 1), m))
        got = {(x.image, x.id): (x.line_id, x.score) for x in vector.nearest_lines(a, b, angle, distance).collect()}
        assert got.keys() == best.keys() and len(got) > 20
        assert all(got[k][0] == best[k][1] and math.isclose(got[k][1], best[k][0], abs_tol=1e-6) for k in got)


def test_segments_meet_only_near_lines(spark):
    rows = spark.range(5000).select(F.lit("i").alias("image"), "id", F.lit(0.0).alias("x1"), F.col("id").cast("double").alias("y1"), F.lit(8.0).alias("x2"), F.col("id").cast("double").alias("y2"))
    lines = rows.where("id % 40 = 0").toDF("image", "line_id", "lx1", "ly1", "lx2", "ly2")
    assert vector._near_lines(rows, lines, 6.0).count() < 5 * 5000


def test_far_holes_do_not_read_a_column_again_for_each(spark):
    """A frame from the current row to the end of a column makes Spark go through the rest of it for every row."""
    holes = spark.createDataFrame([("i", r, 0) for r in range(0, 60, 7)], "image string, r long, c long")
    seen = spark.createDataFrame([("i", r, c, r) for r, c in ((3, 1), (17, 1), (17, 5), (40, 5), (53, 1))], "image string, r2 long, c2 long, found long")
    far = raster._fill_far(holes, seen)
    assert "unboundedfollowing" not in far._jdf.queryExecution().toString().lower()
    want = {r: min(((r - r2) ** 2 + c2**2, r2, c2) for r2, c2 in ((3, 1), (17, 1), (17, 5), (40, 5), (53, 1)))[:2] for r in range(0, 60, 7)}
    assert {x.r: (x["__d"], x["__f"]) for x in far.collect()} == want


def test_corners_meet_the_mask_however_far(spark):
    """Near, far and very far from the mask, with ties, missing pixels, and an image without a mask, against all pairs."""
    draw, steps = np.random.default_rng(21), 2
    shape, on = (60, 90), {"a": [(9, 20), (9, 21), (9, 22), (30, 20), (12, 55), (12, 57), (33, 3), (0, 21), (59, 40)], "b": [], "c": [tuple(p) for p in draw.integers((0, 0), (60, 90), (60, 2)).tolist()]}
    there = {image: draw.random(shape) < 0.8 for image in on}
    for image in on:
        there[image][-1, -1] = True
    pixels = [(image, r, c, (r, c) in on[image]) for image in on for r, c in np.argwhere(there[image]).tolist()]
    corners = [(image, k, i, float(x), float(y)) for image in on for k in range(80) for i, (x, y) in enumerate(draw.integers((-3, -3), (94, 64), (2, 2)).tolist())]
    want = {}
    for image, k, i, x, y in corners:
        mask = np.array([p for p in on[image] if there[image][p]], int).reshape(-1, 2)
        r, c = min(max(round(y), 0), 59), min(max(round(x), 0), 89)
        near = np.zeros(shape, bool)
        near[tuple(mask.T)] = True
        near = wide(near, steps)
        seen = np.argwhere(near & there[image]).tolist()
        if not near[r, c] and seen:
            r, c = min(seen, key=lambda q: ((q[0] - r) ** 2 + (q[1] - c) ** 2, q))
        want[image, k, i] = (c, r)
    want = {(image, k, i): p for (image, k, i), p in want.items() if want[image, k, 0] != want[image, k, 1]}
    px = spark.createDataFrame(pixels, "image string, r long, c int, m boolean")
    out = paths.on_mask(spark.createDataFrame(corners, "image string, id long, pos int, x double, y double"), px, F.col("m"), steps)
    assert {(x.image, x.id, x.pos): (x.x, x.y) for x in out.collect()} == want and len(want) > 300
