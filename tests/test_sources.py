import datetime as dt
import json
import struct

import numpy as np
import pytest

from tessella.sources import files


def glb(doc, blob):
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def triangle():
    points = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], "<f4").tobytes()
    index = np.array([0, 1, 2], "<u2").tobytes() + b"\0\0"
    doc = {
        "nodes": [{"name": "b", "mesh": 0, "translation": [0, 0, 5]}, {"name": "a", "children": [2]}, {"name": "a1", "mesh": 0, "scale": [2, 2, 2]}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}],
        "bufferViews": [{"byteOffset": 0, "byteLength": 36}, {"byteOffset": 36, "byteLength": 6}],
    }
    return glb(doc, points + index)


@pytest.mark.parametrize("top", [3, 255, 256, 65535])
def test_png_round_trip(spark, tmp_path, top):
    grid = np.random.default_rng(top).integers(0, top + 1, (7, 9))
    grid[0, 0] = top
    assert (files.decode_png(files.encode_png(grid))[:, :, 0] == grid).all()
    (tmp_path / "x.png").write_bytes(files.encode_png(grid))
    got = files.read_labels(spark, str(tmp_path)).collect()
    assert {(r.r, r.c): r.label for r in got} == {(r, c): grid[r, c] for r in range(7) for c in range(9)}
    assert files.read_mask(spark, str(tmp_path)).count() == (grid > 0).sum()
    assert files.read_depth(spark, str(tmp_path)).agg({"depth": "max"}).first()[0] == 1.0


def test_glb(spark, tmp_path):
    (tmp_path / "m.glb").write_bytes(triangle())
    faces, vertices = files.read_glb(spark, str(tmp_path))
    assert sorted((r.fid, r.a, r.b, r.c, r.object) for r in faces.collect()) == [(0, 0, 1, 2, "a1"), (1, 3, 4, 5, "b")]
    assert sorted((r.vid, r.x, r.y, r.z) for r in vertices.collect()) == [(0, 0, 0, 0), (1, 2, 0, 0), (2, 0, 2, 0), (3, 0, 0, 5), (4, 1, 0, 5), (5, 0, 1, 5)]
    with pytest.raises(ValueError):
        files.decode_glb(b"nope" + bytes(20))


def test_runs(spark, tmp_path):
    now = dt.datetime(2024, 5, 6, 7, 8, 9, 10, dt.timezone.utc)
    assert files.run_name("Roof planes!", now) == "roof_planes/20240506T070809_000010Z"
    df = spark.range(3)
    path = files.save(df, str(tmp_path), "x", "t", now)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        files.save(df, str(tmp_path), "x", "t", now)
    assert files.file_hashes(spark, path, "*.parquet").count() >= 1
