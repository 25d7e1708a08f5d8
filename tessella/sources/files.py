"""Files as tables: PNG rasters, binary glTF meshes, run folders; and the sinks that write them.

Files are found and read by Spark (``binaryFile``) and decoded where they were read, one file in a call.
"""
from __future__ import annotations

import datetime as dt
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import ship

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # by colour type; palettes are refused
COMPONENT = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}


def decode_png(raw: bytes) -> np.ndarray:
    """Height x width x channels, 8 or 16 bits, not interlaced."""
    if raw[:8] != PNG_MAGIC:
        raise ValueError("not a PNG file")
    at, data, head = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw[at + 8 : at + 21])
        elif kind == b"IDAT":
            data.append(raw[at + 8 : at + 8 + size])
        at += size + 12
    w, h, depth, colour, _, _, interlace = head
    if depth not in (8, 16) or colour not in CHANNELS or interlace:
        raise ValueError(f"PNG with depth {depth}, colour type {colour}, interlace {interlace} is not supported")
    step = CHANNELS[colour] * depth // 8
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int32)
    for r in range(h):
        rule, line = lines[r, 0], lines[r, 1:].astype(np.int32)
        if rule == 1:
            line = line.reshape(w, step).cumsum(0).reshape(-1)
        elif rule == 2:
            line = line + above
        elif rule in (3, 4):
            for i in range(w * step):
                a, b = (line[i - step] & 255 if i >= step else 0), above[i]
                if rule == 3:
                    line[i] += (a + b) // 2
                else:
                    c = above[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    line[i] += a if pa <= pb and pa <= pc else (b if pb <= pc else c)
        above = line & 255
        out[r] = above
    return (out.view(">u2") if depth == 16 else out).reshape(h, w, CHANNELS[colour]).astype(np.int32)


def encode_png(grid: np.ndarray) -> bytes:
    """One channel: 8 bits if the largest value fits, else 16."""
    deep = int(grid.max(initial=0)) > 255
    rows = grid.astype(">u2" if deep else np.uint8)
    body = b"".join(b"\0" + line.tobytes() for line in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], 16 if deep else 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def decode_glb(raw: bytes) -> tuple[list[tuple], list[tuple]]:
    """Vertices (vid, x, y, z) in world space and faces (fid, a, b, c, object); objects in order of their names."""
    magic, version, _ = struct.unpack("<4sII", raw[:12])
    if magic != b"glTF" or version != 2:
        raise ValueError("not a binary glTF 2 file")
    at, doc, blob = 12, None, b""
    while at < len(raw):
        size, kind = struct.unpack("<I4s", raw[at : at + 8])
        part = raw[at + 8 : at + 8 + size]
        doc, blob = (json.loads(part), blob) if kind == b"JSON" else (doc, part if kind == b"BIN\0" else blob)
        at += 8 + size

    def accessor(i: int) -> np.ndarray:
        a = doc["accessors"][i]
        view = doc["bufferViews"][a["bufferView"]]
        kind, n = np.dtype(COMPONENT[a["componentType"]]), WIDTH[a["type"]]
        begin, stride = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", kind.itemsize * n)
        return np.stack([np.frombuffer(blob, kind, n, begin + k * stride) for k in range(a["count"])]) if a["count"] else np.zeros((0, n), kind)

    def local(node: dict) -> np.ndarray:
        if "matrix" in node:
            return np.array(node["matrix"], float).reshape(4, 4).T
        x, y, z, w = node.get("rotation", (0, 0, 0, 1))
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        out = np.eye(4)
        out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)))
        out[:3, 3] = node.get("translation", (0, 0, 0))
        return out

    nodes, found = doc.get("nodes", []), []
    children = {c for n in nodes for c in n.get("children", ())}
    work = [(i, np.eye(4)) for i in range(len(nodes)) if i not in children]
    while work:
        i, parent = work.pop()
        world = parent @ local(nodes[i])
        work += [(c, world) for c in nodes[i].get("children", ())]
        if "mesh" in nodes[i]:
            found.append((nodes[i].get("name", f"node{i}"), i, world, doc["meshes"][nodes[i]["mesh"]]))
    if not found:
        raise ValueError("the file holds no mesh")
    vertices, faces = [], []
    for name, _, world, mesh in sorted(found, key=lambda f: f[:2]):
        for prim in mesh["primitives"]:
            if prim.get("mode", 4) != 4:
                continue
            xyz = accessor(prim["attributes"]["POSITION"]).astype(float) @ world[:3, :3].T + world[:3, 3]
            index = accessor(prim["indices"]).reshape(-1).astype(int) if "indices" in prim else np.arange(len(xyz))
            base = len(vertices)
            vertices += [(base + k, *map(float, p)) for k, p in enumerate(xyz)]
            faces += [(len(faces) + k, *(int(v) + base for v in t), name) for k, t in enumerate(index[: len(index) // 3 * 3].reshape(-1, 3))]
    return vertices, faces


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """image (path), r, c, values (array of channels)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part["path"], part["content"]):
                grid = decode_png(raw)
                h, w, _ = grid.shape
                yield pd.DataFrame({"image": name, "r": np.repeat(np.arange(h), w), "c": np.tile(np.arange(w), h), "values": list(grid.reshape(h * w, -1))})

    return _binary(spark, path, "*.png").mapInPandas(run, "image string, r long, c int, values array<int>")


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """Pixels above 0 of the first channel."""
    return read_png(spark, path).where(F.col("values")[0] > 0).select("image", "r", "c")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label map; more than one channel is an error."""
    one = F.when(F.size("values") == 1, F.col("values")[0]).otherwise(F.raise_error(F.lit("a label map has one channel")).cast("int"))
    return read_png(spark, path).select("image", "r", "c", one.alias("label"))


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """Relative depth: the first channel by the image's largest value, as it is where that is 0."""
    px = read_png(spark, path).select("image", "r", "c", F.col("values")[0].cast("double").alias("d"))
    most = px.groupBy("image").agg(F.max("d").alias("most"))
    return px.join(most, "image").select("image", "r", "c", F.when(F.col("most") > 0, F.col("d") / F.col("most")).otherwise(F.col("d")).alias("depth"))


def read_glb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """faces (mesh, fid, a, b, c, object) and vertices (mesh, vid, x, y, z)."""
    raw = _binary(spark, path, "*.glb")

    def part_of(k: int, columns: list[str]):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for name, content in zip(part["path"], part["content"]):
                    yield pd.DataFrame(decode_glb(content)[k], columns=columns).assign(mesh=name)[["mesh", *columns]]

        return run

    faces = raw.mapInPandas(part_of(1, ["fid", "a", "b", "c", "object"]), "mesh string, fid long, a long, b long, c long, object string")
    return faces, raw.mapInPandas(part_of(0, ["vid", "x", "y", "z"]), "mesh string, vid long, x double, y double, z double")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes and SHA-256 of files, for manifests."""
    return _binary(spark, path, pattern).select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def label_pngs(px: DataFrame) -> DataFrame:
    """(image, r, c, label) to (image, png): a picture for each image."""
    ship(px.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(part["r"].max()) + 1, int(part["c"].max()) + 1), np.int64)
        grid[part["r"], part["c"]] = part["label"]
        return pd.DataFrame({"image": [part["image"].iloc[0]], "png": [encode_png(grid)]})

    return px.select("image", "r", "c", "label").groupBy("image").applyInPandas(run, "image string, png binary")


def run_name(experiment: str, now: dt.datetime) -> str:
    """A folder name from the experiment and the time in UTC."""
    slug = re.sub(r"[^a-z0-9]+", "_", experiment.lower()).strip("_")
    return f"{slug}/{now.astimezone(dt.timezone.utc):%Y%m%dT%H%M%S_%fZ}"


def save(df: DataFrame, root: str, experiment: str, name: str, now: dt.datetime, by: list[str] | None = None) -> str:
    """Write a run's table; a folder that is there already is an error."""
    path = f"{root.rstrip('/')}/{run_name(experiment, now)}/{name}"
    (df.write.mode("errorifexists").partitionBy(*by) if by else df.write.mode("errorifexists")).parquet(path)
    return path
