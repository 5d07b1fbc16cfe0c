"""Tiled 3D models: tile trees, b3dm and GLB containers as frames, and the writers that put them together again.

Files are listed and read by Spark (`binaryFile`); each is decoded in the task that reads it. Frames follow the layout
of sedge.operators.mesh: tiles, primitives, vertices and triangles.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: component types with their sizes, element types with their widths.
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}
SCALES = {5120: 127.0, 5121: 255.0, 5122: 32767.0, 5123: 65535.0, 5125: 4294967295.0}
TILES = "tile_id bigint, parent_id bigint, ord int, depth int, transform array<double>, box array<double>, sphere array<double>, uri string, geometric_error double, refine string"
VERTICES = "path string, mesh int, prim int, v bigint, x double, y double, z double, batch_id bigint"
TRIANGLES = "path string, mesh int, prim int, tri bigint, i0 bigint, i1 bigint, i2 bigint"
IDENTITY = [float(k % 5 == 0) for k in range(16)]


def flatten_tree(root: dict) -> list[tuple]:
    """Rows of a tile tree, numbered before their children in order."""
    out: list[tuple] = []
    todo = [(root, None, 0, 0)]
    while todo:
        tile, parent, order, depth = todo.pop()
        at, volume, content = len(out), tile.get("boundingVolume") or {}, tile.get("content") or {}
        error = tile.get("geometricError")
        out.append((at, parent, order, depth, [float(x) for x in tile.get("transform") or IDENTITY], volume.get("box") and [float(x) for x in volume["box"]], volume.get("sphere") and [float(x) for x in volume["sphere"]], content.get("uri") or content.get("url"), None if error is None else float(error), tile.get("refine")))
        todo += [(c, at, k, depth + 1) for k, c in reversed(list(enumerate(tile.get("children") or [])))]
    return out


def read_tileset(spark: SparkSession, path: str, with_path: bool = False) -> DataFrame:
    """The tile trees of tileset files; a tree has no fixed schema, so a task flattens it. with_path adds the file."""

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in TILES.split(", ")]
        for batch in batches:
            for file, text in zip(batch["path"], batch["value"], strict=True):
                found = pd.DataFrame(flatten_tree(json.loads(text).get("root") or {}), columns=names)
                yield found.astype({"parent_id": "Int64", "tile_id": "int64"}).assign(path=file)

    read = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInPandas(flatten, TILES + ", path string")
    return read if with_path else read.drop("path")


def tileset_json(tiles: list[dict], geometric_error: float) -> str:
    """A tileset file of rows with the columns of TILES."""
    nodes: dict = {}
    for t in sorted(tiles, key=lambda t: t["tile_id"]):
        node = {"boundingVolume": {"box": list(t["box"])} if t["box"] else {"sphere": list(t["sphere"] or [0, 0, 0, 0])}, "geometricError": t["geometric_error"] or 0.0}
        if t["transform"] and list(t["transform"]) != IDENTITY:
            node["transform"] = list(t["transform"])
        node |= {k: v for k, v in (("refine", t["refine"]), ("content", t["uri"] and {"uri": t["uri"]})) if v}
        nodes[t["tile_id"]] = node
    root = None
    for t in sorted(tiles, key=lambda t: (t["ord"] or 0, t["tile_id"])):
        if t["parent_id"] is None or pd.isna(t["parent_id"]):
            root = nodes[t["tile_id"]]
        else:
            nodes[t["parent_id"]].setdefault("children", []).append(nodes[t["tile_id"]])
    return json.dumps({"asset": {"version": "1.0"}, "geometricError": geometric_error, "root": root}, indent=2) + "\n"


def split_b3dm(data: bytes) -> tuple[dict, dict, bytes]:
    """Feature table, batch table and the model inside a b3dm container."""
    if data[:4] != b"b3dm" or len(data) < 28:
        raise ValueError("not a b3dm container")
    _, version, _, fj, fb, bj, bb = struct.unpack_from("<4s6I", data)
    if version != 1:
        raise ValueError(f"b3dm version {version}")
    at = 28
    feature, batch = data[at : at + fj], data[at + fj + fb : at + fj + fb + bj]
    start = at + fj + fb + bj + bb
    if data[start : start + 4] != b"glTF":
        start = data.find(b"glTF", at)
        if start < 0:
            raise ValueError("no model in the container")
    return json.loads(feature or b"{}"), json.loads(batch or b"{}"), data[start:]


def split_glb(data: bytes) -> tuple[dict, bytes]:
    """JSON and binary chunk of a GLB container, version 2."""
    magic, version, total = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2:
        raise ValueError("not a GLB container of version 2")
    at, chunks = 12, {}
    while at + 8 <= min(total, len(data)):
        size, kind = struct.unpack_from("<I4s", data, at)
        chunks.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size
    if b"JSON" not in chunks or b"BIN\0" not in chunks:
        raise ValueError("a GLB container needs a JSON and a BIN chunk")
    return json.loads(chunks[b"JSON"]), chunks[b"BIN\0"]


def accessor(gltf: dict, binary: bytes, number: int) -> np.ndarray:
    """Values of an accessor, rows by component; strides are honoured and normalised integers become fractions."""
    a = gltf["accessors"][number]
    view = gltf["bufferViews"][a["bufferView"]]
    kind, width = np.dtype(COMPONENTS[a["componentType"]]), WIDTHS[a["type"]]
    start, stride = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride") or kind.itemsize * width
    values = np.ndarray((a["count"], width), kind, binary, start, (stride, kind.itemsize)).astype(np.float64 if a["componentType"] == 5126 or a.get("normalized") else np.int64)
    return np.maximum(values / SCALES[a["componentType"]], -1.0) if a.get("normalized") and a["componentType"] != 5126 else values


def primitives(data: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """mesh, primitive, positions, triangle corners and batch ids of the triangle primitives of a b3dm or GLB file."""
    gltf, binary = split_glb(split_b3dm(data)[2] if data[:4] == b"b3dm" else data)
    for m, mesh in enumerate(gltf.get("meshes") or []):
        for p, primitive in enumerate(mesh.get("primitives") or []):
            names = primitive.get("attributes") or {}
            if primitive.get("mode", 4) != 4 or "POSITION" not in names:
                continue
            at = accessor(gltf, binary, names["POSITION"])
            corner = accessor(gltf, binary, primitive["indices"])[:, 0] if "indices" in primitive else np.arange(len(at))
            batch = names.get("_BATCHID", names.get("_FEATURE_ID_0"))
            ids = np.full(len(at), -1) if batch is None else accessor(gltf, binary, batch)[:, 0]
            yield m, p, at, corner[: len(corner) // 3 * 3].reshape(-1, 3), ids.astype(np.int64)


def _decoded(files: DataFrame, schema: str, rows) -> DataFrame:
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                for m, p, at, corner, ids in primitives(bytes(data)):
                    yield rows(path, m, p, at, corner, ids)

    return files.select("path", "content").mapInPandas(decode, schema)


def read_files(spark: SparkSession, path: str, least_bytes: int = 0) -> DataFrame:
    """Model files; those below least_bytes are left out by their listed length, before they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") >= least_bytes)


def vertices(files: DataFrame) -> DataFrame:
    return _decoded(files, VERTICES, lambda path, m, p, at, corner, ids: pd.DataFrame({"path": path, "mesh": m, "prim": p, "v": np.arange(len(at)), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "batch_id": ids}))


def triangles(files: DataFrame) -> DataFrame:
    return _decoded(files, TRIANGLES, lambda path, m, p, at, corner, ids: pd.DataFrame({"path": path, "mesh": m, "prim": p, "tri": np.arange(len(corner)), "i0": corner[:, 0], "i1": corner[:, 1], "i2": corner[:, 2]}))


def _padded(data: bytes, fill: bytes, to: int = 4) -> bytes:
    return data + fill * (-len(data) % to)


def glb_of(positions: np.ndarray, corner: np.ndarray | None, mode: int | None = None) -> bytes:
    """A GLB file of one primitive; indices are as narrow as they can be, or absent, and so is the mode."""
    kind = 5123 if len(positions) <= 65535 else 5125
    index = b"" if corner is None else _padded(corner.astype(COMPONENTS[kind]).tobytes(), b"\0")
    points = positions.astype("<f4").tobytes()
    views = [{"buffer": 0, "byteOffset": len(index), "byteLength": len(points), "target": 34962}]
    values = [{"bufferView": 0, "componentType": 5126, "count": len(positions), "type": "VEC3", "min": positions.min(0).tolist(), "max": positions.max(0).tolist()}]
    primitive: dict = {"attributes": {"POSITION": 0}} | ({} if mode is None else {"mode": mode})
    if corner is not None:
        views.append({"buffer": 0, "byteOffset": 0, "byteLength": corner.size * int(COMPONENTS[kind][2]), "target": 34963})
        values.append({"bufferView": 1, "componentType": kind, "count": int(corner.size), "type": "SCALAR"})
        primitive["indices"] = 1
    gltf = {
        "asset": {"version": "2.0"}, "buffers": [{"byteLength": len(index) + len(points)}], "bufferViews": views, "accessors": values,
        "meshes": [{"primitives": [primitive]}], "nodes": [{"mesh": 0}], "scenes": [{"nodes": [0]}], "scene": 0,
    }
    text, binary = _padded(json.dumps(gltf).encode(), b" "), _padded(index + points, b"\0")
    chunks = struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(binary), b"BIN\0") + binary
    return struct.pack("<4sII", b"glTF", 2, 12 + len(chunks)) + chunks


def _save(path: str, name: str, pieces: list[bytes]) -> None:
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    system.create_dir(inside, recursive=True)
    with system.open_output_stream(f"{inside}/{name}", compression=None) as out:
        for piece in pieces:
            out.write(piece)


def write_models(files: DataFrame, path: str) -> None:
    """Rows of name and content as files of a folder. A task that runs again writes the same names."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                _save(path, name, [bytes(content)])
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("name", "content").mapInPandas(save, "n bigint").agg(F.sum("n")).collect()


def b3dm_of(model: bytes, batch_length: int = 0, batch_table: dict | None = None) -> bytes:
    feature = _padded(json.dumps({"BATCH_LENGTH": batch_length}).encode(), b" ", 8)
    feature += b" " * (-(28 + len(feature)) % 8)
    batch = _padded(json.dumps(batch_table).encode(), b" ", 8) if batch_table else b""
    model = _padded(model, b"\0", 8)
    return struct.pack("<4s6I", b"b3dm", 1, 28 + len(feature) + len(batch) + len(model), len(feature), 0, len(batch), 0) + feature + batch + model


def remap_indices(value, numbers: dict[int, int]):
    """A material with the texture numbers of all its slots, at any depth, replaced."""
    if isinstance(value, list):
        return [remap_indices(x, numbers) for x in value]
    if not isinstance(value, dict):
        return value
    return {k: {**remap_indices(x, numbers), "index": numbers[x["index"]]} if k.endswith("Texture") and isinstance(x, dict) and x.get("index") in numbers else remap_indices(x, numbers) for k, x in value.items()}


PLY_FIELDS = ("x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")


def write_ply(points: DataFrame, path: str) -> None:
    """Points (columns PLY_FIELDS) as binary PLY files, one per task, each with its own header; tasks write no driver memory."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b.to_numpy("<f4").tobytes() for b in batches if len(b)]
        if parts:
            count = sum(map(len, parts)) // (4 * len(PLY_FIELDS))
            head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {count}", *(f"property float {f}" for f in PLY_FIELDS), "end_header", ""])
            # Named by its partition: a task that runs again replaces its file.
            _save(path, f"part-{TaskContext.get().partitionId():05d}.ply", [head.encode(), *parts])
            yield pd.DataFrame({"n": [count]})

    points.select(*[F.col(f).cast("float") for f in PLY_FIELDS]).mapInPandas(save, "n bigint").agg(F.sum("n")).collect()


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of an 8-bit RGB image that is not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("only 8-bit RGB without interlacing")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + 3 * width)
    out = np.zeros((height, 3 * width), np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros(3 * width, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) % 256
        else:
            for x in range(3 * width):
                left, corner = (out[y, x - 3], up[x - 3]) if x >= 3 else (0, 0)
                guess = left if kind == 1 else (left + up[x]) // 2 if kind == 3 else min((left, up[x], corner), key=lambda v, e=left + up[x] - corner: abs(e - v))
                out[y, x] = (line[x] + guess) % 256
    return out.reshape(height, width, 3).astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def scale_png(data: bytes, ratio: float) -> bytes:
    """The image made smaller: each new pixel is the mean of the box that it covers."""
    pixels = decode_png(data).astype(float)
    h, w = (max(1, int(n * ratio)) for n in pixels.shape[:2])
    rows, columns = (np.minimum(np.arange(n + 1) * m // n, m) for n, m in ((h, pixels.shape[0]), (w, pixels.shape[1])))
    sums = np.add.reduceat(np.add.reduceat(pixels, rows[:-1], axis=0), columns[:-1], axis=1)
    area = np.diff(rows)[:, None, None] * np.diff(columns)[None, :, None]
    return encode_png(np.floor(sums / area + 0.5).astype(np.uint8))
