import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.operators import mesh, tiles
from sedge.sources import config, tiles3d, xlsx


def test_workbook_round_trip(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx.workbook([("First", ["k", "v<>"], [["x", 1], [None, "a&b"], [None, None]]), ("Second", ["q"], [["z"]])]))
    rows = xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert {(r["sheet"], r["row_no"], tuple(sorted(r["cells"].items()))) for r in rows.collect()} == {("First", 1, (("k", "x"), ("v<>", "1"))), ("First", 2, (("v<>", "a&b"),)), ("Second", 1, (("q", "z"),))}
    assert xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx"), 0).count() == 2
    assert xlsx.sheet_frame(rows, "Second").first()["q"] == "z"


def test_workbooks_written_by_tasks(spark, tmp_path):
    t = spark.createDataFrame([("b", [("S", ["h"], ["1"])])], "book string, sheets array<struct<name:string,header:array<string>,values:array<string>>>")
    xlsx.write_xlsx(t, str(tmp_path / "out"))
    assert xlsx.read_xlsx(spark, str(tmp_path / "out" / "b.xlsx")).first()["cells"] == {"h": "1"}


def test_column_letters():
    assert [xlsx.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(xlsx.column_number(xlsx.column_letters(n) + "1") == n for n in range(0, 1500, 7))


SQUARE = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], float), np.array([[0, 1, 2], [0, 2, 3]])


def test_b3dm_decodes_to_frames(spark, tmp_path):
    (tmp_path / "m.b3dm").write_bytes(tiles3d.b3dm_of(tiles3d.glb_of(*SQUARE), 1, {"name": ["a"]}))
    files = tiles3d.read_files(spark, str(tmp_path))
    v, t = tiles3d.vertices(files), tiles3d.triangles(files)
    assert sorted((r["v"], r["x"], r["y"]) for r in v.collect()) == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)]
    placed = mesh.with_positions(t.drop("path", "mesh", "prim"), v)
    assert [round(r["area"], 6) for r in mesh.measured(placed).collect()] == [0.5, 0.5]
    feature, batch, _ = tiles3d.split_b3dm((tmp_path / "m.b3dm").read_bytes())
    assert feature == {"BATCH_LENGTH": 1} and batch == {"name": ["a"]}
    assert tiles3d.read_files(spark, str(tmp_path), 1 << 20).isEmpty()


def test_bad_containers():
    with pytest.raises(ValueError):
        tiles3d.split_b3dm(b"nope" + b"\0" * 40)
    text = b'{"a":1} '
    with pytest.raises(ValueError):
        tiles3d.split_glb(struct.pack("<4sII", b"glTF", 2, 20 + len(text)) + struct.pack("<I4s", len(text), b"JSON") + text)


def test_accessor_with_stride_and_normalised_values():
    gltf = {"accessors": [{"bufferView": 0, "componentType": 5123, "count": 2, "type": "SCALAR"}, {"bufferView": 1, "componentType": 5120, "count": 2, "type": "SCALAR", "normalized": True}], "bufferViews": [{"byteStride": 4}, {"byteOffset": 8}]}
    data = struct.pack("<HHHH", 7, 0, 9, 0) + struct.pack("<bb", -128, 127)
    assert tiles3d.accessor(gltf, data, 0)[:, 0].tolist() == [7, 9]
    assert tiles3d.accessor(gltf, data, 1)[:, 0].tolist() == [-1.0, 1.0]


def test_tileset_round_trip(spark, tmp_path):
    move = [float(x) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 2, 3, 4, 1)]
    tree = {"root": {"boundingVolume": {"box": [0.0] * 12}, "geometricError": 8, "transform": move, "children": [{"boundingVolume": {"sphere": [0, 0, 0, 1]}, "geometricError": 1, "content": {"url": "a.b3dm"}, "transform": move}, {"boundingVolume": {"box": [1.0] * 12}, "geometricError": 0}]}}
    (tmp_path / "tileset.json").write_text(json.dumps(tree))
    found = tiles3d.read_tileset(spark, str(tmp_path / "tileset.json"))
    rows = {r["tile_id"]: r for r in found.collect()}
    assert [(r["parent_id"], r["ord"], r["uri"]) for r in rows.values()] == [(None, 0, None), (0, 0, "a.b3dm"), (0, 1, None)]
    world = {r["tile_id"]: r["world"] for r in tiles.world_transforms(found).collect()}
    assert world[1][12:15] == [4.0, 6.0, 8.0] and world[2][12:15] == [2.0, 3.0, 4.0]
    again = json.loads(tiles3d.tileset_json([r.asDict() for r in rows.values()], 8.0))
    assert again["root"]["children"][0]["content"] == {"uri": "a.b3dm"} and len(again["root"]["children"]) == 2


def test_ply_files_hold_all_points(spark, tmp_path):
    points = spark.range(10).selectExpr(*[f"cast(id as float) AS {f}" for f in tiles3d.PLY_FIELDS])
    tiles3d.write_ply(points, str(tmp_path / "ply"))
    total = 0
    for f in (tmp_path / "ply").glob("*.ply"):
        head, _, body = f.read_bytes().partition(b"end_header\n")
        n = int(head.split(b"element vertex ")[1].split()[0])
        assert len(body) == n * 4 * len(tiles3d.PLY_FIELDS)
        total += n
    assert total == 10


@pytest.mark.parametrize("kind", range(5))
def test_png_row_filters(kind):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (4, 5, 3), np.uint8)
    raw = b""
    for y in range(4):
        line, up = pixels[y].reshape(-1).astype(int), (pixels[y - 1].reshape(-1).astype(int) if y else np.zeros(15, int))
        left, corner = np.concatenate((np.zeros(3, int), line[:-3])), np.concatenate((np.zeros(3, int), up[:-3]))
        paeth = np.array([min((a, b, c), key=lambda v, e=a + b - c: abs(e - v)) for a, b, c in zip(left, up, corner)])
        guess = [np.zeros(15, int), left, up, (left + up) // 2, paeth][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (tiles3d.decode_png(data) == pixels).all()
    assert (tiles3d.decode_png(tiles3d.encode_png(pixels)) == pixels).all()


def test_png_scaling_takes_means():
    pixels = np.zeros((4, 4, 3), np.uint8)
    pixels[:2, :2] = 100
    assert tiles3d.decode_png(tiles3d.scale_png(tiles3d.encode_png(pixels), 0.5))[:, :, 0].tolist() == [[100, 0], [0, 0]]


def test_config_and_history(spark, tmp_path):
    (tmp_path / "c").write_text("# note\na: 1\nb: 'x y'\n")
    assert config.load_config(str(tmp_path / "c")) == {"a": 1, "b": "x y"}
    (tmp_path / "bad").write_text("- item")
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path / "bad"))
    (tmp_path / "empty").write_text("\n")
    assert config.load_config(str(tmp_path / "empty")) == {}
    none = config.read_history(spark, str(tmp_path / "missing"))
    assert none.isEmpty()
    more = spark.range(70).selectExpr("cast(id as string) id", "'p' project", "'b' build_type", "'ok' status", "timestamp_ntz'2026-01-01' + make_interval(0,0,0,cast(id as int)) started_at", "'m' message")
    assert config.append_history(none, more).agg({"started_at": "min"}).first()[0].isoformat() == "2026-01-21T00:00:00"


def test_texture_numbers_are_replaced_at_any_depth():
    material = {"pbr": {"baseColorTexture": {"index": 0, "texCoord": 1}}, "normalTexture": {"index": 2}, "list": [{"emissiveTexture": {"index": 9}}], "index": 0}
    assert tiles3d.remap_indices(material, {0: 5, 2: 6}) == {"pbr": {"baseColorTexture": {"index": 5, "texCoord": 1}}, "normalTexture": {"index": 6}, "list": [{"emissiveTexture": {"index": 9}}], "index": 0}


def test_nested_configuration_round_trip(tmp_path, monkeypatch):
    nested = {"git": {"name": "a"}, "projects": [{"name": "x", "to": ["p@q", "r@s"], "spaces": []}, {"name": "ä", "to": None}], "n": 3}
    config.save_config(nested, str(tmp_path / "new" / "c.yaml"))
    assert config.load_config(str(tmp_path / "new" / "c.yaml")) == nested
    for text in ("- a\n- b\n", "a: [1\n"):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(ValueError):
            config.load_config(str(tmp_path / "bad"))
    monkeypatch.setattr(config, "yaml", None)
    (tmp_path / "flat").write_text("a: 1 # one\nb: 'x'\n")
    assert config.load_config(str(tmp_path / "flat")) == {"a": "1", "b": "x"}
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path / "new" / "c.yaml"))


def test_points_written_again_replace_themselves(spark, tmp_path):
    points = spark.range(10, numPartitions=3).select(*[F.lit(1.0).alias(c) for c in tiles3d.PLY_FIELDS])
    for _ in range(2):
        tiles3d.write_ply(points, str(tmp_path / "ply"))
    assert len(list((tmp_path / "ply").glob("*.ply"))) == 3
