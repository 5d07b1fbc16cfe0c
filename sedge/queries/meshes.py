"""Queries of mesh analytics and transformation, over meshes made of the embeddings table."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import materials
from ..functions.text import color_from_name
from ..operators import mesh as M
from ..operators.ordinals import lower_ranks, running_cap
from ..plans import reports
from ..session import table
from ..sources import tiles3d
from ..storage import shared_dir

EPSILON = 10.0


def vertices(spark, sf_dir):
    """A vertex per vector: three of its numbers as coordinates, its label as file."""
    x = [f"cast(embedding[{k}] as double) * 100 AS {c}" for k, c in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS v", "label AS file_id", *x)


def triangles(spark, sf_dir):
    """A strip over all vertices."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS tri", "vec_id AS i0", "vec_id + 1 AS i1", "vec_id + 2 AS i2", "label AS file_id")
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("top"))
    return e.join(F.broadcast(last), F.col("i2") <= F.col("top")).drop("top")


def placed(spark, sf_dir):
    return M.with_positions(triangles(spark, sf_dir), vertices(spark, sf_dir))


def mesh_triangles(spark, sf_dir):
    shift = F.array(*[F.lit(float(c)) for c in (0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0, 5, -7, 2, 1)])
    found = M.with_positions(triangles(spark, sf_dir), vertices(spark, sf_dir), shift)
    return found.select("tri", "file_id", *[F.round(F.col(f"p{k}")[j], 6).alias(f"p{k}{c}") for k in range(3) for j, c in enumerate("xyz")])


def mesh_quality(spark, sf_dir):
    return M.quality(M.measured(placed(spark, sf_dir)), edges=(30.0, 50.0), aspects=(3.0, 5.0), area=10.0)


def mesh_bbox(spark, sf_dir):
    found = M.bounds(vertices(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def mesh_percentiles(spark, sf_dir):
    found = M.measured(placed(spark, sf_dir))
    out = None
    for name in ("longest", "aspect"):
        part = lower_ranks(found, name, list(M.MESH_QUANTILES)).select(F.lit(name).alias("measure"), "q", F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def mesh_dup_faces(spark, sf_dir):
    return M.duplicate_faces(placed(spark, sf_dir), EPSILON)


def mesh_edge_sharing(spark, sf_dir):
    return M.edge_sharing(placed(spark, sf_dir), EPSILON)


def mesh_top_files(spark, sf_dir):
    f = M.measured(placed(spark, sf_dir)).groupBy("file_id").agg(F.count("*").alias("triangles"), F.round(F.max("longest"), 6).alias("max_edge"), F.count_if(F.col("aspect") > 3).alias("slim"))
    return f.orderBy(F.desc("triangles"), "file_id").limit(8)


def shell_faces(spark, sf_dir):
    return M.shell(placed(spark, sf_dir), EPSILON).select("tri", "file_id")


def decimate(spark, sf_dir):
    return M.decimate(triangles(spark, sf_dir), 0.25).select("tri")


def stride_sample(spark, sf_dir):
    return M.every(triangles(spark, sf_dir), 3).select("tri")


def splat_counts(spark, sf_dir):
    area = M.measured(placed(spark, sf_dir)).select("tri", F.round("area", 6).alias("area"))
    return area.select("tri", F.least(F.greatest(F.ceil(F.col("area") * 0.08), F.lit(1)), F.lit(20)).cast("bigint").alias("n"))


def splat_cap(spark, sf_dir):
    return running_cap(splat_counts(spark, sf_dir), "n", 700, "tri").select("tri", "n", F.col("granted").cast("bigint").alias("granted"))


def _clustered(spark, sf_dir):
    return M.clustered(triangles(spark, sf_dir).drop("file_id"), vertices(spark, sf_dir), 25.0, (-100.0, -100.0, -100.0), "file_id")


def vertex_cluster(spark, sf_dir):
    return M.cluster_vertices(_clustered(spark, sf_dir), "file_id")


def vertex_cluster_tris(spark, sf_dir):
    return M.cluster_triangles(_clustered(spark, sf_dir))


def vertex_dedup(spark, sf_dir):
    """Vertices that are equal on a coarse grid are one; they are numbered by first reference."""
    near = vertices(spark, sf_dir).select("v", *[G.half_up(F.col(c) / 20).cast("bigint").alias(c) for c in "xyz"])
    refs = M.corners(triangles(spark, sf_dir)).join(near, "v")
    return M.renumber(refs, ["x", "y", "z"], "tri", "corner")


def index_compact(spark, sf_dir):
    """References of every fifth triangle, renumbered by first use."""
    refs = M.corners(triangles(spark, sf_dir).where("tri % 5 = 0"))
    return M.renumber(refs, ["v"], "tri", "corner")


def index_narrow(spark, sf_dir):
    """Accessors made of order lines: an index view per line."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.count("*").alias("c"))
    a = a.selectExpr("l_orderkey AS file_id", "l_linenumber AS accessor", "l_linenumber div 2 AS buffer_view", "CASE WHEN p % 5 = 0 THEN 5123 ELSE 5125 END AS component_type", "CASE WHEN p % 7 = 0 THEN 'VEC3' ELSE 'SCALAR' END AS type", "c * 3 AS count", "CASE WHEN s % 4 = 0 THEN 12 END AS byte_stride", "CASE WHEN s % 3 = 0 THEN 0L END AS byte_offset", "CASE p % 3 WHEN 0 THEN 34963 WHEN 1 THEN 34962 END AS target", "p * 97 AS max_index")
    return M.narrow_candidates(a)


def content_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.content_ids(d, F.col("text")).select("doc_id", "digest", F.col("content_id").cast("bigint").alias("content_id"))


def merge_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS prim", "4 + p_size % 2 AS mode", "p_brand AS material", "substr(p_type, 1, 4) AS layout", "p_size * 3L AS vertex_count")
    return M.merge_groups(p, ["mode", "material", "layout"], F.col("mode") == 4, "prim")


def batch_offset(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", "cast(c_custkey % 13 as bigint) AS batch_length")
    return M.offsets(c, "c_nationkey", "c_custkey", "batch_length")


def batch_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey AS feature", "c_name AS name", "c_mktsegment AS segment")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS feature", "s_name AS name", "s_nationkey AS nation")
    return a.unionByName(b, allowMissingColumns=True)


def box_downsample(spark, sf_dir):
    px = table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 64 AS px", "l_suppkey % 48 AS py", "cast(l_quantity as bigint) % 256 AS value")
    return M.box_downsample(px, 4)


def hash_random(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.select("o_orderkey", F.round(G.mixed_fraction(F.lit(1), F.col("o_orderkey"), F.col("o_custkey")), 9).alias("r"))


def splat_points(spark, sf_dir):
    s = M.splats(placed(spark, sf_dir))
    return s.select("tri", F.col("s").cast("bigint").alias("s"), *[F.round(F.col("position")[k], 5).alias(c) for k, c in enumerate("xyz")])


def splat_attrs(spark, sf_dir):
    s = M.splats(placed(spark, sf_dir)).where("s = 0")
    size = F.sqrt(sum(F.col("rotation")[k] * F.col("rotation")[k] for k in range(4)))
    return s.select("tri", *[F.round(F.col("normal")[k], 5).alias(f"n{c}") for k, c in enumerate("xyz")], *[F.round(F.col("scales")[k], 5).alias(f"scale_{k}") for k in range(3)], F.round("opacity", 6).alias("opacity"), F.round(size, 6).alias("rotation_norm"))


def color_avg(spark, sf_dir):
    c = [F.array(*[((F.col("tri") * (7 + 5 * k) + 31 * j) % 256) for j in range(4)]) for k in range(3)]
    return triangles(spark, sf_dir).select("tri", *[G.average_color(c)[j].alias(n) for j, n in enumerate("rgba")])


def color_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, '_', p_size, '_', p_partkey % 400, '_7') WHEN 1 THEN concat('tex_', p_partkey % 256, '_1_2_', p_size) ELSE concat(p_name, '_1_2') END AS name")
    return p.select("p_partkey", "name", *[color_from_name(F.col("name"))[k].alias(c) for k, c in enumerate("rgba")])


def material_rewrite(spark, sf_dir):
    """Materials as JSON, made opaque, single-sided and of one colour."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "to_json(named_struct('name', p_brand, 'doubleSided', p_size % 2 = 0, 'alphaMode', IF(p_size % 3 = 0, 'BLEND', 'OPAQUE'), 'baseColorTexture', p_size)) AS material")
    m = F.from_json("material", "name string, doubleSided boolean, alphaMode string, baseColorTexture int")
    solid = F.struct(m["name"].alias("name"), F.lit("OPAQUE").alias("alphaMode"), F.lit(False).alias("doubleSided"), F.array(*map(F.lit, (0.72, 0.68, 0.55, 1.0))).alias("baseColorFactor"))
    return p.select("p_partkey", F.to_json(solid).alias("material"))


def material_view(spark, sf_dir):
    """Materials with textures in some slots, extensions, and fields that no rewrite knows."""
    slot = lambda name, k: f"IF(p_partkey % {k} = 0, concat(',\"{name}\":{{\"index\":', p_size, ',\"extensions\":{{\"KHR_texture_transform\":{{\"scale\":[2,2]}}}}}}'), '')"
    text = f"""concat('{{"name":"', p_brand, '","extras":{{"size":', p_size, '}}', IF(p_size % 3 = 0, ',"alphaMode":"BLEND","alphaCutoff":0.25', ''), IF(p_size % 2 = 0, ',"doubleSided":false', ''),
        ',"pbrMetallicRoughness":{{"metallicFactor":1', {slot("baseColorTexture", 2)}, '}}', {slot("normalTexture", 3)}, {slot("emissiveTexture", 5)}, IF(p_size % 7 = 0, ',"extensions":{{"KHR_materials_ior":{{"ior":1.5}}}}', ''), '}}')"""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE {text} END AS material")


def material_modes(spark, sf_dir):
    """What each way of rewriting leaves of a material."""
    color, out = (0.72, 0.68, 0.55, 1.0), None
    ways = {"solid": lambda m: materials.solid(m, color), "unlit": materials.unlit, "opaque": lambda m: materials.opaque(m, color), "flat": lambda m: materials.opaque(m, color, keep_sides=True, keep_textures=True, lit=False)}
    for name, way in ways.items():
        told = lambda path: F.get_json_object("after", f"$.{path}")
        found = material_view(spark, sf_dir).select("p_partkey", "material", way(F.col("material")).alias("after")).select(
            "p_partkey", F.lit(name).alias("way"), told("name").alias("name"), told("extras.size").alias("size"), told("alphaMode").alias("alpha"), told("doubleSided").alias("sides"), told("pbrMetallicRoughness.baseColorFactor").alias("color"),
            told("pbrMetallicRoughness.metallicFactor").alias("metallic"), told("extensions").alias("extensions"), told("normalTexture.extensions.KHR_texture_transform.scale").alias("normal_scale"), materials.textures_removed(F.col("material")).alias("filled"), materials.textures_removed(F.col("after")).alias("left_over"))
        out = found if out is None else out.unionByName(found)
    return out


def color_chain(spark, sf_dir):
    """A colour for each part: of its corners, of its material, of its image's name, or grey."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 4 = 0 THEN array(p_size, p_partkey % 256, 7, 255) END AS c0", "CASE WHEN p_partkey % 8 <> 4 THEN array(p_size + 1, 9, p_partkey % 200, 255) END AS c1", "array(250, 3, p_size, 128) AS c2",
        "CASE p_partkey % 5 WHEN 1 THEN array(0.5D, p_size / 50D, 1.5D) WHEN 2 THEN array(-0.1D, 0.25D, 0.75D, 0.5D) END AS base", "CASE WHEN p_partkey % 3 = 0 THEN concat('roof_', p_size, '_', p_partkey % 300, '_9') WHEN p_partkey % 3 = 1 THEN 'roof' END AS image")
    found = G.primitive_color([F.col("c0"), F.col("c1"), F.col("c2")], F.col("base"), color_from_name(F.col("image")))
    return p.select("p_partkey", *[found[k].alias(c) for k, c in enumerate("rgba")])


MODEL_ROWS = 50


def model_scan(spark, sf_dir):
    """Triangles of model files that are made of the vectors, 50 to a file: every third file has indices, every third none,
    and every third holds lines, which are no triangles."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, number = rows.sort_values("v")[["x", "y", "z"]].to_numpy(float), int(key[0])
        strip = np.arange(max(0, len(at) - 2))[:, None] + np.arange(3)
        model = tiles3d.glb_of(at, strip if number % 3 == 0 else None, {1: None, 2: 1}.get(number % 3, 4))
        return pd.DataFrame({"name": [f"{number}.b3dm" if number % 2 else f"{number}.glb"], "content": [tiles3d.b3dm_of(model) if number % 2 else model]})

    path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    tiles3d.write_models(vertices(spark, sf_dir).withColumn("file", F.expr(f"v div {MODEL_ROWS}")).groupBy("file").applyInPandas(build, "name string, content binary"), path)
    files = tiles3d.read_files(spark, path)
    corner, at = tiles3d.triangles(files), tiles3d.vertices(files)
    met = corner.join(at.select("path", F.col("v").alias("i0"), F.round("x", 3).alias("x0")), ["path", "i0"])
    return met.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("file"), "tri", "i0", "i1", "i2", "x0")


def sum_pair(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_suppkey")).alias("total"))


def chunk_fold(spark, sf_dir):
    return M.chunk_fold(triangles(spark, sf_dir), "file_id", 60)


def edge_collapse(spark, sf_dir):
    return M.edge_collapse(placed(spark, sf_dir), "file_id", 0.7)


def cache_reorder(spark, sf_dir):
    return M.reorder(triangles(spark, sf_dir), "file_id")


def mesh_report(spark, sf_dir):
    found = reports.mesh_report(triangles(spark, sf_dir), vertices(spark, sf_dir), EPSILON, edges=(30.0, 50.0), aspects=(3.0, 5.0), area=10.0)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def retile_parts(spark, sf_dir):
    found = reports.retile(placed(spark, sf_dir), most_triangles=50, most_parts=9)
    return found.groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("triangles"), F.min("tri").alias("first_tri"))


def splat_cloud(spark, sf_dir):
    return reports.capped_splats(placed(spark, sf_dir), 1000).select("tri", F.col("s").cast("bigint").alias("s"))


QUERIES = {f.__name__: f for f in (mesh_triangles, mesh_quality, mesh_bbox, mesh_percentiles, mesh_dup_faces, mesh_edge_sharing, mesh_top_files, shell_faces, decimate, stride_sample, splat_cap, vertex_cluster, vertex_cluster_tris, vertex_dedup, index_compact, index_narrow, content_dedup, merge_groups, batch_offset, batch_union, box_downsample, hash_random, splat_points, splat_attrs, color_avg, color_chain, material_rewrite, material_modes, model_scan, sum_pair, chunk_fold, edge_collapse, cache_reorder, mesh_report, retile_parts, splat_cloud)} | {"color_from_name": color_names}

_V = "v AS (SELECT vec_id AS v, label AS file_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings)"
_T = f"{_V}, t AS (SELECT a.v AS tri, a.file_id, a.v AS i0, a.v + 1 AS i1, a.v + 2 AS i2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM v a JOIN v b ON b.v = a.v + 1 JOIN v c ON c.v = a.v + 2)"
_D = "sqrt((x{0} - x{1}) * (x{0} - x{1}) + (y{0} - y{1}) * (y{0} - y{1}) + (z{0} - z{1}) * (z{0} - z{1}))"
_M = f"""{_T}, n AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM t),
m AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS twice, sqrt(nx * nx + ny * ny + nz * nz) / 2 AS area, greatest({_D.format(0, 1)}, {_D.format(1, 2)}, {_D.format(2, 0)}) AS longest, greatest({_D.format(0, 1)}, {_D.format(1, 2)}, {_D.format(2, 0)}) / greatest(least({_D.format(0, 1)}, {_D.format(1, 2)}, {_D.format(2, 0)}), 1e-12) AS aspect FROM n)"""
_K = "CAST(floor(x{0} / 10 + 0.5) AS BIGINT) || ',' || CAST(floor(y{0} / 10 + 0.5) AS BIGINT) || ',' || CAST(floor(z{0} / 10 + 0.5) AS BIGINT)"
_F = f"{_T}, k AS (SELECT tri, file_id, {_K.format(0)} AS a, {_K.format(1)} AS b, {_K.format(2)} AS c FROM t), f AS (SELECT tri, file_id, array_to_string(list_sort([a, b, c]), '|') AS face FROM k)"
_C = f"""{_T}, r AS (SELECT tri, u.corner, u.v FROM t, unnest([{{'corner': 0, 'v': i0}}, {{'corner': 1, 'v': i1}}, {{'corner': 2, 'v': i2}}]) AS w(u)),
q AS (SELECT r.*, x, y, z, file_id, CAST(floor((x + 100) / 25) AS BIGINT) AS cx, CAST(floor((y + 100) / 25) AS BIGINT) AS cy, CAST(floor((z + 100) / 25) AS BIGINT) AS cz FROM r JOIN v USING (v))"""
_LOW = 4294967295


def _times(x: str, k: int) -> str:
    return f"((({x} & 65535) * {k} + (((({x} >> 16) * {k}) & 65535) << 16)) & {_LOW})"


def _mix(seed: str, a: str, b: str, name: str) -> str:
    """Select items that leave the fraction under `name`."""
    start = f"(xor(xor(xor(CAST({seed} AS BIGINT), {G.MIX_START}), {_times(f'(CAST({a} AS BIGINT) + 1)', G.MIX_A)}), {_times(f'(CAST({b} AS BIGINT) + 1)', G.MIX_B)}) & {_LOW}) AS {name}0"
    return f"{start}, xor({name}0, {name}0 >> 16) AS {name}1, {_times(f'{name}1', G.MIX_1)} AS {name}2, xor({name}2, {name}2 >> 15) AS {name}3, {_times(f'{name}3', G.MIX_2)} AS {name}4, xor({name}4, {name}4 >> 16) / 4294967296.0::DOUBLE AS {name}"


_S = f"""{_M}, c AS (SELECT tri, x0, y0, z0, x1 - x0 AS ax, y1 - y0 AS ay, z1 - z0 AS az, x2 - x0 AS bx, y2 - y0 AS qy, z2 - z0 AS bz, nx / twice AS nx, ny / twice AS ny, nz / twice AS nz,
    unnest(range(CAST(least(greatest(ceil(twice * 0.5 * 0.08::DOUBLE), 1), 20) AS BIGINT))) AS s FROM m WHERE twice > 1e-12),
h AS (SELECT *, {_mix('1', 'tri', 's * 2', 'ra')}, {_mix('1', 'tri', 's * 2 + 1', 'rb')} FROM c),
g AS (SELECT *, CASE WHEN ra + rb > 1 THEN 1 - ra ELSE ra END AS r, CASE WHEN ra + rb > 1 THEN 1 - rb ELSE rb END AS w FROM h)"""
_QUANTILES = ", ".join(f"({q})" for q in M.MESH_QUANTILES)
ORACLE = {
    "mesh_triangles": f"WITH {_T} SELECT tri, file_id, " + ", ".join(f"round(-y{k} + 5, 6) AS p{k}x, round(x{k} - 7, 6) AS p{k}y, round(z{k} + 2, 6) AS p{k}z" for k in range(3)) + " FROM t",
    "mesh_quality": f"WITH {_M} SELECT count(*) AS triangles, count(*) FILTER (WHERE longest > 30) AS edge_over_1, count(*) FILTER (WHERE longest > 50) AS edge_over_2, count(*) FILTER (WHERE aspect > 3) AS aspect_over_1, count(*) FILTER (WHERE aspect > 5) AS aspect_over_2, count(*) FILTER (WHERE area < 10) AS degenerate, round(max(longest), 6) AS max_edge, round(max(aspect), 6) AS max_aspect FROM m",
    "mesh_bbox": f"WITH {_V} SELECT " + ", ".join(f"round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}, round(max({c}) - min({c}), 6) AS span_{c}" for c in "xyz") + " FROM v",
    "mesh_percentiles": f"""WITH {_M}, l AS (SELECT 'longest' AS measure, longest AS value FROM m UNION ALL SELECT 'aspect', aspect FROM m), s AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY measure) AS n FROM l)
SELECT measure, CAST(q AS DOUBLE) AS q, round(value, 6) AS value FROM s, (VALUES {_QUANTILES}) w(q) WHERE k = CAST(floor((n - 1) * CAST(q AS DOUBLE)) AS BIGINT)""",
    "mesh_dup_faces": f"WITH {_F}, n AS (SELECT face, count(*) AS n FROM f GROUP BY face) SELECT CAST(sum(n) AS BIGINT) AS faces, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(coalesce(sum(least(n, 3)) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_faces, count(*) > 15000000 AS keys_over_limit FROM n",
    "mesh_edge_sharing": f"WITH {_F}, e AS (SELECT array_to_string(list_sort([a, b]), '|') AS e FROM k UNION ALL SELECT array_to_string(list_sort([b, c]), '|') FROM k UNION ALL SELECT array_to_string(list_sort([c, a]), '|') FROM k), n AS (SELECT e, count(*) AS n FROM e GROUP BY e) SELECT count(*) AS edges, count(*) FILTER (WHERE n = 1) AS boundary, count(*) FILTER (WHERE n = 2) AS manifold, count(*) FILTER (WHERE n > 2) AS non_manifold FROM n",
    "mesh_top_files": f"WITH {_M} SELECT file_id, count(*) AS triangles, round(max(longest), 6) AS max_edge, count(*) FILTER (WHERE aspect > 3) AS slim FROM m GROUP BY file_id ORDER BY triangles DESC, file_id LIMIT 8",
    "shell_faces": f"WITH {_F} SELECT tri, file_id FROM f QUALIFY count(*) OVER (PARTITION BY face) = 1",
    "decimate": f"WITH {_T}, s AS (SELECT tri, row_number() OVER (ORDER BY tri) - 1 AS k, count(*) OVER () AS n FROM t), g AS (SELECT max(n) AS n, CAST(greatest(1, floor(max(n) * 0.25)) AS BIGINT) AS m FROM s) SELECT s.tri FROM s, g WHERE s.k IN (SELECT (i * g2.n) // g2.m FROM (SELECT n, m, unnest(range(m)) AS i FROM g) g2)",
    "stride_sample": f"WITH {_T} SELECT tri FROM t QUALIFY (row_number() OVER (ORDER BY tri) - 1) % 3 = 0",
    "splat_cap": f"WITH {_M}, sc AS (SELECT tri, CAST(least(greatest(ceil(round(area, 6) * 0.08::DOUBLE), 1), 20) AS BIGINT) AS n FROM m), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY tri ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sc) SELECT tri, n, CAST(least(n, 700 - b) AS BIGINT) AS granted FROM w WHERE b < 700",
    "vertex_cluster": f"WITH {_C} SELECT cx, cy, cz, file_id, count(*) AS n_refs, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, arg_min(v, tri * 3 + corner) AS representative FROM q GROUP BY cx, cy, cz, file_id",
    "vertex_cluster_tris": f"WITH {_C}, p AS (SELECT tri, max(CASE WHEN corner = 0 THEN cx || ',' || cy || ',' || cz END) AS k0, max(CASE WHEN corner = 1 THEN cx || ',' || cy || ',' || cz END) AS k1, max(CASE WHEN corner = 2 THEN cx || ',' || cy || ',' || cz END) AS k2 FROM q GROUP BY tri) SELECT * FROM p WHERE k0 <> k1 AND k1 <> k2 AND k0 <> k2",
    "vertex_dedup": f"WITH {_C}, p AS (SELECT CAST(floor(x / 20 + 0.5) AS BIGINT) AS x, CAST(floor(y / 20 + 0.5) AS BIGINT) AS y, CAST(floor(z / 20 + 0.5) AS BIGINT) AS z, min(tri * 3 + corner) AS o FROM q GROUP BY 1, 2, 3) SELECT x, y, z, row_number() OVER (ORDER BY o) - 1 AS new_index FROM p",
    "index_compact": f"WITH {_C}, p AS (SELECT v, min(tri * 3 + corner) AS o FROM r WHERE tri % 5 = 0 GROUP BY v) SELECT v, row_number() OVER (ORDER BY o) - 1 AS new_index FROM p",
    "index_narrow": """WITH g AS (SELECT l_orderkey AS file_id, l_linenumber AS accessor, min(l_partkey) AS p, min(l_suppkey) AS s, count(*) AS c FROM lineitem GROUP BY 1, 2), a AS (SELECT *, count(*) OVER (PARTITION BY file_id, accessor // 2) AS uses FROM g)
SELECT file_id, accessor, c * 3 AS count, c * 6 AS saved_bytes FROM a WHERE p % 5 <> 0 AND p % 7 <> 0 AND uses = 1 AND s % 4 <> 0 AND p % 3 <> 1 AND p * 97 <= 65534""",
    "content_dedup": "SELECT doc_id, sha1(text) AS digest, dense_rank() OVER (ORDER BY sha1(text)) AS content_id FROM documents",
    "merge_groups": "SELECT CASE WHEN p_size % 2 = 0 THEN '4|' || p_brand || '|' || substr(p_type, 1, 4) ELSE 'single#' || p_partkey END AS merge_key, count(*) AS n, min(p_partkey) AS first_id, CAST(sum(p_size * 3) AS BIGINT) AS vertices FROM part GROUP BY 1",
    "batch_offset": "SELECT c_custkey, c_nationkey, CAST(c_custkey % 13 AS BIGINT) AS batch_length, CAST(coalesce(sum(c_custkey % 13) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM customer",
    "batch_union": "SELECT c_custkey AS feature, c_name AS name, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier",
    "box_downsample": "SELECT (l_partkey % 64) // 4 AS bx, (l_suppkey % 48) // 4 AS by, CAST(floor(sum(CAST(l_quantity AS BIGINT) % 256) / count(*) + 0.5) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2",
    "hash_random": f"SELECT o_orderkey, round(h, 9) AS r FROM (SELECT o_orderkey, {_mix('1', 'o_orderkey', 'o_custkey', 'h')} FROM orders)",
    "splat_points": f"WITH {_S} SELECT tri, s, round(x0 + ax * r + bx * w, 5) AS x, round(y0 + ay * r + qy * w, 5) AS y, round(z0 + az * r + bz * w, 5) AS z FROM g",
    "splat_attrs": f"WITH {_S} SELECT tri, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz, round(ln(greatest(sqrt(ax * ax + ay * ay + az * az) * 0.5::DOUBLE, 1e-4)), 5) AS scale_0, round(ln(greatest(sqrt(bx * bx + qy * qy + bz * bz) * 0.5::DOUBLE, 1e-4)), 5) AS scale_1, round(ln(greatest(sqrt((ax - bx) * (ax - bx) + (ay - qy) * (ay - qy) + (az - bz) * (az - bz)) * 0.05::DOUBLE, 1e-4)), 5) AS scale_2, round(ln(0.85::DOUBLE / (1 - 0.85::DOUBLE)), 6) AS opacity, 1.0::DOUBLE AS rotation_norm FROM g WHERE s = 0",
    "color_avg": f"WITH {_T} SELECT tri, " + ", ".join(f"CAST(least(greatest(floor(((tri * 7 + {31 * j}) % 256 + (tri * 12 + {31 * j}) % 256 + (tri * 17 + {31 * j}) % 256) / 3.0 + 0.5), 0), 255) AS INTEGER) AS {n}" for j, n in enumerate("rgba")) + " FROM t",
    "color_from_name": """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '_' || p_size || '_' || (p_partkey % 400) || '_7' WHEN 1 THEN 'tex_' || (p_partkey % 256) || '_1_2_' || p_size ELSE p_name || '_1_2' END AS name, p_size FROM part)
SELECT p_partkey, name, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN CAST(p_partkey % 256 AS INTEGER) END AS r, CASE p_partkey % 3 WHEN 0 THEN CAST(least(255, p_partkey % 400) AS INTEGER) WHEN 1 THEN 1 END AS g, CASE p_partkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 2 END AS b, CASE p_partkey % 3 WHEN 0 THEN 255 WHEN 1 THEN p_size END AS a FROM p""",
    "material_rewrite": """SELECT p_partkey, '{"name":"' || p_brand || '","alphaMode":"OPAQUE","doubleSided":false,"baseColorFactor":[0.72,0.68,0.55,1.0]}' AS material FROM part""",
    "material_modes": """WITH p AS (SELECT p_partkey, p_partkey % 50 = 0 AS gone, p_brand, p_size, p_size % 3 = 0 AS blend, p_size % 2 = 0 AS one, p_partkey % 2 = 0 AS base, p_partkey % 3 = 0 AS normal, p_partkey % 5 = 0 AS emissive, p_size % 7 = 0 AS ior FROM part),
w AS (SELECT * FROM p, (VALUES ('solid'), ('unlit'), ('opaque'), ('flat')) v(way))
SELECT p_partkey, way, CASE WHEN NOT gone AND way <> 'solid' THEN p_brand END AS name, CASE WHEN NOT gone AND way <> 'solid' THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN NOT gone AND blend AND way IN ('solid', 'unlit') THEN 'BLEND' END AS alpha,
CASE WHEN way = 'opaque' THEN 'false' WHEN NOT gone AND one THEN 'false' WHEN way = 'solid' THEN 'true' END AS sides, CASE WHEN way <> 'unlit' THEN '[0.72,0.68,0.55,1]' END AS color, CASE WHEN way <> 'unlit' THEN '0' WHEN NOT gone THEN '1' END AS metallic,
CASE WHEN way IN ('unlit', 'flat') THEN CASE WHEN NOT gone AND ior THEN '{"KHR_materials_ior":{"ior":1.5},"KHR_materials_unlit":{}}' ELSE '{"KHR_materials_unlit":{}}' END WHEN way = 'opaque' AND NOT gone AND ior THEN '{"KHR_materials_ior":{"ior":1.5}}' END AS extensions,
CASE WHEN NOT gone AND normal AND way IN ('unlit', 'flat') THEN '[2,2]' END AS normal_scale, CASE WHEN gone THEN 0 ELSE CAST(base AS BIGINT) + CAST(normal AS BIGINT) + CAST(emissive AS BIGINT) END AS filled, CASE WHEN NOT gone AND way IN ('unlit', 'flat') THEN CAST(base AS BIGINT) + CAST(normal AS BIGINT) + CAST(emissive AS BIGINT) ELSE 0 END AS left_over FROM w""",
    "color_chain": """WITH p AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 8 <> 4 THEN [[p_size, p_partkey % 256, 7, 255], [p_size + 1, 9, p_partkey % 200, 255], [250, 3, p_size, 128]] END AS c,
CASE p_partkey % 5 WHEN 1 THEN [0.5::DOUBLE, p_size / 50, 1.5, 1] WHEN 2 THEN [-0.1::DOUBLE, 0.25, 0.75, 0.5] END AS base FROM part),
q AS (SELECT k, CASE WHEN c IS NOT NULL THEN [floor((c[1][i] + c[2][i] + c[3][i]) / 3 + 0.5) FOR i IN range(1, 5)] WHEN base IS NOT NULL THEN [floor(base[i] * 255 + 0.5) FOR i IN range(1, 5)] WHEN k % 3 = 0 THEN [s, k % 300, 9, 255] ELSE [220, 220, 220, 255] END AS v FROM p)
SELECT k AS p_partkey, CAST(least(greatest(v[1], 0), 255) AS INTEGER) AS r, CAST(least(greatest(v[2], 0), 255) AS INTEGER) AS g, CAST(least(greatest(v[3], 0), 255) AS INTEGER) AS b, CAST(least(greatest(v[4], 0), 255) AS INTEGER) AS a FROM q""",
    "model_scan": """WITH v AS (SELECT vec_id // 50 AS file, vec_id % 50 AS i, round(CAST(CAST(CAST(embedding[1] AS DOUBLE) * 100 AS FLOAT) AS DOUBLE), 3) AS x FROM embeddings), n AS (SELECT file, count(*) AS n FROM v GROUP BY file),
t AS (SELECT file, u.t AS tri, CASE file % 3 WHEN 0 THEN u.t ELSE 3 * u.t END AS i0 FROM n, unnest(range(0, CASE file % 3 WHEN 0 THEN n - 2 WHEN 1 THEN n // 3 ELSE 0 END)) AS u(t))
SELECT t.file, tri, i0, i0 + 1 AS i1, i0 + 2 AS i2, x AS x0 FROM t JOIN v ON v.file = t.file AND v.i = i0""",
    "sum_pair": "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS total FROM lineitem",
}
ORACLE["mesh_report"] = f"WITH q AS ({ORACLE['mesh_quality']}), b AS ({ORACLE['mesh_bbox']}), d AS ({ORACLE['mesh_dup_faces']}), e AS ({ORACLE['mesh_edge_sharing']}) SELECT q.*, b.*, d.* EXCLUDE (faces), e.* FROM q, b, d, e"
ORACLE["splat_cloud"] = f"SELECT tri, s FROM (WITH {_S} SELECT tri, s FROM g) ORDER BY tri, s LIMIT 1000"
ORACLE["retile_parts"] = f"""WITH {_T}, b AS (SELECT count(*) AS n, min(least(x0, x1, x2)) AS xa, max(greatest(x0, x1, x2)) AS xb, min(least(y0, y1, y2)) AS ya, max(greatest(y0, y1, y2)) AS yb FROM t),
p AS (SELECT *, least(9, greatest(2, CAST(ceil(n / 50) AS BIGINT))) AS parts, greatest(xb - xa, 0.001) AS w, greatest(yb - ya, 0.001) AS h FROM b), g0 AS (SELECT *, CAST(least(parts, greatest(1, floor(sqrt(parts) * sqrt(w / h) + 0.5))) AS BIGINT) AS gx FROM p), g AS (SELECT *, CAST(ceil(parts / gx) AS BIGINT) AS gy FROM g0)
SELECT CAST(least(greatest(floor(((y0 + y1 + y2) / 3 - ya) / (yb - ya) * gy), 0), gy - 1) * gx + least(greatest(floor(((x0 + x1 + x2) / 3 - xa) / (xb - xa) * gx), 0), gx - 1) AS BIGINT) AS part, count(*) AS triangles, min(tri) AS first_tri FROM t, g GROUP BY 1"""
