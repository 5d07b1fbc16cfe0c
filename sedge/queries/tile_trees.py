"""Queries of tile trees, over trees made of suppliers and customers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import tiles as T
from ..session import table
from ..sources.tiles3d import read_tileset
from ..storage import shared_dir


def tree(spark, sf_dir):
    """Suppliers as tiles: tile t stands below tile (t - 1) div 2; its box is centred at its balance and key."""
    y = "cast(s_suppkey * 37 % 1000 as double)"
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS tile_id", "CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) div 2 END AS parent_id", "s_nationkey", "s_acctbal / 10 AS x", f"{y} AS y", "s_acctbal / 10 - 5 AS min_x", "s_acctbal / 10 + 5 AS max_x", f"{y} - 4 AS min_y", f"{y} + 4 AS max_y")


def points(spark, sf_dir):
    """Customers as tiles on a plane."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS tile_id", "c_acctbal AS x", "cast(c_custkey * 7919 % 5000 as double) AS y", "c_acctbal - 2 AS min_x", "c_acctbal + 2 AS max_x", "cast(c_custkey * 7919 % 5000 as double) - 2 AS min_y", "cast(c_custkey * 7919 % 5000 as double) + 2 AS max_y", "c_nationkey")


def grid_bucket(spark, sf_dir):
    p = points(spark, sf_dir)
    b = T.union_bounds(p).first()
    grid = T.choose_grid(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"], 12)
    cell = T.grid_cell(F.col("x"), F.col("y"), (b["min_x"], b["min_y"]), (b["max_x"], b["max_y"]), grid)
    return p.groupBy(cell.cast("bigint").alias("cell")).agg(F.count("*").alias("n"), F.round(F.min("min_x"), 6).alias("min_x"), F.round(F.max("max_y"), 6).alias("max_y"))


def quadtree_level1(spark, sf_dir):
    p = points(spark, sf_dir)
    whole = T.union_bounds(p).select(*[F.col(c).alias(f"g_{c}") for c in T.SIDES])
    return p.join(F.broadcast(whole)).groupBy(T.quarter().alias("quarter")).agg(F.count("*").alias("n"), F.min("tile_id").alias("first_tile"))


def byte_split(spark, sf_dir):
    """Customers by nation as groups of tiles; a tile's bytes come from its key."""
    members = points(spark, sf_dir).selectExpr("c_nationkey AS group_name", "tile_id", "tile_id * 7919 % 1000 + 1 AS bytes", "x", "y")
    return T.split_overfull(members, 1500, 4000.0).groupBy("group_name", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("tile_id").alias("first_tile"))


def quadtree_groups(spark, sf_dir):
    return T.quadtree_groups(points(spark, sf_dir))


def bounds_union(spark, sf_dir):
    found = T.union_bounds(points(spark, sf_dir), "c_nationkey")
    low, high = [F.col("min_x"), F.col("min_y"), F.lit(0.0)], [F.col("max_x"), F.col("max_y"), F.lit(0.0)]
    box = T.box_of(low, high)
    back = T.bounds_of_box(box)
    return found.select("c_nationkey", *[F.round(box[k], 6).alias(f"box_{k}") for k in (0, 1, 3, 7, 11)], F.round(back[0][0], 6).alias("low_x"), F.round(back[1][1], 6).alias("high_y"))


def bounds_rollup(spark, sf_dir):
    found = T.rolled_up_bounds(tree(spark, sf_dir))
    return found.select("tile_id", *[F.round(c, 6).alias(c) for c in T.SIDES])


def group_size_stats(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def nearest_group(spark, sf_dir):
    g = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS group_id", "s_suppkey % 9 + 1 AS size", "s_acctbal AS cx", "cast(s_nationkey * 100 as double) AS cy", "cast(s_suppkey % 50 as double) AS cz")
    return T.nearest_groups(g, 12).select("group_id", "target_id", F.round("d2", 4).alias("d2"))


def tileset_scan(spark, sf_dir):
    """Tiles of tileset files that are made of the suppliers, one file for each nation: cells below the root, tiles below cells."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey", "s_suppkey % 4 AS cell", "struct(s_suppkey % 5 AS geometricError, struct(array(s_acctbal, 0D, 0D, 1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) AS box) AS boundingVolume, struct(concat('tiles/', s_suppkey, '.b3dm') AS uri) AS content) AS leaf", "s_suppkey")
    cells = s.groupBy("s_nationkey", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "leaf"))), lambda x: x["leaf"]).alias("children"))
    cells = cells.selectExpr("s_nationkey", "struct(cell, struct(100 + cell AS geometricError, 'ADD' AS refine, struct(array(0D, 0D, 0D, 1D) AS sphere) AS boundingVolume, array(1D,0D,0D,0D, 0D,1D,0D,0D, 0D,0D,1D,0D, cast(cell as double),0D,0D,1D) AS transform, children) AS tile) AS c")
    roots = cells.groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["tile"]).alias("children"))
    path = f"{shared_dir(spark)}/tilesets-{uuid.uuid4().hex}"
    roots.selectExpr("to_json(struct(struct('1.0' AS version) AS asset, struct(s_nationkey AS geometricError, struct(array(0D, 0D, 0D, 1D) AS sphere) AS boundingVolume, children) AS root)) AS value").write.option("maxRecordsPerFile", 1).text(path)
    tiles = read_tileset(spark, path, with_path=True)
    top = tiles.where("parent_id IS NULL").select("path", F.col("geometric_error").cast("bigint").alias("nation"))
    return tiles.join(top, "path").select("nation", "tile_id", "parent_id", F.col("ord").cast("bigint").alias("ord"), F.col("depth").cast("bigint").alias("depth"), F.col("transform")[12].alias("shift"), F.col("box")[0].alias("place"), "uri", "geometric_error", "refine")


def tile_prune(spark, sf_dir):
    return T.pruned(tree(spark, sf_dir), F.col("tile_id") % 7 == 3).select("tile_id", "parent_id")


def _stats(spark, sf_dir):
    return tree(spark, sf_dir).selectExpr("tile_id", "parent_id", "concat('t/', tile_id, '.b3dm') AS uri", "tile_id * 7919 % 1000000 AS bytes", "tile_id * 31 % 900 AS triangles", "cast(tile_id % 3 as double) AS geometric_error", "CASE WHEN tile_id % 2 = 0 THEN 'ADD' END AS refine", "cast(tile_id % 17 as double) AS half_x", "cast(tile_id % 5 as double) AS half_y", "2.0D AS half_z")


def lod_candidates(spark, sf_dir):
    return T.lod_candidates(_stats(spark, sf_dir)).select("tile_id", "triangles", "lod_triangles")


def lod_tree(spark, sf_dir):
    s = _stats(spark, sf_dir)
    return T.with_lod(s, T.lod_candidates(s), 10_000_000)


def tile_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS tile_id", "CASE WHEN l_linenumber % 3 = 0 THEN null ELSE cast(l_quantity * 3 as bigint) END AS index_count", "l_partkey % 100 AS position_count")
    each = F.expr("coalesce(index_count, position_count) div 3")
    return li.groupBy("tile_id").agg(F.sum(each).alias("triangles"), F.count("*").alias("primitives")).agg(F.count("*").alias("tiles"), F.sum("triangles").alias("triangles"), F.sum("primitives").alias("primitives"), F.max("triangles").alias("most"))


def tile_tree_transform(spark, sf_dir):
    """A quarter turn or none, and a shift, per tile; where its origin and unit point come to lie."""
    quarter = F.when(F.col("tile_id") % 2 == 1, F.array(*[F.lit(float(c)) for c in (0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0)])).otherwise(F.array(*[F.lit(float(c)) for c in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)]))
    own = F.concat(quarter, F.array((F.col("tile_id") % 10).cast("double"), (F.col("s_nationkey")).cast("double"), F.lit(1.0), F.lit(1.0)))
    world = T.world_transforms(tree(spark, sf_dir).withColumn("transform", own))
    at = G.transform_point(F.col("world"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return world.select("tile_id", F.col("depth").cast("bigint").alias("depth"), *[F.round(F.col("world")[12 + k], 6).alias(f"o{c}") for k, c in enumerate("xyz")], *[F.round(at[k], 6).alias(f"p{c}") for k, c in enumerate("xyz")])


def trs_matrix(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_suppkey % 12 * 0.5D AS angle", "cast(s_nationkey as double) AS t", "s_suppkey % 3 + 1.0D AS k")
    q = [F.lit(0.0), F.lit(0.0), F.sin(F.col("angle") / 2), F.cos(F.col("angle") / 2)]
    m = G.from_trs([F.col("t"), F.col("t") * 2, F.lit(3.0)], q, [F.col("k"), F.lit(1.0), F.lit(2.0)])
    return s.select("s_suppkey", *[F.round(m[j], 6).alias(f"m{j}") for j in (0, 1, 4, 5, 10, 12, 13, 14, 15)])


QUERIES = {f.__name__: f for f in (grid_bucket, byte_split, quadtree_level1, quadtree_groups, bounds_union, bounds_rollup, group_size_stats, nearest_group, tileset_scan, tile_prune, lod_candidates, lod_tree, tile_totals, tile_tree_transform, trs_matrix)}

_P = "p AS (SELECT c_custkey AS tile_id, c_acctbal AS x, CAST(c_custkey * 7919 % 5000 AS DOUBLE) AS y, c_nationkey FROM customer), b AS (SELECT min(x) - 2 AS x0, max(x) + 2 AS x1, min(y) - 2 AS y0, max(y) + 2 AS y1 FROM p)"
_TREE = "s AS (SELECT s_suppkey AS tile_id, CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) // 2 END AS parent_id, s_nationkey, s_acctbal / 10 AS x, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS y FROM supplier)"
_ABOVE = f"WITH RECURSIVE {_TREE}, up AS (SELECT tile_id AS start, tile_id FROM s UNION ALL SELECT start, parent_id FROM up JOIN s USING (tile_id) WHERE parent_id IS NOT NULL)"
_STATS = f"{_TREE}, st AS (SELECT tile_id, parent_id, 't/' || tile_id || '.b3dm' AS uri, tile_id * 7919 % 1000000 AS bytes, tile_id * 31 % 900 AS triangles, CAST(tile_id % 3 AS DOUBLE) AS geometric_error, CASE WHEN tile_id % 2 = 0 THEN 'ADD' END AS refine, tile_id % 17 AS hx, tile_id % 5 AS hy FROM s), cand AS (SELECT *, CAST(greatest(1, floor(triangles * 0.25)) AS BIGINT) AS lod_triangles FROM st WHERE bytes >= 262144 AND triangles >= 200)"


def _split_sql(most: int, span: int, rounds: int) -> str:
    """Halving round by round, each a table expression over the one before."""
    steps = [f"WITH {_P}, h0 AS (SELECT c_nationkey AS g, tile_id, tile_id * 7919 % 1000 + 1 AS bytes, x, y, '' AS part, false AS done FROM p)"]
    for k in range(rounds):
        steps.append(f"""s{k} AS (SELECT *, NOT done AND count(*) OVER w > 1 AND (sum(bytes) OVER w > {most} OR greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w) > {span}) AS over,
    CASE WHEN max(x) OVER w - min(x) OVER w >= max(y) OVER w - min(y) OVER w THEN x ELSE y END AS along, sum(CASE WHEN bytes < {most} THEN bytes + 1 END) OVER w AS weight, count(*) FILTER (WHERE bytes < {most}) OVER w AS n FROM h{k} WINDOW w AS (PARTITION BY g, part)),
a{k} AS (SELECT *, over AND (bytes >= {most} OR n = 1) AS alone FROM s{k}),
b{k} AS (SELECT *, coalesce(sum(CASE WHEN alone THEN 0 ELSE bytes + 1 END) OVER (PARTITION BY g, part ORDER BY along, tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a{k}),
h{k + 1} AS (SELECT g, tile_id, bytes, x, y, CASE WHEN NOT over THEN part WHEN alone THEN part || 'one ' || tile_id WHEN before = 0 OR 2 * before + bytes + 1 <= weight AND before + bytes + 1 < weight THEN part || 'l' ELSE part || 'r' END AS part, NOT over OR alone AS done FROM b{k})""")
    return ",\n".join(steps) + f"\nSELECT g AS group_name, part, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(tile_id) AS first_tile FROM h{rounds} GROUP BY ALL"


ORACLE = {
    "grid_bucket": f"""WITH {_P}, r AS (SELECT *, greatest(x1 - x0, 0.001) AS w, greatest(y1 - y0, 0.001) AS h FROM b), g0 AS (SELECT *, CAST(least(12, greatest(1, floor(sqrt(12) * sqrt(w / h) + 0.5))) AS INTEGER) AS gx FROM r), g AS (SELECT *, CAST(ceil(12 / gx) AS INTEGER) AS gy FROM g0)
SELECT CAST(least(greatest(floor((y - y0) / (y1 - y0) * gy), 0), gy - 1) * gx + least(greatest(floor((x - x0) / (x1 - x0) * gx), 0), gx - 1) AS BIGINT) AS cell, count(*) AS n, round(min(x - 2), 6) AS min_x, round(max(y + 2), 6) AS max_y FROM p, g GROUP BY 1""",
    "byte_split": _split_sql(1500, 4000, 16),
    "quadtree_level1": f"WITH {_P} SELECT CAST(x >= (x0 + x1) / 2 AS INTEGER) + 2 * CAST(y >= (y0 + y1) / 2 AS INTEGER) AS quarter, count(*) AS n, min(tile_id) AS first_tile FROM p, b GROUP BY 1",
    "bounds_union": f"WITH {_P}, u AS (SELECT c_nationkey, min(x - 2) AS a, max(x + 2) AS b, min(y - 2) AS c, max(y + 2) AS d FROM p GROUP BY 1) SELECT c_nationkey, round((a + b) / 2, 6) AS box_0, round((c + d) / 2, 6) AS box_1, round(greatest((b - a) / 2, 0.001), 6) AS box_3, round(greatest((d - c) / 2, 0.001), 6) AS box_7, 0.001::DOUBLE AS box_11, round(a, 6) AS low_x, round(d, 6) AS high_y FROM u",
    "bounds_rollup": f"{_ABOVE} SELECT up.tile_id, round(min(x - 5), 6) AS min_x, round(max(x + 5), 6) AS max_x, round(min(y - 4), 6) AS min_y, round(max(y + 4), 6) AS max_y FROM up JOIN s ON s.tile_id = start WHERE start NOT IN (SELECT parent_id FROM s WHERE parent_id IS NOT NULL) GROUP BY up.tile_id",
    "group_size_stats": "SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)",
    "nearest_group": """WITH g AS (SELECT s_suppkey AS id, s_suppkey % 9 + 1 AS size, s_acctbal AS x, s_nationkey * 100.0::DOUBLE AS y, CAST(s_suppkey % 50 AS DOUBLE) AS z FROM supplier), d AS (SELECT a.id AS group_id, b.id AS target_id, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d2 FROM g a JOIN g b ON a.id <> b.id AND a.size + b.size <= 12)
SELECT group_id, target_id, round(d2, 4) AS d2 FROM d QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY d2, target_id) = 1""",
    "tileset_scan": """WITH s AS (SELECT s_nationkey AS nation, s_suppkey % 4 AS cell, s_suppkey AS k, s_acctbal AS pos FROM supplier), c AS (SELECT nation, cell FROM s GROUP BY ALL),
t AS (SELECT nation, -1 AS cell, -1 AS k, 0 AS depth, CAST(NULL AS DOUBLE) AS pos, CAST(NULL AS VARCHAR) AS uri, CAST(nation AS DOUBLE) AS error, CAST(NULL AS VARCHAR) AS refine FROM (SELECT DISTINCT nation FROM s)
UNION ALL SELECT nation, cell, -1, 1, NULL, NULL, 100.0 + cell, 'ADD' FROM c UNION ALL SELECT nation, cell, k, 2, pos, 'tiles/' || k || '.b3dm', k % 5, NULL FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY cell, k) - 1 AS tile_id, dense_rank() OVER (PARTITION BY nation, depth ORDER BY cell) - 1 AS cell_ord, row_number() OVER (PARTITION BY nation, depth, cell ORDER BY k) - 1 AS leaf_ord FROM t)
SELECT n.nation, n.tile_id, CASE n.depth WHEN 1 THEN 0 WHEN 2 THEN p.tile_id END AS parent_id, CASE n.depth WHEN 0 THEN 0 WHEN 1 THEN n.cell_ord ELSE n.leaf_ord END AS ord, CAST(n.depth AS BIGINT) AS depth, CASE WHEN n.depth = 1 THEN CAST(n.cell AS DOUBLE) ELSE 0 END AS shift, n.pos AS place, n.uri, n.error AS geometric_error, n.refine
FROM n LEFT JOIN n p ON p.nation = n.nation AND p.cell = n.cell AND p.depth = 1 AND n.depth = 2""",
    "tile_prune": f"{_ABOVE} SELECT DISTINCT s.tile_id, s.parent_id FROM up JOIN s USING (tile_id) WHERE start % 7 = 3",
    "lod_candidates": f"WITH {_STATS} SELECT tile_id, triangles, lod_triangles FROM cand WHERE lod_triangles < triangles",
    "lod_tree": f"""WITH {_STATS}, x AS (SELECT st.*, cand.tile_id IS NOT NULL AS lod FROM st LEFT JOIN cand USING (tile_id))
SELECT tile_id, parent_id, CASE WHEN lod THEN replace(uri, '.b3dm', '_lod.b3dm') ELSE uri END AS uri, round(CASE WHEN lod AND geometric_error <= 0 THEN greatest(1.0::DOUBLE, sqrt(hx * hx + hy * hy + 4) / 2) ELSE geometric_error END, 6) AS geometric_error, CASE WHEN lod THEN coalesce(refine, 'REPLACE') ELSE refine END AS refine FROM x
UNION ALL SELECT tile_id + 10000000, tile_id, uri, 0.0::DOUBLE, 'REPLACE' FROM x WHERE lod""",
    "tile_totals": "WITH t AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 3 = 0 THEN (l_partkey % 100) // 3 ELSE CAST(l_quantity * 3 AS BIGINT) // 3 END) AS n, count(*) AS p FROM lineitem GROUP BY 1) SELECT count(*) AS tiles, CAST(sum(n) AS BIGINT) AS triangles, CAST(sum(p) AS BIGINT) AS primitives, CAST(max(n) AS BIGINT) AS most FROM t",
    "tile_tree_transform": f"""WITH RECURSIVE {_TREE}, o AS (SELECT *, tile_id % 2 = 1 AS turn, CAST(tile_id % 10 AS DOUBLE) AS tx, CAST(s_nationkey AS DOUBLE) AS ty FROM s),
w AS (SELECT tile_id, CAST(0 AS BIGINT) AS depth, CASE WHEN turn THEN 0.0::DOUBLE ELSE 1 END AS c, CASE WHEN turn THEN 1.0::DOUBLE ELSE 0 END AS sn, tx AS ox, ty AS oy, 1.0::DOUBLE AS oz FROM o WHERE parent_id IS NULL
UNION ALL SELECT o.tile_id, w.depth + 1, CASE WHEN turn THEN -w.sn ELSE w.c END, CASE WHEN turn THEN w.c ELSE w.sn END, w.ox + w.c * tx - w.sn * ty, w.oy + w.sn * tx + w.c * ty, w.oz + 1 FROM w JOIN o ON o.parent_id = w.tile_id)
SELECT tile_id, depth, round(ox, 6) AS ox, round(oy, 6) AS oy, round(oz, 6) AS oz, round(ox + c, 6) AS px, round(oy + sn, 6) AS py, round(oz, 6) AS pz FROM w""",
    "trs_matrix": """WITH s AS (SELECT s_suppkey, s_suppkey % 12 * 0.5::DOUBLE AS a, CAST(s_nationkey AS DOUBLE) AS t, s_suppkey % 3 + 1.0::DOUBLE AS k FROM supplier)
SELECT s_suppkey, round(cos(a) * k, 6) AS m0, round(sin(a) * k, 6) AS m1, round(-sin(a), 6) AS m4, round(cos(a), 6) AS m5, 2.0::DOUBLE AS m10, t AS m12, t * 2 AS m13, 3.0::DOUBLE AS m14, 1.0::DOUBLE AS m15 FROM s""",
}
