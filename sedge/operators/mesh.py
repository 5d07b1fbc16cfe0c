"""Operators on triangle meshes as frames: vertices (v, x, y, z, ...) and triangles (tri, i0, i1, i2, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from .ordinals import running_sum, with_ordinal

MESH_QUANTILES = (0.001, 0.5, 0.9, 0.99, 0.999)
#: Number of distinct keys from which on a report says so.
MOST_KEYS = 15_000_000


def corners(triangles: DataFrame) -> DataFrame:
    """A row per corner: the triangle's columns, corner (0 to 2) and v."""
    keys = [c for c in triangles.columns if c not in ("i0", "i1", "i2")]
    return triangles.select(*keys, F.posexplode(F.array("i0", "i1", "i2")).alias("corner", "v"))


def with_positions(triangles: DataFrame, vertices: DataFrame, transform: Column | None = None) -> DataFrame:
    """triangles with p0, p1 and p2. One join on the vertex and one grouping, whatever the number of corners."""
    at = G.vec(F.col("x"), F.col("y"), F.col("z"))
    at = G.transform_point(transform, at) if transform is not None else at
    met = corners(triangles).join(vertices.select("v", "x", "y", "z"), "v").withColumn("at", at)
    keys = [c for c in triangles.columns if c not in ("i0", "i1", "i2")]
    picked = [F.max(F.when(F.col("corner") == k, F.col(c))).alias(n) for k in range(3) for c, n in (("v", f"i{k}"), ("at", f"p{k}"))]
    return met.groupBy(*keys).agg(*picked)


def measured(placed: DataFrame) -> DataFrame:
    """placed with the edges e0, e1, e2, area and aspect (longest edge by shortest)."""
    a, b, c = F.col("p0"), F.col("p1"), F.col("p2")
    out = placed.select("*", G.distance(a, b).alias("e0"), G.distance(b, c).alias("e1"), G.distance(c, a).alias("e2"), (G.norm(G.cross(G.sub(b, a), G.sub(c, a))) / 2).alias("area"))
    return out.withColumn("longest", F.greatest("e0", "e1", "e2")).withColumn("aspect", F.col("longest") / F.greatest(F.least("e0", "e1", "e2"), F.lit(1e-12)))


def quality(found: DataFrame, edges: tuple = (1000.0, 5000.0), aspects: tuple = (50.0, 100.0), area: float = 1e-8) -> DataFrame:
    """One row of counters and maxima over all triangles."""
    return found.agg(
        F.count("*").alias("triangles"),
        *[F.count_if(F.col("longest") > limit).alias(f"edge_over_{k}") for k, limit in enumerate(edges, 1)],
        *[F.count_if(F.col("aspect") > limit).alias(f"aspect_over_{k}") for k, limit in enumerate(aspects, 1)],
        F.count_if(F.col("area") < area).alias("degenerate"),
        F.round(F.max("longest"), 6).alias("max_edge"),
        F.round(F.max("aspect"), 6).alias("max_aspect"),
    )


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    """Least and greatest coordinates and spans."""
    found = points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return found.select("*", *[(F.col(f"max_{c}") - F.col(f"min_{c}")).alias(f"span_{c}") for c in "xyz"])


def face_key(epsilon: float, *points: Column) -> Column:
    """Order-free key of points on the grid of a tolerance."""
    return F.array_join(F.array_sort(F.array(*[G.point_key(p, epsilon) for p in points])), "|")


def duplicate_faces(placed: DataFrame, epsilon: float, cap: int = 3, most_keys: int = MOST_KEYS) -> DataFrame:
    """Faces, distinct keys, keys that occur twice or more and their occurrences (each key counts up to the cap).

    All keys are counted; keys_over_limit only tells that there are more than most_keys.
    """
    keys = placed.groupBy(face_key(epsilon, F.col("p0"), F.col("p1"), F.col("p2")).alias("k")).agg(F.count("*").alias("n"))
    capped = F.least("n", F.lit(cap))
    return keys.agg(F.sum("n").alias("faces"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, capped)), F.lit(0)).alias("duplicate_faces"), (F.count("*") > most_keys).alias("keys_over_limit"))


def edge_sharing(placed: DataFrame, epsilon: float) -> DataFrame:
    """Edges by how many triangles share them: boundary, manifold, non-manifold."""
    p = [F.col("p0"), F.col("p1"), F.col("p2")]
    each = placed.select(F.explode(F.array(*[face_key(epsilon, p[a], p[b]) for a, b in ((0, 1), (1, 2), (2, 0))])).alias("k"))
    n = each.groupBy("k").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") == 2).alias("manifold"), F.count_if(F.col("n") > 2).alias("non_manifold"))


def shell(placed: DataFrame, epsilon: float) -> DataFrame:
    """Triangles whose face occurs once. Counts are summed per task first; a face of many copies is not gathered."""
    keyed = placed.withColumn("face", face_key(epsilon, F.col("p0"), F.col("p1"), F.col("p2")))
    single = keyed.groupBy("face").agg(F.count("*").alias("n")).where("n = 1").select("face")
    return keyed.join(single, "face", "left_semi").drop("face")


def centroids(placed: DataFrame) -> DataFrame:
    """placed with the mean of the corners as cx, cy, cz."""
    return placed.select("*", *[((F.col("p0")[k] + F.col("p1")[k] + F.col("p2")[k]) / 3).alias(f"c{c}") for k, c in enumerate("xyz")])


def decimate(triangles: DataFrame, ratio: float, order: str = "tri") -> DataFrame:
    """An even choice of max(1, floor(n * ratio)) of the n triangles, in order: number floor(i * n / target) for each i."""
    numbered = with_ordinal(triangles, "_k", order)
    n = triangles.count()
    target = max(1, int(n * ratio)) if n else 0
    if not target:
        return triangles
    # Triangle k is chosen if floor(i * n / target) = k for some i; the least i with i * n >= k * target is the only one that can.
    i = f"((_k * {target} + {n - 1}) div {n})"
    return numbered.where(f"{i} < {target} AND ({i} * {n}) div {target} = _k").drop("_k")


def every(triangles: DataFrame, stride: int, order: str = "tri") -> DataFrame:
    """Each stride-th triangle of the whole order, from the first."""
    return with_ordinal(triangles, "_k", order).where(F.col("_k") % stride == 0).drop("_k")


def clustered(triangles: DataFrame, vertices: DataFrame, cell: float, low: tuple, *keys: str) -> DataFrame:
    """A row per corner with the cell of its vertex (and keys, such as a feature id, that cells must not mix)."""
    cells = [F.floor((F.col(c) - F.lit(m)) / F.lit(cell)).cast("bigint").alias(f"c{c}") for c, m in zip("xyz", low, strict=True)]
    return corners(triangles).join(vertices.select("v", "x", "y", "z", *keys, *cells), "v")


def cluster_vertices(met: DataFrame, *keys: str) -> DataFrame:
    """Cells with the mean position over all references and the vertex referred to first."""
    mean = [F.round(F.avg(c), 6).alias(c) for c in "xyz"]
    return met.groupBy("cx", "cy", "cz", *keys).agg(F.count("*").alias("n_refs"), *mean, F.min_by("v", F.struct("tri", "corner")).alias("representative"))


def cluster_triangles(met: DataFrame, *keys: str) -> DataFrame:
    """Triangles whose corners stay in three different cells."""
    cell = F.concat_ws(",", "cx", "cy", "cz", *keys)
    return met.groupBy("tri").agg(*[F.max(F.when(F.col("corner") == k, cell)).alias(f"k{k}") for k in range(3)]).where("k0 <> k1 AND k1 <> k2 AND k0 <> k2")


def renumber(references: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """keys and new_index: numbers by first reference."""
    first = references.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return with_ordinal(first, "new_index", "_first").drop("_first")


def narrow_candidates(accessors: DataFrame, most: int = 65534) -> DataFrame:
    """Index accessors (uint32 scalars alone in an unstrided view, not offset, for elements) whose greatest index fits 16 bits."""
    uses = F.count("*").over(Window.partitionBy("file_id", "buffer_view"))
    ok = (F.col("component_type") == 5125) & (F.col("type") == "SCALAR") & (F.col("uses") == 1) & F.col("byte_stride").isNull() & (F.coalesce("byte_offset", F.lit(0)) == 0) & (F.col("target").isNull() | (F.col("target") == 34963))
    return accessors.withColumn("uses", uses).where(ok & (F.col("max_index") <= most)).select("file_id", "accessor", "count", (F.col("count") * 2).alias("saved_bytes"))


def content_ids(rows: DataFrame, content: Column) -> DataFrame:
    """rows with digest and the number of each distinct content, by first digest in order."""
    keyed = rows.withColumn("digest", F.sha1(content.cast("binary")))
    numbers = with_ordinal(keyed.select("digest").distinct(), "content_id", "digest", start=1)
    return keyed.join(numbers, "digest")


def merge_groups(primitives: DataFrame, key: list[str], eligible: Column, row_id: str) -> DataFrame:
    """Sizes of the groups that may be merged: same key if eligible, else each primitive alone."""
    name = F.when(eligible, F.concat_ws("|", *key)).otherwise(F.concat(F.lit("single#"), F.col(row_id).cast("string")))
    return primitives.groupBy(name.alias("merge_key")).agg(F.count("*").alias("n"), F.min(row_id).alias("first_id"), F.sum("vertex_count").alias("vertices"))


def offsets(batches: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Where each batch starts in its group: the lengths before it."""
    return running_sum(batches, "offset", length, [group], order).withColumn("offset", F.col("offset").cast("bigint"))


def box_downsample(pixels: DataFrame, factor: int, *keys: str) -> DataFrame:
    """Mean of factor x factor boxes of pixels (px, py, value), rounded half up."""
    return pixels.groupBy(*keys, F.expr(f"px div {factor}").alias("bx"), F.expr(f"py div {factor}").alias("by")).agg(G.half_up(F.sum("value") / F.count("*")).cast("bigint").alias("value"))


def chunk_fold(triangles: DataFrame, group: str, most_vertices: int, order: str = "tri") -> DataFrame:
    """Triangles of each primitive cut, in order, into chunks of at most most_vertices distinct vertices.

    The cut depends on all triangles before, so that a primitive is one task's work; its size is bounded by its file.
    """

    def fold(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(order)
        known: set = set()
        chunk, out = 0, []
        for corner in zip(found["i0"], found["i1"], found["i2"], strict=True):
            more = set(corner) - known
            if known and len(known) + len(more) > most_vertices:
                chunk, known, more = chunk + 1, set(), set(corner)
            known |= more
            out.append(chunk)
        return pd.DataFrame({group: found[group], order: found[order], "chunk": out})

    kind = triangles.schema[group].dataType.simpleString()
    return triangles.groupBy(group).applyInPandas(fold, f"{group} {kind}, {order} bigint, chunk int")


def splats(placed: DataFrame, seed: int = 1, density: float = 0.08, most: int = 20, size: float = 0.5, opacity: float = 0.85, signed: bool = False) -> DataFrame:
    """Surface points of every triangle with an area: tri, s, position, normal, rotation, log scales and opacity."""
    p = [F.col(f"p{k}") for k in range(3)]
    sides = placed.select("tri", "p0", G.sub(p[1], p[0]).alias("ea"), G.sub(p[2], p[0]).alias("eb"))
    sides = sides.select("*", G.cross(F.col("ea"), F.col("eb")).alias("across"))
    solid = sides.select("*", G.norm(F.col("across")).alias("twice")).where("twice > 1e-12")
    count = F.least(F.greatest(F.ceil(F.col("twice") * 0.5 * density), F.lit(1)), F.lit(most))
    each = solid.select("tri", "p0", "ea", "eb", F.transform("across", lambda c: c / F.col("twice")).alias("normal"), F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("s"))
    each = each.select("*", *[G.mixed_fraction(F.lit(seed), F.col("tri"), F.col("s") * 2 + k, signed).alias(n) for k, n in enumerate("rt")])
    folded = [F.when(F.col("r") + F.col("t") > 1, 1 - F.col(n)).otherwise(F.col(n)) for n in "rt"]
    position = F.array(*[F.col("p0")[k] + F.col("ea")[k] * folded[0] + F.col("eb")[k] * folded[1] for k in range(3)])
    lengths = ((G.norm(F.col("ea")), size), (G.norm(F.col("eb")), size), (G.norm(G.sub(F.col("ea"), F.col("eb"))), 0.05))
    scales = F.array(*[F.ln(F.greatest(length * factor, F.lit(1e-4))) for length, factor in lengths])
    return each.select("tri", "s", position.alias("position"), "normal", G.quaternion_of_normal(F.col("normal")).alias("rotation"), scales.alias("scales"), G.logit(F.lit(opacity)).alias("opacity"))


def simplify_primitive(found: pd.DataFrame, ratio: float) -> pd.DataFrame:
    """Quadric edge collapse of one primitive: cheapest inner edges first, borders locked, until the ratio is met."""
    import heapq

    import numpy as np

    faces = {int(t): [int(a), int(b), int(c)] for t, a, b, c in zip(found["tri"], found["i0"], found["i1"], found["i2"], strict=True)}
    place = {int(r[f"i{k}"]): np.array(r[f"p{k}"], float) for _, r in found.iterrows() for k in range(3)}
    around: dict[int, set] = {v: set() for v in place}
    quadric = {v: np.zeros((4, 4)) for v in place}
    shared: dict[tuple, int] = {}
    for t, f in faces.items():
        n = np.cross(place[f[1]] - place[f[0]], place[f[2]] - place[f[0]])
        n = n / (np.linalg.norm(n) or 1)
        plane = np.append(n, -n @ place[f[0]])
        for k in range(3):
            around[f[k]].add(t)
            quadric[f[k]] += np.outer(plane, plane)
            e = tuple(sorted((f[k], f[(k + 1) % 3])))
            shared[e] = shared.get(e, 0) + 1
    locked = {v for e, n in shared.items() if n != 2 for v in e}

    def cost(a: int, b: int) -> float:
        p = np.append(place[b], 1.0)
        return float(p @ (quadric[a] + quadric[b]) @ p)

    heap = [(cost(a, b), a, b) for x, y in shared for a, b in ((x, y), (y, x)) if a not in locked]
    heapq.heapify(heap)
    target = max(1, int(len(faces) * ratio))
    gone: set = set()
    while heap and len(faces) > target:
        _, a, b = heapq.heappop(heap)
        if a in gone or b in gone or not around[a] & around[b]:
            continue
        for t in list(around[a]):
            f = faces[t]
            if b in f:
                for v in f:
                    around[v].discard(t)
                del faces[t]
            else:
                faces[t] = [b if v == a else v for v in f]
                around[b].add(t)
        quadric[b] = quadric[a] + quadric[b]
        gone.add(a)
        for t in around[b]:
            for v in faces[t]:
                if v != b:
                    for x, y in ((v, b), (b, v)):
                        if x not in locked:
                            heapq.heappush(heap, (cost(x, y), x, y))
    return pd.DataFrame([(t, *f) for t, f in sorted(faces.items())], columns=["tri", "i0", "i1", "i2"])


def edge_collapse(placed: DataFrame, group: str, ratio: float = 0.7) -> DataFrame:
    """Fewer triangles per primitive, borders kept; one task per primitive, whose size is bounded by its file."""
    kind = placed.schema[group].dataType.simpleString()

    def run(found: pd.DataFrame) -> pd.DataFrame:
        return simplify_primitive(found, ratio).assign(**{group: found[group].iloc[0]})[[group, "tri", "i0", "i1", "i2"]]

    return placed.groupBy(group).applyInPandas(run, f"{group} {kind}, tri bigint, i0 bigint, i1 bigint, i2 bigint")


def cache_order(found: pd.DataFrame, cache: int = 16) -> list[int]:
    """Triangles in an order that meets recently used vertices: greedily the neighbour with most of them (published greedy orderings)."""
    faces = [tuple(map(int, f)) for f in zip(found["i0"], found["i1"], found["i2"], strict=True)]
    around: dict[int, set] = {}
    for t, f in enumerate(faces):
        for v in f:
            around.setdefault(v, set()).add(t)
    left, recent, out = set(range(len(faces))), [], []
    while left:
        near = {t for v in recent for t in around[v]}
        best = min(near, key=lambda t: (-sum(v in recent for v in faces[t]), t)) if near else min(left)
        out.append(best)
        left.discard(best)
        for v in faces[best]:
            around[v].discard(best)
            if v in recent:
                recent.remove(v)
            recent.append(v)
        recent = recent[-cache:]
    return out


def reorder(triangles: DataFrame, group: str, order: str = "tri") -> DataFrame:
    """triangles with place: a cache-friendly order inside each primitive."""
    kind = triangles.schema[group].dataType.simpleString()

    def run(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(order).reset_index(drop=True)
        picked = found.iloc[cache_order(found)]
        return picked.assign(place=range(len(picked)))[[group, order, "i0", "i1", "i2", "place"]]

    return triangles.groupBy(group).applyInPandas(run, f"{group} {kind}, {order} bigint, i0 bigint, i1 bigint, i2 bigint, place bigint")

