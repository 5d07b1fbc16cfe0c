"""Compositions: a whole mesh report, and the way from triangles to capped surface points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mesh as M
from ..operators import tiles as T
from ..operators.ordinals import running_cap
from ..storage import cut


def mesh_report(triangles: DataFrame, vertices: DataFrame, epsilon: float, **limits) -> DataFrame:
    """One row: quality counters, bounds, duplicate faces and edge sharing. Triangles are placed and measured once."""
    found = cut(M.measured(M.with_positions(triangles, vertices)))
    parts = [M.quality(found, **limits), M.bounds(vertices), M.duplicate_faces(found, epsilon).drop("faces"), M.edge_sharing(found, epsilon)]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each


def capped_splats(placed: DataFrame, most: int, **options) -> DataFrame:
    """Surface points of triangles in order until `most` of them: whole triangles, and the first points of the last one."""
    points = cut(M.splats(placed, **options))
    counts = points.groupBy("tri").agg(F.count("*").alias("n"))
    granted = running_cap(counts, "n", most, "tri").select("tri", "granted")
    return points.join(granted, "tri").where(F.col("s") < F.col("granted")).drop("granted")


def retile(placed: DataFrame, most_triangles: int = 12_000, most_parts: int = 16) -> DataFrame:
    """placed with part: the cell of a grid over the mesh that holds the triangle's middle. Every triangle is in one part.

    The grid has about triangles / most_triangles cells, within 2 and most_parts; a small mesh is one part.
    """
    middle = M.centroids(placed)
    whole = middle.agg(F.count("*").alias("n"), *[f(F.col(p)[k]).alias(f"{m}_{a}_{p}") for p in ("p0", "p1", "p2") for k, a in enumerate("xy") for m, f in (("min", F.min), ("max", F.max))]).first()
    if whole["n"] <= most_triangles:
        return middle.withColumn("part", F.lit(0))
    low = tuple(min(whole[f"min_{a}_{p}"] for p in ("p0", "p1", "p2")) for a in "xy")
    high = tuple(max(whole[f"max_{a}_{p}"] for p in ("p0", "p1", "p2")) for a in "xy")
    parts = min(most_parts, max(2, -(-whole["n"] // most_triangles)))
    return middle.withColumn("part", T.grid_cell(F.col("cx"), F.col("cy"), low, high, T.choose_grid(high[0] - low[0], high[1] - low[1], parts)))
