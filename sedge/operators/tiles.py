"""Operators on tile trees: frames with tile_id, parent_id and per-tile columns. Trees are walked level by level with joins."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..storage import cut
from .ordinals import running_sum

#: Places that a task of nearest_groups compares with those around them, in the mean.
PLACES_IN_TASK = 1000

SIDES = [f"{m}_{a}" for a in "xy" for m in ("min", "max")]


def world_transforms(tiles: DataFrame, transform: str = "transform", most_depth: int = 64) -> DataFrame:
    """tile_id, depth and world: the product of the transforms from the root down. One join per level of the tree."""
    own = tiles.select("tile_id", "parent_id", F.col(transform).alias("_own"))
    level = own.where("parent_id IS NULL").select("tile_id", F.lit(0).alias("depth"), F.col("_own").alias("world"))
    out = level
    for depth in range(1, most_depth):
        step = own.join(level.select(F.col("tile_id").alias("parent_id"), F.col("world").alias("_above")), "parent_id")
        level = cut(step.select("tile_id", F.lit(depth).alias("depth"), G.multiply(F.col("_above"), F.col("_own")).alias("world")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {most_depth} levels")


def climb(tiles: DataFrame, start: DataFrame, merge: list[Column], most_depth: int = 64) -> DataFrame:
    """What the start tiles (tile_id and columns) give to themselves and to every tile above them, merged on the way up.

    merge holds one aggregate per column, such as a minimum, whose merging does not depend on order; rows are merged at
    every level, so that a level never has more rows than it has tiles.
    """
    names = [c for c in start.columns if c != "tile_id"]
    parents = tiles.select("tile_id", "parent_id").where("parent_id IS NOT NULL")
    level = cut(start)
    out = level
    for _ in range(most_depth):
        level = cut(level.join(parents, "tile_id").drop("tile_id").withColumnRenamed("parent_id", "tile_id").groupBy("tile_id").agg(*merge))
        if level.isEmpty():
            return out.groupBy("tile_id").agg(*merge).select("tile_id", *names)
        out = out.unionByName(level)
    raise ValueError(f"deeper than {most_depth} levels")


def union_bounds(boxes: DataFrame, *keys: str) -> DataFrame:
    """Bounds of all boxes of a key: least of the minima, greatest of the maxima."""
    return boxes.groupBy(*keys).agg(*[F.min(c).alias(c) if c.startswith("min") else F.max(c).alias(c) for c in SIDES])


def rolled_up_bounds(tiles: DataFrame) -> DataFrame:
    """tile_id and bounds: of a tile without children its own, of others the union of those below."""
    inner = tiles.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("tile_id")).distinct()
    leaves = tiles.join(inner, "tile_id", "left_anti").select("tile_id", *SIDES)
    return climb(tiles, leaves, [F.min(c).alias(c) if c.startswith("min") else F.max(c).alias(c) for c in SIDES])


def pruned(tiles: DataFrame, has_content: Column) -> DataFrame:
    """Tiles with content, or with a tile below that has it."""
    start = tiles.where(has_content).select("tile_id", F.lit(1).alias("_kept"))
    return tiles.join(climb(tiles, start, [F.max("_kept").alias("_kept")]).select("tile_id"), "tile_id", "left_semi")


def box_of(low: list[Column], high: list[Column], least_half: float = 0.001) -> Column:
    """Centre and three half axes of bounds, none thinner than least_half."""
    centre = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    half = [F.greatest((b - a) / 2, F.lit(least_half)) for a, b in zip(low, high, strict=True)]
    axes = [half[k] if k == j else F.lit(0.0) for j in range(3) for k in range(3)]
    return F.array(*centre, *axes)


def bounds_of_box(box: Column) -> tuple[list[Column], list[Column]]:
    """Bounds of a centre and three half axes (the axes may be turned)."""
    reach = [F.abs(box[3 + k]) + F.abs(box[6 + k]) + F.abs(box[9 + k]) for k in range(3)]
    return [box[k] - reach[k] for k in range(3)], [box[k] + reach[k] for k in range(3)]


def geometric_error(half: list[Column]) -> Column:
    """Half the norm of the half diagonal, at least 1."""
    return F.greatest(F.lit(1.0), F.sqrt(half[0] * half[0] + half[1] * half[1] + half[2] * half[2]) / 2)


def choose_grid(span_x: float, span_y: float, parts: int) -> tuple[int, int]:
    """Columns and rows of a grid of at least `parts` cells that are close to squares.

    Fixed values: the number of columns, rounded half up and kept within 1 and parts, and the least span.
    """
    columns = math.floor(math.sqrt(parts * max(span_x, 0.001) / max(span_y, 0.001)) + 0.5)
    columns = max(1, min(parts, columns))
    return columns, math.ceil(parts / columns)


def grid_cell(x: Column, y: Column, low: tuple, high: tuple, grid: tuple[int, int]) -> Column:
    """Number of the grid cell of a point, row by row; points outside go to the nearest cell."""

    def place(value: Column, a: float, b: float, n: int) -> Column:
        if n <= 1 or b <= a:
            return F.lit(0)
        return F.least(F.greatest(F.floor((value - F.lit(a)) / F.lit(b - a) * n), F.lit(0)), F.lit(n - 1)).cast("int")

    return place(y, low[1], high[1], grid[1]) * grid[0] + place(x, low[0], high[0], grid[0])


def lod_candidates(tiles: DataFrame, least_bytes: int = 256 << 10, least_triangles: int = 200, ratio: float = 0.25) -> DataFrame:
    """Tiles large enough for a coarse version, with its number of triangles."""
    target = F.greatest(F.lit(1), F.floor(F.col("triangles") * ratio)).cast("bigint")
    return tiles.where((F.col("bytes") >= least_bytes) & (F.col("triangles") >= least_triangles)).withColumn("lod_triangles", target).where("lod_triangles < triangles")


def with_lod(tiles: DataFrame, chosen: DataFrame, shift: int) -> DataFrame:
    """The tree with coarse content on chosen tiles and their exact content on a new child (id + shift) that replaces it."""
    named = tiles.join(chosen.select("tile_id", F.lit(True).alias("_lod")), "tile_id", "left")
    error = F.when(F.col("geometric_error") > 0, F.col("geometric_error")).otherwise(geometric_error([F.col("half_x"), F.col("half_y"), F.col("half_z")]))
    coarse = named.select("tile_id", "parent_id", F.when(F.col("_lod"), F.concat(F.regexp_replace("uri", r"\.b3dm$", ""), F.lit("_lod.b3dm"))).otherwise(F.col("uri")).alias("uri"), F.round(F.when(F.col("_lod"), error).otherwise(F.col("geometric_error")), 6).alias("geometric_error"), F.when(F.col("_lod"), F.coalesce("refine", F.lit("REPLACE"))).otherwise(F.col("refine")).alias("refine"))
    exact = named.where("_lod").select((F.col("tile_id") + shift).alias("tile_id"), F.col("tile_id").alias("parent_id"), "uri", F.lit(0.0).alias("geometric_error"), F.lit("REPLACE").alias("refine"))
    return coarse.unionByName(exact)


def size_class(size: Column) -> Column:
    """Sizes up to 1, 2, 4, 8 ... Larger sizes never have a smaller class."""
    return F.ceil(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def nearest_groups(groups: DataFrame, most_size: int, most_in_cell: int = 64) -> DataFrame:
    """group_id, target_id, d2: the nearest other group (squared distance of centres) that leaves a joint size within most_size.

    Groups look into the grid cells around their own, and the grid gets four times as coarse until the best distance found is
    shorter than a cell, so that nothing outside can be nearer. The first grid is as fine as it takes for no cell to be
    crowded. Cells are listed by size class, and a group looks up the classes that it has room for. Groups of equal centre and
    size are one place with its two smallest ids: no more are needed to give each of them another. Ties go to the smaller id.
    """
    axes = ["cx", "cy", "cz"]
    sized = groups.select("group_id", "size", *[F.col(c).cast("double").alias(c) for c in axes])
    first = F.row_number().over(Window.partitionBy(*axes, "size").orderBy("group_id"))
    places = cut(sized.withColumn("_k", first).where("_k <= 2").groupBy(*axes, "size").agg(F.sort_array(F.collect_list("group_id")).alias("ids")).withColumn("place", F.col("ids")[0]))
    seen = places.agg(F.count("*").alias("n"), F.min("size").alias("least"), *[f(c).alias(f"{f.__name__}_{c}") for c in axes for f in (F.min, F.max)]).first()
    spans = {c: seen[f"max_{c}"] - seen[f"min_{c}"] for c in axes} if seen["n"] else {}
    wide = [c for c in axes if spans.get(c)]
    width = math.prod(spans[c] / max(seen["n"], 1) ** (1 / len(wide)) for c in wide) ** (1 / len(wide)) if wide else 1.0

    def cells(width: float) -> list[Column]:
        return [F.floor((F.col(c) - F.lit(seen[f"min_{c}"])) / F.lit(width)) if c in wide else F.lit(0).cast("long") for c in axes]

    while wide and places.groupBy(*cells(width)).count().agg(F.max("count")).first()[0] > most_in_cell and width > max(spans.values()) * 2.0**-48:
        width /= 4
    room = F.lit(most_size) - F.col("size")
    waiting = places.where(room >= (seen["least"] or 0)).withColumn("need", F.when(F.col("size") <= room, 2).otherwise(1))
    found = None
    while seen["n"]:
        names = ["_x", "_y", "_z"]
        targets = places.select(F.col("ids").alias("t_ids"), F.col("size").alias("t_size"), *[F.col(c).alias(f"t_{c}") for c in axes], *[x.alias(n) for x, n in zip(cells(width), names, strict=True)], size_class(F.col("size")).alias("_class"))
        probes = waiting.withColumn("_class", F.explode(F.sequence(F.lit(0), size_class(room))))
        for x, n, c in zip(cells(width), names, axes, strict=True):
            probes = probes.withColumn(n, F.explode(F.array(x - 1, x, x + 1)) if c in wide else x)
        # Pairs are ranked in the task that meets them, before any shuffle: what a task holds follows from its share of places.
        probes, targets = (x.repartition(-(-seen["n"] // PLACES_IN_TASK), *names, "_class") for x in (probes, targets))
        met = probes.join(targets, [*names, "_class"]).where(F.col("t_size") <= room)
        d2 = sum(((F.col(f"t_{c}") - F.col(c)) * (F.col(f"t_{c}") - F.col(c)) for c in axes[1:]), (F.col("t_cx") - F.col("cx")) * (F.col("t_cx") - F.col("cx")))
        near = Window.partitionBy("place").orderBy("d2", "target_id")
        best = met.select("place", "need", d2.alias("d2"), F.explode("t_ids").alias("target_id")).withColumn("_k", F.row_number().over(near)).where("_k <= 2")
        whole = width > max(spans.values(), default=0)
        ready = best.groupBy("place", "need").agg(F.array_sort(F.collect_list(F.struct("d2", "target_id"))).alias("best"))
        if not whole:
            ready = ready.where((F.size("best") >= F.col("need")) & (F.element_at("best", F.least(F.col("need"), F.size("best")))["d2"] < F.lit(width * width)))
        ready = cut(ready.select("place", "best"))
        found = ready if found is None else found.unionByName(ready)
        waiting = cut(waiting.join(ready, "place", "left_anti"))
        if whole or waiting.isEmpty():
            break
        width *= 4
    if found is None:
        return groups.sparkSession.createDataFrame([], "group_id bigint, target_id bigint, d2 double")
    answers = places.select(*axes, "size", "place").join(found, "place").drop("place")
    other = F.filter("best", lambda b: b["target_id"] != F.col("group_id"))
    return sized.join(answers, [*axes, "size"]).select("group_id", F.get(other, F.lit(0)).alias("m")).where("m IS NOT NULL").select("group_id", "m.target_id", "m.d2")


def quarter() -> Column:
    """The quadrant, 0 to 3, of x and y about the middle of the bounds g_min_x ... g_max_y."""
    east, north = (F.col(a) >= (F.col(f"g_min_{a}") + F.col(f"g_max_{a}")) / 2 for a in "xy")
    return east.cast("int") + 2 * north.cast("int")


def _runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a sorted array begins, and each row's number among the values."""
    first = np.r_[True, of[1:] != of[:-1]]
    return np.flatnonzero(first), np.cumsum(first) - 1


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy() for c in names]


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    return np.argsort(pc.sort_indices(ids).to_numpy(), kind="stable")


def _named(column: str, kept: list[str], name: Callable[[pa.Table], list[str]]) -> Callable[[pa.Table], pa.Table]:
    """A task's function of a group: the kept columns, and the name of each row."""

    def run(rows: pa.Table) -> pa.Table:
        return rows.select(kept).append_column(column, pa.array(name(rows), pa.string()))

    return run


def _usable(*names: str) -> Column:
    """No value of the group is null or not a number, so that sorting in a task is sorting in Spark."""
    odd = F.col("tile_id").isNull()
    for c in names:
        odd |= F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return F.count_if(odd) == 0


def _cells(rows: pa.Table, target: int, most_levels: int) -> list[str]:
    """The final cell of each row of one cell, all its levels one after the other."""
    x, y, *sides = _numbers(rows, "x", "y", *SIDES)
    rank, names, out = _ranks(rows["tile_id"]), [rows["cell"][0].as_py()], np.empty(rows.num_rows, object)
    at, of = np.arange(rows.num_rows), np.zeros(rows.num_rows, int)
    for _ in range(most_levels):
        starts, run = _runs(of)
        n = np.diff(np.r_[starts, len(at)])
        low_x, high_x, low_y, high_y = ((np.minimum if "min" in c else np.maximum).reduceat(v[at], starts) for c, v in zip(SIDES, sides, strict=True))
        ready = n[run] <= target
        out[at[ready]] = np.array(names, object)[of[ready]]
        quarter = (x[at] >= ((low_x + high_x) / 2)[run]).astype(int) + 2 * (y[at] >= ((low_y + high_y) / 2)[run]).astype(int)
        one = np.minimum.reduceat(quarter, starts) == np.maximum.reduceat(quarter, starts)
        order = np.lexsort((rank[at], np.where((high_x - low_x >= high_y - low_y)[run], x[at], y[at]), run))
        place = np.empty(len(at), int)
        place[order] = np.arange(len(at)) - starts[run]
        code = np.where(one[run], np.where(place < (n[run] + 1) // 2, 4, 5), quarter)
        at, keys = at[~ready], (of * 6 + code)[~ready]
        if not len(at):
            return list(out)
        order = np.argsort(keys, kind="stable")
        found, of = np.unique(keys[order], return_inverse=True)
        at, names = at[order], [names[k // 6] + "0123ab"[k % 6] for k in found]
    raise ValueError("cells do not get smaller")


def quadtree_split(tiles: DataFrame, target: int = 12, most_levels: int = 40, rows_in_task: int = 50_000) -> DataFrame:
    """tile_id and cell: tiles split in quadrants at the middle of their cell's bounds until a cell has `target` or fewer.

    Cells that quadrants cannot split are halved by rank along their longer axis. All cells of a level that have more than
    rows_in_task tiles are split in one pass: bounds by a grouping, quadrants by a join; only cells that need the ranks sort
    their rows. A smaller cell is split to its end in one task.
    """
    now = cut(tiles.select("tile_id", "x", "y", F.lit("").alias("cell"), *SIDES))
    done = None
    for level in range(most_levels):
        bounds = [(F.min if c.startswith("min") else F.max)(c).alias(f"g_{c}") for c in SIDES]
        small = ((F.count("*") <= rows_in_task) & _usable("x", "y", *SIDES)).alias("small")
        split = now.join(cut(now.groupBy("cell").agg(F.count("*").alias("n"), small, *bounds)), "cell")
        ready = split.where((F.col("n") <= target) & ~F.col("small")).select("tile_id", "cell")
        finished = split.where("small").select(now.columns).groupBy("cell").applyInArrow(_named("cell", ["tile_id"], partial(_cells, target=target, most_levels=most_levels - level)), ready.schema).unionByName(ready)
        done = finished if done is None else done.unionByName(finished)
        rest = split.where((F.col("n") > target) & ~F.col("small")).withColumn("quarter", quarter())
        shares = rest.groupBy("cell").agg(F.count_distinct("quarter").alias("quarters"))
        rest = rest.join(shares, "cell")
        by_quarter = rest.where("quarters > 1").withColumn("cell", F.concat("cell", F.col("quarter").cast("string")))
        along = F.when(F.col("g_max_x") - F.col("g_min_x") >= F.col("g_max_y") - F.col("g_min_y"), F.col("x")).otherwise(F.col("y"))
        place = F.row_number().over(Window.partitionBy("cell").orderBy(along, "tile_id"))
        by_half = rest.where("quarters = 1").withColumn("_place", place).withColumn("cell", F.concat("cell", F.when(F.col("_place") <= F.ceil(F.col("n") / 2), "a").otherwise("b")))
        now = cut(by_quarter.select(now.columns).unionByName(by_half.select(now.columns)))
        if now.isEmpty():
            return done
    raise ValueError("cells do not get smaller")


class _Near:
    """Groups in order, in blocks under a binary tree whose nodes hold the bounds of their centres and their least size."""

    BLOCK = 8

    def __init__(self, size: list[float], centre: list[tuple[float, float, float]]):
        self.size, self.centre = size, centre  # a group that is gone has the size infinity
        self.leaves = 1 << max(0, (-(-len(size) // self.BLOCK) - 1).bit_length())
        self.nodes: list[tuple] = [()] * (2 * self.leaves)
        for node in range(2 * self.leaves - 1, 0, -1):
            self.nodes[node] = self._of(node)

    def _of(self, node: int) -> tuple:
        """Least size, lower and upper bounds."""
        if node < self.leaves:
            a, b = self.nodes[2 * node], self.nodes[2 * node + 1]
            return (min(a[0], b[0]), min(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]), max(a[4], b[4]), max(a[5], b[5]), max(a[6], b[6]))
        first = (node - self.leaves) * self.BLOCK
        here = [k for k in range(first, min(first + self.BLOCK, len(self.size))) if self.size[k] < math.inf]
        if not here:
            return (math.inf,) * 4 + (-math.inf,) * 3
        return (min(self.size[k] for k in here), *map(min, zip(*(self.centre[k] for k in here))), *map(max, zip(*(self.centre[k] for k in here))))

    def changed(self, k: int) -> None:
        node = self.leaves + k // self.BLOCK
        while node:
            new = self._of(node)
            if new == self.nodes[node]:
                return
            self.nodes[node] = new
            node //= 2

    def nearest(self, k: int, room: float) -> int | None:
        """The nearest other group of a size within room; the first of equally near ones."""
        x, y, z = self.centre[k]
        best, found = math.inf, len(self.size)
        depth = self.leaves.bit_length()
        up = self.leaves + k // self.BLOCK
        stack = [up]
        while up:
            while stack:
                n = stack.pop()
                least, x0, y0, z0, x1, y1, z1 = self.nodes[n]
                if least > room:
                    continue
                dx = x0 - x if x < x0 else x - x1 if x > x1 else 0.0
                dy = y0 - y if y < y0 else y - y1 if y > y1 else 0.0
                dz = z0 - z if z < z0 else z - z1 if z > z1 else 0.0
                apart, first = dx * dx + dy * dy + dz * dz, ((n << (depth - n.bit_length())) - self.leaves) * self.BLOCK
                if apart > best or apart == best and first > found:
                    continue
                if n < self.leaves:
                    stack += [2 * n + 1, 2 * n]
                    continue
                for j in range(first, min(first + self.BLOCK, len(self.size))):
                    if self.size[j] <= room and j != k:
                        a, b, c = self.centre[j]
                        d = (a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z)
                        if d < best or d == best and j < found:
                            best, found = d, j
            # On the way up, the other half of every node above.
            stack, up = [up ^ 1] if up > 1 else [], up // 2
        return found if found < len(self.size) else None


def merge_small(groups: list[tuple[str, int, float, float, float]], least: int, most: int) -> dict[str, str]:
    """Which group each small group joins: again and again the smallest below `least` goes to the nearest that has room.

    Input: name, size and centre of each group; output: final name of every group. A sequence of choices, made on group
    summaries (one row per group), never on their members. The nearest group is looked up in a tree over the groups in the
    order of their names, which brings quadtree cells that are near in space near each other; with other names the result
    is the same, in more time.
    """
    ordered = sorted(groups)
    size = [float(g[1]) for g in ordered]
    total = [(g[2] * g[1], g[3] * g[1], g[4] * g[1]) for g in ordered]
    near_by = _Near(size, [(t[0] / n, t[1] / n, t[2] / n) for t, n in zip(total, size, strict=True)])
    into = list(range(len(ordered)))
    waiting = [(n, k) for k, n in enumerate(size) if n < least]
    heapq.heapify(waiting)
    while waiting:
        n, small = heapq.heappop(waiting)
        if size[small] != n:
            continue
        near = near_by.nearest(small, most - n)
        if near is None:
            break
        total[near] = tuple(a + b for a, b in zip(total[near], total[small], strict=True))
        into[small], size[small] = near, math.inf
        size[near] += n
        near_by.centre[near] = tuple(t / size[near] for t in total[near])
        near_by.changed(small)
        near_by.changed(near)
        if size[near] < least:
            heapq.heappush(waiting, (size[near], near))
    names = {}
    for k, g in enumerate(ordered):
        while into[k] != k:
            into[k] = into[into[k]]
            k = into[k]
        names[g[0]] = ordered[k][0]
    return names


def _parts(rows: pa.Table, most_bytes: int, most_span: float | None, low: list[str], high: list[str], most_rounds: int) -> list[str]:
    """The final part of each row of one part, all its rounds one after the other."""
    size, x, y = _numbers(rows, "bytes", "x", "y")
    lows, highs = _numbers(rows, *low), _numbers(rows, *high)
    rank, ids, names = _ranks(rows["tile_id"]), rows["tile_id"].cast(pa.string()).to_pylist(), [rows["part"][0].as_py()]
    at, of, out, weight = np.arange(rows.num_rows), np.zeros(rows.num_rows, int), [""] * rows.num_rows, size + 1
    for _ in range(most_rounds):
        starts, run = _runs(of)
        spans = [np.maximum.reduceat(b[at], starts) - np.minimum.reduceat(a[at], starts) for a, b in zip(lows, highs, strict=True)]
        light = size[at] < most_bytes
        over = np.add.reduceat(size[at], starts) > most_bytes
        if most_span is not None:
            over |= np.maximum(*spans) > most_span
        over &= np.diff(np.r_[starts, len(at)]) > 1
        alone = over[run] & (~light | (np.add.reduceat(light.astype(int), starts) == 1)[run])
        for k, g in zip(at[~over[run]], of[~over[run]], strict=True):
            out[k] = names[g]
        for k, g in zip(at[alone], of[alone], strict=True):
            out[k] = f"{names[g]}one {ids[k]}"
        rest = over[run] & ~alone
        at, of, wide = at[rest], of[rest], (spans[0] >= spans[1])[run][rest]
        if not len(at):
            return out
        order = np.lexsort((rank[at], np.where(wide, x[at], y[at]), of))
        at, of = at[order], of[order]
        starts, run = _runs(of)
        w, total = weight[at], np.add.reduceat(weight[at], starts)[run]
        before = np.cumsum(w) - w
        before -= before[starts][run]
        left = (before == 0) | (2 * before + w <= total) & (before + w < total)
        found, of = np.unique(2 * of + ~left, return_inverse=True)
        names = [names[k // 2] + "lr"[k % 2] for k in found]
    raise ValueError("parts do not get smaller")


def split_overfull(members: DataFrame, most_bytes: int, most_span: float | None = None, most_rounds: int = 64, rows_in_task: int = 50_000) -> DataFrame:
    """members (group_name, tile_id, bytes, x, y) with part: parts of a group keep within both limits, or are single members.

    A part over a limit gives up the members that reach the byte limit by themselves, and the others are halved where half
    of their weight (bytes, and one for each) lies before, along the longer axis. All parts of a round that have more than
    rows_in_task members are halved at once, by running sums over ranges; a smaller part is halved to its end in one task.
    The span counts the members' sides where they have them, else their centres.
    """
    low, high = (([f"{m}_{a}" for a in "xy"] if set(SIDES) <= set(members.columns) else ["x", "y"]) for m in ("min", "max"))
    keys, span = ["group_name", "part"], [F.max(b) - F.min(a) for a, b in zip(low, high, strict=True)]
    weight = F.col("bytes") + 1
    now = cut(members.withColumn("part", F.lit("")))
    names = [c for c in now.columns if c != "part"]
    small = ((F.count("*") <= rows_in_task) & (F.min("bytes") >= 0) & _usable("bytes", "x", "y", *low, *high)).alias("_small")
    done = None
    for k in range(most_rounds):
        over = F.sum("bytes") > most_bytes if most_span is None else (F.sum("bytes") > most_bytes) | (F.greatest(*span) > most_span)
        stats = now.groupBy(*keys).agg(small, (over & (F.count("*") > 1)).alias("_over"), (span[0] >= span[1]).alias("_wide"), F.sum(F.when(F.col("bytes") < most_bytes, weight)).alias("_weight"), F.count_if(F.col("bytes") < most_bytes).alias("_n"))
        stats = cut(stats.withColumnsRenamed({k: f"_{k}" for k in keys}))
        known = now.join(stats, F.col("group_name").eqNullSafe(F.col("_group_name")) & (F.col("part") == F.col("_part"))).drop("_group_name", "_part")
        alone = F.col("_over") & ((F.col("bytes") >= most_bytes) | (F.col("_n") == 1))
        # Small parts: rows keep their columns, the part is put last as in now.
        name = _named("part", names, partial(_parts, most_bytes=most_bytes, most_span=most_span, low=low, high=high, most_rounds=most_rounds - k))
        finished = known.where("_small").select(*names, "part").groupBy(*keys).applyInArrow(name, now.select(*names, "part").schema)
        large = known.where(~F.col("_small"))
        ready = large.where(~F.col("_over") | alone).withColumn("part", F.when(alone, F.concat("part", F.lit("one "), F.col("tile_id").cast("string"))).otherwise(F.col("part")))
        ended = finished.unionByName(ready.select(*names, "part"))
        done = ended if done is None else done.unionByName(ended)
        rest = large.where(F.col("_over") & ~alone).withColumn("_along", F.when(F.col("_wide"), F.col("x")).otherwise(F.col("y")))
        if rest.isEmpty():
            return done
        halved = running_sum(rest, "_before", weight, keys, "_along", "tile_id")
        left = (F.col("_before") == 0) | (2 * F.col("_before") + weight <= F.col("_weight")) & (F.col("_before") + weight < F.col("_weight"))
        now = cut(halved.withColumn("part", F.concat("part", F.when(left, "l").otherwise("r"))).select(*names, "part"))
    raise ValueError("parts do not get smaller")


def quadtree_groups(tiles: DataFrame, target: int = 12, least: int = 8, most: int = 16) -> DataFrame:
    """tile_id and group_name: quadtree cells, small ones merged with near ones."""
    cells = cut(quadtree_split(tiles, target))
    sums = cells.join(tiles.select("tile_id", "x", "y"), "tile_id").groupBy("cell").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    rows = sums.toArrow()
    into = merge_small(list(zip(*(rows[c].to_pylist() for c in ("cell", "n", "x", "y")), [0.0] * rows.num_rows)), least, most)
    named = pa.table({"cell": pa.array(into.keys(), pa.string()), "group_name": pa.array(into.values(), pa.string())})
    return cells.join(tiles.sparkSession.createDataFrame(named), "cell").select("tile_id", "group_name")
