"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions by several random rotations, shifted, cut into cells and put in order along a
Hilbert curve, once per rotation. A neighbour is looked for among the rows within a window of places around the query's own
on every curve. The window is measured, not guessed: for a bounded sample of vectors the true neighbours are found by brute
force over all rows, and the window is the width that holds the wanted share of them. Windows of all curves are merged and
ranked by exact distance.

Equal vectors are one place on the curves, with the smallest ids that a query could need, so that copies neither crowd a
range nor hide other neighbours.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components take no part, nor do rows
without vec_id; a query never finds its own vec_id; repeated rows count once; vectors are compared with those of their own
length; fewer candidates than wanted are all returned; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordinals import with_ordinal
from .common import cut

#: Fit: curves, projected dimensions, bits per dimension (a key has 60), sampled vectors and the share of their neighbours that windows hold.
CURVES, DIMENSIONS, BITS, SAMPLE, SHARE = 8, 6, 10, 256, 0.97
#: Rows of a range, the piece of a curve that one step compares with the queries that reach into it.
RANGE_ROWS = 4096
WANTED = 10


def usable(vector: Column) -> Column:
    """True for vectors of finite components of which one at least isn't zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v, and k1 and k2, which name the vector (128 bits of hash); negative zeros are zeros."""
    v = F.transform(F.col(column), lambda x: x + F.lit(0).cast("float"))
    taken = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col(column))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return taken.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(7), "v")})


def distinct_vectors(rows: DataFrame, wanted: int) -> DataFrame:
    """k1, k2, v and ids of each vector: its wanted + 1 smallest, which is all that a query can need of it."""
    place = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = rows.withColumn("_place", place).where(F.col("_place") <= wanted + 1)
    return few.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of rows of cells: Gray-code exchanges and inversions from the highest bit down, then
    the bits of all dimensions interleaved."""
    x, one, zero = cells.T.astype(np.uint64), np.uint64(1), np.uint64(0)
    for b in range(bits - 1, 0, -1):
        bit = one << np.uint64(b)
        low = bit - one
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swap = np.where(on, zero, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one != 0, (one << np.uint64(b)) - one, zero)
    x ^= turn
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key


def curve_keys(matrix: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit directions on one curve: a random rotation of its own, scaled to the spread of its coordinates, and a shift."""
    size = matrix.shape[1]
    random = np.random.default_rng([curve, size])
    dims = min(DIMENSIONS, size)
    axes = np.linalg.qr(random.normal(size=(size, dims)))[0]
    # Coordinates of unit vectors lie within a few standard deviations of 1 / sqrt(size); lengths are a matter of the ranking.
    at = (matrix @ axes) * np.sqrt(size) / 8 + 0.5 + (random.uniform(size=dims) - 0.5) / 8
    return hilbert_keys(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1), BITS).astype(np.int64)


def place_on_curves(batches: Iterator[pd.DataFrame], curves: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for size, rows in batch.groupby(batch["v"].map(len)):
            matrix = np.array(rows["v"].tolist(), float)
            top = np.abs(matrix).max(axis=1, keepdims=True)
            matrix = matrix / top  # so that squares neither vanish nor overflow
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
            for c in range(curves):
                yield pd.DataFrame({"size": size, "curve": c, "key": curve_keys(matrix, c), "k1": rows["k1"], "k2": rows["k2"]})


def positions(found: DataFrame, curves: int) -> DataFrame:
    """size, curve, k1, k2 and at: the place in the order by size, curve and key. Ties go by the vector's name."""
    placed = found.select("v", "k1", "k2").mapInPandas(lambda b: place_on_curves(b, curves), "size int, curve int, key long, k1 long, k2 long")
    return cut(with_ordinal(placed, "at", "size", "curve", "key", "k1", "k2").drop("key"))


def distances(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((matrix - query) ** 2).sum(axis=1))


def nearest(matrix: np.ndarray, squares: np.ndarray, query: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n smallest distances, with all that tie with the last one, and their distances.

    Products only tell which rows are far; what is left is measured by differences.
    """
    if len(matrix) > 4 * n:
        own = query @ query
        with np.errstate(all="ignore"):
            rough = squares + own - 2 * (matrix @ query)
            slack = 1e-9 * (squares + own)
        if np.isfinite(rough).all():
            at = np.flatnonzero(rough - slack <= np.partition(rough + slack, n - 1)[n - 1])
        else:
            at = np.arange(len(matrix))
    else:
        at = np.arange(len(matrix))
    d = distances(matrix[at], query)
    if len(at) > n:
        near = d <= np.partition(d, n - 1)[n - 1]
        at, d = at[near], d[near]
    return at, d


def brute_force(found: DataFrame, sample: list, n: int) -> DataFrame:
    """q, k1, k2 and score: the n nearest of every sampled vector among all distinct ones, its own left out."""
    held = found.sparkSession.sparkContext.broadcast([(r["k1"], r["k2"], np.array(r["v"], float)) for r in sample])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for size, rows in batch.groupby(batch["v"].map(len)):
                matrix = np.array(rows["v"].tolist(), float)
                squares, k1, k2 = (matrix**2).sum(axis=1), rows["k1"].to_numpy(), rows["k2"].to_numpy()
                for q, (a, b, vector) in enumerate(held.value):
                    if len(vector) == size:
                        at, d = nearest(matrix, squares, vector, n + 1)
                        out += [(q, k1[i], k2[i], x) for i, x in zip(at, d, strict=True) if (k1[i], k2[i]) != (a, b)]
            yield pd.DataFrame(out, columns=["q", "k1", "k2", "score"]).astype({"q": "int32", "k1": "int64", "k2": "int64", "score": "float64"})

    met = found.select("v", "k1", "k2").mapInPandas(search, "q int, k1 long, k2 long, score double")
    return met.withColumn("_place", F.row_number().over(Window.partitionBy("q").orderBy("score", "k1", "k2"))).where(F.col("_place") <= n).drop("_place")


def window_width(found: DataFrame, placed: DataFrame, *, sample: int = SAMPLE, share: float = SHARE, wanted: int = WANTED) -> int:
    """How many places to either side hold the wanted share of the sampled vectors' neighbours on some curve.

    The sample is bounded; brute force for it is one pass over all rows, and its few neighbours are broadcast.
    """
    chosen = found.orderBy(F.xxhash64("k1", "k2"), "k1", "k2").limit(sample).select("k1", "k2", "v").collect()
    if not chosen:
        return 1
    near = brute_force(found, chosen, wanted).select("q", "k1", "k2")
    own = found.sparkSession.createDataFrame([(q, r["k1"], r["k2"]) for q, r in enumerate(chosen)], "q int, k1 long, k2 long")
    # sample * wanted rows at most
    of = lambda pairs, name: placed.join(F.broadcast(pairs), ["k1", "k2"]).select("q", "curve", "size", *([] if name == "own" else ["k1", "k2"]), F.col("at").alias(name))
    apart = of(near, "near").join(of(own, "own"), ["q", "curve", "size"]).groupBy("q", "k1", "k2").agg(F.min(F.abs(F.col("near") - F.col("own"))).alias("apart"))
    width = apart.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY apart)")).first()[0]
    return max(1, int(width or 1))


def search_ranges(batches: Iterator[pd.DataFrame], width: int, n: int) -> Iterator[pd.DataFrame]:
    """Rows of ranges, each range's candidates before its queries: q1, q2, score and vec_id of the best in every window.

    One range of candidates is held at a time; queries pass by.
    """
    now, pieces, ready = None, [], None

    def build():
        rows = pd.concat(pieces, ignore_index=True).sort_values("at")
        groups = {}
        for key, part in rows.groupby(["size", "curve"]):
            matrix = np.array(part["v"].tolist(), float)
            groups[key] = (part["at"].to_numpy(), matrix, (matrix**2).sum(axis=1), part["ids"].tolist())
        return groups

    for batch in batches:
        out = []
        for (number, asked), rows in batch.groupby(["range", "asked"], sort=True):
            if number != now:
                now, pieces, ready = number, [], None
            if not asked:
                pieces.append(rows)
                continue
            if ready is None:
                ready = build() if pieces else {}
                pieces = []
            for r in rows.itertuples(index=False):
                if (r.size, r.curve) not in ready:
                    continue
                at, matrix, squares, ids = ready[r.size, r.curve]
                low, high = np.searchsorted(at, [r.at - width, r.at + width + 1])
                if low == high:
                    continue
                near, score = nearest(matrix[low:high], squares[low:high], np.array(r.v, float), n + 1)
                found = sorted((s, i) for k, s in zip(near, score, strict=True) for i in ids[low + k])[: n + 1]
                out += [(r.k1, r.k2, s, i) for s, i in found]
        yield pd.DataFrame(out, columns=["q1", "q2", "score", "vec_id"]).astype({"q1": "int64", "q2": "int64", "score": "float64", "vec_id": "int64"})


def search(embeddings: DataFrame, asked: Column, *, column: str = "embedding", wanted: int = WANTED, curves: int = CURVES, sample: int = SAMPLE, share: float = SHARE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest rows found for every row that is asked for."""
    rows = vectors(embeddings, column)
    found = cut(distinct_vectors(rows, wanted))
    placed = positions(found, curves)
    width = window_width(found, placed, sample=sample, share=share, wanted=wanted)
    queries = rows.where(asked).select("vec_id", "k1", "k2").distinct()
    named = found.join(placed.groupBy("k1", "k2").agg(F.first("size").alias("size"), F.collect_list(F.struct("curve", "at")).alias("p")), ["k1", "k2"])
    named = named.select("k1", "k2", "v", "ids", "size", F.explode("p").alias("p")).select("k1", "k2", "v", "ids", "size", "p.curve", "p.at")
    number = lambda at: F.floor(at / range_rows)
    candidates = named.withColumns({"range": number(F.col("at")), "asked": F.lit(False)})
    reach = F.sequence(number(F.greatest(F.col("at") - width, F.lit(0))), number(F.col("at") + width))
    probes = named.join(queries.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").withColumns({"range": F.explode(reach), "asked": F.lit(True), "ids": F.array().cast("array<long>")})
    met = candidates.unionByName(probes).repartition("range").sortWithinPartitions("range", "asked")
    best = met.select("range", "asked", "size", "curve", "at", "k1", "k2", "v", "ids").mapInPandas(lambda b: search_ranges(b, width, wanted), "q1 long, q2 long, score double, vec_id long")
    # A candidate met on several curves has one distance; a query's own id may be among the first.
    place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "vec_id"))
    best = best.distinct().withColumn("_place", place).where(F.col("_place") <= wanted + 1).drop("_place")
    answers = queries.withColumnRenamed("vec_id", "query_id").join(best, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "k1", "k2").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 100 == 0)
