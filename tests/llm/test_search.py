"""Nearest neighbours against brute force: recall, exact scores, ties, copies and odd vectors."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sedge.llm import hilbert_search
from sedge.session import table

SCHEMA = "vec_id long, embedding array<float>, vec_id_ string"


def plain(rows, wanted=10):
    """query_id: [(score, vec_id)] of all candidates in order."""
    ok = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in ok:
        if i % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = near[:wanted]
    return out


def held(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, want):
    return sum(len({j for _, j in found.get(q, [])} & {j for _, j in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        embeddings = table(spark, sf, "embeddings")
        rows = [(r["vec_id"], r["embedding"]) for r in embeddings.collect()]
        want, found = plain(rows), held(hilbert_search.report(embeddings))
        assert set(found) == set(want) and all(len(v) == 10 for v in found.values())
        assert recall(found, want) >= 0.9
        exact = {i: np.array(v, float) for i, v in rows}
        for q, near in found.items():
            assert near == sorted(near)
            for score, j in near:
                assert abs(score - np.sqrt(((exact[q] - exact[j]) ** 2).sum())) < 1e-12


def test_copies_ties_and_odd_vectors(spark):
    r = random.Random(1)
    rows = [(k, [1.0, 2.0, 0.5]) for k in range(0, 700)]  # a hot vector with queries among its copies
    rows += [(1000 + k, [r.gauss(0, 1) for _ in range(3)]) for k in range(300)]
    rows += [(2000, None), (2100, []), (2200, [0.0, 0.0, -0.0]), (2300, [1.0, None, 2.0]), (2400, [float("nan"), 1.0, 1.0]), (2500, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(2600, [3e38, -3e38, 1.0]), (2700, [1e-40, 0.0, 0.0]), (2800, [1.0, 2.0]), (2801, [2.0, 2.0]), (2900, [0.0, -0.0, 1.0]), (2901, [0.0, 0.0, 1.0]), (3000, [9.0]), (1000, rows[700][1])]
    want = plain(rows)
    found = held(hilbert_search.search(spark.createDataFrame([(*x, "s") for x in rows], SCHEMA), F.col("vec_id") % 100 == 0, share=1.0, sample=2000, range_rows=64))
    assert {q: [j for _, j in v] for q, v in found.items()} == {q: [j for _, j in v] for q, v in want.items() if v}
    assert all(abs(a - b) <= 1e-12 * max(1, b) for q in found for (a, _), (b, _) in zip(found[q], want[q]))
    assert hilbert_search.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hilbert_neighbours_touch():
    side = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = hilbert_search.hilbert_keys(side, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = side[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
