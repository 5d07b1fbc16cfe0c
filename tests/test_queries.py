"""Every registered query of the reference operators against its SQL, and the invariants of those that have none."""

import pytest

from sedge import queries as registry
from tests.oracle import check, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    check(QUERIES[name](spark, sf), duck, SQL[name])


def test_all_but_folds_have_sql():
    assert set(QUERIES) - set(SQL) == {"quadtree_groups", "chunk_fold", "edge_collapse", "cache_reorder"}


def test_chunks_keep_triangles_and_limit(spark, sf):
    from sedge.queries import meshes

    found = {r["tri"]: (r["file_id"], r["chunk"]) for r in QUERIES["chunk_fold"](spark, sf).collect()}
    corners: dict = {}
    for t in meshes.triangles(spark, sf).collect():
        corners.setdefault(found[t["tri"]], set()).update((t["i0"], t["i1"], t["i2"]))
    assert len(found) == meshes.triangles(spark, sf).count()
    assert max(map(len, corners.values())) <= 60


def test_quadtree_groups_cover_all_tiles_within_size(spark, sf):
    rows = QUERIES["quadtree_groups"](spark, sf).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r["group_name"]] = sizes.get(r["group_name"], 0) + 1
    assert len({r["tile_id"] for r in rows}) == len(rows) == 150
    assert max(sizes.values()) <= 16


def test_collapse_keeps_border_and_never_adds(spark, sf):
    from sedge.queries import meshes

    before, after = meshes.triangles(spark, sf).count(), QUERIES["edge_collapse"](spark, sf)
    assert 0 < after.count() <= before
    assert after.where("i0 = i1 OR i1 = i2 OR i0 = i2").isEmpty()


def test_reorder_is_a_permutation(spark, sf):
    from sedge.queries import meshes

    rows = QUERIES["cache_reorder"](spark, sf)
    assert rows.select("tri").exceptAll(meshes.triangles(spark, sf).select("tri")).isEmpty()
    assert rows.groupBy("file_id").count().join(rows.groupBy("file_id").agg({"place": "max"}), "file_id").where("`max(place)` <> count - 1").isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
