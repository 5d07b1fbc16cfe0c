import math

import pytest
from pyspark.sql import functions as F

from sedge.functions import geometry as G
from sedge.functions import text as T
from sedge.operators import tiles
from sedge.operators.ordinals import lower_ranks, running_cap, with_ordinal
from sedge.streaming import streams


def test_rank_of_five_is_the_lower_one(spark):
    rows = lower_ranks(spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3)], "x double"), "x", [0.0, 0.5, 0.9, 1.0])
    assert sorted((r["q"], r["value"]) for r in rows.collect()) == [(0.0, 1.0), (0.5, 3.0), (0.9, 4.0), (1.0, 5.0)]


def test_ordinals_and_running_cap(spark):
    rows = spark.range(100, numPartitions=7).selectExpr("id", "100 - id AS k", "3L AS n")
    assert with_ordinal(rows, "o", "k").where("o <> k - 1").isEmpty()
    got = {r["k"]: r["granted"] for r in running_cap(rows, "n", 10, "k").collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 1}


def _mix(seed, a, b):
    x = (seed ^ G.MIX_START ^ ((a + 1) * G.MIX_A & G.LOW) ^ ((b + 1) * G.MIX_B & G.LOW)) & G.LOW
    x ^= x >> 16
    x = x * G.MIX_1 & G.LOW
    x ^= x >> 15
    x = x * G.MIX_2 & G.LOW
    return (x ^ x >> 16) / 2**32


def test_mixed_fraction_equals_plain_arithmetic(spark):
    rows = spark.range(300).select("id", G.mixed_fraction(F.lit(1), F.col("id") * 999983, F.col("id")).alias("r"), G.mixed_fraction(F.lit(1), F.col("id") * 999983, F.col("id"), True).alias("s")).collect()
    for r in rows:
        want = _mix(1, r["id"] * 999983, r["id"])
        assert r["r"] == want and r["s"] == (want if want < 0.5 else want - 1)


def test_quaternions_turn_z_into_the_normal(spark):
    normals = [(0, 0, 1), (0, 0, -1), (1, 0, 0), (0, 1, 0), (0.6, 0, 0.8), (-0.6, 0.64, -0.48), (0.95, 0.3122499, 0)]
    rows = spark.createDataFrame([([float(c) for c in n],) for n in normals], "n array<double>").select("n", G.quaternion_of_normal(F.col("n")).alias("q")).collect()
    for r in rows:
        w, x, y, z = r["q"]
        turned = (2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y))
        assert max(abs(a - b) for a, b in zip(turned, r["n"])) < 1e-6


def test_clamped_colours_and_names(spark):
    row = spark.range(1).select(T.color_from_name(F.lit("roof_300_2_3")).alias("a"), T.color_from_name(F.lit("roof")).alias("b"), T.sheet_name(F.lit(" a:b/c ")).alias("c"), T.sheet_name(F.lit("  ")).alias("d"), T.after_marker(F.lit("a--b--c"), "--").alias("e"), T.after_marker(F.lit("abc"), "--").alias("f"), T.strip_uri(F.lit("a%20b+c?x#y")).alias("g"), T.strip_uri(F.lit("a%2")).alias("h")).first()
    assert row["a"] == [255, 2, 3, 255] and row["b"] is None
    assert tuple(row[c] for c in "cdefgh") == ("a_b_c", "Sheet", "c", None, "a b+c", "a%2")


@pytest.mark.parametrize("parts", [2, 5, 12, 16])
@pytest.mark.parametrize("shape", [(1, 1), (10, 1), (1, 30), (0, 0)])
def test_grid_has_room(parts, shape):
    x, y = tiles.choose_grid(*shape, parts)
    assert x * y >= parts and math.ceil(parts / x) <= y


def test_merging_small_groups_stops_when_full():
    into = tiles.merge_small([("a", 3, 0, 0, 0), ("b", 10, 1, 0, 0), ("c", 12, 0.5, 0, 0), ("d", 7, 50, 0, 0)], 8, 13)
    assert into["a"] == "b" and into["d"] == "d"


def test_small_groups_merge_as_by_trying_all(spark):
    import random

    def plain(groups: list, least: int, most: int) -> dict:
        """Every choice by a look at all groups."""
        now = {g[0]: [float(g[1]), *(c * float(g[1]) for c in g[2:])] for g in groups}
        into = {k: k for k in now}
        while small := min(((g[0], k) for k, g in now.items() if g[0] < least), default=None):
            n, k = small
            ways = [(sum((a / g[0] - b / n) ** 2 for a, b in zip(g[1:], now[k][1:], strict=True)), j) for j, g in now.items() if j != k and g[0] + n <= most]
            if not ways:
                break
            near = min(ways)[1]
            now[near] = [a + b for a, b in zip(now[near], now.pop(k), strict=True)]
            into = {a: near if b == k else b for a, b in into.items()}
        return into

    for seed in range(12):
        r = random.Random(seed)
        at = [(r.random(), r.random(), 0.0), (1.5, 2.5, 3.5)]
        groups = [(f"{r.randint(0, 10**6)}-{k}", r.randint(1, 12), *(r.choice(at) if seed % 3 else (r.gauss(0, 9), r.random(), r.random()))) for k in range(r.choice([0, 1, 9, 150]))]
        assert tiles.merge_small(groups, 8, 16) == plain(groups, 8, 16)


def test_cells_split_in_a_task_are_those_of_the_levels(spark):
    p = spark.range(900).selectExpr("id AS tile_id", "if(id % 3 = 0, 5D, id * 7919 % 1000 / 10D) AS x", "if(id % 3 = 0, 5D, id * id % 77 + 0D) AS y")
    p = p.selectExpr("*", "x - 2 AS min_x", "x + tile_id % 3 AS max_x", "y - 2 AS min_y", "y + 2 AS max_y")
    by_levels, mixed, in_tasks = ({(r["tile_id"], r["cell"]) for r in tiles.quadtree_split(p, 5, rows_in_task=n).collect()} for n in (0, 200, 900))
    assert by_levels == mixed == in_tasks and len(by_levels) == 900


def test_splitting_in_a_task_is_that_of_the_rounds(spark):
    rows = spark.range(700).selectExpr("CASE id % 5 WHEN 0 THEN null WHEN 1 THEN 'b' ELSE 'a' END AS group_name", "1000 - id AS tile_id", "if(id % 50 = 7, 500, id * 7919 % 90) AS bytes", "if(id % 4 = 0, 7D, id * 31 % 100 / 3D) AS x", "id % 9 / 2D AS y", "array(id) AS more")
    for span in (None, 6.0):
        by_rounds, mixed, in_tasks = ({tuple(map(str, r)) for r in tiles.split_overfull(rows, 200, span, rows_in_task=n).collect()} for n in (0, 60, 700))
        assert by_rounds == mixed == in_tasks and len(by_rounds) == 700


def test_splitting_keeps_members_within_both_limits(spark):
    rows = [("a", k, 10 * (k + 1), float(k), 0.0) for k in range(8)] + [("b", 20, 500, 0.0, 0.0), ("b", 21, 5, 1.0, 0.0), ("c", 30, 60, 0.0, 1.0), ("c", 31, 60, 0.0, 1.0)]
    rows += [("d", 100 + k, 0, float(k * k), 0.0) for k in range(9)] + [("e", 200 + k, 1, 5.0, 5.0) for k in range(300)] + [(None, 600, 70, 0.0, 0.0), (None, 601, 70, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "group_name string, tile_id bigint, bytes bigint, x double, y double")
    for span in (None, 10.0):
        found = tiles.split_overfull(df, 120, span).collect()
        parts: dict = {}
        for r in found:
            parts.setdefault((r["group_name"], r["part"]), []).append(r)
        assert sorted(r["tile_id"] for r in found) == sorted(r[1] for r in rows)
        for p in parts.values():
            assert len(p) == 1 or sum(r["bytes"] for r in p) <= 120 and (span is None or max(r["x"] for r in p) - min(r["x"] for r in p) <= span)
        # Halves of equal weight: no more parts than twice what the bytes ask for.
        assert len([k for k in parts if k[0] == "a"]) <= 6 and len([k for k in parts if k[0] == "e"]) == 4
        assert [r["bytes"] for r in parts["b", "one 20"]] == [500]
        assert len([k for k in parts if k[0] == "d"]) == (1 if span is None else 6)


def test_lines_of_a_log_and_others(spark):
    from sedge.operators import logs

    good = '10.0.0.1 - - [05/Mar/2024:10:11:12 +0800] "GET /a page?x=1 HTTP/1.1" 200 17'
    lines = [good, good.replace(" - - ", "  -   -  "), good.replace("HTTP/1.1", "HTTP/"), good.replace("GET /a page?x=1", "/a"), good.replace('"', "'"), good.replace("[", ""), good.replace("200", "ok"), "", None, good.replace(" - - ", " - bob ")]
    lines += [good.replace('1.1"', '1.1 "'), good.replace('1.1"', '1.1 x"'), good.replace("page", "pa\x01ge")]
    got = [tuple(r) for r in logs.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("10.0.0.1", "2024-03-05 10:11:12", "GET", "/a page?x=1", 200)] * 4 + [("10.0.0.1", "2024-03-05 10:11:12", "GET", "/a pa ge?x=1", 200)]


def test_sizes_and_colours(spark):
    sizes = {"12k": 12288, "12kb": 12288, "1.5m": 1572864, "2mb": 2097152, "7": 7, "7b": 7, "5 kb": None, "kb": None, " 3K ": 3072}
    df = spark.createDataFrame([(k,) for k in sizes], "s string")
    assert {r["s"]: r["b"] for r in df.select("s", T.parse_size(F.col("s")).alias("b")).collect()} == sizes
    names = {"x_1_2_3": [1, 2, 3, 255], "x_1_2_3_4": [1, 2, 3, 4], "x_9_1_2_3_4": [1, 2, 3, 4], "1_2_3": None, "x_1_2": None, "x_1_2_3_": None, "x_1000_2_3": None, "x_999_2_3": [255, 2, 3, 255]}
    df = spark.createDataFrame([(k,) for k in names], "s string")
    assert {r["s"]: r["c"] for r in df.select("s", T.color_from_name(F.col("s")).alias("c")).collect()} == names


def test_optional_modules_may_lack_their_libraries():
    import subprocess
    import sys

    code = "import sys; sys.modules['zstandard'] = None\nimport __spark_entry__ as e\nn = len(e.queries()); assert n > 90 and 'op1_license_scan' not in e.queries() and 'pipeline' not in e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests", 1)[0]).returncode == 0


def test_stream_windows_close_by_watermark(spark):
    rows = spark.createDataFrame([(f"2026-01-01 00:{m:02d}:00", k) for m, k in ((0, "a"), (1, "a"), (2, "b"), (40, "a"))], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    found = streams.drain(streams.tumbling_counts(streams.as_stream(spark, rows), "t", "10 minutes", "5 minutes", "k")).collect()
    assert {(r["k"], r["n"]) for r in found} == {("a", 2), ("b", 1)}


def test_stream_dedup_leaves_out_seen(spark):
    rows = spark.range(20).selectExpr("id % 5 AS uid", "id")
    got = streams.dedup_stream(spark, rows, "uid", spark.range(2).selectExpr("id AS uid"))
    assert sorted(r["uid"] for r in got.collect()) == [2, 3, 4]
    within = streams.drain(streams.dedup_within(streams.as_stream(spark, rows.selectExpr("uid", "timestamp'2026-01-01 00:00:00' AS t")), "uid", "t", "1 hour"))
    assert within.count() == 5


def test_recent_keys_are_bounded_and_carried_over_batches(spark):
    rows = [(k, "m" if k % 5 else "n", (k * 7) % (40 if k < 200 else 23)) for k in range(400)]
    seen = [("m", 7, -2), ("m", 1000, -3), ("n", 0, -1)]
    held, want = {"m": [1000, 7], "n": [0]}, []
    for k, box, uid in rows:
        mine = held[box]
        if uid not in mine:
            want.append(k)
            mine.append(uid)
            if len(mine) > 20:
                del mine[:6]
    schema = "k long, box string, uid long"
    path = None
    with streams.keyed_state(spark):
        # Files come one by one, in the order of their rows.
        import tempfile

        path = tempfile.mkdtemp(prefix="recent-")
        for part in range(4):
            spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        before = spark.createDataFrame(seen, "box string, uid long, k long")
        found = streams.drain(streams.dedup_recent(stream, "box", "uid", "k", seen=before, most=20, drop=6))
    assert sorted(r["k"] for r in found.collect()) == want
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_lod_error_and_boxes(spark):
    row = spark.range(1).select(tiles.geometric_error([F.lit(3.0), F.lit(4.0), F.lit(12.0)]).alias("e"), tiles.box_of([F.lit(0.0)] * 3, [F.lit(2.0), F.lit(0.0), F.lit(4.0)]).alias("b")).first()
    assert row["e"] == 6.5 and row["b"][:3] == [1, 0, 2] and row["b"][3] == 1 and row["b"][7] == 0.001


def test_points_of_reference_systems(spark):
    from sedge.plans.rewrite import lonlat_sql

    def at(srid, x, y):
        return spark.sql("SELECT " + ", ".join(f"cast({e} as double) AS c{k}" for k, e in enumerate(lonlat_sql(srid, f"cast({x} as double)", f"cast({y} as double)")))).first()

    close = lambda a, b, tolerance: all(abs(p - q) < tolerance for p, q in zip(a, b))
    assert close(at(3857, 20037508.342789244, 20037508.342789244), (180, 85.0511287798), 1e-9)
    assert close(at(32631, 448251.795, 5411932.678), (2.2945, 48.8582), 1e-5)  # the tower in Paris
    assert close(at(32756, 334873.0, 6252266.0), (151.2153, -33.8568), 1e-3)  # the opera house in Sydney
    assert close(at(4549, 500000, 0), (120, 0), 1e-12) and close(at(4528, 40500000, 0), (120, 0), 1e-12)
    with pytest.raises(ValueError):
        lonlat_sql(1, "x", "y")


def test_unique_names_survive_a_name_that_is_numbered_already(spark):
    from sedge.operators.text import unique_names

    files = spark.createDataFrame([(1, "a.b3dm"), (2, "A.b3dm"), (3, "a_1.b3dm"), (4, "x")], "k int, name string")
    got = {r["k"]: r["out_name"] for r in unique_names(files, "name", "k").collect()}
    assert len({v.lower() for v in got.values()}) == 4 and got[1] == "a.b3dm" and got[3] == "a_1.b3dm"


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_one_large_group_is_numbered_by_many_tasks(spark):
    from sedge.operators.ordinals import numbered, running_sum

    rows = spark.range(1_000_000, numPartitions=8).selectExpr("CASE WHEN id % 10 < 8 THEN 'big' WHEN id % 10 = 8 THEN NULL ELSE concat('g', id % 1000) END AS g", "id * 7919 % 1000003 AS k")
    found = numbered(rows, "n", ["g"], "k")
    wrong = found.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY k) AS want").where("n <> want")
    assert wrong.isEmpty() and found.count() == 1_000_000
    # No task has more than its share of the large group.
    ranges = rows.repartitionByRange(4, "g", "k").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert ranges < 350_000
    sums = running_sum(spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("b", 1, 1)], "g string, k int, v int"), "s", "v", ["g"], "k")
    assert {(r["g"], r["k"]): r["s"] for r in sums.collect()} == {("a", 1): 0, ("a", 2): 5, ("a", 3): 5, ("b", 1): 0}


def test_quantiles_where_half_of_the_values_tie(spark):
    rows = spark.range(1001).selectExpr("CASE WHEN id < 500 THEN 0.0D ELSE cast(id as double) END AS x").unionByName(spark.sql("SELECT cast(null as double) AS x"))
    got = {r["q"]: r["value"] for r in lower_ranks(rows, "x", [0.0, 0.25, 0.4999, 0.5, 0.75, 1.0]).collect()}
    assert got == {0.0: 0.0, 0.25: 0.0, 0.4999: 0.0, 0.5: 500.0, 0.75: 750.0, 1.0: 1000.0}
    assert lower_ranks(rows.where("x IS NULL"), "x", [0.5]).count() == 0


def test_references_meet_one_file_each(spark):
    from sedge.operators.text import resolve_uris

    files = spark.range(10_000).selectExpr("concat('site', id, '/docs/index.html') AS path").unionByName(spark.createDataFrame([("top.txt",), ("A/B/c.txt",), ("z/b/C.txt",), (None,)], "path string"))
    uris = {"site77/docs/index.html": "site77/docs/index.html", "SITE77/docs/INDEX.html": "site0/docs/index.html", "docs/index.html": "site0/docs/index.html", "gone/index.html": "site0/docs/index.html", "b/c.txt": "A/B/c.txt", "c.txt": "A/B/c.txt", "/b/C.txt": "A/B/c.txt", "top.txt": "top.txt", "x/TOP.txt": "top.txt", "none": None, None: None}
    refs = spark.createDataFrame([(u, k % 2) for k, u in enumerate([*uris, *uris])], "uri string, k int")
    found = resolve_uris(refs, files)
    assert found.count() == 2 * len(uris)
    assert {r["uri"]: r["resolved"] for r in found.collect()} == uris
    many = resolve_uris(spark.range(2000).selectExpr("concat('old', id, '/index.html') AS uri"), files)
    assert many.count() == 2000


def test_names_that_contain_a_text(spark):
    import random

    from sedge.operators.text import first_containing

    r = random.Random(2)
    names = [(k, "".join(r.choice("abé") for _ in range(r.randint(0, 12)))) for k in range(200)] + [(3, None), (500, "ends with this")]
    texts = [(k, "".join(r.choice("abé") for _ in range(r.randint(0, 7)))) for k in range(300)] + [(301, None), (302, "with t"), (303, "nowhere"), (304, "")]
    found = first_containing(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(names, "pos int, n string"), "n", "pos")
    want = {k: None if t is None else next((n for _, n in sorted((p, n) for p, n in names if n is not None and t in n)), None) for k, t in texts}
    assert {x["id"]: x["found"] for x in found.collect()} == want and found.count() == len(texts)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_nearest_groups_are_those_of_all_pairs(spark):
    import random

    r = random.Random(4)
    rows = [(k, r.randint(1, 12), r.choice([r.gauss(0, 1), r.gauss(50, 1e-6), 9.0]), r.choice([0.0, 1e5]) + r.random(), 3.0) for k in range(300)]
    rows += [(1000 + k, 2, 7.0, 7.0, 3.0) for k in range(40)] + [(2000, 11, -1e6, 0.0, 3.0), (2001, 13, 0.0, 0.0, 3.0)]
    schema = "group_id bigint, size int, cx double, cy double, cz double"
    want = {}
    for a in rows:
        ways = [(sum((y - x) * (y - x) for x, y in zip(a[2:], b[2:])), b[0]) for b in rows if b[0] != a[0] and a[1] + b[1] <= 13]
        if ways:
            want[a[0]] = min(ways)[::-1]
    got = {x["group_id"]: (x["target_id"], x["d2"]) for x in tiles.nearest_groups(spark.createDataFrame(rows, schema), 13, 16).collect()}
    assert got == want
    assert tiles.nearest_groups(spark.createDataFrame([], schema), 13).count() == 0
    assert tiles.nearest_groups(spark.createDataFrame(rows[:1], schema), 13).count() == 0
    same = [(k, 1, 1.0, 1.0, 1.0) for k in range(500)]
    assert {(x["group_id"], x["target_id"]) for x in tiles.nearest_groups(spark.createDataFrame(same, schema), 2).collect()} == {(k, 0 if k else 1) for k in range(500)}


def test_pairs_of_near_groups_are_spread_over_tasks(spark, monkeypatch):
    """The first grid of many places is met in as many tasks as places ask for, whatever the size of their file."""
    made = []
    monkeypatch.setattr(tiles, "cut", lambda df: made.append(df) or df.sparkSession.createDataFrame(df.toArrow(), df.schema))
    groups = spark.range(5000).selectExpr("id AS group_id", "id % 9 + 1 AS size", "id * 7919 % 5000 / 3D AS cx", "id % 25 * 10D AS cy", "0D AS cz")
    assert tiles.nearest_groups(groups, 12).count() == 5000
    ready = [df for df in made if df.columns == ["place", "best"]]
    assert ready and all(df._jdf.queryExecution().optimizedPlan().toString().count(", 5\n") >= 2 for df in ready)
