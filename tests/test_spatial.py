"""Spatial operators against brute force, in every physical form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import (blob, flat_scene, inside, meets, objects_df, poses_df, prepared, rect, zones_df)
from sceneframe.functions import angles as A
from sceneframe.operators import containment as C, hierarchy as H, nearest as N, ranges as R, routes as RT, scene as SC
from sceneframe.operators.lookup import match_substring
from sceneframe.plans import tools as T


def spread_rings(seed=3, n=60):
    rng = random.Random(seed)
    rings = [("world", None, rect(-10, -10, 110, 110))]
    for i in range(n):
        size = rng.choice([1, 3, 10, 30])
        rings.append((f"z{i}", None, blob(rng, rng.uniform(0, 100), rng.uniform(0, 100), size, rng.randint(3, 9))))
    rings.append(("line", "world", [[1.0, 1.0], [5.0, 5.0]]))
    rings.append(("empty", None, []))
    return rings


def spread_points(seed=4, n=400):
    rng = random.Random(seed)
    pts = [(rng.uniform(-15, 115), rng.uniform(-15, 115)) for _ in range(n)]
    return pts + [(-10.0, -10.0), (110.0, 0.0), (0.0, 110.0), (-10.0, 50.0)]


def test_index_weighs_the_texts_it_would_send(spark, monkeypatch):
    """Names that outgrow the bound turn the broadcast index into grid levels, with the same rows."""
    rings = [(f"z{i}" * 200, None, rect(i, 0, i + 1.5, 2)) for i in range(20)]
    zones = H.zone_hierarchy(zones_df(spark, rings))
    points = spark.createDataFrame([(0, i, i + 0.25, 1.0) for i in range(20)], "scene_id long, ord long, x double, y double")
    rows = []
    for bound in (C.INDEX_TEXT_BYTES, 10_000):
        monkeypatch.setattr(C, "INDEX_TEXT_BYTES", bound)
        index = C.zone_index(zones)
        rows.append((index.cells is None, {(r.ord, r.zone_ord) for r in C.points_in_zones(points, index).collect()}))
    assert [r[0] for r in rows] == [False, True] and rows[0][1] == rows[1][1]
    assert rows[0][1] == {(i, z) for i in range(20) for z in (i - 1, i) if z >= 0}


@pytest.mark.parametrize("form", ["cells", "levels", "shuffle"])
def test_containment_equals_brute_force(spark, form):
    rings, pts = spread_rings(), spread_points()
    zones = H.zone_hierarchy(zones_df(spark, rings), force=form)
    index = H.location_index(zones, force=form)
    assert (index.cells is None) == (form != "cells") and bool(index.fine) == (form == "shuffle")
    points = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(pts)],
                                   "scene_id long, ord long, x double, y double")
    got = {(r.ord, r.zone_ord) for r in C.points_in_zones(points, index).collect()}
    want = {(i, z) for i, (x, y) in enumerate(pts) for z, (_, _, v) in enumerate(rings)
            if len(v) >= 3 and inside(x, y, v)}
    assert got == want
    depth = {r.zord: r.depth for r in zones.collect()}
    hits = {i: sorted(z for j, z in want if j == i) for i in range(len(pts))}
    first = {r.ord: r.zone for r in C.assign_zone(points, index, ["ord"], "first").collect()}
    deep = {r.ord: r.zone for r in C.assign_zone(points, index, ["ord"], "deepest").collect()}
    assert len(first) == len(deep) == len(pts)
    for i, zs in hits.items():
        assert first[i] == (rings[zs[0]][0] if zs else None)
        best = min(zs, key=lambda z: (-depth[z], z)) if zs else None
        assert deep[i] == (rings[best][0] if zs else None)
    counts = {r.zord: (r.num_objects, r.num_direct_objects) for r in
              H.zone_counts(points, zones, index).collect()}
    for z in range(len(rings)):
        members = [i for i, zs in hits.items() if z in zs]
        assert counts[z] == (len(members), sum(deep[i] == rings[z][0] for i in members))


def test_parents_and_depths(spark):
    rings = spread_rings(8)
    for form in ("cells", "levels", "shuffle"):
        got = {r.zord: r for r in H.zone_hierarchy(zones_df(spark, rings), force=form).collect()}

        def area(v):
            return abs(sum(v[i - 1][0] * v[i][1] - v[i][0] * v[i - 1][1] for i in range(len(v)))) / 2
        for i, (name, parent, v) in enumerate(rings):
            if len(v) < 3:
                assert got[i].parent == parent
                continue
            holders = [j for j, (_, _, w) in enumerate(rings)
                       if j != i and len(w) >= 3 and all(inside(x, y, w) for x, y in v)]
            best = min(holders, key=lambda j: (area(rings[j][2]), j)) if holders else None
            assert got[i].parent == (rings[best][0] if holders else None)
            chain, cur = [], got[i]
            by_name = {r.name: r for r in got.values()}
            while cur.parent is not None:
                cur = by_name[cur.parent]
                chain.append(cur.name)
            assert got[i].depth == len(chain)
            assert got[i].full_path == " > ".join([*reversed(chain), name])


def test_deep_chain_cycles_and_duplicate_names(spark):
    nested = [(f"n{i}", None, rect(i, i, 100 - i, 100 - i)) for i in range(20)]
    rings = nested + [("p", "q", []), ("q", "p", []), ("self", "self", []), ("tail", "p", [[0.0, 0.0]]),
                      ("lost", "nowhere", []), ("n3", None, rect(40, 40, 41, 41))]
    rows = {r.zord: r for r in H.zone_hierarchy(zones_df(spark, rings)).collect()}
    assert [rows[i].depth for i in range(4)] == [0, 1, 2, 3]
    # names resolve to the last zone called n3: the walk from n4 passes through it
    assert rows[19].parent == "n18" and rows[25].parent == "n19"
    assert rows[20].depth == 2 and rows[21].depth == 2          # two-zone cycle
    assert rows[22].depth == 1 and rows[22].full_path == "self > self"
    assert rows[23].depth == 2 and rows[23].full_path == "q > p > tail"
    assert rows[24].depth == 0 and rows[24].full_path == "lost"
    walk, cur, seen = 0, rows[4], set()
    last = {r.name: r.zord for r in sorted(rows.values(), key=lambda r: r.zord)}
    while cur.parent in last and last[cur.parent] not in seen:
        seen.add(last[cur.parent])
        walk, cur = walk + 1, rows[last[cur.parent]]
    assert rows[4].depth == walk > 15
    kids = {(r.name, r.child) for r in H.zone_children(H.zone_hierarchy(zones_df(spark, rings))).collect()}
    assert ("q", "p") in kids and ("n0", "n1") in kids and ("lost", "nowhere") not in kids


def test_flat_scene_golden(spark):
    s = flat_scene(spark)
    at = poses_df(spark, [(1, 2.0, 1.5, 0.0, "living_room"), (2, 2.0, 1.5, 0.0, "HALLWAY "),
                          (3, 2.0, 1.5, 0.0, "kitchen"), (4, None, None, None, "kitchen"),
                          (5, 2.0, 1.5, 0.0, "attic"), (6, 2.0, 1.5, 0.0, "Lamp")])
    d = {r.request_id: r for r in T.distance_to(at, s.objects, s.zones).collect()}
    assert (d[1].distance_m, d[1].direction, d[1].destination_type) == (5.1, "ahead", "zone")
    assert (d[2].distance_m, d[2].direction, d[2].destination) == (2.5, "to your left", "hallway")
    assert (d[3].distance_m, d[3].direction) == (0.0, "ahead")
    assert d[4].error == "Cannot get robot pose" and d[4].destination is None
    assert d[5].error == "Destination 'attic' not found." and d[5].hint
    assert (d[6].distance_m, d[6].destination_type) == (6.52, "object")
    o = {r.request_id: r for r in T.orient(at, s.objects, s.zones).collect()}
    assert o[1].message == "Rotating to face living_room (11.3 degrees left)"
    assert o[2].turn_degrees == 90.0 and o[2].goal_destination == "orient:hallway"
    assert o[5].error == "Target 'attic' not found."
    answers, met, passed = T.describe_route(at, s.objects, s.zones)
    zones = {}
    for r in met.orderBy("zone_ord").collect():
        zones.setdefault(r.request_id, []).append(r.zone)
    assert zones == {1: ["kitchen", "living_room"], 2: ["kitchen", "hallway"], 6: ["kitchen", "living_room"]}
    objs = {}
    for r in passed.orderBy("distance_along_path_m", "obj_ord").collect():
        objs.setdefault(r.request_id, []).append((r.label, r.distance_along_path_m, r.side_offset_m))
    assert objs[1] == [("microwave", 0.98, 0.2), ("chair", 3.53, 0.2), ("table", 4.61, 0.1)]
    assert objs[2] == [("microwave", 0.0, 1.0)] and 3 not in objs
    near = T.describe_surroundings(at.where("request_id in (1, 4)"), s.objects, s.index)
    rows = near.orderBy("request_id", "distance", "obj_ord").collect()
    assert [(r.label, r.distance, r.direction, r.current_zone) for r in rows if r.request_id == 1] == [
        ("microwave", 1.0, "ahead", "kitchen"), ("fridge", 1.12, "behind to your right", "kitchen")]
    assert [r.error for r in rows if r.request_id == 4] == ["Cannot get robot pose"]
    pose = T.robot_pose(at, s.index).where("request_id = 1").first()
    assert (pose.x, pose.y, pose.yaw_deg, pose.current_zone) == (2.0, 1.5, 0.0, "kitchen")
    goal = {r.request_id: r for r in T.goal_for_zone(at, s.zones, "name").collect()}
    assert (goal[1].goal_x, goal[1].goal_y) == (7.0, 2.5) and goal[6].error.startswith("Zone 'Lamp' not found. Use")
    assert goal[4].success and goal[4].goal_yaw is None and goal[4].goal_qw == 1.0
    local = T.goal_for_object(at, s.objects, "name", "local").where("request_id = 6").first()
    assert (local.goal_x, local.goal_yaw, local.object) == (8.5, 0.0, "lamp")
    edges = [(0, 0), (4, 0), (4, 1), (4, 3), (0, 3), (2, 3), (0, 1), (10, 5), (10, 2), (7, 5)]
    pts = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(edges)],
                                "scene_id long, ord long, x double, y double")
    zone = {r.ord: r.zone for r in C.assign_zone(pts, s.index, ["ord"], "first").collect()}
    assert [zone[i] for i in range(10)] == ["kitchen"] + ["living_room"] * 3 + ["hallway"] * 2 + ["kitchen"] + [None] * 3


@pytest.mark.parametrize("limit", [None, 0])
def test_range_join(spark, limit):
    rng = random.Random(5)
    objs = [("o", rng.uniform(-20, 20), rng.uniform(-20, 20), 1.0, 100) for _ in range(150)] + [("o", 3.0, 0.0, 1.0, 100)]
    poses = [(i, rng.uniform(-25, 25), rng.uniform(-25, 25), 0.0, "") for i in range(150)] + [(900, 0.0, 0.0, 0.0, "")]
    o, p = objects_df(spark, objs), poses_df(spark, poses)
    got = {(r.request_id, r.obj_ord) for r in R.objects_within(p, o, 3.0, broadcast_rows=limit).collect()}
    want = {(q[0], i) for q in poses for i, b in enumerate(objs) if math.sqrt((q[1] - b[1]) ** 2 + (q[2] - b[2]) ** 2) <= 3.0}
    assert got == want and (900, 150) in got
    pr = p.withColumn("radius", (F.col("request_id") % 7).cast("double") * 1.7)
    got = {(r.request_id, r.obj_ord) for r in R.objects_within(pr, o, "radius", broadcast_rows=limit).collect()}
    want = {(q[0], i) for q in poses for i, b in enumerate(objs)
            if math.sqrt((q[1] - b[1]) ** 2 + (q[2] - b[2]) ** 2) <= (q[0] % 7) * 1.7}
    assert got == want
    left = R.objects_within(p, o, 0.01, "left", broadcast_rows=limit)
    assert left.select("request_id").distinct().count() == len(poses)


@pytest.mark.parametrize("limit,candidates", [(None, 64), (0, 64), (0, 2), (None, 3)])
def test_nearest(spark, monkeypatch, limit, candidates):
    monkeypatch.setattr(N, "CANDIDATES", candidates)
    rng = random.Random(6)
    names = ["red chair", "Chair", "armchair", "table", "lamp"]
    objs = [(rng.choice(names), rng.choice([rng.uniform(0, 50), rng.uniform(20, 20.5)]),
             rng.choice([rng.uniform(0, 50), rng.uniform(20, 20.5)]), 1.0, 99) for _ in range(120)]
    objs += [("lamp", 7.0, 7.0, 1.0, 99)] * 5 + [("lamp", 7.0 + k * 1e-7, 7.0, 1.0, 99) for k in range(8)]
    poses = [(i, rng.uniform(-20, 70), rng.uniform(-20, 70), 0.0, rng.choice(["chair", " CHAIR", "table", "lamp", "", "sofa"]))
             for i in range(200)] + [(900, 7.0, 7.0, 0.0, "lamp"), (901, None, None, None, "lamp")]
    kw = {} if limit is None else {"broadcast_rows": limit}
    got = {r.request_id: r for r in N.nearest_object(
        poses_df(spark, poses), objects_df(spark, objs), keyword="name", **kw).collect()}
    assert len(got) == len(poses)
    for i, x, y, _, word in poses:
        best = None
        for k, (label, ox, oy, *_r) in enumerate(objs):
            if x is not None and word.strip().lower() in label.lower():
                d = math.sqrt((x - ox) ** 2 + (y - oy) ** 2)
                if best is None or d < best[0]:
                    best = (d, k)
        assert (got[i].dist, got[i].obj_ord) == (best if best else (None, None)), i
        assert got[i].name == word


def test_substring_matches(spark):
    words = ["a", "", "cha", "chair", "xchair", "able", "zzz", "arm"]
    labels = ["Chair", "armchair", "table", "Cha", "a"]
    o = objects_df(spark, [(n, 0.0, 0.0, 1.0, 99) for n in labels])
    k = spark.createDataFrame([(0, w) for w in words], "scene_id long, keyword string")
    got = {(r.keyword, r.label) for r in match_substring(k, o).collect()}
    assert got == {(w, n.lower()) for w in words for n in labels if w in n.lower()}


@pytest.mark.parametrize("limit", [None, 0])
def test_routes(spark, limit):
    rng = random.Random(7)
    rings = spread_rings(9, 40)
    objs = [("o", rng.uniform(-5, 105), rng.uniform(-5, 105), 1.0, 99) for _ in range(400)]
    ends = [tuple(rng.uniform(-20, 120) for _ in range(4)) for _ in range(60)]
    ends += [(0.0, 0.0, 0.0, 50.0), (10.0, 10.0, 90.0, 10.0), (5.0, 5.0, 5.0, 5.0), (3.0, 3.0, 3.2, 3.1), (90.0, 95.0, 2.0, 3.0),
             (-800.0, 40.0, 900.0, 41.0)]
    routes = spark.createDataFrame([(i, 0, *e) for i, e in enumerate(ends)],
                                   "request_id long, scene_id long, ax double, ay double, bx double, by double")
    got = {(r.request_id, r.obj_ord) for r in RT.route_objects(
        routes, objects_df(spark, objs), broadcast_rows=limit).collect()}
    want = set()
    for i, (ax, ay, bx, by) in enumerate(ends):
        n = math.sqrt((bx - ax) ** 2 + (by - ay) ** 2)
        if n < 1e-6:
            continue
        ux, uy = (bx - ax) / n, (by - ay) / n
        for k, (_, ox, oy, *_r) in enumerate(objs):
            along = (ox - ax) * ux + (oy - ay) * uy
            if 0 <= along <= n and abs((ox - ax) * -uy + (oy - ay) * ux) <= 2.0:
                want.add((i, k))
    assert got == want and len(want) > 100
    pairs = [(r.request_id, r.zone_ord) for r in RT.route_zones(
        routes, prepared(spark, rings), broadcast_rows=limit).collect()]
    want = {(i, z) for i, e in enumerate(ends) for z, (_, _, v) in enumerate(rings)
            if v and math.hypot(e[2] - e[0], e[3] - e[1]) >= 1e-6 and meets(*e, v)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_long_routes_among_tiny_zones(spark):
    """Cells per route stay bounded; zones without extent are never met."""
    rings = [("dot", None, [(3.0, 0.0)]), ("same", None, [(3.0, 0.0)] * 4), ("tiny", None, [(250.0, -0.05), (250.1, -0.05), (250.1, 0.05), (250.0, 0.05)]),
             ("hall", None, [(-10.0, -20.0), (600.0, -20.0), (600.0, 20.0), (-10.0, 20.0)]),
             ("line", None, [(100.0, -1.0), (100.0, 1.0), (100.0, 0.5)])]
    ends = [(0.0, 0.0, 500.0, 0.0), (0.0, 0.0, 1.0, 0.0), (249.9, 0.01, 250.3, 0.0), (-1e7, 0.0, 1e7, 0.0), (0.0, 9.0, 500.0, 9.5)]
    routes = spark.createDataFrame([(i, 0, *e) for i, e in enumerate(ends)],
                                   "request_id long, scene_id long, ax double, ay double, bx double, by double")
    zones = prepared(spark, rings)
    want = {(i, z) for i, e in enumerate(ends) for z, (_, _, v) in enumerate(rings) if meets(*e, v)}
    for limit in (None, 0):
        pairs = [(r.request_id, r.zone_ord) for r in RT.route_zones(routes, zones, broadcast_rows=limit).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert (0, 2) in want and (2, 2) in want and (3, 2) in want
    assert RT.route_zones(routes, zones.where("name in ('dot', 'same')")).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_beyond_the_bound_are_not_sent(spark, tmp_path):
    """Objects in a file of some KB are listed in many cells: Spark's estimate of them may not decide."""
    spark.range(300).selectExpr(
        "0L scene_id", "id ord", "id", "concat('thing ', id) label", "double(id % 17) x", "double(id % 13) y").write.parquet(f"{tmp_path}/objects")
    objects = spark.read.parquet(f"{tmp_path}/objects")
    poses = poses_df(spark, [(i, float(i % 19), float(i % 7), 0.0, "") for i in range(200)]).withColumn("r", F.col("request_id") % 3 + 0.5)
    routes = poses.selectExpr("request_id", "scene_id", "x ax", "y ay", "x + 9 bx", "y + 5 by")
    spark.createDataFrame([(0, z, f"z{z}", None, rect(z, z, z + 2, z + 2)) for z in range(20)], "scene_id long, zord long, name string, parent string, "
                          "vertices array<array<double>>").write.parquet(f"{tmp_path}/zones")
    zones = SC.prepare_zones(spark.read.parquet(f"{tmp_path}/zones"))
    index = C.zone_index(zones, force="shuffle")
    for small, df in (
            (R.objects_within(poses, objects, "r"), R.objects_within(poses, objects, "r", broadcast_rows=0)),
            (RT.route_objects(routes, objects), RT.route_objects(routes, objects, broadcast_rows=0)),
            (RT.route_zones(routes, zones), RT.route_zones(routes, zones, broadcast_rows=0)),
            (C.points_in_zones(poses, C.zone_index(zones)), C.points_in_zones(poses, index))):
        assert "BroadcastHashJoin" not in plan_of(df) and "SortMergeJoin" in plan_of(df)
        assert sorted(map(str, df.collect())) == sorted(map(str, small.collect()))


def test_counts_are_taken_before_texts_are_put_in_order(spark):
    """Pairs are counted in a hash table next to the join; a request that comes twice counts twice."""
    scene = flat_scene(spark)
    poses = poses_df(spark, [(1, 2.0, 2.0, 0.0, ""), (2, 6.0, 2.0, 0.0, ""), (2, 6.0, 2.0, 0.0, ""), (3, 90.0, 90.0, 0.0, ""), (4, None, None, None, "")])
    counts = T.surroundings_counts(T.describe_surroundings(poses, scene.objects, scene.index, 2.0, "local"))
    assert {r.request_id: (r["count"], r.current_zone, r.error) for r in counts.collect()} == {
        1: (2, "kitchen", None), 2: (4, "living_room", None), 3: (0, None, None), 4: (0, None, T.NO_POSE)}
    counted = [line for line in plan_of(counts).splitlines() if "count(obj_ord" in line]
    assert counted and not any("SortAggregate" in line for line in counted)


def test_generated_code_of_pairs_is_small_enough_to_be_compiled(spark):
    """The JVM never compiles a method of more than 8,000 bytes; pairs with their direction stay below, with the same directions."""
    rng = random.Random(29)
    scene = flat_scene(spark)
    poses = poses_df(spark, [(i, rng.uniform(0, 10), rng.uniform(0, 5), None if i == 7 else rng.uniform(-7, 7), "chair") for i in range(40)]
                     + [(40, None, None, 0.0, "chair"), (41, 500.0, 500.0, 1.0, "chair")])
    sizes = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for dialect in ("cloud", "local"):
            pairs = R.objects_within(poses, scene.objects, 4.0, "left")
            for df in (R.nearby_items(pairs, dialect), T.describe_surroundings(poses, scene.objects, scene.index, dialect=dialect),
                       T.find_nearest(poses, scene.objects, scene.index, "name", dialect)):
                stages = sizes(df._jdf.queryExecution().executedPlan())
                assert stages.size() and all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))
            plain = A.relative_direction(*[F.col(c) for c in ("yaw", "x", "y", "ox", "oy")], dialect)
            found = R.nearby_items(pairs, dialect).withColumn("plain", plain).collect()
            assert len(found) > 60 and all(r.direction == r.plain for r in found) and any(r.direction is None for r in found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_edges_as_columns_and_as_lists_agree(spark, monkeypatch):
    """Zones of three to nine edges, with routes along edges, through corners and inside: no matter how many edges are columns."""
    rng = random.Random(11)
    rings = [(f"z{i}", None, blob(rng, rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([2, 8, 25]), 3 + i % 7)) for i in range(40)]
    rings += [("square", None, rect(10, 10, 20, 20)), ("line", None, [[1.0, 1.0], [5.0, 5.0]])]
    ways = [tuple(rng.uniform(-5, 65) for _ in range(4)) for _ in range(150)]
    ways += [(5.0, 10.0, 30.0, 10.0), (10.0, 0.0, 10.0, 40.0), (0.0, 0.0, 30.0, 30.0), (12.0, 12.0, 13.0, 14.0), (0.0, 20.0, 20.0, 0.0)]
    routes = spark.createDataFrame([(i, 0, *w) for i, w in enumerate(ways)], "request_id long, scene_id long, ax double, ay double, bx double, by double")
    want = {(i, z) for i, w in enumerate(ways) for z, (_, _, v) in enumerate(rings) if meets(*w, v)}
    for flat in (0, 4, 6):
        monkeypatch.setattr(RT, "_FLAT", flat)
        got = [(r.request_id, r.zone_ord) for r in RT.route_zones(routes, prepared(spark, rings)).collect()]
        assert set(got) == want and len(got) == len(want)
