"""As-of joins, ranks and logs, with ordinary and with sliced groups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import objects_df, poses_df
from sceneframe.operators import asof, logs, scale
from sceneframe.operators.arrivals import detect_arrivals
from sceneframe.operators.asof import as_of
from sceneframe.operators.ranges import nearby_items, nearby_ranked, objects_within, rank_nearby
from sceneframe.operators.scale import large_groups, ordered_slices
from sceneframe.plans.tools import latest_status, navigation_status

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def logs_of(rng, n, hot=0.6):
    return [(1 if rng.random() < hot else rng.randint(2, 5), at(rng.randint(0, 300)), i) for i in range(n)]


@pytest.mark.parametrize("rows", [None, 8])
def test_as_of_both_directions(spark, rows):
    rng = random.Random(11)
    left, right = logs_of(rng, 300), logs_of(rng, 120)
    l = spark.createDataFrame(left, "robot_id long, ts timestamp, lid long")
    r = spark.createDataFrame(right, "robot_id long, ts timestamp, rid long")
    for direction in ("backward", "forward"):
        for tol in (None, "20 seconds"):
            got = {x.lid: x.hit for x in as_of(
                l, r, ["robot_id"], "ts", "ts", {"rid": "hit"}, tie="rid", direction=direction,
                tolerance=tol, group_rows=rows).collect()}
            assert len(got) == len(left)
            for robot, ts, lid in left:
                if direction == "backward":
                    fits = [(t, i) for k, t, i in right if k == robot and t <= ts]
                    best = max(fits) if fits else None
                else:
                    fits = [(t, i) for k, t, i in right if k == robot and t >= ts]
                    best = min(fits) if fits else None
                if best and tol and abs((best[0] - ts).total_seconds()) > 20:
                    best = None
                assert got[lid] == (best[1] if best else None), (direction, tol, lid)


def test_slices_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    assert {r["k"] for r in large_groups(df, ["k"], 100)[0].collect()} == {0, 1} and large_groups(df, ["k"], 5000)[1] == 0
    sliced, large = ordered_slices(df, ["k"], F.col("v"), 100)
    assert large.count() == 2 and sliced.count() == 5000
    spans = sliced.groupBy("k", "_slice").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"))
    rows = sorted(spans.collect(), key=lambda r: (r.k, r["_slice"]))
    assert max(r.n for r in rows) <= 200
    for p, q in zip(rows, rows[1:]):
        assert p.k != q.k or p.b < q.a


def test_ranks_in_large_groups(spark):
    rng = random.Random(12)
    items = [(1 if rng.random() < 0.7 else rng.randint(2, 6), rng.choice([0.5, 1.25, rng.randint(0, 300) / 100]), i * 2 ** 33)
             for i in range(600)]
    df = spark.createDataFrame(items, "request_id long, distance double, obj_ord long")
    want = {}
    for q in {i[0] for i in items}:
        for n, (_, _, o) in enumerate(sorted((i for i in items if i[0] == q), key=lambda i: (i[1], i[2])), 1):
            want[o] = n
    for rows in (None, 20):
        assert {r.obj_ord: r["rank"] for r in rank_nearby(df, group_rows=rows).collect()} == want


def test_as_of_without_key_or_time(spark):
    """Such rows stay, without a match, in both directions."""
    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", None)], "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("a", 5), ("a", 7), (None, 5)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for direction in ("backward", "forward"):
        for rows in (None, 1):
            got = as_of(left, right, ["k"], "ts", "ts", {"s": "found"}, direction=direction, group_rows=rows)
            assert {r.id: r.found for r in got.collect()} == {1: 5, 2: None, 3: None}


def test_goals_of_one_time_go_by_tie(spark):
    t = F.timestamp_seconds(F.col("s"))
    poses = spark.createDataFrame([("r", 1, 0.0, 0.0), ("r", 2, 5.0, 5.0)], "robot_id string, s long, x double, y double").withColumn("ts", t)
    goals = spark.createDataFrame([("r", 1, 5.0, 5.0, "far", 2), ("r", 1, 0.0, 0.0, "near", 1)],
                                  "robot_id string, s long, x double, y double, destination string, seq long").withColumn("ts", t)
    assert [(r.destination, r.x) for r in detect_arrivals(poses, goals, tie="seq").collect()] == [("far", 5.0)]


def test_last_lines_and_utterances(spark):
    rng = random.Random(13)
    lines = [(r, t, i, f"[tool] {i}") for r, t, i in logs_of(rng, 400)]
    df = spark.createDataFrame(lines, "robot_id long, ts timestamp, seq long, text string")
    got = {(r.robot_id, r.seq) for r in logs.last_n_log(df, 10).collect()}
    want = set()
    for k in {x[0] for x in lines}:
        want |= {(k, x[2]) for x in sorted((x for x in lines if x[0] == k), key=lambda x: (x[1], x[2]))[-10:]}
    assert got == want
    plan = logs.last_n_log(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
    said = spark.createDataFrame([(" hi \n",), ("\t ",), ("",), ("  ok",)], "text string")
    assert sorted(r.text for r in logs.nonblank_utterances(said).collect()) == ["hi", "ok"]


def test_status_and_goals(spark):
    st = spark.createDataFrame([(1, at(10), [1, 2]), (1, at(20), []), (1, at(30), [4]), (2, at(5), [6])],
                               "robot_id long, ts timestamp, status_codes array<int>")
    goals = spark.createDataFrame([(1, at(8), "kitchen"), (1, at(40), "hall"), (2, at(1), "lab")],
                                  "robot_id long, ts timestamp, destination string")
    asks = spark.createDataFrame([(1, 1, at(1)), (2, 1, at(9)), (3, 1, at(25)), (4, 1, at(35)), (5, 1, at(50)), (6, 2, at(9))],
                                 "request_id long, robot_id long, ts timestamp")
    got = {r.request_id: (r.status, r.destination, r.message) for r in navigation_status(asks, st, goals).collect()}
    assert got == {1: ("idle", None, "No navigation goal active"),
                   2: ("navigating", "kitchen", "Currently navigating to kitchen"),
                   3: ("navigating", "kitchen", "Currently navigating to kitchen"),
                   4: ("arrived", "kitchen", "Arrived at kitchen"),
                   5: ("navigating", "hall", "Currently navigating to hall"),
                   6: ("failed", "lab", "Navigation to lab failed — path may be blocked")}
    assert {r.robot_id: r.status_code for r in latest_status(st).collect()} == {1: 4, 2: 6}
    assert navigation_status(asks, st, goals, "local").columns == ["request_id", "status", "destination"]


def test_arrivals(spark):
    goals = spark.createDataFrame([(1, at(0), 5.0, 0.0, "a"), (1, at(100), 9.0, 0.0, "b"), (1, at(200), 20.0, 0.0, "c")],
                                  "robot_id long, ts timestamp, x double, y double, destination string")
    poses = spark.createDataFrame([(1, at(t), x, 0.0) for t, x in
                                   [(1, 4.0), (50, 4.9), (60, 5.0), (110, 5.0), (150, 9.15), (160, 9.1), (250, 19.0)]],
                                  "robot_id long, ts timestamp, x double, y double")
    for rows in (None, 3):
        got = {r.destination: r.arrived_ts for r in detect_arrivals(poses, goals, group_rows=rows).collect()}
        assert got == {"a": at(50), "b": at(160)}


def test_response_timeout(spark):
    asks = spark.createDataFrame([(1, 1, at(0), "zone", "hall"), (2, 1, at(10), "zone", "lab"), (3, 2, at(0), "zone", "x")],
                                 "request_id long, robot_id long, ts timestamp, topic string, name string")
    res = spark.createDataFrame([(1, at(2), "zone", "r1"), (1, at(3), "zone", "r2"), (1, at(14), "zone", "late"),
                                 (1, at(11), "object", "other")], "robot_id long, ts timestamp, topic string, payload string")
    got = {r.request_id: (r.result, r.error) for r in asof.match_responses(asks, res).collect()}
    assert got == {1: ("r1", None), 2: (None, "Timeout waiting for zone query result for 'lab'"),
                   3: (None, "Timeout waiting for zone query result for 'x'")}


def test_wall_clock_does_not_depend_on_the_session_zone(spark):
    from sceneframe.functions.times import wall_micros
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.sql("select timestamp_ntz'2024-11-03 01:30:15.123456' as t union all "
                           "select timestamp_ntz'1969-12-31 23:59:59.5'")
            got = sorted(r[0] for r in df.select(wall_micros(F.col("t"))).collect())
            assert got == [-500000, 1730597415123456]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_narrow_tables_are_cut_by_their_rows(spark):
    """A table with few partitions gets tasks of a bounded number of rows, however many rows it has."""
    one = spark.range(20_000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert scale.spread(one, "id").rdd.getNumPartitions() == cores
    cut = scale.spread(one, "id", task_rows=1000)
    sizes = [len(p) for p in cut.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000 and sum(sizes) == 20_000
    fine = spark.range(0, 100, 1, 50)
    assert scale.spread(fine, "id", task_rows=10).rdd.getNumPartitions() == 50


def test_pairs_are_numbered_where_they_are_made(spark):
    """Objects too many to be broadcast: the pairs aren't shuffled after the join, unless a request occurs twice."""
    rng = random.Random(8)
    things = objects_df(spark, [(f"t{k}", rng.uniform(0, 30), rng.uniform(0, 30), 0.9, 500) for k in range(150)] + [("lost", None, 2.0, 0.9, 500)])
    rows = [(k, rng.uniform(0, 30), rng.uniform(0, 30), 0.3, "") for k in range(60)] + [(90, None, None, None, "")]
    for asked in (rows, [*rows, (7, 1.0, 1.0, 0.3, ""), (7, 29.0, 1.0, 0.3, ""), *[(None, x, 2.0, 0.3, "") for x in (2.0, 28.0)]]):
        poses = poses_df(spark, asked)
        columns = ["request_id", "rank", "obj_id", "distance", "direction", "x", "dist", "obj_label"]
        want = rank_nearby(nearby_items(objects_within(poses, things, 5.0))).select(columns).collect()
        for broadcast_rows in (0, None):
            got = nearby_ranked(poses, things, 5.0, broadcast_rows=broadcast_rows)
            assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want)) and len(want) > 300
            assert set(got.columns) == set(rank_nearby(nearby_items(objects_within(poses, things, 5.0))).columns)
        for group_rows in (3, 10_000):
            got = nearby_ranked(poses, things, 5.0, broadcast_rows=0, group_rows=group_rows)
            assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want))
        plan = got._jdf.queryExecution().executedPlan().toString()
        window, joined = plan.index("Window"), plan.index("SortMergeJoin")
        assert ("Exchange" in plan[window:joined]) == (asked is not rows)
