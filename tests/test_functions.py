import colorsys
import hashlib
import math
import random

from pyspark.sql import functions as F

from sceneframe.functions import angles as A, geometry as G, text as X
from sceneframe.functions.rounding import py_round


def test_rounding_equals_python(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 1.005, -2.675, 0.5, 1.5, 2.5, -0.5, 0.0, 1e-9, 12345.675, 0.285, 1.0, -1.115]
    values += [rng.uniform(-1000, 1000) for _ in range(2000)]
    values += [k / 200 for k in range(-400, 400)] + [k / 8 for k in range(-80, 80)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", *[py_round(F.col("v"), n).alias(f"r{n}") for n in (1, 2, 3)]).collect()
    for r in got:
        assert [r.r1, r.r2, r.r3] == [round(r.v, 1), round(r.v, 2), round(r.v, 3)], r


def spoken(yaw, deg):
    rel = ((math.radians(deg) - yaw) + math.pi) % (2 * math.pi) - math.pi
    return math.degrees(rel)


def test_directions_around_the_circle(spark):
    rows = [(float(d), x, y) for d in range(-180, 180, 7) for x, y in
            ((1.0, 0.2), (-1.0, 0.3), (0.1, -2.0), (0.4, 1.5), (0.0, 0.0))]
    df = spark.createDataFrame(rows, "d double, x double, y double").withColumn("yaw", A.radians(F.col("d")))
    zero = F.lit(0.0)
    out = df.select("d", "x", "y", A.relative_direction(F.col("yaw"), zero, zero, F.col("x"), F.col("y")).alias("s"),
                    A.relative_direction(F.col("yaw"), zero, zero, F.col("x"), F.col("y"), "local").alias("c")).collect()
    for r in out:
        rel = (math.atan2(r.y, r.x) - math.radians(r.d) + math.pi) % (2 * math.pi) - math.pi
        sector = int(((math.degrees(rel) + 22.5) % 360) // 45)
        assert r.s == A.SPOKEN[sector] and r.c == A.COMPACT[sector], r


def test_turn_and_quaternion(spark):
    df = spark.createDataFrame([(0.7,), (-2.0,), (None,)], "yaw double")
    q = A.quaternion_from_yaw(F.col("yaw"))
    r = df.select("yaw", q["z"].alias("z"), q["w"].alias("w"),
                  A.yaw_from_quaternion(F.lit(0.0), F.lit(0.0), q["z"], q["w"]).alias("back")).collect()
    assert abs(r[0].back - 0.7) < 1e-12 and abs(r[1].back + 2.0) < 1e-12
    assert (r[2].z, r[2].w) == (0.0, 1.0)
    m = spark.range(1).select(A.turn_message(F.lit("hall"), F.lit(11.31)).alias("a"),
                              A.turn_message(F.lit("hall"), F.lit(-90.0)).alias("b")).first()
    assert m.a == "Rotating to face hall (11.3 degrees left)"
    assert m.b == "Rotating to face hall (90.0 degrees right)"


def test_inverse_undoes_affine(spark):
    df = spark.createDataFrame([(1.5, -2.0), (100.0, 3.25)], "x double, y double")
    args = [F.lit(v) for v in (3.0, -1.0, 33.0, 2.5)]
    p = G.affine_2d(F.col("x"), F.col("y"), *args)
    back = G.inverse_affine_2d(p["x"], p["y"], *args)
    for r in df.select("x", "y", back["x"].alias("u"), back["y"].alias("v")).collect():
        assert abs(r.x - r.u) < 1e-9 and abs(r.y - r.v) < 1e-9
    zero = G.inverse_affine_2d(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert df.select(zero["x"].alias("u")).first().u == 1.5


def test_degenerate_rings(spark):
    df = spark.createDataFrame([([],), ([[1.0, 2.0]],), ([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]],)],
                               "v array<array<double>>")
    out = df.select(F.size(G.ring_edges(F.col("v"))).alias("n"), G.vertex_mean_x(F.col("v")).alias("cx"),
                    F.size(G.close_ring(F.col("v"))).alias("c"),
                    G.polygon_area(G.ring_edges(F.col("v"))).alias("a")).collect()
    assert [(r.n, r.cx, r.c) for r in out] == [(0, None, 0), (1, 1.0, 1), (4, 0.25, 4)]
    assert out[2].a == 0.5


def test_label_color(spark):
    labels = ["chair", "black chair", "TV", "sink", "größe", ""]
    rgb = X.label_color(F.col("l"))
    got = spark.createDataFrame([(v,) for v in labels], "l string").select("l", rgb.alias("c")).collect()
    for r in got:
        h = int(hashlib.md5(r.l.encode()).hexdigest()[:6], 16)
        want = colorsys.hsv_to_rgb((h * 137.508) % 360 / 360.0, 0.7 + (h % 4) * 0.075, 0.8 + (h % 3) * 0.067)
        assert tuple(r.c) == tuple(max(30, min(255, int(v * 255))) for v in want), r


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("\t Living  Room \n", "8. Find: nearest chair", "[nav] x [tool]", 2.9),
         ("KITCHEN", "plain", "late [pose] [init]", 6.0)], "n string, d string, t string, m double")
    r = df.select(X.name_key(F.col("n")).alias("k"), X.category(F.col("d")).alias("c"),
                  X.log_tag(F.col("t")).alias("p"), X.log_tag(F.col("t"), "contains").alias("q"),
                  X.distance_band(F.col("m")).alias("b")).collect()
    assert tuple(r[0]) == ("living  room", "Find", "nav", "tool", "nearby")
    assert tuple(r[1]) == ("kitchen", "Other", None, "pose", "a bit further away")
    codes = spark.createDataFrame([(None,), (2,), (4,), (6,), (5,), (1,), (9,)], "c int")
    out = codes.select(X.status_name(F.col("c")).alias("a"), X.status_name(F.col("c"), "local").alias("b"),
                       X.status_message(F.col("c"), F.lit("hall")).alias("m")).collect()
    assert [x.a for x in out] == ["idle", "navigating", "arrived", "failed", "canceled", "accepted", "unknown"]
    assert [x.b for x in out] == ["no_goal", "executing", "succeeded", "aborted", "canceled", "accepted", "no_goal"]
    assert out[0].m == "No navigation goal active" and out[6].m == "Status: unknown"
