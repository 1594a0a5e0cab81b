"""Small scenes and brute-force answers used by the tests."""

import math

from sceneframe.operators import hierarchy as H
from sceneframe.operators.scene import prepare_zones
from sceneframe.plans.publish import Published

ZONES = "scene_id long, zord long, name string, parent string, vertices array<array<double>>"
OBJECTS = ("scene_id long, ord long, id long, label string, centroid struct<x:double,y:double,z:double>, "
           "confidence double, num_points long, x double, y double")
POSES = "request_id long, scene_id long, robot_id long, x double, y double, yaw double, name string"

# Three tiled rooms and six objects with known answers.
FLAT_ROOMS = [("kitchen", 0, 0, 4, 3), ("living_room", 4, 0, 10, 5), ("hallway", 0, 3, 4, 5)]
FLAT_OBJECTS = [("fridge", 1.0, 1.0, 0.95, 500), ("microwave", 3.0, 1.5, 0.88, 200),
                ("chair", 5.5, 2.0, 0.92, 350), ("table", 6.5, 2.5, 0.90, 600),
                ("couch", 7.0, 4.0, 0.93, 800), ("lamp", 8.5, 1.0, 0.85, 150)]


def rect(x0, y0, x1, y1):
    return [[float(x0), float(y0)], [float(x1), float(y0)], [float(x1), float(y1)], [float(x0), float(y1)]]


def zones_df(spark, rings, scene=0):
    """rings: list of (name, parent, vertices)."""
    return spark.createDataFrame(
        [(scene, i, n, p, v) for i, (n, p, v) in enumerate(rings)], ZONES)


def objects_df(spark, rows, scene=0):
    """rows: list of (label, x, y, confidence, num_points)."""
    return spark.createDataFrame(
        [(scene, i, i + 1, n, (x, y, 0.0), c, p, x, y) for i, (n, x, y, c, p) in enumerate(rows)], OBJECTS)


def flat_scene(spark):
    zones = H.zone_hierarchy(zones_df(spark, [(n, None, rect(*r)) for n, *r in FLAT_ROOMS]))
    return Published(objects_df(spark, FLAT_OBJECTS), zones, H.location_index(zones))


def poses_df(spark, rows):
    """rows: list of (request_id, x, y, yaw, name)."""
    return spark.createDataFrame([(i, 0, 1, x, y, w, n) for i, x, y, w, n in rows], POSES)


def inside(x, y, ring):
    hit = False
    for i, (xi, yi) in enumerate(ring):
        xj, yj = ring[i - 1]
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            hit = not hit
    return hit


def meets(ax, ay, bx, by, ring):
    if inside(ax, ay, ring) or inside(bx, by, ring):
        return True
    for i, (cx, cy) in enumerate(ring):
        dx, dy = ring[(i + 1) % len(ring)]
        den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if abs(den) >= 1e-12:
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
            u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
            if 0 <= t <= 1 and 0 <= u <= 1:
                return True
    return False


def blob(rng, cx, cy, size, n):
    """A star-shaped (possibly concave) polygon."""
    return [[cx + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n),
             cy + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]


def prepared(spark, rings, scene=0):
    return prepare_zones(zones_df(spark, rings, scene))
