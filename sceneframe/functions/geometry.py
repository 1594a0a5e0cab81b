"""Planar geometry as column expressions; no UDFs.

Polygons travel as ``vertices`` (array of [x, y]) and, once prepared, as
``edges`` (array of struct xi, yi, xj, yj with j the previous vertex).
"""

from functools import reduce

from pyspark.sql import Column, functions as F

from sceneframe.functions.angles import radians

EDGE_TYPE = "array<struct<xi:double,yi:double,xj:double,yj:double>>"


def project_x(centroid: Column) -> Column:
    return centroid["x"]


def project_y(centroid: Column, axes: Column) -> Column:
    """'xz' means height is y, anything else means height is z."""
    return F.when(axes == "xz", centroid["z"]).otherwise(centroid["y"])


def affine_x(x, y, tx, deg, scale) -> Column:
    t = radians(deg)
    return x * scale * F.cos(t) - y * scale * F.sin(t) + tx


def affine_y(x, y, ty, deg, scale) -> Column:
    t = radians(deg)
    return x * scale * F.sin(t) + y * scale * F.cos(t) + ty


def affine_2d(x, y, tx, ty, deg, scale) -> Column:
    """Scale, rotate, translate."""
    return F.struct(affine_x(x, y, tx, deg, scale).alias("x"),
                    affine_y(x, y, ty, deg, scale).alias("y"))


def inverse_affine_2d(x, y, tx, ty, deg, scale) -> Column:
    """Untranslate, rotate back, divide by scale (0 counts as 1)."""
    t = radians(-deg)
    k = F.when(scale != 0, 1.0 / F.when(scale != 0, scale)).otherwise(1.0)
    dx, dy = x - tx, y - ty
    return F.struct(((dx * F.cos(t) - dy * F.sin(t)) * k).alias("x"),
                    ((dx * F.sin(t) + dy * F.cos(t)) * k).alias("y"))


def _map_ring(vertices: Column, fn) -> Column:
    def one(v):
        p = fn(v[0], v[1])
        return F.array(p["x"], p["y"])
    return F.transform(vertices, one)


def affine_ring(vertices, tx, ty, deg, scale) -> Column:
    return _map_ring(vertices, lambda x, y: affine_2d(x, y, tx, ty, deg, scale))


def inverse_affine_ring(vertices, tx, ty, deg, scale) -> Column:
    return _map_ring(vertices, lambda x, y: inverse_affine_2d(x, y, tx, ty, deg, scale))


def distance(ax, ay, bx, by) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def ring_edges(vertices: Column) -> Column:
    """Edges (vertex i, vertex i-1), starting with (first, last)."""
    n = F.size(vertices)
    shifted = F.concat(F.slice(vertices, n, 1), F.slice(vertices, 1, n - 1))
    edges = F.zip_with(vertices, shifted, lambda a, b: F.struct(
        a[0].alias("xi"), a[1].alias("yi"), b[0].alias("xj"), b[1].alias("yj")))
    return F.when(n >= 1, edges).otherwise(F.array().cast(EDGE_TYPE))


def point_in_polygon(x: Column, y: Column, edges: Column) -> Column:
    """Half-open ray casting: parity of crossed edges."""
    def crossed(e):
        cut = (e["xj"] - e["xi"]) * (y - e["yi"]) / (e["yj"] - e["yi"]) + e["xi"]
        return F.when((e["yi"] > y) != (e["yj"] > y), x < cut).otherwise(False)
    return F.size(F.filter(edges, crossed)) % 2 == 1


def polygon_area(edges: Column) -> Column:
    """Absolute shoelace area."""
    total = F.aggregate(edges, F.lit(0.0),
                        lambda s, e: s + (e["xj"] * e["yi"] - e["xi"] * e["yj"]))
    return F.abs(total) / 2.0


def vertex_mean_x(vertices: Column) -> Column:
    return F.when(F.size(vertices) > 0,
                  F.aggregate(vertices, F.lit(0.0), lambda s, v: s + v[0])
                  / F.when(F.size(vertices) > 0, F.size(vertices)))


def vertex_mean_y(vertices: Column) -> Column:
    return F.when(F.size(vertices) > 0,
                  F.aggregate(vertices, F.lit(0.0), lambda s, v: s + v[1])
                  / F.when(F.size(vertices) > 0, F.size(vertices)))


def polygon_contains_polygon(outer_edges: Column, inner_vertices: Column) -> Column:
    """Every inner vertex lies inside the outer polygon."""
    return F.forall(inner_vertices, lambda v: point_in_polygon(v[0], v[1], outer_edges))


def segments_intersect(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Closed parametric test; parallel segments never intersect."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
    return F.when(F.abs(den) < 1e-12, False).otherwise(
        (t >= 0.0) & (t <= 1.0) & (u >= 0.0) & (u <= 1.0))


def segment_crosses_polygon(ax, ay, bx, by, edges: Column, rx=None, ry=None) -> Column:
    """The segment meets any edge (closed test, parallel edges never count).

    Lambdas are evaluated node by node, so the three determinants of an edge are
    computed once in a first pass.  ``rx, ry`` may pass bx - ax and by - ay as
    ready columns.
    """
    rx = bx - ax if rx is None else rx
    ry = by - ay if ry is None else ry

    # an edge runs from the earlier vertex (j) to the later one (i)
    def determinants(e):
        ex, ey = e["xi"] - e["xj"], e["yi"] - e["yj"]
        cx, cy = e["xj"] - ax, e["yj"] - ay
        return F.struct((rx * ey - ry * ex).alias("d"), (cx * ey - cy * ex).alias("t"),
                        (cx * ry - cy * rx).alias("u"))

    def met(s):
        return F.when(F.abs(s["d"]) < 1e-12, False).otherwise(
            (s["t"] / s["d"]).between(0.0, 1.0) & (s["u"] / s["d"]).between(0.0, 1.0))
    return F.exists(F.transform(edges, determinants), met)


def flat_edges(edges: Column, n: int) -> list[Column]:
    """The first ``n`` edges as plain columns for :func:`segment_crosses_flat`; absent ones are NaN."""
    out = []
    for i in range(n):
        e = F.get(edges, F.lit(i))
        parts = {"x": e["xj"], "y": e["yj"], "ex": e["xi"] - e["xj"], "ey": e["yi"] - e["yj"]}
        out += [F.coalesce(v, F.lit(float("nan"))).alias(f"_{k}{i}") for k, v in parts.items()]
    return out


def segment_crosses_flat(ax, ay, rx, ry, n: int) -> Column:
    """:func:`segment_crosses_polygon` of a polygon with up to ``n`` edges in :func:`flat_edges`, the same sums in generated code."""
    def met(i):
        x, y, ex, ey = (F.col(f"_{k}{i}") for k in ("x", "y", "ex", "ey"))
        cx, cy = x - ax, y - ay
        d, t, u = rx * ey - ry * ex, cx * ey - cy * ex, cx * ry - cy * rx
        return F.when(F.abs(d) < 1e-12, False).otherwise((t / d).between(0.0, 1.0) & (u / d).between(0.0, 1.0))
    return reduce(lambda a, b: a | b, [met(i) for i in range(n)], F.lit(False))


def along_path(ax, ay, bx, by, px, py) -> Column:
    """Scalar projection of p on the path a->b; null for a degenerate path."""
    length = distance(ax, ay, bx, by)
    safe = F.when(length >= 1e-6, length)
    return (px - ax) * ((bx - ax) / safe) + (py - ay) * ((by - ay) / safe)


def side_offset(ax, ay, bx, by, px, py) -> Column:
    """Distance of p from the line through a and b; null for a degenerate path."""
    length = distance(ax, ay, bx, by)
    safe = F.when(length >= 1e-6, length)
    return F.abs((px - ax) * (-((by - ay) / safe)) + (py - ay) * ((bx - ax) / safe))


def close_ring(vertices: Column) -> Column:
    """Repeat the first vertex at the end unless it is already there."""
    first, last = F.get(vertices, F.lit(0)), F.element_at(vertices, -1)
    same = (first[0] == last[0]) & (first[1] == last[1])
    return F.when(F.size(vertices) < 1, vertices).when(same, vertices).otherwise(
        F.concat(vertices, F.slice(vertices, 1, 1)))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - ax) * dx + (py - ay) * dy) / F.when(len2 > 0, len2)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(px, py, ax + t * dx, ay + t * dy)
