"""Which zones hold a point: a theta join turned into equi-joins.

Two physical forms give the same rows:

* **cell index** - when the zone table is proven small, zones are cut over a
  uniform grid, the zones touching a cell are packed into one row, and that
  table is broadcast.  A point meets exactly one index row, so locating points
  is map-only: one hash lookup, no shuffle, no pair table.
* **level cells** - for zone tables of any size, each zone goes to the grid
  level of its own extent (at most four cells) and points are expanded over the
  levels in use; the join key is (scene, level, cell).  Levels with few zones,
  which are the coarse ones whose cells hold very many points, are broadcast;
  only the fine levels, with many distinct cells, are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.functions import geometry as G
from sceneframe.operators.scale import shuffled

#: bounds of the broadcast cell index
INDEX_ZONES = 20_000
INDEX_ENTRIES = 100_000
INDEX_VERTICES = 1_000_000
#: bytes of the payload's texts, two per character, over all cells
INDEX_TEXT_BYTES = 64 << 20


@dataclass
class ZoneIndex:
    """Prepared zones with their broadcast cell index if small enough, or grid levels."""
    zones: DataFrame
    cell: float | None = None
    cells: DataFrame | None = None
    coarse: tuple[int, ...] = ()  #: levels measured small, broadcast
    fine: tuple[int, ...] = ()    #: levels joined by a shuffle


def level_of(extent: Column) -> Column:
    """Smallest integer l with 2**l >= extent."""
    return F.when(extent > 0, F.ceil(F.log2(extent) + 1e-9)).otherwise(-20).cast("int")


def cell_no(v: Column, size: Column) -> Column:
    return F.floor(v / size)


def _in_box(x: Column, y: Column, z) -> Column:
    return ((x >= z["minx"]) & (x <= z["maxx"]) & (y >= z["miny"]) & (y <= z["maxy"]))


def level_cells(zones: DataFrame) -> DataFrame:
    """Prepared zones with _level, _cx, _cy: at most four rows per zone."""
    size = F.pow(F.lit(2.0), F.col("_level"))
    return (zones.withColumn("_level", level_of(F.greatest(
                F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))))
            .withColumn("_cx", F.explode(F.sequence(cell_no(F.col("minx"), size),
                                                    cell_no(F.col("maxx"), size))))
            .withColumn("_cy", F.explode(F.sequence(cell_no(F.col("miny"), size),
                                                    cell_no(F.col("maxy"), size)))))


def zone_levels(zones: DataFrame, max_zones: int | None = None) -> tuple[tuple, tuple]:
    """Grid levels in use, as (levels small enough to broadcast together, the rest).

    One row per binary exponent comes to the driver.  The coarsest levels are
    taken first.
    """
    budget = INDEX_ENTRIES // 4 if max_zones is None else max_zones
    level = level_of(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))
    rows = (zones.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"),
                                                F.sum(F.size("vertices")).alias("v"))
            .where("l is not null").collect())
    coarse, fine, n, v = [], [], 0, 0
    for r in sorted(rows, key=lambda r: -r["l"]):
        if n + r["n"] <= budget and v + r["v"] <= INDEX_VERTICES:
            coarse.append(r["l"])
            n, v = n + r["n"], v + r["v"]
        else:
            fine.append(r["l"])
    return tuple(coarse), tuple(fine)


def zone_index(zones: DataFrame, payload=("name",), force: str | None = None,
               cell: float | None = None) -> ZoneIndex:
    """Measure prepared zones once and choose the physical form.

    ``force`` ('cells', 'levels' or 'shuffle') overrides the choice, for tests.
    """
    valid = zones.where(F.size("vertices") >= 3)
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    nv = F.size("vertices")
    texts = [f.name for f in zones.schema if f.name in payload and f.dataType.simpleString() == "string"]
    nb = sum((F.coalesce(F.length(c), F.lit(0)) * 2 for c in texts), F.lit(0)).cast("double")
    m = valid.agg(
        F.count(F.lit(1)).alias("n"), F.sum(nv).alias("v"),
        F.sum(w * h).alias("wh"), F.sum(w + h).alias("w_h"),
        F.sum(nv * w * h).alias("vwh"), F.sum(nv * (w + h)).alias("vw_h"),
        F.sum(nb).alias("b"), F.sum(nb * w * h).alias("bwh"), F.sum(nb * (w + h)).alias("bw_h"),
        F.percentile_approx(F.least(w, h), 0.25, 100).alias("side")).first()
    if force in (None, "cells") and m["n"] <= INDEX_ZONES and (m["v"] or 0) <= INDEX_VERTICES:
        size = cell or max((m["side"] or 1.0) / 2.0, 1e-6)
        for _ in range(60):
            # a box of w x h meets at most (w/c + 1) * (h/c + 1) cells, plus one per side
            entries = (m["wh"] or 0) / size ** 2 + 2 * (m["w_h"] or 0) / size + 4 * m["n"]
            vertices = (m["vwh"] or 0) / size ** 2 + 2 * (m["vw_h"] or 0) / size + 4 * (m["v"] or 0)
            letters = (m["bwh"] or 0) / size ** 2 + 2 * (m["bw_h"] or 0) / size + 4 * (m["b"] or 0)
            if entries <= INDEX_ENTRIES and vertices <= INDEX_VERTICES * 4 and letters <= INDEX_TEXT_BYTES:
                return ZoneIndex(zones, size, _pack_cells(valid, size, payload))
            size *= 2.0
    coarse, fine = zone_levels(valid, 0 if force == "shuffle" else None)
    return ZoneIndex(zones, coarse=coarse, fine=fine)


def _pack_cells(valid: DataFrame, size: float, payload) -> DataFrame:
    c = F.lit(size)
    keep = list(dict.fromkeys(["zord", *payload, "minx", "maxx", "miny", "maxy", "edges"]))
    return (valid
            .withColumn("_cx", F.explode(F.sequence(cell_no(F.col("minx"), c),
                                                    cell_no(F.col("maxx"), c))))
            .withColumn("_cy", F.explode(F.sequence(cell_no(F.col("miny"), c),
                                                    cell_no(F.col("maxy"), c))))
            # the table was measured above: at most INDEX_ENTRIES rows in all
            .groupBy("scene_id", "_cx", "_cy")
            .agg(F.array_sort(F.collect_list(F.struct(*keep))).alias("_near")))


def _with_hits(points: DataFrame, index: ZoneIndex, x: str, y: str) -> DataFrame:
    """Points with ``_hits``: the zones holding them, in list order (cell form)."""
    size = F.lit(index.cell)
    px, py = F.col(x), F.col(y)
    cells = index.cells.withColumnRenamed("scene_id", "_scene")
    joined = (points.withColumn("_px", cell_no(px, size)).withColumn("_py", cell_no(py, size))
              .join(F.broadcast(cells),
                    (F.col("scene_id") == F.col("_scene")) & (F.col("_px") == F.col("_cx"))
                    & (F.col("_py") == F.col("_cy")), "left"))
    hits = F.filter("_near", lambda z: F.when(
        _in_box(px, py, z), G.point_in_polygon(px, py, z["edges"])).otherwise(False))
    return joined.withColumn("_hits", hits).drop("_px", "_py", "_scene", "_cx", "_cy", "_near")


def _level_pairs(points: DataFrame, index: ZoneIndex, x: str, y: str, payload) -> DataFrame:
    """Containment pairs (level form); index must have levels."""
    px, py = F.col(x), F.col(y)
    zones = level_cells(index.zones.where(F.size("vertices") >= 3)).select(
        F.col("scene_id").alias("_scene"), F.col("_level").alias("_zl"), "_cx", "_cy",
        F.struct("minx", "maxx", "miny", "maxy", "edges").alias("_g"),
        F.struct("zord", *[p for p in payload if p != "zord"]).alias("_z"))
    size = F.pow(F.lit(2.0), F.col("_level"))
    match = ((F.col("scene_id") == F.col("_scene")) & (F.col("_level") == F.col("_zl"))
             & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))
             & _in_box(px, py, F.col("_g")) & G.point_in_polygon(px, py, F.col("_g.edges")))

    def pairs(levels, small: bool) -> DataFrame:
        spread = (points.withColumn("_level", F.explode(F.array(*[F.lit(l) for l in levels])))
                  .withColumn("_px", cell_no(px, size)).withColumn("_py", cell_no(py, size)))
        side = zones.where(F.col("_zl").isin(*levels))
        return spread.join(F.broadcast(side) if small else shuffled(side), match).select(*points.columns, "_z")
    parts = [pairs(levels, small) for levels, small in ((index.coarse, True), (index.fine, False))
             if levels]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def points_in_zones(points: DataFrame, index: ZoneIndex, x: str = "x", y: str = "y",
                    payload=("name",)) -> DataFrame:
    """All (point, zone) containments: point columns, zone_ord, zone_<payload>."""
    names = ["zord", *[p for p in payload if p != "zord"]]
    if index.cells is not None:
        pairs = (_with_hits(points, index, x, y)
                 .withColumn("_z", F.explode("_hits")).drop("_hits"))
    elif index.coarse or index.fine:
        pairs = _level_pairs(points, index, x, y, payload)
    else:
        pairs = (points.withColumn("_z", F.lit(None).cast(
            index.zones.select(F.struct(*names).alias("s")).schema["s"].dataType)).where("false"))
    return pairs.select(*points.columns, F.col("_z.zord").alias("zone_ord"),
                        *[F.col(f"_z.{p}").alias(f"zone_{p}") for p in names if p != "zord"])


def assign_zone(points: DataFrame, index: ZoneIndex, key, rule: str = "deepest",
                x: str = "x", y: str = "y", take: dict[str, str] | None = None) -> DataFrame:
    """Points with the columns of their zone (null outside every zone).

    ``rule='deepest'``: greatest depth, then list order.  ``rule='first'``: first
    in list order.  ``take`` maps zone columns to output names; ``key`` names the
    columns that identify a point (used by the level form only).
    """
    take = take or ({"name": "zone", "parent": "parent_zone", "full_path": "full_path"}
                    if rule == "deepest" else {"name": "zone"})
    payload = list(dict.fromkeys(["zord", *(["depth"] if rule == "deepest" else []), *take]))
    if index.cells is not None:
        hits = _with_hits(points, index, x, y)
        if rule == "first":
            best = F.get("_hits", F.lit(0))
        else:
            best = F.array_min(F.transform("_hits", lambda z: F.struct(
                (-z["depth"]).alias("_d"), *[z[p].alias(p) for p in payload])))
        found = hits.withColumn("_b", best)
        return found.select(*points.columns,
                            *[F.col(f"_b.{c}").alias(n) for c, n in take.items()])
    if not (index.coarse or index.fine):
        types = {f.name: f.dataType for f in index.zones.schema}
        return points.select("*", *[F.lit(None).cast(types[c]).alias(n) for c, n in take.items()])
    pairs = _level_pairs(points.select("scene_id", *[k for k in key if k != "scene_id"], x, y),
                         index, x, y, payload)
    rank = (F.struct("_z.zord") if rule == "first"
            else F.struct((-F.col("_z.depth")).alias("d"), F.col("_z.zord").alias("o")))
    keys = list(dict.fromkeys(["scene_id", *key]))
    best = pairs.groupBy(*keys).agg(F.min_by("_z", rank).alias("_b"))
    return (points.join(best, keys, "left")
            .select(*[F.col(c) for c in points.columns],
                    *[F.col(f"_b.{c}").alias(n) for c, n in take.items()]))


def zone_memberships(points: DataFrame, index: ZoneIndex, key,
                     x: str = "x", y: str = "y") -> DataFrame:
    """Containment rows with ``direct`` and the point's own location.

    ``direct`` says that the zone carries the name of the deepest zone of the
    point; zone, parent_zone and full_path describe that deepest zone.
    """
    if index.cells is not None:
        hits = _with_hits(points, index, x, y)
        best = F.array_min(F.transform("_hits", lambda z: F.struct(
            (-z["depth"]).alias("d"), z["zord"].alias("o"), z["name"].alias("zone"),
            z["parent"].alias("parent_zone"), z["full_path"].alias("full_path"))))
        rows = hits.withColumn("_b", best).withColumn("_z", F.explode("_hits")).select(
            *points.columns, F.col("_z.zord").alias("zone_ord"),
            F.col("_z.name").alias("zone_name"), F.col("_b.zone").alias("zone"),
            F.col("_b.parent_zone").alias("parent_zone"),
            F.col("_b.full_path").alias("full_path"))
    else:
        rows = points_in_zones(assign_zone(points, index, key, "deepest", x, y), index, x, y)
    return rows.withColumn("direct", F.col("zone") == F.col("zone_name"))
