"""Reference SQL for the registered queries, written as plain set-at-a-time SQL.

Each statement recomputes its answer from the base tables by comparing
everything with everything; no grid, index or hierarchy shortcut is shared with
the Spark plans.
"""

from __future__ import annotations

import math

from sceneframe.functions.angles import COMPACT, SPOKEN
from sceneframe.functions.rounding import round_sql
from sceneframe.functions.text import CONTAINED_TAGS, PREFIX_TAGS, STATUS_NAMES
from sceneframe.plans.registry import ALIGN, ESTIMATE
from sceneframe.sources.tables import KEYWORDS, STATUS_OF_EVENT, TAG_OF_EVENT, TOOL_ARGUMENTS, TOOL_OF_EVENT

PI = repr(math.pi) + "e0"
TWO_PI = repr(2 * math.pi) + "e0"
TO_DEG = repr(180.0 / math.pi) + "e0"
TO_RAD = repr(math.pi / 180.0) + "e0"


def dbl(v: float) -> str:
    return f"({v!r}e0)"


def rnd(v: str, n: int) -> str:
    return round_sql(v, n)


def pip(x: str, y: str, e: str) -> str:
    return (f"(len(list_filter({e}, lambda e: CASE WHEN (e.yi > {y}) <> (e.yj > {y}) "
            f"THEN {x} < (e.xj - e.xi) * ({y} - e.yi) / (e.yj - e.yi) + e.xi ELSE false END)) % 2 = 1)")


def wrap(a: str) -> str:
    m = f"(({a} + {PI}) % {TWO_PI})"
    return f"(CASE WHEN {m} < 0 THEN {m} + {TWO_PI} ELSE {m} END - {PI})"


def dist(ax, ay, bx, by) -> str:
    return f"sqrt(({ax}-{bx})*({ax}-{bx})+({ay}-{by})*({ay}-{by}))"


def rel_deg(yaw, rx, ry, ox, oy) -> str:
    return f"({wrap(f'(atan2({oy}-{ry}, {ox}-{rx}) - {yaw})')} * {TO_DEG})"


def sector(deg: str, words=SPOKEN) -> str:
    w = [s.replace("'", "''") for s in words]
    return (f"CASE WHEN {deg} IS NULL THEN NULL WHEN {deg} >= 157.5 OR {deg} < -157.5 THEN '{w[4]}' "
            f"WHEN {deg} >= 112.5 THEN '{w[3]}' WHEN {deg} >= 67.5 THEN '{w[2]}' "
            f"WHEN {deg} >= 22.5 THEN '{w[1]}' WHEN {deg} >= -22.5 THEN '{w[0]}' "
            f"WHEN {deg} >= -67.5 THEN '{w[7]}' WHEN {deg} >= -112.5 THEN '{w[6]}' ELSE '{w[5]}' END")


def case(column: str, mapping: dict) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


def crosses(ax, ay, bx, by, e) -> str:
    den = f"(({bx}-{ax})*(e.yi-e.yj)-({by}-{ay})*(e.xi-e.xj))"
    t = f"(((e.xj-{ax})*(e.yi-e.yj)-(e.yj-{ay})*(e.xi-e.xj))/{den})"
    u = f"(((e.xj-{ax})*({by}-{ay})-(e.yj-{ay})*({bx}-{ax}))/{den})"
    return (f"(len(list_filter({e}, lambda e: CASE WHEN abs({den}) < 1e-12 THEN false "
            f"ELSE {t} >= 0 AND {t} <= 1 AND {u} >= 0 AND {u} <= 1 END)) > 0)")


def keyword(i: str) -> str:
    return "list_extract([" + ", ".join(f"'{k}'" for k in KEYWORDS) + f"], ({i} % 8 + 1)::INT)"


def affine(x, y, tx, ty, deg, scale):
    t = f"({dbl(deg)}*{TO_RAD})"
    sx, sy = f"({x}*{dbl(scale)})", f"({y}*{dbl(scale)})"
    return (f"({sx}*cos({t})-{sy}*sin({t})+{dbl(tx)})", f"({sx}*sin({t})+{sy}*cos({t})+{dbl(ty)})")


def inverse(x, y, tx, ty, deg, scale):
    t = f"({dbl(-deg)}*{TO_RAD})"
    dx, dy, k = f"({x}-{dbl(tx)})", f"({y}-{dbl(ty)})", f"(1e0/{dbl(scale)})"
    return (f"(({dx}*cos({t})-{dy}*sin({t}))*{k})", f"(({dx}*sin({t})+{dy}*cos({t}))*{k})")


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "rects": ((), """
        SELECT r_regionkey::BIGINT AS zord, r_name AS name, r_regionkey*100e0 AS x0, 100e0 AS w, 0e0 AS y0, 100e0 AS h FROM region
        UNION ALL SELECT (SELECT max(r_regionkey)+1 FROM region)+n_nationkey, n_name, nx, 17e0, 2e0, 96e0 FROM nations
        UNION ALL SELECT (SELECT max(r_regionkey)+1 FROM region)+(SELECT max(n_nationkey)+1 FROM nation)+(SELECT count(*) FROM segments)*n_nationkey+m, n_name || '/' || seg, nx+1e0, 15e0, m*18e0+4e0, 16e0 FROM nations, segments"""),
    "nations": ((), """
        SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey*100e0 + 2e0
               + (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)-1)*19e0 AS nx FROM nation"""),
    "segments": ((), """
        SELECT c_mktsegment AS seg, row_number() OVER (ORDER BY c_mktsegment)-1 AS m
        FROM (SELECT DISTINCT c_mktsegment FROM customer)"""),
    "corners": (("nations", "segments", "rects"), """
        SELECT zord, name, x0+0e0+y0*0.25e0 AS x1, y0 AS y1, x0+w+y0*0.25e0 AS x2, y0 AS y2,
               x0+w+(y0+h)*0.25e0 AS x3, y0+h AS y3, x0+0e0+(y0+h)*0.25e0 AS x4, y0+h AS y4 FROM rects"""),
    "zones": (("corners",), """
        SELECT *, (x1+x2+x3+x4)/4 AS cx, (y1+y2+y3+y4)/4 AS cy,
               abs((x4*y1-x1*y4)+(x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y4-x4*y3))/2 AS area,
               [{'xi': x1, 'yi': y1, 'xj': x4, 'yj': y4}, {'xi': x2, 'yi': y2, 'xj': x1, 'yj': y1},
                {'xi': x3, 'yi': y3, 'xj': x2, 'yj': y2}, {'xi': x4, 'yi': y4, 'xj': x3, 'yj': y3}] AS edges
        FROM corners"""),
    "parents": (("zones",), f"""
        SELECT zord, name, pname AS parent FROM (
          SELECT c.zord, c.name, p.name AS pname,
                 row_number() OVER (PARTITION BY c.zord ORDER BY p.area, p.zord) AS rn
          FROM zones c LEFT JOIN zones p ON p.zord <> c.zord
            AND {pip('c.x1', 'c.y1', 'p.edges')} AND {pip('c.x2', 'c.y2', 'p.edges')}
            AND {pip('c.x3', 'c.y3', 'p.edges')} AND {pip('c.x4', 'c.y4', 'p.edges')}) WHERE rn = 1"""),
    "climb": (("parents",), """
        SELECT zord, name, parent AS up, 0::BIGINT AS hops, name AS shown FROM parents
        UNION ALL SELECT c.zord, c.name, p.parent, c.hops+1, p.name || ' > ' || c.shown
        FROM climb c JOIN parents p ON p.name = c.up"""),
    "hier": (("climb",), """
        SELECT z.*, p.parent, c.hops AS depth, c.shown AS full_path
        FROM zones z JOIN parents p USING (zord) JOIN climb c ON c.zord = z.zord AND c.up IS NULL"""),
    "allobj": ((), """
        SELECT p_partkey AS id, p_partkey AS ord, p_name AS label, p_size/50e0 AS confidence,
               (p_partkey*13)%200 AS num_points, ((p_partkey*37)%5250)/10e0 AS x, ((p_partkey*7919)%1000)/10e0 AS y FROM part"""),
    "obj": (("allobj",), "SELECT * FROM allobj WHERE confidence >= 3e-1 AND num_points >= 50"),
    "poses": ((), f"""
        SELECT event_id AS request_id, user_id AS robot_id, ts, event_type, props,
               ((event_id*7919)%5250)/10e0 AS x, ((event_id*104729)%1000)/10e0 AS y,
               (((event_id*31)%3600)/10e0-180e0)*{TO_RAD} AS yaw, {keyword('event_id')} AS keyword,
               event_id AS zpick FROM events"""),
    "named": (("poses", "zones"), """
        SELECT p.*, z.name AS zone_name, z.zord AS zone_zord, z.cx AS tx, z.cy AS ty FROM poses p
        JOIN (SELECT *, row_number() OVER (ORDER BY zord) - 1 AS place, count(*) OVER () AS places FROM zones) z ON z.place = p.zpick % z.places"""),
    "inzone": (("hier", "allobj"), f"""
        SELECT o.id, z.zord, z.name, z.depth, z.parent, z.full_path
        FROM allobj o JOIN hier z ON {pip('o.x', 'o.y', 'z.edges')}"""),
    "deepest": (("inzone",), """
        SELECT id, name AS zone, parent AS parent_zone, full_path FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC, zord) AS rn FROM inzone) WHERE rn = 1"""),
    "posezone": (("poses", "zones"), f"""
        SELECT request_id, name AS current_zone FROM (
          SELECT p.request_id, z.name, row_number() OVER (PARTITION BY p.request_id ORDER BY z.zord) AS rn
          FROM poses p JOIN zones z ON {pip('p.x', 'p.y', 'z.edges')}) WHERE rn = 1"""),
    "catalogue": (("zones", "obj"), """
        SELECT key, destination, kind, tx, ty FROM (
          SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, ord) AS rn FROM (
            SELECT lower(name) AS key, name AS destination, 'zone' AS kind, cx AS tx, cy AS ty, 0 AS prio, zord AS ord FROM zones
            UNION ALL SELECT lower(label), label, 'object', x, y, 1, ord FROM obj)) WHERE rn = 1"""),
    "labelreq": ((), """
        SELECT event_id AS request_id, coalesce(' ' || upper(p_name) || ' ', 'no such thing') AS object_label,
               lower(coalesce(p_name, 'no such thing')) AS label_key
        FROM events LEFT JOIN part ON p_partkey = (event_id*3) % ((SELECT count(*) + count(*)//10 FROM part))"""),
    "mixed": (("named", "labelreq", "catalogue"), """
        SELECT n.request_id, n.x, n.y, n.yaw, CASE WHEN n.request_id % 2 = 0 THEN zone_name ELSE object_label END AS name,
               c.destination, c.kind, c.tx, c.ty
        FROM named n JOIN labelreq l USING (request_id)
        LEFT JOIN catalogue c ON c.key = lower(trim(CASE WHEN n.request_id % 2 = 0 THEN zone_name ELSE object_label END))"""),
    "best": (("poses", "obj"), f"""
        SELECT request_id, keyword, ord, label, d, ox, oy, x, y, yaw FROM (
          SELECT p.request_id, p.keyword, p.x, p.y, p.yaw, o.ord, o.label, o.x AS ox, o.y AS oy,
                 {dist('p.x', 'p.y', 'o.x', 'o.y')} AS d,
                 row_number() OVER (PARTITION BY p.request_id ORDER BY {dist('p.x', 'p.y', 'o.x', 'o.y')}, o.ord) AS rn
          FROM poses p JOIN obj o ON contains(lower(o.label), p.keyword)) WHERE rn = 1"""),
    "routes": (("named",), f"""
        SELECT request_id, x AS ax, y AS ay, tx AS bx, ty AS by_, {dist('x', 'y', 'tx', 'ty')} AS len FROM named"""),
    "passed": (("routes", "obj"), f"""
        SELECT request_id, ord, label, {rnd('a', 2)} AS along, {rnd('s', 2)} AS side FROM (
          SELECT r.request_id, o.ord, o.label, r.len,
                 (o.x-r.ax)*((r.bx-r.ax)/r.len)+(o.y-r.ay)*((r.by_-r.ay)/r.len) AS a,
                 abs((o.x-r.ax)*(-((r.by_-r.ay)/r.len))+(o.y-r.ay)*((r.bx-r.ax)/r.len)) AS s
          FROM routes r JOIN obj o ON r.len >= 1e-6) WHERE a >= 0 AND a <= len AND s <= 2"""),
    "met": (("routes", "zones"), f"""
        SELECT r.request_id, z.zord, z.name FROM routes r JOIN zones z ON r.len >= 1e-6 AND (
          {pip('r.ax', 'r.ay', 'z.edges')} OR {pip('r.bx', 'r.by_', 'z.edges')}
          OR {crosses('r.ax', 'r.ay', 'r.bx', 'r.by_', 'z.edges')})"""),
    "late": ((), """
        SELECT event_id AS request_id, user_id AS robot_id, ts + INTERVAL 90 MINUTE AS ts FROM events"""),
    "near3": (("poses", "obj"), f"""
        SELECT p.request_id, o.ord, o.id, o.label, p.x, p.y, p.yaw, o.x AS ox, o.y AS oy,
               {dist('p.x', 'p.y', 'o.x', 'o.y')} AS d
        FROM poses p JOIN obj o ON {dist('p.x', 'p.y', 'o.x', 'o.y')} <= 3"""),
    "goals": (("named",), """
        SELECT robot_id, ts - INTERVAL 2 HOUR AS ts, request_id, x, y, zone_name AS destination FROM named"""),
    "turns": ((), f"""
        SELECT conv_id AS case_id, turn, role, text AS content,
               CASE WHEN role = 'assistant' AND conv_id % 5 <> 0 THEN list_extract(['find_nearest', 'list_zones',
                 'navigate_to_zone', 'describe_surroundings'], ((conv_id+turn)%4+1)::INT) END AS call_name,
               CASE WHEN turn % 3 = 2 THEN NULL ELSE {keyword('conv_id')} END AS call_arg,
               CASE WHEN turn % 3 = 2 THEN '{{broken' ELSE '{{"object_type":"' || {keyword('conv_id')} || '"}}' END AS call_args
        FROM conversations"""),
    "rounds": (("turns",), """
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY turn) AS rn FROM turns WHERE role = 'assistant'"""),
    "transcripts": (("rounds", "turns"), """
        SELECT c.case_id, coalesce(string_agg(content, '' ORDER BY r.turn), '') AS final_text,
               coalesce(list(call_name ORDER BY r.turn) FILTER (call_name IS NOT NULL), []) AS called,
               coalesce(list(struct_pack(n := call_name, a := call_arg) ORDER BY r.turn)
                        FILTER (call_name IS NOT NULL), []) AS calls
        FROM (SELECT DISTINCT case_id FROM turns) c LEFT JOIN rounds r USING (case_id) GROUP BY 1"""),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in _CTES[n][0]:
            visit(d)
        if n == "rects":
            for d in ("nations", "segments"):
                visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def obj(**fields: str) -> str:
    """SQL for the text of a JSON object from SQL texts of JSON values; a missing value reads null."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || coalesce({v}, 'null')" for k, v in fields.items()) + " || '}'"


def quoted(v: str) -> str:
    return f"('\"' || {v} || '\"')"


def number(v: str) -> str:
    return f"({v})::VARCHAR"


def listed(v: str, order: str) -> str:
    return f"'[' || string_agg({v}, ',' ORDER BY {order}) || ']'"


def whole_answers(dialect: str, message: str, status: str, counts: str) -> str:
    """Whole answers of all tools, tool by tool, and the log lines that show their first 300 characters."""
    local = dialect == "local"
    words = COMPACT if local else SPOKEN
    far = "distance_m" if local else "distance"
    turn = rel_deg("q.yaw", "q.x", "q.y", "q.tx", "q.ty")
    mixed_turn = rel_deg("m.yaw", "m.x", "m.y", "m.tx", "m.ty")
    code = "a.code"
    sentence = (f"CASE WHEN {code} = 4 THEN 'Arrived at ' || dd WHEN {code} = 2 THEN 'Currently navigating to ' || dd WHEN {code} = 6 THEN "
                f"'Navigation to ' || dd || ' failed — path may be blocked' WHEN {code} = 5 THEN 'Navigation was canceled' ELSE 'Status: accepted' END")
    place = obj(zone=quoted("d.zone"), parent_zone=quoted("d.parent_zone"), full_path=quoted("d.full_path"))
    found = obj(id=number("o.id"), label=quoted("o.label"), map_position=obj(x=number("o.x"), y=number("o.y")), location=place)
    thing = obj(id=number("o.id"), label=quoted("o.label"), confidence=number("o.confidence"), num_points=number("o.num_points"),
                centroid_3d=obj(x=number("o.x"), y="'0.0'", z=number("o.y")), map_position=obj(x=number("o.x"), y=number("o.y")), location=place)
    corner = " || ',' || ".join(f"'[' || z.x{i}::VARCHAR || ',' || z.y{i}::VARCHAR || ']'" for i in (1, 2, 3, 4))
    children = f"(SELECT {listed(quoted('k.name'), 'k.zord')} FROM hier k WHERE k.parent = z.name)"
    empty = lambda v: f"coalesce({v}, '[]')"
    goal = lambda kind, name, x, y: (
        obj(status="'\"goal_sent\"'", **{kind: quoted(name)}, goal_x=number(rnd(x, 3)), goal_y=number(rnd(y, 3))) if local else
        obj(success="'true'", **{kind: quoted(name)}, goal=obj(x=number(rnd(x, 3)), y=number(rnd(y, 3)))))
    missing = "'Object ''' || q.object_label || ''' not found."
    lost = (obj(error=quoted(missing + "'"), hint="'\"Use list_objects to see available object labels.\"'") if local else
            obj(error=quoted(missing + " Use list_objects to see available labels.'")))
    around = dict(current_zone=quoted("z.current_zone"), **({"radius_m": "'3.0'"} if local else {"count": number("coalesce(k.n, 0)")}),
                  nearby_objects=empty("k.items"))
    status_body = dict(status=quoted(f"coalesce({case(code, STATUS_NAMES[dialect])}, '{'no_goal' if local else 'unknown'}')"),
                       destination=quoted("a.destination"), **({} if local else {"message": quoted(sentence)}))
    cancelled = "'{\"error\":\"Unknown tool: cancel_navigation\"}'" if local else "'{\"success\":true,\"message\":\"Navigation cancelled\"}'"
    answers = {
        "get_robot_pose": f"SELECT q.request_id, " + obj(
            x=number(rnd("q.x", 3)), y=number(rnd("q.y", 3)), yaw_deg=number(rnd(f"(q.yaw*{TO_DEG})", 1)), frame="'\"map\"'",
            current_zone=quoted("z.current_zone")) + " AS result FROM q LEFT JOIN posezone z USING (request_id)",
        "describe_surroundings": f"SELECT q.request_id, {obj(**around)} FROM q LEFT JOIN posezone z USING (request_id) LEFT JOIN ("
            f"SELECT request_id, count(*) AS n, {listed(obj(label=quoted('label'), **{far: number('dd'), 'direction': quoted(sector('g', words))}), 'dd, ord')} AS items "
            f"FROM (SELECT *, {rnd('d', 2)} AS dd, {rel_deg('yaw', 'x', 'y', 'ox', 'oy')} AS g FROM near3) GROUP BY 1) k USING (request_id)",
        "find_nearest": f"SELECT q.request_id, " + obj(
            label=quoted("b.label"), distance_m=number(rnd("b.d", 2)), direction=quoted(sector("b.g", words)), zone=quoted("f.zone")) +
            f" FROM q JOIN (SELECT *, {rel_deg('yaw', 'x', 'y', 'ox', 'oy')} AS g FROM best) b USING (request_id) LEFT JOIN ("
            f"SELECT id, arg_min(name, zord) AS zone FROM inzone GROUP BY 1) f ON f.id = b.ord",
        "distance_to": f"SELECT request_id, CASE WHEN destination IS NULL THEN " + obj(
            error=quoted("'Destination ''' || name || ''' not found.'"), hint="'\"Use list_zones or list_objects to see available names.\"'") + " ELSE " + obj(
            destination=quoted("destination"), destination_type=quoted("kind"), distance_m=number(rnd("d", 2)), direction=quoted(sector("g", words))) +
            f" END FROM (SELECT m.*, {dist('m.x', 'm.y', 'm.tx', 'm.ty')} AS d, {mixed_turn} AS g FROM mixed m JOIN q USING (request_id))",
        "describe_route": f"SELECT q.request_id, " + obj(
            destination=quoted("q.zone_name"), total_distance_m=number(rnd(dist("q.x", "q.y", "q.tx", "q.ty"), 2)), direction=quoted(sector(turn, words)),
            zones_along_path=empty("a.items"), objects_along_path=empty("b.items")) +
            f" FROM q LEFT JOIN (SELECT request_id, {listed(quoted('name'), 'zord')} AS items FROM met GROUP BY 1) a USING (request_id) LEFT JOIN ("
            f"SELECT request_id, {listed(obj(label=quoted('label'), distance_along_path_m=number('along'), side_offset_m=number('side')), 'along, ord')} AS items "
            f"FROM passed GROUP BY 1) b USING (request_id)",
        "orient_me": "SELECT request_id, " + obj(
            target=quoted("zone_name"), direction_from_current=quoted(sector("g", words)), turn_degrees=number(rnd("g", 1)),
            message=quoted(message.format(n="zone_name"))) + f" FROM (SELECT q.*, {turn} AS g FROM q)",
        "navigate_to_zone": f"SELECT request_id, {goal('zone', 'zone_name', 'tx', 'ty')} FROM q",
        "navigate_to_object": f"SELECT q.request_id, CASE WHEN o.label IS NULL THEN {lost} ELSE {goal('object', 'o.label', 'o.x', 'o.y')} END FROM q LEFT JOIN ("
            f"SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY ord) AS rn FROM obj) o ON rn = 1 AND lower(o.label) = q.label_key",
        "query_object": "SELECT q.request_id, " + obj(
            query=quoted("q.object_label"), found="CASE WHEN k.n IS NULL THEN 'false' ELSE 'true' END", count=number("k.n"), objects=empty("k.items")) +
            f" FROM q LEFT JOIN (SELECT lower(o.label) AS label_key, count(*) AS n, {listed(thing, 'o.ord')} AS items "
            f"FROM obj o LEFT JOIN deepest d ON d.id = o.id GROUP BY 1) k USING (label_key)",
        "get_navigation_status": f"SELECT a.request_id, {obj(**status_body)} FROM (SELECT a.*, g.destination, coalesce(g.destination, 'None') AS dd FROM ("
            f"SELECT q.*, s.code FROM q ASOF LEFT JOIN ({status}) s ON q.robot_id = s.robot_id AND q.ts >= s.ts) a "
            f"ASOF LEFT JOIN goals g ON a.robot_id = g.robot_id AND a.ts >= g.ts) a",
        "cancel_navigation": f"SELECT request_id, {cancelled} FROM q",
        "query_zone": "SELECT q.request_id, " + obj(query=quoted("q.zone_name"), found="'true'", zone="r.body", objects=empty("c.objects"),
                                                    direct_objects=empty("c.direct")) + " FROM q JOIN (SELECT z.zord, " + obj(
            name=quoted("z.name"), display_name=quoted("z.full_path"), parent=quoted("z.parent"), depth=number("z.depth"), children=empty(children),
            vertices_world=f"'[' || {corner} || ']'", num_objects=number("n.num_objects"), num_direct_objects=number("n.num_direct_objects")) +
            f" AS body FROM hier z JOIN ({counts}) n USING (zord)) r ON r.zord = q.zone_zord LEFT JOIN ("
            f"SELECT i.zord, {listed(found, 'o.ord')} AS objects, '[' || string_agg({found}, ',' ORDER BY o.ord) FILTER (d.zone = i.name) || ']' AS direct "
            f"FROM inzone i JOIN obj o ON o.id = i.id JOIN deepest d ON d.id = i.id GROUP BY 1) c ON c.zord = q.zone_zord",
        "list_zones": "SELECT request_id, '{\"zones\":' || (SELECT " + listed(
            f"'{{\"name\":\"' || z.name || '\",\"display_name\":\"' || z.full_path || '\"' || coalesce(',\"parent\":' || {quoted('z.parent')}, '') "
            f"|| coalesce(',\"children\":' || {children}, '') || '}}'", "z.zord") + " FROM hier z) || '}' FROM q",
        "list_objects": "SELECT request_id, '{\"objects\":' || (SELECT " + listed(quoted("label"), "label") +
            " FROM (SELECT DISTINCT label FROM obj)) || '}' FROM q"}
    value = {"find_nearest": "n.keyword", "distance_to": "m.name", "navigate_to_object": "l.object_label", "query_object": "l.object_label"}
    args = "CASE t.tool " + " ".join(f"WHEN '{t}' THEN {obj(**{a: quoted(value.get(t, 'n.zone_name'))})}"
                                     for t, a in TOOL_ARGUMENTS.items() if a is not None) + " ELSE '{}' END"
    lot = "n.request_id % 400"
    tools = "[" + ", ".join(f"'{t}'" for t in TOOL_ARGUMENTS) + "]"
    asked = (f"asked AS MATERIALIZED (SELECT n.*, l.object_label, l.label_key, t.tool, {args} AS args FROM named n JOIN labelreq l USING (request_id) "
             f"JOIN mixed m USING (request_id) JOIN (SELECT request_id, list_extract({tools}, (CASE WHEN {lot} = 0 THEN 12 WHEN {lot} = 1 THEN 13 "
             f"WHEN {lot} < 10 THEN 11 ELSE {lot} % 11 END + 1)::INT) AS tool FROM named n) t USING (request_id))")
    every = " UNION ALL ".join(f"SELECT * FROM (WITH q AS (SELECT * FROM asked WHERE tool = '{t}') {sql})" for t, sql in answers.items())
    return query("SELECT request_id, tool, result AS result_json, '[tool] ' || tool || '(' || args || ') -> ' || substr(result, 1, 300) AS line "
                 f"FROM asked JOIN ({every}) USING (request_id)", "named", "labelreq", "mixed", "best", "posezone", "near3", "met", "passed", "deepest",
                 "obj", "goals", "hier", extra=asked)


def query(body: str, *ctes: str, extra: str = "") -> str:
    """The body over the named common tables, then over ``extra`` ones of its own."""
    if not ctes:
        return body
    parts = ", ".join(f"{n} AS {'' if n == 'climb' else 'MATERIALIZED '}({_CTES[n][1]})"
                      for n in _closure(ctes))
    return f"WITH RECURSIVE {parts}{',' if extra else ''} {extra} {body}"


def _scored() -> str:
    quote = lambda l: f"('[' || array_to_string(list_transform({l}, lambda n: '''' || n || ''''), ', ') || ']')"
    return f"""
    SELECT case_id, category, len(issues) = 0 AS passed, len(issues)::BIGINT AS num_issues,
           array_to_string(issues, ' | ') AS issues FROM (
      SELECT case_id, 'Cat' || (case_id % 7) AS category, list_concat(list_concat(list_concat(
        CASE WHEN case_id % 4 = 0 AND list_contains(called, 'navigate_to_zone')
             THEN ['Called rejected tool: navigate_to_zone'] ELSE [] END,
        CASE WHEN case_id % 3 = 2 THEN []
             WHEN case_id % 3 = 0 AND len(called) = 0 THEN []
             WHEN list_has_any(expected, called) THEN []
             ELSE ['Expected one of ' || {quote('expected')} || ', got ' || {quote('called')}] END),
        CASE WHEN case_id % 2 = 0 AND len(called) > 0 AND NOT contains(lower(coalesce(arg, '')), want)
             THEN ['Arg object_type=' || coalesce('''' || arg || '''', 'None') || ', expected ''' || want || ''''] ELSE [] END),
        list_concat(
        CASE WHEN NOT contains(lower(final_text), 'the') THEN ['Response missing all of: [''the'']'] ELSE [] END,
        CASE WHEN contains(lower(final_text), '***') THEN ['Response contains forbidden: ''***'''] ELSE [] END)) AS issues
      FROM (SELECT *, {keyword('(case_id + case_id % 4)')} AS want,
              coalesce(list_extract(list_filter(calls, lambda c: list_contains(expected, c.n)), 1).a,
                       list_extract(calls, 1).a) AS arg
            FROM (SELECT *, CASE case_id % 3 WHEN 0 THEN ['list_zones']
                    WHEN 1 THEN ['find_nearest', 'describe_surroundings'] ELSE []::VARCHAR[] END AS expected
                  FROM transcripts)))"""


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    code = case("event_type", STATUS_OF_EVENT)
    tag = case("event_type", TAG_OF_EVENT)

    ax, ay = affine("x", "y", *ALIGN)
    s["project_align"] = query(
        f"SELECT id, {rnd('a', 3)} AS map_x, {rnd('b', 3)} AS map_y FROM (SELECT id, {ax} AS a, {ay} AS b FROM allobj)", "allobj")
    corners = lambda src: " UNION ALL ".join(
        f"SELECT zord, {i - 1}::BIGINT AS i, x{i} AS x, y{i} AS y FROM {src}" for i in (1, 2, 3, 4))
    ix, iy = inverse("x", "y", *ALIGN[:3], 2.0)
    s["inverse_align"] = query(
        f"SELECT zord, i, {rnd('a', 3)} AS x, {rnd('b', 3)} AS y FROM (SELECT zord, i, {ix} AS a, {iy} AS b FROM ({corners('corners')}))", "corners")
    s["quaternions"] = query(
        f"SELECT request_id, {rnd('z', 6)} AS qz, {rnd('w', 6)} AS qw, {rnd('c', 6)} AS cos_yaw, {rnd('n', 6)} AS sin_yaw FROM ("
        f"SELECT *, cos(b) AS c, sin(b) AS n FROM (SELECT *, atan2(2*w*z, 1-2*z*z) AS b FROM ("
        f"SELECT request_id, sin(yaw/2) AS z, cos(yaw/2) AS w FROM poses)))", "poses")
    s["pose_directions"] = query(
        f"SELECT request_id, {rnd('d', 2)} AS distance, {rnd('b', 1)} AS bearing_deg, {sector('g')} AS spoken, "
        f"{sector('g', COMPACT)} AS compact, CASE WHEN d/10 < 1 THEN 'right here' WHEN d/10 < 3 THEN 'nearby' "
        f"WHEN d/10 < 6 THEN 'a short walk' ELSE 'a bit further away' END AS band FROM (SELECT request_id, "
        f"{dist('x', 'y', '250e0', '50e0')} AS d, atan2(50e0-y, 250e0-x)*{TO_DEG} AS b, "
        f"{rel_deg('yaw', 'x', 'y', '250e0', '50e0')} AS g FROM poses)", "poses")
    message = (f"'Rotating to face ' || {{n}} || ' (' || {rnd('abs(g)', 1)}::VARCHAR || ' degrees ' || "
               f"CASE WHEN g > 0 THEN 'left' ELSE 'right' END || ')'")
    s["turns_to_point"] = query(
        f"SELECT request_id, {rnd('g', 1)} AS turn_degrees, {message.format(n=chr(39) + 'centre' + chr(39))} AS message FROM ("
        f"SELECT request_id, {rel_deg('yaw', 'x', 'y', '250e0', '50e0')} AS g FROM poses)", "poses")
    s["polygon_facts"] = query(
        f"SELECT zord, name, {rnd('area', 3)} AS area, {rnd('cx', 3)} AS cx, {rnd('cy', 3)} AS cy, 4::BIGINT AS num_edges FROM zones", "zones")
    chan = lambda *v: ("greatest(30, least(255, floor((CASE i " + " ".join(
        f"WHEN {n} THEN {x}" for n, x in enumerate(v)) + " END)*255e0)))::BIGINT")
    s["label_colors"] = (
        "SELECT label, " + chan("v", "q", "p", "p", "t", "v") + " AS r, " + chan("t", "v", "v", "q", "p", "p") + " AS g, "
        + chan("p", "p", "t", "v", "v", "q") + " AS b FROM (SELECT label, v, (floor(hue*6)%6)::INT AS i, v*(1-sat) AS p, "
        "v*(1-sat*(hue*6-floor(hue*6))) AS q, v*(1-sat*(1-(hue*6-floor(hue*6)))) AS t FROM (SELECT label, "
        "((h*137.508e0)%360e0)/360e0 AS hue, (h%4)*0.075e0+0.7e0 AS sat, (h%3)*0.067e0+0.8e0 AS v FROM ("
        "SELECT DISTINCT p_name AS label, ('0x' || substr(md5(p_name), 1, 6))::BIGINT::DOUBLE AS h FROM part)))")
    s["name_keys"] = "SELECT p_partkey AS id, lower(p_name) AS name_key FROM part"
    dest = "('room ' || (event_id % 7))"
    s["status_texts"] = (
        f"SELECT event_id AS seq, {case('c', STATUS_NAMES['cloud'])} AS cloud_status, {case('c', STATUS_NAMES['local'])} AS local_status, "
        f"CASE c WHEN 4 THEN 'Arrived at ' || {dest} WHEN 2 THEN 'Currently navigating to ' || {dest} "
        f"WHEN 6 THEN 'Navigation to ' || {dest} || ' failed — path may be blocked' WHEN 5 THEN 'Navigation was canceled' "
        f"ELSE 'Status: accepted' END AS message FROM (SELECT event_id, {code} AS c FROM events)")
    in_list = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
    s["log_tags"] = (
        f"SELECT event_id AS seq, CASE WHEN t IN {in_list(PREFIX_TAGS)} THEN t END AS prefix_tag, "
        f"CASE WHEN t IN {in_list(CONTAINED_TAGS)} THEN t END AS contained_tag FROM (SELECT event_id, {tag} AS t FROM events)")
    s["text_previews"] = ("SELECT conv_id AS case_id, turn, substr(replace(text, chr(10), ' '), 1, 150) AS preview FROM conversations")
    s["rounding_modes"] = (
        f"SELECT l_returnflag, count(*) AS n, sum(floor({rnd('v', 2)}*100e0+0.5e0))::BIGINT AS cents, "
        f"sum(floor({rnd('v', 1)}*10e0+0.5e0))::BIGINT AS dimes FROM (SELECT l_returnflag, l_extendedprice*l_discount AS v FROM lineitem) GROUP BY 1")

    s["filtered_objects"] = query(
        "SELECT id, label, confidence, num_points FROM obj WHERE lower(label) NOT IN ('small ring', 'red widget')", "obj")
    s["filtered_by_table"] = query(
        "SELECT id, label FROM allobj WHERE confidence >= 5e-1 AND num_points >= 100 AND lower(label) NOT IN ("
        "SELECT lower(p_name) FROM part WHERE p_size = 50)", "allobj")
    s["lookup_answers"] = query(
        "SELECT request_id, label_key, n IS NOT NULL AS found, coalesce(n, 0) AS count FROM labelreq LEFT JOIN ("
        "SELECT lower(label) AS k, count(*) AS n FROM obj GROUP BY 1) ON k = label_key", "labelreq", "obj")
    s["lookup_matches"] = query(
        "SELECT lower(label) AS label_key, id, confidence FROM obj WHERE lower(label) IN (SELECT label_key FROM labelreq)",
        "labelreq", "obj")
    s["substring_matches"] = query(
        "SELECT keyword, label FROM (SELECT DISTINCT keyword FROM poses UNION SELECT DISTINCT substr(keyword, 1, 2) FROM poses) "
        "JOIN (SELECT DISTINCT lower(label) AS label FROM allobj) ON contains(label, keyword)", "poses", "allobj")
    s["destination_misses"] = query(
        "SELECT request_id, 'Destination ''' || name || ''' not found.' AS error, "
        "'Use list_zones or list_objects to see available names.' AS hint FROM ("
        "SELECT request_id, CASE WHEN request_id % 2 = 0 THEN zone_name ELSE keyword END AS name FROM named) "
        "WHERE lower(name) NOT IN (SELECT key FROM catalogue)", "named", "catalogue")

    s["points_in_zones"] = query("SELECT id, zord AS zone_ord, name AS zone_name FROM inzone", "inzone")
    s["poses_in_zones"] = query(
        f"SELECT p.request_id, z.zord AS zone_ord, z.name AS zone_name FROM poses p JOIN zones z ON {pip('p.x', 'p.y', 'z.edges')}",
        "poses", "zones")
    s["objects_deepest_zone"] = query(
        "SELECT o.id, zone, parent_zone, full_path FROM allobj o LEFT JOIN deepest d ON d.id = o.id", "deepest")
    s["poses_first_zone"] = query(
        "SELECT p.request_id, current_zone AS zone FROM poses p LEFT JOIN posezone z ON z.request_id = p.request_id", "posezone")
    s["zone_parents"] = query("SELECT zord, name, parent FROM parents", "parents")
    s["zone_hierarchy"] = query("SELECT zord, name, parent, depth, full_path FROM hier", "hier")
    s["zone_ancestors"] = query(
        "SELECT h.zord, g.h AS hop, list_extract(string_split(full_path, ' > '), (depth + 1 - g.h)::INT) AS ancestor "
        "FROM hier h JOIN range(1, 200) g(h) ON g.h <= h.depth", "hier")
    s["zone_children"] = query(
        "SELECT p.zord, p.name, c.zord AS child_ord, c.name AS child FROM hier p JOIN hier c ON c.parent = p.name", "hier")
    counts = ("SELECT z.zord, count(i.id) AS num_objects, count(CASE WHEN d.zone = z.name THEN 1 END) AS num_direct_objects "
              "FROM hier z LEFT JOIN inzone i ON i.zord = z.zord {f} LEFT JOIN deepest d ON d.id = i.id GROUP BY 1")
    only = "AND i.id IN (SELECT id FROM obj)"
    s["zone_counts"] = query(counts.format(f=""), "deepest")
    contents = ("SELECT i.zord AS zone_ord, o.id, o.label, d.zone = i.name AS direct, d.full_path "
                "FROM inzone i JOIN obj o ON o.id = i.id JOIN deepest d ON d.id = i.id")
    s["zone_contents"] = query(contents, "deepest", "obj")
    s["zone_names_sorted"] = query("SELECT name FROM zones ORDER BY name", "zones")
    seg = ("SELECT zord, x1 AS xa, y1 AS ya, x2 AS xb, y2 AS yb FROM zones UNION ALL SELECT zord, x2, y2, x3, y3 FROM zones "
           "UNION ALL SELECT zord, x3, y3, x4, y4 FROM zones UNION ALL SELECT zord, x4, y4, x1, y1 FROM zones")

    def pseg(px, py, e):
        dx, dy = f"({e}.xb-{e}.xa)", f"({e}.yb-{e}.ya)"
        t = f"greatest(0e0, least(1e0, (({px}-{e}.xa)*{dx}+({py}-{e}.ya)*{dy})/({dx}*{dx}+{dy}*{dy})))"
        return dist(px, py, f"({e}.xa+{t}*{dx})", f"({e}.ya+{t}*{dy})")
    den = "((e.xb-e.xa)*(f.yb-f.ya)-(e.yb-e.ya)*(f.xb-f.xa))"
    tt = f"(((f.xa-e.xa)*(f.yb-f.ya)-(f.ya-e.ya)*(f.xb-f.xa))/{den})"
    uu = f"(((f.xa-e.xa)*(e.yb-e.ya)-(f.ya-e.ya)*(e.xb-e.xa))/{den})"
    adjacent = lambda gap: (
        f"SELECT DISTINCT e.zord AS a, f.zord AS b FROM ({seg}) e JOIN ({seg}) f ON e.zord < f.zord AND ("
        f"CASE WHEN abs({den}) < 1e-12 THEN false ELSE {tt} BETWEEN 0 AND 1 AND {uu} BETWEEN 0 AND 1 END "
        f"OR {pseg('e.xa', 'e.ya', 'f')} <= {gap} OR {pseg('f.xa', 'f.ya', 'e')} <= {gap})")
    s["zone_adjacency"] = query(adjacent(1), "zones")
    # distances by rounds from every target, then a walk that always takes the lowest neighbour that is nearer
    s["planned_journeys"] = query(
        """SELECT journey_id, stop_no, coalesce(hop, 0) AS hop, zone, hop = d AS is_stop,
                  CASE WHEN hop IS NULL THEN 'No route to ''' || stop || '''' END AS error
           FROM (SELECT l.*, w.hop, w.zone, r.d FROM legs l LEFT JOIN reach r ON r.root = l.target AND r.node = l.source
                 LEFT JOIN (SELECT s, t, hop, z.name AS zone FROM walk JOIN zones z ON z.zord = walk.node) w
                 ON w.s = l.source AND w.t = l.target AND (w.hop > 0 OR r.d = 0))""", "zones", extra=f"""
        pairs_of AS MATERIALIZED ({adjacent(3)}),
        adj AS MATERIALIZED (SELECT a AS node, b AS next FROM pairs_of UNION ALL SELECT b, a FROM pairs_of),
        placed AS (SELECT zord, name, row_number() OVER (ORDER BY zord) - 1 AS place, count(*) OVER () AS places FROM zones),
        legs AS MATERIALIZED (SELECT event_id AS journey_id, k AS stop_no, s.zord AS source, t.zord AS target, t.name AS stop
             FROM events, (VALUES (1, 1, 3), (2, 3, 7)) v(k, f, g), placed s, placed t
             WHERE s.place = (event_id * f) % s.places AND t.place = (event_id * g) % t.places),
        seen(root, node, d) USING KEY (root, node) AS (SELECT DISTINCT target, target, 0 FROM legs
             UNION SELECT DISTINCT s.root, adj.next, s.d + 1 FROM seen s JOIN adj ON adj.node = s.node
                   WHERE NOT EXISTS (SELECT 1 FROM recurring.seen r WHERE r.root = s.root AND r.node = adj.next)),
        reach AS MATERIALIZED (SELECT root, node, d FROM seen),
        pairs AS (SELECT DISTINCT source, target FROM legs),
        walk AS (SELECT source AS s, target AS t, 0 AS hop, source AS node, d AS rest FROM pairs JOIN reach ON root = target AND node = source
             UNION ALL SELECT s, t, any_value(hop) + 1, min(adj.next), any_value(rest) - 1 FROM walk JOIN adj ON adj.node = walk.node
                  JOIN reach ON reach.root = walk.t AND reach.node = adj.next AND reach.d = walk.rest - 1 WHERE rest > 0 GROUP BY s, t)""")

    s["distinct_labels"] = query("SELECT DISTINCT lower(label) AS label FROM obj", "obj")
    s["label_index"] = query(
        "SELECT lower(label) AS label_key, count(*) AS occurrences, min(ord) AS first_ord, min(id) AS first_id FROM obj GROUP BY 1", "obj")
    s["scene_summary"] = query(
        "SELECT 0::BIGINT AS scene_id, (SELECT count(*) FROM obj) AS num_objects, (SELECT count(DISTINCT label) FROM obj) AS num_labels, "
        "(SELECT count(*) FROM zones) AS num_zones, true AS ready", "obj", "zones")
    s["scene_extent"] = query(
        f"SELECT 0::BIGINT AS scene_id, min(x)-1.5e0 AS min_x, min(y)-1.5e0 AS min_y, max(x)+1.5e0 AS max_x, max(y)+1.5e0 AS max_y "
        f"FROM (SELECT x, y FROM ({corners('zones')}) UNION ALL SELECT x, y FROM obj)", "obj", "zones")

    within = (f"SELECT p.request_id, o.id AS obj_id, {rnd('d', 2)} AS distance FROM (SELECT p.request_id, o.id, "
              f"{dist('p.x', 'p.y', 'o.x', 'o.y')} AS d FROM poses p JOIN obj o ON {dist('p.x', 'p.y', 'o.x', 'o.y')} <= {{r}})")
    within = within.replace("SELECT p.request_id, o.id AS obj_id, ", "SELECT request_id, id AS obj_id, ", 1)
    s["objects_within"] = query(within.format(r="3"), "poses", "obj")
    s["objects_within_own_radius"] = query(within.format(r="(p.request_id % 5) + 0.5e0"), "poses", "obj")
    s["nearby_ranked"] = query(
        f"SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY distance, obj_id) AS rank, obj_id, distance, direction FROM ("
        f"SELECT request_id, obj_id, {rnd('d', 2)} AS distance, {sector('g')} AS direction FROM (SELECT p.request_id, o.id AS obj_id, "
        f"{dist('p.x', 'p.y', 'o.x', 'o.y')} AS d, {rel_deg('p.yaw', 'p.x', 'p.y', 'o.x', 'o.y')} AS g "
        f"FROM poses p JOIN obj o ON {dist('p.x', 'p.y', 'o.x', 'o.y')} <= 5))", "poses", "obj")
    s["nearest_object"] = query(
        f"SELECT request_id, keyword, ord AS obj_ord, label AS obj_label, {rnd('d', 2)} AS distance FROM poses p LEFT JOIN best b USING (request_id, keyword)", "best")
    s["resolved_destinations"] = query(
        f"SELECT request_id, destination, kind, {rnd('tx', 3)} AS x, {rnd('ty', 3)} AS y FROM mixed", "mixed")
    s["route_objects"] = query(
        "SELECT request_id, ord AS obj_ord, label AS obj_label, along AS distance_along_path_m, side AS side_offset_m FROM passed", "passed")
    s["route_objects_ranked"] = query(
        "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY along, ord) AS rank, ord AS obj_ord, "
        "along AS distance_along_path_m FROM passed", "passed")
    s["route_zones"] = query("SELECT request_id, zord AS zone_ord, name AS zone_name FROM met", "met")
    s["pose_as_of"] = query(
        f"SELECT l.request_id, p.x, p.y, {rnd('p.yaw', 6)} AS yaw FROM late l ASOF LEFT JOIN poses p ON l.robot_id = p.robot_id AND l.ts >= p.ts",
        "late", "poses")
    s["matched_responses"] = query(
        "SELECT request_id, result, CASE WHEN result IS NULL THEN 'Timeout waiting for zone query result for ''' || request_id || '''' END AS error FROM ("
        "SELECT a.request_id, CASE WHEN r.ts <= a.ts + INTERVAL 3 HOUR THEN r.props END AS result FROM "
        "(SELECT * FROM poses WHERE event_type IN ('signup', 'click')) a ASOF LEFT JOIN "
        "(SELECT * FROM poses WHERE event_type NOT IN ('signup', 'click')) r ON a.robot_id = r.robot_id AND a.ts <= r.ts)", "poses")
    s["arrivals_detected"] = query(
        f"SELECT robot_id, destination, min(epoch_us(ts)) AS arrived_us FROM (SELECT p.robot_id, p.ts, p.x, p.y, g.gx, g.gy, g.destination "
        f"FROM poses p ASOF JOIN (SELECT robot_id, ts - INTERVAL 2 HOUR AS gts, x AS gx, y AS gy, 'goal ' || request_id AS destination FROM poses) g "
        f"ON p.robot_id = g.robot_id AND p.ts >= g.gts) WHERE {dist('x', 'y', 'gx', 'gy')} < 60 GROUP BY 1, 2", "poses")

    rx, ry = inverse("x", "y", *ALIGN)
    nx, ny = affine("a", "b", *ESTIMATE, 1.0)
    s["realigned_zones"] = query(
        f"SELECT zord, i, {rnd('c', 3)} AS x, {rnd('d', 3)} AS y FROM (SELECT zord, i, {nx} AS c, {ny} AS d FROM ("
        f"SELECT zord, i, {rx} AS a, {ry} AS b FROM ({corners('corners')})))", "corners")
    ox, oy = affine("x", "y", *ESTIMATE, 1.0)
    s["realigned_objects"] = query(
        f"SELECT id, {rnd('a', 3)} AS map_x, {rnd('b', 3)} AS map_y FROM (SELECT id, {ox} AS a, {oy} AS b FROM allobj)", "allobj")
    s["objects_snapshot"] = query(
        "SELECT o.ord, o.id, o.label, o.confidence, o.x, o.y, d.zone, d.full_path, d.zone IS NULL AS null_written "
        "FROM obj o LEFT JOIN deepest d ON d.id = o.id", "deepest", "obj")
    corners = " || ';' || ".join(f"(x{i}*100)::BIGINT || ',' || (y{i}*100)::BIGINT" for i in (1, 2, 3, 4))
    report = (f"SELECT z.zord, z.name, z.full_path AS display_name, z.parent, z.depth, c.num_objects, c.num_direct_objects, "
              f"coalesce((SELECT string_agg(k.name, '|' ORDER BY k.zord) FROM hier k WHERE k.parent = z.name), '') AS children, "
              f"{corners} AS corners FROM hier z JOIN ({counts.format(f=only)}) c USING (zord)")
    s["zones_snapshot"] = query(report, "deepest", "obj")
    colors = s["label_colors"].replace("FROM part", "FROM (SELECT label AS p_name FROM obj)")
    zcolors = s["label_colors"].replace("FROM part", "FROM (SELECT name AS p_name FROM zones)")
    s["map_features"] = query(
        f"SELECT 'centroids' AS ns, 2*id AS feature_id, {rnd('x', 3)} AS x, {rnd('y', 3)} AS y, 3e-1 AS z, 4e-1 AS size, r, 8e-1 AS alpha, "
        f"NULL AS text, NULL::BIGINT AS ring_points FROM obj JOIN ({colors}) USING (label) "
        f"UNION ALL SELECT 'labels', 2*id+1, {rnd('x', 3)}, {rnd('y', 3)}, 6e-1, 3e-1, 255, 1e0, label, NULL FROM obj "
        f"UNION ALL SELECT 'all_zone_polygons', 2*zord, NULL, NULL, {rnd('(depth*0.05e0+0.05e0)', 3)}, CASE WHEN depth > 0 THEN 3e-2 ELSE 5e-2 END, r, 9e-1, NULL, 5 "
        f"FROM hier z JOIN ({zcolors}) c ON c.label = z.name "
        f"UNION ALL SELECT 'all_zone_labels', 2*zord+1, {rnd('cx', 3)}, {rnd('cy', 3)}, {rnd('(depth*0.15e0+0.5e0)', 3)}, "
        f"{rnd('greatest(0.2e0, 0.4e0-depth*0.05e0)', 3)}, 0, 1e0, full_path, NULL FROM hier", "hier", "obj")
    s["parsed_payloads"] = query(
        "SELECT id AS message_id, label, x, y, NULL::VARCHAR AS error FROM allobj WHERE id % 10 <> 3 "
        "UNION ALL SELECT id, NULL, NULL, NULL, '[error] Failed to parse objects JSON: {not json' FROM allobj WHERE id % 10 = 3", "allobj")
    s["saved_alignments"] = query(
        f"SELECT robot_id AS scene_id, {rnd('(x/7)', 4)} AS translate_x, {rnd('(y/7)', 4)} AS translate_y, "
        f"{rnd(f'(yaw*{TO_DEG})', 2)} AS rotate_deg, 1e0 AS scale FROM (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY ts DESC) AS rn FROM poses) WHERE rn = 1", "poses")

    pose = f"{rnd('x', 3)} AS x, {rnd('y', 3)} AS y, {rnd(f'(yaw*{TO_DEG})', 1)} AS yaw_deg"
    s["robot_pose"] = query(
        f"SELECT p.request_id, {pose}, 'map' AS frame, current_zone, NULL::VARCHAR AS error "
        f"FROM poses p LEFT JOIN posezone z ON z.request_id = p.request_id", "posezone")
    s["live_pose_zone"] = query(
        f"SELECT robot_id, {pose}, current_zone FROM (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY ts DESC) AS rn FROM poses) p "
        f"LEFT JOIN posezone z ON z.request_id = p.request_id WHERE rn = 1", "posezone")
    s["describe_surroundings"] = query(
        f"SELECT p.request_id, z.current_zone, n.ord AS obj_ord, n.label, {rnd('n.d', 2)} AS distance, {sector('n.g')} AS direction "
        f"FROM poses p LEFT JOIN posezone z ON z.request_id = p.request_id LEFT JOIN (SELECT *, {rel_deg('yaw', 'x', 'y', 'ox', 'oy')} AS g FROM near3) n "
        f"ON n.request_id = p.request_id", "posezone", "near3")
    s["surroundings_counts"] = query(
        "SELECT p.request_id, coalesce(n, 0) AS count, z.current_zone FROM poses p LEFT JOIN posezone z ON z.request_id = p.request_id "
        "LEFT JOIN (SELECT request_id, count(*) AS n FROM near3 GROUP BY 1) k ON k.request_id = p.request_id", "posezone", "near3")
    objfirst = (f"SELECT id, name AS zone FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY zord) AS rn FROM inzone) WHERE rn = 1")
    s["find_nearest"] = query(
        f"SELECT request_id, label, {rnd('d', 2)} AS distance_m, {sector('g')} AS direction, zone, NULL::VARCHAR AS error FROM ("
        f"SELECT b.*, {rel_deg('yaw', 'x', 'y', 'ox', 'oy')} AS g FROM best b) LEFT JOIN ({objfirst}) ON id = ord", "best", "inzone")
    s["distance_to"] = query(
        f"SELECT request_id, destination, kind AS destination_type, {rnd('d', 2)} AS distance_m, {sector('g')} AS direction, "
        f"CASE WHEN destination IS NULL THEN 'Destination ''' || name || ''' not found.' END AS error, "
        f"CASE WHEN destination IS NULL THEN 'Use list_zones or list_objects to see available names.' END AS hint FROM ("
        f"SELECT *, {dist('x', 'y', 'tx', 'ty')} AS d, {rel_deg('yaw', 'x', 'y', 'tx', 'ty')} AS g FROM mixed)", "mixed")
    s["describe_route"] = query(
        "SELECT request_id, 'zone' AS kind, zord AS ord, name, NULL::DOUBLE AS distance_along_path_m, NULL::DOUBLE AS side_offset_m FROM met "
        "UNION ALL SELECT request_id, 'object', ord, label, along, side FROM passed", "met", "passed")
    s["route_summaries"] = query(
        f"SELECT request_id, destination, {rnd('d', 2)} AS total_distance_m, {sector('g')} AS direction FROM (SELECT request_id, zone_name AS destination, "
        f"{dist('x', 'y', 'tx', 'ty')} AS d, {rel_deg('yaw', 'x', 'y', 'tx', 'ty')} AS g FROM named)", "named")
    s["orient"] = query(
        f"SELECT request_id, zone_name AS target, {sector('g')} AS direction_from_current, {rnd('g', 1)} AS turn_degrees, "
        f"{message.format(n='zone_name')} AS message, 'orient:' || zone_name AS goal_destination FROM ("
        f"SELECT *, {rel_deg('yaw', 'x', 'y', 'tx', 'ty')} AS g FROM named)", "named")
    s["goals_for_zones"] = query(
        f"SELECT request_id, zone_name AS zone, {rnd('tx', 3)} AS goal_x, {rnd('ty', 3)} AS goal_y, {rnd('b', 6)} AS goal_yaw, "
        f"{rnd('sin(b/2)', 6)} AS goal_qz, {rnd('cos(b/2)', 6)} AS goal_qw FROM (SELECT *, atan2(ty-y, tx-x) AS b FROM named)", "named")
    s["goals_for_objects"] = query(
        f"SELECT m.request_id, o.label IS NOT NULL AS success, o.label AS object, {rnd('o.x', 3)} AS goal_x, {rnd('o.y', 3)} AS goal_y, "
        f"CASE WHEN o.label IS NOT NULL THEN 0e0 END AS goal_yaw, CASE WHEN o.label IS NULL THEN 'Object ''' || m.name || ''' not found.' END AS error, "
        f"CASE WHEN o.label IS NULL THEN 'Use list_objects to see available object labels.' END AS hint FROM mixed m LEFT JOIN ("
        f"SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY ord) AS rn FROM obj) o ON rn = 1 AND lower(o.label) = lower(trim(m.name))", "mixed")
    s["list_zones"] = query(
        "SELECT z.zord, z.name, z.full_path AS display_name, z.parent, c.zord AS child_ord, c.name AS child FROM hier z LEFT JOIN hier c ON c.parent = z.name", "hier")
    s["list_objects"] = query("SELECT DISTINCT label FROM obj", "obj")
    s["query_zone"] = query(
        f"SELECT n.request_id, true AS found, r.name AS zone, r.display_name, r.parent, r.depth, r.num_objects, r.num_direct_objects, r.children, r.corners "
        f"FROM named n JOIN ({report}) r ON r.name = n.zone_name", "deepest", "obj", "named")
    s["query_zone_contents"] = query(
        "SELECT i.zord AS zone_ord, o.id, o.label, o.x, o.y, d.full_path, d.zone = i.name AS direct "
        "FROM inzone i JOIN obj o ON o.id = i.id JOIN deepest d ON d.id = i.id WHERE i.zord IN (SELECT zone_zord FROM named)", "deepest", "obj", "named")
    s["query_object"] = query(
        "SELECT request_id, n IS NOT NULL AS found, coalesce(n, 0) AS count FROM labelreq LEFT JOIN (SELECT lower(label) AS k, count(*) AS n "
        "FROM obj GROUP BY 1) ON k = label_key", "labelreq", "obj")
    s["query_object_matches"] = query(
        "SELECT lower(o.label) AS label_key, o.id, o.x, o.y, o.confidence, d.zone, d.parent_zone, d.full_path FROM obj o "
        "LEFT JOIN deepest d ON d.id = o.id WHERE lower(o.label) IN (SELECT label_key FROM labelreq)", "labelreq", "deepest", "obj")
    s["zones_report"] = query(report, "deepest", "obj")
    status = (f"SELECT robot_id, ts, seq, code FROM (SELECT user_id AS robot_id, ts, event_id AS seq, {code} AS code FROM events "
              f"UNION ALL SELECT robot_id, ts, -1, 2 FROM goals)")
    s["navigation_status"] = query(
        f"SELECT request_id, coalesce({case('code', STATUS_NAMES['cloud'])}, 'idle') AS status, CASE WHEN code IS NOT NULL THEN destination END AS destination, "
        f"CASE WHEN code IS NULL THEN 'No navigation goal active' WHEN code = 4 THEN 'Arrived at ' || dd WHEN code = 2 THEN 'Currently navigating to ' || dd "
        f"WHEN code = 6 THEN 'Navigation to ' || dd || ' failed — path may be blocked' WHEN code = 5 THEN 'Navigation was canceled' "
        f"ELSE 'Status: accepted' END AS message FROM (SELECT a.request_id, a.code, g.destination, coalesce(g.destination, 'None') AS dd FROM ("
        f"SELECT l.*, s.code FROM late l ASOF LEFT JOIN ({status}) s ON l.robot_id = s.robot_id AND l.ts >= s.ts) a "
        f"ASOF LEFT JOIN goals g ON a.robot_id = g.robot_id AND a.ts >= g.ts)", "late", "goals")
    for dialect, key in (("cloud", "whole_answers"), ("local", "whole_answers_local")):
        s[key] = whole_answers(dialect, message, status, counts.format(f=only))
    s["latest_status"] = (
        f"SELECT robot_id, status_code FROM (SELECT user_id AS robot_id, {code}::INT AS status_code, "
        f"row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
    s["cancellations"] = (
        "SELECT event_id AS request_id, user_id AS robot_id, 5 AS status_code, true AS success, 'Navigation cancelled' AS message "
        "FROM events WHERE event_type = 'signup'")
    line = f"'[' || {tag} || '] ' || props"
    s["last_log_lines"] = (
        f"SELECT robot_id, seq, text FROM (SELECT user_id AS robot_id, event_id AS seq, {line} AS text, "
        f"row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50")
    s["log_counts"] = f"SELECT user_id AS robot_id, {tag} AS tag, count(*) AS lines FROM events GROUP BY 1, 2"
    s["utterances"] = (
        "SELECT conv_id, turn, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS text FROM conversations WHERE role = 'user' AND turn % 3 <> 1 "
        "AND trim(text, chr(9) || chr(10) || chr(13) || ' ') <> ''")
    ok = "request_id % 11 <> 0"
    s["request_arguments"] = query(
        f"SELECT request_id, CASE WHEN {ok} AND event_type = 'click' THEN keyword END AS object_type, "
        f"CASE WHEN {ok} AND event_type IN ('error', 'purchase') THEN zone_name END AS destination, "
        f"CASE WHEN {ok} AND event_type = 'signup' THEN zone_name END AS zone_name, "
        f"CASE WHEN {ok} AND event_type <> 'view' THEN 1 ELSE 0 END::BIGINT AS num_args FROM named", "named")
    tools = case("event_type", TOOL_OF_EVENT)
    need = ("CASE event_type WHEN 'click' THEN '''object_type''' WHEN 'error' THEN '''destination''' "
            "WHEN 'purchase' THEN '''destination''' WHEN 'signup' THEN '''zone_name''' END")
    flown, broke = "n.request_id % 97 = 5", "n.request_id % 50 = 7"
    good = f"NOT ({flown}) AND NOT ({broke} AND event_type <> 'view')"
    s["answered_requests"] = query(
        f"SELECT n.request_id, CASE WHEN {flown} THEN 'fly' ELSE {tools} END AS tool, "
        f"CASE WHEN {flown} THEN 'Unknown tool: fly' WHEN {broke} THEN {need} END AS error, "
        f"CASE WHEN {good} AND event_type = 'click' THEN b.label END AS label, "
        f"CASE WHEN {good} AND event_type IN ('error', 'purchase') THEN zone_name END AS destination, "
        f"CASE WHEN NOT ({good}) THEN NULL WHEN event_type = 'click' THEN {sector('b.g')} WHEN event_type IN ('error', 'purchase') THEN {sector('n.g')} END AS direction, "
        f"CASE WHEN {good} AND event_type = 'view' THEN z.current_zone END AS current_zone, "
        f"CASE WHEN {good} AND event_type = 'signup' THEN zone_name END AS zone, "
        f"CASE WHEN {good} AND event_type = 'view' THEN coalesce(k.n, 0) END AS count "
        f"FROM (SELECT *, {rel_deg('yaw', 'x', 'y', 'tx', 'ty')} AS g FROM named) n "
        f"LEFT JOIN (SELECT *, {rel_deg('yaw', 'x', 'y', 'ox', 'oy')} AS g FROM best) b ON b.request_id = n.request_id "
        f"LEFT JOIN posezone z ON z.request_id = n.request_id "
        f"LEFT JOIN (SELECT request_id, count(*) AS n FROM near3 GROUP BY 1) k ON k.request_id = n.request_id",
        "named", "best", "posezone", "near3")
    asked = f"SELECT * FROM named n WHERE {good}"
    own = lambda t, kind: f"JOIN ({asked}) n ON n.request_id = t.request_id AND n.event_type = '{kind}'"
    zone_items = (f"SELECT i.zord, d.zone = i.name AS direct FROM inzone i JOIN obj o ON o.id = i.id JOIN deepest d ON d.id = i.id "
                  f"WHERE i.zord IN (SELECT zone_zord FROM ({asked}) WHERE event_type = 'signup')")
    s["answer_items"] = query(
        f"SELECT 'nearby_objects' AS section, count(*) AS items, count(DISTINCT t.request_id) AS answers FROM near3 t {own('t', 'view')} "
        f"UNION ALL SELECT 'zones_along_path', count(*), count(DISTINCT t.request_id) FROM met t {own('t', 'purchase')} "
        f"UNION ALL SELECT 'objects_along_path', count(*), count(DISTINCT t.request_id) FROM passed t {own('t', 'purchase')} "
        f"UNION ALL SELECT 'objects', count(*), count(DISTINCT zord) FROM ({zone_items}) "
        f"UNION ALL SELECT 'direct_objects', count(*), count(DISTINCT zord) FROM ({zone_items}) WHERE direct",
        "near3", "met", "passed", "named", "deepest", "obj")
    per = lambda src: f"(SELECT request_id, count(*) AS n FROM {src} GROUP BY 1)"
    s["answer_documents"] = query(
        f"SELECT n.request_id, CASE WHEN {good} AND event_type = 'view' THEN coalesce(a.n, 0) END AS nearby, "
        f"CASE WHEN {good} AND event_type = 'purchase' THEN coalesce(b.n, 0) END AS zones, "
        f"CASE WHEN {good} AND event_type = 'purchase' THEN coalesce(c.n, 0) "
        f"WHEN {good} AND event_type = 'signup' THEN NULL END AS objects FROM named n "
        f"LEFT JOIN {per('near3')} a ON a.request_id = n.request_id LEFT JOIN {per('met')} b ON b.request_id = n.request_id "
        f"LEFT JOIN {per('passed')} c ON c.request_id = n.request_id", "named", "near3", "met", "passed")
    s["debug_lines"] = query(
        "SELECT n.request_id, '[tool] find_nearest(' || CASE WHEN request_id % 50 = 7 THEN '{oops' ELSE '{\"object_type\":\"' || keyword || '\"}' END || ')' AS call "
        "FROM poses n WHERE event_type = 'click' AND NOT request_id % 97 = 5", "poses")

    s["pose_log_lines"] = query(
        f"SELECT request_id, printf('[pose] Robot at (%.3f, %.3f), yaw=%.1fdeg, zone=%s', x, y, yaw_deg, coalesce(current_zone, 'None')) AS text "
        f"FROM (SELECT p.request_id, {pose}, current_zone FROM poses p LEFT JOIN posezone z ON z.request_id = p.request_id)", "posezone")
    s["goal_log_lines"] = query(
        f"SELECT request_id, printf('[nav] Published goal: (%.3f, %.3f, yaw=0.0) on /goal_pose', {rnd('tx', 3)}, {rnd('ty', 3)}) AS text FROM named", "named")
    s["conversation_history"] = (
        "SELECT conv_id AS case_id, CASE WHEN role = 'system' THEN 0 ELSE 2 END::BIGINT AS part, turn, role, text AS content FROM conversations "
        "UNION ALL SELECT conv_id, 1, turn - 1, role, text FROM conversations WHERE turn = 0")
    s["content_blocks"] = (
        "SELECT conv_id AS case_id, turn, text || chr(10) || 'done' AS text, 1::BIGINT AS num_calls, 'list_zones' AS first_call "
        "FROM conversations WHERE role = 'assistant'")
    s["tool_calls"] = query(
        "SELECT case_id, turn, rn AS round, 0::BIGINT AS call_no, case_id || '-' || turn AS id, call_name AS name, call_args AS arguments "
        "FROM rounds WHERE call_name IS NOT NULL", "rounds")
    s["tool_results"] = query(
        "SELECT case_id, turn, call_name AS name, CASE WHEN call_name = 'list_zones' THEN '{\"zones\": []}' "
        "ELSE '{\"info\":\"Mock result for ' || call_name || '\"}' END AS result FROM rounds WHERE call_name IS NOT NULL", "rounds")
    s["final_texts"] = query(
        "SELECT case_id, final_text FROM transcripts WHERE case_id IN (SELECT case_id FROM rounds)", "transcripts")
    s["scored_cases"] = query(_scored(), "transcripts")
    s["eval_report"] = query(
        f"SELECT scope, category, passed, failed, total, {rnd('pct', 1)} AS percent FROM (SELECT CASE WHEN category IS NULL THEN 'overall' ELSE 'category' END AS scope, "
        f"category, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) AS total, "
        f"count(*) FILTER (passed)/count(*)::DOUBLE*100e0 AS pct FROM ({_scored()}) GROUP BY ROLLUP (category))", "transcripts")
    edge_of = lambda order: (
        f"SELECT user_id AS scene_id, props AS payload FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY user_id ORDER BY ts {order}, props {order}) AS rn FROM events) WHERE rn = 1")
    s["stream_latched_state"] = edge_of("DESC")
    # of the first of the batches (by event number) that has the topic
    s["stream_first_receipt"] = edge_of("ASC").replace("ORDER BY ts", "ORDER BY event_id % 3, ts")
    s["stream_statuses"] = s["latest_status"]
    s["stream_timeouts"] = s["matched_responses"]
    s["stream_realigned"] = s["realigned_objects"]
    held = f"*, {rel_deg('yaw', 'x', 'y', 'tx', 'ty')} AS g"
    s["stream_answers"] = query(
        f"SELECT n.request_id, {tools} AS tool, CASE WHEN event_type = 'error' THEN zone_name END AS destination, "
        f"CASE WHEN event_type = 'error' THEN {sector('n.g')} END AS direction, CASE WHEN event_type = 'view' THEN z.current_zone END AS current_zone, "
        f"CASE WHEN event_type = 'view' THEN coalesce(k.n, 0) END AS count FROM (SELECT {held} FROM named) n "
        f"LEFT JOIN posezone z ON z.request_id = n.request_id LEFT JOIN (SELECT request_id, count(*) AS n FROM near3 GROUP BY 1) k ON k.request_id = n.request_id "
        f"WHERE event_type IN ('error', 'view')", "named", "posezone", "near3")
    s["stream_pose_zone"] = s["live_pose_zone"].replace(f", {rnd(f'(yaw*{TO_DEG})', 1)} AS yaw_deg", "")
    s["stream_log_ring"] = s["last_log_lines"]
    s["stream_arrivals"] = s["arrivals_detected"]
    s["journey_status"] = (
        f"SELECT journey_id, CASE WHEN cur >= total THEN 'succeeded' ELSE 'executing' END AS status, pct AS progress_percent, "
        f"least(past + 1, stops) AS current_stop, stops AS total_stops, CASE WHEN cur >= total THEN 'Journey complete. ' || pct || '% complete.' "
        f"ELSE 'Waypoint ' || (cur + 1) || ' of ' || total || ': enter room ' || (cur + 1) || '.' || CASE WHEN stops > 1 THEN ' (stop ' || least(past + 1, stops) || "
        f"' of ' || stops || ': room ' || nxt || ')' ELSE '' END || ' ' || pct || '% complete.' END AS narration FROM (SELECT *, {rnd('(cur*100e0/total)', 1)} AS pct FROM ("
        f"SELECT o_orderkey AS journey_id, o_orderkey % 4 AS cur, count(*) AS total, count(*) FILTER (n % 2 = 0) AS stops, "
        f"count(*) FILTER (n % 2 = 0 AND n - 1 < o_orderkey % 4) AS past, "
        f"min(n) FILTER (n % 2 = 0 AND n - 1 >= o_orderkey % 4) AS nxt "
        f"FROM orders JOIN range(1, 8) g(n) ON n <= 3 + o_orderkey % 5 GROUP BY 1, 2))")
    return s
