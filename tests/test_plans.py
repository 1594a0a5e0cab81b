import json
import random

from pyspark.sql import functions as F

from helpers import OBJECTS, flat_scene, objects_df, rect, zones_df
from sceneframe.operators import scene as SC
from sceneframe.plans import dispatch, evaluation as EV, journeys as J, publish as P
from sceneframe.sources import scenes, sinks
from test_ordered import at

REQ = "request_id long, scene_id long, robot_id long, ts timestamp, tool string, args string"


def _logs(spark):
    poses = spark.createDataFrame([(1, at(0), 2.0, 1.5, 0.0)], "robot_id long, ts timestamp, x double, y double, yaw double")
    st = spark.createDataFrame([(1, at(1), [4])], "robot_id long, ts timestamp, status_codes array<int>")
    goals = spark.createDataFrame([(1, at(0), "kitchen")], "robot_id long, ts timestamp, destination string")
    return poses, st, goals


def _ask(spark, asks, dialect="cloud", scene=0):
    s = flat_scene(spark)
    poses, st, goals = _logs(spark)
    req = spark.createDataFrame([(i, scene, 1, at(5), t, a) for i, (t, a) in enumerate(asks)], REQ)
    answers = dispatch.answer_requests(req, poses, s, st, goals, dialect, {t for t, _ in asks})
    rows = {r.request_id: r for r in dispatch.documents(answers).collect()}
    return req, answers, rows


def test_every_tool_as_document(spark):
    asks = [("get_robot_pose", "{}"), ("describe_surroundings", None), ("describe_surroundings", '{"radius": 4}'),
            ("find_nearest", '{"object_type": " CHAIR "}'), ("find_nearest", '{"object_type": "sofa"}'),
            ("distance_to", '{"destination": "hallway"}'), ("describe_route", '{"destination": "living_room"}'),
            ("describe_route", '{"destination": "kitchen"}'), ("orient_me", '{"target": "hallway"}'),
            ("navigate_to_zone", '{"zone_name": "Hallway"}'), ("navigate_to_object", '{"object_label": "lamp"}'),
            ("query_zone", '{"zone_name": "kitchen"}'), ("query_zone", '{"zone_name": "attic"}'),
            ("query_object", '{"object_label": "Couch"}'), ("query_object", '{"object_label": "sofa"}'),
            ("list_zones", "{}"), ("list_objects", "{}"), ("get_navigation_status", "{}"), ("cancel_navigation", "{}"),
            ("fly", "{}"), ("find_nearest", "{broken"), ("query_zone", None), ("describe_surroundings", '{"radius": "far"}')]
    _, answers, rows = _ask(spark, asks)
    assert len(rows) == len(asks)
    doc = {i: json.loads(r.result_json) for i, r in rows.items()}
    assert doc[0] == {"x": 2.0, "y": 1.5, "yaw_deg": 0.0, "frame": "map", "current_zone": "kitchen"}
    assert doc[1]["count"] == 2 and [o["label"] for o in doc[1]["nearby_objects"]] == ["microwave", "fridge"]
    assert doc[2]["count"] == 3 and doc[2]["nearby_objects"][2] == {"label": "chair", "distance": 3.54, "direction": "ahead"}
    assert doc[3] == {"label": "chair", "distance_m": 3.54, "direction": "ahead", "zone": "living_room"}
    assert doc[4] == {"error": "No objects matching 'sofa' found.", "hint": "Use list_objects to see available labels."}
    assert doc[5]["destination_type"] == "zone" and doc[5]["direction"] == "to your left"
    assert doc[6]["zones_along_path"] == ["kitchen", "living_room"] and len(doc[6]["objects_along_path"]) == 3
    assert doc[7]["zones_along_path"] == [] and doc[7]["objects_along_path"] == []
    assert doc[8]["turn_degrees"] == 90.0
    assert doc[9] == {"success": True, "zone": "hallway", "goal": {"x": 2.0, "y": 4.0}}
    assert doc[10]["goal"] == {"x": 8.5, "y": 1.0}
    assert [o["label"] for o in doc[11]["objects"]] == ["fridge", "microwave"] == [o["label"] for o in doc[11]["direct_objects"]]
    assert doc[11]["zone"]["num_objects"] == 2 and doc[12]["found"] is False and doc[12]["zone"] is None
    assert doc[13]["count"] == 1 and doc[13]["objects"][0]["location"]["zone"] == "living_room"
    assert doc[14]["found"] is False and doc[14]["objects"] == []
    assert [z["name"] for z in doc[15]["zones"]] == ["kitchen", "living_room", "hallway"]
    assert doc[11]["zone"]["children"] == [] and len(doc[11]["zone"]["vertices_world"]) == 4
    assert all("parent" not in z and "children" not in z and z["display_name"] == z["name"] for z in doc[15]["zones"])
    assert doc[16]["objects"] == ["chair", "couch", "fridge", "lamp", "microwave", "table"]
    assert doc[17] == {"status": "arrived", "destination": "kitchen", "message": "Arrived at kitchen"}
    assert doc[18] == {"success": True, "message": "Navigation cancelled"}
    assert doc[19] == {"error": "Unknown tool: fly"} and rows[19].tool == "fly"
    assert doc[20] == {"error": "'object_type'"} and doc[21] == {"error": "'zone_name'"}
    assert "error" in doc[22]


def test_local_dialect(spark):
    asks = [("describe_surroundings", "{}"), ("cancel_navigation", "{}"), ("navigate_to_zone", '{"zone_name": "hallway"}'),
            ("navigate_to_zone", '{"zone_name": "attic"}')]
    req, answers, rows = _ask(spark, asks, "local")
    doc = {i: json.loads(r.result_json) for i, r in rows.items()}
    assert doc[0]["radius_m"] == 3.0 and doc[0]["nearby_objects"][1]["direction"] == "behind-right"
    assert doc[1] == {"error": "Unknown tool: cancel_navigation"}
    assert doc[2] == {"status": "goal_sent", "zone": "hallway", "goal_x": 2.0, "goal_y": 4.0}
    assert doc[3] == {"error": "Zone 'attic' not found.", "hint": "Use list_zones to see available zone names."}
    lines = dispatch.debug_lines(req, answers.headers).where("request_id = 2").first()
    assert lines.text.startswith('[tool] navigate_to_zone({"zone_name": "hallway"}) -> {"status":"goal_sent"')


def test_lines_of_a_file_are_scenes(spark, tmp_path):
    (tmp_path / "many.json").write_text(json.dumps(SCENE) + "\n\n" + json.dumps(dict(SCENE, zones=[])) + "\n")
    scene = scenes.read_scene(spark, str(tmp_path / "many.json"), multi_line=False)
    got = {}
    for r in scene.objects.collect():
        got.setdefault(r.scene_id, []).append(r.ord)
    assert len(got) == 2 and all(sorted(v) == [0, 1, 2] for v in got.values()) and all(k.startswith("many#") for k in got)
    assert scene.zones.select("scene_id").distinct().count() == 1


def test_scene_without_data(spark):
    _, _, rows = _ask(spark, [("find_nearest", '{"object_type": "x"}'), ("list_zones", "{}"),
                                 ("list_objects", "{}"), ("navigate_to_zone", '{"zone_name": "kitchen"}')], scene=7)
    assert [json.loads(rows[i].result_json)["error"] for i in range(4)] == [
        "No object data available", "No zone data available", "No object data available", "No zone data available"]


SCENE = {"metadata": {"created": "2026", "world_axes": "xz", "alignment":
                      {"translate_x": 1.0, "translate_y": 2.0, "rotate_deg": 90.0, "scale": 2.0}},
         "objects": [{"id": 5, "label": "Chair", "centroid": {"x": 1.0, "y": 9.0, "z": 3.0}, "confidence": 1.0, "num_points": 100,
                      "location": {"zone": "wrong", "parent_zone": None, "full_path": None}},
                     {"id": 6, "label": "ghost", "centroid": {"x": 0.0, "y": 0.0, "z": 0.0}, "confidence": 0.1, "num_points": 100},
                     {"id": 7, "label": "thin", "centroid": {"x": 0.0, "y": 0.0, "z": 0.0}, "confidence": 0.9, "num_points": 49}],
         "zones": [{"name": "hall", "parent": None, "depth": 0, "children": [], "vertices_world": rect(-10, 0, 10, 10)},
                   {"name": "nook", "parent": None, "depth": 0, "children": [], "vertices_world": rect(-6, 3, -4, 5)}]}


def test_read_publish_and_snapshots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lab.json").write_text(json.dumps(SCENE, indent=1))
    bare = dict(SCENE, metadata={}, zones=[])
    (tmp_path / "in" / "bare.json").write_text(json.dumps(bare))
    scene = scenes.read_scene(spark, str(tmp_path / "in"), world_axes="xy", translate_x=0.5)
    pub = P.publish(scene)
    rows = {(r.scene_id): r for r in pub.enriched.collect()}
    lab = rows["lab"]  # (1, 3) scaled to (2, 6), turned to (-6, 2), moved to (-5, 4)
    assert (round(lab.x, 9), round(lab.y, 9), lab.zone, lab.parent_zone, lab.full_path) == (-5.0, 4.0, "nook", "hall", "hall > nook")
    assert (rows["bare"].x, rows["bare"].y, rows["bare"].zone) == (1.5, 9.0, None)
    snap = sinks.objects_snapshot(pub.enriched)
    text = {r.scene_id: json.loads(r.json) for r in snap.collect()}
    assert text["bare"]["location"] == {"zone": None, "parent_zone": None, "full_path": None}
    assert text["lab"]["centroid_3d"] == {"x": 1.0, "y": 9.0, "z": 3.0}
    sinks.write_snapshot(snap, str(tmp_path / "snap"))
    assert spark.read.text(str(tmp_path / "snap")).where("scene_id = 'lab'").count() == 1
    zs = {r.zord: json.loads(r.json) for r in sinks.zones_snapshot(pub.zones, pub.objects).collect()}
    assert zs[0]["num_objects"] == 1 and zs[0]["num_direct_objects"] == 0 and zs[1]["display_name"] == "hall > nook"
    sinks.write_alignment(scene.alignments.withColumn("rotate_deg", F.lit(1.23456)), str(tmp_path / "al"))
    assert {r.rotate_deg for r in spark.read.json(str(tmp_path / "al")).collect()} == {1.23}
    summary = {r.scene_id: r for r in SC.scene_summary(pub.objects, pub.zones).collect()}
    assert summary["lab"].ready and not summary["bare"].ready
    ext = {r.scene_id: r for r in SC.scene_extent(pub.objects, pub.zones, spark.createDataFrame(
        [("lab",), ("none",)], "scene_id string")).collect()}
    assert (ext["none"].min_x, ext["none"].max_y) == (-2.5, 7.5) and (ext["lab"].min_x, ext["lab"].max_y) == (-11.5, 11.5)
    feats = sinks.map_features(pub.objects, pub.zones).groupBy("ns").count().collect()
    assert {r.ns: r["count"] for r in feats} == {"centroids": 2, "labels": 2, "all_zone_polygons": 2, "all_zone_labels": 2}


def test_split_files(spark, tmp_path):
    for part, body in (("o", {"objects": SCENE["objects"]}), ("a", {"translate_x": 1.0, "translate_y": 2.0, "rotate_deg": 90.0}),
                       ("z", {"zones": SCENE["zones"]})):
        (tmp_path / part).mkdir()
        (tmp_path / part / "lab.json").write_text(json.dumps(body))
    s = scenes.read_scene_split(spark, str(tmp_path / "o"), str(tmp_path / "a"), str(tmp_path / "z"), world_axes="xz")
    r = P.publish(s).enriched.first()
    assert (round(r.x, 9), round(r.y, 9), r.zone) == (-2.0, 3.0, "hall")
    alone = scenes.read_scene_split(spark, str(tmp_path / "o"))
    assert alone.zones.count() == 0 and alone.alignments.first().scale == 1.0


def test_payloads(spark):
    good = json.dumps({"objects": [{"id": 1, "label": "a", "map_position": {"x": 1.0, "y": 2.0}}]})
    zones = json.dumps({"zones": [{"name": "z", "vertices_world": [[0, 0], [1, 0], [1, 1]]}, {"name": "empty"}]})
    df = spark.createDataFrame([(0, good), (1, "{oops"), (2, None), (3, '{"objects": []}')], "scene_id long, payload string")
    rows, errors = scenes.parse_scene_payload(df, "objects")
    assert [(r.scene_id, r.label, r.x) for r in rows.collect()] == [(0, "a", 1.0)]
    assert {r.scene_id for r in errors.collect()} == {1, 2}
    rows, _ = scenes.parse_scene_payload(spark.createDataFrame([(0, zones)], "scene_id long, payload string"), "zones")
    assert [(r.name, len(r.vertices)) for r in rows.orderBy("zord").collect()] == [("z", 3), ("empty", 0)]


def test_realign(spark):
    objs = spark.createDataFrame([(0, 0, 1, "a", (1.0, 0.0, 0.0), 1.0, 99, 0.0, 0.0)], OBJECTS).drop("x", "y")
    al = spark.createDataFrame([(0, 5.0, 5.0, 0.0, 2.0, "xy")], "scene_id long, translate_x double, translate_y double, "
                               "rotate_deg double, scale double, world_axes string")
    scene = scenes.Scene(objs, zones_df(spark, [("z", None, rect(5, 5, 9, 9))]), al)
    est = spark.createDataFrame([(0, at(1), 9.0, 9.0, 0.0, 0.0, 0.0, 1.0), (0, at(2), 10.0, 0.0, 0.0, 0.0, 2 ** -0.5, 2 ** -0.5)],
                                "scene_id long, ts timestamp, x double, y double, qx double, qy double, qz double, qw double")
    moved = P.realign(scene, P.latest_alignment(est))
    o = SC.to_map_frame(moved.objects, moved.alignments).first()
    assert (round(o.x, 9), round(o.y, 9)) == (10.0, 1.0)  # scale 1, a quarter turn
    ring = [[round(v, 9) for v in p] for p in moved.zones.first().vertices]
    assert ring == [[10.0, 0.0], [10.0, 2.0], [8.0, 2.0], [8.0, 0.0]]
    same = P.realign(scene, P.latest_alignment(est.where("false")))
    assert same.alignments.first().scale == 2.0 and same.zones.first().vertices == rect(5, 5, 9, 9)


def test_filter_objects(spark):
    o = objects_df(spark, [("Chair", 0.0, 0.0, 0.3, 50), ("chair", 0.0, 0.0, 0.29, 50), ("TABLE", 0.0, 0.0, 1.0, 49), ("Lamp", 0.0, 0.0, 1.0, 99)])
    assert SC.filter_objects(o).count() == 2
    assert [r.label for r in SC.filter_objects(o, excluded_labels=["CHAIR"]).collect()] == ["Lamp"]
    banned = spark.createDataFrame([("LAMP",)], "label string")
    assert [r.label for r in SC.filter_objects(o, excluded_labels=banned).collect()] == ["Chair"]


CASE = ("case_id long, description string, expected_tools array<string>, arg_check map<string,string>, reject_tools array<string>, "
        "mock_results map<string,string>, should_contain array<string>, should_not_contain array<string>")
TURN = "case_id long, turn long, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>"


def test_scoring(spark):
    call = lambda n, a="{}": ("c", n, a)
    cases = spark.createDataFrame([
        (1, "8. Find: nearest", ["find_nearest"], {"object_type": "chair"}, [], {"find_nearest": "R"}, ["chair"], ["3.5"]),
        (2, "13. Nav: confirm", ["list_zones", None], {}, ["navigate_to_zone"], {}, ["?"], []),
        (3, "3. Nav: no call", ["list_zones", None], {}, ["navigate_to_zone"], {}, ["go"], []),
        (4, "plain", ["find_nearest"], {"object_type": "chair"}, [], {}, [], []),
        (5, "9. Find: args", ["list_objects"], {"object_type": "chair"}, [], {}, [], ["x"]),
        (6, "7. Info: silent", [], {}, [], {}, ["word"], [])], CASE)
    turns = spark.createDataFrame([
        (1, 0, "user", "where?", []), (1, 1, "assistant", "Look: ", [call("find_nearest", '{"object_type": "Red CHAIR"}')]),
        (1, 2, "assistant", "a ch", []), (1, 3, "assistant", "air", []),
        (2, 1, "assistant", "Going!", [call("navigate_to_zone"), call("fly")]),
        (3, 1, "assistant", "Shall we GO?", []),
        (4, 1, "assistant", None, [call("other", "{bad"), call("find_nearest", '{"object_type": 3}')]),
        (5, 1, "assistant", "xylophone", [call("fly", '{"object_type": "chair"}')])], TURN)
    got = {r.case_id: r for r in EV.score_cases(turns, cases).collect()}
    assert got[1].passed and got[1].final_text == "Look: a chair" and got[1].category == "Find"
    assert got[2].issues == ["Called rejected tool: navigate_to_zone",
                             "Expected one of ['list_zones'], got ['navigate_to_zone', 'fly']", "Response missing all of: ['?']"]
    assert got[3].passed and got[4].issues == ["Arg object_type='3', expected 'chair'"] and got[4].category == "Other"
    assert got[5].issues == ["Expected one of ['list_objects'], got ['fly']", "Response contains forbidden: 'x'"]
    assert got[6].issues == ["Response missing all of: ['word']"]
    rep = {(r.scope, r.category): (r.passed, r.failed, r.percent) for r in EV.eval_report(turns, cases).collect()}
    assert rep[("overall", None)] == (2, 4, 2 / 6 * 100) and rep[("category", "Nav")] == (1, 1, 50.0)
    res = {(r.case_id, r.name): r.result for r in EV.attach_tool_results(EV.extract_tool_calls(turns), cases).collect()}
    assert res[(1, "find_nearest")] == "R" and json.loads(res[(2, "fly")]) == {"info": "Mock result for fly"}


def test_all_assistant_turns_count(spark):
    turns = spark.createDataFrame([(1, i, "assistant", str(i), [("c", f"t{i}", "{}")]) for i in range(8)], TURN)
    r = EV.case_transcripts(turns).first()
    assert r.final_text == "01234567" and [c.name for c in r.calls] == [f"t{i}" for i in range(8)]
    assert {(c.turn, c.round, c.name) for c in EV.extract_tool_calls(turns).collect()} == {(i, i + 1, f"t{i}") for i in range(8)}


def test_content_blocks(spark):
    body = json.dumps([{"type": "text", "text": "a"}, {"type": "tool_use", "id": "1", "name": "fly", "input": {"k": 1}},
                       {"type": "image"}, {"type": "text", "text": "b"}])
    r = EV.content_blocks(spark.createDataFrame([(body,)], "content string")).first()
    assert r.text == "a\nb" and [(c.name, json.loads(c.arguments)) for c in r.tool_calls] == [("fly", {"k": 1})]


def test_journeys(spark):
    rings = [("a", None, rect(0, 0, 10, 10)), ("b", None, rect(10.5, 0, 20, 10)), ("c", None, rect(20.2, 0, 30, 10)),
             ("d", None, rect(10, 12, 20, 20)), ("far", None, rect(90, 90, 99, 99)), ("tiny", None, rect(9.8, 4, 10.6, 5))]
    from sceneframe.operators import hierarchy as H
    zones = H.zone_hierarchy(zones_df(spark, rings))
    adj = J.zone_adjacency(zones, 1.0)
    assert {(r.a, r.b) for r in adj.collect()} == {(0, 1), (0, 5), (1, 2), (1, 5)}
    trips = spark.createDataFrame([(1, 0, "a", ["C", "b"]), (2, 0, "a", ["far"]), (3, 0, "b", ["b", "attic"])],
                                  "journey_id long, scene_id long, start_zone string, destinations array<string>")
    rows = J.plan_journeys(trips, zones, adj).orderBy("journey_id", "stop_no", "hop").collect()
    assert [(r.journey_id, r.stop_no, r.zone, r.is_stop, r.error) for r in rows] == [
        (1, 1, "b", False, None), (1, 1, "c", True, None), (1, 2, "b", True, None), (2, 1, None, None, "No route to 'far'"),
        (3, 1, "b", True, None), (3, 2, None, None, "No route to 'attic'")]
    way = [(1, i, f"enter room{i}", i == 4, "pump_room") for i in range(5)]
    way[3] = (1, 3, "enter pump_room", False, "")
    way += [(2, i, "exit gallery_2" if i == 4 else "x", i in (5, 8, 11), {5: "pump_room", 8: "loading_bay", 11: "foyer"}.get(i, ""))
            for i in range(12)]
    w = spark.createDataFrame(way, "journey_id long, idx int, action string, is_stop boolean, stop string")
    p = spark.createDataFrame([(1, 3), (2, 4)], "journey_id long, current_waypoint int")
    got = {r.journey_id: r for r in J.journey_status(w, p).collect()}
    assert got[1].narration == "Waypoint 4 of 5: enter pump_room. 60.0% complete." and got[1].progress_percent == 60.0
    assert got[2].narration == "Waypoint 5 of 12: exit gallery_2. (stop 1 of 3: pump_room) 33.3% complete."
    assert (got[2].current_stop, got[2].total_stops) == (1, 3)


def shortest(edges, source, target):
    """Breadth-first over whole paths, smallest path first."""
    around = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    paths, seen = {source: (source,)}, {source}
    while paths and target not in paths:
        nxt = {}
        for path in sorted(paths.values()):
            for node in around.get(path[-1], ()):
                if node not in seen:
                    nxt[node] = min(nxt.get(node, (9e9,)), path + (node,))
        seen |= set(nxt)
        paths = nxt
    return paths.get(target)


def test_shortest_paths_in_several_leaps(spark, monkeypatch):
    """Two scenes, one with a long corridor; unreachable zones, zones without neighbours, a leg to its own start."""
    rng = random.Random(6)
    graphs = {0: [(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.09], 7: [(k, k + 1) for k in range(24)] + [(40, 41)]}
    legs = [(0, rng.randrange(34), rng.randrange(34)) for _ in range(60)] + [(7, 0, 24), (7, 24, 1), (7, 3, 40), (7, 5, 5), (7, 99, 2), (7, 2, 99), (7, 99, 99), (5, 1, 2)]
    adjacency = spark.createDataFrame([(s, a, b) for s, e in graphs.items() for a, b in e], "scene_id long, a long, b long")
    frame = spark.createDataFrame(legs, "scene_id long, source long, target long")
    want = sorted((s, a, b, k, node, len(p) - 1) for s, a, b in set(legs) if (p := shortest(graphs.get(s, []), a, b)) for k, node in enumerate(p))
    for leap in (12, 3):
        monkeypatch.setattr(J, "LEAP", leap)
        assert sorted(map(tuple, J.shortest_zone_paths(frame, adjacency).collect())) == want
    assert J.shortest_zone_paths(frame.limit(0), adjacency).count() == 0
    assert {r.hop for r in J.shortest_zone_paths(frame, adjacency.limit(0)).collect()} == {0}


def test_split_scenes_in_lines(spark, tmp_path):
    """Two scenes as lines of split files, in different orders; one line without an id."""
    parts = {"objects": [{"scene_id": k, "objects": [{"id": 1, "label": f"lamp {k}", "centroid": {"x": 1.0, "y": 2.0, "z": 0.0}, "confidence": 0.9, "num_points": 99}]} for k in ("one", "two")]
             + [{"objects": []}],
             "offset": [{"scene_id": k, "translate_x": x, "translate_y": 0.0, "rotate_deg": 0.0} for k, x in (("two", 2.0), ("one", 1.0))],
             "zones": [{"scene_id": k, "zones": [{"name": f"room {k}", "vertices_world": rect(0, 0, 4, 4)}]} for k in ("two", "one")]}
    for kind, docs in parts.items():
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "house.json").write_text("\n".join(map(json.dumps, docs)))
    scene = scenes.read_scene_split(spark, *(str(tmp_path / k) for k in parts), multi_line=False)
    met = scene.objects.join(scene.alignments, "scene_id").join(scene.zones, "scene_id").collect()
    assert sorted((r.scene_id, r.label, r.translate_x, r["name"]) for r in met) == [("house#one", "lamp one", 1.0, "room one"), ("house#two", "lamp two", 2.0, "room two")]
