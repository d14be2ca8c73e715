"""Reachability, lanes, review loops, imports with rejects, exports and dot segments against brute force."""

import csv
import io
import json
import random

from pyspark.sql import functions as F

from quarryline.functions import urls as U
from quarryline.operators import graph as G
from quarryline.operators import grounding as C
from quarryline.sources import readers, sinks


def test_reachable_ends_in_cycles(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(300), rng.randrange(300)) for _ in range(500)} | {(1, 1), (1, 2), (2, 1)}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for most in (None, 2):
        want = {}
        for start in (1, 7, 299, 5000):
            level, depth, seen = {start}, 0, {start: 0}
            while level and (most is None or depth < most):
                depth += 1
                level = {b for a in level for b in after.get(a, ())} - set(seen)
                seen |= dict.fromkeys(level, depth)
            want |= {(start, i): d for i, d in seen.items()}
        got = G.reachable(spark.createDataFrame(list(edges), "src long, dst long"), spark.createDataFrame([(s,) for s in (1, 7, 299, 5000, 1)], "start long"), most).collect()
        assert {(r.start, r.id): r.depth for r in got} == want and len(got) == len(want)


def test_reachable_over_many_edges(spark):
    n = 500_000
    ids = spark.range(n)
    edges = ids.select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % n).alias("dst")).union(ids.select("id", ((F.col("id") * 31 + 5) % n)))
    found = G.reachable(edges, spark.createDataFrame([(0,)], "start long"), 12)
    level, seen = {0}, {0}
    for _ in range(12):
        level = {x for i in level for x in ((i * 7 + 1) % n, (i * 31 + 5) % n)} - seen
        seen |= level
    assert found.count() == len(seen)


def test_lanes_and_services_of_events(spark):
    ddl = "n string, s string, c string, k string"
    rows = [("Injury at Work", None, "Business", "crisis"), ("Old", "mental health plan", "Growing older", None), ("x", None, None, None), ("New home", "veteran", "Housing", "planned")]
    df = spark.createDataFrame(rows, ddl)
    cols = [F.col(c) for c in "nsck"]
    lanes = {r.n: list(r.v) for r in df.select("n", G.event_lanes(*cols).alias("v")).collect()}
    assert lanes == {"Injury at Work": ["employment", "disability", "emergencies"], "Old": ["disability", "older"], "x": [], "New home": ["housing"]}
    services = {r.n: list(r.v) for r in df.select("n", G.inferred_services(*cols[:3]).alias("v")).collect()}
    assert "DVA" in services["New home"] and "DVA" not in services["Old"] and services["x"] == []


def test_journey_view_places_and_focuses(spark):
    ddl = "id string, event_name string, typical_age_range array<int>, cluster string, position_x double"
    graph = spark.createDataFrame([("a", "A", [20, 40], "Health", None), ("b", "B", None, None, 7.0)], ddl)
    people = "id long, age int, income int, citizenship array<string>, residency_state string, employment_status string, housing_status string, current_life_events array<string>"
    profiles = spark.createDataFrame([(1, 20, None, None, None, None, None, ["A", "B", "A", "gone"]), (2, 70, None, None, None, None, None, None)], people)
    got = {r.p_id: r for r in G.journey_view(graph, profiles).collect()}
    assert got[1].focus_point.asDict() == {"x": 3.5, "y": 10.0, "z": 15.0} and got[2].focus_point.asDict() == {"x": 0.0, "y": 10.0, "z": 0.0}
    assert (got[1].life_stage, got[2].life_stage) == ("Young Adult", "Senior") and len(got[2].events) == 2 and {c.cluster for c in got[2].clusters} == {"Health", "Other"}


def test_review_loops_stop_as_specified(spark):
    rows = [("a", 2, "o2", "ACCEPT", None), ("a", 1, "o1", "REJECT", None), ("a", 3, "o3", "REJECT", None), ("b", 1, "p1", "REJECT", None), ("b", 2, None, None, "timeout"), ("b", 3, "p3", "ACCEPT", None)]
    rows += [("c", i, f"q{i}", "REJECT" if i < 4 else "ACCEPT", None) for i in range(1, 6)] + [("d", 1, None, "ACCEPT", "broken")]
    got = {r["sample"]: tuple(r)[1:] for r in C.review_loops(spark.createDataFrame(rows, "sample string, number int, output string, verdict string, error string")).collect()}
    assert got == {
        "a": (2, True, "ACCEPT", "o2", 1), "b": (2, False, "MAX_ITERATIONS_EXCEEDED", "p1", 1), "c": (3, False, "MAX_ITERATIONS_EXCEEDED", "q3", 3), "d": (1, False, "MAX_ITERATIONS_EXCEEDED", None, 0),
    }


def test_imports_keep_good_rows_and_list_rejects(spark, tmp_path):
    good = [{"id": str(i), "n": i, "tags": ["x"]} for i in range(20)]
    lines = [json.dumps(x) for x in good] + ['{"id": "b", "n": ', "plain", '{"n": 5}', '{"id": "t", "n": "many"}', "", '{"id": "e", "more": 1}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    rows, rejects = readers.import_jsonl(spark, f"{tmp_path}/in.jsonl", "id string, n int, tags array<string>")
    assert {(r.id, r.n) for r in rows.collect()} == {(x["id"], x["n"]) for x in good} | {("e", None)}
    assert {(r.line, r.reason) for r in rejects.collect()} == {(lines[20], "not a row of the schema"), ("plain", "not a row of the schema"), ('{"n": 5}', "no id"), (lines[23], "not a row of the schema")}


def test_csv_is_streamed(spark):
    df = spark.createDataFrame([("a,b", ["x", "y"], None), ('q"', [], 2)], "t string, l array<string>, n int")
    rows = list(csv.reader(io.StringIO("".join(sinks.stream_csv(df)))))
    assert rows[0] == ["t", "l", "n"] and sorted(map(tuple, rows[1:])) == [("a,b", "x|y", ""), ('q"', "", "2")]


def dots(path):
    out, parts = [], path[1:].split("/")
    for i, s in enumerate(parts):
        k = s.lower().replace("%2e", ".")
        if k == "..":
            out = out[:-1]
        if k not in (".", ".."):
            out.append(s)
        elif i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def test_dot_segments_equal_brute_force(spark):
    rng = random.Random(6)
    paths = ["/" + "/".join(rng.choice(["a", "b.c", ".", "..", "%2e", ".%2E", "", "...", ".a"]) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.d for r in df.select(U.without_dots(F.col("p")).alias("d")).collect()] == [dots(p) for p in paths]
    page = "https://H.org/x/y/z?q=/../1"
    cases = {"../w": "https://H.org/x/w", "./": "https://H.org/x/y/", "/a/../../b?c=/./d#/../e": "https://H.org/b?c=/./d#/../e", "http://o.org/a/..": "http://o.org/", "?k=/../": "https://H.org/x/y/z?k=/../", "g/..": "https://H.org/x/y/"}
    df = spark.createDataFrame([(k,) for k in cases], "h string").select(U.resolve(F.col("h"), F.lit(page)).alias("u"))
    assert [r.u for r in df.collect()] == list(cases.values())


def test_journey_focus_counts_and_carries_no_list(spark):
    graph = spark.createDataFrame([("a", "A", [20, 40], "Health"), ("b", "B", None, None), ("c", "C", None, "Other")], "id string, event_name string, typical_age_range array<int>, cluster string")
    people = "id long, age int, income int, citizenship array<string>, residency_state string, employment_status string, housing_status string, current_life_events array<string>"
    profiles = spark.createDataFrame([(1, 20, None, None, None, None, None, ["A", "B"]), (2, 70, None, None, None, None, None, None)], people)
    found = G.journey_focus(graph, profiles)
    view = {r.p_id: r for r in G.journey_view(graph, profiles).collect()}
    assert {r.p_id: (r.life_stage, r.completeness, r.focus_point, r.events, r.clusters) for r in found.collect()} == {k: (r.life_stage, r.completeness, r.focus_point, 3, 2) for k, r in view.items()}
    assert "collect_list" not in found._jdf.queryExecution().toString()
