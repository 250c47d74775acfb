"""Sheets with names, many tiers over few steps, summaries."""

import json

from slopeworks.operators import directions, reports, search


def test_departure_and_arrival_have_names(spark):
    steps = spark.createDataFrame([(k, 1, "rue a", 30.0, None, []) for k in (1, 2, 3)], "route_id long, step_no long, name string, length_m double, delta double, notes array<string>")
    totals = spark.createDataFrame([(k, 30.0, 60.0, 0.0) for k in (1, 2, 3)], "route_id long, length_m double, time_s double, gain_m double")
    ends = spark.createDataFrame([(1, "A", "B"), (2, None, "C")], "route_id long, start_name string, end_name string")
    lines = {(x.route_id, x.line_no): x.line for x in directions.directions_text(steps, totals, ends).collect()}
    assert lines[1, 0] == "Départ : A" and lines[2, 0] == lines[3, 0] == "Départ"
    assert lines[1, 2] == " 2. Arrivée : B — total 30 m, 1 min, D+ 0 m" and lines[3, 2] == " 2. Arrivée — total 30 m, 1 min, D+ 0 m"


def test_tiers_look_their_route_up(spark):
    arc = lambda w, step, no, u, v, m: (1, w, 0, "found", step, 0.0, 100.0, no, u * 10 + v, True, m, u, v)
    rows = [arc(50, 0, 0, 1, 2, 100.0), arc(50, 1, 0, 1, 3, 60.0), arc(50, 1, 1, 3, 2, 70.0), arc(50, 2, 0, 1, 4, 200.0), arc(50, 2, 1, 4, 2, 50.0), arc(100, 0, 0, 1, 2, 100.0), arc(100, 1, 0, 1, 4, 65.0), arc(100, 1, 1, 4, 2, 50.0)]
    steps = spark.createDataFrame([*rows, (2, 50, 0, "unreachable", *[None] * 9)], search.STEPS)
    numbered, ways = search.numbered_tiers(steps, search.Plan(tuple(range(0, 121)), refine=False))
    got = {(x.window_m, x.tier_pct): x.route_no for x in numbered.collect()}
    assert len(got) == 242 and [got[50, t] for t in (0, 29, 30, 120)] == [0, 0, 1, 1]
    assert [got[100, t] for t in (0, 14, 15, 120)] == [0, 0, 2, 2]
    plain = {(x.window_m, x.tier_pct): x.step for x in search.of_tiers(steps, search.Plan(tuple(range(0, 121)))).select("window_m", "tier_pct", "step").distinct().collect()}
    assert {k: {(50, 0): 0, (50, 1): 1, (100, 0): 0, (100, 1): 2}[k[0], s] for k, s in plain.items()} == got
    assert sorted((x.route_no, x.arc_seq, x.u, x.v) for x in ways.collect()) == [(0, 0, 1, 2), (1, 0, 1, 3), (1, 1, 3, 2), (2, 0, 1, 4), (2, 1, 4, 2)]


def test_summary_is_json(spark):
    solved = spark.createDataFrame(
        [(1, 0, 1000.4, 0.0, 4.04, 0.0, 9.0, 8.0, 300.0, None), (1, 10, 1000.4, 0.0, 4.04, 0.0, 9.0, 8.0, 300.0, 0)],
        "req_id long, tier long, length_m double, detour_pct double, max_grade_pct double, steep_len_m double, gain_m double, loss_m double, time_s double, same_as_tier long",
    )
    text = "".join(x.line for x in sorted(reports.summary_json(solved).collect(), key=lambda x: (x.part, x.tier)))
    one, two = json.loads(text)["variants"]
    assert one["length_m"] == 1000 and one["max_grade_pct"] == 4.0 and one["same_as_tier"] is None and one["png"].endswith("+00pct.png")
    assert two["same_as_tier"] == 0 and two["png"] is None
