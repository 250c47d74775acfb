"""The network job on one street over a sloping tile."""

import math

from slopeworks.jobs import build_network

SIDE, Z = 64, 14


def tiles(spark, lon, lat, rise):
    """Tiles around a place whose altitude grows by ``rise`` per pixel eastward."""
    n = 1 << Z
    tx = int((lon + 180) / 360 * n)
    ty = int((1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * n)
    rows = [(Z, x, y, [rise * ((x - tx) * SIDE + i % SIDE) for i in range(SIDE * SIDE)]) for x in range(tx - 1, tx + 3) for y in range(ty - 1, ty + 2)]
    return spark.createDataFrame(rows, "z int, x long, y long, pixels array<double>")


def test_one_street(spark):
    lon, lat = 2.39, 48.85
    segs = [(1, "road", "residential", None), (2, "road", "footway", "sidewalk"), (3, "road", "motorway", None), (4, "road", "primary", None), (5, "road", "primary", None)]
    segments = spark.createDataFrame(segs, "seg_id long, subtype string, class string, subclass string")
    vertices = spark.createDataFrame([(s, k, lon + 0.001 * k, lat + 0.0001 * s) for s in range(1, 5) for k in range(3)] + [(5, k, lon, lat) for k in range(2)], "seg_id long, seq int, lon double, lat double")
    connectors = spark.createDataFrame([(s, at, s * 10 + i) for s in range(1, 6) for i, at in enumerate((0.0, 0.25, 1.0))] + [(1, 0.25, 11)], "seg_id long, at double, connector_id long")
    access = spark.createDataFrame([(4, True, True, False, False)], "seg_id long, allow boolean, fwd boolean, bwd boolean, explicit boolean")
    flags = spark.createDataFrame([(4, "is_bridge", None, None)], "seg_id long, flag string, from_at double, to_at double")
    rise = 0.2
    got = build_network.build_network(segments, vertices, connectors, access, flags, tiles(spark, lon, lat, rise), side=SIDE, zoom=Z)
    edges = {(x.seg_id, x.piece): x for x in got["edges"].collect()}
    first = [e for (s, _), e in sorted(edges.items()) if s == 1]
    assert {s for s, _ in edges} == {1, 4} and len(first) == 2
    meters = math.radians(0.002) * 6371008.8 * math.cos(math.radians(lat))
    assert abs(first[0].length_m - meters * 0.25) < 0.1 and abs(first[1].length_m - meters * 0.75) < 0.3
    assert (first[0].u, first[0].v, first[1].v) == (10, 11, 12)
    pixels = 0.002 / 360 * (1 << Z) * SIDE
    slope = 100 * pixels * rise / meters
    assert abs(first[1].max_fwd - slope) < 0.3 and first[1].max_bwd < 0 and first[1].allow_bwd
    assert not edges[4, 0].allow_bwd and edges[4, 0].pref == 1.1
    pts = got["points"].where(f"edge_id = {first[1].edge_id}").orderBy("seq").collect()
    assert all(b.dist_m - a.dist_m <= 10.01 for a, b in zip(pts, pts[1:])) and pts[0].dist_m == 0
    nodes = {x.node_id: (round(x.lon, 6), round(x.lat, 6)) for x in got["nodes"].collect()}
    assert nodes[10] == (2.39, 48.8501) and nodes[11] == (2.3905, 48.8501) and nodes[12] == (2.392, 48.8501) and len(nodes) == 6


def test_empty(spark):
    empty = lambda s: spark.createDataFrame([], s)
    got = build_network.build_network(
        empty("seg_id long, subtype string, class string, subclass string"), empty("seg_id long, seq int, lon double, lat double"), empty("seg_id long, at double, connector_id long"),
        empty("seg_id long, allow boolean, fwd boolean, bwd boolean, explicit boolean"), empty("seg_id long, flag string, from_at double, to_at double"), empty("z int, x long, y long, pixels array<double>"),
    )
    assert got["edges"].count() == got["nodes"].count() == 0


def test_whole_line_and_its_ends(spark):
    from pyspark.sql import functions as F

    from slopeworks.operators import routes

    line = spark.createDataFrame([(1, k, 2.0 + 0.1 * k, 48.0) for k in range(8)], "line_id long, seq int, lon double, lat double")
    cut = lambda a, b: [round(x.lon, 9) for x in routes.line_substring(line, F.lit(a), F.lit(b)).orderBy("pos_deg").collect()]
    assert cut(0.0, 1.0) == [round(2.0 + 0.1 * k, 9) for k in range(8)]
    assert cut(0.9, 1.0) == [2.63, 2.7] and cut(0.0, 0.1) == [2.0, 2.07]


def test_a_sweep_cuts_as_each_piece_alone(spark):
    """Cuts on vertices, between them, at ends, past doubled vertices and gaps between pieces; rows grow with vertices and pieces, not with their product."""
    import random

    from pyspark.sql import functions as F

    from slopeworks.operators import routes

    rng = random.Random(4)
    vertices, pieces = [], []
    for line in range(12):
        x = 0.0
        for k in range(rng.randint(1, 40)):
            vertices.append((line, k, 2.0 + x, 48.0 + rng.choice([0.0, 0.001])))
            x += rng.choice([0.0, 0.01, 0.02])
        at = sorted({0.0, 1.0, *(rng.choice([rng.random(), 0.25, 0.5]) for _ in range(9))})
        pieces += [(line, line * 100 + i, a, b) for i, (a, b) in enumerate(zip(at, at[1:])) if i % 4 != 3]
    v = spark.createDataFrame([*vertices, (99, 0, 2.0, 48.0), (99, 1, 2.0, 48.0)], "line_id long, seq int, lon double, lat double")
    p = spark.createDataFrame([*pieces, (99, 9900, 0.0, 1.0)], "line_id long, edge_id long, from_at double, to_at double")
    told = lambda df: sorted((r.edge_id, round(r.pos_deg, 9), round(r.lon, 9), round(r.lat, 9)) for r in df.collect())
    alone = v.join(p, "line_id").withColumnRenamed("line_id", "_").withColumnRenamed("edge_id", "line_id")
    want = told(routes.line_substring(alone, F.col("from_at"), F.col("to_at")).withColumnRenamed("line_id", "edge_id"))
    got = told(routes.cut_lines(v, p))
    assert got == want and 2 * len(pieces) * 0.5 < len(got) <= len(vertices) + 2 * len(pieces)


def test_access_by_rows_is_access_by_arrays(spark):
    from pyspark.sql import functions as F

    from slopeworks.operators import network

    kinds = [(t, h, u, g, m) for t in ("denied", "allowed", "designated", "other") for h in (None, "forward", "backward") for u in (True, False) for g in (True, False) for m in (None, "bicycle", "foot")]
    rows = [(s, k, *kinds[(s * 31 + k * k * 17 + s * k * 7) % len(kinds)]) for s in range(300) for k in range(s % 6 + 1)]
    rules = spark.createDataFrame(rows, "seg_id long, ord long, access_type string, heading string, has_during boolean, has_recognized boolean, mode string")
    listed = rules.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("ord", "access_type", "heading", "has_during", "has_recognized", "mode"))).alias("r")).select("seg_id", network.bike_access(F.col("r")).alias("a")).select("seg_id", "a.*")
    want = sorted(tuple(x) for x in listed.collect())
    assert sorted(tuple(x) for x in network.access_of_rules(rules).collect()) == want
    assert len(set(x[1:] for x in want)) > 6


def test_nodes_alone_are_those_of_the_network_without_its_grades(spark, monkeypatch):
    lon, lat = 2.39, 48.85
    segments = spark.createDataFrame([(s, "road", "residential", None) for s in range(8)], "seg_id long, subtype string, class string, subclass string")
    vertices = spark.createDataFrame([(s, k, lon + 0.001 * k - 0.002 * (s == 5), lat + 0.0001 * s) for s in range(8) for k in range(3)], "seg_id long, seq int, lon double, lat double")
    connectors = spark.createDataFrame([(s, at, (s * 3 + i) % 11) for s in range(8) for i, at in enumerate((0.0, 0.25, 0.25, 1.0))], "seg_id long, at double, connector_id long")
    access = spark.createDataFrame([(4, True, True, False, False), (6, False, True, True, False)], "seg_id long, allow boolean, fwd boolean, bwd boolean, explicit boolean")
    flags = spark.createDataFrame([(4, "is_bridge", None, None)], "seg_id long, flag string, from_at double, to_at double")
    ground = tiles(spark, lon, lat, 0.2)
    want = sorted(tuple(x) for x in build_network.build_network(segments, vertices, connectors, access, flags, ground, side=SIDE, zoom=Z)["nodes"].collect())
    monkeypatch.setattr(build_network.routes, "edge_metrics", None)
    monkeypatch.setattr(build_network.profile, "smooth", None)
    assert len(want) > 5 and sorted(tuple(x) for x in build_network.build_nodes(segments, vertices, connectors, access, ground, side=SIDE, zoom=Z).collect()) == want
