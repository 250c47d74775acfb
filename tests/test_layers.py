import random
import struct

import pytest
from pyspark.sql import functions as F

from slopeworks.operators import layers
from slopeworks.sources import geometry
from slopeworks.sources import layers as files


def test_boxes_of_any_size_meet_once(spark):
    rng = random.Random(3)

    def box():
        x, y, w, h = rng.uniform(-170, 150), rng.uniform(-80, 60), 10 ** rng.uniform(-5, 1.3), 10 ** rng.uniform(-5, 1.3)
        return (x, x + w * (rng.random() > 0.1), y, y + h * (rng.random() > 0.1))

    f = [(k, *box()) for k in range(400)] + [(400, -180.0, 180.0, -90.0, 90.0), (401, 2.0, 2.01, 48.0, 48.01), (402, None, 1.0, 0.0, 1.0)]
    r = [(k, *box()) for k in range(60)] + [(60, 2.01, 2.02, 48.01, 48.02), (61, -180.0, 180.0, -90.0, 90.0), (62, 2.01, 2.01, 48.0, 48.0)]
    fd = spark.createDataFrame(f, "id long, xmin double, xmax double, ymin double, ymax double").withColumn("_level", F.lit("own"))
    rd = spark.createDataFrame(r, "req_id long, x0 double, x1 double, y0 double, y1 double")
    want = sorted((q[0], p[0]) for q in r for p in f if None not in p and p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3])
    assert sorted(tuple(x) for x in layers.features_per_request(fd, rd).collect()) == want
    assert (60, 401) in want and (62, 401) in want
    assert layers.features_per_request(fd.limit(0), rd).count() == 0 == layers.features_per_request(fd, rd.limit(0)).count()


def test_boxes_are_not_sent_to_all_tasks_and_crowds_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(layers, "REQUESTS_A_CELL", 7)
    fd = spark.range(300).selectExpr("id", "id / 128D as xmin", "id / 128D + 0.004D as xmax", "id % 7 / 128D as ymin", "id % 7 / 128D + 0.05D as ymax")
    rd = spark.range(100).selectExpr("id as req_id", "id / 512D as x0", "id / 512D + 2D as x1", "0D as y0", "0.03D as y1")
    got = layers.features_per_request(fd, rd)
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_task#" in line and "_tasks" not in line.split("_task#")[0]]
    assert any("SortMergeJoin" in line for line in joins) and not any("BroadcastHashJoin" in line for line in joins)
    want = sorted((q, p) for q in range(100) for p in range(300) if p / 128 <= q / 512 + 2 and p / 128 + 0.004 >= q / 512 and p % 7 / 128 <= 0.03)
    assert sorted(tuple(x) for x in got.collect()) == want


def test_kind_from_the_head_is_the_decoded_kind(spark):
    point = lambda order, code: struct.pack(f"{order}BI2d", order == "<", code, 1.0, 2.0)
    raws = [point("<", 1), point(">", 1), struct.pack("<BII", 1, 2, 0), struct.pack(">BII", 0, 6, 0), b"", None, b"\x01\x63\x00\x00\x00", b"\x01\x02"]
    got = spark.createDataFrame([(x,) for x in raws], "b binary").select(geometry.kind_of(F.col("b")).alias("h"), geometry.wkb_decode(F.col("b")).kind.alias("d")).collect()
    assert [x.h for x in got] == [x.d for x in got] == ["Point", "Point", "LineString", "MultiPolygon", None, None, None, None]


def test_layers_are_styled_by_kind_and_torn_geometries_have_no_vertices(spark):
    ring = F.struct(F.array(*map(F.lit, (0.0, 1.0, 1.0, 0.0))).alias("xs"), F.array(*map(F.lit, (0.0, 0.0, 1.0, 0.0))).alias("ys"))
    rows = [
        ("land_use", 1, "park", "x", None, "Polygon"), ("land_use", 2, "park", "x", None, "LineString"), ("land", 3, "forest", "x", None, "Polygon"), ("water", 4, "river", "x", None, "LineString"),
        ("water", 5, "lake", "x", None, "Polygon"), ("water", 6, "lake", "x", None, "LineString"), ("building", 7, None, None, None, "Polygon"), ("segment", 8, "road", "primary", "A", "LineString"),
        ("segment", 9, "rail", None, "B", "LineString"), ("segment", 10, "road", "primary", "", "LineString"), (None, 11, "park", "x", None, "Polygon"), ("segment", 12, "road", "service", "C", "LineString"),
    ]
    n = spark.createDataFrame(rows, "layer string, id long, subtype string, class string, name string, k string").withColumns({"xmin": F.lit(0.0), "xmax": F.lit(1.0), "ymin": F.lit(0.0), "ymax": F.lit(1.0), "style": F.lit("own")})
    whole = F.when(F.col("k") == "Polygon", geometry.wkb_encode(F.lit("Polygon"), F.array(ring))).otherwise(geometry.wkb_encode(F.lit("LineString"), F.array(ring)))
    n = n.withColumn("geometry", whole)
    torn = n.where("id = 8").withColumns({"id": F.lit(13).cast("long"), "geometry": F.substring("geometry", 1, 12)})
    extent = spark.createDataFrame([(0.5, 2.0, 0.5, 2.0)], "x0 double, x1 double, y0 double, y1 double")
    got = {x.id: (x.style, x.draw_order, x.label, x.n) for x in layers.prepare_layers(n.unionByName(torn), extent).groupBy("id", "style", "draw_order", "label").agg(F.count("*").alias("n")).collect()}
    assert got == {
        1: ("park", None, None, 4), 3: ("green", None, None, 4), 4: ("water line", None, None, 4), 5: ("water area", None, None, 4), 7: ("building", None, None, 4), 8: ("road primary", 7, "A", 4),
        9: ("rail", None, None, 4), 10: ("road primary", 7, None, 4), 12: ("road service", 3, None, 4),
    }


def test_altitudes_over_borders_and_gaps_of_tiles(spark):
    side = 4
    height = lambda gx, gy: 3.0 * gx + 7.0 * gy + gx * gy
    have = [(0, 0), (1, 0), (0, 1)]
    tiles = [(1, x, y, [None if (x, y, k) == (0, 0, 5) else height(x * side + k % side, y * side + k // side) for k in range(side * side)]) for x, y in have]
    points = [(k, a, b) for k, (a, b) in enumerate([(1.5, 2.5), (3.5, 1.25), (3.5, 3.5), (3.0, 3.0), (-5.0, 2.0), (9.0, 0.5), (6.5, 6.5), (1.0, 1.0), (0.5, 0.75)])]

    def plain(px, py):
        px, py = (max(0.0, min(2 * side - 1.0, v)) for v in (px, py))
        v = w = 0.0
        for dx in (0, 1):
            for dy in (0, 1):
                gx, gy = min(int(px) + dx, 2 * side - 1), min(int(py) + dy, 2 * side - 1)
                own = abs(1 - dx - (px - int(px))) * abs(1 - dy - (py - int(py)))
                if own > 0 and (gx // side, gy // side) in have and (gx, gy) != (1, 1):
                    v, w = v + own * height(gx, gy), w + own
        return v / w if w else None

    got = dict(map(tuple, layers.sample_elevation(spark.createDataFrame(points, "pt_id long, px double, py double"), spark.createDataFrame(tiles, "z int, x long, y long, pixels array<double>"), side, 1).collect()))
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 7, 8]  # the seventh lies on a missing tile alone
    for k, a, b in points:
        assert got.get(k) == (pytest.approx(plain(a, b)) if plain(a, b) is not None else None)


def test_a_layer_without_a_folder_has_no_rows(spark, tmp_path):
    box = {c: F.lit(0.5) for c in files.BOX}
    spark.range(3).withColumns({"theme": F.lit("base"), "type": F.lit("land"), "subtype": F.lit("forest"), **box}).write.partitionBy("theme", "type").parquet(f"{tmp_path}/l")
    found = files.scan_layers(spark, f"{tmp_path}/l", (0.0, 1.0, 0.0, 1.0))
    assert {k: f.count() for k, f in found.items()} == {"segment": 0, "water": 0, "land_use": 0, "land": 3, "building": 0}
    assert set(found["building"].columns) == {"id", "subtype", "class", "height", "geometry", *files.BOX}
