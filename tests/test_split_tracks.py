"""A track of many chunks against the same track as one."""

import random

import pytest
from pyspark.sql import functions as F

from slopeworks.operators import profile, routes


def tracks(spark, seed=1):
    """One track with a third of all rows, one with long gaps, one with samples in one place, one sample alone, and short ones."""
    rng = random.Random(seed)
    rows = []

    def add(track, steps):
        at, up = 0.0, 0.0
        for k, d in enumerate(steps):
            at, up = at + d, up + rng.uniform(-1, 1) * max(d, 1) * 0.12
            rows.append((track, k, at, up, "x"))

    add(1, [rng.choice([0.5, 3, 7, 12]) for _ in range(900)])
    add(2, [rng.choice([1, 5, 350, 900]) for _ in range(300)])
    add(3, [rng.choice([0, 0, 0, 10]) for _ in range(300)])
    add(4, [17.0])
    for t in range(10, 40):
        add(t, [rng.choice([5, 20]) for _ in range(40)])
    return spark.createDataFrame(rows, "track_id long, seq long, dist_m double, elev_m double, `a.b` string").repartition(5)


def told(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.na.fill(-1.0).collect())


@pytest.mark.parametrize("window", [100, 7.5, 900])
def test_chunks_change_no_grade(spark, window):
    points = tracks(spark)
    whole = told(profile.windowed_grades(points, window, chunk_m=1e9))
    assert len(whole) == points.count() and told(profile.windowed_grades(points, window, chunk_m=150.0)) == whole


def test_chunks_change_no_run(spark):
    graded = profile.windowed_grades(tracks(spark), 30)
    whole = told(profile.islands(graded, 2.0, 1e9))
    assert told(profile.islands(graded, 2.0, 60.0)) == whole and told(profile.islands(graded, 2.0, 5.0)) == whole
    # Runs in order of their track, as the samples have them.
    rows = sorted((r.track_id, r.seq, r.dist_m, r.grade) for r in graded.collect())
    want, last = [], None
    for track, _, at, grade in rows:
        if grade > 2.0:
            if last == (track, True):
                want[-1][2] = at
            else:
                want.append([track, at, at])
        last = (track, grade > 2.0)
    assert [[r[0], r[2], r[3]] for r in whole] == [[t, round(a, 6), round(b, 6)] for t, a, b in want] and len(want) > 50


def test_no_key_holds_more_than_a_chunk_and_what_is_around(spark):
    cut = profile._chunked(tracks(spark), 50.0, 200.0)
    most = cut.where("track_id = 1").groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert most < 900 / 8 and cut.where("track_id = 1 and _own").count() == 900


def test_edges_carry_no_places_through_the_sorts(spark):
    points = spark.range(60).selectExpr("id div 6 as edge_id", "id % 6 as seq", "id % 6 * 10D as dist_m", "id * 7 % 5 * 1D as elev_m", "id * 1D as lon", "id * 2D as lat")
    got = routes.edge_metrics(points)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "lon#" not in plan and "lat#" not in plan
    # Tasks of the sorts are as many as asked for, not merged by their few bytes.
    assert "RepartitionByExpression [track_id" in plan and got.count() == 10


def test_only_tracks_of_several_chunks_are_asked_for_their_ends(spark):
    points = spark.range(60).selectExpr("id div 6 as track_id", "id % 6 as seq", "id % 6 * 10D as dist_m", "id * 7 % 5 * 1D as elev_m")
    got = profile.windowed_grades(points)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 60
