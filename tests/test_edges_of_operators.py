"""Windows of any width and elevations beside a missing tile."""

import numpy as np
from pyspark.sql import functions as F

from slopeworks.operators import layers, profile


def plain_grades(x, z, window):
    lo, hi = np.maximum(x - window / 2, x[0]), np.minimum(x + window / 2, x[-1])
    return 100 * (np.interp(hi, x, z) - np.interp(lo, x, z)) / np.maximum(hi - lo, 1.0)


def test_windows_of_odd_and_broken_width(spark):
    x, z = np.cumsum([0.0, 3, 5, 4, 8, 12, 1, 2, 9, 7, 6, 11]), np.array([0.0, 1, 3, 2, 2, 5, 4, 4, 8, 6, 7, 7])
    points = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, z, strict=True))], "track_id long, seq long, dist_m double, elev_m double")
    for window in (24, 25, 7, 12.5, 100):
        got = [r.grade for r in profile.windowed_grades(points, window).orderBy("seq").collect()]
        assert np.allclose(got, plain_grades(x, z, window)), window


def test_elevation_beside_a_missing_tile(spark):
    tiles = spark.createDataFrame([(14, x, y, [10.0] * 16) for x, y in ((0, 0), (2, 0), (0, 1), (1, 1), (2, 1))], "z int, x long, y long, pixels array<double>")
    asked = spark.createDataFrame([(1, 3.5, 1.0), (2, 4.0, 3.5), (3, 1.0, 1.0), (4, 5.0, 1.0)], "pt_id long, px double, py double")
    got = {r.pt_id: r.elev_m for r in layers.sample_elevation(asked, tiles, 4, 14).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 10.0}  # the fourth has no tile at all


def test_labels_rank_by_importance_length_and_name(spark):
    rows = [(k, 0, f"n{k % 3}", k % 2, 10.0 + k, 100.0) for k in range(12)] + [(99, 0, "short", 9, 1.0, 100.0)]
    lines = spark.createDataFrame(rows, "line_id long, map_id int, name string, importance int, length_m double, span_m double")
    got = [r.line_id for r in layers.label_candidates(lines, most=5).orderBy("rank").collect()]
    assert got == [11, 9, 7, 5, 3]
    assert layers.label_candidates(lines.where(F.lit(False))).count() == 0


def test_several_extents_are_an_error(spark):
    import pytest

    from slopeworks.operators import layers

    box = "x0 double, x1 double, y0 double, y1 double"
    features = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 5.0, 6.0, 5.0, 6.0)], f"id long, {box}")
    extents = [(0.0, 2.0, 0.0, 2.0), (4.0, 7.0, 4.0, 7.0)]
    of = lambda rows: [r.id for r in layers.extent_filter(features, spark.createDataFrame(rows, box)).collect()]
    assert of(extents[:1]) == [1] and of(extents[1:]) == [2] and of([]) == []
    with pytest.raises(ValueError, match="one extent"):
        of(extents)
