"""Street lines by hand: turned pieces, branches, rings, equal names apart."""

from slopeworks.operators import streets

A, B, C, D, E = (0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (2.0, 1.0)


def merged(spark, rows):
    df = spark.createDataFrame([(i, n, c, [p[0] for p in v], [p[1] for p in v]) for i, n, c, v in rows], "piece_id long, name string, class string, xs array<double>, ys array<double>")
    return {(x.name, x.line_id): (x["class"], x.pieces, list(zip(x.xs, x.ys))) for x in streets.street_merge(df).collect()}


def test_turned_pieces_and_names(spark):
    got = merged(spark, [(1, "a", "x", [B, A]), (2, "a", "y", [B, C]), (3, "a", "y", [D, C]), (4, "b", "z", [D, E]), (5, None, "z", [A, B]), (6, "c", "z", [A])])
    assert got == {("a", 1): ("x", 3, [A, B, C, D]), ("b", 4): ("z", 1, [D, E])}


def test_branch_ends_lines(spark):
    got = merged(spark, [(1, "a", "x", [A, B]), (2, "a", "x", [B, C]), (3, "a", "x", [C, D]), (4, "a", "x", [C, E])])
    assert got == {("a", 1): ("x", 2, [A, B, C]), ("a", 3): ("x", 1, [C, D]), ("a", 4): ("x", 1, [C, E])}


def test_ring_twins_and_self_ring(spark):
    got = merged(spark, [(1, "a", "x", [A, B]), (2, "a", "x", [B, E]), (3, "a", "x", [E, A]), (4, "b", "x", [A, B]), (5, "b", "x", [A, B]), (6, "c", "x", [A, B, E, A])])
    assert {k: v[1] for k, v in got.items()} == {("a", 1): 3, ("b", 4): 2, ("c", 6): 1}
    assert got["a", 1][2] == [A, B, E, A] and got["c", 6][2] == [A, B, E, A]


def test_long_street_and_empty(spark):
    n = 300
    rows = [((i * 7919) % n, "a", "x", [(float(i), 0.0), (float(i + 1), 0.0)]) for i in range(n)]
    got = merged(spark, rows)
    assert list(got) == [("a", 0)] and got["a", 0][1] == n and sorted(got["a", 0][2]) == [(float(i), 0.0) for i in range(n + 1)]
    assert merged(spark, []) == {}


def test_a_street_of_many_pieces_by_jumps(spark, monkeypatch):
    """10^5 pieces in one line and a ring of 1,000, turned at random: every vertex at its place, in some 17 rounds."""
    from pyspark.sql import functions as F

    n, m = 100_000, 1_000
    k = spark.range(n + m)
    on, at = F.col("id") < n, F.when(F.col("id") < n, F.col("id")).otherwise(F.col("id") - n).cast("double")
    ring = F.when(on, at + 1).otherwise(F.pmod(at + 1, F.lit(float(m))))
    turned = F.xxhash64("id") % 2 == 0
    xs = F.when(turned, F.array(ring, at)).otherwise(F.array(at, ring))
    y = F.when(on, 0.0).otherwise(1.0)
    pieces = k.select(F.pmod(F.col("id") * 7919, F.lit(1_000_003)).alias("piece_id"), F.lit("a").alias("name"), F.lit("x").alias("class"), xs.alias("xs"), F.array(y, y).alias("ys"))
    rounds = []
    own = streets.written
    monkeypatch.setattr(streets, "written", lambda df: rounds.append(1) or own(df))
    got = streets.line_vertices(pieces)
    line = got.where("y = 0").agg(F.count("*").alias("n"), F.countDistinct("first").alias("lines"), F.max(F.abs(F.col("x") - F.col("seq"))).alias("up"), F.max(F.abs(n - F.col("x") - F.col("seq"))).alias("down")).first()
    assert (line.n, line.lines) == (n + 1, 1) and 0 in (line.up, line.down)
    around = [r.x for r in got.where("y = 1").orderBy("seq").collect()]
    assert len(around) == m + 1 and around[0] == around[-1] and {abs(a - b) for a, b in zip(around, around[1:])} == {1.0, m - 1.0}
    assert len(rounds) < 50
