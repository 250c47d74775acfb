"""Routes as sequences of arcs: their samples, what steps and edges measure, and which arcs break a grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.functions import geo
from slopeworks.operators import directions, profile

#: Length of the stretches by which samples and steps are joined.
STRETCH_M = 250.0


def assemble_points(arcs: DataFrame, points: DataFrame) -> DataFrame:
    """Samples (track_id, seq, arc_seq, dist_m, elev_m, lon, lat) of routes (route_id, arc_seq, edge_id, fwd, length_m).

    Edge samples run backward where the arc does; the sample that two arcs share is kept once.
    """
    before = Window.partitionBy("route_id").orderBy("arc_seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = arcs.select("route_id", "arc_seq", "edge_id", "fwd", "length_m", F.coalesce(F.sum("length_m").over(before), F.lit(0.0)).alias("_start"))
    n = placed.join(points.withColumnsRenamed({"seq": "_k", "dist_m": "_d"}), "edge_id").withColumn("_k", F.when(F.col("fwd"), F.col("_k")).otherwise(-F.col("_k")))
    n = n.withColumn("_n", F.row_number().over(Window.partitionBy("route_id", "arc_seq").orderBy("_k"))).where("_n > 1 or arc_seq = 0")
    along = F.col("_start") + F.when(F.col("fwd"), F.col("_d")).otherwise(F.col("length_m") - F.col("_d"))
    seq = F.row_number().over(Window.partitionBy("route_id").orderBy("arc_seq", "_k")) - 1
    return n.select(F.col("route_id").alias("track_id"), seq.cast("long").alias("seq"), "arc_seq", along.alias("dist_m"), "elev_m", "lon", "lat")


def edge_metrics(points: DataFrame, window_m: float = 100, threshold: float = 6.0) -> DataFrame:
    """Steepest grade, steep length and gain of every edge both ways, from its samples (edge_id, seq, dist_m, elev_m); backward, an interval starts at its far sample.

    Grades are sorted three times: nothing but what they need goes along.
    """
    graded = profile.windowed_grades(points.select(F.col("edge_id").alias("track_id"), "seq", "dist_m", "elev_m"), window_m)
    n = graded.withColumn("_far", F.lead("grade").over(profile.by_seq()))
    long, climb = F.col("next_dist") - F.col("dist_m"), F.col("next_elev") - F.col("elev_m")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return n.groupBy(F.col("track_id").alias("edge_id")).agg(
        F.max("grade").alias("max_fwd"), (-F.min("grade")).alias("max_bwd"),
        total(F.when(F.col("grade") > threshold, long)).alias("steep_fwd"), total(F.when(-F.col("_far") > threshold, long)).alias("steep_bwd"),
        total(F.greatest(climb, F.lit(0.0))).alias("gain_fwd"), total(F.greatest(-climb, F.lit(0.0))).alias("gain_bwd"),
    )


def step_points(points: DataFrame, steps: DataFrame) -> DataFrame:
    """Samples of every step, both ends included; one that two steps share appears in both.

    Samples and steps meet by stretches of ``STRETCH_M``, so a long route is not a pairing of all its samples with all its steps.
    """
    stretch = lambda c: F.floor(F.col(c) / STRETCH_M)
    s = steps.select(F.col("route_id").alias("_r"), "step_no", "name", "d_start", "d_end", "length_m", F.explode(F.sequence(stretch("d_start"), stretch("d_end"))).alias("_s"))
    same = (F.col("track_id") == F.col("_r")) & (stretch("dist_m") == F.col("_s"))
    return points.join(s, same & F.col("dist_m").between(F.col("d_start"), F.col("d_end"))).drop("_r", "_s")


def step_stats(graded: DataFrame, steps: DataFrame, climb: float = 2.0, steep: float = 6.0) -> DataFrame:
    """Per step the grades' range and the lengths climbing, descending and steep; an interval counts where it starts."""
    by = Window.partitionBy("track_id", "step_no").orderBy("seq")
    n = step_points(graded, steps).withColumns({"_long": F.lead("dist_m").over(by) - F.col("dist_m"), "_up": F.lead("elev_m").over(by) - F.col("elev_m")})
    total = lambda ok, c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0))
    return n.groupBy(F.col("track_id").alias("route_id"), "step_no").agg(
        F.max("grade").alias("max_grade"), F.min("grade").alias("min_grade"), total(F.col("grade") > climb, F.col("_long")).alias("climb_m"),
        total(F.col("_up") > 0, F.col("_up")).alias("gain_m"), total(F.col("grade") < -climb, F.col("_long")).alias("descent_m"), total(F.col("grade") > steep, F.col("_long")).alias("steep_m"),
    )


def turn_bearings(points: DataFrame, steps: DataFrame, reach_m: float = 30.0) -> DataFrame:
    """Entry and exit azimuth of every step over its first and last ``reach_m``, and the turn from the step before (null for the first)."""
    by_all, by = Window.partitionBy("track_id").orderBy("seq"), Window.partitionBy("track_id", "step_no")
    here = F.struct("seq", "lon", "lat")
    n = points.withColumn("_after", F.lead(here).over(by_all)).withColumn("_before", F.lag(here).over(by_all))
    n = step_points(n, steps).withColumns({"_d0": F.min("dist_m").over(by), "_d1": F.max("dist_m").over(by), "_i0": F.min("seq").over(by)})
    s = n.groupBy(F.col("track_id").alias("route_id"), "step_no").agg(
        F.min(here).alias("a"), F.max(here).alias("z"), F.max(F.when(F.col("dist_m") - F.col("_d0") < reach_m, here)).alias("near"), F.min_by("_after", "seq").alias("second"),
        F.min(F.when((F.col("seq") > F.col("_i0")) & (F.col("_d1") - F.col("dist_m") < reach_m), here)).alias("far"), F.max_by("_before", "seq").alias("last"),
    )
    # At least one interval is looked at, even if it is longer than the reach.
    s = s.withColumn("near", F.when(F.col("near.seq") > F.col("a.seq"), F.col("near")).otherwise(F.coalesce("second", "a")))
    s = s.withColumn("far", F.when(F.col("far.seq") < F.col("z.seq"), F.col("far")).when(F.col("z.seq") > F.col("a.seq"), F.col("last")))
    azimuth = lambda p, q: geo.bearing(F.col(f"{p}.lon"), F.col(f"{p}.lat"), F.col(f"{q}.lon"), F.col(f"{q}.lat"))
    s = s.withColumn("entry", azimuth("a", "near")).withColumn("exit", F.coalesce(F.when(F.col("far").isNotNull(), azimuth("far", "z")), F.col("entry")))
    delta = directions.wrap(F.col("entry") - F.lag("exit").over(Window.partitionBy("route_id").orderBy("step_no")))
    return s.select("route_id", "step_no", "entry", "exit", delta.alias("delta"))


def violation_runs(graded: DataFrame, arcs: DataFrame, cap: float, tolerance: float = 0.05) -> DataFrame:
    """(route_id, run, arc_seq, run_max): per run of samples above ``cap`` the arcs to blame.

    These are the arcs it touches whose own mean grade (``mean_grade`` of route_id, arc_seq) is above the cap, else the steepest of them.
    """
    over = F.col("grade") > cap + tolerance
    started = over & ~F.coalesce(F.lag("grade").over(profile.by_seq()) > cap + tolerance, F.lit(False))
    runs = graded.withColumn("run", F.sum(started.cast("long")).over(profile.by_seq())).where(over)
    touched = runs.groupBy(F.col("track_id").alias("route_id"), "run", "arc_seq").agg(F.max("grade").alias("_g")).join(arcs.select("route_id", "arc_seq", "mean_grade"), ["route_id", "arc_seq"])
    by = Window.partitionBy("route_id", "run")
    judged = touched.withColumns({"run_max": F.max("_g").over(by), "_rank": F.row_number().over(by.orderBy(F.desc("mean_grade"), "arc_seq"))})
    return judged.where((F.col("mean_grade") > cap) | (F.col("_rank") == 1)).select("route_id", "run", "arc_seq", "run_max")


def detour_pct(routes: DataFrame) -> DataFrame:
    """``routes`` (req_id, tier, length_m) with the detour over the request's reference: its tier of 0 or less, else its shortest."""
    by = Window.partitionBy("req_id")
    base = F.coalesce(F.max(F.when(F.col("tier") <= 0, F.col("length_m"))).over(by), F.min("length_m").over(by))
    return routes.withColumn("reference_m", base).withColumn("detour_pct", (F.col("length_m") / F.col("reference_m") - 1) * 100)


def tier_label(tier: Column) -> Column:
    return F.when(tier <= 0, F.lit("+0 % (trajet le plus court)")).otherwise(F.format_string("+%d %% de détour", tier))


def tier_slug(tier: Column) -> Column:
    return F.format_string("variante_+%02dpct", tier)


def cut_lines(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """(edge_id, pos_deg, lon, lat) of pieces (line_id, edge_id, from_at, to_at) of lines (line_id, seq, lon, lat): what ``line_substring`` gives for each, in one sweep along a line.

    Pieces of a line do not overlap. A line's vertices and cuts are sorted once; a cut takes the
    stretch it falls in from the vertex before it, a vertex its piece from the cut before it. There
    are as many rows as vertices and twice the pieces. A line without length has none.
    """
    by = Window.partitionBy("line_id").orderBy("seq")
    n = points.withColumns({"_lon": F.lead("lon").over(by), "_lat": F.lead("lat").over(by)})
    n = n.withColumn("_l", F.coalesce(F.sqrt(F.pow(F.col("_lon") - F.col("lon"), 2) + F.pow(F.col("_lat") - F.col("lat"), 2)), F.lit(0.0)))
    n = n.withColumn("_s", F.coalesce(F.sum("_l").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    none = lambda t: F.lit(None).cast(t)
    stretch = F.struct("lon", "lat", F.col("_lon").alias("lon2"), F.col("_lat").alias("lat2"), F.col("_s").alias("s"), F.col("_l").alias("l"))
    vertices = n.select("line_id", F.col("_s").alias("pos"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("n"), stretch.alias("on"), none("struct<edge_id:bigint,a:double,b:double>").alias("piece"))
    total = n.groupBy("line_id").agg(F.sum("_l").alias("t")).where("t > 0")
    a, b = F.col("from_at") * F.col("t"), F.col("to_at") * F.col("t")
    piece = F.struct(F.col("edge_id").cast("long").alias("edge_id"), a.alias("a"), b.alias("b"))
    # At one place a piece ends before the next one begins.
    ends = F.explode(F.array(F.struct(b.alias("pos"), F.lit(1).alias("kind")), F.struct(a.alias("pos"), F.lit(2).alias("kind"))))
    cuts = pieces.join(total, "line_id").withColumns({"_p": piece, "_e": ends}).select("line_id", "_e.pos", "_e.kind", F.col("edge_id").cast("long").alias("n"), none(vertices.schema["on"].dataType.simpleString()).alias("on"), F.col("_p").alias("piece"))
    along = Window.partitionBy("line_id").orderBy("pos", "kind", "n").rowsBetween(Window.unboundedPreceding, 0)
    length = F.max(F.when(F.col("kind") == 0, F.col("pos"))).over(Window.partitionBy("line_id"))
    swept = vertices.unionByName(cuts).withColumns({
        "_on": F.last("on", ignorenulls=True).over(along), "_in": F.last(F.when(F.col("kind") == 2, F.col("piece")), ignorenulls=True).over(along), "_t": length,
    })
    inner = (F.col("kind") == 0) & (F.col("pos") > F.col("_in.a") + 1e-12 * F.col("_t")) & (F.col("pos") < F.col("_in.b") - 1e-12 * F.col("_t"))
    share = F.when(F.col("_on.l") > 0, (F.col("pos") - F.col("_on.s")) / F.col("_on.l")).otherwise(0.0)
    point = lambda c: F.col(f"_on.{c}") + F.coalesce((F.col(f"_on.{c}2") - F.col(f"_on.{c}")) * share, F.lit(0.0))
    kept = swept.where(F.coalesce(inner, F.lit(False)) | ((F.col("kind") > 0) & F.col("_on").isNotNull()))
    return kept.select(F.coalesce("piece.edge_id", "_in.edge_id").alias("edge_id"), F.col("pos").alias("pos_deg"), point("lon").alias("lon"), point("lat").alias("lat"))


def line_substring(points: DataFrame, a: Column, b: Column) -> DataFrame:
    """The piece of every line (line_id, seq, lon, lat) between positions ``a`` and ``b`` of its planar length: (line_id, pos_deg, lon, lat). A line without length has none."""
    by = Window.partitionBy("line_id").orderBy("seq")
    n = points.withColumns({"_lon": F.lead("lon").over(by), "_lat": F.lead("lat").over(by)})
    n = n.withColumn("_l", F.coalesce(F.sqrt(F.pow(F.col("_lon") - F.col("lon"), 2) + F.pow(F.col("_lat") - F.col("lat"), 2)), F.lit(0.0)))
    n = n.withColumn("_s", F.coalesce(F.sum("_l").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_t", F.sum("_l").over(Window.partitionBy("line_id"))).where("_t > 0")
    # A cut lies on the stretch it falls in; at the line's end it is the last vertex, which has no stretch.
    on = lambda x: F.when((x >= F.col("_s")) & ((x < F.col("_s") + F.col("_l")) | F.col("_lon").isNull()), x)
    slack = 1e-12 * F.col("_t")
    inner = F.when((F.col("_s") > a * F.col("_t") + slack) & (F.col("_s") < b * F.col("_t") - slack), F.col("_s"))
    cut = n.withColumn("pos_deg", F.explode(F.array_compact(F.array(inner, on(a * F.col("_t")), on(b * F.col("_t")))))).withColumn("_f", F.when(F.col("_l") > 0, (F.col("pos_deg") - F.col("_s")) / F.col("_l")).otherwise(0.0))
    point = lambda c: F.col(c) + F.coalesce((F.col(f"_{c}") - F.col(c)) * F.col("_f"), F.lit(0.0))
    return cut.select("line_id", "pos_deg", point("lon").alias("plon"), point("lat").alias("plat")).withColumnsRenamed({"plon": "lon", "plat": "lat"})
