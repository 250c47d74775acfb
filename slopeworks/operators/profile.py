"""Distance-altitude tracks (track_id, seq, dist_m, elev_m): window grade, steep stretches, gain, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slopeworks.functions.geo import speed


def track() -> WindowSpec:
    return Window.partitionBy("track_id")


def by_seq() -> WindowSpec:
    return track().orderBy("seq")


def with_next(points: DataFrame) -> DataFrame:
    """The distance and altitude of the next sample; null at a track's end."""
    return points.withColumns({"next_dist": F.lead("dist_m").over(by_seq()), "next_elev": F.lead("elev_m").over(by_seq())})


def segment_grades(points: DataFrame) -> DataFrame:
    """Slope in percent of each interval, no shorter than a micrometre."""
    n = with_next(points).where("next_dist is not null")
    return n.select("track_id", "seq", (100 * (F.col("next_elev") - F.col("elev_m")) / F.greatest(F.col("next_dist") - F.col("dist_m"), F.lit(1e-6))).alias("grade"))


#: Metres of a track that meet in one task.
CHUNK_M = 20_000.0


def _chunked(points: DataFrame, half: float, chunk_m: float) -> DataFrame:
    """``points`` by ``_chunk`` of their track, a chunk's own ones (``_own``) with those half a window around it and the nearest one beyond on either side.

    No key holds more than a chunk and its surroundings, however long the track; what is known of
    a whole track at once is a row per chunk.
    """
    # Half a window reaches no farther than the neighbouring chunk.
    size = max(chunk_m, half)
    chunk = F.floor(F.col("dist_m") / size)
    placed = points.withColumn("_chunk", chunk).withColumn("_x", F.col("dist_m") - F.col("_chunk") * size)
    at = lambda d, own: F.struct((F.col("_chunk") + d).alias("c"), F.lit(own).alias("own"))
    to = F.array_compact(F.array(at(0, True), F.when(F.col("_x") <= half, at(-1, False)), F.when(F.col("_x") > size - half, at(1, False))))
    near = placed.withColumn("_to", F.explode(to)).select(*[F.col(f"`{c}`") for c in points.columns], F.col("_to.c").alias("_chunk"), F.col("_to.own").alias("_own"))
    sample = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    # A track that is all in chunk 0 has no chunk beside it.
    split = placed.where((F.col("dist_m") >= size) | (F.col("dist_m") < 0) | F.col("dist_m").isNull()).select("track_id").distinct()
    ends = placed.join(split, "track_id", "left_semi").groupBy("track_id", "_chunk").agg(
        F.max_by(F.when(F.col("_x") <= size - half, sample), F.when(F.col("_x") <= size - half, F.col("seq"))).alias("inner_last"), F.max_by(sample, "seq").alias("last"),
        F.min_by(F.when(F.col("_x") > half, sample), F.when(F.col("_x") > half, F.col("seq"))).alias("inner_first"), F.min_by(sample, "seq").alias("first"),
    )
    along = Window.partitionBy("track_id").orderBy("_chunk")
    beside = lambda step, inner, end: F.when(step("_chunk").over(along) == F.col("_chunk") + (1 if step is F.lead else -1), F.coalesce(step(inner).over(along), step(end, 2).over(along))).otherwise(step(end).over(along))
    beyond = ends.withColumn("_beside", F.array(beside(F.lag, "inner_last", "last"), beside(F.lead, "inner_first", "first"))).withColumn("_s", F.explode(F.array_compact("_beside")))
    return near.unionByName(beyond.select(*[F.col(f"_s.`{c}`").alias(c) for c in points.columns], "_chunk", F.lit(False).alias("_own")))


def _graded(points: DataFrame, window_m: float, min_len_m: float, chunk_m: float) -> DataFrame:
    """``windowed_grades`` with ``_chunk``."""
    half = window_m / 2
    # Frames take whole bounds: distances are doubled, or told in half millimetres where the window is no whole number.
    unit = 2 if float(window_m).is_integer() else 2000
    part = Window.partitionBy("track_id", "_chunk")
    reach, by_dist, in_order = round(half * unit), part.orderBy(F.col("dist_m") * unit), part.orderBy("seq")
    sample = F.struct("dist_m", "elev_m", "next_dist", "next_elev")
    # A number of partitions asked for is kept: samples take little in files and much in sorts, so tasks are not to be merged by bytes.
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # What goes by the order is taken first: the widest rows are sorted once.
    n = _chunked(points, half, chunk_m).repartition(parts, "track_id", "_chunk").withColumns({
        "next_dist": F.lead("dist_m").over(in_order), "next_elev": F.lead("elev_m").over(in_order), "_first": F.first(F.struct("dist_m", "elev_m")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
    }).withColumns({
        "_lo": F.max_by(sample, "seq").over(by_dist.rangeBetween(Window.unboundedPreceding, -reach)),
        "_hi": F.max_by(sample, "seq").over(by_dist.rangeBetween(Window.unboundedPreceding, reach)),
    }).where("_own")

    def at(s: Column, x: Column) -> Column:
        inside = s["elev_m"] + (s["next_elev"] - s["elev_m"]) * (x - s["dist_m"]) / (s["next_dist"] - s["dist_m"])
        return F.when(s["next_dist"].isNull() | (s["next_dist"] <= s["dist_m"]), s["elev_m"]).otherwise(inside)

    lo_x = F.greatest(F.col("dist_m") - half, F.col("_first.dist_m"))
    hi_x = F.when(F.col("_hi.next_dist").isNull(), F.col("_hi.dist_m")).otherwise(F.col("dist_m") + half)
    lo = F.when(F.col("_lo").isNull(), F.col("_first.elev_m")).otherwise(at(F.col("_lo"), lo_x))
    grade = 100 * (at(F.col("_hi"), hi_x) - lo) / F.greatest(hi_x - lo_x, F.lit(float(min_len_m)))
    return n.withColumn("grade", grade).drop("_lo", "_hi", "_first", "_own")


def windowed_grades(points: DataFrame, window_m: float = 100, min_len_m: float = 1, chunk_m: float = CHUNK_M) -> DataFrame:
    """``points`` with next_dist, next_elev and the slope over a window centred on each sample, cut at the track's ends.

    Distances do not fall along a track. Only frames that grow with the distance are used, so a
    chunk costs one sort; a track is as many tasks as it has chunks.
    """
    return _graded(points, window_m, min_len_m, chunk_m).drop("_chunk")


def islands(graded: DataFrame, above: float, chunk_m: float = CHUNK_M) -> DataFrame:
    """(track_id, run, start_m, end_m, max_grade, samples) of the maximal runs of samples steeper than ``above``, numbered along their track.

    Runs are found chunk by chunk; a run that is open at a chunk's end is one with that which the
    next chunk begins with.
    """
    cut = graded if "_chunk" in graded.columns else graded.withColumn("_chunk", F.floor(F.col("dist_m") / chunk_m))
    part = Window.partitionBy("track_id", "_chunk").orderBy("seq")
    steep = F.coalesce(F.col("grade") > above, F.lit(False))
    started = steep & ~F.coalesce(F.lag("grade").over(part) > above, F.lit(False))
    local = cut.select("track_id", "_chunk", "seq", "dist_m", "grade", steep.alias("_steep"), F.sum(started.cast("long")).over(part).alias("_run"))
    # A row per run of a chunk, and one (run 0 or not steep) for what lies between.
    runs = local.groupBy("track_id", "_chunk", F.when(F.col("_steep"), F.col("_run")).alias("_run")).agg(
        F.min("dist_m").alias("start_m"), F.max("dist_m").alias("end_m"), F.max("grade").alias("max_grade"), F.count("*").alias("samples"), F.min("seq").alias("_from"), F.max("seq").alias("_to")
    )
    ends = runs.groupBy("track_id", "_chunk").agg(
        F.count("_run").alias("_runs"), F.min_by(F.col("_run").isNotNull(), "_from").alias("_begins"), F.max_by(F.col("_run").isNotNull(), "_to").alias("_open")
    )
    along = Window.partitionBy("track_id").orderBy("_chunk")
    goes_on = (F.col("_begins") & F.coalesce(F.lag("_open").over(along), F.lit(False))).cast("long")
    ends = ends.withColumn("_on", goes_on).select(
        "track_id", "_chunk",
        (F.coalesce(F.sum("_runs").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("_on").over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("_before"),
    )
    whole = runs.where("_run is not null").join(ends, ["track_id", "_chunk"]).withColumn("run", F.col("_before") + F.col("_run"))
    return whole.groupBy("track_id", "run").agg(F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"), F.max("max_grade").alias("max_grade"), F.sum("samples").alias("samples"))


def elevation_gain_loss(points: DataFrame) -> DataFrame:
    d = F.col("next_elev") - F.col("elev_m")
    return with_next(points).groupBy("track_id").agg(
        F.coalesce(F.sum(F.greatest(d, F.lit(0.0))), F.lit(0.0)).alias("gain_m"), F.coalesce(F.sum(F.greatest(-d, F.lit(0.0))), F.lit(0.0)).alias("loss_m")
    )


def track_metrics(points: DataFrame, window_m: float = 100, threshold: float = 6.0) -> DataFrame:
    """One row per track: length, steepest grade, steep length, gain, loss, riding time and harshness. One sort by chunks of tracks serves all."""
    graded = _graded(points, window_m, 1, CHUNK_M)
    length, climb = F.col("next_dist") - F.col("dist_m"), F.col("next_elev") - F.col("elev_m")
    hard = length * F.pow(F.greatest(F.col("grade"), F.lit(0.0)) / threshold, 3)
    time = F.when(length > 0, length / speed(climb / length))
    metrics = graded.groupBy("track_id").agg(
        (F.max("dist_m") - F.min("dist_m")).alias("length_m"),
        F.greatest(F.max("grade"), F.lit(0.0)).alias("max_grade_pct"),
        F.coalesce(F.sum(F.greatest(climb, F.lit(0.0))), F.lit(0.0)).alias("gain_m"),
        F.coalesce(F.sum(F.greatest(-climb, F.lit(0.0))), F.lit(0.0)).alias("loss_m"),
        F.coalesce(F.sum(time), F.lit(0.0)).alias("time_s"),
        F.coalesce(F.sum(hard), F.lit(0.0)).alias("harshness"),
    )
    steep = islands(graded, threshold).groupBy("track_id").agg(F.sum(F.col("end_m") - F.col("start_m")).alias("steep_len_m"))
    return metrics.join(steep, "track_id", "left").fillna(0.0, ["steep_len_m"])


def steepest_point(graded: DataFrame) -> DataFrame:
    return graded.groupBy("track_id").agg(F.max_by(F.struct("seq", "dist_m", "grade"), F.struct("grade", -F.col("seq"))).alias("p")).select("track_id", "p.*")


def milestones(points: DataFrame, first_m: float = 400, every_m: float = 800, end_gap_m: float = 200) -> DataFrame:
    """The first sample at or after each mark, as long as the mark is clear of the end: an as-of by bucket, no join."""
    n = points.withColumns({"_before": F.lag("dist_m").over(by_seq()), "_length": F.max("dist_m").over(track())})
    passed = n.withColumn("_b", F.greatest(F.floor((F.col("dist_m") - first_m) / every_m) + 1, F.lit(0)))
    # Marks m with before < m <= dist.
    lo = F.when(F.col("_before").isNull(), F.lit(0)).otherwise(F.greatest(F.floor((F.col("_before") - first_m) / every_m) + 1, F.lit(0)))
    marks = passed.withColumn("k", F.explode(F.when(F.col("_b") > lo, F.sequence(lo, F.col("_b") - 1)).otherwise(F.array().cast("array<bigint>"))))
    return marks.withColumn("mark_m", (first_m + F.col("k") * every_m).cast("double")).where(F.col("mark_m") < F.col("_length") - end_gap_m).select("track_id", "mark_m", "seq", "dist_m")


def smooth(edges: DataFrame, smooth_m: float = 30) -> DataFrame:
    """``edges`` (dist, elev arrays) with elev as moving mean over k samples, k = smooth_m over the median spacing; ends repeat; nested, so no shuffle."""
    n = F.size("dist")
    gaps = F.array_sort(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get("dist", i + 1) - F.get("dist", i)))
    middle = F.transform(F.array(gaps), lambda g: (F.get(g, F.floor((F.size(g) - 1) / 2).cast("int")) + F.get(g, F.floor(F.size(g) / 2).cast("int"))) / 2)[0]
    k = F.bround(smooth_m / F.greatest(middle, F.lit(0.1))).cast("int")

    def mean(i: Column, k: Column) -> Column:
        of = F.sequence(i - F.floor(k / 2).cast("int"), i - F.floor(k / 2).cast("int") + k - 1)
        return F.aggregate(of, F.lit(0.0), lambda a, j: a + F.get("elev", F.greatest(F.lit(0), F.least(n - 1, j)))) / k

    averaged = F.transform(F.array(k), lambda k: F.when(k > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: mean(i, k))).otherwise(F.col("elev")))[0]
    return edges.withColumn("elev", F.when(n >= 3, averaged).otherwise(F.col("elev")))


def bridge(edges: DataFrame, flag: str = "bridged") -> DataFrame:
    """Where ``flag`` holds, altitudes on the straight line between the piece's ends."""
    a, b, d0, d1 = F.get("elev", F.lit(0)), F.element_at("elev", -1), F.get("dist", F.lit(0)), F.element_at("dist", -1)
    line = F.transform("dist", lambda d: a + (b - a) * (d - d0) / F.greatest(d1 - d0, F.lit(1e-9)))
    return edges.withColumn("elev", F.when(F.col(flag), line).otherwise(F.col("elev")))
