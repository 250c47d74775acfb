"""Turn-by-turn steps from the named arcs of routes (route_id, seq, name, road_class, length_m)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slopeworks.functions import geo

# What stands for a missing street name, by road class.
CLASS_LABEL = {
    "cycleway": "piste cyclable", "service": "voie de service", "path": "chemin", "footway": "allée", "pedestrian": "voie piétonne", "track": "chemin",
    "living_street": "zone de rencontre", "residential": "rue sans nom", "unclassified": "voie sans nom", "tertiary": "voie sans nom",
    "secondary": "voie sans nom", "primary": "voie sans nom", "unknown": "voie sans nom",
}
#: Unnamed groups shorter than this join the step before.
SHORT_M = 25.0


def route() -> WindowSpec:
    return Window.partitionBy("route_id").orderBy("seq")


def label_lookup(arcs: DataFrame) -> DataFrame:
    """``arcs`` with the shown ``label``: the name, else the class's label, else the default."""
    labels = F.create_map(*[F.lit(x) for c in CLASS_LABEL.items() for x in c])
    return arcs.withColumn("label", F.coalesce(F.nullif(F.col("name"), F.lit("")), labels[F.col("road_class")], F.lit("voie sans nom")))


def route_offsets(arcs: DataFrame) -> DataFrame:
    return arcs.withColumn("start_m", F.coalesce(F.sum("length_m").over(route().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def step_groups(arcs: DataFrame) -> DataFrame:
    """Consecutive arcs of one label: (route_id, grp, label, named, start_m, end_m)."""
    n = route_offsets(label_lookup(arcs)).withColumn("_new", (~F.col("label").eqNullSafe(F.lag("label").over(route()))).cast("long"))
    return n.withColumn("grp", F.sum("_new").over(route())).groupBy("route_id", "grp").agg(
        F.first("label").alias("label"), F.min_by(F.col("name").isNotNull(), "seq").alias("named"), F.min("start_m").alias("start_m"), F.max(F.col("start_m") + F.col("length_m")).alias("end_m")
    )


def steps(arcs: DataFrame) -> DataFrame:
    """Groups merged: short unnamed ones join the step before, equal labels in a row are one step."""
    by = Window.partitionBy("route_id").orderBy("grp")
    short = (F.col("end_m") - F.col("start_m") < SHORT_M) & ~F.col("named")
    n = step_groups(arcs).withColumn("_kept", (F.row_number().over(by) == 1) | ~short)
    n = n.withColumn("_last", F.last(F.when(F.col("_kept"), F.col("label")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    n = n.withColumn("step_no", F.sum((F.col("_kept") & ~F.col("label").eqNullSafe(F.col("_last"))).cast("long")).over(by))
    return n.groupBy("route_id", "step_no").agg(
        F.min_by("label", "grp").alias("name"), F.min("start_m").alias("d_start"), F.max("end_m").alias("d_end"), (F.max("end_m") - F.min("start_m")).alias("length_m")
    )


# Fixed values, here and in step_notes and directions_text: the sheet's words.
def turn_word(delta: Column) -> Column:
    size, side = F.abs(delta), F.when(delta > 0, "droite").otherwise("gauche")
    return (
        F.when(size < 25, F.lit("Continuer tout droit sur"))
        .when(size < 60, F.concat(F.lit("Légèrement à "), side, F.lit(" sur")))
        .when(size < 135, F.concat(F.lit("Tourner à "), side, F.lit(" sur")))
        .otherwise(F.concat(F.lit("Faire demi-tour (virage serré à "), side, F.lit(") sur")))
    )


def wrap(delta: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(delta + 180.0, F.lit(360.0)) - 180.0


def step_notes(stats: DataFrame, threshold: float = 6.0) -> DataFrame:
    """``stats`` (as from step_stats) with ``notes``: a climb of 40 m or more that reaches 2 %, and a descent of 40 m or more."""
    whole, tenth = lambda c: F.format_string("%.0f", F.bround(c)), lambda c: F.format_string("%.1f", F.bround(c, 1))
    steep = F.when(F.col("steep_m") > 0, F.concat(F.lit(", dont "), whole("steep_m"), F.lit(f" m à plus de {threshold:g} %"))).otherwise("")
    climb = F.concat(F.lit("montée sur "), geo.distance_text(F.col("climb_m")), F.lit(" (+"), whole("gain_m"), F.lit(" m), pente max "), tenth("max_grade"), F.lit(" %"), steep)
    descent = F.concat(F.lit("descente sur "), geo.distance_text(F.col("descent_m")), F.lit(" (pente min "), tenth("min_grade"), F.lit(" %)"))
    return stats.withColumn("notes", F.array_compact(F.array(F.when((F.col("climb_m") >= 40) & (F.col("max_grade") >= 2.0), climb), F.when(F.col("descent_m") >= 40, descent))))


def directions_text(steps: DataFrame, totals: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(route_id, line_no, line): departure, every step (route_id, step_no, name, length_m, delta, notes), arrival with the route's totals.

    ``ends`` (route_id, start_name, end_name) names departure and arrival; a route or name that is not there goes unnamed.
    Lines stay rows: a sheet is written by sorting on (route_id, line_no), not by gathering a route in one value.
    """
    mark = F.when(F.exists("notes", lambda n: n.startswith("montée")), F.lit("⛰ ")).otherwise("↘ ")
    notes = F.when(F.size("notes") > 0, F.concat(F.lit("  \n    "), mark, F.array_join("notes", " ; "))).otherwise("")
    instruction = F.when(F.col("delta").isNull(), F.lit("Partir sur")).otherwise(turn_word(F.col("delta")))
    line = F.concat(F.format_string("%2d", "step_no"), F.lit(". "), instruction, F.lit(" **"), F.col("name"), F.lit("** — "), geo.distance_text(F.col("length_m")), notes)
    body = steps.select("route_id", F.col("step_no").cast("long").alias("line_no"), line.alias("line"))
    n = totals.join(steps.groupBy("route_id").agg((F.max("step_no") + 1).alias("_n")), "route_id")
    n = n.join(ends, "route_id", "left") if ends is not None else n.withColumns({c: F.lit(None).cast("string") for c in ("start_name", "end_name")})
    after = lambda c: F.coalesce(F.concat(F.lit(" : "), F.col(c)), F.lit(""))
    minutes, gain = F.format_string("%.0f", F.bround(F.col("time_s") / 60)), F.format_string("%.0f", F.bround(F.round("gain_m", 6)))  # whatever the order of the sum
    arrival = F.concat(F.format_string("%2d", "_n"), F.lit(". Arrivée"), after("end_name"), F.lit(" — total "), geo.distance_text(F.col("length_m")), F.lit(", "), minutes, F.lit(" min, D+ "), gain, F.lit(" m"))
    return body.unionByName(n.select("route_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("Départ"), after("start_name")).alias("line"))).unionByName(n.select("route_id", F.col("_n").cast("long").alias("line_no"), arrival.alias("line")))
