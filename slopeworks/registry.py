"""Registered queries of the network, track and layer operators, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slopeworks.functions import geo
from slopeworks.operators import directions, layers, network, profile
from slopeworks.sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def r(c, n: int = 6):  # noqa: ANN001, ANN201
    return F.round(c, n)


PAIRS = """p as (select line_id, seq, lon, lat, lead(lon) over (partition by line_id order by seq) as lon2, lead(lat) over (partition by line_id order by seq) as lat2 from fx_lines)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("line_id").orderBy("seq")
    return view(spark, d, "fx_lines").withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w)})


HAV = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))"
C = ("lon", "lat", "lon2", "lat2")


def _c() -> list:
    return [F.col(c) for c in C]


@query(f"with {PAIRS} select line_id, seq, round({HAV}, 4) as m from p where lon2 is not null")
def haversine(spark, d):
    return _pairs(spark, d).where("lon2 is not null").select("line_id", "seq", r(geo.haversine(*_c()), 4).alias("m"))


@query(f"with {PAIRS} select line_id, round(coalesce(sum({HAV}), 0.0), 3) as length_m, count(*) as n from p group by line_id")
def polyline_length(spark, d):
    return _pairs(spark, d).groupBy("line_id").agg(r(F.coalesce(F.sum(geo.haversine(*_c())), F.lit(0.0)), 3).alias("length_m"), F.count("*").alias("n"))


@query(f"""with {PAIRS}, b as (select line_id, seq, degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) as a from p where lon2 is not null)
select line_id, seq, round(case when a < 0 then a + 360.0 else a end, 5) as azimuth from b""")
def bearing(spark, d):
    return _pairs(spark, d).where("lon2 is not null").select("line_id", "seq", r(geo.bearing(*_c()), 5).alias("azimuth"))


@query(f"""with {PAIRS}, k as (select *, greatest(1, cast(ceil({HAV} / 10.0 - 1e-9) as integer)) as k from p where lon2 is not null)
select line_id, seq, cast(i as integer) as part, round(lon + (lon2 - lon) * i / k, 8) as plon, round(lat + (lat2 - lat) * i / k, 8) as plat from k, unnest(range(1, k + 1)) as t(i)""")
def densify(spark, d):
    parts = F.greatest(F.lit(1), F.ceil(geo.haversine(*_c()) / 10.0 - 1e-9).cast("int"))
    n = _pairs(spark, d).where("lon2 is not null").withColumn("k", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("k"))))
    at = lambda a, b: r(F.col(a) + (F.col(b) - F.col(a)) * F.col("part") / F.col("k"), 8)
    return n.select("line_id", "seq", "part", at("lon", "lon2").alias("plon"), at("lat", "lat2").alias("plat"))


@query("""select line_id, seq, round(radians(lon - 2.4) * 6371008.8 * cos(radians(48.84)), 4) as x, round(radians(lat - 48.84) * 6371008.8, 4) as y, round(lon, 8) as lon, round(lat, 8) as lat from fx_lines""")
def local_projection(spark, d):
    x, y = geo.to_local(F.col("lon"), F.col("lat"), F.lit(2.4), F.lit(48.84))
    n = view(spark, d, "fx_lines").withColumns({"x": x, "y": y})
    lon, lat = geo.from_local(F.col("x"), F.col("y"), F.lit(2.4), F.lit(48.84))
    return n.select("line_id", "seq", r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"), r(lon, 8).alias("lon"), r(lat, 8).alias("lat"))


@query("""select line_id, seq, round(radians(lon) * 6378137.0, 3) as x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) as y, round(lon, 8) as lon, round(lat, 8) as lat, round(1 / cos(radians(lat)), 8) as scale from fx_lines""")
def web_mercator(spark, d):
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    n = view(spark, d, "fx_lines").withColumns({"x": x, "y": y, "scale": 1 / F.cos(F.radians("lat"))})
    lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
    return n.select("line_id", "seq", r(F.col("x"), 3).alias("x"), r(F.col("y"), 3).alias("y"), r(lon, 8).alias("lon"), r(lat, 8).alias("lat"), r(F.col("scale"), 8).alias("scale"))


TILE = "(lon + 180) / 360 * 16384 as tx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384 as ty"


@query(f"select line_id, seq, round(tx, 6) as tx, round(ty, 6) as ty, round(tx * 256 - 0.5, 3) as px, round(ty * 256 - 0.5, 3) as py from (select line_id, seq, {TILE} from fx_lines)")
def tile_pixel(spark, d):
    tx, ty = geo.tile(F.col("lon"), F.col("lat"), 14)
    return view(spark, d, "fx_lines").withColumns({"tx": tx, "ty": ty}).select("line_id", "seq", r(F.col("tx")).alias("tx"), r(F.col("ty")).alias("ty"), r(F.col("tx") * 256 - 0.5, 3).alias("px"), r(F.col("ty") * 256 - 0.5, 3).alias("py"))


@query(f"""with t as (select line_id, min(floor(tx)) as x0, max(floor(tx)) as x1, min(floor(ty)) as y0, max(floor(ty)) as y1 from (select line_id, {TILE} from fx_lines) group by line_id)
select line_id, cast(x as bigint) as x, cast(y as bigint) as y from t, unnest(range(cast(x0 as bigint), cast(x1 as bigint) + 1)) as a(x), unnest(range(cast(y0 as bigint), cast(y1 as bigint) + 1)) as b(y)""")
def tile_cover(spark, d):
    tx, ty = geo.tile(F.col("lon"), F.col("lat"), 14)
    t = view(spark, d, "fx_lines").groupBy("line_id").agg(*[f(F.floor(c)).alias(n) for c, n, f in ((tx, "x0", F.min), (tx, "x1", F.max), (ty, "y0", F.min), (ty, "y1", F.max))])
    return t.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1"))).select("line_id", "x", "y")


@query("""select vec_id as tile_id, list_transform(embedding, lambda v: round(128 * 256.0 + floor(abs(v) * 100) + 7 / 256.0 - 32768, 6)) as elev from embeddings""")
def tile_decode(spark, d):
    # In single precision, as entries are: 0.29 times 100 is 29 there and less in double precision.
    # A whole number above 2^24, an infinity or what is no number is its own floor: floor() gives a bigint, which holds none of them.
    floor = lambda x: F.when(x < 2.0**24, F.floor(x).cast("double")).otherwise(x.cast("double"))
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: floor(F.abs(v) * F.lit(100).cast("float"))).alias("g"))
    rgb = e.withColumns({"r": F.transform("g", lambda _: F.lit(128)), "b": F.transform("g", lambda _: F.lit(7))})
    value = F.zip_with(F.zip_with("r", "g", lambda a, g: (a * 256.0 + g).cast("float")), "b", lambda x, b: r(x.cast("double") + b / 256.0 - 32768))
    return rgb.select(F.col("vec_id").alias("tile_id"), value.alias("elev"))


GRADED = """n as (select *, lead(dist_m) over w as next_dist, lead(elev_m) over w as next_elev,
  max(seq) over (partition by track_id order by dist_m range between unbounded preceding and 50.0 preceding) as lo,
  max(seq) over (partition by track_id order by dist_m range between unbounded preceding and 50.0 following) as hi,
  first_value(dist_m) over w as d0, first_value(elev_m) over w as e0 from fx_points window w as (partition by track_id order by seq)),
m as (select n.*, l.dist_m as ld, l.elev_m as le, l.next_dist as lnd, l.next_elev as lne, h.dist_m as hd, h.elev_m as he, h.next_dist as hnd, h.next_elev as hne,
  greatest(n.dist_m - 50.0, n.d0) as lx, case when h.next_dist is null then h.dist_m else n.dist_m + 50.0 end as hx
  from n left join n l on l.track_id = n.track_id and l.seq = n.lo join n h on h.track_id = n.track_id and h.seq = n.hi),
g as (select track_id, seq, dist_m, elev_m, next_dist, next_elev, 100 * ((case when hnd is null then he else he + (hne - he) * (hx - hd) / (hnd - hd) end)
  - (case when ld is null then e0 when lnd is null then le else le + (lne - le) * (lx - ld) / (lnd - ld) end)) / greatest(hx - lx, 1.0) as grade from m)"""
RUNS = """s as (select *, case when grade > 6.0 and not coalesce(lag(grade) over (partition by track_id order by seq) > 6.0, false) then 1 else 0 end as st from g),
i as (select *, cast(sum(st) over (partition by track_id order by seq) as bigint) as run from s),
runs as (select track_id, run, min(dist_m) as start_m, max(dist_m) as end_m, max(grade) as max_grade, count(*) as samples from i where grade > 6.0 group by track_id, run)"""


def _points(spark, d):
    return view(spark, d, "fx_points")


@query(f"with {GRADED} select track_id, seq, round(grade, 5) as grade from g")
def windowed_grade(spark, d):
    return profile.windowed_grades(_points(spark, d)).select("track_id", "seq", r(F.col("grade"), 5).alias("grade"))


@query("with n as (select *, lead(dist_m) over w as nd, lead(elev_m) over w as ne from fx_points window w as (partition by track_id order by seq)) select track_id, seq, round(100 * (ne - elev_m) / greatest(nd - dist_m, 1e-6), 5) as grade from n where nd is not null")
def segment_grade(spark, d):
    return profile.segment_grades(_points(spark, d)).withColumn("grade", r(F.col("grade"), 5))


@query(f"with {GRADED}, {RUNS} select track_id, run, start_m, end_m, round(max_grade, 5) as max_grade, samples from runs")
def steep_intervals(spark, d):
    return profile.islands(profile.windowed_grades(_points(spark, d)), 6.0).withColumn("max_grade", r(F.col("max_grade"), 5))


@query("with n as (select *, lead(elev_m) over (partition by track_id order by seq) - elev_m as de from fx_points) select track_id, coalesce(sum(greatest(de, 0.0)), 0.0) as gain_m, coalesce(sum(greatest(-de, 0.0)), 0.0) as loss_m from n where de is not null or true group by track_id")
def elevation_gain_loss(spark, d):
    return profile.elevation_gain_loss(_points(spark, d))


SPEED = """x as (select *, next_dist - dist_m as l, next_elev - elev_m as dh from g),
y as (select *, 90.0 * 9.81 * (0.007 + dh / l) as a, 0.33 as b, 5.0 as v0 from x),
v as (select *, case when a < 0 and a * (32 / 3.6) + b * pow(32 / 3.6, 3) <= 110.0 then 32 / 3.6 else
  list_reduce(list_prepend(case when a < 0 then 25.0 else 12.0 end, [1.0 for z in range(60)]), lambda u, one: greatest(0.05, u - (a * u + b * u * u * u - 110.0) / (a + 3 * b * u * u))) end as speed from y)"""


@query(f"""with {GRADED}, {RUNS}, {SPEED},
t as (select track_id, max(dist_m) - min(dist_m) as length_m, greatest(max(grade), 0.0) as max_grade_pct, coalesce(sum(greatest(dh, 0.0)), 0.0) as gain_m, coalesce(sum(greatest(-dh, 0.0)), 0.0) as loss_m,
  coalesce(sum(l / greatest(3.5 / 3.6, least(32 / 3.6, speed))), 0.0) as time_s, coalesce(sum(l * pow(greatest(grade, 0.0) / 6.0, 3)), 0.0) as harshness from v group by track_id),
k as (select track_id, sum(end_m - start_m) as steep_len_m from runs group by track_id)
select t.track_id, length_m, round(max_grade_pct, 4) as max_grade_pct, gain_m, loss_m, round(time_s, 2) as time_s, round(harshness, 3) as harshness, coalesce(steep_len_m, 0.0) as steep_len_m from t left join k on k.track_id = t.track_id""")
def track_metrics(spark, d):
    m = profile.track_metrics(_points(spark, d))
    return m.withColumns({"max_grade_pct": r(F.col("max_grade_pct"), 4), "time_s": r(F.col("time_s"), 2), "harshness": r(F.col("harshness"), 3)})


@query(f"with {GRADED} select track_id, arg_max(seq, [grade, -seq]) as seq, arg_max(dist_m, [grade, -seq]) as dist_m, round(max(grade), 5) as grade from g group by track_id")
def steepest_point(spark, d):
    return profile.steepest_point(profile.windowed_grades(_points(spark, d))).withColumn("grade", r(F.col("grade"), 5))


@query(f"with {GRADED} select band, count(*) as samples from (select case when grade > 6.0 then 'steep' when grade >= 2.0 then 'climb' else 'easy' end as band from g) group by band")
def band_profile(spark, d):
    band = F.when(F.col("grade") > 6.0, "steep").when(F.col("grade") >= 2.0, "climb").otherwise("easy")
    return profile.windowed_grades(_points(spark, d)).groupBy(band.alias("band")).agg(F.count("*").alias("samples"))


@query("""with t as (select track_id, max(dist_m) as len from fx_points group by track_id), m as (select track_id, cast(400.0 + k * 800.0 as double) as mark_m from t, unnest(range(0, 100000)) as u(k) where 400.0 + k * 800.0 < len - 200.0)
select m.track_id, mark_m, min(p.seq) as seq, min(p.dist_m) as dist_m from m join fx_points p on p.track_id = m.track_id and p.dist_m >= m.mark_m group by m.track_id, mark_m""")
def milestones(spark, d):
    return profile.milestones(_points(spark, d))


@query(f"""with {GRADED}, {RUNS} select g.track_id, run, count(*) as points, min(seq) as first_seq from g join runs on runs.track_id = g.track_id and g.dist_m between start_m - 1e-6 and end_m + 1e-6 group by g.track_id, run""")
def points_in_interval(spark, d):
    g = profile.windowed_grades(_points(spark, d))
    runs = profile.islands(g, 6.0).withColumnRenamed("track_id", "t")
    inside = g.join(runs, (F.col("track_id") == F.col("t")) & F.col("dist_m").between(F.col("start_m") - 1e-6, F.col("end_m") + 1e-6))
    return inside.groupBy("track_id", "run").agg(F.count("*").alias("points"), F.min("seq").alias("first_seq"))


def _edge_arrays(spark, d):
    return view(spark, d, "fx_edge_points").groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("seq", "dist_m", "elev_m"))).alias("p")).select(
        "edge_id", F.col("p.dist_m").alias("dist"), F.col("p.elev_m").alias("elev"), (F.col("edge_id") % 5 == 0).alias("bridged")
    )


@query("""with g as (select *, lead(dist_m) over (partition by edge_id order by seq) - dist_m as gap, count(*) over (partition by edge_id) as n from fx_edge_points),
k as (select edge_id, max(n) as n, cast(round_even(30.0 / greatest(median(gap), 0.1), 0) as integer) as k from g group by edge_id),
w as (select p.edge_id, p.seq, k.k, k.n, j from fx_edge_points p join k on k.edge_id = p.edge_id, unnest(range(-20, 21)) as u(j) where j >= -(k.k // 2) and j < k.k - k.k // 2)
select p.edge_id, p.seq, round(case when k.k > 1 then (select sum(q.elev_m) / max(w.k) from w join fx_edge_points q on q.edge_id = w.edge_id and q.seq = greatest(0, least(w.n - 1, w.seq + w.j)) where w.edge_id = p.edge_id and w.seq = p.seq) else p.elev_m end, 6) as elev_m
from fx_edge_points p join k on k.edge_id = p.edge_id""")
def smooth_elevation(spark, d):
    return profile.smooth(_edge_arrays(spark, d)).select("edge_id", F.posexplode("elev").alias("s", "e")).select("edge_id", F.col("s").cast("long").alias("seq"), r(F.col("e")).alias("elev_m"))


@query("""with e as (select *, first_value(elev_m) over w as e0, last_value(elev_m) over w as e1, first_value(dist_m) over w as d0, last_value(dist_m) over w as d1 from fx_edge_points window w as (partition by edge_id order by seq rows between unbounded preceding and unbounded following))
select edge_id, seq, round(case when edge_id % 5 = 0 then e0 + (e1 - e0) * (dist_m - d0) / greatest(d1 - d0, 1e-9) else elev_m end, 6) as elev_m from e""")
def bridge_elevation(spark, d):
    return profile.bridge(_edge_arrays(spark, d)).select("edge_id", F.posexplode("elev").alias("s", "e")).select("edge_id", F.col("s").cast("long").alias("seq"), r(F.col("e")).alias("elev_m"))


MAP = "map {" + ", ".join(f"'{k}': {v}" for k, v in network.ROAD_CLASSES.items()) + "}"


@query(f"select seg_id, class, cast({MAP}[class] as double) as pref from fx_segments where subtype = 'road' and {MAP}[class] is not null")
def filter_road_class(spark, d):
    return network.filter_road_class(view(spark, d, "fx_segments")).select("seg_id", "class", "pref")


RULES = """u as (select * from fx_access where not has_during and (mode is null or mode = 'bicycle')),
x as (select *, access_type = 'denied' or (access_type = 'allowed' and has_recognized) as closes from u),
a as (select seg_id, coalesce(arg_max(not closes, ord) filter (where heading is null), true) as allow,
  coalesce(arg_max(not closes, ord) filter (where heading = 'forward' or (heading is null and not closes)), true) as fwd,
  coalesce(arg_max(not closes, ord) filter (where heading = 'backward' or (heading is null and not closes)), true) as bwd,
  coalesce(bool_or(mode = 'bicycle') filter (where not closes), false) as explicit from x group by seg_id),
f as (select s.seg_id, coalesce(allow, true) as allow, coalesce(fwd, true) as fwd, coalesce(bwd, true) as bwd, coalesce(explicit, false) as explicit from (select distinct seg_id from fx_access) s left join a on a.seg_id = s.seg_id)"""


def _access(spark, d):
    return network.access_of_rules(view(spark, d, "fx_access"))


@query(f"with {RULES} select * from f")
def bike_access(spark, d):
    return _access(spark, d)


@query(f"with {RULES} select seg_id from f where allow and (fwd or bwd)")
def filter_access(spark, d):
    return _access(spark, d).where("allow and (fwd or bwd)").select("seg_id")


REASON = f"case when subtype <> 'road' or {MAP}[class] is null then 'class' when not (coalesce(allow, true) and (coalesce(fwd, true) or coalesce(bwd, true))) then 'access' when class = 'footway' and (coalesce(subclass in ('sidewalk', 'crosswalk'), false) or not coalesce(explicit, false)) then 'footway' else 'kept' end"


def _audited(spark, d):
    s, a = view(spark, d, "fx_segments"), _access(spark, d)
    n = s.join(a, "seg_id", "left").fillna(True, ["allow", "fwd", "bwd"]).fillna(False, ["explicit"])
    known = F.col("class").isin(list(network.ROAD_CLASSES))
    walk = (F.col("class") == "footway") & (F.coalesce(F.col("subclass").isin("sidewalk", "crosswalk"), F.lit(False)) | ~F.col("explicit"))
    return n.withColumn("reason", F.when((F.col("subtype") != "road") | ~known, "class").when(~(F.col("allow") & (F.col("fwd") | F.col("bwd"))), "access").when(walk, "footway").otherwise("kept"))


@query(f"with {RULES} select seg_id from (select fx_segments.seg_id, {REASON} as reason from fx_segments left join f on f.seg_id = fx_segments.seg_id) where reason = 'kept'")
def filter_footway(spark, d):
    return _audited(spark, d).where("reason = 'kept'").select("seg_id")


@query(f"with {RULES} select reason, count(*) as segments from (select {REASON} as reason from fx_segments left join f on f.seg_id = fx_segments.seg_id) group by reason")
def skip_audit(spark, d):
    return _audited(spark, d).groupBy("reason").agg(F.count("*").alias("segments"))


@query("select seg_id, bool_or(flag = 'is_bridge' and (from_at is null or (from_at <= 0.2 + 1e-9 and to_at >= 0.3 - 1e-9))) as bridge, bool_or(flag = 'is_tunnel' and (from_at is null or (from_at <= 0.2 + 1e-9 and to_at >= 0.3 - 1e-9))) as tunnel from fx_flags group by seg_id")
def flag_covers(spark, d):
    flags = view(spark, d, "fx_flags").groupBy("seg_id").agg(F.collect_list(F.struct("flag", "from_at", "to_at")).alias("f"))
    return flags.select("seg_id", *[network.flag_covers(F.col("f"), f"is_{n}", F.lit(0.2), F.lit(0.3)).alias(n) for n in ("bridge", "tunnel")])


@query('''with n as (select seg_id, "at" as a, connector_id, row_number() over w - 1 as piece, lead("at") over w as to_at, lead(connector_id) over w as v from fx_connectors window w as (partition by seg_id order by "at", connector_id))
select seg_id, cast(piece as bigint) as piece, connector_id as u, v, a as from_at, to_at from n where to_at > a''')
def sort_connectors(spark, d):
    return network.connector_pairs(view(spark, d, "fx_connectors"))


ARCS = """arcs as (select edge_id, length_m, true as fwd, u, v, 100 * de / greatest(length_m, 1e-6) as mean_grade from fx_edges where allow_fwd
union all select edge_id, length_m, false, v, u, -100 * de / greatest(length_m, 1e-6) from fx_edges where allow_bwd)"""


def _arcs(spark, d):
    return network.arcs_from_edges(view(spark, d, "fx_edges"))


@query(f"with {ARCS} select edge_id, length_m, fwd, u, v, round(mean_grade, 6) as mean_grade from arcs")
def arcs_from_edges(spark, d):
    return _arcs(spark, d).withColumn("mean_grade", r(F.col("mean_grade")))


@query(f"with {ARCS}, w as (select u % 500 as u, v % 500 as v, edge_id, fwd, length_m, mean_grade from arcs) select u, v, edge_id, fwd, length_m, round(mean_grade, 6) as mean_grade from w qualify row_number() over (partition by u, v order by length_m, edge_id, not fwd) = 1")
def dedupe_parallel_arcs(spark, d):
    folded = _arcs(spark, d).withColumns({"u": F.col("u") % 500, "v": F.col("v") % 500})
    return network.cheapest_parallel(folded).withColumn("mean_grade", r(F.col("mean_grade")))


@query("""with e as (select seg_id, connector_id, "at", row_number() over (partition by connector_id order by seg_id, "at") as k from fx_connectors) select connector_id as node_id, seg_id, "at" from e where k = 1""")
def distinct_nodes(spark, d):
    return view(spark, d, "fx_connectors").groupBy(F.col("connector_id").alias("node_id")).agg(F.min(F.struct("seg_id", "at")).alias("p")).select("node_id", "p.*")


PTS = "q as (select r.req_id * 2 + s as pt_id, n.lon + 0.0003 as lon, n.lat - 0.0002 as lat from fx_requests r, (select 0 as s union all select 1) t join fx_nodes n on n.node_id = case when s = 0 then r.src else r.dst end)"


def _ends(spark, d):
    q = view(spark, d, "fx_requests").select("req_id", F.posexplode(F.array("src", "dst")).alias("s", "node_id"))
    # Nodes are many more than their file's size tells: not sent to all tasks.
    return q.join(view(spark, d, "fx_nodes").hint("merge"), "node_id").select((F.col("req_id") * 2 + F.col("s")).alias("pt_id"), (F.col("lon") + 0.0003).alias("lon"), (F.col("lat") - 0.0002).alias("lat"))


@query(f"with {PTS} select pt_id, arg_min(n.node_id, [round(pow((n.lon - q.lon) * cos(radians(q.lat)), 2) + pow(n.lat - q.lat, 2), 14), n.node_id]) as node_id from q, fx_nodes n group by pt_id")
def nearest_node(spark, d):
    return network.nearest_node(_ends(spark, d), view(spark, d, "fx_nodes")).select("pt_id", "node_id")


@query(f"with {PTS}, b as (select pt_id // 2 as req_id, round(min(lon) - 0.0045, 8) as x0, round(max(lon) + 0.0045, 8) as x1, round(min(lat) - 0.0045, 8) as y0, round(max(lat) + 0.0045, 8) as y1 from q group by pt_id // 2) select req_id, x0, x1, y0, y1 from b")
def request_bbox(spark, d):
    return _boxes(spark, d)


def _boxes(spark, d):
    return _ends(spark, d).groupBy(F.floor(F.col("pt_id") / 2).alias("req_id")).agg(
        r(F.min("lon") - 0.0045, 8).alias("x0"), r(F.max("lon") + 0.0045, 8).alias("x1"), r(F.min("lat") - 0.0045, 8).alias("y0"), r(F.max("lat") + 0.0045, 8).alias("y1")
    )


@query(f"with {PTS}, b as (select pt_id // 2 as req_id, round(min(lon) - 0.0045, 8) as x0, round(max(lon) + 0.0045, 8) as x1, round(min(lat) - 0.0045, 8) as y0, round(max(lat) + 0.0045, 8) as y1 from q group by pt_id // 2) select req_id, id from b, fx_layers where xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0")
def features_per_request(spark, d):
    return layers.features_per_request(view(spark, d, "fx_layers"), _boxes(spark, d))


@query("select id, subtype, class from fx_layers where xmin <= 2.41 and xmax >= 2.39 and ymin <= 48.8401 and ymax >= 48.8201")
def scan_bbox(spark, d):
    box = [F.lit(x) for x in (2.39, 2.41, 48.8201, 48.8401)]
    return view(spark, d, "fx_layers").where(layers.overlaps(*box)).select("id", "subtype", "class")


@query("select id, case when subtype = 'park' then 'park' when subtype in ('recreation', 'agriculture', 'golf') or class in ('grass', 'garden', 'allotments', 'meadow') then 'green' when subtype = 'cemetery' then 'cemetery' when subtype in ('developed', 'construction', 'transportation') and class in ('industrial', 'railway', 'brownfield', 'construction') then 'industrial' when subtype = 'education' then 'school' end as style from fx_layers")
def classify_landuse(spark, d):
    return view(spark, d, "fx_layers").select("id", layers.classify_landuse(F.col("subtype"), F.col("class")).alias("style"))


@query("select id, 'green' as style from fx_layers where subtype in ('forest', 'grass', 'shrub', 'wetland')")
def classify_land(spark, d):
    return view(spark, d, "fx_layers").select("id", layers.classify_land(F.col("subtype")).alias("style")).where("style is not null")


@query("select subtype, class, count(*) as features, round(sum(xmax - xmin), 6) as width from fx_layers group by subtype, class")
def group_layers(spark, d):
    return view(spark, d, "fx_layers").groupBy("subtype", "class").agg(F.count("*").alias("features"), r(F.sum(F.col("xmax") - F.col("xmin"))).alias("width"))


@query("""with p as (select t.k as pt_id, (8300 * 8) + (k * 7919 % 1600) / 10.0 as px, (5630 * 8) + (k * 104729 % 1600) / 10.0 as py from (select p_partkey as k from part) t),
h as (select max(x) as hx, max(y) as hy, min(x) as lx, min(y) as ly from fx_tiles), c as (select pt_id, greatest(lx * 8.0, least((hx + 1) * 8 - 1.0, px)) as px, greatest(ly * 8.0, least((hy + 1) * 8 - 1.0, py)) as py, hx, hy from p, h),
n as (select pt_id, least(cast(floor(px) as bigint) + dx, (hx + 1) * 8 - 1) as gx, least(cast(floor(py) as bigint) + dy, (hy + 1) * 8 - 1) as gy, (case when dx = 1 then px - floor(px) else 1 - (px - floor(px)) end) * (case when dy = 1 then py - floor(py) else 1 - (py - floor(py)) end) as w from c, unnest([0, 1]) as a(dx), unnest([0, 1]) as b(dy))
select pt_id, round(sum(w * t.pixels[(gy % 8) * 8 + gx % 8 + 1]), 5) as elev_m from n join fx_tiles t on t.x = gx // 8 and t.y = gy // 8 where w > 0 group by pt_id""")
def dem_sample(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("pt_id"), (8300 * 8 + (F.col("p_partkey") * 7919 % 1600) / 10.0).alias("px"), (5630 * 8 + (F.col("p_partkey") * 104729 % 1600) / 10.0).alias("py"))
    return layers.sample_elevation(p, view(spark, d, "fx_tiles"), 8, 14).withColumn("elev_m", r(F.col("elev_m"), 5))


LABEL = "coalesce(nullif(name, ''), map {" + ", ".join(f"'{k}': '{v}'" for k, v in directions.CLASS_LABEL.items()) + "}[road_class], 'voie sans nom')"
GROUPS = f"""o as (select *, {LABEL} as label, coalesce(sum(length_m) over (partition by route_id order by seq rows between unbounded preceding and 1 preceding), 0.0) as start_m from fx_route_arcs),
b as (select *, case when label is not distinct from lag(label) over (partition by route_id order by seq) then 0 else 1 end as nw from o),
c as (select *, cast(sum(nw) over (partition by route_id order by seq) as bigint) as grp from b),
gr as (select route_id, grp, min(label) as label, arg_min(name is not null, seq) as named, min(start_m) as start_m, max(start_m + length_m) as end_m from c group by route_id, grp)"""
STEPS = """kp as (select *, row_number() over w = 1 or not (end_m - start_m < 25.0 and not named) as kept from gr window w as (partition by route_id order by grp)),
ls as (select *, last_value(case when kept then label end ignore nulls) over (partition by route_id order by grp rows between unbounded preceding and 1 preceding) as prev from kp),
sn as (select *, cast(sum(case when kept and label is distinct from prev then 1 else 0 end) over (partition by route_id order by grp) as bigint) as step_no from ls),
st as (select route_id, step_no, arg_min(label, grp) as name, min(start_m) as d_start, max(end_m) as d_end, max(end_m) - min(start_m) as length_m from sn group by route_id, step_no)"""


def _route_arcs(spark, d):
    return view(spark, d, "fx_route_arcs")


@query(f"select route_id, seq, {LABEL} as label from fx_route_arcs")
def label_lookup(spark, d):
    return directions.label_lookup(_route_arcs(spark, d)).select("route_id", "seq", "label")


@query("select route_id, seq, coalesce(sum(length_m) over (partition by route_id order by seq rows between unbounded preceding and 1 preceding), 0.0) as start_m from fx_route_arcs")
def route_offsets(spark, d):
    return directions.route_offsets(_route_arcs(spark, d)).select("route_id", "seq", "start_m")


@query(f"with {GROUPS} select * from gr")
def step_groups(spark, d):
    return directions.step_groups(_route_arcs(spark, d))


@query(f"with {GROUPS}, {STEPS} select * from st")
def step_merge(spark, d):
    return directions.steps(_route_arcs(spark, d))


@query(f"""with {GROUPS}, {STEPS}, pt as (select route_id, seq, coalesce(sum(length_m) over (partition by route_id order by seq rows between unbounded preceding and 1 preceding), 0.0) as d from fx_route_arcs)
select st.route_id, step_no, min(seq) filter (where d >= d_start) as idx_start, max(seq) filter (where d <= d_end) as idx_end from st join pt on pt.route_id = st.route_id group by st.route_id, step_no""")
def step_asof(spark, d):
    arcs = _route_arcs(spark, d)
    steps = directions.steps(arcs).withColumnRenamed("route_id", "_r")
    points = directions.route_offsets(arcs).select("route_id", "seq", F.col("start_m").alias("d"))
    # A point belongs to the step it starts in and, on the boundary, to the one before: an interval join within the route.
    near = points.join(steps, (F.col("route_id") == F.col("_r")) & F.col("d").between(F.col("d_start"), F.col("d_end")))
    return near.groupBy("route_id", "step_no").agg(F.min("seq").alias("idx_start"), F.max("seq").alias("idx_end"))


@query("""select delta, case when abs(delta) < 25 then 'Continuer tout droit sur' when abs(delta) < 60 then 'Légèrement à ' || case when delta > 0 then 'droite' else 'gauche' end || ' sur' when abs(delta) < 135 then 'Tourner à ' || case when delta > 0 then 'droite' else 'gauche' end || ' sur'
else 'Faire demi-tour (virage serré à ' || case when delta > 0 then 'droite' else 'gauche' end || ') sur' end as words, count(*) as n from (select cast((p_partkey * 37 + 180) % 360 - 180 as double) as delta from part) group by 1, 2""")
def turn_word(spark, d):
    n = spark.read.parquet(f"{d}/part.parquet").select(directions.wrap((F.col("p_partkey") * 37).cast("double")).alias("delta"))
    return n.withColumn("words", directions.turn_word(F.col("delta"))).groupBy("delta", "words").agg(F.count("*").alias("n"))


@query("select route_id, seq, case when length_m * 37 >= 1000 then printf('%.1f km', length_m * 37 / 1000) else printf('%.0f m', length_m * 37) end as distance, case when m >= 60 then printf('%d h %02d', m // 60, m % 60) else printf('%d min', m) end as time from (select *, cast(round_even(length_m * 97 / 60, 0) as bigint) as m from fx_route_arcs)")
def format_distance_time(spark, d):
    return _route_arcs(spark, d).select("route_id", "seq", geo.distance_text(F.col("length_m") * 37).alias("distance"), geo.time_text(F.col("length_m") * 97).alias("time"))


REQ = "rt as (select src % 3 as req_id, cast(req_id as bigint) as tier, [src % 2, dst % 2, (src + dst) % 2] as nodes from fx_requests)"


def _routes(spark, d):
    return view(spark, d, "fx_requests").select((F.col("src") % 3).alias("req_id"), F.col("req_id").cast("long").alias("tier"), F.array(F.col("src") % 2, F.col("dst") % 2, (F.col("src") + F.col("dst")) % 2).alias("nodes"))


@query(f"with {REQ}, f as (select *, min(tier) over (partition by req_id, nodes) as first from rt) select req_id, tier, case when first < tier then first end as same_as_tier, cast(dense_rank() over (partition by req_id order by first) - 1 as bigint) as route_no from f")
def same_as_tier(spark, d):
    return network.same_as_tier(_routes(spark, d))


@query(f"with {REQ} select req_id, min(tier) as first_tier, string_agg('+' || tier || ' %', ' = ' order by tier) as tiers from rt group by req_id, nodes")
def tiers_per_route(spark, d):
    text = F.array_join(F.transform(F.array_sort(F.collect_list("tier")), lambda t: F.format_string("+%d %%", t)), " = ")
    return _routes(spark, d).groupBy("req_id", "nodes").agg(F.min("tier").alias("first_tier"), text.alias("tiers")).drop("nodes")


PADDED = ", ".join(f"round({f}({c}) {sign} (0.06 * (max({c}) - min({c})) + {k}), 8) as {n}" for c, k, n0 in (("lon", 0.004, "x"), ("lat", 0.003, "y")) for f, sign, n in (("min", "-", n0 + "0"), ("max", "+", n0 + "1")))


@query(f"select {PADDED}, round(avg(lon), 8) as lon0, round(avg(lat), 8) as lat0 from fx_nodes")
def overall_extent(spark, d):
    n = view(spark, d, "fx_nodes")
    pad = lambda c, k: 0.06 * (F.max(c) - F.min(c)) + k
    return n.agg(
        r(F.min("lon") - pad("lon", 0.004), 8).alias("x0"), r(F.max("lon") + pad("lon", 0.004), 8).alias("x1"), r(F.min("lat") - pad("lat", 0.003), 8).alias("y0"),
        r(F.max("lat") + pad("lat", 0.003), 8).alias("y1"), r(F.avg("lon"), 8).alias("lon0"), r(F.avg("lat"), 8).alias("lat0"),
    )


def _relaxed(where: str = "", budget: str = "1e9") -> str:
    """Cheapest paths by recursion; a billionth of a metre per arc lets the one with fewer arcs win."""
    return f"""with recursive {ARCS}, e as (select u, v, min(length_m) + 1e-9 as w from arcs {where} group by u, v),
q as (select req_id, src, dst, {budget} as most from fx_requests),
p(req_id, node, d, most) using key (req_id, node) as (
  select req_id, src, 0.0::double, most from q
  union
  select p.req_id, e.v, min(p.d + e.w), any_value(p.most) from p join e on e.u = p.node left join recurring.p as old on old.req_id = p.req_id and old.node = e.v
  where p.d + e.w <= p.most + 1e-6 and (old.d is null or p.d + e.w < old.d) group by p.req_id, e.v)
select q.req_id, round(p.d, 3) as cost, cast(round((p.d - round(p.d, 3)) * 1e9) as bigint) as hops, case when p.d is null then 'none' else 'found' end as status from q left join p on p.req_id = q.req_id and p.node = q.dst"""


# 3 km are far above a short trip's way.
@query(_relaxed(budget="case when req_id % 3 = 0 then 1e9 else 3000.0 end"))
def shortest_paths(spark, d):
    return network.shortest_paths(_arcs(spark, d), view(spark, d, "fx_requests"), view(spark, d, "fx_nodes")).withColumn("cost", r(F.col("cost"), 3))


@query(_relaxed("where mean_grade <= 4.0 + 1e-9", "case when req_id % 3 = 0 then 12000.0 else 1500.0 end"))
def grade_capped_path(spark, d):
    asked = view(spark, d, "fx_requests").withColumns({"budget": F.when(F.col("req_id") % 3 == 0, 12000.0).otherwise(1500.0), "cap": F.lit(4.0)})
    return network.shortest_paths(_arcs(spark, d).withColumnRenamed("mean_grade", "grade"), asked, view(spark, d, "fx_nodes")).withColumn("cost", r(F.col("cost"), 3))


@query()
def shortest_routes(spark, d):
    """The arcs of every request's shortest path; tests hold them against its cost and hops."""
    return network.shortest_routes(_arcs(spark, d), view(spark, d, "fx_requests"), view(spark, d, "fx_nodes"))


CHAINS = _relaxed(budget="case when req_id % 3 = 0 then 1e9 else 3000.0 end")


@query(f"""select req_id, t.cost, t.hops, true as starts, true as ends, true as joined, true as known from ({with_views(CHAINS)}) t where t.status = 'found' and t.hops > 0""")
def route_chains(spark, d):
    """Every found route added up from its arcs again: metres, arcs, whether it starts and ends where asked, whether each arc begins where the one before ends, and whether the network has its arcs."""
    arcs, asked = _arcs(spark, d), view(spark, d, "fx_requests")
    by = Window.partitionBy("req_id").orderBy("arc_seq")
    own = arcs.select("edge_id", "fwd", F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("length_m").alias("_m"))
    n = network.shortest_routes(arcs, asked, view(spark, d, "fx_nodes")).select("req_id", "arc_seq", "edge_id", "fwd", "u", "v").join(own, ["edge_id", "fwd"], "left")
    n = n.withColumns({"_before": F.lag("v").over(by), "_known": F.coalesce((F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")), F.lit(False))}).join(asked, "req_id")
    told = {
        "cost": r(F.sum("_m"), 3), "hops": F.count("*"), "starts": F.min_by("u", "arc_seq") == F.first("src"), "ends": F.max_by("v", "arc_seq") == F.first("dst"),
        "joined": F.every(F.coalesce(F.col("_before") == F.col("u"), F.col("_before").isNull())), "known": F.every("_known"),
    }
    return n.groupBy("req_id").agg(*[c.alias(k) for k, c in told.items()])


@query("""with n as (select line_id, 'street ' || (line_id % 7) as name, max(lon) - min(lon) as len, 0.049 as span, line_id % 4 as imp from fx_lines group by line_id)
select line_id, name, cast(row_number() over (order by imp desc, len desc, name, line_id) as bigint) as rank from n where len >= 0.025 * span qualify rank <= 160""")
def label_candidates(spark, d):
    n = view(spark, d, "fx_lines").groupBy("line_id").agg((F.max("lon") - F.min("lon")).alias("length_m"))
    n = n.withColumns({"map_id": F.lit(0), "span_m": F.lit(0.049), "importance": F.col("line_id") % 4, "name": F.concat(F.lit("street "), F.col("line_id") % 7)})
    return layers.label_candidates(n).select("line_id", "name", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from slopeworks import registry_layers, registry_reports, registry_routes, registry_search  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from slopeworks import registry_layers, registry_reports, registry_routes, registry_search  # noqa: F401

    return dict(SQL)


