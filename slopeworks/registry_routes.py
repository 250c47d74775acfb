"""Registered queries of assembled routes, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopeworks.operators import directions, layers, network, profile, reports, routes
from slopeworks.registry import GRADED, GROUPS, REQ, RUNS, SPEED, STEPS, _routes, query, r
from slopeworks.sources.fixtures import view

ROUTE = """s0 as (select *, coalesce(sum(length_m) over (partition by route_id order by arc_seq rows between unbounded preceding and 1 preceding), 0.0) as at0 from fx_route_edges),
s1 as (select s0.route_id, arc_seq, case when fwd then p.seq else -p.seq end as k, at0 + case when fwd then p.dist_m else s0.length_m - p.dist_m end as dist_m, p.elev_m, p.lon, p.lat from s0 join fx_edge_points p on p.edge_id = s0.edge_id),
s2 as (select * from s1 qualify arc_seq = 0 or row_number() over (partition by route_id, arc_seq order by k) > 1),
ap as (select route_id as track_id, row_number() over (partition by route_id order by arc_seq, k) - 1 as seq, arc_seq, dist_m, elev_m, lon, lat from s2)"""
ON_ROUTES, ON_EDGES = GRADED.replace("fx_points", "ap"), GRADED.replace("fx_points", "ep")
NAMED = (GROUPS + ", " + STEPS).replace("fx_route_arcs", "ra")
RA = "ra as (select route_id, arc_seq as seq, name, road_class, length_m from fx_route_edges)"


def _arcs(spark, d):
    return view(spark, d, "fx_route_edges")


def _points(spark, d):
    return routes.assemble_points(_arcs(spark, d), view(spark, d, "fx_edge_points"))


def _steps(spark, d):
    return directions.steps(_arcs(spark, d).withColumnRenamed("arc_seq", "seq"))


@query(f"with {ROUTE} select track_id, seq, arc_seq, round(dist_m, 6) as dist_m, elev_m, round(lon, 8) as lon, round(lat, 8) as lat from ap")
def assemble_points(spark, d):
    return _points(spark, d).withColumns({"dist_m": r(F.col("dist_m")), "lon": r(F.col("lon"), 8), "lat": r(F.col("lat"), 8)})


@query(f"""with ep as (select edge_id as track_id, seq, dist_m, elev_m from fx_edge_points), {ON_EDGES}, k as (select *, lead(grade) over (partition by track_id order by seq) as far, next_dist - dist_m as l, next_elev - elev_m as dh from g)
select track_id as edge_id, round(max(grade), 4) as max_fwd, round(-min(grade), 4) as max_bwd, round(coalesce(sum(l) filter (where grade > 6.0), 0.0), 4) as steep_fwd, round(coalesce(sum(l) filter (where -far > 6.0), 0.0), 4) as steep_bwd,
round(coalesce(sum(greatest(dh, 0.0)), 0.0), 4) as gain_fwd, round(coalesce(sum(greatest(-dh, 0.0)), 0.0), 4) as gain_bwd from k group by track_id""")
def edge_metrics(spark, d):
    m = routes.edge_metrics(view(spark, d, "fx_edge_points"))
    return m.select("edge_id", *[r(F.col(c), 4).alias(c) for c in m.columns[1:]])


STATS = """sq as (select g.*, step_no, lead(g.dist_m) over w - g.dist_m as l, lead(g.elev_m) over w - g.elev_m as dh from g join st on st.route_id = g.track_id and g.dist_m between d_start and d_end window w as (partition by g.track_id, step_no order by g.seq)),
ss as (select track_id as route_id, step_no, round(max(grade), 4) as max_grade, round(min(grade), 4) as min_grade, round(coalesce(sum(l) filter (where grade > 2.0), 0.0), 4) as climb_m, round(coalesce(sum(dh) filter (where dh > 0), 0.0), 4) as gain_m,
round(coalesce(sum(l) filter (where grade < -2.0), 0.0), 4) as descent_m, round(coalesce(sum(l) filter (where grade > 6.0), 0.0), 4) as steep_m from sq group by track_id, step_no)"""


@query(f"with {ROUTE}, {ON_ROUTES}, {RA}, {NAMED}, {STATS} select * from ss")
def step_stats(spark, d):
    return _stats(profile.windowed_grades(_points(spark, d)), _steps(spark, d))


def _stats(graded, steps):
    s = routes.step_stats(graded, steps)
    return s.select("route_id", "step_no", *[r(F.col(c), 4).alias(c) for c in s.columns[2:]])


BEARING = "(degrees(atan2(sin(radians({1}.lon - {0}.lon)) * cos(radians({1}.lat)), cos(radians({0}.lat)) * sin(radians({1}.lat)) - sin(radians({0}.lat)) * cos(radians({1}.lat)) * cos(radians({1}.lon - {0}.lon)))) + 360.0) % 360.0"


TURNS = f"""sp as (select ap.track_id, ap.seq, ap.dist_m, step_no, min(ap.dist_m) over w as d0, max(ap.dist_m) over w as d1, min(ap.seq) over w as i0, max(ap.seq) over w as i1 from ap join st on st.route_id = ap.track_id and ap.dist_m between d_start and d_end window w as (partition by ap.track_id, step_no)),
ix as (select track_id, step_no, min(i0) as i0, max(i1) as i1, greatest(max(seq) filter (where dist_m - d0 < 30.0), min(i0) + 1) as k, coalesce(least(min(seq) filter (where seq > i0 and d1 - dist_m < 30.0), max(i1) - 1), max(i1)) as k2 from sp group by track_id, step_no),
az as (select ix.track_id as route_id, step_no, {BEARING.format('a', 'b')} as entry, case when i1 > k2 then {BEARING.format('c', 'z')} end as out from ix join ap a on a.track_id = ix.track_id and a.seq = i0 left join ap b on b.track_id = ix.track_id and b.seq = k join ap c on c.track_id = ix.track_id and c.seq = k2 join ap z on z.track_id = ix.track_id and z.seq = i1),
az2 as (select route_id, step_no, entry, coalesce(out, entry) as out from az),
tn as (select route_id, step_no, round(entry, 4) as entry, round(out, 4) as exit, round((entry - lag(out) over (partition by route_id order by step_no) + 540.0) % 360.0 - 180.0, 4) as delta from az2)"""


@query(f"with {ROUTE}, {RA}, {NAMED}, {TURNS} select * from tn")
def turn_bearings(spark, d):
    return _bearings(_points(spark, d), _steps(spark, d))


def _bearings(points, steps):
    t = routes.turn_bearings(points, steps)
    return t.select("route_id", "step_no", *[r(F.col(c), 4).alias(c) for c in ("entry", "exit", "delta")])


@query(f"""with {ROUTE}, {ON_ROUTES}, ga as (select g.track_id, g.seq, g.grade, ap.arc_seq from g join ap on ap.track_id = g.track_id and ap.seq = g.seq),
v as (select *, case when grade > 4.05 and not coalesce(lag(grade) over (partition by track_id order by seq) > 4.05, false) then 1 else 0 end as st from ga), w as (select *, cast(sum(st) over (partition by track_id order by seq) as bigint) as run from v),
t as (select track_id as route_id, run, arc_seq, max(grade) as gm from w where grade > 4.05 group by 1, 2, 3), a as (select f.route_id, f.arc_seq, case when fwd then 1 else -1 end * 100 * e.de / greatest(e.length_m, 1e-6) as mean_grade from fx_route_edges f join fx_edges e on e.edge_id = f.edge_id),
j as (select t.*, mean_grade, max(gm) over (partition by t.route_id, run) as run_max, row_number() over (partition by t.route_id, run order by mean_grade desc, t.arc_seq) as rk from t join a on a.route_id = t.route_id and a.arc_seq = t.arc_seq)
select route_id, run, arc_seq, round(run_max, 4) as run_max from j where mean_grade > 4.0 or rk = 1""")
def violation_runs(spark, d):
    sign = F.when(F.col("fwd"), 1).otherwise(-1)
    means = _arcs(spark, d).select("route_id", "arc_seq", "edge_id", "fwd").join(view(spark, d, "fx_edges"), "edge_id").withColumn("mean_grade", sign * 100 * F.col("de") / F.greatest("length_m", F.lit(1e-6)))
    return routes.violation_runs(profile.windowed_grades(_points(spark, d)), means, 4.0).withColumn("run_max", r(F.col("run_max"), 4))


@query(f"with {RA}, {NAMED} select route_id, step_no, name, length_m from st where length_m >= 60.0 and not (starts_with(name, 'voie') or starts_with(name, 'piste') or starts_with(name, 'chemin') or starts_with(name, 'allée') or starts_with(name, 'rue sans'))")
def route_label_candidates(spark, d):
    return _steps(spark, d).where((F.col("length_m") >= 60.0) & ~F.col("name").rlike("^(voie|piste|chemin|allée|rue sans)")).select("route_id", "step_no", "name", "length_m")


@query(f"with {REQ}, f as (select req_id, nodes, min(tier) as first_tier, count(*) as times from rt group by req_id, nodes) select req_id, nodes, first_tier, times, cast(row_number() over (partition by req_id order by first_tier) - 1 as bigint) as route_no from f")
def distinct_routes(spark, d):
    numbered = network.same_as_tier(_routes(spark, d)).select("req_id", "tier", "route_no")
    of = _routes(spark, d).join(numbered, ["req_id", "tier"])
    return of.groupBy("req_id", "nodes", "route_no").agg(F.min("tier").alias("first_tier"), F.count("*").alias("times"))


@query("select req_id, window_m, tier_pct, (1000.0 + src)::double * (1 + tier_pct / 100.0::double) as budget_m from fx_requests, unnest([50, 100, 150]) as a(window_m), unnest([0, 10, 20, 50]) as b(tier_pct)")
def tier_grid(spark, d):
    cost = view(spark, d, "fx_requests").select("req_id", (F.lit(1000.0) + F.col("src")).alias("cost"))
    return network.tier_grid(cost, [0, 10, 20, 50], [50, 100, 150])


@query("""with t as (select src % 5 as req_id, cast(req_id % 4 as bigint) * 10 as tier, 1000.0::double + dst as length_m from fx_requests), b as (select *, coalesce(max(case when tier <= 0 then length_m end) over (partition by req_id), min(length_m) over (partition by req_id)) as reference_m from t)
select req_id, tier, length_m, reference_m, round((length_m / reference_m - 1) * 100, 6) as detour_pct, case when tier <= 0 then '+0 % (trajet le plus court)' else '+' || tier || ' % de détour' end as label, printf('variante_+%02dpct', tier) as slug from b""")
def detour_pct(spark, d):
    t = view(spark, d, "fx_requests").select((F.col("src") % 5).alias("req_id"), (F.col("req_id") % 4 * 10).cast("long").alias("tier"), (F.lit(1000.0) + F.col("dst")).alias("length_m"))
    return routes.detour_pct(t).withColumns({"detour_pct": r(F.col("detour_pct")), "label": routes.tier_label(F.col("tier")), "slug": routes.tier_slug(F.col("tier"))})


@query("""with n as (select *, lead(lon) over w as lon2, lead(lat) over w as lat2 from fx_lines window w as (partition by line_id order by seq)), m as (select *, coalesce(sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2)), 0.0) as l from n),
s as (select *, coalesce(sum(l) over (partition by line_id order by seq rows between unbounded preceding and 1 preceding), 0.0) as s, sum(l) over (partition by line_id) as t from m),
p as (select line_id, s as pos_deg, lon, lat from s where s > 0.2 * t and s < 0.7 * t union all select line_id, f * t, lon + (lon2 - lon) * (f * t - s) / l, lat + (lat2 - lat) * (f * t - s) / l from s, unnest([0.2::double, 0.7::double]) as u(f) where f * t >= s and f * t < s + l)
select line_id, round(pos_deg, 7) as pos_deg, round(lon, 7) as lon, round(lat, 7) as lat from p""")
def line_substring(spark, d):
    piece = routes.line_substring(view(spark, d, "fx_lines"), F.lit(0.2), F.lit(0.7))
    return piece.select("line_id", *[r(F.col(c), 7).alias(c) for c in ("pos_deg", "lon", "lat")])


def _far(c: str) -> str:
    return f"case when {c} >= 1000 then printf('%.1f km', {c} / 1000) else printf('%.0f m', {c}) end"


NOTES = f"""nt as (select *, list_filter([case when climb_m >= 40 and max_grade >= 2.0 then 'montée sur ' || {_far('climb_m')} || printf(' (+%.0f m), pente max %.1f %%', gain_m, round_even(max_grade, 1)) || case when steep_m > 0 then printf(', dont %.0f m à plus de 6 %%', steep_m) else '' end end,
  case when descent_m >= 40 then 'descente sur ' || {_far('descent_m')} || printf(' (pente min %.1f %%)', round_even(min_grade, 1)) end], lambda z: z is not null) as notes from ss)"""


@query(f"with {ROUTE}, {ON_ROUTES}, {RA}, {NAMED}, {STATS}, {NOTES} select route_id, step_no, notes from nt")
def step_notes(spark, d):
    return directions.step_notes(step_stats(spark, d)).select("route_id", "step_no", "notes")


@query(f"""with {ROUTE}, {ON_ROUTES}, {RA}, {NAMED}, {STATS}, {NOTES}, {TURNS}, {SPEED},
tt as (select track_id as route_id, max(dist_m) - min(dist_m) as length_m, coalesce(sum(greatest(dh, 0.0)), 0.0) as gain_m, coalesce(sum(l / greatest(3.5 / 3.6, least(32 / 3.6, speed))), 0.0) as time_s from v group by track_id),
ln as (select st.*, nt.notes, tn.delta, case when delta > 0 then 'droite' else 'gauche' end as side from st join nt on nt.route_id = st.route_id and nt.step_no = st.step_no join tn on tn.route_id = st.route_id and tn.step_no = st.step_no),
ct as (select tt.*, k.n from tt join (select route_id, max(step_no) + 1 as n from ln group by route_id) k on k.route_id = tt.route_id)
select route_id, step_no as line_no, printf('%2d', step_no) || '. ' || case when delta is null then 'Partir sur' when abs(delta) < 25 then 'Continuer tout droit sur' when abs(delta) < 60 then 'Légèrement à ' || side || ' sur' when abs(delta) < 135 then 'Tourner à ' || side || ' sur'
  else 'Faire demi-tour (virage serré à ' || side || ') sur' end || ' **' || name || '** — ' || {_far('length_m')} || case when len(notes) = 0 then '' else '  ' || chr(10) || '    ' || case when starts_with(notes[1], 'montée') then '⛰ ' else '↘ ' end || array_to_string(notes, ' ; ') end as line from ln
union all select route_id, 0, 'Départ : début ' || route_id from ct
union all select route_id, n, printf('%2d', n) || '. Arrivée : fin ' || route_id || ' — total ' || {_far('length_m')} || printf(', %.0f min, D+ %.0f m', time_s / 60, round(gain_m, 6)) from ct""")
def directions_text(spark, d):
    steps = _steps(spark, d).join(step_notes(spark, d), ["route_id", "step_no"]).join(turn_bearings(spark, d), ["route_id", "step_no"])
    totals = profile.track_metrics(_points(spark, d)).withColumnRenamed("track_id", "route_id")
    named = totals.select("route_id", F.concat(F.lit("début "), "route_id").alias("start_name"), F.concat(F.lit("fin "), "route_id").alias("end_name"))
    return directions.directions_text(steps, totals, named)


@query(f"""with {ROUTE}, rn as (select distinct track_id, 'R&D <' || track_id || '>' as name from ap)
select track_id, 1 as part, seq as line_no, printf('      <trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele></trkpt>', round(lat, 8), round(lon, 8), round(elev_m, 1)) as line from ap union all
select track_id, u.p, u.n, case u.p * 10 + u.n when 0 then '<?xml version="1.0" encoding="UTF-8"?>' when 1 then '<gpx version="1.1" creator="slopeworks" xmlns="http://www.topografix.com/GPX/1/1">' when 2 then '  <trk>'
  when 3 then '    <name>' || replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</name>' when 4 then '    <trkseg>' when 20 then '    </trkseg>' when 21 then '  </trk>' else '</gpx>' end
from rn, (values (0, 0::bigint), (0, 1), (0, 2), (0, 3), (0, 4), (2, 0), (2, 1), (2, 2)) as u(p, n)""")
def gpx_lines(spark, d):
    points = _points(spark, d)
    return reports.gpx_lines(points, _route_names(points))


def _route_names(points):
    return points.select("track_id").distinct().withColumn("name", F.concat(F.lit("R&D <"), F.col("track_id"), F.lit(">")))


def _features(spark, d):
    """Features of every route. What several tables read is written once: a plan that holds it several times over weighs on the driver."""
    points, steps = network.written(_points(spark, d)), network.written(_steps(spark, d))
    graded = network.written(profile.windowed_grades(points))
    notes = directions.step_notes(_stats(graded, steps)).select("route_id", "step_no", "max_grade", "notes")
    told = network.written(steps.join(notes, ["route_id", "step_no"]).join(_bearings(points, steps).select("route_id", "step_no", "delta"), ["route_id", "step_no"]))
    metrics = network.written(profile.track_metrics(points))
    return network.written(reports.geojson_features(graded, metrics, told, _route_names(points)))


WORD = "case when delta is null then 'Partir sur' when abs(delta) < 25 then 'Continuer tout droit sur' when abs(delta) < 60 then 'Légèrement à ' || side || ' sur' when abs(delta) < 135 then 'Tourner à ' || side || ' sur' else 'Faire demi-tour (virage serré à ' || side || ') sur' end"
TENTH = "printf('%.1f', round_even({0} * 10.0, 0) / 10.0 + 0.0::double)"
WHOLE = " || ".join(f"""',"{c}":' || cast(round_even({c}, 0) as bigint)""" for c in ("length_m", "steep_len_m", "gain_m", "loss_m", "time_s"))
FEATURES = f"""tm as (select track_id, max(dist_m) - min(dist_m) as length_m, greatest(max(grade), 0.0) as max_grade_pct, coalesce(sum(greatest(dh, 0.0)), 0.0) as gain_m, coalesce(sum(greatest(-dh, 0.0)), 0.0) as loss_m,
  coalesce(sum(l / greatest(3.5 / 3.6, least(32 / 3.6, speed))), 0.0) as time_s from v group by track_id),
tl as (select track_id, sum(end_m - start_m) as steep_len_m from runs group by track_id), tq as (select tm.*, coalesce(steep_len_m, 0.0) as steep_len_m from tm left join tl on tl.track_id = tm.track_id),
fl as (select track_id, 'line' as kind, 0::bigint as no, '{{"type":"Feature","properties":{{"name":"R&D <' || track_id || '>"' || {WHOLE} || ',"max_grade_pct":' || {TENTH.format('max_grade_pct')} || '}},"geometry":{{"type":"LineString","coordinates":['
  || (select string_agg(printf('[%.6f,%.6f,%.1f]', round(lon, 8), round(lat, 8), round(elev_m, 1)), ',' order by seq) from ap where ap.track_id = tq.track_id) || ']}}}}' as feature from tq),
fs as (select ap.track_id, 'steep' as kind, run as no, '{{"type":"Feature","properties":{{"kind":"steep","from_m":' || cast(round_even(start_m, 0) as bigint) || ',"to_m":' || cast(round_even(end_m, 0) as bigint) || '}},"geometry":{{"type":"LineString","coordinates":['
  || string_agg(printf('[%.6f,%.6f]', round(lon, 8), round(lat, 8)), ',' order by seq) || ']}}}}' as feature from ap join runs on runs.track_id = ap.track_id and ap.dist_m between start_m - 1e-6 and end_m + 1e-6 group by ap.track_id, run, start_m, end_m having count(*) >= 2),
pt as (select st.route_id, st.step_no, arg_min(lon, seq) as lon, arg_min(lat, seq) as lat from ap join st on st.route_id = ap.track_id and ap.dist_m between d_start and d_end group by 1, 2),
fp as (select st.route_id as track_id, 'step' as kind, st.step_no as no, '{{"type":"Feature","properties":{{"kind":"step","n":' || st.step_no || ',"instruction":"' || {WORD} || '","name":' || to_json(st.name) || ',"length_m":' || cast(round_even(st.length_m, 0) as bigint) || ',"max_grade_pct":' || {TENTH.format('max_grade')}
  || ',"notes":' || to_json(notes) || '}},"geometry":{{"type":"Point","coordinates":' || printf('[%.6f,%.6f]', round(lon, 8), round(lat, 8)) || '}}}}' as feature
  from st join nt on nt.route_id = st.route_id and nt.step_no = st.step_no join (select *, case when delta > 0 then 'droite' else 'gauche' end as side from tn) t on t.route_id = st.route_id and t.step_no = st.step_no join pt on pt.route_id = st.route_id and pt.step_no = st.step_no),
fa as (select * from fl union all select * from fs union all select * from fp)"""
TOLD = f"{ROUTE}, {ON_ROUTES}, {RUNS}, {RA}, {NAMED}, {STATS}, {NOTES}, {TURNS}, {SPEED}, {FEATURES}"


@query(f"with {TOLD} select * from fa")
def geojson_route(spark, d):
    return _features(spark, d)


@query(f"""with {TOLD}, oc as (select track_id, feature, row_number() over w as line_no, lead(no) over w is null as last from fa window w as (partition by track_id order by case kind when 'line' then 0 when 'steep' then 1 else 2 end, no))
select track_id, line_no, feature || case when last then '' else ',' end as line from oc union all select track_id, 0, '{{"type":"FeatureCollection","features":[' from oc where last union all select track_id, line_no + 1, ']}}' from oc where last""")
def union_features(spark, d):
    return reports.union_features(_features(spark, d))


@query("select line_id, seq from fx_lines where lon > 2.39 and lon < 2.41 and lat > 48.8201 and lat < 48.8401 qualify count(*) over (partition by line_id) >= 2")
def points_in_extent(spark, d):
    return layers.points_in_extent(view(spark, d, "fx_lines"), 2.39, 2.41, 48.8201, 48.8401).select("line_id", "seq")


@query("""with n as (select line_id, lon, lat, lead(lon) over w - lon as dx, lead(lat) over w - lat as dy from fx_lines window w as (partition by line_id order by seq)),
k as (select line_id, greatest(0.0, case when dx <> 0 then least((2.3905 - lon) / dx, (2.3907 - lon) / dx) else 0 end, case when dy <> 0 then least((48.82 - lat) / dy, (48.83005 - lat) / dy) else 0 end) as t0,
  least(1.0, case when dx <> 0 then greatest((2.3905 - lon) / dx, (2.3907 - lon) / dx) else 1 end, case when dy <> 0 then greatest((48.82 - lat) / dy, (48.83005 - lat) / dy) else 1 end) as t1,
  (dx = 0 and lon not between 2.3905 and 2.3907) or (dy = 0 and lat not between 48.82 and 48.83005) as beside from n where dx is not null)
select distinct line_id from k where not beside and t0 <= t1""")
def line_intersects_box(spark, d):
    return layers.lines_in_box(view(spark, d, "fx_lines"), 2.3905, 2.3907, 48.82, 48.83005)
