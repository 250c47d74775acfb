"""Registered queries of layer sources and geometries, each with its SQL for DuckDB."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from slopeworks.functions import geo
from slopeworks.operators import layers, network, streets
from slopeworks.registry import query, r
from slopeworks.sources import geometry
from slopeworks.sources import layers as files
from slopeworks.sources.fixtures import view


def _parts(df, by, *order):
    """Vertices gathered into one part per ``by``."""
    own = F.array_sort(F.collect_list(F.struct(*order, "lon", "lat")))
    return df.groupBy(*by).agg(own.alias("v")).select(*by, F.struct(F.col("v.lon").alias("xs"), F.col("v.lat").alias("ys")).alias("p"))


def _lines(spark, d):
    """Every line as a binary LineString."""
    p = _parts(view(spark, d, "fx_lines"), ["line_id"], "seq")
    return p.select("line_id", geometry.wkb_encode(F.lit("LineString"), F.array("p")).alias("geometry"))


@query("select line_id, 'LineString' as kind, cast(0 as integer) as part, cast(row_number() over (partition by line_id order by seq) - 1 as integer) as seq, lon, lat from fx_lines")
def wkb_decode(spark, d):
    n = _lines(spark, d).withColumn("g", geometry.wkb_decode(F.col("geometry"))).withColumn("kind", F.col("g.kind"))
    return geometry.vertices_of(n, keep=("line_id", "kind"))


@query("""with l as (select *, line_id // 2 as id, cast(line_id % 2 as integer) as part from fx_lines)
select id, part, cast(row_number() over (partition by id, part order by seq) - 1 as integer) as seq, round(radians(lon) * 6378137.0, 3) as x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) as y from l""")
def explode_parts(spark, d):
    p = _parts(view(spark, d, "fx_lines"), ["line_id"], "seq").withColumn("id", F.floor(F.col("line_id") / 2))
    multi = p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_id", "p"))).alias("l")).select("id", geometry.wkb_encode(F.lit("MultiLineString"), F.col("l.p")).alias("geometry"))
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    return geometry.vertices_of(multi.withColumn("g", geometry.wkb_decode(F.col("geometry")))).select("id", "part", "seq", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query('select seg_id from fx_connectors group by seg_id having count(*) >= 2 and max("at") > min("at")')
def valid_geometry(spark, d):
    c = view(spark, d, "fx_connectors").withColumns({"lon": 2.38 + F.col("at") * 0.001, "lat": F.lit(48.82)})
    p = _parts(c, ["seg_id"], "at").withColumn("g", geometry.wkb_decode(geometry.wkb_encode(F.lit("LineString"), F.array("p"))))
    return network.valid_geometry(p, F.col("g"), F.size("p.xs")).select("seg_id")


@query("select route_id, seq, name from fx_route_arcs")
def primary_name(spark, d):
    n = view(spark, d, "fx_route_arcs").withColumn("names", F.when(F.col("name").isNotNull(), F.struct(F.col("name").alias("primary")))).drop("name")
    return n.select("route_id", "seq", F.col("names.primary").alias("name"))


EXTENT = "x as (select min(lon) as x0, min(lon) + 0.5 * (max(lon) - min(lon)) as x1, min(lat) as y0, min(lat) + 0.5 * (max(lat) - min(lat)) as y1 from fx_nodes)"


def _extent(spark, d):
    half = lambda c: F.min(c) + 0.5 * (F.max(c) - F.min(c))
    return view(spark, d, "fx_nodes").agg(F.min("lon").alias("x0"), half("lon").alias("x1"), F.min("lat").alias("y0"), half("lat").alias("y1"))


@query(f"with {EXTENT} select id, subtype, class from fx_layers, x where xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0")
def extent_filter(spark, d):
    return layers.extent_filter(view(spark, d, "fx_layers"), _extent(spark, d)).select("id", "subtype", "class")


@query("""select id, case when id % 3 = 0 then 'water area' when id % 3 = 1 and subtype in ('park', 'cemetery') then 'water line' end as style from fx_layers where id % 3 = 0 or (id % 3 = 1 and subtype in ('park', 'cemetery'))""")
def classify_water(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("Polygon", "LineString", "Point"))), (F.col("id") % 3 + 1).cast("int"))
    sub = F.when(F.col("subtype") == "park", "river").when(F.col("subtype") == "cemetery", "canal").otherwise("lake")
    return view(spark, d, "fx_layers").select("id", layers.classify_water(kind, sub).alias("style")).where("style is not null")


ORDER = "map {" + ", ".join(f"'{k}': {v}" for k, v in layers.ROAD_ORDER.items()) + "}"


@query(f"""with w as (select seg_id, subtype, class, 'street ' || (seg_id % 7) as name, {ORDER}[class] as o from fx_segments)
select seg_id, case when subtype = 'rail' then 'rail' else 'road ' || class end as style, case when subtype = 'road' then o end as draw_order, case when subtype = 'road' and class in {layers.LABELLED!r} then name end as label
from w where subtype = 'rail' or o is not null""")
def classify_ways(spark, d):
    s = view(spark, d, "fx_segments").withColumn("name", F.concat(F.lit("street "), F.col("seg_id") % 7))
    return layers.classify_ways(s).select("seg_id", "style", "draw_order", "label")


def _features(spark, d):
    """Boxes as binary polygons of a layer, lines as segments."""
    f = view(spark, d, "fx_layers").withColumn("layer", F.when(F.col("id") % 2 == 0, "land_use").otherwise("land"))
    ring = F.struct(F.array("xmin", "xmax", "xmax", "xmin", "xmin").alias("xs"), F.array("ymin", "ymin", "ymax", "ymax", "ymin").alias("ys"))
    area = f.select("layer", "id", "subtype", "class", F.lit(None).cast("string").alias("name"), geometry.wkb_encode(F.lit("Polygon"), F.array(ring)).alias("geometry"), *files.BOX)
    box = view(spark, d, "fx_lines").groupBy("line_id").agg(F.min("lon").alias("xmin"), F.max("lon").alias("xmax"), F.min("lat").alias("ymin"), F.max("lat").alias("ymax"))
    cls = F.when(F.col("line_id") % 2 == 0, "residential").otherwise("service")
    way = _lines(spark, d).join(box, "line_id").select(F.lit("segment").alias("layer"), F.col("line_id").alias("id"), F.lit("road").alias("subtype"), cls.alias("class"), F.concat(F.lit("street "), F.col("line_id") % 7).alias("name"), "geometry", *files.BOX)
    return area.unionByName(way)


MERC = "round(radians(lon) * 6378137.0, 3) as x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) as y"


@query(f"""with {EXTENT}, a as (select case when id % 2 = 0 then 'land_use' else 'land' end as layer, *, case when id % 2 = 1 then (case when subtype in ('forest', 'grass', 'shrub', 'wetland') then 'green' end)
  when subtype in ('park') then 'park' when subtype in ('recreation', 'agriculture', 'golf') or class in ('grass', 'garden', 'allotments', 'meadow') then 'green' when subtype = 'cemetery' then 'cemetery'
  when subtype in ('developed', 'construction', 'transportation') and class in ('industrial', 'railway', 'brownfield', 'construction') then 'industrial' when subtype = 'education' then 'school' end as style from fx_layers, x where xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0),
v as (select layer, id, style, null::integer as draw_order, null::varchar as label, u.seq, case when u.seq in (1, 2) then xmax else xmin end as lon, case when u.seq in (2, 3) then ymax else ymin end as lat from a, unnest([0, 1, 2, 3, 4]) as u(seq) where style is not null
union all select 'segment', line_id, case when line_id % 2 = 0 then 'road residential' else 'road service' end, case when line_id % 2 = 0 then 4 else 3 end, case when line_id % 2 = 0 then 'street ' || (line_id % 7) end, cast(row_number() over (partition by line_id order by seq) - 1 as integer), lon, lat from fx_lines
  where line_id in (select line_id from fx_lines, x group by line_id, x0, x1, y0, y1 having min(lon) <= x1 and max(lon) >= x0 and min(lat) <= y1 and max(lat) >= y0))
select layer, id, style, draw_order, label, cast(0 as integer) as part, seq, {MERC} from v""")
def prepare_layers(spark, d):
    n = layers.prepare_layers(_features(spark, d), _extent(spark, d))
    return n.withColumns({"x": r(F.col("x"), 3), "y": r(F.col("y"), 3)})


def _cached(spark, d):
    """The features of a folder, written once under a name that tells what they come from."""
    kinds = F.element_at(F.array(*[F.struct(F.lit(t).alias("theme"), F.lit(k).alias("type")) for t, k in files.LAYERS]), (F.col("id") % 5 + 1).cast("int"))
    n = view(spark, d, "fx_layers").withColumn("k", kinds).select("*", "k.*").drop("k")
    # One column that only some partitions have.
    height = n.where("type = 'building'").withColumn("height", F.col("id") * 1.0)
    both = files.union_promoted([n.where("type <> 'building'"), height])
    name = hashlib.sha256(f"{d}/{spark.sparkContext.applicationId}".encode()).hexdigest()[:16]
    return both, f"{network.scratch(spark)}/layers-{name}"


TYPES = "case id % 5 when 0 then 'segment' when 1 then 'water' when 2 then 'land_use' when 3 then 'land' else 'building' end"


@query(f"select {TYPES} as type, count(*) as features, count(case when id % 5 = 4 then 1 end) as heights, min(id) as first_id from fx_layers group by 1")
def union_promote(spark, d):
    return _cached(spark, d)[0].groupBy("type").agg(F.count("*").alias("features"), F.count("height").alias("heights"), F.min("id").alias("first_id"))


@query("select id, subtype, class, case when id % 5 = 4 then cast(id as double) end as height from fx_layers")
def layer_cache_sink(spark, d):
    df, path = _cached(spark, d)
    return files.layer_cache(df, path).select("id", "subtype", "class", "height")


@query(f"select {TYPES} as type, id, subtype, class, case when id % 5 = 4 then cast(id as double) end as height from fx_layers where xmin <= 2.41 and xmax >= 2.39 and ymin <= 48.8401 and ymax >= 48.8201")
def scan_bbox_multi(spark, d):
    df, path = _cached(spark, d)
    root = path + "-parts"
    df.write.mode("overwrite").partitionBy("theme", "type").parquet(root)
    found = files.scan_layers(spark, root, (2.39, 2.41, 48.8201, 48.8401))
    typed = [f.select(F.lit(k).alias("type"), "id", "subtype", "class", *(["height"] if "height" in f.columns else [])) for k, f in found.items()]
    return files.union_promoted(typed).withColumn("height", F.col("height").cast("double"))


@query("""with p as (select line_id, seq, line_id * 100 + seq as piece_id, lon, lat, lead(lon) over w as lon2, lead(lat) over w as lat2 from fx_lines window w as (partition by line_id order by seq)),
k as (select *, row_number() over (partition by line_id order by seq) - seq as isle from p where lon2 is not null and seq % 10 <> 9)
select 'street ' || (line_id % 7) as name, min(piece_id) as line_id, arg_min(case when piece_id % 3 = 0 then 'residential' else 'service' end, piece_id) as class, count(*) as pieces, count(*) + 1 as vertices, round(sum(sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2))), 9) as length_deg from k group by line_id, isle""")
def street_merge(spark, d):
    w = Window.partitionBy("line_id").orderBy("seq")
    p = view(spark, d, "fx_lines").withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w), "piece_id": F.col("line_id") * 100 + F.col("seq")}).where("lon2 is not null and seq % 10 <> 9")
    turned = F.col("piece_id") % 2 == 0  # pieces lie either way round
    pair = lambda a, b: F.when(turned, F.array(a, b)).otherwise(F.array(b, a))
    cls = F.when(F.col("piece_id") % 3 == 0, "residential").otherwise("service")
    n = streets.street_merge(p.select("piece_id", F.concat(F.lit("street "), F.col("line_id") % 7).alias("name"), cls.alias("class"), pair("lon", "lon2").alias("xs"), pair("lat", "lat2").alias("ys")))
    step = lambda i: F.sqrt(F.pow(F.get("xs", i) - F.get("xs", i - 1), 2) + F.pow(F.get("ys", i) - F.get("ys", i - 1), 2))
    length = F.aggregate(F.sequence(F.lit(1), F.size("xs") - 1), F.lit(0.0), lambda a, i: a + step(i))
    return n.select("name", "line_id", "class", "pieces", F.size("xs").cast("long").alias("vertices"), r(length, 9).alias("length_deg"))
