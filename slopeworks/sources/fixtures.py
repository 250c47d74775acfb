"""Views that derive network, track and layer tables from the base tables; the same SQL runs in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("customer", "embeddings", "events", "lineitem", "orders", "part")

#: name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_nodes": ((), """
select p_partkey as node_id, p_partkey % 50 as gx, cast(floor(p_partkey / 50.0) as bigint) as gy,
       cast(238000 + p_partkey % 50 * 100 as double) / 100000 as lon,
       cast(4882000 + cast(floor(p_partkey / 50.0) as bigint) * 100 as double) / 100000 as lat,
       cast((p_partkey * 7919 + p_size * 31) % 8 as double) as elev
from part
"""),
    "fx_edges": (('fx_nodes',), """
select a.node_id * 2 as edge_id, a.node_id as u, b.node_id as v,
       cast(70 + (a.node_id * 13) % 60 as double) as length_m, b.elev - a.elev as de,
       true as allow_fwd, (a.node_id % 7) <> 0 as allow_bwd
from fx_nodes a join fx_nodes b on b.node_id = a.node_id + 1
where a.gx < 49 and (a.node_id * 31 + a.gy * 7) % 10 < 9
union all
select a.node_id * 2 + 1, a.node_id, b.node_id,
       cast(80 + (a.node_id * 17) % 70 as double), b.elev - a.elev, true, (a.node_id % 11) <> 0
from fx_nodes a join fx_nodes b on b.node_id = a.node_id + 50
where (a.node_id * 37 + a.gy * 3) % 10 < 9
"""),
    # A trip in three goes across the whole network, the others up to 6 columns and 5 rows.
    "fx_requests": ((), """
select req_id, src, case when req_id % 3 = 0 then far else least(49, greatest(0, src % 50 + dx)) + 50 * least(top, greatest(0, cast(floor(src / 50.0) as bigint) + dy)) end as dst
from (select c_custkey as req_id, (c_custkey * 97) % n as src, (c_custkey * 389 + 31) % n as far, (c_custkey * 389 + 31) % 13 - 6 as dx, (c_custkey * 31 + 7) % 11 - 5 as dy, cast(floor(n / 50.0) as bigint) - 1 as top
      from customer cross join (select count(*) as n from part) t) trips
"""),
    "fx_points": ((), """
select user_id as track_id,
       cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as seq,
       cast(cast(sum(1 + event_id % 20) over (partition by user_id order by ts, event_id
            rows between unbounded preceding and current row) as bigint) as double) as dist_m,
       cast(cast(floor(value) as bigint) % 12 as double) as elev_m
from events
"""),
    "fx_route_arcs": ((), """
select user_id as route_id,
       cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as seq,
       case when event_type in ('error', 'signup') then null else event_type end as name,
       case event_type when 'error' then 'service' when 'signup' then 'footway' else 'residential' end as road_class,
       cast(1 + event_id % 60 as double) as length_m
from events
"""),
    "fx_segments": ((), """
select o_orderkey as seg_id, case when o_orderstatus = 'P' then 'rail' else 'road' end as subtype,
       case o_orderpriority when '1-URGENT' then 'primary' when '2-HIGH' then 'residential'
            when '3-MEDIUM' then 'footway' when '4-NOT SPECIFIED' then 'cycleway' else 'motorway' end as class,
       case when o_custkey % 3 = 0 then 'sidewalk' when o_custkey % 3 = 1 then 'crosswalk' end as subclass
from orders
"""),
    "fx_connectors": ((), """
select distinct l_orderkey as seg_id, cast(l_linenumber as double) / 8 as at, l_partkey as connector_id
from lineitem
"""),
    "fx_access": ((), """
select l_orderkey as seg_id,
       cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as bigint) as ord,
       case l_returnflag when 'R' then 'denied' when 'A' then 'allowed' else 'designated' end as access_type,
       case when l_quantity < 17 then 'forward' when l_quantity < 34 then 'backward' end as heading,
       l_discount > 0.055 as has_during,
       l_suppkey % 9 = 0 as has_recognized,
       case when l_tax < 0.025 then null when l_tax < 0.055 then 'bicycle' else 'foot' end as mode
from lineitem
"""),
    "fx_layers": ((), """
select p_partkey as id,
       case p_type when 'ECONOMY' then 'park' when 'SMALL' then 'cemetery' when 'MEDIUM' then 'education'
            when 'LARGE' then 'developed' when 'PROMO' then 'recreation' else 'forest' end as subtype,
       case when p_size % 3 = 0 then 'industrial' when p_size % 3 = 1 then 'grass' else 'other' end as class,
       cast(238000 + p_partkey % 50 * 100 as double) / 100000 as xmin,
       cast(238000 + p_partkey % 50 * 100 + p_size * 10 as double) / 100000 as xmax,
       cast(4882000 + cast(floor(p_partkey / 50.0) as bigint) * 100 as double) / 100000 as ymin,
       cast(4882000 + cast(floor(p_partkey / 50.0) as bigint) * 100 + p_size * 10 as double) / 100000 as ymax
from part
"""),
    "fx_tiles": ((), """
select 14 as z, 8300 + vec_id % 20 as x, 5630 + cast(floor(vec_id / 20.0) as bigint) as y, embedding as pixels
from embeddings
"""),
    "fx_lines": (('fx_nodes',), """
select gy as line_id, gx as seq, lon, lat + (gx % 3) * cast(0.0002 as double) as lat
from fx_nodes
"""),
    "fx_edge_points": (('fx_edges', 'fx_nodes'), """
select e.edge_id, k.k as seq, e.length_m * k.k / 6 as dist_m,
       a.lon + (b.lon - a.lon) * k.k / 6 as lon, a.lat + (b.lat - a.lat) * k.k / 6 as lat,
       a.elev + e.de * k.k / 6 + case when k.k in (0, 6) then 0 else (e.edge_id * k.k) % 3 end as elev_m
from fx_edges e join fx_nodes a on a.node_id = e.u join fx_nodes b on b.node_id = e.v
cross join (select distinct cast(l_linenumber - 1 as bigint) as k from lineitem where l_linenumber <= 7) k
"""),
    "fx_route_edges": (('fx_edges', 'fx_nodes'), """
select a.gy as route_id, cast(row_number() over (partition by a.gy order by e.edge_id) - 1 as bigint) as arc_seq, e.edge_id, a.gx % 5 <> 0 as fwd, e.length_m,
       case when a.gx % 12 >= 4 then concat('rue ', cast(a.gx - a.gx % 4 as varchar(9))) end as name,
       case when a.gx % 2 = 0 then 'service' else 'residential' end as road_class
from fx_edges e join fx_nodes a on a.node_id = e.u where e.edge_id % 2 = 0
"""),
    "fx_edge_names": (('fx_edges', 'fx_nodes'), """
select e.edge_id, case when (a.gx + a.gy) % 12 < 4 then null when e.edge_id % 2 = 0 then concat('rue ', cast(a.gy as varchar(9))) else concat('avenue ', cast(a.gx as varchar(9))) end as name,
       case when a.gx % 2 = 0 then 'service' else 'residential' end as road_class
from fx_edges e join fx_nodes a on a.node_id = e.u
"""),
    "fx_flags": ((), """
select l_orderkey as seg_id, case when l_suppkey % 2 = 0 then 'is_bridge' else 'is_tunnel' end as flag,
       case when l_quantity < 25 then cast(floor(l_quantity / 5) as double) / 10 end as from_at,
       case when l_quantity < 25 then cast(floor(l_quantity / 5) as double) / 10 + cast(0.4 as double) end as to_at
from lineitem where l_discount > 0.075
"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view over the tables in ``sf_dir``."""
    needed, sql = VIEWS[name]
    for other in needed:
        view(spark, sf_dir, other).createOrReplaceTempView(other)
    for base in BASE:
        if base in sql:
            spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, with the views it reads in front."""
    named: list[str] = []

    def add(text: str) -> None:
        for name, (_, own) in VIEWS.items():
            if name in text and name not in named:
                add(own)
                if name not in named:
                    named.append(name)

    add(sql)
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in named)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}" if named else body
    return f"with {ctes}\n{body}" if named else body
