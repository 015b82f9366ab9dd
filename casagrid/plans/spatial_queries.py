"""Registered queries: spatial joins, zone scores, territory and property scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from casagrid.functions.numbers import round_stat
from casagrid.operators import scoring as Z
from casagrid.operators import search as S
from casagrid.operators import spatial as G
from casagrid.operators.quantiles import summarize
from casagrid.plans.inputs import CACHE, base, curated, more_columns, rnd, view
from casagrid.plans.registry import query, shared
from casagrid.sources.projections import table
from casagrid.sources.tables import join_rows, spread, stored

# Zone layer: 5 × 5 rectangles over the region keys; every fourth one has a rectangular hole.
IDX = "(r*5+c)"
ZONE = [
    (f"cast({IDX} as bigint)", "feature_idx"),
    (f"concat('Zona ', cast({IDX} as string))", "zone"),
    ("-3.466005e1 + cast(r as double)*2.2e-2", "south"),
    ("-3.466005e1 + cast(r+1 as double)*2.2e-2", "north"),
    ("-5.870005e1 + cast(c as double)*1.8e-2", "west"),
    ("-5.870005e1 + cast(c+1 as double)*1.8e-2", "east"),
    (f"case when {IDX}%6=5 then null else cast(({IDX}*37)%5*20 as double) end", "score"),
    (f"case when {IDX}%3=0 then 'explicita' else '' end", "level"),
    (f"cast(({IDX}*7)%11 as double)", "area"),
    (f"case when {IDX}%3=0 then 'high' when {IDX}%3=1 then 'medium' else 'low' end", "confidence"),
    (f"{IDX}%7=3", "needs_manual_review"),
    (f"{IDX}%4=1", "has_hole"),
    (f"cast({IDX}%10+1 as double)/2e0", "area_km2"),
    (f"concat('m', cast({IDX}%3 as string))", "source_method"),
    (f"concat('fuente ', cast({IDX}%4 as string))", "source"),
    (f"case when {IDX}%5=0 then null else {IDX}*3 end", "camera_count"),
    (f"case when {IDX}%4=2 then null else cast(({IDX}*17)%130 as double) end", "transport"),
    (f"case when {IDX}%7=1 then null else cast(({IDX}*23)%110-5 as double) end", "health"),
]
SETTLE = [
    ("s_suppkey", "feature_idx"),
    ("s_name", "settlement"),
    ("cast((s_suppkey%5)*25 as double)", "risk_score"),
    ("cast(100+(s_suppkey%4)*100 as double)", "radius_m"),
    ("case when s_suppkey%5=2 then null else cast((s_suppkey%3)*30 as double) end", "score"),
    ("case when s_suppkey%2=0 then concat('zona ', cast(cast(floor((s_suppkey*619)%1000*1.1e-4/2.2e-2)*5+floor((s_suppkey*389)%1000*1e-4/1.8e-2) as int) as string)) else '' end", "assigned_zone"),
    ("-3.4659947e1 + cast((s_suppkey*619)%1000 as double)*1.1e-4", "latitude"),
    ("-5.8699953e1 + cast((s_suppkey*389)%1000 as double)*1e-4", "longitude"),
]
SECPOINT = [
    ("c_custkey", "point_id"),
    ("case c_custkey%6 when 0 then 'camera' when 1 then 'safe_stop' when 2 then 'plate_reader' when 3 then 'police_station' when 4 then 'women_police_station' else 'neighborhood_alarm' end", "point_type"),
    ("-3.465997e1 + cast((c_custkey*733)%1000 as double)*1.1e-4", "latitude"),
    ("-5.869997e1 + cast((c_custkey*1409)%1000 as double)*1e-4", "longitude"),
]


def _cols(exprs) -> str:
    return ", ".join(f"{e} as {n}" for e, n in exprs)


shared("v_zone", f"select {_cols(ZONE)} from (select a.r_regionkey as r, b.r_regionkey as c from region a cross join region b)")
shared("v_wide", "select * replace (south-6.03e-3 as south, north+6.03e-3 as north, west-6.03e-3 as west, east+6.03e-3 as east) from v_zone", "v_zone")
shared("v_strip", "select r_regionkey as feature_idx, concat('Partido ', r_regionkey) as zone, -3.4665e1+r_regionkey*2.2e-2 as south, -3.4665e1+(r_regionkey+1)*2.2e-2 as north, -5.8705e1 as west, -5.8610e1 as east, 'low' as confidence, 'strip' as source_method, false as needs_manual_review from region where r_regionkey<4")
shared("v_column", "select r_regionkey as feature_idx, case r_regionkey when 0 then 'Hurlingham' when 1 then 'Villa Tesei' when 2 then 'William C. Morris' else concat('Localidad ', r_regionkey) end as zone, -3.4665e1 as south, -3.4550e1 as north, -5.870503e1+r_regionkey*1.9e-2 as west, -5.870503e1+(r_regionkey+1)*1.9e-2 as east, 'medium' as confidence, 'column' as source_method, false as needs_manual_review from region where r_regionkey<>3")
shared("v_settle", f"select *, latitude-8.03e-4 as south, latitude+8.03e-4 as north, longitude-8.03e-4 as west, longitude+8.03e-4 as east from (select {_cols(SETTLE)} from supplier)")
shared("v_secpoint", f"select {_cols(SECPOINT)} from customer")


def _ring(df, south="south", west="west", north="north", east="east"):
    return df.withColumn("rings", F.array(G.rectangle_rings(south, west, north, east)))


def zones(spark, folder, wide: bool = False):
    """The zone layer as a stored table, as a layer file would be."""
    return stored(spark, folder, f"zones_{wide}".lower(), lambda: _zones(spark, folder, wide))


def _zones(spark, folder, wide: bool):
    keys = table(spark, folder, "region").selectExpr("r_regionkey as r", "explode(sequence(0, 4)) as c")
    df = keys.selectExpr(*[f"{e} as {n}" for e, n in ZONE])
    if wide:
        for c, d in (("south", -6.03e-3), ("north", 6.03e-3), ("west", -6.03e-3), ("east", 6.03e-3)):
            df = df.withColumn(c, F.col(c) + F.lit(d))
        return _ring(df)
    hole = df.withColumns({"hs": F.col("south") + 6e-3, "hn": F.col("south") + 1.2e-2, "hw": F.col("west") + 5e-3, "he": F.col("west") + 1e-2})
    outer, inner = G.rectangle_rings("south", "west", "north", "east"), G.rectangle_rings("hs", "hw", "hn", "he")
    return hole.withColumn("rings", F.when(F.col("has_hole"), F.array(outer, inner)).otherwise(F.array(outer))).drop("hs", "hn", "hw", "he")


def settlements(spark, folder):
    return stored(spark, folder, "settlements", lambda: _settlements(spark, folder))


def _settlements(spark, folder):
    df = table(spark, folder, "supplier").selectExpr(*[f"{e} as {n}" for e, n in SETTLE])
    df = df.withColumns({"south": F.col("latitude") - 8.03e-4, "north": F.col("latitude") + 8.03e-4, "west": F.col("longitude") - 8.03e-4, "east": F.col("longitude") + 8.03e-4})
    return _ring(df)


def area_layer(df):
    return df.drop("latitude", "longitude", "south", "north", "west", "east")


def secpoints(spark, folder):
    return table(spark, folder, "customer").selectExpr(*[f"{e} as {n}" for e, n in SECPOINT])


def located(spark, folder):
    return spread(view(spark, folder, "v_location").select("property_id", "latitude", "longitude"))


def layer(df):
    return df.drop("south", "north", "west", "east")


IN_BOX = "latitude between south and north and longitude between west and east"
IN_HOLE = "(has_hole and latitude between south+6e-3 and south+1.2e-2 and longitude between west+5e-3 and west+1e-2)"
M_DEG = "(6371008.8*pi()/180)"
BOX_GAP = f"sqrt(pow(greatest(west-longitude,0,longitude-east)*cos(radians(latitude))*{M_DEG},2)+pow(greatest(south-latitude,0,latitude-north)*{M_DEG},2))"


def hav(lat1, lon1, lat2, lon2):
    return f"2*6371008.8*asin(sqrt(pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2)))"


shared("first_zone", f"select property_id, min(feature_idx) as feature_idx from v_location, v_zone where {IN_BOX} and not {IN_HOLE} group by property_id", "v_location", "v_zone")


@query(
    "first_covering_zone",
    "J9,G3",
    oracle="select property_id, feature_idx, zone from first_zone join v_zone using (feature_idx)",
    uses=("first_zone",),
)
def first_covering_zone(spark, folder):
    return G.first_covering(located(spark, folder), layer(zones(spark, folder)), "property_id", ["feature_idx", "zone"])


def _q(e, p):
    return f"quantile_cont(cast({e} as double), {p})"


@query(
    "zone_price_m2_by_polygon",
    "J9,A1,A2,F1,Q4",
    oracle=f"""select zone, count(*) as total, {rnd('avg(price_m2)',4)} as avg, {rnd(_q('price_m2',.5),4)} as median, {rnd('stddev_pop(price_m2)',4)} as std,
      {rnd(_q('price_m2',.25),4)} as q1, {rnd(_q('price_m2',.75),4)} as q3 from curated join first_zone using (property_id) join (select feature_idx, zone from v_zone) using (feature_idx)
      where status='active' and operation='sale' and not is_hidden and price_m2 is not null group by zone order by total desc, zone limit 20""",
    uses=("curated", "first_zone"),
)
def zone_price_m2_by_polygon(spark, folder):
    df = S.search(curated(spark, folder), {}).filter(F.col("price_m2").isNotNull())
    placed = df.select("property_id", "latitude", "longitude", "price_m2")
    hit = G.first_covering(placed.drop("price_m2"), layer(zones(spark, folder)), "property_id", ["zone"])
    s = summarize(placed.join(hit, "property_id"), ["zone"], {"m2": "price_m2"}, {"median": 0.5, "q1": 0.25, "q3": 0.75})
    out = s.select("zone", F.col("n").alias("total"), *[round_stat(c, 4).alias(c) for c in ("avg", "median", "std", "q1", "q3")])
    return out.orderBy(F.desc("total"), "zone").limit(20)


for _last in (False, True):

    @query(
        "best_score_zone_last" if _last else "best_score_zone",
        "J10",
        oracle=f"""select property_id, feature_idx, zone, score from (select property_id, feature_idx, zone, score, row_number() over (partition by property_id
          order by coalesce(score,-1) desc, feature_idx {'desc' if _last else 'asc'}) as rn from v_location, v_wide where {IN_BOX}) where rn = 1""",
        uses=("v_location", "v_wide"),
    )
    def best_score_zone(spark, folder, last=_last):
        return G.best_score_covering(located(spark, folder), layer(zones(spark, folder, True)), "property_id", ["feature_idx", "zone", "score"], last)


@query(
    "smallest_zone",
    "J11",
    oracle=f"""select property_id, zone, area from (select property_id, zone, area, row_number() over (partition by property_id order by area, feature_idx) as rn from v_location, v_wide where {IN_BOX}) where rn = 1""",
    uses=("v_location", "v_wide"),
)
def smallest_zone(spark, folder):
    return G.smallest_covering(located(spark, folder), layer(zones(spark, folder, True)), "property_id", ["zone", "area"])


shared(
    "zone_or_near",
    f"""select property_id, zone, match, distance_m from (select *, row_number() over (partition by property_id order by kind, distance_m, feature_idx) as rn from
        (select property_id, feature_idx, zone, case when {IN_BOX} and not {IN_HOLE} then 0 else 1 end as kind, case when {IN_BOX} and not {IN_HOLE} then 'polygon' else 'nearest' end as match,
           {BOX_GAP} as distance_m from v_location, v_zone where latitude is not null) where kind = 0 or distance_m <= 800) where rn = 1""",
    "v_location",
    "v_zone",
)


@query(
    "zone_or_nearest",
    "J12,G2,G4",
    oracle=f"select property_id, zone, match, {rnd('distance_m', 3)} as distance_m from zone_or_near",
    uses=("zone_or_near",),
)
def zone_or_nearest(spark, folder):
    df = G.covering_or_nearest(located(spark, folder), layer(zones(spark, folder)), "property_id", ["zone"])
    return df.withColumn("distance_m", round_stat("distance_m", 3))


@query(
    "point_radius_zone",
    "J13",
    oracle=f"""select property_id, feature_idx, score from (select l.property_id, feature_idx, score, row_number() over (partition by l.property_id order by coalesce(score,-1) desc, feature_idx desc) as rn
      from v_location l, v_settle s where {hav('l.latitude','l.longitude','s.latitude','s.longitude')} <= radius_m) where rn = 1""",
    uses=("v_location", "v_settle"),
)
def point_radius_zone(spark, folder):
    feats = settlements(spark, folder).select("feature_idx", "score", "radius_m", "latitude", "longitude")
    return G.point_zone_match(located(spark, folder), feats, "property_id", ["feature_idx", "score"], 400.0)


shared("near_points", f"select property_id, point_id, point_type, cast(round({hav('l.latitude','l.longitude','s.latitude','s.longitude')}) as bigint) as dist from v_location l, v_secpoint s where {hav('l.latitude','l.longitude','s.latitude','s.longitude')} <= 500", "v_location", "v_secpoint")


@query("nearby_point_counts", "J14", oracle="select property_id, point_type, count(*) as n from near_points group by 1, 2", uses=("near_points",))
def nearby_point_counts(spark, folder):
    counts, _ = G.nearby_points(located(spark, folder), secpoints(spark, folder), "property_id")
    return counts.select("property_id", "point_type", "n")


@query(
    "nearby_point_list",
    "J14,O5",
    oracle="select property_id, string_agg(concat(dist, ':', point_id), ',' order by dist, point_id) as nearest from (select *, row_number() over (partition by property_id order by dist, point_id) as rn from near_points) where rn <= 8 group by property_id",
    uses=("near_points",),
)
def nearby_point_list(spark, folder):
    _, near = G.nearby_points(located(spark, folder), secpoints(spark, folder), "property_id")
    text = F.array_join(F.transform("nearest", lambda s: F.concat(s["dist"].cast("string"), F.lit(":"), s["point_id"].cast("string"))), ",")
    return near.select("property_id", text.alias("nearest"))


shared(
    "near_settle",
    f"""select property_id, settlement, distance_m from (select property_id, settlement, {BOX_GAP.replace('latitude', 'l.latitude').replace('longitude', 'l.longitude')} as distance_m, row_number() over (partition by property_id order by {BOX_GAP.replace('latitude', 'l.latitude').replace('longitude', 'l.longitude')}, feature_idx) as rn
        from v_location l, v_settle where l.latitude is not null and {BOX_GAP.replace('latitude', 'l.latitude').replace('longitude', 'l.longitude')} <= 1000) where rn = 1""",
    "v_location",
    "v_settle",
)


@query("nearest_settlement", "J15", oracle=f"select property_id, settlement, {rnd('distance_m',3)} as distance_m from near_settle", uses=("near_settle",))
def nearest_settlement(spark, folder):
    df = G.nearest_feature(located(spark, folder), area_layer(settlements(spark, folder)), "property_id", ["settlement"])
    return df.withColumn("distance_m", round_stat("distance_m", 3))


@query(
    "zone_by_name",
    "J16",
    oracle="""select p.property_id, min(feature_idx) as feature_idx from v_property p join v_zone z on lower(z.zone) in (lower(p.detected_neighborhood), lower(p.neighborhood), lower(p.inferred_neighborhood), lower(p.locality), lower(p.detected_locality)) group by 1""",
    uses=("v_property", "v_zone"),
)
def zone_by_name(spark, folder):
    names = ["detected_neighborhood", "neighborhood", "inferred_neighborhood", "locality", "detected_locality"]
    return Z.name_match(view(spark, folder, "v_property"), zones(spark, folder), "property_id", names, ["feature_idx"])


@query(
    "zone_box_conflicts",
    "J25",
    oracle="select a.feature_idx as left_idx, b.feature_idx as right_idx from v_wide a join v_wide b on a.feature_idx < b.feature_idx and a.south<=b.north and b.south<=a.north and a.west<=b.east and b.west<=a.east",
    uses=("v_wide",),
)
def zone_box_conflicts(spark, folder):
    return G.bbox_conflicts(layer(zones(spark, folder, True)))


@query(
    "camera_lattice_coverage",
    "G20",
    oracle=f"""with g as (select feature_idx, a, b, south+(a+0.5)*(north-south)/20 as latitude, west+(b+0.5)*(east-west)/20 as longitude from v_zone, (select range as a from range(20)), (select range as b from range(20)))
      select feature_idx, count(*) as lattice_points, {rnd('sum(hit)*100.0/count(*)', 4)} as coverage_pct from (select feature_idx, a, b, max(case when {hav('g.latitude','g.longitude','s.latitude','s.longitude')} <= 250 then 1 else 0 end) as hit
        from g, v_secpoint s group by 1, 2, 3) group by 1""",
    uses=("v_zone", "v_secpoint"),
)
def camera_lattice_coverage(spark, folder):
    df = G.lattice_coverage(layer(zones(spark, folder)), secpoints(spark, folder), 250.0)
    return df.withColumn("coverage_pct", round_stat("coverage_pct", 4))


_CANDIDATES = "array(concat('calle ', cast(p_partkey%100 as string)), concat('calle ', cast((p_partkey+1)%100 as string)), concat('calle ', cast((p_partkey*7)%100 as string)))"
shared(
    "v_resolved",
    """with a as (select p_partkey as property_id, case when p_partkey%7<>0 then [concat('calle ', p_partkey%100), concat('calle ', (p_partkey+1)%100), concat('calle ', (p_partkey*7)%100)] else [] end as cs from part),
      b as (select l.property_id, cs, l.latitude as la, l.longitude as lo, manually_corrected as mc, detected_latitude as dla, detected_longitude as dlo, neighborhood as source_zone from base l join v_more using (property_id) join a using (property_id)),
      h as (select property_id, min((pos, q, c.latitude, c.longitude)) as h from (select property_id, unnest(cs) as q, generate_subscripts(cs,1) as pos from b where la is null and dla is null) join v_cache c on c.query=q and c.latitude is not null group by 1)
      select property_id, source_zone, coalesce(la, dla, h[3]) as latitude, coalesce(lo, dlo, h[4]) as longitude, case when la is not null then case when mc then 'manual_location' else 'location' end when dla is not null then 'detected_coordinates' when h is not null then 'geocode_cache' else '' end as src,
        case when la is not null or dla is not null then 'not_needed' when len(cs)=0 then 'no_query' when h is null then 'cache_miss' when cs[1] in (select query from v_cache) then 'cache_hit' else 'cache_applied' end as status, h[2] as geocode_query from b left join h using (property_id)""",
    "base",
    "v_more",
    "v_cache",
)
shared(
    "v_inferred",
    f"""select *, case when latitude is null then 'no_coordinates' when zone is null then concat(src,'_no_match') else concat(src,'_',match) end as method from v_resolved left join (select property_id, zone, match, distance_m from (select *, row_number() over (partition by property_id order by kind, distance_m, feature_idx) as rn from
        (select property_id, feature_idx, zone, case when {IN_BOX} and not {IN_HOLE} then 0 else 1 end as kind, case when {IN_BOX} and not {IN_HOLE} then 'polygon' else 'nearest' end as match,
           {BOX_GAP} as distance_m from v_resolved, v_zone where latitude is not null) where kind = 0 or distance_m <= 800) where rn = 1) using (property_id)""",
    "v_resolved",
    "v_zone",
)


@query(
    "infer_zone",
    "G7,J20",
    oracle=f"""select property_id, coalesce(zone,'') as inferred_zone, method, {rnd('distance_m')} as distance_m, (source_zone<>'' and coalesce(zone,'')<>'' and source_zone<>coalesce(zone,'')) as zone_conflict, zone is null as needs_review,
      src as coordinate_source, status as geocoding_status, geocode_query from v_inferred""",
    uses=("v_inferred",),
)
def infer_zone(spark, folder):
    return _inferred(spark, folder).withColumn("distance_m", round_stat("distance_m"))


def _inferred(spark, folder):
    asked = table(spark, folder, "part").selectExpr("p_partkey as property_id", f"case when p_partkey%7<>0 then {_CANDIDATES} else cast(array() as array<string>) end as candidates")
    df = join_rows(join_rows(base(spark, folder).withColumn("source_zone", F.col("neighborhood")), more_columns(spark, folder), "property_id"), asked, "property_id")
    cols = ("property_id", "source_zone", "latitude", "longitude", "manually_corrected", "detected_latitude", "detected_longitude", "candidates")
    found = Z.resolve_coordinates(df.select(*cols), table(spark, folder, "customer").selectExpr(*[f"{e} as {n}" for e, n in CACHE]))
    return Z.infer_zone(found, layer(zones(spark, folder)).select("feature_idx", "zone", "rings"))


@query(
    "zone_inference_report",
    "A32",
    oracle="""select count(*) as processed, count(zone) as inferred, count(*) filter (match='polygon') as strict_polygon, count(*) filter (match='nearest') as nearest_fallback,
      count(*) filter (source_zone<>'' and zone<>'' and source_zone<>zone) as conflicts, count(*) filter (zone is null) as needs_review, count(*) filter (latitude is null) as no_data, count(*) filter (src='geocode_cache') as from_cache
      from v_inferred""",
    uses=("v_inferred",),
)
def zone_inference_report(spark, folder):
    return Z.zone_report(_inferred(spark, folder))


def _boxes(spark, folder, name: str):
    """Municipalities (strips) and localities (columns), with a gap in either layer."""
    r = "r_regionkey"
    df = table(spark, folder, "region").filter(f"{r} < 4" if name == "strip" else f"{r} <> 3")
    if name == "strip":
        df = df.selectExpr(f"{r} as feature_idx", f"concat('Partido ', cast({r} as string)) as zone", f"-3.4665e1+{r}*2.2e-2 as south", f"-3.4665e1+({r}+1)*2.2e-2 as north", "-5.8705e1 as west", "-5.8610e1 as east", "'low' as confidence")
    else:
        label = f"case {r} when 0 then 'Hurlingham' when 1 then 'Villa Tesei' when 2 then 'William C. Morris' else concat('Localidad ', cast({r} as string)) end as zone"
        df = df.selectExpr(f"{r} as feature_idx", label, "-3.4665e1 as south", "-3.4550e1 as north", f"-5.870503e1+{r}*1.9e-2 as west", f"-5.870503e1+({r}+1)*1.9e-2 as east", "'medium' as confidence")
    return layer(_ring(df.withColumns({"source_method": F.lit(name), "needs_manual_review": F.lit(False)})))


def _first(name: str, source: str, test: str) -> str:
    return f"{name} as (select property_id, zone, confidence, source_method, needs_manual_review from (select *, row_number() over (partition by property_id order by feature_idx) as rn from v_location, {source} where {test}) where rn=1)"


@query(
    "infer_territory",
    "G8",
    oracle=f"""with {_first('p', 'v_strip', IN_BOX)}, {_first('l', 'v_column', IN_BOX)}, {_first('z', 'v_zone', f'{IN_BOX} and not {IN_HOLE}')},
      n as (select property_id, zone, d from (select property_id, zone, {BOX_GAP} as d, row_number() over (partition by property_id order by {BOX_GAP}, feature_idx) as rn from v_location, v_zone where latitude is not null and {BOX_GAP} <= 2000) where rn=1),
      j as (select b.*, p.zone as pz, l.zone as lz, z.zone as zz, coalesce(case when z.zone is not null then z.confidence when l.zone is not null then l.confidence else p.confidence end, '') as conf, coalesce(case when z.zone is not null then z.source_method when l.zone is not null then l.source_method else p.source_method end, '') as sm, z.needs_manual_review as mr, n.zone as nz, n.d
        from base b left join p using (property_id) left join l using (property_id) left join z using (property_id) left join n using (property_id)),
      w as (select *, case when latitude is null then 'no_coordinates' else concat_ws(',', case when pz is null then 'no_municipality' end, case when lz is null then 'no_locality' end, case when zz is null then 'no_zone' end, case when mr then 'manual_review' end,
        case when neighborhood<>'' and zz<>'' and neighborhood<>zz then 'zone_conflict' end, case when locality<>'' and lz<>'' and locality<>lz then 'locality_conflict' end) end as reasons from j)
      select property_id, coalesce(pz,'') as municipality, coalesce(lz,'') as locality, coalesce(zz,'') as zone, conf as confidence, sm as source_method, reasons<>'' as needs_review, reasons as review_reasons, nz as nearest_zone, {rnd('d')} as nearest_m from w""",
    uses=("base", "v_location", "v_strip", "v_column", "v_zone"),
)
def infer_territory(spark, folder):
    df = base(spark, folder).select("property_id", "latitude", "longitude", F.col("neighborhood").alias("source_zone"), F.col("locality").alias("source_locality"))
    fine = layer(zones(spark, folder)).select("feature_idx", "zone", "confidence", "source_method", "needs_manual_review", "rings")
    out = Z.infer_territory(df, _boxes(spark, folder, "strip"), _boxes(spark, folder, "column"), fine)
    return out.withColumns({"review_reasons": F.array_join("review_reasons", ","), "nearest_m": round_stat("nearest_m")})


# Zones that are only a point, above the polygons in number: every third settlement.
_POINT_ZONE = "select feature_idx+100 as feature_idx, settlement as zone, score, case when feature_idx%4=0 then 'punto' else '' end as level, 'punto' as source, cast(null as bigint) as camera_count, latitude, longitude from v_settle where feature_idx%3=0"


@query(
    "score_security",
    "G9,L26",
    oracle=f"""with m as (select property_id, feature_idx, zone, score, level, source, camera_count from v_location, v_wide where {IN_BOX} union all select property_id, feature_idx, zone, score, level, source, camera_count from v_location l, ({_POINT_ZONE}) s where {hav('l.latitude','l.longitude','s.latitude','s.longitude')} <= 250),
      b as (select * from (select *, row_number() over (partition by property_id order by coalesce(score,-1) desc, feature_idx) as rn from m) where rn=1),
      t as (select property_id, point_type, count(*) as n from near_points group by 1,2), c as (select property_id, sum(n)::bigint as k, string_agg(concat(point_type,':',n), ',' order by point_type) as by_type from t group by 1),
      e as (select property_id, string_agg(concat(dist,':',point_id), ',' order by dist, point_id) as nearest from (select *, row_number() over (partition by property_id order by dist, point_id) as rn from near_points) where rn<=8 group by 1)
      select property_id, score as coverage_score, 100-score as risk_score, case when zone is null then '' when level<>'' then level when score is null then '' when score>=65 then 'alta' when score>=45 then 'media' else 'baja' end as security_level,
        coalesce(zone,'') as zone_label, source, camera_count, coalesce(k,0) as points_nearby, by_type as points_by_type, nearest from v_location left join b using (property_id) left join c using (property_id) left join e using (property_id)""",
    uses=("v_location", "v_wide", "v_settle", "near_points"),
)
def score_security(spark, folder):
    points = settlements(spark, folder).filter("feature_idx % 3 = 0").selectExpr(
        "feature_idx + 100 as feature_idx", "settlement as zone", "score", "case when feature_idx%4=0 then 'punto' else '' end as level", "'punto' as source", "cast(null as bigint) as camera_count", "latitude", "longitude"
    )
    places = view(spark, folder, "v_location").select("property_id", "latitude", "longitude")
    out = Z.score_security(places, layer(zones(spark, folder, True)), secpoints(spark, folder), point_zones=points, facts=["source", "camera_count"])
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("points_by_type")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    near = F.array_join(F.transform("nearest", lambda s: F.concat(s["dist"].cast("string"), F.lit(":"), s["point_id"].cast("string"))), ",")
    return out.withColumns({"points_by_type": kinds, "nearest": near})


_COMPONENTS = {"transport_score": "transport", "health_score": "health"}


def _clamped(c: str) -> str:
    return f"case when {c} is not null then greatest(0.0, least(100.0, {c})) end"


@query(
    "score_location",
    "G10,L26",
    oracle=f"""with pt as (select property_id, z.* from first_zone join v_zone z using (feature_idx)),
      nm as (select property_id, z.* from (select p.property_id, min(feature_idx) as feature_idx from v_property p join v_zone z on lower(z.zone) in (lower(p.detected_neighborhood), lower(p.inferred_neighborhood), lower(p.locality)) group by 1) join v_zone z using (feature_idx)),
      m as (select *, 'coordinates' as method from pt union all select *, 'zone' from nm where property_id not in (select property_id from pt)),
      h as (select l.property_id, s.feature_idx, risk_score from v_location l join pt on pt.property_id=l.property_id, v_settle s where {IN_BOX.replace('latitude', 'l.latitude').replace('longitude', 'l.longitude').replace('south', 's.south').replace('north', 's.north').replace('west', 's.west').replace('east', 's.east')}
        and (lower(pt.zone) not in (select assigned_zone from v_settle) or s.assigned_zone=lower(pt.zone))),
      f as (select property_id, max(risk_score) as flood_risk, count(*) as k, string_agg(concat(feature_idx, ':', risk_score::int), ',' order by risk_score desc, feature_idx) filter (rn<=3) as l from (select *, row_number() over (partition by property_id order by risk_score desc, feature_idx) as rn from h) group by 1)
      select b.property_id, coalesce(method,'') as match_method, coalesce(m.zone,'') as zone_name, m.score as overall_score, case when m.zone is null then '' when m.level<>'' then m.level when m.score is null then '' when m.score>=70 then 'alta' when m.score>=60 then 'media_alta' when m.score>=45 then 'media' else 'baja' end as value_level,
        {_clamped('m.transport')} as transport_score, {_clamped('m.health')} as health_score, flood_risk, k as flood_matches, l as flood_list,
        case when method='coordinates' then {rnd('distance_m',1)} end as settlement_m, case when method='coordinates' then settlement end as settlement
      from v_property b left join m using (property_id) left join f using (property_id) left join near_settle using (property_id)""",
    uses=("v_property", "first_zone", "near_settle"),
)
def score_location(spark, folder):
    df = base(spark, folder).select("property_id", "latitude", "longitude", "detected_neighborhood", "inferred_neighborhood", "locality")
    s = area_layer(settlements(spark, folder))
    names = ["detected_neighborhood", "inferred_neighborhood", "locality"]
    floods, settled = s.select("feature_idx", "risk_score", "assigned_zone", "rings"), s.select("feature_idx", "settlement", "rings")
    out = Z.score_location(df, layer(zones(spark, folder)), floods, settled, names, components=_COMPONENTS)
    listed = F.array_join(F.transform("flood_list", lambda x: F.concat(x["feature_idx"].cast("string"), F.lit(":"), x["risk_score"].cast("int").cast("string"))), ",")
    return out.withColumns({"settlement_m": round_stat("settlement_m", 1), "flood_list": listed})


@query(
    "score_backfill_changes",
    "L26",
    oracle=f"""select p.property_id, score as security_coverage_score, coalesce(zone,'') as inferred_zone from v_property p left join
      (select * from (select property_id, zone, score, row_number() over (partition by property_id order by coalesce(score,-1) desc, feature_idx) as rn from v_location, v_wide where {IN_BOX}) where rn=1) b using (property_id)
      where score is distinct from security_coverage_score or coalesce(zone,'') <> inferred_zone""",
    uses=("v_property", "v_location", "v_wide"),
)
def score_backfill_changes(spark, folder):
    fresh = Z.score_security(located(spark, folder), layer(zones(spark, folder, True)), secpoints(spark, folder))
    fresh = fresh.select("property_id", F.col("coverage_score").alias("security_coverage_score"), F.col("zone_label").alias("inferred_zone"))
    changed = Z.changed_rows(view(spark, folder, "v_property"), fresh, "property_id", ["security_coverage_score", "inferred_zone"])
    return changed.select("property_id", "security_coverage_score", "inferred_zone")


# Zone metrics derived from part: one zone per brand and size.
METRIC_KEYS = [
    "cameras_per_km2", "camera_coverage_250m_pct", "nearest_police_m", "police_station_count_per_km2", "women_police_station_count_per_km2", "safe_stop_count_per_km2", "plate_reader_count_per_km2",
    "commercial_pois_per_km2", "nearest_supermarket_m", "nearest_pharmacy_m", "green_area_pct", "nearest_park_m", "nearest_bus_stop_m", "bus_stops_per_km2", "nearest_train_station_m", "schools_per_km2",
    "nearest_school_m", "health_points_per_km2", "nearest_health_center_m", "distance_to_waterway_m", "distance_to_externality_m", "industrial_area_pct", "nearest_hospital_m", "official_bus_lines_count",
    "nearest_official_bus_route_m", "sube_points_count", "nearest_sube_point_m",
]


def _metric(i: int, name: str) -> str:
    span = 4000 if name.startswith(("nearest", "distance")) else 100
    return f"case when (n+{i})%9=4 then null else cast(((n+1)*{37 + 2 * i})%{span} as double) end"


METRICS = [("zone", "zone"), *[(_metric(i, m), m) for i, m in enumerate(METRIC_KEYS)]]
METRIC_BASE = "select p_brand||'/'||cast(p_size as varchar) as zone, cast(count(*) as bigint)*7+cast(max(p_partkey) as bigint) as n from part group by 1"
shared("v_metric", f"select {_cols(METRICS)} from ({METRIC_BASE})")


def zone_metrics(spark, folder):
    g = table(spark, folder, "part").groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("zone"))
    return g.agg((F.count(F.lit(1)) * 7 + F.max("p_partkey")).alias("n")).selectExpr(*[f"{e} as {n}" for e, n in METRICS])


def _mm(c: str) -> str:
    return f"(case when {c} is null then null when max({c}) over () = min({c}) over () then case when max({c}) over () > 0 then 100.0 else 0.0 end else ({c}-min({c}) over ())/(max({c}) over ()-min({c}) over ())*100 end)"


def _inv(c: str, cap: float) -> str:
    return f"(case when {c} is not null then greatest(0.0, least(100.0, 100*(1-greatest(0.0,least({float(cap)},{c}))/{float(cap)}))) end)"


def _ws(pairs) -> str:
    num = "+".join(f"coalesce(({v})*{w},0)" for v, w in pairs)
    den = "+".join(f"(case when ({v}) is null then 0 else {w}::double end)" for v, w in pairs)
    return rnd(f"(({num})/nullif({den},0))")


def _spec(spec) -> str:
    return _ws([({"density": lambda: f"n_{c}", "near": lambda: _inv(c, cap), "as is": lambda: c}[k](), w) for k, c, w, cap in spec])


def _norms(weights) -> str:
    cols = dict.fromkeys(c for s in weights.values() for k, c, _w, _p in s if k == "density")
    return ", ".join(f"{_mm(c)} as n_{c}" for c in cols)


_SEC = {"security_infrastructure_score": Z.SECURITY_WEIGHTS}
shared("sec_scored", f"select zone, {_spec(Z.SECURITY_WEIGHTS)} as security_infrastructure_score from (select *, {_norms(_SEC)} from v_metric)", "v_metric")
_FIVE = "case when {0} is null then null when {0}<20 then 'muy_baja' when {0}<40 then 'baja' when {0}<60 then 'media' when {0}<80 then 'media_alta' else 'alta' end"


@query(
    "security_infrastructure",
    "G13,W8,G11,G12",
    oracle=f"select zone, security_infrastructure_score, {_FIVE.format('security_infrastructure_score')} as security_level from sec_scored",
    uses=("sec_scored",),
)
def security_infrastructure(spark, folder):
    return Z.security_infrastructure(zone_metrics(spark, folder)).select("zone", "security_infrastructure_score", "security_level")


_FIRST = {k: v for k, v in Z.POI_WEIGHTS.items() if k != "walkability_proxy_score"}
shared(
    "poi_scored",
    f"select *, {_spec(Z.POI_WEIGHTS['walkability_proxy_score'])} as walkability_proxy_score from (select zone, nearest_bus_stop_m, {', '.join(f'{_spec(s)} as {n}' for n, s in _FIRST.items())} from (select *, {_norms(Z.POI_WEIGHTS)} from v_metric))",
    "v_metric",
)


@query("poi_zone_scores", "G14,W8", oracle=f"select zone, {', '.join(Z.POI_WEIGHTS)} from poi_scored", uses=("poi_scored",))
def poi_zone_scores(spark, folder):
    return Z.poi_scores(zone_metrics(spark, folder)).select("zone", *Z.POI_WEIGHTS)


@query(
    "official_zone_scores",
    "G15",
    oracle=f"select zone, {', '.join(f'{_spec(s)} as {n}' for n, s in Z.OFFICIAL_WEIGHTS.items())}, {_ws([('least(100.0, nearest_park_m/greatest(nearest_school_m,1)*1000)', 0.6), (_inv('nearest_pharmacy_m', 1500), 0.4)])} as urban_informality_score from (select *, {_norms(Z.OFFICIAL_WEIGHTS)} from v_metric)",
    uses=("v_metric",),
)
def official_zone_scores(spark, folder):
    df = Z.official_scores(zone_metrics(spark, folder))
    penalty = Z.settlement_penalty(F.col("nearest_park_m"), F.col("nearest_school_m"), F.col("nearest_pharmacy_m"))
    return df.select("zone", *Z.OFFICIAL_WEIGHTS, penalty.alias("urban_informality_score"))


def _overall_sql(model: str) -> str:
    vals = [(f"(100-{n[1:]})" if n.startswith("-") else n, w) for n, w in Z.OVERALL_WEIGHTS[model]]
    used = "+".join(f"(({v}) is not null)::int" for v, _ in vals)
    return f"{_ws(vals)} as overall_score, {used} as sources_count"


for _model in ("base", "official"):

    @query(
        f"overall_value_{_model}",
        "G16",
        oracle=f"""select zone, overall_score, sources_count, case when sources_count>=6 then 'medium_high' when sources_count>=4 then 'medium' when sources_count>=2 then 'low' else 'very_low' end as data_confidence,
          {_FIVE.format('overall_score')} as value_level from (select zone, {_overall_sql(_model)} from poi_scored join sec_scored using (zone) join (select zone, green_area_pct as urban_informality_score from v_metric) using (zone))""",
        uses=("poi_scored", "sec_scored", "v_metric"),
    )
    def overall_value(spark, folder, model=_model):
        df = Z.poi_scores(Z.security_infrastructure(zone_metrics(spark, folder))).withColumn("urban_informality_score", F.col("green_area_pct"))
        return Z.overall_value(df, model).select("zone", "overall_score", "sources_count", "data_confidence", "value_level")


OVERLAP = [
    ("concat('Zona ', cast(l_suppkey%40 as string))", "zone"),
    ("case when l_linenumber=1 then 'Muy Baja a Nula' when l_linenumber=2 then 'muy baja' when l_linenumber=3 then 'Média' when l_linenumber=4 then 'alta' when l_linenumber=5 then 'Muy Alta' else 'sin dato' end", "risk_text"),
    ("l_quantity", "area"),
    ("cast(100000+(l_suppkey%40)*100 as double)", "zone_area"),
    ("cast(20+l_orderkey%30 as double)", "source_area"),
    ("l_extendedprice", "households"),
    ("case when l_linenumber%4=0 then '' else concat('L', cast(l_partkey%60 as string)) end", "line"),
]
shared("v_overlap", f"select {_cols(OVERLAP)} from lineitem")
_FLOOD = "case when strip_accents(lower(risk_text)) like '%muy baja a nula%' then 5 when strip_accents(lower(risk_text)) like '%baja%' then 25 when strip_accents(lower(risk_text)) like '%media%' then 50 when strip_accents(lower(risk_text)) like '%alta%' then 75 else 0 end"


def overlaps(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*[f"{e} as {n}" for e, n in OVERLAP])


@query(
    "flood_by_zone",
    "A25,G19",
    oracle=f"""select zone, {rnd('sum(area)')} as overlap_m2, {rnd('sum(area)/max(zone_area)*100',4)} as overlap_pct, {rnd('sum(case when s>=50 then area else 0 end)')} as high_m2, sum(area)>0 as in_flood_risk_zone,
      {rnd('sum(area*s)/sum(area)')} as flood_penalty_score, {_FIVE.format('(sum(area*s)/sum(area))')} as flood_risk_level, nullif(max(s),0) as max_score from (select *, {_FLOOD} as s from v_overlap) group by zone""",
    uses=("v_overlap",),
)
def flood_by_zone(spark, folder):
    return Z.area_weighted_score(overlaps(spark, folder).withColumn("score", Z.flood_level_value("risk_text")))


@query("apportioned_households", "A26", oracle=f"select zone, {rnd('sum(households*least(1.0, area/source_area))')} as total from v_overlap group by zone", uses=("v_overlap",))
def apportioned_households(spark, folder):
    return Z.apportioned_sum(overlaps(spark, folder), "households")


@query(
    "route_lines",
    "A27",
    oracle="""select zone, count(*) as routes, count(distinct nullif(line,'')) as lines, coalesce((select string_agg(line, ',' order by line) from (select distinct line from v_overlap x where x.zone=o.zone and line<>'' order by line limit 30)),'') as line_names from v_overlap o group by zone""",
    uses=("v_overlap",),
)
def route_lines(spark, folder):
    return Z.route_lines(overlaps(spark, folder))


_TYPES = ["camera", "safe_stop", "plate_reader", "police_station", "women_police_station", "neighborhood_alarm"]
shared("zoned_points", f"select point_id, point_type, zone from v_secpoint, v_zone where {IN_BOX} and not {IN_HOLE}", "v_secpoint", "v_zone")


def zoned_points(spark, folder):
    pts = secpoints(spark, folder)
    hit = G.first_covering(pts.drop("point_type"), layer(zones(spark, folder)), "point_id", ["zone"])
    return pts.join(hit, "point_id")


@query(
    "infrastructure_by_zone",
    "A22",
    oracle=f"select zone, area_km2, {', '.join(f'count(*) filter (point_type={chr(39)}{t}{chr(39)}) as {t}_count, ' + rnd(f'count(*) filter (point_type={chr(39)}{t}{chr(39)})/area_km2', 4) + f' as {t}_per_km2' for t in _TYPES)} from v_zone left join zoned_points using (zone) group by zone, area_km2",
    uses=("v_zone", "zoned_points"),
)
def infrastructure_by_zone(spark, folder):
    return Z.infrastructure_by_zone(zoned_points(spark, folder), zones(spark, folder).select("zone", "area_km2"), _TYPES)


@query(
    "parcel_metrics",
    "A24",
    oracle=f"""select zone, count(area) as parcels, {rnd('count(area)/any_value(area_km2)',4)} as parcels_per_km2, {rnd('avg(area)',4)} as mean_area, {rnd('quantile_cont(area,0.5)',4)} as median_area, {rnd('quantile_cont(area,0.25)',4)} as p25_area, {rnd('quantile_cont(area,0.75)',4)} as p75_area
      from (select zone, area_km2 from v_zone) left join (select zone, area*source_area as area from v_overlap) using (zone) group by zone""",
    uses=("v_zone", "v_overlap"),
)
def parcel_metrics(spark, folder):
    parcels = overlaps(spark, folder).select("zone", (F.col("area") * F.col("source_area")).alias("area"))
    return Z.parcel_metrics(parcels, zones(spark, folder).select("zone", "area_km2"))


_TAG = {
    "amenity": "case p_partkey%9 when 0 then 'pharmacy' when 1 then 'school' when 2 then 'fuel' when 3 then 'bank' when 4 then 'recycling' else null end",
    "shop": "case p_partkey%8 when 0 then 'bakery' when 1 then 'supermarket' when 2 then 'shoes' else null end",
    "leisure": "case p_partkey%7 when 0 then 'park' when 1 then 'marina' else null end",
    "railway": "case p_partkey%11 when 0 then 'station' when 1 then 'rail' else null end",
    "highway": "case p_partkey%13 when 0 then 'bus_stop' when 1 then 'primary' else null end",
    "waterway": "case when p_partkey%17=0 then 'river' else '' end",
    "landuse": "case p_partkey%19 when 0 then 'industrial' when 1 then 'grass' else null end",
}
shared("v_poi", "select p_partkey as poi_id, concat('Zona ', p_partkey%25) as zone, " + ", ".join(f"{e} as {n}" for n, e in _TAG.items()) + " from part")
_B = {
    "amenities": "amenity in ('pharmacy','school','fuel','bank') or shop in ('bakery','supermarket')",
    "education_points": "amenity='school'",
    "health_points": "amenity='pharmacy'",
    "green_spaces": "leisure='park' or landuse='grass'",
    "transport_stops": "railway='station' or highway='bus_stop'",
    "transport_routes": "railway='rail'",
    "waterways": "waterway<>''",
    "externalities": "highway='primary' or railway='rail' or landuse='industrial' or amenity in ('fuel','recycling') or waterway<>''",
}


def pois(spark, folder):
    df = table(spark, folder, "part").selectExpr("p_partkey as poi_id", "concat('Zona ', p_partkey%25) as zone", *[f"{e} as {n}" for n, e in _TAG.items()])
    return df.withColumn("buckets", Z.poi_buckets({n: F.col(n) for n in _TAG}))


@query(
    "poi_routing",
    "G17",
    oracle=" union all ".join(f"select poi_id, '{b}' as bucket from v_poi where {t}" for b, t in _B.items()),
    uses=("v_poi",),
)
def poi_routing(spark, folder):
    return pois(spark, folder).select("poi_id", F.explode("buckets").alias("bucket"))


@query(
    "poi_by_zone",
    "A23",
    oracle=f"select zone, {', '.join(f'count(*) filter ({t}) as {b}_count, ' + rnd(f'count(*) filter ({t})/any_value(area_km2)', 4) + f' as {b}_per_km2' for b, t in _B.items())} from (select zone, area_km2 from v_zone) left join v_poi using (zone) group by zone",
    uses=("v_zone", "v_poi"),
)
def poi_by_zone(spark, folder):
    return Z.poi_by_zone(pois(spark, folder), zones(spark, folder).select("zone", "area_km2"), list(_B))


@query(
    "integrated_layer",
    "J18,J17",
    oracle="""select z.zone, case when b.zone is not null then b.amenity_density_score else null end as amenity_density_score, case when o.zone is not null then o.health else a.health end as health_access_score
      from (select distinct zone from v_metric) z left join (select zone, amenity_density_score from poi_scored) b using (zone)
      left join (select zone, health_access_score as health from poi_scored) a using (zone)
      left join (select zone, nearest_hospital_m as health from v_metric where nearest_hospital_m > 2000) o using (zone)""",
    uses=("v_metric", "poi_scored"),
)
def integrated_layer(spark, folder):
    m = zone_metrics(spark, folder)
    first = Z.poi_scores(m).select("zone", "amenity_density_score", "health_access_score")
    second = m.filter(F.col("nearest_hospital_m") > 2000).select("zone", F.col("nearest_hospital_m").alias("health_access_score"))
    return Z.integrate_layers(m.select("zone"), [first, second])
