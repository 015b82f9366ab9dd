"""Registered queries: GPS traces, trips, alerts, notes and the nearby search over positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casagrid.functions.numbers import round_stat
from casagrid.operators import search as S
from casagrid.operators import traces as T
from casagrid.plans.inputs import base, listings, rnd, view
from casagrid.plans.registry import query, shared
from casagrid.plans.spatial_queries import hav
from casagrid.session import ensure_checkpoint_dir
from casagrid.sources.projections import table

DRIVE = [
    ("user_id%7", "session_id"),
    ("event_id", "event_id"),
    ("1700000000000+event_id*1500", "ts_ms"),
    ("-3.46e1 + cast(event_id%200 as double)*6e-5", "latitude"),
    ("-5.865e1 + cast((event_id*3)%500 as double)*6e-5", "longitude"),
    ("case when event_id%17=0 then 8e1 else cast(12+event_id%5 as double) end", "accuracy"),
    ("case when event_id%5=0 then null else cast(event_id%9 as double) end", "speed"),
    ("cast((event_id*13)%360 as double)", "heading"),
    ("1700000000000+event_id*1500+(event_id%14)*1000-2000", "now_ms"),
]
UPLOAD = [
    ("user_id%10", "owner"),
    ("event_id%500", "session_id"),
    ("event_id", "arrived"),
    ("event_type", "kind"),
]
NOTE = [
    ("user_id%40", "note_id"),
    ("event_id", "arrived"),
    ("case when event_id%29=0 then 'delete' else 'put' end", "action"),
    ("event_id%3", "revision"),
    ("concat('m', cast(event_id%4 as string))", "mutation_id"),
]


def _sel(exprs) -> str:
    return ", ".join(f"{e} as {n}" for e, n in exprs)


for _name, _exprs in (("v_drive", DRIVE), ("v_upload", UPLOAD), ("v_note", NOTE)):
    shared(_name, f"select {_sel(_exprs)} from events")


def drive(spark, folder):
    return table(spark, folder, "events").selectExpr(*[f"{e} as {n}" for e, n in DRIVE])


@query("usable_positions", "R1", oracle="select session_id, event_id from v_drive where accuracy<=60 and now_ms-ts_ms between -1000 and 10000", uses=("v_drive",))
def usable_positions(spark, folder):
    return T.usable_positions(drive(spark, folder)).select("session_id", "event_id")


_TRIP_HAV = hav("plat", "plon", "latitude", "longitude").replace("6371008.8", "6371000.0")
shared(
    "steps",
    f"""select *, coalesce({_TRIP_HAV}, 0) as step_m, (ts_ms-pts)/1000.0::double as elapsed_s from (select *, lag(ts_ms) over w as pts, lag(latitude) over w as plat, lag(longitude) over w as plon from v_drive window w as (partition by session_id order by ts_ms, event_id))""",
    "v_drive",
)


@query(
    "trace_steps",
    "W9",
    oracle=f"""select session_id, event_id, {rnd('step_m',4)} as step_m, elapsed_s, {rnd('step_m/nullif(elapsed_s,0)*3.6',4)} as speed_kmh, {rnd('sum(step_m) over (partition by session_id order by ts_ms, event_id rows unbounded preceding)',3)} as total_m from steps""",
    uses=("steps",),
)
def trace_steps(spark, folder):
    out = T.trace_steps(drive(spark, folder))
    return out.select("session_id", "event_id", round_stat("step_m", 4).alias("step_m"), F.col("elapsed_s").cast("double").alias("elapsed_s"), round_stat("speed_kmh", 4).alias("speed_kmh"), round_stat("total_m", 3).alias("total_m"))


_ACCEPT = f"""with recursive p as (select *, row_number() over (partition by session_id order by ts_ms, event_id) as rn from v_drive where accuracy<=60),
  s as (select session_id, rn, event_id, ts_ms as pts, latitude as plat, longitude as plon, 0.0::double as distance_m, 'first' as reason from p where rn=1
    union all select session_id, rn, event_id, case when reason in ('movement','continuity') then ts_ms else pts end, case when reason in ('movement','continuity') then latitude else plat end, case when reason in ('movement','continuity') then longitude else plon end,
      case when reason='movement' then d else 0.0 end, reason from (select *, case when el<=0 then 'order' when d/(el/1000.0)*3.6>160 then 'jump' when el<3000 then 'interval' when d>=15 then 'movement' when el>=30000 then 'continuity' else 'noise' end as reason
        from (select p.*, s.pts, s.plat, s.plon, p.ts_ms-s.pts as el, {hav('s.plat','s.plon','p.latitude','p.longitude')} as d from s join p on p.session_id=s.session_id and p.rn=s.rn+1)))
  select session_id, event_id, reason in ('first','movement','continuity') as accepted, {rnd('distance_m',4)} as distance_m, reason from s
  union all select session_id, event_id, false, 0.0, 'accuracy' from v_drive where not accuracy<=60"""


@query("accepted_trace_points", "R2", oracle=_ACCEPT, uses=("v_drive",))
def accepted_trace_points(spark, folder):
    out = T.accept_trace_points(drive(spark, folder))
    return out.select("session_id", "event_id", "accepted", round_stat("distance_m", 4).alias("distance_m"), "reason")


@query("streamed_trace_points", "R2", oracle=_ACCEPT, uses=("v_drive",))
def streamed_trace_points(spark, folder):
    """The same rule as a stateful stream drained from the events file into a table."""
    import uuid

    from casagrid.streaming import streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_PROVIDER)
    events = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    path = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    streams.run_to_table(streams.accept_stream(stream.selectExpr(*[f"{e} as {n}" for e, n in DRIVE])), f"{path}/out", f"{path}/state")
    out = spark.read.schema("session_id long, event_id long, ts_ms long, accepted boolean, distance_m double, reason string").parquet(f"{path}/out")
    return out.select("session_id", "event_id", "accepted", round_stat("distance_m", 4).alias("distance_m"), "reason")


@query(
    "sampled_positions",
    "R16",
    oracle=f"""with recursive p as (select *, row_number() over (partition by session_id order by ts_ms, event_id) as rn from v_drive),
  s as (select session_id, rn, event_id, ts_ms as pts, latitude as plat, longitude as plon, true as hit from p where rn=1
    union all select session_id, rn, event_id, case when hit then ts_ms else pts end, case when hit then latitude else plat end, case when hit then longitude else plon end, hit from
      (select p.*, s.pts, s.plat, s.plon, p.ts_ms-s.pts >= 5000 and ({hav('s.plat','s.plon','p.latitude','p.longitude')} >= 60 or p.ts_ms-s.pts >= 15000) as hit from s join p on p.session_id=s.session_id and p.rn=s.rn+1))
  select session_id, event_id from s where hit""",
    uses=("v_drive",),
)
def sampled_positions(spark, folder):
    return T.sample_positions(drive(spark, folder)).select("session_id", "event_id")


def _course(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(degrees(atan2(sin(radians({lon2}-{lon1}))*cos(radians({lat2})), cos(radians({lat1}))*sin(radians({lat2}))-sin(radians({lat1}))*cos(radians({lat2}))*cos(radians({lon2}-{lon1}))))+360)%360"


def _turn(to: str, start: str) -> str:
    return f"((({to})-({start})+540)%360-180)"


# b: last base fix, a: anchor, cam: camera heading, mv: moving, mat / cat: when last moved and turned.
_HEADING = f"""with recursive p as (select *, row_number() over (partition by session_id order by ts_ms, event_id) as rn, case when speed>=0 then speed end as spd, case when heading between 0 and 360 then heading%360 end as told,
    case when latitude is null or longitude is null then 'invalid' when accuracy is null or accuracy>60 then 'accuracy' when ts_ms is null or ts_ms>now_ms+1000 or now_ms-ts_ms>10000 then 'stale' end as pre from v_drive),
  s as (select distinct session_id, 0::bigint as rn, null::bigint as event_id, null::bigint as bts, null::double as bla, null::double as blo, null::double as bac, null::bigint as ats, null::double as ala, null::double as alo, null::double as aac,
      null::double as cam, false as mv, null::bigint as mat, null::bigint as cat, '' as reason from v_drive
    union all select session_id, rn, event_id, case when lost then bts else ts_ms end, case when lost then bla else latitude end, case when lost then blo else longitude end, case when lost then bac else accuracy end,
      case when lost or r='short' then ats when r='vague' then null else ts_ms end, case when lost or r='short' then ala else latitude end, case when lost or r='short' then alo else longitude end, case when lost or r='short' then aac else accuracy end,
      case when r<>'go' then cam when cam is null then aim else (cam+least(0.75, greatest(0.2, 1-exp(-(ts_ms-cat)/1000.0::double/0.9)))*{_turn('aim','cam')}+360)%360 end,
      case when lost then mv when r in ('await','short') then mv1 else r='go' end, case when r='stop' then null when r='go' then ts_ms else mat end, case when r='go' then ts_ms else cat end,
      case r when 'vague' then 'heading-accuracy' when 'stop' then 'stopped' when 'await' then 'awaiting-movement' when 'short' then case when mv1 then 'moving' else 'awaiting-movement' end when 'go' then 'moving' else r end
    from (select *, case when told is not null and abs({_turn('told','way')})<=70 then told else way end as aim, r in ('invalid','accuracy','stale','order','jump') as lost from
      (select *, case when r2<>'reach' then r2 when pace<(case when mv1 then 2 else 2.5 end) or pace>55 or measured<2 then 'slow' else 'go' end as r, {_course('ala','alo','latitude','longitude')} as way from
        (select *, ad/nullif(ts_ms-ats,0)*1000 as measured, coalesce(spd, ad/nullif(ts_ms-ats,0)*1000) as pace, case when r1<>'on' then r1 when ts_ms-ats<700 or ad < (case when spd is null then greatest(10, aac+accuracy) when told is null then greatest(8, (aac+accuracy)*0.75) else greatest(8, least(15, (aac+accuracy)*0.5)) end) then 'short' else 'reach' end as r2 from
          (select *, {hav('ala','alo','latitude','longitude')} as ad, mv and mat is not null and ts_ms-mat<=4000 as mv1,
             case when pre is not null then pre when bts is not null and ts_ms<=bts then 'order' when bts is not null and {hav('bla','blo','latitude','longitude')}>55*(ts_ms-bts)/1000.0::double+bac+accuracy then 'jump' when accuracy>30 then 'vague' when spd<2 then 'stop' when ats is null or ts_ms-ats>12000 then 'await' else 'on' end as r1
           from (select p.*, s.bts, s.bla, s.blo, s.bac, s.ats, s.ala, s.alo, s.aac, s.cam, s.mv, s.mat, s.cat from s join p on p.session_id=s.session_id and p.rn=s.rn+1))))))
  select session_id, event_id, {rnd('cam',4)} as camera_heading, mv as moving, reason from s where rn>0"""


@query("tracked_heading", "R3,G6", oracle=_HEADING, uses=("v_drive",))
def tracked_heading(spark, folder):
    return T.track_heading(drive(spark, folder)).withColumn("camera_heading", round_stat("camera_heading", 4))


shared(
    "spot_groups",
    "select group_id, min(latitude) as latitude, min(longitude) as longitude, count(*) as group_count, min(property_id) as first_property from (select *, concat(printf('%.6f', latitude), ',', printf('%.6f', longitude)) as group_id from v_location where latitude is not null) group by 1",
    "v_location",
)
shared(
    "met",
    f"""select session_id, group_id, min(ts_ms) as first_seen, min(cast(round(d) as bigint)) as min_distance_m, any_value(group_count) as group_count from (select s.session_id, s.ts_ms, g.group_id, g.group_count, {hav('s.latitude','s.longitude','g.latitude','g.longitude')} as d from
      (select session_id, latitude, longitude, min(ts_ms) as ts_ms from v_drive group by 1,2,3) s, spot_groups g) where d<=350 group by 1,2""",
    "v_drive",
    "spot_groups",
)


def met(spark, folder):
    return T.accumulate_encounters(drive(spark, folder), view(spark, folder, "v_location"), 350.0)


@query("trip_encounters", "R4", oracle="select session_id, group_id, first_seen, min_distance_m, group_count, group_count as kept_properties from met", uses=("met",))
def trip_encounters(spark, folder):
    return met(spark, folder)


shared("v_favorite", "select user_id%7 as session_id, event_id%300 as property_id from events")


@query(
    "trip_properties",
    "R5",
    oracle="""with i as (select m.*, l.property_id from met m join (select property_id, concat(printf('%.6f', latitude), ',', printf('%.6f', longitude)) as group_id from v_location where latitude is not null) l using (group_id)), f as (select distinct session_id, property_id from v_favorite)
      select session_id, property_id, coalesce(group_id, concat('property-', property_id)) as group_id, first_seen, min_distance_m, coalesce(min_distance_m<=120,false) as passed_close, f.session_id is not null as favorite, coalesce(group_count>=5,false) as suspicious from i full join f using (session_id, property_id)""",
    uses=("met", "v_favorite"),
)
def trip_properties(spark, folder):
    favorites = table(spark, folder, "events").selectExpr("user_id%7 as session_id", "event_id%300 as property_id")
    return T.trip_properties(met(spark, folder), view(spark, folder, "v_location"), favorites)


_SIDE = _turn(_course("d.latitude", "d.longitude", "g.latitude", "g.longitude"), "d.heading")
_ALERTS = f"""with recursive c as (select session_id, ts_ms, event_id, group_id, first_property, dist, case when abs(side)<=35 then 'adelante' when abs(side)>=155 then 'detras' when side>0 then 'a tu derecha' when side<=0 then 'a tu izquierda' else '' end as direction
      from (select d.*, g.group_id, g.first_property, {hav('d.latitude','d.longitude','g.latitude','g.longitude')} as dist, case when d.heading is not null and d.speed>=2 then {_SIDE} end as side from v_drive d, spot_groups g
        where g.group_count<5 and abs(d.latitude-g.latitude)<0.002 and abs(d.longitude-g.longitude)<0.002) where dist<=120),
  f as (select session_id, ts_ms, event_id, list({{'g': group_id, 'd': direction, 'm': dist}} order by case when direction='adelante' then 0 else 1 end, dist, first_property) as options,
      row_number() over (partition by session_id order by ts_ms, event_id) as rn from c where direction<>'detras' group by 1,2,3),
  s as (select distinct session_id, 0::bigint as rn, null::bigint as event_id, []::varchar[] as told, null::struct(g varchar, d varchar, m double) as hit from f
    union all select session_id, rn, event_id, case when hit is null then told else list_append(told, hit.g) end, hit from
      (select f.session_id, f.rn, f.event_id, s.told, list_filter(f.options, lambda o: not list_contains(s.told, o.g))[1] as hit from s join f on f.session_id=s.session_id and f.rn=s.rn+1))
  select session_id, event_id, hit.g as group_id, hit.d as direction, {rnd('hit.m',4)} as distance_m from s where hit is not null"""


@query("proximity_alerts", "R6,G6", oracle=_ALERTS, uses=("v_drive", "spot_groups"))
def proximity_alerts(spark, folder):
    out = T.proximity_alerts(drive(spark, folder), view(spark, folder, "v_location"))
    return out.withColumn("distance_m", round_stat("distance_m", 4))


@query(
    "saved_trips",
    "R7",
    oracle="""select owner, session_id, arrived, kind from (select *, row_number() over (partition by owner, session_id order by arrived, kind) as rn from v_upload where kind<>'error') u where rn=1
      and not exists (select 1 from v_upload s where s.kind='error' and s.owner=u.owner and s.session_id=u.session_id)""",
    uses=("v_upload",),
)
def saved_trips(spark, folder):
    rows = table(spark, folder, "events").selectExpr(*[f"{e} as {n}" for e, n in UPLOAD])
    return T.save_trips(rows.filter(F.col("kind") == "error"), rows.filter(F.col("kind") != "error"))


@query(
    "trip_check",
    "R8",
    oracle=f"""select session_id, count(*) as points, max(ts_ms)-min(ts_ms) as duration_ms, {rnd('sum(step_m)',3)} as distance_m, case when count(*)>1500 then 'points' when max(ts_ms)-min(ts_ms)>604800000 then 'duration'
      when bool_or(coalesce(step_m > greatest(250, elapsed_s*75+100), false)) then 'jump' when sum(step_m)>2000000 then 'distance' else '' end as reason from steps group by 1""",
    uses=("steps",),
)
def trip_check(spark, folder):
    return T.trip_check(drive(spark, folder)).withColumn("distance_m", round_stat("distance_m", 3))


@query(
    "note_changes",
    "R9",
    oracle="""with recursive n as (select *, row_number() over (partition by note_id order by arrived) as rn from v_note),
      s as (select note_id, 0::bigint as rn, null::bigint as arrived, null::bigint as rev, null::varchar as mut, false as del, '' as outcome from (select distinct note_id from v_note)
        union all select note_id, rn, arrived, case outcome when 'created' then 1 when 'updated' then rev+1 else rev end, case when outcome in ('created','updated') then mutation_id else mut end, del or outcome='removed', outcome from
          (select n.*, s.rev, s.mut, s.del, case when s.del then 'deleted' when action='delete' then case when s.rev is null then 'ignored' else 'removed' end when s.rev is not null and s.mut=n.mutation_id then 'repeated'
             when s.rev is null and n.revision=0 then 'created' when s.rev is null or n.revision<>s.rev then 'conflict' else 'updated' end as outcome from s join n on n.note_id=s.note_id and n.rn=s.rn+1))
      select note_id, arrived, outcome, rev as revision_after from s where rn>0""",
    uses=("v_note",),
)
def note_changes(spark, folder):
    return T.apply_notes(table(spark, folder, "events").selectExpr(*[f"{e} as {n}" for e, n in NOTE]))


@query("trip_memory", "R10", oracle="select distinct group_id from met where session_id not in (2, 4)", uses=("met",))
def trip_memory(spark, folder):
    deleted = drive(spark, folder).filter(F.col("session_id").isin(2, 4)).select("session_id").distinct()
    return T.trip_memory(met(spark, folder), deleted)


@query("simplified_traces", "R11")
def simplified_traces(spark, folder):
    return T.simplify_traces(drive(spark, folder))


@query(
    "downsampled_traces",
    "W11",
    oracle="""select session_id, event_id from (select *, row_number() over (partition by session_id order by ts_ms, event_id) as place, count(*) over (partition by session_id) as n from v_drive
      where session_id in (select session_id from v_drive group by 1 order by max(ts_ms) desc, session_id desc limit 10)) where n>1 and ((place-1) % greatest(1, (n+198)//199) = 0 or place=n)""",
    uses=("v_drive",),
)
def downsampled_traces(spark, folder):
    return T.downsample(T.latest_trips(drive(spark, folder), 10)).select("session_id", "event_id")


_ELIGIBLE = """operation='sale' and status='active' and not is_hidden and not outside_target and precision_kind in ('exact','manual') and ((currency='USD' and price between 1000 and 5000000) or (currency<>'USD' and price>0))
      and (precision_kind='manual' or manually_corrected or location_confidence in ('high','medium')) and property_id in (select property_id from v_listing where active)"""
shared("near_ok", f"select property_id, latitude, longitude, concat(printf('%.6f', latitude), ',', printf('%.6f', longitude)) as group_id from base where {_ELIGIBLE}", "base", "v_listing")


def _nearby_sql(limit: int) -> str:
    return f"""with g as (select group_id, min(latitude) as la, min(longitude) as lo, count(*) as c, min(property_id) as fp from near_ok group by 1),
      n as (select position_id, group_id, c, fp, d, row_number() over w as rn, sum(c) over (w rows unbounded preceding) as s from (select event_id as position_id, g.*, cast(round({hav('latitude','longitude','la','lo')}) as bigint) as d from v_trace, g where {hav('latitude','longitude','la','lo')} <= 350)
        where d<=350 window w as (partition by position_id order by d, fp)),
      t as (select *, case when s<={limit} then c when rn=1 and c>=5 then {limit} end as take from n),
      m as (select *, row_number() over (partition by group_id order by property_id) as place from near_ok)
      select position_id, property_id, m.group_id, d as distance_m, c as group_count, c>=5 as group_suspicious, take<c as group_truncated from t join m using (group_id) where take is not null and place<=take"""


for _limit in (250, 2):

    @query(f"nearby_of_positions_{_limit}", "R15,W10,F19,O6,A40", oracle=_nearby_sql(_limit), uses=("near_ok", "v_trace"))
    def nearby_of_positions(spark, folder, limit=_limit):
        positions = view(spark, folder, "v_trace").select(F.col("event_id").alias("position_id"), "latitude", "longitude")
        return T.nearby_query(positions, S.nearby_eligible(base(spark, folder), listings(spark, folder)), 350.0, limit)


@query(
    "latency_report",
    "A35",
    oracle=f"select event_type, {rnd('quantile_cont(value, 0.5)', 4)} as p50, quantile_disc(value, 0.95) as p95, max(value) as max from events group by 1",
)
def latency_report(spark, folder):
    return T.latency_report(table(spark, folder, "events"), "event_type", "value").withColumn("p50", round_stat("p50", 4))


@query(
    "observed_before_current",
    "J22",
    oracle="""select event_id, p.property_id, coalesce(case when event_id%3=0 then cast(event_id*10 as double) end, price::double) as price, coalesce(nullif(case when event_id%4=0 then 'vista' else '' end,''), p.title) as title
      from (select event_id, event_id%500 as property_id from events) e left join v_property p using (property_id)""",
    uses=("v_property",),
)
def observed_before_current(spark, folder):
    seen = table(spark, folder, "events").selectExpr("event_id", "event_id%500 as property_id", "case when event_id%3=0 then cast(event_id*10 as double) end as price", "case when event_id%4=0 then 'vista' else '' end as title")
    now = view(spark, folder, "v_property").select("property_id", F.col("price").cast("double").alias("price"), "title")
    return T.fill_observed(seen, now, ["price", "title"])
