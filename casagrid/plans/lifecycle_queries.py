"""Registered queries: listing lifecycle, merging, repairs, rollback and audits of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from casagrid.functions import address as A
from casagrid.operators import lifecycle as L
from casagrid.operators import listing as C
from casagrid.operators import merge as M
from casagrid.operators import search as S
from casagrid.plans.inputs import base, listings, view
from casagrid.plans.registry import query, shared
from casagrid.sources.projections import table
from casagrid.sources.tables import join_rows

BATCH = [
    ("cast(o_custkey%6 as bigint)", "source_id"),
    ("o_orderkey + o_custkey%5 - 2", "external_id"),
    ("concat('https://site', cast(o_custkey%6 as string), '.example/ficha/casa-', cast(o_orderkey as string), '-', cast(o_custkey as string))", "url"),
    ("cast(o_orderdate as date)", "seen_on"),
    ("cast(floor(o_totalprice) as bigint)", "price"),
    ("case when o_custkey%7=0 then '' else o_orderpriority end", "title"),
    ("case when o_orderstatus='F' then 'ARS' when o_orderstatus='P' then '' else 'USD' end", "currency"),
    ("case when o_orderkey%9=0 then concat('new', cast(o_custkey%50 as string)) else concat('fp', cast(o_custkey%3000 as string)) end", "fingerprint"),
    ("o_orderkey", "position"),
]
RUN = [
    ("o_orderkey", "run_id"),
    ("cast(o_custkey%20 as bigint)", "source_id"),
    ("cast(o_orderdate as date)", "finished_on"),
    ("case when o_custkey%4=0 then 'partial' else 'success' end", "status"),
    ("case when o_orderstatus='O' then 'complete' else 'sample' end", "mode"),
    ("case when o_custkey%5=0 then 10 else null end", "max_pages"),
    ("cast(null as int)", "max_listings"),
    ("cast(o_orderkey%50 as int)", "planned"),
    ("cast(case when o_orderkey%3=0 then 5 else o_orderkey%50 end as int)", "processed"),
    ("cast(case when o_orderkey%11=0 then 2 else 0 end as int)", "errors"),
    ("case when o_orderkey%13=0 then 7e1 when o_orderkey%2=0 then null else 9.5e1 end", "coverage_ratio"),
]


def _sel(exprs) -> str:
    return ", ".join(f"{e} as {n}" for e, n in exprs)


shared("v_batch0", f"select {_sel(BATCH)} from orders")
shared("v_batch", "select * exclude(rn) from (select *, row_number() over (partition by source_id, external_id order by position) as rn from v_batch0) where rn=1", "v_batch0")
shared("v_run", f"select {_sel(RUN)} from orders")
shared(
    "adv",
    """select source_id, external_id, listing_id, property_id, url, active, missing_runs, last_seen_on, source_status from (select *, row_number() over (partition by source_id, external_id
        order by last_seen_on desc, listing_id desc, property_id desc, url desc, active desc, missing_runs desc, source_status desc) as rn from v_listing) where rn=1""",
    "v_listing",
)


_OLD_LINK = [(BATCH[0][0], "source_id"), ("o_orderkey-7", "external_id"), (BATCH[2][0], "old_url")]
shared("ident", f"select source_id, external_id, coalesce(old_url, url) as url, last_seen_on as first_seen_on, last_seen_on, 'seed' as last_seen_reason from adv left join (select {_sel(_OLD_LINK)} from orders) using (source_id, external_id)", "adv")


def batch(spark, folder):
    return L.keep_first(table(spark, folder, "orders").selectExpr(*[f"{e} as {n}" for e, n in BATCH]), L.KEY, ["position"])


def runs(spark, folder):
    return table(spark, folder, "orders").selectExpr(*[f"{e} as {n}" for e, n in RUN])


def adverts(spark, folder):
    keep = ["listing_id", "property_id", "url", "active", "missing_runs", "source_status"]
    out = L.latest_per_key(listings(spark, folder), L.KEY, [F.col("last_seen_on")], [*keep, "last_seen_on"])
    return out.select(*L.KEY, "listing_id", "property_id", "url", "active", "missing_runs", "last_seen_on", "source_status")


def identities(spark, folder, known=None):
    """Remembered adverts; some under a link that is not the advert's present one."""
    old = table(spark, folder, "orders").selectExpr(*[f"{e} as {n}" for e, n in _OLD_LINK])
    rows = join_rows(adverts(spark, folder) if known is None else known, old, L.KEY, "left")
    return rows.select(*L.KEY, F.coalesce("old_url", "url").alias("url"), F.col("last_seen_on").alias("first_seen_on"), "last_seen_on", F.lit("seed").alias("last_seen_reason"))


@query("latest_adverts", "W2", oracle="select source_id, external_id, listing_id, property_id, active, missing_runs from adv", uses=("adv",))
def latest_adverts(spark, folder):
    return adverts(spark, folder).select(*L.KEY, "listing_id", "property_id", "active", "missing_runs")


@query(
    "latest_snapshot",
    "W2",
    oracle="select property_id, snapshot_id, currency, price from (select *, row_number() over (partition by property_id order by observed_on desc, snapshot_id desc, currency desc, price desc nulls last) as rn from v_snapshot) where rn=1",
    uses=("v_snapshot",),
)
def latest_snapshot(spark, folder):
    return L.latest_per_key(view(spark, folder, "v_snapshot"), ["property_id"], [F.col("observed_on"), F.col("snapshot_id"), F.col("currency"), F.col("price")], ["snapshot_id", "currency", "price"])


@query(
    "reference_run",
    "W3",
    oracle="select source_id, run_id, mode from (select *, row_number() over (partition by source_id order by (mode='complete' and status='success') desc, finished_on desc, run_id desc) as rn from v_run) where rn=1",
    uses=("v_run",),
)
def reference_run(spark, folder):
    good = (F.col("mode") == "complete") & (F.col("status") == "success")
    return L.preferred_latest(runs(spark, folder), "source_id", good, [F.col("finished_on"), F.col("run_id")], ["run_id", "mode"])


@query(
    "richest_advert",
    "W5",
    oracle="""select property_id, listing_id, image_url, source_status from (select *, row_number() over (partition by property_id order by (image_url<>'')::int+(source_status<>'')::int desc, listing_id, image_url desc, source_status desc) as rn from v_listing) where rn=1""",
    uses=("v_listing",),
)
def richest_advert(spark, folder):
    return L.keep_richest(listings(spark, folder), ["property_id"], ["image_url", "source_status"], "listing_id")


@query(
    "known_identities",
    "J7",
    oracle="select source_id, external_id, exists (select 1 from adv a where a.source_id=b.source_id and a.external_id=b.external_id) as known from v_batch b",
    uses=("v_batch", "adv"),
)
def known_identities(spark, folder):
    return L.new_and_known(batch(spark, folder), identities(spark, folder)).select(*L.KEY, "known")


@query(
    "identity_upsert",
    "L2",
    oracle="""select source_id, external_id, coalesce(b.url, a.url) as url, coalesce(a.last_seen_on, date '2001-01-01') as first_seen_on, case when b.url is not null then greatest(coalesce(a.last_seen_on, date '2001-01-01'), date '2001-01-01') else a.last_seen_on end as last_seen_on,
      case when b.url is not null then 'ingest' else 'seed' end as last_seen_reason from ident a full join v_batch b using (source_id, external_id)""",
    uses=("v_batch", "ident"),
)
def identity_upsert(spark, folder):
    return L.upsert_identities(identities(spark, folder), batch(spark, folder), "2001-01-01")


def resolved(spark, folder):
    props = view(spark, folder, "v_property").select("property_id", F.concat(F.lit("fp"), F.col("property_id").cast("string")).alias("fingerprint"))
    return L.resolve_batch(batch(spark, folder), adverts(spark, folder), props)


shared(
    "resolved",
    """with m as (select b.*, a.property_id as by_key, p.property_id as by_print
        from v_batch b left join (select source_id, external_id, min(property_id) as property_id from adv group by 1,2) a using (source_id, external_id) left join v_property p on b.fingerprint = concat('fp', cast(p.property_id as varchar))),
      made as (select fingerprint, row_number() over (order by left(md5(fingerprint),3), fingerprint) + (select max(property_id) from v_property) as made from (select distinct fingerprint from m where by_key is null and by_print is null))
      select m.* exclude (by_key, by_print), coalesce(by_key, by_print, made) as property_id, case when by_key is not null then 'listing' when by_print is not null then 'fingerprint' else 'created' end as match from m left join made using (fingerprint)""",
    "v_batch",
    "adv",
    "v_property",
)


@query("ingest_resolution", "L1", oracle="select source_id, external_id, match, property_id from resolved", uses=("resolved",))
def ingest_resolution(spark, folder):
    return resolved(spark, folder).select(*L.KEY, "match", "property_id")


@query(
    "ingest_properties",
    "L1",
    oracle="""with f as (select property_id, bool_or(match='created') as made, max(seen_on) as seen_on, arg_max(nullif(title,''), (seen_on, source_id, external_id)) filter (title<>'') as title, arg_max(nullif(currency,''), (seen_on, source_id, external_id)) filter (currency<>'') as currency,
        arg_max(price, (seen_on, source_id, external_id)) as price from resolved group by 1)
      select property_id, case when override_field='title' then p.title else coalesce(f.title, p.title, case when made then 'Propiedad sin título' end) end as title, coalesce(f.currency, p.currency, case when made then '' end) as currency,
        case when override_field='price' then p.price else coalesce(f.price, p.price) end::double as price, greatest(last_seen_on, seen_on) as last_seen_on, coalesce(made, false) as created from v_property p full join f using (property_id)""",
    uses=("resolved",),
)
def ingest_properties(spark, folder):
    props = view(spark, folder, "v_property").select(
        "property_id", "title", "currency", "price", "last_seen_on", F.when(F.col("override_field") != "", F.array("override_field")).otherwise(F.array().cast("array<string>")).alias("overrides")
    )
    order = [F.col("seen_on"), F.col("source_id"), F.col("external_id")]
    out = L.merge_properties(props, resolved(spark, folder).withColumn("price", F.col("price").cast("decimal(16,2)")), ["title", "currency", "price"], order)
    return out.select("property_id", "title", "currency", F.col("price").cast("double").alias("price"), "last_seen_on", "created")


@query(
    "ingest_listings",
    "L1",
    oracle="""with made as (select source_id, external_id, row_number() over (order by left(md5(concat(source_id, chr(31), external_id)),3), source_id, external_id) + (select max(listing_id) from adv) as made from resolved anti join adv using (source_id, external_id))
      select source_id, external_id, coalesce(a.listing_id, made) as listing_id, coalesce(r.property_id, a.property_id) as property_id, coalesce(r.url, a.url) as url, case when r.url is not null then true else a.active end as active, case when r.url is not null then 0 else a.missing_runs end as missing_runs,
      greatest(a.last_seen_on, r.seen_on) as last_seen_on, made is not null as created from adv a full join resolved r using (source_id, external_id) left join made using (source_id, external_id)""",
    uses=("resolved",),
)
def ingest_listings(spark, folder):
    return L.merge_listings(adverts(spark, folder), resolved(spark, folder))


@query(
    "unseen_snapshots",
    "L3",
    oracle="""select property_id, content_hash, count(*) as n from (select distinct property_id, sha256(concat(currency,'|',coalesce(cast(price as varchar),''))) as content_hash from v_snapshot where observed_on >= date '2000-01-01') x
      where not exists (select 1 from v_snapshot s where s.property_id=x.property_id and s.observed_on < date '2000-01-01' and sha256(concat(s.currency,'|',coalesce(cast(s.price as varchar),'')))=x.content_hash) group by 1,2""",
    uses=("v_snapshot",),
)
def unseen_snapshots(spark, folder):
    hashed = view(spark, folder, "v_snapshot").withColumn("content_hash", F.sha2(F.concat_ws("|", "currency", F.coalesce(F.col("price").cast("string"), F.lit(""))), 256))
    cut = F.lit("2000-01-01").cast("date")
    fresh = L.new_snapshots(hashed.filter(F.col("observed_on") < cut), hashed.filter(F.col("observed_on") >= cut), ["property_id"])
    return fresh.groupBy("property_id", "content_hash").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unseen_images",
    "L4,W4",
    oracle="""with n as (select listing_id, u as url, min(p)-1 as position from (select listing_id, unnest(us) as u, generate_subscripts(us,1) as p from (select listing_id, [image_url, concat('x', line_no), image_url] as us from v_listing)) group by 1,2)
      select listing_id, url, cast(position as int) as position from n where not exists (select 1 from v_listing l where l.listing_id=n.listing_id and l.image_url=n.url and l.line_no%2=0)""",
    uses=("v_listing",),
)
def unseen_images(spark, folder):
    df = listings(spark, folder)
    have = df.filter(F.col("line_no") % 2 == 0).select("listing_id", F.col("image_url").alias("url"))
    found = df.select("listing_id", F.array("image_url", F.concat(F.lit("x"), F.col("line_no").cast("string")), "image_url").alias("images"))
    return L.new_images(have, found)


_MOVED = "case when property_id%3=0 then latitude+1e-3 else latitude end"


@query(
    "moved_pins",
    "L5",
    oracle="select property_id, latitude, longitude from v_location where latitude is not null and not manually_corrected and property_id%3=0",
    uses=("v_location",),
)
def moved_pins(spark, folder):
    loc = view(spark, folder, "v_location")
    fresh = loc.selectExpr("property_id", f"{_MOVED} as latitude", "longitude")
    return L.location_changes(loc.select("property_id", "latitude", "longitude", "manually_corrected"), fresh)[1]


@query(
    "updated_pins",
    "L5",
    oracle=f"select property_id, case when manually_corrected then latitude else {_MOVED} end as latitude, longitude, coalesce(manually_corrected,false) as manually_corrected from v_location",
    uses=("v_location",),
)
def updated_pins(spark, folder):
    loc = view(spark, folder, "v_location")
    fresh = loc.selectExpr("property_id", f"{_MOVED} as latitude", "longitude")
    return L.location_changes(loc.select("property_id", "latitude", "longitude", "manually_corrected"), fresh)[0]


@query(
    "stale_adverts",
    "J6,U7",
    oracle="select source_id, external_id, listing_id from adv where active and (source_id, external_id) not in (select source_id, external_id from v_batch)",
    uses=("adv", "v_batch"),
)
def stale_adverts(spark, folder):
    return L.stale_adverts(adverts(spark, folder), batch(spark, folder)).select(*L.KEY, "listing_id")


shared(
    "missed",
    """select *, active and not seen as missed, case when active and not seen then missing_runs+1 else missing_runs end as runs_after, active and not (not seen and missing_runs+1>=2) as active_after
      from (select a.*, exists (select 1 from v_batch b where b.source_id=a.source_id and b.external_id=a.external_id) as seen from adv a)""",
    "adv",
    "v_batch",
)


@query("missing_adverts", "L6", oracle="select source_id, external_id, cast(runs_after as int) as missing_runs, active_after as active, missed from missed", uses=("missed",))
def missing_adverts(spark, folder):
    return L.mark_missing(adverts(spark, folder), batch(spark, folder)).select(*L.KEY, "missing_runs", "active", "missed")


shared("gone_props", "select property_id from missed group by 1 having bool_or(active) and not bool_or(active_after)", "missed")


@query("removed_properties", "L6", oracle="select property_id from gone_props", uses=("gone_props",))
def removed_properties(spark, folder):
    before = adverts(spark, folder)
    return L.removed_properties(before, L.mark_missing(before, batch(spark, folder)))


@query(
    "missing_gate",
    "L7",
    oracle="""select run_id, case when mode<>'complete' then 'incomplete mode' when max_pages is not null then 'limited run' when status<>'success' then concat('status ', status) when planned<=0 then 'nothing planned'
      when processed<>planned then 'partly processed' when errors>0 then 'errors' when coalesce(coverage_ratio,100)<80 then 'low coverage' else '' end as skip_reason from v_run""",
    uses=("v_run",),
)
def missing_gate(spark, folder):
    return L.may_mark_missing(runs(spark, folder)).select("run_id", "skip_reason")


@query(
    "missing_report",
    "L8",
    oracle="""select source_id, count(*) filter (missed) as stale, count(*) filter (missed and active_after) as incremented, count(*) filter (missed and not active_after) as deactivated,
      count(distinct case when missed and not active_after and property_id in (select property_id from gone_props) then property_id end) as removed_properties from missed group by 1""",
    uses=("missed", "gone_props"),
)
def missing_report(spark, folder):
    return L.missing_report(adverts(spark, folder), batch(spark, folder))


@query(
    "removed_status",
    "L9",
    oracle="""with r as (select distinct source_id, external_id from v_batch where title=''), a as (select adv.*, r.source_id is not null as gone from adv left join r using (source_id, external_id)),
      t as (select property_id, bool_or(gone) as t, bool_or(active and not gone) as act from a group by 1)
      select property_id, case when t and not act then 'removed' else status end as status from v_property left join t using (property_id)""",
    uses=("adv", "v_batch", "v_property"),
)
def removed_status(spark, folder):
    gone = batch(spark, folder).filter(F.col("title") == "")
    return L.mark_removed(adverts(spark, folder), gone, view(spark, folder, "v_property"))[1]


_RESULT = "case when o_orderkey%4=0 then 'unavailable' when o_orderkey%4=1 then 'active' else 'uncertain' end"
shared("v_audit", f"select o_orderkey*10+1+o_custkey%3 as listing_id, {_RESULT} as result from orders")


def audit(spark, folder):
    return table(spark, folder, "orders").selectExpr("o_orderkey*10+1+o_custkey%3 as listing_id", f"{_RESULT} as result")


@query("audit_pending", "L10", oracle="select source_id, external_id, listing_id from adv where listing_id not in (select listing_id from v_audit)", uses=("adv", "v_audit"))
def audit_pending(spark, folder):
    done = audit(spark, folder).join(adverts(spark, folder).select("listing_id", "url"), "listing_id")
    return L.pending_audit(adverts(spark, folder), done).select(*L.KEY, "listing_id")


shared(
    "discovered",
    """with i as (select source_id, external_id, min(listing_id) as lid from adv where active group by 1,2),
      m as (select n.source_id, n.url, max((last_seen_on, n.external_id, lid)) as h from ident n join i using (source_id, external_id) group by 1,2)
      select source_id, external_id, url, position, listing_id, matched_by, case when listing_id is null then 'new_pending' else 'existing_pending' end as status from (select *, row_number() over (partition by source_id, external_id order by position, url, listing_id nulls first, matched_by) as rn from
        (select b.source_id, coalesce(case when i.lid is not null then b.external_id else coalesce(u.ext, h[2]) end, b.external_id) as external_id, b.url, b.position, coalesce(i.lid, u.lid, h[3]) as listing_id,
            case when i.lid is not null then 'id' when u.lid is not null then 'url' when h is not null then 'memory' else 'none' end as matched_by
          from v_batch b left join i using (source_id, external_id)
          left join (select source_id, url, min(listing_id) as lid, arg_min(external_id, listing_id) as ext from adv where active group by 1,2) u on u.source_id=b.source_id and u.url=b.url
          left join m on m.source_id=b.source_id and m.url=b.url)) where rn=1""",
    "adv",
    "v_batch",
    "ident",
)


def discovered(spark, folder):
    return L.discovery_status(L.resolve_discovery(batch(spark, folder), adverts(spark, folder), identities(spark, folder)))


@query("discovery_resolution", "J8,L11", oracle="select source_id, external_id, url, position, listing_id, matched_by, status from discovered", uses=("discovered",))
def discovery_resolution(spark, folder):
    return discovered(spark, folder)


@query("discovery_gone", "L11", oracle="select source_id, external_id from adv a where active and not exists (select 1 from discovered d where d.source_id=a.source_id and d.external_id=a.external_id)", uses=("discovered",))
def discovery_gone(spark, folder):
    return L.gone_adverts(adverts(spark, folder), discovered(spark, folder)).select(*L.KEY)


@query(
    "discovery_counts",
    "A29,L12",
    oracle="select source_id, count(*) as seen, count(listing_id) as existing, 0 as new, count(*)-count(listing_id) as out_of_phase from discovered group by 1",
    uses=("discovered",),
)
def discovery_counts(spark, folder):
    return L.discovery_counts(discovered(spark, folder), phase_has_new=False)


@query(
    "discovery_progress",
    "W13",
    oracle="""select source_id, external_id, position, row_number() over w as place, cast(sum(case when listing_id is null then 1 else 0 end) over w as bigint) as new_so_far, cast(sum(case when listing_id is null then 0 else 1 end) over w as bigint) as existing_so_far
      from discovered window w as (partition by source_id order by position, external_id rows unbounded preceding)""",
    uses=("discovered",),
)
def discovery_progress(spark, folder):
    return L.running_counts(discovered(spark, folder))


for _mode, _test in (("all", "true"), ("stale", "date '2001-06-01' - last_seen_on > 400"), ("incomplete", "missing_runs=1")):

    @query(
        f"reprocess_{_mode}",
        "L12",
        oracle=f"select source_id, external_id from (select source_id, external_id, last_seen_on, missing_runs, a.active from discovered d join adv a using (source_id, external_id) where d.listing_id is not null and a.active) where {_test}",
        uses=("discovered",),
    )
    def reprocess(spark, folder, mode=_mode):
        snap = discovered(spark, folder).join(adverts(spark, folder).select(*L.KEY, "active", "last_seen_on", (F.col("missing_runs") == 1).alias("incomplete")), L.KEY)
        return L.reprocess_selection(snap, mode, "2001-06-01", 400).select(*L.KEY)


MIRROR = [
    ("l_partkey", "property_id"),
    ("cast(l_linenumber%6 as bigint)", "source_id"),
    ("concat('https://site', cast(l_linenumber%6 as string), '.example/f/casa-', cast(l_suppkey as string), '-', cast(cast(l_quantity as int) as string), '-', cast(l_orderkey%450 as string))", "url"),
]
shared("v_mirror", f"select {_sel(MIRROR)} from lineitem")
shared("tails", "select distinct property_id, source_id, split_part(url, chr(47), 5) as tail from v_mirror", "v_mirror")
shared(
    "edges",
    "select distinct t.property_id as a, h.hub as b from tails t join (select tail, min(property_id) as hub from tails group by 1 having min(source_id)<>max(source_id)) h using (tail) where t.property_id <> h.hub",
    "tails",
)
_REACH = "sym as (select a, b from edges union select b, a from edges), reach(node, root) as (select distinct a, a from sym union select e.b, r.root from reach r join sym e on e.a=r.node)"
_COMP = "comp as (select node, min(root) as component from reach group by node)"


def mirrors(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*[f"{e} as {n}" for e, n in MIRROR])


@query("mirror_edges", "J23,L13", oracle="select a, b from edges", uses=("edges",))
def mirror_edges(spark, folder):
    return M.tail_edges(mirrors(spark, folder))


@query("duplicate_components", "L13", oracle=f"with recursive {_REACH}, {_COMP} select node, component from comp", uses=("edges",))
def duplicate_components(spark, folder):
    return M.components(M.tail_edges(mirrors(spark, folder)))


@query(
    "split_listings",
    "L15",
    oracle="""with d as (select property_id, concat('fp', cast(property_id as varchar)) as fp from v_property where address=''), r as (select a.*, fp from adv a join d using (property_id) where active),
      f as (select property_id, min(listing_id) as m, count(*) as n from r group by 1 having count(*)>1)
      select listing_id, property_id, case when listing_id%2=0 then sha256(concat('split|', source_id, '|', external_id, '|', url)) else concat('other', cast(listing_id as varchar)) end as new_fingerprint from r join f using (property_id) where listing_id<>m""",
    uses=("adv", "v_property"),
)
def split_listings(spark, folder):
    props = view(spark, folder, "v_property").select("property_id", "address", F.concat(F.lit("fp"), F.col("property_id").cast("string")).alias("fingerprint"))
    own = F.concat(F.lit("fp"), F.col("property_id").cast("string"))
    rows = adverts(spark, folder).withColumn("listing_print", F.when(F.col("listing_id") % 2 == 0, own).otherwise(F.concat(F.lit("other"), F.col("listing_id").cast("string"))))
    return M.split_plan(props, rows, A.is_plausible_address("address")).select("listing_id", "property_id", "new_fingerprint")


_AFTER = [
    ("property_id", "property_id"),
    ("case when property_id%5=0 then price+100 else price end", "price"),
    ("case when property_id%7=0 then '' when property_id%11=0 then 'Calle' when property_id%13=0 then 'Calle 9 999' else address end", "address"),
    ("case when property_id%6=0 then 'Moron' else locality end", "locality"),
    ("case when property_id%8=0 then '' else location_notes end", "location_notes"),
]


@query(
    "field_diff",
    "L16",
    oracle="""with a as (select p.property_id, override_field, p.price as p0, p.address as a0, p.locality as l0, p.location_notes as n0, case when property_id%5=0 then price+100 else price end as p1,
        case when property_id%7=0 then '' when property_id%11=0 then 'Calle' when property_id%13=0 then 'Calle 9 999' else address end as a1, case when property_id%6=0 then 'Moron' else locality end as l1, case when property_id%8=0 then '' else location_notes end as n1 from v_property p)
      select property_id, 'price' as field, cast(p0 as varchar) as old, cast(p1 as varchar) as new from a where p0 is distinct from p1 and override_field<>'price'
      union all select property_id, 'address', a0, a1 from a where a0<>a1 and a1<>'' and override_field<>'address' and not (a0<>'' and a1='Calle')
      union all select property_id, 'locality', l0, l1 from a where l0<>l1 union all select property_id, 'location_notes', n0, n1 from a where n0<>n1""",
    uses=("v_property",),
)
def field_diff(spark, folder):
    before = view(spark, folder, "v_property").withColumn("overrides", F.when(F.col("override_field") != "", F.array("override_field")))
    after = before.selectExpr(*[f"{e} as {n}" for e, n in _AFTER])
    return M.field_diff(before, after, "property_id", ["price", "address", "locality", "location_notes"], "overrides", ["location_notes"])


@query(
    "status_policy",
    "L17",
    oracle="""with k as (select *, lower(regexp_extract(url, '(?i)([^/]*-[0-9]+-[0-9]+)$', 1)) as mkey from adv)
      select listing_id, source_id, property_id, case when exists (select 1 from k o where o.property_id=a.property_id and o.source_id<>a.source_id and o.active and o.source_status<>'reserved'
          and not (a.source_id=1 and o.source_id=2) and not (a.source_id=2 and o.source_id=1 and a.mkey<>'' and a.mkey=o.mkey)) then 'active' else 'reserved' end as final_status
      from k a where source_status='reserved'""",
    uses=("adv",),
)
def status_policy(spark, folder):
    rows = adverts(spark, folder)
    proposed = rows.filter(F.col("source_status") == "reserved").withColumn("status", F.col("source_status"))
    return L.status_policy(rows, proposed, ["reserved"], origin=1, mirror=2).select("listing_id", "source_id", "property_id", "final_status")


@query(
    "address_repairs",
    "L20,J26,J27",
    oracle="""with r as (select property_id, normalized_address, case when normalized_address like 'calle 1%' then 'Villa Tesei' when normalized_address like 'calle 2%' then 'William C. Morris' when normalized_address like 'calle%' then 'Hurlingham' end as rule_locality from v_property),
      c as (select doc_id as property_id, case when quality=1 then concat('Corregida ', doc_id) end as address from labels)
      select p.property_id, coalesce(c.address, p.address) as address, rule_locality from v_property p join r using (property_id) left join c using (property_id)""",
    uses=("v_property",),
)
def address_repairs(spark, folder):
    rules = spark.createDataFrame([("calle 1", 1, "Villa Tesei"), ("calle 2", 2, "William C. Morris"), ("calle", 3, "Hurlingham")], "prefix string, rule_no int, locality string")
    props = view(spark, folder, "v_property").select("property_id", "address", "normalized_address")
    fixes = table(spark, folder, "labels").selectExpr("doc_id as property_id", "case when quality=1 then concat('Corregida ', doc_id) end as address")
    out = M.prefix_rules(M.apply_corrections(props, fixes, "property_id", ["address"]), "normalized_address", rules, ["locality"])
    return out.select("property_id", "address", "rule_locality")


_AG = "case when c_custkey%3=0 then concat('Prop ', cast(c_custkey%30 as string), ' 120 m2') when c_custkey%3=1 then concat('  Prop ', cast(c_custkey%30 as string), ' - ') else 'Ver ubicacion' end"


@query(
    "agency_remap",
    "L21",
    oracle="""with a as (select c_custkey as agency_id, case when c_custkey%3<>2 then concat('Prop ', cast(c_custkey%30 as varchar)) else '' end as name from customer), t as (select name, min(agency_id) as t from a where name<>'' group by 1)
      select t as agency_id, count(*) as adverts from v_listing l left join a using (agency_id) left join t using (name) group by 1""",
    uses=("v_listing",),
)
def agency_remap(spark, folder):
    agencies = table(spark, folder, "customer").selectExpr("c_custkey as agency_id", f"{_AG} as name")
    moved, _ = M.remap_agencies(listings(spark, folder), agencies, A.normalize_agency("name"))
    return moved.groupBy("agency_id").agg(F.count(F.lit(1)).alias("adverts"))


@query(
    "condition_backfill",
    "L22",
    oracle="select property_id, 'unknown' as old, 'new' as new from v_property where condition_category='unknown' and property_id%8=2",
    uses=("v_property",),
)
def condition_backfill(spark, folder):
    df = view(spark, folder, "v_property").withColumn("text", F.when(F.col("property_id") % 8 == 2, "Casa a estrenar").otherwise("casa"))
    found = A.infer_condition("text")
    out = df.select("property_id", F.col("condition_category").alias("old"), found.alias("new"))
    return out.filter((F.col("old") == "unknown") & (F.col("new") != "unknown"))


_DECISION = [
    ("event_id%700", "property_id"),
    ("event_id", "decided_at"),
    ("case event_id%5 when 0 then 'approve' when 1 then 'address' when 2 then 'locality' when 3 then 'zone' else 'remove' end", "decision"),
    ("concat('v', cast(event_id as string))", "value"),
]
shared("v_decision", f"select {_sel(_DECISION)} from events")


@query(
    "curation_decisions",
    "L27",
    oracle="""with d as (select property_id, arg_max(decision, decided_at) as k, arg_max(value, decided_at) as v from v_decision group by 1)
      select property_id, case when k='address' then v else address end as address, case when k='locality' then v else locality end as locality, case when k='zone' then v else inferred_zone end as inferred_zone,
        case when k='remove' then 'removed' else status end as status, is_reviewed or k is not null as is_reviewed from v_property left join d using (property_id)""",
    uses=("v_property", "v_decision"),
)
def curation_decisions(spark, folder):
    d = table(spark, folder, "events").selectExpr(*[f"{e} as {n}" for e, n in _DECISION])
    out = M.apply_decisions(view(spark, folder, "v_property"), d, "property_id")
    return out.select("property_id", "address", "locality", "inferred_zone", "status", "is_reviewed")
