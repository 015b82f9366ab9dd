"""Registered queries that drain streams, checked against what a batch job gives over the whole history.

Rows arrive in slices. Each slice is added to the folder that a stream reads, and the stream is started again from its
checkpoint, so every query also goes through recovery and through several micro-batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casagrid.operators import lifecycle as L
from casagrid.plans.inputs import view
from casagrid.plans.lifecycle_queries import adverts, batch, identities
from casagrid.plans.registry import query, shared
from casagrid.session import ensure_checkpoint_dir
from casagrid.sources.projections import table
from casagrid.sources.tables import stored
from casagrid.streaming import streams


def fed(spark: SparkSession, rows: DataFrame, slices: int, drain: Callable[[DataFrame, str], None]) -> str:
    """Feeds ``rows`` by their column ``slice``, drains after each, and gives the folder of the streams' results."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_PROVIDER)
    path = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    for i in range(slices):
        rows.filter(F.col("slice") == i).write.mode("append").parquet(f"{path}/in")
        drain(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path)
    return path


SLICES = 3
# Every 97th position comes a slice late, after the watermark has passed its window.
ARRIVAL = [
    ("user_id%7", "session_id"),
    ("1700000000000+event_id*1500", "ts_ms"),
    ("1700000000000+event_id*1500+(event_id%14)*1000-2000", "received_ms"),
    ("case when event_id%19=0 then null else -3.46e1 end", "latitude"),
    ("-5.86e1", "longitude"),
    ("case when event_id%17=0 then 8e1 else cast(12+event_id%5 as double) end", "accuracy"),
    ("case when event_id%97=0 then 2 when event_id%3000<1000 then 0 when event_id%3000<2000 then 1 else 2 end", "slice"),
]
shared("v_arrival", f"select {', '.join(f'{e} as {n}' for e, n in ARRIVAL)} from events")
shared(
    "verdicts",
    """select *, ts_ms//60000*60000 as w, case when latitude is null or accuracy>60 then 'invalid' when received_ms-ts_ms < -1000 then 'future' when received_ms-ts_ms > 10000 then 'late' else 'usable' end as verdict from v_arrival""",
    "v_arrival",
)


def arrivals(spark, folder):
    rows = table(spark, folder, "events").selectExpr(*[f"{e} as {n}" for e, n in ARRIVAL])
    return rows.withColumns({"ts": F.timestamp_millis("ts_ms"), "received": F.timestamp_millis("received_ms")})


@query(
    "streamed_position_windows",
    "R14",
    oracle="""with u as (select * from verdicts where verdict='usable'), m as (select s.slice, (select max(ts_ms)-10000 from u where u.slice<s.slice) as mark from range(0,4) s(slice)),
        k as (select session_id, w, count(*) as positions, min(ts_ms) as first_ms, max(ts_ms) as last_ms from u join m using (slice) where mark is null or w+60000>mark group by 1,2)
      select session_id, w as window_ms, positions, first_ms, last_ms from k where w+60000 <= (select mark from m where slice=3)""",
    uses=("verdicts",),
)
def streamed_position_windows(spark, folder):
    schema = "session_id long, window_start timestamp, positions long, first_at timestamp, last_at timestamp"
    path = fed(spark, arrivals(spark, folder), SLICES, lambda s, path: streams.run_to_table(streams.position_windows(s), f"{path}/out", f"{path}/state"))
    out = spark.read.schema(schema).parquet(f"{path}/out")
    return out.select("session_id", F.unix_millis("window_start").alias("window_ms"), "positions", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("last_at").alias("last_ms"))


@query(
    "streamed_arrival_counts",
    "R14",
    oracle="""with r as (select *, received_ms//60000*60000 as rw from verdicts), m as (select s.slice, (select max(received_ms) from r where r.slice<s.slice) as mark from range(0,4) s(slice))
      select session_id, rw as window_ms, count(*) filter (verdict='usable') as usable, count(*) filter (verdict='late') as late, count(*) filter (verdict='future') as future, count(*) filter (verdict='invalid') as invalid
      from r join m using (slice) where (mark is null or rw+60000>mark) and rw+60000 <= (select mark from m where slice=3) group by 1,2""",
    uses=("verdicts",),
)
def streamed_arrival_counts(spark, folder):
    schema = "session_id long, window_start timestamp, usable long, late long, future long, invalid long"
    path = fed(spark, arrivals(spark, folder), SLICES, lambda s, path: streams.run_to_table(streams.arrival_counts(s), f"{path}/out", f"{path}/state"))
    return spark.read.schema(schema).parquet(f"{path}/out").select("session_id", F.unix_millis("window_start").alias("window_ms"), "usable", "late", "future", "invalid")


@query(
    "streamed_snapshot_changes",
    "R13",
    oracle="""with e as (select *, row_number() over (partition by property_id, currency, price order by observed_on, snapshot_id) as nth from v_snapshot), f as (select * from e where nth=1)
      select property_id, snapshot_id, cast(observed_on as date) as observed_on, case when lag(snapshot_id) over w is null then 'first' else 'change' end as kind, lag(currency) over w as old_currency, lag(price) over w as old_price, currency, price
      from f window w as (partition by property_id order by observed_on, snapshot_id)""",
    uses=("v_snapshot",),
)
def streamed_snapshot_changes(spark, folder):
    rows = view(spark, folder, "v_snapshot").withColumn("content_hash", F.sha2(F.concat_ws("|", "currency", F.coalesce(F.col("price").cast("string"), F.lit(""))), 256))
    year = F.year("observed_on")
    rows = rows.withColumn("slice", F.when(year < 1994, 0).when(year < 1996, 1).otherwise(2))
    path = fed(spark, rows, SLICES, lambda s, path: streams.run_to_table(streams.snapshot_changes(s), f"{path}/out", f"{path}/state"))
    return spark.read.schema(streams.CHANGE).parquet(f"{path}/out")


def _discovery_log(spark, folder) -> streams.DiscoveryLog:
    """All discovered links in the order of their positions, in three slices; the last is recorded once more."""
    rows = stored(spark, folder, "discovered_links", lambda: batch(spark, folder))
    last = rows.agg(F.max("position")).scalar()
    rows = rows.withColumn("slice", F.floor(F.col("position") * SLICES / (last + 1)).cast("int"))
    known = stored(spark, folder, "latest_adverts", lambda: adverts(spark, folder))
    # Every micro-batch reads these; they are worked once.
    lookups = L.discovery_lookups(known, identities(spark, folder, known))
    lookups = {name: stored(spark, folder, f"adverts_{name}", lambda rows=rows: rows) for name, rows in lookups.items()}
    logs = []

    def drain(stream: DataFrame, path: str) -> None:
        log = streams.DiscoveryLog(spark, path, lambda found: L.discovery_status(L.resolve_links(found, **lookups)))
        streams.record_discovery(stream, log, f"{path}/state")
        logs.append(log)

    fed(spark, rows, SLICES, drain)
    logs[-1].record(rows.filter(F.col("slice") == SLICES - 1), SLICES - 1)
    return logs[-1]


@query("streamed_discovery", "R12", oracle="select source_id, external_id, url, position, listing_id, matched_by, status from discovered", uses=("discovered",))
def streamed_discovery(spark, folder):
    return _discovery_log(spark, folder).items()


@query(
    "streamed_discovery_counts",
    "R12",
    oracle="select source_id, count(*) as seen, count(listing_id) as existing, count(*)-count(listing_id) as new, 0 as out_of_phase from discovered group by 1",
    uses=("discovered",),
)
def streamed_discovery_counts(spark, folder):
    return _discovery_log(spark, folder).counts()
