"""Registered queries that write files from the given tables and read them back through the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casagrid.operators import lifecycle as L
from casagrid.plans.inputs import listings, view
from casagrid.plans.lifecycle_queries import adverts, audit
from casagrid.plans.registry import query, shared
from casagrid.plans.spatial_queries import settlements
from casagrid.session import ensure_checkpoint_dir
from casagrid.sources import io
from casagrid.sources.projections import table


def new_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


@query(
    "stored_listing_tables",
    "S1",
    oracle="""select property_id, p.title, p.price::double as price, p.bathrooms::double as bathrooms, count(l.listing_id) as adverts, min(s.name) as first_source, count(distinct c.c_name) as agencies, max(latitude) as latitude
      from v_property p left join v_listing l using (property_id) left join (select distinct source_id, concat('Fuente ', source_id) as name from v_listing) s using (source_id) left join customer c on c.c_custkey=l.agency_id left join v_location o using (property_id) group by all""",
    uses=("v_property", "v_listing", "v_location"),
)
def stored_listing_tables(spark, folder):
    path = new_folder(spark, "tables")
    adv = listings(spark, folder)
    written = {
        "property": view(spark, folder, "v_property"),
        "listing": adv,
        "location": view(spark, folder, "v_location"),
        "snapshot": view(spark, folder, "v_snapshot").withColumn("listing_id", F.col("snapshot_id")),
        "source": adv.select("source_id", F.concat(F.lit("Fuente "), F.col("source_id").cast("string")).alias("name")).distinct(),
        "agency": table(spark, folder, "customer").selectExpr("c_custkey as agency_id", "c_name as name"),
    }
    for name, df in written.items():
        kinds = {f.name: f.dataType for f in io.SCHEMAS[name].fields}
        df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns if c in kinds and c != "overrides"]).write.parquet(f"{path}/{name}.parquet")
    t = io.read_listing_tables(spark, path)
    named = t["listing"].join(t["source"].select("source_id", F.col("name").alias("source_name")), "source_id", "left").join(t["agency"].select("agency_id", F.col("name").alias("agency_name")), "agency_id", "left")
    found = named.groupBy("property_id").agg(F.count(F.lit(1)).alias("adverts"), F.min("source_name").alias("first_source"), F.countDistinct("agency_name").alias("agencies"))
    out = t["property"].join(found, "property_id", "left").join(t["location"].select("property_id", "latitude"), "property_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("property_id", "title", F.col("price").cast("double").alias("price"), F.col("bathrooms").cast("double").alias("bathrooms"), F.coalesce("adverts", zero).alias("adverts"), "first_source", F.coalesce("agencies", zero).alias("agencies"), "latitude")


@query(
    "layer_file_features",
    "S2",
    oracle="""select trim(settlement) as name, 'riesgo' as level, 0 as part, 5 as points, cast(west as double) as west, cast(south as double) as south, concat('r', risk_score::int, ' "{', feature_idx, '}"') as note from v_settle""",
    uses=("v_settle",),
)
def layer_file_features(spark, folder):
    """Collections of forty features each, written as text and read piece by piece."""
    rows = settlements(spark, folder)
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"))
    note = F.concat(F.lit("r"), F.col("risk_score").cast("int").cast("string"), F.lit(' "{'), F.col("feature_idx").cast("string"), F.lit('}"'))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("settlement").alias("name"), note.alias("note")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")
    )
    grouped = rows.groupBy(F.floor(F.col("feature_idx") / 40)).agg(F.collect_list(feature).alias("features"))
    path = new_folder(spark, "layer")
    grouped.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(path)
    out = io.read_geo_layer(spark, path, "riesgo")
    first = F.col("rings")[0]
    return out.select("name", "level", "part", F.size(first).alias("points"), first[0]["lon"].alias("west"), first[0]["lat"].alias("south"), F.col("props")["note"].alias("note"))


_TEXT = "case when event_id%7=0 then concat('dos\nlineas \"', event_type, '\"; x') when event_id%7=1 then '' else concat('a,b ', event_type) end"


@query(
    "open_data_file",
    "S3",
    oracle="""select cast(event_id as varchar) as event_id, cast(2017+event_id%8 as varchar) as ano, trim(event_type) as tipo_de_hecho, nullif(case when event_id%7=0 then concat('dos', chr(10), 'lineas "', event_type, '"; x') when event_id%7=1 then '' else concat('a,b ', event_type) end, '') as texto,
      cast(user_id as varchar) as texto_2 from events""",
)
def open_data_file(spark, folder):
    path = new_folder(spark, "csv")
    rows = table(spark, folder, "events").selectExpr("event_id", "2017+event_id%8 as `Año`", "concat(' ', event_type, ' ') as `Tipo de Hecho`", f"{_TEXT} as Texto", "user_id as `Texto `")
    rows.write.option("escape", '"').option("sep", ";").csv(path, header=True)
    df = io.read_open_data(spark, path, ["ano", "tipo_de_hecho"], sep=";")
    return df.select("event_id", "ano", "tipo_de_hecho", F.nullif("texto", F.lit("")).alias("texto"), "texto_2")


_ALIAS = [("s_suppkey", "place"), ("concat(case when s_suppkey%2=0 then 'Barrió ' else 'BARRIO-' end, cast(s_suppkey%30 as string))", "source_text_normalized"), ("concat('Zona ', cast(s_suppkey as string))", "canonical_name")]
shared("v_alias_file", "select " + ", ".join(f"{e} as {n}" for e, n in _ALIAS) + " from supplier")


@query("alias_lookup_file", "S4", oracle="select concat('barrio', place%30) as alias_key, arg_min(canonical_name, place) as canonical_name from v_alias_file group by 1", uses=("v_alias_file",))
def alias_lookup_file(spark, folder):
    path = new_folder(spark, "alias")
    rows = table(spark, folder, "supplier").selectExpr(*[f"{e} as {n}" for e, n in _ALIAS])
    rows.repartitionByRange(4, "place").sortWithinPartitions("place").write.csv(path, header=True)
    return io.read_alias_lookup(spark, path)


@query(
    "audit_log_file",
    "S6,L10",
    oracle="select source_id, external_id, listing_id from adv where listing_id not in (select listing_id from v_audit)",
    uses=("adv", "v_audit"),
)
def audit_log_file(spark, folder):
    """The adverts that an audit still has to check, from the log it wrote so far."""
    path = new_folder(spark, "audit")
    known = adverts(spark, folder)
    done = audit(spark, folder).join(known.select("listing_id", "url"), "listing_id")
    done.select(F.col("listing_id").alias("id"), "url", "result", F.lit(False).alias("dry_run")).write.json(path)
    log = io.read_audit_log(spark, path).withColumnRenamed("id", "listing_id")
    return L.pending_audit(known, log).select(*L.KEY, "listing_id")
