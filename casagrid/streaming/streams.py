"""Structured Streaming twins of the keyed trace, note, discovery and snapshot rules.

Rows of a key are sorted inside each micro-batch. Input whose micro-batches follow each other in time gives the result
of the batch job; a point that comes after later ones were worked is rejected with reason ``order``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DateType, LongType, StringType, StructField, StructType

from casagrid.operators import lifecycle as L
from casagrid.operators import trace_rules as R
from casagrid.operators import traces as T
from casagrid.sources.tables import join_rows

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS_PER_FRAME = 10_000
# How old a position may be, and how far ahead of the clock, when it is received.
STALE_MS, FUTURE_MS = 10_000, 1_000
CHANGE = StructType(
    [
        StructField("property_id", LongType()), StructField("snapshot_id", LongType()), StructField("observed_on", DateType()), StructField("kind", StringType()),
        StructField("old_currency", StringType()), StructField("old_price", LongType()), StructField("currency", StringType()), StructField("price", LongType()),
    ]
)


class KeyedScan(StatefulProcessor):
    """Keeps the state of a rule per key as JSON and emits its rows."""

    def __init__(self, rule: R.Rule, order: list[str], names: list[str]) -> None:
        self.rule, self.order, self.names = rule, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state = json.loads(held[0]) if held else None
        # One key's rows of one micro-batch; the trigger's file or row limit bounds them.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="mergesort")
        for at in range(0, len(batch), ROWS_PER_FRAME):
            frame = batch.iloc[at : at + ROWS_PER_FRAME]
            state, columns = self.rule(state, frame)
            keep = columns.pop("_out", None)
            out = frame.assign(**columns)
            yield (out if keep is None else out[keep])[self.names]
        self.state.update((json.dumps(state),))

    def close(self) -> None:
        pass


def keyed_stream(stream: DataFrame, key: str, rule: R.Rule, order: list[str], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(",")]
    return stream.groupBy(key).transformWithStateInPandas(KeyedScan(rule, order, names), outputStructType=schema, outputMode="Append", timeMode="None")


def accept_stream(stream: DataFrame) -> DataFrame:
    schema = "session_id long, event_id long, ts_ms long, accepted boolean, distance_m double, reason string"
    return keyed_stream(stream, "session_id", R.accept_rule, ["ts_ms", "event_id"], schema)


def sample_stream(stream: DataFrame) -> DataFrame:
    schema = "session_id long, event_id long, ts_ms long, latitude double, longitude double"
    return keyed_stream(stream, "session_id", R.sample_rule, ["ts_ms", "event_id"], schema)


def heading_stream(stream: DataFrame) -> DataFrame:
    schema = "session_id long, event_id long, camera_heading double, moving boolean, reason string"
    return keyed_stream(stream, "session_id", R.heading_rule, ["ts_ms", "event_id"], schema)


def alert_stream(stream: DataFrame, properties: DataFrame) -> DataFrame:
    """Stream–static distance join, then the announced groups of each session as state."""
    rows = T.alert_candidates(stream, T.property_groups(properties))
    schema = "session_id long, event_id long, group_id string, direction string, distance_m double"
    order = ["ts_ms", "event_id", "rank", "distance_m", "first_property"]
    return keyed_stream(rows, "session_id", R.alert_rule, order, schema)


def note_stream(stream: DataFrame) -> DataFrame:
    schema = "note_id long, arrived long, outcome string, revision_after long"
    return keyed_stream(stream, "note_id", R.by_row(T.note_step), ["arrived"], schema)


def arrival_verdict(ts: str = "ts", received: str = "received") -> Column:
    """``future``, ``late``, ``invalid`` or ``usable``, by the age of a position when it was received."""
    age_ms = (F.unix_millis(F.col(received)) - F.unix_millis(F.col(ts))).cast("long")
    whole = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.coalesce(F.col("accuracy") <= T.MAX_ACCURACY_M, F.lit(False))
    return F.when(age_ms.isNull() | ~whole, "invalid").when(age_ms < -FUTURE_MS, "future").when(age_ms > STALE_MS, "late").otherwise("usable")


def position_windows(stream: DataFrame, key: str = "session_id", ts: str = "ts", received: str = "received", width: str = "1 minute") -> DataFrame:
    """Usable positions of each key and window of event time, given out once the watermark has passed the window.

    The watermark trails the latest usable position by the age at which one goes stale, and a position whose window it
    has passed is dropped. Future positions are put aside first, so they cannot push it ahead.
    """
    usable = stream.filter(arrival_verdict(ts, received) == "usable").withWatermark(ts, f"{STALE_MS} milliseconds")
    counts = usable.groupBy(key, F.window(ts, width).alias("span")).agg(F.count("*").alias("positions"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    return counts.select(key, F.col("span.start").alias("window_start"), "positions", "first_at", "last_at")


def arrival_counts(stream: DataFrame, key: str = "session_id", ts: str = "ts", received: str = "received", width: str = "1 minute") -> DataFrame:
    """Positions of each verdict by key and window of the time of receipt; what :func:`position_windows` leaves out."""
    marked = stream.withColumn("verdict", arrival_verdict(ts, received)).withWatermark(received, "0 seconds")
    n = lambda verdict: F.count_if(F.col("verdict") == verdict).alias(verdict)
    counts = marked.groupBy(key, F.window(received, width).alias("span")).agg(*map(n, ("usable", "late", "future", "invalid")))
    return counts.select(key, F.col("span.start").alias("window_start"), "usable", "late", "future", "invalid")


# Ids that differ in their last eight bits only share one state value.
BUCKET_BITS = 8


class ContentChanges(StatefulProcessor):
    """Keeps the contents that the properties of a bucket have had, in order; emits each new one with that before it.

    A bucket holds 256 ids at most, so its state and its frames are bounded, and one call works all of them at once.
    """

    KEPT = ["property_id", "content_hash", "currency", "price"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", StructType([StructField("contents", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows of one bucket in one micro-batch, which the trigger's file limit bounds.
        types = {"property_id": "Int64", "price": "Int64"}
        batch = pd.concat(list(rows), ignore_index=True).astype(types).sort_values(["observed_on", "snapshot_id"], kind="mergesort").assign(fresh=True)
        if self.kept.exists():
            had = pa.ipc.open_stream(self.kept.get()[0]).read_all().to_pandas().astype(types)
            batch = pd.concat([had.assign(fresh=False), batch], ignore_index=True)
        batch = batch.drop_duplicates(["property_id", "content_hash"]).sort_values("property_id", kind="mergesort")
        before = batch.groupby("property_id", dropna=False)[["currency", "price"]].shift()
        first = ~batch["property_id"].duplicated()
        out = batch.assign(kind=first.map({True: "first", False: "change"}), old_currency=before["currency"], old_price=before["price"])[batch["fresh"].to_numpy(bool)]
        if len(out):
            table = pa.Table.from_pandas(batch[self.KEPT], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            self.kept.update((sink.getvalue().to_pybytes(),))
            yield out.astype({"snapshot_id": "Int64"})[CHANGE.names]

    def close(self) -> None:
        pass


def snapshot_changes(stream: DataFrame) -> DataFrame:
    """New contents of each property with the currency and price before and after.

    ``stream``: property_id, snapshot_id, observed_on, content_hash, currency, price. A content that a property has had
    once is never new again, however late it returns; the state lives in the RocksDB store, spread over the shuffle
    partitions. Micro-batches that follow each other in time give the events of a window over the whole history.
    """
    rows = stream.withColumn("bucket", F.shiftright("property_id", BUCKET_BITS))
    return rows.groupBy("bucket").transformWithStateInPandas(ContentChanges(), outputStructType=CHANGE, outputMode="Append", timeMode="None")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available into a Parquet folder, exactly once per micro-batch."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


class DiscoveryLog:
    """Discovered adverts and running counters as two tables, a folder for each micro-batch.

    A batch reads folders of smaller numbers only and overwrites its own, so one that is run again changes nothing.
    """

    ITEMS = "source_id long, external_id long, url string, position long, listing_id long, matched_by string, status string"
    COUNTS = "source_id long, seen long, existing long, new long, out_of_phase long"

    def __init__(self, spark: SparkSession, path: str, classify: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.path, self.classify = spark, path, classify

    def table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        if before == 0:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        rows = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def record(self, batch: DataFrame, number: int) -> None:
        """Classify what no earlier batch has had, and add it to the counters of the batch before."""
        key = ["source_id", "external_id"]
        fresh = join_rows(self.classify(batch), self.table("items", self.ITEMS, number).select(*key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.path}/items/batch={number}")
        own = self.spark.read.schema(self.ITEMS).parquet(f"{self.path}/items/batch={number}")
        names = ["seen", "existing", "new", "out_of_phase"]
        last = self.table("counts", self.COUNTS, number).groupBy("source_id").agg(F.max_by(F.struct(*names), "batch").alias("c")).select("source_id", "c.*")
        total = last.unionByName(L.discovery_counts(own)).groupBy("source_id").agg(*[F.sum(n).alias(n) for n in names])
        total.write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")

    def items(self) -> DataFrame:
        return self.table("items", self.ITEMS).drop("batch")

    def counts(self) -> DataFrame:
        """Counters after the last batch of each source."""
        rows = self.table("counts", self.COUNTS)
        return rows.groupBy("source_id").agg(F.max_by(F.struct("seen", "existing", "new", "out_of_phase"), "batch").alias("c")).select("source_id", "c.*")


def record_discovery(stream: DataFrame, log: DiscoveryLog, checkpoint: str) -> None:
    """Drain what is available of a stream of discovered links into ``log``."""
    query = stream.writeStream.foreachBatch(log.record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
