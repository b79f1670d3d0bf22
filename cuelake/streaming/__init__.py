"""Incremental forms: outcomes of postings, cadence, and loading of shots."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from cuelake.operators import shots
from cuelake.staging import shared_dir, written


#: Parts that record keys are dealt to. A batch costs a few milliseconds for each part that it touches, not for each key.
KEY_PARTS = 1 << 14


class _FirstReport(StatefulProcessor):
    """Lets the earliest row of each key of a part pass, and no other of it ever after (or until `keep` milliseconds have gone by).

    The state of a part is the list of its keys: read once and appended to once a batch, each key with a time to live of its own."""

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "rkey string", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for some in rows:  # of a key that stands in many rows one is held
            both = some if first is None else pd.concat([first, some])
            first = both.sort_values(["ts", "path", "outcome"]).drop_duplicates("rkey")
        if first is None:
            return
        seen = {r[0] for r in self.seen.get()} if self.seen.exists() else set()
        fresh = first[~first["rkey"].isin(seen)]
        if len(fresh):
            self.seen.appendList([(k,) for k in fresh["rkey"]])
            yield fresh[["rkey", "path", "outcome", "ts"]]

    def close(self) -> None:
        pass


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """For streams started within: state in a store that keeps keys on disk, as keyed state needs it. The session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def first_reports(outcomes: DataFrame, keep: int | None = None) -> DataFrame:
    """ST2: the first report (rkey, path, outcome, ts) of each record key; works on a table and, in append mode, on a stream.

    In a stream each key is kept in a state, so that a key reported again counts once however late that is;
    with `keep` (milliseconds) it goes after that time and a later report counts again. Reports without a key or time are left out.
    Keys are dealt to KEY_PARTS parts by hash, so that Python and its state are asked once for each part of a batch.
    """
    rows = outcomes.where("rkey IS NOT NULL AND ts IS NOT NULL").select("rkey", "path", "outcome", "ts")
    if not outcomes.isStreaming:
        return rows.groupBy("rkey").agg(F.min(F.struct("ts", "path", "outcome")).alias("r")).select("rkey", "r.path", "r.outcome", "r.ts")
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("rkey"), F.lit(KEY_PARTS)))
    return parts.groupBy("_part").transformWithStateInPandas(_FirstReport(keep), rows.schema, "append", "ProcessingTime" if keep else "None")


def outcomes_folded(reports: DataFrame) -> DataFrame:
    """ST2: postings per path from the first reports of their keys."""
    posted = F.col("outcome") == "posted"
    return reports.groupBy("path").agg(
        F.count_if(posted).alias("posts"), F.max(F.when(posted, F.col("ts"))).alias("last_posted"), F.coalesce(F.bool_or(F.col("outcome") == "refused"), F.lit(False)).alias("skip")
    )


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """ST3: events per hour."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "n")


def sliding_days(events: DataFrame, late: str = "1 day") -> DataFrame:
    """ST3: events of the day up to each hour."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day_from"), "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 day") -> DataFrame:
    """ST3: runs of events of a key without a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("first"), "n")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("dir"), F.lit(buckets)).cast("int")


def edition(folder: str, name: str, number: int) -> str:
    return f"{folder}/{name}/edition={number}"


def _publish(spark: SparkSession, folder: str, number: int, parts: dict[str, DataFrame], buckets: int, before: list[Row]) -> None:
    """Writes buckets of tables as edition `number`, then names for each bucket the edition that holds it now."""
    rows = list(before)
    for name, part in parts.items():
        path = edition(folder, name, number)
        part.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
        held = spark.read.schema(StructType([*part.schema, StructField("bucket", IntegerType())])).parquet(path).groupBy("bucket").count().collect()  # a row for each bucket written
        rows += [Row(table=name, bucket=r["bucket"], number=number, rows=r["count"]) for r in held]
    listing = spark.createDataFrame([(r["table"], r["bucket"], r["number"], r["rows"], buckets) for r in rows], "table string, bucket int, number int, rows long, buckets int")
    listing.coalesce(1).write.mode("overwrite").parquet(edition(folder, "current", number))


def _listing(spark: SparkSession, folder: str, number: int | None = None) -> list[Row]:
    """Which edition holds each bucket: rows for each bucket of each table, no more."""
    if number is not None:
        return spark.read.parquet(edition(folder, "current", number)).collect()
    known = spark.read.parquet(f"{folder}/current")
    last = known.agg(F.max("edition")).first()[0]
    return known.where(F.col("edition") == last).collect()


def stored(spark: SparkSession, folder: str, name: str, schema: StructType, listing: list[Row] | None = None, only: set[int] | None = None) -> DataFrame:
    """A table (`shots` or `manifest`) as the current listing, or a given one, has it; of some buckets, if `only` is given."""
    listing = _listing(spark, folder) if listing is None else listing
    paths = [f"{edition(folder, name, r['number'])}/bucket={r['bucket']}" for r in listing if r["table"] == name and (only is None or r["bucket"] in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def begun(shots_table: DataFrame, manifest: DataFrame, folder: str, buckets: int = 64) -> None:
    """ST1: lays down what a folder begins with, as edition -1."""
    _publish(shots_table.sparkSession, folder, -1, {"shots": shots_table, "manifest": manifest}, buckets, [])


def load_continuously(manifests: DataFrame, folder: str, rows_of: Callable[[DataFrame], DataFrame], described: list[str], schemas: dict[str, StructType], within: float = 0.05) -> None:
    """ST1: a stream of manifest rows (dir, mtime, size) into the tables of shots below `folder`; runs over what there is now.

    The tables are in buckets of folders. A batch reads and writes the buckets of its new or changed folders only,
    as an edition of its own, and then names the edition in which each bucket is current: buckets that it
    doesn't touch stay where they are. So a batch that is run again does the same again, and readers never see half
    of one. `rows_of(batch)` gives the cues of a batch's folders. Of several rows of a folder in a batch the latest
    counts. A manifest that was seen flows in again under a new file name only; it then changes nothing.
    schemas: of `shots` and `manifest`. Counters of a batch (M2) are in `counts`, an edition each.
    """

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _listing(spark, folder, number - 1)
        buckets = before[0]["buckets"]
        latest = batch.groupBy("dir").agg(F.max_by(F.struct("mtime", "size"), "mtime").alias("x")).select("dir", "x.*")
        seen = {r[0] for r in batch.select(_bucket(buckets)).distinct().collect()}  # numbers of buckets
        todo = shots.changed_dirs(latest, stored(spark, folder, "manifest", schemas["manifest"], before, seen))
        touched = {r[0] for r in todo.select(_bucket(buckets)).distinct().collect()}
        old, manifest = (stored(spark, folder, name, schemas[name], before, touched) for name in ("shots", "manifest"))
        changed = latest.where(_bucket(buckets).isin(touched)) if touched else latest.limit(0)
        rows = written(rows_of(changed), "st1-rows") if touched else rows_of(changed)  # joined and counted several times
        new, known, counts = shots.loaded(old, manifest, changed, rows, described, within)
        rest = [r for r in before if r["bucket"] not in touched]
        parts = {"shots": new.select(*schemas["shots"].names), "manifest": known.select(*schemas["manifest"].names)}
        others = sum(r["rows"] for r in rest if r["table"] == "shots")
        counts.withColumn("total", F.col("total") + others).write.mode("overwrite").parquet(edition(folder, "counts", number))
        _publish(spark, folder, number, parts if touched else {}, buckets, rest)

    writer = manifests.writeStream.foreachBatch(load).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source holds now and return the complete result.

    Each batch writes the result so far (in append mode, what it adds) as Parquet under the shared folder, which is read
    back, so that no row passes through the driver. The stream's checkpoint lies there too.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/batch-{number}")
        done.append(number)

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    with keyed_state(spark):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    parts = sorted(set(done)) if mode == "append" else done[-1:]
    return spark.read.schema(stream.schema).parquet(*(f"{folder}/batch-{k}" for k in parts))
