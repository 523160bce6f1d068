"""Incremental input as Structured Streaming jobs."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructType

from quire import constants as K, schemas
from quire.operators import decisions as D, emit as E, ingest as I
from quire.operators.log import NAMES, State, out_of
from quire.plans.convert import lay_out, plan_landing
from quire.session import settle
from quire.sources.tables import layout_tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


BUCKETS = 64  # of a kept table, so that a batch reads and writes those it needs


def layout_stream(spark: SparkSession, path: str) -> DataFrame:
    """Layout files as they land."""
    files = spark.readStream.schema(schemas.struct(schemas.LAYOUT_FILE)).json(path)
    return files.select("*", F.col("_metadata.file_modification_time").alias("landed_at"))


def _bucket(*keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A kept table, empty where nothing was kept yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


_DONE = "doc_id string, revision string, version int, pins string, batch int, bucket int"


def convert_stream(docs: DataFrame, out: str, checkpoint: str, decided: DataFrame | None = None, version: int = K.READER_VERSION, pins: str = ""):
    """Layout files to blocks and markdown lines, each revision of a document once.

    A document's revision is the hash of its pages. What was converted already by this
    version under these pins is skipped, however often and under whatever name it lands
    again; a document with decisions keeps the reading they were made on. ``landed`` says
    what became of each document, ``status`` of each page: pages that can't be laid out
    stop no other. Of several revisions in one batch the one landed last counts.

    A batch is written under its own number, so a batch run again replaces itself; it
    reads only those buckets of the done table that its documents fall in.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        revision = F.sha2(F.to_json(F.struct("format", "reader", "bodySize", "pages")), 256)
        last = F.max_by(F.struct("format", "reader", "bodySize", "pages"), F.struct("landed_at", "revision")).alias("d")
        df = df if "landed_at" in df.columns else df.withColumn("landed_at", F.lit(None).cast("timestamp"))
        docs = df.withColumn("revision", revision).groupBy("doc_id").agg(last, F.max_by("revision", F.struct("landed_at", "revision")).alias("revision"))
        docs = settle(docs.select("doc_id", "revision", "d.*"), "landed")
        named = docs.select("doc_id", "revision")
        needed = [r[0] for r in named.select(_bucket("doc_id")).distinct().collect()]  # BUCKETS numbers at most
        done = _kept(spark, f"{out}/done", _DONE).where(F.col("batch") < batch_id).where(F.col("bucket").isin(needed))
        held = decided if decided is not None else named.select("doc_id").limit(0)
        plan = settle(plan_landing(named, done, held, version, pins), "plan")
        todo = docs.join(plan.where("state = 'convert'").select("doc_id"), "doc_id", "left_semi")
        t = layout_tables(todo)
        laid = lay_out(t["runs"], t["links"], t["pictures"])
        blocks = settle(laid.blocks, "blocks")
        md = E.emit(blocks, t["pages"], pictures=t["pictures"])
        tables = {"blocks": blocks, "md_lines": md.lines, "status": laid.status, "errors": laid.broken, "landed": plan}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        ledger = plan.where("state = 'convert'").select("doc_id", "revision", F.lit(version).alias("version"), F.lit(pins).alias("pins"))
        ledger.withColumn("bucket", _bucket("doc_id")).write.partitionBy("bucket").mode("overwrite").parquet(f"{out}/done/batch={batch_id}")

    return (
        docs.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def converted(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of ``convert_stream`` as it stands: each document's rows of the batch
    that converted it last."""
    last = _kept(spark, f"{out}/done", _DONE).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{name}").join(last, ["doc_id", "batch"], "left_semi").drop("batch")


_DECISION = "doc_id {0}, block_id string, action string, seq {1}, batch int, bucket int"


def latest_decisions_stream(log: DataFrame, out: str, checkpoint: str, compact_every: int = 32):
    """The newest edit of each block, merged when it is read (``read_latest``).

    A batch is reduced and written as a delta into the buckets its blocks fall in; what
    stood is neither read nor written. Every ``compact_every`` batches the buckets that
    have deltas are written anew.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        new = D.latest_decisions(df).withColumn("bucket", _bucket("doc_id", "block_id"))
        new.write.partitionBy("bucket").mode("overwrite").parquet(f"{out}/deltas/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact_latest(df.sparkSession, out, batch_id)

    return (
        log.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _latest_parts(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """Rows of the newest written form of each bucket, and of the deltas after it."""
    deltas = spark.read.parquet(f"{out}/deltas")
    types = [deltas.schema[c].dataType.simpleString() for c in ("doc_id", "seq")]
    whole = _kept(spark, f"{out}/whole", _DECISION.format(*types))
    if upto is not None:
        deltas, whole = deltas.where(F.col("batch") <= upto), whole.where(F.col("batch") < upto)
    newest = whole.groupBy("bucket").agg(F.max("batch").alias("_newest"))
    names = ["doc_id", "block_id", "action", "seq", "bucket"]
    kept = whole.join(newest, "bucket").where("batch = _newest").select(*names, F.lit(False).alias("fresh"))
    after = deltas.join(newest, "bucket", "left").where("_newest is null or batch > _newest").select(*names, F.lit(True).alias("fresh"))
    return kept.unionByName(after)


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest edit of each block so far."""
    return D.latest_decisions(_latest_parts(spark, out))


def compact_latest(spark: SparkSession, out: str, batch_id: int) -> None:
    """Writes the buckets that have deltas since they were written last, as of batch_id."""
    parts = _latest_parts(spark, out, batch_id)
    stale = parts.where("fresh").select("bucket").distinct()
    rows = D.latest_decisions(parts.join(stale, "bucket", "left_semi"))
    rows.withColumn("bucket", _bucket("doc_id", "block_id")).write.partitionBy("bucket").mode("overwrite").parquet(f"{out}/whole/batch={batch_id}")


class FoldLog(StatefulProcessor):
    """A document's decisions and undo history as state. No command is lost to a
    restart: state and output commit with their batch."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", StructType().add("saved", StringType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        state = State(saved[0] if saved else None)
        batch = pd.concat(list(rows)).sort_values("seq")
        for action, block, payload in zip(batch["action"], batch["block_id"], batch["payload"]):
            state.take(action, block, payload if isinstance(payload, str) else None)
        self.state.update((state.saved(),))
        yield pd.DataFrame([state.row(key[0])], columns=NAMES)

    def close(self) -> None:
        pass


def fold_log_stream(log: DataFrame) -> DataFrame:
    """log(doc_id, seq, action, block_id, payload), as it arrives, folded."""
    return log.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=FoldLog(), outputStructType=out_of(log), outputMode="Update", timeMode="None"
    )


def stage_stream(candidates: DataFrame, manifest: DataFrame, out: str, checkpoint: str):
    """Drops as they arrive: one copy per id and hash, then reconciled whole."""
    once = candidates.dropDuplicates(["doc_id", "sha256"])

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{out}/candidates/batch={batch_id}")
        every = spark.read.parquet(f"{out}/candidates").drop("batch")
        I.reconcile(manifest, every).write.mode("overwrite").parquet(f"{out}/status/version={batch_id}")

    return (
        once.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def progress(pages_read: DataFrame) -> DataFrame:
    """Pages read of each document so far, as a stream in update mode."""
    return pages_read.groupBy("doc_id").agg(F.count("*").alias("pages_read"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None]):
    """Run a stream over all that is there now, each batch through `write`."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out
