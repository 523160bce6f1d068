"""Exact deduplication as a stateful stream.

State, one entry for each digest and kept for ever on disk (RocksDB): how many
texts had it, the stable identifier of the one that stays (the largest id) and
where that text lies (file and row). Texts are not in the state; on a hit the
bytes of both texts are fetched and compared.
"""

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.llm.common import FILE, ROW, lower_ascii, placed, settle, shared

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession):
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        # many small stores: no room is set aside on disk before it is needed
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    were = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in were.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_state(stream: DataFrame, digest: Column, id_column: str, checkpoint: str | None = None) -> DataFrame:
    """The state after all that now lies in the stream's source: (_digest, _n, _keep).

    ``_keep`` is struct(id, file, row) of the row that stays: the largest id, null
    least; of rows alike in it the one with the largest place. ``checkpoint`` names a
    folder to go on from in a later call; a new one is used otherwise, and each
    call's result holds the digests touched since the folder was begun.
    """
    spark = stream.sparkSession
    home = checkpoint or shared(spark)
    keep = F.struct(
        F.col(id_column).alias("id"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    state = (
        stream.select(digest.alias("_digest"), keep.alias("_keep"))
        .groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_keep").alias("_keep"))
    )

    landed_any = [bool(checkpoint)]

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/state/batch={number}")
        landed_any[0] = True

    with _state_on_disk(spark):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{home}/log")
            .trigger(availableNow=True)
            .foreachBatch(land)
            .start()
        )
        query.awaitTermination()
    schema = state.schema
    if not landed_any[0]:
        return spark.createDataFrame([], schema)
    landed = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{home}/state")
    return landed.groupBy("_digest").agg(F.max("_n").alias("_n"), F.max("_keep").alias("_keep"))


def decide(docs: DataFrame, state: DataFrame, digest: Column, norm: Column, id_column: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, _at_file, _at_row, keep_id, group_size, kept, digest.

    Rows whose digest came once stay. On a hit the full bytes are compared with
    those of the row that stays; rows that differ from it (two texts of one digest)
    are grouped by their own bytes, so a weak digest costs time and no result.
    """
    base = placed(docs.withColumns({"_id": F.col(id_column), "_digest": digest, "_norm": norm}), "_id", "_digest", "_norm")
    once = state.where("_n = 1").select(
        F.col("_keep.id").alias("_id"), F.col("_keep.file").alias(FILE), F.col("_keep.row").alias(ROW),
        F.col("_keep.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("_digest").alias("digest"),
    )
    hit = state.where("_n > 1").select(F.col("_digest"), "_n", "_keep")
    hits = settle(base.join(hit, "_digest"))
    place = F.struct(F.col("_id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    stays = hits.where(place == F.col("_keep")).select(
        F.col("_digest"), F.col("_norm").alias("_stays")
    )
    checked = settle(hits.join(stays, "_digest").select(
        "_id", FILE, ROW, "_digest", "_n", "_keep", (F.col("_norm") == F.col("_stays")).alias("_same"),
        F.when(F.col("_norm") != F.col("_stays"), F.col("_norm")).alias("_norm"),
    ))
    odd = checked.where("not _same")
    wrong = odd.groupBy("_digest").agg(F.count(F.lit(1)).alias("_wrong"))
    alike = checked.where("_same").join(wrong, "_digest", "left")
    place = F.struct(F.col("_id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    own = odd.groupBy("_norm").agg(F.count(F.lit(1)).alias("_m"), F.max(place).alias("_own"))
    odd = odd.join(own, "_norm").select(
        "_id", FILE, ROW, F.col("_digest").alias("digest"), F.col("_own.id").alias("keep_id"), F.col("_m").alias("group_size"),
        (place == F.col("_own")).alias("kept"),
    )
    alike = alike.select(
        "_id", FILE, ROW, F.col("_digest").alias("digest"), F.col("_keep.id").alias("keep_id"),
        (F.col("_n") - F.coalesce("_wrong", F.lit(0))).alias("group_size"), (place == F.col("_keep")).alias("kept"),
    )
    return once.unionByName(alike).unionByName(odd).withColumnRenamed("_id", id_column)


def exact_dedup(spark: SparkSession, path: str, digest=None, checkpoint: str | None = None) -> DataFrame:
    """Deduplicates the Parquet table at ``path`` by its text column.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Returns doc_id, keep_id, group_size, kept, digest (of the normalised text, SHA-256
    in hex) and the row's place.
    Repeated rows with one id are told apart by place, so one row of each group
    stays; null ids are least. An empty table gives no rows; other columns of the
    table are not read. ``digest`` makes another digest of the normalised text.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    norm = lower_ascii(F.col("text"))
    digest = digest or (lambda t: F.sha2(t, 256))
    each = f"{path[:-1]}[{path[-1]}]"  # as a pattern: a stream takes no path of a single file
    state = settle(keep_state(spark.readStream.schema(schema).parquet(each), digest(norm), "doc_id", checkpoint))
    return decide(spark.read.parquet(path), state, digest(norm), norm)
