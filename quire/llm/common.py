"""What the operators share: stable row places, blocks of rows, ranks, settling."""

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILE, ROW, BLOCK = "_at_file", "_at_row", "_at_block"


def shared(spark: SparkSession) -> str:
    """A new folder under the one the cluster shares; our own only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        import tempfile

        base = getattr(spark, "_llm_dir", None)
        if base is None:
            base = spark._llm_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, and a lost
    executor costs a read."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and where each row stands: (_at_file, _at_row), unique.

    A table read from Parquet has places already; another is written once, so that
    its rows keep the places they get.
    """
    try:
        return df.select(
            *columns,
            F.xxhash64("_metadata.file_path").alias(FILE),
            F.col("_metadata.row_index").alias(ROW),
        )
    except AnalysisException:
        return settle(
            df.select(*columns)
            .withColumn(ROW, F.monotonically_increasing_id())
            .withColumn(FILE, F.shiftright(ROW, 33))
            .withColumn(ROW, F.col(ROW).bitwiseAND((1 << 33) - 1))
        )


ALL = "_all"


def whole(df: DataFrame):
    """All columns of df as one, so that no name of theirs can meet one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ALL)


def apart(names: list[str]) -> list:
    """The columns that ``whole`` put together."""
    return [F.col(f"{ALL}.`{c}`").alias(c) for c in names]


def blocked(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``placed`` with _at_block, one value for each run of rows of one file."""
    return placed(df, *columns).withColumn(BLOCK, F.xxhash64(FILE, F.floor(F.col(ROW) / rows)))


def lower_ascii(text):
    """A-Z lower-cased, all else as it is; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def ranked(df: DataFrame, group: list, order: list, value: str | None = None) -> DataFrame:
    """df with _rank, gapless from 0 in each group by order, and with ``value``
    also _before, its sum over the rows that come earlier in the group.

    Rows are dealt by range of (group, order), so a group of any size is spread
    over tasks; only one row per task and group is summed up across tasks. df is
    written once, so it should be narrow. order must tell rows apart; rows equal in
    it are ranked in any order, so keep only rows that are alike equal.
    """
    dealt = settle(df.repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id()))
    keys = ["_pid", *[f"_g{i}" for i in range(len(group))]]
    dealt = dealt.withColumns({f"_g{i}": F.col(g) for i, g in enumerate(group)})
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(value).alias("_v")] if value else [])
    parts = dealt.groupBy(*keys).agg(*sums)
    before = W.partitionBy(*keys[1:]).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"{k}_") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v0")] if value else []),
    )
    here = W.partitionBy(*keys).orderBy(*order)
    out = dealt.withColumn("_rank", F.row_number().over(here) - 1)
    if value:
        out = out.withColumn(
            "_before", F.coalesce(F.sum(value).over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    out = out.join(parts, same)
    out = out.withColumn("_rank", (F.col("_rank") + F.col("_n0")).cast("long"))
    if value:
        out = out.withColumn("_before", F.col("_before") + F.col("_v0"))
    return out.select(*df.columns, "_rank", *(["_before"] if value else []))


def part(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
