"""Session settings and the one place lineage is cut."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A union of alike-partitioned sides must not pass for partitioned itself:
    # adaptive execution may change one side afterwards, and a grouping over the
    # union would then count its keys once per side.
    "spark.sql.unionOutputPartitioning": "false",
}


def build(master: str, app: str = "quire", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings results depend on, laid on a session someone else made."""
    for key in ("spark.sql.session.timeZone", "spark.sql.unionOutputPartitioning"):
        spark.conf.set(key, SETTINGS[key])
    return spark


def widen(df: DataFrame, key: str) -> DataFrame:
    """df spread over the cores when it comes in fewer pieces than there are.

    A table of many files is left as it lies: this moves only small ones.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for cut lineage; one of our own only where
    none is named and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    own = getattr(spark, "_quire_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._quire_dir = own
    return own


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def written_once(spark: SparkSession):
    """What is written here leaves no shuffle behind: nobody asks for it again, and without
    this its files lie there until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: what is used twice is
    computed once, and a lost executor costs a read, not a recompute."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with written_once(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: dict = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make):
    """A table a pipeline would keep, made once for a session and a data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]
