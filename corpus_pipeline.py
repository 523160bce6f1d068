"""A corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns
the columns of documents; the last adds where each row lies. Columns beyond those of
documents are left behind by the first stage, whatever their names; ids may repeat or be
null; an empty table gives an empty table.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import decontamination, language_id, mixing, near_dedup, resharding
from quire.llm.common import settle
from quire.llm.queries import OLD_SHARDS, SHARDS, lies_in
from quire.session import prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those whose text is null or has no letter, and
    those whose likeliest language is under 0.3. Repeated rows meet one fate; ties of
    languages go to the first by name; texts are read whole, whatever their length."""
    prepare(spark)
    return language_id.accepted(docs.select(*COLUMNS))


def near_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id, of rows of
    one id the first in place. Texts that are null or without words are near to nothing
    and stay."""
    prepare(spark)
    return near_dedup.one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: three quarters of its shingles of five
    words. Items of fewer words, and texts without words, meet nothing."""
    prepare(spark)
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights; rows repeat. A null
    source is a source; a null text has no words and is repeated with its source. Which
    rows are taken once more is drawn from id and text, so reruns agree."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    return mixing.materialize(docs, mixing.mix(docs, mixing.cycle()))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows lie in 40 shards of equal counts, moved from 32 at least cost; the columns
    of documents with old_shard and shard. Rows that repeat are rows like any, told apart
    by place."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    plan = resharding.reshard(docs, lies_in(F.col("doc_id")), OLD_SHARDS, SHARDS)
    return resharding.rewrite(docs, plan).select(*COLUMNS, "old_shard", "shard")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup_),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # the network of the first stage has no SQL
