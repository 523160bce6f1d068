"""Mixing sources to target weights: capped water-filling, then seeded repetition."""

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import ALL, FILE, ROW, apart, placed, ranked, whole

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(sizes: list[float], weights: list[float], epochs: float, total: float | None = None) -> list[float]:
    """Targets that share ``total`` (all sizes by default) by weight, none above
    ``epochs`` times its source's size: sources above are clamped and what they
    can't take is shared among the others by weight, until none is above. If every
    source is clamped the targets add up to less than ``total``."""
    left = float(sum(sizes) if total is None else total)
    targets = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if weights[i] > 0]
    while free:
        share = left / sum(weights[i] for i in free)
        over = [i for i in free if share * weights[i] > epochs * sizes[i]]
        if not over:
            for i in free:
                targets[i] = share * weights[i]
            break
        for i in over:
            targets[i] = float(epochs * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in set(over)]
    return targets


def source_targets(sizes: DataFrame, weigh, epochs: float = 3.0, total: float | None = None) -> DataFrame:
    """sizes (source, source_size) with the target of each source.

    ``weigh`` makes the list of weights from the list of sources, which is in code
    point order with null last. A mix names a weight for each source, so the table
    of sources is a setting and is handled on the driver.
    """
    spark = sizes.sparkSession
    rows = [(r[0], int(r[1])) for r in sizes.select("source", "source_size").collect()]
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    targets = fill([n for _, n in rows], weigh([s for s, _ in rows]), epochs, total)
    return spark.createDataFrame(
        [(s, n, t) for (s, n), t in zip(rows, targets)], "source string, source_size long, target double"
    )


def mix(docs: DataFrame, weigh, epochs: float = 3.0, seed: int = 17, id_column: str = "doc_id") -> DataFrame:
    """How often each row is repeated so that every source meets its target.

    A source whose target is r times its size repeats each of its rows floor(r)
    times; then its rows are taken once more, in an order drawn from the seed, until
    the words are spent. The row where they run out is taken for its first
    ``extra_words`` words only, so a source's taken words differ from its target by
    less than one. Returns id, place (_at_file, _at_row), source, size, source_size,
    target, copies, extra_words and taken (words, repeats counted; at most epochs
    times the size). A null text has no words and is repeated none the less; a null
    source is a source. Rows alike in all are told apart by place. The order depends
    on the seed, id and text, so reruns agree.
    """
    draw = F.xxhash64(F.lit(seed), F.col(id_column), F.coalesce("text", F.lit("")))
    more = {"_id": F.col(id_column), "size": word_count(F.col("text")), "_draw": draw}
    base = placed(docs.withColumns(more), "_id", "source", "size", "_draw")
    drawn = ranked(base, ["source"], ["_draw", FILE, ROW], "size")
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weigh, epochs).withColumnRenamed("source", "_source")
    out = drawn.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.least(F.floor(ratio), F.lit(int(epochs)))
    spend = F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_spend") - F.col("_before"))).cast("long")
    out = out.withColumn("_whole", whole.cast("long")).withColumn("_spend", spend).withColumn("_extra", extra)
    more = (F.col("_extra") == F.col("size")) & (F.col("_extra") > 0)
    return out.select(
        F.col("_id").alias(id_column), FILE, ROW, "source", "size", "source_size", "target",
        (F.col("_whole") + F.when(more, 1).otherwise(0)).alias("copies"),
        F.when(more, F.lit(0)).otherwise(F.col("_extra")).cast("long").alias("extra_words"),
        (F.col("_whole") * F.col("size") + F.col("_extra")).alias("taken"),
    )


def cycle(weights=(5.0, 2.0, 1.0)):
    """Weights dealt out to the sources in turn."""
    return lambda sources: [weights[i % len(weights)] for i in range(len(sources))]


def materialize(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of docs as often as the plan says, in docs' own columns.

    Documents stay whole: the one of each source that the plan takes in part is
    repeated once more if at least half of it is taken.
    """
    times = F.col("copies") + F.when((F.col("extra_words") * 2 >= F.col("size")) & (F.col("extra_words") > 0), 1).otherwise(0)
    n = plan.select(F.col(FILE).alias("_f"), F.col(ROW).alias("_r"), times.cast("int").alias("_times")).where("_times > 0")
    rows = placed(docs.select(whole(docs)), ALL).join(n, (F.col(FILE) == F.col("_f")) & (F.col(ROW) == F.col("_r")))
    return rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*apart(docs.columns))
