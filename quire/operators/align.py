"""Page positions to markdown lines: paired by block, read between the pairs."""

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quire.operators.ordered import nearest_known, running_before

PAGE = ["doc_id", "page"]


def _longest(xs) -> list[int]:
    """Places of the longest strictly increasing run."""
    tails, at, back = [], [], []
    for i, x in enumerate(xs):
        k = bisect.bisect_left(tails, x)
        back.append(at[k - 1] if k else -1)
        tails[k:k + 1], at[k:k + 1] = [x], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


@F.pandas_udf(ArrayType(IntegerType()))
def _longest_udf(xs: pd.Series) -> pd.Series:
    return xs.map(lambda v: _longest(list(v)))


def align_positions(placed: DataFrame, blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """(doc_id, x, y): page position and markdown line of the blocks kept as pairs.

    Pages stand one under another and the markdown keeps their order, so the
    longest increasing run of a document is its pages' runs end to end: each is
    found inside its page. tops(doc_id, page, top) comes from page_tops.
    """
    pairs = (
        placed.where("not deleted")
        .join(blocks.select("doc_id", "page", "block_id", "box"), [*PAGE, "block_id"])
        .join(tops, PAGE)
        .select(*PAGE, F.col("line_from").alias("y"), (F.col("top") + F.col("box.y")).alias("x"))
        .where("x > 0 and y > 0")
    )
    packed = pairs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("p"))
    kept = packed.withColumn("keep", _longest_udf(F.transform("p", lambda s: s["x"])))
    return kept.select(
        *PAGE, F.inline(F.transform("keep", lambda i: F.element_at("p", i + 1)))
    ).select("doc_id", "page", "x", "y")


def page_tops(pages: DataFrame) -> DataFrame:
    """(doc_id, page, top): where each page starts when pages stand in a column."""
    whole = pages.withColumn("_h", F.ceil("height"))
    return running_before(whole, ["doc_id"], "page", F.col("_h"), "top").select(*PAGE, F.col("top").cast("double").alias("top"))


def positions_to_lines(points: DataFrame, asked: DataFrame, tops: DataFrame, ends: DataFrame) -> DataFrame:
    """asked(doc_id, page, q, x) with y: read between the pairs either side.

    An as-of join as a union: a page's pairs and questions are sorted together
    by x, the pair before and the pair after are carried to each question, and
    the line between them is linear. The pairs around a page come from the
    nearest pages that have any, or are the two ends: ends(doc_id, end_x, end_y).
    """
    pair = F.struct("x", F.col("y").cast("double").alias("y"))
    edges = points.groupBy(*PAGE).agg(F.min_by(pair, "x").alias("first"), F.max_by(pair, "x").alias("last"))
    pages = tops.select(*PAGE).join(edges, PAGE, "left")
    pages = nearest_known(pages, ["doc_id"], "page", F.col("last"), "lo", ahead=False)
    pages = nearest_known(pages, ["doc_id"], "page", F.col("first"), "hi", ahead=True).join(ends, "doc_id")
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    end = F.struct(F.col("end_x").cast("double").alias("x"), F.col("end_y").cast("double").alias("y"))
    around = pages.select(
        *PAGE, F.explode(F.array(F.coalesce("lo", start), F.coalesce("hi", end))).alias("pair")
    ).select(*PAGE, "pair.x", "pair.y")
    known = points.select(*PAGE, "x", F.col("y").cast("double").alias("y")).unionByName(around)
    known = known.withColumn("q", F.lit(None).cast("long"))
    wanted = asked.select(*PAGE, "x", F.lit(None).cast("double").alias("y"), "q")
    order = Window.partitionBy(*PAGE).orderBy("x", F.col("q").isNotNull())
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    here = F.when(F.col("q").isNull(), F.struct("x", "y"))
    both = (
        known.unionByName(wanted)
        .withColumn("lo", F.last(here, ignorenulls=True).over(back))
        .withColumn("hi", F.first(here, ignorenulls=True).over(ahead))
        .where("q is not null")
    )
    span = F.col("hi.x") - F.col("lo.x")
    share = F.when(span > 0, (F.col("x") - F.col("lo.x")) / span).otherwise(F.lit(0.0))
    y = F.when(F.col("hi").isNull(), F.col("lo.y")).otherwise(
        F.col("lo.y") + share * (F.col("hi.y") - F.col("lo.y"))
    )
    return both.select(*PAGE, "q", "x", y.alias("y"))
