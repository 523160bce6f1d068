"""Choosing blocks in bulk, and what may be done with the ones chosen."""

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quire import constants as K
from quire.functions import geometry as G

PAGE = ["doc_id", "page"]


def select_range(placed: DataFrame, ranges: DataFrame, deleted_too: bool = False) -> DataFrame:
    """Blocks between two ids of their document, either way round.
    ranges(doc_id, a, b)."""
    at = placed.select("doc_id", F.col("block_id"), F.struct("page", "ord").alias("at"))
    ends = (
        ranges.join(at.withColumnsRenamed({"block_id": "a", "at": "at_a"}), ["doc_id", "a"])
        .join(at.withColumnsRenamed({"block_id": "b", "at": "at_b"}), ["doc_id", "b"])
        .select("doc_id", F.least("at_a", "at_b").alias("lo"), F.greatest("at_a", "at_b").alias("hi"))
    )
    place = F.struct("page", "ord")
    picked = placed.join(ends, "doc_id").where((place >= F.col("lo")) & (place <= F.col("hi")))
    if not deleted_too:
        picked = picked.where(~F.col("deleted"))
    return picked.select("doc_id", "page", "ord", "block_id")


def toggle(selected: DataFrame, toggled: DataFrame) -> DataFrame:
    """(doc_id, ids): the symmetric difference of two id arrays per document."""
    a, b = F.coalesce("a", F.array()), F.coalesce("b", F.array())
    both = selected.withColumnRenamed("ids", "a").join(toggled.withColumnRenamed("ids", "b"), "doc_id", "full_outer")
    a = F.coalesce("a", F.array().cast("array<string>"))
    b = F.coalesce("b", F.array().cast("array<string>"))
    ids = F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))
    return both.select("doc_id", ids.alias("ids")).where(F.size("ids") > 0)


def lasso(blocks: DataFrame, lassos: DataFrame) -> DataFrame:
    """Blocks a box touches, edges included. lassos(doc_id, page, lasso)."""
    return blocks.join(lassos, PAGE).where(G.touches(F.col("box"), F.col("lasso"))).select(
        "doc_id", "page", "ord", "block_id"
    )


def ids_by_page(selected: DataFrame) -> DataFrame:
    return selected.groupBy(*PAGE).agg(F.array_sort(F.collect_set("block_id")).alias("ids"))


def selection_summary(selected: DataFrame) -> DataFrame:
    """Per document: what hide and delete would do to the selection, and what
    every block of it already is. selected(doc_id, kind, role, level, bold,
    italic, quote, hidden, deleted)."""
    shown = ~F.col("deleted")
    n = F.count_if(shown)
    heading = F.bool_or(shown & (F.col("role") == "heading"))
    text_only = ~F.bool_or(shown & (F.col("kind") != "text"))

    def all_of(test):
        return F.bool_and(F.when(shown, test))

    looks = F.concat_ws(":", "role", F.col("level").cast("string"))
    same = F.when((F.min(F.when(shown, looks)) == F.max(F.when(shown, looks))), F.min(F.when(shown, looks)))
    bar = text_only & (n > 0)
    return selected.groupBy("doc_id").agg(
        F.when(n > 0, F.when(F.bool_or(shown & ~F.col("hidden")), "hide").otherwise("show")).alias("hide_action"),
        n.alias("hide_count"),
        F.when(F.bool_or(shown), "delete").otherwise("restore").alias("delete_action"),
        F.count("*").alias("delete_count"),
        F.when(bar, same).alias("look"),
        F.when(bar, all_of(F.col("quote"))).alias("quote_lit"),
        F.when(bar, all_of(F.col("bold")) & ~heading).alias("bold_lit"),
        F.when(bar, all_of(F.col("italic")) & ~heading).alias("italic_lit"),
    )


# ---- indent and outdent -----------------------------------------------------


def _moved(depth, before, chosen, by):
    """New depth of each item of one list run, None where it stays."""
    now, out = [], []
    for d, first, picked in zip(depth, before, chosen):
        ceiling = 0 if first or not now else now[-1] + 1
        new = d
        if picked:
            new = min(d + 1, ceiling) if by > 0 else max(0, d - 1)
        now.append(new)
        out.append(new if new != d else None)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _moved_udf(depth: pd.Series, first: pd.Series, chosen: pd.Series, by: pd.Series) -> pd.Series:
    return pd.Series([_moved(*row) for row in zip(depth, first, chosen, by)])


def nesting(items: DataFrame, by: int) -> DataFrame:
    """(doc_id, block_id, depth): the items one indent (1) or outdent (-1) moves.

    items(doc_id, page, line_from, block_id, depth, after, chosen). A list is
    inside one page, so a page is as far as one move can reach another.
    """
    one = F.struct("line_from", "block_id", "depth", F.col("after").isNull().alias("first"), "chosen")
    pages = items.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("rows"))

    def each(name):
        return F.transform("rows", lambda r: r[name])

    moved = pages.withColumn("new", _moved_udf(each("depth"), each("first"), each("chosen"), F.lit(by)))
    return (
        moved.select("doc_id", F.inline(F.arrays_zip("rows", "new")))
        .where("new is not null")
        .select("doc_id", "rows.block_id", F.col("new").alias("depth"))
    )
