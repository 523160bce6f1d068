"""Running headers, footers and page numbers: found by place, then by wording."""

from pyspark.sql import Column, DataFrame, functions as F

from quire import constants as K
from quire.functions import geometry as G, text as T
from quire.operators.structure import by_page

PAGE = ["doc_id", "page"]


def page_number_of(kind, marker, text, box, page_height) -> Column:
    """The label a block in a margin prints and nothing else, or NULL."""
    margin = (kind == "text") & G.in_margin(box, page_height)
    return F.when(margin, T.page_label(T.printed(marker, text)))


def seen(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Text blocks as furniture sees them: printed words, wording, place, label.

    Only what may lie in a margin of the lowest or the highest page takes its words along
    to where its own page's height is known; of the rest, a digest of 128 bits tells which
    wordings are alike. words, printed and key are those of blocks in a margin.
    """
    height = pages.select(*PAGE, F.col("height").alias("_h"))
    said, box = T.printed(F.col("marker"), F.col("text")), F.col("box")
    heights = pages.agg(F.min("height").alias("_least"), F.max("height").alias("_most"))
    # a point of slack, so that rounding decides nothing here
    may = (G.bottom(box) <= F.col("_most") * K.MARGIN_FRACTION + 1) | (box["y"] >= F.col("_least") * (1 - K.MARGIN_FRACTION) - 1)
    light = (
        blocks.where("kind = 'text'")
        .crossJoin(heights)
        .select(
            *PAGE,
            "ord",
            "block_id",
            F.struct(*[box[c].alias(c) for c in "yh"]).alias("box"),
            F.when(may, F.col("text")).alias("words"),
            F.when(may, said).alias("printed"),
            T.has_letter(said).alias("worded"),
            F.unhex(F.md5(T.wording(said))).alias("digest"),
        )
    )
    margin = G.in_margin(box, F.col("_h"))
    return light.join(height, PAGE).select(
        *PAGE,
        "ord",
        "block_id",
        F.when(margin, F.col("words")).alias("words"),
        F.when(margin, F.col("printed")).alias("printed"),
        F.when(margin, T.wording(F.col("printed"))).alias("key"),
        "digest",
        "worded",
        margin.alias("margin"),
        # bound, so that it is no part of a generated method too long to be compiled
        F.when(margin, T.bind(F.col("printed"), T.page_label)).alias("label"),
        (F.col("box.y") < F.col("_h") / 2).alias("top"),
    )


def _repeated_from(rows: DataFrame) -> DataFrame:
    candidate = F.col("margin") & F.col("label").isNull()
    per_page = (
        rows.where("worded")
        .groupBy("doc_id", "digest", "page")
        .agg(
            F.count_if(candidate).alias("n"),
            F.count_if(candidate & F.col("top")).alias("top"),
            F.min(F.when(candidate, F.struct("ord", F.trim("printed").alias("text"), "key"))).alias("first"),
        )
    )
    hit = F.col("n") > 0
    per_key = per_page.groupBy("doc_id", "digest").agg(
        F.count("*").alias("anywhere"),
        F.count_if(hit).alias("n_pages"),
        F.sum("n").alias("n_blocks"),
        F.sum("top").alias("n_top"),
        F.min(F.when(hit, F.struct("page", "first.ord", "first.text", "first.key"))).alias("first"),
    )
    return per_key.where(
        (F.col("n_pages") >= K.MIN_PAGES) & (F.col("n_pages") / F.col("anywhere") >= K.MARGIN_SHARE)
    ).select(
        "doc_id",
        "first.key",
        F.col("first.text").alias("text"),
        F.when(F.col("n_top") * 2 >= F.col("n_blocks"), "top").otherwise("bottom").alias("place"),
        "n_pages",
        "n_blocks",
        F.col("first.page").alias("first_page"),
        F.col("first.ord").alias("first_ord"),
    )


def repeated_lines(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per running header or footer. Its pages and blocks are rows of
    repeated_blocks, so a line on a million pages is never one array."""
    return _repeated_from(seen(blocks, pages))


def repeated_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, key, page, ord, block_id) of every repeated header or footer."""
    rows = seen(blocks, pages)
    keys = _repeated_from(rows).select("doc_id", "key")
    return (
        rows.where("worded and margin and label is null")
        .join(keys, ["doc_id", "key"])
        .select("doc_id", "key", "page", "ord", "block_id", "words")
    )


def page_number_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return (
        seen(blocks, pages)
        .where("label is not null")
        .select(*PAGE, "ord", "block_id", "label", "printed", "top")
    )


def page_numbers(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: how many page numbers, and the band most are in."""
    return (
        page_number_blocks(blocks, pages)
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n_labels"),
            F.count_distinct("page").alias("n_pages"),
            F.min_by("label", F.struct("page", "ord")).alias("first_label"),
            F.max_by("label", F.struct("page", "ord")).alias("last_label"),
            F.when(F.count_if("top") * 2 > F.count("*"), "top").otherwise("bottom").alias("place"),
        )
    )


def find_furniture(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, kind, count, sample, hidden_as): each kind and its first example."""
    numbers = page_number_blocks(blocks, pages).select(
        *PAGE,
        "ord",
        F.lit("page_numbers").alias("furniture"),
        T.ws_trim(F.col("printed")).alias("sample"),
        F.concat(F.lit("page "), "label").alias("hidden_as"),
    )
    heads = repeated_blocks(blocks, pages).select(
        *PAGE,
        "ord",
        F.lit("headers_footers").alias("furniture"),
        T.ws_trim(F.col("words")).alias("sample"),
        T.ws_trim(F.col("words")).alias("hidden_as"),
    )
    first = F.min(F.struct("page", "ord", "sample", "hidden_as"))
    return (
        numbers.unionByName(heads)
        .groupBy("doc_id", "furniture")
        .agg(F.count("*").alias("n"), first.alias("first"))
        .select(
            "doc_id", "furniture", "n", F.col("first.sample").alias("sample"), F.col("first.hidden_as").alias("hidden_as")
        )
    )


def count_furniture(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    found = find_furniture(blocks, pages)
    counted = found.groupBy("doc_id").pivot("furniture", ["page_numbers", "headers_footers"]).agg(F.first("n"))
    return counted.na.fill(0, ["page_numbers", "headers_footers"])


def apply_furniture(
    shaped: DataFrame,
    raw: DataFrame,
    pages: DataFrame,
    settings: DataFrame | None,
    line_settings: DataFrame | None,
) -> DataFrame:
    """shaped blocks with furniture settings laid under what was decided by hand.

    Adds `furniture` (which setting acted) and `label`. With no settings at all
    nothing is looked for.
    """
    if settings is None and line_settings is None:
        return shaped.withColumns(
            {"furniture": F.lit(None).cast("string"), "label": F.lit(None).cast("string")}
        )
    spark = shaped.sparkSession
    if settings is None:
        settings = spark.createDataFrame(
            [], f"doc_id {shaped.schema['doc_id'].dataType.simpleString()}, page_numbers string, headers_footers string"
        )
    per_page = by_page(settings.select("doc_id", "page_numbers", "headers_footers"), pages)
    rows = seen(raw, pages)
    keys = _repeated_from(rows).select("doc_id", "key", F.lit(True).alias("_repeats"))
    # Both kinds of furniture lie in margins: those few blocks are laid on the page's all at once.
    found = rows.where("margin and (label is not null or worded)").join(keys, ["doc_id", "key"], "left")
    if line_settings is not None:
        own = line_settings.select("doc_id", F.col("wording").alias("key"), "choice")
        found = found.join(own, ["doc_id", "key"], "left")
    else:
        found = found.withColumn("choice", F.lit(None).cast("string"))
    found = found.where("label is not null or _repeats").select(
        *PAGE,
        "block_id",
        F.when(F.col("label").isNull(), F.col("key")).alias("key"),
        F.when(F.col("label").isNull(), F.col("choice")).alias("choice"),
        F.col("label").alias("_label"),
    )
    by_hand = F.col("hidden") | F.col("deleted")
    numbers = F.coalesce("page_numbers", F.lit("keep"))
    label = F.when(~by_hand & (numbers != "keep"), F.col("_label"))
    line = F.when(
        ~by_hand & F.col("key").isNotNull(), F.coalesce("choice", "headers_footers", F.lit("keep"))
    )
    setting = F.when(F.col("label").isNotNull(), "page_numbers").when(
        F.coalesce(F.col("_line"), F.lit("keep")) != "keep", "headers_footers"
    )
    choice = F.when(F.col("furniture") == "page_numbers", numbers).when(
        F.col("furniture") == "headers_footers", F.col("_line")
    )
    return (
        shaped.join(per_page, PAGE, "left")
        .join(found, [*PAGE, "block_id"], "left")
        .withColumn("label", label)
        .withColumn("_line", line)
        .withColumn("furniture", setting)
        .withColumn("_choice", choice)
        .withColumn("deleted", F.col("deleted") | F.coalesce(F.col("_choice") == "delete", F.lit(False)))
        .withColumn("hidden", F.col("hidden") | F.coalesce(F.col("_choice") == "hide", F.lit(False)))
        .drop("page_numbers", "headers_footers", "key", "choice", "_label", "_line", "_choice")
    )
