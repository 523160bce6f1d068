"""Blocks and decisions to numbered markdown lines that trace back to blocks.

A page's lines depend only on its own blocks: one Arrow function per batch of
pages goes over their flags and small integers. Where a page starts in its
document is a running total over pages. All that is decided, laid over and counted
is so on light rows without words; the words meet them once, when lines are made.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import ArrayType

from quire import constants as K
from quire.functions import text as T
from quire.operators import furniture, paged
from quire.operators.decisions import overlay_decisions
from quire.operators.ordered import running_before
from quire.session import settle

PAGE = ["doc_id", "page"]


# ---- list markers -----------------------------------------------------------


def _write_page(hidden, quote, listed, bullet, depth, printed):
    """What a block's line is told from, block by block: whether it is an item, the list
    around it, its marker, and the blank lines about it (the fields of _WRITTEN).

    A block starts over, with a list of its own, if it is in the open and no item, or the
    first item of a list parted by a quote.
    """
    levels: list[list] = [[0, None]]  # per open depth: its column, its counted list
    was_list = prev_quote = prev_open = False
    after, hang, upto = None, 0, 0
    for i, (hid, quoted, in_role, plain, asked, value) in enumerate(zip(hidden, quote, listed, bullet, depth, printed)):
        is_item = in_role and not hid
        parted = is_item and was_list and quoted != prev_quote
        in_list = was_list and not parted
        ends_open = is_item or (hid and was_list)
        if parted or not (hid or is_item):
            levels, after = [[0, None]], None
        marker = column = d = before = None
        hung = hang
        if is_item:
            d = min(max(0, asked), len(levels) - 1)
            column, counted = levels[d]
            del levels[d:]
            if plain:
                marker, counted = "-", None
            else:
                last, mark = counted or (0, ".")
                number = last + 1 if value != value else int(value)
                if counted and number != last + 1:
                    mark = ")" if mark == "." else "."
                marker, counted = f"{number}{mark}", (number, mark)
            hang = column + len(marker) + 1
            levels += [[column, counted], [hang, None]]
            before, after = after, i
        blank_before = int(prev_open and not (was_list if hid else ends_open and in_list))
        blank_after = int(not ends_open)
        quoted_after = quoted and i + 1 < len(quote) and quote[i + 1]
        yield (
            is_item, was_list, ends_open, marker, column, d, before, hung, blank_before, blank_after,
            quoted and prev_quote, quoted_after, i + 1, upto + blank_before + 1,
        )
        upto += blank_before + 1 + blank_after
        prev_quote, prev_open = quoted, ends_open
        if not hid:
            was_list = is_item


_WRITTEN = {
    "is_item": pa.bool_(), "was_list": pa.bool_(), "ends_open": pa.bool_(), "marker": pa.string(), "indent": pa.int32(),
    "depth": pa.int32(), "after": pa.int32(), "hang": pa.int32(), "blank_before": pa.int32(), "blank_after": pa.int32(),
    "quoted_before": pa.bool_(), "quoted_after": pa.bool_(), "n": pa.int32(), "at": pa.int64(),
}


@F.arrow_udf(ArrayType(from_arrow_schema(pa.schema(list(_WRITTEN.items())))))
def _write_udf(
    hidden: pa.Array, quote: pa.Array, listed: pa.Array, bullet: pa.Array, depth: pa.Array, printed: pa.Array
) -> pa.Array:
    made = [
        m
        for page in paged.pages(hidden, quote, listed, bullet, depth, printed)
        for m in _write_page(*[v.tolist() for v in page])
    ]
    fields = zip(*made) if made else [()] * len(_WRITTEN)
    return paged.pack(hidden, **{k: pa.array(f, type=t) for (k, t), f in zip(_WRITTEN.items(), fields)})


# A written block's own columns, and those of them that not all blocks have.
_CARRIED = ("ord", "block_id", "kind", "role", "level", "quote", "hidden", "corrected", "furniture", "label")
_IF_GIVEN = ("words", "fixed", "figure", "bold", "italic")


def list_markers(blocks: DataFrame) -> DataFrame:
    """Shaped blocks, deleted ones left out, with what their lines are told from: is_item,
    was_list, ends_open, item(marker, indent, depth), the block the item comes after, hang
    (the column text under a list hangs at), the blank lines around, n and at.

    A page's blocks are gathered once and one function goes over their flags; their words,
    where they have them, stay in the JVM and nothing is shuffled after it.
    """
    carried = [*_CARRIED, *[c for c in _IF_GIVEN if c in blocks.columns]]
    value = T.printed_value(F.col("role"), F.col("marker")).cast("double")
    row = F.struct(
        *carried, F.col("role").isin(*K.LIST_ROLES).alias("listed"), F.col("depth").alias("asked"), value.alias("value")
    )
    packed = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def each(get):
        return F.transform("rows", get)

    told = packed.withColumn(
        "told",
        _write_udf(
            each(lambda b: b["hidden"]),
            each(lambda b: b["quote"]),
            each(lambda b: b["listed"]),
            each(lambda b: b["role"] == "bullet"),
            each(lambda b: b["asked"]),
            each(lambda b: b["value"]),
        ),
    )
    ids = F.transform("told", lambda t: F.get("rows", t["after"])["block_id"])
    made = told.withColumn("ids", ids).select(*PAGE, F.inline(F.arrays_zip("rows", "told", "ids")))
    plain = [f"told.{k}" for k in _WRITTEN if k not in ("marker", "indent", "depth", "after")]
    item = F.struct(*[f"told.{k}" for k in ("marker", "indent", "depth")]).alias("item")
    return made.select(*PAGE, *[f"rows.{c}" for c in (*carried, "value")], *plain, item, F.col("ids").alias("after"))


# ---- lines ------------------------------------------------------------------


def _image(assets: Column) -> Column:
    return T.figure_md(F.col("page"), F.col("picture"), assets, F.col("pic_path"))


BLOCK = [*PAGE, "ord", "block_id"]


def texts_of(blocks: DataFrame) -> DataFrame:
    """What blocks say: all that is wide of them."""
    return blocks.select(*BLOCK, "text", "href")


def _words() -> Column:
    text = F.coalesce("fixed", "text")
    said = T.inline_md(F.col("role"), text, F.col("href"), F.col("bold"), F.col("italic"))
    return F.when(F.col("kind") == "image", F.col("figure")).otherwise(said)


def shape(
    blocks: DataFrame,
    pages: DataFrame,
    decisions: DataFrame | None = None,
    settings: DataFrame | None = None,
    line_settings: DataFrame | None = None,
    pictures: DataFrame | None = None,
    assets: Column | None = None,
) -> DataFrame:
    """Every block that has words, overlaid with decisions and settings: a light row, with
    the words of a picture (figure) or of a correction (fixed), no others."""
    # A text has words when something is left of it trimmed: asked before they are made.
    has = T.ws_trim(F.col("text")) != ""
    own = ("kind", "role", "level", "depth", "bold", "italic", "marker", "picture")
    light = blocks.select(*BLOCK, *own, has.alias("_has"), F.lit(None).cast("string").alias("text"))
    shaped = overlay_decisions(light, decisions)
    if pictures is None:
        shaped = shaped.withColumn("pic_path", F.lit(None).cast("string"))
    else:
        kept = pictures.select(*PAGE, F.col("pic_no").alias("picture"), F.col("path").alias("pic_path"))
        shaped = shaped.join(kept, [*PAGE, "picture"], "left")
    assets = F.concat(F.col("doc_id").cast("string"), F.lit(".assets/")) if assets is None else assets
    shaped = shaped.withColumn("figure", F.when(F.col("kind") == "image", _image(assets)))
    said = F.when(F.col("kind") == "image", F.col("figure") != "").when(F.col("corrected"), T.ws_trim(F.col("text")) != "").otherwise(F.col("_has"))
    shaped = shaped.where(said).withColumnRenamed("text", "fixed").drop("_has", "picture", "pic_path")
    return furniture.apply_furniture(shaped, blocks, pages, settings, line_settings)


def _hidden_says() -> Column:
    number = F.coalesce(F.col("value"), F.lit(1)).cast("int").cast("string")
    return (
        F.when(F.col("label").isNotNull(), F.concat(F.lit("page "), F.col("label")))
        .when(F.col("kind") == "image", F.col("words"))
        .when(F.col("role") == "heading", T.heading_md(F.col("level"), F.col("words")))
        .when(F.col("role") == "bullet", F.concat(F.lit("- "), F.col("words")))
        .when(F.col("role").isin(*K.LIST_ROLES), F.concat(number, F.lit(". "), F.col("words")))
        .otherwise(F.col("words"))
    )


def written(shaped: DataFrame) -> DataFrame:
    """Blocks that become lines: n on the page, the line's text, the blank lines
    around it, and `at`, its line counted inside the page."""
    return list_markers(shaped.where("not deleted")).withColumn("line", _line()).drop("words", "value")


def _line() -> Column:
    """The line of a block with its words and list markers."""
    quote = F.when(F.col("quote"), F.lit("> ")).otherwise(F.lit(""))
    text = (
        F.when(
            F.col("hidden"),
            F.concat(
                F.when(F.col("was_list"), F.repeat(F.lit(" "), F.col("hang"))).otherwise(F.lit("")),
                T.comment_md(_hidden_says()),
            ),
        )
        .when(F.col("kind") == "image", F.col("words"))
        .when(F.col("role") == "heading", T.heading_md(F.col("level"), F.col("words")))
        .when(
            F.col("is_item"),
            F.concat(
                F.repeat(F.lit(" "), F.col("item.indent")), F.col("item.marker"), F.lit(" "), F.col("words")
            ),
        )
        .otherwise(F.col("words"))
    )
    return F.concat(quote, text)


def page_offsets(blocks_written: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: content lines, the rule before it, the blank after it, and how
    many lines of its document come before."""
    content = blocks_written.groupBy(*PAGE).agg(
        F.max(F.col("at") + F.col("blank_after")).alias("content"),
        F.max_by("ends_open", "ord").alias("open"),
    )
    df = (
        pages.select(*PAGE)
        .join(content, PAGE, "left")
        .withColumn("content", F.coalesce("content", F.lit(0)))
        .withColumn("open", F.coalesce("open", F.lit(False)))
    )
    ends = df.groupBy("doc_id").agg(
        F.min("page").alias("first_page"),
        F.max("page").alias("last_page"),
        F.min(F.when(F.col("content") > 0, F.col("page"))).alias("first_written"),
    )
    df = (
        df.join(ends, "doc_id")
        .withColumn(
            "rule",
            F.when(
                (F.col("page") > F.col("first_page"))
                & F.coalesce(F.col("first_written") < F.col("page"), F.lit(False)),
                2,
            ).otherwise(0),
        )
        .withColumn("tail", F.when(F.col("open") & (F.col("page") < F.col("last_page")), 1).otherwise(0))
    )
    return running_before(df, ["doc_id"], "page", F.col("rule") + F.col("content") + F.col("tail"), "offset")


def told_lines(blocks_written: DataFrame, pages: DataFrame, texts: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, text, block_id, page, hidden, corrected, also): the markdown, line
    by line, and what was done to the block of each. Written blocks are told their place
    before they meet their texts, the one side that is wide. The texts of blocks in
    ``also`` come with them, as they are, without a line_no."""
    at_page = page_offsets(blocks_written, pages)
    none = F.lit(None).cast("string")

    def line(no, text, block, when):
        return F.when(
            when, F.struct(no.cast("long").alias("line_no"), text.alias("text"), block.alias("block_id"))
        )

    at = F.col("offset") + F.col("rule") + F.col("at")
    last = (F.col("page") == F.col("last_page")) & (F.col("at") + F.col("blank_after") == F.col("content"))

    def gap(flag):
        return F.when(F.col(flag), F.lit(">")).otherwise(F.lit(""))

    asked = blocks_written.join(at_page, PAGE).withColumn("also", F.lit(False))
    if also is not None:
        asked = asked.unionByName(also.select(*BLOCK, F.lit(True).alias("also")), allowMissingColumns=True)
    lined = asked.join(texts, BLOCK).withColumn("words", _words()).withColumn("line", _line())
    body = lined.select(
        *PAGE,
        "hidden",
        "corrected",
        "also",
        F.explode(
            F.array_compact(
                F.array(
                    line(none, F.col("text"), F.col("block_id"), F.col("also")),
                    line(at - 1, gap("quoted_before"), none, F.col("blank_before") == 1),
                    line(at, F.col("line"), F.col("block_id"), ~F.col("also")),
                    line(at + 1, gap("quoted_after"), none, (F.col("blank_after") == 1) & ~last),
                )
            )
        ).alias("l"),
    )
    end = F.col("offset") + F.col("rule") + F.col("content") + 1
    bare_last = (F.col("page") == F.col("last_page")) & (F.col("content") == 0)
    rules = at_page.select(
        *PAGE,
        F.lit(False).alias("hidden"),
        F.lit(False).alias("corrected"),
        F.lit(False).alias("also"),
        F.explode(
            F.array_compact(
                F.array(
                    line(F.col("offset") + 1, F.lit("---"), none, F.col("rule") == 2),
                    line(F.col("offset") + 2, F.lit(""), none, (F.col("rule") == 2) & ~bare_last),
                    line(end, F.lit(""), none, F.col("tail") == 1),
                )
            )
        ).alias("l"),
    )
    return body.unionByName(rules).select("doc_id", "l.line_no", "l.text", "l.block_id", "page", "hidden", "corrected", "also")


def placed(shaped: DataFrame, blocks_written: DataFrame, pages: DataFrame) -> DataFrame:
    """Every block placed, deleted ones with n and line 0, in document order by (page, ord)."""
    at_page = page_offsets(blocks_written, pages).select(*PAGE, "offset", "rule")
    line = F.col("offset") + F.col("rule") + F.col("at")
    shown = blocks_written.join(at_page, PAGE).select(
        *PAGE,
        "ord",
        "block_id",
        "n",
        line.alias("line_from"),
        line.alias("line_to"),
        "hidden",
        F.lit(False).alias("deleted"),
        "furniture",
        F.when(F.col("is_item"), F.struct(F.col("item.depth").alias("depth"), "after")).alias("item"),
    )
    gone = shaped.where("deleted").select(
        *PAGE,
        "ord",
        "block_id",
        F.lit(0).alias("n"),
        F.lit(0).cast("long").alias("line_from"),
        F.lit(0).cast("long").alias("line_to"),
        F.lit(False).alias("hidden"),
        F.lit(True).alias("deleted"),
        "furniture",
        F.lit(None).cast("struct<depth:int,after:string>").alias("item"),
    )
    return shown.unionByName(gone)


def md_pages(lines: DataFrame) -> DataFrame:
    """One page's markdown and where it starts, counted from 0. The lines of a
    page are next to one another, so a page is a group."""
    return lines.groupBy(*PAGE).agg(
        (F.min("line_no") - 1).alias("line_from"),
        F.count("*").alias("n_lines"),
        F.concat(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY line_no)"), F.lit("\n")).alias("text"),
    )


def changed_pages(now: DataFrame, before: DataFrame) -> DataFrame:
    """(doc_id, page): pages whose text or whose lineage of blocks differs."""

    def digest(lines):
        row = F.struct("line_no", "text", F.coalesce("block_id", F.lit("")).alias("b"))
        ordered = F.array_sort(F.collect_list(row))
        return lines.groupBy(*PAGE).agg(
            F.sha2(
                F.to_json(F.transform(ordered, lambda r: F.struct(r["text"].alias("t"), r["b"].alias("b")))), 256
            ).alias("digest")
        )

    a, b = digest(now).alias("a"), digest(before).alias("b")
    return a.join(b, PAGE, "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(*PAGE)


class Markdown:
    """What emit gives: shaped and written blocks, light rows without their texts, and
    tables made from them."""

    def __init__(self, shaped: DataFrame, blocks: DataFrame, pages: DataFrame):
        self.shaped, self.blocks, self.pages = shaped, blocks, pages
        # Used by every table below, so computed once.
        self.written = settle(list_markers(shaped.where("not deleted")), "written")

    def told(self, also: DataFrame | None = None) -> DataFrame:
        return told_lines(self.written, self.pages, texts_of(self.blocks), also)

    @property
    def lines(self) -> DataFrame:
        """(doc_id, line_no, text, block_id, page): the markdown, line by line."""
        return self.told().drop("hidden", "corrected", "also")

    @property
    def placed(self) -> DataFrame:
        return placed(self.shaped, self.written, self.pages)


def emit(blocks: DataFrame, pages: DataFrame, **given) -> Markdown:
    """blocks to markdown. `given`: decisions, settings, line_settings, pictures, assets."""
    return Markdown(shape(blocks, pages, **given), blocks, pages)
