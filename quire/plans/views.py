"""The supplied tables seen as layout: what the registered queries run on.

Every view is a plain derivation, so it grows with the tables. A document's
text is set as pages of printed lines: twelve words a line, thirty lines a
page, one document in four in two columns, with a running header and a page
number. Some paragraphs are dressed as headings, list items or broken words,
by a rule on the document and paragraph number, because the supplied prose has
none of its own.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import geometry as G
from quire.functions.text import bind
from quire.session import settle, stored, widen

LINES_PER_PAGE = 30
PAGE_W, PAGE_H = 612.0, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paragraphs(text: str) -> Column:
    """A text's paragraphs that aren't blank, their words one blank apart."""
    paras = F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(paras, lambda p: F.when(F.contains(p, F.lit("  ")), F.regexp_replace(p, " +", " ")).otherwise(p))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, i, para, k, raw, wraps): text wrapped at twelve words."""

    def wrap(p, n):
        lines = F.regexp_extract_all(p, F.lit("[^ ]++(?: [^ ]++){0,11}"), F.lit(0))
        return bind(
            lines,
            lambda ls: F.transform(
                ls, lambda raw, k: F.struct(n.alias("para"), k.alias("k"), raw.alias("raw"), (F.size(ls) > 1).alias("wraps"))
            ),
        )

    return (
        widen(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
        .select("doc_id", "source", F.posexplode(F.flatten(F.transform(_paragraphs("text"), wrap))).alias("i", "l"))
        .select("doc_id", "source", "i", "l.para", "l.k", "l.raw", "l.wraps")
    )


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, source): pages by the count of each document's lines, without the
    lines. The counts, a light row for each document, are written once for a folder."""
    words = lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + 1
    n = F.aggregate(_paragraphs("text"), F.lit(0), lambda n, p: n + F.ceil(words(p) / 12).cast("int"))

    def count():
        docs = widen(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
        counted = docs.select("doc_id", "source", F.ceil(n / LINES_PER_PAGE).cast("int").alias("n"))
        # asked of the totals: asked of a text, its lines would be counted twice
        has = F.when(F.col("n") > 0, F.col("source"))
        each = counted.groupBy("doc_id").agg(F.max("n").alias("n"), F.min(has).alias("source")).where("n > 0")
        return settle(each, "doc-pages")

    each = stored(spark, sf_dir, "doc-pages", count)
    return each.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("page"), "source")


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lines with boxes: the lines table (doc_id, page, line_no, ...)."""
    n = LINES_PER_PAGE
    d = doc_lines(spark, sf_dir)
    m = F.pmod(F.col("doc_id") * 5 + F.col("para") * 7, F.lit(20))
    first = F.col("k") == 0
    roman = F.element_at(
        F.array(*[F.lit(r) for r in ("i", "ii", "iii", "iv", "v", "vi", "ix", "x")]),
        (F.col("para") % 8 + 1).cast("int"),
    )
    d = d.withColumn("m", m).withColumns(
        {
            "page": (F.floor(F.col("i") / n) + 1).cast("int"),
            "slot": (F.col("i") % n).cast("int"),
            "two": F.col("doc_id") % 4 == 0,
            "listed": F.col("m").between(3, 9),
            "mark": F.when(
                first,
                F.when(F.col("m").between(3, 5), F.concat((F.col("para") % 9 + 1).cast("string"), F.lit(". ")))
                .when(F.col("m").between(6, 7), F.lit("• "))
                .when(F.col("m") == 8, F.concat(F.lit("("), F.char(97 + F.col("para") % 26), F.lit(") ")))
                .when(F.col("m") == 9, F.concat(roman, F.lit(". ")))
                .when(F.lit(False), F.lit("")),
            ),
        }
    )
    broken = (F.col("m") == 11) & F.col("wraps")
    text = F.concat(
        F.coalesce("mark", F.lit("")),
        F.when(broken & (F.col("k") == 1), F.lit("ple ")).otherwise(F.lit("")),
        F.col("raw"),
        F.when(broken & first, F.lit(" exam-"))
        .when((F.col("m") == 12) & first & (F.col("doc_id") % 3 == 0), F.lit(" exam-ple"))
        .otherwise(F.lit("")),
    )
    size = F.when(F.col("i") == 0, 16.0).when((F.col("m") == 0) & first, 13.0).otherwise(10.0)
    right = F.col("two") & (F.col("slot") >= n // 2)
    x = (
        F.when(right, 336).otherwise(72)
        + F.when(F.col("listed"), F.col("para") % 3 * 18).otherwise(0)
        + F.when(F.col("listed") & ~first, 14).otherwise(0)
    )
    y = 100 + 18 * F.when(F.col("two"), F.col("slot") % (n // 2)).otherwise(F.col("slot")) + F.when(
        first, 4
    ).otherwise(0)
    body = d.select(
        "doc_id",
        "page",
        (F.col("slot") + 1).alias("line_no"),
        text.alias("text"),
        size.alias("size"),
        x.cast("double").alias("x"),
        y.cast("double").alias("y"),
        F.col("two"),
        (F.col("m") == 10).alias("bold"),
        (F.col("m") == 14).alias("italic"),
    )
    body = body.withColumn(
        "w", F.greatest(F.length("text") * F.when(F.col("two"), 0.5).otherwise(1.0), F.lit(120.0))
    )
    edges = doc_pages(spark, sf_dir).select(
        "doc_id",
        "page",
        F.explode(
            F.array(
                F.struct(
                    F.lit(0).alias("line_no"),
                    F.concat(F.lit("Notes of "), "source", F.lit(" part "), F.col("page").cast("string")).alias("text"),
                    F.lit(30.0).alias("y"),
                ),
                F.struct(
                    F.lit(n + 1).alias("line_no"),
                    F.concat(F.lit("Page "), F.col("page").cast("string")).alias("text"),
                    F.lit(760.0).alias("y"),
                ),
            )
        ).alias("e"),
    ).select(
        "doc_id",
        "page",
        "e.line_no",
        "e.text",
        F.lit(10.0).alias("size"),
        F.lit(72.0).alias("x"),
        "e.y",
        (F.col("doc_id") % 4 == 0).alias("two"),
        F.lit(False).alias("bold"),
        F.lit(False).alias("italic"),
        F.lit(200.0).alias("w"),
    )
    return body.unionByName(edges).select(
        "doc_id",
        "page",
        "line_no",
        "text",
        G.box(F.col("x"), F.col("y"), F.col("w"), F.col("size")).alias("box"),
        "size",
        "bold",
        "italic",
        F.when(F.col("bold"), F.lit("Body-Bold")).otherwise(F.lit("Body")).alias("font"),
    )


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = doc_pages(spark, sf_dir)
    return pages.select("doc_id", "page", F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"))


def layout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each printed line as one run per word, spaces told by the pieces."""
    lines = layout_lines(spark, sf_dir)
    words = F.split("line", " ")
    unit = F.when(F.col("doc_id") % 4 == 0, F.lit(0.5)).otherwise(F.lit(1.0))
    # a word starts after all that stands before its space
    at = F.when(F.col("k") > 0, F.length(F.call_function("substring_index", "line", F.lit(" "), "k")) + 1).otherwise(0)
    return (
        lines.withColumnRenamed("text", "line")
        .withColumn("words", words)
        .withColumn("unit", unit)
        .select("*", F.posexplode("words").alias("k", "word"))
        .where("word != ''")
        .select(
            "doc_id",
            "page",
            (F.col("line_no") * 1000 + F.col("k")).alias("run_no"),
            F.col("word").alias("text"),
            (F.col("k") > 0).alias("lead"),
            (F.col("k") < F.size("words") - 1).alias("trail"),
            G.box(
                F.col("box.x") + F.col("unit") * at,
                F.col("box.y"),
                F.col("unit") * F.length("word"),
                F.col("box.h"),
            ).alias("box"),
            G.bottom(F.col("box")).alias("base"),
            "size",
            "bold",
            "italic",
            "font",
        )
    )


def damaged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each printed line as one run; on one page in eleven one lacks its base or its width."""
    hurt = ((F.col("doc_id") + F.col("page")) % 11 == 3) & (F.col("line_no") == 0)
    no_base, no_width = hurt & (F.col("doc_id") % 2 == 0), hurt & (F.col("doc_id") % 2 == 1)
    width = F.when(no_width, F.lit(float("nan"))).otherwise(F.col("box.w"))
    return layout_lines(spark, sf_dir).select(
        "doc_id", "page", F.col("line_no").alias("run_no"), "text", F.lit(False).alias("lead"), F.lit(False).alias("trail"),
        F.col("box").withField("w", width).alias("box"), F.when(~no_base, G.bottom(F.col("box"))).alias("base"), "size", "bold", "italic", "font",
    )


def page_seconds() -> Column:
    """A time budget that one page in thirteen can't keep."""
    return F.when((F.col("doc_id") + F.col("page")) % 13 == 5, 0.0).otherwise(120.0)


def gutter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lines as two runs with a wide gap between: in one document of three the
    gaps lie under one another, as a gutter does; in one they wander, as spaces do; in
    one they do now this, now that. Some lines are short, some larger than the rest. A
    half of a line is prose: also one that reads like a list marker is none."""
    n = LINES_PER_PAGE
    d = doc_lines(spark, sf_dir).select("doc_id", "i", F.split("raw", " ").alias("words"))
    slot, kind = (F.col("i") % n).cast("int"), F.col("doc_id") % 3
    wanders = (kind == 1) | ((kind == 2) & (F.floor(F.col("i") / 7) % 2 == 1))
    size = F.when((kind == 2) & (F.col("i") % 9 == 4), 14.0).otherwise(10.0)
    width = F.when(wanders, 90 + F.col("i") * 37 % 160).otherwise(160)
    gap = size * (0.8 + F.col("i") % 4 * 0.5)
    half = F.ceil(F.size("words") / 2).cast("int")
    one = lambda k, x, w, text: F.struct(F.lit(k).alias("k"), x.cast("double").alias("x"), w.cast("double").alias("w"), text.alias("text"))
    left = one(0, F.lit(72), width, F.array_join(F.slice("words", 1, half), " "))
    right = one(1, 72 + width + gap, F.lit(200) - F.col("i") % 5 * 40, F.array_join(F.slice("words", half + 1, F.size("words")), " "))
    both = F.when((F.size("words") < 2) | (F.col("i") % 8 == 7), F.array(left)).otherwise(F.array(left, right))
    y = 60 + 12 * slot
    return d.select("doc_id", "i", slot.alias("slot"), size.alias("size"), y.cast("double").alias("y"), F.explode(both).alias("r")).select(
        "doc_id", (F.floor(F.col("i") / n) + 1).cast("int").alias("page"), (F.col("slot") * 2 + F.col("r.k")).alias("run_no"),
        "r.text", F.lit(True).alias("lead"), F.lit(False).alias("trail"), G.box(F.col("r.x"), F.col("y"), F.col("r.w"), F.col("size") * 0.8).alias("box"),
        (F.col("y") + F.col("size") * 0.8).alias("base"), "size", F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("Body").alias("font"),
        F.lit(False).alias("marker"),
    )


def layout_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pictures: one in five pages has a figure, one in seven a speck."""
    pages = layout_pages(spark, sf_dir)
    seed = F.col("doc_id") + F.col("page")
    made = F.array_compact(
        F.array(
            F.when(
                seed % 5 == 0,
                F.struct(
                    F.lit(0).alias("pic_no"),
                    G.box(F.lit(400.0), (200 + seed % 11 * 30), F.lit(300.0), F.lit(60.0)).alias("box"),
                    F.lit(200).alias("px_w"),
                    F.lit(100).alias("px_h"),
                ),
            ),
            F.when(
                seed % 7 == 0,
                F.struct(
                    F.lit(1).alias("pic_no"),
                    G.box(F.lit(80.0), F.lit(300.0), F.lit(20.0), (2 + seed % 3 * 11)).alias("box"),
                    F.lit(8).alias("px_w"),
                    F.lit(8).alias("px_h"),
                ),
            ),
            F.when(
                seed % 3 == 0,
                F.struct(
                    F.lit(2).alias("pic_no"),
                    G.box(F.lit(90.0), F.lit(500.0), F.lit(30.0), F.lit(30.0)).alias("box"),
                    F.lit(8).alias("px_w"),
                    F.lit(8).alias("px_h"),
                ),
            ),
        )
    )
    return pages.select(
        "doc_id", "page", F.col("width").alias("page_w"), F.col("height").alias("page_h"), F.explode(made).alias("p")
    ).select("doc_id", "page", "page_w", "page_h", "p.*")


def kept_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions import runs as R, text as T

    kept = R.keep_pictures(layout_pictures(spark, sf_dir))
    return kept.withColumn("path", T.figure_name(F.col("page"), F.col("pic_no")))


def layout_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two links a page: one wide over a slot, one thin across two lines."""
    pages = layout_pages(spark, sf_dir)
    slot = (F.col("doc_id") + F.col("page")) % 13
    made = F.array(
        F.struct(
            F.lit(0).alias("link_no"),
            G.box(F.lit(70.0), 98 + slot * 18, F.lit(400.0), F.lit(16.0)).alias("box"),
            F.concat(
                F.lit("https://example.com/d "), F.col("doc_id").cast("string"), F.lit("?p=("),
                F.col("page").cast("string"), F.lit(")"),
            ).alias("url"),
        ),
        F.struct(
            F.lit(1).alias("link_no"),
            G.box(F.lit(70.0), 100 + slot * 18, F.lit(100.0), F.lit(40.0)).alias("box"),
            F.concat(F.lit("https://example.com/e/"), F.col("page").cast("string")).alias("url"),
        ),
    )
    return pages.select("doc_id", "page", F.inline(made))


def event_block() -> Column:
    """The block an event is about: the first three pages have twenty each."""
    return F.format_string("p%db%d", F.floor(F.col("event_id") / 20) % 3 + 1, F.col("event_id") % 20)


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as edits: (doc_id, seq, action, block_id)."""
    action = (
        F.when(F.col("event_type") == "click", "hide")
        .when(F.col("event_type") == "view", "show")
        .when(F.col("event_type") == "signup", "delete")
        .when(F.col("event_type") == "purchase", "restore")
        .otherwise("undo")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
        event_block().alias("block_id"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as standing decisions, the last one of each block: field by field."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        event_block().alias("block_id"),
        "event_id",
        "event_type",
    )
    last = e.groupBy("doc_id", "block_id").agg(
        F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("t")
    )

    def on(t, value, kind):
        return F.when(F.col("t") == t, F.lit(value)).cast(kind)

    return last.select(
        "doc_id",
        "block_id",
        on("view", "heading", "string").alias("role"),
        on("view", 2, "int").alias("level"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("boolean").alias("bold"),
        F.lit(None).cast("boolean").alias("italic"),
        on("error", True, "boolean").alias("quote"),
        on("click", True, "boolean").alias("hidden"),
        on("signup", True, "boolean").alias("deleted"),
        F.when(F.col("t") == "purchase", F.concat(F.lit("Corrected words "), F.col("event_id").cast("string"))).alias(
            "text"
        ),
    )


def doc_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document does with its furniture, by its id."""

    def pick(k):
        return F.element_at(F.array(F.lit("keep"), F.lit("hide"), F.lit("delete")), (k % 3 + 1).cast("int"))

    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select(
        "doc_id", pick(F.col("doc_id")).alias("page_numbers"), pick(F.floor(F.col("doc_id") / 3)).alias("headers_footers")
    )


def line_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document in five chooses for its running header by itself."""
    return (
        table(spark, sf_dir, "documents")
        .where("doc_id % 5 = 0")
        .select(
            "doc_id",
            F.concat(
                F.lit("notes of "), F.regexp_replace(F.lower("source"), r"\d+", "#"), F.lit(" part #")
            ).alias("wording"),
            F.lit("hide").alias("choice"),
        )
    )


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each printed line as one run."""
    return layout_lines(spark, sf_dir).select(
        "doc_id", "page", F.col("line_no").alias("run_no"), "text", F.lit(False).alias("lead"), F.lit(False).alias("trail"),
        "box", G.bottom(F.col("box")).alias("base"), "size", "bold", "italic", "font",
    )


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text each page prints: its runs, one for each printed line, before any grouping."""
    from quire.operators.lines import text_layer

    return text_layer(line_runs(spark, sf_dir))
