"""Human decisions over blocks: laid over, grouped, cut, inserted, chosen."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire import constants as K
from quire.functions import text as T

PAGE = ["doc_id", "page"]

FIELDS = ("text", "role", "level", "depth", "bold", "italic")
FLAGS = ("quote", "hidden", "deleted")
DECISIONS = (
    "doc_id long, block_id string, role string, level int, depth int, bold boolean, italic boolean, "
    "quote boolean, hidden boolean, deleted boolean, break_before string, break_after string, text string"
)


def overlay_decisions(blocks: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Field by field: what was decided, else what the reader read."""
    if decisions is None:
        return blocks.withColumns(
            {**{f: F.lit(False) for f in FLAGS}, "corrected": F.lit(False)}
        )
    have = set(decisions.columns)
    picked = decisions.select(
        "doc_id",
        "block_id",
        *[F.col(f).alias(f"_{f}") for f in (*FIELDS, *FLAGS) if f in have],
    )
    out = blocks.join(picked, ["doc_id", "block_id"], "left")
    over = {f: F.coalesce(f"_{f}", f) for f in FIELDS if f in have}
    flags = {f: F.coalesce(f"_{f}", F.lit(False)) if f in have else F.lit(False) for f in FLAGS}
    corrected = F.col("_text").isNotNull() if "text" in have else F.lit(False)
    return out.withColumns({**over, **flags, "corrected": corrected}).drop(
        *[f"_{f}" for f in (*FIELDS, *FLAGS)]
    )


# ---- joins, cuts, inserts ---------------------------------------------------


def rehead(joins: DataFrame, groups: DataFrame) -> DataFrame:
    """joins(doc_id, child, head) after more blocks are joined: `groups` holds
    (doc_id, head, member). Members and what they headed go to the new head,
    which is its own head's if it has one: always one hop."""
    own = joins.select("doc_id", F.col("child").alias("_id"), F.col("head").alias("_head"))
    to_head = (
        groups.join(own, (groups.doc_id == own.doc_id) & (groups["head"] == own["_id"]), "left")
        .select(groups.doc_id, F.coalesce("_head", groups["head"]).alias("head"), "member")
    )
    to_head = to_head.alias("g").join(
        own.alias("o"), (F.col("g.doc_id") == F.col("o.doc_id")) & (F.col("g.member") == F.col("o._id")), "left"
    ).select("g.doc_id", F.col("g.head").alias("new_head"), F.coalesce("o._head", "g.member").alias("absorbed"))
    absorbed = to_head.where("absorbed != new_head").dropDuplicates(["doc_id", "absorbed"])
    moved = joins.alias("j").join(
        absorbed.alias("a"),
        (F.col("j.doc_id") == F.col("a.doc_id")) & (F.col("j.head") == F.col("a.absorbed")),
        "left",
    ).select("j.doc_id", "j.child", F.coalesce("a.new_head", "j.head").alias("head"))
    fresh = absorbed.select("doc_id", F.col("absorbed").alias("child"), F.col("new_head").alias("head"))
    kept = moved.join(fresh.select("doc_id", "child"), ["doc_id", "child"], "left_anti")
    return kept.unionByName(fresh).where("child != head")


def merge_groups(blocks: DataFrame, joins: DataFrame) -> DataFrame:
    """(doc_id, head, text, n_members): children's words folded onto their head
    in block order. A group is what a person joined by hand."""
    hop = joins.select("doc_id", F.col("child").alias("block_id"), "head")
    return (
        blocks.where("kind = 'text'")
        .join(hop, ["doc_id", "block_id"], "left")
        .withColumn("head", F.coalesce("head", "block_id"))
        .groupBy("doc_id", "head")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))), lambda s: s["text"]), " "
            ).alias("text"),
            F.count("*").alias("n_members"),
        )
    )


def block_pieces(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cut blocks as [word_from, word_to) pieces with ids <id> and <id>c<k>."""
    words = F.filter(F.split(T.ws_collapse(F.col("text")), " "), lambda w: w != "")
    clean = F.array_sort(F.array_distinct(F.filter("at", lambda k: k > 0)))
    rows = (
        blocks.where("kind = 'text'")
        .join(cuts.withColumn("at", clean), ["doc_id", "block_id"])
        .withColumn("words", words)
    )
    starts = F.concat(F.array(F.lit(0)), F.col("at"))
    ends = F.concat(F.col("at"), F.array(F.size("words")))
    pieces = F.arrays_zip(starts.alias("word_from"), ends.alias("word_to"))
    return (
        rows.withColumn("starts", starts)
        .withColumn("ends", ends)
        .select("doc_id", "page", "ord", "block_id", "words", F.inline(F.arrays_zip("starts", "ends")))
        .select(
            "doc_id",
            "page",
            "ord",
            F.when(F.col("starts") == 0, F.col("block_id"))
            .otherwise(F.concat("block_id", F.lit("c"), F.col("starts").cast("string")))
            .alias("piece_id"),
            F.col("starts").alias("word_from"),
            F.col("ends").alias("word_to"),
            F.array_join(
                F.slice("words", F.col("starts") + 1, F.greatest(F.col("ends") - F.col("starts"), F.lit(0))), " "
            ).alias("text"),
        )
    )


def rejoin_pieces(cuts: DataFrame, asked: DataFrame) -> DataFrame:
    """cuts with the ones between adjacent pieces taken out. asked(doc_id,
    block_id, starts): word positions of the pieces, in order; a request whose
    pieces are not next to one another changes nothing."""
    have = F.concat(F.array(F.lit(0)), F.col("at"))
    first = F.array_position(have, F.element_at("starts", 1))
    adjacent = (first > 0) & (F.slice(have, F.greatest(first.cast("int"), F.lit(1)), F.size("starts")) == F.col("starts"))
    gone = F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0)))
    return cuts.join(asked, ["doc_id", "block_id"], "left").select(
        "doc_id",
        "block_id",
        F.when(
            F.coalesce((F.size("starts") > 1) & adjacent, F.lit(False)), F.array_except("at", gone)
        ).otherwise(F.col("at")).alias("at"),
    )


def insert_order(blocks: DataFrame, inserts: DataFrame) -> DataFrame:
    """Blocks and inserted text in one order: text after its anchor, in list
    order, or at its page's top when it has none."""
    anchors = blocks.select("doc_id", F.col("block_id").alias("after"), F.col("page").alias("_page"), "ord")
    put = (
        inserts.join(anchors, ["doc_id", "after"], "left")
        .where("after is null or _page is not null")
        .select(
            "doc_id",
            F.coalesce("_page", "page").alias("page"),
            F.coalesce("ord", F.lit(-1)).alias("anchor"),
            F.lit(1).alias("second"),
            F.col("pos").alias("third"),
            F.col("insert_id").alias("id"),
            "text",
        )
    )
    own = blocks.select(
        "doc_id",
        "page",
        F.col("ord").alias("anchor"),
        F.lit(0).alias("second"),
        F.lit(0).alias("third"),
        F.col("block_id").alias("id"),
        "text",
    )
    order = Window.partitionBy(*PAGE).orderBy("anchor", "second", "third")
    return own.unionByName(put).select(
        *PAGE, (F.row_number().over(order) - 1).alias("ord"), "id", "text"
    )


# ---- reading the log --------------------------------------------------------


def latest_decisions(log: DataFrame) -> DataFrame:
    """The newest edit of each block: later sequence numbers win."""
    return log.groupBy("doc_id", "block_id").agg(
        F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq")
    )


def decide(blocks: DataFrame, predicate: Column, **change) -> DataFrame:
    """The decisions a rule makes on the shaped blocks it picks. A field set to
    what the reader read is left out, and hidden and deleted exclude each other."""
    picked = blocks.where(predicate)
    cols = {}
    for f in ("role", "level", "depth", "bold", "italic"):
        kind = dict(blocks.dtypes)[f]
        value = F.lit(change[f]).cast(kind) if f in change else F.lit(None).cast(kind)
        cols[f] = F.when(value != F.col(f), value)
    for f in FLAGS:
        cols[f] = F.lit(True if change.get(f) else None).cast("boolean")
    if change.get("deleted"):
        cols["hidden"] = F.lit(None).cast("boolean")
    for f in ("break_before", "break_after"):
        cols[f] = F.lit("page" if change.get(f) else None).cast("string")
    cols["text"] = F.lit(change.get("text")).cast("string")
    out = picked.select("doc_id", "block_id", *[c.alias(f) for f, c in cols.items()])
    kept = None
    for f in cols:
        kept = F.col(f).isNotNull() if kept is None else kept | F.col(f).isNotNull()
    return out.where(kept)


def is_blank(edits: DataFrame) -> Column:
    """Whether an edits row holds no decision and no history."""

    def empty(name):
        return F.coalesce(F.size(name), F.lit(0)) <= 0

    parts = [
        empty(c)
        for c in ("blocks", "joins", "cuts", "inserts", "repeated_lines", "undo", "redo")
        if c in edits.columns
    ]
    for c in ("page_numbers", "headers_footers"):
        if c in edits.columns:
            parts.append(F.col(c).isNull())
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def stale_reads(docs: DataFrame, decided_docs: DataFrame, reader: int = K.READER_VERSION) -> DataFrame:
    """Documents to read again: read by another version, and nothing decided."""
    return docs.where(F.col("reader") != reader).join(decided_docs.select("doc_id").distinct(), "doc_id", "left_anti")
