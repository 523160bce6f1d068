"""Whether markdown carries every letter and word its pages print."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quire.functions import text as T
from quire.functions.text import cut_words  # by itself: T holds functions Spark has made its own
from quire.operators import paged
from quire.operators.emit import BLOCK, texts_of
from quire.session import settle

PAGE = ["doc_id", "page"]


# ---- multisets of letters ---------------------------------------------------


def letter_counts(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, ch, n): letters and digits of `text`, case folded. Each text is one
    histogram, never a row for each letter, and histograms are added up before the
    shuffle, so a hot key moves one row per letter."""
    each = df.select(*keys, F.inline(T.letter_histogram(text)))
    return each.groupBy(*keys, "ch").agg(F.sum("n").alias("n"))


def total(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n").alias("total"))


def combine(counts: DataFrame, other: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """Multiset sum (or difference, no count below zero)."""
    signed = counts.unionByName(other.withColumn("n", F.col("n") * sign))
    return signed.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def carried(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: letters expected, and how many of them are in `got`.

    Both sides are summed in one grouping, so nothing is joined.
    """
    both = expected.select(*keys, "ch", F.col("n").alias("want"), F.lit(0).cast("long").alias("have")).unionByName(
        got.select(*keys, "ch", F.lit(0).cast("long").alias("want"), F.col("n").alias("have"))
    )
    per_letter = both.groupBy(*keys, "ch").agg(F.sum("want").alias("want"), F.sum("have").alias("have"))
    return per_letter.groupBy(*keys).agg(
        F.sum("want").alias("expected"), F.sum(F.least("want", "have")).alias("carried")
    )


def coverage(tallies: DataFrame, in_split: str = "in_split") -> DataFrame:
    """Carried over expected, pooled over all inputs and over the split's."""
    share = F.when(F.sum("expected") > 0, F.sum("carried") / F.sum("expected"))
    return (
        tallies.groupingSets([[], [F.col(in_split)]], F.col(in_split))
        .agg(
            F.grouping(in_split).alias("g"),
            F.count("*").alias("inputs"),
            F.sum("expected").alias("expected"),
            F.sum("carried").alias("carried"),
            share.alias("coverage"),
        )
        .where(f"g = 1 or {in_split}")
        .select(
            F.when(F.col("g") == 1, "all").otherwise("text_layer").alias("inputs_of"),
            "inputs",
            "expected",
            "carried",
            "coverage",
        )
    )


# ---- words ------------------------------------------------------------------


def _flat(texts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word in lists of marked texts: its page, its place in its text, and itself."""
    which, pos, words = cut_words(texts.flatten())
    return np.repeat(np.arange(len(texts)), paged.lengths(texts))[which], pos, words


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Values as numbers from 0, and the values these stand for."""
    told = values.dictionary_encode()
    return told.indices.to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary


def weigh_words(printed: pa.ListArray, written: pa.ListArray, dropped: pa.ListArray) -> pa.StructArray:
    """Of each page, its texts marked, the words printed more often than written, in order;
    of a page that has such words, those written more often than it needs, a line each."""
    found, step = [], 512  # pages whose words are held at a time
    for a in range(0, len(printed), step):
        sides = [_flat(c.slice(a, step)) for c in (printed, written, dropped)]
        n, page, pos = min(step, len(printed) - a), sides[0][0], sides[0][1]
        code, words = _codes(pa.concat_arrays([w for _, _, w in sides]))
        # a cell is a word of a page: each side's words are counted by cell
        size = max(1, len(words))
        cell, cells = _codes(pa.array(np.concatenate([p for p, _, _ in sides]) * size + code))
        on, word = np.divmod(cells.to_numpy(zero_copy_only=False), size)
        by_side = np.split(cell, np.cumsum([len(p) for p, _, _ in sides])[:-1])
        want, have, drop = (np.bincount(c, minlength=len(cells)) for c in by_side)
        # occurrence k of a word, by its place, is missing when k > dropped + have
        short = np.flatnonzero((want > have + drop)[by_side[0]])
        short = short[np.lexsort((pos[short], by_side[0][short]))]
        own = by_side[0][short]
        nth = np.arange(len(own)) - np.searchsorted(own, own) + 1
        lost = short[nth > (have + drop)[own]]
        lost = lost[np.lexsort((pos[lost], page[lost]))]
        lacks = np.bincount(page[lost], minlength=n) > 0
        spare = np.flatnonzero((have > np.maximum(want - drop, 0)) & lacks[on])
        spare = spare[np.argsort(on[spare], kind="stable")]

        def lists(of, values):
            edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(edges), values)

        said = lambda c: words.take(pa.array(word[c])).cast(pa.string())
        row = [paged.ints(pos[lost]), said(by_side[0][lost])]
        missing = lists(page[lost], pa.StructArray.from_arrays(row, ["pos", "word"]))
        found.append(pa.StructArray.from_arrays([missing, pc.binary_join(lists(on[spare], said(spare)), "\n")], ["missing", "spare"]))
    return pa.concat_arrays(found) if found else pa.array([], _WEIGHED_ARROW)


_WEIGHED_ARROW = pa.struct(
    {"missing": pa.list_(pa.struct({"pos": pa.int32(), "word": pa.string()})), "spare": pa.string()}
)


@F.arrow_udf(from_arrow_type(_WEIGHED_ARROW))
def _weigh(printed: pa.Array, written: pa.Array, dropped: pa.Array) -> pa.Array:
    return weigh_words(printed, written, dropped)


_SIDES = ("layer", "drop", "seen", "note")


def gathered(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, layer, drop, seen, note) of texts(keys, side, text), see ``sides``: each
    page's texts as they are, one array for each side, so nothing but texts is shuffled.
    Pages that are so already are left alone."""
    if "side" not in texts.columns:
        return texts
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("text"))).alias(side)
    return texts.groupBy(*keys).agg(*map(of, _SIDES))


def weighed_words(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, missing, spare) of texts: the texts of a page are ``gathered`` as they are and
    its words are counted in arrays, so no word is ever a row."""
    marked = lambda *sides: F.transform(F.concat(*sides), T.words_marked)
    pages = gathered(texts, keys).select(*keys, _weigh(marked("layer"), marked("seen", "note"), marked("drop")).alias("w"))
    return pages.select(*keys, "w.*")


def missing_words(weighed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, word): words printed more often than written, in order.

    The first occurrences are the ones dropped, so occurrence k is missing when
    k > dropped + have.
    """
    return weighed.select(*keys, F.inline("missing"))


def spare_word_filter(weighed: DataFrame, keys: list[str]) -> DataFrame:
    """missing_words without the words a spare word of the same page contains. A page's
    spare words are lines of one text, and no word has a line break."""
    kept = F.filter("missing", lambda m: ~F.contains(F.col("spare"), m["word"]))
    return weighed.select(*keys, F.inline(kept))


# ---- a whole document -------------------------------------------------------


def _told(blocks: DataFrame, markdown, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with hidden and corrected of their block, texts of lost blocks): texts are
    shuffled once for both. Lines that don't say what was done to their block are joined to
    the few blocks that are hidden or corrected: written by themselves, Spark sees how few."""
    if hasattr(markdown, "told"):
        told = markdown.told(lost)
        return told.where("not also"), told.where("also")
    odd = markdown.written.where("hidden or corrected").select(*PAGE, "block_id", "hidden", "corrected")
    return markdown.lines.join(settle(odd, "fate"), [*PAGE, "block_id"], "left"), texts_of(blocks).join(lost, BLOCK)


def sides(layers: DataFrame, blocks: DataFrame, markdown, decisions: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, side, text): every text the check weighs, and which side of
    it: 'layer' printed, 'drop' not expected, 'seen' and 'note' written in the
    open and in a comment."""
    return layers.select(*PAGE, F.lit("layer").alias("side"), "text").unionByName(_written_sides(blocks, markdown, decisions))


def sides_by_page(layers: DataFrame, blocks: DataFrame, markdown, decisions: DataFrame | None = None) -> DataFrame:
    """``sides``, ``gathered``. What a page prints and what is written of it are grouped by
    page each by itself and joined where that put them: layers, grouped before they come
    here, are not shuffled again. A page without a number is met by grouping."""
    known = F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    own = _written_sides(blocks, markdown, decisions)
    printed = layers.where(known).groupBy(*PAGE).agg(F.collect_list("text").alias("layer"))
    pages = printed.join(gathered(own.where(known), PAGE).drop("layer"), PAGE, "full_outer")
    none = F.array().cast("array<string>")
    pages = pages.select(*PAGE, *[F.coalesce(side, none).alias(side) for side in _SIDES])
    every = layers.select(*PAGE, F.lit("layer").alias("side"), "text").unionByName(own)
    return pages.unionByName(gathered(every.where(~known), PAGE))


def _written_sides(blocks: DataFrame, markdown, decisions: DataFrame | None) -> DataFrame:
    # A block that is not written is deleted, or has no words to lose. Which are lost is
    # told from light rows.
    kept = markdown.written.select("doc_id", "block_id", F.lit(True).alias("_kept"))
    rows = blocks.select(*BLOCK, "role", "marker").join(kept, ["doc_id", "block_id"], "left")
    if decisions is None:
        rows = rows.withColumns({"_role": F.col("role"), "_fixed": F.lit(False)})
    else:
        d = decisions.select(
            "doc_id", "block_id", F.col("role").alias("_drole"), F.col("text").isNotNull().alias("_fixed")
        )
        rows = rows.join(d, ["doc_id", "block_id"], "left").withColumns(
            {"_role": F.coalesce("_drole", "role"), "_fixed": F.coalesce("_fixed", F.lit(False))}
        )
    marker = F.when(F.col("_role") == "numbered", F.regexp_replace("marker", r"\d", "")).otherwise(F.col("marker"))
    lost = rows.where(F.col("_kept").isNull() | F.col("_fixed")).select(*BLOCK)
    lines, lost = _told(blocks, markdown, lost)
    drops = rows.select(*PAGE, marker.alias("text")).unionByName(lost.select(*PAGE, "text")).where("text != ''")
    # What a reader is shown is read off the lines themselves. A corrected block's words
    # are the person's: left out of the written side.
    inside = F.regexp_extract("text", r"^[ >]*<!-- (.*) -->$", 1)
    hidden = F.coalesce("hidden", F.lit(False))
    own = lines.where("block_id is not null").where(~F.coalesce("corrected", F.lit(False))).select(
        *PAGE,
        F.when(hidden, "note").otherwise("seen").alias("side"),
        T.rendered_text(F.when(hidden, inside).otherwise(F.col("text"))).alias("text"),
    )
    return drops.select(*PAGE, F.lit("drop").alias("side"), "text").unionByName(own)


def fidelity_pages(weighed: DataFrame) -> DataFrame:
    """Per page: letters expected, carried, and carried only in comments.

    A page's texts of one side are counted as one, and what is left is grouped by
    page as they were, so nothing but texts is shuffled.
    """
    pages = gathered(weighed, PAGE)

    def counted(side):
        return F.transform(T.letter_histogram(F.array_join(side, "\n")), lambda c: c.withField("side", F.lit(side)))

    per_letter = pages.select(*PAGE, F.inline(F.concat(*map(counted, _SIDES))))

    def n(*which):
        return F.sum(F.when(F.col("side").isin(*which), F.col("n")).otherwise(0))

    letters = per_letter.groupBy(*PAGE, "ch").agg(
        F.greatest(n("layer") - n("drop"), F.lit(0)).alias("want"),
        n("seen").alias("seen"),
        n("seen", "note").alias("both"),
    )
    sums = letters.groupBy(*PAGE).agg(
        F.sum("want").alias("expected"),
        F.sum(F.least("want", "both")).alias("carried"),
        F.sum(F.least("want", "both") - F.least("want", "seen")).alias("hidden"),
    )
    return sums


def fidelity_missing(weighed: DataFrame) -> DataFrame:
    """(doc_id, page, pos, word): the words printed and not written."""
    return spare_word_filter(weighed_words(weighed, PAGE), PAGE)


def fidelity_docs(pages: DataFrame) -> DataFrame:
    """Pages rolled up to documents: coverage is 1 where nothing is expected."""
    return (
        pages.groupBy("doc_id")
        .agg(*[F.sum(c).alias(c) for c in ("expected", "carried", "hidden")])
        .withColumn(
            "coverage",
            F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.col("carried") / F.col("expected")),
        )
    )
