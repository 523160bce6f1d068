"""Whole pipelines: layout to blocks, blocks to markdown, for all or what changed."""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from quire import constants as K
from quire.functions import runs as R
from quire.operators import decisions as D, emit as E, lines as L, structure as S
from quire.operators.digests import changed_documents, digest_tree
from quire.operators.fidelity import fidelity_pages, sides_by_page
from quire.session import settle


class Laid(NamedTuple):
    """blocks in reading order; what became of each page: status(doc_id, page, state,
    problem), where state is laid out, broken, slow or failed; and the broken pages with
    the number of their bad_runs."""

    blocks: DataFrame
    status: DataFrame
    broken: DataFrame


def lay_out(
    runs: DataFrame, links: DataFrame | None = None, pictures: DataFrame | None = None, seconds: Column | float = K.PAGE_SECONDS
) -> Laid:
    """Runs, links and kept pictures to blocks, page by page: one page stops no other.

    A page with a run that can't be placed is broken (``broken_pages``); one that takes
    longer than its seconds is slow; one whose reading fails is failed. They have no
    blocks and are named in status. Broken pages are taken out when their runs are packed,
    so that runs are not shuffled for it. A broken page's lines count in no fact about its
    document; a slow page's do. A run without a page is named under a null page.
    """
    broken = settle(broken_pages(runs), "broken")
    lines = L.runs_to_lines(runs.where("page is not null"), broken)
    if links is not None:
        lines = L.mark_links(lines, links)
    lines = settle(lines, "lines")
    if pictures is not None:
        pictures = pictures.join(broken.select(*S.PAGE), S.PAGE, "left_anti")
    blocks, late = S.structure_in_time(lines, pictures, F.lit(seconds) if isinstance(seconds, (int, float)) else seconds)
    state = F.substring_index("state", ": ", 1)
    problem = F.when(F.col("state") != state, F.substring_index("state", ": ", -1))
    late = late.select(*S.PAGE, state.alias("state"), problem.alias("problem"))
    good = lines.select(*S.PAGE).distinct().join(late.select(*S.PAGE), S.PAGE, "left_anti")
    good = good.select(*S.PAGE, F.lit("laid out").alias("state"), F.lit(None).cast("string").alias("problem"))
    return Laid(blocks, good.unionByName(late).unionByName(broken.select(*S.PAGE, F.lit("broken").alias("state"), "problem")), broken)


def read_blocks(runs: DataFrame, links: DataFrame | None = None, pictures: DataFrame | None = None) -> DataFrame:
    """``lay_out``'s blocks alone."""
    return lay_out(runs, links, pictures).blocks


def broken_pages(runs: DataFrame) -> DataFrame:
    """(doc_id, page, bad_runs, problem): pages with a run that lacks its text, page, box,
    base or size, or has one that is no finite number. Such a page is left out whole and
    named here, so that one broken page stops no other."""
    numbers = {"box": [f"box.{c}" for c in ("x", "y", "w", "h")], "base": ["base"], "size": ["size"]}
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    problem = F.when(F.col("page").isNull(), "page").when(F.col("text").isNull(), "text")
    for name, columns in numbers.items():
        problem = problem.when(reduce(lambda a, b: a | b, map(bad, columns)), name)
    wrong = runs.withColumn("problem", problem).where("problem is not null")
    return wrong.groupBy("doc_id", "page").agg(F.count("*").alias("bad_runs"), F.min("problem").alias("problem"))


def plan_landing(landed: DataFrame, done: DataFrame, decided: DataFrame, version: int = K.READER_VERSION, pins: str = "") -> DataFrame:
    """landed(doc_id, revision) with state: what is to become of each document.

    ``done`` if that revision was converted by this version under these pins: nothing is
    to do. ``pinned`` if the document has decisions and was converted before: decisions
    name blocks of that reading, so it stands. ``convert`` otherwise. done(doc_id,
    revision, version, pins) is what was converted; decided(doc_id) what has decisions.
    """
    same = (F.col("_revision") == F.col("revision")) & (F.col("_version") == version) & (F.col("_pins") == pins)
    before = done.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("revision", "version", "pins")])
    known = landed.join(before, "doc_id", "left").groupBy("doc_id", "revision").agg(
        F.coalesce(F.bool_or(same), F.lit(False)).alias("_same"), (F.count("_revision") > 0).alias("_read")
    )
    held = decided.select("doc_id").distinct().withColumn("_decided", F.lit(True))
    state = F.when(F.col("_same"), "done").when(F.col("_read") & F.col("_decided"), "pinned").otherwise("convert")
    return known.join(held, "doc_id", "left").select("doc_id", "revision", state.alias("state"))


def raw_to_runs(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Pieces as an extractor gives them (matrix, width, height, ascent, descent,
    vertical, flags) to runs with boxes, bases and sizes."""
    height = pages.select("doc_id", "page", F.col("height").alias("_ph"))
    size = F.when(F.col("vertical"), F.col("width")).otherwise(F.col("height"))
    cleaned = R.clean_runs(raw.withColumn("size", size))
    placed = R.run_box(
        F.col("text"), F.col("font"), F.col("matrix"), F.col("width"), F.col("height"), F.col("vertical"),
        F.col("ascent"), F.col("descent"), F.col("_ph"),
    )
    return (
        cleaned.join(height, ["doc_id", "page"])
        .withColumn("r", placed)
        .select("doc_id", "page", "run_no", "text", "lead", "trail", "r.box", "r.base", "r.size", "bold", "italic", "font")
    )


def markdown_of(blocks: DataFrame, pages: DataFrame, **given) -> E.Markdown:
    return E.emit(blocks, pages, **given)


def changed_only(changed: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table for the documents in changed(doc_id) alone."""
    ids = changed.select("doc_id").distinct()
    return [t.join(ids, "doc_id", "left_semi") for t in tables]


class ReEmitted(NamedTuple):
    """Markdown of the documents that changed, their ids (those gone too), and the tree
    to keep for next time."""

    markdown: E.Markdown
    changed: DataFrame
    tree: DataFrame


def re_emit(before: DataFrame, blocks: DataFrame, pages: DataFrame, decisions: DataFrame | None = None) -> ReEmitted:
    """Emits the documents whose blocks or decisions differ from what ``before``, the
    tree kept last time, was made of, and no other."""
    page = F.regexp_extract("block_id", r"^p(\d+)", 1).cast("int")
    given = [blocks] if decisions is None else [blocks, decisions.withColumn("page", page)]
    tree = settle(digest_tree(*given), "tree")
    changed = settle(changed_documents(tree, before), "changed")
    b, p, *d = changed_only(changed, blocks, pages, *([] if decisions is None else [decisions]))
    return ReEmitted(E.emit(b, p, decisions=d[0]) if d else E.emit(b, p), changed, tree)


def to_read(docs: DataFrame, decided: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of documents whose stored read no longer stands."""
    stale = D.stale_reads(docs, decided, K.READER_VERSION)
    return runs.join(stale.select("doc_id"), "doc_id", "left_semi")


def coverage_by_document(layers: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The flagship check: every letter printed against every letter written."""
    md = E.emit(blocks, pages)
    per_page = fidelity_pages(sides_by_page(layers, blocks, md))
    return per_page.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("expected").alias("expected"), F.sum("carried").alias("carried")
    )
