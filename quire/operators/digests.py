"""What changed, told from a stored tree of digests rather than from the tables.

A page's digest covers every row given for it, whole spans of pages have one over their
pages, a document one over its spans. Two trees are compared from the top: documents
alike at the root are never looked into, so what is moved follows what changed.
"""

from pyspark.sql import DataFrame, functions as F

SPAN = 64  # pages under one digest
PAGES, SPANS, DOCUMENT = 0, 1, 2


def digest_tree(*tables: DataFrame) -> DataFrame:
    """(doc_id, level, node, digest) over tables with doc_id and page: level 0 are
    pages, 1 spans of SPAN pages by number, 2 documents (node 0). Every column counts,
    and its name; the order of rows doesn't, nor which table comes first."""
    rows = None
    for table in tables:
        columns = F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)])
        one = table.select("doc_id", F.col("page").cast("long").alias("node"), F.sha2(F.to_json(columns, {"ignoreNullFields": "false"}), 256).alias("digest"))
        rows = one if rows is None else rows.unionByName(one)

    def over(df, node):
        each = F.array_sort(F.collect_list(F.struct("node", "digest")))
        return df.groupBy("doc_id", node.alias("_node")).agg(F.sha2(F.to_json(each), 256).alias("digest")).withColumnRenamed("_node", "node")

    pages = over(rows, F.col("node"))
    spans = over(pages, F.floor(F.col("node") / SPAN))
    documents = over(spans, F.lit(0).cast("long"))
    out = None
    for level, part in ((PAGES, pages), (SPANS, spans), (DOCUMENT, documents)):
        part = part.select("doc_id", F.lit(level).alias("level"), "node", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def _unlike(now: DataFrame, before: DataFrame, level: int, within: DataFrame | None = None, of=None) -> DataFrame:
    """(doc_id, node) whose digests differ, or that one side lacks."""
    sides = []
    for tree, name in ((now, "a"), (before, "b")):
        part = tree.where(F.col("level") == level).select("doc_id", "node", F.col("digest").alias(name))
        if within is not None:
            above = within.select("doc_id", F.col("node").alias("_above"))
            part = part.withColumn("_above", of).join(above, ["doc_id", "_above"], "left_semi").drop("_above")
        sides.append(part)
    return sides[0].join(sides[1], ["doc_id", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", "node")


def changed_documents(now: DataFrame, before: DataFrame) -> DataFrame:
    """doc_id of documents that differ, came or went."""
    return _unlike(now, before, DOCUMENT).select("doc_id")


def changed_pages(now: DataFrame, before: DataFrame) -> DataFrame:
    """(doc_id, page) of pages that differ, came or went: spans are compared for
    documents that differ, pages for spans that do."""
    spans = _unlike(now, before, SPANS, _unlike(now, before, DOCUMENT), F.lit(0).cast("long"))
    pages = _unlike(now, before, PAGES, spans, F.floor(F.col("node") / SPAN))
    return pages.select("doc_id", F.col("node").cast("int").alias("page"))
