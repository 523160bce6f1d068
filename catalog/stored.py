"""Registered queries over sources: stored JSON through its gates, layout files read
back as tables, tests, run history and markdown written and read.

JSON is made from the tables, so it grows with them: each row's is good, or wrong in one
of the ways a gate knows. The expected code stands beside the fragment that earns it.
"""

import uuid

from pyspark.sql import functions as F

from catalog import layout_sql as L
from catalog.layout import markdown_of
from quire import session
from quire.plans import views as V
from quire.sources import gates as GA, tables as TA

QUERIES = {}


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


def _picked(fragments, k):
    return F.element_at(F.array(*[F.lit(f) for f, *_ in fragments]), (k + 1).cast("int"))


def _code(fragments, k):
    codes = ", ".join("NULL" if c is None else f"'{c}'" for _, c, *_ in fragments)
    return f"([{codes}])[{k} + 1]"


# ---- gates ------------------------------------------------------------------

PAGE = '{"n": 1, "lines": [], "pictures": [], "blocks": []}'
ANALYSES = [
    (f'"format": 1, "reader": 4, "bodySize": 10.5, "pages": [{PAGE}, {PAGE}]}}', None),
    ('"format": 1, ', "json"),
    (f'"format": 2, "pages": [{PAGE}]}}', "format"),
    (f'"format": "1", "pages": [{PAGE}]}}', "format"),
    ('"format": 1, "pages": {"n": 1}}', "no_pages"),
    ('"format": 1}', "no_pages"),
    (f'"format": 1, "pages": [{PAGE}, {{"n": "2", "lines": [], "pictures": [], "blocks": []}}]}}', "page"),
    ('"format": 1, "pages": [{"n": 1, "lines": [], "pictures": []}]}', "page"),
    ('"format": 1, "reader": "new", "pages": []}', None),
]


def _analyses(s, d):
    """Layout JSON of every document, its text carried along; one in ten is a list."""
    k = F.col("doc_id") % 9
    text = F.to_json(F.struct(F.col("text").alias("title")))
    whole = F.concat(F.expr("substr(_t, 1, length(_t) - 1)"), F.when(F.col("_t") != "{}", ", ").otherwise(""), _picked(ANALYSES, k))
    made = V.table(s, d, "documents").withColumn("_t", text)
    return made.select("doc_id", F.when(F.col("doc_id") % 10 == 7, F.concat(F.lit("["), "_t", F.lit("]"))).otherwise(whole).alias("json"))


add(
    "gate_analysis",
    lambda s, d: GA.gate_analysis(_analyses(s, d)).select("doc_id", "problem", "reader", "body_size"),
    f"""SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'not_object' ELSE {_code(ANALYSES, "(doc_id % 9)")} END AS problem,
      CASE WHEN doc_id % 10 <> 7 AND doc_id % 9 = 0 THEN 4 ELSE 1 END AS reader,
      CASE WHEN doc_id % 10 <> 7 AND doc_id % 9 = 0 THEN 10.5 ELSE 0.0 END::DOUBLE AS body_size FROM documents""",
)

# the third value: undo steps that can be put back
DECISIONS = [
    ('{"version": 1, "blocks": {"B": {"role": "para", "level": 3, "quote": true}}}', None, 0),
    ('{"version": 1, "blocks": {"B": {"hidden": true}}, "undo": [{"blocks": {}}, {"blocks": 1}, 7, {"blocks": {"B": {"bold": false}}}]}', None, 2),
    ('{"version": 1, "blocks": ', "json", 0),
    ('"B"', "not_object", 0),
    ('{"version": 2, "blocks": {}}', "format", 0),
    ('{"version": 1, "cuts": []}', "cuts_type", 0),
    ('{"version": 1, "cuts": {"B": [3, 0]}}', "cut_place", 0),
    ('{"version": 1, "inserts": [{"id": "i1", "text": "B"}]}', "insert", 0),
    ('{"version": 1, "inserts": [{"id": "i1", "text": "B", "page": 1, "after": null}, {"id": "i1", "text": "b", "page": 2, "after": "B"}]}', "insert_id_twice", 0),
    ('{"version": 1, "done": "yes"}', "done_type", 0),
    ('{"version": 1, "page_numbers": "drop"}', "page_numbers", 0),
    ('{"version": 1, "headers_footers": 1}', "headers_footers", 0),
    ('{"version": 1, "repeated_lines": {"B": "perhaps"}}', "line_setting", 0),
    ('{"version": 1, "blocks": ["B"]}', "blocks_type", 0),
    ('{"version": 1, "blocks": {"B": {"level": 9}}}', "block_override", 0),
    ('{"version": 1, "blocks": {"B": {"text": "  "}}, "undo": [{"blocks": {}}]}', "block_override", 1),
    ('{"version": 1, "joins": "B"}', "joins_type", 0),
    ('{"version": 1, "joins": {"B": 2}}', "join_target", 0),
]


def _decisions(s, d):
    block = F.concat(F.lit("p1b"), F.col("event_id").cast("string"))
    json = F.replace(_picked(DECISIONS, F.col("event_id") % len(DECISIONS)), F.lit('"B"'), F.concat(F.lit('"'), block, F.lit('"')))
    return V.table(s, d, "events").select("event_id", json.alias("json"))


K = f"(event_id % {len(DECISIONS)})"
add(
    "gate_decisions",
    lambda s, d: GA.gate_decisions(_decisions(s, d)).select("event_id", "problem", "undo_steps", "redo_steps"),
    f"SELECT event_id, {_code(DECISIONS, K)} AS problem, ({[n for *_, n in DECISIONS]})[{K} + 1] AS undo_steps, 0 AS redo_steps FROM events",
)

SHA = "0123456789abcdef" * 4
MANIFESTS = [
    (f'{{"format": 1, "name": "Corpus N", "documents": {{"a/N": {{"sha256": "{SHA}", "kept": 1}}}}}}', None),
    ('{"format": 1, "documents": {}}', None),
    ('{"format": 1', "json"),
    ('[{"format": 1}]', "not_object"),
    ('{"format": 2, "documents": {}}', "newer"),
    ('{"format": 0, "documents": {}}', "format"),
    ('{"documents": {}}', "format"),
    ('{"format": 1, "documents": []}', "no_documents"),
    ('{"format": 1, "documents": {"a//N": {}}}', "document_id"),
    ('{"format": 1, "documents": {"aN": 3}}', "entry_type"),
    (f'{{"format": 1, "documents": {{"aN": {{"sha256": "{SHA[:-1]}"}}}}}}', "sha256"),
]


def _manifests(s, d):
    json = F.replace(_picked(MANIFESTS, F.col("doc_id") % len(MANIFESTS)), F.lit("N"), F.col("doc_id").cast("string"))
    return V.table(s, d, "documents").select("doc_id", json.alias("json"))


add(
    "gate_manifest",
    lambda s, d: GA.gate_manifest(_manifests(s, d)).select("doc_id", "problem", F.when(F.col("doc_id") % len(MANIFESTS) == 0, F.col("name")).alias("name")),
    f"""SELECT doc_id, {_code(MANIFESTS, f"(doc_id % {len(MANIFESTS)})")} AS problem,
      CASE WHEN doc_id % {len(MANIFESTS)} = 0 THEN 'Corpus ' || doc_id END AS name FROM documents""",
)

# ---- written and read -------------------------------------------------------


def _place(s, name):
    return f"{session.shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _layout_back(s, d):
    """Printed lines as layout files, a document a row, read back as runs."""
    run = F.struct(
        "line_no", "text", F.lit(False).alias("lead"), F.lit(False).alias("trail"), "box", F.col("box.y").alias("base"), "size", "bold", "italic", "font"
    )
    pages = V.layout_lines(s, d).groupBy("doc_id", F.col("page").alias("n")).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    docs = pages.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n", "runs"))).alias("pages"))
    at = _place(s, "layout")
    docs.withColumn("format", F.lit(1)).write.json(at)
    return TA.read_layout(s, at)["runs"]


add(
    "read_layout",
    lambda s, d: _layout_back(s, d).select(F.col("doc_id").cast("long").alias("doc_id"), "page", "run_no", "text", "size", "box.x", "box.y", "box.w"),
    L.with_lines("SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS run_no, text, size, x, y, w FROM lines"),
)


def _tests_back(s, d):
    """Benchmark items as tests, a file for each of three categories, read back."""
    at = _place(s, "tests")
    b = V.table(s, d, "benchmark")
    for k, name in enumerate(("present", "order", "table")):
        one = b.where(F.col("item_id") % 3 == k).select(
            F.col("item_id").cast("string").alias("id"), F.concat(F.lit("doc"), (F.col("item_id") % 7).cast("string"), F.lit(".pdf")).alias("pdf"),
            (F.col("item_id") % 5).cast("int").alias("page"), F.lit(name).alias("type"), "text",
            F.concat(F.lit("c"), F.when(F.col("item_id") % 7 < 4, F.lit(0)).otherwise(F.col("item_id") % 2).cast("string")).alias("category"),
        )
        one.write.mode("append").json(f"{at}/{name}")
    path = lambda name: f"{at}/{name}"
    parts = [TA.read_tests(s, path(n), category_of_file=False).withColumn("file", F.lit(n)) for n in ("present", "order", "table")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


add(
    "read_tests",
    lambda s, d: _tests_back(s, d).select("id", "input", "page", "type", "text", "category", "problem"),
    """WITH b AS (SELECT *, 'c' || CASE WHEN item_id % 7 < 4 THEN 0 ELSE item_id % 2 END AS category FROM benchmark),
    n AS (SELECT item_id % 3 AS file, item_id % 7 AS pdf, count(DISTINCT category) AS n FROM b GROUP BY 1, 2)
    SELECT item_id::VARCHAR AS id, 'doc' || item_id % 7 || '.pdf' AS input, (item_id % 5)::INT AS page, (['present', 'order', 'table'])[item_id % 3 + 1] AS type,
      text, category, CASE WHEN n.n <> 1 THEN 'its tests name several categories' END AS problem
    FROM b JOIN n ON n.file = item_id % 3 AND n.pdf = item_id % 7""",
)


def _history_back(s, d):
    """A run for each tool and day of the events, appended in two goes and read back."""
    runs = V.table(s, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    line = runs.select(
        F.col("day").cast("timestamp").alias("date"), F.lit("events").alias("benchmark"), F.col("event_type").alias("tool"), F.col("n").cast("int").alias("pages"),
        F.struct(F.col("n").cast("int").alias("inputs"), (F.col("n") / 4).alias("score")).alias("all"),
    )
    at = _place(s, "history")
    for part in (F.dayofmonth("date") <= 10, F.dayofmonth("date") > 10):
        TA.append_history(line.where(part), at)
    return TA.read_history(s, at)


add(
    "history",
    lambda s, d: _history_back(s, d).select(F.date_format("date", "yyyy-MM-dd").alias("day"), "tool", "pages", F.col("all.inputs").alias("inputs"), F.col("all.score").alias("score")),
    """SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type AS tool, count(*)::INT AS pages, count(*)::INT AS inputs, count(*) / 4 AS score
      FROM events GROUP BY ts::DATE, event_type""",
)


def _markdown_back(s, d):
    at = _place(s, "markdown")
    TA.write_markdown(markdown_of(s, d).lines, at)
    return TA.read_markdown(s, at)


add(
    "write_markdown",
    lambda s, d: _markdown_back(s, d).groupBy("doc_id", "text").agg(F.count("*").alias("n")),
    L.with_markdown("SELECT doc_id, text, count(*) AS n FROM md GROUP BY doc_id, text"),
)
