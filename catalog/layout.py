"""Registered queries over the layout views: lines, blocks, furniture, markdown."""

from pyspark.sql import functions as F

from catalog import layout_sql as L
from quire.functions import geometry as G, runs as R, text as T
from quire.operators import decisions as D, digests as DG, emit as E, furniture as FU, lines as LN, structure as S
from quire.plans import convert as C, views as V
from quire.session import stored

PAGE = ["doc_id", "page"]


def _flat_box(df):
    return df.withColumns({k: F.col(f"box.{k}") for k in "xywh"}).drop("box")


def blocks_of(spark, sf):
    """The layout's text blocks: what most queries here start from."""
    return stored(spark, sf, "blocks", lambda: S.structure(V.layout_lines(spark, sf)))


def _markdown(spark, sf):
    return E.emit(blocks_of(spark, sf), V.layout_pages(spark, sf))


def markdown_of(spark, sf):
    """The undecided markdown, its written blocks kept: what checks on it start from."""
    return stored(spark, sf, "markdown", lambda: _markdown(spark, sf))


QUERIES = {}


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


# ---- lines ------------------------------------------------------------------

add(
    "runs_to_lines",
    lambda s, d: _flat_box(LN.runs_to_lines(V.layout_runs(s, d))).drop("line_no"),
    L.with_lines(
        """SELECT doc_id, page, text, size, bold, italic, CASE WHEN bold THEN 'Body-Bold' ELSE 'Body' END AS font,
          x, y, (length(text) * CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS w, h FROM lines"""
    ),
)
add(
    "gutter_evidence",
    lambda s, d: LN.gutter_evidence(V.gutter_runs(s, d)),
    f"WITH {L.GUTTERS} SELECT doc_id, page, run_no, half, clear, inked, side FROM said",
)
add(
    "gutter_lines",
    lambda s, d: _flat_box(LN.runs_to_lines(V.gutter_runs(s, d))).select(*PAGE, "text", "size", "x", "y", "w"),
    f"""WITH {L.GUTTERS} SELECT doc_id, page, text, size, x, y, w FROM (
      SELECT doc_id, page, size, y, x, CASE WHEN joins THEN right_x + right_w - x ELSE w END AS w,
        CASE WHEN joins THEN trim(text || ' ' || right_text) ELSE text END AS text FROM judged
      UNION ALL SELECT doc_id, page, size, y, right_x, right_w, right_text FROM judged WHERE NOT joins)""",
)
add(
    "text_layer",
    lambda s, d: V.layers(s, d),
    L.with_lines("SELECT doc_id, page, string_agg(text, ' ' ORDER BY line_no) AS text FROM lines GROUP BY doc_id, page"),
)
add(
    "mark_links",
    lambda s, d: LN.mark_links(V.layout_lines(s, d), V.layout_links(s, d)).select(*PAGE, "line_no", "href"),
    # a page's two links are known from its number: each line looks at both
    L.with_lines(
        """SELECT doc_id, page, line_no,
          CASE WHEN greatest(0, least(x + w, 470) - greatest(x, 70)) * greatest(0, least(y + h, 114 + down) - greatest(y, 98 + down)) >= 0.5 * w * h
              THEN 'https://example.com/d ' || doc_id || '?p=(' || page || ')'
            WHEN greatest(0, least(x + w, 170) - greatest(x, 70)) * greatest(0, least(y + h, 140 + down) - greatest(y, 100 + down)) >= 0.5 * w * h
              THEN 'https://example.com/e/' || page END AS href
        FROM (SELECT *, (doc_id + page) % 13 * 18 AS down FROM lines)"""
    ),
)
add(
    "keep_pictures",
    lambda s, d: _flat_box(V.kept_pictures(s, d)).select(*PAGE, "pic_no", "x", "y", "w", "h"),
    "WITH " + L.LINES + L.PAGES + L.PICTURES + " SELECT doc_id, page, pic_no, x, y, w, h FROM pictures",
)

# ---- document facts ---------------------------------------------------------

add(
    "body_size",
    lambda s, d: S.body_size(V.layout_lines(s, d)),
    "WITH " + L.LINES + L.FACTS + " SELECT doc_id, body_size FROM facts",
)
add(
    "bold_fraction",
    lambda s, d: S.bold_fraction(V.layout_lines(s, d)),
    "WITH " + L.LINES + L.FACTS + " SELECT doc_id, bold_fraction FROM facts",
)
add(
    "document_facts",
    lambda s, d: S.document_facts(V.layout_lines(s, d)),
    "WITH " + L.LINES + L.FACTS + " SELECT doc_id, body_size, bold_fraction FROM facts",
)
add(
    "compounds",
    lambda s, d: S.compounds(V.layout_lines(s, d)),
    L.with_lines(
        r"""SELECT DISTINCT doc_id, replace(lower(unnest(regexp_extract_all(text, '\p{L}+(?:[-‐]\p{L}+)+'))), '‐', '-') AS word
        FROM lines"""
    ),
)
add(
    "is_heading",
    lambda s, d: S.by_page(S.document_facts(V.layout_lines(s, d)), V.layout_lines(s, d))
    .join(V.layout_lines(s, d), PAGE)
    .select(
        *PAGE,
        "line_no",
        S.is_heading(
            F.col("text"), F.col("size"), F.col("bold"), F.col("body_size"), F.col("bold_fraction") < 0.35
        ).alias("heading"),
    ),
    L.with_blocks("SELECT doc_id, page, line_no, heading FROM classed"),
)

# ---- blocks -----------------------------------------------------------------

add(
    "reading_order",
    lambda s, d: S.grouped_lines(V.layout_lines(s, d)).select(*PAGE, "line_no", "pos", "group"),
    L.with_blocks('SELECT doc_id, page, line_no, pos - 1 AS pos, grp AS "group" FROM grouped'),
)
add(
    "structure",
    lambda s, d: _flat_box(S.structure(V.layout_lines(s, d))).select(
        *PAGE, "ord", "block_id", "x", "y", "w", "h", F.size("lines").alias("n_lines"), "text", "role", "level", "depth",
        "bold", "italic", "marker", "size",
    ),
    L.with_blocks("SELECT * FROM blocks"),
)
add(
    "page_status",
    lambda s, d: C.lay_out(V.damaged_runs(s, d), seconds=V.page_seconds()).status,
    L.with_lines(
        """SELECT doc_id, page, CASE WHEN (doc_id + page) % 11 = 3 THEN 'broken' WHEN (doc_id + page) % 13 = 5 THEN 'slow' ELSE 'laid out' END AS state,
        CASE WHEN (doc_id + page) % 11 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'box' END END AS problem FROM layout_pages"""
    ),
)
add(
    "sound_blocks",
    lambda s, d: _flat_box(C.lay_out(V.damaged_runs(s, d), V.layout_links(s, d), seconds=V.page_seconds()).blocks).select(
        *PAGE, "ord", "block_id", "x", "y", "w", "h", F.size("lines").alias("n_lines"), "text", "role", "level", "depth",
        "bold", "italic", "marker", "size",
    ),
    # a broken page's lines count in nothing; a slow page's count in its document's facts
    f"WITH {L.SOUND}, timely AS (SELECT *, (doc_id + page) % 13 = 5 AS slow FROM blocks) SELECT * EXCLUDE (slow) FROM timely WHERE NOT slow",
)
add(
    "list_depth",
    lambda s, d: blocks_of(s, d).where("role in ('bullet','numbered','alpha','roman')").select(*PAGE, "block_id", "depth"),
    L.with_blocks("SELECT doc_id, page, block_id, depth FROM blocks WHERE role IN ('bullet','numbered','alpha','roman')"),
)
add(
    "join_lines",
    lambda s, d: blocks_of(s, d).select(*PAGE, "block_id", "text"),
    L.with_blocks("SELECT doc_id, page, block_id, text FROM blocks"),
)
add(
    "heading_levels",
    lambda s, d: S.heading_levels(blocks_of(s, d)).select("doc_id", F.explode("levels").alias("size", "level")),
    L.with_blocks("SELECT doc_id, size, least(level, 4) AS level FROM heading_sizes"),
)
add(
    "place_pictures",
    lambda s, d: S.structure(V.layout_lines(s, d), V.kept_pictures(s, d)).select(*PAGE, "ord", "block_id", "kind"),
    "WITH " + L.CLASSED + L.PAGES + L.PICTURES + """,
    near AS (
      SELECT p.doc_id, p.page, p.pic_no, b.ord,
        CASE WHEN least(b.y + b.h, p.y + p.h) - greatest(b.y, p.y) > 0 AND b.x >= p.x + p.w - 2 THEN b.x - (p.x + p.w)
          WHEN least(b.x + b.w, p.x + p.w) - greatest(b.x, p.x) > 0 AND b.y >= p.y + p.h - 2 THEN b.y - (p.y + p.h) END AS dist
      FROM pictures p JOIN blocks b ON b.doc_id = p.doc_id AND b.page = p.page),
    best AS (
      SELECT doc_id, page, pic_no, arg_min(ord, floor(dist / 6 + 0.5) * 100000 + ord) AS anchor
      FROM near WHERE dist IS NOT NULL GROUP BY 1, 2, 3),
    rows AS (
      SELECT doc_id, page, ord AS a, 1 AS t, 0 AS n, block_id, 'text' AS kind FROM blocks
      UNION ALL
      SELECT p.doc_id, p.page, coalesce(anchor, 1000000), 0, p.pic_no, 'p' || p.page || 'i' || p.pic_no, 'image'
      FROM pictures p LEFT JOIN best b ON b.doc_id = p.doc_id AND b.page = p.page AND b.pic_no = p.pic_no)
    SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY a, t, n) - 1 AS ord, block_id, kind FROM rows""",
)

# ---- furniture --------------------------------------------------------------

SEEN = """, seen AS (
  SELECT doc_id, page, ord, block_id, y, text, CASE WHEN marker <> '' THEN marker || ' ' || text ELSE text END AS printed,
    y + h <= 792 * 0.12 OR y >= 792 - 792 * 0.12 AS margin FROM blocks),
keyed AS (
  SELECT *, CASE WHEN margin THEN lower(nullif(regexp_extract(printed, '(?i)^(?:page\\s+)?(\\d{1,4})$', 1), '')) END AS label,
    CASE WHEN regexp_matches(printed, '\\p{L}') THEN trim(regexp_replace(lower(printed), '\\d+', '#', 'g')) ELSE '' END AS key
  FROM seen),
rep AS (
  SELECT doc_id, key, count(DISTINCT page) AS anywhere,
    count(DISTINCT page) FILTER (margin AND label IS NULL) AS n_pages,
    count(*) FILTER (margin AND label IS NULL) AS n_blocks,
    count(*) FILTER (margin AND label IS NULL AND y < 396) AS n_top,
    arg_min(trim(printed), page * 1000 + ord) FILTER (margin AND label IS NULL) AS text,
    min(page * 1000 + ord) FILTER (margin AND label IS NULL) AS first
  FROM keyed WHERE key <> '' GROUP BY doc_id, key
  HAVING n_pages >= 2 AND n_pages / anywhere >= 0.5)"""

add(
    "repeated_lines",
    lambda s, d: FU.repeated_lines(blocks_of(s, d), V.layout_pages(s, d)),
    "WITH " + L.CLASSED + SEEN + """ SELECT doc_id, key, text, CASE WHEN n_top * 2 >= n_blocks THEN 'top' ELSE 'bottom' END AS place,
      n_pages, n_blocks, first // 1000 AS first_page, first % 1000 AS first_ord FROM rep""",
)
add(
    "repeated_blocks",
    lambda s, d: FU.repeated_blocks(blocks_of(s, d), V.layout_pages(s, d)).drop("words"),
    "WITH " + L.CLASSED + SEEN + """ SELECT doc_id, key, page, ord, block_id FROM keyed JOIN rep USING (doc_id, key)
      WHERE margin AND label IS NULL""",
)
add(
    "page_numbers",
    lambda s, d: FU.page_numbers(blocks_of(s, d), V.layout_pages(s, d)),
    "WITH " + L.CLASSED + SEEN + """ SELECT doc_id, count(*) AS n_labels, count(DISTINCT page) AS n_pages,
      arg_min(label, page * 1000 + ord) AS first_label, arg_max(label, page * 1000 + ord) AS last_label,
      CASE WHEN count(*) FILTER (y < 396) * 2 > count(*) THEN 'top' ELSE 'bottom' END AS place
      FROM keyed WHERE label IS NOT NULL GROUP BY doc_id""",
)
add(
    "find_furniture",
    lambda s, d: FU.find_furniture(blocks_of(s, d), V.layout_pages(s, d)),
    "WITH " + L.CLASSED + SEEN + """ SELECT doc_id, 'page_numbers' AS furniture, count(*) AS n,
        arg_min(trim(printed), page * 1000 + ord) AS sample, 'page ' || arg_min(label, page * 1000 + ord) AS hidden_as
      FROM keyed WHERE label IS NOT NULL GROUP BY doc_id
      UNION ALL
      SELECT doc_id, 'headers_footers', count(*), arg_min(trim(k.text), page * 1000 + ord), arg_min(trim(k.text), page * 1000 + ord)
      FROM keyed k JOIN rep USING (doc_id, key) WHERE margin AND label IS NULL GROUP BY doc_id""",
)
add(
    "count_furniture",
    lambda s, d: FU.count_furniture(blocks_of(s, d), V.layout_pages(s, d)),
    "WITH " + L.CLASSED + SEEN + """ SELECT doc_id, count(*) FILTER (label IS NOT NULL) AS page_numbers,
      count(*) FILTER (label IS NULL) AS headers_footers
      FROM keyed LEFT JOIN rep USING (doc_id, key) WHERE margin AND (label IS NOT NULL OR rep.key IS NOT NULL) GROUP BY doc_id""",
)
SETTINGS = """, set AS (
  SELECT doc_id, (['keep','hide','delete'])[doc_id % 3 + 1] AS pn, (['keep','hide','delete'])[doc_id // 3 % 3 + 1] AS hf,
    CASE WHEN doc_id % 5 = 0 THEN 'notes of ' || regexp_replace(lower(source), '\\d+', '#', 'g') || ' part #' END AS own
  FROM documents)"""
add(
    "apply_furniture",
    lambda s, d: E.shape(
        blocks_of(s, d), V.layout_pages(s, d), decisions=V.decisions(s, d), settings=V.doc_settings(s, d),
        line_settings=V.line_settings(s, d),
    ).select(*PAGE, "block_id", "hidden", "deleted", "furniture", "label"),
    "WITH " + L.CLASSED + SEEN + L.DECISIONS + SETTINGS + """,
    asked AS (
      SELECT k.*, coalesce(t = 'click', false) AS h0, coalesce(t = 'signup', false) AS d0, pn, hf, own,
        rep.key IS NOT NULL AND margin AND label IS NULL AS repeats, CASE WHEN t = 'purchase' THEN 'x' ELSE k.text END AS said
      FROM keyed k LEFT JOIN last_events e USING (doc_id, block_id) JOIN set USING (doc_id) LEFT JOIN rep USING (doc_id, key)),
    chosen AS (
      SELECT *, CASE WHEN h0 OR d0 THEN NULL WHEN label IS NOT NULL AND pn <> 'keep' THEN 'page_numbers'
          WHEN repeats AND (CASE WHEN key = own THEN 'hide' ELSE hf END) <> 'keep' THEN 'headers_footers' END AS furniture
      FROM asked WHERE said <> ''),
    ruled AS (
      SELECT *, CASE furniture WHEN 'page_numbers' THEN pn WHEN 'headers_footers' THEN CASE WHEN key = own THEN 'hide' ELSE hf END END AS c
      FROM chosen)
    SELECT doc_id, page, block_id, h0 OR coalesce(c = 'hide', false) AS hidden, d0 OR coalesce(c = 'delete', false) AS deleted,
      furniture, CASE WHEN furniture = 'page_numbers' THEN label END AS label FROM ruled""",
)

# ---- decisions --------------------------------------------------------------

add(
    "overlay_decisions",
    lambda s, d: D.overlay_decisions(blocks_of(s, d), V.decisions(s, d)).select(
        *PAGE, "block_id", "text", "role", "level", "depth", "bold", "italic", "quote", "hidden", "deleted", "corrected"
    ),
    "WITH " + L.CLASSED + L.DECISIONS + """ SELECT doc_id, page, block_id,
      CASE WHEN t = 'purchase' THEN 'Corrected words ' || event_id ELSE text END AS text,
      CASE WHEN t = 'view' THEN 'heading' ELSE role END AS role, CASE WHEN t = 'view' THEN 2 ELSE level END AS level,
      depth, bold, italic, coalesce(t = 'error', false) AS quote, coalesce(t = 'click', false) AS hidden,
      coalesce(t = 'signup', false) AS deleted, coalesce(t = 'purchase', false) AS corrected
      FROM blocks LEFT JOIN last_events USING (doc_id, block_id)""",
)


def _joins(s, d):
    """Every third block of a page joined onto the block before it."""
    b = blocks_of(s, d).where("ord % 3 = 2")
    return b.select("doc_id", F.col("block_id").alias("child"), F.format_string("p%db%d", "page", F.col("ord") - 1).alias("head"))


add(
    "merge_groups",
    lambda s, d: D.merge_groups(blocks_of(s, d), _joins(s, d)),
    L.with_blocks(
        """SELECT doc_id, 'p' || page || 'b' || (ord - CASE WHEN ord % 3 = 2 THEN 1 ELSE 0 END) AS head,
          string_agg(text, ' ' ORDER BY ord) AS text, count(*) AS n_members FROM blocks GROUP BY doc_id, page, 2"""
    ),
)
add(
    "block_pieces",
    lambda s, d: D.block_pieces(
        blocks_of(s, d),
        blocks_of(s, d).where("size(split(text, ' ')) > 9").select(
            "doc_id", "block_id", F.array(F.lit(7), F.lit(3)).alias("at")
        ),
    ).select("doc_id", "piece_id", "word_from", "word_to", "text"),
    L.with_blocks(
        """, cut AS (SELECT doc_id, block_id, string_split(text, ' ') AS w FROM blocks WHERE len(string_split(text, ' ')) > 9),
        edge AS (SELECT *, unnest([0, 3, 7]) AS f FROM cut)
        SELECT doc_id, CASE WHEN f = 0 THEN block_id ELSE block_id || 'c' || f END AS piece_id, f AS word_from,
          CASE f WHEN 0 THEN 3 WHEN 3 THEN 7 ELSE len(w) END AS word_to,
          array_to_string(w[f + 1 : CASE f WHEN 0 THEN 3 WHEN 3 THEN 7 ELSE len(w) END], ' ') AS text FROM edge"""
    ),
)


def _inserts(s, d):
    """Two notes after every page's second block, one at every third page's top."""
    p = V.layout_pages(s, d)
    made = F.array(
        F.struct(F.lit("a").alias("t"), F.lit(0).alias("pos"), F.format_string("p%db1", "page").alias("after")),
        F.struct(F.lit("b").alias("t"), F.lit(1).alias("pos"), F.format_string("p%db1", "page").alias("after")),
        F.struct(F.lit("c").alias("t"), F.lit(2).alias("pos"), F.lit(None).cast("string").alias("after")),
    )
    return p.select("doc_id", "page", F.inline(made)).select(
        "doc_id", F.concat(F.lit("i"), "page", "t").alias("insert_id"), "page", "after", F.col("t").alias("text"), "pos"
    )


add(
    "insert_order",
    lambda s, d: D.insert_order(blocks_of(s, d), _inserts(s, d)).select(*PAGE, "ord", "id"),
    L.with_blocks(
        """, rows AS (
          SELECT doc_id, page, ord AS a, 0 AS b, 0 AS c, block_id AS id FROM blocks
          UNION ALL SELECT doc_id, page, 1, 1, 0, 'i' || page || 'a' FROM blocks WHERE ord = 1
          UNION ALL SELECT doc_id, page, 1, 1, 1, 'i' || page || 'b' FROM blocks WHERE ord = 1
          UNION ALL SELECT doc_id, page, -1, 1, 2, 'i' || page || 'c' FROM layout_pages)
        SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY a, b, c) - 1 AS ord, id FROM rows"""
    ),
)

# ---- markdown ---------------------------------------------------------------

add(
    "emit",
    lambda s, d: _markdown(s, d).lines,
    L.with_markdown("SELECT doc_id, line_no, text, block_id, page FROM md"),
)
add(
    "line_numbers",
    lambda s, d: markdown_of(s, d).placed.select(*PAGE, "block_id", "n", "line_from", "line_to", "hidden", "deleted"),
    L.with_markdown(
        """SELECT m.doc_id, m.page, m.block_id, e.nth AS n, m.line_no AS line_from, m.line_no AS line_to, false AS hidden,
          false AS deleted FROM md m JOIN emitted e ON e.doc_id = m.doc_id AND e.block_id = m.block_id"""
    ),
)
add(
    "list_markers",
    lambda s, d: markdown_of(s, d).written.where("is_item").select(
        *PAGE, "block_id", "item.marker", "item.indent", "item.depth"
    ),
    L.with_markdown(
        """SELECT doc_id, page, block_id, mk AS marker, ind AS indent, dep AS depth FROM emitted WHERE item"""
    ),
)
add(
    "list_after",
    lambda s, d: markdown_of(s, d).placed.where("item is not null").select(*PAGE, "block_id", "item.after"),
    L.with_markdown(
        """SELECT doc_id, page, block_id, CASE WHEN p_item THEN p_id END AS after FROM (
          SELECT *, lag(item) OVER o AS p_item, lag(block_id) OVER o AS p_id FROM emitted
          WINDOW o AS (PARTITION BY doc_id, page ORDER BY nth)) WHERE item"""
    ),
)
add(
    "md_pages",
    lambda s, d: E.md_pages(markdown_of(s, d).lines),
    L.with_markdown(
        """SELECT doc_id, page, min(line_no) - 1 AS line_from, count(*) AS n_lines,
          string_agg(text, chr(10) ORDER BY line_no) || chr(10) AS text FROM md GROUP BY doc_id, page"""
    ),
)
add(
    "emit_decided",
    lambda s, d: E.emit(
        S.structure(V.layout_lines(s, d), V.kept_pictures(s, d)), V.layout_pages(s, d), decisions=V.decisions(s, d),
        settings=V.doc_settings(s, d), line_settings=V.line_settings(s, d), pictures=V.kept_pictures(s, d),
    ).lines,
)


def _earlier(blocks):
    """Blocks as they were before: some first pages worded otherwise, some second pages not there."""
    text = F.when((F.col("doc_id") % 7 == 0) & (F.col("page") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return blocks.where(~((F.col("doc_id") % 11 == 0) & (F.col("page") == 2))).withColumn("text", text)


CHANGED = "(doc_id % 7 = 0 AND page = 1) OR (doc_id % 11 = 0 AND page = 2)"
add(
    "changed_digests",
    lambda s, d: DG.changed_pages(DG.digest_tree(blocks_of(s, d)), DG.digest_tree(_earlier(blocks_of(s, d)))),
    L.with_blocks(f"SELECT DISTINCT doc_id, page FROM blocks WHERE {CHANGED}"),
)
add(
    "re_emit",
    lambda s, d: C.re_emit(DG.digest_tree(_earlier(blocks_of(s, d))), blocks_of(s, d), V.layout_pages(s, d)).markdown.lines.select(
        "doc_id", "line_no", "text", "block_id", "page"
    ),
    L.with_markdown(f"SELECT doc_id, line_no, text, block_id, page FROM md WHERE doc_id IN (SELECT doc_id FROM blocks WHERE {CHANGED})"),
)


def _changed(s, d):
    blocks, pages = blocks_of(s, d), V.layout_pages(s, d)
    after = E.emit(blocks, pages, decisions=V.decisions(s, d))
    return E.changed_pages(after.lines, E.emit(blocks, pages).lines)


add(
    "changed_pages",
    _changed,
    "WITH " + L.CLASSED + L.DECISIONS + """ SELECT DISTINCT doc_id, page FROM blocks JOIN last_events USING (doc_id, block_id)
      WHERE text <> '' AND (t IN ('click', 'error', 'signup', 'purchase')
        OR (t = 'view' AND (role <> 'heading' OR level <> 2)))""",
)
