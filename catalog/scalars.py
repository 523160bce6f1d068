"""Registered queries over scalar functions: markers, labels, markdown, letters, paths."""

from pyspark.sql import functions as F

from catalog import layout_sql as L
from quire.functions import geometry as G, measure as M, paths as P, phrases as W, runs as R, text as T
from quire.plans import views as V

QUERIES = {}


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


def over_lines(columns):
    """Each printed line of the layout with the columns made of its text, its
    marker and its first word."""

    def query(s, d):
        t = F.col("text")
        made = columns(t, T.marker_of(t), F.substring_index(t, " ", 1))
        return V.layout_lines(s, d).select("doc_id", "page", "line_no", *[c.alias(n) for n, c in made.items()])

    return query


KEY = "doc_id, page, line_no"
add(
    "marker_of",
    over_lines(lambda t, marker, first_word: dict(role=marker["role"], marker=marker["marker"], rest=marker["rest"])),
    L.with_lines(
        f"""SELECT {KEY}, role, trim(mh) AS marker, CASE WHEN role = '' THEN text ELSE trim(substr(text, length(mh) + 1)) END AS rest
        FROM (SELECT *, {L.head("text", "role")} AS mh FROM (SELECT *, {L.role("text")} AS role FROM lines))"""
    ),
)
add(
    "marker_only",
    over_lines(lambda t, marker, first_word: dict(word=first_word, bullet=T.bullet_only(first_word), marker=T.marker_only(first_word))),
    L.with_lines(
        f"""SELECT {KEY}, word, regexp_matches(word, '^[{L.BULLETS}\\-–—·*]+$') AS bullet,
          regexp_matches(word, '(?i)^\\(?(?:\\d{{1,3}}|[ivxlcdm]{{1,5}}|[a-z])[.)]$') AS marker
        FROM (SELECT *, split_part(text, ' ', 1) AS word FROM lines)"""
    ),
)


def _labels(s, d):
    """Margin texts of many shapes, made from each line's number."""
    romans = F.array(*[F.lit(r) for r in ROMANS])
    r = F.element_at(romans, (F.col("i") % len(ROMANS) + 1).cast("int"))
    n = F.col("i").cast("string")
    shapes = [
        F.concat(F.lit("Page "), n), F.concat(F.lit("- "), n, F.lit(" -")), r, F.col("raw"), F.upper(r),
        F.concat(n, F.lit(" of "), (F.col("i") + 5).cast("string")), F.concat(F.lit("p. "), n), F.concat(n, F.lit(" apples")),
    ]
    said = F.element_at(F.array(*shapes), ((F.col("i") + F.col("doc_id")) % len(shapes) + 1).cast("int"))
    return V.doc_lines(s, d).select("doc_id", "i", said.alias("said"))


ROMANS = ["i", "ii", "iv", "ix", "xl", "l", "lxxxix", "xii", "mix", "did", "civil", "mill", "cd", "d", "c", "xc"]
SAID = f"""said AS (SELECT doc_id, i, (['Page ' || i, '- ' || i || ' -', r, raw, upper(r), i || ' of ' || (i + 5), 'p. ' || i,
      i || ' apples'])[(i + doc_id) % 8 + 1] AS said
    FROM (SELECT *, ({ROMANS})[i % {len(ROMANS)} + 1] AS r FROM doc_lines))"""
ROMAN = "(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
add(
    "page_label",
    lambda s, d: _labels(s, d).select("doc_id", "i", "said", T.page_label(F.col("said")).alias("label")),
    f"WITH {L.PARAS}, {SAID}"
    + rf""" SELECT doc_id, i, said, lower(nullif(regexp_extract(trim(said),
      '(?i)^[\s\-–—|·.]*(?:page\s+|p\.\s*)?(\d{{1,4}}|{ROMAN})(?:\s*(?:of|/)\s*(?:\d{{1,4}}|{ROMAN}))?[\s\-–—|·.]*$', 1), '')) AS label
    FROM said""",
)
add(
    "roman_value",
    lambda s, d: _labels(s, d).where(F.col("said").rlike("(?i)^[ivxlc]+$")).select(
        "doc_id", "i", T.roman_value(F.col("said")).alias("value")
    ),
    f"WITH {L.PARAS}, {SAID}"
    + """, digits AS (
      SELECT doc_id, i, unnest(string_split(lower(said), '')) AS c, generate_subscripts(string_split(said, ''), 1) AS k
      FROM said WHERE regexp_matches(said, '(?i)^[ivxlc]+$')),
    valued AS (SELECT *, CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 END AS v FROM digits),
    signed AS (SELECT *, CASE WHEN v < coalesce(lead(v) OVER (PARTITION BY doc_id, i ORDER BY k), 0) THEN -v ELSE v END AS sv FROM valued)
    SELECT doc_id, i, sum(sv)::BIGINT AS value FROM signed GROUP BY doc_id, i""",
)
add(
    "printed_value",
    over_lines(lambda t, marker, first_word: dict(value=T.printed_value(marker["role"], marker["marker"]))),
    L.with_lines(
        f"""SELECT {KEY}, {L.printed_value("role", "marker")} AS value FROM (
          SELECT *, trim({L.head("text", "role")}) AS marker FROM (SELECT *, {L.role("text")} AS role FROM lines))"""
    ),
)
add(
    "wording",
    over_lines(lambda t, marker, first_word: dict(key=T.wording(t))),
    L.with_lines(
        rf"""SELECT {KEY}, CASE WHEN regexp_matches(k, '\p{{L}}') THEN k ELSE '' END AS key FROM (
          SELECT *, trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS k FROM lines)"""
    ),
)
add("printed", over_lines(lambda t, marker, first_word: dict(said=T.printed(marker["marker"], marker["rest"]))), L.with_lines(f"""SELECT {KEY},
    CASE WHEN m <> '' THEN m || ' ' || trim(substr(text, length(mh) + 1)) ELSE text END AS said FROM (
      SELECT *, trim(mh) AS m FROM (SELECT *, {L.head("text", "role")} AS mh FROM (SELECT *, {L.role("text")} AS role FROM lines)))"""))
add(
    "in_margin",
    over_lines(lambda t, marker, first_word: dict(margin=G.in_margin(F.col("box"), F.lit(V.PAGE_H)))),
    L.with_lines(f"SELECT {KEY}, y + h <= 792.0::DOUBLE * 0.12::DOUBLE OR y >= 792.0::DOUBLE - 792.0::DOUBLE * 0.12::DOUBLE AS margin FROM lines"),
)
add(
    "page_number_of",
    over_lines(lambda t, marker, first_word: dict(label=F.when(G.in_margin(F.col("box"), F.lit(V.PAGE_H)), T.page_label(t)))),
    L.with_lines(rf"""SELECT {KEY}, CASE WHEN y + h <= 95 OR y >= 697 THEN
      lower(nullif(regexp_extract(text, '(?i)^(?:page\s+|p\.\s*)?(\d{{1,4}}|{ROMAN})$', 1), '')) END AS label FROM lines"""),
)


def _pairs(s, d):
    """Each line beside the next one of its page."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    return V.layout_lines(s, d).withColumn("b", F.lead("box").over(w)).where("b is not null")


def _box_algebra(s, d):
    a, b = F.col("box"), F.col("b")
    u = G.rounded(G.union(a, b))
    return _pairs(s, d).select(
        "doc_id", "page", "line_no", *[u[k].alias(f"u{k}") for k in "xywh"], G.overlap_x(a, b).alias("ox"),
        G.overlap_y(a, b).alias("oy"), G.touches(a, b).alias("touches"),
    )


add(
    "box_algebra",
    _box_algebra,
    L.with_lines(
        f"""SELECT {KEY}, floor(least(x, bx) * 100 + 0.5) / 100 AS ux, floor(least(y, b_y) * 100 + 0.5) / 100 AS uy,
          floor((greatest(x + w, bx + bw) - least(x, bx)) * 100 + 0.5) / 100 AS uw,
          floor((greatest(y + h, b_y + bh) - least(y, b_y)) * 100 + 0.5) / 100 AS uh,
          least(x + w, bx + bw) - greatest(x, bx) AS ox, least(y + h, b_y + bh) - greatest(y, b_y) AS oy,
          x <= bx + bw AND bx <= x + w AND y <= b_y + bh AND b_y <= y + h AS touches
        FROM (SELECT *, lead(x) OVER o AS bx, lead(y) OVER o AS b_y, lead(w) OVER o AS bw, lead(h) OVER o AS bh FROM lines
          WINDOW o AS (PARTITION BY doc_id, page ORDER BY line_no)) WHERE bx IS NOT NULL"""
    ),
)
add(
    "same_style",
    lambda s, d: _same_style(s, d),
    L.with_lines(
        f"""SELECT {KEY}, abs(size - s2) <= 0.6 AND bold = b2 AS same FROM (
          SELECT *, lead(size) OVER o AS s2, lead(bold) OVER o AS b2 FROM lines
          WINDOW o AS (PARTITION BY doc_id, page ORDER BY line_no)) WHERE s2 IS NOT NULL"""
    ),
)


def _same_style(s, d):
    from pyspark.sql import Window

    from quire.operators.structure import same_style

    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    two = V.layout_lines(s, d).withColumn("s2", F.lead("size").over(w)).withColumn("b2", F.lead("bold").over(w))
    return two.where("s2 is not null").select(
        "doc_id", "page", "line_no", same_style(F.col("size"), F.col("bold"), F.col("s2"), F.col("b2")).alias("same")
    )


# ---- markdown ---------------------------------------------------------------

add("escape_md", over_lines(lambda t, marker, first_word: dict(md=T.escape_md(t))), L.with_lines(f"SELECT {KEY}, {L.escaped('text')} AS md FROM lines"))
add(
    "heading_md",
    over_lines(lambda t, marker, first_word: dict(md=T.heading_md(F.col("line_no") % 9, t))),
    L.with_lines(
        f"""SELECT {KEY}, repeat('#', (CASE WHEN line_no % 9 = 0 THEN 2 ELSE least(line_no % 9, 6) END)::INT) || ' ' || text AS md FROM lines"""
    ),
)
add(
    "comment_md",
    over_lines(lambda t, marker, first_word: dict(md=T.comment_md(F.concat(t, F.lit(" --> "), t)))),
    L.with_lines(f"SELECT {KEY}, '<!-- ' || replace(text || ' --> ' || text, '-->', '-- >') || ' -->' AS md FROM lines"),
)
add(
    "inline_md",
    over_lines(lambda t, marker, first_word: dict(
        md=T.inline_md(
            F.when(F.col("line_no") % 5 == 0, "heading").otherwise("para"),
            F.concat(t, F.when(F.col("line_no") % 3 == 0, " ##").otherwise("")),
            F.when(F.col("line_no") % 4 == 0, F.lit("http://e.com/a (b)")),
            F.col("bold"),
            F.col("italic"),
        )
    )),
    L.with_lines(
        rf"""SELECT {KEY}, CASE WHEN hd THEN l ELSE CASE WHEN italic THEN '*' ELSE '' END || CASE WHEN bold THEN '**' ELSE '' END || l
          || CASE WHEN bold THEN '**' ELSE '' END || CASE WHEN italic THEN '*' ELSE '' END END AS md FROM (
          SELECT *, CASE WHEN line_no % 4 = 0 THEN '[' || e || '](http://e.com/a%20%28b%29)' ELSE e END AS l FROM (
            SELECT *, CASE WHEN hd THEN regexp_replace(e0, '(\s)(#+)$', '\1\\\2') ELSE e0 END AS e FROM (
              SELECT *, line_no % 5 = 0 AS hd, {L.escaped("said")} AS e0 FROM (
                SELECT *, text || CASE WHEN line_no % 3 = 0 THEN ' ##' ELSE '' END AS said FROM lines))))"""
    ),
)
add(
    "link_target",
    lambda s, d: V.table(s, d, "pages").select(
        "page_id", T.link_target(F.concat(F.col("url"), F.lit(" (a\\b) <"), F.lit("\t"), F.col("page_id").cast("string"))).alias("target")
    ),
    """SELECT page_id, replace(replace(replace(replace(replace(replace(url || ' (a\\b) <' || chr(9) || page_id, ' ', '%20'), '(', '%28'), ')', '%29'),
      '\\', '%5C'), '<', '%3C'), chr(9), '%09') AS target FROM pages""".replace("\\\\", "\\"),
)
add(
    "figure_md",
    lambda s, d: V.layout_pictures(s, d).select(
        "doc_id",
        "page",
        "pic_no",
        T.figure_md(
            F.col("page"), F.col("pic_no"), F.lit("my doc.assets/"),
            F.when(F.col("px_w") > 8, T.figure_name(F.col("page"), F.col("pic_no"))),
        ).alias("md"),
    ),
    "WITH " + L.LINES + L.PAGES + L.PICTURES + """ SELECT doc_id, page, pic_no, CASE WHEN px_w > 8 THEN
      '![page ' || page || ' figure ' || (pic_no + 1) || '](my%20doc.assets/p' || page || '-i' || pic_no || '.png)' END AS md
      FROM raw_pictures""",
)

# ---- letters ----------------------------------------------------------------

add(
    "letters_and_words",
    over_lines(lambda t, marker, first_word: dict(letters=F.size(T.letters_of(t)), words=F.array_join(T.words_of(t), "|"))),
    L.with_lines(
        rf"""SELECT {KEY}, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]')) AS letters,
          coalesce(array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), '|'), '') AS words FROM lines"""
    ),
)
add(
    "plain",
    lambda s, d: V.table(s, d, "documents").select("doc_id", T.plain(F.col("text")).alias("plain")),
    r"""SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g') AS plain FROM documents""",
)


def _hrefs(s, d):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    schemes = F.array(*[F.lit(x) for x in ("", "https://x.org", "javascript:", "mailto:a@b", "data:x", "IRCS:", "?q=a:b", "#a:")])
    made = F.concat(F.element_at(schemes, (F.col("k") % 8 + 1).cast("int")), F.col("href"))
    return (
        V.table(s, d, "pages")
        .select("page_id", "url", F.posexplode(hrefs).alias("k", "href"))
        .select("page_id", "k", made.alias("href"))
    )


add(
    "safe_url",
    lambda s, d: _hrefs(s, d).select("page_id", "k", "href", T.safe_url(F.col("href")).alias("safe")),
    """WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages),
    e AS (SELECT page_id, unnest(hs) AS x, generate_subscripts(hs, 1) - 1 AS k FROM h),
    m AS (SELECT page_id, k, (['', 'https://x.org', 'javascript:', 'mailto:a@b', 'data:x', 'IRCS:', '?q=a:b', '#a:'])[k % 8 + 1] || x AS href FROM e)
    SELECT page_id, k, href, CASE WHEN instr(href, ':') = 0
      OR regexp_matches(href, '^[^:]*[/?#]') OR regexp_matches(href, '(?i)^(https?|ircs?|mailto|xmpp):') THEN href ELSE '' END AS safe
    FROM m""",
)
add(
    "is_comment",
    lambda s, d: V.table(s, d, "pages")
    .select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<!--.*?-->|<[a-z][^>]*>"), F.lit(0))).alias("k", "tag"))
    .select("page_id", "k", T.is_comment(F.col("tag")).alias("comment"), T.is_comment(F.concat("tag", "tag")).alias("twice")),
    """WITH h AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<[a-z][^>]*>') AS ts FROM pages)
    SELECT page_id, generate_subscripts(ts, 1) - 1 AS k, starts_with(unnest(ts), '<!--') AS comment, false AS twice FROM h""",
)
add(
    "text_size",
    lambda s, d: V.table(s, d, "documents").select("doc_id", M.text_size(F.col("text")).alias("m")).select("doc_id", "m.*"),
    """SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END AS lines,
      strlen(text) AS bytes, floor(length(text) / 4 + 0.5)::BIGINT AS tokens FROM documents""",
)
add(
    "may_hold_gfm",
    lambda s, d: V.table(s, d, "documents").select("doc_id", F.array_join(M.may_hold_gfm(F.col("text")), ",").alias("gfm")),
    r"""SELECT doc_id, array_to_string(list_filter([
      CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t>|:-]+$') AND contains(x, '|') AND contains(x, '-'))) > 0 THEN 'tables' END,
      CASE WHEN regexp_matches(text, '(^|[^\\])(\\\\)*~') THEN 'strikethrough' END,
      CASE WHEN regexp_matches(text, '(^|[^\\])(\\\\)*\[\^') THEN 'footnotes' END,
      CASE WHEN regexp_matches(text, '(^|[^\\])(\\\\)*\[[ xX]\]') THEN 'task lists' END,
      CASE WHEN regexp_matches(text, '(?i)https?://|www\.|\S@\S+\.\S') THEN 'bare links' END], lambda x: x IS NOT NULL), ',') AS gfm FROM documents""",
)
add(
    "rendered_text",
    over_lines(lambda t, marker, first_word: dict(shown=T.rendered_text(F.concat(F.lit("## "), T.escape_md(t))), same=F.lit(True))),
    L.with_lines(f"SELECT {KEY}, text AS shown, true AS same FROM lines"),
)

# ---- paths ------------------------------------------------------------------


def files(s, d):
    """documents as uploaded files: a path of folders, a name, an extension."""
    doc = V.table(s, d, "documents")
    k = F.col("doc_id")
    folder = F.element_at(
        F.array(*[F.lit(x) for x in FOLDERS]), (k % len(FOLDERS) + 1).cast("int")
    )
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTS]), (k % len(EXTS) + 1).cast("int"))
    return doc.select("doc_id", F.concat(folder, "lang", F.lit("/"), "source", F.lit(" No."), k.cast("string"), ext).alias("path"))


FOLDERS = ["", "a/b.pdf/", "__MACOSX/x/", ".cache/", "../up//", "My Docs & more/", "c\\d/", "x--y/.git/", "w1/sources/"]
EXTS = [".pdf", ".PDF", ".zip", ".md", "/manifest.json", ".tar.gz", "/._n.pdf"]
FILES = f"""files AS (SELECT doc_id, ({FOLDERS})[doc_id % {len(FOLDERS)} + 1] || lang || '/' || source || ' No.' || doc_id
    || ({EXTS})[doc_id % {len(EXTS)} + 1] AS path FROM documents)""".replace("\\\\", "\\")
add(
    "path_policy",
    lambda s, d: files(s, d).select(
        "doc_id", "path", P.is_pdf(F.col("path")).alias("pdf"), P.is_zip(F.col("path")).alias("zip"), P.is_manifest(F.col("path")).alias("manifest"), P.is_junk(F.col("path")).alias("junk")
    ),
    f"WITH {FILES}" + r""" SELECT doc_id, path, lower(path) LIKE '%.pdf' AS pdf, lower(path) LIKE '%.zip' AS zip,
      parts[-1] = 'manifest.json' AS manifest, list_contains(parts, '__MACOSX') OR len(list_filter(parts[1:-2], lambda x: x LIKE '.%')) > 0
        OR parts[-1] LIKE '.\_%' ESCAPE '\' OR parts[-1] IN ('.DS_Store', 'Thumbs.db') AS junk
      FROM (SELECT *, string_split(path, '/') AS parts FROM files)""",
)
SEG = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}._ -]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^[ .]+|[ .]+$', '', 'g')"""


def seg(x):
    return "coalesce(nullif(" + SEG.format(x=x) + ", ''), 'untitled')"


FOLD = rf"""CASE WHEN regexp_matches({seg('x')}, '(?i)\.(pdf|md|assets)$')
  THEN regexp_replace(regexp_replace({seg('x')}, '\.(\w+)$', '-\1'), '-{{2,}}', '-', 'g') ELSE {seg('x')} END"""
NAMES = r"""list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x NOT IN ('', '.', '..'))"""
add(
    "path_cleaning",
    lambda s, d: files(s, d).select(
        "doc_id", P.normalize_path(F.col("path")).alias("normal"), P.clean_path(F.col("path")).alias("folder"), P.clean_id(F.col("path")).alias("id"),
        P.is_doc_id(F.col("path")).alias("is_id"), P.is_doc_id(P.clean_id(F.col("path"))).alias("fixed"),
    ),
    f"WITH {FILES}, n AS (SELECT *, {NAMES} AS ns FROM files), c AS (SELECT doc_id, path, array_to_string(ns, '/') AS normal,"
    + f" array_to_string(list_transform(ns, lambda x: {FOLD}), '/') AS folder,"
    + f" array_to_string(list_concat(list_transform(ns[:-2], lambda x: {FOLD}), list_transform(ns[-1:], lambda x: {seg('x')})), '/') AS id FROM n)"
    + " SELECT doc_id, normal, folder, id, id = path AND path <> '' AS is_id, true AS fixed FROM c",
)
SLUG = r"""coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'doc')"""
STEM = r"""CASE WHEN base LIKE '.%' AND NOT contains(substr(base, 2), '.') THEN CASE WHEN lower(base) = '.pdf' THEN '' ELSE base END
  WHEN contains(base, '.') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END"""
add(
    "id_derivation",
    lambda s, d: files(s, d).select(
        "doc_id", P.stem(F.col("path")).alias("stem"), P.slug(F.col("path")).alias("slug"), P.doc_id_for(F.col("path"), F.lit("in/tray")).alias("id"),
        P.renamed_id(P.clean_id(F.col("path")), F.concat(F.lit(" New name/"), F.col("doc_id").cast("string"), F.lit(".PDF "))).alias("renamed"),
    ),
    f"WITH {FILES}, n AS (SELECT *, {NAMES} AS ns, string_split(path, '/')[-1] AS base FROM files),"
    + f" c AS (SELECT *, array_to_string(list_transform(list_concat(['in', 'tray'], ns[:-2]), lambda x: {FOLD}), '/') AS f,"
    + f" array_to_string(list_transform(ns[:-2], lambda x: {FOLD}), '/') AS home, {STEM} AS st FROM n)"
    + f" SELECT doc_id, st AS stem, {SLUG.format(x='path')} AS slug, f || '/' || {SLUG.format(x='st')} AS id,"
    + " CASE WHEN home = '' THEN '' ELSE home || '/' END || 'new-name-' || doc_id AS renamed FROM c",
)
add(
    "workspace_names",
    lambda s, d: V.table(s, d, "documents").select(
        "doc_id",
        P.clean_name(F.col("text")).alias("name"),
        P.export_name(F.concat_ws(" ", "source", "lang"), F.col("doc_id") % 2 == 0, F.lit("2026-10-23").cast("date")).alias("export"),
        P.exported_name(F.concat("source", F.lit("-project-2026-10-23"))).alias("back"),
    ),
    f"""SELECT doc_id, nullif(trim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80)), '') AS name,
      {seg("concat_ws(' ', source, lang)")} || '-' || CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'project' END || '-2026-10-23.zip' AS export,
      source AS back FROM documents""",
)
add(
    "phrases",
    lambda s, d: V.table(s, d, "documents").select(
        "doc_id", W.human(F.col("n_chars") * F.col("n_chars") * F.col("doc_id")).alias("size"), W.few(F.split("text", " ")).alias("few"),
        W.plural(F.col("doc_id") % 3, "page").alias("pages"),
    ),
    """SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' ELSE CASE WHEN v < 10 THEN printf('%.1f', floor(v * 10 + 0.5) / 10)
          ELSE printf('%d', floor(v + 0.5)::BIGINT) END || CASE WHEN b < 1048576 THEN ' KB' WHEN b < 1073741824 THEN ' MB' ELSE ' GB' END END AS size,
      array_to_string(w[1:3], ', ') || CASE WHEN len(w) > 3 THEN ' and ' || (len(w) - 3) || ' more' ELSE '' END AS few,
      (doc_id % 3) || ' page' || CASE WHEN doc_id % 3 = 1 THEN '' ELSE 's' END AS pages
    FROM (SELECT *, b / CASE WHEN b < 1048576 THEN 1024.0 WHEN b < 1073741824 THEN 1048576.0 ELSE 1073741824.0 END AS v FROM (
      SELECT *, n_chars * n_chars * doc_id AS b, string_split(text, ' ') AS w FROM documents))""",
)

# ---- runs as an extractor gives them ----------------------------------------


def raw_runs(s, d):
    """The layout's words as raw pieces: names with subset prefixes, stray
    spaces, lone glyphs in a picture face, control characters."""
    runs = V.layout_runs(s, d)
    k = F.col("run_no") % 7
    raw = (
        F.when(k == 1, F.concat(F.lit("  "), "text"))
        .when(k == 2, F.concat("text", F.lit("\t ")))
        .when(k == 3, F.lit("§"))
        .when(k == 4, F.lit("   "))
        .when(k == 5, F.concat("text", F.char(F.lit(7)), F.lit("x")))
        .otherwise(F.col("text"))
    )
    font = F.when(k == 3, "ABCDEF+Wingdings").when(k == 5, "Q+Times-BoldItalic").otherwise(F.col("font"))
    return runs.withColumns({"text": raw, "font": font, "size": F.when(k == 6, 0.0).otherwise(F.col("size"))})


RUNS = """, word_runs AS (
  SELECT doc_id, page, line_no, size, bold, italic, unnest(string_split(text, ' ')) AS word,
    generate_subscripts(string_split(text, ' '), 1) - 1 AS k0 FROM lines),
raw_runs AS (
  SELECT *, line_no * 1000 + k0 AS run_no, (line_no * 1000 + k0) % 7 AS k, CASE WHEN bold THEN 'Body-Bold' ELSE 'Body' END AS face
  FROM word_runs WHERE word <> '')"""
add(
    "clean_runs",
    lambda s, d: R.clean_runs(raw_runs(s, d)).select("doc_id", "page", "run_no", "text", "lead", "trail", "font", "bold", "italic"),
    "WITH " + L.LINES + L.PAGES + RUNS + """ SELECT doc_id, page, run_no,
      CASE k WHEN 3 THEN '•' WHEN 5 THEN word || chr(65533) || 'x' ELSE word END AS text, k = 1 AS lead, k = 2 AS trail,
      CASE k WHEN 3 THEN 'Wingdings' WHEN 5 THEN 'Times-BoldItalic' ELSE face END AS font,
      bold OR k = 5 OR face LIKE '%Bold%' AND k <> 3 AS bold, italic OR k = 5 AS italic FROM raw_runs WHERE k NOT IN (4, 6)""",
)
FONTS = ["ABCDEF+Helvetica-Bold", "HelveticaNeueLTW1G-BdIt", "Arial-Black", "Times-Italic", "Courier+Oblique", "Plain"]
add(
    "font_facts",
    lambda s, d: V.doc_lines(s, d)
    .withColumn("name", F.element_at(F.array(*[F.lit(x) for x in FONTS]), (F.col("i") % 6 + 1).cast("int")))
    .select("doc_id", "i", R.font_facts(F.col("name"), F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0).alias("f"))
    .select("doc_id", "i", "f.*"),
    f"""WITH {L.PARAS}, n AS (SELECT doc_id, i, regexp_replace(({FONTS})[i % 6 + 1], '^[^+]*\\+', '') AS font FROM doc_lines)
    SELECT doc_id, i, font, doc_id % 7 = 0 OR regexp_matches(font, '(?i)bold|black|heavy|-bd') AS bold,
      doc_id % 11 = 0 OR regexp_matches(font, '(?i)italic|oblique|-it') AS italic FROM n""",
)


def _run_boxes(s, d):
    """Each word of the layout set by a matrix: upright, turned, or condensed."""
    runs = V.layout_runs(s, d)
    k = F.col("run_no") % 3
    size = F.col("size")
    zero = F.lit(0.0)
    x, y = F.col("box.x"), F.lit(V.PAGE_H) - F.col("base")
    matrix = (
        F.when(k == 0, F.array(size, zero, zero, size, x, y))
        .when(k == 1, F.array(zero, size, -size, zero, x, y))
        .otherwise(F.array(size * 0.5, zero, zero, size, x, y))
    )
    r = R.run_box(
        F.col("text"), F.col("font"), matrix, F.col("box.w"), size, F.lit(False), F.lit(0.0), F.lit(0.0), F.lit(V.PAGE_H)
    )
    return runs.withColumn("r", r).select(
        "doc_id", "page", "run_no", *[F.round(F.col(f"r.box.{c}"), 6).alias(c) for c in "xywh"], F.col("r.base").alias("base"),
        F.col("r.size").alias("size"),
    )


add(
    "run_boxes",
    _run_boxes,
    "WITH " + L.LINES + L.PAGES + """, sized AS (
      SELECT doc_id, page, line_no, size, x AS lx, y + h AS base, CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS u,
        string_split(text, ' ') AS ws FROM lines),
    words AS (SELECT doc_id, page, line_no, size, lx, base, u, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS k0, ws FROM sized),
    runs AS (
      SELECT *, line_no * 1000 + k0 AS run_no, lx + u * length(array_to_string(ws[1:k0], ' ') || CASE WHEN k0 > 0 THEN ' ' ELSE '' END) AS x,
        u * length(word) AS w, regexp_matches(word, '[A-Z0-9bdfhklt|/\\\\()\\[\\]{}!?"''*#$&@£€%]') AS tall,
        regexp_matches(word, '[acemnorsuvwxz]') AS low, regexp_matches(word, '[gjpqy()\\[\\]{}/|\\\\,;_@JQ]') AS down FROM words WHERE word <> ''),
    inked AS (
      SELECT *, CASE WHEN NOT (tall OR low) THEN size * ((0.9 + -0.21) / 2 - (0.9 - -0.21) / 4) WHEN down THEN size * -0.22 ELSE 0.0 END AS lo,
        CASE WHEN NOT (tall OR low) THEN size * ((0.9 + -0.21) / 2 + (0.9 - -0.21) / 4) WHEN tall THEN 0.7 * size ELSE 0.5 * size END AS hi
      FROM runs)
    SELECT doc_id, page, run_no, round(CASE WHEN run_no % 3 = 1 THEN x - hi ELSE x END, 6) AS x,
      round(CASE WHEN run_no % 3 = 1 THEN base - w ELSE base - hi END, 6) AS y,
      round(CASE WHEN run_no % 3 = 1 THEN hi - lo ELSE w END, 6) AS w,
      round(CASE WHEN run_no % 3 = 1 THEN w ELSE hi - lo END, 6) AS h, base, size FROM inked""",
)
