"""The table views of quire.plans.views as ANSI SQL with CTEs, and what the page
operators must give on them."""

PARAS = """
doc_paras AS (
  SELECT doc_id, source, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS para
  FROM (SELECT doc_id, source,
          list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS ps
        FROM documents)),
doc_chunks AS (
  SELECT doc_id, source, para, unnest(range(0, (len(w) + 11) // 12)) AS k, w
  FROM (SELECT doc_id, source, para, string_split_regex(trim(p), ' +') AS w FROM doc_paras)),
doc_lines AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY para, k) - 1 AS i,
    para, k, array_to_string(w[12 * k + 1 : 12 * k + 12], ' ') AS raw, len(w) > 12 AS wraps
  FROM doc_chunks)"""

LINES = (
    PARAS
    + """,
dressed AS (
  SELECT *, (doc_id * 5 + para * 7) % 20 AS m, i // 30 + 1 AS page, i % 30 AS slot, doc_id % 4 = 0 AS two
  FROM doc_lines),
body_lines AS (
  SELECT doc_id, page, slot + 1 AS line_no, two,
    CASE WHEN k > 0 THEN ''
      WHEN m BETWEEN 3 AND 5 THEN (para % 9 + 1)::VARCHAR || '. '
      WHEN m BETWEEN 6 AND 7 THEN '• '
      WHEN m = 8 THEN '(' || chr((97 + para % 26)::INT) || ') '
      WHEN m = 9 THEN (['i','ii','iii','iv','v','vi','ix','x'])[para % 8 + 1] || '. '
      ELSE '' END
    || CASE WHEN m = 11 AND wraps AND k = 1 THEN 'ple ' ELSE '' END || raw
    || CASE WHEN m = 11 AND wraps AND k = 0 THEN ' exam-'
         WHEN m = 12 AND k = 0 AND doc_id % 3 = 0 THEN ' exam-ple' ELSE '' END AS text,
    (CASE WHEN i = 0 THEN 16 WHEN m = 0 AND k = 0 THEN 13 ELSE 10 END)::DOUBLE AS size,
    (CASE WHEN two AND slot >= 15 THEN 336 ELSE 72 END
      + CASE WHEN m BETWEEN 3 AND 9 THEN para % 3 * 18 + CASE WHEN k > 0 THEN 14 ELSE 0 END ELSE 0 END)::DOUBLE AS x,
    (100 + 18 * CASE WHEN two THEN slot % 15 ELSE slot END + CASE WHEN k = 0 THEN 4 ELSE 0 END)::DOUBLE AS y,
    m = 10 AS bold, m = 14 AS italic
  FROM dressed),
sheets AS (SELECT doc_id, page, min(source) AS source FROM dressed GROUP BY doc_id, page),
lines AS (
  SELECT doc_id, page, line_no, text, size, x, y,
    greatest(length(text) * CASE WHEN two THEN 0.5 ELSE 1.0 END, 120.0)::DOUBLE AS w, size AS h, bold, italic
  FROM body_lines
  UNION ALL
  SELECT doc_id, page, 0, 'Notes of ' || source || ' part ' || page, 10.0, 72.0, 30.0, 200.0, 10.0, false, false FROM sheets
  UNION ALL
  SELECT doc_id, page, 31, 'Page ' || page, 10.0, 72.0, 760.0, 200.0, 10.0, false, false FROM sheets)"""
)

# Two runs a line, the gap between them judged by the lines around.
GUTTERS = (
    PARAS
    + """,
split_lines AS (
  SELECT doc_id, i // 30 + 1 AS page, i % 30 AS slot, string_split(raw, ' ') AS ws, (60 + 12 * (i % 30))::DOUBLE AS y,
    CASE WHEN doc_id % 3 = 2 AND i % 9 = 4 THEN 14.0 ELSE 10.0 END::DOUBLE AS size,
    (CASE WHEN doc_id % 3 = 1 OR (doc_id % 3 = 2 AND i // 7 % 2 = 1) THEN 90 + i * 37 % 160 ELSE 160 END)::DOUBLE AS w,
    0.8::DOUBLE + i % 4 * 0.5::DOUBLE AS wide, (200 - i % 5 * 40)::DOUBLE AS right_w, i % 8 = 7 AS short
  FROM doc_lines),
two AS (
  SELECT doc_id, page, slot, y, size, 72.0::DOUBLE AS x, w, len(ws) >= 2 AND NOT short AS has_right,
    array_to_string(ws[1 : (len(ws) + 1) // 2], ' ') AS text, 72 + w + size * wide AS right_x, right_w,
    array_to_string(ws[(len(ws) + 1) // 2 + 1 :], ' ') AS right_text, size * 0.8::DOUBLE AS h
  FROM split_lines),
gaps AS (
  SELECT *, right_x - (x + w) AS gap, has_right AND right_x - (x + w) > 0.6 * h AND right_x - (x + w) <= 2.5 * size AS asked FROM two),
strips AS (
  SELECT doc_id, page, slot, y, size, 0 AS half, x + w + 0.15 * size AS lo, (x + w + right_x) / 2 AS hi FROM gaps WHERE asked
  UNION ALL SELECT doc_id, page, slot, y, size, 1, (x + w + right_x) / 2, right_x - 0.15 * size FROM gaps WHERE asked),
around AS (
  SELECT s.doc_id, s.page, s.slot, s.half, k.slot > s.slot AS below, abs(k.slot - s.slot) AS off,
    NOT (k.x < s.hi AND k.x + k.w > s.lo) AND NOT (k.has_right AND k.right_x < s.hi AND k.right_x + k.right_w > s.lo) AS free
  FROM strips s JOIN two k ON k.doc_id = s.doc_id AND k.page = s.page AND k.slot <> s.slot AND abs(k.y - s.y) <= 5 * s.size
    AND greatest(k.size, s.size) <= 1.25 * least(k.size, s.size)
    AND (k.x < s.lo OR (k.has_right AND k.right_x < s.lo)) AND (k.x + k.w > s.hi OR (k.has_right AND k.right_x + k.right_w > s.hi))),
nearest AS (SELECT * FROM around QUALIFY row_number() OVER (PARTITION BY doc_id, page, slot, half, below ORDER BY off) <= 3),
sides AS (
  SELECT doc_id, page, slot, half, below, count(*) AS n, count(*) FILTER (free) AS c FROM nearest GROUP BY ALL),
said AS (
  SELECT doc_id, page, slot, slot * 2 + 1 AS run_no, half, coalesce(sum(c), 0)::INT AS clear, coalesce(sum(n - c), 0)::INT AS inked,
    coalesce(bool_or(n = 3 AND c = 3), false) AS side
  FROM strips LEFT JOIN sides USING (doc_id, page, slot, half) GROUP BY doc_id, page, slot, half),
verdict AS (
  SELECT doc_id, page, slot, NOT bool_or(side OR (clear >= 3 AND clear > inked)) AND bool_or(inked > 0) AS is_space
  FROM said GROUP BY doc_id, page, slot),
judged AS (
  SELECT g.*, NOT has_right OR gap <= 0.6 * h OR coalesce(is_space, false) AS joins
  FROM (SELECT * REPLACE (CASE WHEN has_right THEN right_text ELSE '' END AS right_text, CASE WHEN has_right THEN right_x ELSE x + w END AS right_x,
    CASE WHEN has_right THEN right_w ELSE 0 END AS right_w) FROM gaps) g LEFT JOIN verdict USING (doc_id, page, slot))"""
)

BULLETS = "■□▪▫●○◦•‣⁃◆◇❏❑❒❘❙❚❖➥"


def role(c: str) -> str:
    return f"""CASE
      WHEN regexp_extract({c}, '^(?:[{BULLETS}]\\s*|[\\-–—·*]\\s+)') <> ''
        AND length(regexp_extract({c}, '^(?:[{BULLETS}]\\s*|[\\-–—·*]\\s+)')) < length({c}) THEN 'bullet'
      WHEN regexp_matches({c}, '^\\(?(\\d{{1,3}})[.)]\\s+') THEN 'numbered'
      WHEN regexp_extract({c}, '(?i)^\\(?(x{{0,3}}(?:ix|iv|v?i{{0,3}}))[.)]\\s+', 1) <> '' THEN 'roman'
      WHEN regexp_matches({c}, '^\\(?([a-zA-Z])[.)]\\s+') THEN 'alpha' ELSE '' END"""


def head(c: str, r: str) -> str:
    return f"""CASE {r} WHEN 'bullet' THEN regexp_extract({c}, '^(?:[{BULLETS}]\\s*|[\\-–—·*]\\s+)')
      WHEN 'numbered' THEN regexp_extract({c}, '^\\(?\\d{{1,3}}[.)]\\s+')
      WHEN 'roman' THEN regexp_extract({c}, '(?i)^\\(?x{{0,3}}(?:ix|iv|v?i{{0,3}})[.)]\\s+')
      WHEN 'alpha' THEN regexp_extract({c}, '^\\(?[a-zA-Z][.)]\\s+') ELSE '' END"""


FACTS = """,
sizes AS (SELECT doc_id, floor(size * 10 + 0.5) / 10 AS size, sum(length(text)) AS n, min(page * 1000 + line_no) AS seen_at
          FROM lines GROUP BY 1, 2),
facts AS (
  SELECT doc_id, (SELECT s.size FROM sizes s WHERE s.doc_id = l.doc_id ORDER BY n DESC, seen_at LIMIT 1) AS body_size,
    sum(CASE WHEN bold THEN length(text) ELSE 0 END) / sum(length(text)) AS bold_fraction
  FROM lines l GROUP BY doc_id)"""

CLASSED = (
    LINES
    + FACTS
    + f""",
marked AS (SELECT *, {role("text")} AS mrole FROM lines),
classed AS (
  SELECT l.*, length(trim(text)) BETWEEN 1 AND 90 AND mrole = '' AND (size >= body_size * 1.1
      OR (bold_fraction < 0.35 AND bold AND size >= body_size AND NOT regexp_matches(trim(text), '[.,;]$'))) AS heading
  FROM marked l JOIN facts USING (doc_id)),
ordered AS (
  SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph,
    lag(size) OVER o AS ps, lag(bold) OVER o AS pb, lag(heading) OVER o AS phead,
    row_number() OVER o AS pos
  FROM classed WINDOW o AS (PARTITION BY doc_id, page ORDER BY x >= 336, y, x)),
opened AS (
  SELECT *, NOT coalesce(
      y - (py + ph) BETWEEN -0.5 * greatest(ph, h, 1) AND 1.1 * greatest(ph, h, 1)
      AND least(px + pw, x + w) - greatest(px, x) > 0
      AND abs(ps - size) <= 0.6 AND pb = bold AND mrole = '' AND heading = phead, false) AS opens
  FROM ordered),
grouped AS (
  SELECT *, (sum(opens::INT) OVER (PARTITION BY doc_id, page ORDER BY pos) - 1)::INT AS grp FROM opened),
compound_docs AS (SELECT DISTINCT doc_id FROM lines WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}-])exam-ple($|[^\\p{{L}}-])')),
gathered AS (
  SELECT doc_id, page, grp, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b,
    bool_and(bold) AS bold, bool_and(italic) AS italic, bool_and(heading) AS heading,
    arg_min(text, pos) AS first_text, arg_min(mrole, pos) AS mrole, arg_min(size, pos) AS size, arg_min(h, pos) AS first_h,
    string_agg(text, ' ' ORDER BY pos) AS joined, count(*) AS n_lines
  FROM grouped GROUP BY doc_id, page, grp),
heads AS (SELECT *, {head("first_text", "mrole")} AS mhead FROM gathered),
texted AS (
  SELECT h.*, trim(mhead) AS marker,
    trim(replace(trim(substr(joined, length(mhead) + 1)), 'exam- ple ',
      CASE WHEN c.doc_id IS NULL THEN 'example ' ELSE 'exam-ple ' END)) AS text,
    CASE WHEN mrole <> '' THEN mrole WHEN heading THEN 'heading' ELSE 'para' END AS role0
  FROM heads h LEFT JOIN compound_docs c USING (doc_id)),
heading_sizes AS (
  SELECT doc_id, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS level
  FROM (SELECT DISTINCT doc_id, size FROM texted WHERE role0 = 'heading')),
item_depth AS (
  SELECT doc_id, page, grp, dense_rank() OVER (PARTITION BY doc_id, page, x >= 336 ORDER BY floor(x + 0.5)) - 1 AS d
  FROM texted WHERE mrole <> ''),
nested AS (
  SELECT t.*, d.d, lag(mrole) OVER o AS lrole, lag(x) OVER o AS lx, lag(b) OVER o AS lb, lag(size) OVER o AS lsize,
    lag(d.d) OVER o AS ld
  FROM texted t LEFT JOIN item_depth d USING (doc_id, page, grp)
  WINDOW o AS (PARTITION BY doc_id, page ORDER BY grp)),
detailed AS (
  SELECT *, role0 = 'para' AND NOT bold AND coalesce(lrole, '') <> '' AND (x >= 336) = (lx >= 336) AND x >= lx + 2
      AND size <= lsize + 0.6 AND y - lb < 2.5 * greatest(first_h, 1) AS detail
  FROM nested),
blocks AS (
  SELECT t.doc_id, t.page, grp AS ord, 'p' || t.page || 'b' || grp AS block_id, x, y, r - x AS w, b - y AS h, n_lines,
    text, CASE WHEN detail THEN 'bullet' ELSE role0 END AS role,
    CASE WHEN role0 = 'heading' THEN least(s.level, 4) ELSE 0 END AS level,
    CASE WHEN detail THEN ld + 1 ELSE coalesce(d, 0) END AS depth, bold, italic, marker, t.size
  FROM detailed t LEFT JOIN heading_sizes s ON s.doc_id = t.doc_id AND s.size = t.size)"""
)

# Blocks of the pages that views.damaged_runs leaves sound; the heading sizes of pages that are not in time don't count.
SOUND = (
    CLASSED.replace("\nlines AS (", "\nevery_line AS (")
    .replace(FACTS, """,
lines AS (SELECT * FROM every_line WHERE (doc_id + page) % 11 <> 3)""" + FACTS)
    .replace("FROM texted WHERE role0 = 'heading'", "FROM texted WHERE role0 = 'heading' AND (doc_id + page) % 13 <> 5")
)

PAGES = """,
layout_pages AS (SELECT DISTINCT doc_id, page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height FROM dressed)"""

# Pictures kept after clipping and decoration rules; see views.layout_pictures.
PICTURES = """,
raw_pictures AS (
  SELECT doc_id, page, 0 AS pic_no, 400.0::DOUBLE AS x, (200 + (doc_id + page) % 11 * 30)::DOUBLE AS y, 300.0::DOUBLE AS w,
    60.0::DOUBLE AS h, 200 AS px_w, 100 AS px_h FROM layout_pages WHERE (doc_id + page) % 5 = 0
  UNION ALL
  SELECT doc_id, page, 1, 80.0, 300.0, 20.0, (2 + (doc_id + page) % 3 * 11)::DOUBLE, 8, 8 FROM layout_pages
    WHERE (doc_id + page) % 7 = 0
  UNION ALL
  SELECT doc_id, page, 2, 90.0, 500.0, 30.0, 30.0, 8, 8 FROM layout_pages WHERE (doc_id + page) % 3 = 0),
clipped AS (
  SELECT doc_id, page, pic_no, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, 612) - greatest(x, 0) AS w,
    least(y + h, 792) - greatest(y, 0) AS h, px_w, px_h FROM raw_pictures),
pictures AS (
  SELECT * FROM clipped WHERE w >= 4 AND h >= 4 AND px_w * px_h > 1
    AND NOT ((px_w < 64 OR px_h < 64) AND (w < 24 OR h < 24)))"""

EVENT_BLOCK = "'p' || (event_id // 20 % 3 + 1) || 'b' || event_id % 20"
DECISIONS = f""",
last_events AS (
  SELECT user_id AS doc_id, {EVENT_BLOCK} AS block_id, max(event_id) AS event_id,
    arg_max(event_type, event_id) AS t FROM events GROUP BY 1, 2)"""


def with_blocks(select: str) -> str:
    return f"WITH {CLASSED}{PAGES}\n{select}"


def with_lines(select: str) -> str:
    return f"WITH {LINES}{PAGES}\n{select}"


def with_doc_lines(select: str) -> str:
    return f"WITH {PARAS}\n{select}"


ESCAPE = r"""regexp_replace(regexp_replace(regexp_replace({c}, '([\\`*_\[\]<&~])', '\\\1', 'g'), '^([#>+-])', '\\\1'), '^(\d{{1,9}})([.)])', '\1\\\2')"""


def escaped(c: str) -> str:
    return ESCAPE.format(c=c)


ROMAN_OF = "CASE lower({c}) WHEN 'i' THEN 1 WHEN 'ii' THEN 2 WHEN 'iii' THEN 3 WHEN 'iv' THEN 4 WHEN 'v' THEN 5 WHEN 'vi' THEN 6 WHEN 'vii' THEN 7 WHEN 'viii' THEN 8 WHEN 'ix' THEN 9 WHEN 'x' THEN 10 WHEN 'xi' THEN 11 WHEN 'xii' THEN 12 END"


def printed_value(r: str, m: str) -> str:
    inside = f"regexp_extract({m}, '^\\(?([^().]+)[.)]$', 1)"
    return f"""CASE WHEN {r} = 'numbered' AND regexp_matches({inside}, '^\\d{{1,3}}$') THEN {inside}::INT
      WHEN {r} = 'alpha' AND regexp_matches({inside}, '^[a-zA-Z]$') THEN ascii(lower({inside})) - 96
      WHEN {r} = 'roman' THEN {ROMAN_OF.format(c=inside)} END"""


# The whole markdown of the undecided blocks, list counters by recursion.
MARKDOWN = (
    CLASSED
    + PAGES
    + f""",
worded AS (
  SELECT *, {escaped("text")} AS esc, {printed_value("role", "marker")} AS printed,
    role IN ('bullet', 'numbered', 'alpha', 'roman') AS item FROM blocks WHERE text <> ''),
spoken AS (
  SELECT *, CASE WHEN role = 'heading' THEN repeat('#', greatest(1, least(6, CASE WHEN level = 0 THEN 2 ELSE level END))::INT) || ' '
        || regexp_replace(esc, '(\\s)(#+)$', '\\1\\\\\\2')
      ELSE CASE WHEN italic THEN '*' ELSE '' END || CASE WHEN bold THEN '**' ELSE '' END || esc
        || CASE WHEN bold THEN '**' ELSE '' END || CASE WHEN italic THEN '*' ELSE '' END END AS words,
    row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS nth FROM worded),
counted AS (
  SELECT s.doc_id, s.page, 0::BIGINT AS nth, [0]::INT[] AS cols, [NULL]::INT[] AS nums, ['.'] AS dots,
    NULL::VARCHAR AS mk, NULL::INT AS ind, NULL::INT AS dep
  FROM (SELECT DISTINCT doc_id, page FROM spoken) s
  UNION ALL
  SELECT doc_id, page, nth,
    CASE WHEN item THEN list_concat(cols[1:d+1], [cols[d+1] + length(mk) + 1]) ELSE [0] END,
    CASE WHEN item THEN list_concat(nums[1:d], [CASE WHEN role = 'bullet' THEN NULL ELSE value END, NULL]) ELSE [NULL]::INT[] END,
    CASE WHEN item THEN list_concat(dots[1:d], [dot, '.']) ELSE ['.'] END,
    CASE WHEN item THEN mk END, CASE WHEN item THEN cols[d+1] END, CASE WHEN item THEN d END
  FROM (
    SELECT *, CASE WHEN role = 'bullet' THEN '-' ELSE value || dot END AS mk FROM (
      SELECT *, CASE WHEN nums[d+1] IS NULL THEN '.' WHEN value = nums[d+1] + 1 THEN dots[d+1]
          WHEN dots[d+1] = '.' THEN ')' ELSE '.' END AS dot FROM (
        SELECT *, coalesce(printed, coalesce(nums[d+1], 0) + 1) AS value FROM (
          SELECT s.doc_id, s.page, s.nth, s.item, s.role, s.printed, c.cols, c.nums, c.dots,
            least(greatest(s.depth, 0), len(c.cols) - 1)::INT AS d
          FROM counted c JOIN spoken s ON s.doc_id = c.doc_id AND s.page = c.page AND s.nth = c.nth + 1)))))"""
    + """,
emitted AS (
  SELECT s.*, c.mk, c.ind, c.dep, CASE WHEN item THEN repeat(' ', c.ind) || c.mk || ' ' || words ELSE words END AS line,
    coalesce(lag(item) OVER o, false) AND NOT item AS before, NOT item AS after,
    lead(s.nth) OVER o IS NULL AS last_on_page
  FROM spoken s JOIN counted c ON c.doc_id = s.doc_id AND c.page = s.page AND c.nth = s.nth
  WINDOW o AS (PARTITION BY s.doc_id, s.page ORDER BY s.nth)),
doc_span AS (SELECT doc_id, min(page) AS p0, max(page) AS p1 FROM layout_pages GROUP BY doc_id),
all_lines AS (
  SELECT doc_id, page, nth * 3 - 1 AS k, '' AS text, NULL AS block_id FROM emitted WHERE before
  UNION ALL SELECT doc_id, page, nth * 3, line, block_id FROM emitted
  UNION ALL SELECT doc_id, page, nth * 3 + 1, '', NULL FROM emitted JOIN doc_span USING (doc_id)
    WHERE after AND NOT (last_on_page AND page = p1)
  UNION ALL SELECT doc_id, page, -1, '---', NULL FROM layout_pages JOIN doc_span USING (doc_id) WHERE page > p0
  UNION ALL SELECT doc_id, page, 0, '', NULL FROM layout_pages JOIN doc_span USING (doc_id) WHERE page > p0
  UNION ALL SELECT doc_id, page, 1000000, '', NULL FROM emitted JOIN doc_span USING (doc_id)
    WHERE last_on_page AND item AND page < p1),
md AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) AS line_no, text, block_id, page FROM all_lines)"""
)


def with_markdown(select: str) -> str:
    return f"WITH RECURSIVE {MARKDOWN}\n{select}"
