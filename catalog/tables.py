"""Registered queries over documents as a corpus: fidelity, measure, ingest, scoring,
selection, alignment, the decision log and its streams."""

from pyspark.sql import functions as F

from catalog import layout_sql as L
from catalog.layout import blocks_of, markdown_of
from catalog.scalars import FILES, files
from quire import session
from quire.functions import measure as M, text as T
from quire.operators import (
    align as A, decisions as D, emit as E, fidelity as FI, ingest as I, log as LG, score as SC, selection as SE,
)
from quire.plans import convert as C, views as V
from quire.streaming import jobs as J

QUERIES = {}
PAGE = ["doc_id", "page"]


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


# ---- letters and fidelity ---------------------------------------------------

LETTERS = r"unnest(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]'))"
WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"

add(
    "letter_counts",
    lambda s, d: FI.letter_counts(V.table(s, d, "documents"), ["lang"], F.col("text")),
    f"SELECT lang, ch, count(*) AS n FROM (SELECT lang, {LETTERS.format(c='text')} AS ch FROM documents) GROUP BY lang, ch",
)
add(
    "letter_totals",
    lambda s, d: FI.total(FI.letter_counts(V.table(s, d, "conversations"), ["conv_id"], F.col("text")), ["conv_id"]),
    f"SELECT conv_id, count(*) AS total FROM (SELECT conv_id, {LETTERS.format(c='text')} AS ch FROM conversations) GROUP BY conv_id",
)


def _turns(s, d, role):
    talk = V.table(s, d, "conversations").where(F.col("role") == role)
    return FI.letter_counts(talk, ["conv_id"], F.col("text"))


TURNS = f"""c AS (SELECT conv_id, role, {LETTERS.format(c='text')} AS ch FROM conversations),
  n AS (SELECT conv_id, ch, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM c GROUP BY 1, 2)"""
add(
    "carried",
    lambda s, d: FI.carried(_turns(s, d, "user"), _turns(s, d, "assistant"), ["conv_id"]),
    f"WITH {TURNS} SELECT conv_id, sum(u)::BIGINT AS expected, sum(least(u, a))::BIGINT AS carried FROM n GROUP BY conv_id HAVING sum(u + a) > 0",
)
add(
    "multiset_difference",
    lambda s, d: FI.combine(_turns(s, d, "user"), _turns(s, d, "assistant"), ["conv_id", "ch"], -1),
    f"WITH {TURNS} SELECT conv_id, ch, u - a AS n FROM n WHERE u > a",
)
add(
    "multiset_sum",
    lambda s, d: FI.combine(_turns(s, d, "user"), _turns(s, d, "assistant"), ["conv_id", "ch"]),
    f"WITH {TURNS} SELECT conv_id, ch, u + a AS n FROM n WHERE u + a > 0",
)


EXCHANGE = ["conv_id", "pair"]


def _exchanges(s, d):
    """A question and its answer stand for a page and its markdown."""
    side = F.when(F.col("role") == "user", "layer").when(F.col("role") == "assistant", "seen")
    texts = V.table(s, d, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("pair"), side.alias("side"), "text")
    return FI.weighed_words(texts, EXCHANGE)


SAID = f"""t AS (SELECT conv_id, turn // 2 AS pair, role, {WORDS.format(c='text')} AS ws FROM conversations),
  w AS (SELECT conv_id, pair, role, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM t),
  have AS (SELECT conv_id, pair, word, count(*) AS n FROM w WHERE role = 'assistant' GROUP BY 1, 2, 3),
  u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pair, word ORDER BY pos) AS nth FROM w WHERE role = 'user'),
  miss AS (SELECT u.conv_id, u.pair, u.pos, u.word FROM u LEFT JOIN have h ON h.conv_id = u.conv_id AND h.pair = u.pair
    AND h.word = u.word WHERE nth > coalesce(h.n, 0))"""
add("missing_words", lambda s, d: FI.missing_words(_exchanges(s, d), EXCHANGE), f"WITH {SAID} SELECT conv_id, pair, pos, word FROM miss")
add(
    "spare_word_filter",
    lambda s, d: FI.spare_word_filter(_exchanges(s, d), EXCHANGE),
    f"""WITH {SAID}, want AS (SELECT conv_id, pair, word, count(*) AS n FROM u GROUP BY 1, 2, 3),
    spare AS (SELECT h.conv_id, h.pair, h.word FROM have h LEFT JOIN want q ON q.conv_id = h.conv_id AND q.pair = h.pair AND q.word = h.word
      WHERE h.n > coalesce(q.n, 0))
    SELECT conv_id, pair, pos, word FROM miss m
    WHERE NOT EXISTS (SELECT 1 FROM spare s WHERE s.conv_id = m.conv_id AND s.pair = m.pair AND contains(s.word, m.word))""",
)


def _sides(s, d):
    return FI.sides_by_page(V.layers(s, d), blocks_of(s, d), markdown_of(s, d))


FIDELITY = rf""", layer AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY line_no) AS text FROM lines GROUP BY 1, 2),
  texts AS (
    SELECT doc_id, page, 'layer' AS side, text FROM layer
    UNION ALL SELECT doc_id, page, 'drop', CASE WHEN role = 'numbered' THEN regexp_replace(marker, '\d', '', 'g') ELSE marker END FROM blocks
    UNION ALL SELECT doc_id, page, 'seen', regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\]\([^)]*\)', ' ', 'g') FROM md WHERE block_id IS NOT NULL),
  counts AS (SELECT doc_id, page, ch, count(*) FILTER (side = 'layer') AS l, count(*) FILTER (side = 'drop') AS d,
      count(*) FILTER (side = 'seen') AS s
    FROM (SELECT doc_id, page, side, {LETTERS.format(c='text')} AS ch FROM texts) GROUP BY 1, 2, 3),
  per_page AS (SELECT doc_id, page, sum(greatest(l - d, 0))::BIGINT AS expected, sum(least(greatest(l - d, 0), s))::BIGINT AS carried,
      0::BIGINT AS hidden FROM counts GROUP BY 1, 2)"""
add(
    "fidelity_pages",
    lambda s, d: FI.fidelity_pages(_sides(s, d)),
    f"WITH RECURSIVE {L.MARKDOWN}{FIDELITY} SELECT * FROM per_page",
)
add(
    "fidelity_docs",
    lambda s, d: FI.fidelity_docs(FI.fidelity_pages(_sides(s, d))),
    f"""WITH RECURSIVE {L.MARKDOWN}{FIDELITY} SELECT doc_id, sum(expected)::BIGINT AS expected, sum(carried)::BIGINT AS carried,
      0::BIGINT AS hidden, sum(carried) / sum(expected) AS coverage FROM per_page GROUP BY doc_id""",
)
add(
    "coverage_by_document",
    lambda s, d: C.coverage_by_document(V.layers(s, d), blocks_of(s, d), V.layout_pages(s, d)),
    f"""WITH RECURSIVE {L.MARKDOWN}{FIDELITY} SELECT doc_id, count(*) AS pages, sum(expected)::BIGINT AS expected,
      sum(carried)::BIGINT AS carried FROM per_page GROUP BY doc_id""",
)


def _decided_sides(s, d):
    blocks, pages, decided = blocks_of(s, d), V.layout_pages(s, d), V.decisions(s, d)
    md = E.emit(blocks, pages, decisions=decided, settings=V.doc_settings(s, d), line_settings=V.line_settings(s, d))
    return FI.sides_by_page(V.layers(s, d), blocks, md, decided)


add("fidelity_decided", lambda s, d: FI.fidelity_pages(_decided_sides(s, d)))
add("fidelity_missing", lambda s, d: FI.fidelity_missing(_decided_sides(s, d)))
add(
    "coverage",
    lambda s, d: FI.coverage(
        FI.carried(_turns(s, d, "user"), _turns(s, d, "assistant"), ["conv_id"]).withColumn("in_split", F.col("conv_id") % 3 != 0)
    ),
    f"""WITH {TURNS}, k AS (SELECT conv_id, sum(u) AS e, sum(least(u, a)) AS c FROM n GROUP BY conv_id)
    SELECT 'all' AS inputs_of, count(*) AS inputs, sum(e)::BIGINT AS expected, sum(c)::BIGINT AS carried, sum(c) / sum(e) AS coverage FROM k
    UNION ALL SELECT 'text_layer', count(*), sum(e)::BIGINT, sum(c)::BIGINT, sum(c) / sum(e) FROM k WHERE conv_id % 3 <> 0""",
)

# ---- measure ----------------------------------------------------------------


def _commented(s, d):
    """documents with comments put in by line number: whole, two on a line, open,
    escaped."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 9 == 2, F.concat(F.lit("<!-- "), x, F.lit(" -->")))
        .when(i % 9 == 4, F.concat(F.lit("<!-- a --> "), x, F.lit(" <!-- b -->")))
        .when(i % 9 == 6, F.concat(F.lit("\\<!-- "), x))
        .otherwise(x),
    )
    return V.table(s, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


add(
    "comment_lines",
    lambda s, d: _commented(s, d).select("doc_id", M.comment_lines(F.col("text")).alias("n")),
    """WITH x AS (SELECT doc_id, len(string_split(text, chr(10))) AS k FROM documents)
    SELECT doc_id, (SELECT count(*) FROM range(k) r(i) WHERE i % 9 IN (2, 4)) AS n FROM x""",
)
add(
    "measure",
    lambda s, d: E.md_pages(markdown_of(s, d).lines)
    .select(*PAGE, M.text_size(F.col("text")).alias("m"), M.comment_lines(F.col("text")).alias("comments"),
            F.array_join(M.may_hold_gfm(F.col("text")), ",").alias("gfm"))
    .select(*PAGE, "m.*", "comments", "gfm"),
    L.with_markdown(
        r"""SELECT doc_id, page, len(string_split(t, chr(10))) - 1 AS lines, strlen(t) AS bytes, floor(length(t) / 4 + 0.5)::BIGINT AS tokens,
          0 AS comments, array_to_string(list_filter([
            CASE WHEN regexp_matches(t, '(^|[^\\])(\\\\)*~') THEN 'strikethrough' END,
            CASE WHEN regexp_matches(t, '(?i)https?://|www\.|\S@\S+\.\S') THEN 'bare links' END], lambda x: x IS NOT NULL), ',') AS gfm
        FROM (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) || chr(10) AS t FROM md GROUP BY 1, 2)"""
    ),
)

# ---- ingest -----------------------------------------------------------------


def _staged(s, d):
    """documents as staged files: the id a source and a number make, the text's
    bytes, one document in seventeen staged twice, one in nineteen in conflict."""
    doc = V.table(s, d, "documents")
    sha = F.sha2(F.col("text"), 256)
    made = doc.select(
        F.concat(F.col("source"), F.lit("/d"), F.when(F.col("doc_id") % 19 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")).alias("doc_id"),
        sha.alias("sha256"),
        F.concat("source", F.lit(".pdf")).alias("name"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.element_at(F.array(F.lit("browser"), F.lit("workspace"), F.lit("loose")), (F.col("doc_id") % 3 + 1).cast("int")).alias("origin"),
        F.col("doc_id").alias("arrival"),
        F.col("doc_id").alias("n"),
    )
    made = made.withColumn("doc_id", F.when(F.col("n") % 19 <= 1, F.concat(F.lit("pair/d"), (F.col("n") - F.col("n") % 19).cast("string"))).otherwise(F.col("doc_id")))
    again = made.where("n % 17 = 0").withColumn("arrival", F.col("arrival") + 10_000_000)
    return made.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True))).drop("n")


def candidates(s, d):
    """What was staged, second copies among it."""
    return _staged(s, d).drop("again")


def manifest(s, d):
    """Every fourth document is listed: with its hash, another, or none."""
    doc = V.table(s, d, "documents").where("doc_id % 4 = 0")
    sha = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.sha2("source", 256))
    extra = F.create_map(F.lit("edits"), F.lit("{}"), F.lit("note"), F.col("lang"))
    listed = doc.select(F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string")).alias("doc_id"), sha.alias("sha256"), extra.alias("extra"))
    gone = doc.where("doc_id % 8 = 0").select(
        F.concat(F.lit("gone/d"), F.col("doc_id").cast("string")).alias("doc_id"), F.sha2("lang", 256).alias("sha256"), extra.alias("extra")
    )
    return listed.unionByName(gone)


STAGED = """made AS (
  SELECT CASE WHEN doc_id % 19 <= 1 THEN 'pair/d' || (doc_id - doc_id % 19) ELSE source || '/d' || doc_id END AS id, sha256(text) AS sha,
    strlen(text) AS bytes, (['browser','workspace','loose'])[doc_id % 3 + 1] AS origin, doc_id AS arrival, doc_id AS n, source FROM documents),
staged AS (SELECT * FROM made UNION ALL SELECT * REPLACE (arrival + 10000000 AS arrival) FROM made WHERE n % 17 = 0),
kept AS (SELECT id, sha, arg_min(origin, arrival) AS origin, arg_min(bytes, arrival) AS bytes, min(arrival) AS arrival,
    arg_min(source || '.pdf', arrival) AS name, count(*) - 1 AS repeats FROM staged GROUP BY 1, 2),
listed AS (
  SELECT source || '/d' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(source) END AS sha, lang FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT 'gone/d' || doc_id, sha256(lang), lang FROM documents WHERE doc_id % 8 = 0),
per_id AS (SELECT id, count(*) AS copies, min(arrival) AS arrival, min(sha) AS sha, min(origin) AS origin FROM kept GROUP BY id),
ids AS (SELECT coalesce(l.id, p.id) AS id, l.id IS NOT NULL AS is_listed, l.sha AS lsha, coalesce(p.copies, 0) AS copies, p.arrival, p.sha, p.origin
  FROM listed l FULL OUTER JOIN per_id p ON p.id = l.id),
owner AS (SELECT sha, arg_min(id, (CASE WHEN is_listed THEN 0 ELSE 1000000000000 END) + arrival) AS owner FROM ids WHERE copies = 1 GROUP BY sha),
status AS (
  SELECT i.id AS doc_id, CASE WHEN copies = 0 THEN 'missing' WHEN copies > 1 THEN 'conflict'
      WHEN is_listed AND lsha IS NULL THEN CASE WHEN origin = 'workspace' THEN 'unchanged' ELSE 'revised' END
      WHEN is_listed THEN CASE WHEN lsha = i.sha THEN 'unchanged' ELSE 'revised' END
      WHEN owner <> i.id THEN 'duplicate' ELSE 'new' END AS status, copies, CASE WHEN copies = 1 THEN i.sha END AS sha256
  FROM ids i LEFT JOIN owner o ON o.sha = i.sha)"""
add("dedupe_candidates", lambda s, d: I.dedupe_candidates(candidates(s, d)),
    f"WITH {STAGED} SELECT id AS doc_id, sha AS sha256, name, bytes, origin, arrival, repeats FROM kept")
add("repeats_said", lambda s, d: I.repeats_said(candidates(s, d)),
    f"""WITH {STAGED} SELECT CASE WHEN origin = 'browser' THEN 'already uploaded' ELSE 'already staged' END AS said, sum(repeats)::BIGINT AS n
    FROM kept WHERE repeats > 0 GROUP BY 1""")
add("owner_of_bytes", lambda s, d: I.owner_of_bytes(manifest(s, d), candidates(s, d)),
    f"WITH {STAGED} SELECT sha AS sha256, owner FROM owner")
add("reconcile", lambda s, d: I.reconcile(manifest(s, d), candidates(s, d)), f"WITH {STAGED} SELECT * FROM status")
add("union_ids", lambda s, d: I.union_ids(manifest(s, d), candidates(s, d)),
    f"WITH {STAGED} SELECT id AS doc_id, is_listed AS listed FROM ids")
add(
    "shed_decisions",
    lambda s, d: I.shed_decisions(manifest(s, d), I.reconcile(manifest(s, d), candidates(s, d))).select(
        "doc_id", "sha256", F.array_join(F.array_sort(F.map_keys("extra")), ",").alias("fields")
    ),
    f"""WITH {STAGED} SELECT l.id AS doc_id, l.sha AS sha256, CASE WHEN s.status = 'revised' THEN 'note' ELSE 'edits,note' END AS fields
    FROM listed l LEFT JOIN status s ON s.doc_id = l.id""",
)
add(
    "drop_derived",
    lambda s, d: I.drop_derived(candidates(s, d).select("doc_id", "arrival"), I.reconcile(manifest(s, d), candidates(s, d))),
    f"WITH {STAGED} SELECT id AS doc_id, arrival FROM staged WHERE id NOT IN (SELECT doc_id FROM status WHERE status = 'revised')",
)
add(
    "space_check",
    lambda s, d: I.space_check(I.reconcile(manifest(s, d), candidates(s, d)), candidates(s, d), 1_000_000),
    f"""WITH {STAGED} SELECT sum(bytes)::BIGINT AS writing, sum(bytes) * 2 <= 1000000 AS fits
    FROM kept WHERE origin <> 'browser' AND id IN (SELECT doc_id FROM status WHERE copies = 1)""",
)


def _settled(s, d):
    first = candidates(s, d).groupBy("doc_id").agg(F.min("sha256").alias("sha256"))
    kept, aside = I.settle_conflict(candidates(s, d), first)
    return kept.select("doc_id", "sha256", "arrival", F.lit("kept").alias("pile")).unionByName(
        aside.select("doc_id", "sha256", "arrival", F.lit("aside").alias("pile"))
    )


add("settle_conflict", _settled, f"""WITH {STAGED} SELECT id AS doc_id, sha AS sha256, arrival,
    CASE WHEN sha = min(sha) OVER (PARTITION BY id) THEN 'kept' ELSE 'aside' END AS pile FROM staged""")
add(
    "rename_staged",
    lambda s, d: I.rename_staged(
        I.dedupe_candidates(candidates(s, d)).select("doc_id", "sha256", "arrival"),
        _staged(s, d).where("arrival % 3 = 0 and not again").select(
            "doc_id", F.concat(F.lit("Renamed "), F.col("arrival").cast("string")).alias("typed")
        ).dropDuplicates(["doc_id"]),
    ),
    f"""WITH {STAGED}, r AS (SELECT DISTINCT id, n FROM made WHERE n % 3 = 0)
    SELECT CASE WHEN r.id IS NULL THEN k.id ELSE regexp_replace(k.id, '/[^/]*$', '') || '/renamed-' || r.n END AS doc_id, sha AS sha256, arrival
    FROM kept k LEFT JOIN (SELECT id, min(n) AS n FROM r GROUP BY id HAVING count(*) = 1) r ON r.id = k.id""",
)
add(
    "backfill_hashes",
    lambda s, d: I.backfill_hashes(
        manifest(s, d).select("doc_id", "sha256"),
        V.table(s, d, "documents").select(
            F.concat("source", F.lit("/d"), F.col("doc_id").cast("string")).alias("doc_id"),
            F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"),
        ),
    ),
    f"""WITH {STAGED} SELECT l.id AS doc_id, coalesce(l.sha, sha256(d.text)) AS sha256, strlen(d.text) AS bytes
    FROM listed l JOIN documents d ON l.id = d.source || '/d' || d.doc_id""",
)


def _drops(s, d):
    """Line items as files of drops: big ones by quantity, junk by number."""
    li = V.table(s, d, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 5).alias("drop_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"),
        F.when(F.col("l_orderkey") % 23 == 0, F.concat(F.lit("._"), F.col("l_orderkey").cast("string")))
        .otherwise(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"))).alias("name"),
        (F.col("l_quantity") * F.when(F.col("l_suppkey") % 5 == 0, 1000).when(F.col("l_suppkey") % 5 == 1, 1_000_000).otherwise(11_500_000)).cast("long").alias("bytes"),
    )


add(
    "drop_caps",
    lambda s, d: I.drop_caps(_drops(s, d)),
    """WITH f AS (SELECT l_suppkey % 5 AS drop_id, l_orderkey * 10 + l_linenumber AS arrival,
        CASE WHEN l_orderkey % 23 = 0 THEN '._' || l_orderkey ELSE 'f' || l_orderkey END AS name,
        (l_quantity * CASE WHEN l_suppkey % 5 = 0 THEN 1000 WHEN l_suppkey % 5 = 1 THEN 1000000 ELSE 11500000 END)::BIGINT AS bytes FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY drop_id ORDER BY arrival) AS rank, bytes > 536870912 AS big FROM f WHERE name NOT LIKE '.%'),
    u AS (SELECT *, sum(CASE WHEN big OR rank > 10000 THEN 0 ELSE bytes END) OVER (PARTITION BY drop_id ORDER BY rank) AS upto FROM r),
    o AS (SELECT *, min(CASE WHEN rank > 10000 OR (NOT big AND upto > 4294967296) THEN rank END) OVER (PARTITION BY drop_id) AS stop FROM u)
    SELECT drop_id, arrival, name, bytes, CASE WHEN rank > stop THEN 'after the stop' WHEN rank > 10000 THEN 'too many files' WHEN big THEN 'too large'
      WHEN rank = stop THEN 'drop too large' ELSE 'taken' END AS verdict FROM o
    UNION ALL SELECT drop_id, arrival, name, bytes, 'junk' FROM f WHERE name LIKE '.%'""",
)


def _entries(s, d):
    """documents as entries of archives, one archive a source."""
    f = files(s, d).withColumnRenamed("path", "p").join(V.table(s, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    k = F.col("doc_id")
    path = F.when(k % 5 == 0, F.concat(F.lit("x/"), (k % 400).cast("string"), F.lit(".pdf"))).otherwise(F.col("p"))
    return f.select(
        F.col("source").alias("archive"), k.alias("entry_no"), path.alias("path"), (F.col("n_chars") * 1000).alias("size"),
        (F.col("n_chars") * F.when(F.col("source") == "src3", 20000).otherwise(1500)).alias("original_size"),
        F.when((F.col("source") == "src1") & (k % 2 == 0), 12).otherwise(8).alias("method"), ((F.col("source") == "src2") & (k % 3 == 0)).alias("encrypted"),
    )


add(
    "archive_gate",
    lambda s, d: I.archive_gate(_entries(s, d)),
    f"WITH {FILES}" + r""", e AS (
      SELECT source AS archive, doc_id AS no, array_to_string(list_filter(string_split(replace(CASE WHEN doc_id % 5 = 0 THEN 'x/' || (doc_id % 400) || '.pdf' ELSE path END, '\', '/'), '/'),
          lambda x: x NOT IN ('', '.', '..')), '/') AS path, n_chars * 1000 AS size, n_chars * CASE WHEN source = 'src3' THEN 20000 ELSE 1500 END AS osize,
        CASE WHEN source = 'src1' AND doc_id % 2 = 0 THEN 12 ELSE 8 END AS method, source = 'src2' AND doc_id % 3 = 0 AS enc
      FROM files JOIN documents USING (doc_id)),
    w AS (SELECT *, row_number() OVER (PARTITION BY archive, path ORDER BY no) AS nth FROM e WHERE (lower(path) LIKE '%.pdf' OR string_split(path, '/')[-1] = 'manifest.json')
      AND NOT (list_contains(string_split(path, '/'), '__MACOSX') OR len(list_filter(string_split(path, '/')[1:-2], lambda x: x LIKE '.%')) > 0
        OR string_split(path, '/')[-1] LIKE '.\_%' ESCAPE '\')),
    bad AS (SELECT archive, arg_min(CASE WHEN enc THEN 'encrypted' WHEN method NOT IN (0, 8) THEN 'method' ELSE 'twice' END, no) AS why
      FROM w WHERE enc OR method NOT IN (0, 8) OR nth = 2 GROUP BY archive),
    costs AS (SELECT archive, path, max(greatest(size, osize)) AS cost FROM w GROUP BY 1, 2)
    SELECT archive, count(*) AS entries, sum(cost)::BIGINT AS inflated,
      coalesce(any_value(why), CASE WHEN count(*) > 10000 THEN 'too many' WHEN sum(cost) > 536870912 THEN 'too large' END) AS refused
    FROM costs LEFT JOIN bad USING (archive) GROUP BY archive""",
)


def _uploads(s, d):
    """documents as uploads of drops, some holding exported workspaces."""
    k = F.col("doc_id")
    path = (
        F.when(k % 10 == 0, F.concat(F.lit("ws"), (k % 4).cast("string"), F.lit("/manifest.json")))
        .when(k % 10 <= 3, F.concat(F.lit("ws"), (k % 4).cast("string"), F.lit("/sources/"), "source", F.lit("/A "), k.cast("string"), F.lit(".pdf")))
        .when(k % 10 == 4, F.concat(F.lit("ws1/notes/"), k.cast("string"), F.lit(".pdf")))
        .when((k % 10 == 5) & (k % 3 == 0), F.lit("manifest.json"))
        .when(k % 10 == 6, F.lit("sources/manifest.json"))
        .when(k % 10 == 7, F.concat(F.lit("ws2/sources/.pdf")))
        .otherwise(F.concat("lang", F.lit("/Loose "), k.cast("string"), F.lit(".pdf")))
    )
    return V.table(s, d, "documents").select((k % 7).alias("drop_id"), path.alias("path"))


UPLOADS = """up AS (SELECT doc_id % 7 AS drop_id, CASE WHEN doc_id % 10 = 0 THEN 'ws' || (doc_id % 4) || '/manifest.json'
    WHEN doc_id % 10 <= 3 THEN 'ws' || (doc_id % 4) || '/sources/' || source || '/A ' || doc_id || '.pdf'
    WHEN doc_id % 10 = 4 THEN 'ws1/notes/' || doc_id || '.pdf' WHEN doc_id % 10 = 5 AND doc_id % 3 = 0 THEN 'manifest.json'
    WHEN doc_id % 10 = 6 THEN 'sources/manifest.json' WHEN doc_id % 10 = 7 THEN 'ws2/sources/.pdf'
    ELSE lang || '/Loose ' || doc_id || '.pdf' END AS path FROM documents),
  top AS (SELECT DISTINCT drop_id FROM up WHERE path = 'manifest.json'),
  inner_roots AS (SELECT DISTINCT drop_id, split_part(path, '/', 1) AS root FROM up WHERE regexp_matches(path, '^[^/]+/manifest\\.json$')),
  roots AS (SELECT drop_id, '' AS root FROM top UNION ALL
    SELECT drop_id, root FROM inner_roots WHERE NOT (root IN ('sources', 'markdown') AND drop_id IN (SELECT drop_id FROM top)))"""
add("workspace_roots", lambda s, d: I.workspace_roots(_uploads(s, d)), f"WITH {UPLOADS} SELECT drop_id, root FROM roots")
add(
    "workspace_root_of",
    lambda s, d: I.workspace_root_of(_uploads(s, d)),
    f"WITH {UPLOADS}" + r""", r AS (SELECT up.drop_id, up.path, arg_max(root, length(root)) AS root FROM up LEFT JOIN roots ON roots.drop_id = up.drop_id
        AND (root = '' OR starts_with(path, root || '/')) GROUP BY up.drop_id, up.path),
      n AS (SELECT drop_id, path, count(*) AS n FROM up GROUP BY 1, 2),
      z AS (SELECT *, CASE WHEN root = '' THEN 'sources/' ELSE root || '/sources/' END AS src, lower(path) LIKE '%.pdf' AS pdf FROM r JOIN n USING (drop_id, path)),
      y AS (SELECT *, CASE WHEN pdf AND root IS NOT NULL AND starts_with(path, src) THEN regexp_replace(substr(path, length(src) + 1), '\.pdf$', '') END AS held,
        UNNEST(range(n)) AS copy FROM z)
      SELECT drop_id, path, root, CASE WHEN pdf AND root IS NULL THEN
          CASE WHEN path = 'ws2/sources/.pdf' THEN 'ws2/sources/doc'
            ELSE regexp_replace(path, '[^/]*$', '') || regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.pdf$', '')), '[^a-z0-9]+', '-', 'g') END
          WHEN held <> '' THEN held END AS doc_id,
        CASE WHEN pdf AND root IS NOT NULL AND NOT starts_with(path, src) THEN 'outside sources' WHEN held = '' THEN 'no name' END AS rejected FROM y""",
)
add(
    "folder_rollup",
    lambda s, d: I.folder_rollup(files(s, d)),
    f"WITH {FILES}" + """, p AS (SELECT DISTINCT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS ns FROM files),
    e AS (SELECT ns, unnest(range(1, len(ns))) AS k FROM p)
    SELECT array_to_string(ns[1:k], '/') AS folder, count(*) AS files FROM e GROUP BY 1""",
)


def _nodes(s, d):
    """Titles of web pages as names in folders of nine."""
    title = F.regexp_extract("html", r"<title>([^<]*)", 1)
    n = F.col("page_id")
    return V.table(s, d, "pages").select(
        F.floor(n / 9).alias("parent"), F.concat(title, F.lit("#"), n.cast("string")).alias("name"), (n % 3 > 0).alias("is_file")
    )


add("tree_order", lambda s, d: I.tree_order(_nodes(s, d)),
    r"""WITH n AS (SELECT page_id // 9 AS parent, regexp_extract(html, '<title>([^<]*)', 1) || '#' || page_id AS name, page_id % 3 > 0 AS is_file FROM pages)
    SELECT parent, name, is_file, row_number() OVER (PARTITION BY parent ORDER BY is_file, strip_accents(lower(name)), name) AS place FROM n""")

# ---- scoring ----------------------------------------------------------------


def verdicts(s, d, passed="quality"):
    doc = V.table(s, d, "documents").select("doc_id", "source")
    lab = V.table(s, d, "labels")
    hit = F.col("quality") == 1 if passed == "quality" else F.col("toxic") == 0
    return lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("input"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("doc_id") % 29 == 0, "baseline").otherwise(F.col("source")).alias("category"), hit.alias("passed"),
    )


VERDICTS = """v AS (SELECT l.doc_id AS input, 't' || l.doc_id AS id, CASE WHEN l.doc_id % 29 = 0 THEN 'baseline' ELSE source END AS category,
    quality = 1 AS passed, toxic = 0 AS was FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
  tally AS (SELECT category, count(*) FILTER (passed) AS passed, count(*) AS total FROM v GROUP BY category)"""
add("category_tallies", lambda s, d: SC.category_tallies(verdicts(s, d)), f"WITH {VERDICTS} SELECT * FROM tally")
add("macro_score", lambda s, d: SC.macro_score(SC.category_tallies(verdicts(s, d))),
    f"WITH {VERDICTS} SELECT avg(passed / total) AS score, sum(total)::BIGINT AS tests FROM tally")
add("micro_score", lambda s, d: SC.micro_score(SC.category_tallies(verdicts(s, d))),
    f"WITH {VERDICTS} SELECT sum(passed) / sum(total) AS score, sum(total)::BIGINT AS tests FROM tally WHERE category <> 'baseline'")


def _measures(s, d):
    e = V.table(s, d, "events")
    return e.groupBy((F.col("user_id") % 4).alias("subset"), F.col("event_type").alias("measure")).agg(
        F.round(F.avg("value"), 6).alias("value")
    )


add("tabled_average", lambda s, d: SC.tabled_average(_measures(s, d), ["click", "view", "signup"]).withColumn("average", F.round("average", 6)),
    """SELECT subset, round(avg(value), 6) AS average FROM (SELECT user_id % 4 AS subset, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)
    WHERE event_type IN ('click', 'view', 'signup') GROUP BY subset""")


def _reported(s, d):
    t = SC.category_tallies(verdicts(s, d))
    off = F.when(F.col("category").endswith("7"), 1).otherwise(0)
    return t.where("category != 'src4'").select("category", (F.col("passed") + off).alias("passed"), "total", (F.col("passed") / F.col("total")).alias("mean"))


add("score_consistency", lambda s, d: SC.score_consistency(SC.category_tallies(verdicts(s, d)), _reported(s, d)),
    f"""WITH {VERDICTS} SELECT category, passed, total, CASE WHEN category <> 'src4' THEN passed + 1 END AS reported_passed,
      CASE WHEN category <> 'src4' THEN total END AS reported_total FROM tally WHERE category = 'src4' OR category LIKE '%7'""")
add("verdict_diff", lambda s, d: SC.verdict_diff(verdicts(s, d), verdicts(s, d, "toxic")),
    f"WITH {VERDICTS} SELECT input, id, category, passed, CASE WHEN passed THEN 'now passes' ELSE 'now fails' END AS change FROM v WHERE passed <> was")
add("score_on", lambda s, d: SC.score_on(verdicts(s, d), verdicts(s, d).where("passed")).unionByName(
        SC.score_on(verdicts(s, d), verdicts(s, d).where("passed"), inside=False)).groupBy("passed").agg(F.count("*").alias("n")),
    f"WITH {VERDICTS} SELECT passed, count(*) AS n FROM v GROUP BY passed")


def _md(s, d):
    return V.table(s, d, "documents").select(F.col("doc_id").alias("input"), "text")


add(
    "report_failures",
    lambda s, d: SC.report_failures(
        verdicts(s, d), _md(s, d), SC.markdown_hashes(_md(s, d).withColumn("text", F.when(F.col("input") % 5 == 0, "old").otherwise(F.col("text"))))
    ),
    f"""WITH {VERDICTS}, c AS (SELECT input, count(*) FILTER (NOT passed) AS failed, count(*) AS tests FROM v GROUP BY input)
    SELECT input, id, category, passed, failed, tests, input % 5 = 0 AS stale FROM v JOIN c USING (input) WHERE NOT passed""",
)


def _kept(s, d):
    doc = V.table(s, d, "documents")
    base = doc.select(F.col("doc_id").alias("input"), F.lit("r1").alias("revision"), F.lit("v2").alias("version"), F.sha2("source", 256).alias("pins"))
    return base, base.where("input % 3 != 0").withColumn("pins", F.when(F.col("input") % 5 == 0, "other").otherwise(F.col("pins")))


add("pending", lambda s, d: SC.pending(*_kept(s, d)).select("input"),
    "SELECT doc_id AS input FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
add(
    "still_to_fetch",
    lambda s, d: SC.still_to_fetch(
        V.table(s, d, "documents").select(F.col("source").alias("name"), F.sha2("text", 256).alias("sha256")),
        V.table(s, d, "documents").where("doc_id % 2 = 0").select(F.col("source").alias("name"), F.sha2("text", 256).alias("sha256")),
    ),
    """SELECT source AS name, sha256(text) AS sha256 FROM documents
    EXCEPT ALL SELECT source, sha256(text) FROM documents WHERE doc_id % 2 = 0""",
)


def _file_runs(s, d):
    return V.table(s, d, "documents").select(
        F.col("doc_id").alias("input"), (F.col("n_chars") % 7 + 1).alias("pages"), (F.col("n_chars") * 3).alias("ms"),
        F.when(F.col("doc_id") % 50 == 0, "damaged").alias("error"), (F.col("doc_id") % 100 == 0).alias("gave_up"),
    )


add("run_summary", lambda s, d: SC.run_summary(_file_runs(s, d)),
    """SELECT sum(n_chars % 7 + 1)::BIGINT AS pages, sum(n_chars * 3) / 1000 AS seconds,
      floor(sum(n_chars % 7 + 1) / (sum(n_chars * 3) / 1000) * 10 + 0.5) / 10 AS pages_per_second,
      count(*) FILTER (doc_id % 50 = 0) AS unread, count(*) FILTER (doc_id % 100 = 0) AS gave_up FROM documents""")
add("corpus_hash", lambda s, d: SC.corpus_hash(SC.markdown_hashes(_md(s, d))),
    """WITH l AS (SELECT substr(sha256(doc_id::VARCHAR), 1, 4) AS leaf, doc_id || ':' || sha256(CASE WHEN trim(text) = '' THEN '' ELSE text END) AS row FROM documents),
    a AS (SELECT leaf, sha256(string_agg(row, ',' ORDER BY row)) AS hash, count(*) AS n FROM l GROUP BY leaf),
    b AS (SELECT substr(leaf, 1, 2) AS branch, sha256(string_agg(hash, ',' ORDER BY leaf)) AS hash, sum(n) AS n FROM a GROUP BY 1)
    SELECT sha256(string_agg(hash, ',' ORDER BY branch)) AS hash, sum(n)::BIGINT AS inputs FROM b""")


def _history(s, d):
    e = V.table(s, d, "events")
    return e.select(
        F.col("ts").alias("date"), F.col("event_type").alias("benchmark"), (F.col("user_id") % 9).alias("tool"), (F.col("user_id") % 2).alias("revision"),
        F.lit("s1").alias("scorer"), (F.col("user_id") % 3).alias("browsers"), F.col("value").alias("score"), F.col("event_id").alias("run"),
    )


add("latest_run", lambda s, d: SC.latest_run(_history(s, d)).select("benchmark", "tool", "run", "score", "previous_score"),
    """SELECT event_type AS benchmark, user_id % 9 AS tool, event_id AS run, value AS score, prev AS previous_score FROM (
      SELECT *, lag(value) OVER (PARTITION BY event_type, user_id % 9, user_id % 2, user_id % 3 ORDER BY ts) AS prev,
        row_number() OVER (PARTITION BY event_type, user_id % 9 ORDER BY ts DESC) AS nth FROM events) WHERE nth = 1""")
add("spread_sample", lambda s, d: SC.spread_sample(
        V.table(s, d, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("input")), 97),
    """WITH r AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS input, row_number() OVER (ORDER BY source || '/' || lpad(doc_id::VARCHAR, 9, '0')) - 1 AS r, count(*) OVER () AS n FROM documents)
    SELECT input FROM r WHERE r IN (SELECT i * n // 97 FROM range(97) t(i))""")
add(
    "history_gate",
    lambda s, d: SC.history_gate(
        V.table(s, d, "events").select(
            "event_id", (F.col("event_id") % 5 == 0).alias("began_dirty"), (F.col("event_id") % 7 == 0).alias("now_dirty"), F.lit("a").alias("began_commit"),
            F.when(F.col("event_id") % 11 == 0, "b").otherwise("a").alias("now_commit"), (F.col("user_id") % 3).alias("inputs"), F.lit(2).alias("all_inputs"),
            (F.col("event_id") % 13 == 0).cast("int").alias("gave_up"),
        )
    ).select("event_id", "refused"),
    """SELECT event_id, CASE WHEN user_id % 3 <> 2 THEN 'a slice' WHEN event_id % 5 = 0 THEN 'the tree has changes'
      WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 'the tree changed during the run' WHEN event_id % 13 = 0 THEN 'given up on at the time limit' END AS refused FROM events""",
)
add(
    "run_table",
    lambda s, d: SC.run_table(
        SC.category_tallies(verdicts(s, d)).withColumn("inputs_of", F.lit("all")).unionByName(
            SC.category_tallies(verdicts(s, d).where("input % 2 = 0")).withColumn("inputs_of", F.lit("text_layer"))
        )
    ),
    f"""WITH {VERDICTS}, half AS (SELECT category, count(*) FILTER (passed) AS p, count(*) AS t FROM v WHERE input % 2 = 0 GROUP BY category)
    SELECT category, printf('%.1f%%  %d/%d', passed / total * 100, passed, total) AS "all",
      CASE WHEN t IS NOT NULL THEN printf('%.1f%%  %d/%d', p / t * 100, p, t) END AS text_layer FROM tally LEFT JOIN half USING (category)""",
)


def _quote_rows(s, d):
    """Benchmark items' eight-word stretches, held against every document that
    holds one of the item's stretches."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cut = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("w") / 8).cast("int") - 1), lambda k: F.array_join(F.slice("w", k * 8 + 1, 8), " ")
    )
    b = V.table(s, d, "benchmark").withColumn("w", words).where(F.size("w") >= 8)
    quotes = session.settle(b.select("item_id", F.posexplode(cut).alias("k", "text")), "quotes")
    # a document's stretches are looked up by a key of 64 bits; words are compared on a hit
    at = F.sequence(F.lit(0), F.size("w") - 8)
    doc = V.table(s, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") >= 8)
    stretch = lambda k: F.slice("w", k + 1, 8)
    keys = doc.select("doc_id", F.posexplode(F.transform(at, lambda k: F.xxhash64(stretch(k)))).alias("k", "key"))
    known = quotes.select("item_id", "text", F.xxhash64(F.split("text", " ")).alias("key")).distinct()
    hits = keys.join(known, "key").select("doc_id", "k", "item_id", "text")
    spots = hits.groupBy("doc_id").agg(F.collect_set(F.struct("k", "item_id", "text")).alias("hits"))
    held = doc.join(spots, "doc_id").select("doc_id", F.explode(F.filter("hits", lambda h: F.array_join(stretch(h["k"]), " ") == h["text"])).alias("h"))
    pairs = held.select("doc_id", "h.item_id").distinct()
    return pairs.join(quotes, "item_id").select(
        F.col("doc_id").alias("input"), F.concat_ws("#", "item_id", "k").alias("quote_no"), "text", F.lit(None).cast("int").alias("slack")
    )


def _worn_quotes(s, d):
    """Two of three quotes with letters lost or changed, and some slack for every fourth."""
    k = F.substring_index("quote_no", "#", -1).cast("int")
    text = F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, F.replace("text", F.lit("e"), F.lit("")))
    return _quote_rows(s, d).select(
        "input", "quote_no", text.otherwise(F.replace("text", F.lit("a"), F.lit("oo"))).alias("text"),
        F.when(k % 4 == 0, F.lit(8)).alias("slack"),
    )


QUOTE_ROWS = r"""b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
  q AS (SELECT item_id, unnest(range(len(w) // 8)) AS k, w FROM b),
  quotes AS (SELECT item_id, k, array_to_string(w[8 * k + 1 : 8 * k + 8], ' ') AS text FROM q),
  d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, unnest(range(greatest(len(w) - 7, 0))) AS k, w FROM d),
  held AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 8], ' ') AS text FROM s),
  pairs AS (SELECT DISTINCT doc_id, item_id FROM held JOIN quotes USING (text)),
  flat AS (SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g') AS hay FROM documents)"""
add(
    "quotes_exact",
    lambda s, d: SC.quotes_found(_md(s, d), _quote_rows(s, d)).select("input", "quote_no", "exact"),
    f"WITH {QUOTE_ROWS}" + r""" SELECT p.doc_id AS input, p.item_id || '#' || k AS quote_no,
      contains(hay, regexp_replace(strip_accents(text), '[^\p{L}\p{N}]', '', 'g')) AS exact
    FROM pairs p JOIN quotes USING (item_id) JOIN flat USING (doc_id)""",
)
# every stretch of the text is tried, at each length the edits allow
WORN_QUOTES = QUOTE_ROWS + r""",
  worn AS (SELECT p.doc_id AS input, p.item_id || '#' || k AS quote_no, hay, CASE WHEN k % 4 = 0 THEN 8 ELSE 0 END AS slack,
    regexp_replace(strip_accents(CASE k % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', '') ELSE replace(text, 'a', 'oo') END), '[^\p{L}\p{N}]', '', 'g') AS needle
    FROM pairs p JOIN quotes USING (item_id) JOIN flat USING (doc_id)),
  lim AS (SELECT *, greatest(slack, length(needle) // 10) AS lim, contains(hay, needle) AS exact FROM worn),
  spots AS (SELECT input, quote_no, hay, needle, lim, unnest(range(length(hay))) AS i FROM lim WHERE NOT exact),
  tried AS (SELECT input, quote_no, lim, needle, substr(hay, i + 1, m::BIGINT) AS part FROM spots, range(160) r(m)
    WHERE m BETWEEN length(needle) - lim AND length(needle) + lim AND i + m <= length(hay)),
  near AS (SELECT DISTINCT input, quote_no FROM tried WHERE levenshtein(needle, part) <= lim),
  held_quotes AS (SELECT l.input, l.quote_no, l.exact, l.exact OR n.input IS NOT NULL AS found FROM lim l LEFT JOIN near n USING (input, quote_no))"""
add("quotes_found", lambda s, d: SC.quotes_found(_md(s, d), _worn_quotes(s, d)), f"WITH {WORN_QUOTES} SELECT input, quote_no, exact, found FROM held_quotes")
add("text_layer_split", lambda s, d: SC.text_layer_split(_md(s, d), _worn_quotes(s, d)),
    f"""WITH {WORN_QUOTES}, shares AS (SELECT input, count(*) FILTER (found) / count(*) AS share FROM held_quotes GROUP BY input)
    SELECT doc_id AS input, share, CASE WHEN share IS NULL THEN length(hay) >= 200 ELSE share >= 0.8 END AS in_split
    FROM flat LEFT JOIN shares ON doc_id = input""")
add("prose_quotes", lambda s, d: SC.prose_quotes(_md(s, d)),
    r"""WITH d AS (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS r FROM (
      SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '(?s)\$\$.*?\$\$', chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\n\s*\n') AS runs FROM documents)),
    w AS (SELECT doc_id, r, list_filter(regexp_split_to_array(run, '\s+'), lambda x: x <> '') AS w FROM d),
    c AS (SELECT doc_id, r, unnest(range(len(w) // 8)) AS k, w FROM w),
    q AS (SELECT doc_id, r, k, array_to_string(w[8 * k + 1 : 8 * k + 8], ' ') AS text FROM c),
    g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r, k) - 1 AS i
      FROM q WHERE NOT regexp_matches(text, '[\\$]') AND length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 24)
    SELECT doc_id AS input, i AS quote_no, text FROM g""")
add("stretches", lambda s, d: V.table(s, d, "benchmark").select("item_id", F.posexplode(SC.stretches(F.col("text"))).alias("k", "text")),
    r"""WITH RECURSIVE c AS (SELECT item_id, regexp_extract_all(text, '(?s)(?:[^\p{L}\p{N}]*[\p{L}\p{N}]){30}') AS whole, text FROM benchmark),
    t AS (SELECT item_id, whole, substr(text, 1 + coalesce(list_sum(list_transform(whole, lambda x: length(x))), 0)::BIGINT) AS tail FROM c),
    f AS (SELECT item_id, CASE WHEN n >= 15 OR (n > 0 AND len(whole) = 0) THEN list_append(whole, tail) ELSE whole END AS parts
      FROM (SELECT *, len(regexp_extract_all(tail, '[\p{L}\p{N}]')) AS n FROM t))
    SELECT item_id, generate_subscripts(parts, 1) - 1 AS k, unnest(parts) AS text FROM f""")


def _tests(s, d):
    """Benchmark items, seven words at a time, as tests of every type."""
    every = F.filter(F.split("text", " "), lambda x: x != "")
    stretch = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / 7).cast("int")), lambda k: F.slice(every, k * 7 + 1, 7))
    b = V.table(s, d, "benchmark").where(F.size(every) > 0).select("item_id", F.posexplode(stretch).alias("k", "w"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("present", "absent", "order", "table", "math", "baseline")]), ((F.col("item_id") + F.col("k")) % 6 + 1).cast("int"))

    def word(k):
        return F.get("w", F.lit(k))

    def on(types, c):
        return F.when(kind.isin(*types), c)

    return b.select(
        F.col("item_id").alias("input"), F.format_string("t%d.%d", "item_id", "k").alias("id"), kind.alias("type"),
        F.lit(2).alias("max_diffs"), on(("present", "absent"), F.array_join("w", " ")).alias("text"), on(("order",), F.array_join(F.slice("w", 1, 3), " ")).alias("before"),
        on(("order",), F.array_join(F.slice("w", 4, 4), " ")).alias("after"), on(("table",), F.array_join(F.slice("w", 1, 3), " ")).alias("cell"),
        on(("table",), word(3)).alias("up"), F.lit(None).cast("string").alias("down"), on(("table",), word(4)).alias("left"), F.lit("").alias("right"),
        on(("table",), word(5)).alias("top_heading"), on(("table",), word(6)).alias("left_heading"), on(("math",), F.array_join("w", " ")).alias("math"),
    )


TESTS = """i AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM benchmark),
  u AS (SELECT item_id, unnest(range((len(ws) + 6) // 7)) AS k, ws FROM i),
  t AS (SELECT item_id, k, (['present','absent','order','table','math','baseline'])[(item_id + k) % 6 + 1] AS type, ws[7 * k + 1 : 7 * k + 7] AS w FROM u)"""
add("test_wants", lambda s, d: SC.wants(_tests(s, d)).select("id", "wants"),
    f"""WITH {TESTS} SELECT 't' || item_id || '.' || k AS id, CASE type WHEN 'present' THEN to_json(array_to_string(w, ' '))::VARCHAR || ' present' WHEN 'absent' THEN to_json(array_to_string(w, ' '))::VARCHAR || ' absent'
      WHEN 'order' THEN to_json(array_to_string(w[1:3], ' '))::VARCHAR || ' before ' || to_json(array_to_string(w[4:7], ' '))::VARCHAR
      WHEN 'table' THEN 'cell ' || to_json(array_to_string(w[1:3], ' '))::VARCHAR || coalesce(', up ' || to_json(w[4])::VARCHAR, '') || coalesce(', left ' || to_json(w[5])::VARCHAR, '')
        || coalesce(', under ' || to_json(w[6])::VARCHAR, '') || coalesce(', beside ' || to_json(w[7])::VARCHAR, '')
      WHEN 'math' THEN 'formula ' || array_to_string(w, ' ') ELSE 'text, and not the same thing over and over' END AS wants FROM t""")
add("quotes_of_tests", lambda s, d: SC.quotes_of_tests(_tests(s, d)).select("input", "text", "slack"),
    f"""WITH {TESTS}, q AS (SELECT item_id, unnest(CASE WHEN type IN ('present', 'absent') THEN [array_to_string(w, ' ')]
        WHEN type = 'order' THEN [array_to_string(w[1:3], ' '), array_to_string(w[4:7], ' ')]
        WHEN type = 'table' THEN [array_to_string(w[1:3], ' '), w[4], w[5], w[6], w[7]] ELSE [] END) AS text FROM t)
    SELECT item_id AS input, text, 2 AS slack FROM q WHERE text <> ''""")

# ---- selection --------------------------------------------------------------


def _placed(s, d):
    b = blocks_of(s, d)
    return b.select(*PAGE, "ord", "block_id", "kind", "role", "level", "bold", "italic", (F.col("ord") % 4 == 3).alias("deleted"))


def _ranges(s, d):
    """From each document's last block that is one of its page's first five, back to
    its first block that isn't its page's first."""
    at = F.struct("page", "ord")
    return blocks_of(s, d).groupBy("doc_id").agg(
        F.max_by("block_id", F.when(F.col("ord") <= 4, at)).alias("a"), F.min_by("block_id", F.when(F.col("ord") >= 1, at)).alias("b")
    )


add("select_range", lambda s, d: SE.select_range(_placed(s, d), _ranges(s, d)),
    L.with_blocks("""SELECT doc_id, page, ord, block_id FROM blocks JOIN (
        SELECT doc_id, max(page * 1000000 + ord) FILTER (ord <= 4) AS p, min(page * 1000000 + ord) FILTER (ord >= 1) AS q FROM blocks GROUP BY doc_id) USING (doc_id)
      WHERE p IS NOT NULL AND q IS NOT NULL AND page * 1000000 + ord BETWEEN least(p, q) AND greatest(p, q) AND ord % 4 <> 3"""))
add(
    "lasso",
    lambda s, d: SE.lasso(
        blocks_of(s, d),
        V.layout_pages(s, d).select(*PAGE, F.struct(F.lit(60.0).alias("x"), (130.0 + F.col("page") % 5 * 40).alias("y"), F.lit(30.0).alias("w"), F.lit(100.0).alias("h")).alias("lasso")),
    ),
    L.with_blocks("""SELECT doc_id, page, ord, block_id FROM blocks WHERE x <= 90 AND 60 <= x + w AND y <= 230 + page % 5 * 40 AND 130 + page % 5 * 40 <= y + h"""),
)


def _picks(s, d, n):
    e = V.table(s, d, "events").where(F.col("event_id") % n == 0)
    return e.groupBy(F.col("user_id").alias("doc_id")).agg(
        F.collect_set(V.event_block()).alias("ids")
    )


PICKS = f"""a AS (SELECT DISTINCT user_id AS doc_id, {L.EVENT_BLOCK} AS id FROM events WHERE event_id % 2 = 0),
  b AS (SELECT DISTINCT user_id AS doc_id, {L.EVENT_BLOCK} AS id FROM events WHERE event_id % 3 = 0)"""
add("selection_toggle", lambda s, d: SE.toggle(_picks(s, d, 2), _picks(s, d, 3)).select("doc_id", F.array_join("ids", ",").alias("ids")),
    f"""WITH {PICKS} SELECT doc_id, string_agg(id, ',' ORDER BY id) AS ids FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY doc_id""")
add("ids_by_page", lambda s, d: SE.ids_by_page(_placed(s, d).where("not deleted")).select(*PAGE, F.array_join("ids", ",").alias("ids")),
    L.with_blocks("SELECT doc_id, page, string_agg(block_id, ',' ORDER BY block_id) AS ids FROM blocks WHERE ord % 4 <> 3 GROUP BY doc_id, page"))


def _selected(s, d):
    return D.overlay_decisions(blocks_of(s, d), V.decisions(s, d))


add("selection_summary", lambda s, d: SE.selection_summary(_selected(s, d)),
    "WITH " + L.CLASSED + L.DECISIONS + """, z AS (SELECT doc_id, CASE WHEN t = 'view' THEN 'heading' ELSE role END AS role, CASE WHEN t = 'view' THEN 2 ELSE level END AS level,
        bold, italic, coalesce(t = 'error', false) AS quote, coalesce(t = 'click', false) AS hidden, coalesce(t = 'signup', false) AS deleted
      FROM blocks LEFT JOIN last_events USING (doc_id, block_id))
    SELECT doc_id, CASE WHEN n = 0 THEN NULL WHEN shown > 0 THEN 'hide' ELSE 'show' END AS hide_action, n AS hide_count,
      CASE WHEN n > 0 THEN 'delete' ELSE 'restore' END AS delete_action, c AS delete_count, CASE WHEN looks = 1 THEN look END AS look,
      CASE WHEN n > 0 THEN q END AS quote_lit, CASE WHEN n > 0 THEN b AND heads = 0 END AS bold_lit, CASE WHEN n > 0 THEN i AND heads = 0 END AS italic_lit FROM (
      SELECT doc_id, count(*) AS c, count(*) FILTER (NOT deleted) AS n, count(*) FILTER (NOT deleted AND NOT hidden) AS shown,
        count(DISTINCT role || ':' || level) FILTER (NOT deleted) AS looks, min(role || ':' || level) FILTER (NOT deleted) AS look,
        bool_and(quote) FILTER (NOT deleted) AS q, bool_and(bold) FILTER (NOT deleted) AS b, bool_and(italic) FILTER (NOT deleted) AS i,
        count(*) FILTER (NOT deleted AND role = 'heading') AS heads FROM z GROUP BY doc_id)""")


def _items(s, d):
    p = markdown_of(s, d).placed.where("item is not null")
    return p.select(*PAGE, "line_from", "block_id", "item.depth", "item.after", (F.col("ord") % 2 == 1).alias("chosen"))


add("nesting_indent", lambda s, d: SE.nesting(_items(s, d), 1),
    # one item after another: none goes deeper than one below where the item before it went
    L.with_markdown(""", it AS (SELECT doc_id, page, block_id, dep, ord % 2 = 1 AS chosen, begins, row_number() OVER (PARTITION BY doc_id, page ORDER BY nth) AS k
      FROM (SELECT *, NOT coalesce(lag(item) OVER (PARTITION BY doc_id, page ORDER BY nth), false) AS begins FROM emitted) WHERE item),
    moved AS (
      SELECT doc_id, page, k, block_id, dep, CASE WHEN chosen THEN least(dep + 1, 0) ELSE dep END AS new FROM it WHERE k = 1
      UNION ALL
      SELECT i.doc_id, i.page, i.k, i.block_id, i.dep, CASE WHEN NOT i.chosen THEN i.dep WHEN i.begins THEN 0 ELSE least(i.dep + 1, m.new + 1) END
      FROM moved m JOIN it i ON i.doc_id = m.doc_id AND i.page = m.page AND i.k = m.k + 1)
    SELECT doc_id, block_id, new AS depth FROM moved WHERE new <> dep"""))
add("nesting_outdent", lambda s, d: SE.nesting(_items(s, d), -1),
    L.with_markdown("SELECT doc_id, block_id, dep - 1 AS depth FROM emitted WHERE item AND dep > 0 AND ord % 2 = 1"))

# ---- alignment --------------------------------------------------------------


def _points(s, d):
    blocks, pages = blocks_of(s, d), V.layout_pages(s, d)
    tops = A.page_tops(pages)
    return A.align_positions(markdown_of(s, d).placed, blocks, tops), tops


def _aligned(s, d):
    points, tops = _points(s, d)
    pages = V.layout_pages(s, d)
    ends = pages.groupBy("doc_id").agg((F.count("*") * V.PAGE_H).alias("end_x"), (F.count("*") * 100.0).alias("end_y"))
    asked = tops.select(*PAGE, F.explode(F.array(*[F.lit(k) for k in (0, 150, 400, 700)])).alias("k"), "top").select(
        *PAGE, F.col("k").cast("long").alias("q"), (F.col("top") + F.col("k")).alias("x")
    )
    return A.positions_to_lines(points, asked, tops, ends)


add("align_positions", lambda s, d: _points(s, d)[0])
add("positions_to_lines", _aligned)
add("page_tops", lambda s, d: A.page_tops(V.layout_pages(s, d)),
    L.with_lines("SELECT doc_id, page, ((row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) * 792)::DOUBLE AS top FROM layout_pages"))

# ---- decisions and their log ------------------------------------------------

add("latest_decisions", lambda s, d: D.latest_decisions(V.decision_log(s, d)),
    f"""SELECT user_id AS doc_id, {L.EVENT_BLOCK} AS block_id, (map {{'click': 'hide', 'view': 'show', 'signup': 'delete', 'purchase': 'restore', 'error': 'undo'}})[arg_max(event_type, event_id)] AS action,
      max(event_id) AS seq FROM events GROUP BY 1, 2""")
# log: the edits that changed something and still stand, with what they left their block as; u, r: how many can be undone and redone.
FOLD = f"""WITH RECURSIVE e AS (SELECT user_id AS doc_id, {L.EVENT_BLOCK} AS b, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::STRUCT(b VARCHAR, st VARCHAR)[] AS log, 0 AS u, 0 AS r FROM e
      UNION ALL SELECT doc_id, k, CASE WHEN t = 'error' AND u > 0 THEN log[:-2] WHEN t <> 'error' AND new <> old THEN list_append(log, {{'b': b, 'st': new}}) ELSE log END,
        CASE WHEN t = 'error' THEN greatest(u - 1, 0) WHEN new <> old THEN least(u + 1, 100) ELSE u END,
        CASE WHEN t = 'error' AND u > 0 THEN r + 1 WHEN t <> 'error' AND new <> old THEN 0 ELSE r END
      FROM (SELECT *, CASE t WHEN 'click' THEN 'h' WHEN 'signup' THEN 'd' WHEN 'view' THEN CASE WHEN old = 'h' THEN '' ELSE old END
          WHEN 'purchase' THEN CASE WHEN old = 'd' THEN '' ELSE old END END AS new
        FROM (SELECT e.doc_id, e.k, e.b, e.t, f.log, f.u, f.r, coalesce(list_filter(f.log, lambda x: x.b = e.b)[-1].st, '') AS old
          FROM f JOIN e ON e.doc_id = f.doc_id AND e.k = f.k + 1))),
    l AS (SELECT doc_id, arg_max(log, k) AS log, arg_max(u, k) AS u, arg_max(r, k) AS r FROM f GROUP BY doc_id),
    z AS (SELECT doc_id, unnest(log) AS x, generate_subscripts(log, 1) AS i FROM l),
    w AS (SELECT * FROM (SELECT doc_id, x.b AS block_id, arg_max(x.st, i) AS st FROM z GROUP BY 1, 2) WHERE st <> '')"""
FOLDED = FOLD + """ SELECT doc_id, '{"blocks": {' || coalesce(b, '') || '}, "cuts": {}, "headers_footers": "keep", "inserts": [], "joins": {}, "page_numbers": "keep", "repeated_lines": {}}' AS decided,
      u AS undo_depth, r AS redo_depth FROM l LEFT JOIN (
        SELECT doc_id, string_agg('"' || block_id || '": {"' || CASE st WHEN 'h' THEN 'hidden' ELSE 'deleted' END || '": true}', ', ' ORDER BY block_id) AS b FROM w GROUP BY doc_id) USING (doc_id)"""
add("fold_decision_log", lambda s, d: LG.fold_decision_log(V.decision_log(s, d)), FOLDED)
add("decided_blocks", lambda s, d: LG.decided_tables(LG.fold_decision_log(V.decision_log(s, d)))["decisions"].select(
        "doc_id", "block_id", F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("deleted", F.lit(False)).alias("deleted")),
    FOLD + " SELECT doc_id, block_id, st = 'h' AS hidden, st = 'd' AS deleted FROM w")
add("decide", lambda s, d: D.decide(blocks_of(s, d), F.col("role") == "heading", role="heading", level=2, hidden=True).select("doc_id", "block_id", "level", "hidden"),
    L.with_blocks("SELECT doc_id, block_id, CASE WHEN level <> 2 THEN 2 END AS level, true AS hidden FROM blocks WHERE role = 'heading'"))


def _docs(s, d):
    return V.table(s, d, "documents").select("doc_id", (F.col("doc_id") % 6).alias("reader"))


add("stale_reads", lambda s, d: D.stale_reads(_docs(s, d), V.decisions(s, d)),
    "SELECT doc_id, doc_id % 6 AS reader FROM documents WHERE doc_id % 6 <> 5 AND doc_id NOT IN (SELECT user_id FROM events)")
def _landing(s, d):
    """Every document lands; two of three were converted, some since changed or by an
    older version; users with events have decisions."""
    docs = V.table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("revision"))
    m = F.col("doc_id") % 6
    done = docs.where(F.col("doc_id") % 3 != 0).select(
        "doc_id", F.when(m == 1, "older").otherwise(F.col("revision")).alias("revision"), F.when(m == 2, 4).otherwise(5).alias("version"),
        F.when(m == 4, "other").otherwise("").alias("pins"),
    )
    return C.plan_landing(docs, done.unionByName(done.where(m == 1)), V.decisions(s, d), 5)


add("plan_landing", lambda s, d: _landing(s, d),
    """SELECT doc_id, sha256(coalesce(text, '')) AS revision, CASE WHEN doc_id % 6 = 5 THEN 'done'
      WHEN doc_id % 3 <> 0 AND doc_id IN (SELECT user_id FROM events) THEN 'pinned' ELSE 'convert' END AS state FROM documents""")
add("rehead_joins", lambda s, d: D.rehead(
        V.layout_pages(s, d).select("doc_id", F.format_string("p%db2", "page").alias("child"), F.format_string("p%db1", "page").alias("head")),
        V.layout_pages(s, d).select("doc_id", F.format_string("p%db0", "page").alias("head"), F.format_string("p%db1", "page").alias("member"))),
    L.with_lines("""SELECT doc_id, 'p' || page || 'b' || unnest([1, 2]) AS child, 'p' || page || 'b0' AS head FROM layout_pages"""))
add(
    "is_blank",
    lambda s, d: V.table(s, d, "documents").select("doc_id")
    .join(LG.fold_decision_log(V.decision_log(s, d)), "doc_id", "left")
    .select("doc_id", F.from_json("decided", LG._DECIDED).alias("e"), "undo_depth", "redo_depth")
    .select("doc_id", "e.*", F.array_repeat(F.lit("s"), F.coalesce("undo_depth", F.lit(0))).alias("undo"), F.array_repeat(F.lit("s"), F.coalesce("redo_depth", F.lit(0))).alias("redo"))
    .withColumns({k: F.nullif(k, F.lit("keep")) for k in ("page_numbers", "headers_footers")})
    .transform(lambda df: df.select("doc_id", D.is_blank(df).alias("blank"))),
    """SELECT doc_id, NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.doc_id AND event_type IN ('click', 'signup')) AS blank FROM documents d""",
)

# ---- streams, run over all there is -----------------------------------------

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _event_stream(s, d):
    e = s.readStream.schema(EVENTS).parquet(f"{d}/events*.parquet")
    action = (
        F.when(F.col("event_type") == "click", "hide").when(F.col("event_type") == "view", "show")
        .when(F.col("event_type") == "signup", "delete").when(F.col("event_type") == "purchase", "restore").otherwise("undo")
    )
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), action.alias("action"),
        V.event_block().alias("block_id"), F.lit(None).cast("string").alias("payload"),
    )


def _place(s, name):
    import uuid

    base = f"{session.shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _latest_stream(s, d):
    out, check = _place(s, "latest")
    J.latest_decisions_stream(_event_stream(s, d).select("doc_id", "seq", "action", "block_id"), out, check).awaitTermination()
    return J.read_latest(s, out)


add("latest_decisions_stream", _latest_stream, QUERIES["latest_decisions"][1])


def _fold_stream(s, d):
    out, check = _place(s, "fold")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    J.run_to_end(J.fold_log_stream(_event_stream(s, d)), out, check, "update", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return s.read.parquet(out).drop("batch")


add("fold_log_stream", _fold_stream, FOLDED)


def _progress_stream(s, d):
    out, check = _place(s, "progress")
    J.run_to_end(J.progress(_event_stream(s, d)), out, check, "update", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return s.read.parquet(out).groupBy("doc_id").agg(F.max("pages_read").alias("pages_read"))


add("progress_stream", _progress_stream, "SELECT user_id AS doc_id, count(*) AS pages_read FROM events GROUP BY user_id")


def _stage_stream(s, d):
    out, check = _place(s, "stage")
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    stream = s.readStream.schema(docs).parquet(f"{d}/documents*.parquet")
    made = stream.select(
        F.concat("source", F.lit("/d"), F.col("doc_id").cast("string")).alias("doc_id"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("name"),
        F.octet_length("text").cast("long").alias("bytes"), F.lit("loose").alias("origin"), F.col("doc_id").alias("arrival"),
    )
    J.stage_stream(made, manifest(s, d), out, check).awaitTermination()
    return s.read.parquet(f"{out}/status/version=0")


add("stage_stream", _stage_stream,
    """WITH c AS (SELECT source || '/d' || doc_id AS id, sha256(text) AS sha, doc_id AS arrival FROM documents),
    listed AS (SELECT source || '/d' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(source) END AS sha FROM documents WHERE doc_id % 4 = 0
      UNION ALL SELECT 'gone/d' || doc_id, sha256(lang) FROM documents WHERE doc_id % 8 = 0),
    ids AS (SELECT coalesce(l.id, c.id) AS id, l.id IS NOT NULL AS is_listed, l.sha AS lsha, c.sha, c.arrival FROM listed l FULL OUTER JOIN c ON c.id = l.id),
    owner AS (SELECT sha, arg_min(id, CASE WHEN is_listed THEN 0 ELSE 1000000000000 END + arrival) AS owner FROM ids WHERE sha IS NOT NULL GROUP BY sha)
    SELECT i.id AS doc_id, CASE WHEN i.sha IS NULL THEN 'missing' WHEN is_listed AND lsha = i.sha THEN 'unchanged' WHEN is_listed THEN 'revised'
      WHEN owner <> i.id THEN 'duplicate' ELSE 'new' END AS status, CASE WHEN i.sha IS NULL THEN 0 ELSE 1 END AS copies, i.sha AS sha256
    FROM ids i LEFT JOIN owner o ON o.sha = i.sha""")
