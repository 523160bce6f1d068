"""Steps that grew slow at size: what they may not do again."""

import os

import pytest
from pyspark.sql import functions as F

from quire.operators import structure as S
from quire.plans import views as V

SMALL = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no supplied tables")


def lines_of(spark, texts):
    rows = [(1, 1, i, t, (72.0, 96.0 + 12 * i, 300.0, 9.0), 10.0, False, False, "Body") for i, t in enumerate(texts)]
    box = "struct<x:double,y:double,w:double,h:double>"
    return spark.createDataFrame(
        rows, f"doc_id long, page int, line_no int, text string, box {box}, size double, bold boolean, italic boolean, font string"
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@supplied
def test_pages_are_counted_once(spark):
    V.doc_pages(spark, SMALL).collect()
    assert "aggregate(" not in plan(V.layout_lines(spark, SMALL)) + plan(V.layout_pages(spark, SMALL))


def test_only_broken_blocks_wait_for_their_text(spark):
    def said(texts):
        (block,) = S.raw_blocks(lines_of(spark, texts)).select(F.inline("blocks")).collect()
        return block["said"]

    whole = said(["1. one two ", "", "three\n"])
    assert (whole["marker"], whole["text"], whole["broken"]) == ("1.", "one two three", None)
    cut = said(["one engi-", "neering"])
    assert (cut["text"], cut["broken"]) == (None, ["one engi-", "neering"])


def longest_method(spark, df):
    """Bytes of the longest method Spark generates for a plan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        made = debug.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
        return max([0, *[made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@supplied
@pytest.mark.parametrize("name", ["packed", "find_furniture", "apply_furniture"])
def test_generated_methods_are_compiled(spark, name):
    """The JVM leaves a method of more than 8,000 bytes to its interpreter."""
    import __spark_entry__ as entry

    if name == "packed":
        df = S._packed(V.layout_lines(spark, SMALL))
    else:
        df = entry.queries()[name](spark, SMALL)
    assert longest_method(spark, df) < 8000


def written_of(spark, blocks):
    """blocks: (role, marker, depth, hidden, quote, deleted) of one page."""
    from quire.operators import emit as E

    rows = [(1, 1, i, f"p1b{i}", "text", "w", r, 0, d, m, h, q, gone) for i, (r, m, d, h, q, gone) in enumerate(blocks)]
    made = spark.createDataFrame(
        rows,
        "doc_id long, page int, ord int, block_id string, kind string, words string, role string, level int, depth int, "
        "marker string, hidden boolean, quote boolean, deleted boolean",
    )
    more = {"corrected": F.lit(False), "furniture": F.lit(None).cast("string"), "label": F.lit(None).cast("string")}
    return E.written(made.withColumns(more))


MIXED = [
    ("bullet", "-", 0, False, False, False), ("numbered", "3.", 1, False, False, False), ("para", "", 0, True, False, False),
    ("numbered", "9.", 1, False, True, False), ("bullet", "-", 5, False, True, True), ("para", "", 0, False, True, False),
    ("para", "", 0, False, True, False), ("alpha", "b)", 0, False, False, False),
]


def test_written_blocks(spark):
    """A list, a hidden block inside, an item parted by a quote, a deleted one left out."""
    got = written_of(spark, MIXED).orderBy("ord").collect()
    assert [r["line"] for r in got] == ["- w", "  3. w", "     <!-- w -->", "> 9. w", "> w", "> w", "2. w"]
    assert [(r["n"], r["at"], r["after"]) for r in got] == [
        (1, 1, None), (2, 2, "p1b0"), (3, 3, None), (4, 5, None), (5, 7, None), (6, 9, None), (7, 11, None)
    ]
    assert [(r["blank_before"], r["blank_after"]) for r in got] == [(0, 0), (0, 0), (0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert [(r["quoted_before"], r["quoted_after"]) for r in got[3:6]] == [(False, True), (True, True), (True, False)]


def test_blocks_are_shuffled_once_to_be_written(spark):
    assert plan(written_of(spark, MIXED)).count("Exchange") == 1


def test_spaces_collapse_as_before(spark):
    import itertools

    from quire import constants as K
    from quire.functions import text as T

    texts = ["".join(p) for p in itertools.product("a \té  \n", repeat=4)]
    plain = F.regexp_replace("t", rf"{K.WS}{{2,}}|(?! ){K.WS}", " ")
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    assert df.where(~T.ws_collapse(F.col("t")).eqNullSafe(plain)).count() == 0
    assert "contains" in T.ws_collapse(F.col("t"))._jc.toString().lower()


def missing_by_hand(texts):
    """(doc_id, page, pos, word) of texts (doc_id, page, side, text), word by word."""
    import re
    from collections import Counter, defaultdict

    pages = defaultdict(lambda: defaultdict(list))
    for doc, page, side, text in texts:
        pages[doc, page][side].append(re.findall(r"[^\W_]+", (text or "").lower()))
    out = []
    for (doc, page), sides in pages.items():
        layer = sorted((i, w) for ws in sides["layer"] for i, w in enumerate(ws))
        have = Counter(w for s in ("seen", "note") for ws in sides[s] for w in ws)
        drop = Counter(w for ws in sides["drop"] for w in ws)
        want, nth = Counter(w for _, w in layer), Counter()
        spare = [w for w, n in have.items() if n > max(want[w] - drop[w], 0)]
        for i, w in layer:
            nth[w] += 1
            if nth[w] > have[w] + drop[w] and not any(w in s for s in spare):
                out.append((doc, page, i, w))
    return sorted(out)


def test_no_word_is_a_row(spark):
    import random

    from quire.operators import fidelity as FI

    draw = random.Random(4)
    words = ["a", "ab", "Cab", "über", "straße", "СЛОВО", "x1", "1", "٣", "ét", "o'er", "语言", "𝒳y", "—", "_b_", "z"]
    texts = [
        (d, p, side, draw.choice([" ", "  ", "\n", ", "]).join(draw.choices(words, k=draw.randrange(0, 14))))
        for d in range(40) for p in (1, 2) for side in ("layer", "seen", "seen", "note", "drop") if draw.random() < 0.8
    ]
    texts += [(99, 1, "layer", "of of of"), (99, 1, "layer", "of on"), (99, 1, "drop", "of"), (99, 1, "seen", None), (98, 1, "seen", "lone")]
    weighed = spark.createDataFrame(texts, "doc_id long, page int, side string, text string")
    FI.fidelity_pages(weighed).collect()  # what it leaves behind must not travel with the words' function
    missing = FI.fidelity_missing(weighed)
    assert plan(missing).count("Exchange") == 1 and "Window" not in plan(missing)
    assert sorted(map(tuple, missing.collect())) == missing_by_hand(texts)
    assert [f.dataType.simpleString() for f in missing.schema] == ["bigint", "int", "int", "string"]


def pictures_df(spark, rows):
    box = "struct<x:double,y:double,w:double,h:double>"
    return spark.createDataFrame(rows, f"doc_id long, page int, pic_no int, box {box}, path string, px_w int, px_h int")


@supplied
def test_pictures_are_placed_where_blocks_are_made(spark):
    """The same blocks as by the window over a page, pages with no line and pictures with no text near included."""
    lines = V.layout_lines(spark, SMALL).where("doc_id % 7 < 3")
    far = pictures_df(spark, [(1, 900, 0, (1.0, 1.0, 5.0, 5.0), "a", 9, 9), (1, 900, 1, (1.0, 1.0, 5.0, 5.0), "b", 9, 9)])
    pictures = V.kept_pictures(spark, SMALL).unionByName(far, allowMissingColumns=True)
    got = S.structure(lines, pictures)
    assert "Window" not in plan(got) and "Exchange" not in plan(got)
    want = S.place_pictures(S.structure(lines), pictures).select(got.columns)
    assert got.where("kind = 'image'").count() > 2
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_whole_blocks_are_not_shuffled(spark):
    """Only headings and broken words wait for their document; what is left is read as it was written."""
    texts = ["1. one two", "three", "a high-", "way of high-way", "one engi-", "neering"]
    blocks = S.structure(lines_of(spark, texts))
    assert "Exchange" not in plan(blocks)
    assert [r.text for r in blocks.orderBy("ord").collect()] == ["one two three a high-way of high-way one engineering"]


def test_texts_meet_their_lines_once(spark):
    from quire.operators import emit as E

    blocks = S.structure(lines_of(spark, ["Some words", "and more."]))
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0)], "doc_id long, page int, width double, height double")
    md = E.emit(blocks, pages)
    assert not {"words", "text", "line"} & {*md.written.columns, *md.shaped.columns}
    assert [r.text for r in md.lines.collect()] == ["Some words and more."]


def test_only_margins_take_their_words_along(spark):
    """Pages of all heights: what lies in a margin of its own page, as told one by one, has words; no other has."""
    from quire.functions import geometry as G, text as T
    from quire.operators import furniture as FU

    heights = [40.0, 100.0, 792.0, 5000.0]
    rows = [
        (1, p + 1, i, f"p{p + 1}b{i}", "text", ["Page 3", "Notes 4", "12", "— —", None][i % 5], "", (0.0, y, 10.0, 9.0))
        for p, h in enumerate(heights) for i, y in enumerate([0.0, h * 0.12 - 9, h * 0.12 - 8.9, 11.0, 30.0, h / 2, h * 0.88, h * 0.88 - 0.01, h - 5, h])
    ]
    box = "struct<x:double,y:double,w:double,h:double>"
    blocks = spark.createDataFrame(rows, f"doc_id long, page int, ord int, block_id string, kind string, text string, marker string, box {box}")
    pages = spark.createDataFrame([(1, p + 1, 612.0, h) for p, h in enumerate(heights)], "doc_id long, page int, width double, height double")
    margin = G.in_margin(F.col("box"), F.col("height"))
    said = T.printed(F.col("marker"), F.col("text"))
    told = [F.when(margin, c).alias(n) for n, c in (("words", F.col("text")), ("printed", said), ("key", T.wording(said)), ("label", T.page_label(said)))]
    want = blocks.join(pages, ["doc_id", "page"]).select("block_id", margin.alias("margin"), *told)
    got = FU.seen(blocks, pages).select(want.columns)
    assert got.where("margin").count() > 10
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_pages_texts_are_grouped_once(spark):
    """Pages gathered apart and joined are those gathered together, one without a number included; what
    a page prints, grouped before, is not shuffled again."""
    from quire.operators import emit as E, fidelity as FI, lines as LN

    row = lambda d, p, i, t: (d, p, i, f"p{p}b{i}", "text", t, "1." if i else "", "numbered" if i else "para")
    rows = [row(1, 1, 0, "Some words"), row(1, 1, 1, "left out"), row(1, 2, 0, "put right"), row(2, None, 1, "nowhere")]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, ord int, block_id string, kind string, text string, marker string, role string")
    box = F.struct(*[F.lit(300.0).alias(c) for c in "xywh"]).alias("box")
    more = [F.lit(0).alias("level"), F.lit(0).alias("depth"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(None).cast("string").alias("href"), F.lit(-1).alias("picture"), box]
    blocks = blocks.select("*", *more)
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0), (1, 2, 612.0, 792.0)], "doc_id long, page int, width double, height double")
    decisions = spark.createDataFrame(
        [(1, "p1b1", True, None), (1, "p2b0", None, "set right")], "doc_id long, block_id string, deleted boolean, text string"
    ).withColumn("role", F.lit(None).cast("string"))
    runs = spark.createDataFrame(
        [(1, 1, 0, "Some words"), (1, 1, 1, "1. left out"), (1, 3, 0, "of a page alone"), (2, None, 0, "nowhere else")],
        "doc_id long, page int, run_no int, text string",
    )
    layers = LN.text_layer(runs)
    md = E.emit(blocks, pages, decisions=decisions)
    apart = FI.sides_by_page(layers, blocks, md, decisions)
    sort = lambda df: sorted(repr([r.doc_id, r.page, *map(sorted, (r.layer, r.drop, r.seen, r.note))]) for r in df.collect())
    assert sort(apart) == sort(FI.gathered(FI.sides(layers, blocks, md, decisions), ["doc_id", "page"]))
    assert len(sort(apart)) == 4
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        at = plan(FI.fidelity_missing(apart))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    joined = at[at.index("FullOuter") :].splitlines()
    assert "Sort [" in joined[1] and "Aggregate" in joined[2]


def lines_by_hand(rows):
    """(doc_id, page, text, x, right, size, bold, italic, font) of runs, each page by itself."""
    import numpy as np

    from quire.operators import bands

    out, pages = [], {}
    for r in sorted(rows, key=lambda r: (r[:3])):
        pages.setdefault(r[:2], []).append(r[3:])
    units = lambda r: len((r[0] or "").encode("utf-16-be")) // 2
    for key, runs in pages.items():
        number = [np.array([float(v) for v in c]) for c in zip(*[(*r[3], r[4], r[5]) for r in runs])]
        at = bands.Lines(*number, np.array([bool(r[9]) for r in runs]), np.array([len(runs)]))
        for line in range(int(at.line.max()) + 1):
            mine = sorted((int(at.place[i]), i) for i in range(len(runs)) if at.line[i] == line)
            said = "".join((" " if runs[i][1] or at.gap[i] else "") + runs[i][0] + (" " if runs[i][2] else "") for _, i in mine if runs[i][0] is not None)
            own = [runs[i] for _, i in mine]
            first = max(own, key=lambda r: -1 if r[0] is None else units(r))
            share = lambda k: None if all(r[0] is None for r in own) else sum(units(r) for r in own if r[k]) * 2 > sum(map(units, own))
            box = (min(r[3][0] for r in own), max(r[3][0] + r[3][2] for r in own))
            out.append((*key, " ".join(said.split()), *box, first[5], share(6), share(7), first[8]))
    return out


def test_runs_are_packed_where_they_lie(spark):
    """However runs are dealt and cut in batches they make the lines they make page by page, in one shuffle."""
    import random

    from quire.operators import lines as LN

    draw = random.Random(5)
    words = ["a", "über", "𝒳𝒳𝒳𝒳", "語", "long-word", "1.", "", None]
    rows = [
        (d, p, n, draw.choice(words), draw.choice([True, False, None]), draw.random() < 0.2, (20.0 + 30 * (n % 9), 50.0 + 14 * (n // 9), draw.choice([8.0, 20.0, 25.0]), 9.0),
         59.0 + 14 * (n // 9), draw.choice([10.0, 10.0, 10.5]), draw.choice([True, False, None]), draw.random() < 0.5, draw.choice(["F", "G", None]), draw.random() < 0.1)
        for d in range(5) for p in (1, 2) for n in range(40)
    ]
    draw.shuffle(rows)
    ddl = "doc_id long, page int, run_no int, text string, lead boolean, trail boolean, box struct<x:double,y:double,w:double,h:double>, base double, size double, bold boolean, italic boolean, font string, marker boolean"
    runs = spark.createDataFrame(rows, ddl)
    want = sorted(map(repr, lines_by_hand(rows)))
    for n in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        lines = LN.runs_to_lines(runs)
        assert plan(lines).count("Exchange") == 1 and "Window" not in plan(lines)
        got = [(r.doc_id, r.page, r.text, r.box.x, r.box.x + r.box.w, r["size"], r.bold, r.italic, r.font) for r in lines.collect()]
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(repr, got)) == want
    top = sorted((r.doc_id, r.page, r.line_no, r.box.y, r.box.x) for r in lines.collect())
    assert top == sorted(top, key=lambda r: (*r[:2], *r[3:])) and [r[2] for r in top if r[:2] == (0, 1)] == list(range(len([r for r in top if r[:2] == (0, 1)])))


def test_runs_of_one_number_go_by_what_they_say(spark):
    from quire.operators import lines as LN

    ddl = "doc_id long, page int, run_no int, text string, lead boolean, trail boolean, box struct<x:double,y:double,w:double,h:double>, base double, size double, bold boolean, italic boolean, font string"
    rows = [(1, 1, 0, t, False, False, (20.0, 50.0, 8.0, 9.0), 59.0, 10.0, False, False, "F") for t in "cab"]
    assert [r.text for r in LN.runs_to_lines(spark.createDataFrame(rows, ddl).repartition(3, "text")).collect()] == ["abc"]


def test_what_is_settled_leaves_no_shuffle(spark):
    from quire import session

    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {os.path.join(a, f) for d in dirs for a, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}

    before, held = shuffled(), spark.conf.get(session.CLEANUP, None)
    df = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = session.settle(df, "counts")
    assert shuffled() <= before and spark.conf.get(session.CLEANUP, None) == held
    assert kept.agg(F.sum("n")).first()[0] == 5000 and df.count() == 7
