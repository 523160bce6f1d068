"""Golden pages, each a document of its own, read in one job."""

import pytest
from pyspark.sql import functions as F

from quire.operators import emit as E, lines as L, structure as S

INK = 9.2  # how tall a 10 pt line's ink is
PROSE = [f"Pumps are inspected yearly by group {c} and logged." for c in "abcdefgh"]


def line(text, x=72.0, base=96.0, size=10.0, bold=False, href=None, w=None):
    h = INK * size / 10
    return dict(text=text, x=float(x), y=base - 0.7 * size, w=float(w or 4.5 * len(text)), h=h, size=float(size),
                bold=bold, href=href)


def stack(texts, x=72.0, base=96.0, leading=12, **kw):
    return [line(t, x, base + i * leading, **kw) for i, t in enumerate(texts)]


def flow(*parts):
    """(text, size, bold) headings and lists of prose, a paragraph step apart."""
    out, base = [], 96.0
    for p in parts:
        base += 24
        if isinstance(p, list):
            out += stack(p, base=base)
            base += 12 * (len(p) - 1)
        else:
            out.append(line(p[0], base=base, size=p[1], bold=len(p) > 2 and p[2]))
            base += p[1] - 10
    return out


A, B, C = PROSE[0:2], PROSE[2:4], PROSE[4:6]
J = " ".join
CASES = {
    "wrapped": (stack(PROSE[:4]), [f"p {J(PROSE[:4])}"]),
    "gap": (
        stack(PROSE[:2], leading=19) + [line(PROSE[2], base=96 + 19 + 20)],
        [f"p {J(PROSE[:2])}", f"p {PROSE[2]}"],
    ),
    "weight": ([line(PROSE[0]), line(PROSE[1], base=108, bold=True)] + stack(PROSE[2:6], base=132),
               [f"p {PROSE[0]}", f"p {PROSE[1]}", f"p {J(PROSE[2:6])}"]),
    "hanging indent": ([line(PROSE[0])] + stack(PROSE[1:3], x=90, base=108), [f"p {J(PROSE[:3])}"]),
    "outdent": (
        [line(PROSE[0], 80), line(PROSE[1], 72, 108), line(PROSE[2], 81, 132), line(PROSE[3], 72, 144)],
        [f"p {J(PROSE[:2])}", f"p {PROSE[2]}", f"p {PROSE[3]}"],
    ),
    "two columns": (
        stack(["Left one here", "left two here"]) + stack(["Left three", "left four"], base=132)
        + stack(["Right one", "right two"], x=330) + stack(["Right three", "right four"], x=330, base=132),
        ["p Left one here left two here", "p Left three left four", "p Right one right two", "p Right three right four"],
    ),
    "four levels": (
        flow(("Manual", 24), A, ("Schedule", 18), B, ("Yearly", 14), C, ("Checks", 12), A),
        ["h1 Manual", f"p {J(A)}", "h2 Schedule", f"p {J(B)}", "h3 Yearly", f"p {J(C)}", "h4 Checks", f"p {J(A)}"],
    ),
    "within eight percent": (
        flow(("Manual", 24), A, ("Schedule", 22.5), B, ("Yearly", 21.5), C),
        ["h1 Manual", f"p {J(A)}", "h1 Schedule", f"p {J(B)}", "h2 Yearly", f"p {J(C)}"],
    ),
    "size threshold": (flow(("Large", 11.1), A, ("Not", 10.9), B), ["h1 Large", f"p {J(A)}", "p Not", f"p {J(B)}"]),
    "exactly larger": (flow(("Exactly", 11), A), ["h1 Exactly", f"p {J(A)}"]),
    "bold at body size": (
        flow(("Schedule", 10, True), A, ("Before you begin:", 10, True), B, ("Never dry.", 10, True), C),
        ["h1 Schedule", f"p {J(A)}", "h1 Before you begin:", f"p {J(B)}", "p Never dry.", f"p {J(C)}"],
    ),
    "length limit": (
        flow(("x" * 90, 11.5), A, ("x" * 91, 11.5), B),
        ["h1 " + "x" * 90, f"p {J(A)}", "p " + "x" * 91, f"p {J(B)}"],
    ),
    "divided": (stack(["by the facility engi-", "neering group, and so on"]), ["p by the facility engineering group, and so on"]),
    "seen compound": (stack(["A well-known Supplier and a well-", "known Dealer"]), ["p A well-known Supplier and a well-known Dealer"]),
    "capital or digit": (
        stack(["coupling that is PTFE-", "lined by the Smith-", "Jones group in 1990-", "1995 are Replaced"]),
        ["p coupling that is PTFE-lined by the Smith-Jones group in 1990-1995 are Replaced"],
    ),
    "hyphenated already": (stack(["of the state-of-the-", "art Pump"]), ["p of the state-of-the-art Pump"]),
    "hanging hyphen": (stack(["on the high-", "and low-pressure Pumps"]), ["p on the high- and low-pressure Pumps"]),
    "dash": (stack(["by the dock -", "and Pumps"]), ["p by the dock - and Pumps"]),
    "one letter": (stack(["the stated p-", "value, and by x-", "ray; see vitamin-", "c for it"]), ["p the stated p-value, and by x-ray; see vitamin-c for it"]),
    "apostrophe": (stack(["the gaskets did-", "n't arrive"]), ["p the gaskets didn't arrive"]),
    "first hyphen": (
        stack(["for their signal-", "to-noise ratio and three-", "and-a-half with the elec-", "tron-beam and medi-", "um-firm Gaskets"]),
        ["p for their signal-to-noise ratio and three-and-a-half with the electron-beam and medium-firm Gaskets"],
    ),
    "french": (stack(["en stock, dit-", "il. Pourquoi avez-", "vous peut-", "être lui-", "même reste-", "t-il là"]),
               ["p en stock, dit-il. Pourquoi avez-vous peut-être lui-même reste-t-il là"]),
    "vowel": (stack(["par les é-", "lèves au premier é-", "tage"]), ["p par les élèves au premier étage"]),
    "before to": (stack(["room are mid-", "to high-pressure Units, each pho-", "to of it"]), ["p room are mid- to high-pressure Units, each photo of it"]),
    "indents": (
        [line("• One", 72, 96), line("• Two", 75, 108), line("• Three", 72, 120), line("• Four", 76, 132)],
        ["bullet • One", "bullet • Two", "bullet • Three", "  bullet • Four"],
    ),
    "detail": (
        [line("1. Grease the pump"), line("with the lithium type", 80, 120), line("2. Check it", 72, 144)],
        ["numbered 1. Grease the pump", "  bullet with the lithium type", "numbered 2. Check it"],
    ),
    "steps back": (
        [line("1. Grease the pump bearings"), line("every quarter of it", 84, 108), line("What follows the list", 72, 120)],
        ["numbered 1. Grease the pump bearings every quarter of it", "p What follows the list"],
    ),
    "link": ([line("Read this", href="http://a"), line("and this", base=108, href="http://a")], ["p Read this and this -> http://a"]),
}


def brief(b):
    if b.kind == "image":
        return f"image {b.block_id}"
    said = f"h{b.level} {b.text}" if b.role == "heading" else f"p {b.text}"
    if b.role not in ("heading", "para"):
        said = "  " * b.depth + " ".join(p for p in (b.role, b.marker, b.text) if p)
    return said + (f" -> {b.href}" if b.href else "")


LINE_DDL = "doc_id string, page int, line_no int, text string, box struct<x:double,y:double,w:double,h:double>, size double, bold boolean, italic boolean, font string, href string"


def lines_of(spark, docs):
    rows = [
        (name, 1, i, l["text"], (l["x"], l["y"], l["w"], l["h"]), l["size"], l["bold"], False, "F", l["href"])
        for name, ls in docs.items()
        for i, l in enumerate(ls)
    ]
    return spark.createDataFrame(rows, LINE_DDL)


@pytest.fixture(scope="module")
def read(spark):
    blocks = S.structure(lines_of(spark, {k: v[0] for k, v in CASES.items()})).orderBy("doc_id", "ord").collect()
    return {name: [brief(b) for b in blocks if b.doc_id == name] for name in CASES}


@pytest.mark.parametrize("name", CASES)
def test_golden(read, name):
    assert read[name] == CASES[name][1]


def run(text, x, base, size=10.0, w=None, bold=False):
    h = 0.92 * size
    return (text, False, False, (float(x), base - 0.7 * size, float(w or 5 * len(text)), h), float(base), float(size), bold)


def words(texts, x, base, space=7, w=5):
    out = []
    for t in texts:
        out.append(run(t, x, base, w=w * len(t)))
        x += w * len(t) + space
    return out


LOOSE = [
    "Pumps are inspected yearly by the facility",
    "engineering group and every reading is put",
    "in a log kept by the door of the pump room",
    "Spare gaskets lie there as well for repairs",
]

COLUMNS = [
    ("Pumps are set in a", "Any reading that is"),
    ("row of three in it", "over a range given"),
    ("Spares lie beside", "here is put down at"),
    ("a door of the room", "once by who saw it"),
]

RUN_CASES = {
    "runs on a line": (
        [run("Pressure", 72, 96), run("Gauge", 117, 96), run("Pressure", 72, 168), run("Gauge", 118.5, 168)],
        ["Pressure Gauge", "Pressure", "Gauge"],
    ),
    "space or kerning": (
        [run("Grease", 72, 96), run("pump", 103.5, 96), run("Grease", 72, 120), run("pump", 102.5, 120)],
        ["Grease pump", "Greasepump"],
    ),
    "superscript": ([run("daily.", 72, 96), run("1", 102, 93, size=6), run("weekly", 72, 108)], ["daily.1", "weekly"]),
    "drop cap": (
        [run("T", 72, 120, size=30, w=18)] + [run(f"line {k} of the text", 96, 96 + 12 * k) for k in range(3)],
        ["T", "line 0 of the text", "line 1 of the text", "line 2 of the text"],
    ),
    "marker gap": ([run("•", 72, 96), run("item", 95, 96)], ["• item"]),
    "wide spaces": (
        sum((words(t.split(" "), 72, 96 + 12 * k) for k, t in enumerate(LOOSE)), []),
        LOOSE,
    ),
    "gutter": (
        sum(
            (words(le.split(" "), 72, 96 + 12 * k) + words(ri.split(" "), 188, 97 + 12 * k) for k, (le, ri) in enumerate(COLUMNS)), []
        ),
        [t for pair in COLUMNS for t in pair],
    ),
}


def test_runs_to_lines(spark):
    rows = [(name, 1, i, *r[:7], False, "F") for name, (runs, _) in RUN_CASES.items() for i, r in enumerate(runs)]
    ddl = "doc_id string, page int, run_no int, text string, lead boolean, trail boolean, box struct<x:double,y:double,w:double,h:double>, base double, size double, bold boolean, italic boolean, font string"
    got = L.runs_to_lines(spark.createDataFrame(rows, ddl)).orderBy("doc_id", "line_no").collect()
    for name, (_, want) in RUN_CASES.items():
        assert sorted(r.text for r in got if r.doc_id == name) == sorted(want), name


def test_pictures_before_their_text(spark):
    blocks = S.structure(
        lines_of(spark, {"d": [line("Above it"), line("Caption below", base=250), line("Last", base=400)]}),
        spark.createDataFrame(
            [("d", 1, 0, (72.0, 120.0, 100.0, 110.0), "a.png", 200, 200), ("d", 1, 1, (72.0, 500.0, 50.0, 50.0), "b.png", 200, 200)],
            "doc_id string, page int, pic_no int, box struct<x:double,y:double,w:double,h:double>, path string, px_w int, px_h int",
        ),
    )
    assert [brief(b) for b in blocks.orderBy("ord").collect()] == ["p Above it", "image p1i0", "p Caption below", "p Last", "image p1i1"]


BLOCK = dict(kind="text", box=(72.0, 300.0, 100.0, 10.0), lines=[0], level=0, depth=0, bold=False, italic=False, marker="", size=10.0, font="F", picture=-1, href=None)


def blocks_df(spark, docs):
    from quire import schemas

    cols = [f.name for f in schemas.struct(schemas.BLOCKS)]
    rows = []
    for doc, blocks in docs.items():
        count = {}
        for b in blocks:
            page = b.get("page", 1)
            k = count[page] = count.get(page, -1) + 1
            full = {**BLOCK, "doc_id": doc, "page": page, "ord": k, "block_id": f"p{page}b{k}", **b}
            rows.append(tuple(full[c] for c in cols))
    return spark.createDataFrame(rows, schemas.struct(schemas.BLOCKS))


def pages_df(spark, docs, height=792.0):
    rows = [(d, p, 612.0, height) for d, bs in docs.items() for p in range(1, max(b.get("page", 1) for b in bs) + 1)]
    return spark.createDataFrame(rows, "doc_id string, page int, width double, height double")


def item(role, marker, depth=0, text="Item", **kw):
    return dict(role=role, marker=marker, depth=depth, text=text, **kw)


EMITTED = {
    "alpha": ([item("alpha", "c."), item("alpha", "(d)")], ["3. Item", "4. Item"]),
    "roman": ([item("roman", "iv."), item("roman", "v)"), item("roman", "IX.")], ["4. Item", "5. Item", "9) Item"]),
    "by hand": ([item("numbered", "7."), item("numbered", "")], ["7. Item", "8. Item"]),
    "clamped": ([item("bullet", "•", 2), item("bullet", "•", 3)], ["- Item", "  - Item"]),
    "nested": (
        [item("numbered", "1."), item("alpha", "a.", 1), item("roman", "i.", 2), item("roman", "ii.", 2), item("alpha", "b.", 1), item("numbered", "2.")],
        ["1. Item", "   1. Item", "      1. Item", "      2. Item", "   2. Item", "2. Item"],
    ),
    "out of turn": ([item("numbered", "2."), item("numbered", "10."), item("numbered", "11.")], ["2. Item", "10) Item", "11) Item"]),
    "paragraph ends a list": ([item("bullet", "•"), item("para", ""), item("bullet", "•")], ["- Item", "", "Item", "", "- Item"]),
    "rule": ([item("para", "", page=1), item("bullet", "•", page=2), item("para", "", page=4)], ["Item", "", "---", "", "- Item", "", "---", "", "---", "", "Item"]),
    "escapes": ([item("para", "", text="2024. a*b [x] # <y>"), item("heading", "", text="Title ##")], [r"2024\. a\*b \[x] # \<y>".replace("[x]", "[x\\]"), "", r"## Title \##"]),
    "style": ([item("para", "", bold=True, italic=True, href="http://e.com/a (b)")], ["***[Item](http://e.com/a%20%28b%29)***"]),
}


def test_emit(spark):
    docs = {k: v[0] for k, v in EMITTED.items()}
    got = E.emit(blocks_df(spark, docs), pages_df(spark, docs)).lines.orderBy("doc_id", "line_no").collect()
    for name, (_, want) in EMITTED.items():
        mine = [r for r in got if r.doc_id == name]
        assert [r.text for r in mine] == want, name
        assert [r.line_no for r in mine] == list(range(1, len(want) + 1))


def test_decided(spark):
    docs = {
        "hidden": [item("para", ""), item("numbered", "4."), item("numbered", "9."), item("numbered", "5."), item("para", "")],
        "quoted": [item("para", "", text=t) for t in "abcd"],
        "deleted": [item("para", "", text=t) for t in "abc"],
    }
    decisions = spark.createDataFrame(
        [("hidden", "p1b2", True, False, False), ("hidden", "p1b4", True, False, False), ("quoted", "p1b1", False, False, True),
         ("quoted", "p1b2", False, False, True), ("deleted", "p1b1", False, True, False)],
        "doc_id string, block_id string, hidden boolean, deleted boolean, quote boolean",
    )
    md = E.emit(blocks_df(spark, docs), pages_df(spark, docs), decisions=decisions)
    got = md.lines.orderBy("doc_id", "line_no").collect()
    text = {d: [r.text for r in got if r.doc_id == d] for d in docs}
    assert text["hidden"] == ["Item", "", "4. Item", "   <!-- 9. Item -->", "5. Item", "   <!-- Item -->"]
    assert text["quoted"] == ["a", "", "> b", ">", "> c", "", "d"]
    assert text["deleted"] == ["a", "", "c"]
    placed = {(r.doc_id, r.block_id): r for r in md.placed.collect()}
    assert placed["deleted", "p1b1"].n == 0 and placed["deleted", "p1b2"].n == 2
    pages = E.md_pages(md.lines).collect()
    assert {r.doc_id: r.text for r in pages}["deleted"] == "a\n\nc\n"


def test_runs_say_what_is_a_marker(spark):
    """Prose that reads like a list marker reaches no further than other prose."""
    ddl = "doc_id string, page int, run_no int, text string, lead boolean, trail boolean, box struct<x:double,y:double,w:double,h:double>, base double, size double, bold boolean, italic boolean, font string"
    rows = [("d", 1, i, *r[:7], False, "F") for i, r in enumerate([run("a.", 72, 96), run("item", 95, 96)])]
    runs = spark.createDataFrame(rows, ddl)
    assert [r.text for r in L.runs_to_lines(runs).collect()] == ["a. item"]
    told = L.runs_to_lines(runs.withColumn("marker", F.lit(False)))
    assert [r.text for r in told.orderBy("line_no").collect()] == ["a.", "item"]


def test_reading_order_of_few_and_many_lines():
    """Parts of few lines are read by lists as by arrays."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        for _ in range(50):
            x, y = rng.integers(0, 60, n) * 10.0, rng.integers(0, 40, n) * 18.0
            w, h = rng.integers(1, 20, n) * 10.0, np.full(n, 10.0)
            few, most = S._reading_order(x, y, w, h, 10.0), S._FewLines.MOST
            S._FewLines.MOST = 0
            try:
                assert S._reading_order(x, y, w, h, 10.0) == few
            finally:
                S._FewLines.MOST = most


def test_pages_are_made_once(spark, tmp_path):
    """Pages come from the count of lines: no row of a line, no text in a shuffle; and a
    structure's plan packs the lines of a page once."""
    import os

    from quire.plans import views as V

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no supplied tables")
    pages = V.layout_pages(spark, sf)
    lines = V.doc_lines(spark, sf).select("doc_id", (F.floor(F.col("i") / V.LINES_PER_PAGE) + 1).cast("int").alias("page"))
    assert sorted(pages.select("doc_id", "page").collect()) == sorted(lines.distinct().collect())
    assert "posexplode" not in pages._jdf.queryExecution().optimizedPlan().toString()
    packed = S.grouped_lines(V.layout_lines(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert packed.count("collect_list") == 1


def test_spaces_at_an_edge(spark):
    """Text is trimmed and collapsed as the plain rules say, whatever its spaces."""
    from quire import constants as K
    from quire.functions import text as T

    texts = ["", " ", "a", " a", "a ", "a b", "a  b", "a\u00a0b", "\u3000a\t", "a \u0085", "a \r\n", "\n", "a\nb", None, "ab\u2028", " \u0085"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(
        T.ws_trim(t).alias("a"), F.regexp_replace(t, rf"^{K.WS}+|{K.WS}+$", "").alias("b"),
        T.ws_collapse(t).alias("c"), F.regexp_replace(t, rf"{K.WS}+", " ").alias("d"),
    ).collect()
    assert [(r.a, r.c) for r in got] == [(r.b, r.d) for r in got]
