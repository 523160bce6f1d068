"""Furniture, fidelity, measure, decisions, ingest, scoring, gates, streams."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import measure as M, paths as P, text as T
from quire.operators import (
    align as A, decisions as D, emit as E, fidelity as FI, furniture as FU, ingest as I, log as LG, ordered as O, score as SC, selection as SE,
)
from quire.sources import gates
from test_structure import blocks_df, item, pages_df


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_page_labels(spark):
    good = ["12", "iv", "Page 12", "12 of 40", "- 12 -", "p. 7", "xii", "xl", "lxxxix", "iv of xx"]
    bad = ["civil", "did", "mill", "Chapter 3", "12 apples", "MIX", "DIV", "CIV", "MI", "DI", "CI", "D.", "M", "C", "D"]
    got = values(spark, T.page_label, good + bad)
    assert got[: len(good)] == ["12", "iv", "12", "12", "12", "7", "xii", "xl", "lxxxix", "iv"]
    assert got[len(good) :] == [None] * len(bad)


def test_markers_and_values(spark):
    got = values(spark, T.marker_of, ["• a", "-5 C", "- a", "1. a", "(2) a", "i. a", "v) a", "c. a", "iiii. a", "1.a", "•", "word"])
    assert [r.role for r in got] == ["bullet", "", "bullet", "numbered", "numbered", "roman", "roman", "alpha", "", "", "", ""]


def test_comment_lines(spark):
    texts = ["a", "<!-- a -->\n<!-- b --> <!-- c -->", "x\n<!-- a\nb\n", "x <!-- a\nb", "\\<!-- a -->", "\\\\<!-- a -->", "<!-- a\nb -->\nc"]
    assert values(spark, M.comment_lines, texts) == [0, 2, 2, 0, 0, 1, 2]


def test_measure_sizes(spark):
    got = values(spark, M.text_size, ["", "a", "a\n\nb\n", "é" * 8])
    assert [r.lines for r in got] == [0, 1, 3, 1] and (got[3].bytes, got[3].tokens) == (16, 2)


def test_names(spark):
    assert values(spark, P.clean_id, ["a/../b.pdf/c d?.x", "/..", "Ünï/é", "x.md/y"]) == ["a/b-pdf/c d-.x", "", "Ünï/é", "x-md/y"]
    assert values(spark, P.stem, ["a/b.tar.gz", ".hidden", ".pdf", "x"]) == ["b.tar", ".hidden", "", "x"]
    long = values(spark, P.clean_segment, ["é" * 200])[0]
    assert len(long.encode()) == 248
    assert values(spark, P.clean_name, [" a​‮ b ", "‍", "x" * 90]) == ["a b", None, "x" * 80]
    assert values(spark, T.rendered_text, ["# A \\* b", "12) x [t](u) **y**", "<!-- z -->"]) == ["A * b", "12 x t  y", " "]


def furniture_doc():
    rows = []
    for n in (1, 2, 3):
        for text, y in (("Annual Report 2024", 20), ("Methods" if n < 3 else "Results", 300), (f"Body text on page {n}.", 400),
                        (f"Chapter {n} — Findings", 770), (str(n), 785)):
            rows.append(dict(page=n, role="para", text=text, box=(280.0, float(y), 40.0, 10.0)))
        if n == 1:
            rows.append(dict(page=1, role="para", text="Draft for review", box=(280.0, 760.0, 40.0, 10.0)))
    return {"d": rows}


def test_furniture(spark):
    docs = furniture_doc()
    blocks, pages = blocks_df(spark, docs), pages_df(spark, docs, 800.0)
    lines = {r.place: r for r in FU.repeated_lines(blocks, pages).collect()}
    assert {k: (r.n_pages, r.n_blocks) for k, r in lines.items()} == {"top": (3, 3), "bottom": (3, 3)}
    assert lines["bottom"].text == "Chapter 1 — Findings"
    counts = FU.count_furniture(blocks, pages).collect()[0]
    assert (counts.page_numbers, counts.headers_footers) == (3, 6)
    assert FU.page_numbers(blocks, pages).collect()[0].place == "bottom"


LAYERS = "Grease the pump weekly. Log every service."


@pytest.mark.parametrize(
    "decided, lose, want, missing",
    [
        (None, False, (34, 34, 0), []),
        (None, True, (34, 19, 0), ["log", "every", "service"]),
        (dict(deleted=True), False, (19, 19, 0), []),
        (dict(hidden=True), False, (34, 34, 15), []),
        (dict(text="Fixed words"), False, (19, 19, 0), []),
    ],
)
def test_fidelity(spark, decided, lose, want, missing):
    blocks = [item("para", "", text="Grease the pump weekly."), item("para", "", text="Log every service.")]
    docs = {"d": blocks[:1] if lose else blocks}
    b, p = blocks_df(spark, docs), pages_df(spark, docs)
    d = decided or {}
    decisions = spark.createDataFrame(
        [("d", "p1b1", None, d.get("hidden"), d.get("deleted"), d.get("text"))],
        "doc_id string, block_id string, role string, hidden boolean, deleted boolean, text string",
    )
    layers = spark.createDataFrame([("d", 1, LAYERS)], "doc_id string, page int, text string")
    weighed = FI.sides(layers, b, E.emit(b, p, decisions=decisions), decisions)
    page = FI.fidelity_pages(weighed).collect()[0]
    assert (page.expected, page.carried, page.hidden) == want
    assert [r.word for r in FI.fidelity_missing(weighed).orderBy("pos").collect()] == missing


def test_fidelity_reads_the_lines(spark):
    from types import SimpleNamespace

    docs = {"d": [item("para", "", text="Grease the pump_7 weekly."), item("para", "", text="Log every service.")]}
    b, p = blocks_df(spark, docs), pages_df(spark, docs)
    md = E.emit(b, p)
    layers = spark.createDataFrame([("d", 1, "Grease the pump_7 weekly. Log every service.")], "doc_id string, page int, text string")
    whole = FI.fidelity_pages(FI.sides(layers, b, md)).collect()[0]
    assert whole.expected == whole.carried == 35
    short = SimpleNamespace(shaped=md.shaped, written=md.written, lines=md.lines.where("text not like 'Log%'"))
    weighed = FI.sides(layers, b, short)
    assert FI.fidelity_pages(weighed).collect()[0].carried == 20
    assert [r.word for r in FI.fidelity_missing(weighed).orderBy("pos").collect()] == ["log", "every", "service"]


def test_log(spark):
    def fold(*actions):
        state = LG.State()
        for a in actions:
            state.take(*(a if len(a) == 3 else (*a, None)))
        return state

    assert fold(("hide", "b")).now["blocks"] == {"b": {"hidden": True}}
    assert fold(("hide", "b"), ("delete", "b")).now["blocks"] == {"b": {"deleted": True}}
    assert fold(("delete", "b"), ("hide", "b")).now["blocks"] == {"b": {"hidden": True}}
    assert fold(("hide", "b"), ("show", "b")).now["blocks"] == {}
    s = fold(("hide", "b1"), ("delete", "b2"), ("undo", None))
    assert s.now["blocks"] == {"b1": {"hidden": True}} and (len(s.undo), len(s.redo)) == (1, 1)
    s.take("redo", None, None)
    assert s.now["blocks"] == {"b1": {"hidden": True}, "b2": {"deleted": True}}
    assert len(fold(("hide", "b"), ("hide", "b")).undo) == 1
    assert len(fold(*[("hide", f"b{i}") for i in range(150)]).undo) == 100
    p = json.dumps({"change": {"role": "para"}, "reader": {"b": {"role": "para"}}})
    assert fold(("apply", "b", p)).undo == []
    j = fold(("join", None, json.dumps({"ids": ["a", "b"]})), ("join", None, json.dumps({"ids": ["z", "a"]})))
    assert j.now["joins"] == {"a": "z", "b": "z"}
    c = fold(("set_cuts", "b", json.dumps({"at": [7, 3, 3]})), ("join", None, json.dumps({"ids": ["b", "bc3"]})))
    assert c.now["cuts"] == {"b": [7]}
    i = fold(("add_insert", None, json.dumps({"page": 1, "text": "x"})), ("add_insert", None, json.dumps({"page": 1, "text": "y", "before": "i1"})))
    assert [k["id"] for k in i.now["inserts"]] == ["i2", "i1"]
    assert fold(("hide", "b"), ("revert", None)).now == LG.EMPTY
    log = spark.createDataFrame(
        [(1, 2, "undo", None), (1, 1, "hide", "b"), (2, 1, "delete", "c")], "doc_id long, seq long, action string, block_id string"
    )
    rows = LG.decided_tables(LG.fold_decision_log(log))["decisions"].collect()
    assert [(r.doc_id, r.block_id, r.deleted) for r in rows] == [(2, "c", True)]


def test_reconcile(spark):
    m = spark.createDataFrame([("l", "h1"), ("r", "h2"), ("gone", "h9"), ("u", None)], "doc_id string, sha256 string")
    c = spark.createDataFrame(
        [("l", "h1", "n", 1, "browser", 1), ("r", "hX", "n", 1, "loose", 2), ("u", "h7", "n", 1, "workspace", 3), ("a", "h3", "n", 1, "loose", 4),
         ("b", "h3", "n", 1, "loose", 5), ("two", "h4", "n", 1, "loose", 6), ("two", "h5", "n", 1, "loose", 7), ("copy", "h1", "n", 1, "loose", 8)],
        "doc_id string, sha256 string, name string, bytes long, origin string, arrival long",
    )
    got = {r.doc_id: r.status for r in I.reconcile(m, c).collect()}
    assert got == {"l": "unchanged", "r": "revised", "gone": "missing", "u": "unchanged", "a": "new", "b": "duplicate", "two": "conflict", "copy": "duplicate"}


def test_tree_order(spark):
    rows = [("zeta", True), ("Alpha", True), ("beta", False), ("alpha-dir", False), ("Beta", False)]
    df = spark.createDataFrame([("", n, f) for n, f in rows], "parent string, name string, is_file boolean")
    assert [r.name for r in I.tree_order(df).orderBy("place").collect()] == ["alpha-dir", "Beta", "beta", "Alpha", "zeta"]


def test_scores(spark):
    t = [(17, 2927), (1394, 1394), (287, 760), (186, 442), (548, 884), (70, 526), (0, 458), (2, 1022)]
    tallies = spark.createDataFrame([(f"c{i}", p, n) for i, (p, n) in enumerate(t)], "category string, passed long, total long")
    assert round(SC.macro_score(tallies).collect()[0].score, 4) == 0.3199
    one = spark.createDataFrame([("a", 783, 2318), ("baseline", 5, 5)], "category string, passed long, total long")
    assert round(SC.micro_score(one).collect()[0].score, 4) == 0.3378


def test_nearest_edits():
    def brute(needle, hay):
        row = [0] * (len(hay) + 1)
        for i, c in enumerate(needle):
            new = [i + 1]
            for j, h in enumerate(hay):
                new.append(min(row[j] + (c != h), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for needle, hay in (("kitten", "xxsittingxx"), ("abcdef", "zzabdefzz"), ("aaaa", "bbbb"), ("hello", ""), ("spam", "spxam")):
        for limit in (1, 2, 3, 9):
            assert SC.nearest_edits(needle, hay, limit) == min(brute(needle, hay), limit + 1)


def test_gates(spark):
    page = {"n": 1, "lines": [], "pictures": [], "blocks": []}
    docs = [
        ("ok", {"format": 1, "pages": [page]}, None), ("bad json", "{", "json"), ("list", [], "not_object"),
        ("format", {"format": 2, "pages": []}, "format"), ("pages", {"format": 1}, "no_pages"),
        ("page", {"format": 1, "pages": [{"n": "1"}]}, "page"),
    ]
    df = spark.createDataFrame([(n, j if isinstance(j, str) else json.dumps(j)) for n, j, _ in docs], "name string, json string")
    got = {r.name: r for r in gates.gate_analysis(df).collect()}
    assert {n: got[n].problem for n, _, _ in docs} == {n: p for n, _, p in docs}
    assert (got["ok"].reader, got["ok"].body_size) == (1, 0.0)
    ok = {"version": 1, "blocks": {"a": {"role": "para", "level": 3, "quote": True}}, "mine": 1, "undo": [{"blocks": {}}, {"blocks": 1}]}
    edits = [
        ("ok", ok, True), ("role", {"version": 1, "blocks": {"a": {"role": "x"}}}, False), ("level", {"version": 1, "blocks": {"a": {"level": 7}}}, False),
        ("text", {"version": 1, "blocks": {"a": {"text": " "}}}, False), ("cut", {"version": 1, "cuts": {"a": [0]}}, False),
        ("ids", {"version": 1, "inserts": [{"id": "i", "text": "", "page": 1, "after": None}] * 2}, False),
        ("insert", {"version": 1, "inserts": [{"id": "i", "text": "", "page": 1, "after": None}]}, True),
        ("choice", {"version": 1, "page_numbers": "drop"}, False), ("join", {"version": 1, "joins": {"a": 1}}, False), ("version", {"version": 2}, False),
    ]
    df = spark.createDataFrame([(n, json.dumps(j)) for n, j, _ in edits], "doc_id string, json string")
    rows = {r.doc_id: r for r in gates.gate_decisions(df).collect()}
    assert {n: rows[n].problem is None for n, _, _ in edits} == {n: g for n, _, g in edits}
    assert rows["ok"].undo_steps == 1
    sha = "a" * 64
    manifests = [
        ("ok", {"format": 1, "name": " n ", "documents": {"a/b": {"sha256": sha, "edits": {}}}}, None), ("newer", {"format": 2, "documents": {}}, "newer"),
        ("id", {"format": 1, "documents": {"a/../b": {}}}, "document_id"),
        ("sha", {"format": 1, "documents": {"a": {"sha256": "x"}}}, "sha256"), ("docs", {"format": 1}, "no_documents"),
    ]
    df = spark.createDataFrame([(n, json.dumps(j)) for n, j, _ in manifests], "id string, json string")
    rows = {r.id: r for r in gates.gate_manifest(df).collect()}
    assert {n: rows[n].problem for n, _, _ in manifests} == {n: p for n, _, p in manifests}
    assert rows["ok"].name == "n"
    entry = gates.manifest_entries(df.where("id = 'ok'")).collect()[0]
    assert (entry.doc_id, entry.sha256, entry.extra) == ("a/b", sha, {"edits": "{}"})


def test_running_totals_cross_spans(spark):
    df = spark.range(1, 10001).select(F.lit(1).alias("d"), F.col("id").alias("p"))
    got = O.running_before(df, ["d"], "p", F.lit(2), "before").agg(F.max("before"), F.sum("before")).collect()[0]
    assert tuple(got) == (2 * 9999, 2 * 9999 * 10000 // 2)
    known = O.nearest_known(df, ["d"], "p", F.when(F.col("p") % 5000 == 1, F.col("p")), "near", ahead=True)
    assert known.where("p in (1, 5001, 9999)").orderBy("p").select("near").collect() == [(5001,), (None,), (None,)]


def test_nesting(spark):
    rows = [("d", 1, 1, "a", 0, None, True), ("d", 1, 2, "b", 0, "a", True), ("d", 1, 3, "c", 0, "b", True)]
    df = spark.createDataFrame(rows, "doc_id string, page int, line_from int, block_id string, depth int, after string, chosen boolean")
    assert {r.block_id: r.depth for r in SE.nesting(df, 1).collect()} == {"b": 1, "c": 1}


def test_longest_run():
    import bisect
    import itertools

    for xs in itertools.permutations(range(6)):
        best = []
        for x in xs:
            k = bisect.bisect_left(best, x)
            best[k : k + 1] = [x]
        places = A._longest(xs)
        assert len(places) == len(best) and all(xs[a] < xs[b] for a, b in zip(places, places[1:]))


def test_convert_stream(spark, tmp_path):
    from quire.streaming import jobs as J

    run = {"text": "Hello", "lead": False, "trail": False, "box": {"x": 72.0, "y": 90.0, "w": 30.0, "h": 9.0}, "base": 96.0, "size": 10.0,
           "bold": False, "italic": False, "font": "F"}
    link = {"box": {"x": 70.0, "y": 88.0, "w": 40.0, "h": 14.0}, "url": "https://example.org/a"}
    picture = {"box": {"x": 72.0, "y": 300.0, "w": 200.0, "h": 100.0}, "path": "p2-i0.png", "px": [400, 200]}
    page = {"n": 1, "width": 612.0, "height": 792.0, "runs": [run], "lines": [], "pictures": [], "links": [], "blocks": []}
    broken = {**page, "n": 3, "runs": [{**run, "box": None}, run]}
    doc = {"doc_id": "d", "format": 1, "pages": [page, {**page, "n": 2, "links": [link], "pictures": [picture]}, broken]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.json").write_text(json.dumps(doc))
    out = str(tmp_path / "out")
    J.convert_stream(J.layout_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "check")).awaitTermination()
    got = [(r.page, r.text) for r in spark.read.parquet(f"{out}/md_lines").where("block_id is not null").orderBy("line_no").collect()]
    assert got == [(1, "Hello"), (2, "[Hello](https://example.org/a)"), (2, "![page 2 figure 1](d.assets/p2-i0.png)")]
    errors = spark.read.parquet(f"{out}/errors").collect()
    assert [(r.doc_id, r.page, r.bad_runs, r.problem) for r in errors] == [("d", 3, 1, "box")]


def test_log_keeps_the_type_of_ids(spark):
    from quire.operators import log as LG

    log = spark.createDataFrame([("a", 1, "hide", "p1b1"), ("b", 1, "undo", "p1b1")], "doc_id string, seq int, action string, block_id string")
    assert {r.doc_id: r.undo_depth for r in LG.fold_decision_log(log).collect()} == {"a": 1, "b": 0}


def test_running_totals_by_any_order(spark):
    rows = [("x", i * 7 % 101, i) for i in range(101)] + [(None, 5, 3), (None, 4, 2)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r.g, r.o): (r.n, r.v_upto, r.n_all) for r in O.running(df, ["g"], ["o"], totals=True, n=F.lit(1), v_upto=F.col("v")).collect()}
    value = {o: v for g, o, v in rows if g}
    for o in value:
        assert got["x", o] == (o + 1, sum(value[k] for k in range(o + 1)), 101)
    assert got[None, 4] == (1, 2, 2) and got[None, 5] == (2, 5, 2)


def test_drop_caps_returns_every_file(spark):
    files = [("d", 1, "a", 5), ("d", 2, "._x", 1), ("d", 3, "b", 50), ("d", 4, "c", 5), ("d", 5, "e", 3), ("d", 6, "f", 1), ("k", 1, "a", 1)]
    df = spark.createDataFrame(files, "drop_id string, arrival int, name string, bytes long")
    got = {(r.drop_id, r.arrival): r.verdict for r in I.drop_caps(df, max_files=9, max_file=20, max_drop=12).collect()}
    assert got == {
        ("d", 1): "taken", ("d", 2): "junk", ("d", 3): "too large", ("d", 4): "taken", ("d", 5): "drop too large",
        ("d", 6): "after the stop", ("k", 1): "taken",
    }


def test_tree_order_is_by_character(spark):
    """Signs go by their code, not by a language's rules; what has no name is last."""
    names = ["Foo-bar#13", "Foo#12", "\u00c9cole", "eclair", "Foo_a", None, "foo b"]
    df = spark.createDataFrame([(1, n, True) for n in names], "parent long, name string, is_file boolean")
    got = [r.name for r in I.tree_order(df).orderBy("place").collect()]
    assert got == ["eclair", "\u00c9cole", "foo b", "Foo#12", "Foo-bar#13", "Foo_a", None]
