"""Layout page by page: broken and slow pages are named and stop no other."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import structure as S
from quire.plans import convert as C

RUNS = "doc_id string, page int, run_no int, text string, lead boolean, trail boolean, box struct<x:double,y:double,w:double,h:double>, base double, size double, bold boolean, italic boolean, font string"


def run(doc, page, n, text="words of a line", base=None, w=200.0, y=None):
    y = 100.0 + 14 * n if y is None else y
    return (doc, page, n, text, False, False, (72.0, y, w, 10.0), y + 10 if base is None else base, 10.0, False, False, "F")


def test_one_page_stops_no_other(spark):
    rows = [run("a", p, n) for p in (1, 2, 3, 4) for n in range(3)] + [run("b", 1, 0)]
    rows += [run("a", 2, 9, w=float("inf")), run("a", 3, 9, text=None), run("a", None, 0), run("c", 1, 0, base=float("nan"))]
    pictures = spark.createDataFrame(
        [("a", p, 0, (72.0, 120.0, 100.0, 110.0), "a.png", 200, 200) for p in (1, 2, 4)],
        "doc_id string, page int, pic_no int, box struct<x:double,y:double,w:double,h:double>, path string, px_w int, px_h int",
    )
    seconds = F.when((F.col("doc_id") == "a") & (F.col("page") == 4), 0.0).otherwise(60.0)
    laid = C.lay_out(spark.createDataFrame(rows, RUNS), pictures=pictures, seconds=seconds)
    status = {(r.doc_id, r.page): (r.state, r.problem) for r in laid.status.collect()}
    assert status == {
        ("a", 1): ("laid out", None), ("a", 2): ("broken", "box"), ("a", 3): ("broken", "text"), ("a", 4): ("slow", None),
        ("a", None): ("broken", "page"), ("b", 1): ("laid out", None), ("c", 1): ("broken", "base"),
    }
    assert {(r.doc_id, r.page) for r in laid.blocks.collect()} == {("a", 1), ("b", 1)}
    assert C.read_blocks(spark.createDataFrame(rows, RUNS)).where("doc_id = 'a'").select("page").distinct().count() == 2


def test_a_page_has_its_time():
    n = 200
    x, y = np.zeros(n), np.arange(n) * 12.0
    page = [x, y, x + 100, x + 10, x + 10, x > 0, x > 0, x > 0]
    assert len(S._structure(*page)[0]) == n
    with pytest.raises(S.Late):
        S._structure(*page, time.perf_counter())


def test_broken_pages_are_taken_out_packed(spark):
    """A run that can't be placed travels with its page: runs are shuffled once, as packs, and not to be sorted out."""
    from quire.operators import lines as L

    rows = [run("a", p, n) for p in (1, 2) for n in range(3)] + [run("a", 2, 9, w=float("nan")), run("b", 1, 0, text=None), run("b", 2, 0)]
    runs = spark.createDataFrame(rows, RUNS)
    broken = C.broken_pages(runs)
    lines = L.runs_to_lines(runs, broken)
    assert sorted({(r.doc_id, r.page) for r in lines.collect()}) == [("a", 1), ("b", 2)]
    assert [tuple(r) for r in broken.orderBy("doc_id").collect()] == [("a", 2, 1, "box"), ("b", 1, 1, "text")]
    text = lines._jdf.queryExecution().executedPlan().toString()
    anti = text[text.index("LeftAnti") :].splitlines()
    assert "Aggregate" in "".join(anti[1:3]) and not any("Exchange" in x for x in anti[1:2])
