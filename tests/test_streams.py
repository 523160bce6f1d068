"""Streams that keep what they did: landings converted once, decisions merged when read."""

import json
import os

import pytest

from quire.streaming import jobs as J

RUN = {"text": "Hello", "lead": False, "trail": False, "box": {"x": 72.0, "y": 90.0, "w": 30.0, "h": 9.0}, "base": 96.0, "size": 10.0,
       "bold": False, "italic": False, "font": "F"}


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def land(place, name, doc_id, *texts):
    pages = [
        {"n": n, "width": 612.0, "height": 792.0, "runs": [{**RUN, "text": t}], "lines": [], "pictures": [], "links": [], "blocks": []}
        for n, t in enumerate(texts, 1)
    ]
    (place / "in" / name).write_text(json.dumps({"doc_id": doc_id, "format": 1, "pages": pages}))


def go(spark, place, **given):
    J.convert_stream(J.layout_stream(spark, str(place / "in")), str(place / "out"), str(place / "check"), **given).awaitTermination()


def landed(spark, place):
    return sorted((r.batch, r.doc_id, r.state) for r in spark.read.parquet(str(place / "out" / "landed")).collect())


def test_a_landing_is_converted_once(spark, place):
    land(place, "a.json", "a", "one", "two")
    land(place, "b.json", "b", "other")
    go(spark, place)
    assert landed(spark, place) == [(0, "a", "convert"), (0, "b", "convert")]
    land(place, "a-again.json", "a", "one", "two")  # the same under another name
    land(place, "b-again.json", "b", "changed")
    go(spark, place)
    assert landed(spark, place)[2:] == [(1, "a", "done"), (1, "b", "convert")]
    assert spark.read.parquet(str(place / "out" / "md_lines")).where("batch = 1 and doc_id = 'a'").count() == 0
    text = sorted((r.doc_id, r.page, r.text) for r in J.converted(spark, str(place / "out"), "blocks").collect())
    assert text == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "changed")]
    # decisions pin a reading; another version reads the rest again
    land(place, "a-new.json", "a", "rewritten")
    land(place, "b-third.json", "b", "changed")
    land(place, "c.json", "c", "new, and decided")
    go(spark, place, decided=spark.createDataFrame([("a",), ("c",)], "doc_id string"), version=6)
    assert landed(spark, place)[4:] == [(2, "a", "pinned"), (2, "b", "convert"), (2, "c", "convert")]
    text = sorted((r.doc_id, r.text) for r in J.converted(spark, str(place / "out"), "blocks").collect())
    assert text == [("a", "one"), ("a", "two"), ("b", "changed"), ("c", "new, and decided")]


def test_several_revisions_in_a_batch(spark, place):
    for n, text in enumerate(("first", "second", "third")):
        land(place, f"{n}.json", "a", text)
        os.utime(place / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    go(spark, place)
    assert [r.text for r in J.converted(spark, str(place / "out"), "blocks").collect()] == ["third"]


@pytest.mark.parametrize("every", [2, 100])
def test_latest_decisions(spark, place, every):
    log, out = [], str(place / "out")
    for n in range(5):
        rows = [(d, 10 * n + d, f"act{n}", f"p1b{(d + n) % 4}") for d in range(6 if n < 4 else 1)]
        log += rows
        spark.createDataFrame(rows, "doc_id int, seq long, action string, block_id string").coalesce(1).write.parquet(str(place / "in" / f"n{n}"))
        stream = spark.readStream.schema("doc_id int, seq long, action string, block_id string").parquet(str(place / "in" / "n*"))
        J.latest_decisions_stream(stream, out, str(place / "check"), every).awaitTermination()
    want = {}
    for d, seq, action, block in sorted(log, key=lambda r: r[1]):
        want[d, block] = (action, seq)
    assert {(r.doc_id, r.block_id): (r.action, r.seq) for r in J.read_latest(spark, out).collect()} == want
    # a batch of one row writes one bucket
    assert len([f for f in os.listdir(f"{out}/deltas/batch=4") if f.startswith("bucket=")]) == 1
    assert os.path.isdir(f"{out}/whole") == (every == 2)
