"""Digest trees: what differs is found, whatever order rows come in."""

from quire.operators import digests as D
from quire.plans import convert as C

BLOCKS = "doc_id string, page int, ord int, block_id string, text string"


def blocks(spark, change=()):
    rows = {(d, p, o): (d, p, o, f"p{p}b{o}", f"{d} {p} {o}") for d in "abc" for p in range(1, 200 if d == "c" else 3) for o in range(2)}
    for key, text in change:
        if text is None:
            del rows[key]
        else:
            rows[key] = (*key, f"p{key[1]}b{key[2]}", text)
    return spark.createDataFrame(list(rows.values()), BLOCKS)


def test_changes_are_found(spark):
    before = D.digest_tree(blocks(spark))
    assert D.changed_pages(D.digest_tree(blocks(spark).repartition(5)), before).count() == 0
    change = [(("a", 1, 1), "other"), (("b", 2, 0), None), (("b", 2, 1), None), (("c", 150, 0), None), (("c", 199, 2), "one more"), (("d", 1, 0), "new")]
    now = D.digest_tree(blocks(spark, change))
    assert {tuple(r) for r in D.changed_pages(now, before).collect()} == {("a", 1), ("b", 2), ("c", 150), ("c", 199), ("d", 1)}
    assert {r.doc_id for r in D.changed_documents(now, before).collect()} == set("abcd")
    # two pages that trade places, a null against an empty text, decisions beside blocks
    swapped = D.digest_tree(blocks(spark, [(("a", 1, 0), "a 2 0"), (("a", 2, 0), "a 1 0")]))
    assert {tuple(r) for r in D.changed_pages(swapped, before).collect()} == {("a", 1), ("a", 2)}
    one, two = (spark.createDataFrame([("a", 1, t)], "doc_id string, page int, t string") for t in (None, ""))
    assert D.changed_pages(D.digest_tree(one), D.digest_tree(two)).count() == 1
    decided = spark.createDataFrame([("b", 1, "hide")], "doc_id string, page int, action string")
    assert [tuple(r) for r in D.changed_pages(D.digest_tree(blocks(spark), decided), before).collect()] == [("b", 1)]


def test_only_changed_documents_are_emitted(spark):
    rows = [(d, 1, 0, "p1b0", "text", d, "para", 0, 0, False, False, "", 10.0, "F", -1, None) for d in ("a", "b")]
    ddl = "doc_id string, page int, ord int, block_id string, kind string, text string, role string, level int, depth int, bold boolean, italic boolean, marker string, size double, font string, picture int, href string"
    made = spark.createDataFrame(rows, ddl).selectExpr("*", "named_struct('x', 72d, 'y', 80d, 'w', 10d, 'h', 9d) AS box", "array(0) AS lines")
    pages = spark.createDataFrame([("a", 1, 612.0, 792.0), ("b", 1, 612.0, 792.0)], "doc_id string, page int, width double, height double")
    first = C.re_emit(D.digest_tree(made).limit(0), made, pages)
    assert {r.doc_id for r in first.markdown.lines.collect()} == {"a", "b"}
    again = C.re_emit(first.tree, made, pages)
    assert again.markdown.lines.count() == 0 and again.changed.count() == 0
    other = made.selectExpr("* except (text)", "CASE doc_id WHEN 'a' THEN 'changed' ELSE text END AS text")
    assert [(r.doc_id, r.text) for r in C.re_emit(first.tree, other, pages).markdown.lines.collect()] == [("a", "changed")]
