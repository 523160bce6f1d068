"""Quotes in texts against a plain edit table."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quire.operators import quotes as Q, score as SC


def edits(needle, hay):
    n, h = ([*t.encode("utf-16-le").hex(" ", 2).split()] for t in (needle, hay))
    row = [0] * (len(h) + 1)
    for i, c in enumerate(n, 1):
        new = [i]
        for j, x in enumerate(h, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé漢🙂x"])
def test_nearest_all(letters):
    rng = random.Random(len(letters))
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    hays, needles, owner, limit = [draw(rng.choice([0, 3, 40, 200])) for _ in range(12)] + [""], [], [], []
    for _ in range(250):
        i = rng.randrange(len(hays))
        t = hays[i]
        a = rng.randrange(len(t) + 1)
        q = list(t[a : a + rng.randrange(1, 70)])
        for _ in range(rng.randrange(7)):
            k = rng.randrange(len(q) + 1)
            q[k : k + rng.randrange(2)] = draw(rng.randrange(2))
        needles.append("".join(q) if rng.random() < 0.9 else draw(rng.randrange(1, 50)))
        owner.append(i)
        limit.append(rng.randrange(8))
    got = Q.nearest_all(*Q.letters(pa.array(hays)), *Q.letters(pa.array(needles)), np.array(owner), np.array(limit))
    assert got.tolist() == [min(edits(q, hays[i]), k + 1) for q, i, k in zip(needles, owner, limit)]
    assert len(set(got.tolist())) > 3


def test_one_letter_again_and_again():
    hay, needles = "a" * 30_000 + "b" + "a" * 30_000, ["a" * 40, "a" * 20 + "b" + "a" * 20, "b" * 3 + "a" * 40, "c" * 30]
    n = len(needles)
    got = Q.nearest_all(*Q.letters(pa.array([hay])), *Q.letters(pa.array(needles * 20)), np.zeros(20 * n, int), np.full(20 * n, 4))
    assert got.tolist() == [0, 0, 2, 5] * 20


def test_many_quotes_of_one_text(spark, monkeypatch):
    """Shares of an input's quotes, inputs without a layer, quotes without letters."""
    monkeypatch.setattr(Q, "BESIDE", 7)
    text = " ".join(f"word{i}x" for i in range(300))
    layers = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "input string, text string")
    quotes = [("a", i, f"Word{i}x, word{i + 1}x! word{i + 2}x", None) for i in range(50)] + [("a", 100, "--", None), ("b", 1, "some", 0), ("d", 1, "some", 0)]
    quotes += [("a", 101, "word5x wrd6x word7x", 0), ("a", 102, "nothing like it here at all", 2), ("c", 1, "ab", 2)]
    got = {(r.input, r.quote_no): (r.exact, r.found) for r in SC.quotes_found(layers, spark.createDataFrame(quotes, "input string, quote_no int, text string, slack int")).collect()}
    assert got == {("a", i): (True, True) for i in range(50)} | {("a", 101): (False, True), ("a", 102): (False, False), ("c", 1): (False, True), ("b", 1): (False, False)}
