"""Periodic runs against brute force: word sequences of many kinds, and the query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import periodic_runs as PR, queries as Q

SMALL = "/root/testdata/sf0.001"


def runs_of(words, least=12):
    """(start, end, period) of every run, distance by distance."""
    n, found = len(words), {}
    for d in range(1, n // 2 + 1):
        i = 0
        while i < n - d:
            j = i
            while j < n - d and words[j] == words[j + d]:
                j += 1
            if j > i and j + d - i >= max(least, 2 * d):
                found.setdefault((i, j + d), d)
            i = max(j, i) + 1
    return sorted(((a, b, d) for (a, b), d in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for a, b, d in runs for i in range(a + d, b)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


def invented(rng):
    out, n, k = [], rng.randint(0, 160), rng.choice([1, 2, 3, 5, 50])
    while len(out) < n:
        kind = rng.random()
        if kind < 0.5:
            unit = [str(rng.randrange(k)) for _ in range(rng.randint(1, 20))]
            out += unit * rng.randint(1, 6) + unit[: rng.randrange(len(unit))]
        elif kind < 0.8 and out:
            i = rng.randrange(len(out))
            out += out[i : i + rng.randint(1, 60)]
        else:
            out.append(str(rng.randrange(3 * k)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_kernel(seed):
    rng = random.Random(seed)
    docs = [invented(rng) for _ in range(30)] + [[rng.choice("ab") for _ in range(120)] for _ in range(10)] + [[]]
    n, (owner, start, length, period), (joined, edges) = PR.collapse(*laid([" ".join(d) for d in docs]))
    for t, d in enumerate(docs):
        own = owner == t
        want = runs_of(d)
        assert list(zip(start[own], (start + length)[own], period[own])) == want
        assert joined[edges[t] : edges[t + 1]].tobytes().decode() == collapsed(d, want)
        assert n[t] == len(d)


def test_transform():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        x, y = (rng.integers(0, PR.PRIME, (3, size)).astype(np.uint64) for _ in range(2))
        assert (PR.backward(PR.forward(x)) == x).all()
        got = PR.backward(PR.forward(x) * PR.forward(y) % np.uint64(PR.PRIME))
        for r in range(3):
            want = [sum(int(x[r, i]) * int(y[r, (j - i) % size]) for i in range(size)) % PR.PRIME for j in range(size)]
            assert got[r].tolist() == want


def test_long_texts():
    """Half a million words: one word, Fibonacci words, two stretches of a word."""
    x, y = "a", "ab"
    while len(y) < 100_000:
        x, y = y, y + x
    same, split = ["w"] * 500_000, ["w"] * 250_000 + ["v"] + ["w"] * 249_999
    for words, want in ((same, [(0, 500_000, 1)]), (split, [(0, 250_000, 1), (250_001, 500_000, 1)])):
        _, (_, start, length, period), _ = PR.collapse(*laid([" ".join(words)]))
        assert list(zip(start, start + length, period)) == want
    _, (_, start, length, period), _ = PR.collapse(*laid([" ".join(y)]))
    w = np.array(list(y))
    for a, n, q in list(zip(start, length, period))[:: max(1, len(start) // 50)]:
        assert (w[a : a + n - q] == w[a + q : a + n]).all() and n >= max(12, 2 * q)
        assert (a == 0 or w[a - 1] != w[a - 1 + q]) and (a + n == len(w) or w[a + n] != w[a + n - q])


def test_odd_rows(spark):
    """Null, empty and blank texts, repeated rows and ids, further columns, no rows."""
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "x " * 12, 1), (4, "x y " * 6, 1), (4, "x y " * 6, 1), (5, "é " * 11, 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, runs int")
    got = {(r.doc_id, r.n_words): (len(r.runs), r.collapsed) for r in PR.periodic_runs(df).collect()}
    assert got == {(1, 0): (0, ""), (2, 0): (0, ""), (3, 0): (0, ""), (None, 12): (1, "x"), (4, 12): (1, "x y"), (5, 11): (0, " ".join("é" * 11))}
    assert PR.periodic_runs(df).count() == len(rows)
    assert PR.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        PR.periodic_runs(df, least=8)


def test_op11(spark):
    from quire.session import prepare

    prepare(spark)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in Q.op11_periodic_runs(spark, SMALL).collect()}
    assert set(got) == set(docs)
    seen = 0
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs, r = runs_of(w), got[i]
        seen += len(runs)
        best = min(runs, key=lambda x: (x[0] - x[1], x[0], x[2]), default=None)
        want = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert seen
