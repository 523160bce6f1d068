"""The registered queries and the pipeline on the smallest supplied tables, against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from quire.llm import chunk_dedup as CD, language_id as LI, queries as Q, token_records as TR

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no supplied tables")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def docs(spark):
    from quire.session import prepare

    prepare(spark)
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SMALL):
        name = f.removesuffix(".parquet")
        at = f"{SMALL}/{f}/*.parquet" if os.path.isdir(f"{SMALL}/{f}") else f"{SMALL}/{f}"
        db.execute(f"create view {name} as select * from '{at}'")
    return db


@pytest.mark.parametrize("name", [n for n, (_, sql) in Q.QUERIES.items() if sql])
def test_queries_with_sql(spark, duck, name):
    fn, sql = Q.QUERIES[name]
    got, want = fn(spark, SMALL), duck.execute(sql)
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(got.columns)
    line = lambda r: repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r))
    assert sorted(map(line, got.select(*order).collect())) == sorted(map(line, want.fetchall()))


def _likeliest(network, text):
    """(language, score) by plain convolution of each window."""
    data = np.frombuffer(text.encode(), np.uint8)
    x, _, have = LI.windows(data, np.array([0, len(data)]))
    p = (network.softmax(network.pooled(x)[0]) * have[:, None]).sum(0) / have.sum()
    return network.languages[int(p.argmax())], float(p.max())


def _network(table):
    out = LI.held_out(F.col("doc_id"))
    return LI.fit(table.where(~out).select(F.col("doc_id").alias("_key"), "text", "lang"))


def test_op2(spark, docs):
    got = {r.doc_id: r for r in Q.op2_language_id(spark, SMALL).collect()}
    network = _network(spark.read.parquet(f"{SMALL}/documents.parquet"))
    right = []
    for d in docs:
        r = got.pop(d.doc_id)
        assert r.held_out == (remainder(d.doc_id, 5) == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in d.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        lang, score = _likeliest(network, d.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4
        if r.held_out and d.lang:
            right.append(r.lang_pred == d.lang)
    assert not got and np.mean(right) > 0.9


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TR.default_tokenizer())
    start, want = 0, []
    for d in docs:
        ids = [*whole.encode(d.text or "", add_special_tokens=False).ids, 0]
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = Q.op3_token_records(spark, SMALL).orderBy("doc_id").select("doc_id", "start", "n_tokens", "ids_crc32")
    assert [tuple(r) for r in got.collect()] == want


def _op4(text):
    """Spans from chunks that came earlier end to end, each read on byte by byte."""
    seen, want = {}, []
    for i, t in text.items():
        start, end, _ = CD.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)])) if t else ([], [], None)
        chunks, runs = list(zip(map(int, start), map(int, end))), []  # runs: first chunk, last chunk, first place
        for k, (a, b) in enumerate(chunks):
            first = seen.setdefault(t[a:b], (i, a))
            if first == (i, a):
                continue
            if runs and runs[-1][1] == k - 1 and first == (runs[-1][2][0], runs[-1][2][1] + a - chunks[runs[-1][0]][0]):
                runs[-1][1] = k
            else:
                runs.append([k, k, first])
        for k, m, (j, at) in runs:
            a, b, f = chunks[k][0], chunks[m][1], text[j]
            low, high = max(0, a - CD.REACH), min(len(t), b + CD.REACH)
            end = at + b - a
            left = right = 0
            while a - left > low and at > left and t[a - left - 1] == f[at - left - 1]:
                left += 1
            while b + right < high and end + right < len(f) and t[b + right] == f[end + right]:
                right += 1
            if b + right - (a - left) >= 96:
                want.append((i, j, a - left, b + right, at - left, m - k + 1))
    return want


def test_op4(spark, docs):
    text = {d.doc_id: (d.text or "").encode() for d in docs}
    got = Q.op4_chunk_dedup(spark, SMALL).select("doc_id", "first_id", "start", "end", "first_start", "n_chunks")
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(_op4(text)) and rows
    for i, j, a, b, at, _ in rows:
        assert text[i][a:b] == text[j][at : at + b - a] and (j, at) < (i, a)
    # of all stretches of bytes that come again, told from the texts alone, those of 250 bytes are met
    seen, runs, met = set(), 0, 0
    for i, t in text.items():
        again = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - 249):
            if t[a : a + 250] in seen:
                again[a : a + 250] = True
            seen.add(t[a : a + 250])
        edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0))
        for a, b in zip(edge[::2], edge[1::2]):
            runs += 1
            met += any(r[0] == i and r[2] < b and r[3] > a for r in rows)
    assert runs > 20 and met >= 0.98 * runs


def test_op6(spark, docs):
    got = {r.doc_id: r for r in Q.op6_resharding(spark, SMALL).collect()}
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for d in docs:
        r, raw = got[d.doc_id], (d.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        assert r.old_shard == remainder(d.doc_id, Q.OLD_SHARDS)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(Q.SHARDS)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[j]) for j in range(Q.SHARDS)]
    assert max(counts) - min(counts) <= 1
    old = Counter(remainder(d.doc_id, Q.OLD_SHARDS) for d in docs)
    assert sum(r.old_shard != r.shard for r in got.values()) == sum(max(0, counts[j] - old[j]) for j in range(Q.SHARDS))


def _targets(sizes):
    """Water-filling by bisection on the level, for sizes in order of their sources."""
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    total, low, high = float(sum(sizes)), 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * s, w * level) for s, w in zip(sizes, weights)) < total else (low, level)
    return [min(3 * s, w * high) for s, w in zip(sizes, weights)]


def _sources(rows):
    size = Counter()
    for r in rows:
        size[r.source] += len(words(r.text))
    return sorted(size, key=lambda s: (s is None, s or "")), size


def test_op7(spark, docs):
    got = {r.doc_id: r for r in Q.op7_mixing(spark, SMALL).collect()}
    sources, size = _sources(docs)
    target, taken = dict(zip(sources, _targets([size[s] for s in sources]))), Counter()
    for d in docs:
        r = got[d.doc_id]
        assert (r.size, r.source_size) == (len(words(d.text)), size[d.source]) and r.taken <= 3 * r.size
        assert math.isclose(r.target, target[d.source], rel_tol=1e-9)
        taken[d.source] += r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 1 for s in sources)
    again = {r.doc_id: r for r in Q.op7_mixing(spark, SMALL).collect()}
    assert again == got


def test_op8(spark, docs):
    got = {r.doc_id: r for r in Q.op8_suffix_dedup(spark, SMALL).collect()}
    seen, total = set(), 0
    for d in docs:
        b = (d.text or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 99):
            h = hashlib.blake2b(b[i : i + 100], digest_size=16).digest()
            if h in seen:
                gone[i + 1 : i + 101] = True
            seen.add(h)
        kept = np.frombuffer(b, np.uint8)[~gone[1:-1]].tobytes()
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed) == (len(b), int(gone.sum())) and r.n_spans == int((gone[1:] & ~gone[:-1]).sum())
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
        total += r.n_removed
    assert len(got) == len(docs) and total


def test_op9(spark, docs):
    got = {r.doc_id: r for r in Q.op9_lm_scoring(spark, SMALL).collect()}
    tokens = {d.doc_id: ["\0b", *words(d.text), "\0e"] for d in docs}
    train = [t for i, t in tokens.items() if remainder(i, 7) != 2]
    one, two = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (n + v + 1)
    c = lambda h: len(train) if h == "\0b" else one[h]
    assert len(got) == len(docs)
    for i, t in tokens.items():
        r = got[i]
        assert r.held_out == (remainder(i, 7) == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t) - 1, sum(one[w] > 0 for w in t[1:]), n)
        assert math.isclose(r.base_score, sum(math.log10(p(w)) for w in t[1:]), rel_tol=1e-9)
        smooth = sum(math.log10((two[h, w] + 200 * p(w)) / (c(h) + 200)) for h, w in zip(t, t[1:]))
        assert math.isclose(r.score, smooth, rel_tol=1e-9)
    gain = [got[i].score - got[i].base_score for i in tokens if remainder(i, 7) == 2 and len(tokens[i]) > 20]
    assert np.mean(gain) > 0


def _components(rows):
    """The place in rows of the first of each row's group."""
    own = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and root[i] != root[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return own, root


def test_op10(spark, docs):
    own, root = _components(docs)
    want = [(d.doc_id, len(s), docs[k].doc_id, docs[k].doc_id == d.doc_id) for d, s, k in zip(docs, own, root)]
    got = Q.op10_near_dedup(spark, SMALL).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == want


def _items(spark):
    """(width, shingles) of each benchmark item that has words."""
    out = []
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r.text)
        k = min(len(w), 5)
        out += [(k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})] if w else []
    return out


def test_pipeline(spark, docs):
    """Every stage on what its predecessor kept, and run() as their composition."""
    stages = dict(CP.STAGES)
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    key = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars)
    settled = lambda name, df: CP.settle(stages[name](spark, df, SMALL))

    network = _network(table)
    spoken = [d for d in docs if any(c.isalpha() for c in d.text or "") and _likeliest(network, d.text)[1] >= 0.3]
    one = settled("language_id", table)
    assert one.columns == table.columns and sorted(map(key, one.collect()), key=str) == sorted(map(key, spoken), key=str)

    _, root = _components(spoken)
    alone = [d for i, d in enumerate(spoken) if root[i] == i]
    two = settled("near_dedup", one)
    assert sorted(r.doc_id for r in two.collect()) == [d.doc_id for d in alone]

    items = _items(spark)
    clean = []
    for d in alone:
        w = words(d.text)
        have = {k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for k in {k for k, _ in items}}
        if not any(100 * len(s & have[k]) >= 75 * len(s) for k, s in items):
            clean.append(d)
    three = settled("decontamination", two)
    assert sorted(r.doc_id for r in three.collect()) == [d.doc_id for d in clean] and len(clean) < len(alone)

    four = settled("mixing", three)
    mixed, by_id = four.collect(), {d.doc_id: d for d in clean}
    assert all(key(r) == key(by_id[r.doc_id]) for r in mixed)
    sources, size = _sources(clean)
    target, longest, taken = dict(zip(sources, _targets([size[s] for s in sources]))), Counter(), Counter()
    for r in mixed:
        taken[r.source] += len(words(r.text))
    for d in clean:
        longest[d.source] = max(longest[d.source], len(words(d.text)))
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in sources)

    ids = sorted(r.doc_id for r in mixed)
    for last in (stages["sharding"](spark, four, SMALL), CP.run(spark, SMALL)):
        got = last.collect()
        counts = np.bincount([r.shard for r in got], minlength=Q.SHARDS)
        assert sorted(r.doc_id for r in got) == ids and counts.max() - counts.min() <= 1
        assert {"doc_id", "text", "lang", "source", "n_chars", "old_shard", "shard"} == set(last.columns)


def test_pipeline_of_nothing_and_hard_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "  "), (None, "one two"), (4, "same words here and no more of them"), (4, "same words here and no more of them"), (5, "x" * 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, _rank string"
    odd = spark.createDataFrame([(i, t, None, None, None, "s", "r") for i, t in rows], schema)
    for table in (odd, odd.limit(0)):
        df = CP.settle(table)
        for name, stage in CP.STAGES:
            df = CP.settle(stage(spark, df, SMALL))
            assert set(CP.COLUMNS) <= set(df.columns)
            assert name == CP.STAGES[-1][0] or df.columns == CP.COLUMNS
        assert df.where("text is null or text = ''").count() == 0
