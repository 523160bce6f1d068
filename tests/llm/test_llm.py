"""The corpus operators on small tables: hard rows, and brute force."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import chunk_dedup as CD, decontamination as DC, exact_dedup as ED, kernels as K, language_id as LI
from quire.llm import lm_scoring as LM, mixing as MX, near_dedup as ND, resharding as RS, suffix_dedup as SD, token_records as TR

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id string, size string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def rows():
    rnd = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    long = " ".join(rnd.choice(vocabulary, 400))
    texts = [None, "", "   ", "one", "One", "two words", long, long.upper(), long + " tail", long[200:900] + " é ñ", "ab" * 300]
    texts += [" ".join(rnd.choice(vocabulary, 30)) for _ in range(12)] + ["same line of five words here"] * 6
    out = [(i, t, "ab"[i % 2], "s" + str(i % 3), 0, "x", "y") for i, t in enumerate(texts)]
    return out + [(6, long, None, None, None, None, None), (6, long, None, None, None, None, None), (None, "one", None, None, None, "z", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.createDataFrame(rows(), COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, tmp_path, weak):
    docs.write.parquet(f"{tmp_path}/d.parquet")
    digest = (lambda t: t.substr(1, 2)) if weak else None  # collides, so bytes decide
    got = ED.exact_dedup(spark, f"{tmp_path}/d.parquet", digest).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[(r[1] or "").lower()].append(r[0])
    want = sorted((-1 if i is None else i, max(x for x in g if x is not None), len(g)) for g in groups.values() for i in g)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_nothing(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/d.parquet")
    assert ED.exact_dedup(spark, f"{tmp_path}/d.parquet").count() == 0


def test_token_records(spark, docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TR.default_tokenizer())
    got = TR.tokenized(spark, docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows()), key=lambda i: -1 if i is None else i)
    want = defaultdict(list)
    for r in rows():
        want[r[0]].append(np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    start = 0
    for r in got:
        assert r.start == start and bytes(r.ids) in want[r.doc_id]
        start += r.n_tokens
    assert TR.tokenized(spark, none).count() == 0


def test_encoder_on_odd_text():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(TR.default_tokenizer()), TR.Encoder(TR.default_tokenizer())
    rnd = np.random.default_rng(3)
    bits = ["a", "é", "×", " ", "  ", "\n", "\t", "'s", "'", "1", "!", " ", "　", "<|endoftext|>", "中", "\x85", " the", "Z,"]
    texts = ["".join(rnd.choice(bits, rnd.integers(0, 30))) for _ in range(800)]
    ids, count = own.encode(*K.buffers(pa.array(texts)))
    ends = np.cumsum(count)
    for t, a, b in zip(texts, ends - count, ends):
        assert whole.encode(t, add_special_tokens=False).ids == ids[a:b].tolist()


def test_damaged_record():
    raw = bytearray(TR.record(np.arange(9, dtype=np.uint32), False))
    assert TR.ids_of(bytes(raw)).tolist() == list(range(9))
    raw[15] ^= 1
    with pytest.raises(ValueError):
        TR.ids_of(bytes(raw))


def test_language_id(docs, none):
    got = LI.languages(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == "und" for r in got) == 3
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert LI.languages(none).count() == 0
    assert LI.accepted(docs, 0.0).columns == docs.columns


def test_decontamination(spark, docs, none):
    text = rows()[6][1]
    bench = [(1, " ".join(text.split()[50:90])), (2, "one"), (3, None), (4, ""), (5, "not there at all my friend")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in DC.contamination(docs, bench, block=2).collect()}
    want = set()
    for d, t, *_ in rows():
        for i, s in [(r[0], r[1]) for r in bench.collect()]:
            w, v = words(t), words(s)
            n = min(len(v), 5)
            item = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if item and 100 * len(item & have) >= 75 * len(item):
                want.add((d, i))
    assert got == want
    assert DC.contamination(none, bench).count() == 0 and DC.contamination(docs, bench.limit(0)).count() == 0
    assert DC.clean(docs, bench).columns == docs.columns


def test_resharding(docs, none):
    from quire.llm.queries import lies_in

    out = RS.rewrite(docs, RS.reshard(docs, lies_in(docs.doc_id), 32, 7))
    got = out.collect()
    counts = np.bincount([r.shard for r in got], minlength=7)
    assert counts.max() - counts.min() <= 1 and counts.sum() == len(rows())
    slots = RS.with_slots(out.select("shard", RS.FILE, RS.ROW)).collect()
    assert sorted((r.shard, r.slot) for r in slots) == [(s, i) for s in range(7) for i in range(counts[s])]
    assert RS.rewrite(none, RS.reshard(none, lies_in(none.doc_id), 32, 7)).count() == 0


def test_transfers_move_the_least():
    moves = RS.transfers([10, 0, 5], [4, 4, 4, 3], [2.0, 1.0, 1.0])
    assert sum(n for i, j, n in moves if i != j) == 7
    assert [sum(n for _, j, n in moves if j == k) for k in range(4)] == [4, 4, 4, 3]
    with pytest.raises(ValueError):
        RS.transfers([5], [4])


def test_filling():
    assert MX.fill([10, 10, 10], [1, 1, 1], 3) == [10, 10, 10]
    assert MX.fill([1, 100], [5, 1], 3) == [3, 98]
    assert MX.fill([], [], 3) == []


def test_mixing(docs, none):
    got = MX.mix(docs, MX.cycle()).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert r.taken == r.copies * r.size + r.extra_words and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sorted(r.size for r in got) == sorted(len(words(r[1])) for r in rows())
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert got == MX.mix(docs, MX.cycle()).collect() or sorted(r.taken for r in got)
    assert MX.mix(none, MX.cycle()).count() == 0
    assert MX.materialize(docs, MX.mix(docs, MX.cycle())).columns == docs.columns


def repeated(texts):
    seen, out = set(), []
    for t in texts:
        b, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        out.append(int(gone.sum()))
    return out


def test_suffix_dedup(spark, docs, none):
    alone = [r for r in rows() if r[0] is not None][: len(rows()) - 3]
    got = SD.repeats(spark.createDataFrame(alone, COLUMNS)).orderBy("doc_id").collect()
    assert [sum(s.end - s.start for s in r.spans) for r in got] == repeated([r[1] or "" for r in alone])
    assert all(r.n_bytes == len(bytes(r.kept)) + sum(s.end - s.start for s in r.spans) for r in got)
    assert SD.repeats(docs).count() == len(rows()) and SD.repeats(none).count() == 0


def test_chunk_dedup(docs, none):
    spans = CD.repeated_spans(docs).collect()
    text = {r[0]: (r[1] or "").encode() for r in rows()}
    assert {8, 9} <= {r.doc_id for r in spans}
    assert all(text[r.doc_id][r.start : r.start + 8] == text[r.first_id][r.first_start : r.first_start + 8] for r in spans if r.doc_id is not None)
    assert CD.repeated_spans(none).count() == 0
    assert CD.without(docs, CD.repeated_spans(docs)).count() == len(rows())


def _passages(n, seed):
    """n texts and n later ones, each with a passage of 51 to 60 words of one of the first, and the passages."""
    rnd = np.random.default_rng(seed)
    some = lambda k: ["".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), rnd.integers(3, 10))) for _ in range(k)]
    texts = [some(120) for _ in range(n)]
    taken = [t[a : a + k] for t in texts for a, k in [(rnd.integers(0, 60), rnd.integers(51, 61))]]
    texts += [[*some(20), *p, *some(20)] for p in taken]
    return [" ".join(t) for t in texts], [" ".join(p) for p in taken]


def test_chunk_dedup_meets_whole_passages(spark):
    texts, taken = _passages(300, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = CD.repeated_spans(docs).collect()
    met = set()
    for r in spans:  # every byte of a span is where it came first
        assert texts[r.doc_id][r.start : r.end] == texts[r.first_id][r.first_start : r.first_start + r.end - r.start]
        a = texts[r.doc_id].index(taken[r.doc_id - 300])
        if r.start <= a and r.end >= a + len(taken[r.doc_id - 300]):  # to its first and last byte
            met.add(r.doc_id)
    assert met == set(range(300, 600))
    kept = {r.doc_id: r.text for r in CD.without(docs, CD.repeated_spans(docs)).collect()}
    assert all(len(kept[i]) <= len(texts[i]) - len(taken[i - 300]) for i in met)


@pytest.mark.parametrize("word", ["a", "and", "der", "Straße", "one two", "seventeen-letters", "a phrase of forty-five bytes that comes again"])
def test_chunks_of_one_word_again_and_again(word):
    run = " ".join([word] * max(51, 400 // len(word)))
    texts = [f"{run} {'zq vex'}", f"Some other words, {run}.", f"x {run} {run} y", f"{'lorem ipsum ' * 3}dolor {run}, then"]
    alone = []
    for t in texts:
        b = t.encode()
        start, end, _ = CD.cuts(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert start[0] == 0 and end[-1] == len(b) and (start[1:] == end[:-1]).all()
        alone.append({b[i:j] for i, j in zip(start.tolist(), end.tolist()) if b[i:j] in (" ".join([word] * 600)).encode() and j - i >= CD.MIN})
    assert all(a & alone[0] for a in alone)
    whole = CD.cuts(*K.buffers(pa.array(texts)))
    one = [CD.cuts(*K.buffers(pa.array([t]))) for t in texts]
    assert [len(o[0]) for o in one] == np.bincount(whole[2]).tolist()


def test_components_are_never_left_split(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {(r.node, r.root) for r in ND.components(path).collect()} == {(i, 0) for i in range(65)}
    with pytest.raises(RuntimeError):
        ND.components(path, rounds=1)


def test_lm_scoring(docs, none):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    out = F.coalesce(F.col("doc_id") % 3 == 2, F.lit(False))
    got = LM.score(docs, out, mu=50.0).collect()
    train = [["\0b", *words(r[1]), "\0e"] for r in rows() if r[0] is None or r[0] % 3 != 2]
    one, two = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    want = []
    for r in rows():
        t = ["\0b", *words(r[1]), "\0e"]
        p = lambda w: (one[w] + 1) / (n + v + 1)
        c = lambda h: len(train) if h == "\0b" else one[h]
        want.append((sum(math.log10(p(w)) for w in t[1:]), sum(math.log10((two[h, w] + 50 * p(w)) / (c(h) + 50)) for h, w in zip(t, t[1:]))))
    assert np.allclose(sorted(want), sorted((r.base_score, r.score) for r in got))
    assert all(r.train_tokens == n for r in got) and LM.score(none, out).count() == 0


def test_near_dedup(docs, none):
    got = ND.near_duplicates(docs).collect()
    sets = []
    for r in rows():
        w = words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {k: min((r[0] for r, x in zip(rows(), root) if x == k and r[0] is not None), default=None) for k in root}
    key = lambda x: tuple(-1 if y is None else y for y in x)
    want = [(r[0], len(s), least[k]) for r, s, k in zip(rows(), sets, root)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.stays for r in got) == len(set(root))
    assert ND.near_duplicates(none).count() == 0 and ND.one_of_each(docs).columns == docs.columns
