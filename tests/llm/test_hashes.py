"""Words that a power hash takes for one another: Thue-Morse sequences and complements."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import decontamination as DC, kernels as K, lm_scoring as LM, near_dedup as ND, token_records as TR


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (64, 1024, 4096)]


def test_word_hashes():
    rng = np.random.default_rng(4)
    some = {"".join(rng.choice(list("ab"), rng.integers(1, 40))) for _ in range(3000)}
    words = sorted(some | {w for p in PAIRS for w in p})
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    hashes, _ = K.word_hashes(data, np.array([0, len(data)]))
    assert len(np.unique(hashes)) == len(words) == len(hashes)
    one, _ = K.word_hashes(np.frombuffer(words[-1].upper().encode(), np.uint8), np.array([0, len(words[-1])]))
    assert one[0] == hashes[-1]


@pytest.mark.parametrize("pair", PAIRS)
def test_encoder(pair):
    code, whole = TR.Encoder(TR.default_tokenizer()), Tokenizer.from_file(TR.default_tokenizer())
    texts = [f"{w} and {w}." for w in (*pair, *pair[::-1])]
    for group in (texts, texts[:1], texts[1:2]):
        raw = [t.encode() for t in group]
        ids, n = code.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
        for t, got in zip(group, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == whole.encode(t, add_special_tokens=False).ids


def _docs(spark):
    rows = [(i, f"{w} " * 3 + f"one two three {w} four five six") for i, w in enumerate(w for p in PAIRS for w in p)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates(spark):
    rows, df = _docs(spark)
    got = {r.doc_id: r.component_id for r in ND.near_duplicates(df).collect()}
    assert got == {i: i for i, _ in rows}


def test_decontamination(spark):
    rows, df = _docs(spark)
    got = {(r.doc_id, r.item_id) for r in DC.contamination(df, df.selectExpr("doc_id AS item_id", "text")).collect()}
    assert got == {(i, i) for i, _ in rows}


def test_lm_scoring(spark):
    rows, df = _docs(spark)
    held = F.col("doc_id") % 2 == 1
    trained = {w for i, t in rows if i % 2 == 0 for w in t.split()}
    got = {r.doc_id: r.n_known for r in LM.score(df, held).collect()}
    assert got == {i: sum(w in trained for w in t.split()) + 1 for i, t in rows}
