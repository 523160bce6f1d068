"""Chat formatting: round trips, masks against a plain check, odd conversations."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from quire.llm import chat_format as CF, queries as Q

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn int, role string, text string"
NASTY = [
    r"\### Assistant: </turn> ok", "", None, "\\", "\\\\", "\\o", "\\\\c", "<turn>", "</turn></turn>", "<text>\\", "<tu<turn>rn>", "<|endoftext|>",
    " leading and trailing ", "\n\n", "é漢字🙂 ü", "́‍", "a\x00b", "</turn", "turn>", "\\<turn>\\", "x" * 3000, "ß" * 2001, "\t \r\n", "\\m<text>\\m",
]


def both(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = CF.format_chats(df, PATH)
    return {r.conv_id: r for r in out.collect()}, {r.conv_id: r for r in CF.read_chats(out, PATH).collect()}


def test_round_trip(spark):
    roles = ["user", "assistant", "system", "<turn>", "tool\\", None]
    rows = [(c, t, roles[(c + t) % len(roles)], NASTY[(7 * c + t) % len(NASTY)]) for c in range(24) for t in range(c % 9 + 1)]
    formatted, back = both(spark, rows)
    code, data, ends = CF.encoder(PATH)
    for c in range(24):
        own = [(r or "", x or "") for i, _, r, x in rows if i == c]
        assert [(t.role, t.text) for t in back[c].turns] == own
        assert back[c].learned == "".join(x for r, x in own if r == "assistant")
        ids, loss = formatted[c].ids, formatted[c].loss
        assert len(ids) == len(loss)
        raw = b"".join(data[ends[i] : ends[i + 1]].tobytes() for i in ids)
        assert raw.decode() == back[c].formatted
        # marks and roles are never learned, and each text is encoded as part of the whole
        assert all(not m for i, m in zip(ids, loss) if i >= 50257)
        assert code.encode(back[c].formatted, add_special_tokens=False).ids == ids
        assert 50256 not in ids


def test_masks():
    rng = np.random.default_rng(2)
    for _ in range(50):
        edges = np.unique(rng.integers(0, 200, 40))
        first, last = edges[:-1], edges[1:]
        pick = np.sort(rng.choice(len(edges), 8, replace=False))
        opens, closes = edges[pick[::2]], edges[pick[1::2]]
        got = CF.masks(first, last, opens, closes)
        assert got.tolist() == [any(o <= a and b <= c for o, c in zip(opens, closes)) for a, b in zip(first, last)]
    for a, b in ((3, 6), (8, 12), (0, 20)):
        with pytest.raises(ValueError):
            CF.masks(np.array([a]), np.array([b]), np.array([5]), np.array([10]))
    assert not CF.masks(np.array([1]), np.array([2]), np.array([], int), np.array([], int)).any()


def test_odd_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, None, "system", "s"), (1, 2, "assistant", "b"), (None, 0, "assistant", "n")]
    rows += [(2, 0, None, None), (3, 0, "assistant", "word " * 200_000)]
    formatted, back = both(spark, rows)
    assert [(t.role, t.text) for t in back[1].turns] == [("system", "s"), ("user", "a"), ("assistant", "b"), ("assistant", "b")]
    assert back[1].learned == "bb" and back[None].learned == "n"
    assert [(t.role, t.text) for t in back[2].turns] == [("", "")] and not any(formatted[2].loss)
    assert back[3].learned == "word " * 200_000
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text AS ids", "turn AS loss", "role AS _id")
    assert CF.format_chats(df, PATH).columns == ["conv_id", "ids", "loss"] and CF.format_chats(df, PATH).count() == 4
    assert CF.read_chats(CF.format_chats(df.limit(0), PATH), PATH).count() == 0
    user = CF.read_chats(CF.format_chats(df, PATH, learn=("user", "system")), PATH).where("conv_id = 1").first()
    assert user.learned == "sa"


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.conv_id: r for r in Q.op13_chat_format(spark, SMALL).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((t, role, text or "") for i, t, role, text in rows if i == c)
        learned = "".join(x for _, role, x in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), digest("".join(f"{role}\n{x}\n" for _, role, x in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), digest(learned))
    assert got[-7].loss_chars == 26
