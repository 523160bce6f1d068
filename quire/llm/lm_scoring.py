"""Scoring with a weighted backoff automaton of smoothed n-grams.

States are the empty history and every word seen in training (and the text's begin).
An n-gram seen in training is an arc from its history, weighed by its smoothed
log-probability; every other word is reached by the state's failure arc, which weighs
log(mu / (c(h) + mu)) and leads to the empty state, whose arcs are the single words.
A text is walked once from left to right, carrying the state.

The model is as large as the corpus, so it is never in one place. Texts are taken in
blocks; a block asks for the counts of its distinct n-grams, in hash order, one
request for each range of hashes, and says how often they occur in its training
texts. Who holds a range adds up all blocks' counts and answers each request in the
same order. Each block then has the part of the automaton that it walks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm import kernels as K
from quire.llm.common import BLOCK, ROW, blocked, part, settle

ROWS, BYTES = 4096, 24 << 20  # of a block: rows of a file, and bytes at which one is closed early
END = np.uint64(0xA076_1D64_78BD_642F)
BEGIN = np.uint64(0xE703_7ED1_A0B4_28DB)
_LEFT, _RIGHT = np.uint64(0x8EBC_6AF0_9C88_C6E3), np.uint64(0x5899_65CC_7537_4CC3)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(hash, text number, is it a text's first token) of every word and, after each
    text's words, its end."""
    n = len(offsets) - 1
    words, text = K.word_hashes(data, offsets)
    count = np.bincount(text, minlength=n) + 1
    ends = np.cumsum(count)
    out = np.empty(len(words) + n, np.uint64)
    last = np.zeros(len(out), bool)
    last[ends - 1] = True
    out[~last], out[last] = words, END
    first = np.zeros(len(out), bool)
    first[ends - count] = True
    return out, np.repeat(np.arange(n), count), first


def histories(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first] = BEGIN
    return before


def pairs(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    return K.mix(histories(token, first) * _LEFT + token * _RIGHT)


def grams_of(data: np.ndarray, offsets: np.ndarray):
    """(tokens, text, first, [(distinct, place of each token's) of single words and of pairs])."""
    parts = [(a, tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in K.pieces(offsets, 1 << 20)]
    token = np.concatenate([p[0] for _, p in parts])
    text = np.concatenate([p[1] + a for a, p in parts])
    first = np.concatenate([p[2] for _, p in parts])
    found = [np.unique(x, return_inverse=True) for x in (token, pairs(token, first))]
    return token, text, first, found


def ranges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """n+1 places that cut sorted hashes into n even ranges of all 64-bit values."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


_REQUEST = "_pid int, _block long, _first long, _n int, _hashes binary, _counts binary"
_ANSWER = "_pid int, _block long, _first long, _n int, _counts binary, _tokens long, _types long"


def requests(rows: DataFrame, n_ranges: int) -> DataFrame:
    """rows: text, _train, _at_block, _at_row. Range numbers from n_ranges on are of pairs."""

    def run(batches):
        held: list = []  # (block, rows, texts, flags) of the block being gathered

        def close():
            block, at = held[0][0], np.concatenate([h[1] for h in held])
            text = pa.concat_arrays([h[2] for h in held])
            train = np.concatenate([h[3] for h in held])
            data, offsets = K.buffers(text)
            _, owner, _, found = grams_of(data, offsets)
            learned = train[owner]
            out = []
            for kind, (hashes, where) in enumerate(found):
                count = np.bincount(where[learned], minlength=len(hashes)).astype("<u4")
                cut = ranges(hashes, n_ranges)
                for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    if a < b:
                        out.append((kind * n_ranges + p, block, int(at[0]), len(at), hashes[a:b].tobytes(), count[a:b].tobytes()))
            columns = list(zip(*out))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["_pid", "_block", "_first", "_n", "_hashes", "_counts"]
            )

        size = 0
        for batch in batches:
            block, at = batch[BLOCK].to_numpy(), batch[ROW].to_numpy()
            train = np.asarray(batch["_train"].to_numpy(zero_copy_only=False), bool)
            _, offsets = K.buffers(batch["text"])
            a = 0
            while a < len(block):
                same = np.flatnonzero(block[a:] != block[a])
                b = a + (int(same[0]) if len(same) else len(block) - a)
                full = int(np.searchsorted(offsets, offsets[a] + BYTES))
                b = max(a + 1, min(b, full))
                if held and (held[0][0] != block[a] or size + offsets[b] - offsets[a] > BYTES or held[-1][1][-1] + 1 != at[a]):
                    yield close()
                    held, size = [], 0
                held.append((int(block[a]), at[a:b], batch["text"].slice(a, b - a), train[a:b]))
                size += int(offsets[b] - offsets[a])
                a = b
        if held:
            yield close()

    return rows.select("text", "_train", BLOCK, ROW).mapInArrow(run, _REQUEST)


def answer(table: pa.Table) -> pa.Table:
    """One range: all blocks' counts added up, and each request answered in its order.
    The range's training tokens and types are said once, in its first row."""
    hashes = [np.frombuffer(x, np.uint64) for x in table["_hashes"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table["_counts"].to_pylist()])
    _, where = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(where, counts).astype(np.int64)
    ends = np.cumsum([len(h) for h in hashes])
    told = total.astype("<u8")[where]
    replies = [told[e - len(h) : e].tobytes() for e, h in zip(ends.tolist(), hashes)]
    once = np.zeros(len(hashes), np.int64)
    once[0] = 1
    out = table.select(["_pid", "_block", "_first", "_n"])
    out = out.append_column("_counts", pa.array(replies, pa.binary()))
    out = out.append_column("_tokens", pa.array(once * int(total.sum())))
    return out.append_column("_types", pa.array(once * int((total > 0).sum())))


class Automaton:
    """The part of the model that a block walks: counts of its words and its pairs."""

    def __init__(self, words, word_counts, pair_counts, n_tokens: int, n_types: int, mu: float):
        self.words, self.c1, self.c2, self.mu = words, word_counts.astype(np.float64), pair_counts.astype(np.float64), mu
        self.single = np.log10((self.c1 + 1) / (n_tokens + n_types + 1))  # arcs of the empty state
        at = np.searchsorted(words, END)
        self.begins = float(self.c1[at]) if at < len(words) and words[at] == END else 0.0

    def walk(self, word: np.ndarray, pair: np.ndarray, first: np.ndarray):
        """(base, smoothed) log10 of each token; word and pair number the distinct ones."""
        base = self.single[word]
        state = np.empty(len(word))  # how often the state reached before each token was left in training
        state[1:] = self.c1[word[:-1]]
        state[first] = self.begins
        failure = np.where(state > 0, np.log10(self.mu / (state + self.mu)), 0.0)
        arc = (self.c2[pair] + self.mu * 10.0**base) / (state + self.mu)
        return base, np.where(self.c2[pair] > 0, np.log10(arc), failure + base)


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", mu: float = 200.0) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Tokens are runs of bytes other than white space, A-Z lower-cased, and one end. The
    model is learned from all rows that aren't held out. P(w) = (c(w) + 1) / (N + V + 1)
    for a token seen c(w) times among N of V kinds, an unseen one having c = 0;
    P(w | h) = (c(h w) + mu P(w)) / (c(h) + mu). base_score sums log10 P(w), score
    sums log10 P(w | h). A null or empty text is its end alone; where nothing is learned,
    N and V are 0 and both scores are 0. Repeated rows each get their own score.
    """
    spark = docs.sparkSession
    rows = blocked(docs.withColumns({"_id": F.col(id_column), "_out": held_out, "_train": ~held_out}), ROWS, "_id", "text", "_out", "_train")
    n = max(8, 2 * part(spark))
    answers = settle(requests(rows, n).groupBy("_pid").applyInArrow(answer, _ANSWER))
    single = answers.where(F.col("_pid") < n).agg(F.sum("_tokens"), F.sum("_types")).collect()[0]
    total, types = int(single[0] or 0), int(single[1] or 0)
    kind = dict(docs.dtypes)[id_column]
    names = ["_id", "_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def walk(key, texts: pa.Table, replies: pa.Table) -> pa.Table:
        texts = texts.sort_by(ROW).combine_chunks()
        at = texts[ROW].to_numpy()
        parts: dict = {}
        for r in replies.to_pylist():
            parts.setdefault((r["_first"], r["_n"]), []).append((r["_pid"], r["_counts"]))
        columns: list = [[], [], [], []]
        kept = []
        for (begin, many), got in sorted(parts.items()):
            a = int(np.searchsorted(at, begin))
            some = texts.slice(a, many)
            data, offsets = K.buffers(some["text"].combine_chunks() if some["text"].num_chunks != 1 else some["text"].chunk(0))
            _, text, first, found = grams_of(data, offsets)
            got.sort()
            c1, c2 = (np.frombuffer(b"".join(c for p, c in got if (p >= n) == pair), "<u8") for pair in (False, True))
            model = Automaton(found[0][0], c1, c2, total, types, mu)
            base, smooth = model.walk(found[0][1], found[1][1], first)
            columns[0].append(np.bincount(text, minlength=many))
            columns[1].append(np.bincount(text, c1[found[0][1]] > 0, many).astype(np.int64))
            columns[2].append(np.bincount(text, base, many))
            columns[3].append(np.bincount(text, smooth, many))
            kept.append(some.select(["_id", "_out"]))
        out = pa.concat_tables(kept)
        c = [np.concatenate(x) for x in columns]
        more = [c[0], c[1], np.full(len(c[0]), total, np.int64), c[2], c[3]]
        for name, x in zip(names[2:], more):
            out = out.append_column(name, pa.array(x))
        return out

    schema = f"_id {kind}, _out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = rows.select("_id", "_out", "text", ROW, BLOCK)
    scored = texts.groupBy(BLOCK).cogroup(answers.groupBy("_block")).applyInArrow(walk, schema)
    return scored.withColumnsRenamed({"_id": id_column, "_out": "held_out"})
