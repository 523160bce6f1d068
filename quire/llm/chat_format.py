"""Chat formatting: whole conversations as token ids, with an offset-aligned loss mask.

A conversation is rendered in one piece:

    <turn>role<text>text</turn><turn>role<text>text</turn>...

The three marks are control tokens of their own, with ids above the vocabulary's, so no
other token reaches over the edge of a text. In roles and texts the marks, and the
backslash, are written as a backslash and a letter, so a text can't pass for a mark and
reads back as it was. A rendered conversation is encoded once, whole, with the offsets
of its tokens; the loss mask is the intersection of those sorted spans with the sorted
spans of the turns to be learned, found by binary search.
"""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm import kernels as K

OPEN, MIDDLE, CLOSE = MARKS = ("<turn>", "<text>", "</turn>")
CODES = dict(zip(MARKS, ("\\o", "\\m", "\\c")))  # what stands for a mark inside a text
PIECE = 1 << 21  # bytes of rendered text taken at a time


def escaped(text: Column) -> Column:
    """text with backslashes doubled and each mark written as its code; null is empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark, code in CODES.items():
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    """The text of which ``escaped`` made this one. A doubled backslash is split at
    first, from the left, so what stands between two of them holds codes only."""

    def plain(part: Column) -> Column:
        for mark, code in CODES.items():
            part = F.replace(part, F.lit(code), F.lit(mark))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def rendered(rows: DataFrame, id_column: str = "conv_id", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: id, text, and of each turn its head's and its body's
    length in characters and whether it is to be learned."""
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    turns = rows.select(F.col(id_column).alias("_id"), turn.alias("t")).groupBy("_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    pieces = F.transform(
        "t",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE)).alias("head"),
            escaped(t["text"]).alias("body"), t["role"].isin(*learn).alias("learn"),
        ),
    )
    each = turns.select("_id", F.explode(F.array(pieces)).alias("p"))  # an array of one: pieces are made once
    return each.select(
        "_id", F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("text"),
        F.transform("p", lambda p: F.char_length(p["head"])).alias("heads"),
        F.transform("p", lambda p: F.char_length(p["body"])).alias("bodies"), F.transform("p", lambda p: p["learn"]).alias("learn"),
    )


def masks(first: np.ndarray, last: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Which of the tokens [first, last) lie in one of the sorted, separate spans
    [opens, closes). Control tokens stand at each span's edges, so a token lies wholly
    in a span or outside all; a token reaching over an edge is an error."""
    if not len(opens):
        return np.zeros(len(first), bool)
    at = np.searchsorted(opens, first, "right") - 1
    inside = (at >= 0) & (first < closes[at])
    after = np.searchsorted(opens, last, "left") - 1  # the last span that begins before the token ends
    if (inside & (last > closes[at])).any() or (~inside & (after != at)).any():
        raise ValueError("a token reaches over the edge of a turn")
    return inside


_ENCODERS: dict[str, tuple] = {}


def encoder(path: str):
    """(tokenizer with the marks added, its vocabulary's bytes end to end, their ends)."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        code = Tokenizer.from_file(path)
        code.encode_special_tokens = True  # their strings in a text are ordinary text
        code.add_tokens([AddedToken(m, normalized=False, special=False) for m in MARKS])
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        odd = [b for b in range(256) if b not in set(plain)]  # byte-level pieces write these from U+0100 on
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(odd)}
        added = {i: t.content.encode() for i, t in code.get_added_tokens_decoder().items()}
        size = code.get_vocab_size()
        words = [added[i] if i in added else bytes(byte_of[c] for c in code.id_to_token(i)) for i in range(size)]
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        _ENCODERS[path] = code, np.frombuffer(b"".join(words), np.uint8), ends
    return _ENCODERS[path]


def _flat(lists, kind):
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind)


def format_chats(rows: DataFrame, tokenizer: str, id_column: str = "conv_id", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: id, ids (token ids, int), loss (one byte a token: 1 where
    it is to be learned). rows: id, turn, role, text; ``learn`` names the roles whose
    texts are learned, marks and roles never.

    Turns are ordered by turn, then role, then text, so ties and repeated rows all come,
    in one order; a null turn comes first. Null roles and texts are empty. Rows of null
    id are one conversation. A conversation of empty texts has its marks and no loss. An
    empty table gives no rows; further columns are not read. A conversation, like a
    text, is one row and must fit a task's memory some thirtyfold.
    """
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            code = encoder(tokenizer)[0]
            texts = batch["text"]
            _, offsets = K.buffers(texts)
            for a, b in K.pieces(offsets, PIECE):
                part = batch.slice(a, b - a)
                got = code.encode_batch(part["text"].to_pylist(), add_special_tokens=False)
                count = np.fromiter(map(len, got), np.int64, b - a)
                ids = np.fromiter((i for e in got for i in e.ids), np.int32, int(count.sum()))
                spans = np.fromiter((x for e in got for s in e.offsets for x in s), np.int64, 2 * len(ids)).reshape(-1, 2)
                # conversations are laid end to end, so that one search serves all
                heads, bodies, turned = _flat(part["heads"], np.int64), _flat(part["bodies"], np.int64), _flat(part["learn"], bool)
                ends = np.cumsum(heads + bodies + len(CLOSE))
                turns = np.concatenate([[0], np.cumsum(np.diff(part["heads"].offsets.to_numpy()))])
                base = np.concatenate([[0], ends])[turns[:-1]]
                place = np.repeat(base, count)
                closes = ends - len(CLOSE)
                wanted = turned & (bodies > 0)
                loss = masks(spans[:, 0] + place, spans[:, 1] + place, (closes - bodies)[wanted], closes[wanted])
                edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["_id"], pa.ListArray.from_arrays(pa.array(edges), pa.array(ids)),
                        pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(loss.astype(np.uint8))]),
                    ],
                    names=["_id", "ids", "loss"],
                )

    return rendered(rows, id_column, learn).mapInArrow(run, f"_id {kind}, ids array<int>, loss binary").withColumnRenamed("_id", id_column)


def read_chats(formatted: DataFrame, tokenizer: str, id_column: str = "conv_id") -> DataFrame:
    """Reads ``format_chats``' rows back: id, turns (array of role, text), learned (the
    texts under the loss mask, unescaped, end to end) and formatted (the rendered text)."""
    kind = formatted.schema[id_column].dataType.simpleString()

    def texts(ids, which, rows):
        """The bytes of the ids as one text a row; which: the row of each id, in order."""
        _, data, ends = encoder(tokenizer)
        size = ends[ids + 1] - ends[ids]
        at = np.arange(int(size.sum())) + np.repeat(ends[ids] - (np.cumsum(size) - size), size)
        edges = np.concatenate([[0], np.cumsum(np.bincount(which, size, rows).astype(np.int64))])
        wide = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(edges), pa.py_buffer(data[at])])
        wide.validate(full=True)  # as the bytes of whole characters they must be UTF-8
        return wide.cast(pa.string())

    def run(batches):
        for batch in batches:
            ids = _flat(batch["ids"], np.int64)
            count = np.diff(batch["ids"].offsets.to_numpy())
            on = K.buffers(batch["loss"])[0] > 0
            n, which = batch.num_rows, np.repeat(np.arange(batch.num_rows), count)
            yield pa.RecordBatch.from_arrays([batch["_id"], texts(ids, which, n), texts(ids[on], which[on], n)], names=["_id", "formatted", "raw"])

    back = formatted.select(F.col(id_column).alias("_id"), "ids", "loss").mapInArrow(run, f"_id {kind}, formatted string, raw string")
    whole = F.filter(F.split("formatted", CLOSE), lambda t: t != "")  # what follows the last mark is empty
    turns = F.transform(
        whole,
        lambda t: F.struct(
            unescaped(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescaped(F.substring_index(t, MIDDLE, -1)).alias("text"),
        ),
    )
    return back.select(F.col("_id").alias(id_column), turns.alias("turns"), unescaped(F.col("raw")).alias("learned"), "formatted")
