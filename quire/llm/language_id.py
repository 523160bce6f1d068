"""Language identification by a byte convolutional network.

One hidden layer of filters of several widths over bytes, the greatest response of
each filter in a fixed-length window, and a softmax over languages; trained in numpy
and applied to every window of every whole text. Bytes come in 64 classes (A-Z as
a-z). A filter's response to w bytes in a row is a sum of w table entries, so for
each width the responses to all pairs, or triples, of classes are tabled once and a
window costs one gather and one maximum.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from quire.llm import kernels as K
from quire.llm.common import ALL, apart, whole

WIDTHS, FILTERS, WINDOW, CLASSES = (2, 3, 4), 12, 256, 64


def byte_classes() -> np.ndarray:
    """a-z and A-Z: 1-26, white space 27, digits 28, other ASCII 29; bytes that go on a
    character 30-61 by their low bits; bytes that begin one 62 or 63; 0 is padding."""
    c = np.full(256, 29, np.uint8)
    c[0x61:0x7B] = c[0x41:0x5B] = np.arange(1, 27)
    c[K.SPACE] = 27
    c[0x30:0x3A] = 28
    c[0x80:0xC0] = 30 + (np.arange(0x80, 0xC0) & 31)
    c[0xC0:0xE0], c[0xE0:] = 62, 63
    return c


_CLASS = byte_classes()


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW):
    """(windows x size classes, text of each, bytes in each): each text cut into
    windows, the last one padded with class 0; an empty text has none."""
    lengths = np.diff(offsets)
    n = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][text] + number * size
    have = np.minimum(size, offsets[1:][text] - start)
    at = np.minimum(start[:, None] + np.arange(size), max(len(data) - 1, 0))
    x = _CLASS[data[at]] if len(data) else np.zeros((0, size), np.uint8)
    x[np.arange(size) >= have[:, None]] = 0
    return x, text, have


class Network:
    """Weights: filters[w] is (w, CLASSES, FILTERS), then a dense layer to languages."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
        for f in self.filters.values():
            f[:, 0] = -2.0  # padding answers to nothing
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray):
        """(greatest responses, where they are) of each window and filter."""
        best, place = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            z = sum(self.filters[w][j][x[:, j : j + n]] for j in range(w)) + self.bias[w]
            at = z.argmax(1)
            place.append(at)
            best.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1), place

    def softmax(self, best: np.ndarray) -> np.ndarray:
        z = np.maximum(best, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 6):
        """Adam on the cross-entropy; the gradient flows through each greatest response."""
        rng = np.random.default_rng(seed)
        params = [*self.filters.values(), *self.bias.values(), self.dense, self.offset]
        m = [np.zeros_like(p) for p in params]
        v = [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                best, place = self.pooled(xb)
                d = self.softmax(best)
                d[np.arange(len(yb)), yb] -= 1
                d /= len(yb)
                active = np.maximum(best, 0)
                back = (d @ self.dense.T) * (best > 0)
                filters, bias = [], []
                for k, w in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    df = np.zeros_like(self.filters[w])
                    for j in range(w):
                        np.add.at(df[j], (np.take_along_axis(xb, place[k] + j, 1), np.arange(FILTERS)), g)
                    df[:, 0] = 0
                    filters.append(df)
                    bias.append(g.sum(0))
                step += 1
                for p, g, a, b in zip(params, [*filters, *bias, active.T @ d, d.sum(0)], m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self):
        """Responses to all pairs and triples of classes, for quick application."""
        f2, f3, f4 = (self.filters[w] for w in (2, 3, 4))
        two = (f2[0][:, None] + f2[1][None]).reshape(-1, FILTERS) + self.bias[2]
        three = (f3[0][:, None, None] + f3[1][None, :, None] + f3[2][None, None]).reshape(-1, FILTERS) + self.bias[3]
        front = (f4[0][:, None] + f4[1][None]).reshape(-1, FILTERS) + self.bias[4]
        rear = (f4[2][:, None] + f4[3][None]).reshape(-1, FILTERS)
        return two, three, np.ascontiguousarray(front), np.ascontiguousarray(rear)

    def predict(self, x: np.ndarray, tables) -> np.ndarray:
        """Probabilities of the languages for each window."""
        two, three, front, rear = tables
        best = np.full((len(x), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for i in range(0, len(x), 2048):
            b = best[i : i + 2048]
            b2, b3, b4 = (np.ascontiguousarray(b[:, k * FILTERS : (k + 1) * FILTERS]) for k in range(3))
            columns = np.ascontiguousarray(x[i : i + 2048].T).astype(np.intp)  # a place of all windows at a time
            pairs = columns[:-1] * CLASSES + columns[1:]
            triples = pairs[:-1] * CLASSES + columns[2:]
            got, more = np.empty_like(b2), np.empty_like(b2)
            for j in range(len(pairs)):
                np.maximum(b2, two.take(pairs[j], 0, got, "clip"), out=b2)
                if j < len(triples):
                    np.maximum(b3, three.take(triples[j], 0, got, "clip"), out=b3)
                if j < len(pairs) - 2:
                    front.take(pairs[j], 0, got, "clip")
                    got += rear.take(pairs[j + 2], 0, more, "clip")
                    np.maximum(b4, got, out=b4)
            best[i : i + 2048] = np.concatenate([b2, b3, b4], 1)
        return self.softmax(best)


def sample(labelled: DataFrame, per_language: int, pieces: int) -> list[tuple[str, bytes]]:
    """``pieces`` windows of each of at most ``per_language`` texts a language: those
    of least hash, so the sample is the same for any partitioning. Only the windows,
    cut out where the texts lie, are moved, and of each language only those whose hash
    lies among the least few of all, as its count says: a bound that leaves fewer than
    are wanted lies eight deviations off, and what is ranked doesn't grow with the table."""
    from pyspark.sql import Window as W

    h = F.xxhash64(F.lit(11), "_key", "text")
    length = F.greatest(F.lit(1), F.char_length("text") - WINDOW + 1)
    cut = lambda i: F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(i), "_key"), length) + 1).cast("int"), F.lit(WINDOW))
    rows = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("_h", h)
    wanted = per_language + 8 * per_language**0.5 + 32
    # rows that repeat one id and text have one hash and count once
    counts = rows.select("lang", "_h").distinct().groupBy("lang").count().collect()
    if not counts:
        return []
    least = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, wanted / n - 0.5)])
    rows = rows.where(F.col("_h") / 2.0**64 <= F.element_at(least, F.col("lang")))
    rows = rows.select("lang", "_h", F.array(*map(cut, range(pieces))).alias("_cuts")).distinct()
    first = F.row_number().over(W.partitionBy("lang").orderBy("_h", "_cuts"))
    picked = rows.withColumn("_n", first).where(F.col("_n") <= per_language).orderBy("lang", "_h", "_cuts").collect()
    return [(r["lang"], c.encode()) for r in picked for c in r["_cuts"]]


def fit(labelled: DataFrame, per_language: int = 500, pieces: int = 3, seed: int = 5) -> Network | None:
    """A network from labelled rows (_key, text, lang), or None if none has a label
    and a letter. At most ``per_language`` texts of a language are learned from,
    ``pieces`` windows of each; that bounds what comes to the driver."""
    got = sample(labelled, per_language, pieces)
    languages = sorted({lang for lang, _ in got})
    if not languages:
        return None
    texts = [t for _, t in got]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, text, have = windows(data, ends)
    y = np.array([languages.index(lang) for lang, _ in got])[text]
    some = have >= 16
    # short texts are met too: some windows are learned from again, cut short
    rng = np.random.default_rng(seed)
    short = x[some].copy()
    short[np.arange(WINDOW)[None, :] >= rng.integers(12, 120, len(short))[:, None]] = 0
    return Network(languages, seed).train(np.concatenate([x[some], short]), np.concatenate([y[some], y[some]]))


def predict(docs: DataFrame, network: Network | None, *keep: str) -> DataFrame:
    """The kept columns with lang_pred and score.

    Every window of every whole text is applied; the score of a language is its mean
    probability over windows, weighed by their bytes, and the greatest wins (ties:
    first in order of name). A text that is null or has no letter is ``und`` with
    score 0, as is every text if there is no network.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, F.when(letter, F.col("text")).alias("_text"))
    schema = StructType([*(f for f in rows.schema if f.name != "_text"), *StructType.fromDDL("lang_pred string, score double")])

    def run(batches):
        tables = network.tables() if network else None
        for batch in batches:
            data, offsets = K.buffers(batch["_text"])
            n = batch.num_rows
            pred, score = np.zeros(n, np.int64), np.zeros(n)
            for a, b in K.pieces(offsets, 1 << 19) if network else ():
                x, text, have = windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(x):
                    continue
                p = network.predict(x, tables) * have[:, None]
                total = np.stack([np.bincount(text, p[:, k], b - a) for k in range(p.shape[1])], 1)
                total /= np.maximum(np.bincount(text, have, b - a), 1)[:, None]
                pred[a:b], score[a:b] = total.argmax(1), total.max(1)
            null = np.asarray(batch["_text"].is_null()) | (network is None)
            names = np.array([*(network.languages if network else []), "und"], object)
            out = [batch[c] for c in batch.schema.names if c != "_text"]
            out += [pa.array(names[np.where(null, len(names) - 1, pred)], pa.string())]
            out += [pa.array(np.where(null, 0.0, np.minimum(score, 1.0)))]
            yield pa.RecordBatch.from_arrays(out, names=[*(c for c in batch.schema.names if c != "_text"), "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo parts,
    is 0. A null id is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == 0, F.lit(True))


def languages(docs: DataFrame, id_column: str = "doc_id", per_language: int = 500) -> DataFrame:
    """id, held_out, lang_pred and score of every row; learned from labelled rows that
    aren't held out. Repeated rows and rows of one id each get their own."""
    out = held_out(F.col(id_column))
    network = fit(docs.where(~out).select(F.col(id_column).alias("_key"), "text", "lang"), per_language)
    return predict(docs.withColumn("_out", out), network, id_column, "_out").withColumnRenamed("_out", "held_out")


def accepted(docs: DataFrame, least: float = 0.3, id_column: str = "doc_id") -> DataFrame:
    """docs (its own columns) without rows that have no language: ``und``, or no language
    likelier than ``least``."""
    out = held_out(F.col(id_column))
    network = fit(docs.where(~out).select(F.col(id_column).alias("_key"), "text", "lang"))
    got = predict(docs.select(whole(docs), "text"), network, ALL)
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*apart(docs.columns))
