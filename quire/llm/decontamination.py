"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so the similarity of an item to a whole
document says little. Items are partitioned by size; for the class of items of at
most u shingles a document is taken in overlapping blocks of 2u shingles, so that a
passage of an item fills a good part of some block and the two share minima. A
document that shares a minimum of an item in any block is a candidate; candidates
are verified by exact containment of the item's shingles in the whole document.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import kernels as K
from quire.llm.common import ALL, FILE, ROW, apart, placed, settle, whole

WIDTH, HASHES = 5, 96
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**64, HASHES, np.uint64, endpoint=False) | np.uint64(1)
_B = _rng.integers(0, 2**64, HASHES, np.uint64, endpoint=False)


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES x len(first) least values of universal hashes over the stretches that
    begin at ``first``; none may be empty."""
    out = np.empty((HASHES, len(first)), np.uint64)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat(hashes * _A[k] + _B[k], first)
    return out


class Items:
    """The test items of one block of the benchmark, ready to be sought."""

    def __init__(self, ids: list, texts: list, threshold: float):
        data, offsets = K.buffers(pa.array(texts, pa.string()))
        hashes, text = K.word_hashes(data, offsets)
        n_words = np.bincount(text, minlength=len(ids))
        self.ids, self.threshold = ids, threshold
        self.width = np.minimum(n_words, WIDTH)
        self.sets: list[np.ndarray] = []
        for i in range(len(ids)):
            own = hashes[text == i]
            s, _ = K.shingles(own, np.zeros(len(own), np.int64), 1, max(int(self.width[i]), 1), False)
            self.sets.append(np.unique(s))
        self.need = np.array([int(np.ceil(threshold * len(s) - 1e-9)) for s in self.sets])
        self.classes: dict[int, dict[int, tuple]] = {}
        for w in sorted(set(self.width[self.width > 0].tolist())):
            for i in np.flatnonzero(self.width == w):
                u = 1
                while u < len(self.sets[i]):
                    u *= 2
                self.classes.setdefault(w, {}).setdefault(u, []).append(int(i))
        for w, by_size in self.classes.items():
            for u, items in by_size.items():
                mins = np.stack([minima(self.sets[i], np.zeros(1, np.int64))[:, 0] for i in items])
                order = np.argsort(mins, axis=0, kind="stable")
                by_size[u] = (np.array(items), np.take_along_axis(mins, order, 0), order)

    def candidates(self, by_size: dict, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs with a shared minimum in some block."""
        n = np.bincount(text)
        first = np.cumsum(n) - n
        found = []
        base, mins, owner = min(by_size), None, None
        while base <= max(by_size):
            if mins is None:
                within = np.arange(len(hashes)) - first[text]
                start = np.flatnonzero(within % base == 0)
                owner = text[start]
                mins = minima(hashes, start)
            if base in by_size:
                items, sorted_mins, order = by_size[base]
                joined = mins.copy()  # a block of 2 u: this stretch and the next of the same text
                same = owner[1:] == owner[:-1]
                joined[:, :-1][:, same] = np.minimum(mins[:, :-1], mins[:, 1:])[:, same]
                for k in range(HASHES):
                    lo = np.searchsorted(sorted_mins[:, k], joined[k])
                    at = np.flatnonzero(sorted_mins[np.minimum(lo, len(items) - 1), k] == joined[k])
                    hi = np.searchsorted(sorted_mins[:, k], joined[k][at], "right")
                    count = hi - lo[at]
                    take = np.repeat(lo[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    found.append(np.stack([np.repeat(owner[at], count), items[order[take, k]]], 1))
            # stretches twice as long
            number = np.arange(len(owner)) - np.searchsorted(owner, owner)
            even = np.flatnonzero(number % 2 == 0)
            pair = np.minimum(even + 1, len(owner) - 1)
            ok = owner[pair] == owner[even]
            merged = mins[:, even]
            merged[:, ok] = np.minimum(merged[:, ok], mins[:, pair[ok]])
            mins, owner, base = merged, owner[even], base * 2
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all pairs that reach the threshold."""
        words, of = K.word_hashes(data, offsets)
        out = []
        for w, by_size in self.classes.items():
            hashes, text = K.shingles(words, of, len(offsets) - 1, w, False)
            if not len(hashes):
                continue
            n = np.bincount(text, minlength=len(offsets) - 1)
            ends = np.cumsum(n)
            for t, i in self.candidates(by_size, hashes, text).tolist():
                shared = int(np.isin(self.sets[i], hashes[ends[t] - n[t] : ends[t]]).sum())
                if shared >= self.need[i]:
                    out.append((t, i, shared))
        return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, id_column: str = "doc_id", block: int = 4096
) -> DataFrame:
    """(id, item_id, n_item, n_shared, containment): every pair of a document and a
    test item of whose distinct five-word shingles the document holds at least
    ``threshold``. Words are runs of bytes other than white space, A-Z lower-cased.

    An item of fewer than five words is one shingle of all its words, sought among
    the document's runs of as many words; an item without words matches nothing,
    nor does a null or empty text. Repeated rows and rows of one id each give their
    own pairs. The benchmark is taken in blocks of ``block`` items (the stated query
    set; each block is shipped to the tasks, so its size bounds what is sent), and
    each block is one pass over the documents without a shuffle.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_column]
    item_kind = dict(benchmark.dtypes)["item_id"]
    items = benchmark.select("item_id", "text").where("text is not null")
    rows = items.toLocalIterator(prefetchPartitions=False)
    schema = f"{id_column} {kind}, item_id {item_kind}, n_item long, n_shared long, containment double"
    rows_of = docs.select(id_column, "text").where("text is not null")
    parts, some = [], []

    def seek(found: list) -> DataFrame:
        ids, texts = [r[0] for r in found], [r[1] for r in found]

        def run(batches):
            sought = Items(ids, texts, threshold)
            for batch in batches:
                data, offsets = K.buffers(batch["text"])
                own = batch[id_column].to_pylist()
                hits = []
                for a, b in K.pieces(offsets, 1 << 20):
                    for t, i, n in sought.search(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        hits.append((own[a + t], ids[i], len(sought.sets[i]), n, n / len(sought.sets[i])))
                columns = list(zip(*hits)) or [[]] * 5
                types = [batch.schema.field(id_column).type, item_type, pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=[id_column, "item_id", "n_item", "n_shared", "containment"],
                )

        return rows_of.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    for row in rows:
        some.append(row)
        if len(some) == block:
            parts.append(seek(some))
            some = []
    if some:
        parts.append(seek(some))
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p) if len(parts) > 1 else p
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs (its own columns, whatever their names) without those that hold a test item,
    told by place."""
    at = placed(docs.select(whole(docs)), ALL)
    at = at.withColumn("_place", F.concat_ws(":", FILE, ROW))
    texts = at.select("_place", F.col(f"{ALL}.text").alias("text"))
    hit = settle(contamination(texts, benchmark, threshold, "_place").select("_place").distinct())
    return at.join(hit, "_place", "left_anti").select(*apart(docs.columns))
