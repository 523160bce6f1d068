"""Quotes looked up in texts, letter for letter or with a few edits, by seeds.

A quote that some stretch of a text matches with k edits, cut into k+1 pieces, has one
piece there without an edit. So the first letters of every piece are seeds: all windows
of a text are hashed once, whatever the number of quotes, and looked up among the seeds
of that text's quotes. Edits are counted only round a seed's hit, by a bit-parallel
distance over the stretch the quote could take up there. Letters are UTF-16 units.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEED = 16  # letters at most; a power of two
BESIDE = 2048  # quotes that share one copy of their text
SLAB = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MORE
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of strings end to end, and n+1 places where they begin; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and len(ends) else np.zeros(0, np.uint8)
    units = np.frombuffer(raw.tobytes().decode().encode("utf-16-le"), np.uint16)
    if len(units) == len(raw):
        return units, ends - ends[0]
    worth = ((raw & 0xC0) != 0x80).astype(np.int64) + (raw >= 0xF0)  # a byte's units: one a character, two of four bytes
    return units, np.concatenate([[0], np.cumsum(worth)])[ends - ends[0]]


def _windows(units: np.ndarray, size: int) -> np.ndarray:
    """A hash of every size letters in a row; size a power of two."""
    h, step = units.astype(np.uint64) + np.uint64(1), 1
    while step < size:
        h = _spread(h[:-step] * _ODD + h[step:]) if len(h) > step else h[:0]
        step *= 2
    return h


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... count[i] of them, for each i."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def edits_within(needle: np.ndarray, hay: np.ndarray) -> int:
    """Fewest edits that turn needle into some stretch of hay: the column of the edit
    table beside each letter of hay is two bit vectors, its steps up and its steps down."""
    m = len(needle)
    if not m:
        return 0
    every, last = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = {}
    for i, c in enumerate(needle.tolist()):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score, best = every, 0, m, m
    for c in hay.tolist():
        hit = at.get(c, 0)
        level = ((hit & up) + up ^ up) | hit
        rise, fall = down | every & ~(level | up), up & level
        score += 1 if rise & last else -1 if fall & last else 0
        best = min(best, score)
        rise, fall, hit = rise << 1 & every, fall << 1 & every, hit | down
        up, down = fall | every & ~(hit | rise), rise & hit
    return best


def _seeds(lengths: np.ndarray, limits: np.ndarray):
    """(needle, place of the piece in it, letters of the seed) of every piece."""
    pieces = limits + 1
    needle = np.repeat(np.arange(len(lengths)), pieces)
    number = _ranges(np.zeros(len(pieces), np.int64), pieces)
    place = number * lengths[needle] // pieces[needle]
    size = np.minimum(SEED, 1 << np.floor(np.log2(np.maximum(1, lengths // pieces))).astype(np.int64))
    return needle, place, size[needle]


def nearest_all(hay: np.ndarray, at: np.ndarray, needle: np.ndarray, begin: np.ndarray, owner: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each needle the fewest edits to a stretch of its hay, or one more than its
    limit if it takes more. hay, at and needle, begin: letters and beginnings; owner:
    each needle's hay."""
    n, limit = len(begin) - 1, np.maximum(limit.astype(np.int64), 0)
    size, best = np.diff(begin), limit + 1
    best[size == 0] = 0
    held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    tiny = np.flatnonzero(size <= limit)  # as good as deleted anywhere: all of the hay is looked at
    for i in tiny.tolist():
        held[i].append((int(at[owner[i]]), int(at[owner[i] + 1])))
    real = np.flatnonzero(size > limit)
    which, place, span = _seeds(size[real], limit[real])
    which = real[which]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for s in np.unique(span).tolist():
        own = span == s
        seed, off = which[own], place[own]
        key = _spread(_windows(needle, s)[begin[seed] + off] + owner[seed].astype(np.uint64) * _MORE)
        order = np.argsort(key, kind="stable")
        seed, off, key = seed[order], off[order], key[order]
        h = _windows(hay, s)
        h = _spread(h + text[: len(h)].astype(np.uint64) * _MORE)
        maybe = np.zeros(1 << 20, bool)
        maybe[key >> np.uint64(44)] = True
        spot = np.flatnonzero(maybe[h >> np.uint64(44)])
        spot = spot[spot + s <= at[text[spot] + 1]]
        lo, hi = np.searchsorted(key, h[spot], "left"), np.searchsorted(key, h[spot], "right")
        spot, lo, count = spot[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        cut = np.flatnonzero(np.diff(np.cumsum(count) // SLAB, prepend=0))
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(spot)]):
            if a < b:
                _round(hay, at, needle, begin, owner, limit, best, held, np.repeat(spot[a:b], count[a:b]), _ranges(lo[a:b], count[a:b]), seed, off)
    for i in np.flatnonzero((best > 0) & (limit > 0)).tolist():
        for a, b in _merged(held[i]):
            best[i] = min(best[i], edits_within(needle[begin[i] : begin[i + 1]], hay[a:b]))
    return best


def _round(hay, at, needle, begin, owner, limit, best, held, spot, hit, seed, off):
    """Takes in hits of seeds: exact ones set best to 0, stretches round others are held."""
    i, start = seed[hit], spot - off[hit]
    size, own = np.diff(begin)[i], owner[i]
    whole = np.flatnonzero((off[hit] == 0) & (start + size <= at[own + 1]) & (best[i] > 0))
    for a in range(0, len(whole), max(1, SLAB // (1 + int(size.max(initial=0))))):
        w = whole[a : a + max(1, SLAB // (1 + int(size.max(initial=0))))]
        step = _ranges(np.zeros(len(w), np.int64), size[w])
        same = hay[np.repeat(start[w], size[w]) + step] == needle[np.repeat(begin[i[w]], size[w]) + step]
        whole_hit = np.logical_and.reduceat(same, np.cumsum(size[w]) - size[w]) if len(w) else same
        best[i[w[whole_hit]]] = 0
    left = (best[i] > 0) & (limit[i] > 0)
    i, start, size, own = i[left], start[left], size[left], own[left]
    if not len(i):
        return
    lo, hi = np.maximum(start - limit[i], at[own]), np.minimum(start + size + limit[i], at[own + 1])
    order = np.lexsort((lo, i))
    i, lo, hi = i[order], lo[order], hi[order]
    # stretches of one needle that touch become one: ends are raised needle by needle
    lift = i * (len(hay) + 1)
    far = np.maximum.accumulate(hi + lift) - lift
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (lo[1:] > far[:-1])
    last = np.append(new[1:], True)
    for k, a, b in zip(i[new].tolist(), lo[new].tolist(), far[last].tolist()):
        held[k].append((a, b))


def _merged(spans):
    out = None
    for a, b in sorted(spans):
        if out and a <= out[1]:
            out = (out[0], max(out[1], b))
        else:
            if out:
                yield out
            out = (a, b)
    if out:
        yield out


def nearest_edits(needle: str, hay: str, limit: int) -> int:
    """Fewest edits turning needle into some stretch of hay, or limit + 1."""
    edits = nearest_all(*letters(pa.array([hay])), *letters(pa.array([needle])), np.zeros(1, np.int64), np.array([limit]))
    return int(edits[0])


def look_up(hays: DataFrame, needles: DataFrame) -> DataFrame:
    """needles(input, quote_no, needle, limit) held against hays(input, hay): input,
    quote_no, limit and edits, the fewest that turn needle into a stretch of hay, or
    limit + 1 where it takes more. Inputs without a hay have no rows.

    A text lies in one row beside an array of its quotes; one with more than BESIDE
    quotes lies once beside each share of them.
    """
    shares = needles.groupBy("input").agg(F.ceil(F.count(F.lit(1)) / BESIDE).alias("_n"))
    shared = needles.join(shares.withColumnRenamed("input", "_i"), F.col("input") == F.col("_i"))
    share: Column = F.pmod(F.xxhash64("quote_no", "needle"), F.col("_n"))
    beside = shared.groupBy("input", share.alias("_share")).agg(F.collect_list(F.struct("quote_no", "needle", "limit")).alias("quotes"))
    kinds = [(c, needles.schema[c].dataType.simpleString()) for c in ("input", "quote_no")]

    def run(batches):
        for batch in batches:
            quotes = batch["quotes"]
            flat = quotes.flatten()
            owner = np.repeat(np.arange(batch.num_rows), quotes.value_lengths().to_numpy().astype(np.int64))
            limit = flat.field("limit").to_numpy(zero_copy_only=False)
            edits = nearest_all(*letters(batch["hay"]), *letters(flat.field("needle")), owner, limit)
            yield pa.RecordBatch.from_arrays(
                [batch["input"].take(pa.array(owner)), flat.field("quote_no"), flat.field("limit"), pa.array(edits.astype(np.int32))],
                names=["input", "quote_no", "limit", "edits"],
            )

    rows = beside.join(hays.select("input", "hay"), "input").select("input", "hay", "quotes")
    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds) + ", limit int, edits int")
