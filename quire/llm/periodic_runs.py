"""Periodic runs of words, found by block convolution, and texts with them collapsed.

A run of period q and length n (n >= 2*q) holds, wherever a grid of blocks is laid, a
whole block of the grid that comes again q words later within the run. So at each
dyadic scale the words of a batch of texts are cut into blocks of B words, and each
block is laid over the windows that follow it: the sum of squared differences of the
words' numbers is a correlation, taken for all distances of a window at once by a
number-theoretic transform, in integers modulo a prime. A sum of zero is an
occurrence; it seeds an extension, word by word, to the longest stretch of that
distance. The scale of blocks of B words answers for periods of 2*B to 4*B-1; the
first, of 4 words, for those of 1 to 15.

Two things keep the work in proportion to n * log(n)^2 whatever the text. A block of
which some word does not come again within reach has no occurrence and is not
transformed. A block that lies, with its whole reach, in a run known already (of
period B/2 or less) could only show multiples of that period; and where it occurs in
another run of that period, how far both agree follows from the runs' ends.

Sums are equal to zero modulo the prime, so an occurrence is checked word by word
before it counts; nothing is told apart by a hash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import kernels as K

LEAST = 12  # words of a run
BASE, STRIDE = 4, 2  # the first scale's blocks, which overlap
PIECE = 1 << 20  # bytes of text taken at a time
SLAB = 1 << 20  # array cells worked on at a time
PRIME, ROOT = 15 * 2**27 + 1, 31  # fixed values: a prime under 2**31 and a generator
_P = np.uint64(PRIME)
FAR = np.iinfo(np.int64).max

_TURNS: dict[tuple[int, bool], np.ndarray] = {}


def _turns(size: int, back: bool) -> np.ndarray:
    """The first size/2 powers of a root of unity of order size, or of its inverse."""
    if (size, back) not in _TURNS:
        root = pow(ROOT, (PRIME - 1) // size, PRIME)
        root = pow(root, -1, PRIME) if back else root
        out = np.ones(1, np.uint64)
        while len(out) < size // 2:
            out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % _P])
        _TURNS[size, back] = out[: max(1, size // 2)]
    return _TURNS[size, back]


def _sum(a, b):
    s = a + b
    return np.minimum(s, s - _P)  # unsigned: s - p wraps round where s < p


def forward(x: np.ndarray) -> np.ndarray:
    """The transform of each row (a power of two long), its values in scrambled order."""
    rows, size = x.shape
    half = size // 2
    while half:
        v = x.reshape(rows, -1, 2, half)
        a, b = v[:, :, 0], v[:, :, 1]
        x = np.stack([_sum(a, b), _sum(a, _P - b) * _turns(2 * half, False) % _P], axis=2)
        half //= 2
    return x.reshape(rows, size)


def backward(x: np.ndarray) -> np.ndarray:
    """The rows of which ``forward`` made x."""
    rows, size = x.shape
    half = 1
    while half < size:
        v = x.reshape(rows, -1, 2, half)
        a, b = v[:, :, 0], v[:, :, 1] * _turns(2 * half, True) % _P
        x = np.stack([_sum(a, b), _sum(a, _P - b)], axis=2)
        half *= 2
    return x.reshape(rows, size) * np.uint64(pow(size, -1, PRIME)) % _P


def occurrences(a: np.ndarray, squares: np.ndarray, start: np.ndarray, size: int, windows) -> tuple:
    """(block's start, distance) of every zero sum of squared differences between the
    blocks a[start : start+size] and what follows at distances size*w to size*(w+1)-1,
    for each w of windows. squares: running sums of a*a; both reach past the last window."""
    found = []
    rows = max(1, SLAB // (2 * size))
    at, wide = np.arange(size), np.arange(2 * size)
    for i in range(0, len(start), rows):
        s = start[i : i + rows, None]
        x = np.zeros((len(s), 2 * size), np.uint64)
        block = a[s + at]
        x[:, 0], x[:, size + 1 :] = block[:, 0], block[:, :0:-1]
        x = forward(x)
        own = squares[s + size] - squares[s]
        for w in windows:
            y = s + w * size
            both = backward(forward(a[y + wide]) * x % _P)[:, :size]
            y = y + at
            total = own + (squares[y + size] - squares[y]) + 2 * (_P - both)
            row, d = np.nonzero(total % _P == 0)
            found.append((s[row, 0], d + w * size))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def alike(a: np.ndarray, i: np.ndarray, k: np.ndarray, step: int, most: int = FAR) -> np.ndarray:
    """How many words (most at most) agree from i and from k (> i) on, going by step."""
    out = np.zeros(len(i), np.int64)
    for lo in range(0, len(i), SLAB >> 5):
        live, width = np.arange(lo, min(lo + (SLAB >> 5), len(i))), 16
        while len(live):
            j = (out[live, None] + np.arange(width)) * step
            x, y = i[live, None] + j, k[live, None] + j
            same = (x >= 0) & (y < len(a))
            same &= a[np.clip(x, 0, len(a) - 1)] == a[np.clip(y, 0, len(a) - 1)]
            n = np.where(same.all(1), width, same.argmin(1))
            out[live] += n
            live = live[(n == width) & (out[live] < most)]
            width = max(16, min(2 * width, SLAB // max(1, len(live))))
    return np.minimum(out, most)


class _Known:
    """Runs found so far: start, end, period, once each, by start."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start, end, period):
        start, end, period = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, end, start))  # of multiples of a period the least stays
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        self.start, self.end, self.period = start[new], end[new], period[new]

    def upto(self, period):
        """Those of that period or less, and at each the one so far that ends last."""
        pick = self.period <= period
        start, end, q = self.start[pick], self.end[pick], self.period[pick]
        last = np.maximum.accumulate(end) if len(end) else end
        lead = np.flatnonzero(end == last)
        which = lead[np.searchsorted(lead, np.arange(len(end)), "right") - 1] if len(end) else lead
        return start, end, q, which


def _around(known, at, size):
    """Which of the runs holds [at, at+size), -1 if none. Two runs share fewer words
    than their periods add up to, so for periods up to size/2 there is one at most."""
    start, end, _, which = known
    i = np.searchsorted(start, at, "right") - 1
    run = np.where(i >= 0, which[np.maximum(i, 0)], -1) if len(start) else np.full(len(at), -1)
    return np.where((run >= 0) & (end[run] >= at + size), run, -1) if len(start) else run


def _stretches(a, s, d, size):
    """(start, end, distance) of the longest stretches of equal distance round seeds."""
    good = alike(a, s, s + d, 1, size) == size
    order = np.lexsort((s[good], d[good]))
    s, d = s[good][order], d[good][order]
    head = np.ones(len(s), bool)
    head[1:] = (d[1:] != d[:-1]) | (s[1:] - s[:-1] > size)
    tail = np.append(head[1:], True) if len(s) else head
    left, right, d = s[head], s[tail] + size, d[head]
    left = left - alike(a, left - 1, left - 1 + d, -1)
    return left, right + d + alike(a, right, right + d, 1), d


def runs(a: np.ndarray, longest: int, least: int = LEAST):
    """(start, end, period) of every run of least words or more in a, by start, then
    period. a: numbers of words, with one that comes only there between two texts;
    longest: words of the longest text."""
    known, n = _Known(), len(a)
    big = 4 * max(BASE, longest)
    order = np.argsort(a, kind="stable")
    again = np.full(n, FAR)
    same = a[order[1:]] == a[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    padded = np.zeros(n + big + 8 * BASE, np.uint64)
    padded[:n] = a
    squares = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum(padded * padded % _P, out=squares[1:])
    size, reach = BASE, np.full(-(-n // BASE) * BASE, FAR)
    reach[:n] = again
    worst = np.maximum(reach[:-1], reach[1:]) if len(reach) else reach
    start = np.arange(0, max(0, n - BASE + 1), STRIDE)
    start = start[np.maximum(worst[start], worst[start + 2]) < 4 * BASE]
    reach = reach.reshape(-1, BASE).max(1)  # of each block: how far its words come again
    windows = (0, 1, 2, 3)
    while True:
        short = known.upto(size // 2)
        run = _around(short, start, size)
        inside = run >= 0
        inside[inside] = short[1][run[inside]] >= start[inside] + 5 * size
        s, d = occurrences(padded, squares, start[~inside], size, windows)
        ok = (d > 0) & (s + d + size <= n)
        s, d = s[ok], d[ok]
        here, there = _around(short, s, size), _around(short, s + d, size)
        both = (here >= 0) & (there >= 0)
        both[both] = short[2][here[both]] == short[2][there[both]]
        edge = both.copy()  # both runs end, or begin, at this distance: what lies beyond counts
        x, y = here[both], there[both]
        edge[both] = (x != y) & ((short[1][y] - short[1][x] == d[both]) | (short[0][y] - short[0][x] == d[both]))
        both &= ~edge
        left, right, dist = _stretches(a, s[~both], d[~both], size)
        # within two runs of one period, distances that leave them at different places
        other = both.copy()
        other[both] = here[both] != there[both]
        x, y, ds, at = here[other], there[other], d[other], s[other]
        l2, r2 = np.maximum(short[0][x], short[0][y] - ds), np.minimum(short[1][x], short[1][y] - ds)
        fit = r2 - l2 + ds >= np.maximum(least, 2 * ds)
        fit[fit] = alike(a, at[fit], at[fit] + ds[fit], 1, size) == size
        left, right, dist = (np.concatenate(z) for z in ((left, l2[fit]), (right, (r2 + ds)[fit]), (dist, ds[fit])))
        fit = right - left >= np.maximum(least, 2 * dist)
        known.add(left[fit], right[fit], dist[fit])
        size *= 2
        if 4 * size > longest:
            break
        reach = np.append(reach, FAR) if len(reach) % 2 else reach
        reach = reach.reshape(-1, 2).max(1)
        start = np.flatnonzero(reach < 4 * size) * size
        windows = (2, 3)
    order = np.lexsort((known.period, known.start))
    return known.start[order], known.end[order], known.period[order]


def _numbered(data, start, end):
    """A number for each word, equal for equal bytes only."""
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    solid = data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(solid)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def collapse(data: np.ndarray, offsets: np.ndarray, least: int = LEAST):
    """For texts laid end to end: words of each, runs of each and each text collapsed."""
    n_texts = len(offsets) - 1
    start, end, text = K.words(data, offsets)
    n = np.bincount(text, minlength=n_texts)
    base = np.cumsum(n) - n + np.arange(n_texts)  # one place between texts
    a = np.empty(len(start) + n_texts, np.int64)
    place = np.arange(len(start)) + text
    ids = _numbered(data, start, end)
    a[place] = ids
    a[base + n] = (ids.max(initial=-1) + 1) + np.arange(n_texts)
    lo, hi, period = runs(a, int(n.max(initial=0)), least)
    owner = np.searchsorted(base, lo, "right") - 1
    depth = np.zeros(len(a) + 1, np.int64)
    np.add.at(depth, lo + period, 1)
    np.add.at(depth, hi, -1)
    keep = np.cumsum(depth)[place] == 0
    start, size, text = start[keep], (end - start)[keep], text[keep]
    later = np.zeros(len(text), np.int64)
    later[1:] = text[1:] == text[:-1]
    ends = np.cumsum(size + later)
    joined = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    at = np.arange(int(size.sum())) + np.repeat(ends - np.cumsum(size), size)
    joined[at] = data[np.arange(len(at)) + np.repeat(start - (np.cumsum(size) - size), size)]
    edges = np.concatenate([[0], np.cumsum(np.bincount(text, size + later, n_texts).astype(np.int64))])
    return n, (owner, lo - base[owner], hi - lo, period), (joined, edges)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_words, runs (array of start, length, period, by start, then period) and
    collapsed (words joined by one space, each run cut to its first period) of each row.

    Words are runs of bytes that are not ASCII white space. A run is a stretch of words
    of least period q, at least max(least, 2*q) long, that no word beside it carries on.
    Runs may overlap; a word goes if any run holds it after that run's first q words.
    A null or empty text, and one of white space, has no words, no runs and collapses to
    an empty text. A text of any length is one piece of work and must fit a task's memory
    about fiftyfold. Rows are read one by one: repeated rows, repeated and null ids, an
    empty table and further columns, which are not read, change nothing. least is 9 or more.
    """
    if least < 9:
        raise ValueError("runs of fewer than 9 words may hold no whole block")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch["_text"])
            for a, b in K.pieces(offsets, PIECE):
                n, (owner, start, length, period), (joined, edges) = collapse(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least)
                parts = [pa.array(x.astype(np.int64)) for x in (start, length, period)]
                lists = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))]).astype(np.int32)
                wide = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(joined)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_id"].slice(a, b - a), pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(parts, ["start", "length", "period"])),
                        wide.cast(pa.string()),
                    ],
                    names=["_id", "n_words", "runs", "collapsed"],
                )

    narrow = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    schema = f"_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return narrow.mapInArrow(run, schema).withColumnRenamed("_id", id_column)
