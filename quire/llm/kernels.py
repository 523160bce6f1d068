"""Array kernels over the UTF-8 bytes of a batch of texts.

Every kernel takes the bytes of many texts laid end to end, so its cost is a few
array passes over the batch and none per text or per word.
"""

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240613)
_BYTE = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(32))) * _FOLD
    h = (h ^ (h >> np.uint64(29))) * _FOLD
    return h ^ (h >> np.uint64(32))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string or binary array; null is empty."""
    import pyarrow as pa

    if column.null_count:
        empty = pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type)
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if ends is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int):
    """(first, last) of runs of texts of about size bytes; a longer text is one run."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = last


def powers(n: int) -> np.ndarray:
    """The first n powers of the base of the string hash, modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * _BASE)])
    return _POWERS[:n]


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_DOWN = np.ones(1, np.uint64)


def inverse_powers(at: np.ndarray, n: int) -> np.ndarray:
    """The inverses of the powers numbered at, all below n."""
    global _DOWN
    while len(_DOWN) < n:
        _DOWN = np.concatenate([_DOWN, _DOWN * (_DOWN[-1:] * _INVERSE)])
    return _DOWN[at]


def running(data: np.ndarray) -> np.ndarray:
    """n+1 running sums from which ``between`` takes the hash of any stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end), of some hundreds of bytes at most; they
    depend on content and length."""
    h = (sums[end] - sums[start]) * inverse_powers(start, len(sums))
    return mix(h ^ (np.asarray(end - start).astype(np.uint64) * _FOLD))


_LADDER = np.zeros(0, np.uint64)


def ladder(n: int) -> np.ndarray:
    """n odd multipliers drawn at random, one for each place in a run."""
    global _LADDER
    if len(_LADDER) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        _LADDER = np.random.default_rng(20240614).integers(1, 2**64, size, np.uint64, endpoint=False) | np.uint64(1)
    return _LADDER[:n]


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes, none of them empty: the sum of each byte's value times
    its place's multiplier. It is for runs of any length, unlike ``between``, whose
    multipliers are powers, so that long patterns can weigh what their complements do."""
    size = end - start
    begin = np.cumsum(size) - size
    if not len(size):
        return np.zeros(0, np.uint64)
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    values = _BYTE[data[place + np.repeat(start, size)]] * ladder(int(size.max()))[place]
    return mix(np.add.reduceat(values, begin) ^ (size.astype(np.uint64) * _FOLD))


def words(data: np.ndarray, offsets: np.ndarray):
    """(start, end, text number) of every maximal run of bytes that are not white
    space; no word crosses from one text to the next."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=solid[1:-1])
    opens = solid[1:-1] & ~solid[:-2]
    closes = solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] |= solid[1:-1][inner]
    closes[inner - 1] |= solid[1:-1][inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(hash, text number) of every word after lower-casing A-Z only."""
    low = LOWER[data]
    start, end, text = words(low, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), text
    return hash_runs(low, start, end), text


_PLACES = _rng.integers(1, 2**64, 64, np.uint64, endpoint=False) | np.uint64(1)


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, width: int = 5, whole: bool = True):
    """(hash, text number) of every run of width words, in order, repeats included.

    A text of fewer words, but at least one, is one shingle of all its words when
    ``whole``; otherwise it has none.
    """
    n = np.bincount(text, minlength=n_texts)
    first = np.cumsum(n) - n
    at = np.flatnonzero(np.arange(len(hashes)) - first[text] + width <= n[text]) if len(hashes) else np.zeros(0, np.int64)
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        total += hashes[at + j] * _PLACES[j]
    total, owner = mix(total), text[at]
    short = np.flatnonzero((n > 0) & (n < width)) if whole else np.zeros(0, np.int64)
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = n[short] > j
            extra[has] += hashes[first[short[has]] + j] * _PLACES[j]
        extra = mix(extra ^ (n[short].astype(np.uint64) * _FOLD))
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        total, owner = np.concatenate([total, extra])[order], np.concatenate([owner, short])[order]
    return total, owner


def distinct(values: np.ndarray, group: np.ndarray):
    """(value, group) once each, by group and then value."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    return v[new], g[new]


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k bytes, built from runs half as long; k a power of two."""
    h, step = _BYTE[data], 1
    while step < k:
        h = (h[:-step] * _BASE) ^ (h[step:] >> np.uint64(7)) ^ (h[step:] << np.uint64(57))
        h ^= h >> np.uint64(31)
        step *= 2
    return h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values in a row."""
    m, have = values, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = 100, k: int = 32):
    """Sampled positions that every window of length bytes agrees on.

    Each window has one anchor: the leftmost of its k-byte runs of least hash, so
    equal windows have equal anchors at equal places. Returns, for every stretch of
    consecutive windows of one text with one anchor: (hash of the anchor, its place,
    first window, number of windows, text number); places count from the batch's start.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none, none
    h = grams(data, k)
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (least(keyed, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(at))
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    good = starts + length <= offsets[text + 1]
    new = good.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~good[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none.astype(np.uint64), none, none, none, none
    ends = np.concatenate([[0], np.cumsum(good)])
    n = np.diff(np.append(ends[first], ends[-1]))
    return mix(h[at[first]]), at[first], first, n, text[first]


def anchor_of(data: np.ndarray, windows: np.ndarray, length: int = 100, k: int = 32) -> np.ndarray:
    """The anchors' places of the windows that begin at the given places."""
    h = grams(data, k)
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    return (least(keyed, length - k + 1)[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
