"""Where runs of text stand on a page, as array passes over a whole batch of pages.

Runs are taken in steps: at step t the t-th run from the top of every page that has so
many is put on a baseline, all pages at once, against a small matrix of the baselines
still within reach (one row a page). Gaps between neighbours are then judged for all
pages together: a gap wide enough to be a gutter is a strip, and what the lines above
and below have in that strip is read off sorted edges, so that no strip is held against
every run.
"""

import numpy as np

from quire import constants as K

EMPTY, NONE = -1, np.iinfo(np.int64).max


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ..., count[i] of them, for each i in turn."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def alike(a, b):
    return np.maximum(a, b) <= K.SAME_SIZE * np.minimum(a, b)


def _standing(top, low, y, h):
    """One's middle is in the other's span, and half of it or more lies within."""
    end = y + h
    shared = np.minimum(low, end) - np.maximum(top, y)
    own, other = (top + low) / 2, (y + end) / 2
    return ((top <= other) & (other <= low) & (shared >= K.BASELINE_OVERLAP * (end - y))) | (
        (y <= own) & (own <= end) & (shared >= K.BASELINE_OVERLAP * (low - top))
    )


def stand(x, y, h, base, size, count):
    """The baseline of each run, numbered from 0 on each page from the top down.

    count: runs of each page, whose columns lie end to end. A run takes the baseline
    nearest its own of those in reach that it stands on: the page's newest, or any of
    runs of its size. A baseline is where its largest run has it.
    """
    total = len(x)
    page = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((x, y, page))
    ahead = np.argsort(-count, kind="stable")  # pages with most runs first: those at work stay in front
    begin = (np.cumsum(count) - count)[ahead]
    steps = np.arange(1, int(count.max(initial=0)) + 1)
    busy = len(count) - np.searchsorted(np.sort(count), steps, "left")
    number = np.full(total, EMPTY)
    wide = 4
    which = np.full((len(count), wide), EMPTY)
    top, low, level, scale = (np.zeros((len(count), wide)) for _ in range(4))
    newest = np.full(len(count), EMPTY)
    for t, n in enumerate(busy.tolist()):
        i = order[begin[:n] + t]
        yi, hi, bi, si = (v[i][:, None] for v in (y, h, base, size))
        near = which[:n]
        near[low[:n] < yi] = EMPTY  # its ink ends above: out of reach for good
        off = np.abs(bi - level[:n])
        fits = (near != EMPTY) & ((near == newest[:n, None]) | alike(si, scale[:n]))
        fits &= (off <= K.BASELINE_SHIFT * np.minimum(si, scale[:n])) & _standing(top[:n], low[:n], yi, hi)
        off = np.where(fits, off, np.inf)
        nearest = fits & (off == off.min(1, keepdims=True))
        slot = np.where(nearest, near, NONE).argmin(1)
        fresh = np.flatnonzero(~fits.any(1))
        if len(fresh) and (near[fresh] != EMPTY).all(1).any():
            which = np.hstack([which, np.full(which.shape, EMPTY)])
            top, low, level, scale = (np.hstack([v, np.zeros(v.shape)]) for v in (top, low, level, scale))
            near = which[:n]
        slot[fresh] = (near[fresh] == EMPTY).argmax(1)
        newest[fresh] += 1
        near[fresh, slot[fresh]] = newest[fresh]
        at = np.arange(n), slot
        yi, hi, bi, si = yi[:, 0], hi[:, 0], bi[:, 0], si[:, 0]
        is_new = np.zeros(n, bool)
        is_new[fresh] = True
        larger = is_new | (si > scale[at])
        top[at] = np.where(is_new, yi, np.minimum(top[at], yi))
        low[at] = np.where(is_new, yi + hi, np.maximum(low[at], yi + hi))
        level[at] = np.where(larger, bi, level[at])
        scale[at] = np.where(larger, si, scale[at])
        number[i] = near[at]
    return number, order


class _Edges:
    """Runs of each baseline by size, with their edges sorted, for counts in a strip."""

    def __init__(self, band, x, right, size):
        order = np.lexsort((x, size, band))
        band, size, x, right = band[order], size[order], x[order], right[order]
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (size[1:] != size[:-1])
        self.strand = np.cumsum(new) - 1
        self.band, self.size = band[new], size[new]
        self.least = x[new]
        self.most = np.maximum.reduceat(right, np.flatnonzero(new)) if len(band) else right
        # complex numbers compare by their real, then their imaginary part
        self.lefts = self.strand + 1j * x
        self.rights = np.sort(self.strand + 1j * right)

    def inked(self, strand, lo, hi):
        """How many runs of a strand reach into [lo, hi]: those that begin before its
        end, less those that end before its beginning."""
        return np.searchsorted(self.lefts, strand + 1j * hi, "left") - np.searchsorted(self.rights, strand + 1j * lo, "right")


def evidence(edges: _Edges, page, tops, band, lo, hi, size):
    """(clear, inked, one side all clear) of each strip [lo, hi] of a baseline, in type
    of that size, over the nearest GUTTER_LINES lines that run across it each way.

    page and tops: of each baseline, by page and from the top down.
    """
    reach = K.GUTTER_LOOK * size
    where = page + 1j * tops
    slack = 1e-9 * (1 + np.abs(tops[band]) + reach)
    a = np.searchsorted(where, page[band] + 1j * (tops[band] - reach - slack), "left")
    b = np.searchsorted(where, page[band] + 1j * (tops[band] + reach + slack), "right")
    # a row for each strip and each strand of type alike on a line within reach
    first = np.searchsorted(edges.band, a, "left")
    count = np.searchsorted(edges.band, b, "left") - first
    strip = np.repeat(np.arange(len(band)), count)
    strand = spans(first, count)
    line = edges.band[strand]
    keep = (line != band[strip]) & alike(edges.size[strand], size[strip]) & (np.abs(tops[line] - tops[band[strip]]) <= reach[strip])
    strip, strand, line = strip[keep], strand[keep], line[keep]
    clear, ink = np.zeros(len(band), np.int64), np.zeros(len(band), np.int64)
    side = np.zeros(len(band), bool)
    if not len(strip):
        return clear, ink, side
    new = np.ones(len(strip), bool)
    new[1:] = (strip[1:] != strip[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(new)
    left = np.logical_or.reduceat(edges.least[strand] < lo[strip], at)
    right = np.logical_or.reduceat(edges.most[strand] > hi[strip], at)
    free = np.add.reduceat(edges.inked(strand, lo[strip], hi[strip]), at) == 0
    across = left & right
    strip, line, free = strip[at][across], line[at][across], free[across]
    for below in (False, True):
        own = (line > band[strip]) == below
        s, k, f = strip[own], line[own], free[own]
        order = np.lexsort((k if below else -k, s))
        s, f = s[order], f[order]
        n = np.bincount(s, minlength=len(band))
        rank = np.arange(len(s)) - (np.cumsum(n) - n)[s]
        s, f = s[rank < K.GUTTER_LINES], f[rank < K.GUTTER_LINES]
        open_ = np.bincount(s, f, len(band)).astype(np.int64)
        n = np.minimum(n, K.GUTTER_LINES)
        clear, ink = clear + open_, ink + n - open_
        side |= (n == K.GUTTER_LINES) & (open_ == n)
    return clear, ink, side


class Lines:
    """Lines of a batch of pages, from their runs' columns laid end to end.

    line, place, gap: each run's line on its page, its place in it from 1, and whether
    more than kerning parts it from the run before. Of the strips looked at: strip_run
    (the run after the gap), strip_half (0 left, 1 right), clear, inked and side.
    """

    def __init__(self, x, y, w, h, base, size, marker, count):
        total, right = len(x), x + w
        if not total:
            self.line = self.place = self.strip_run = self.strip_half = self.clear = self.inked = np.zeros(0, np.int64)
            self.gap = self.side = np.zeros(0, bool)
            return
        page = np.repeat(np.arange(len(count)), count)
        number, down = stand(x, y, h, base, size, count)
        # baselines of all pages: a page's first run of each gives its top
        turn = np.empty(total, np.int64)
        turn[down] = np.arange(total)
        order = np.lexsort((turn, x, number, page))  # along each baseline
        begins = np.ones(total, bool)
        begins[1:] = (number[order][1:] != number[order][:-1]) | (page[order][1:] != page[order][:-1])
        band = np.empty(total, np.int64)
        band[order] = np.cumsum(begins) - 1
        n_bands = int(begins.sum())
        first = np.full(n_bands, NONE)
        np.minimum.at(first, band, turn)
        tops, sheet = y[down[first]], page[down[first]]
        # along a baseline: how far the ink reached before each run
        r, prev = order, np.roll(order, 1)
        rising = np.argsort(right, kind="stable")
        rank = np.empty(total, np.int64)
        rank[rising] = np.arange(total)
        furthest = np.maximum.accumulate(band[r] * total + rank[r]) % total  # band numbers only rise along r
        edge = np.roll(right[rising][furthest], 1)
        gap = x[r] - edge
        tall = np.maximum(h[prev], h[r])
        near = gap <= K.JOIN_GAP_RATIO * tall
        small = np.minimum(size[prev], size[r])
        asked = np.flatnonzero(~begins & ~near & (gap <= K.WORD_SPACE * small) & alike(size[prev], size[r]))
        joined, lone = near.copy(), gap <= K.MARKER_GAP_RATIO * tall
        e, s, z = edge[asked], x[r[asked]], small[asked]
        inset, middle = K.GUTTER_INSET * z, (e + s) / 2
        lo, hi = np.concatenate([e + inset, middle]), np.concatenate([middle, s - inset])
        twice = np.concatenate([asked, asked])
        edges = _Edges(band, x, right, size)
        self.clear, self.inked, self.side = evidence(edges, sheet, tops, band[r[twice]], lo, hi, np.concatenate([z, z]))
        self.strip_run, self.strip_half = r[twice], np.repeat([0, 1], len(asked))
        gutter = (self.side | ((self.clear >= K.GUTTER_CLEAR) & (self.clear > self.inked))).reshape(2, -1).any(0)
        joined[asked] = ~gutter & (self.inked.reshape(2, -1) > 0).any(0)
        # a marker that begins a line reaches further; whether it does hangs on the run before
        opens, marked = begins | ~joined, np.roll(marker[r], 1)
        while True:
            now = begins | ~np.where(marked & np.roll(opens, 1), lone, joined)
            if (now == opens).all():
                break
            opens = now
        line = np.cumsum(opens) - 1
        head = np.flatnonzero(opens)
        place = np.arange(total) - head[line] + 1
        lines_before = np.searchsorted(page[r[head]], np.arange(len(count)), "left")
        self.line, self.place, self.gap = np.empty(total, np.int64), np.empty(total, np.int64), np.zeros(total, bool)
        self.line[r] = line - lines_before[page[r]]
        self.place[r] = place
        self.gap[r] = ~opens & (gap > K.SPACE_GAP_RATIO * np.maximum(h[r], 1.0))
