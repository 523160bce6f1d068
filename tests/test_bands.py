"""Line kernels over batches of pages: gutters against brute force, pages apart or together."""

import random

import numpy as np
import pytest

from quire import constants as K
from quire.operators import bands as B


def alike(a, b):
    return max(a, b) <= K.SAME_SIZE * min(a, b)


def said_of(lines, i, lo, hi, size):
    """What lines (lists of (x, right, size), with tops) around line i say of a strip."""
    clear = ink = 0
    side = False
    for ks in (range(i - 1, -1, -1), range(i + 1, len(lines))):
        seen = []
        for k in ks:
            top, runs = lines[k]
            if abs(top - lines[i][0]) > K.GUTTER_LOOK * size or len(seen) == K.GUTTER_LINES:
                break
            near = [r for r in runs if alike(r[2], size)]
            if any(x < lo for x, _, _ in near) and any(e > hi for _, e, _ in near):
                seen.append(not any(x < hi and e > lo for x, e, _ in near))
        clear, ink = clear + sum(seen), ink + len(seen) - sum(seen)
        side |= len(seen) == K.GUTTER_LINES and all(seen)
    return clear, ink, side


def sheet(rng):
    """Lines 12 points apart, each of a few runs, some larger; as columns of runs."""
    rows = []
    for k in range(rng.randrange(0, 14)):
        x, size = 60.0 + rng.randrange(3), rng.choice([10.0, 10.0, 10.0, 14.0])
        for _ in range(rng.randrange(1, 5)):
            w = float(rng.randrange(20, 90, 5))
            rows.append((x, 50.0 + 12 * k, w, size * 0.8, 50 + 12 * k + size * 0.8, size, rng.random() < 0.1))
            x += w + rng.choice([2.0, 8.0, 12.0, 20.0, 40.0])
    rng.shuffle(rows)
    return rows


def lines_of(pages):
    flat = [r for p in pages for r in p]
    columns = [np.array([r[k] for r in flat], float) for k in range(6)]
    return B.Lines(*columns, np.array([r[6] for r in flat], bool), np.array([len(p) for p in pages]))


@pytest.mark.parametrize("seed", range(6))
def test_evidence(seed):
    rng = random.Random(seed)
    pages = [sheet(rng) for _ in range(20)]
    got, at = lines_of(pages), 0
    whose = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    for n, page in enumerate(pages):
        tops = sorted({r[1] for r in page})
        lines = [(t, [(r[0], r[0] + r[2], r[5]) for r in page if r[1] == t]) for t in tops]
        for j in np.flatnonzero(whose[got.strip_run] == n):
            run = page[got.strip_run[j] - at]
            edge = max(r[0] + r[2] for r in page if r[1] == run[1] and r[0] < run[0])
            before = max((r for r in page if r[1] == run[1] and r[0] < run[0]), key=lambda r: r[0])
            size = min(before[5], run[5])
            inset, middle = K.GUTTER_INSET * size, (edge + run[0]) / 2
            lo, hi = ((edge + inset, middle), (middle, run[0] - inset))[got.strip_half[j]]
            assert (got.clear[j], got.inked[j], got.side[j]) == said_of(lines, tops.index(run[1]), lo, hi, size)
        at += len(page)
    assert len(got.strip_run)


def test_pages_do_not_meet():
    rng = random.Random(11)
    pages = [sheet(rng) for _ in range(30)] + [[]]
    whole = lines_of(pages)
    parts = [lines_of([p]) for p in pages]
    for name in ("line", "place", "gap", "clear", "inked", "side"):
        assert np.concatenate([getattr(p, name) for p in parts]).tolist() == sorted_as(whole, parts, name)
    assert len(lines_of([]).line) == 0 and len(lines_of([[], []]).line) == 0


def sorted_as(whole, parts, name):
    """whole's values in the order the parts have them; strips by run and half."""
    value = getattr(whole, name)
    if name in ("line", "place", "gap"):
        return value.tolist()
    at, key = 0, []
    for p in parts:
        key += [(at + r, h) for r, h in zip(p.strip_run.tolist(), p.strip_half.tolist())]
        at += len(p.line)
    own = dict(zip(zip(whole.strip_run.tolist(), whole.strip_half.tolist()), value.tolist()))
    return [own[k] for k in key]


def test_many_baselines_in_reach():
    """Twelve tall runs side by side, each standing lower than the last: no two share a baseline."""
    rows = [(60.0 + 30 * k, 50.0 + k, 20.0, 200.0, 100.0 + 30 * k, 10.0, False) for k in range(12)]
    assert sorted(lines_of([rows]).line.tolist()) == list(range(12))
