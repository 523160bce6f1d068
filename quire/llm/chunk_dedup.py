"""Substring deduplication by content-defined chunks.

A gear rolling hash runs over a text's bytes; where its high bits are zero a cut can
be. A place is a cut if there was no such place in the MIN bytes before it, so cuts
depend on some 50 bytes before them and on nothing else: text put in shifts the bytes
but not the cuts, and a passage that repeats has the same chunks from its second cut
on. Where no such place is near, the strictly least hash within NEAR bytes on both sides
is one. Only a stretch of a period of up to NEAR bytes (one word again and again) has
neither: it is cut where it begins and ends, and inside into pieces of whole periods that
begin at the period's least hash, so that they are alike whatever stands around it.
Chunks over MAX bytes are cut again every MAX bytes. Chunks are deduplicated by
digest: the first in order of id and place stays.

Rows are taken in blocks. A block asks about each distinct chunk of its own once, one
packed request for each range of digests; a range answers where a chunk came first. So
a chunk that very many texts share is met once for each block of them, and texts are
moved only as packed blocks. Repeated chunks end to end that came first end to end are
one run; what stands beside a run's first is asked for once, however many runs share it,
and the run is read on at both ends, byte by byte.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import kernels as K, suffix_dedup as SD
from quire.llm.common import BLOCK, FILE, ROW, placed, settle

BITS, MIN, MAX = 5, 16, 1024
LEAST = 96  # bytes of a span
REACH = 256  # bytes a run is read on at each end at most: cuts settle within fewer
SHARE = 16 << 20  # bytes of text for each range of digests
NEAR, PERIODIC = 48, 64
_rng = np.random.default_rng(41)
_GEAR = _rng.integers(0, 2**32, 256, np.uint32, endpoint=False)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[data[i]] modulo 2**32, so each value depends on 32 bytes."""
    h, step = _GEAR[data], 1
    while step < 32:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def _weak(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of hashes strictly less than all within NEAR bytes, in one text."""
    if len(h) < 2 * NEAR + 1:
        return np.zeros(0, np.int64)
    low, mid = K.least(h, NEAR), h[NEAR:-NEAR]
    at = np.flatnonzero((mid < low[: len(mid)]) & (mid < low[NEAR + 1 :])) + NEAR
    text = np.searchsorted(offsets, at, "right") - 1
    return at[(at - NEAR - offsets[text] >= 31) & (at + NEAR < offsets[text + 1])] + 1


def _periodic(data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cuts of stretches of short period inside the given chunks. A stretch holds PERIODIC
    bytes at least that are like those a period before; the least period counts."""
    long = end - start > PERIODIC
    start, n = start[long], (end - start)[long]
    begin = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(start - begin, n)
    owner = np.repeat(np.arange(len(n)), n)
    d, free, out = data[at], np.ones(len(at), bool), []
    for p in range(1, NEAR + 1):
        if len(d) < p + PERIODIC:
            break
        # of PERIODIC places in a row some 7 are multiples of 8
        some = d[p::8] == d[:-p:8]
        for step in (1, 2, 3):
            some = some[step:] & some[:-step]
        if not some.any():
            continue
        same = (d[p:] == d[:-p]) & (owner[p:] == owner[:-p]) & free[p:] & free[:-p]
        other = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        for i in np.flatnonzero(np.diff(other) > PERIODIC):
            a, b = int(other[i]), int(other[i + 1]) - 1 + p
            free[a:b] = False
            # hashes from a + 31 on see nothing but the stretch
            first = a + 32 + int(np.argmin(h[at[a] + 31 : at[a] + 31 + p]))
            size = p * -(-NEAR // p)
            out.append(at[a] + np.concatenate([[0], np.arange(first, b + 1, size) - a, [b - a]]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray):
    """(start, end, text number) of the chunks of texts laid end to end."""
    h = gear(data)
    place = np.flatnonzero(h < np.uint32(1 << (32 - BITS))) + 1
    text = np.searchsorted(offsets, place - 1, "right") - 1
    # the hash of a text's first 31 bytes would look into the text before
    place = place[place - offsets[text] >= 32]
    far = np.ones(len(place), bool)
    far[1:] = place[1:] - place[:-1] >= MIN
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], place[far], _weak(h, offsets)]))
    start, end, text = _stretches(data, offsets, start)
    more = _periodic(data, h, start, end)
    if len(more):
        start, end, text = _stretches(data, offsets, np.unique(np.concatenate([start, more])))
    n = -(-(end - start) // MAX)
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start, end, text = (np.repeat(x, n) for x in (start, end, text))
    start = start + number * MAX
    return start, np.minimum(start + MAX, end), text


def _stretches(data: np.ndarray, offsets: np.ndarray, start: np.ndarray):
    start = start[start < len(data)]
    text = np.searchsorted(offsets, start, "right") - 1
    return start, np.minimum(np.append(start[1:], len(data)), offsets[text + 1]), text


def chunked(data: np.ndarray, offsets: np.ndarray):
    """(start, end, text number, two digests) of the chunks of texts laid end to end."""
    parts = []
    for a, b in K.pieces(offsets, 1 << 20):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, text = cuts(d, o)
        middle = (start + end) // 2
        half = K.hash_runs(d, middle, end)  # the second half holds a byte at least
        parts.append((start + offsets[a], end + offsets[a], text + a, K.hash_runs(d, start, end), K.mix(half ^ K.mix(end.astype(np.uint64) - start.astype(np.uint64)))))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, t) for t in (np.int64,) * 3 + (np.uint64,) * 2)


# a chunk asked about: its digests, its row and first byte in the block
ASKED = {"key": "<u8", "digest": "<u8", "row": "<u2", "start": "<u4"}
# one that came earlier: itself, and the row where it came first
MET = {"row": "<u2", "start": "<u4", "f_id": "<i8", "f_block": "<i8", "f_part": "<i4", "f_row": "<u2", "f_start": "<u4"}
_TYPES = {"_pid": pa.int32(), "_block": pa.int64(), "_part": pa.int32()}
_PLACE = "_block long, _part int"
_ASK = f"_pid int, {_PLACE}, _ids binary, " + ", ".join(f"{c} binary" for c in ASKED)
_ANSWER = f"{_PLACE}, " + ", ".join(f"{c} binary" for c in MET)
FIRST = ["f_block", "f_part", "f_row", "f_start", "f_end"]
_RUN = f"{_PLACE}, _row int, _id long, start long, end long, n_chunks long, f_id long, f_block long, f_part int, f_row int, f_start long, f_end long, before binary, after binary"


class _Block:
    """Chunks of one part of a block, and of equal ones the first."""

    def __init__(self, packs: pa.Table):
        self.data, self.offsets, row, ids, self.null = SD.opened(packs)
        self.start, self.end, self.text, self.key, self.digest = chunked(self.data, self.offsets)
        self.row, self.ids = row[self.text], ids[self.text]
        self.at = self.start - self.offsets[self.text]
        self.by_row = SD.by_row(ids, row)
        order, new = SD.first_of_each(self.key, self.digest, (self.ids, self.row, self.at))
        self.first = np.empty(len(order), np.int64)
        self.first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
        self.own = order[new]  # sorted by key


def _asked(one: _Block, block: int, part: int, n: int) -> list:
    own = {"key": one.key, "digest": one.digest, "row": one.row, "start": one.at}
    own = {c: v[one.own] for c, v in own.items()}
    cut = np.searchsorted(own["key"], np.array([(i << 64) // n for i in range(1, n)], np.uint64))
    cut, ids = [0, *cut.tolist(), len(one.own)], SD.ids_of_block(one.by_row)
    return [(p, block, part, ids, *(own[c][a:b].astype(t).tobytes() for c, t in ASKED.items())) for p, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]


def _answered(table: pa.Table) -> pa.Table:
    """One range of digests: of each chunk asked about that came earlier, where first."""
    rows = {c: [np.frombuffer(x, t) for x in table[c].to_pylist()] for c, t in ASKED.items()}
    size = [len(x) for x in rows["key"]]
    doc = np.concatenate([SD.take_ids(i, r) for i, r in zip(table["_ids"].to_pylist(), rows["row"])])
    block, part = (np.repeat(table[c].to_numpy(), size) for c in ("_block", "_part"))
    every = {c: np.concatenate(x) for c, x in rows.items()}
    order, new = SD.first_of_each(every["key"], every["digest"], (doc, block, part, every["row"], every["start"]))
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    met = {"row": every["row"], "start": every["start"], "f_id": doc[first], "f_block": block[first], "f_part": part[first], "f_row": every["row"][first], "f_start": every["start"][first]}
    out, ends = [], np.cumsum(size)
    for b, p, e, n in zip(table["_block"].to_pylist(), table["_part"].to_pylist(), ends.tolist(), size):
        own = np.flatnonzero(first[e - n : e] != np.arange(e - n, e)) + e - n
        if len(own):
            out.append((b, p, *(met[c][own].astype(t).tobytes() for c, t in MET.items())))
    return pa.Table.from_batches([SD.table_of(out, ["_block", "_part", *MET], _TYPES)])


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = np.maximum(end - start, 0)
    edges = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(edges[-1])) + np.repeat(start - edges[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(data[at])]).cast(pa.binary())


def _runs(least: int):
    """Runs of repeated chunks of one part of a block, with the bytes beside them."""

    def run(key, packs: pa.Table, answers: pa.Table) -> pa.Table:
        block, part = key[0].as_py(), key[1].as_py()
        one = _Block(packs)
        met = {c: np.concatenate([np.frombuffer(x, t) for x in answers[c].to_pylist()] or [np.zeros(0, t)]) for c, t in MET.items()}
        spot = (met["row"].astype(np.int64) << 32) + met["start"]
        order = np.argsort(spot)
        # where each chunk came first: the answer to its block's first, or that one itself
        f = one.first
        mine = (one.row[f] << 32) + one.at[f]
        at = np.minimum(np.searchsorted(spot[order], mine), max(len(spot) - 1, 0))
        told = spot[order][at] == mine if len(spot) else np.zeros(len(f), bool)
        hit = order[at] if len(spot) else at
        pick = lambda c, own: np.where(told, met[c][hit], own) if len(spot) else own
        f_id, f_row, f_start = pick("f_id", one.ids[f]), pick("f_row", one.row[f]).astype(np.int64), pick("f_start", one.at[f]).astype(np.int64)
        f_block, f_part = pick("f_block", np.full(len(f), block)), pick("f_part", np.full(len(f), part)).astype(np.int64)
        again = told | (f != np.arange(len(f)))
        size = one.end - one.start
        on = np.zeros(len(f), bool)  # carries on the chunk before and its first
        if len(f):
            on[1:] = again[1:] & again[:-1] & (one.text[1:] == one.text[:-1]) & (f_start[1:] == f_start[:-1] + size[:-1])
            for c in (f_block, f_part, f_row):
                on[1:] &= c[1:] == c[:-1]
        a = np.flatnonzero(again & ~on)
        b = np.flatnonzero(again & ~np.append(on[1:], False)) if len(f) else a
        begin, end, low = one.start[a], one.end[b], one.offsets[one.text[a]]
        before, after = np.maximum(begin - REACH, low), np.minimum(end + REACH, one.offsets[one.text[a] + 1])
        some = after - before >= least  # read on to its utmost, can it be long enough?
        a, b, begin, end, low, before, after = (v[some] for v in (a, b, begin, end, low, before, after))
        null = lambda v: pa.array(v, mask=v == SD.NULL_ID)
        n, f_end = len(a), f_start[a] + end - begin
        return pa.table({
            "_block": pa.array(np.full(n, block)), "_part": pa.array(np.full(n, part, np.int32)), "_row": pa.array(one.row[a].astype(np.int32)),
            "_id": null(one.ids[a].astype(np.int64)), "start": pa.array(begin - low), "end": pa.array(end - low), "n_chunks": pa.array(b - a + 1),
            "f_id": null(f_id[a].astype(np.int64)), "f_block": pa.array(f_block[a].astype(np.int64)), "f_part": pa.array(f_part[a].astype(np.int32)),
            "f_row": pa.array(f_row[a].astype(np.int32)), "f_start": pa.array(f_start[a]), "f_end": pa.array(f_end),
            "before": _slices(one.data, before, begin), "after": _slices(one.data, end, after),
        })

    return run


def _beside(packs: pa.Table, places: pa.Table) -> pa.Table:
    """The bytes before and after firsts, as many as are asked for."""
    data, offsets, row, _, _ = SD.opened(packs)
    text = np.searchsorted(row, places["f_row"].to_numpy())
    start, end = (offsets[text] + places[c].to_numpy() for c in ("f_start", "f_end"))
    before = _slices(data, np.maximum(start - places["left"].to_numpy(), offsets[text]), start)
    return places.select(FIRST).append_column("f_before", before).append_column("f_after", _slices(data, end, np.minimum(end + places["right"].to_numpy(), offsets[text + 1])))


def common(a, b, left: bool) -> np.ndarray:
    """How many bytes of each pair of binary values are alike, from their ends if left."""
    a, ao = K.buffers(a)
    b, bo = K.buffers(b)
    n = np.minimum(np.diff(ao), np.diff(bo))
    begin = np.cumsum(n) - n
    k = np.arange(int(n.sum())) - np.repeat(begin, n)
    at = [np.repeat(o[1:], n) - 1 - k if left else np.repeat(o[:-1], n) + k for o in (ao, bo)]
    alike, some = n.copy(), n > 0
    if some.any():
        unlike = np.where(a[at[0]] != b[at[1]], k, len(k))
        alike[some] = np.minimum(np.minimum.reduceat(unlike, begin[some]), n[some])
    return alike


def repeated_spans(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id") -> DataFrame:
    """A row for each span of ``least`` bytes or more that came earlier: id, start and end
    (bytes), n_chunks, first_id and first_start (where its first byte came first), and
    the row's place (_at_block, _row). A span equals, byte for byte, what lies there.

    Earlier is a smaller id (null least of all; rows of one id block by block) or an
    earlier byte of the same text. A span is a run of chunks met earlier end to end, read
    on at both ends while bytes are alike, by REACH bytes at most: what is alike beyond
    holds chunks of its own. Where chunks came first in several places there is a span for
    each, and spans may overlap. A
    repeat within which no whole chunk lies is not met; of longer ones more are, see the
    README. Null and empty texts have no chunks; repeated rows repeat in all their bytes;
    an empty table has no spans; further columns are not read. A text must fit a task's
    memory about fortyfold.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-int(total) // SHARE))
    packs = SD.sheaves(docs, id_column).withColumnRenamed("_row", "_part")
    part = ["_block", "_part"]

    def enter(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                out += _asked(_Block(_part(pa.Table.from_batches([batch.slice(i, 1)]))), batch["_block"][i].as_py(), batch["_part"][i].as_py(), n)
            yield SD.table_of(out, ["_pid", *part, "_ids", *ASKED], _TYPES)

    find = _runs(least)
    answers = packs.mapInArrow(enter, _ASK).groupBy("_pid").applyInArrow(_answered, _ANSWER)
    runs = packs.groupBy(*part).cogroup(answers.groupBy(*part)).applyInArrow(lambda key, p, a: find(key, _part(p), a), _RUN)
    runs = settle(runs)
    places = runs.groupBy(*FIRST).agg(F.max(F.octet_length("before")).alias("left"), F.max(F.octet_length("after")).alias("right"))
    beside = (
        packs.groupBy(*part)
        .cogroup(places.groupBy("f_block", "f_part"))
        .applyInArrow(lambda p, q: _beside(_part(p), q) if p.num_rows and q.num_rows else _nothing(), "f_block long, f_part int, f_row int, f_start long, f_end long, f_before binary, f_after binary")
    )

    def read_on(batches):
        for batch in batches:
            left, right = common(batch["before"], batch["f_before"], True), common(batch["after"], batch["f_after"], False)
            moved = {"start": -left, "end": right, "f_start": -left}
            columns = [pa.array(batch[c].to_numpy() + moved[c]) if c in moved else batch[c] for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    kept = ["_id", "start", "end", "n_chunks", "f_id", "f_start", "_block", "_row"]
    out = runs.join(beside, FIRST).mapInArrow(read_on, "_id long, start long, end long, n_chunks long, f_id long, f_start long, _block long, _row int")
    return out.where(F.col("end") - F.col("start") >= least).select(
        F.col("_id").alias(id_column), "start", "end", "n_chunks", F.col("f_id").alias("first_id"), F.col("f_start").alias("first_start"),
        F.col("_block").alias(BLOCK), "_row",
    )


def _part(packs: pa.Table) -> pa.Table:
    return packs.rename_columns(["_row" if c == "_part" else c for c in packs.column_names])


def _nothing() -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array([], t) for t in types], names=[*FIRST, "f_before", "f_after"])


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the bytes of the spans taken out of their texts; bytes that are no
    longer UTF-8 at a cut within a character are replaced. Every row stays, in its own
    columns, whatever their names."""
    names = docs.columns
    cut = spans.groupBy(BLOCK, "_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    cut = cut.withColumnsRenamed({BLOCK: "_b", "_row": "_r"})
    rows = placed(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_all")), "_all")
    block, row = F.xxhash64(FILE, F.floor(F.col(ROW) / SD.ROWS)), F.pmod(F.col(ROW), F.lit(SD.ROWS)).cast("int")
    rows = rows.join(cut, (block == F.col("_b")) & (row == F.col("_r")), "left")
    raw = F.col("_all.text").cast("binary")
    # what lies between the furthest end so far and the next span's start
    piece = lambda a, b: F.substring(raw, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept"))
    joined = F.aggregate(
        "_cut",
        none,
        lambda k, s: F.struct(F.greatest(k["at"], s["end"]).alias("at"), F.concat(k["kept"], piece(k["at"], s["start"])).alias("kept")),
        lambda k: F.concat(k["kept"], piece(k["at"], F.octet_length(raw).cast("long"))),
    )
    text = F.when(F.col("_cut").isNull(), F.col("_all.text")).otherwise(F.make_valid_utf8(joined.cast("string")))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"_all.`{c}`").alias(c) for c in names])
