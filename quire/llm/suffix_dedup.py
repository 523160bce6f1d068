"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

The sort goes from the most significant digit down, through 100 bytes and no further,
and only groups of more than one suffix are sorted on:

1. Suffixes are first grouped by a digit of 32 bytes. Not every suffix is entered:
   every window of 100 bytes has an anchor, the 32-byte run of least hash in it, and
   equal windows have equal anchors at equal places. So the windows that share an
   anchor are entered together, as one stretch, under their anchor's digit, with a
   digest of all their bytes. A digit met once holds no repeat and is done.
2. Stretches equal in all their bytes are equal windows throughout; all but the
   first stretch of each digest repeat.
3. Of the digits whose stretches differ, the first stretch of each digest is sorted
   on: digits of 83 bytes common to 17 windows each say which windows can still be
   alike, and those windows are grouped by all their 100 bytes. Groups are exactly
   the repeated windows; all but the first of each repeat.

Entries of a block of rows travel packed, one request for each range of digits; a
block enters one stretch once, so a passage in very many texts is met once for each
block of them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm import kernels as K
from quire.llm.common import BLOCK, ROW, blocked, part, settle

LENGTH, GRAM, ROWS, BYTES = 100, 32, 512, 32 << 20
CORES = 4
SIDE = -(-(LENGTH - GRAM + 1) // CORES)  # windows that one core stands for
NULL_ID = -(2**63)

# an entry: digit, digest of the stretch, row in the block, first window in the text,
# number of windows, a short digest of each core (0: no window of it)
ENTRY = {"key": "<u8", "digest": "<u8", "row": "<u2", "start": "<u4", "n": "u1", "cores": "<u4"}
HIT = ("row", "start", "n", "cores")
_REQUEST = "_pid int, _block long, _ids binary, " + ", ".join(f"{c} binary" for c in ENTRY)
_HITS = "_block long, " + ", ".join(f"{c} binary" for c in HIT)


def ids_of_block(doc: np.ndarray) -> bytes:
    """The ids of a block's rows by row number: a first id and a step if that tells
    all, else every id."""
    step = int(doc[1] - doc[0]) if len(doc) > 1 else 0
    if (np.diff(doc) == step).all():
        return b"\0" + np.array([doc[0], step], "<i8").tobytes()
    return b"\1" + doc.astype("<i8").tobytes()


def take_ids(raw: bytes, rows: np.ndarray) -> np.ndarray:
    values = np.frombuffer(raw, "<i8", offset=1)
    return values[0] + values[1] * rows.astype(np.int64) if raw[0] == 0 else values[rows]


def table_of(rows: list, names: list, schema: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, schema.get(n, pa.binary())) for c, n in zip(columns, names)], names=names)


_TYPES = {"_pid": pa.int32(), "_block": pa.int64()}


def first_of_each(key, digest, order: tuple):
    """(places sorted by key, digest and order; is it the first of its key and digest)."""
    at = np.lexsort((*order[::-1], digest, key))
    new = np.ones(len(at), bool)
    new[1:] = (key[at[1:]] != key[at[:-1]]) | (digest[at[1:]] != digest[at[:-1]])
    return at, new


def asked(block: int, doc: np.ndarray, found: dict, n_ranges: int) -> list:
    """Request rows of one block. Of equal stretches in the block the first is entered;
    the others repeat it and go on as they are, under a range from n_ranges on."""
    at, new = first_of_each(found["key"], found["digest"], (doc[found["row"]], found["row"], found["start"]))
    ids, out = ids_of_block(doc), []
    rest = {c: found[c][at[~new]] for c in ENTRY}
    if len(rest["key"]):
        rest["cores"] = np.zeros_like(rest["cores"])
        out.append((n_ranges + block % n_ranges, block, b"", *(rest[c].astype(t).tobytes() for c, t in ENTRY.items())))
    first = {c: found[c][at[new]] for c in ENTRY}
    cut = np.searchsorted(first["key"], np.array([(i << 64) // n_ranges for i in range(1, n_ranges)], np.uint64))
    cut = [0, *cut.tolist(), len(first["key"])]
    for p, (a, b) in enumerate(zip(cut, cut[1:])):
        if a < b:
            out.append((p, block, ids, *(first[c][a:b].astype(t).tobytes() for c, t in ENTRY.items())))
    return out


def answered(n_ranges: int):
    """Sorts one range of digits: which entries repeat an earlier one in all their bytes
    (cores 0), and which windows of the others can still be alike (a bit for each core)."""

    def run(table: pa.Table) -> pa.Table:
        names = ["_block", *HIT]
        if table["_pid"][0].as_py() >= n_ranges:
            return table.select(names)
        rows = {c: [np.frombuffer(x, t) for x in table[c].to_pylist()] for c, t in ENTRY.items()}
        size = [len(x) for x in rows["key"]]
        doc = np.concatenate([take_ids(i, r) for i, r in zip(table["_ids"].to_pylist(), rows["row"])])
        block = np.repeat(table["_block"].to_numpy(), size)
        all_of = {c: np.concatenate(x) for c, x in rows.items()}
        at, new = first_of_each(all_of["key"], all_of["digest"], (doc, block, all_of["row"], all_of["start"]))
        mask = np.zeros(len(at), np.uint32)
        firsts = at[new]
        for j in range(CORES):
            core = (all_of["cores"][firsts] >> np.uint32(8 * j)) & np.uint32(0xFF)
            some = np.flatnonzero(core)
            order = some[np.lexsort((core[some], all_of["key"][firsts[some]]))]
            k, c = all_of["key"][firsts[order]], core[order]
            like = np.zeros(len(order), bool)
            like[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
            like[:-1] |= like[1:]
            mask[firsts[order[like]]] |= np.uint32(1 << j)
        hit = np.zeros(len(at), bool)
        hit[at[~new]] = True
        hit |= mask > 0
        all_of["cores"] = mask
        ends, out = np.cumsum(size), []
        for b, e, n in zip(table["_block"].to_pylist(), ends.tolist(), size):
            own = np.flatnonzero(hit[e - n : e]) + e - n
            if len(own):
                out.append((b, *(all_of[c][own].astype(ENTRY[c]).tobytes() for c in HIT)))
        return pa.Table.from_batches([table_of(out, names, _TYPES)])

    return run


def stretches(data: np.ndarray, offsets: np.ndarray) -> dict:
    """Entries of the texts of one piece; row numbers its texts."""
    key, at, first, n, text = K.anchors(data, offsets, LENGTH, GRAM)
    sums = K.running(data)
    digest = K.between(sums, first, first + n + LENGTH - 1)
    cores = np.zeros(len(key), np.uint32)
    for j in range(CORES):
        # windows that begin SIDE*j or up to SIDE-1 more bytes before the anchor hold these bytes
        a, b = at - SIDE * j, at - SIDE * (j + 1) + 1 + LENGTH
        have = (np.maximum(first, a - SIDE + 1) <= np.minimum(first + n - 1, a)).nonzero()[0]
        short = (K.between(sums, a[have], b[have]) >> np.uint64(57)).astype(np.uint32) | np.uint32(0x80)
        cores[have] |= short << np.uint32(8 * j)
    return {"key": key, "digest": digest, "row": text, "start": first - offsets[text], "n": n, "cores": cores}


def windows(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, mask: np.ndarray) -> dict:
    """Entries of single windows: those of the given stretches whose core is in the mask."""
    sums = K.running(data)
    base = start.astype(np.int64) + offsets[row]
    n = n.astype(np.int64)
    at = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    owner = np.repeat(np.arange(len(n)), n)
    anchor = K.anchor_of(data, at, LENGTH, GRAM)
    like = (mask[owner] >> ((anchor - at) // SIDE).astype(np.uint32)) & np.uint32(1) > 0
    at, owner = at[like], owner[like]
    half = K.between(sums, at, at + LENGTH // 2) * np.uint64(3) + K.between(sums, at + LENGTH // 2, at + LENGTH)
    zero = np.zeros(len(at), np.uint32)
    r = row[owner].astype(np.int64)
    return {"key": K.between(sums, at, at + LENGTH), "digest": K.mix(half), "row": r, "start": at - offsets[r], "n": zero + 1, "cores": zero}


def sheaves(docs: DataFrame, id_column: str) -> DataFrame:
    """Blocks of rows, each packed: (_block, first row number, ids, null ids, text
    lengths, texts compressed). A block's row may come in parts."""
    rows = blocked(docs.withColumn("_id", F.col(id_column).cast("long")), ROWS, "_id", "text")

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            block, at = batch[BLOCK].to_numpy(), batch[ROW].to_numpy()
            data, offsets = K.buffers(batch["text"])
            null = np.asarray(batch["_id"].is_null())
            ids = np.asarray(batch["_id"].fill_null(NULL_ID))
            a, out = 0, []
            while a < len(block):
                change = np.flatnonzero((block[a + 1 :] != block[a]) | (np.diff(at[a:]) != 1))
                b = a + 1 + (int(change[0]) if len(change) else len(block) - a - 1)
                b = max(a + 1, min(b, int(np.searchsorted(offsets, offsets[a] + BYTES))))
                text = pack.compress(data[offsets[a] : offsets[b]].tobytes())
                out.append((int(block[a]), int(at[a]) % ROWS, ids[a:b].tobytes(), null[a:b].tobytes(), np.diff(offsets[a : b + 1]).astype("<i8").tobytes(), text))
                a = b
            yield table_of(out, ["_block", "_row", "_ids", "_null", "_sizes", "_text"], {**_TYPES, "_row": pa.int32()})

    return rows.select("_id", "text", BLOCK, ROW).mapInArrow(run, "_block long, _row int, _ids binary, _null binary, _sizes binary, _text binary")


def opened(table: pa.Table):
    """(bytes, offsets, row numbers, ids, null) of a block's parts, in order of row."""
    import zstandard

    parts = sorted(table.to_pylist(), key=lambda r: r["_row"])
    unpack = zstandard.ZstdDecompressor()
    size = [np.frombuffer(p["_sizes"], "<i8") for p in parts]
    raw = [unpack.decompress(p["_text"], max_output_size=max(1, int(s.sum()))) if s.sum() else b"" for p, s in zip(parts, size)]
    row = np.concatenate([p["_row"] + np.arange(len(s)) for p, s in zip(parts, size)])
    ids = np.concatenate([np.frombuffer(p["_ids"], "<i8") for p in parts])
    null = np.concatenate([np.frombuffer(p["_null"], bool) for p in parts])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(size))])
    return np.frombuffer(b"".join(raw), np.uint8), offsets, row, ids, null


def by_row(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.zeros(int(row[-1]) + 1, np.int64)
    out[row] = ids
    return out


def joined(found: list) -> dict:
    return {c: np.concatenate([f[c] for f in found]) for c in ENTRY}


def repeats(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, n_bytes, spans (array of start, end: the maximal runs of bytes that repeat)
    and kept (the other bytes) of each row.

    A byte repeats if a string of 100 bytes that covers it also starts earlier: in a
    row of smaller id, or earlier in the same text. Strings are judged on the input,
    overlaps count, and none crosses rows. A null text is empty and a text of under
    100 bytes has no repeat. Null ids come before all others; rows of one id are taken
    as different texts, in order of place.
    """
    n = max(8, 2 * part(docs.sparkSession))
    packs = sheaves(docs, id_column)

    def enter(batches):
        names = ["_pid", "_block", "_ids", *ENTRY]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                data, offsets, row, ids, _ = opened(one)
                found = []
                for a, b in K.pieces(offsets, 1 << 19):
                    f = stretches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    found.append(f | {"row": row[f["row"] + a]})
                out += asked(batch["_block"][i].as_py(), by_row(ids, row), joined(found), n)
            yield table_of(out, names, _TYPES)

    def hits(requests: DataFrame) -> DataFrame:
        return settle(requests.groupBy("_pid").applyInArrow(answered(n), _HITS))

    def sort_on(key, texts: pa.Table, marks: pa.Table) -> pa.Table:
        names = ["_pid", "_block", "_ids", *ENTRY]
        data, offsets, row, ids, _ = opened(texts)
        mark = {c: np.concatenate([np.frombuffer(x, ENTRY[c]) for x in marks[c].to_pylist()] or [np.zeros(0, ENTRY[c])]) for c in HIT}
        on = np.flatnonzero(mark["cores"])
        if not len(on):
            return pa.Table.from_batches([table_of([], names, _TYPES)])
        mark = {c: x[on] for c, x in mark.items()}
        text = np.searchsorted(row, mark["row"])
        found = []
        for a, b in K.pieces(offsets, 1 << 19):
            own = np.flatnonzero((text >= a) & (text < b))
            if len(own):
                f = windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], text[own] - a, mark["start"][own], mark["n"][own], mark["cores"][own])
                found.append(f | {"row": row[f["row"] + a]})
        return pa.Table.from_batches([table_of(asked(key[0].as_py(), by_row(ids, row), joined(found), n), names, _TYPES)])

    def cut(key, texts: pa.Table, marks: pa.Table) -> pa.Table:
        data, offsets, row, ids, null = opened(texts)
        mark = {c: np.concatenate([np.frombuffer(x, ENTRY[c]) for x in marks[c].to_pylist()] or [np.zeros(0, ENTRY[c])]) for c in HIT}
        whole = mark["cores"] == 0
        start = mark["start"][whole].astype(np.int64) + offsets[np.searchsorted(row, mark["row"][whole])]
        depth = np.zeros(len(data) + 1, np.int32)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + mark["n"][whole] + LENGTH - 1, -1)
        gone = np.cumsum(depth[:-1]) > 0
        spans, kept = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            edge = np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)
            spans.append([{"start": x, "end": y} for x, y in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())])
            kept.append(data[a:b][~gone[a:b]].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "_id": pa.array(ids, pa.int64(), mask=null), "n_bytes": pa.array(np.diff(offsets)),
            "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()),
        })

    requests = ", ".join(["_pid int", "_block long", "_ids binary", *(f"{c} binary" for c in ENTRY)])
    first = hits(packs.mapInArrow(enter, requests))
    again = hits(packs.groupBy("_block").cogroup(first.groupBy("_block")).applyInArrow(sort_on, requests))
    marks = first.unionByName(again)
    out = packs.groupBy("_block").cogroup(marks.groupBy("_block")).applyInArrow(
        cut, "_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )
    return out.withColumnRenamed("_id", id_column)
