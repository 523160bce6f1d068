"""Token ids in length-delimited binary records, with an offset index beside them.

A shard is two files. ``<name>.rec`` holds one record for each document:

    u64 length of the data | u32 masked CRC-32 of those 8 bytes
    data: u8 bytes an id (2 or 4) and the ids, little-endian
    u32 masked CRC-32 of the data

``<name>.idx`` holds 25 bytes for each record, in the same order: u8 whether the id
is null, i64 document id, u64 offset of the record, u64 number of ids, so a reader
can take records in any order. A checksum is masked as
``rotate_right(crc, 15) + 0xa282ead8``, so that data which itself holds checksums
doesn't weaken them.
"""

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import kernels as K
from quire.llm.common import settle, shared

INDEX = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
CACHED = 1_000_000  # stretches an encoder remembers


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def record(ids: np.ndarray, wide: bool) -> bytes:
    data = bytes([4 if wide else 2]) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = len(data).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), data, masked(data).to_bytes(4, "little")))


def ids_of(raw: bytes) -> np.ndarray:
    """The ids of one record; ValueError if a checksum or a length is wrong."""
    size = int.from_bytes(raw[:8], "little")
    if masked(raw[:8]) != int.from_bytes(raw[8:12], "little") or len(raw) != size + 16:
        raise ValueError("the record's length is damaged")
    data = raw[12 : 12 + size]
    if masked(data) != int.from_bytes(raw[12 + size :], "little"):
        raise ValueError("the record's data is damaged")
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", offset=1).astype(np.uint32)


def _set(*spans) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in spans:
        out[first : last + 1] = True
    return out


_LETTER = _set((0x41, 0x5A), (0x61, 0x7A))
_PUNCT = _set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_SOLID = _set((0x21, 0x7E))


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where a byte-level pre-tokenizer surely begins a new piece, whatever
    lies around: at a single space or line feed between two characters that aren't
    white space, after such a line feed, and where punctuation follows a letter.
    Characters judged are ASCII and the two-byte letters that begin with C3."""
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    accent = after & (data != 0x97) & (data != 0xB7)
    solid = _SOLID[data]
    single = np.zeros(len(data), bool)
    single[1:-1] = (solid | after)[:-2] & (solid | lead)[2:]
    feed = single & (data == 0x0A)
    cut = feed | (single & (data == 0x20))
    cut[1:] |= feed[:-1] | ((_LETTER[data] | accent)[:-1] & _PUNCT[data][1:])
    return cut


class Encoder:
    """Ids of whole texts by a byte-level tokenizer of the ``tokenizers`` library.

    A text is encoded stretch by stretch, between the places of ``cuts``, and each
    distinct stretch only once, told apart by its bytes. Where a special token's string occurs, whole texts
    are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = self.tokenizer.get_vocab_size() > 65536
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.forget()

    def forget(self):
        """Stretches known: their ids, their bytes, and slots by hash."""
        self.start = self.count = self.begin = self.size = self.slot = np.zeros(0, np.int64)
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.known = np.zeros(0, np.uint64)

    def joined(self, data, start, end):
        """(ids, counts) of stretches that hold no line feed and neither begin nor end
        with odd white space: laid in lines, a line feed is one piece of its own."""
        size = end - start + 1
        ends = np.cumsum(size)
        lines = np.full(ends[-1], 0x0A, np.uint8)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        lines[inner] = data[at[inner]]
        every = np.searchsorted(ends, np.arange(1 << 16, ends[-1] + (1 << 16), 1 << 16))
        edges = [0, *np.unique(ends[np.minimum(every, len(ends) - 1)]).tolist()]
        texts = [lines[x:y].tobytes().decode() for x, y in zip(edges, edges[1:])]
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(got)
        feeds = np.flatnonzero(ids == self.feed)
        return ids[ids != self.feed], np.diff(feeds, prepend=-1) - 1

    def learn(self, data, start, end):
        """Encodes stretches; they get the next slots, in order."""
        feeds = np.concatenate([[0], np.cumsum(data == 0x0A)])
        first = start + (data[start] == 0x20)
        last = data[end - 1]
        easy = (feeds[start] == feeds[end]) & (first < end)
        head = data[np.minimum(first, len(data) - 1)]
        easy &= (_SOLID[head] | (head == 0xC3)) & (_SOLID[last] | ((data[end - 2] == 0xC3) & (end - start > 1)))
        easy &= self.feed is not None
        many, parts = np.zeros(len(start), np.int64), []
        if easy.any():
            flat, many[easy] = self.joined(data, start[easy], end[easy])
            parts.append(flat)
        if not easy.all():
            rest = ~easy
            texts = [data[a:b].tobytes().decode() for a, b in zip(start[rest].tolist(), end[rest].tolist())]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            many[rest] = np.fromiter(map(len, got), np.int64, len(got))
            parts.append(np.fromiter((x for ids in got for x in ids), np.uint32, int(many[rest].sum())))
        at = np.empty(len(start), np.int64)  # where each one's ids begin: the easy ones lie first
        order = np.argsort(~easy, kind="stable")
        at[order] = np.cumsum(many[order]) - many[order] + len(self.ids)
        self.start, self.count = np.concatenate([self.start, at]), np.concatenate([self.count, many])
        self.ids = np.concatenate([self.ids, *parts])

    def find(self, hashes, data, start, end):
        """The slot of each stretch that is known, byte for byte; -1 for others."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        slots = np.full(len(hashes), -1)
        met = np.flatnonzero(self.known[at] == hashes) if len(self.known) else at[:0]
        own = self.slot[at[met]]
        size = (end - start)[met]
        met, own, size = (v[size == self.size[own]] for v in (met, own, size))
        if len(met):
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            same = data[np.repeat(start[met], size) + step] == self.bytes[np.repeat(self.begin[own], size) + step]
            same = np.logical_and.reduceat(same, np.cumsum(size) - size)
            slots[met[same]] = own[same]
        return slots

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of all texts end to end, number of ids of each text)."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        raw = data.tobytes()
        cut = np.zeros(len(data), bool) if any(x in raw for x in self.special) else cuts(data)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        edges = pa.py_buffer(np.append(start, len(data)).astype(np.int64))
        each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, edges, pa.py_buffer(raw)]).dictionary_encode()
        which = each.indices.to_numpy()
        words, ends = K.buffers(each.dictionary)  # the distinct stretches, end to end
        begin, end = ends[:-1], ends[1:]
        hashes = K.hash_runs(words, begin, end)
        if len(self.start) > CACHED:
            self.forget()
        slots = self.find(hashes, words, begin, end)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = len(self.start) + np.arange(len(new))
            self.learn(words, begin[new], end[new])
            size = (end - begin)[new]
            step = np.arange(int(size.sum())) + np.repeat(begin[new] - (np.cumsum(size) - size), size)
            self.begin = np.concatenate([self.begin, np.cumsum(size) - size + len(self.bytes)])
            self.size, self.bytes = np.concatenate([self.size, size]), np.concatenate([self.bytes, words[step]])
            # of stretches alike in hash but not in bytes the first known is found again
            self.known, first = np.unique(np.concatenate([self.known, hashes[new]]), return_index=True)
            self.slot = np.concatenate([self.slot, slots[new]])[first]
        at = slots[which]
        first, count = self.start[at], self.count[at]
        total = np.cumsum(count)
        take = np.arange(total[-1]) + np.repeat(first - (total - count), count)
        text = np.searchsorted(offsets, start, "right") - 1
        return self.ids[take], np.bincount(text, count, n).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_records(docs: DataFrame, tokenizer: str, out: str, end_id: int = 0, id_column: str = "doc_id") -> DataFrame:
    """Encodes every whole text and writes shards under ``out`` in ascending id order.

    Null text is empty, null ids come first, rows of one id are ordered by text and
    all written. Each document ends with ``end_id``. Rows are dealt by range of id
    (and text, so that one id of many rows is spread too); each task writes one
    shard under a name of its own and reports it, so a task that runs twice leaves a
    file that no manifest names. Returns the manifest, one row for each shard: path,
    first_null, first_id, first_key, records, ids.
    """
    key = F.xxhash64("text")
    dealt = docs.select(F.col(id_column).cast("long").alias("_id"), F.col("text"), key.alias("_key"))
    dealt = dealt.repartitionByRange("_id", "_key").sortWithinPartitions("_id", "_key", "text")

    def write(batches):
        store, base = fs.FileSystem.from_uri(out)
        name = f"part-{uuid.uuid4().hex}"
        rec = idx = head = None
        offset = total = n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rec is None:
                rec, idx = (store.open_output_stream(f"{base}/{name}.{x}") for x in ("rec", "idx"))
                head = (batch["_id"][0].as_py(), batch["_key"][0].as_py())
            code = encoder(tokenizer)
            data, offsets = K.buffers(batch["text"])
            null = np.asarray(batch["_id"].is_null())
            doc = np.asarray(batch["_id"].fill_null(0))
            for a, b in K.pieces(offsets, 1 << 21):
                ids, count = code.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(count)
                index = np.zeros(b - a, INDEX)
                index["null"], index["doc_id"], index["n"] = null[a:b], doc[a:b], count + 1
                for i in range(b - a):
                    raw = record(np.append(ids[ends[i] - count[i] : ends[i]], np.uint32(end_id)), code.wide)
                    index["offset"][i] = offset
                    offset += len(raw)
                    rec.write(raw)
                idx.write(index.tobytes())
                total, n = total + int(ends[-1]) + b - a, n + b - a
        if rec is not None:
            rec.close()
            idx.close()
            names = ["path", "first_id", "first_key", "records", "ids"]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(names, (f"{out}/{name}", *head, n, total)))],
                pa.schema([("path", pa.string()), *[(x, pa.int64()) for x in names[1:]]]),
            )

    store, base = fs.FileSystem.from_uri(out)
    store.create_dir(base)
    return settle(dealt.mapInArrow(write, "path string, first_id long, first_key long, records long, ids long"))


def read_records(manifest: DataFrame, spans: int = 4) -> DataFrame:
    """Reads shards back by their index: doc_id, start (ids in all records before),
    n_tokens, ids (little-endian u32). Every checksum is checked.

    Ids before a shard are summed over the manifest (one row a shard). A shard is
    read in ``spans`` tasks, each seeking to its own records.
    """
    from pyspark.sql import Window as W

    before = W.orderBy(F.col("first_id").asc_nulls_first(), "first_key").rowsBetween(W.unboundedPreceding, -1)
    work = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    work = work.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).repartition("path", "span")

    def read(batches):
        for batch in batches:
            for job in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(job["path"])
                with store.open_input_file(f"{at}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                start = job["start"] + np.cumsum(index["n"].astype(np.int64)) - index["n"].astype(np.int64)
                lo, hi = (len(index) * (job["span"] + x) // spans for x in (0, 1))
                if lo == hi:
                    continue
                with store.open_input_file(f"{at}.rec") as f:
                    ends = np.append(index["offset"][1:], f.size()).astype(np.int64)
                    i = lo
                    while i < hi:
                        j = max(i + 1, int(np.searchsorted(ends[:hi], int(index["offset"][i]) + (4 << 20))))
                        base = int(index["offset"][i])
                        raw = f.read_at(int(ends[j - 1]) - base, base)
                        got = [ids_of(raw[int(index["offset"][k]) - base : int(ends[k]) - base]) for k in range(i, j)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(index["doc_id"][i:j], pa.int64(), mask=index["null"][i:j] > 0),
                                pa.array(start[i:j], pa.int64()),
                                pa.array([len(x) for x in got], pa.int64()),
                                pa.array([x.astype("<u4").tobytes() for x in got], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        i = j

    return work.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` as records in the shared folder and reads them back."""
    return read_records(write_records(docs, tokenizer or default_tokenizer(), shared(spark)))
