"""MinHash near-deduplication: many universal hash minima with banding, signature
verification, exact verification, and connected components by alternating
large-star and small-star.

A node is one distinct set of five-word shingles: texts with equal sets are linked
whatever the rest does, so copies are one node and cost nothing. Nodes that share a
band are candidates. In each bucket first every node is compared with one centre,
drawn by hash anew for each band; then, where a bucket's nodes are still in several
components, all pairs between these are compared block by block, by signature and
then on full sets, so no link that shares a band is lost and no bucket is emitted as
pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quire.llm import kernels as K
from quire.llm.common import ALL, FILE, ROW, apart, placed, settle, whole

BANDS, WIDTH_OF_BAND, WORDS = 24, 3, 5
HASHES = BANDS * WIDTH_OF_BAND
LEAST_AGREE = 0.5  # of the signature: five deviations under a similarity of 0.75
CHUNK = 512  # nodes of one side of a block of pairs
_rng = np.random.default_rng(99)
_A = _rng.integers(1, 2**64, HASHES, np.uint64, endpoint=False) | np.uint64(1)
_B = _rng.integers(0, 2**64, HASHES, np.uint64, endpoint=False)
_C = _rng.integers(1, 2**64, WIDTH_OF_BAND, np.uint64, endpoint=False) | np.uint64(1)


def sets(data: np.ndarray, offsets: np.ndarray):
    """(distinct shingles of each text in order, how many each text has)."""
    n = len(offsets) - 1
    words, text = K.word_hashes(data, offsets)
    values, owner = K.distinct(*K.shingles(words, text, n, WORDS))
    return values, np.bincount(owner, minlength=n)


def signature(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """len(first) x HASHES minima, each cut to its high 32 bits."""
    out = np.empty((HASHES, len(first)), np.uint32)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat(values * _A[k] + _B[k], first) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def bands(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(len(sig), BANDS, WIDTH_OF_BAND).astype(np.uint64)
    return K.mix((s * _C).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _C[0]).view(np.int64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """_id, place, n_shingles, _node (digest of the shingle set; null if it is empty),
    _bands and _sig of every row."""

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch["text"])
            n = batch.num_rows
            count = np.zeros(n, np.int64)
            nodes: list = [None] * n
            own: list = [None] * n
            sigs: list = [None] * n
            for a, b in K.pieces(offsets, 1 << 20):
                values, c = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                count[a:b] = c
                some = np.flatnonzero(c)
                if not len(some):
                    continue
                ends = np.cumsum(c)
                sig = signature(values, (ends - c)[some])
                band = bands(sig)
                raw = values.tobytes()
                for k, i in enumerate(some.tolist()):
                    nodes[a + i] = xxhash.xxh3_128_digest(raw[8 * (ends[i] - c[i]) : 8 * ends[i]])
                    own[a + i] = band[k].tobytes()
                    sigs[a + i] = sig[k].tobytes()
            out = [batch[c] for c in ("_id", FILE, ROW)]
            out += [pa.array(count), pa.array(nodes, pa.binary()), pa.array(own, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["_id", FILE, ROW, "n_shingles", "_node", "_bands", "_sig"])

    rows = placed(docs.withColumn("_id", F.col(id_column).cast("long")), "_id", "text")
    schema = f"_id long, {FILE} long, {ROW} long, n_shingles long, _node binary, _bands binary, _sig binary"
    return rows.mapInArrow(run, schema)


def _band_rows(nodes: DataFrame) -> DataFrame:
    """(_node, _band, _key), a row for each band of each node."""
    piece = lambda i: F.substring(F.col("_bands"), F.lit(1) + i * 8, F.lit(8))
    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("b"), piece(i).alias("k")))
    return nodes.select("_node", F.explode(each).alias("_e")).select(
        "_node", F.col("_e.b").cast("byte").alias("_band"), F.col("_e.k").alias("_key")
    )


def _star_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): every node of a bucket with the bucket's centre."""
    draw = F.struct(F.xxhash64("_band", "_node").alias("h"), F.col("_node").alias("c"))
    centre = rows.groupBy("_band", "_key").agg(F.min(draw).alias("_c"))
    pairs = rows.join(centre, ["_band", "_key"]).where(F.col("_node") != F.col("_c.c"))
    return pairs.select(F.col("_node").alias("a"), F.col("_c.c").alias("b")).distinct()


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in LEAST_AGREE of their places."""
    sig = nodes.select(F.col("_node"), "_sig")
    both = pairs.join(sig.withColumnsRenamed({"_node": "a", "_sig": "_sa"}), "a").join(
        sig.withColumnsRenamed({"_node": "b", "_sig": "_sb"}), "b"
    )

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(K.buffers(batch[c])[0].tobytes(), np.uint32).reshape(-1, HASHES) for c in ("_sa", "_sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= LEAST_AGREE * HASHES))

    return both.select("a", "b", "_sa", "_sb").mapInArrow(run, "a binary, b binary")


def _set_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_node, _set): the shingles of each wanted (_node, place), from its whole text."""

    def run(batches):
        for batch in batches:
            data, offsets = K.buffers(batch["text"])
            for a, b in K.pieces(offsets, 1 << 20):
                values, c = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(c)
                raw = [values[e - n : e].tobytes() for e, n in zip(ends.tolist(), c.tolist())]
                yield pa.RecordBatch.from_arrays([batch["_node"].slice(a, b - a), pa.array(raw, pa.binary())], names=["_node", "_set"])

    at = wanted.select("_node", F.col("_place.f").alias("_f"), F.col("_place.r").alias("_r"))
    text = placed(docs, "text").join(at, (F.col(FILE) == F.col("_f")) & (F.col(ROW) == F.col("_r")))
    return text.select("_node", "text").mapInArrow(run, "_node binary, _set binary")


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two distinct sets have 100 * shared >= percent * union."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(p) + len(q) - n)


def _linked(pairs: DataFrame, set_rows: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * shared >= percent * union on their full sets."""
    one = pairs.join(set_rows.withColumnsRenamed({"_node": "a", "_set": "_x"}), "a")
    both = one.join(set_rows.withColumnsRenamed({"_node": "b", "_set": "_y"}), "b")

    def run(batches):
        for batch in batches:
            (x, xo), (y, yo) = K.buffers(batch["_x"]), K.buffers(batch["_y"])
            x, y = np.frombuffer(x.tobytes(), np.uint64), np.frombuffer(y.tobytes(), np.uint64)
            xo, yo = xo // 8, yo // 8
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                good[i] = _alike(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "_x", "_y").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least node of
    its component. Large-star and small-star alternate until nothing changes; if
    ``rounds`` are given and run out before that, it raises."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # every neighbour, both ways
            near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # only smaller ones
            near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("_a"), F.least("a", "_b").alias("_m"))
        own = near.join(least, near["a"] == least["_a"])
        if large:
            out = own.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        else:
            out = own.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
                least.select(F.col("_a").alias("a"), F.col("_m").alias("b"))
            )
        return out.where("a <> b").distinct()

    e, seen, done = settle(edges.where("a <> b").select("a", "b").distinct()), None, 0
    while True:
        if done == rounds:
            raise RuntimeError(f"components still changed after {rounds} rounds")
        done += 1
        e = settle(star(star(e, True), False))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0]
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _cross_links(rows: DataFrame, roots: DataFrame, nodes: DataFrame, set_rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different components that share a bucket.

    Nodes of buckets still split, with what they share buckets with, are families; a
    family's nodes are compared in blocks of CHUNK by CHUNK, first by signature, then
    on their full sets, likeliest first. Once two components are linked in a block
    their other pairs are left, so a block gives fewer links than it has nodes.
    """
    root = roots.select(F.col("node").alias("_node"), "root")
    rows = rows.join(root, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    split = rows.groupBy("_band", "_key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("_node").alias("_c"))
    members = settle(rows.join(split.where("lo <> hi"), ["_band", "_key"]).select("_node", "root", "_c").distinct())
    family = components(members.select(F.col("_node").alias("a"), F.col("_c").alias("b")))
    family = settle(family.select(F.col("node").alias("_node"), F.col("root").alias("_family")))
    size = family.groupBy("_family").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_m"))
    one = members.select("_node", "root").distinct().join(family, "_node").join(size, "_family")
    one = one.withColumn("_i", F.pmod(F.xxhash64("_node"), F.col("_m")).cast("int"))
    one = one.join(nodes.select("_node", "_sig"), "_node").join(set_rows, "_node")
    # each node goes to the blocks of pairs (i, j), i <= j, of its own chunk
    block = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda j: F.struct(F.least("_i", j).alias("i"), F.greatest("_i", j).alias("j")))
    blocks = one.withColumn("_p", F.explode(block)).select(
        "_family", F.col("_p.i").alias("_pi"), F.col("_p.j").alias("_pj"), "_node", "root", "_sig", "_set", "_i"
    )

    def run(table: pa.Table) -> pa.Table:
        node = table["_node"].to_pylist()
        _, root = np.unique(np.array([r.hex() for r in table["root"].to_pylist()]), return_inverse=True)
        sig = np.frombuffer(b"".join(table["_sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
        full = [np.frombuffer(x, np.uint64) for x in table["_set"].to_pylist()]
        size = np.array([len(x) for x in full])
        chunk = table["_i"].to_numpy()
        i, j = table["_pi"][0].as_py(), table["_pj"][0].as_py()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        found = []
        for x in left.tolist():
            ys = right[right > x] if i == j else right
            ys = ys[(root[ys] != root[x]) & (100 * np.minimum(size[ys], size[x]) >= percent * np.maximum(size[ys], size[x]))]
            agree = (sig[ys] == sig[x]).sum(1)
            good = agree >= LEAST_AGREE * HASHES
            found.append(np.stack([agree[good], np.full(int(good.sum()), x), ys[good]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        joined = list(range(int(root.max()) + 1))

        def top(r: int) -> int:
            while joined[r] != r:
                joined[r] = joined[joined[r]]
                r = joined[r]
            return r

        links = []
        for _, x, y in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
            p, q = top(int(root[x])), top(int(root[y]))
            if p != q and _alike(full[x], full[y], percent):
                joined[p] = q
                links.append((node[x], node[y]))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return blocks.groupBy("_family", "_pi", "_pj").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 75, id_column: str = "doc_id") -> DataFrame:
    """Groups of texts linked by 100 * shared >= percent * union of their shingles.

    Words are runs of bytes other than white space after lower-casing A-Z; a text of
    fewer than five words is one shingle, one without words has an empty set and is
    linked with nothing. Returns id, place, n_shingles, component_id (smallest id
    that can be reached; null ids count only where there are no others), kept
    (the id is component_id) and stays (true for just one row of a group, the first by id and
    place, also where ids repeat or are null). A link shares a band with a chance of
    at least 1 - 2e-6; every link found is confirmed on the full sets.
    """
    prints = settle(fingerprints(docs, id_column))
    place = F.struct(F.col(FILE).alias("f"), F.col(ROW).alias("r"))
    nodes = settle(
        prints.where("_node is not null").groupBy("_node").agg(
            F.min("_id").alias("_least"), F.min(place).alias("_place"), F.any_value("_bands").alias("_bands"), F.any_value("_sig").alias("_sig"),
            F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col(FILE).alias("f"), F.col(ROW).alias("r"))).alias("_first"),
        )
    )
    rows = _band_rows(nodes)
    crowded = rows.groupBy("_band", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_band", "_key")
    rows = settle(rows.join(crowded, ["_band", "_key"]))  # of buckets with two nodes at least
    likely = settle(_likely(_star_pairs(rows), nodes))
    # the sets of all nodes that share a bucket, from which both rounds are confirmed
    full = settle(_set_rows(docs, nodes.join(rows.select("_node").distinct(), "_node")))
    links = settle(_linked(likely, full, percent))
    roots = settle(components(links))
    links = _cross_links(rows, roots, nodes, full, percent).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(links)
    named = nodes.join(roots, nodes["_node"] == roots["node"], "left").withColumn("root", F.coalesce("root", "_node"))
    groups = named.groupBy("root").agg(F.min("_least").alias("component_id"), F.min("_first").alias("_first"))
    table = named.select("_node", "root").join(groups, "root").select("_node", "component_id", "_first")
    light = prints.select("_id", FILE, ROW, "n_shingles", "_node")
    out = light.where("_node is not null").join(table, "_node")
    out = out.unionByName(
        light.where("_node is null").withColumn("component_id", F.col("_id")).withColumn("_first", F.lit(None).cast(table.schema["_first"].dataType))
    )
    first = (F.col("_first.f") == F.col(FILE)) & (F.col("_first.r") == F.col(ROW))
    return out.select(
        F.col("_id").alias(id_column), FILE, ROW, "n_shingles", "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.col("_node").isNull() | first, F.lit(False)).alias("kept"),
        (F.col("_node").isNull() | first).alias("stays"),
    )


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs (its own columns, whatever their names) with one row of each group of
    near-duplicates: that of the smallest id, of rows of one id that of the first place.
    Rows without words stay."""
    stay = near_duplicates(docs, percent).where("stays").select(F.col(FILE).alias("_f"), F.col(ROW).alias("_r"))
    rows = placed(docs.select(whole(docs)), ALL)
    return rows.join(stay, (F.col(FILE) == F.col("_f")) & (F.col(ROW) == F.col("_r")), "left_semi").select(*apart(docs.columns))
