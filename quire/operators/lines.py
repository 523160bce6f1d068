"""Runs of text to printed lines, and links laid over the lines.

The page is the unit: which run joins which depends on the runs before it. Runs are
packed where they lie: of each page that a batch of rows holds, one piece, a list for
each column and the words end to end. Pieces are grouped by page, once, and one function
makes the lines of a whole batch of pages (`bands`), so that no run is ever sorted or
shuffled as a row.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type
from pyspark.sql.types import StructType

from quire import constants as K
from quire.functions import geometry as G, text as T
from quire.operators import bands, paged

PAGE = ["doc_id", "page"]

_NUMBERS = ("x", "y", "w", "h", "base", "size")
_FLAGS = ("lead", "trail", "bold", "italic", "marker")
_PIECE = pa.schema(
    [("run_no", pa.list_(pa.int64())), ("words", pa.string()), ("bytes", pa.list_(pa.int32()))]
    + [(c, pa.list_(pa.float64())) for c in _NUMBERS]
    + [("flags", pa.list_(pa.int8())), ("fonts", pa.list_(pa.string())), ("font", pa.list_(pa.int32()))]
)


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Values as numbers from 0, null as one of them, and the values these stand for."""
    told = values.dictionary_encode("encode")
    return told.indices.to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary


def _buffer(words: pa.StringArray) -> tuple[np.ndarray, pa.Buffer]:
    """Where each word begins and the last ends, and the bytes of all."""
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return edges, words.buffers()[2] or pa.py_buffer(b"")


def pack_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs as pieces: of each page in a batch, its runs in one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = {name: batch.column(name) for name in batch.schema.names}
        keys = np.stack([_codes(runs[c])[0] for c in PAGE])
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(0)
        begin = np.flatnonzero(new)
        edges = np.append(begin, len(order)).astype(np.int32)
        runs = {name: column.take(pa.array(order)) for name, column in runs.items()}
        lists = lambda values, at=edges: pa.ListArray.from_arrays(pa.array(at), values)
        text = runs["text"]
        size = pc.fill_null(pc.binary_length(text), -1).cast(pa.int32())
        at, raw = _buffer(pc.fill_null(text, ""))
        flags = sum(runs[c].fill_null(False).to_numpy(zero_copy_only=False).astype(np.int8) << k for k, c in enumerate(_FLAGS))
        # a piece names each of its fonts once
        code, fonts = _codes(runs["font"])
        piece = np.repeat(np.arange(len(begin)), np.diff(edges))
        named, which = np.unique(piece * len(fonts) + code, return_inverse=True)
        first = np.searchsorted(named, np.arange(len(begin) + 1) * len(fonts)).astype(np.int32)
        columns = {
            **{c: runs[c].take(pa.array(begin)) for c in PAGE},
            "run_no": lists(runs["run_no"].cast(pa.int64())),
            "words": pa.StringArray.from_buffers(len(begin), pa.py_buffer(at[edges].tobytes()), raw),
            "bytes": lists(size),
            **{c: lists(runs[c]) for c in _NUMBERS},
            "flags": lists(pa.array(flags.astype(np.int8))),
            "fonts": lists(fonts.take(pa.array(named % len(fonts))), first),
            "font": lists(paged.ints(which.reshape(-1) - first[piece])),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class _Runs:
    """Runs of pages given by their pieces, page after page and by run_no in each, as arrays:
    count (of each page), run_no, words, the numbers with NaN for null, known (which are no
    null), the flags, and font."""

    def __init__(self, pieces: pa.ListArray):
        of_page, pieces = paged.lengths(pieces), pieces.flatten()
        part = dict(zip([f.name for f in pieces.type], pieces.flatten()))
        n_runs = paged.lengths(part["run_no"])
        piece = np.repeat(np.arange(len(pieces)), n_runs)
        page = np.repeat(np.arange(len(of_page)), of_page)[piece]
        flat = {name: column.flatten() for name, column in part.items() if name != "words"}
        self.run_no = flat["run_no"].fill_null(np.iinfo(np.int64).min).to_numpy()
        size = flat["bytes"].to_numpy()
        at, raw = _buffer(part["words"])
        ends = (at[0] if len(at) else 0) + np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
        words = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32).tobytes()), raw)
        begins = np.cumsum(paged.lengths(part["fonts"])) - paged.lengths(part["fonts"])
        font = flat["fonts"].take(pa.array(begins[piece] + flat["font"].to_numpy()))
        order = np.lexsort((self.run_no, page))
        same = (page[order][1:] == page[order][:-1]) & (self.run_no[order][1:] == self.run_no[order][:-1])
        if same.any():  # runs of one number go by what they say and where they stand
            said = [*zip(words.to_pylist(), *[flat[c].to_pylist() for c in _NUMBERS], flat["flags"].to_pylist())]
            key = lambda i: (page[i], self.run_no[i], *[(v is not None, v) for v in said[i]])
            order = np.array(sorted(order.tolist(), key=key))
        self.page, self.run_no, taken = page[order], self.run_no[order], pa.array(order)
        self.count = np.bincount(self.page, minlength=len(of_page))
        self.words, self.font, self.silent = words.take(taken), font.take(taken), size[order] < 0
        for c in _NUMBERS:
            setattr(self, c, flat[c].take(taken).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float))
        self.known = {c: flat[c].take(taken).is_valid().to_numpy(zero_copy_only=False) for c in _NUMBERS}
        flags = flat["flags"].to_numpy()[order]
        for k, c in enumerate(_FLAGS):
            setattr(self, c, (flags >> k & 1).astype(bool))

    def lines(self) -> bands.Lines:
        return bands.Lines(*[getattr(self, c) for c in _NUMBERS], self.marker, self.count)


def _utf16(words: pa.StringArray) -> np.ndarray:
    """Lengths in UTF-16 units: ``T.utf16_length``."""
    at, raw = _buffer(words)
    raw = np.frombuffer(raw, np.uint8)
    units = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80).astype(np.int64) + (raw >= 0xF0))])
    return units[at[1:]] - units[at[:-1]]


_LINE = pa.struct(
    [("text", pa.string())] + [(c, pa.float64()) for c in ("x", "y", "w", "h", "size")] + [("bold", pa.bool_()), ("italic", pa.bool_()), ("font", pa.string())]
)


def make_lines(pieces: pa.ListArray) -> pa.ListArray:
    """The lines of each page, as ``bands`` numbers them; text and numbers as they come."""
    runs = _Runs(pieces)
    at = runs.lines()
    order = np.lexsort((at.place, at.line, runs.page))
    page, line = runs.page[order], at.line[order]
    new = np.ones(len(order), bool)
    new[1:] = (page[1:] != page[:-1]) | (line[1:] != line[:-1])
    begin = np.flatnonzero(new)
    on = np.cumsum(new) - 1
    edges = np.append(begin, len(order)).astype(np.int32)
    # A space is told by the pieces' own spaces or by the gap between them.
    blank = pa.array(["", " "])
    space = lambda told: blank.take(pa.array((told & ~runs.silent)[order].astype(np.int32)))
    said = pc.binary_join_element_wise(space(runs.lead | at.gap), runs.words.take(pa.array(order)), space(runs.trail), "")
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), said), "")

    def edge(over, values, known, void):
        """The least or greatest known value of each line, null if there is none."""
        none = ~np.logical_or.reduceat(known, begin) if len(begin) else np.zeros(0, bool)
        return (over.reduceat(np.where(known, values, void), begin) if len(begin) else np.zeros(0)), none

    box, none = {}, {}
    for c, span in (("x", "w"), ("y", "h")):
        v, k = getattr(runs, c)[order], runs.known[c][order]
        far, both = v + getattr(runs, span)[order], k & runs.known[span][order]
        # a number that is none is greater than any
        box[c], none[c] = edge(np.fmin, v, k, np.nan)
        most, gone = edge(np.maximum, far, both, -np.inf)
        box[span], none[span] = most - box[c], none[c] | gone
    chars = _utf16(runs.words)[order] * ~runs.silent[order]
    longest = np.lexsort((at.place[order], -np.where(runs.silent[order], -1, chars), on))[begin]
    total = lambda v: np.add.reduceat(v, begin) if len(begin) else v
    empty = np.logical_and.reduceat(runs.silent[order], begin) if len(begin) else np.zeros(0, bool)
    most = lambda flag: pa.array(total(flag[order] * chars) * 2 > total(chars), mask=empty)
    pick = order[longest]
    fields = [text, *[pa.array(box[c], mask=none[c]) for c in "xywh"]]
    fields += [pa.array(runs.size[pick], mask=~runs.known["size"][pick]), most(runs.bold), most(runs.italic), runs.font.take(pa.array(pick))]
    per_page = np.concatenate([[0], np.cumsum(np.bincount(page[begin], minlength=len(pieces)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per_page), pa.StructArray.from_arrays(fields, [f.name for f in _LINE]))


STEP = 512  # pages whose runs are held at a time


@F.arrow_udf(from_arrow_type(pa.list_(_LINE)))
def _make_lines(pieces: pa.Array) -> pa.Array:
    made = [make_lines(pieces.slice(a, STEP)) for a in range(0, len(pieces), STEP)]
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(_LINE))


_STRIP = pa.list_(
    pa.struct([("run_no", pa.int64()), ("half", pa.int32()), ("clear", pa.int32()), ("inked", pa.int32()), ("side", pa.bool_())])
)


@F.arrow_udf(from_arrow_type(_STRIP))
def _strips(pieces: pa.Array) -> pa.Array:
    runs = _Runs(pieces)
    on = runs.lines()
    order = np.lexsort((on.strip_half, on.strip_run))
    run = on.strip_run[order]
    edges = np.concatenate([[0], np.cumsum(np.bincount(runs.page[run], minlength=len(pieces)))]).astype(np.int32)
    fields = [pa.array(runs.run_no[run]), *[paged.ints(v) for v in (on.strip_half[order], on.clear[order], on.inked[order])]]
    strips = pa.StructArray.from_arrays([*fields, pa.array(on.side[order])], [f.name for f in _STRIP.value_type])
    return pa.ListArray.from_arrays(pa.array(edges), strips)


def packed_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, page, pieces): each page's runs, packed. Runs that don't say themselves
    whether they are list markers are told by their text."""
    marker = F.col("marker") if "marker" in runs.columns else F.trim("text").rlike(T.BULLET_ONLY_RE) | F.trim("text").rlike(T.MARKER_ONLY_RE)
    numbers = [F.col(f"box.{c}").cast("double").alias(c) for c in "xywh"] + [F.col(c).cast("double").alias(c) for c in ("base", "size")]
    flat = runs.select(*PAGE, "run_no", "text", *numbers, "lead", "trail", "bold", "italic", marker.alias("marker"), "font")
    schema = StructType([runs.schema[c] for c in PAGE] + from_arrow_schema(_PIECE).fields)
    pieces = flat.mapInArrow(pack_runs, schema)
    return pieces.groupBy(*PAGE).agg(F.collect_list(F.struct(*_PIECE.names)).alias("pieces"))


def gutter_evidence(runs: DataFrame) -> DataFrame:
    """(doc_id, page, run_no, half, clear, inked, side) for each gap that could be a
    gutter or a space: what the nearest lines above and below that run across its left
    (0) or right (1) half, in type of its size, have there. run_no: the run after the
    gap; side: one side's lines, as many as count, are all clear."""
    found = packed_runs(runs).select(*PAGE, F.inline(_strips("pieces")))
    return found.withColumn("run_no", F.col("run_no").cast(runs.schema["run_no"].dataType))


def runs_to_lines(runs: DataFrame, leave_out: DataFrame | None = None) -> DataFrame:
    """runs(doc_id, page, run_no, text, lead, trail, box, base, size, bold, italic, font)
    to lines(doc_id, page, line_no, text, box, size, bold, italic, font). Runs may have
    marker, whether one is a list marker: what follows it joins it over a wider gap.
    Pages in leave_out(doc_id, page) have no lines; they are left out once packed."""
    pages = packed_runs(runs)
    if leave_out is not None:
        pages = pages.join(leave_out.select(*PAGE), PAGE, "left_anti")
    # from the top down, by the box as it is given out
    down = lambda l, i: F.struct(G.round_to(l["y"]).alias("top"), G.round_to(l["x"]).alias("left"), i.alias("line"), l.alias("l"))
    placed = pages.select(*PAGE, _make_lines("pieces").alias("lines")).select(
        *PAGE, F.posexplode(F.array_sort(F.transform("lines", down))).alias("line_no", "at")
    )
    return placed.select(*PAGE, "line_no", "at.l.*").select(
        *PAGE,
        "line_no",
        T.ws_trim(T.ws_collapse(F.col("text"))).alias("text"),
        G.rounded(F.struct(*"xywh")).alias("box"),
        G.round_to(F.col("size"), 10).alias("size"),
        "bold",
        "italic",
        "font",
    )


def text_layer(runs: DataFrame) -> DataFrame:
    """Each page's text before any grouping: its runs joined by a space."""
    return runs.groupBy(*PAGE).agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY run_no)").alias("text")
    )


def mark_links(lines: DataFrame, links: DataFrame) -> DataFrame:
    """lines with href: the first link over half of the line's area.

    A page's links travel as one array beside each of its lines, so no pair of
    line and link is ever a row.
    """
    per_page = links.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct("link_no", "box", "url"))).alias("_links")
    )
    line = F.col("box")
    area = line["w"] * line["h"]

    def covers(link):
        shared = F.greatest(F.lit(0.0), G.overlap_x(link["box"], line)) * F.greatest(
            F.lit(0.0), G.overlap_y(link["box"], line)
        )
        return (area > 0) & (shared >= K.LINK_COVER * area)

    first = F.get(F.filter(F.col("_links"), covers), F.lit(0))["url"]
    return lines.join(per_page, PAGE, "left").withColumn("href", first).drop("_links")
