"""A page's arrays in and out of Python as Arrow lists: no row objects either way."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pages(*columns: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """Each page's slice of every column. A NULL number reads as NaN."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    ends = np.cumsum(lengths(columns[0])).tolist()
    start = 0
    for end in ends:
        yield tuple(f[start:end] for f in flat)
        start = end


def lengths(column: pa.ListArray) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def pack(like: pa.ListArray, **fields: pa.Array) -> pa.ListArray:
    """Flat fields as lists of structs, as long as `like`'s lists."""
    offsets = np.concatenate([[0], np.cumsum(lengths(like))]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields))
    )


def ints(values) -> pa.Array:
    return pa.array(values, type=pa.int32())
