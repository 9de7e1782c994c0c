"""Words of a batch of texts by Arrow kernels, shared by the operators that count words or word runs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# text that one round of kernels works on; bounds a worker's memory
SLICE_BYTES = 4 << 20


class Words(NamedTuple):
    code: np.ndarray        # dictionary index of every word, in text order
    row: np.ndarray         # row that the word stands in, ascending
    dictionary: list[bytes]
    rows: int


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes in ``column``; a longer text makes a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def words(texts: pa.Array, separators: str) -> Words:
    """Maximal pieces between ``separators`` (a pattern), A-Z in lower case; a null text has none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=separators)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                 row.filter(full).to_numpy(zero_copy_only=False).astype(np.int64),
                 coded.dictionary.cast(pa.binary()).to_pylist(), len(texts))
