"""Arrow batches of a task gathered into larger tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Rows that stay together even if they have more bytes than asked for.
LEAST_ROWS = 64


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches a task makes; after the last, Arrow's spare memory goes back, as the worker stays for later stages."""
    yield from batches
    pa.default_memory_pool().release_unused()


def sliced(batches: Iterator[pa.RecordBatch], n_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``n_bytes``, as Spark fills a batch by rows, whatever their bytes."""
    for batch in batches:
        step = max(LEAST_ROWS, batch.num_rows * n_bytes // max(batch.nbytes, 1))
        for first in range(0, batch.num_rows, step) if batch.nbytes > n_bytes else (0,):
            yield batch.slice(first, step) if step < batch.num_rows else batch


def tables_of(batches: Iterator[pa.RecordBatch], n_bytes: int) -> Iterator[pa.Table]:
    """Tables of about ``n_bytes``."""
    held, size = [], 0
    for batch in sliced(batches, n_bytes):
        held.append(batch)
        size += batch.nbytes
        if size >= n_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, n_bytes: int) -> Iterator[pa.Table]:
    """Tables of about ``n_bytes`` that never split the rows of a key; rows come sorted by it."""
    rest: pa.Table | None = None
    for table in tables_of(batches, n_bytes):
        held = table if rest is None else pa.concat_tables([rest, table])
        # The last group may go on in the next table.
        n_open = pc.sum(pc.equal(held[key], held[key][-1])).as_py()
        if n_open < held.num_rows:
            yield held.slice(0, held.num_rows - n_open)
        rest = held.slice(held.num_rows - n_open)
    if rest is not None:
        yield rest


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers of all binary values of a column in a row."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def byte_planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as all their first bytes, then all their second ones and so on: small numbers then compress well."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(value: bytes, kind: str) -> np.ndarray:
    """The numbers of :func:`byte_planes`."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(value, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def joined_planes(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers of all values of :func:`byte_planes` of a column in a row."""
    return np.concatenate([np.empty(0, kind), *(from_planes(value, kind) for value in column.to_pylist())])
