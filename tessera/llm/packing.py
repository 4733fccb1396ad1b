"""Compact rows for shuffles: several NumPy arrays in one compressed binary value."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard

_TYPES = [np.dtype(t) for t in ("<u8", "<i8", "<u4", "<u1", "<f8")]


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as bytes; 4-byte unsigned ones are kept as differences, which compress well where they rise."""
    head, body = [], []
    for a in arrays:
        head.append((_TYPES.index(a.dtype), len(a)))
        if a.dtype == np.dtype("<u4") and len(a):
            a = np.diff(a, prepend=np.uint32(0)).astype(np.uint32)
            a = a.view(np.uint8).reshape(-1, 4).T.copy()
        body.append(a.tobytes())
    return struct.pack("<B", len(head)) + b"".join(struct.pack("<BI", *h) for h in head) + zstandard.ZstdCompressor(level=level).compress(b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    count = data[0]
    head = [struct.unpack_from("<BI", data, 1 + 5 * i) for i in range(count)]
    body, at, out = zstandard.ZstdDecompressor().decompress(data[1 + 5 * count :], max_output_size=sum(_TYPES[t].itemsize * n for t, n in head) or 1), 0, []
    for t, n in head:
        kind = _TYPES[t]
        raw = np.frombuffer(body, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        if kind == np.dtype("<u4"):
            out.append(np.cumsum(raw.reshape(4, n).T.copy().view("<u4").ravel(), dtype=np.uint32))
        else:
            out.append(raw.view(kind) if n else np.empty(0, kind))
    return out


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(starts, append=len(sorted_values))


def by_part(parts: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that occurs, the places of its members, in order."""
    order = np.argsort(parts, kind="stable")
    edges = np.searchsorted(parts[order], np.arange(count + 1))
    for part in np.flatnonzero(np.diff(edges)):
        yield int(part), order[edges[part] : edges[part + 1]]


def row_chunks(batches: Iterable, size: int) -> Iterator:
    """Runs of rows, as Arrow tables, of some ``size`` bytes of text; a document is never cut."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, amount = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = amount + np.cumsum(lengths), 0
        while start < len(ends):
            stop = int(np.searchsorted(ends, size)) + 1
            if stop > len(ends):
                held.append(batch.slice(start))
                amount = int(ends[-1])
                break
            held.append(batch.slice(start, stop - start))
            yield pa.Table.from_batches(held)
            held, amount = [], 0
            ends, start = ends - ends[stop - 1], stop
    if held:
        yield pa.Table.from_batches(held)


def frozen(table) -> bytes:
    """An Arrow table as compressed bytes."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def thawed(data):
    import pyarrow as pa

    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def chunked(batches: Iterable, size: int, lower: bool = False) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Rows of (key, text) batches with their words, some ``size`` words at a time; a document is never cut.

    Words end at ASCII white space; ``lower`` puts A-Z, and nothing else, in lower case.
    """
    from .shared import claim, text_bytes

    claim("words")
    keys, words, held = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            for key, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1))):
                found = text.lower().split() if lower else text.split()
                keys.append(key)
                words.append(found)
                held += len(found)
                if held >= size:
                    yield keys, words
                    keys, words, held = [], [], 0
    if keys:
        yield keys, words
