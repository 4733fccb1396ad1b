"""Substring deduplication with a count-min prefilter.

A window is ``WINDOW`` consecutive words.  Documents are packed into chunks.  The
first pass keeps a count-min sketch of all windows, dealt by hash range: a chunk
sends the cells of its windows to their ranges, a range merges what comes to its
part of the sketch and answers each chunk which of its cells hold two or more
windows.  A count in the sketch is never too low, so a second pass has to group
exactly only the windows all of whose cells are set; none is lost.

The exact grouping is by 64-bit hashes of whole windows, dealt by hash range.  A
chunk sends each of its distinct windows once: one that occurs twice within the
chunk is known to repeat and needs no answer, so a passage that a third of all
documents share costs one entry a chunk.  The sketch grows with the input and stays
where it is dealt: nothing of it is collected or broadcast.

Defined results: a null text has no words; a document shorter than a window has
no window and is kept; windows are judged on the input, the same document
included; repeated rows, also those without an id, repeat each other; a very long
text is one chunk; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import by_part, frozen, pack, row_chunks, runs, thawed, unpack
from .shared import chunk_bytes, claim, discard, documents, hash_ranges, hashed_words, mixed, ship, text_bytes, text_size, tidy, tidy_cogroup, written

#: Words of a window.
WINDOW = 35
#: Text bytes of a chunk, at least, and for each hash range.
CHUNK_BYTES, PART_BYTES = 2_000_000, 16_000_000
#: Rows of the sketch; bytes of text for each cell of a row; least cells of a row's range, as a power of two.
ROWS, BYTES_A_CELL, LEAST_BITS = 2, 3, 10

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        with np.errstate(over="ignore"):
            up = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
            _POWERS.update(n=n, up=up(_BASE), down=up(pow(_BASE, -1, 1 << 64)))
    return _POWERS["up"], _POWERS["down"]


def windows(words: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document number and place of every window of a chunk, in order."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = hashed_words([w for doc in words for w in doc])
    count, n = len(words), len(flat)
    del words  # of all that a chunk needs the largest
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * up[:n], dtype=np.uint64)])
    doc = np.repeat(np.arange(count, dtype=np.uint32), lengths)
    place = np.arange(n, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(place + size <= np.repeat(lengths, lengths))
    return mixed((sums[at + size] - sums[at]) * down[at]), doc[at], place[at].astype(np.uint32)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(hashes ^ np.uint64(0xA5A5A5A5 * (row + 1))) >> np.uint64(64 - bits)


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, data): the rows of ``docs`` in chunks of some ``size`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for rows in row_chunks(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([frozen(rows)], pa.binary())], names=["chunk", "data"])
            chunk += 1

    return docs.mapInArrow(tidy(run), "chunk long, data binary")


def chunk_words(data: bytes) -> list[list[bytes]]:
    claim("words")
    return [t.split() for c in thawed(data).column("text").chunks for t in text_bytes(c)]


class Cells:
    """Where the windows of a chunk fall in one row of the sketch: distinct cells in order, range after range."""

    def __init__(self, hashes: np.ndarray, row: int, ranges: int, bits: int):
        part = hashes >> np.uint64(64 - (ranges.bit_length() - 1))
        cell = part << np.uint64(bits) | cells_of(hashes, row, bits)
        self.order = np.argsort(cell)
        starts, self.lengths = runs(cell := cell[self.order])
        self.inside = (cell[starts] & np.uint64((1 << bits) - 1)).astype(np.uint32)
        self.edges = np.searchsorted(cell[starts], np.arange(ranges + 1, dtype=np.uint64) << np.uint64(bits))

    def of_windows(self, on: np.ndarray) -> np.ndarray:
        """What is known of the cells, for each window."""
        out = np.empty(len(self.order), bool)
        out[self.order] = np.repeat(on, self.lengths)
        return out


def sketched(held: DataFrame, size: int, ranges: int, bits: int) -> DataFrame:
    """(chunk, part, data): for each chunk and range, which of the chunk's cells there hold two or more windows."""

    def messages(chunk: int, data: bytes) -> pa.RecordBatch:
        found, _, _ = windows(chunk_words(data), size)
        rows = [Cells(found, r, ranges, bits) for r in range(ROWS)]
        del found
        parts = np.flatnonzero(np.diff(rows[0].edges)).tolist()
        sent = [pack(*[x for c in rows for at in [slice(c.edges[p], c.edges[p + 1])] for x in (c.inside[at], np.packbits(c.lengths[at] > 1))]) for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array(sent, pa.binary())], names=["part", "chunk", "data"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield messages(chunk, data.as_py())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for part, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, []).append((chunk, data))
        for part in list(held):
            messages, counts = held.pop(part), np.zeros((ROWS, 1 << bits), np.uint8)
            for _, data in messages:
                got = unpack(data)
                for row in range(ROWS):
                    cells, more = got[2 * row], np.unpackbits(got[2 * row + 1], count=len(got[2 * row]))
                    counts[row, cells] = np.minimum(counts[row, cells], 1) + 1 + more
            for start in range(0, len(messages), 256):
                some = messages[start : start + 256]
                answers = [pack(*[np.packbits(counts[row, unpack(data)[2 * row]] > 1) for row in range(ROWS)]) for _, data in some]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.int64()), pa.array([part] * len(some), pa.int32()), pa.array(answers, pa.binary())], names=["chunk", "part", "data"])

    sent = held.mapInArrow(tidy(emit), "part int, chunk long, data binary").repartition(ranges, "part")
    return sent.mapInArrow(tidy(merge), "chunk long, part int, data binary")


def estimated_repeated(found: np.ndarray, answers: list[tuple[int, bytes]], ranges: int, bits: int) -> np.ndarray:
    """For each window of a chunk, whether all its cells hold two or more, by the ranges' answers."""
    ok = np.ones(len(found), bool)
    got = [unpack(data) for _, data in sorted(answers)]
    for row in range(ROWS):
        cells = Cells(found, row, ranges, bits)
        sizes = np.diff(cells.edges)
        on = [np.unpackbits(g[row], count=n) for g, n in zip(got, sizes[np.diff(cells.edges) > 0])]
        ok &= cells.of_windows(np.concatenate(on).astype(bool))
    return ok


def repeated_windows(held: DataFrame, answers: DataFrame, size: int, ranges: int, bits: int) -> DataFrame:
    """(chunk, data): the documents, by their place in the chunk, and the places in them where windows start that occur more than once."""

    def candidates(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        key = None
        if chunk.num_rows and answered.num_rows:
            key = chunk.column("chunk")[0].as_py()
            found, doc, place = windows(chunk_words(chunk.column("data")[0].as_py()), size)
            kept = np.flatnonzero(estimated_repeated(found, list(zip(answered.column("part").to_pylist(), answered.column("data").to_pylist())), ranges, bits))
            found, doc, place = found[kept], doc[kept], place[kept]
            order = np.argsort(found)
            starts, lengths = runs(found[order])
            more = np.zeros(len(found), bool)
            more[order] = np.repeat(lengths > 1, lengths)
            several = found[order][starts[lengths > 1]]
            part, part_of = ((x >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64) for x in (found, several))
            edges = np.searchsorted(part_of, np.arange(ranges + 1))
            for p, own in by_part(part, ranges):
                single, known = own[~more[own]], own[more[own]]
                out.append((p, pack(found[single], doc[single], place[single], several[edges[p] : edges[p + 1]], doc[known], place[known])))
        return pa.table([pa.array([p for p, _ in out], pa.int32()), pa.array([key] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())], names=["part", "chunk", "data"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for part, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                by.setdefault(part, []).append((chunk, data))
        for part in list(by):
            messages = by.pop(part)
            got = [unpack(data) for _, data in messages]
            ends = np.cumsum([len(g[0]) for g in got])
            every = np.concatenate([g[0] for g in got] + [g[3] for g in got])
            order = np.argsort(every)
            starts, lengths = runs(every[order])
            repeated = np.zeros(len(every), bool)
            repeated[order] = np.repeat(lengths > 1, lengths)
            del every, order
            for (chunk, _), end, (single, doc, place, _, known_doc, known_place) in zip(messages, ends, got):
                on = repeated[end - len(single) : end]
                if on.any() or len(known_doc):
                    data = pack(np.concatenate([doc[on], known_doc]), np.concatenate([place[on], known_place]))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], names=["chunk", "data"])

    sent = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy_cogroup(candidates), "part int, chunk long, data binary")
    return sent.repartition(ranges, "part").mapInArrow(tidy(group), "chunk long, data binary")


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + size, n), -1)
    return np.cumsum(edges[:n]) > 0


def without(text: bytes, gone: np.ndarray) -> bytes:
    """A text without some of its words and the white space behind them; all else is as it was."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for first, after in zip(edges[::2], edges[1::2]):
        out.append(text[at : spans[first][0]])
        at = spans[after][0] if after < len(spans) else len(text)
    out.append(text[at:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, size: int = WINDOW, *, carry: tuple[str, ...] = (), keep_text: bool = True, chunk: int | None = None, ranges: int | None = None) -> DataFrame:
    """Removes every word that a repeated window covers.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), the columns in ``carry`` and, with ``keep_text``, ``kept``: the text
    without the removed words, its other words and their white space as they were.
    ``chunk`` (text bytes) and ``ranges`` (a power of two) follow from the input's size.
    """
    spark = docs.sparkSession
    ship(spark)
    fields = [f"carry_{i}" for i in range(len(carry))]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(h) for c, h in zip(carry, fields)])
    total = text_size(read)
    ranges = ranges or hash_ranges(total, PART_BYTES)
    bits = max(LEAST_BITS, (total // BYTES_A_CELL // ranges).bit_length())
    held, held_at = written(chunks(read, chunk or chunk_bytes(total, CHUNK_BYTES)), "substring-chunks")
    answers, answers_at = written(sketched(held, size, ranges, bits), "substring-sketch")
    marks, _ = written(repeated_windows(held, answers, size, ranges, bits), "substring-marks")
    discard(spark, answers_at)
    kinds = [read.schema[h].dataType.simpleString() for h in fields]
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text + "".join(f", `{c}` {kind}" for c, kind in zip(carry, kinds))

    def remove(chunk: pa.Table, marked: pa.Table) -> pa.Table:
        rows = thawed(chunk.column("data")[0].as_py())
        doc, place = (np.concatenate(x) for x in zip((np.empty(0, np.uint32),) * 2, *(unpack(d) for d in marked.column("data").to_pylist())))
        order = np.argsort(doc, kind="stable")
        doc, place = doc[order], place[order].astype(np.int64)
        edges = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        n_words, n_removed, digest, kept = [], [], [], []
        for i, text in enumerate(t for c in rows.column("text").chunks for t in text_bytes(c)):
            words = text.split()
            n_words.append(len(words))
            n_removed.append(0)
            if edges[i + 1] > edges[i]:
                gone = covered(place[edges[i] : edges[i + 1]], len(words), size)
                n_removed[-1] = int(gone.sum())
                words = [words[j] for j in np.flatnonzero(~gone)]
                text = without(text, gone) if keep_text else text
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            if keep_text:
                kept.append(text.decode("utf-8"))
        columns = {"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if keep_text:
            columns["kept"] = pa.array(kept, pa.string())
        return pa.table({**columns, **{c: rows.column(h) for c, h in zip(carry, fields)}})

    return held.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(tidy_cogroup(remove), ddl)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated windows of 35 words take from each document."""
    return remove_repeats(documents(spark, sf_dir), keep_text=False)


QUERIES = {"op7_substrings": op7_substrings}
ORACLE_SQL = {
    "op7_substrings": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35
), h AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM s
), again AS (
  SELECT k FROM h GROUP BY k HAVING count(*) > 1
), c AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM h SEMI JOIN again USING (k)
), cut AS (
  SELECT r, list(j) AS js FROM c GROUP BY r
), kept AS (
  SELECT doc_id, w, coalesce(js, []) AS js FROM d LEFT JOIN cut USING (r)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(js) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN len(js) = 0 THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(js, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM kept
"""
}
