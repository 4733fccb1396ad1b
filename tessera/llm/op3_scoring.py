"""Language-model scoring with a log-frequency Bloom filter.

The text is read once, in chunks.  The distinct words, word pairs and triples of a
chunk, with their counts in its training documents, go to their hash ranges.  A range
sums them, exactly, quantises the sums of pairs and triples and puts an n-gram of
level q into its segment of a Bloom filter as (n-gram, 1) to (n-gram, q); to estimate
a count, level after level is probed until one is missing.  What it finds goes back to
the chunks that asked, with the exact counts of their words, which the base score
needs.  A token w after u v is scored by the smoothed probability

    p(w | u v) = b * c(u, v, w) / C(u, v) + (1 - b) * p(w | v),   b = SHARE * C(u, v) / (C(u, v) + MU_TRIPLE)
    p(w | v) = a * c(v, w) / C(v) + (1 - a) * p(w),               a = SHARE * C(v) / (C(v) + MU_PAIR)
    p(w) = (C(w) + 1) / (N + V + 1)

A level stands for its least count in c, and for its largest one in C(u, v); words
have their exact counts.  So what the filter finds never adds up to more than 1 for a
context, but for the filter's few false hits.  An n-gram that wasn't seen falls back
to the shorter one.

The filter holds all pairs and triples: there are more ranges for a larger input, each
segment is as large as its entries need, and no worker holds more than one.

Defined results: a null text is empty and has the one end token; a row with a
null id isn't held out and isn't learnt from; with no training token the scores
are those of c = N = V = 0; repeated rows are scored each; an empty table gives an
empty result; a very long text is one chunk; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import chunked, pack, runs, unpack
from .shared import chunk_bytes, documents, hash_ranges, hashed_words, mixed, ship, tidy, written

#: Words of a chunk, at least, and the bytes that a word is taken to have; text bytes for each hash range.
CHUNK, WORD_BYTES, PART_BYTES = 500_000, 6, 16_000_000
#: Bits of the filter for each entry, and its probes for one.
ENTRY_BITS, PROBES = 7, 4
#: The largest weight of an n-gram's frequency, and the counts of its context at which the weight is half of that.
SHARE, MU_PAIR, MU_TRIPLE = 0.5, 20.0, 1.0
#: The tokens before the first word and after the last.
START, END = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
#: The least count of each level: 1, 2, 3, 4, 6, 8, 12 and so on, two levels for a doubling.
LEAST = np.array([0] + sorted({1 << k for k in range(41)} | {3 << k for k in range(40)}), np.int64)
LEVELS = len(LEAST) - 2


def tokens_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk, the hashes before them, and the document of each."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    n = int(lengths.sum())
    last = np.cumsum(lengths) - 1
    token = np.empty(n, np.uint64)
    inner = np.ones(n, bool)
    inner[last] = False
    token[inner] = hashed_words([w for doc in words for w in doc])
    token[last] = END
    before = np.concatenate([[START], token[:-1]]).astype(np.uint64) if n else token
    before[np.concatenate([[0], last[:-1] + 1])] = START
    return token, before, np.repeat(np.arange(len(words)), lengths)


def pairs_of(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(before + np.uint64(0x9E3779B97F4A7C15)) ^ token)


def triples_of(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Each token with the two before it; the first one of a text has the start twice."""
    earlier = np.where(before == START, START, np.concatenate([[START], before[:-1]]).astype(np.uint64)) if len(token) else token
    return mixed(pairs_of(pairs_of(earlier, before), token) ^ np.uint64(0xA24BAED4963EE407))


def gram_bits(tokens: int) -> int:
    """The bits of an n-gram's hash: so many that two n-grams of the text share one far more rarely than the filter errs."""
    return min(64, max(40, tokens.bit_length() + 12))


def grams_of(before: np.ndarray, token: np.ndarray, bits: int) -> np.ndarray:
    """All pairs, then all triples, as the first bits of their hashes."""
    rest = np.uint64(64 - bits)
    return np.concatenate([pairs_of(before, token), triples_of(before, token)]) >> rest << rest


def counted(values: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in order, and how often each one occurs where it is learnt from."""
    order = np.argsort(values)
    values = values[order]
    starts, _ = runs(values)
    return values[starts], np.add.reduceat(learnt[order], starts, dtype=np.uint32) if len(starts) else np.empty(0, np.uint32)


def planes(a: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones and so on; these compress better."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.ravel()


def unplaned(data: np.ndarray, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(size, -1).T).ravel().view(kind)


def rising(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes as planes of their differences."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def unrisen(data: np.ndarray) -> np.ndarray:
    return np.cumsum(unplaned(data, np.uint64), dtype=np.uint64)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The level of each count; 0 for none."""
    return np.minimum(LEVELS, np.searchsorted(LEAST, counts, side="right") - 1)


def count_at(level: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return LEAST[level]


def most_at(level: np.ndarray) -> np.ndarray:
    """The largest count of a level; 0 for level 0."""
    return np.where(level > 0, LEAST[level + 1] - 1, 0)


def smoothed(word: np.ndarray, context: np.ndarray, pair: np.ndarray, context2: np.ndarray, triple: np.ndarray) -> np.ndarray:
    """p(w | u v) from p(w), C(v), c(v, w), C(u, v) and c(u, v, w)."""
    a, b = SHARE * context / (context + MU_PAIR), SHARE * context2 / (context2 + MU_TRIPLE)
    p = a * np.minimum(pair, context) / np.maximum(context, 1) + (1 - a) * word
    return b * np.minimum(triple, context2) / np.maximum(context2, 1) + (1 - b) * p


class LogBloom:
    """The filter: segments of equal size, one for each range of hashes."""

    def __init__(self, data: np.ndarray, segments: int):
        self.data, self.segments = data, segments
        self.shift, self.bits = np.uint64(64 - (segments.bit_length() - 1)), len(data) * 8 // segments

    @staticmethod
    def places(hashes: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
        """The bits, within the segment, of (n-gram, level)."""
        h = mixed(hashes ^ np.uint64(0xD1B54A32D192ED03 * (level + 1) % (1 << 64)))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((h + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) % np.uint64(bits)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by membership probes of rising level."""
        out = np.zeros(len(hashes), np.int64)
        at = np.arange(len(hashes))
        start = (hashes >> self.shift) * np.uint64(self.bits) if self.segments > 1 else np.zeros(len(hashes), np.uint64)
        for level in range(1, LEVELS + 1):
            own, offset = hashes[at], start[at]
            on = np.ones(len(at), bool)
            for place in self.places(own, level, self.bits):
                bit = offset + place
                on &= (self.data[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at = at[on]
            if not len(at):
                break
            out[at] = level
        return out


def segment(hashes: np.ndarray, level: np.ndarray) -> LogBloom:
    """The filter over all n-grams of a range, as large as their entries need."""
    bits = int(level.sum() * ENTRY_BITS * 1.1) // 64 * 64 + 64
    on = np.zeros(bits, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        for place in LogBloom.places(hashes[level >= q], q, bits):
            on[place] = 1
    return LogBloom(np.packbits(on, bitorder="little"), 1)


def answered(rows: DataFrame, parts: int, bits: int, chunk_words: int = CHUNK) -> DataFrame:
    """What the hash ranges find for each chunk, and the chunks; ``rows`` are (row, text).

    A row with neither chunk nor data has the sums of a range.  A row with part -1 is
    a chunk: its documents, its distinct words and the word of each token.  Any other is
    a range's answer: exact counts of the chunk's words, levels of its pairs and triples.
    """
    shift, rest = np.uint64(64 - (parts.bit_length() - 1)), np.uint64(64 - bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words in chunked(batches, chunk_words, lower=True):
            token, before, doc = tokens_of(words)
            n = np.array([len(w) + 1 for w in words], np.int64)
            del words
            ids = [k["doc_id"] for k in keys]
            flags = np.array([(i is None) + 2 * k["held_out"] for i, k in zip(ids, keys)], np.uint8)
            learnt = (flags == 0).astype(np.uint8)[doc]
            (w, wn), (p, pn) = counted(token, learnt), counted(grams_of(before, token, bits), np.concatenate([learnt, learnt]))
            edges = np.arange(parts + 1)
            we, pe = (np.searchsorted((x >> shift).astype(np.int64), edges) for x in (w, p))
            chunk, at, data = keys[0]["key"], [], []
            for part in range(parts):
                ws, ps = slice(we[part], we[part + 1]), slice(pe[part], pe[part + 1])
                if ws.stop > ws.start or ps.stop > ps.start:
                    at.append(part)
                    data.append(pack(rising(w[ws]), planes(wn[ws]), rising(p[ps] >> rest), planes(pn[ps])))
            whole = pack(np.array([i or 0 for i in ids], np.int64), flags, n, rising(w), planes(np.searchsorted(w, token).astype(np.uint32)))
            to = int(mixed(np.array([chunk], np.uint64))[0] % np.uint64(parts))
            kinds = [False] * len(at) + [True]
            yield pa.RecordBatch.from_arrays([pa.array([*at, to], pa.int32()), pa.array([chunk] * len(kinds), pa.int64()), pa.array(kinds), pa.array([*data, whole], pa.binary())], names=["part", "chunk", "whole", "data"])

    def add(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, n = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(values, kind="stable")
        values = values[order]
        starts, _ = runs(values)
        return values[starts], np.add.reduceat(n[order], starts, dtype=np.int64) if len(starts) else n.astype(np.int64)

    def answers(chunks: list[int], part: int, items: list[bytes]) -> Iterator[pa.RecordBatch]:
        asked = [unpack(i) for i in items]
        w, p = [unrisen(a[0]) for a in asked], [unrisen(a[2]) << rest for a in asked]
        (words, wn), (grams, pn) = add(w, [unplaned(a[1], np.uint32) for a in asked]), add(p, [unplaned(a[3], np.uint32) for a in asked])
        del asked
        level = level_of(pn)
        found = segment(grams, level).levels(grams).astype(np.uint8)
        yield out([None], [part], [None], int(wn.sum()), int((wn > 0).sum()))
        for chunk, ws, ps in zip(chunks, w, p):
            yield out([chunk], [part], [pack(planes(wn[np.searchsorted(words, ws)]), found[np.searchsorted(grams, ps)])])

    def out(chunk: list, part: list, data: list, total: int | None = None, distinct: int | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary()), pa.array([total] * len(chunk), pa.int64()), pa.array([distinct] * len(chunk), pa.int64())], names=["chunk", "part", "data", "total", "distinct"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for part, chunk, whole, data in zip(*(c.to_pylist() for c in batch.columns)):
                if whole:
                    yield out([chunk], [-1], [data])
                    continue
                chunks, items = held.setdefault(part, ([], []))
                chunks.append(chunk)
                items.append(data)
        for part in list(held):
            chunks, items = held.pop(part)
            yield from answers(chunks, part, items)

    dealt = rows.mapInArrow(tidy(emit), "part int, chunk long, whole boolean, data binary").repartition(parts, "part")
    return dealt.mapInArrow(tidy(merge), "chunk long, part int, data binary, total long, distinct long")


def held_out(folds: int = 7):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 2, F.lit(False))


def score(docs: DataFrame) -> DataFrame:
    """Scores every whole text by a model of the documents that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    ship(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    first = read.agg(F.sum(F.octet_length("text")).alias("size"), F.count_if(~F.col("held_out") & F.col("doc_id").isNotNull()).alias("starts")).first()
    size, starts = first["size"] or 0, float(first["starts"])
    row = F.struct(F.monotonically_increasing_id().alias("key"), "doc_id", "held_out").alias("row")
    bits = gram_bits(size // WORD_BYTES)
    made = answered(read.select(row, "text"), hash_ranges(size, PART_BYTES), bits, chunk_bytes(size, CHUNK * WORD_BYTES) // WORD_BYTES)
    found, _ = written(made, "lm-answers")
    sums = found.where("chunk IS NULL").agg(F.sum("total").alias("N"), F.sum("distinct").alias("V")).first()
    total, norm = sums["N"] or 0, float((sums["N"] or 0) + (sums["V"] or 0) + 1)

    def scored(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")  # the chunk itself, then the answers in the order of their hashes
        ids, flags, n, own, where = unpack(rows.column("data")[0].as_py())
        own, where = unrisen(own), unplaned(where, np.uint32)
        got = [unpack(d.as_py()) for d in rows.column("data")[1:]]
        exact = np.concatenate([unplaned(g[0], np.int64) for g in got])
        level = np.concatenate([g[1] for g in got]).astype(np.int64)
        begin = np.zeros(len(where), bool)
        begin[np.concatenate([[0], np.cumsum(n)[:-1]])] = True
        after = lambda x: np.where(begin, starts, np.concatenate([x[:1], x[:-1]]))
        token = own[where]
        before = np.where(begin, START, np.concatenate([[START], token[:-1]]).astype(np.uint64))
        _, spots = np.unique(grams_of(before, token, bits), return_inverse=True)
        pair, triple = level[spots[: len(token)]], level[spots[len(token) :]]
        word = ((exact + 1) / norm)[where]
        p = smoothed(word, after(exact[where]), count_at(pair), after(most_at(pair)), count_at(triple))
        doc = np.repeat(np.arange(len(n)), n)
        base, score, known = (np.bincount(doc, x, len(n)) for x in (np.log10(word), np.log10(p), (exact > 0)[where]))
        return pa.table([pa.array(ids, mask=flags & 1 == 1), pa.array(flags & 2 == 2), pa.array(n), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = found.where("chunk IS NOT NULL").select("chunk", "part", "data").groupBy("chunk")
    return asked.applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(documents(spark, sf_dir))


QUERIES = {"op3_scoring": op3_scoring}
ORACLE_SQL: dict[str, str] = {}
