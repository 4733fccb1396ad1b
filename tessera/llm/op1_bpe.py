"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can
never be joined by a merge, so it marks a certain cut.  Each piece that the
pre-tokeniser yields is cut at all such pairs; the fragments are encoded
independently by the vocabulary's merges and their ids concatenated.  Fragments
repeat far more often than whole pieces, and a very long piece costs no more
than its fragments do.

Defined results: a null text is the empty text, which has no ids; special
tokens written out in a text become their single id; ids outside the vocabulary
raise on decoding, ids that don't form UTF-8 decode with replacement characters;
repeated rows and extra columns are kept row by row, and an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import claim, documents, ship, tidy

#: The published split pattern of byte-level BPE vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that only later versions of Unicode know than the library's 16.0, as first and last code point.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Pieces and fragments a worker remembers; each cache starts afresh when full.
CACHE = 200_000
#: Longer pieces are not worth remembering.
LONGEST_CACHED = 64
#: The rank of a pair that no merge joins.
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary, by its rule: printable Latin-1 stands for itself, the rest is numbered from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


def _checked(spec: dict) -> bool:
    """Whether a space goes before a text; settings of the file that this encoder doesn't follow are refused."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if wrong or spec.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex", True):
        raise ValueError(f"not a plain byte-level vocabulary: {wrong or 'normalizer or pre-tokenizer'}")
    return bool(before.get("add_prefix_space"))


class ForcedBoundaryBpe:
    """Encoder and decoder of one byte-level BPE vocabulary (the JSON text of a tokenizers file)."""

    def __init__(self, spec: str):
        read = json.loads(spec)
        self.prefix_space = _checked(read)
        model, letters = read["model"], byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = model["vocab"]
        self.token = {i: to_bytes(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.token.update({i: t.encode() for t, i in self.special.items()})
        self.byte_id = [0] * 256
        for i, t in self.token.items():
            if len(t) == 1:
                self.byte_id[t[0]] = i
        self.rank, self.new_of = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.new_of.append(vocab[a + b])
        self.joinable = {p for t in vocab if len(t) > 1 for b in [to_bytes(t)] for p in zip(b, b[1:])}
        later = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
        self.first_later = chr(LATER[0][0])
        self.pieces, self.later = regex.compile(PIECES), regex.compile(f"[{later}]")
        # The same pattern for texts with such characters, which are neither letters nor numbers to the library.
        self.pieces_later = regex.compile(PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{later}]]").replace(r"?\p{L}+", rf"?[\p{{L}}--[{later}]]+").replace(r"?\p{N}+", rf"?[\p{{N}}--[{later}]]+"), regex.V1)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = [str(i) for i in range(max(self.token) + 1)]
        self.bytes_of = [self.token.get(i) for i in range(len(self.names))]
        self.by_fragment: dict[bytes, tuple[int, ...]] = {}
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = outer.encode_piece(piece.encode("utf-8"))
                if len(piece) <= LONGEST_CACHED:
                    if len(self) >= CACHE:
                        self.clear()
                    self[piece] = ids
                return ids

        self.by_piece = Pieces()

    def fragments(self, piece: bytes) -> list[bytes]:
        """Cuts a piece wherever two neighbouring bytes are inside no token."""
        joinable, out, start = self.joinable, [], 0
        if joinable.issuperset(zip(piece, piece[1:])):
            return [piece]
        for at, pair in enumerate(zip(piece, piece[1:]), 1):
            if pair not in joinable:
                out.append(piece[start:at])
                start = at
        out.append(piece[start:])
        return out

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        ids: list[int] = []
        for fragment in self.fragments(piece):
            got = self.by_fragment.get(fragment)
            if got is None:
                got = self.encode_fragment(fragment)
                if len(fragment) <= LONGEST_CACHED:
                    if len(self.by_fragment) >= CACHE:
                        self.by_fragment.clear()
                    self.by_fragment[fragment] = got
            ids.extend(got)
        return tuple(ids)

    def encode_fragment(self, fragment: bytes) -> tuple[int, ...]:
        ids = [self.byte_id[b] for b in fragment]
        if len(ids) > 48:
            return self._encode_long(ids)
        rank, new_of = self.rank.get, self.new_of
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            ids[i] = new_of[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NEVER)
        return tuple(ids)

    def _encode_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same merges by a queue over linked neighbours, for fragments without cuts."""
        n, rank, new_of = len(ids), self.rank.get, self.new_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, p) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank(p[0] << 20 | p[1], NEVER)) != NEVER]
        heapq.heapify(queue)
        while queue:
            least, i, pair = heapq.heappop(queue)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = new_of[least], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank(ids[left] << 20 | ids[right], NEVER)) != NEVER:
                    heapq.heappush(queue, (r, left, (ids[left], ids[right])))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; special tokens written out in it count as such."""
        later = not text.isascii() and max(text) >= self.first_later and self.later.search(text)
        pattern = self.pieces_later if later else self.pieces
        ids: list[int] = []
        for part in self.splits.split(text) if self.splits is not None and any(s in text for s in self.special) else (text,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                part = " " + part if self.prefix_space and part[0] != " " else part
                ids.extend(chain.from_iterable(map(self.by_piece.__getitem__, pattern.findall(part))))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[int, ForcedBoundaryBpe] = {}


def _loaded(spec: str) -> ForcedBoundaryBpe:
    """One encoder for each vocabulary and worker, so that its caches outlive a task."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED[key] = ForcedBoundaryBpe(spec)
    return _LOADED[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, *, keep_ids: bool = True, keep_text: bool = True, slice_rows: int = 64) -> DataFrame:
    """Encodes and decodes every whole ``text`` of ``docs``.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256; with ``keep_ids``
    also the ids (array<int>), with ``keep_text`` the decoded text.  The
    vocabulary file has a fixed size and is read once, on the driver.
    """
    ship(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [pa.field("ids", pa.list_(pa.int32()))] * keep_ids + [pa.field("decoded", pa.string())] * keep_text
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _LOADED.clear)
        bpe = _loaded(spec.value)
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(start, slice_rows)
                columns: list[list] = [[] for _ in out]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = bpe.encode(text or "")
                    decoded = bpe.decode(ids)
                    names = bpe.names
                    row = [doc_id, len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()]
                    for column, value in zip(columns, row + [ids] * keep_ids + [decoded] * keep_text):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(tidy(run), ddl)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of all documents, as digests."""
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False, keep_text=False)


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}
