"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of whole labelled
texts.  A text is parsed greedily into the longest phrases that occur in that sample,
across its words; a text of the same language needs few, long phrases.  Phrases times
the logarithm of the sample's length estimate the text's cross entropy in bits; the
language with the fewest such normalised phrases wins.

Texts are parsed whole, as lower-case letters with one space between words, in pieces
of ``PIECE`` characters: all pieces of a batch go through the automaton's table
abreast, one character of each at a time.

Defined results: a null text and a text without any letter is ``und`` with score
0; equal entropies go to the language that sorts first by code point; rows with
null doc_id are kept and are never learnt from; an empty or unlabelled table
learns nothing, and then every text is ``und``; a very long text is many pieces;
other columns are kept, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import row_chunks
from .shared import claim, documents, ship, tidy

#: Characters of each language's text that the automaton is built over; the last text goes beyond, so twice as many at most.
SAMPLE_CHARS = 50_000
#: Characters of a piece, at whose end a phrase ends; characters of a batch of texts.
PIECE, BATCH_CHARS = 512, 1_000_000
#: Entries of a transition table at most; with a larger alphabet each text is parsed by itself.
TABLE = 1 << 24
#: Letters of a stretch of text to whose likelihood the score refers.
STRETCH = 16.0


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, lower-cased, other than letters made one space between words; where each text starts; its letters."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(low), dtype=np.int32), np.fromiter(map(len, low), np.int64, len(low)) + 1)
    letter = letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1] & ~letter[1:]
    where = np.flatnonzero(kept)
    points, doc, letter = np.where(letter[where], points[where], 0x20), doc[where], letter[where]
    # A space that nothing of its text follows goes.
    inner = letter.copy()
    inner[:-1] |= doc[1:] == doc[:-1]
    points, doc, letter = points[inner], doc[inner], letter[inner]
    return points, np.searchsorted(doc, np.arange(len(low) + 1)), np.bincount(doc[letter], minlength=len(low))


def _plain(texts: list[str]) -> list[str]:
    """The normalised texts that have a letter."""
    points, edges, _ = normalised(texts)
    return [points[a:b].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(edges, edges[1:]) if b > a]


class SuffixAutomaton:
    """All substrings of a text; states are numbers, transitions one dictionary for each."""

    def __init__(self, text: str):
        step: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.step, self.size = step, max(2, len(text))

    def phrases(self, word: str) -> int:
        """Longest matches, one after the other, until the word is used up; an unknown letter is a phrase too."""
        step, count, i, n = self.step, 0, 0, len(word)
        while i < n:
            count += 1
            state, start = 0, i
            while i < n and (to := step[state].get(word[i])) is not None:
                state = to
                i += 1
            if i == start:
                i += 1
        return count


class Table:
    """An automaton's transitions as one array, with where a phrase ends.

    An entry is the next state's row, with ``ENDS`` added where the character
    begins a new phrase, as no longer match exists.
    """

    ENDS = 1 << 30

    def __init__(self, automaton: SuffixAutomaton, text: str):
        alphabet = sorted(set(text) - {"\n"})
        states, width = len(automaton.step), len(alphabet) + 1
        self.entries = (states + 1) * width
        if self.entries > TABLE:
            return
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, width)
        of = {c: i for i, c in enumerate(alphabet, 1)}
        # The last row is that of a piece's start, and of what follows an unknown character.
        self.start = states * width
        root = np.full(width, self.start, np.int32)
        for c, to in automaton.step[0].items():
            if c in of:
                root[of[c]] = to * width
        table = np.tile(root + self.ENDS, (states + 1, 1)).astype(np.int32)
        for state, step in enumerate(automaton.step):
            for c, to in step.items():
                if c in of:
                    table[state, of[c]] = to * width
        self.table = table.ravel()

    def phrases(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The phrases of each piece; longer pieces come first."""
        classes, state = self.classes[points], np.full(len(starts), self.start, np.int32)
        count, running = np.zeros(len(starts), np.int32), np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
        for i, n in enumerate(running.tolist()):
            to = self.table[state[:n] + classes[starts[:n] + i]]
            count[:n] += to >> 30
            state[:n] = to & (self.ENDS - 1)
        return count


class CrossParser:
    """Languages and their automata, built once and sent to the workers as tables."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.automata = [SuffixAutomaton(samples[x]) for x in self.langs]
        self.bits = np.array([math.log2(a.size) for a in self.automata])
        self.tables = [Table(a, samples[x]) for a, x in zip(self.automata, self.langs)]
        for automaton, table in zip(self.automata, self.tables):
            if table.entries <= TABLE:
                automaton.step = []  # the table has it all

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of each text (row) in each language, and its letters."""
        points, edges, count = normalised(texts)
        sizes = np.diff(edges)
        pieces = -(-sizes // PIECE)
        doc = np.repeat(np.arange(len(texts)), pieces)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        starts, lengths = edges[:-1][doc] + at, np.minimum(PIECE, sizes[doc] - at)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, doc = starts[order], lengths[order], doc[order]
        out = np.zeros((len(texts), len(self.langs)))
        for i, (automaton, table) in enumerate(zip(self.automata, self.tables)):
            if table.entries <= TABLE:
                found = table.phrases(points, starts, lengths)
            else:
                found = [automaton.phrases(points[s : s + n].tobytes().decode("utf-32-le", "surrogatepass")) for s, n in zip(starts, lengths)]
            out[:, i] = np.bincount(doc, found, len(texts))
        return out, count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """For each text the language, the score and the bits a letter that the winner needs.

        The score is the winner's share of the languages' likelihoods for a stretch of
        up to ``STRETCH`` letters, fewer for a text of few letters, at these bits a letter.
        """
        if not self.langs:
            return [("und", 0.0, 0.0)] * len(texts)
        phrases, count = self.phrases(texts)
        bits = phrases * self.bits / np.maximum(count, 1)[:, None]
        best, least = bits.argmin(axis=1), bits.min(axis=1)
        stretch = STRETCH * count / (count + STRETCH)
        score = 1 / np.exp2(np.maximum(-1000, (least[:, None] - bits) * stretch[:, None])).sum(axis=1)
        return [(self.langs[b], float(s), float(x)) if n else ("und", 0.0, 0.0) for b, s, x, n in zip(best, score, least, count)]


def held_out(column="doc_id", folds: int = 4):
    """Whether a document is held out: crc32 of its id as text leaves 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 2, F.lit(False))


def learn(docs: DataFrame, *, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Samples labelled texts of each language until there are ``sample_chars`` characters of it.

    Whole texts come in the order of a hash of their id, so the sample is the same on
    every run.  Texts that are longer than the sample by themselves are left out; only
    where a language has no other, the first of them is its sample, up to that length.
    Only the texts under a hash bound computed from each language's size reach the
    driver: about three times the sample at most.
    """
    use = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    use = use.select("lang", "doc_id", "text", F.length("text").alias("n"), F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)).alias("at"))
    fits = F.col("n") <= sample_chars
    sizes = use.groupBy("lang").agg(F.sum(F.when(fits, F.col("n"))).alias("chars")).collect()
    bounds = {r["lang"]: min(1 << 30, int((1 << 30) * 2.0 * sample_chars / max(1, r["chars"])) + 1) for r in sizes if r["chars"] is not None}
    found: dict[str, list[str]] = {}
    if bounds:
        near = F.lit(False)
        for lang, bound in bounds.items():
            near = near | ((F.col("lang") == lang) & (F.col("at") < bound))
        for r in sorted(use.where(fits & near).collect(), key=lambda r: (r["at"], r["doc_id"], r["text"])):
            held = found.setdefault(r["lang"], [])
            if sum(map(len, held)) < sample_chars:
                held += _plain([r["text"]])
    long = [r["lang"] for r in sizes if r["chars"] is None]
    if long:
        first = F.min_by(F.substring("text", 1, sample_chars), F.struct("at", "doc_id"))
        found.update({r["lang"]: _plain([r["first"]]) for r in use.where(F.col("lang").isin(long)).groupBy("lang").agg(first.alias("first")).collect()})
    # No phrase goes from one text to the next.
    return {lang: "\n".join(texts) for lang, texts in found.items() if texts}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """Predicts the language of every whole text.

    Returns the columns of ``docs`` and lang_pred, score and bits_per_letter, as
    :meth:`CrossParser.predict` says.
    """
    ship(docs.sparkSession)
    # At most 4 * TABLE bytes for a language, whose number is that of the labels.
    model = docs.sparkSession.sparkContext.broadcast(CrossParser(samples))
    names = [n for n in docs.columns]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        parser = model.value
        for rows in row_chunks(batches, BATCH_CHARS):
            rows = rows.combine_chunks()
            langs, scores, bits = zip(*parser.predict(rows.column(at).to_pylist())) if rows.num_rows else ((), (), ())
            out = [*rows.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            yield from pa.table(out, names=[*names, "lang_pred", "score", "bits_per_letter"]).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, bits_per_letter double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learnt from those that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    samples = learn(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), samples)
    return found.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_langid": op4_langid}
ORACLE_SQL: dict[str, str] = {}
