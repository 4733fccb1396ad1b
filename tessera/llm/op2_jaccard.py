"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct word shingles.  All sets are
ordered alike, by estimated document frequency, then by hash; two sets of
similarity t share at least l tokens among the first n - ceil(t * n) + l of each,
for any l up to their overlap.  Each document picks l by its estimated cost: the
frequencies of its prefix tokens (entries to scan), plus the candidates left when
l tokens must match, each of which costs a verification.  A pair must share as
many prefix tokens as the smaller l of the two, so each needs a prefix for its own l
only.  Once both sizes are known, the
overlap o they need is too, and the first n - o + l tokens of each have to share l.

Equal sets are one set from the start.  Tokens that several sets share are grouped
by hash range.  First each token's sets meet one of them, the same for most tokens
of a group of copies, so a group of near copies falls together after one
comparison for each member.  Then all pairs that share enough prefix tokens and are
not yet in one class are verified; a link within a class can't change the classes.
Nothing is capped.

Frequencies are counted over all documents, within chunks; the ``MOST_FREQUENT``
tokens with the highest sums are broadcast.  They affect the order and so the
cost, never the result.

Defined results: a text without words (or null) has the empty set, links with
nothing and is its own class; with fewer words than a shingle, the whole sequence
is the one shingle; rows with one id are documents of that id each; a row with a
null id is linked with nothing and has a null class; a very long text is one set; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import by_part, chunked, pack, runs, unpack
from .shared import chunk_bytes, discard, documents, hash_ranges, hashed_words, hot_keys, mixed, ship, spread_join, text_size, tidy, written

#: Words of a shingle; similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Words of a chunk, at least, and the bytes that a word is taken to have; text bytes for each hash range.
CHUNK, WORD_BYTES, PART_BYTES = 250_000, 6, 16_000_000
#: Sets with one token that are joined in one task.
TOGETHER = 2000
#: Tokens whose frequency is broadcast (12 bytes each), and the least count in a chunk that is reported.
MOST_FREQUENT, LEAST_COUNT = 1 << 18, 2
#: The largest l; the costs of verifying a candidate and of one more prefix entry, in scanned entries.
MOST_MATCHES, VERIFY_COST, ENTRY_COST = 6, 50.0, 8.0
#: How many more sets have a token, as far as is known, that no chunk has twice.
UNSEEN = 0.05
#: Bits of the filter that selects the sets to store for verification.
FILTER_BITS = 27

_EMPTY = np.empty(0, np.uint64)


def shingle_sets(words: list[list[bytes]], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text, the sorted hashes of the distinct shingles of its words."""
    lengths = np.array([len(w) for w in words], np.int64)
    w = hashed_words([x for doc in words for x in doc])
    n = len(w)
    if not n:
        return [_EMPTY] * len(words)
    whole = np.zeros(n, np.uint64)
    for i in range(min(size, n)):
        whole[: n - i] = mixed(whole[: n - i] ^ w[i:]) + np.uint64(i + 1)
    out = []
    for end, k in zip(np.cumsum(lengths), lengths):
        if k >= size:
            out.append(np.unique(whole[end - k : end - size + 1]))
        elif k:
            h = np.zeros(1, np.uint64)
            for i in range(k):
                h = mixed(h ^ w[end - k + i]) + np.uint64(i + 1)
            out.append(mixed(h + np.uint64(k)))
        else:
            out.append(_EMPTY)
    return out


def set_id(tokens: np.ndarray) -> int:
    """The id of a set: a signed hash of its tokens."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _sets(batches, chunk: int = CHUNK) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Chunks of keys and sets."""
    for keys, words in chunked(batches, chunk, lower=True):
        yield keys, shingle_sets(words)


def survey(docs: DataFrame) -> DataFrame:
    """One pass: (key, sid, n) of each document and (token, count) of what is frequent in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _sets(batches):
            ids = [set_id(s) if len(s) and k is not None else None for k, s in zip(keys, sets)]
            distinct = {i: s for i, s in zip(ids, sets) if i is not None}
            starts_counts = runs(every := np.sort(np.concatenate([_EMPTY, *distinct.values()])))
            often = starts_counts[1] >= LEAST_COUNT
            tokens, counts = every[starts_counts[0][often]].view(np.int64), starts_counts[1][often]
            none, n, m = [None], len(keys), len(tokens)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys + none * m, pa.int64()), pa.array(ids + none * m, pa.int64()), pa.array([len(s) for s in sets] + none * m, pa.int64()),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(tokens)]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(counts.astype(np.int64))]),
            ], names=["key", "sid", "n", "token", "count"])

    return docs.mapInArrow(tidy(run), "key long, sid long, n long, token long, count long")


def prefix(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set, in order, for the chosen l, and l."""
    n = len(tokens)
    least = -(-n * percent // 100)
    estimate = np.full(n, 1 + UNSEEN)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        estimate = np.where(frequent[at] == tokens, counts[at], estimate)
    order = np.lexsort((tokens, estimate))
    longest = min(MOST_MATCHES, least)
    order = order[: min(n, n - least + longest)]
    # What a partner of the same size costs: the first n - o + l tokens, o being the overlap that the two need.
    behind = n - -(-2 * n * percent // (100 + percent))
    scanned = np.cumsum(estimate[order] - 1)[behind : behind + longest]
    matches = np.arange(1, len(scanned) + 1)
    cost = scanned + VERIFY_COST * scanned / matches + ENTRY_COST * matches
    chosen = int(np.argmin(cost)) + 1
    return tokens[order[: n - least + chosen]], chosen


def prefix_entries(docs: DataFrame, frequent: DataFrame, parts: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """(token, sid, n, place, matches, splits) of each prefix token that two distinct sets have.

    ``splits`` says into how many parts the token's sets are to be spread in joins.
    """
    top = frequent.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    held = docs.sparkSession.sparkContext.broadcast((tokens[order], top["count"].to_numpy(np.int64)[order]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = held.value
        for _, sets in _sets(batches, chunk):
            distinct = {set_id(s): s for s in sets if len(s)}
            if not distinct:
                continue
            found = [prefix(s, frequent, counts, percent) for s in distinct.values()]
            lengths = [len(t) for t, _ in found]
            token = np.concatenate([t for t, _ in found])
            place = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
            owner = np.repeat(np.arange(len(found), dtype=np.uint32), lengths)
            sids, sizes, chosen = np.array(list(distinct), np.int64), np.array([len(s) for s in distinct.values()], np.int64), np.array([m for _, m in found], np.uint8)
            for part, at in by_part((token % np.uint64(parts)).astype(np.int64), parts):
                # Only the documents that have tokens in this part go along.
                own, places = np.unique(owner[at], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(sids[own], sizes[own].astype(np.uint32), chosen[own], token[at], places.astype(np.uint32), place[at])], pa.binary())], names=["part", "entries"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                sids, sizes, chosen, token, owner, place = unpack(data.as_py())
                by.setdefault(part, []).append([token, sids[owner], sizes[owner], place, chosen[owner]])
        for part in list(by):
            token, sid, size, place, chosen = (np.concatenate(x) for x in zip(*by.pop(part)))
            order = np.lexsort((sid, token))
            token, sid = token[order], sid[order]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])])
            order, token, sid = order[new], token[new], sid[new]
            _, lengths = runs(token)
            kept = np.repeat(lengths > 1, lengths)
            order, token, sid = order[kept], token[kept], sid[kept]
            lengths = lengths[lengths > 1]
            splits = np.repeat(-(-lengths // TOGETHER), lengths).astype(np.int32)
            for start in range(0, len(order), 100_000):
                cut = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(token[cut].view(np.int64)), pa.array(sid[cut]), pa.array(size[order[cut]].astype(np.int32)), pa.array(place[order[cut]].astype(np.int32)), pa.array(chosen[order[cut]].astype(np.int32)), pa.array(splits[cut])], names=["token", "sid", "n", "place", "matches", "splits"])

    rows = docs.mapInArrow(tidy(emit), "part int, entries binary").repartition(parts, "part")
    return rows.mapInArrow(tidy(shared), "token long, sid long, n int, place int, matches int, splits int")


def bit_filter(ids: DataFrame, bits: int = FILTER_BITS, ranges: int = 64) -> bytes:
    """A bitmap of fixed size in which the bit of each id's hash is set."""
    width = (1 << bits) // ranges

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mixed(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            for part, own in by_part(at // width, ranges):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack((at[own] % width).astype(np.uint32))], pa.binary())], names=["part", "at"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(part, np.zeros(width, np.uint8))[unpack(data.as_py())[0]] = 1
        for part, on in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(on).tobytes()], pa.binary())], names=["part", "bits"])

    whole = bytearray((1 << bits) // 8)
    made = ids.mapInArrow(tidy(parts), "part int, at binary").repartition(ranges // 4, "part").mapInArrow(tidy(merge), "part int, bits binary")
    for r in made.collect():
        whole[r["part"] * width // 8 : (r["part"] + 1) * width // 8] = r["bits"]
    return bytes(whole)


def stored_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(sid, tokens) of the documents with the given keys, and of the few others that their filter lets through.

    Only these are split and hashed again.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(bit_filter(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bitmap.value, np.uint8)

        def chosen(batches):
            for batch in batches:
                at = mixed(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
                on = (wanted[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
                yield batch.filter(pa.array(on.astype(bool)))

        for _, sets in _sets(chosen(batches)):
            distinct = list({set_id(s): s for s in sets if len(s)}.items())
            for start in range(0, len(distinct), 200):
                some = distinct[start : start + 200]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([s.view(np.int64) for _, s in some], pa.list_(pa.int64()))], names=["sid", "tokens"])

    return docs.mapInArrow(tidy(run), "sid long, tokens array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("tokens").alias(f"{x}_tokens"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(sid, label) of each end of an edge: the least id reachable, by hash-min with pointer jumping.

    Each step is written to the shared folder, so an executor that is lost costs
    the step in hand only.
    """
    spark = edges.sparkSession
    both, at = written(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("sid", "to"), f"{name}-edges")
    hot = hot_keys(both, "to")
    labels, old = written(both.groupBy("sid").agg(F.least(F.min("to"), F.first("sid")).alias("label")), f"{name}-labels")
    while True:
        near = spread_join(both, labels.withColumnRenamed("sid", "to"), "to", hot=hot).select("sid", "label")
        least, least_at = written(near.union(labels).groupBy("sid").agg(F.min("label").alias("label")), f"{name}-least")
        jump = labels.where("sid <> label").select(F.col("sid").alias("label"), F.col("label").alias("further"))
        moved = spread_join(least, jump, "label", "left").select("sid", F.least("label", F.coalesce("further", "label")).alias("label"))
        new, path = written(moved, f"{name}-labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "sid").where("label <> was").limit(1).count()
        discard(spark, old, least_at)
        labels, old = new, path
        if not changed:
            discard(spark, at)
            return labels


def _salted(entries: DataFrame) -> DataFrame:
    """Spreads each token's sets over its parts."""
    return entries.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("splits")).cast("int"))


def _copied(rows: DataFrame, splits: str = "splits") -> DataFrame:
    """Rows that are to meet all of a token's sets go to each of its parts."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col(splits) - 1)))


def _overlap(percent: int, n: str, m: str):
    """The least overlap of two sets that are similar: t / (1 + t) of both sizes."""
    return F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent))


def _least(percent: int, n: str):
    return F.ceil(F.col(n) * percent / 100)


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    ship(spark)
    doc_id = F.col("doc_id").cast("long")
    read = docs.select(doc_id.alias("key"), "text")
    named = read.where("key IS NOT NULL")
    total = text_size(docs)
    found, found_at = written(survey(read), "jaccard-survey")
    members = found.where("token IS NULL").select("key", "sid", "n")
    frequent = found.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count"))
    first_key, first_at = written(members.where("sid IS NOT NULL").groupBy("sid").agg(F.min("key").alias("key")), "jaccard-first")
    made = prefix_entries(named, frequent, hash_ranges(total, PART_BYTES), percent, chunk_bytes(total, CHUNK * WORD_BYTES) // WORD_BYTES)
    entries, entries_at = written(made, "jaccard-entries")
    close = lambda n, m: (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)

    def links(pairs: DataFrame) -> tuple[DataFrame, str]:
        """The similar ones among candidate pairs (a, b)."""
        pairs, pairs_at = written(pairs, "jaccard-pairs")
        ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        sets, sets_at = written(stored_sets(named, ends.join(first_key, "sid").select("key")), "jaccard-sets")
        made, at = written(verified(pairs, sets, percent), "jaccard-links")
        discard(spark, pairs_at, sets_at)
        return made, at

    # Each token's sets against the one that shares most of its prefix with others.  In a group of copies it is the
    # same for most tokens, the one with the fewest changes.  Shared tokens are only those with this pivot, so a pair
    # may be missed here; what is not among them has to fit behind one of the two prefixes.
    central = entries.groupBy("sid").agg((-F.count(F.lit(1))).alias("rank"))
    ranked = F.struct("rank", F.xxhash64("sid").alias("tie"), *[F.col(c).alias(f"p_{c}") for c in ("sid", "n", "place", "matches")])
    pivot = entries.join(central, "sid").groupBy("token").agg(F.min(ranked).alias("p"), F.first("splits").alias("p_splits"))
    pivot = _copied(pivot.select("token", "p_splits", *[f"p.p_{c}" for c in ("sid", "n", "place", "matches")]), "p_splits")
    both = F.least("matches", "p_matches")
    inside = lambda place, n: F.col(place) < F.col(n) - _least(percent, n) + both
    near = _salted(entries).join(pivot, ["token", "part"]).where((F.col("sid") != F.col("p_sid")) & close("n", "p_n") & inside("place", "n") & inside("p_place", "p_n"))
    needed = F.greatest(both, _overlap(percent, "n", "p_n") - F.greatest(_least(percent, "n"), _least(percent, "p_n")) + both)
    near = near.groupBy(F.least("sid", "p_sid").alias("a"), F.greatest("sid", "p_sid").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first(needed).alias("needed"))
    edges, edges_at = links(near.where("shared >= needed").select("a", "b"))
    labels = components(edges, "jaccard")
    # All pairs that are still apart.  Knowing both sizes, the prefixes that have to share so many tokens are shorter.
    own = entries.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    split = own.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.first("splits").alias("s")).where("least <> most")
    open_, open_at = written(_salted(own).join(_copied(split, "s").select("token", "part"), ["token", "part"]), "jaccard-open")
    side = lambda df, x: df.select("token", "part", *[F.col(c).alias(f"{x}_{c}") for c in ("sid", "n", "place", "matches", "label")])
    a, b = side(open_, "a"), side(_copied(open_), "b")
    both = F.least("a_matches", "b_matches")
    inside = lambda x: F.col(f"{x}_place") < F.col(f"{x}_n") - _overlap(percent, "a_n", "b_n") + both
    pairs = a.join(b, ["token", "part"]).where((F.col("a_sid") < F.col("b_sid")) & (F.col("a_label") != F.col("b_label")) & close("a_n", "b_n") & inside("a") & inside("b"))
    pairs = pairs.groupBy(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first(both).alias("needed"))
    more, more_at = links(pairs.where("shared >= needed").select("a", "b"))
    labels = components(edges.union(more), "jaccard")
    firsts, firsts_at = written(first_key.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "jaccard-labels")
    discard(spark, entries_at, open_at, edges_at, more_at, first_at)
    least = firsts.groupBy("label").agg(F.min("key").alias("component_id"))
    of_set, _ = written(spread_join(firsts, least, "label").select("sid", "component_id"), "jaccard-classes")
    linked, _ = written(spread_join(members.where("sid IS NOT NULL"), of_set, "sid").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id"), "jaccard-linked")
    alone, _ = written(members.where("sid IS NULL").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("key").alias("component_id")), "jaccard-alone")
    discard(spark, found_at, firsts_at)
    return linked.unionByName(alone)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document under links of similarity 0.75 or more."""
    return classes(documents(spark, sf_dir))


QUERIES = {"op2_jaccard": op2_jaccard}
ORACLE_SQL = {
    "op2_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM d
), t AS (
  SELECT r, doc_id, len(g) AS n, unnest(g) AS k FROM s
), p AS (
  SELECT a.r AS a, b.r AS b FROM t a JOIN t b ON a.k = b.k AND a.r < b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), c AS (
  SELECT r, r AS root FROM s
  UNION
  SELECT e.b, c.root FROM c JOIN e ON e.a = c.r
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(q.doc_id) AS component_id
FROM s JOIN c ON c.r = s.r JOIN s q ON q.r = c.root
GROUP BY s.r, s.doc_id, len(s.g)
"""
}
