"""Preference formatting of chat conversations.

A pair is a chosen and a rejected conversation.  Their longest common prefix of
turns is rendered once, as the prompt; what follows is rendered as two
completions, in which only the assistant's turns bear loss.

The result has one row for each rendered turn, not one for each conversation: the
prefix ends at the least turn number at which the two differ, which is a minimum
over a join on (pair, turn).  So no conversation, however long, is gathered
anywhere.  :func:`assembled` joins the turns of each pair to whole strings where
conversations are known to be short.

All of it is DataFrame operations.

Defined results: turns are aligned by their number; several rows of one turn
number are one turn if the multisets of (role, text) are equal, and are rendered
in the order of role and text; a null role or text is the empty one; rows with a
null conversation or turn take no part; a conversation without partner has no
prompt and is rendered whole as its side's completion; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a turn is rendered.
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"
#: The role whose turns bear loss.
TRAINED = "assistant"


def rendered(role, text):
    before, rest = TEMPLATE.split("{role}")
    between, after = rest.split("{text}")
    return F.concat(F.lit(before), role, F.lit(between), text, F.lit(after))


def format_pairs(turns: DataFrame) -> DataFrame:
    """Formats pairs of conversations.

    ``turns`` has pair_id, chosen (boolean), turn, role and text.  Returns
    pair_id, part (prompt, chosen or rejected), turn, role, rendered, loss
    (whether the turn bears loss) and prompt_turns, the turn numbers in the prompt.
    """
    turns = turns.where("pair_id IS NOT NULL AND turn IS NOT NULL").select("pair_id", "chosen", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.xxhash64("role", "text")
    # Sums of two halves and an exclusive or of another hash: equal for equal multisets of rows, in any order.
    low, high = digest.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(digest, 32)
    sides = turns.groupBy("pair_id", "turn").agg(*[
        how(F.when(F.col("chosen") == which, what)).alias(f"{name}_{which}") for which in (True, False)
        for name, how, what in (("n", F.count, F.lit(1)), ("low", F.sum, low), ("high", F.sum, high), ("xor", F.bit_xor, F.xxhash64("text", "role")))
    ])
    same = F.lit(True)
    for name in ("n", "low", "high", "xor"):
        same = same & F.col(f"{name}_True").eqNullSafe(F.col(f"{name}_False"))
    sides = sides.select("pair_id", "turn", same.alias("same"))
    ends = sides.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("parts_at"), F.count(F.lit(1)).alias("numbers"))
    # The prompt's turn numbers: those before the first that differs.
    common = sides.join(ends, "pair_id").groupBy("pair_id").agg(F.first("parts_at").alias("parts_at"), F.sum((F.col("parts_at").isNull() | (F.col("turn") < F.col("parts_at"))).cast("long")).alias("prompt_turns"))
    rows = turns.join(common, "pair_id")
    shared = F.col("parts_at").isNull() | (F.col("turn") < F.col("parts_at"))
    rows = rows.where(~shared | F.col("chosen"))
    part = F.when(shared, "prompt").when(F.col("chosen"), "chosen").otherwise("rejected")
    return rows.select("pair_id", part.alias("part"), "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), (~shared & (F.col("role") == TRAINED)).alias("loss"), "prompt_turns")


def assembled(formatted: DataFrame) -> DataFrame:
    """One row for each pair: prompt, chosen and rejected as strings.  For conversations that fit in a row."""
    def joined(part):
        kept = F.collect_list(F.when(F.col("part") == part, F.struct("turn", "role", "rendered")))
        return F.array_join(F.transform(F.array_sort(kept), lambda x: x["rendered"]), "").alias(part)

    return formatted.groupBy("pair_id").agg(*[joined(p) for p in ("prompt", "chosen", "rejected")])


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations: 2k is preferred to 2k + 1."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pair = F.shiftright("conv_id", 1)
    return format_pairs(turns.select(pair.alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text"))


QUERIES = {"op6_chat": op6_chat}
ORACLE_SQL = {
    "op6_chat": r"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), s AS (
  SELECT pair_id, turn,
    coalesce(list([role, text] ORDER BY role, text) FILTER (WHERE chosen), []) = coalesce(list([role, text] ORDER BY role, text) FILTER (WHERE NOT chosen), []) AS same
  FROM t GROUP BY pair_id, turn
), e AS (
  SELECT pair_id, min(turn) FILTER (WHERE NOT same) AS parts_at FROM s GROUP BY pair_id
), c AS (
  SELECT s.pair_id, any_value(parts_at) AS parts_at, count(*) FILTER (WHERE parts_at IS NULL OR turn < parts_at) AS prompt_turns
  FROM s JOIN e ON s.pair_id = e.pair_id GROUP BY s.pair_id
)
SELECT t.pair_id, CASE WHEN parts_at IS NULL OR turn < parts_at THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part,
  turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
  NOT (parts_at IS NULL OR turn < parts_at) AND role = 'assistant' AS loss, CAST(prompt_turns AS BIGINT) AS prompt_turns
FROM t JOIN c ON t.pair_id = c.pair_id
WHERE NOT (parts_at IS NULL OR turn < parts_at) OR chosen
"""
}
