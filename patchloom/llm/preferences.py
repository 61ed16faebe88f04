"""Operator 3, preference formatting, with DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as the prompt; what follows in each
is its completion, rendered with a mask: runs of (start, end, train) in characters that cover the completion without gaps, where
only what the assistant says, with its end mark, is trained.

Pairs come from a table of scored answers to the same opening: conversations with an equal first turn are one group, its best
conversation is the chosen one of all others in it. That is one pair for each other conversation, never all pairs of a group.
The best has most turns, then the longest text, then the smallest conv_id. It is found by an aggregate that is added up before the shuffle,
and brought back by a join of which Spark can split the hot side. A conversation with an opening of its own has no rejected one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import keep, load

OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, turns array<struct<turn, role, text>>) in order of turn, then role, then text.

    A null role or text becomes an empty one; rows with a null conv_id belong to no conversation and are left out, and a null turn
    comes before all others. Repeated rows of a conversation are one turn.
    """
    known = turns.where(F.col("conv_id").isNotNull())
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return known.groupBy("conv_id").agg(F.sort_array(F.collect_set(one)).alias("turns"))


def same_turn(a: Column, b: Column) -> Column:
    return (a["role"] == b["role"]) & (a["text"] == b["text"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two conversations begin with alike; roles and texts count, turn numbers don't."""
    n = F.least(F.size(a), F.size(b))
    alike = F.transform(F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b")), lambda t: same_turn(t["a"], t["b"]))
    first = F.array_position(alike, F.lit(False))
    return F.when(first == 0, n).otherwise((first - 1).cast("int"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(f"{CLOSE}\n"))


def segments(turns: Column) -> Column:
    """Pieces of a rendered completion: array<struct<text, train>>; the head of a turn and other roles aren't trained."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.concat(F.lit(OPEN), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("train")),
        F.struct(F.concat(t["text"], F.lit(CLOSE)).alias("text"), (t["role"] == TRAINED).alias("train")),
        F.struct(F.lit("\n").alias("text"), F.lit(False).alias("train")),
    )))


#: Lengths that are added up one by one; sums of so many are added up by themselves.
TOGETHER = 256


def ends(lengths: Column) -> Column:
    """Running sums of an array of int, in blocks: what a step copies is a block's sums or the sums of all blocks, never all sums before it."""
    none = F.array().cast("array<int>")

    def added(x: Column) -> Column:
        return F.aggregate(x, none, lambda s, v: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + v))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / TOGETHER).cast("int")), lambda b: added(F.slice(x, b * TOGETHER + 1, F.lit(TOGETHER))))

    def shifted(t: Column) -> Column:
        return F.flatten(F.transform(t["blocks"], lambda block, k: F.transform(block, lambda v: v + F.when(k > 0, F.element_at(t["before"], k)).otherwise(0))))

    # A variable of a lambda is worked out once, so lengths, blocks and their sums are bound to one.
    bound = F.transform(F.transform(F.array(lengths), blocks), lambda x: F.struct(x.alias("blocks"), added(F.transform(x, lambda block: F.element_at(block, -1))).alias("before")))
    return F.when(F.size(lengths) == 0, none).otherwise(F.transform(bound, shifted)[0])


def mask(pieces: Column) -> Column:
    """array<struct<start, end, train>> over the joined pieces, in time that grows with their number."""
    sums = ends(F.transform(pieces, lambda p: F.length(p["text"])))
    trains = F.transform(pieces, lambda p: F.struct(F.length(p["text"]).alias("n"), p["train"].alias("train")))
    return F.transform(F.arrays_zip(trains.alias("p"), sums.alias("end")), lambda x: F.struct((x["end"] - x["p"]["n"]).alias("start"), x["end"].alias("end"), x["p"]["train"].alias("train")))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(chosen, rejected: arrays of turns, and any other columns) to the other columns with prompt, prompt_turns, and for each side its completion and mask.

    Equal conversations, or one that the other begins with, give an empty completion; empty ones give an empty prompt. Nothing is dropped.
    """
    rest = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    chosen, rejected = F.col("chosen"), F.col("rejected")
    out = pairs.withColumn("prompt_turns", common_prefix(chosen, rejected))
    shared = F.slice(chosen, F.lit(1), F.col("prompt_turns"))
    out = out.withColumn("prompt", F.array_join(F.transform(shared, rendered), ""))
    for side in ("chosen", "rejected"):
        out = out.withColumn(f"{side}_pieces", segments(F.slice(F.col(side), F.col("prompt_turns") + 1, F.size(side))))
        out = out.withColumn(f"{side}_completion", F.array_join(F.transform(f"{side}_pieces", lambda p: p["text"]), "")).withColumn(f"{side}_mask", mask(F.col(f"{side}_pieces")))
    return out.select(*rest, "prompt_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask")


def paired(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected): each conversation but the best of its group as the rejected one.

    A conversation that shares its first turn with no other is a chosen one without a rejected one: null id, no turns.
    """
    rows = conversations(turns)
    opening = F.sha2(F.to_json(F.struct(F.col("turns")[0]["role"].alias("role"), F.col("turns")[0]["text"].alias("text"))), 256)
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.length(t["text"]))
    rows = keep(rows.select("conv_id", "turns", opening.alias("opening"), F.struct(F.size("turns").alias("n"), size.alias("chars"), (-F.col("conv_id")).alias("id")).alias("order")), "conversations")
    best = rows.groupBy("opening").agg(F.max("order").alias("best"), F.count("*").alias("members"))
    best = keep(best.select("opening", (-F.col("best.id")).alias("chosen_id"), "members"), "best")
    # The chosen conversation's turns are fetched by its id, so the grouping above moves no texts.
    mine = rows.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    chosen = best.where("members > 1").join(mine, "chosen_id")
    others = rows.select("opening", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    both = others.join(chosen, "opening").where("chosen_id <> rejected_id").select("chosen_id", "rejected_id", "chosen", "rejected")
    alone = mine.join(best.where("members = 1").select("chosen_id"), "chosen_id", "left_semi")
    none = F.slice("chosen", F.lit(1), F.lit(0))
    return both.unionByName(alone.select("chosen_id", F.lit(None).cast(rows.schema["conv_id"].dataType).alias("rejected_id"), "chosen", none.alias("rejected")))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations, formatted; masks as text, start:end for each trained run."""
    out = format_pairs(paired(load(spark, sf_dir, "conversations")))

    def trained(side: str) -> Column:
        runs = F.filter(f"{side}_mask", lambda m: m["train"])
        return F.array_join(F.transform(runs, lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))), ",").alias(f"{side}_trained")

    return out.select("chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen_completion", trained("chosen"), "rejected_completion", trained("rejected"))


OP3_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM turns
), convs AS (
  SELECT conv_id, count(*) AS n, sum(length(text)) AS chars, max(CASE WHEN k = 1 THEN role || chr(10) || text END) AS opening FROM numbered GROUP BY conv_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY opening ORDER BY n DESC, chars DESC, conv_id) AS r, first_value(conv_id) OVER (PARTITION BY opening ORDER BY n DESC, chars DESC, conv_id) AS chosen_id FROM convs
), pairs AS (
  SELECT chosen_id, conv_id AS rejected_id FROM ranked WHERE r > 1
  UNION ALL SELECT min(chosen_id), NULL FROM ranked GROUP BY opening HAVING count(*) = 1
), prefix AS (
  SELECT p.chosen_id, p.rejected_id, least(min(CASE WHEN c.role = j.role AND c.text = j.text THEN NULL ELSE c.k END), max(CASE WHEN j.k IS NOT NULL THEN c.k END) + 1) - 1 AS prompt_turns
  FROM pairs p JOIN numbered c ON c.conv_id = p.chosen_id LEFT JOIN numbered j ON j.conv_id = p.rejected_id AND j.k = c.k GROUP BY 1, 2
), parts AS (
  SELECT x.chosen_id, x.rejected_id, x.prompt_turns, s.side, t.k, t.role, t.text,
    '<|im_start|>' || t.role || chr(10) AS head, t.text || '<|im_end|>' AS body
  FROM prefix x CROSS JOIN (VALUES ('chosen'), ('rejected')) s(side) JOIN numbered t ON t.conv_id = CASE WHEN s.side = 'chosen' THEN x.chosen_id ELSE x.rejected_id END
), placed AS (
  SELECT *, coalesce(sum(CASE WHEN k > prompt_turns THEN length(head) + length(body) + 1 ELSE 0 END) OVER (PARTITION BY chosen_id, rejected_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins FROM parts
)
SELECT chosen_id, rejected_id, CAST(prompt_turns AS BIGINT) AS prompt_turns,
  coalesce(string_agg(CASE WHEN side = 'chosen' AND k <= prompt_turns THEN head || body || chr(10) END, '' ORDER BY k), '') AS prompt,
  coalesce(string_agg(CASE WHEN side = 'chosen' AND k > prompt_turns THEN head || body || chr(10) END, '' ORDER BY k), '') AS chosen_completion,
  coalesce(string_agg(CASE WHEN side = 'chosen' AND k > prompt_turns AND role = 'assistant' THEN CAST(begins AS BIGINT) || ':' || CAST(begins + length(body) AS BIGINT) END, ',' ORDER BY k), '') AS chosen_trained,
  coalesce(string_agg(CASE WHEN side = 'rejected' AND k > prompt_turns THEN head || body || chr(10) END, '' ORDER BY k), '') AS rejected_completion,
  coalesce(string_agg(CASE WHEN side = 'rejected' AND k > prompt_turns AND role = 'assistant' THEN CAST(begins AS BIGINT) || ':' || CAST(begins + length(body) AS BIGINT) END, ',' ORDER BY k), '') AS rejected_trained
FROM placed GROUP BY chosen_id, rejected_id, prompt_turns
"""
