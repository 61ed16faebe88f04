"""Audit of how filters interact: every order of five filters, what each step removes, and what each filter owes to its place.

A document's failures become a mask of five bits. Masks are counted once for each part of the table; all orders follow from those counts, since
what a step removes depends on the set of filters before it alone. Whole texts are compared for the duplicate filter only where they can be
equal: documents are split by length in code points, then by hashes of successive blocks, and those left alone by a split are dropped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.llm.common import keep, load
from patchloom.llm.near_copies import among

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
BREAK, SYMBOLS = r"[\x20\x09-\x0D]+", "[#$%&*|]"
#: Code points at which a text is cut into the blocks that are hashed one after the other; the last block is all the rest.
CUTS = (64, 1024)
SPLITS = ("length", *(f"block_{k}" for k in range(len(CUTS) + 1)))


def split_columns(text: Column, cuts: Sequence[int] = CUTS) -> list[Column]:
    """length and the hash of each block of a text without nulls; equal texts have equal ones."""
    edges = [0, *cuts]
    blocks = [F.substring(text, F.lit(a + 1), F.lit(b - a)) for a, b in itertools.pairwise(edges)] + [F.substring(text, F.lit(edges[-1] + 1), F.lit(0x7FFFFFFF))]
    return [F.char_length(text).alias("length"), *(F.xxhash64(b).alias(f"block_{k}") for k, b in enumerate(blocks))]


def _repeated(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows that share their values of ``by`` with another one. Both sides of the join are tables, so Spark can split the partition of a hot group."""
    twice = keep(rows.groupBy(*by).count().where("count > 1").drop("count"), "twice")
    return keep(rows.join(twice, list(by), "left_semi"), "split")


def copies(docs: DataFrame, split: DataFrame) -> DataFrame:
    """(doc_id, text) and the same rows as doc_id with ``split_columns``, to doc_id, SPLITS, first_id: documents whose text a smaller doc_id has too, and the smallest such id.

    Null texts count as empty; rows with a null doc_id are no copies and have none; a repeated row is one copy, not of itself; an id with
    several texts is judged for each. Extra columns are ignored; an empty table gives no rows.
    """
    rows = split.where("doc_id is not null").select("doc_id", *SPLITS)
    for k in range(1, len(SPLITS) + 1):
        rows = _repeated(rows, SPLITS[:k])
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = among(docs.where("doc_id is not null").select("doc_id", "text"), rows.select("doc_id")).select("doc_id", text.alias("text")).select("doc_id", "text", *split_columns(F.col("text")))
    texts = whole.groupBy(*SPLITS, "text").agg(F.min("doc_id").alias("first_id"))
    classes = keep(texts.groupBy(*SPLITS).agg(F.count("*").alias("texts"), F.min("first_id").alias("first_id")), "classes")
    found = rows.join(classes.where("texts = 1").drop("texts"), list(SPLITS)).where("doc_id > first_id")
    mixed = classes.where("texts > 1").select(*SPLITS)
    if not mixed.isEmpty():  # texts that differ although all of their hashes agree
        apart = keep(whole.join(mixed, list(SPLITS), "left_semi"), "apart")
        first = keep(apart.groupBy(*SPLITS, "text").agg(F.min("doc_id").alias("first_id")), "first")
        found = found.unionByName(apart.join(first, [*SPLITS, "text"]).where("doc_id > first_id").drop("text"))
    return found.groupBy("doc_id", *SPLITS).agg(F.min("first_id").alias("first_id"))


def failures(text: Column) -> list[Column]:
    """The conditions A to D of a text without nulls, as booleans; E is a matter of the table."""
    words = F.array_remove(F.split(text, BREAK), "")
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < MIN_WORDS, F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT, upper * 100 > F.char_length(text) * UPPER_PERCENT, text.rlike(SYMBOLS)]


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) to doc_id, part, mask: the bits (1, 2, 4, ...) of the filters in FILTERS that each document fails.

    Null texts are empty, a null lang is the part "". Repeated rows are each returned; a null doc_id never fails E; extra columns are ignored;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    bits = sum(f.cast("int") * (1 << k) for k, f in enumerate(failures(F.col("text"))))
    rows = keep(read.select("doc_id", "part", bits.alias("bits"), *split_columns(F.col("text"))), "marked")
    again = keep(copies(docs, rows), "copies").withColumn("copy", F.lit(1 << FILTERS.index("E"))).drop("first_id")
    return rows.join(again, ["doc_id", *SPLITS], "left").select("doc_id", "part", (F.col("bits") + F.coalesce("copy", F.lit(0))).alias("mask"))


def counted(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask) and (doc_id, quality, toxic) to part, mask, good, toxic, n. A document is good or toxic if any label of its id says so."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    known = keep(known.withColumnRenamed("doc_id", "of"), "labels")
    rows = masks.join(known, masks["doc_id"] == known["of"], "left")
    return rows.groupBy("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]).agg(F.count("*").alias("n"))


def steps() -> list[tuple[int, int, int]]:
    """(mask of the filters before, the filter's bit, number of orders that have them so)."""
    out = []
    for f in range(len(FILTERS)):
        others = [k for k in range(len(FILTERS)) if k != f]
        for n in range(len(FILTERS)):
            out += [(sum(1 << k for k in before), 1 << f, math.factorial(n) * math.factorial(len(FILTERS) - 1 - n)) for before in itertools.combinations(others, n)]
    return out


def audit(counts: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n) to a row for each part, order of FILTERS and step; no parts, no rows.

    The counts are few (parts x 32 masks x labels), each meets the 80 pairs of earlier filters and a filter, and those the 600 steps of all orders.
    """
    each = F.explode(F.array(*[F.struct(*(F.lit(x).alias(n) for x, n in zip(s, ("before", "bit", "orders"), strict=True))) for s in steps()])).alias("s")
    rows = counts.select("*", each).select("part", "mask", "good", "toxic", "n", "s.*")
    fails, passed = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) == 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    found = rows.groupBy("part", "before", "bit", "orders").agg(
        total(passed & ~fails).alias("kept"), total(passed & fails).alias("removed"), total(~passed & fails).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(passed & fails & (F.col("good") == 1)).alias("good_lost"), total(passed & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    found = found.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "bit")))
    places = [("".join(o), k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), 1 << FILTERS.index(x)) for o in itertools.permutations(FILTERS) for k, x in enumerate(o)]
    orders = counts.sparkSession.createDataFrame(places, "filter_order string, step int, before int, bit int")
    return found.join(F.broadcast(orders), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents."""
    return audit(counted(marked(load(spark, sf_dir, "documents")), load(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH read AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copy FROM read
), known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1
), marked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * copy::INT AS mask
  FROM words d LEFT JOIN known k ON d.doc_id = k.doc_id
), counts AS (
  SELECT part, mask, good, toxic, count(*) AS n FROM marked GROUP BY ALL
), letters AS (
  SELECT substr('ABCDE', i, 1) AS x, 1 << (i - 1) AS bit FROM range(1, 6) AS r(i)
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), places AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) AS r(step)
), found AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & before = 0 AND mask & bit = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails, sum(n) FILTER (mask & before = 0 AND mask & bit > 0 AND good) AS good_lost, sum(n) FILTER (mask & before = 0 AND mask & bit > 0 AND toxic) AS toxic_lost
  FROM counts, places GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM found
"""
