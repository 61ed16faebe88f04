"""Findings: parsed from a reviewer's answers, rated by weakness, compared with thresholds and a baseline, counted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions.text import cwe_normalized

REQUIRED = ("what", "why", "how_to_fix", "severity", "confidence")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _named(value: Column | str, names: tuple[str, ...], default: str) -> Column:
    known = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(_col(value)))), F.lit(default))


def severity(value: Column | str) -> Column:
    """A severity's name, case and blanks aside; anything else is Medium."""
    return _named(value, C.SEVERITIES, "Medium")


def confidence(value: Column | str) -> Column:
    """A confidence's name, case and blanks aside; anything else is Medium."""
    return _named(value, C.CONFIDENCES, "Medium")


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def extracted(raw: Column | str) -> Column:
    """The first JSON object of an answer as a variant: the whole text, else a fenced block, else from the first brace to the last; null for none."""
    raw = _col(raw)
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n(.*?)\n\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    out = F.lit(None).cast("variant")
    for text in (braces, fence, raw):
        v = F.try_parse_json(text)
        out = F.when(v.isNotNull() & _is_object(v), v).otherwise(out)
    return out


def line_range(value: Column) -> Column:
    """struct<start, end, bad> of a variant: an object with start and end, or an array of two or more; in order.

    Fractions are cut off. Null without both ends of an object; bad if an end is negative or no whole number, or an array's end is null.
    """
    whole = F.col(value) if isinstance(value, str) else value
    shape = F.schema_of_variant(whole)
    is_array = F.startswith(shape, F.lit("ARRAY")) & F.try_variant_get(whole, "$[1]", "variant").isNotNull()
    is_object = F.startswith(shape, F.lit("OBJECT"))

    def end(at: str, name: str) -> tuple[Column, Column]:
        v = F.when(is_array, F.try_variant_get(whole, at, "variant")).when(is_object, F.try_variant_get(whole, f"$.{name}", "variant"))
        text, kind = F.try_variant_get(v, "$", "string"), F.schema_of_variant(v)
        cut = F.when(F.try_variant_get(v, "$", "double") < 0, F.ceil(F.try_variant_get(v, "$", "double"))).otherwise(F.floor(F.try_variant_get(v, "$", "double")))
        number = F.when(F.startswith(kind, F.lit("DECIMAL")) | kind.isin("DOUBLE", "FLOAT"), cut.try_cast("int")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").try_cast("int"))
        return text.isNotNull(), number.otherwise(F.trim(text).try_cast("int"))

    (has_a, x), (has_b, y) = end("$[0]", "start"), end("$[1]", "end")
    both = is_array | is_object & has_a & has_b
    bad = both & (x.isNull() | y.isNull() | (x < 0) | (y < 0))
    good = both & ~bad
    return F.struct(F.when(good, F.least(x, y)).alias("start"), F.when(good, F.greatest(x, y)).alias("end"), F.coalesce(bad, F.lit(False)).alias("bad"))


def parsed(responses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, file_path, raw) to one row per finding, and one with ``error`` for each answer that is no valid one.

    An answer is valid if it holds an object with an array ``findings`` of objects that all have the required fields; one bad finding spoils its
    whole answer. file_path of a finding is that of its answer. An answer without findings gives no row.
    """
    rows = responses.select(*keys, "file_path", extracted("raw").alias("data"), F.col("raw"))
    list_ = F.try_variant_get("data", "$.findings", "array<variant>")
    rows = rows.withColumn("list", list_)
    broken = F.when(F.col("data").isNull(), F.lit("no JSON object")).when(F.col("list").isNull(), F.lit("no findings array"))

    def missing(f: Column) -> Column:
        test = ~_is_object(f)
        for name in REQUIRED:
            test = test | F.try_variant_get(f, f"$.{name}", "string").isNull()
        return test

    def bad_range(f: Column) -> Column:
        return F.coalesce(line_range(F.try_variant_get(f, "$.line_range", "variant"))["bad"], F.lit(False))

    error = F.coalesce(broken, F.when(F.exists("list", missing), F.lit("missing required field")), F.when(F.exists("list", bad_range), F.lit("bad line range")))
    rows = rows.withColumn("error", error)
    items = F.when(F.col("error").isNull(), F.col("list")).otherwise(F.array(F.lit(None).cast("variant")))
    rows = rows.select(*keys, "file_path", "error", F.posexplode(items).alias("finding_no", "f"))

    def text(name: str) -> Column:
        return F.try_variant_get("f", f"$.{name}", "string")

    lines = line_range(F.try_variant_get("f", "$.line_range", "variant"))
    good = F.col("error").isNull()
    return rows.select(
        *keys, "file_path", F.col("finding_no").cast("long").alias("finding_no"), text("what").alias("what"), text("why").alias("why"), text("how_to_fix").alias("how_to_fix"),
        F.when(good, severity(text("severity"))).alias("severity"), F.when(good, confidence(text("confidence"))).alias("confidence"),
        cwe_normalized(text("cwe_id")).alias("cwe_id"), F.nullif(F.trim(text("owasp_category")), F.lit("")).alias("owasp_category"), lines["start"].alias("line_start"), lines["end"].alias("line_end"), "error",
    )


def cwe_table(spark: SparkSession) -> DataFrame:
    """(cwe_id, mapped): the fixed rule table, a few hundred rows whatever the data."""
    pairs = F.array(*[F.struct(F.lit(c).alias("cwe_id"), F.lit(s).alias("mapped")) for c, s in C.cwe_severities()])
    return spark.range(1).select(F.inline(pairs))


def rated(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Findings with the severity that the rules give their weakness (else their own); a Low confidence caps it at Medium."""
    rules = F.broadcast(cwe_table(findings.sparkSession)) if rules is None else rules  # other rules may be of any size
    names = F.array(*[F.lit(s) for s in C.SEVERITIES])
    out = findings.join(rules, "cwe_id", "left")
    rank = F.array_position(names, F.coalesce("mapped", "severity")).cast("int")
    rank = F.when(F.col("confidence") == "Low", F.greatest(rank, F.lit(C.SEVERITIES.index("Medium") + 1))).otherwise(rank)
    return out.withColumn("severity", F.get(names, rank - 1)).select(*findings.columns)


def action(severity_: Column | str, overrides: Mapping[str, str] | None = None) -> Column:
    """What a severity does: block, warn or allow; overrides replace defaults one by one."""
    rules = C.DEFAULT_ACTIONS | dict(overrides or {})
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), _col(severity_))


def actions(findings: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Number of findings for each action, all three present."""
    return _zero_filled(findings.select(action("severity", overrides).alias("action")), "action", ("block", "warn", "allow"))


def blocks(findings: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """One row: whether any finding blocks; none doesn't."""
    return findings.agg(F.coalesce(F.bool_or(action("severity", overrides) == "block"), F.lit(False)).alias("should_block"))


def _zero_filled(df: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Counts of the given values in one aggregate, a row for each of them."""
    counts = df.agg(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.count_if(F.col(column) == n) for n in names])).alias("m"))
    return counts.select(F.explode("m").alias(column, "n"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Number of findings for each severity, all five present."""
    return _zero_filled(findings, "severity", C.SEVERITIES)


def by_file(findings: DataFrame, order: str) -> DataFrame:
    """One row per file: its findings' number, worst severity and least ``order``; a null path is ``(unknown)``."""
    names = F.array(*[F.lit(s) for s in C.SEVERITIES])
    rank = F.array_position(names, F.col("severity")).cast("int")
    out = findings.groupBy(F.coalesce("file_path", F.lit("(unknown)")).alias("file_path")).agg(F.count("*").alias("n"), F.min(rank).alias("rank"), F.min(order).alias("first_seen"))
    return out.select("file_path", "n", F.get(names, F.col("rank") - 1).alias("worst"), "first_seen")


def suppressed(findings: DataFrame, baseline: DataFrame, known: bool = False) -> DataFrame:
    """Findings whose finding_id is not in the baseline; with ``known``, those that are."""
    return findings.join(baseline.select("finding_id").distinct(), "finding_id", "left_semi" if known else "left_anti")


def enriched(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """Baseline entries with weakness and file from the last scan where they have none; of several rows of an id the first (least ``ord``) counts."""
    first = cache.groupBy("finding_id").agg(F.min_by(F.struct("cwe_id", "file_path"), "ord").alias("c"))
    out = entries.join(first, "finding_id", "left")
    return out.withColumn("cwe_id", F.coalesce("cwe_id", "c.cwe_id")).withColumn("file_path", F.coalesce("file_path", "c.file_path")).drop("c")


def per_file_counts(files: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Every file with its number of findings, 0 for none."""
    counts = findings.groupBy(key).agg(F.count("*").alias("n"))
    return files.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
