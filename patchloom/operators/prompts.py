"""Review prompts rendered from nested rows, and their token budget.

A context row has path, diff_lines array<struct<line_num, change_type, content>>, expanded_region, region_start_line,
scopes array<struct<type, name, start_line, end_line, source>> and symbols array<struct<name, file, code>>, the last two in the order
in which they are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.text import lines, tokens_estimated

# Headings and marks of a prompt.
NO_CHANGES = "No code changes to analyze."
FOOTER = "Analyze the above code changes for security vulnerabilities."
CUT_MARK = "... [truncated for token limit]"
BETWEEN = "\n\n---\n\n"


def _fenced(body: Column) -> Column:
    return F.concat(F.lit("```\n"), body, F.lit("\n```"))


def _numbered(number: Column, mark: Column, content: Column) -> Column:
    return F.concat(F.format_string("%4d |", number), mark, F.lit(" "), content)


def code_block(region: Column, first_line: Column, diff_lines: Column) -> Column:
    """The region with line numbers, added lines marked; without a region the added lines alone, by number."""
    added = F.filter(diff_lines, lambda d: d["change_type"] == "+")
    numbers = F.transform(added, lambda d: d["line_num"])
    shown = F.transform(lines(region), lambda x, k: _numbered(first_line + k, F.when(F.array_contains(numbers, first_line + k), "+").otherwise(" "), x))
    keyed = F.transform(added, lambda d, k: F.struct(d["line_num"].alias("n"), k.alias("k"), d["content"].alias("c")))
    alone = F.transform(F.array_sort(keyed), lambda d: _numbered(d["n"], F.lit("+"), d["c"]))
    return F.array_join(F.when(region == "", alone).otherwise(shown), "\n")


def file_section(path: Column, region: Column, first_line: Column, diff_lines: Column, scopes: Column, symbols: Column, with_source: bool = True, with_symbols: bool = True) -> Column:
    """The part of a prompt that shows one file; parts without content are left out."""
    code = code_block(region, first_line, diff_lines)
    gone = F.filter(diff_lines, lambda d: d["change_type"] == "-")
    removed = F.array_join(F.transform(gone, lambda d: _numbered(d["line_num"], F.lit("-"), d["content"])), "\n")

    def scope(s: Column) -> Column:
        head = F.format_string("- %s `%s` (lines %d-%d)", s["type"], s["name"], s["start_line"], s["end_line"])
        return F.when(s["source"] != "", F.concat(head, F.lit(":\n"), _fenced(s["source"]))).otherwise(head) if with_source else head

    defined = F.transform(symbols, lambda s: F.concat(F.format_string("**`%s`** (from `%s`):\n", s["name"], s["file"]), _fenced(s["code"])))
    parts = F.array(
        F.concat(F.lit("## File: "), path),
        F.when(code != "", F.concat(F.lit("### Code Context\n"), _fenced(code))),
        F.when(F.size(gone) > 0, F.concat(F.lit("### Removed Lines\n"), _fenced(removed))),
        F.when(F.size(scopes) > 0, F.concat(F.lit("### Enclosing Scopes\n"), F.array_join(F.transform(scopes, scope), "\n"))),
        F.when(F.size(symbols) > 0, F.concat(F.lit("### Referenced Definitions\n"), F.array_join(defined, "\n"))) if with_symbols else F.lit(None).cast("string"),
    )
    return F.array_join(F.array_compact(parts), "\n\n")


def prompts(contexts: DataFrame, key: str, order: str, max_tokens: int | None = None) -> DataFrame:
    """(key, prompt, tokens): one prompt for each key from its contexts in ``order``.

    Over the budget, first the text of scopes goes, then the definitions; what changed is never cut, so a prompt can stay over it.
    """
    columns = [F.col(c) for c in ("path", "expanded_region", "region_start_line", "diff_lines", "scopes", "symbols")]
    forms = {"a": (True, True), "b": (False, True), "c": (False, False)} if max_tokens is not None else {"a": (True, True)}
    rows = contexts.select(key, order, *[file_section(*columns, *form).alias(n) for n, form in forms.items()])

    def joined(name: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("s"))))
        return F.array_join(F.transform(pairs, lambda p: p["s"]), BETWEEN)

    rows = rows.groupBy(key).agg(*[joined(n).alias(n) for n in forms])
    whole = F.concat(F.col("a"), F.lit(f"\n\n{FOOTER}"))
    if max_tokens is not None:
        cut = [F.concat(F.col(n), F.lit(f"\n\n{CUT_MARK}\n\n{FOOTER}")) for n in ("b", "c")]
        whole = F.when(tokens_estimated(whole) <= max_tokens, whole).when(tokens_estimated(cut[0]) <= max_tokens, cut[0]).otherwise(cut[1])
    return rows.select(key, whole.alias("prompt")).withColumn("tokens", tokens_estimated("prompt"))


def token_total(prompts_: DataFrame, system_tokens: int = 0) -> DataFrame:
    """One row: prompts and their tokens, the instructions' included."""
    return prompts_.agg(F.count("*").alias("n_prompts"), F.coalesce(F.sum(F.col("tokens") + system_tokens), F.lit(0)).cast("long").alias("total_tokens"))
