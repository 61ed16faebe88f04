"""Unified diffs as tables: files, hunks, numbered lines.

A diff is cut into blocks of lines, so one diff of any size spreads over tasks. Running sums number the marks inside each block; a summary of
each block says what it adds to those after it; the summaries, few, are summed up by diff; and each block is finished by itself with what
its diff had before it. ``marked_lines`` does this once, and files, hunks and lines all come from its rows. No step needs Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.functions.text import lines
from patchloom.shared import merged_join

#: Lines to a block: what one window of the first level holds.
BLOCK = 1 << 16
HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def unquote_c(quoted: str) -> tuple[str, str]:
    """(content, remainder) of a text that may begin with a C-quoted string; each octal byte becomes one character."""
    if not quoted.startswith('"'):
        return quoted, ""
    m = re.match(r'"((?:[^"\\]|\\[\s\S])*)"?', quoted)
    body = re.sub(r"\\([0-7]{3}|[\s\S])", lambda e: chr(int(e[1], 8)) if len(e[1]) == 3 else _ESCAPES.get(e[1], e[1]), m[1])
    return body, quoted[m.end() :]


@F.pandas_udf(T.StructType([T.StructField("content", T.StringType()), T.StructField("rest", T.StringType())]))
def unquoted_path(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unquote_c(t or "") for t in text], columns=["content", "rest"])


def _header_paths(line: Column) -> Column:
    """(old, new) of a ``diff --git`` line; without quotes the line is cut at the last `` b/``."""
    rest = F.substring(line, len("diff --git ") + 1, 1 << 30)
    old, new = F.regexp_extract(rest, r"^a/(.*) b/(.*)$", 1), F.regexp_extract(rest, r"^a/(.*) b/(.*)$", 2)
    return F.struct(old.alias("old"), new.alias("new"))


def _named(line: Column, start: str) -> Column:
    """The path after ``--- `` or ``+++ ``: null for /dev/null, without its a/ or b/."""
    rest = F.substring(line, len(start) + 1, 1 << 30)
    return F.when(F.startswith(rest, F.lit("/dev/null")), F.lit(None)).otherwise(F.regexp_replace(rest, "^[ab]/", ""))


def line_blocks(diffs: DataFrame, size: int | None = None) -> DataFrame:
    """(diff_id, text) to diff_id, block, pos, line: the lines of each text, ``size`` of them to a block."""
    rows = diffs.select("diff_id", F.posexplode(lines("text")).alias("pos", "line"))
    return rows.select("diff_id", F.floor(F.col("pos") / (size or BLOCK)).alias("block"), F.col("pos").cast("long").alias("pos"), "line")


def marked_lines(diffs: DataFrame) -> DataFrame:
    """One row per line that belongs to a file: diff_id, pos, line, file_no, hunk_no (0 before the first hunk), kind, new_start, line_num.

    From whole texts (diff_id, text), or from lines (diff_id, block, pos, line) in which ``pos`` orders the lines of a block and ``block`` those of
    a diff. kind is header, hunk, body (a line of a hunk: blank, plus or minus sign first) or meta. Inside a hunk, an empty line and a line with
    a backslash are of kind skip, and a hunk ends only where the next one or the next file begins. new_start is that of the line's hunk, and
    line_num, of a body line, its number in the new file; a removed line has the number of what follows it.
    """
    rows = diffs if "line" in diffs.columns else line_blocks(diffs)
    first = F.left("line", F.lit(1))
    head, is_hunk = F.startswith("line", F.lit("diff --git ")), F.startswith("line", F.lit("@@ -")) & F.col("line").rlike(HUNK)
    rows = rows.select("diff_id", "block", "pos", "line", first.alias("sign"), head.alias("head"), (is_hunk & ~head).alias("is_hunk"), first.isin(" ", "+").cast("long").alias("step"))
    # Inside a block: files and hunks begun up to each line, and steps in the new file since the last mark.
    order = Window.partitionBy("diff_id", "block").orderBy("pos")
    rows = rows.withColumns({"nth": F.row_number().over(order) - 1, "f": F.sum(F.col("head").cast("long")).over(order), "h": F.sum(F.col("is_hunk").cast("long")).over(order), "s": F.sum("step").over(order)})
    mark, start = F.col("head") | F.col("is_hunk"), F.when(F.col("is_hunk"), F.regexp_extract("line", HUNK, 3).try_cast("int"))
    rows = rows.withColumns({
        "h0": F.coalesce(F.max(F.when(F.col("head"), F.col("h"))).over(order), F.lit(0)), "s0": F.coalesce(F.max(F.when(mark, F.col("s"))).over(order), F.lit(0)),
        "marked": F.max(mark.cast("int")).over(order) == 1, "start": F.last(start, True).over(order),
    })
    rows = rows.select("diff_id", "block", "nth", "line", "sign", "head", "is_hunk", "step", "f", (F.col("h") - F.col("h0")).alias("hunk"), (F.col("s") - F.col("s0")).alias("steps"), "marked", "start")
    # Of each block: what it hands on. Blocks are few, so one window holds those of a diff.
    last = F.max(F.struct("nth", "f", "hunk", "steps", "marked", "start"))
    blocks = rows.groupBy("diff_id", "block").agg(last.alias("z")).select("diff_id", "block", "z.*")
    up_to = Window.partitionBy("diff_id").orderBy("block")
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"files": F.sum("f").over(up_to), "hunks": F.sum("hunk").over(up_to), "walked": F.sum("steps").over(up_to)})
    # Sums since the last block with a header (for hunks), or with any mark (for steps): what was summed up before that block is taken off.
    blocks = blocks.withColumns({
        "hunks0": F.max(F.when(F.col("f") > 0, F.col("hunks") - F.col("hunk"))).over(before), "walked0": F.last(F.when(F.col("marked"), F.col("walked") - F.col("steps")), True).over(before),
        "c_lines": F.coalesce(F.sum(F.col("nth") + 1).over(before), F.lit(0)), "c_files": F.coalesce(F.sum("f").over(before), F.lit(0)), "c_start": F.last("start", True).over(before),
    })
    carried = blocks.select(
        "diff_id", "block", "c_lines", "c_files", "c_start", (F.coalesce(F.lag("hunks").over(up_to), F.lit(0)) - F.coalesce("hunks0", F.lit(0))).alias("c_hunks"),
        (F.coalesce(F.lag("walked").over(up_to), F.lit(0)) - F.coalesce("walked0", F.lit(0))).alias("c_steps"),
    )
    rows = merged_join(rows, carried, ["diff_id", "block"])
    file_no, hunk_no = F.col("c_files") + F.col("f"), F.col("hunk") + F.when(F.col("f") == 0, F.col("c_hunks")).otherwise(0)
    rows = rows.select("diff_id", (F.col("c_lines") + F.col("nth")).alias("pos"), "line", file_no.alias("file_no"), hunk_no.alias("hunk_no"), "sign", "head", "is_hunk", "step", F.col("steps") + F.when(F.col("marked"), 0).otherwise(F.col("c_steps")), F.coalesce("start", "c_start").alias("new_start"))
    rows = rows.toDF("diff_id", "pos", "line", "file_no", "hunk_no", "sign", "head", "is_hunk", "step", "steps", "new_start").where("file_no > 0")
    kind = F.when(F.col("head"), "header").when((F.col("hunk_no") > 0) & F.col("sign").isin(" ", "+", "-"), "body").when(F.col("is_hunk"), "hunk").when(F.col("hunk_no") > 0, "skip").otherwise("meta")
    number = F.when(F.col("kind") == "body", F.col("new_start") + F.col("steps") - F.col("step")).cast("int")
    return rows.withColumn("kind", kind).select("diff_id", "pos", "line", "file_no", "hunk_no", "kind", F.when(F.col("hunk_no") > 0, F.col("new_start")).alias("new_start"), number.alias("line_num"))


def _marked(diffs: DataFrame) -> DataFrame:
    return diffs if "kind" in diffs.columns else marked_lines(diffs)


def diff_files(diffs: DataFrame) -> DataFrame:
    """One row per file of each diff (texts, lines, or rows of ``marked_lines``): diff_id, file_no, old_path, new_path, path, is_new_file, is_deleted, is_renamed, is_binary, mode_changed."""
    rows = _marked(diffs).where(F.col("kind").isin("header", "meta"))

    def says(*starts: str) -> Column:
        test = F.lit(False)
        for s in starts:
            test = test | F.startswith("line", F.lit(s))
        return F.coalesce(F.bool_or(test & (F.col("kind") == "meta")), F.lit(False))

    def after(start: str, value: Column) -> Column:
        return F.max(F.when((F.col("kind") == "meta") & F.startswith("line", F.lit(start)), value))

    quoted = F.col("line").contains('"')
    line = F.when(quoted, _unquoted_line(F.col("line"))).otherwise(F.regexp_replace("line", r"^((?:---|\+\+\+) [^\t]*)\t.*$", "$1"))
    rows = rows.withColumn("line", line)
    head = _header_paths(F.col("line"))
    found = rows.groupBy("diff_id", "file_no").agg(
        F.max(F.when(F.col("kind") == "header", head["old"])).alias("head_old"), F.max(F.when(F.col("kind") == "header", head["new"])).alias("head_new"),
        after("--- ", _named(F.col("line"), "--- ")).alias("minus"), after("+++ ", _named(F.col("line"), "+++ ")).alias("plus"),
        after("rename from ", F.substring("line", len("rename from ") + 1, 1 << 30)).alias("from"), after("rename to ", F.substring("line", len("rename to ") + 1, 1 << 30)).alias("to"),
        says("new file mode").alias("is_new_file"), says("deleted file mode").alias("is_deleted"),
        says("rename from", "rename to", "similarity index").alias("is_renamed"), says("Binary files", "GIT binary patch").alias("is_binary"), says("old mode", "new mode").alias("mode_changed"),
    )
    old, new = F.coalesce("minus", "from", "head_old"), F.coalesce("plus", "to", "head_new")
    found = found.select("diff_id", "file_no", old.alias("old_path"), new.alias("new_path"), "is_new_file", "is_deleted", "is_renamed", "is_binary", "mode_changed")
    return found.withColumn("path", F.when(F.col("is_deleted"), F.col("old_path")).otherwise(F.col("new_path")))


def _unquoted_line(line: Column) -> Column:
    """A header or metadata line with its C-quoted paths decoded, as by ``unquote_c``; a quotation that does not end stays as it is.

    The line is cut into escapes, quotes and the texts between them, which are gone through once: ``out`` is what is done, ``raw`` and ``text``
    what an open quotation has so far, as it stands and decoded. Outside of quotations a backslash is a plain character.
    """

    def decoded(t: Column) -> Column:
        escape = F.substring(t, 2, 3)
        byte = F.decode(F.unhex(F.lpad(F.conv(escape, 8, 16), 4, "0")), "UTF-16BE")
        known = F.create_map(*[F.lit(x) for kv in _ESCAPES.items() for x in kv])
        return F.when(~F.startswith(t, F.lit("\\")) | (F.length(t) == 1), t).when(F.length(t) == 4, byte).otherwise(F.coalesce(F.try_element_at(known, escape), escape))

    def step(state: Column, t: Column) -> Column:
        out, raw, text = state["out"], state["raw"], state["text"]
        ends, begins = F.endswith(t, F.lit('"')), t == '\\"'
        outside = F.when(ends, F.struct(F.when(begins, F.concat(out, F.lit("\\"))).otherwise(out).alias("out"), F.lit('"').alias("raw"), F.lit("").alias("text")))
        outside = outside.otherwise(F.struct(F.concat(out, t).alias("out"), F.lit("").alias("raw"), F.lit("").alias("text")))
        inside = F.when(t == '"', F.struct(F.concat(out, text).alias("out"), F.lit("").alias("raw"), F.lit("").alias("text")))
        inside = inside.otherwise(F.struct(out.alias("out"), F.concat(raw, t).alias("raw"), F.concat(text, decoded(t)).alias("text")))
        return F.when(raw == "", outside).otherwise(inside)

    tokens = F.regexp_extract_all(line, F.lit(r'\\[0-7]{3}|\\[\s\S]|"|[^"\\]+|\\'), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("raw"), F.lit("").alias("text"))
    return F.aggregate(tokens, start, step, lambda s: F.concat(s["out"], s["raw"]))


def hunks(diffs: DataFrame) -> DataFrame:
    """One row per hunk: diff_id, file_no, hunk_no, old_start, old_count, new_start, new_count; a missing count is 1."""
    rows = _marked(diffs).where("kind = 'hunk'")
    number = [F.regexp_extract("line", HUNK, k) for k in range(1, 5)]
    value = [number[0].try_cast("int"), F.coalesce(number[1].try_cast("int"), F.lit(1)), number[2].try_cast("int"), F.coalesce(number[3].try_cast("int"), F.lit(1))]  # Spark may take numbers of a line before it knows its kind
    return rows.select("diff_id", "file_no", "hunk_no", *[v.alias(n) for v, n in zip(value, ("old_start", "old_count", "new_start", "new_count"), strict=True)])


def numbered(lines_: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of hunks (keys, pos, marker, new_start, ...) with ``line_num``: the line in the new file; a removed line has the number of what follows it."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    steps = F.sum(F.when(F.col("marker").isin("+", " "), 1).otherwise(0)).over(before)
    return lines_.withColumn("line_num", (F.col("new_start") + F.coalesce(steps, F.lit(0))).cast("int"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """One row per line of a hunk: diff_id, file_no, hunk_no, pos, line_num, change_type (plus, minus or blank), content."""
    rows = _marked(diffs).where("kind = 'body'")
    return rows.select("diff_id", "file_no", "hunk_no", "pos", "line_num", F.left("line", F.lit(1)).alias("change_type"), F.substring("line", 2, 1 << 30).alias("content"))
