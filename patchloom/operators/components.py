"""Component files (Vue, Svelte, Astro): their script block, its language, and the template without it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
FRONT = r"(?ms)\A\s*^---[ \t]*$\r?\n(.*?)^---[ \t]*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _line_of(text: Column, block: Column) -> Column:
    before = F.left(text, F.instr(text, block) - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int")


def script_block(text: Column | str) -> Column:
    """struct<content, start_line> of the first script block: without line ends around it, starting on the line after its tag; null for none or a blank one."""
    text = _col(text)
    whole, body = F.regexp_extract(text, SCRIPT, 0), F.regexp_extract(text, SCRIPT, 2)
    content = F.regexp_replace(F.regexp_replace(body, r"^[\r\n]+", ""), r"[\r\n]+$", "")
    block = F.struct(content.alias("content"), (_line_of(text, whole) + 2).alias("start_line"))
    return F.when((whole != "") & (F.trim(body) != ""), block)


def script_language(text: Column | str) -> Column:
    """typescript if the first script tag says so, else javascript."""
    attributes = F.regexp_extract(_col(text), SCRIPT, 1)
    return F.when(attributes.rlike(r"""(?i)\blang\s*=\s*["']?(ts|typescript)\b"""), F.lit("typescript")).otherwise(F.lit("javascript"))


def without_blocks(text: Column | str) -> Column:
    """The text without script and style blocks."""
    return F.regexp_replace(F.regexp_replace(_col(text), SCRIPT, ""), STYLE, "")


def blanked(text: Column | str) -> Column:
    """The text with script and style blocks turned into as many empty lines, so line numbers stay: lines of each block become empty, one after the other."""
    out = _col(text)
    for pattern in (SCRIPT, STYLE):
        blocks = F.regexp_extract_all(out, F.lit(pattern), F.lit(0))
        out = F.aggregate(blocks, out, lambda s, b: F.replace(s, b, F.regexp_replace(b, r"[^\r\n]", "")))
    return out


def frontmatter(text: Column | str) -> Column:
    """struct<content, start_line> between the first two lines of three hyphens; null if there is none or it is empty."""
    text = _col(text)
    whole, body = F.regexp_extract(text, FRONT, 0), F.regexp_extract(text, FRONT, 1)
    lead = F.regexp_extract(text, r"\A\s*", 0)
    start = F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))
    return F.when((whole != "") & (F.trim(F.regexp_replace(body, r"[\r\n]", "")) != ""), F.struct(F.regexp_replace(body, r"[\r\n]+$", "").alias("content"), (start + 2).cast("int").alias("start_line")))


def frontmatter_language(content: Column | str) -> Column:
    """typescript if the frontmatter has marks of it, else javascript."""
    return F.when(_col(content).rlike(r"\binterface\s+\w+|\btype\s+\w+\s*=|:\s*(string|number|boolean|any)\b|\bimport\s+type\b|\bas\s+\w+"), F.lit("typescript")).otherwise(F.lit("javascript"))
