"""Line intervals: hunks widened to regions, regions merged, scopes that hold changed lines. Intervals are closed and count from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.shared import merged_join


def expanded(new_start: Column | str, new_count: Column | str, expansion: int, file_length: Column | str | None = None) -> Column:
    """struct<start_line, end_line> of a hunk with ``expansion`` lines on each side, within the file; (1, 0) for an empty file."""
    start, count = (F.col(c) if isinstance(c, str) else c for c in (new_start, new_count))
    low = F.greatest(start - expansion, F.lit(1))
    high = start + F.greatest(count, F.lit(1)) - 1 + expansion
    if file_length is not None:
        length = F.col(file_length) if isinstance(file_length, str) else file_length
        empty = length <= 0
        low = F.when(empty, 1).otherwise(F.least(low, F.greatest(length, F.lit(1))))
        high = F.when(empty, 0).otherwise(F.least(high, length))
    return F.struct(low.cast("int").alias("start_line"), high.cast("int").alias("end_line"))


def merged(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the intervals of each key; intervals that touch (a gap of no line) become one. Empty ones (end before start) are dropped."""
    order = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = regions.where("end_line >= start_line").withColumn("new", F.when(reach.isNotNull() & (F.col("start_line") <= reach + 1), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order))
    return rows.groupBy(*keys, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def file_regions(files: DataFrame, hunks: DataFrame, keys: list[str], expansion: int = 50) -> DataFrame:
    """Regions of each file (keys, file_length, is_new_file, is_deleted, is_binary): a new file is one region, a deleted or binary one has none, others have their merged hunks."""
    alive = files.where(~F.col("is_deleted") & ~F.col("is_binary"))
    new = alive.where("is_new_file and file_length > 0").select(*keys, F.lit(1).alias("start_line"), F.col("file_length").cast("int").alias("end_line"))
    rest = merged_join(hunks, alive.where("not is_new_file").select(*keys, "file_length"), keys)
    rest = rest.withColumn("r", expanded("new_start", "new_count", expansion, "file_length")).select(*keys, "r.start_line", "r.end_line")
    return new.unionByName(merged(rest, keys))


def envelope(regions: DataFrame, keys: list[str]) -> DataFrame:
    """First and last line of all regions of a key, gaps included."""
    return regions.groupBy(*keys).agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def line_count(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Lines in the regions of a key."""
    return regions.groupBy(*keys).agg(F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("n_lines"))


def innermost(lines: DataFrame, scopes: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Each line (keys, line_num, ...) with the deepest scope (keys, scope_type, name, start_line, end_line, depth) that holds it; lines in none are left out.

    Scopes are listed in every band of ``width`` lines that they touch, so the join is on equal keys and bands and never compares a line with
    all scopes of a file. Of equally deep scopes the later start wins, then the later name.
    """
    band = F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width)))
    listed = scopes.where("end_line >= start_line").select(*keys, band.alias("band"), F.struct("depth", "start_line", "scope_type", "name", "end_line").alias("scope"))
    inside = F.col("line_num").between(F.col("scope.start_line"), F.col("scope.end_line"))
    rows = lines.where("line_num >= 1").withColumn("band", F.floor(F.col("line_num") / width))
    found = merged_join(rows, listed, [*keys, "band"]).where(inside)
    found = found.groupBy(*lines.columns).agg(F.max("scope").alias("scope"))
    return found.select(*lines.columns, "scope.scope_type", "scope.name", "scope.start_line", "scope.end_line", "scope.depth")


def distinct_scopes(found: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The distinct scopes of each key with ``first_seen``, the least ``order`` of a line in it."""
    return found.groupBy(*keys, "scope_type", "name", "start_line", "end_line").agg(F.min(order).alias("first_seen"))


def scope_text(lines: Column, start_line: Column, end_line: Column, limit: int = 200, is_new_file: Column | None = None) -> Column:
    """Text of a scope, at most ``limit`` lines with a note on how many are missing; of a new file nothing is cut."""
    n = end_line - start_line + 1
    body = F.slice(lines, start_line, F.greatest(n, F.lit(0)))
    cut = F.concat(F.array_join(F.slice(body, F.lit(1), F.lit(limit)), "\n"), F.format_string("\n... (truncated %d lines)", (F.size(body) - limit).cast("int")))
    whole = F.size(body) <= limit
    return F.when(whole | is_new_file if is_new_file is not None else whole, F.array_join(body, "\n")).otherwise(cut)


def clipped(intervals: DataFrame, first: Column, last: Column, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Intervals that touch [first, last], cut to it and counted from its first line; used for script blocks within a component file."""
    kept = intervals.where((F.col(start) <= last) & (F.col(end) >= first))
    return kept.withColumn(start, (F.greatest(F.col(start), first) - first + 1).cast("int")).withColumn(end, (F.least(F.col(end), last) - first + 1).cast("int"))


def region_text(lines: Column, start_line: Column, end_line: Column) -> Column:
    """Lines from the first to the last of all regions as one text; empty without regions."""
    return F.when(start_line.isNull(), F.lit("")).otherwise(F.array_join(F.slice(lines, start_line, F.greatest(end_line - start_line + 1, F.lit(0))), "\n"))
