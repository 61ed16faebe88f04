"""Symbols and where they come from: free names, the import that binds a name, the file that an import means. First match always means least ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.operators.regions import scope_text
from patchloom.shared import merged_join


def free_symbols(used: DataFrame, defined: DataFrame, builtins: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, symbol) that are used but neither defined under the same key nor built in."""
    out = used.select(*keys, "symbol").distinct()
    out = out.join(defined.select(*keys, "symbol").distinct(), [*keys, "symbol"], "left_anti")
    return out.join(builtins.select("symbol").distinct(), "symbol", "left_anti").select(*keys, "symbol")


def bound_names(imports: DataFrame) -> DataFrame:
    """One row for each name that an import binds: its columns and ``bound``.

    Imports: file_id, ord, module, names array<string> (null for a whole module), alias, name_aliases array<struct<original, alias>>.
    Named imports bind their names and the aliases of these; a whole module binds its alias, else itself, its first part and its last.
    """
    aliases = F.coalesce("name_aliases", F.array().cast("array<struct<original:string,alias:string>>"))
    named = F.concat("names", F.transform(aliases, lambda a: a["alias"]))
    parts = F.split("module", r"[./:\\]+")
    module = F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(F.array(F.col("module"), F.get(parts, F.lit(0)), F.element_at(parts, -1)))
    return imports.withColumn("bound", F.explode(F.array_distinct(F.coalesce(named, module))))


def resolved_imports(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, symbol) with the first import in source order that binds it: module, ord, and the original name behind an alias."""
    more = [c for c in ("is_relative", "level") if c in imports.columns]
    bound = bound_names(imports).select("file_id", F.col("bound").alias("symbol"), F.struct("ord", "module", "name_aliases", *more).alias("i"))
    first = merged_join(symbols, bound, ["file_id", "symbol"]).groupBy("file_id", "symbol").agg(F.min_by("i", "i.ord").alias("i"))
    original = F.get(F.filter(F.coalesce("i.name_aliases", F.array().cast("array<struct<original:string,alias:string>>")), lambda a: a["alias"] == F.col("symbol")), F.lit(0))["original"]
    return first.select("file_id", "symbol", "i.module", "i.ord", *[f"i.{c}" for c in more], F.coalesce(original, F.col("symbol")).alias("original"))


def first_existing(wanted: DataFrame, candidates: Column, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): for each row the first of its candidate paths that is among ``files``; rows without one are left out."""
    rows = wanted.select(*keys, F.posexplode(candidates).alias("at", "path"))
    found = merged_join(rows, files.select("path").distinct(), "path")
    return found.groupBy(*keys).agg(F.min_by("path", "at").alias("path"))


def definitions(resolved: DataFrame, top_level: DataFrame, lines_of: DataFrame, limit: int = 200) -> DataFrame:
    """(file_id, symbol, path, code): the text of the first top-level node of that name in the file that the import means, at most ``limit`` lines of it with a note.

    resolved: file_id, symbol, original, path. top_level: path, name, start_line, end_line. lines_of: path, lines. Symbols without a definition
    are left out.
    """
    node = top_level.groupBy("path", "name").agg(F.min(F.struct("start_line", "end_line")).alias("n"))
    out = merged_join(resolved, node, (resolved["path"] == node["path"]) & (resolved["original"] == node["name"])).select("file_id", "symbol", resolved["path"], "n")
    out = merged_join(out, lines_of.select("path", "lines"), "path")
    return out.select("file_id", "symbol", "path", scope_text(F.col("lines"), F.col("n.start_line"), F.col("n.end_line"), limit).alias("code"))
