"""The whole review of a table of diffs: from diff text and source files to prompts, findings and a verdict.

All steps are keyed by (diff_id, file_no), so many diffs are reviewed at once and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.text import finding_id
from patchloom.operators import code, components, diffs, filters, findings, projects, prompts, regions, review, symbols
from patchloom.operators.projects import VERSION, versioned
from patchloom.shared import keep, merged_join
from patchloom.shipping import ship
from patchloom.sources.files import Config, SourceError

KEY = ["diff_id", "file_no"]
SYSTEM_TOKENS = 1200
#: Prompts of a task, where progress is told.
PROMPTS = 32


@dataclass
class Scan:
    """Results of a review: contexts and prompts by file, findings with ids, those that are new, errors, and one row of status."""

    contexts: DataFrame
    prompts: DataFrame
    findings: DataFrame
    new: DataFrame
    errors: DataFrame
    blocks: DataFrame


def check_ready(reviewer: Callable | None, changes: DataFrame) -> bool:
    """Whether there is anything to review; without a reviewer an error is raised."""
    if reviewer is None:
        raise SourceError("no reviewer is configured")
    return not changes.where(F.trim("text") != "").isEmpty()


def reviewed_files(marked: DataFrame, versions: DataFrame, sources: DataFrame, config: Config) -> DataFrame:
    """Files of all diffs (``diffs.marked_lines``) that are to be reviewed, with repo, revision, language, lines, text and error of their source.

    versions: diff_id, repo, revision. sources: repo, revision, path, text, lines, error.
    """
    files = merged_join(diffs.diff_files(marked), versions, "diff_id")
    files = merged_join(files, sources.select(*VERSION, "path", "text", "lines", "error"), [*VERSION, "path"], "left")
    return filters.analyzable(files, config.third_party_patterns, config.sensitive())


def _code_parts(files: DataFrame) -> DataFrame:
    """(file_id, path, language, text, shift): what the parsers read; of a component file its script, ``shift`` lines further down."""
    block = F.when(F.col("language").isin("vue", "svelte"), components.script_block("text")).when(F.col("language") == "astro", components.frontmatter("text"))
    rows = files.where("text IS NOT NULL").withColumn("block", block)
    language = F.when(F.col("language").isin("vue", "svelte"), components.script_language("text")).when(F.col("language") == "astro", components.frontmatter_language("block.content")).otherwise(F.col("language"))
    is_component = F.col("language").isin("vue", "svelte", "astro")
    rows = rows.where(~is_component | F.col("block").isNotNull())
    return rows.select(*KEY, *VERSION, F.xxhash64(*KEY).alias("file_id"), "path", language.alias("language"), F.when(is_component, F.col("block.content")).otherwise(F.col("text")).alias("text"), F.when(is_component, F.col("block.start_line") - 1).otherwise(0).alias("shift"))


def contexts(changes: DataFrame, sources: DataFrame, config: Config) -> DataFrame:
    """One row per reviewed file: diff_id, file_no, path, expanded_region, region_start_line, diff_lines, scopes, symbols, n_region_lines.

    changes: diff_id, text, and repo and revision if there are several of either; sources: path, text, lines, error, and the same.
    """
    sources = versioned(sources)
    marked = keep(diffs.marked_lines(changes), "marked")
    return _contexts(marked, keep(reviewed_files(marked, _versions(changes), sources, config), "files"), sources, config)


def _versions(changes: DataFrame) -> DataFrame:
    return versioned(changes).select("diff_id", *VERSION).distinct()


def _contexts(marked: DataFrame, files: DataFrame, sources: DataFrame, config: Config) -> DataFrame:
    files = files.where("error IS NULL")
    length = F.coalesce(F.size("lines"), F.lit(0))
    areas = regions.file_regions(files.select(*KEY, length.alias("file_length"), "is_new_file", "is_deleted", "is_binary"), diffs.hunks(marked), KEY, config.hunk_expansion_lines)
    areas, changed = keep(areas, "areas"), merged_join(diffs.diff_lines(marked), files.select(*KEY), KEY, "left_semi")
    parts = _code_parts(files)
    parsed = keep(merged_join(code.parsed(parts), parts.select("file_id", "shift", *KEY), "file_id"), "parsed")

    found = parsed.select(*KEY, "shift", F.inline("scopes"))
    found = found.select(*KEY, "scope_type", "name", (F.col("start_line") + F.col("shift")).alias("start_line"), (F.col("end_line") + F.col("shift")).alias("end_line"), "depth")
    inner = regions.innermost(changed.where("change_type <> ' '").select(*KEY, "pos", "line_num"), found, KEY)
    scopes = merged_join(regions.distinct_scopes(inner, KEY, "pos"), files.select(*KEY, "lines", "is_new_file"), KEY)
    text = regions.scope_text(F.col("lines"), F.col("start_line"), F.col("end_line"), config.scope_size_limit, F.col("is_new_file"))
    scopes = scopes.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first_seen", F.col("scope_type").alias("type"), "name", "start_line", "end_line", text.alias("source")))).alias("s"))
    scopes = scopes.select(*KEY, F.transform("s", lambda s: F.struct(s["type"].alias("type"), s["name"].alias("name"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), s["source"].alias("source"))).alias("scopes"))

    shifted = merged_join(areas, parts.select(*KEY, "file_id", "shift"), KEY).select("file_id", (F.col("start_line") - F.col("shift")).alias("start_line"), (F.col("end_line") - F.col("shift")).alias("end_line"))
    used = keep(code.used_symbols(parsed, shifted), "used")
    homes = projects.nearest(parts.select(*VERSION, "path", "file_id", "language"), projects.projects(sources)).withColumnRenamed("path", "current")
    homes = keep(homes, "homes")  # plain columns from here on: what manifests say stands in many tests below
    meant = keep(projects.meant_files(used, code.imports(parsed), homes, sources, config.third_party_patterns), "meant")
    targets = merged_join(meant.select("place").distinct(), sources.where("text IS NOT NULL").select(projects.place("path").alias("place"), "path", "text", "lines"), "place").withColumn("language", filters.language("path"))
    targets = keep(targets.where(~filters.is_vendored("path", config.third_party_patterns)), "targets")
    tops = code.top_level(code.parsed(targets.select(F.xxhash64("place").alias("file_id"), F.col("place").alias("path"), "language", "text")))
    defined = symbols.definitions(meant.withColumnRenamed("place", "path"), tops, targets.select(F.col("place").alias("path"), "lines"), config.scope_size_limit)
    defined = merged_join(defined.withColumn("path", F.element_at(F.split("path", "\x00"), -1)), parts.select("file_id", *KEY), "file_id")
    defined = defined.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("symbol").alias("name"), F.col("path").alias("file"), "code"))).alias("symbols"))

    around = merged_join(regions.envelope(areas, KEY), regions.line_count(areas, KEY), KEY)
    shown = changed.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "line_num", "change_type", "content"))).alias("d"))
    shown = shown.select(*KEY, F.transform("d", lambda d: F.struct(d["line_num"].alias("line_num"), d["change_type"].alias("change_type"), d["content"].alias("content"))).alias("diff_lines"))
    out = files.select(*KEY, "path", "lines")
    for more in (around, shown, scopes, defined):
        out = merged_join(out, more, KEY, "left")

    def kept(name: str, kind: str):
        return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>")).alias(name)

    return out.select(
        *KEY, "path", regions.region_text(F.col("lines"), F.col("start_line"), F.col("end_line")).alias("expanded_region"), F.coalesce("start_line", F.lit(1)).alias("region_start_line"),
        kept("diff_lines", "struct<line_num:int,change_type:string,content:string>"), kept("scopes", "struct<type:string,name:string,start_line:int,end_line:int,source:string>"),
        kept("symbols", "struct<name:string,file:string,code:string>"), F.coalesce("n_lines", F.lit(0)).alias("n_region_lines"),
    )


def scan(spark: SparkSession, changes: DataFrame, sources: DataFrame, reviewer: Callable[[str], str], config: Config | None = None, baseline: DataFrame | None = None, max_tokens: int | None = None, on_progress: Callable[[str, int, int], None] | None = None) -> Scan:
    """Review all diffs (diff_id, text) against source files (path, text, lines, error), one prompt a file.

    Contexts, prompts, findings and errors are keyed by (diff_id, file_no), so diffs that touch one path stay apart. With columns repo and revision
    in both tables, each diff is read against its own version of the files. Diffs are parsed once. on_progress is called with (file path, files done, files in all).
    """
    config = config or Config()
    ship(spark)
    sources = versioned(sources)
    marked = keep(diffs.marked_lines(changes), "marked")
    reviewed = keep(reviewed_files(marked, _versions(changes), sources, config), "files")
    about = keep(_contexts(marked, reviewed, sources, config), "contexts")
    keyed = about.withColumn("context_id", F.concat_ws(":", "diff_id", "file_no"))
    asked = merged_join(prompts.prompts(keyed, "context_id", "file_no", max_tokens), keyed.select("context_id", *KEY, "path"), "context_id")
    asked = keep(asked.select(*KEY, F.col("path").alias("file_path"), "path", "prompt", "tokens"), "prompts") if on_progress else asked.withColumn("file_path", F.col("path"))
    options = {"concurrent": config.max_concurrent_api_calls, "timeout": float(config.timeout)}
    calls = asked.select(*KEY, "file_path", "prompt")
    if on_progress:
        total = calls.count()
        calls = calls.repartition(max(spark.sparkContext.defaultParallelism, -(-total // PROMPTS)), *KEY)  # progress is told by task
        with review.Progress(spark, total, on_progress) as progress:
            got = keep(review.reviewed(calls, reviewer, KEY, progress=progress, **options), "findings")
    else:
        got = keep(review.reviewed(calls, reviewer, KEY, **options), "findings")  # calls cost money, so answers are written before use
    good = got.where("error IS NULL").withColumn("finding_id", finding_id("cwe_id", "file_path", "line_start", "what"))
    good = filters.confident(good, config.min_confidence)
    new = findings.suppressed(good, baseline) if baseline is not None else good
    unread = reviewed.where("error IS NOT NULL").select(*KEY, F.col("path").alias("file_path"), "error", F.lit("unreadable").alias("error_type"))
    errors = got.where("error IS NOT NULL").select(*KEY, "file_path", "error", "error_type").unionByName(unread)
    return Scan(about, asked, good, new, errors, findings.blocks(new, dict(config.thresholds)))
