"""Sources of the review: files, diffs, configuration, baselines, scan caches, manifests.

Whatever is data is read by Spark; only a single local repository's diff and its configuration are read on the driver.
"""

from __future__ import annotations

import fnmatch
import subprocess
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions.text import lines
from patchloom.operators.baseline import ENTRY

SNIFF = 8192
GIT_SECONDS = 30


class SourceError(Exception):
    """A source that can't be read; the text says why."""


def diffs(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, path, text) of exported diff files, whole."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.xxhash64("path").alias("diff_id"), "path", "text")


#: Bytes of a diff file that a task reads when its lines are read by themselves.
SPLIT_BYTES = 16 << 20


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, block, pos, line) of exported diff files of any size: a file is read in splits, each of them a block, and never held whole."""
    key = "spark.sql.files.maxPartitionBytes"
    reader = spark.newSession()  # the caller's setting stays
    reader.conf.set(key, str(SPLIT_BYTES))
    rows = reader.read.option("lineSep", "\n").text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("diff_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "\r$", "").alias("line"))


def staged_diff(repo: str = ".") -> str:
    """The staged diff of a local repository; bytes that are no UTF-8 are replaced."""
    return _git(repo, "diff", "--cached")


def head_commit(repo: str = ".") -> str | None:
    """The commit that is checked out, None in a repository without one."""
    try:
        return _git(repo, "rev-parse", "HEAD").strip() or None
    except SourceError:
        return None


def branch(repo: str = ".") -> str | None:
    """The branch, None when detached."""
    try:
        name = _git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()
    except SourceError:
        return None
    return None if name in ("", "HEAD") else name


def _git(repo: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=GIT_SECONDS)
    except FileNotFoundError as e:
        raise SourceError("git is not installed") from e
    except subprocess.TimeoutExpired as e:
        raise SourceError(f"git took more than {GIT_SECONDS} seconds") from e
    if done.returncode:
        raise SourceError(done.stderr.decode("utf-8", "replace").strip() or f"git failed with {done.returncode}")
    return done.stdout.decode("utf-8", "replace")


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, lines, error) of files: a NUL byte near the start makes a file binary, an error without text; bytes that are no UTF-8 are replaced. Spark leaves out empty files, of which there is nothing to review."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    is_binary = F.hex(F.substring("content", 1, SNIFF)).rlike("^(..)*?00")
    text = F.when(~is_binary, F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", ""))
    rows = rows.withColumn("text", text).withColumn("error", F.when(is_binary, F.lit("binary file")))
    return rows.select("path", "text", lines("text").alias("lines"), "error")


# --- configuration -------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """Settings, with defaults; two of them are accepted and have no effect yet: symbol_resolution_depth and max_tokens_per_scan."""

    hunk_expansion_lines: int = 50
    scope_size_limit: int = 200
    symbol_resolution_depth: int = 1
    third_party_patterns: tuple[str, ...] = C.VENDOR_PATTERNS
    sensitive_patterns: tuple[str, ...] = ()
    use_default_sensitive_patterns: bool = True
    model: str = "gpt-5.2"
    temperature: float = 0.0
    min_confidence: str = "Low"
    max_tokens_per_scan: int = 0
    max_concurrent_api_calls: int = 5
    timeout: int = 120
    fail_on_error: bool = True
    baseline_path: str = ".patchloom-baseline.json"
    thresholds: Mapping[str, str] = field(default_factory=lambda: dict(C.DEFAULT_ACTIONS))

    def sensitive(self) -> tuple[str, ...]:
        """The globs in force, defaults first."""
        return (*(C.SENSITIVE_GLOBS if self.use_default_sensitive_patterns else ()), *self.sensitive_patterns)


_LEAST = {"hunk_expansion_lines": 0, "scope_size_limit": 0, "symbol_resolution_depth": 0, "max_tokens_per_scan": 0, "max_concurrent_api_calls": 1, "timeout": 1, "temperature": 0}


def _word(value: object, known: tuple[str, ...], name: str) -> str:
    found = {k.lower(): k for k in known}.get(value.strip().lower() if isinstance(value, str) else "")
    if found is None:
        raise SourceError(f"{name}: {value!r} is none of {', '.join(known)}")
    return found


def config_from(text: str) -> Config:
    """Settings from TOML; unknown keys are ignored, names of levels may be in any case, thresholds overlay the defaults one by one."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SourceError(f"the configuration is no TOML: {e}") from e
    out = {}
    for f in fields(Config):
        if f.name not in data:
            continue
        value = data[f.name]
        if f.name == "thresholds":
            if not isinstance(value, dict):
                raise SourceError("thresholds must be a table")
            value = C.DEFAULT_ACTIONS | {_word(k, C.SEVERITIES, "thresholds"): _word(v, ("block", "warn", "allow"), k) for k, v in value.items()}
        elif f.name == "min_confidence":
            value = _word(value, C.CONFIDENCES, f.name)
        elif f.name.endswith("patterns") and f.name != "use_default_sensitive_patterns":
            if not (isinstance(value, list) and all(isinstance(v, str) for v in value)):
                raise SourceError(f"{f.name} must be a list of texts")
            value = tuple(value)
        elif isinstance(f.default, bool) or isinstance(f.default, str):
            if not isinstance(value, type(f.default)):
                raise SourceError(f"{f.name} must be a {type(f.default).__name__}")
        elif isinstance(value, bool) or not isinstance(value, int | (float if isinstance(f.default, float) else int)):
            raise SourceError(f"{f.name} must be a number")
        if f.name in _LEAST and value < _LEAST[f.name] or f.name == "temperature" and value > 2:
            raise SourceError(f"{f.name} is out of range: {value}")
        if f.name == "model" and not value.strip():
            raise SourceError("model is blank")
        out[f.name] = value
    return Config(**out)


def find_config(start: str, name: str = ".patchloom.toml") -> Config:
    """The settings in the nearest file of that name at or above a folder; defaults where there is none."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / name).is_file():
            return config_from((folder / name).read_text("utf-8"))
    return Config()


# --- baselines and caches --------------------------------------------------------------------------------------------------------------

_ENTRIES = "version string, entries array<struct<" + ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in ENTRY.split(", ")) + ">>"


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline file; a blank or missing one has none, one that lacks a required field or is no baseline raises an error when it is read."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ENTRY)
        raise
    data = F.from_json("value", _ENTRIES)
    entries = data["entries"]
    none = F.array().cast("array<struct<" + ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in ENTRY.split(", ")) + ">>")
    blank = F.regexp_replace("value", r"\s", "") == ""  # in the expression itself: a filter before it may be evaluated after it
    rows = text.select(F.when(blank, none).when(entries.isNotNull(), entries).otherwise(F.raise_error(F.lit("not a baseline"))).alias("e"))
    rows = rows.select(F.inline("e"))
    complete = F.lit(True)
    for c in ("finding_id", "cwe_id", "code_hash", "reason", "added_at"):
        complete = complete & F.col(c).isNotNull()
    return rows.select(*[F.when(complete, F.col(c)).otherwise(F.raise_error(F.lit("a baseline entry lacks a required field"))).alias(c) for c in rows.columns])


def scan_cache(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the last scan with ``ord``; what can't be parsed gives none."""
    schema = "scan_time string, findings array<struct<finding_id: string, cwe_id: string, what: string, file_path: string, severity: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d"))
    return rows.select(F.posexplode("d.findings").alias("ord", "f")).select("ord", "f.*")


# --- manifests: columns on the text of a file --------------------------------------------------------------------------------------------


def npm_name(text: Column) -> Column:
    return F.get_json_object(text, "$.name")


def npm_workspaces(text: Column) -> Column:
    """Workspaces in list form."""
    return F.from_json(F.get_json_object(text, "$.workspaces"), "array<string>")


def java_base_package(pom: Column, gradle: Column, root_folders: Column) -> Column:
    """groupId of a pom's project itself, else the group of a Gradle file, else the folders below the source root."""
    own = pom
    for inner in ("parent", "dependencies", "dependencyManagement", "build", "profiles", "reporting", "plugins"):  # groups of others
        own = F.regexp_replace(own, rf"(?s)<{inner}\b[^>]*+>.*?</{inner}>", "")
    own = F.regexp_replace(own, r"(?s)<!--.*?-->", "")
    group = F.nullif(F.regexp_extract(own, r"(?s)<project\b.*?<groupId>\s*([^<\s]+)\s*</groupId>", 1), F.lit(""))
    gradle_group = F.nullif(F.regexp_extract(gradle, r"""(?m)^\s*group\s*=?\s*["']([^"']+)["']""", 1), F.lit(""))
    return F.coalesce(group, gradle_group, root_folders)


def go_module(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^module\s+(\S+)", 1), F.lit(""))


def gemfile_gems(text: Column) -> Column:
    """Distinct gem names, null for none."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"""gem\s+["']([^"']+)["']"""), F.lit(1)))
    return F.when(F.size(found) > 0, found)


def composer_prefixes(text: Column) -> Column:
    """map of namespace prefix to folder from autoload and autoload-dev, the latter first in rank; of several folders the first."""

    def of(key: str) -> Column:
        raw = F.from_json(F.get_json_object(text, f"$['{key}']['psr-4']"), "map<string,string>")
        first = F.transform_values(raw, lambda k, v: F.coalesce(F.get(F.from_json(v, "array<string>"), F.lit(0)), v))
        return F.coalesce(first, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))

    main, dev = of("autoload"), of("autoload-dev")
    return F.map_concat(F.map_filter(main, lambda k, v: ~F.map_contains_key(dev, k)), dev)


def mix_app(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\bapp:\s*:(\w+)", 1), F.lit(""))


def mix_dependencies(text: Column) -> Column:
    """Names in the first block of dependencies, null without one."""
    block = F.regexp_extract(text, r"(?s)\bdefp?\s+deps\b.*?\bdo\b(.*?)\bend\b", 1)
    return F.when(block != "", F.array_distinct(F.regexp_extract_all(block, F.lit(r"\{\s*:(\w+)"), F.lit(1))))


# Marks of frameworks: a file that must be there, and what its text must hold.
FRAMEWORK_MARKS = {
    "django": (("manage.py", None),), "flask": tuple((f, "Flask(__name__)") for f in ("app.py", "wsgi.py", "application.py")), "fastapi": tuple((f, "FastAPI(") for f in ("main.py", "app.py", "asgi.py")),
    "rails": (("config/application.rb", None),), "laravel": (("artisan", None),), "wordpress": (("wp-config.php", None), ("*.php", "Plugin Name:"), ("style.css", "Theme Name:")), "phoenix": (("mix.exs", "{:phoenix,"),),
}


def frameworks(files: DataFrame) -> DataFrame:
    """(project, path, text) to one row per project with a flag for each framework."""
    flags = []
    for name, marks in FRAMEWORK_MARKS.items():
        test = F.lit(False)
        for path, mark in marks:
            here = F.col("path").rlike(r"^[^/]+\.php$") if path == "*.php" else F.col("path") == path
            test = test | (here & F.contains(F.left("text", F.lit(4096)), F.lit(mark)) if mark else here)
        flags.append(F.coalesce(F.bool_or(test), F.lit(False)).alias(name))
    return files.groupBy("project").agg(*flags)


# Files that make a package a Django app.
DJANGO_APP_FILES = ("models.py", "views.py", "admin.py", "forms.py", "urls.py", "apps.py", "serializers.py")


def django_apps(files: DataFrame) -> DataFrame:
    """(project, path, ...) to (project, app): packages at the top or one level below it that hold a file of an app, with dots between levels."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]+$", "")
    near = files.select("project", name.alias("name"), folder.alias("folder")).where("folder <> '' AND size(split(folder, '/')) <= 2")
    found = near.groupBy("project", "folder").agg(F.bool_or(F.col("name") == "__init__.py").alias("package"), F.bool_or(F.col("name").isin(*DJANGO_APP_FILES)).alias("app"))
    return found.where("package AND app").select("project", F.replace("folder", F.lit("/"), F.lit(".")).alias("app"))


def glob_matches(path: str, pattern: str) -> bool:
    """The driver's own test of a path against a glob, as the column functions have it."""
    low, pattern = path.lower(), pattern.lower()
    if "/" in pattern:
        return fnmatch.fnmatchcase(low, pattern) or fnmatch.fnmatchcase(low, f"*/{pattern}")
    return fnmatch.fnmatchcase(low.rsplit("/", 1)[-1], pattern)
