"""Which files of a diff are reviewed: language, vendored, generated and sensitive files. All tests are column expressions, so Spark joins them into one filter."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions.text import mean_line_length


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def any_of(tests: Sequence[Column]) -> Column:
    """Whether any of the tests holds, as a balanced tree: a chain of many would nest too deep for the compiler of plans."""
    tests = list(tests)
    if len(tests) < 2:
        return tests[0] if tests else F.lit(False)
    half = len(tests) // 2
    return any_of(tests[:half]) | any_of(tests[half:])


def language(path: Column | str) -> Column:
    """Language of a path, null for none: compound suffix first, then the last suffix in lower case, then the whole name. Hidden files have no suffix."""
    path = _col(path)
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in C.LANGUAGE_BY_SUFFIX.items() for x in kv])
    by_name = F.create_map(*[F.lit(x) for kv in C.LANGUAGE_BY_NAME.items() for x in kv])
    out = F.coalesce(F.try_element_at(known, suffix), F.try_element_at(by_name, base_name(path)))
    for end, name in C.LANGUAGE_BY_COMPOUND_SUFFIX.items():
        out = F.when(F.endswith(F.lower(path), F.lit(end)), F.lit(name)).otherwise(out)
    return out


def is_vendored(path: Column | str, patterns: Sequence[str] = C.VENDOR_PATTERNS) -> Column:
    """Whether a path begins with a pattern or has it after a slash, so ``log/`` does not match ``blog/``."""
    if not patterns:
        return F.lit(False)
    # One expression over the patterns: written out, their negation becomes a chain too deep for the compiler of plans.
    whole = F.concat(F.lit("/"), _col(path))
    return F.exists(F.array(*[F.lit(f"/{p}") for p in patterns]), lambda p: F.contains(whole, p))


def glob_regex(pattern: str) -> str:
    """The Java and RE2 pattern of a shell glob in which ``*`` also matches slashes; a pattern with a slash may begin after any folder."""
    low = pattern.lower()
    core = fnmatch.translate(low).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z").replace("(?>", "(?:")
    return f"(?s)^(?:.*/)?{core}$" if "/" in low else f"(?s)^(?:.*/)?{_without_slash(core)}$"


def _without_slash(core: str) -> str:
    """A pattern for base names: nothing in it may match a slash."""
    return core.replace(".*?", "[^/]*").replace(".*", "[^/]*")


def sensitive_pattern(path: Column | str, patterns: Sequence[str] = C.SENSITIVE_GLOBS) -> Column:
    """The first glob, in their order, that a path matches without regard to case, or null.

    Globs without a star are names (or the ends of paths), looked up whole; those with one star are looked up by the beginning or the end of
    the name, of each length that occurs, in hashed sets. What each lookup finds is the place of a glob, and the least place wins. Only globs of other
    forms (two stars with something before or after, question marks, sets) are tested one by one, the usual two-star form by ``contains``.
    """
    found = _lookups(path, patterns)
    if not found:
        return F.lit(None).cast("string")
    places = [F.when(hit, place) for hit, place in found]
    return F.get(F.array(*[F.lit(p) for p in patterns]), places[0] if len(places) == 1 else F.least(*places))


def is_sensitive(path: Column | str, patterns: Sequence[str] = C.SENSITIVE_GLOBS) -> Column:
    """Whether any glob matches a path: the tests of ``sensitive_pattern`` without their places."""
    return any_of([hit for hit, _ in _lookups(path, patterns)])


def _lookups(path: Column | str, patterns: Sequence[str]) -> list[tuple[Column, Column]]:
    """(test, least place of a glob that it stands for)."""
    low = F.lower(_col(path))
    name = F.substring_index(low, "/", -1)
    whole: dict[int, dict[str, int]] = {}  # parts of the path: text: place
    ends: dict[tuple[int, int], dict[str, int]] = {}  # lengths of beginning and end: text: place
    found: list[tuple[Column, Column]] = []
    for place, pattern in enumerate(patterns):
        glob = pattern.lower()
        stars, plain = glob.count("*"), not set("?[") & set(glob)
        if plain and not stars:
            whole.setdefault(glob.count("/") + 1, {}).setdefault(glob, place)
        elif plain and stars == 1 and "/" not in glob:
            before, after = glob.split("*")
            ends.setdefault((len(before), len(after)), {}).setdefault(f"{before}*{after}", place)
        elif plain and stars == 2 and "/" not in glob and glob[0] == glob[-1] == "*":
            found.append((F.contains(name, F.lit(glob[1:-1])), F.lit(place)))
        else:
            found.append((low.rlike(glob_regex(pattern)), F.lit(place)))

    def looked_up(key: Column, places: dict[str, int], possible: Column | None = None) -> tuple[Column, Column]:
        test = key.isin(*places)
        return (test if possible is None else possible & test), F.try_element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), key)

    for parts, places in whole.items():
        found.append(looked_up(F.substring_index(low, "/", -parts), places))
    for (a, b), places in ends.items():
        found.append(looked_up(F.concat(F.left(name, F.lit(a)), F.lit("*"), F.right(name, F.lit(b))), places, F.char_length(name) >= a + b))
    return found


def sensitive_split(files: DataFrame, patterns: Sequence[str] = C.SENSITIVE_GLOBS) -> DataFrame:
    """``files`` with ``matched_pattern``: null for files that are kept."""
    return files.withColumn("matched_pattern", sensitive_pattern("path", patterns))


def _begins(lines: Column, marks: Sequence[str], first: int) -> Column:
    head = F.slice(lines, F.lit(1), F.lit(first))
    return F.exists(head, lambda x: _any(F.startswith(F.trim(x), F.lit(m)) for m in marks))


def _any(tests) -> Column:
    return any_of(list(tests))


def is_generated(path: Column | str, lines: Column | str, language_: Column | str) -> Column:
    """Whether a file is generated, from its path and the first lines of it, by language."""
    path, lines, lang = _col(path), F.slice(_col(lines), F.lit(1), F.lit(C.HEAD_LINES)), _col(language_)
    low, name = F.lower(path), base_name(path)
    long_lines = mean_line_length(lines) > C.LONG_LINES

    def ends(text: Column, suffixes: Sequence[str]) -> Column:
        return _any(F.endswith(text, F.lit(s)) for s in suffixes)

    def has(text: Column, parts: Sequence[str]) -> Column:
        return _any(F.contains(text, F.lit(p)) for p in parts)

    django = F.contains(path, F.lit("/migrations/")) & F.endswith(path, F.lit(".py")) & F.exists(F.slice(lines, F.lit(1), F.lit(10)), lambda x: F.contains(x, F.lit(C.DJANGO_MARK)))
    content = F.filter(F.transform(lines, F.trim), lambda x: (x != "") & ~F.startswith(x, F.lit("//go:build")) & ~F.startswith(x, F.lit("// +build")))
    go_header = F.coalesce(F.get(content, F.lit(0)).rlike(C.GO_HEADER), F.lit(False))
    php_head = F.slice(lines, F.lit(1), F.lit(5))
    return F.coalesce(
        F.when(lang == "python", django | _begins(lines, C.PYTHON_MARKS, 5))
        .when(lang == "javascript", ends(low, C.MINIFIED_SUFFIXES) | long_lines)
        .when(lang == "typescript", (ends(low, C.DECLARATION_SUFFIXES) & _begins(lines, C.DECLARATION_MARKS, 5)) | long_lines)
        .when(lang == "java", has(low, C.JAVA_SEGMENTS) | _begins(lines, C.JAVA_MARKS, 20))
        .when(lang == "ruby", F.endswith(path, F.lit("db/schema.rb")) | _begins(lines, C.RUBY_MARKS, 5))
        .when(lang == "go", ends(name, C.GO_SUFFIXES) | (F.startswith(name, F.lit("mock_")) & F.endswith(name, F.lit(".go"))) | go_header)
        .when(lang == "php", has(low, C.PHP_SEGMENTS) | F.exists(php_head, lambda x: has(x, C.PHP_MARKS)))
        .when(lang == "elixir", _begins(lines, C.ELIXIR_MARKS, 5) | long_lines)
        .when(lang.isin("vue", "svelte", "astro", "html"), long_lines),
        F.lit(False),
    )


def analyzable(files: DataFrame, vendor: Sequence[str] = C.VENDOR_PATTERNS, sensitive: Sequence[str] = C.SENSITIVE_GLOBS) -> DataFrame:
    """Files to review, with their language: (path, lines, is_binary, is_deleted, ...) that are neither binary, deleted, of no known language, vendored, generated nor sensitive.

    The cheap tests on the path come first in the plan; ``lines`` may be null for a file that can't be read.
    """
    kept = files.where(~F.col("is_binary") & ~F.col("is_deleted")).withColumn("language", language("path"))
    kept = kept.where(F.col("language").isNotNull() & ~is_vendored("path", vendor) & ~is_sensitive("path", sensitive))
    return kept.where(~is_generated("path", F.coalesce("lines", F.array().cast("array<string>")), "language"))


def keep_paths(files: DataFrame, kept: DataFrame) -> DataFrame:
    """The files whose path is in ``kept``."""
    return files.join(kept.select("path").distinct(), "path", "left_semi")


def confident(findings: DataFrame, least: str) -> DataFrame:
    """Findings of at least a confidence; an unknown one counts as the lowest."""
    names = F.array(*[F.lit(c) for c in C.CONFIDENCES])
    rank = F.array_position(names, F.col("confidence"))
    rank = F.when(rank == 0, len(C.CONFIDENCES)).otherwise(rank)
    return findings.where(rank <= C.CONFIDENCES.index(least) + 1)
