"""Code operators as tables: one parse of each file, then scopes, imports, names, their files and their definitions by relational steps.

Sources are (file_id, path, language, text). Only ``parsed`` runs Python; all else is joins and column expressions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions.text import camel_case, snake_case
from patchloom.operators import code_names, symbols
from patchloom.operators.code_parse import Import, parse
from patchloom.operators.filters import any_of
from patchloom.shared import merged_join

PARSED = (
    "file_id long, path string, language string, scopes array<struct<scope_type string, name string, start_line int, end_line int, depth int>>, "
    "imports array<struct<module string, names array<string>, alias string, name_aliases array<struct<original string, alias string>>, is_star boolean, is_relative boolean, level int>>, "
    "symbols array<struct<line int, name string, role string>>, top_level array<struct<name string, start_line int, end_line int>>"
)


#: Files, and characters of them, whose parse a task holds at once.
FILES, CHARS = 256, 1 << 20
#: Tasks of a parse for each core: a parse costs far more than moving its text, and a table may come in few files, or small ones that were joined.
TASKS = 3
_STRINGS = pa.list_(pa.string())
_ALIASES = pa.list_(pa.struct([("original", pa.string()), ("alias", pa.string())]))
_SCOPE = [("scope_type", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("depth", pa.int32())]
_IMPORT = [("module", pa.string()), ("names", _STRINGS), ("alias", pa.string()), ("name_aliases", _ALIASES), ("is_star", pa.bool_()), ("is_relative", pa.bool_()), ("level", pa.int32())]
_SYMBOL = [("line", pa.int32()), ("name", pa.string()), ("role", pa.string())]
_TOP_LEVEL = [("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]


def _structs(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """An array of structs for each file, built column by column."""
    flat = [x for r in rows for x in r]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)], fields=[pa.field(n, t) for n, t in fields])
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, rows))], type=pa.int32()), structs)


def _imported(i: Import) -> tuple:
    return i.module, i.names, i.alias, [{"original": o, "alias": a} for o, a in i.name_aliases], i.is_star, i.is_relative, i.level


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most FILES files that end where CHARS are passed."""
    at, chars = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        chars += n or 0
        if k + 1 - at == FILES or chars > CHARS:
            yield batch.slice(at, k + 1 - at)
            at, chars = k + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def parsed(sources: DataFrame) -> DataFrame:
    """Each file with all that its parser finds; a file that can't be parsed has empty arrays, a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(map(_portions, batches)):
            found = [parse(lang or "", text or "") for lang, text in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            columns = [
                _structs([p.scopes for p in found], _SCOPE), _structs([[_imported(i) for i in p.imports] for p in found], _IMPORT),
                _structs([p.symbols for p in found], _SYMBOL), _structs([p.top_level for p in found], _TOP_LEVEL),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("file_id", "path", "language")] + columns, ["file_id", "path", "language", "scopes", "imports", "symbols", "top_level"])

    spread = sources.select(F.col("file_id").cast("long").alias("file_id"), "path", "language", "text")
    return spread.repartition(TASKS * sources.sparkSession.sparkContext.defaultParallelism, "file_id").mapInArrow(run, PARSED)


def scopes(parsed_: DataFrame) -> DataFrame:
    """file_id, scope_type, name, start_line, end_line, depth."""
    return parsed_.select("file_id", F.inline("scopes"))


def imports(parsed_: DataFrame) -> DataFrame:
    """file_id, ord (place in the source), and the columns of an import."""
    return parsed_.select("file_id", F.posexplode("imports").alias("ord", "i")).select("file_id", "ord", "i.*")


def top_level(parsed_: DataFrame) -> DataFrame:
    """path, name, start_line, end_line of what a file declares at its top."""
    return parsed_.select("path", F.inline("top_level"))


def used_symbols(parsed_: DataFrame, regions: DataFrame, builtins: bool = False) -> DataFrame:
    """Distinct (file_id, symbol) used in a region (file_id, start_line, end_line) and not defined in the same one; built-in names only with ``builtins``."""
    rows = merged_join(parsed_.select("file_id", "language", "symbols"), regions, "file_id").select("file_id", "language", "start_line", "end_line", F.inline("symbols"))
    named = rows.where(F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy("file_id", "language", "start_line", "end_line", F.col("name").alias("symbol"))
    left = named.agg(F.max(F.col("role") == "use").alias("used"), F.max(F.col("role") == "definition").alias("defined")).where("used and not defined")
    left = left.select("file_id", "language", "symbol").distinct()
    if not builtins:
        left = left.where(~is_builtin(F.col("language"), F.col("symbol")))
    return left.select("file_id", "symbol")


def is_builtin(language: Column, symbol: Column) -> Column:
    """Whether a language has a name built in."""
    out = F.lit(False)
    for name in ("python", "javascript", "typescript", "java", "go", "ruby", "php", "elixir"):
        out = F.when(language == name, symbol.isin(*sorted(code_names.names(name)))).otherwise(out)
    return out


# --- where an import leads ------------------------------------------------------------------------------------------------------------

# Suffixes that an import may leave out, and folders that frameworks load classes from.
JS_ENDS = (".js", ".mjs", ".cjs", ".jsx")
TS_ENDS = (".ts", ".tsx", ".mts", ".cts", *JS_ENDS)
LARAVEL_FOLDERS = ("app/Models", "app/Http/Controllers", "app/Http/Middleware", "app/Services", "app/Providers", "app/Jobs", "app/Events", "app/Listeners", "app/Mail")
RAILS_FOLDERS = ("app/models", "app/controllers", "app/mailers", "app/jobs", "app/helpers", "app/services", "app/channels", "app/serializers", "app/components", "app/policies", "app/decorators", "app/validators", "app")


def normal_path(path: Column) -> Column:
    """A path without ``.`` parts and with ``..`` parts resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    keep = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when((p == "..") & (F.size(s) > 0), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(F.array_append(s, p)))
    return F.array_join(keep, "/")


def folder(path: Column, up: Column | int = 0) -> Column:
    """The folder of a file, or one so many levels higher; empty for the top."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1 - up, F.lit(0))), "/")


def _under(base: Column, name: Column) -> Column:
    return F.when(base == "", name).otherwise(F.concat(base, F.lit("/"), name))


def candidates(language: Column, module: Column, is_relative: Column, level: Column, current: Column) -> Column:
    """The paths that an import of a module may mean, the likeliest first; Go, PHP by namespace and Elixir's umbrellas are in their own functions."""

    def each(base: Column, ends: tuple[str, ...]) -> list[Column]:
        return [F.concat(base, F.lit(e)) for e in ends]

    dotted = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = folder(current, F.greatest(level - 1, F.lit(0)))
    beside = F.when(dotted == "", up).otherwise(_under(up, dotted))
    python = F.when(is_relative, F.array(*each(beside, (".py", "/__init__.py")))).otherwise(F.array(*each(dotted, (".py", "/__init__.py")), *each(F.concat(F.lit("src/"), dotted), (".py", "/__init__.py"))))
    near = normal_path(_under(folder(current), module))

    def script(ends: tuple[str, ...]) -> Column:
        def around(path: Column, bare: Column) -> Column:
            return F.array(path, *each(bare, ends), *each(path, tuple(f"/index{e}" for e in ends)))

        known = F.transform(F.array(near), lambda p: F.struct(p.alias("path"), F.regexp_replace(p, r"\.[^./]+$", "").alias("bare")))  # worked out once for all candidates
        return F.when(is_relative, F.get(F.transform(known, lambda k: around(k["path"], k["bare"])), F.lit(0))).otherwise(F.array().cast("array<string>"))

    slashes = F.replace(module, F.lit("."), F.lit("/"))
    java = F.array(*[F.concat(F.lit(p), slashes, F.lit(".java")) for p in ("src/main/java/", "src/test/java/", "src/", "")])
    ruby = F.when(is_relative, F.array(F.concat(F.regexp_replace(near, r"\.rb$", ""), F.lit(".rb")))).otherwise(
        F.array(*[F.concat(F.lit(p), module, F.lit(e)) for p, e in (("lib/", ".rb"), ("", ".rb"), ("app/", ".rb"), ("lib/", "/init.rb"))]))
    php_name = F.replace(module, F.lit("\\"), F.lit("/"))
    php = F.when(is_relative, F.array(normal_path(_under(folder(current), F.ltrim(module, F.lit("/")))))).otherwise(F.array(*[F.concat(F.lit(p), php_name, F.lit(".php")) for p in ("src/", "app/", "lib/", "")]))
    elixir_name = elixir_path(module)
    elixir = F.array(F.concat(F.lit("lib/"), elixir_name, F.lit(".ex")), F.concat(elixir_name, F.lit(".ex")))
    none = F.array().cast("array<string>")
    return (
        F.when(language == "python", python).when(language == "javascript", script(JS_ENDS)).when(language == "typescript", script(TS_ENDS))
        .when(language == "java", java).when(language == "ruby", ruby).when(language == "php", php).when(language == "elixir", elixir).otherwise(none)
    )


def elixir_path(module: Column) -> Column:
    """``MyApp.Accounts.User`` as ``my_app/accounts/user``."""
    return F.array_join(F.transform(F.split(module, r"\."), snake_case), "/")


def resolved_files(resolved: DataFrame, parsed_: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, symbol, original, path): for each resolved import the first of its candidates that is a file (path)."""
    rows = merged_join(resolved, parsed_.select("file_id", F.col("path").alias("current"), "language"), "file_id")
    paths = candidates(F.col("language"), F.col("module"), F.col("is_relative"), F.col("level"), F.col("current"))
    return symbols.first_existing(rows, paths, files, ["file_id", "symbol", "original"])


def go_package_files(imports_: DataFrame, go_module: str, files: DataFrame) -> DataFrame:
    """(file_id, module, path): the first file by name, tests aside, of each imported package of the module itself."""
    own = imports_.where((F.col("module") == go_module) | F.startswith("module", F.lit(f"{go_module}/")))
    own = own.select("file_id", "module", F.substring("module", len(go_module) + 2, 1 << 30).alias("folder"))
    go = files.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select("path", folder(F.col("path")).alias("folder"))
    return merged_join(own, go, "folder").groupBy("file_id", "module").agg(F.min("path").alias("path"))


def php_namespace_files(imports_: DataFrame, psr4: dict[str, str], files: DataFrame) -> DataFrame:
    """(file_id, module, path): files by namespace prefixes, in their order, then by the usual folders."""
    module = F.col("module")
    tail = [F.when(F.startswith(module, F.lit(p)), F.concat(F.lit(d.rstrip("/") + "/"), F.replace(F.substring(module, len(p) + 1, 1 << 30), F.lit("\\"), F.lit("/")), F.lit(".php"))) for p, d in psr4.items()]
    usual = [F.concat(F.lit(p), F.replace(module, F.lit("\\"), F.lit("/")), F.lit(".php")) for p in ("src/", "app/", "lib/", "")]
    return symbols.first_existing(imports_, F.array_compact(F.array(*tail, *usual)), files, ["file_id", "module"])


def framework_candidates(framework: str, name: Column) -> Column:
    """The paths at which a framework (rails, laravel or phoenix) loads a class by itself."""
    if framework == "rails":
        paths = [F.concat(F.lit(f"{d}/"), snake_case(name), F.lit(".rb")) for d in RAILS_FOLDERS]
    elif framework == "laravel":
        paths = [F.concat(F.lit(f"{d}/"), name, F.lit(".php")) for d in LARAVEL_FOLDERS]
    else:
        web = snake_case(F.get(F.split(name, r"\."), F.lit(0)))
        rest = F.array_join(F.transform(F.slice(F.split(name, r"\."), F.lit(2), F.lit(64)), snake_case), "/")
        first = F.get(F.split(name, r"\."), F.lit(1))
        kinds = (("Controller", "controllers"), ("Live", "live"), ("Components", "components"), ("Component", "components"), ("View", "views"), ("Channel", "channels"))
        paths = [F.when(F.endswith(first, F.lit(end)), F.concat(F.lit("lib/"), web, F.lit(f"/{d}/"), rest, F.lit(".ex"))) for end, d in kinds]
        paths = [F.when(F.endswith(F.get(F.split(name, r"\."), F.lit(0)), F.lit("Web")), p) for p in [*paths, F.concat(F.lit("lib/"), web, F.lit("/"), rest, F.lit(".ex"))]]
    return F.array_compact(F.array(*paths))


def framework_files(wanted: DataFrame, framework: str, files: DataFrame) -> DataFrame:
    """(file_id, symbol, path): a class without an import in the folders that a framework loads by itself: rails, laravel or phoenix."""
    return symbols.first_existing(wanted, framework_candidates(framework, F.col("symbol")), files, ["file_id", "symbol"])


def is_first_party(language: Column, module: Column, is_relative: Column, exists: Column, project: Column, patterns: tuple[str, ...] = C.VENDOR_PATTERNS) -> Column:
    """Whether a module belongs to the project: never the standard library or a pattern, always a relative import, else by the language's rule.

    exists: whether the module leads to a file of the project. project: struct<package, namespaces array, dependencies array>, the
    project's own name (npm name, base package, go.mod module, mix app), its PSR-4 prefixes or workspaces, and its gems or deps.
    """
    vendored = any_of([F.contains(module, F.lit(p)) for p in patterns])
    package, spaces, deps = project["package"], F.coalesce(project["namespaces"], F.array().cast("array<string>")), F.coalesce(project["dependencies"], F.array().cast("array<string>"))
    head = F.get(F.split(module, r"\."), F.lit(0))
    python = ~head.isin(*sorted(code_names.python_modules())) & exists & ~vendored
    script = (module == package) | F.array_contains(spaces, module) | F.startswith(module, F.concat(package, F.lit("/")))
    platform = any_of([F.startswith(module, F.lit(p)) for p in code_names.JAVA_PREFIXES])
    java = ~platform & (F.startswith(module, F.concat(package, F.lit("."))) | exists)
    go = F.contains(module, F.lit(".")) & ~vendored & ((module == package) | F.startswith(module, F.concat(package, F.lit("/"))))
    ruby = ~module.isin(*code_names.RUBY_MODULES) & ~vendored & ~F.array_contains(deps, module) & exists
    php = ~vendored & F.exists(spaces, lambda s: F.startswith(module, s))
    own = camel_case(package)
    elixir = ~F.startswith(module, F.lit(":")) & ~module.isin(*sorted(code_names.names("elixir"))) & ~vendored & ~F.exists(deps, lambda d: camel_case(d) == head)
    in_own = (module == own) | F.startswith(module, F.concat(own, F.lit(".")))
    in_web = F.array_contains(deps, F.lit("phoenix")) & ((module == F.concat(own, F.lit("Web"))) | F.startswith(module, F.concat(own, F.lit("Web."))))
    rule = (
        F.when(language == "python", python).when(language.isin("javascript", "typescript"), script).when(language == "java", java)
        .when(language == "go", go).when(language == "ruby", ruby).when(language == "php", php).when(language == "elixir", elixir & (in_own | in_web))
    )
    return F.coalesce(F.when(is_relative & ~language.isin("java", "go"), F.lit(True)).otherwise(rule), F.lit(False))
