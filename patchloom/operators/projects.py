"""Projects in trees of files: folders with a manifest, what it says, the project that each file belongs to, and the files that names lead to.

Everything is keyed by repository and revision, so many repositories, versions and nested projects are one run. A file belongs to the nearest
folder above it that has a manifest of its language: its folders are written out and joined to those of the manifests, and the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.text import camel_case
from patchloom.operators import code, symbols
from patchloom.shared import merged_join
from patchloom.sources import files as M

VERSION = ["repo", "revision"]
#: The family of languages that a manifest is for, and files that mark a framework.
MANIFESTS = {"package.json": "script", "pom.xml": "java", "build.gradle": "java", "go.mod": "go", "Gemfile": "ruby", "composer.json": "php", "mix.exs": "elixir"}
MARKS = {"config/application.rb": ("ruby", "rails"), "artisan": ("php", "laravel")}
FACTS = ("root string, package string, namespaces array<string>, dependencies array<string>, prefixes map<string,string>, framework string")


def versioned(df: DataFrame) -> DataFrame:
    """``df`` with repo and revision, empty where it has none."""
    for c in VERSION:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(""))
    return df


def family(language: Column) -> Column:
    return F.when(language.isin("javascript", "typescript", "vue", "svelte", "astro"), F.lit("script")).otherwise(language)


def projects(sources: DataFrame) -> DataFrame:
    """(repo, revision, path, text) to one row per folder and family of languages that has a manifest or a mark: repo, revision, family, and FACTS."""
    name = F.element_at(F.split("path", "/"), -1)
    kinds = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    manifests = sources.where(name.isin(*MANIFESTS)).select(*VERSION, code.folder(F.col("path")).alias("root"), F.try_element_at(kinds, name).alias("family"), name.alias("name"), "text")
    for path, (kind, mark) in MARKS.items():
        here = sources.where((F.col("path") == path) | F.endswith("path", F.lit(f"/{path}")))
        root = F.regexp_replace(F.left("path", F.char_length("path") - len(path)), "/$", "")
        manifests = manifests.unionByName(here.select(*VERSION, root.alias("root"), F.lit(kind).alias("family"), F.lit(f"#{mark}").alias("name"), F.lit("").alias("text")))
    text = {n: F.max(F.when(F.col("name") == n, F.col("text"))).alias(f"t{k}") for k, n in enumerate([*MANIFESTS, *(f"#{m}" for _, m in MARKS.values())])}
    rows = manifests.groupBy(*VERSION, "family", "root").agg(*text.values())
    t = {n: F.col(f"t{k}") for k, n in enumerate(text)}
    none = F.lit(None).cast("string")
    package = F.coalesce(M.npm_name(t["package.json"]), M.java_base_package(t["pom.xml"], t["build.gradle"], none), M.go_module(t["go.mod"]), M.mix_app(t["mix.exs"]))
    prefixes = F.when(t["composer.json"].isNotNull(), M.composer_prefixes(t["composer.json"]))
    framework = F.when(t["#rails"].isNotNull(), F.lit("rails")).when(t["#laravel"].isNotNull(), F.lit("laravel")).when(F.contains(t["mix.exs"], F.lit("{:phoenix,")), F.lit("phoenix"))
    return rows.select(
        *VERSION, "family", "root", package.alias("package"), F.coalesce(M.npm_workspaces(t["package.json"]), F.map_keys(prefixes)).alias("namespaces"),
        F.coalesce(M.gemfile_gems(t["Gemfile"]), M.mix_dependencies(t["mix.exs"])).alias("dependencies"), prefixes.alias("prefixes"), framework.alias("framework"),
    )


def nearest(files: DataFrame, found: DataFrame) -> DataFrame:
    """``files`` (repo, revision, path, language) with ``project``, a struct of FACTS: that of the nearest folder above; without one the root is the top and the rest null."""
    keys = [*VERSION, "path", "language"]
    parts = F.split("path", "/")
    above = files.select(*keys).distinct().withColumn("family", family(F.col("language"))).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)))
    above = above.withColumn("root", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    facts = F.struct("root", "package", "namespaces", "dependencies", "prefixes", "framework")
    best = merged_join(above, found.withColumn("facts", facts), [*VERSION, "family", "root"]).groupBy(*keys).agg(F.max_by("facts", "depth").alias("project"))
    out = merged_join(files, best, keys, "left")
    top = F.struct(F.lit(""), *[F.lit(None).cast(kind) for kind in ("string", "array<string>", "array<string>", "map<string,string>", "string")]).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in FACTS.split(', '))}>")
    return out.withColumn("project", F.coalesce("project", top))


def _under(root: Column, path: Column) -> Column:
    return F.when(root == "", path).otherwise(F.concat(root, F.lit("/"), path))


def candidates(row: DataFrame) -> Column:
    """The paths that a name may mean, the likeliest first, of rows with language, module (null without an import), symbol, is_relative, level, current and project."""
    module, project, symbol = F.col("module"), F.col("project"), F.col("symbol")
    root, none = project["root"], F.array().cast("array<string>")
    plain = code.candidates(F.col("language"), module, F.col("is_relative"), F.col("level"), F.col("current"))
    plain = F.when(F.col("is_relative"), plain).otherwise(F.transform(plain, lambda p: _under(root, p)))
    spaces = F.coalesce(F.map_entries(project["prefixes"]), F.array().cast("array<struct<key:string,value:string>>"))
    own = F.filter(spaces, lambda e: F.startswith(module, e["key"]))
    psr4 = F.transform(own, lambda e: _under(root, F.regexp_replace(F.concat(F.regexp_replace(e["value"], "/+$", ""), F.lit("/"), F.replace(F.substr(module, F.char_length(e["key"]) + 1), F.lit("\\"), F.lit("/")), F.lit(".php")), "^/+", "")))
    imported = F.when((F.col("language") == "php") & ~F.col("is_relative"), F.concat(psr4, plain)).otherwise(plain)
    elixir = F.transform(code.candidates(F.lit("elixir"), F.coalesce(module, symbol), F.lit(False), F.lit(0), F.col("current")), lambda p: _under(root, p))

    def loaded(framework: str, name: Column) -> Column:
        return F.transform(code.framework_candidates(framework, name), lambda p: _under(root, p))

    by_rule = F.when(project["framework"] == "rails", loaded("rails", symbol)).when(project["framework"] == "laravel", loaded("laravel", symbol)).otherwise(none)
    web = F.when(project["framework"] == "phoenix", loaded("phoenix", F.coalesce(module, symbol))).otherwise(none)
    return F.when(F.col("language") == "elixir", F.concat(elixir, web)).when(module.isNull(), by_rule).when((F.col("language") == "php") & (project["framework"] == "laravel"), F.concat(imported, by_rule)).otherwise(imported)


def place(path: Column | str) -> Column:
    """One text for a path of a version of a repository."""
    return F.concat_ws("\x00", "repo", "revision", path)


def meant_files(used: DataFrame, imports: DataFrame, files: DataFrame, sources: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(file_id, symbol) to file_id, symbol, original (its name there), place: the file of the project, of the same version, that a used name leads to.

    imports: as from ``code.imports``. files: file_id, repo, revision, current, language, project. sources: repo, revision, path. A name takes the first import that
    binds it and of its candidates the first that exists; a Go package means its first file by name, tests aside; names without an
    import are looked for in the folders that a framework loads. Names of other projects than the file's own lead nowhere.
    """
    lang = merged_join(imports, files.select("file_id", "language"), "file_id")
    last = F.element_at(F.split("module", "/"), -1)
    # A file of Ruby binds the class that it is named after.
    names = F.when((F.col("language") == "ruby") & F.col("names").isNull(), F.array(last, camel_case(last))).otherwise(F.col("names"))
    bound = symbols.resolved_imports(used, lang.withColumn("names", names).where("NOT (language = 'go' AND coalesce(alias, '') IN ('_', '.'))").drop("language"))
    bound = bound.select("file_id", "symbol", "module", "is_relative", "level", "original")
    free = merged_join(used, bound.select("file_id", "symbol"), ["file_id", "symbol"], "left_anti").select("file_id", "symbol", F.lit(None).cast("string").alias("module"), F.lit(False).alias("is_relative"), F.lit(0).alias("level"), F.col("symbol").alias("original"))
    rows = merged_join(bound.unionByName(free), files, "file_id")
    rows = rows.where("module IS NOT NULL OR language = 'elixir' OR project.framework IS NOT NULL")
    rows = rows.withColumn("original", F.when(F.col("language") == "elixir", F.coalesce("module", "symbol")).otherwise(F.col("original")))
    project, module = F.col("project"), F.col("module")
    own = F.when(module.isNull() & (F.col("language") != "elixir"), F.lit(True)).otherwise(code.is_first_party(F.col("language"), F.coalesce(module, "symbol"), F.col("is_relative"), F.lit(True), project, patterns))
    rows = rows.where(own | (F.col("language") == "php") & (project["framework"] == "laravel"))
    there = sources.select(*VERSION, "path").distinct()
    paths = F.transform(candidates(rows), lambda p: F.concat_ws("\x00", "repo", "revision", p))
    found = symbols.first_existing(rows.where("language <> 'go'"), paths, there.select(place("path").alias("path")), ["file_id", "symbol", "original"])
    package = project["package"]
    folder = F.when(module == package, project["root"]).otherwise(_under(project["root"], F.substr(module, F.char_length(package) + 2)))
    go = rows.where("language = 'go'").select("file_id", "symbol", "original", *VERSION, folder.alias("folder"))
    listed = there.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).groupBy(*VERSION, code.folder(F.col("path")).alias("folder")).agg(F.min("path").alias("path"))
    go = merged_join(go, listed, [*VERSION, "folder"]).select("file_id", "symbol", "original", place("path").alias("path"))
    return found.unionByName(go).withColumnRenamed("path", "place")
