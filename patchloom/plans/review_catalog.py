"""Queries on whole reviews and on what surrounds them: diffs of many files, manifests, frameworks, failing reviewers, reports. Every document gives one project, with its number in names."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions import text as X
from patchloom.operators import code, components, diffs, filters, regions, reports, review, symbols
from patchloom.plans import scan
from patchloom.plans.code_catalog import _filled, _values, _with_id
from patchloom.shared import new_path
from patchloom.sources import files as M
from patchloom.sources.files import Config
from patchloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _expected(select: str, rows: list[tuple], columns: str) -> str:
    return f"SELECT {select} FROM documents, {_values(rows, columns)}"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id")


# --- diffs of several files and hunks ----------------------------------------------------------------------------------------------

DIFF = r"""diff --git a/src/a__ID__.py b/src/a__ID__.py
index 1..2 100644
--- a/src/a__ID__.py
+++ b/src/a__ID__.py
@@ -1,3 +1,4 @@ def f():
 one
-two
+zwei __ID__
+drei
 three
@@ -20 +21,0 @@
-gone
\ No newline at end of file
diff --git a/old__ID__.txt b/new__ID__.txt
similarity index 100%
rename from old__ID__.txt
rename to new__ID__.txt
diff --git a/gone.js b/gone.js
deleted file mode 100644
--- a/gone.js
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/i.png b/i.png
new file mode 100644
Binary files /dev/null and b/i.png differ
diff --git a/run.sh b/run.sh
old mode 100644
new mode 100755
diff --git "a/d\303\251\t__ID__.txt" "b/d\303\251\t__ID__.txt"
--- "a/d\303\251\t__ID__.txt"
+++ "b/d\303\251\t__ID__.txt"
@@ -1 +1 @@
-x
+y
diff --git a/fresh.py b/fresh.py
new file mode 100644
--- /dev/null
+++ b/fresh.py
@@ -0,0 +1,2 @@
+p
+q
"""


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select(F.col("doc_id").alias("diff_id"), _filled(DIFF).alias("text"))


_FILES = [
    (1, "src/a__ID__.py", False, False, False, False, False), (2, "new__ID__.txt", False, False, True, False, False), (3, "gone.js", False, True, False, False, False), (4, "i.png", True, False, False, True, False),
    (5, "run.sh", False, False, False, False, True), (6, "dÃ©\t__ID__.txt", False, False, False, False, False), (7, "fresh.py", True, False, False, False, False),
]


@_query(_expected(f"doc_id AS diff_id, CAST(file_no AS BIGINT) AS file_no, {_with_id('path')} AS path, is_new_file, is_deleted, is_renamed, is_binary, mode_changed", _FILES, "file_no, path, is_new_file, is_deleted, is_renamed, is_binary, mode_changed"))
def q_diff_many_files(spark: SparkSession, d: str) -> DataFrame:
    """New, deleted, renamed, binary, changed in mode, and with a C-quoted path whose bytes become one character each."""
    return diffs.diff_files(_diffs(spark, d)).select("diff_id", "file_no", "path", "is_new_file", "is_deleted", "is_renamed", "is_binary", "mode_changed")


@_query(_expected("doc_id AS diff_id, CAST(file_no AS BIGINT) AS file_no, CAST(hunk_no AS BIGINT) AS hunk_no, CAST(a AS INT) AS old_start, CAST(b AS INT) AS old_count, CAST(c AS INT) AS new_start, CAST(e AS INT) AS new_count", [(1, 1, 1, 3, 1, 4), (1, 2, 20, 1, 21, 0), (3, 1, 1, 2, 0, 0), (6, 1, 1, 1, 1, 1), (7, 1, 0, 0, 1, 2)], "file_no, hunk_no, a, b, c, e"))
def q_diff_many_hunks(spark: SparkSession, d: str) -> DataFrame:
    return diffs.hunks(_diffs(spark, d))


_LINES = [(1, 1, 1, " ", "one"), (1, 1, 2, "-", "two"), (1, 1, 2, "+", "zwei __ID__"), (1, 1, 3, "+", "drei"), (1, 1, 4, " ", "three"), (1, 2, 21, "-", "gone"), (3, 1, 0, "-", "a"), (3, 1, 0, "-", "b"), (6, 1, 1, "-", "x"), (6, 1, 1, "+", "y"), (7, 1, 1, "+", "p"), (7, 1, 2, "+", "q")]


@_query(_expected(f"doc_id AS diff_id, CAST(file_no AS BIGINT) AS file_no, CAST(hunk_no AS BIGINT) AS hunk_no, CAST(n AS INT) AS line_num, change_type, {_with_id('content')} AS content", _LINES, "file_no, hunk_no, n, change_type, content"))
def q_diff_many_lines(spark: SparkSession, d: str) -> DataFrame:
    return diffs.diff_lines(_diffs(spark, d)).select("diff_id", "file_no", "hunk_no", "line_num", "change_type", "content")


@_query(_expected("doc_id AS diff_id, CAST(file_no AS BIGINT) AS file_no, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line", [(1, 1, 6), (1, 19, 23), (6, 1, 3), (7, 1, 30)], "file_no, a, b"))
def q_file_regions(spark: SparkSession, d: str) -> DataFrame:
    """A new file is one region, deleted and binary ones have none, others the merged hunks with two lines around each."""
    changes = _diffs(spark, d)
    files = diffs.diff_files(changes).withColumn("file_length", F.lit(30))
    return regions.file_regions(files, diffs.hunks(changes), ["diff_id", "file_no"], 2)


@_query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'b' || doc_id || chr(10) || 'c' ELSE 'd' END AS region FROM documents")
def q_region_text(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array(F.lit("a"), F.concat(F.lit("b"), F.col("doc_id").cast("string")), F.lit("c"), F.lit("d"))
    start, end = F.expr("CASE doc_id % 3 WHEN 1 THEN 2 WHEN 2 THEN 4 END"), F.expr("CASE doc_id % 3 WHEN 1 THEN 3 WHEN 2 THEN 9 END")
    return _ids(spark, d).select("doc_id", regions.region_text(lines, start, end).alias("region"))


# --- generated files, broken files, built-in names -----------------------------------------------------------------------------------

_GENERATED = [
    ("a/generated/X__ID__.java", "class X {}", True), ("a/X__ID__.java", '@Generated("tool")', True), ("a/X__ID__.java", "class X {}", False), ("app/x__ID__.php", "<?php // plain", False),
    ("x__ID__.go", "// Code generated by tool. DO NOT EDIT.", True), ("x__ID__.go", "package x", False), ("mock_x__ID__.go", "package x", True), ("a/migrations/0001__ID__.py", "# Generated by Django 4.2", True), ("a/0001__ID__.py", "# Django 4.2", False), ("db/schema.rb", "x", True), ("storage/framework/views/v__ID__.php", "x", True),
]


@_query(_expected(f"doc_id, {_with_id('path')} AS path, head, flag AS is_generated", _GENERATED, "path, head, flag"))
def q_generated_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of generated files in names, folders and first lines."""
    rows = _ids(spark, d).select("doc_id", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(h).alias("head")) for p, h, _ in _GENERATED])))
    rows = rows.select("doc_id", _filled(F.col("p")).alias("path"), "head")
    return rows.withColumn("is_generated", filters.is_generated("path", X.lines("head"), filters.language("path")))


_BROKEN = "import os\n\ndef broken__ID__(:\n    pass\n\ndef ok__ID__(a):\n    return a\n\nclass (:\n    pass\n"


@_query(_expected(f"doc_id AS file_id, {_with_id('name')} AS name, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line", [("ok__ID__", 6, 7)], "name, a, b"))
def q_broken_files(spark: SparkSession, d: str) -> DataFrame:
    """Of a file with errors the valid blocks are read, of one with nothing else nothing."""
    rows = _ids(spark, d).select(F.col("doc_id").alias("file_id"), F.lit("x.py").alias("path"), F.lit("python").alias("language"), _filled(_BROKEN).alias("text"))
    rows = rows.unionByName(rows.withColumn("text", F.lit("def (:\n  )(\n")))
    return code.scopes(code.parsed(rows)).select("file_id", "name", "start_line", "end_line")


_NAMES = [("python", "len", True), ("python", "lens__ID__", False), ("javascript", "console", True), ("javascript", "len", False), ("java", "String", True), ("go", "append", True), ("ruby", "puts", True), ("php", "strlen", True), ("elixir", "Enum", True), ("typescript", "Promise", True), ("cobol", "len", False)]


@_query(_expected(f"doc_id, language, {_with_id('name')} AS name, flag AS is_builtin", _NAMES, "language, name, flag"))
def q_builtin_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _ids(spark, d).select("doc_id", F.inline(F.array(*[F.struct(F.lit(x).alias("language"), F.lit(n).alias("n")) for x, n, _ in _NAMES])))
    return rows.select("doc_id", "language", _filled(F.col("n")).alias("name")).withColumn("is_builtin", code.is_builtin(F.col("language"), F.col("name")))


_ASTRO = "---\nimport X from './x__ID__';\ninterface P { a: string }\n---\n<h1/>\n"


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'import X from ''./x' || doc_id || ''';' || chr(10) || 'interface P { a: string }' END AS content, CASE WHEN doc_id % 2 = 0 THEN 2 END::INT AS start_line, CASE WHEN doc_id % 2 = 0 THEN 'typescript' END AS language FROM documents")
def q_astro_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, _filled(_ASTRO)).otherwise(F.lit("<h1>--- no block ---</h1>"))
    rows = _ids(spark, d).select("doc_id", components.frontmatter(text).alias("f"))
    return rows.select("doc_id", "f.content", "f.start_line", F.when(F.col("f").isNotNull(), components.frontmatter_language(F.col("f.content"))).alias("language"))


# --- manifests and frameworks --------------------------------------------------------------------------------------------------------


@_query("SELECT doc_id, '@me/app' || doc_id AS name, 'packages/a' || doc_id || ' tools' AS workspaces FROM documents")
def q_npm_manifest(spark: SparkSession, d: str) -> DataFrame:
    text = _filled('{"name": "@me/app__ID__", "version": "1.0.0", "workspaces": ["packages/a__ID__", "tools"]}')
    return _ids(spark, d).select("doc_id", M.npm_name(text).alias("name"), F.array_join(M.npm_workspaces(text), " ").alias("workspaces"))


_POM = "<?xml version='1.0'?>\n<project xmlns='m'>\n<parent><groupId>org.parent</groupId></parent>\n<dependencies><dependency><groupId>org.dep</groupId></dependency></dependencies>\n<groupId>com.acme__ID__</groupId>\n</project>"


@_query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'com.acme' || doc_id WHEN 1 THEN 'org.gradle' || doc_id ELSE 'com.folder' END AS package FROM documents")
def q_java_package(spark: SparkSession, d: str) -> DataFrame:
    """The project's own group, not its parent's or a dependency's; else the build file's; else the source folders."""
    kind = F.col("doc_id") % 3
    pom, gradle = F.when(kind == 0, _filled(_POM)).when(kind == 2, F.lit("<project><dependencies><groupId>x.y</groupId></dependencies></project>")), F.when(kind < 2, _filled("plugins {}\ngroup = 'org.gradle__ID__'\n"))
    return _ids(spark, d).select("doc_id", M.java_base_package(pom, gradle, F.lit("com.folder")).alias("package"))


@_query("SELECT doc_id, 'acme.io/app' || doc_id AS module FROM documents")
def q_go_module(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("doc_id", M.go_module(_filled("// comment\nmodule acme.io/app__ID__\n\ngo 1.22\n")).alias("module"))


@_query("SELECT doc_id, 'rails pg own' || doc_id AS gems FROM documents")
def q_gemfile(spark: SparkSession, d: str) -> DataFrame:
    text = _filled("source 'https://rubygems.org'\ngem 'rails', '~> 7'\n  gem \"pg\"\ngroup(:test) { gem 'own__ID__' }\ngem 'rails'\n")
    return _ids(spark, d).select("doc_id", F.array_join(M.gemfile_gems(text), " ").alias("gems"))


@_query(_expected(f"doc_id, {_with_id('prefix')} AS prefix, folder", [("App__ID__\\", "src/"), ("Lib\\", "lib/"), ("Tests\\", "tests/")], "prefix, folder"))
def q_composer(spark: SparkSession, d: str) -> DataFrame:
    text = json.dumps({"autoload": {"psr-4": {"App__ID__\\": "src/", "Lib\\": ["lib/", "old/"]}}, "autoload-dev": {"psr-4": {"Tests\\": "tests/"}}})
    return _ids(spark, d).select("doc_id", F.explode(M.composer_prefixes(_filled(text))).alias("prefix", "folder"))


@_query("SELECT doc_id, 'shop' || doc_id AS app, 'phoenix ecto own' || doc_id AS deps FROM documents")
def q_mix(spark: SparkSession, d: str) -> DataFrame:
    text = _filled('defmodule Shop.MixProject do\n  def project do\n    [app: :shop__ID__, version: "1"]\n  end\n  defp deps do\n    [{:phoenix, "~> 1.7"}, {:ecto, "3"}, {:own__ID__, path: "x"}]\n  end\nend\n')
    return _ids(spark, d).select("doc_id", M.mix_app(text).alias("app"), F.array_join(M.mix_dependencies(text), " ").alias("deps"))


_PROJECT_FILES = [("manage.py", "x"), ("app.py", "app = Flask(__name__)"), ("main.py", "no framework"), ("config/application.rb", "x"), ("plugin.php", "<?php /* Plugin Name: P__ID__ */"), ("shop/__init__.py", ""), ("shop/models.py", ""), ("lib/util/__init__.py", ""), ("lib/util/views.py", ""), ("lib/deep/er/__init__.py", ""), ("lib/deep/er/views.py", ""), ("plain/models.py", "")]


def _project(spark: SparkSession, d: str) -> DataFrame:
    rows = _ids(spark, d).select(F.col("doc_id").alias("project"), "doc_id", F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in _PROJECT_FILES])))
    return rows.where("doc_id % 2 = 0 OR path <> 'manage.py'").select("project", "path", _filled(F.col("text")).alias("text"))


@_query("SELECT doc_id AS project, doc_id % 2 = 0 AS django, true AS flask, false AS fastapi, true AS rails, false AS laravel, true AS wordpress, false AS phoenix FROM documents")
def q_frameworks(spark: SparkSession, d: str) -> DataFrame:
    return M.frameworks(_project(spark, d))


@_query("SELECT doc_id AS project, unnest(['shop', 'lib.util']) AS app FROM documents")
def q_django_apps(spark: SparkSession, d: str) -> DataFrame:
    return M.django_apps(_project(spark, d))


# --- reviewers that fail, whole reviews, reports --------------------------------------------------------------------------------------


class Failing:
    """A reviewer that fails as its prompt says."""

    def __call__(self, prompt: str) -> str:
        if prompt.startswith("fail "):
            raise review.ReviewError(prompt.split()[1], "" if len(prompt.split()) < 3 else prompt.split(" ", 2)[2])
        if prompt.startswith("other "):
            raise ValueError(prompt)
        return prompt


_CALLS = [
    ("fail rate_limit", "rate_limit", "The reviewer's rate limit was reached"), ("fail auth", "auth", "The reviewer refused the credentials"), ("fail server no. __ID__", "server", "The reviewer failed"), ("fail bad maximum context length is 9", "context_length", "The prompt is too long for the reviewer"),
    ("other thing __ID__", "ValueError", "other thing __ID__"), ("", "empty", "The reviewer gave an empty answer"), ("no json", "malformed", "The answer is no valid JSON"), ('{"findings": []}', None, None),
]


@_query(_expected(f"doc_id, 'f' || n AS file_path, kind AS error_type, {_with_id('message')} AS message", [(k, kind, m) for k, (_, kind, m) in enumerate(_CALLS) if kind], "n, kind, message"))
def q_review_errors(spark: SparkSession, d: str) -> DataFrame:
    """Failures of a reviewer by kind, and what reports say of them; a good answer without findings gives no row."""
    calls = _ids(spark, d).select("doc_id", F.posexplode(F.array(*[F.lit(c) for c, _, _ in _CALLS])).alias("n", "p"))
    calls = calls.select("doc_id", F.concat(F.lit("f"), F.col("n").cast("string")).alias("file_path"), _filled(F.col("p")).alias("prompt"))
    return review.error_messages(review.reviewed(calls, Failing(), ["doc_id"], concurrent=1)).select("doc_id", "file_path", "error_type", "message")


_APP = "from lib__ID__ import query as q\n\n\nclass Api:\n    def get(self, user):\n        token = 1\n        return q(user)\n"
_LIB = "X = 1\n\ndef query(x):\n    return x\n"
_CHANGE = "diff --git a/app__ID__.py b/app__ID__.py\n--- a/app__ID__.py\n+++ b/app__ID__.py\n@@ -5,2 +5,3 @@\n     def get(self, user):\n+        token = 1\n         return q(user)\ndiff --git a/bad__ID__.py b/bad__ID__.py\n--- a/bad__ID__.py\n+++ b/bad__ID__.py\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/vendor/x.py b/vendor/x.py\n--- a/vendor/x.py\n+++ b/vendor/x.py\n@@ -1 +1 @@\n-a\n+b\n"


def _review_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    changes = _ids(spark, d).select(F.col("doc_id").alias("diff_id"), _filled(_CHANGE).alias("text"))
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).cast("string").alias("t"), F.lit(e).cast("string").alias("error")) for p, t, e in (("app__ID__.py", _APP, None), ("lib__ID__.py", _LIB, None), ("bad__ID__.py", None, "binary file"), ("vendor/x__ID__.py", "b\n", None))])
    sources = _ids(spark, d).select("doc_id", F.inline(rows))
    return changes, sources.select(_filled(F.col("p")).alias("path"), _filled(F.col("t")).alias("text"), X.lines(_filled(F.col("t"))).alias("lines"), "error")


@_query("SELECT doc_id AS diff_id, 'app' || doc_id || '.py' AS path, 3 AS region_start_line, 5 AS n_region_lines, 'function get' AS scopes, 'q lib' || doc_id || '.py' || chr(10) || 'def query(x):' || chr(10) || '    return x' AS symbols FROM documents")
def q_scan_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What a prompt is made of: the region around a change, its scope, and the definition that an imported name stands for."""
    out = scan.contexts(*_review_tables(spark, d), Config(hunk_expansion_lines=2))
    scopes = F.array_join(F.transform("scopes", lambda s: F.concat_ws(" ", s["type"], s["name"])), ",")
    defined = F.array_join(F.transform("symbols", lambda s: F.concat(s["name"], F.lit(" "), s["file"], F.lit("\n"), s["code"])), ",")
    return out.select("diff_id", "path", F.col("region_start_line").cast("int").alias("region_start_line"), F.col("n_region_lines").cast("int").alias("n_region_lines"), scopes.alias("scopes"), defined.alias("symbols"))


#: By language: the files of a project (the first is changed, at a line), and the definition that its names lead to, with its file.
_TREES: dict[str, tuple[list[tuple[str, str]], int, str, str]] = {
    "go": ([("svc__ID__/main.go", "package main\n\nimport (\n\t\"fmt\"\n\t\"acme.io/app__ID__/model\"\n)\n\nfunc main() {\n\tfmt.Println(model(1))\n}\n"), ("svc__ID__/go.mod", "module acme.io/app__ID__\n"), ("svc__ID__/model/b.go", "package model\n"), ("svc__ID__/model/a.go", "package model\n\nfunc model(x int) int {\n\treturn x\n}\n"), ("svc__ID__/model/a_test.go", "package model\nfunc model() {}\n"), ("model/a.go", "package other\nfunc model() {}\n")], 9, "model svc__ID__/model/a.go", "func model(x int) int {\n\treturn x\n}"),
    "php": ([("web__ID__/src/Page.php", "<?php\nuse App\\Models\\User;\nclass Page {\n    function show() { return User::find(1); }\n}\n"), ("web__ID__/composer.json", '{"autoload": {"psr-4": {"App\\\\": "code/"}}}'), ("web__ID__/code/Models/User.php", "<?php\nclass User {\n    static function find($id) {}\n}\n"), ("code/Models/User.php", "<?php\nclass User { }\n")], 4, "User web__ID__/code/Models/User.php", "class User {\n    static function find($id) {}\n}"),
    "ruby": ([("shop__ID__/lib/cart.rb", "class Cart\n  def total\n    LineItem.sum\n  end\nend\n"), ("shop__ID__/config/application.rb", "module Shop; end\n"), ("shop__ID__/app/models/line_item.rb", "class LineItem\n  def self.sum = 1\nend\n"), ("app/models/line_item.rb", "class LineItem; end\n")], 3, "LineItem shop__ID__/app/models/line_item.rb", "class LineItem\n  def self.sum = 1\nend"),
    "elixir": ([("apps/a__ID__/lib/page.ex", "defmodule MyApp.Page do\n  alias MyApp.Item\n  def go(x) do\n    Item.check(x)\n  end\nend\n"), ("apps/a__ID__/mix.exs", "defmodule MyApp.MixProject do\n  def project do\n    [app: :my_app]\n  end\nend\n"), ("apps/a__ID__/lib/my_app/item.ex", "defmodule MyApp.Item do\n  def check(x), do: x\nend\n"), ("lib/my_app/item.ex", "defmodule MyApp.Item do\nend\n")], 4, "Item apps/a__ID__/lib/my_app/item.ex", "defmodule MyApp.Item do\n  def check(x), do: x\nend"),
}


def _tree(spark: SparkSession, d: str, language: str) -> tuple[DataFrame, DataFrame]:
    """Every document is a repository with two revisions; the first lacks the definition, and a diff changes one file in the second."""
    files, line, _, _ = _TREES[language]
    changed = files[0][1].split("\n")[line - 1]
    change = f"diff --git a/{files[0][0]} b/{files[0][0]}\n--- a/{files[0][0]}\n+++ b/{files[0][0]}\n@@ -{line} +{line} @@\n-x\n+{changed}\n"
    changes = _ids(spark, d).select(F.col("doc_id").alias("diff_id"), F.concat(F.lit("r"), "doc_id").alias("repo"), F.lit("new").alias("revision"), _filled(change).alias("text"))
    rows = F.array(*[F.struct(F.lit(v).alias("revision"), F.lit(p).alias("p"), F.lit(t).alias("t")) for v in ("old", "new") for k, (p, t) in enumerate(files) if v == "new" or k != 2])
    sources = _ids(spark, d).select("doc_id", F.inline(rows))
    return changes, sources.select(F.concat(F.lit("r"), "doc_id").alias("repo"), "revision", _filled(F.col("p")).alias("path"), _filled(F.col("t")).alias("text"), X.lines(_filled(F.col("t"))).alias("lines"), F.lit(None).cast("string").alias("error"))


def _defined(out: DataFrame) -> DataFrame:
    found = F.array_join(F.transform("symbols", lambda s: F.concat(s["name"], F.lit(" "), s["file"], F.lit("\n"), s["code"])), ",")
    return out.select("diff_id", "path", found.alias("symbols"))


def _text_sql(text: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")).replace("__ID__", "' || doc_id || '").replace("\t", "' || chr(9) || '")


def _add_trees() -> None:
    for language, (files, _, place, code_) in _TREES.items():
        _QUERIES[f"q_scan_contexts_{language}"] = lambda spark, d, language=language: _defined(scan.contexts(*_tree(spark, d, language), Config()))
        _SQL[f"q_scan_contexts_{language}"] = f"SELECT doc_id AS diff_id, {_text_sql(files[0][0])} AS path, {_text_sql(place + chr(10) + code_)} AS symbols FROM documents"


_add_trees()


@_query(" UNION ALL ".join(f"SELECT doc_id * 4 + {k} AS diff_id, {_text_sql(files[0][0])} AS path, {_text_sql(place + chr(10) + code_)} AS symbols FROM documents" for k, (files, _, place, code_) in enumerate(_TREES.values())))
def q_scan_monorepo(spark: SparkSession, d: str) -> DataFrame:
    """One repository and revision for a document, with a project of each language in it: names lead to files of their own project."""
    changes = sources = None
    for k, language in enumerate(_TREES):
        c, s = _tree(spark, d, language)
        c = c.withColumn("diff_id", F.col("diff_id") * 4 + k)
        changes, sources = (c, s) if changes is None else (changes.unionByName(c), sources.unionByName(s))
    return _defined(scan.contexts(changes, sources, Config()))


@_query("SELECT doc_id AS diff_id, 'app' || doc_id || '.py' AS file_path, 'High' AS severity, 'CWE-798' AS cwe_id, NULL AS error FROM documents UNION ALL SELECT doc_id, 'bad' || doc_id || '.py', NULL, NULL, 'binary file' FROM documents")
def q_scan_results(spark: SparkSession, d: str) -> DataFrame:
    """Findings and errors of the review of all diffs, each under its own diff."""
    out = scan.scan(spark, *_review_tables(spark, d), review.SecretStub())
    good = out.findings.select("diff_id", "file_path", "severity", "cwe_id", F.lit(None).cast("string").alias("error"))
    return good.unionByName(out.errors.select("diff_id", "file_path", F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("cwe_id"), "error"))


@_query("SELECT doc_id AS file_id, 'f' || doc_id AS symbol, 'm' || doc_id || '.py' AS path, CASE WHEN doc_id % 2 = 0 THEN 'def g(a):' || chr(10) || '    x = 1' || chr(10) || '    y = 2' || chr(10) || '... (truncated 1 lines)' ELSE 'def g(a):' || chr(10) || '    return a' END AS code FROM documents")
def q_definitions(spark: SparkSession, d: str) -> DataFrame:
    """The text of what an imported name stands for, at most three lines of it."""
    body = F.when(F.col("doc_id") % 2 == 0, F.lit("X = 1\ndef g(a):\n    x = 1\n    y = 2\n    return a\n")).otherwise(F.lit("def g(a):\n    return a\n"))
    rows = _ids(spark, d).select(F.col("doc_id").alias("file_id"), _filled("f__ID__").alias("symbol"), F.lit("g").alias("original"), _filled("m__ID__.py").alias("path"), body.alias("text"))
    tops = code.top_level(code.parsed(rows.select("file_id", "path", F.lit("python").alias("language"), "text")))
    return symbols.definitions(rows.select("file_id", "symbol", "original", "path"), tops, rows.select("path", X.lines("text").alias("lines")), 3)


_SEVERITY = "CASE doc_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE 'Info' END"


def _few(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        "doc_id", f"{_SEVERITY} AS severity", "concat('cwe1-', doc_id) AS finding_id", "CASE WHEN doc_id % 7 = 6 THEN NULL ELSE concat('src/', source, '.py') END AS file_path", "CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id AS INT) END AS line_start",
        "CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id + doc_id % 2 AS INT) END AS line_end", "concat('finding ', repeat('x', CAST(doc_id % 9 AS INT))) AS what")


@_query(f"WITH s AS (SELECT {_SEVERITY} AS severity FROM documents), c AS (SELECT severity, count(*) AS n, min(list_position(['Critical', 'High', 'Medium', 'Low', 'Info'], severity)) AS k FROM s GROUP BY 1) SELECT string_agg(n || ' ' || severity, ', ' ORDER BY k) || ' (3 suppressed)' AS summary FROM c")
def q_summary_line(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary_line(_few(spark, d), 3)


@_query("SELECT 2 AS exit_code, 'errors' AS of UNION ALL SELECT 1, 'blocking' UNION ALL SELECT 0, 'clean' UNION ALL SELECT 1, 'errors allowed'")
def q_exit_code(spark: SparkSession, d: str) -> DataFrame:
    found, none = _few(spark, d), _few(spark, d).where("doc_id IS NULL")
    parts = [(found, found, True, "errors"), (found, none, True, "blocking"), (found.where("severity = 'Low'"), none, True, "clean"), (found, found, False, "errors allowed")]
    out = [reports.status(f, e.select("doc_id"), fail).withColumn("of", F.lit(name)) for f, e, fail, name in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@_query(f"""SELECT {_SEVERITY} AS severity, coalesce(CASE WHEN doc_id % 7 = 6 THEN NULL ELSE 'src/' || source || '.py' END, '(unknown)') || CASE WHEN doc_id % 4 = 3 THEN '' WHEN doc_id % 2 = 1 THEN ':' || doc_id || '-' || (doc_id + 1) ELSE ':' || doc_id END AS place,
 CASE WHEN doc_id % 9 > 4 THEN 'finding x...' ELSE 'finding ' || repeat('x', CAST(doc_id % 9 AS BIGINT)) END AS what, 'cwe1-' || doc_id AS finding_id FROM documents""")
def q_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.table_rows(_few(spark, d), 12)


@_query(f"""SELECT doc_id, '{{"finding_id":"cwe1-' || doc_id || '","what":"finding ' || repeat('x', CAST(doc_id % 9 AS BIGINT)) || '","severity":"' || {_SEVERITY} || '"' || CASE WHEN doc_id % 7 = 6 THEN '' ELSE ',"file_path":"src/' || source || '.py"' END
 || CASE WHEN doc_id % 4 = 3 THEN '' ELSE ',"line_range":{{"start":' || doc_id || ',"end":' || (doc_id + doc_id % 2) || '}}' END || '}}' AS value FROM documents""")
def q_finding_json(spark: SparkSession, d: str) -> DataFrame:
    """Findings as JSON objects: null fields left out, lines nested."""
    rows = _few(spark, d)
    return rows.select("doc_id", reports.finding_json(rows.columns).alias("value"))


@_query(f"""SELECT 'cwe1-' || doc_id AS finding_id, {_SEVERITY} AS severity, CASE WHEN doc_id % 7 = 6 THEN NULL ELSE 'src/' || source || '.py' END AS file_path, CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id AS INT) END AS line_start, NULL AS error FROM documents
 UNION ALL SELECT NULL, NULL, 'src/' || source || '.py', NULL, 'failed ' || doc_id FROM documents WHERE doc_id % 11 = 0""")
def q_report_file(spark: SparkSession, d: str) -> DataFrame:
    """Findings and errors as they stand in a written report, a line each."""
    errors = table(spark, d, "documents").where("doc_id % 11 = 0").selectExpr("concat('src/', source, '.py') AS file_path", "concat('failed ', doc_id) AS error", "'server' AS error_type")
    path = new_path(spark, "report") + ".json"
    reports.write_report(_few(spark, d), errors, {"branch": "main"}, "doc_id", "2026-01-01T00:00:00Z", path, 3)
    item = F.from_json(F.regexp_replace("value", "^,? ", ""), "finding_id string, severity string, file_path string, line_range struct<start: int>, error string").alias("i")
    return spark.read.text(path).where(F.col("value").rlike('^,? \\{"')).select(item).select("i.finding_id", "i.severity", "i.file_path", F.col("i.line_range.start").alias("line_start"), "i.error")


@_query("SELECT 'cwe1-' || doc_id AS finding_id, 'CWE-' || doc_id % 90 AS cwe_id, 'h' || doc_id AS code_hash, CASE WHEN doc_id % 3 > 0 THEN 'a.py' END AS file_path, 'why \"' || doc_id || '\"' AS reason FROM documents")
def q_baseline_file(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a baseline after they were written and read."""
    entries = table(spark, d, "documents").selectExpr("concat('cwe1-', doc_id) AS finding_id", "concat('CWE-', doc_id % 90) AS cwe_id", "concat('h', doc_id) AS code_hash", "CASE WHEN doc_id % 3 > 0 THEN 'a.py' END AS file_path", "concat('why \"', doc_id, '\"') AS reason", "'2026-01-01' AS added_at")
    path = new_path(spark, "baseline") + ".json"
    reports.write_baseline(entries, path)
    return M.baseline(spark, path).select("finding_id", "cwe_id", "code_hash", "file_path", "reason")


@_query(f"SELECT 'cwe1-' || doc_id AS finding_id, NULL AS cwe_id, {_SEVERITY} AS severity, CASE WHEN doc_id % 7 = 6 THEN NULL ELSE 'src/' || source || '.py' END AS file_path FROM documents")
def q_scan_cache_file(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a scan cache after they were written and read."""
    path = new_path(spark, "cache") + ".json"
    reports.write_scan_cache(_few(spark, d).withColumn("cwe_id", F.lit(None).cast("string")), path, "2026-01-01T00:00:00Z")
    return M.scan_cache(spark, path).select("finding_id", "cwe_id", "severity", "file_path")


class Flaky:
    """A reviewer that fails as often as its prompt says before it answers."""

    def __init__(self):
        self.failed: dict[str, int] = {}

    def __call__(self, prompt: str) -> str:
        kind, times, _ = prompt.split(" ", 2)
        self.failed[prompt] = self.failed.get(prompt, 0) + 1
        if self.failed[prompt] <= int(times):
            raise review.ReviewError(kind, f"{kind} {self.failed[prompt]}")
        return '{"findings": []}'


_FLAKY = [("server", 0, None), ("server", 1, None), ("rate_limit", 2, None), ("timeout", 3, "timeout 3"), ("auth", 1, "auth 1"), ("connection", 2, "connection 1")]


@_query(_expected("doc_id, CAST(n AS INT) AS n, error", [(k, e) for k, (_, _, e) in enumerate(_FLAKY)], "n, error"))
def q_review_retries(spark: SparkSession, d: str) -> DataFrame:
    """Transient failures are tried again, twice here; others are not."""
    calls = _ids(spark, d).select("doc_id", F.posexplode(F.array(*[F.lit(f"{k} {n} __ID__") for k, n, _ in _FLAKY])).alias("n", "p"))
    calls = calls.select("doc_id", "n", F.lit("f").alias("file_path"), _filled(F.col("p")).alias("prompt"))
    return review.answers(calls, Flaky(), concurrent=64, retries=2, keys=["doc_id", "n"], wait=0.001).select("doc_id", "n", "error")
