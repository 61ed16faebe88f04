"""Code parsing and import resolution on snippets written for these tests."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.operators import code, components
from patchloom.operators.code_parse import parse
from patchloom.plans import code_catalog
from patchloom.plans.code_cases import CASES, HEADS

PYTHON = """import os.path, json as j
from .pkg import a, b as c
from x import *

@deco
class K(Base):
    def m(self, q):
        return helper(q) + os.path.join("x") + j.dumps(c)

async def g():
    z = len(K)
    return z
"""
JS = """import def, { one, two as deux } from './lib/util.js';
import * as ns from "pkg";
const { p, q: r } = require('../dep');
// function notThis() {
class Box extends Base {
  open(key) {
    return helper(key, this.x) + deux;
  }
}
const make = async (a, b) => {
  return ns.run(a);
};
function* gen() { yield 1; }
export function top(x) { return x + "function fake() {"; }
"""
TS = """import type { T } from './t';
import { A } from './a';
namespace N {
  export function inner(v: number): string { return A(v); }
}
"""
JAVA = """package x;
import java.util.List;
import com.acme.util.Helper;
import static com.acme.Tools.run;
import com.acme.all.*;
public class Main {
    public Main(int n) { this.n = n; }
    @Override
    public String go(List<String> in) throws Exception {
        in.forEach(x -> Helper.use(x));
        return run(in);
    }
}
interface Shape { }
"""
GO = """package main

import (
    "fmt"
    m "acme.io/app/model"
    _ "side"
)

import "os"

func (s *Server) Run(ctx Ctx) error {
    v := m.New(ctx)
    fmt.Println(v)
    return nil
}

func main() {
    go func() {
        work()
    }()
}
"""
RUBY = """require 'json'
require_relative 'lib/helper'
autoload :Late, 'late'

module Shop
  class Cart
    def add(item)
      if item
        items.each do |i|
          Helper.check(i)
        end
      end
    end
  end
end
"""
PHP = """<?php
use App\\Models\\User;
use App\\Util\\{First, Second as Sec};
require __DIR__ . '/boot.php';
trait Named { }
class Page extends Base {
    public function show($id) {
        $f = function ($x) { return $x; };
        return User::find($id) . strlen($id);
    }
}
function helper($a) { return Sec::go($a); }
"""
ELIXIR = """defmodule Shop.Cart do
  alias Shop.{Item, User}
  alias Shop.Long.Name, as: Short
  import Enum, only: [map: 2]
  use GenServer

  def add(cart, item) do
    if item do
      Item.check(item)
    end
    fn x -> x end
  end
end
"""


def scopes(language, text):
    return {(k, n): (a, b, d) for k, n, a, b, d in parse(language, text).scopes}


def test_python():
    p = parse("python", PYTHON)
    assert scopes("python", PYTHON) == {("class", "K"): (5, 8, 1), ("function", "m"): (7, 8, 2), ("function", "g"): (10, 12, 1)}
    assert [(i.module, i.names, i.alias, i.is_star, i.level) for i in p.imports] == [("os.path", None, None, False, 0), ("json", None, "j", False, 0), (".pkg", ["a", "b"], None, False, 1), ("x", [], None, True, 0)]
    assert p.imports[2].name_aliases == [("b", "c")]
    assert [t[0] for t in p.top_level] == ["K", "g"]
    assert parse("python", "def broken(:").scopes == []


def test_javascript_and_typescript():
    s = scopes("javascript", JS)
    assert s[("class", "Box")] == (5, 9, 1) and s[("method", "open")] == (6, 8, 2) and s[("arrow_function", "make")][:2] == (10, 12)
    assert s[("generator", "gen")][:2] == (13, 13) and s[("function", "top")][:2] == (14, 14)
    assert not {n for _, n in s} & {"notThis", "fake"}
    i = parse("javascript", JS).imports
    assert [(x.module, x.names, x.alias, x.is_relative) for x in i] == [("./lib/util.js", ["one", "two", "def"], None, True), ("pkg", None, "ns", False), ("../dep", ["p", "q"], None, True)]
    assert ("two", "deux") in i[0].name_aliases and ("q", "r") in i[2].name_aliases
    t = scopes("typescript", TS)
    assert t[("namespace", "N")] == (3, 5, 1) and t[("function", "inner")] == (4, 4, 2)
    assert [x.module for x in parse("typescript", TS).imports] == ["./a"]


def test_java():
    s = scopes("java", JAVA)
    assert s[("class", "Main")][:2] == (6, 13) and s[("constructor", "Main")][:2] == (7, 7) and s[("method", "go")][:2] == (8, 12) and ("interface", "Shape") in s
    assert [(i.module, i.names, i.is_star) for i in parse("java", JAVA).imports] == [("java.util.List", ["List"], False), ("com.acme.util.Helper", ["Helper"], False), ("com.acme.Tools", ["run"], False), ("com.acme.all", [], True)]


def test_go():
    s = scopes("go", GO)
    assert s[("method", "Run")] == (11, 15, 1) and s[("function", "main")] == (17, 21, 1) and s[("function", "<anonymous>")] == (18, 20, 2)
    assert [(i.module, i.alias) for i in parse("go", GO).imports] == [("fmt", None), ("acme.io/app/model", "m"), ("side", "_"), ("os", None)]


def test_ruby_php_elixir():
    r = scopes("ruby", RUBY)
    assert r[("module", "Shop")] == (5, 15, 1) and r[("class", "Cart")] == (6, 14, 2) and r[("method", "add")] == (7, 13, 3) and r[("block", "<block>")][:2] == (9, 11)
    assert [(i.module, i.names, i.is_relative) for i in parse("ruby", RUBY).imports] == [("json", None, False), ("lib/helper", None, True), ("late", ["Late"], False)]
    p = scopes("php", PHP)
    assert p[("trait", "Named")][:2] == (5, 5) and p[("class", "Page")][:2] == (6, 11) and p[("method", "show")][:2] == (7, 10) and p[("closure", "<anonymous>")][:2] == (8, 8) and p[("function", "helper")][:2] == (12, 12)
    assert [(i.module, i.names, i.alias) for i in parse("php", PHP).imports] == [("App\\Models\\User", ["User"], None), ("App\\Util\\First", ["First"], None), ("App\\Util\\Second", ["Second"], "Sec"), ("/boot.php", None, None)]
    e = scopes("elixir", ELIXIR)
    assert e[("module", "Shop.Cart")][:2] == (1, 13) and e[("function", "add")][:2] == (7, 12) and e[("anonymous_function", "<fn>")][:2] == (11, 11)
    assert [(i.module, i.names, i.alias) for i in parse("elixir", ELIXIR).imports] == [("Shop.Item", ["Item"], None), ("Shop.User", ["User"], None), ("Shop.Long.Name", None, "Short"), ("Enum", ["map"], None), ("GenServer", None, None)]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(1, "src/app/k.py", "python", PYTHON), (2, "web/main.js", "javascript", JS), (3, "M.java", "java", JAVA), (4, "s.go", "go", GO), (5, "c.rb", "ruby", RUBY), (6, "p.php", "php", PHP), (7, "c.ex", "elixir", ELIXIR), (8, "x.css", "css", "a{}"), (9, "n.py", "python", None)]
    return code.parsed(spark.createDataFrame(rows, "file_id long, path string, language string, text string")).cache()


def test_used_symbols(spark, parsed):
    regions = spark.createDataFrame([(k, 1, 40) for k in range(1, 10)], "file_id long, start_line int, end_line int")
    got = {}
    for r in code.used_symbols(parsed, regions).collect():
        got.setdefault(r.file_id, set()).add(r.symbol)
    assert got[1] == {"deco", "Base", "helper", "os", "j", "c"}
    assert {"helper", "Base", "deux", "ns"} <= got[2] and not got[2] & {"run", "x", "key", "make", "a"}
    assert {"Helper", "run"} <= got[3] and not got[3] & {"use", "List"}  # types are no uses
    assert {"fmt", "m", "work"} <= got[4] and not got[4] & {"v", "Println", "New"}
    assert "Helper" in got[5] and "check" not in got[5]
    assert {"User", "Sec"} <= got[6] and not got[6] & {"find", "strlen", "Base"}  # a base class is a type there
    assert "Item" in got[7]


def test_scopes_and_imports(parsed):
    assert code.scopes(parsed).where("file_id = 1").count() == 3
    rows = code.imports(parsed).where("file_id = 1").orderBy("ord").collect()
    assert [r.module for r in rows] == ["os.path", "json", ".pkg", "x"]
    assert rows[0].names is None and rows[3].names == []
    assert code.parsed.__doc__


@pytest.mark.parametrize(
    ("language", "module", "relative", "level", "current", "files", "want"),
    [
        ("python", "pkg.mod", False, 0, "a.py", ["src/pkg/mod.py", "pkg/mod/__init__.py"], "pkg/mod/__init__.py"),
        ("python", "..up.mod", True, 2, "a/b/c.py", ["a/up/mod.py"], "a/up/mod.py"),
        ("python", ".", True, 1, "a/b/c.py", ["a/b/__init__.py"], "a/b/__init__.py"),
        ("javascript", "../lib/x", True, 0, "web/app/main.js", ["web/lib/x/index.js", "web/lib/x.mjs"], "web/lib/x.mjs"),
        ("javascript", "react", False, 0, "a.js", ["react.js"], None),
        ("typescript", "./y", True, 0, "src/a.ts", ["src/y.js", "src/y.tsx"], "src/y.tsx"),
        ("java", "com.acme.Main", False, 0, "A.java", ["com/acme/Main.java", "src/com/acme/Main.java"], "src/com/acme/Main.java"),
        ("ruby", "util", False, 0, "a.rb", ["app/util.rb", "util.rb"], "util.rb"),
        ("ruby", "../x", True, 0, "lib/a/b.rb", ["lib/x.rb"], "lib/x.rb"),
        ("php", "App\\Models\\User", False, 0, "a.php", ["src/App/Models/User.php"], "src/App/Models/User.php"),
        ("elixir", "MyApp.UserStore", False, 0, "a.ex", ["lib/my_app/user_store.ex"], "lib/my_app/user_store.ex"),
    ],
)
def test_candidates(spark, language, module, relative, level, current, files, want):
    rows = spark.createDataFrame([(1, "S", "S", module, relative, level)], "file_id long, symbol string, original string, module string, is_relative boolean, level int")
    about = spark.createDataFrame([(1, current, language)], "file_id long, path string, language string")
    got = code.resolved_files(rows, about, spark.createDataFrame([(f,) for f in files], "path string")).collect()
    assert (got[0].path if got else None) == want


def test_package_and_framework_files(spark):
    files = spark.createDataFrame([(f,) for f in ("model/b.go", "model/a_test.go", "model/a.go", "main.go", "lib/Acme/User.php", "app/Models/Post.php", "app/models/user_account.rb", "lib/shop_web/controllers/page_controller.ex")], "path string")
    imports = spark.createDataFrame([(1, "acme.io/app/model"), (2, "acme.io/app"), (3, "acme.io/apple")], "file_id long, module string")
    assert {(r.file_id, r.path) for r in code.go_package_files(imports, "acme.io/app", files).collect()} == {(1, "model/a.go"), (2, "main.go")}
    php = spark.createDataFrame([(1, "Acme\\User")], "file_id long, module string")
    assert code.php_namespace_files(php, {"Acme\\": "lib/Acme/"}, files).first().path == "lib/Acme/User.php"
    for framework, symbol, path in (("rails", "UserAccount", "app/models/user_account.rb"), ("laravel", "Post", "app/Models/Post.php"), ("phoenix", "ShopWeb.PageController", "lib/shop_web/controllers/page_controller.ex")):
        wanted = spark.createDataFrame([(1, symbol)], "file_id long, symbol string")
        assert code.framework_files(wanted, framework, files).first().path == path


@pytest.mark.parametrize(
    ("language", "module", "relative", "exists", "project", "want"),
    [
        ("python", "os.path", False, True, (None, None, None), False), ("python", "mine.x", False, True, (None, None, None), True), ("python", "numpy", False, False, (None, None, None), False), ("python", ".a", True, False, (None, None, None), True),
        ("javascript", "@me/a", False, False, ("root", ["@me/a"], None), True), ("javascript", "react", False, False, ("root", None, None), False),
        ("java", "java.util.List", False, True, ("com.acme", None, None), False), ("java", "com.acme.x.Y", False, False, ("com.acme", None, None), True),
        ("go", "fmt", False, False, ("acme.io/app", None, None), False), ("go", "acme.io/app/x", False, False, ("acme.io/app", None, None), True), ("go", "acme.io/apple", False, False, ("acme.io/app", None, None), False),
        ("ruby", "json", False, True, (None, None, None), False), ("ruby", "mine", False, True, (None, None, ["rails"]), True), ("ruby", "rails", False, True, (None, None, ["rails"]), False),
        ("php", "Acme\\X", False, False, (None, ["Acme\\"], None), True), ("php", "Other\\X", False, False, (None, ["Acme\\"], None), False),
        ("elixir", "MyApp.X", False, False, ("my_app", None, ["phoenix"]), True), ("elixir", "MyAppWeb.X", False, False, ("my_app", None, ["phoenix"]), True), ("elixir", "MyAppWeb.X", False, False, ("my_app", None, []), False), ("elixir", "Enum", False, False, ("enum", None, None), False),
    ],
)
def test_first_party(spark, language, module, relative, exists, project, want):
    row = spark.createDataFrame([(language, module, relative, exists, project)], "language string, module string, is_relative boolean, e boolean, project struct<package string, namespaces array<string>, dependencies array<string>>")
    assert row.select(code.is_first_party(*[F.col(c) for c in ("language", "module", "is_relative", "e", "project")]).alias("x")).first().x is want


def test_components(spark):
    vue = '<template>\n<p/>\n</template>\n<script setup lang="ts">\nconst a = 1;\nlet b;\n</script>\n<style>\np {}\n</style>\n'
    astro = "---\nimport X from './x';\ninterface P { a: string }\n---\n<h1/>\n"
    frame = spark.createDataFrame([(vue, astro)], "vue string, astro string")
    row = frame.select(components.script_block("vue").alias("s"), components.script_language("vue").alias("l"), components.blanked("vue").alias("b"), components.frontmatter("astro").alias("f"), components.frontmatter_language(components.frontmatter("astro")["content"]).alias("fl"), components.script_block("astro").alias("none"), components.frontmatter("vue").alias("nof")).first()
    assert tuple(row.s) == ("const a = 1;\nlet b;", 5) and row.l == "typescript"
    assert row.b.count("\n") == vue.count("\n") and "const" not in row.b and "<p/>" in row.b
    assert tuple(row.f) == ("import X from './x';\ninterface P { a: string }", 2) and row.fl == "typescript"
    assert row.none is None and row.nof is None


def test_end_to_end_definitions(spark):
    from patchloom.functions.text import lines
    from patchloom.operators import symbols

    main, lib = "from lib import f as ff\n\ndef run():\n    return ff(1)\n", "X = 1\n\ndef f(a):\n    return a\n"
    sources = spark.createDataFrame([(1, "main.py", "python", main), (2, "lib.py", "python", lib)], "file_id long, path string, language string, text string")
    p = code.parsed(sources).cache()
    used = code.used_symbols(p, spark.createDataFrame([(1, 3, 4)], "file_id long, start_line int, end_line int"))
    found = code.resolved_files(symbols.resolved_imports(used, code.imports(p)), p, sources.select("path"))
    got = symbols.definitions(found, code.top_level(p), sources.select("path", lines("text").alias("lines"))).collect()
    assert [(r.symbol, r.path, r.code) for r in got] == [("ff", "lib.py", "def f(a):\n    return a")]


def test_broken_python_keeps_its_valid_blocks():
    text = "import os\n\ndef broken(:\n    pass\n\n@deco\ndef ok(a):\n    return a\n\ntry:\n    x = 1\nexcept E as e:\n    y(e)\n\nclass (:\n    pass\nclass Good:\n    def m(self):\n        pass\n"
    assert scopes("python", text) == {("function", "ok"): (6, 8, 1), ("class", "Good"): (17, 19, 1), ("function", "m"): (18, 19, 2)}
    p = parse("python", text)
    assert [i.module for i in p.imports] == ["os"] and [t[0] for t in p.top_level] == ["ok", "Good"]
    assert (13, "y", "use") in p.symbols and (12, "e", "definition") in p.symbols
    assert parse("python", "def broken(:\n  x\n").scopes == []


@pytest.mark.parametrize("text", [" + ".join("a" for _ in range(3000)), "a" + ".b" * 4000, "if a:\n    pass\n" + "elif a:\n    pass\n" * 1500, "(" * 5000, "x = " + "[" * 150 + "]" * 150])
def test_deep_python_does_not_fail(text):
    parse("python", text)


def test_code_in_template_strings_and_one_line_ruby():
    js = "const a = `x ${foo(bar)} y ${z}`;\nfunction f() { return `}${ok}`; }\n"
    used = {n for _, n, r in parse("javascript", js).symbols if r == "use"}
    assert {"foo", "bar", "z", "ok"} <= used and not used & {"x", "y"}
    assert scopes("javascript", js)[("function", "f")][:2] == (2, 2)
    rb = "class A; end\ndef b; 1; end\ndef c(x) = x + 1\ndef d(x)\n  if x; 1; end\nend\nprivate def e\n  2\nend\n"
    s = scopes("ruby", rb)
    assert s[("class", "A")][:2] == (1, 1) and s[("method", "b")][:2] == (2, 2) and s[("method", "d")][:2] == (4, 6) and s[("method", "e")][:2] == (7, 9)


@pytest.mark.parametrize("language", sorted(CASES))
def test_pieces_of_code(language):
    """Each piece alone, and all of them in one file."""
    head = HEADS.get(language, "")
    for text, want, used in CASES[language]:
        p = parse(language, head + text)
        shift = head.count("\n")
        assert sorted((k, n, a - shift, b - shift, d) for k, n, a, b, d in p.scopes) == sorted(want), text
        defined = {n for _, n, role in p.symbols if role == "definition"}
        assert {n for _, n, role in p.symbols if role == "use"} - defined == set(used), text
    everything = parse(language, head + "".join(t for t, _, _ in CASES[language]))
    assert len(everything.scopes) == sum(len(s) for _, s, _ in CASES[language])


@pytest.mark.parametrize("language", sorted(CASES))
def test_broken_and_long_files(language):
    """Cut or damaged anywhere, a file is still read, in time that grows with its length."""
    head = HEADS.get(language, "")
    text = head + "".join(t for t, _, _ in CASES[language])
    for at in range(0, len(text), 7):
        parse(language, text[:at])
        parse(language, text[at:])
        parse(language, text[:at] + "}{)(\"'`" + text[at:])
    began = time.perf_counter()
    parse(language, text * 30)
    once = time.perf_counter() - began
    for mark in ("{", "(", "`${", "<<A\n", "def f\n", "a=>", "f(<b>", '"""', "<?php ", "do\n", "x = [", "if (", "/*"):
        began = time.perf_counter()
        parse(language, head + mark * 3000)
        assert time.perf_counter() - began < 10 + once, mark


def test_a_parse_holds_few_files():
    """Portions end at a number of files and where their characters pass a bound, nulls included; together they are the batch."""
    texts = ["x"] * (code.FILES + 3) + [None, "y" * (code.CHARS + 1), "z", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], ["text"])
    parts = [p.column("text").to_pylist() for p in code._portions(batch)]
    assert [len(p) for p in parts] == [code.FILES, 5, 2] and sum(parts, []) == texts
    assert list(code._portions(batch.slice(0, 0))) == []


def test_names_take_one_parse_in_many_tasks(spark):
    """One task's files go to several, and uses and definitions come from one pass over the parse."""
    rows = spark.range(0, 40, 1, 1).selectExpr("id AS file_id", "concat('f', id) AS path", "'python' AS language", "concat('def f(a):\n    return a + g', id, '(f)\n') AS text")
    parsed = code.parsed(rows)
    assert parsed.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    used = code.used_symbols(parsed, rows.selectExpr("file_id", "1 AS start_line", "2 AS end_line"))
    assert sorted(map(tuple, used.collect())) == [(k, f"g{k}") for k in range(40)]
    assert used._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("language", ["javascript", "python"])
def test_no_table_of_files_goes_through_the_driver(spark, language):
    """What grows with the files is dealt to tasks and merged there, however few bytes it has; joins that Spark chose were sent to all, through the driver."""
    found = code_catalog.queries()[f"q_symbol_files_{language}"](spark, "/root/testdata/sf0.001")
    assert found.count() == 200 * len(code_catalog.FILES[language][1])
    found.collect()
    assert "SortMergeJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan
