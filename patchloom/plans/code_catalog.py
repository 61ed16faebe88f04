"""Queries on parsing and import resolution, for each language: every document becomes a file of code with its number in all names, some lines further down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators import code, symbols
from patchloom.plans.code_cases import CASES, HEADS
from patchloom.plans.code_samples import SAMPLES
from patchloom.shared import keep
from patchloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
SHIFT = "CAST(doc_id % 5 AS INT)"

#: type, name, first line, last line, depth.
SCOPES: dict[str, list[tuple[str, str, int, int, int]]] = {
    "python": [("class", "K__ID__", 5, 8, 1), ("function", "m", 7, 8, 2), ("function", "g__ID__", 10, 12, 1)],
    "javascript": [("class", "Box__ID__", 5, 9, 1), ("method", "open", 6, 8, 2), ("arrow_function", "make__ID__", 10, 12, 1), ("generator", "gen__ID__", 13, 13, 1), ("function", "top__ID__", 14, 14, 1)],
    "typescript": [("namespace", "N__ID__", 3, 5, 1), ("function", "inner__ID__", 4, 4, 2), ("class", "Store__ID__", 6, 10, 1), ("method", "load", 7, 9, 2)],
    "java": [("class", "Main__ID__", 6, 13, 1), ("constructor", "Main__ID__", 7, 7, 2), ("method", "go__ID__", 8, 12, 2), ("lambda", "<lambda>", 10, 10, 3), ("interface", "Shape__ID__", 14, 14, 1)],
    "go": [("method", "Run__ID__", 11, 15, 1), ("function", "main__ID__", 17, 21, 1), ("function", "<anonymous>", 18, 20, 2)],
    "ruby": [("module", "Shop__ID__", 5, 16, 1), ("class", "Cart__ID__", 6, 15, 2), ("method", "add__ID__", 7, 13, 3), ("block", "<block>", 9, 11, 4), ("method", "one__ID__", 14, 14, 3)],
    "php": [("trait", "Named__ID__", 5, 5, 1), ("class", "Page__ID__", 6, 11, 1), ("method", "show__ID__", 7, 10, 2), ("closure", "<anonymous>", 8, 8, 3), ("function", "helper__ID__", 12, 12, 1)],
    "elixir": [("module", "Shop.Cart__ID__", 1, 13, 1), ("function", "add__ID__", 7, 12, 2), ("anonymous_function", "<fn>", 11, 11, 3)],
}
#: module, names (joined by blanks, None for a whole module), alias, name aliases (original=alias), star, relative.
IMPORTS: dict[str, list[tuple[str, str | None, str | None, str, bool, bool]]] = {
    "python": [("os.path", None, None, "", False, False), ("json", None, "j", "", False, False), (".pkg__ID__", "a b", None, "b=c", False, True), ("lib__ID__", "", None, "", True, False)],
    "javascript": [("./lib/u__ID__.js", "one two first", None, "two=deux", False, True), ("pkg", None, "ns", "", True, False), ("../dep__ID__", "p q", None, "q=r", False, True)],
    "typescript": [("./a__ID__", "A__ID__", None, "", False, True)],
    "java": [("java.util.List", "List", None, "", False, False), ("com.acme.util.Helper__ID__", "Helper__ID__", None, "", False, False), ("com.acme.Tools", "run__ID__", None, "", False, False), ("com.acme.all", "", None, "", True, False)],
    "go": [("fmt", None, None, "", False, False), ("acme.io/app/model__ID__", None, "m", "", False, False), ("side", None, "_", "", False, False), ("os", None, None, "", False, False)],
    "ruby": [("json", None, None, "", False, False), ("help/h__ID__", None, None, "", False, True), ("late", "Late__ID__", None, "", False, False)],
    "php": [("App\\Models\\User__ID__", "User__ID__", None, "", False, False), ("App\\Util\\First__ID__", "First__ID__", None, "", False, False), ("App\\Util\\Second", "Second", "Sec__ID__", "Second=Sec__ID__", False, False), ("/boot__ID__.php", None, None, "", False, True)],
    "elixir": [("Shop.Item__ID__", "Item__ID__", None, "", False, False), ("Shop.User", "User", None, "", False, False), ("Shop.Long.Name__ID__", None, "Short__ID__", "", False, False), ("Enum", "map", None, "", False, False), ("GenServer", None, None, "", False, False)],
}
#: The lines below the imports, and the names that are used there and come from elsewhere.
USED: dict[str, tuple[int, int, list[str]]] = {
    "python": (5, 12, ["Base", "c", "deco", "helper__ID__", "j", "os"]),
    "javascript": (5, 14, ["Base", "deux", "helper__ID__", "inner__ID__", "ns"]),
    "typescript": (3, 10, ["A__ID__", "fetch__ID__"]),
    "java": (6, 13, ["Helper__ID__", "run__ID__"]),
    "go": (11, 21, ["fmt", "m", "work__ID__"]),
    "ruby": (5, 16, ["Helper__ID__", "items"]),
    "php": (5, 12, ["Sec__ID__", "User__ID__"]),
    "elixir": (7, 12, ["Item__ID__"]),
}
#: Files of the project beside the samples, and the file that each of the names above comes from, with its name there.
FILES: dict[str, tuple[list[str], list[tuple[str, str, str]]]] = {
    "python": (["src/app/pkg__ID__.py", "os.py"], [("c", "b", "src/app/pkg__ID__.py")]),
    "javascript": (["web/lib/u__ID__.js", "web/lib/u__ID__/index.js", "pkg.js"], [("deux", "two", "web/lib/u__ID__.js")]),
    "typescript": (["web/a__ID__.js", "web/a__ID__.tsx"], [("A__ID__", "A__ID__", "web/a__ID__.tsx")]),
    "java": (["src/com/acme/util/Helper__ID__.java", "src/main/java/com/acme/util/Helper__ID__.java"], [("Helper__ID__", "Helper__ID__", "src/main/java/com/acme/util/Helper__ID__.java")]),
    "elixir": (["lib/shop/item__ID__.ex", "lib/item__ID__.ex"], [("Item__ID__", "Item__ID__", "lib/shop/item__ID__.ex")]),
}
_APP = ("acme.io/app", "", "")
#: module, relative, leads to a file, (package, namespaces, dependencies, joined by blanks), whether it is the project's own.
OWN: dict[str, list[tuple[str, bool, bool, tuple[str, str, str], bool]]] = {
    "python": [("os.path", False, True, ("", "", ""), False), ("mine__ID__.x", False, True, ("", "", ""), True), ("numpy", False, False, ("", "", ""), False), (".a__ID__", True, False, ("", "", ""), True), ("site-packages/y__ID__", False, True, ("", "", ""), False)],
    "javascript": [("@me/a__ID__", False, False, ("root", "@me/a__ID__ @me/b", ""), True), ("react", False, False, ("root", "", ""), False), ("root/sub__ID__", False, False, ("root", "", ""), True), ("rooted", False, False, ("root", "", ""), False), ("./x__ID__", True, False, ("root", "", ""), True)],
    "typescript": [("@me/a__ID__", False, False, ("app", "@me/a__ID__", ""), True), ("app", False, False, ("app", "", ""), True), ("lodash", False, True, ("app", "", ""), False), ("../y__ID__", True, False, ("app", "", ""), True)],
    "java": [("java.util.List", False, True, ("com.acme", "", ""), False), ("com.acme.x.Y__ID__", False, False, ("com.acme", "", ""), True), ("com.acmex.Y", False, False, ("com.acme", "", ""), False), ("org.own__ID__.Z", False, True, ("com.acme", "", ""), True), ("org.w3c.dom.Node", False, True, ("com.acme", "", ""), False)],
    "go": [("fmt", False, False, _APP, False), ("acme.io/app/x__ID__", False, False, _APP, True), ("acme.io/app", False, False, _APP, True), ("acme.io/apple__ID__", False, False, _APP, False), ("acme.io/app/vendor/z", False, False, _APP, False)],
    "ruby": [("json", False, True, ("", "", "rails pg"), False), ("mine__ID__", False, True, ("", "", "rails pg"), True), ("rails", False, True, ("", "", "rails pg"), False), ("other__ID__", False, False, ("", "", "rails pg"), False), ("x__ID__", True, False, ("", "", ""), True)],
    "php": [("Acme\\X__ID__", False, False, ("", "Acme\\ Own\\", ""), True), ("Own\\Y", False, False, ("", "Acme\\ Own\\", ""), True), ("Other\\X__ID__", False, True, ("", "Acme\\", ""), False), ("/boot.php", True, False, ("", "", ""), True)],
    "elixir": [("MyApp.X__ID__", False, False, ("my_app", "", "phoenix"), True), ("MyAppWeb.X__ID__", False, False, ("my_app", "", "phoenix"), True), ("MyAppWeb.X", False, False, ("my_app", "", "ecto"), False), ("Enum", False, False, ("enum", "", ""), False), ("Ecto.Query", False, True, ("my_app", "", "ecto"), False), (":crypto", False, False, ("my_app", "", ""), False)],
}


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) v({columns})"


def _with_id(column: str) -> str:
    return f"replace({column}, '__ID__', CAST(doc_id AS VARCHAR))"


def _filled(text) -> F.Column:
    return F.replace(F.lit(text) if isinstance(text, str) else text, F.lit("__ID__"), F.col("doc_id").cast("string"))


def _sources(spark: SparkSession, d: str, language: str) -> DataFrame:
    path, text = SAMPLES[language]
    below = F.concat(F.repeat(F.lit("\n"), F.expr(SHIFT)), _filled(text))
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "doc_id", _filled(path).alias("path"), F.lit(language).alias("language"), below.alias("text"))


def _scopes(language: str) -> tuple[Query, str]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return code.scopes(code.parsed(_sources(spark, d, language)))

    return query, f"SELECT doc_id AS file_id, scope_type, {_with_id('name')} AS name, CAST(start_line + {SHIFT} AS INT) AS start_line, CAST(end_line + {SHIFT} AS INT) AS end_line, CAST(depth AS INT) AS depth FROM documents, {_values(SCOPES[language], 'scope_type, name, start_line, end_line, depth')}"


def _imports(language: str) -> tuple[Query, str]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = code.imports(code.parsed(_sources(spark, d, language)))
        aliases = F.array_join(F.transform("name_aliases", lambda a: F.concat(a["original"], F.lit("="), a["alias"])), " ")
        return rows.select("file_id", "ord", "module", F.when(F.col("names").isNotNull(), F.array_join("names", " ")).alias("names"), "alias", aliases.alias("aliases"), "is_star", "is_relative")

    rows = [(k, *r) for k, r in enumerate(IMPORTS[language])]
    return query, f"SELECT doc_id AS file_id, CAST(ord AS INT) AS ord, {_with_id('module')} AS module, {_with_id('names')} AS names, {_with_id('alias')} AS alias, {_with_id('aliases')} AS aliases, is_star, is_relative FROM documents, {_values(rows, 'ord, module, names, alias, aliases, is_star, is_relative')}"


def _used(language: str, parsed: DataFrame, sources: DataFrame) -> DataFrame:
    first, last, _ = USED[language]
    shift = F.expr(SHIFT)
    regions = sources.select("file_id", (shift + first).alias("start_line"), (shift + last).alias("end_line"))
    return code.used_symbols(parsed, regions)


def _symbols(language: str) -> tuple[Query, str]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        sources = _sources(spark, d, language)
        return _used(language, code.parsed(sources), sources)

    return query, f"SELECT doc_id AS file_id, {_with_id('symbol')} AS symbol FROM documents, {_values([(s,) for s in USED[language][2]], 'symbol')}"


def _symbol_files(language: str) -> tuple[Query, str]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        sources = _sources(spark, d, language)
        parsed = keep(code.parsed(sources), "parsed")
        used = _used(language, parsed, sources)
        there = F.explode(F.array(*[_filled(f) for f in FILES[language][0]])).alias("path")
        files = sources.select("path").unionByName(table(spark, d, "documents").select(there))
        return code.resolved_files(symbols.resolved_imports(used, code.imports(parsed)), parsed, files).select("file_id", "symbol", "original", "path")

    return query, f"SELECT doc_id AS file_id, {_with_id('symbol')} AS symbol, {_with_id('original')} AS original, {_with_id('path')} AS path FROM documents, {_values(FILES[language][1], 'symbol, original, path')}"


def _first_party(language: str) -> tuple[Query, str]:
    def split(text: F.Column) -> F.Column:
        return F.filter(F.split(text, " "), lambda x: x != "")

    def query(spark: SparkSession, d: str) -> DataFrame:
        cases = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(m).alias("module"), F.lit(r).alias("r"), F.lit(e).alias("e"), F.lit(p).alias("package"), F.lit(n).alias("spaces"), F.lit(x).alias("deps")) for k, (m, r, e, (p, n, x), _) in enumerate(OWN[language])])
        rows = table(spark, d, "documents").select("doc_id", F.inline(cases)).withColumn("module", _filled(F.col("module"))).withColumn("spaces", _filled(F.col("spaces")))
        project = F.struct(F.nullif("package", F.lit("")).alias("package"), split(F.col("spaces")).alias("namespaces"), split(F.col("deps")).alias("dependencies"))
        return rows.select("doc_id", "ord", "module", code.is_first_party(F.lit(language), F.col("module"), F.col("r"), F.col("e"), project).alias("is_own"))

    rows = [(k, m, own) for k, (m, _, _, _, own) in enumerate(OWN[language])]
    return query, f"SELECT doc_id, CAST(ord AS INT) AS ord, {_with_id('module')} AS module, is_own FROM documents, {_values(rows, 'ord, module, is_own')}"


def q_symbol_files_go(spark: SparkSession, d: str) -> DataFrame:
    """Go imports of the module's own packages and the first file of each."""
    imports = code.imports(code.parsed(_sources(spark, d, "go")))
    files = table(spark, d, "documents").select(F.explode(F.array(*[_filled(f"model__ID__/{n}") for n in ("b.go", "a.go", "a_test.go")])).alias("path"))
    return code.go_package_files(imports, "acme.io/app", files)


def q_symbol_files_php(spark: SparkSession, d: str) -> DataFrame:
    """PHP imports by namespace prefixes, then by the usual folders."""
    imports = code.imports(code.parsed(_sources(spark, d, "php"))).where("NOT is_relative")
    files = table(spark, d, "documents").select(F.explode(F.array(*[_filled(f) for f in ("code/Models/User__ID__.php", "src/App/Models/User__ID__.php", "lib/App/Util/First__ID__.php")])).alias("path"))
    return code.php_namespace_files(imports, {"App\\": "code/"}, files)


def q_symbol_files_ruby(spark: SparkSession, d: str) -> DataFrame:
    """Ruby imports that lead to a file, and constants without an import in the folders that the framework loads."""
    sources = _sources(spark, d, "ruby")
    parsed = keep(code.parsed(sources), "parsed")
    files = table(spark, d, "documents").select(F.explode(F.array(*[_filled(f) for f in ("lib/help/h__ID__.rb", "app/models/helper__ID__.rb", "app/helper__ID__.rb")])).alias("path"))
    near = code.imports(parsed).where("is_relative").select("file_id", F.col("module").alias("symbol"), F.col("module").alias("original"), "module", "is_relative", "level")
    found = code.resolved_files(near, parsed, files).select("file_id", "symbol", "path")
    used = _used("ruby", parsed, sources).where("symbol rlike '^[A-Z]'")
    return found.unionByName(code.framework_files(used, "rails", files))


def q_framework_files(spark: SparkSession, d: str) -> DataFrame:
    """Classes in the folders of three frameworks, the first folder first."""
    files = table(spark, d, "documents").select(F.explode(F.array(*[_filled(f) for f in ("app/Services/Post__ID__.php", "app/Models/Post__ID__.php", "app/jobs/user_job__ID__.rb", "lib/shop_web/controllers/page__ID___controller.ex")])).alias("path"))
    out = None
    for framework, symbol in (("laravel", "Post__ID__"), ("rails", "UserJob__ID__"), ("phoenix", "ShopWeb.Page__ID__Controller")):
        wanted = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), _filled(symbol).alias("symbol"))
        found = code.framework_files(wanted, framework, files)
        out = found if out is None else out.unionByName(found)
    return out


#: A document's file has so many pieces of CASES, chosen by its number.
PIECES = 4


def _piece(k: int, n: int) -> str:
    """Which of ``n`` pieces a document has at place ``k``."""
    return f"((doc_id + {k}) * {2 * k + 1} + doc_id DIV {n} * {k + 1}) % {n}"


def _assembled(spark: SparkSession, d: str, language: str) -> DataFrame:
    pieces = F.array(*[F.lit(text) for text, _, _ in CASES[language]])
    text = F.concat(F.lit(HEADS.get(language, "")), *[F.get(pieces, F.expr(f"CAST({_piece(k, len(CASES[language]))} AS INT)")) for k in range(PIECES)])
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), F.lit(language).alias("language"), text.alias("text"))
    return rows


def _placed_sql(language: str) -> str:
    """Each document's pieces in order, with the lines before each."""
    cases, n = CASES[language], len(CASES[language])
    lengths = _values([(k, text.count("\n")) for k, (text, _, _) in enumerate(cases)], "piece, n_lines")
    chosen = " UNION ALL ".join(f"SELECT doc_id, {k} AS place, {_piece(k, n).replace('DIV', '//')} AS piece FROM documents" for k in range(PIECES))
    head = HEADS.get(language, "").count("\n")
    return f"WITH lengths AS (SELECT * FROM {lengths}), chosen AS ({chosen}), placed AS (SELECT doc_id, place, piece, {head} + coalesce(sum(n_lines) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM chosen JOIN lengths USING (piece))"


def _case_scopes(language: str) -> tuple[Query, str]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return code.scopes(code.parsed(_assembled(spark, d, language)))

    rows = [(k, *s) for k, (_, scopes, _) in enumerate(CASES[language]) for s in scopes]
    return query, f"{_placed_sql(language)} SELECT doc_id AS file_id, scope_type, name, CAST(above + first AS INT) AS start_line, CAST(above + last AS INT) AS end_line, CAST(depth AS INT) AS depth FROM placed JOIN {_values(rows, 'piece, scope_type, name, first, last, depth')} USING (piece)"


def _case_symbols(language: str) -> tuple[Query, str]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        sources = _assembled(spark, d, language)
        return code.used_symbols(code.parsed(sources), sources.select("file_id", F.lit(1).alias("start_line"), F.lit(1 << 20).alias("end_line")), builtins=True)

    rows = [(k, s) for k, (_, _, used) in enumerate(CASES[language]) for s in used]
    return query, f"{_placed_sql(language)} SELECT DISTINCT doc_id AS file_id, symbol FROM placed JOIN {_values(rows, 'piece, symbol')} USING (piece)"


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name, make, of in _KINDS:
        out |= {f"q_{name}_{language}": make(language)[0] for language in of}
    return out | {f.__name__: f for f in (q_symbol_files_go, q_symbol_files_php, q_symbol_files_ruby, q_framework_files)}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, make, of in _KINDS:
        out |= {f"q_{name}_{language}": make(language)[1] for language in of}
    return out | {
        "q_symbol_files_go": "SELECT doc_id AS file_id, 'acme.io/app/model' || doc_id AS module, 'model' || doc_id || '/a.go' AS path FROM documents",
        "q_symbol_files_php": "SELECT doc_id AS file_id, 'App\\Models\\User' || doc_id AS module, 'code/Models/User' || doc_id || '.php' AS path FROM documents UNION ALL SELECT doc_id, 'App\\Util\\First' || doc_id, 'lib/App/Util/First' || doc_id || '.php' FROM documents",
        "q_symbol_files_ruby": "SELECT doc_id AS file_id, 'help/h' || doc_id AS symbol, 'lib/help/h' || doc_id || '.rb' AS path FROM documents UNION ALL SELECT doc_id, 'Helper' || doc_id, 'app/models/helper' || doc_id || '.rb' FROM documents",
        "q_framework_files": "SELECT doc_id AS file_id, 'Post' || doc_id AS symbol, 'app/Models/Post' || doc_id || '.php' AS path FROM documents UNION ALL SELECT doc_id, 'UserJob' || doc_id, 'app/jobs/user_job' || doc_id || '.rb' FROM documents UNION ALL SELECT doc_id, 'ShopWeb.Page' || doc_id || 'Controller', 'lib/shop_web/controllers/page' || doc_id || '_controller.ex' FROM documents",
    }


_KINDS = (("scopes", _scopes, SCOPES), ("imports", _imports, IMPORTS), ("symbols", _symbols, USED), ("symbol_files", _symbol_files, FILES), ("first_party", _first_party, OWN), ("case_scopes", _case_scopes, CASES), ("case_symbols", _case_symbols, CASES))
