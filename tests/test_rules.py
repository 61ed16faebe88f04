"""Filters, regions, findings, prompts and text functions on small fixtures."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import text as X
from patchloom.operators import baseline, filters, findings, prompts, regions, review, symbols


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "want"), [("a/b.PY", "python"), ("x.blade.php", "html"), ("x.php", "php"), (".py", None), ("dir/Makefile", "makefile"), ("makefile.txt", None), ("a.d.ts", "typescript"), ("noext", None), ("a.b/c", None)])
def test_language(spark, path, want):
    assert one(spark, filters.language(F.lit(path))) == want


def test_vendored_and_sensitive(spark):
    paths = ["log/a.py", "blog/a.py", "x/log/a.py", "vendor.py", "app/[slug]/.env", "a/.env.local", "keys/ID_RSA", "home/.aws/credentials", ".aws/credentials", "x.aws/credentials", "my.env", "a/b.pem.txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", filters.is_vendored("path").alias("v"), filters.sensitive_pattern("path").alias("s")).collect()
    assert {r.path for r in rows if r.v} == {"log/a.py", "x/log/a.py"}
    assert {r.path: r.s for r in rows if r.s} == {"app/[slug]/.env": ".env", "a/.env.local": ".env.*", "keys/ID_RSA": "id_rsa", "home/.aws/credentials": ".aws/credentials", ".aws/credentials": ".aws/credentials", "my.env": "*.env"}


def test_globs_agree_with_the_driver(spark):
    from patchloom.sources.files import glob_matches

    paths = ["a/.ENV", "x/service-account-1.json", ".docker/config.json", "p/.docker/config.json", "p.docker/config.json", "a.tfstate.1", "vault.yml/x", "z/gcloudx.json"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.s for r in frame.select("path", filters.sensitive_pattern("path").alias("s")).collect()}
    for p in paths:
        assert got[p] == next((g for g in C.SENSITIVE_GLOBS if glob_matches(p, g)), None)


@pytest.mark.parametrize(
    ("path", "lines", "lang", "want"),
    [
        ("a/migrations/1.py", ["", "# Generated by Django 5"], "python", True), ("a.py", ["x", " # DO NOT EDIT"], "python", True), ("a.py", ["", "", "", "", "", "# DO NOT EDIT"], "python", False),
        ("a.min.js", ["x"], "javascript", True), ("a.js", ["x" * 501], "javascript", True), ("a.js", ["x" * 500], "javascript", False), ("a.js", [], "javascript", False),
        ("t.d.ts", ["/* Generated by x */"], "typescript", True), ("t.ts", ["/* Generated by x */"], "typescript", False), ("b/generated/A.java", [], "java", True), ("A.java", ["@Generated(1)"], "java", True),
        ("db/schema.rb", [], "ruby", True), ("mock_a.go", [], "go", True), ("a.go", ["//go:build x", "", "// Code generated by t. DO NOT EDIT."], "go", True), ("a.go", ["package a", "// Code generated by t. DO NOT EDIT."], "go", False),
        ("var/cache/a.php", [], "php", True), ("a.php", ["x @generated y"], "php", True), ("a.ex", ["# Generated by x"], "elixir", True), ("a.css", ["x" * 900], "css", False),
    ],
)
def test_generated(spark, path, lines, lang, want):
    frame = spark.createDataFrame([(path, lines, lang)], "path string, lines array<string>, lang string")
    assert frame.select(filters.is_generated("path", "lines", "lang").alias("x")).first().x is want


@pytest.mark.parametrize(("start", "count", "n", "length", "want"), [(100, 10, 50, 500, (50, 159)), (3, 2, 50, 500, (1, 54)), (495, 4, 50, 500, (445, 500)), (5, 3, 0, 9, (5, 7)), (5, 0, 0, 9, (5, 5)), (5, 1, 3, 0, (1, 0))])
def test_expansion(spark, start, count, n, length, want):
    assert tuple(one(spark, regions.expanded(F.lit(start), F.lit(count), n, F.lit(length)))) == want


def test_merge(spark):
    rows = [(1, 5, 9), (1, 1, 4), (1, 11, 12), (1, 6, 7), (2, 3, 3), (3, 1, 0), (4, 1, 10), (4, 2, 3), (4, 12, 20), (4, 9, 11)]
    got = regions.merged(spark.createDataFrame(rows, "f long, start_line int, end_line int"), ["f"]).orderBy("f", "start_line").collect()
    assert [tuple(r) for r in got] == [(1, 1, 9), (1, 11, 12), (2, 3, 3), (4, 1, 20)]


def test_file_regions(spark):
    files = spark.createDataFrame([(1, 30, True, False, False), (2, 30, False, True, False), (3, 100, False, False, False), (4, 0, True, False, False)], "f long, file_length int, is_new_file boolean, is_deleted boolean, is_binary boolean")
    hunks = spark.createDataFrame([(1, 1, 30), (2, 1, 3), (3, 10, 2), (3, 20, 1)], "f long, new_start int, new_count int")
    got = regions.file_regions(files, hunks, ["f"], 3).orderBy("f", "start_line").collect()
    assert [tuple(r) for r in got] == [(1, 1, 30), (3, 7, 14), (3, 17, 23)]


def test_innermost_and_text(spark):
    scopes = spark.createDataFrame([(1, "class", "A", 1, 300, 1), (1, "function", "f", 100, 130, 2), (1, "function", "g", 200, 210, 2)], "f long, scope_type string, name string, start_line int, end_line int, depth int")
    lines = spark.createDataFrame([(1, 0), (1, 5), (1, 110), (1, 205), (1, 301), (1, 120)], "f long, line_num int")
    found = regions.innermost(lines, scopes, ["f"])
    assert {r.line_num: r["name"] for r in found.collect()} == {5: "A", 110: "f", 205: "g", 120: "f"}
    seen = regions.distinct_scopes(found, ["f"], "line_num").orderBy("first_seen").collect()
    assert [(r["name"], r.first_seen) for r in seen] == [("A", 5), ("f", 110), ("g", 205)]
    body = F.array(*[F.lit(c) for c in "abcdef"])
    assert one(spark, regions.scope_text(body, F.lit(2), F.lit(6), 3)) == "b\nc\nd\n... (truncated 2 lines)"
    assert one(spark, regions.scope_text(body, F.lit(2), F.lit(6), 3, F.lit(True))) == "b\nc\nd\ne\nf"


GOOD = {"what": "a", "why": "b", "how_to_fix": "c", "severity": "HIGH ", "confidence": "odd", "cwe_id": "89", "line_range": {"start": 9, "end": 4}}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (json.dumps({"findings": [GOOD]}), [("High", "Medium", "CWE-89", 4, 9, None)]),
        ("x\n```json\n" + json.dumps({"findings": [GOOD]}) + "\n```\ny", [("High", "Medium", "CWE-89", 4, 9, None)]),
        ("see " + json.dumps({"findings": [GOOD]}) + " ok", [("High", "Medium", "CWE-89", 4, 9, None)]),
        (json.dumps([{"findings": []}]), []),
        (json.dumps({"findings": []}), []),
        ("no json", [(None, None, None, None, None, "no JSON object")]),
        ("[1]", [(None, None, None, None, None, "no JSON object")]),
        (json.dumps({"other": 1}), [(None, None, None, None, None, "no findings array")]),
        (json.dumps({"findings": [GOOD, {"what": "x"}]}), [(None, None, None, None, None, "missing required field")]),
        (json.dumps({"findings": [GOOD | {"line_range": [3, 8, 9]}]}), [("High", "Medium", "CWE-89", 3, 8, None)]),
        (json.dumps({"findings": [GOOD | {"line_range": [-1, 8]}]}), [(None, None, None, None, None, "bad line range")]),
        (json.dumps({"findings": [GOOD | {"line_range": {"start": 3}}]}), [("High", "Medium", "CWE-89", None, None, None)]),
    ],
)
def test_answers(spark, raw, want):
    got = findings.parsed(spark.createDataFrame([("f", raw)], "file_path string, raw string")).collect()
    assert [(r.severity, r.confidence, r.cwe_id, r.line_start, r.line_end, r.error) for r in got] == want


def test_rating_thresholds_and_counts(spark):
    rows = [(1, "CWE-89", "Info", "High"), (2, "CWE-89", "Info", "Low"), (3, "CWE-9999", "Critical", "Low"), (4, None, "Low", "Low"), (5, "CWE-1164", "High", "High")]
    rated = findings.rated(spark.createDataFrame(rows, "id int, cwe_id string, severity string, confidence string"))
    assert {r.id: r.severity for r in rated.collect()} == {1: "High", 2: "Medium", 3: "Medium", 4: "Low", 5: "Info"}
    assert {r.severity: r.n for r in findings.by_severity(rated).collect()} == {"Critical": 0, "High": 1, "Medium": 2, "Low": 1, "Info": 1}
    assert {r.action: r.n for r in findings.actions(rated).collect()} == {"block": 1, "warn": 2, "allow": 2}
    assert findings.blocks(rated).first().should_block is True
    assert findings.blocks(rated, {"High": "warn"}).first().should_block is False
    assert findings.blocks(rated.limit(0)).first().should_block is False
    assert len(C.cwe_severities()) == 295
    assert len(C.SENSITIVE_GLOBS) == 80


def test_baseline_steps(spark):
    base = spark.createDataFrame([("a", "C", "", "r", "t", None)], baseline.ENTRY)
    scan = spark.createDataFrame([("a", "C", "p", "Low", 0), ("b", None, "p", "Info", 1), ("b", "D", "q", "Low", 2), ("c", "E", None, "High", 3)], "finding_id string, cwe_id string, file_path string, severity string, ord int")
    more = baseline.added(base, baseline.bulk_entries(scan, "why", "now"))
    assert sorted((r.finding_id, r.cwe_id, r.file_path) for r in more.collect()) == [("a", "C", None), ("b", "", "p")]
    assert [r.finding_id for r in baseline.removed(more, "a").collect()] == ["b"]
    assert sorted(r.finding_id for r in findings.suppressed(scan, more).collect()) == ["c"]
    entries = spark.createDataFrame([("b", None, None), ("z", None, "k")], "finding_id string, cwe_id string, file_path string")
    assert sorted((r.finding_id, r.cwe_id, r.file_path) for r in findings.enriched(entries, scan).collect()) == [("b", None, "p"), ("z", None, "k")]


@pytest.mark.parametrize(("code", "want"), [("x = 1  # c\n\n  y = '#' # d", "x = 1\ny = '#'"), ('"""doc\nmore"""\nz', "z"), ("'''d'''a\\#b # c", "a\\#b"), ("# only", ""), ('s = "a\\"#b" # c', 's = "a\\"#b"')])
def test_normalised_code(spark, code, want):
    assert one(spark, X.code_normalized(F.lit(code))) == want


def _scanned(line):
    quote, hidden = "", False
    for k, c in enumerate(line):
        if hidden:
            hidden = False
        elif c == "\\":
            hidden = True
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#":
            return line[:k]
    return line


def test_comments_are_found_as_by_a_scan_over_characters(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab'\"\\#\n \t\xa0x") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["a" * 300_000 + "#x", "'\\" * 100_000, 'a "' * 100_000 + " #", " " * 300_000 + "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.code_normalized("t").alias("got")).collect()
    for r in rows:
        plain = re.sub(r"\'\'\'[\s\S]*?\'\'\'", "", re.sub(r'"""[\s\S]*?"""', "", r.t))
        assert r.got == "\n".join(x for x in (_scanned(line).strip() for line in plain.splitlines()) if x)


def test_ids(spark):
    same = [one(spark, X.fingerprint(F.lit(c), F.lit("CWE-89"))) for c in ("a = 1 # x", "  a = 1\n\n")]
    assert same[0] == same[1]
    assert one(spark, X.is_finding_id(F.lit(same[0])))
    a = one(spark, X.finding_id(F.lit(None), F.lit(""), F.lit(None).cast("int"), F.lit("t")))
    assert a.startswith("unknown-")
    assert a != one(spark, X.finding_id(F.lit(None), F.lit("p"), F.lit(None).cast("int"), F.lit("t")))


@pytest.mark.parametrize(("text", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\rc\n\n", ["a", "b", "c", ""]), ("a\x1cb c", ["a", "b", "c"])])
def test_lines(spark, text, want):
    assert one(spark, X.lines(F.lit(text))) == want == text.splitlines()


def test_prompt_parts(spark):
    row = [(1, 0, "a.py", "x\ny", 9999, [(9999, "+", "x"), (9999, "-", "old")], [("function", "f", 1, 2, "src")], [("h", "l.py", "def h()")])]
    schema = "k int, o int, path string, expanded_region string, region_start_line int, diff_lines array<struct<line_num int, change_type string, content string>>, scopes array<struct<type string, name string, start_line int, end_line int, source string>>, symbols array<struct<name string, file string, code string>>"
    frame = spark.createDataFrame(row, schema)
    whole = prompts.prompts(frame, "k", "o").first().prompt
    assert whole.startswith("## File: a.py\n\n### Code Context\n```\n9999 |+ x\n10000 |  y\n```\n\n### Removed Lines\n```\n9999 |- old\n```\n\n### Enclosing Scopes\n- function `f` (lines 1-2):\n```\nsrc\n```\n\n### Referenced Definitions\n**`h`** (from `l.py`):\n```\ndef h()\n```")
    assert whole.endswith(prompts.FOOTER)
    cut = prompts.prompts(frame, "k", "o", 1).first().prompt
    assert "src" not in cut and "def h()" not in cut and "9999 |+ x" in cut and prompts.CUT_MARK in cut
    bare = spark.createDataFrame([(1, 0, "a.py", "", 1, [(7, "+", "b"), (3, "+", "a")], [], [])], schema)
    assert "   3 |+ a\n   7 |+ b" in prompts.prompts(bare, "k", "o").first().prompt


def test_review_errors(spark):
    calls = spark.createDataFrame([("a", "token"), ("b", ""), ("c", "fine")], "file_path string, prompt string")
    got = {r.file_path: (r.severity, r.error) for r in review.reviewed(calls, review.SecretStub()).collect()}
    assert got == {"a": ("High", None), "b": (None, "empty prompt")}
    errors = review.error_messages(spark.createDataFrame([("x", "raw", "timeout"), ("y", "raw", "other")], "file_path string, error string, error_type string"))
    assert {r.file_path: r.message for r in errors.collect()} == {"x": review.MESSAGES["timeout"], "y": "raw"}
    assert review.is_too_long("This model's maximum context is 8") and not review.is_too_long("bad key")


def test_imports_first_match(spark):
    rows = [(1, 0, "a.b", ["x", "y"], None, [("x", "z")]), (1, 1, "os.path", None, None, []), (1, 2, "c", None, "x", [])]
    imports = spark.createDataFrame(rows, "file_id long, ord int, module string, names array<string>, alias string, name_aliases array<struct<original string, alias string>>")
    want = spark.createDataFrame([(1, s) for s in ("x", "y", "z", "os", "path", "none")], "file_id long, symbol string")
    got = {r.symbol: (r.module, r.original) for r in symbols.resolved_imports(want, imports).collect()}
    assert got == {"y": ("a.b", "y"), "z": ("a.b", "x"), "os": ("os.path", "os"), "path": ("os.path", "path"), "x": ("a.b", "x")}


def test_sensitive_names_by_lookup(spark):
    """What lookups find is what the globs match one by one, the first of them, on names made from their parts."""
    import fnmatch
    import random

    from patchloom import constants as C

    r = random.Random(3)
    extra = ("*a?b*", "[xy]z*", "conf/*.Key", "a*b*c", "*", "Deep/er/Name.txt", "*mid*")
    for globs in (C.SENSITIVE_GLOBS, (*C.SENSITIVE_GLOBS[:40], *extra, *C.SENSITIVE_GLOBS[40:])):
        parts = [p for g in globs for p in (g, g.replace("*", ""), g.replace("*", "q"), g.replace("*", ".x."), g.split("*")[0], g.split("*")[-1]) if p]
        paths = {r.choice(["", "/", "src/", "a/b/", ".aws/", "x.env/"]) + r.choice(["", "", "my", "."]) + r.choice(parts) + r.choice(["", "", ".bak", "x"]) for _ in range(3000)}
        paths = sorted(p.upper() if r.random() < 0.1 else p for p in paths)
        got = {x.path: x.s for x in spark.createDataFrame([(p,) for p in paths], "path string").select("path", filters.sensitive_pattern("path", globs).alias("s")).collect()}
        for p in paths:
            low = p.lower()
            want = next((g for g in globs if (fnmatch.fnmatchcase(low, g.lower()) or fnmatch.fnmatchcase(low, f"*/{g.lower()}") if "/" in g else fnmatch.fnmatchcase(low.rsplit("/", 1)[-1], g.lower()))), None)
            assert got[p] == want, (p, got[p], want)


def test_equal_intervals_stay_in_one_region(spark):
    """Many equal intervals at a file's end: regions are those of a loop over the sorted intervals."""
    draw = random.Random(4)
    rows = [(k, min(start, 90), min(start + draw.randrange(9), 90)) for k in range(40) for start in (draw.randrange(1, 200) for _ in range(30))]
    want = []
    for k in range(40):
        mine: list[list[int]] = []
        for start, end in sorted((a, b) for u, a, b in rows if u == k):
            if mine and start <= mine[-1][1] + 1:
                mine[-1][1] = max(mine[-1][1], end)
            else:
                mine.append([start, end])
        want += [(k, a, b) for a, b in mine]
    got = regions.merged(spark.createDataFrame(rows, "k int, start_line int, end_line int").repartition(7), ["k"])
    assert sorted(map(tuple, got.collect())) == want
