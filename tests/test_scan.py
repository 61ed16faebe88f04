"""A review from diff text to verdict."""

import re

import pytest
from pyspark.sql import functions as F

from patchloom.functions.text import lines
from patchloom.operators import review
from patchloom.plans import review_catalog, scan
from patchloom.sources.files import Config, SourceError

APP = "from lib.db import query as q\n\n\nclass Api:\n    def get(self, user):\n        token = 1\n        return q(user)\n"
DB = "def query(x):\n    return x\n"
VUE = "<template/>\n<script>\nfunction go() {\n  return 1;\n}\n</script>\n"
DIFF = """diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -5,2 +5,3 @@
     def get(self, user):
+        token = 1
         return q(user)
diff --git a/node_modules/x.js b/node_modules/x.js
--- a/node_modules/x.js
+++ b/node_modules/x.js
@@ -1 +1 @@
-a
+b
diff --git a/p.vue b/p.vue
--- a/p.vue
+++ b/p.vue
@@ -4 +4 @@
-  return 0;
+  return 1;
diff --git a/bad.py b/bad.py
--- a/bad.py
+++ b/bad.py
@@ -1 +1 @@
-a
+b
"""


@pytest.fixture(scope="module")
def tables(spark):
    changes = spark.createDataFrame([(1, DIFF)], "diff_id long, text string")
    rows = [("app.py", APP, None), ("lib/db.py", DB, None), ("p.vue", VUE, None), ("bad.py", None, "binary file")]
    sources = spark.createDataFrame(rows, "path string, text string, error string").select("path", "text", lines("text").alias("lines"), "error")
    return changes, sources


def test_contexts(tables):
    got = {r.path: r for r in scan.contexts(*tables, Config(hunk_expansion_lines=2)).collect()}
    assert set(got) == {"app.py", "p.vue"}
    app = got["app.py"]
    assert (app.region_start_line, app.n_region_lines) == (3, 5) and app.expanded_region.startswith("\nclass Api:")
    assert [(s.type, s.name) for s in app.scopes] == [("function", "get")] and "token = 1" in app.scopes[0].source
    assert [(s.name, s.file, s.code) for s in app.symbols] == [("q", "lib/db.py", DB.rstrip("\n"))]
    assert [(s.name, s.start_line, s.end_line) for s in got["p.vue"].scopes] == [("go", 3, 5)]


def test_scan(spark, tables):
    got = scan.scan(spark, *tables, review.SecretStub())
    assert [(r.file_path, r.severity) for r in got.findings.collect()] == [("app.py", "High")]
    assert got.blocks.first().should_block is True
    assert [(r.file_path, r.error) for r in got.errors.collect()] == [("bad.py", "binary file")]
    known = got.findings.select("finding_id")
    again = scan.scan(spark, *tables, review.SecretStub(), Config(thresholds={"High": "block"}), known)
    assert again.new.count() == 0 and again.blocks.first().should_block is False
    assert got.prompts.where(F.col("prompt").contains("### Referenced Definitions")).count() == 1


def test_ready(tables):
    assert scan.check_ready(review.SecretStub(), tables[0]) and not scan.check_ready(review.SecretStub(), tables[0].limit(0))
    with pytest.raises(SourceError):
        scan.check_ready(None, tables[0])


def test_diffs_of_one_path_stay_apart(spark, tables):
    changes = spark.createDataFrame([(1, DIFF), (2, DIFF)], "diff_id long, text string")
    got = scan.scan(spark, changes, tables[1], review.SecretStub())
    assert sorted((r.diff_id, r.file_path) for r in got.findings.collect()) == [(1, "app.py"), (2, "app.py")]
    assert sorted((r.diff_id, r.file_path, r.error_type) for r in got.errors.collect()) == [(1, "bad.py", "unreadable"), (2, "bad.py", "unreadable")]
    assert review.error_messages(got.errors).where("message = 'binary file'").count() == 2


def test_a_late_call_holds_up_nothing(spark):
    import time

    class Slow:
        def __call__(self, prompt):
            time.sleep(30 if prompt == "slow" else 0.05)
            return '{"findings": []}'

    calls = spark.createDataFrame([(k, f"f{k}", "slow" if k in (0, 3) else "quick") for k in range(8)], "k long, file_path string, prompt string").coalesce(1)
    began = time.perf_counter()
    got = {r.k: r.error_type for r in review.answers(calls, Slow(), concurrent=2, timeout=1.0, keys=["k"]).collect()}
    assert time.perf_counter() - began < 20
    assert got == {k: "timeout" if k in (0, 3) else None for k in range(8)}


def test_long_definitions_are_cut(spark):
    long = "def query(x):\n" + "".join(f"    y{k} = {k}\n" for k in range(50))
    rows = [("app.py", APP, None), ("lib/db.py", long, None), ("p.vue", VUE, None), ("bad.py", None, "binary file")]
    sources = spark.createDataFrame(rows, "path string, text string, error string").select("path", "text", lines("text").alias("lines"), "error")
    got = {r.path: r for r in scan.contexts(spark.createDataFrame([(1, DIFF)], "diff_id long, text string"), sources, Config(scope_size_limit=10)).collect()}
    assert got["app.py"].symbols[0].code.endswith("... (truncated 41 lines)")


@pytest.mark.parametrize("query", ["q_scan_contexts", "q_scan_results"])
def test_no_table_of_a_review_goes_through_the_driver(spark, query):
    """No step of a review of many small diffs sends a table to all executors, however few bytes it has."""
    def executed() -> dict[int, str]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {r.executionId(): r.physicalPlanDescription() for r in map(runs.apply, range(runs.size()))}

    before = max(executed(), default=-1)
    assert review_catalog.queries()[query](spark, "/root/testdata/sf0.001").collect()
    plans = [plan for k, plan in executed().items() if k > before]
    sent = {keys for p in plans for keys in re.findall(r"^\(\d+\) BroadcastHashJoin.*\nLeft keys \[\d+\]: \[(.*)\]", p, re.M)}
    assert any("SortMergeJoin" in p for p in plans) and {re.sub("#[0-9]+", "", k) for k in sent} <= {"cwe_id"}  # the table of weaknesses is a fixed one
