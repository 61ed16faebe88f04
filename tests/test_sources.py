"""Sources, reports and the stream on files of these tests."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from patchloom.operators import reports
from patchloom.sources import files as S
from patchloom.streaming import diff_stream


def test_config():
    c = S.config_from('hunk_expansion_lines = 3\nmin_confidence = " MEDIUM "\nunknown = 1\n[thresholds]\nhigh = "Warn"\n')
    assert c.hunk_expansion_lines == 3 and c.min_confidence == "Medium" and c.thresholds["High"] == "warn" and c.thresholds["Critical"] == "block"
    assert S.config_from("# only a comment\n") == S.Config() == S.config_from("")
    assert len(S.Config().sensitive()) == 80 and len(S.Config(use_default_sensitive_patterns=False, sensitive_patterns=("x",)).sensitive()) == 1


@pytest.mark.parametrize("text", ["hunk_expansion_lines = -1", "timeout = 0", "max_concurrent_api_calls = 0", "temperature = 3.0", "model = '  '", "min_confidence = 'x'", "a = [", "thresholds = 1", "fail_on_error = 'x'", "timeout = true", "sensitive_patterns = 'x'"])
def test_bad_config(text):
    with pytest.raises(S.SourceError):
        S.config_from(text)


def test_find_config(tmp_path):
    (tmp_path / ".patchloom.toml").write_text("timeout = 7\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert S.find_config(str(tmp_path / "a" / "b")).timeout == 7


def test_git(tmp_path):
    with pytest.raises(S.SourceError):
        S.staged_diff(str(tmp_path))
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "trunk")
    assert S.head_commit(str(tmp_path)) is None
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "a.py")
    assert "+x = 1" in S.staged_diff(str(tmp_path))
    run("-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", "m")
    assert len(S.head_commit(str(tmp_path))) == 40 and S.branch(str(tmp_path)) == "trunk"
    run("checkout", "-q", "--detach")
    assert S.branch(str(tmp_path)) is None


def test_files(spark, tmp_path):
    for name, data in {"a.py": b"x\r\ny\n", "b.bin": b"a\x00b", "c.txt": b"\xff\xfeok", "d.txt": b"", "e.txt": b"P\x0cQ 0"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in S.source_files(spark, str(tmp_path)).collect()}
    assert rows["a.py"].lines == ["x", "y"] and rows["a.py"].error is None
    assert rows["b.bin"].error == "binary file" and rows["b.bin"].text is None
    assert rows["c.txt"].text.endswith("ok") and "�" in rows["c.txt"].text
    assert "d.txt" not in rows and rows["e.txt"].error is None


def test_baseline_files(spark, tmp_path):
    entry = {"finding_id": "cwe1-0123456789abcdef", "cwe_id": "CWE-1", "code_hash": "", "reason": "r", "added_at": "t", "extra": 1}
    path = tmp_path / "base.json"
    assert S.baseline(spark, str(path)).count() == 0
    path.write_text("  \n")
    assert S.baseline(spark, str(path)).count() == 0
    path.write_text(json.dumps({"version": "1.0", "entries": [entry]}))
    rows = S.baseline(spark, str(path))
    assert rows.first().file_path is None and rows.count() == 1
    reports.write_baseline(rows, str(tmp_path / "deep" / "copy.json"))
    assert json.loads((tmp_path / "deep" / "copy.json").read_text())["entries"] == [{k: v for k, v in entry.items() if k != "extra"}]
    for bad in ("[1]", "{", json.dumps({"entries": [{"finding_id": "x"}]})):
        path.write_text(bad)
        with pytest.raises(Exception, match="baseline"):
            S.baseline(spark, str(path)).collect()
    cache = tmp_path / "scan.json"
    cache.write_text(json.dumps({"scan_time": "t", "findings": [{"finding_id": "a"}, {"finding_id": "b", "severity": "Low"}]}))
    assert [(r.ord, r.finding_id, r.severity) for r in S.scan_cache(spark, str(cache)).collect()] == [(0, "a", None), (1, "b", "Low")]
    cache.write_text("{broken")
    assert S.scan_cache(spark, str(cache)).count() == 0


def test_manifests(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.npm_name(F.lit('{"name": "n", "workspaces": ["a"]}'))) == "n" and one(S.npm_workspaces(F.lit('{"workspaces": ["a", "b"]}'))) == ["a", "b"]
    assert one(S.go_module(F.lit("// x\nmodule acme.io/a\n"))) == "acme.io/a"
    assert one(S.gemfile_gems(F.lit("gem 'a'\n  gem \"b\"\ngem 'a'\n"))) == ["a", "b"] and one(S.gemfile_gems(F.lit("none"))) is None
    assert one(S.composer_prefixes(F.lit(json.dumps({"autoload": {"psr-4": {"A\\": "src/", "B\\": ["x/", "y/"]}}, "autoload-dev": {"psr-4": {"A\\": "dev/"}}})))) == {"A\\": "dev/", "B\\": "x/"}
    mix = "def project do [app: :shop, version: 1] end\n defp deps do [{:phoenix, \"1\"}, {:jason, \"2\"}] end"
    assert one(S.mix_app(F.lit(mix))) == "shop" and one(S.mix_dependencies(F.lit(mix))) == ["phoenix", "jason"]
    assert one(S.java_base_package(F.lit("<project><groupId> com.a </groupId></project>"), F.lit(None).cast("string"), F.lit("x"))) == "com.a"
    assert one(S.java_base_package(F.lit(""), F.lit("group = 'g.h'"), F.lit("x"))) == "g.h"
    projects = spark.createDataFrame([("p", "manage.py", ""), ("p", "app.py", "app = Flask(__name__)"), ("q", "main.py", "x")], "project string, path string, text string")
    got = {r.project: r for r in S.frameworks(projects).collect()}
    assert got["p"].django and got["p"].flask and not got["p"].rails and not got["q"].fastapi
    wp = spark.createDataFrame([("p", "my.php", "/* Plugin Name: x */"), ("q", "style.css", "none"), ("q", "inc/my.php", "Plugin Name: x")], "project string, path string, text string")
    assert {r.project: r.wordpress for r in S.frameworks(wp).collect()} == {"p": True, "q": False}
    tree = ["shop/__init__.py", "shop/models.py", "apps/blog/__init__.py", "apps/blog/views.py", "a/b/c/__init__.py", "a/b/c/models.py", "lib/__init__.py", "manage.py"]
    assert {r.app for r in S.django_apps(spark.createDataFrame([("p", t) for t in tree], "project string, path string")).collect()} == {"shop", "apps.blog"}


def test_reports(spark, tmp_path):
    rows = [("id1", "w" * 80, "y", "h", "High", "Low", "CWE-1", None, "a.py", 3, 9, 1), ("id2", "x", "y", "h", "Info", "High", None, None, None, None, None, 0)]
    f = spark.createDataFrame(rows, "finding_id string, what string, why string, how_to_fix string, severity string, confidence string, cwe_id string, owasp_category string, file_path string, line_start int, line_end int, ord int")
    errors = spark.createDataFrame([("b.py", "late", "timeout")], "file_path string, error string, error_type string")
    doc = reports.report(f, errors.limit(0), {"branch": None, "files": 2}, "ord", "2026-01-01T00:00:00Z", suppressed=1)
    assert doc["summary"] == {"total": 2, "critical": 0, "high": 1, "medium": 0, "low": 0, "info": 1, "suppressed": 1}
    assert [x["finding_id"] for x in doc["findings"]] == ["id2", "id1"] and doc["findings"][1]["line_range"] == {"start": 3, "end": 9} and "cwe_id" not in doc["findings"][0]
    assert "errors" not in doc and doc["metadata"] == {"files": 2}
    reports.write_document(doc, str(tmp_path / "x" / "r.json"))
    assert (tmp_path / "x" / "r.json").read_text().endswith("}\n")
    assert reports.summary_line(f, 1).first().summary == "1 High, 1 Info (1 suppressed)" and reports.summary_line(f.limit(0)).first().summary == "No findings"
    assert {r.place: len(r.what) for r in reports.table_rows(f).collect()} == {"a.py:3-9": 60, "(unknown)": 1}
    assert reports.status(f, errors).first().exit_code == 2 and reports.status(f, errors, fail_on_error=False).first().exit_code == 1
    assert reports.status(f, errors.limit(0), overrides={"High": "allow"}).first().exit_code == 0
    prompts = spark.createDataFrame([("b", 5), ("a", 7)], "path string, tokens long")
    d = reports.dry_run(prompts, 3, 10).first()
    assert (d.dry_run, d.staged_files, d.analyzed_files, d.total_tokens, [x.path for x in d.files]) == (True, 3, 2, 32, ["a", "b"])
    reports.write_findings(f, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.diff").write_text(f"diff --git a/f{k}.py b/f{k}.py\n--- a/f{k}.py\n+++ b/f{k}.py\n@@ -1 +1 @@\n-a\n+b\n")
    query = diff_stream.write_parsed(diff_stream.stream_diffs(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted((r.path, r.language) for r in spark.read.parquet(str(tmp_path / "out" / "files")).collect()) == [(f"f{k}.py", "python") for k in range(3)]
    assert spark.read.parquet(str(tmp_path / "out" / "lines")).count() == 6


def test_reports_of_any_size(spark, tmp_path):
    """A report written by tasks equals the document gathered on the driver, in its order; parts are joined as files."""
    n = 5000
    found = spark.range(n).selectExpr("id AS ord", "concat('id', id) AS finding_id", "concat('what \"', id, '\" é') AS what", "element_at(array('Critical', 'High', 'Low'), CAST(id % 3 AS INT) + 1) AS severity", "CASE WHEN id % 4 > 0 THEN 'a.py' END AS file_path", "CASE WHEN id % 2 = 0 THEN 3 END AS line_start", "9 AS line_end").repartition(6)
    errors = spark.createDataFrame([("x.py", "no \"answer\"", None), ("y.py", "late", "timeout")], "file_path string, error string, error_type string")
    for rows, failed, suppressed in ((found, errors, 2), (found.limit(0), errors.limit(0), None), (found.where("ord = 0"), errors.limit(0), 0)):
        at = tmp_path / "deep" / "report.json"
        reports.write_report(rows, failed, {"branch": "b", "files": 2, "none": None}, "ord", "2026-01-01T00:00:00Z", str(at), suppressed)
        assert json.loads(at.read_text("utf-8")) == reports.report(rows, failed, {"branch": "b", "files": 2, "none": None}, "ord", "2026-01-01T00:00:00Z", suppressed)
        assert [p.name for p in at.parent.iterdir()] == ["report.json"]
    reports.write_scan_cache(found.withColumn("cwe_id", F.lit(None).cast("string")), str(tmp_path / "cache.json"), "2026-01-01T00:00:00Z")
    assert S.scan_cache(spark, str(tmp_path / "cache.json")).where("what = 'what \"7\" é' AND cwe_id IS NULL").count() == 1
    assert S.scan_cache(spark, str(tmp_path / "cache.json")).count() == n
