"""Diff parsing on small diffs written for these tests."""

import random
import re

import pytest
from pyspark.sql import functions as F

from patchloom.operators import diffs
from patchloom.sources import files

TWO = """diff --git a/src/a.py b/src/a.py
index 1..2 100644
--- a/src/a.py
+++ b/src/a.py
@@ -10,3 +10,4 @@ def f():
 keep
-gone
+new one
+new two
\\ No newline at end of file
@@ -40 +41 @@
-x
+y
diff --git a/old name.txt b/new name.txt
similarity index 100%
rename from old name.txt
rename to new name.txt
diff --git a/gone.bin b/gone.bin
deleted file mode 100644
Binary files a/gone.bin and /dev/null differ
diff --git a/run.sh b/run.sh
old mode 100644
new mode 100755
"""


def _diffs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "diff_id long, text string")


def test_files(spark):
    rows = diffs.diff_files(_diffs(spark, TWO)).orderBy("file_no").collect()
    assert [r.path for r in rows] == ["src/a.py", "new name.txt", "gone.bin", "run.sh"]
    assert [r.is_renamed for r in rows] == [False, True, False, False]
    assert [r.is_deleted for r in rows] == [False, False, True, False]
    assert [r.is_binary for r in rows] == [False, False, True, False]
    assert [r.mode_changed for r in rows] == [False, False, False, True]
    assert rows[1].old_path == "old name.txt"


def test_hunks_and_lines(spark):
    d = _diffs(spark, TWO)
    assert [tuple(r)[3:] for r in diffs.hunks(d).orderBy("hunk_no").collect()] == [(10, 3, 10, 4), (40, 1, 41, 1)]
    lines = diffs.diff_lines(d).orderBy("hunk_no", "pos").collect()
    assert [(r.line_num, r.change_type, r.content) for r in lines] == [(10, " ", "keep"), (11, "-", "gone"), (11, "+", "new one"), (12, "+", "new two"), (41, "-", "x"), (41, "+", "y")]


def test_several_diffs_blank_and_new_files(spark):
    new = "diff --git a/n.go b/n.go\nnew file mode 100644\n--- /dev/null\n+++ b/n.go\n@@ -0,0 +1,2 @@\n+package n\n\n+func F() {}\n"
    d = _diffs(spark, "", "  \n", new, TWO)
    files = diffs.diff_files(d).collect()
    assert sorted(r.diff_id for r in files) == [2, 3, 3, 3, 3]
    one = [r for r in files if r.diff_id == 2][0]
    assert one.is_new_file and one.path == "n.go"
    # An empty line inside a hunk, whose leading blank was lost, is dropped.
    lines = diffs.diff_lines(d).where("diff_id = 2").orderBy("pos").collect()
    assert [(r.line_num, r.content) for r in lines] == [(1, "package n"), (2, "func F() {}")]


def test_quoted_paths(spark):
    text = 'diff --git "a/t\\303\\244b\\t.txt" "b/t\\303\\244b\\t.txt"\n--- "a/t\\303\\244b\\t.txt"\n+++ "b/t\\303\\244b\\t.txt"\n@@ -1 +1 @@\n-a\n+b\n'
    row = diffs.diff_files(_diffs(spark, text)).first()
    assert row.path == "t\xc3\xa4b\t.txt"  # each octal byte is one character
    assert diffs.unquote_c('"a\\nb" rest') == ("a\nb", " rest")
    assert diffs.unquote_c('"say \\"hi\\" \\\\ \\101"') == ('say "hi" \\ A', "")
    assert diffs.unquote_c("plain") == ("plain", "")


def test_header_with_separator_inside(spark):
    text = "diff --git a/x b/y.txt b/x b/y.txt\n--- a/x b/y.txt\n+++ b/x b/y.txt\n@@ -1 +1 @@\n-a\n+b\n"
    assert diffs.diff_files(_diffs(spark, text)).first().path == "x b/y.txt"


def _plainly(text):
    """A plain reading of a diff: (kind, file, hunk, number, line) of each line."""
    out, file, hunk, start, at = [], 0, 0, 0, 0
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            file, hunk = file + 1, 0
            out.append(("header", file, 0, None, line))
            continue
        if not file:
            continue
        m = re.match(diffs.HUNK, line)
        if hunk and line[:1] in (" ", "+", "-") and line:
            out.append(("body", file, hunk, at, line))
            at += line[0] != "-"
        elif m:
            hunk, at = hunk + 1, int(m[3])
            out.append(("hunk", file, hunk, None, line))
        else:
            out.append(("skip" if hunk else "meta", file, hunk, None, line))
    return out


def _random_diff(seed, n):
    r = random.Random(seed)
    made = []
    for _ in range(n):
        made.append(r.choice(["diff --git a/x b/x", "@@ -1 +%d @@" % r.randint(0, 99), "+a", "-b", " c", " d", "+e", "", "\\ No newline", "--- a/x", "+++ b/x", "new file mode", "@@ broken", "diff --gitx"]))
    return "\n".join(made)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_blocks_change_nothing(spark, monkeypatch, size):
    """Files, hunks and line numbers are the same however a diff is cut into blocks."""
    monkeypatch.setattr(diffs, "BLOCK", size)
    texts = [TWO, "", "x\n+y", "+a\n" + TWO * 2, *(_random_diff(k, 60) for k in range(12))]
    got = {}
    for r in diffs.marked_lines(_diffs(spark, *texts)).orderBy("pos").collect():
        got.setdefault(r.diff_id, []).append((r.kind, r.file_no, r.hunk_no, r.line_num, r.line))
    for k, text in enumerate(texts):
        want = _plainly(text)
        while want and want[-1][4] == "" and text.endswith("\n"):  # a line break at the end begins no line
            want = want[:-1]
            break
        assert got.get(k, []) == want, text


def test_one_diff_spreads_over_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(diffs, "BLOCK", 1000)
    body = "".join(f"+line {k}\n" for k in range(30_000))
    text = f"diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -0,0 +1,30000 @@\n{body}" + TWO
    blocks = diffs.line_blocks(_diffs(spark, text)).groupBy("block").count().collect()
    assert len(blocks) == 31 and max(r["count"] for r in blocks) == 1000
    marked = diffs.marked_lines(_diffs(spark, text))
    lines = diffs.diff_lines(marked).where("file_no = 1")
    assert lines.agg({"line_num": "max"}).first()[0] == lines.count() == 30_000
    assert diffs.diff_files(marked).count() == 5
    (tmp_path / "big.diff").write_text(text)
    monkeypatch.setattr(files, "SPLIT_BYTES", 1 << 15)
    read = files.diff_lines(spark, str(tmp_path))
    assert read.select("block").distinct().count() > 5
    again = diffs.marked_lines(read).select("pos", "line", "file_no", "hunk_no", "kind", "line_num")
    assert again.exceptAll(marked.select("pos", "line", "file_no", "hunk_no", "kind", "line_num")).count() == 0 and again.count() == marked.count()


def test_quotations_are_decoded_without_python(spark):
    """Equal to a search for quotations and ``unquote_c`` of each, on texts of all kinds of marks; and files of a diff need no Python worker."""
    marks = ['"', '"', "\\", '\\"', "\\\\", "\\n", "\\101", "\\303\\251", "\\777", "\\8", "a", " b/", "é", "😀", "\\😀", "1", "\t"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(marks, k=rng.randrange(12))) for _ in range(3000)] + ['diff --git "a/' + "\\303\\251" * 20_000 + '.py" "b/x.py"']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", diffs._unquoted_line(F.col("t")).alias("u")).collect()
    want = [re.sub(r'"(?:[^"\\]|\\[\s\S])*"', lambda m: diffs.unquote_c(m[0])[0], t) for t in texts]
    assert [r["u"] for r in sorted(rows)] == want
    plan = diffs.diff_files(spark.createDataFrame([(1, "diff --git a/x b/x\n")], "diff_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
