"""Progress of a review, and reviewers that never answer."""

import subprocess
import sys
import textwrap
import threading
import time
from pathlib import Path

from pyspark.sql import functions as F

from patchloom.operators import review

CALLS = "k long, file_path string, prompt string"


def test_every_file_is_told_once(spark):
    told = []
    calls = spark.createDataFrame([(k, f"f{k}", "x" if k % 3 else "") for k in range(40)], CALLS).repartition(5)
    with review.Progress(spark, 40, lambda *x: told.append(x), every=0.05) as progress:
        got = review.answers(calls, review.SecretStub(), keys=["k"], progress=progress)
        assert got.where("error IS NOT NULL").count() == 14
        got.count()  # runs again: partitions that are known say nothing new
    assert [d for _, d, _ in told] == list(range(1, 41)) and told[-1][1:] == (40, 40)
    assert {p for p, _, _ in told} == {f"f{k}" for k in range(40)}


def test_no_prompts(spark):
    told = []
    with review.Progress(spark, 0, lambda *x: told.append(x)) as progress:
        assert review.answers(spark.createDataFrame([], CALLS), review.SecretStub(), progress=progress).count() == 0
    assert told == []


def test_a_retried_task_counts_once(tmp_path):
    """A task that fails at first: the last call has all files, and none is told twice."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {str(Path(review.__file__).parents[2])!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        from patchloom.operators import review
        from patchloom.shipping import ship
        ship(spark)
        def reviewer(prompt):
            if prompt == "7" and not os.path.exists({str(tmp_path / "once")!r}):
                open({str(tmp_path / "once")!r}, "w").close()
                os._exit(1)
            return '{{"findings": []}}'
        told = []
        calls = spark.createDataFrame([(k, f"f{{k}}", str(k)) for k in range(12)], {CALLS!r}).repartition(4)
        with review.Progress(spark, 12, lambda *x: told.append(x)) as p:
            n = review.answers(calls, reviewer, progress=p).count()
        assert n == 12 and [x[1:] for x in told] == [(k, 12) for k in range(1, 13)] and len({{x[0] for x in told}}) == 12, told
        print("told all")
    """))
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=170)
    assert "told all" in done.stdout, done.stdout + done.stderr[-2000:]
    assert (tmp_path / "once").exists()


def test_threads_of_late_calls_are_bounded(spark):
    class Never:
        def __call__(self, prompt):
            if threading.active_count() > 40:
                return "too many threads"
            time.sleep(60)
            return "{}"

    calls = spark.createDataFrame([(k, f"f{k}", "x") for k in range(200)], CALLS).coalesce(1)
    began = time.perf_counter()
    got = review.answers(calls, Never(), concurrent=2, timeout=0.3, keys=["k"])
    assert {r["error_type"]: r["count"] for r in got.groupBy("error_type").count().collect()} == {"timeout": 200}
    assert time.perf_counter() - began < 30
    assert got.select(F.max("raw")).first()[0] is None


def test_each_prompt_is_asked_once(spark, tmp_path):
    """Findings, broken answers and failures come from one pass of calls."""

    def reviewer(prompt):
        with open(f"{tmp_path}/asked", "a") as f:
            f.write(prompt + "\n")
        if prompt.endswith("3"):
            raise review.ReviewError("auth")
        return "no json" if prompt.endswith("5") else '{"findings": []}'

    calls = spark.createDataFrame([(k, f"f{k}", f"p{k}") for k in range(30)], CALLS).repartition(4)
    got = review.reviewed(calls, reviewer, ["k"]).collect()
    assert sorted(r.error_type for r in got) == ["auth"] * 3 + ["malformed"] * 3
    assert sorted((tmp_path / "asked").read_text().split()) == sorted(f"p{k}" for k in range(30))


def test_calls_share_few_threads(spark):
    """A task starts no thread for each call: 2,000 calls, three at once, come from a few threads and overlap."""

    def reviewer(prompt):
        time.sleep(0.0002)
        return f"{threading.current_thread().name} {threading.active_count()}"

    calls = spark.range(2000, numPartitions=1).selectExpr("id AS k", "'f' AS file_path", "string(id) AS prompt")
    names = [r.raw.rsplit(" ", 1)[0] for r in review.answers(calls, reviewer, concurrent=3, keys=["k"]).collect()]
    assert len(names) == 2000 and 1 < len(set(names)) <= 9
