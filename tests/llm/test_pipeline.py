"""The pipeline's stages on a small table, one by one, and the whole of it."""

import os
import sys

import pytest

import corpus_pipeline
from patchloom.llm import registry

sys.path.insert(0, os.path.dirname(__file__))
from test_near_copies import _leaders as exact_leaders  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], DATA).cache())
    return out


def test_stages(stages):
    docs, known, single, masked, packed = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "packing"]
    assert all(s.dtypes == docs.dtypes for s in (known, single, masked))
    assert known.count() >= 0.99 * docs.count()
    assert {r.doc_id for r in single.select("doc_id").collect()} == exact_leaders(known.select("doc_id", "text").collect())
    assert masked.count() == single.count() and not masked.where(r"text rlike '[a-z]@[a-z]+\\.[a-z]'").count()
    tokens = packed.groupBy("doc_id").sum("length").collect()
    assert len(tokens) == masked.count()


def test_registry():
    names = list(registry.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and len(names) == 11
    assert corpus_pipeline.ORACLE_SQL is None and set(registry.oracle_sql()) <= set(names)


def test_run_equals_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1].count()
