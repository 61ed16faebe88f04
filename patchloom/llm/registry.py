"""Queries of the corpus operators, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchloom.llm.embedding_dedup import OP8_SQL, op8_embedding_dedup
from patchloom.llm.filter_audit import OP13_SQL, op13_filter_audit
from patchloom.llm.interval_join import OP12_SQL, op12_interval_join
from patchloom.llm.langid import op7_langid
from patchloom.llm.lexicon import op5_bpe
from patchloom.llm.licences import op10_licences
from patchloom.llm.lm_scores import op11_lm_scores
from patchloom.llm.packing import op6_packing
from patchloom.llm.pii import op4_pii
from patchloom.llm.preferences import OP3_SQL, op3_preferences
from patchloom.llm.simhash import op1_simhash
from patchloom.llm.token_files import op2_token_files
from patchloom.llm.topk import OP9_SQL, op9_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_token_files": op2_token_files,
        "op3_preferences": op3_preferences,
        "op4_pii": op4_pii,
        "op5_bpe": op5_bpe,
        "op6_packing": op6_packing,
        "op7_langid": op7_langid,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_topk": op9_topk,
        "op10_licences": op10_licences,
        "op11_lm_scores": op11_lm_scores,
        "op12_interval_join": op12_interval_join,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": pipeline,
    }


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op3_preferences": OP3_SQL, "op8_embedding_dedup": OP8_SQL, "op9_topk": OP9_SQL, "op12_interval_join": OP12_SQL, "op13_filter_audit": OP13_SQL}
