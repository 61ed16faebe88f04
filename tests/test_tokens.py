"""Token counts against a plain loop of merges."""

import base64
import random

import pytest
import regex
from pyspark.sql import functions as F

from patchloom.operators import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _plain(piece, ranks, memo={}):  # noqa: B006
    if piece not in memo:
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        memo[piece] = len(parts)
    return memo[piece]


def test_all_documents(spark, ranks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("x").alias("tokens_"))
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == sum(_plain(p.encode(), ranks) for p in regex.findall(tokens.PATTERN, r["text"] or ""))


def test_odd_texts(spark, ranks):
    r = random.Random(4)
    texts = [None, "", " ", "\n\n  a", "'s're'LL", "日本語 é́ 🙂", "a" * 5000, " " * 3000 + "b", "\x00\x7f", "x1 y22 333", *("".join(r.choice("abc teh in's\n!é") for _ in range(80)) for _ in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {x["k"]: x["tokens"] for x in tokens.token_counts(df, PATH).collect()}
    assert got == {k: sum(_plain(p.encode(), ranks) for p in regex.findall(tokens.PATTERN, t or "")) for k, t in enumerate(texts)}
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 2000)
    m = tokens.Merges(PATH)
    whole = m.count(" ".join(f"word{k}x" for k in range(500)))
    assert len(m.memo) < 40 and whole == sum(m.count(f"{' ' * bool(k)}word{k}x") for k in range(500))
