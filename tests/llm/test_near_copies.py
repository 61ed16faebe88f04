"""The pipeline's near-duplicate stage against exact similarity of five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patchloom.llm import id_bits, near_copies, sign_blocks, simhash

DATA = "/root/testdata/sf0.01"


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _leaders(rows):
    sets, holders, up = [_shingles(r.text) for r in rows], {}, list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    blank = [k for k, s in enumerate(sets) if not s]
    pairs = [(blank[0], k) for k in blank[1:]]
    for k, s in enumerate(sets):
        for m in {m for x in s for m in holders.get(x, ())}:
            if 5 * len(s & sets[m]) >= 4 * len(s | sets[m]):
                pairs.append((m, k))
        for x in s:
            holders.setdefault(x, []).append(k)
    for a, b in pairs:
        up[top(a)] = top(b)
    least = {}
    for k, r in enumerate(rows):
        least[top(k)] = min(least.get(top(k), r.doc_id), r.doc_id)
    return set(least.values())


def test_stage_keeps_one_of_each_group_by_exact_similarity(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == _leaders(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("fill", [1 << 21, 300])
def test_copies_at_the_bound(spark, fill, monkeypatch):
    monkeypatch.setattr(near_copies, "FILL", fill)
    words = [f"w{k}" for k in range(94)]  # 90 shingles
    at, under = [*words[:-10], *(f"x{k}" for k in range(10))], [*words[:-11], *(f"y{k}" for k in range(11))]  # 80 of 100, 79 of 101
    texts = [(5, " ".join(words)), (3, " ".join(at)), (4, " ".join(under)), (8, " ".join(words).upper()), (1, ""), (2, " \n"), (None, " ".join(words)), (9, "a b")]
    docs = spark.createDataFrame([*texts, (9, "a b")], "doc_id long, text string")
    kept = sorted((r.doc_id or 0) for r in near_copies.one_of_each_group(docs).collect())
    assert kept == [0, 1, 3, 4, 9]


def _copies(seed=4, texts=6, copies=25):
    """Groups of near copies: each a base text with some words changed, on both sides of the bound, and chains of them."""
    rng, out = random.Random(seed), []
    for t in range(texts):
        words = [f"t{t}w{k}" for k in range(rng.choice((12, 60, 150)))]
        for c in range(copies):
            mine = list(words if rng.random() < 0.7 or not out else out[-1].split())
            for _ in range(rng.randint(0, max(1, len(mine) // 40))):
                mine[rng.randrange(len(mine))] = f"c{t}x{c}x{rng.randrange(9)}"
            out.append(" ".join(mine))
    return [*out, *out[:10], "", " ", "one", "one two"]


@pytest.mark.parametrize(("bucket", "fill"), [(1024, 1 << 18), (8, 400), (3, 90)])
def test_chunks_lose_no_link(spark, monkeypatch, bucket, fill):
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    monkeypatch.setattr(near_copies, "FILL", fill)
    docs = spark.createDataFrame(list(enumerate(_copies())), "doc_id long, text string")
    kept = [r.doc_id for r in near_copies.one_of_each_group(docs).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == _leaders(docs.collect())


def test_links_outside_the_largest_component_are_found(spark):
    """Chunks and guests see few links here: pairs of one group whose members lie in different chunks."""
    rng = random.Random(1)
    pairs = [(int(a), int(b)) for a, b in (rng.sample(range(200), 2) for _ in range(150))]

    def check(rows):
        seen = {}
        for r in rows.collect():
            seen.setdefault((r.g, r.i, r.j), set()).add(r.rep)
        found = {(a, b) for members in seen.values() for a, b in pairs if a in members and b in members}
        return spark.createDataFrame(sorted(found), "src long, dst long")

    members = spark.range(200).selectExpr("0L AS g", "id AS rep", "1L AS load")
    got = {r.node: r.component for r in near_copies.joined(members, 20, check).collect()}
    p, q = (np.array(x) for x in zip(*pairs, strict=True))
    want = near_copies._rooted(200, p, q)
    assert got == {k: int(v) for k, v in enumerate(want) if v != k}


def test_number_of_blocks():
    assert near_copies.blocks_for(10) == near_copies.blocks_for(1000)
    bits, blocks = near_copies.blocks_for(10_000_000)
    assert bits == 14 and blocks < 200 and sign_blocks.places(bits, blocks).shape == (blocks, bits)
    assert all(len(set(block)) == bits for block in sign_blocks.places(bits, blocks).tolist())


def test_odd_tables(spark):
    schema = "doc_id long, text string, same long, component_id string"
    assert near_copies.one_of_each_group(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (None, "x", 3, "c"), (None, "x", 4, "d"), (5, long, 5, "e"), (4, long + " end", 6, "f"), (7, "a b c d e f", 7, "g"), (7, "quite another text than that", 8, "h"), (9, "quite another text than that", 9, "i")]
    out = near_copies.one_of_each_group(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "same", "component_id"]
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 4, 7]


def test_bitmap_of_ids_keeps_all_of_them(spark):
    docs = spark.range(20_000).selectExpr("id - 5000 AS doc_id", "cast(id AS string) AS text")
    ids = docs.where("doc_id % 7 = 0").select("doc_id").limit(2500)
    got = near_copies.among(docs, ids)
    assert got.columns == docs.columns and ids.exceptAll(got.select("doc_id")).isEmpty() and got.count() <= ids.count() + 20


def _shuffled(plan) -> int:
    """Bytes that the shuffles of a plan that has run have written."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _shuffled(plan.executedPlan())
    own = plan.getRuntimeStatistics().sizeInBytes().toLong() if plan.nodeName() == "ShuffleQueryStage" else 0
    return own + sum(_shuffled(plan.children().apply(k)) for k in range(plan.children().size()))


def test_texts_of_leaders_do_not_move(spark):
    """What is too large to be sent to all: rows stay where they lie all the same, but for a few, and ids that come again are told apart."""
    docs = spark.range(6000, numPartitions=3).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20), k -> sha2(concat(id, '-', k), 256))) AS text", "id AS p", "id AS page")
    docs = docs.unionByName(docs.where("doc_id IN (7, 5007)")).unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    groups = docs.selectExpr("doc_id", "doc_id % 1000 AS component_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.leaders(docs, groups)
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [-1, -1, -1, *range(1000)]
    assert all(r.p == r.page and (r.doc_id is None or r.p == r.doc_id) and len(r.text) == 1299 for r in rows)
    assert _shuffled(out._jdf.queryExecution().executedPlan()) < 300_000


def test_leaders_whose_bits_are_shared(spark, monkeypatch):
    """With few bits most ids share one with an id of another kind, and the join of what is left decides."""
    monkeypatch.setattr(id_bits, "ID_BITS", 1 << 10)
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text").unionByName(spark.createDataFrame([(7, "x")], "doc_id long, text string"))
    got = simhash.leaders(docs, docs.selectExpr("doc_id", "doc_id % 500 AS component_id"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(500))
