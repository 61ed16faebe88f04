"""SimHash and embedding near-duplicates, components and top-k against brute force."""

import numpy as np
import pytest
import xxhash

from patchloom.llm import embedding_dedup, simhash, topk
from patchloom.llm.common import star_edges
from patchloom.llm.components import connected_components

DOCS = "doc_id long, text string, fp string, key long, t string, rep string, n_chars long"


def _components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "ÄÖ Ab cD", "a b c d", "a b c d e f a b c d e f", "x " * 5000, "a b c d e f", "É\x0bF\x0cG"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _slow_fingerprint(text)


def test_masks_bring_close_pairs_together():
    rng = np.random.default_rng(1)
    for blocks in (5, 6, 7, 8):
        masks = np.array(simhash.block_masks(blocks, 4), dtype=np.int64).view(np.uint64)
        for _ in range(200):
            flips = rng.choice(64, 4, replace=False)
            x = np.uint64(sum(1 << int(b) for b in flips))
            assert ((masks & x) == 0).any()


def _base(rng, n=120):
    return [f"w{rng.integers(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def documents():
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(120):
        texts.append(" ".join(_base(rng)))
    for base in (0, 1, 2):  # near copies
        for _ in range(25):
            words = texts[base].split()
            words[int(rng.integers(len(words)))] = "changed"
            texts.append(" ".join(words))
    texts += [texts[5]] * 40 + [None, "", " ", "one", "one", "x y " * 4000]
    return list(enumerate(texts))


@pytest.mark.parametrize("bucket", [1024, 8])
def test_simhash_components(spark, documents, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.DISTANCE, bucket))
    rows = [(10 * i, t, "x", i, "y", "z", 0) for i, t in documents]
    rows += [rows[3], (None, "one", "", 0, "", "", 0), (None, "alone in the world of null ids", "", 0, "", "", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    prints = [simhash.fingerprint(t) for _, t in documents]
    pairs = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = {10 * i: 10 * c for i, c in enumerate(_components(len(prints), pairs))}
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.fingerprint == f"{prints[r.doc_id // 10]:016x}"
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted([str(want[10 * next(i for i, t in documents if t == "one")]), "None"])


def test_one_of_each_group(spark, documents):
    rows = [(i, t, "x", i, "y", "z", 0) for i, t in documents]
    frame = spark.createDataFrame([*rows, rows[7], rows[7]], DOCS)
    kept = simhash.one_of_each_group(frame).collect()
    want = {r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(want) and kept[0].asDict().keys() == frame.first().asDict().keys()


def test_empty_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.one_of_each_group(spark.createDataFrame([], DOCS)).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (202, 200), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {201: 200, 202: 200}


def test_star_edges():
    linked = np.eye(6, dtype=bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert star_edges(linked).tolist() == [0, 1, 1, 0, 4, 0]


@pytest.mark.parametrize("bucket", [512, 6])
def test_embedding_links(spark, bucket, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 16)).astype(np.float32)
    near = np.concatenate([x[:3].repeat(12, axis=0) + 0.08 * rng.standard_normal((36, 16)).astype(np.float32), x[4:5].repeat(9, axis=0), 3 * x[6:7]])
    x = np.concatenate([x, near])
    rows = [(i, v.tolist(), i, "a") for i, v in enumerate(x)]
    n = len(rows)
    rows += [(1000, None, 0, ""), (1001, [], 0, ""), (1002, [0.0] * 16, 0, ""), (1003, [1.0, None] * 8, 0, ""), (1004, [float("nan")] * 16, 0, ""), (1005, [float("inf")] * 16, 0, ""), (1006, [1.0, 2.0], 0, ""), (1007, [1.0, 2.0], 0, "")]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, keys string")).collect()}
    assert len(got) == len(rows)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = y @ y.T >= 0.95
    np.fill_diagonal(close, False)
    comp = _components(n, [tuple(p) for p in np.argwhere(close)])
    assert [got[i].n_links for i in range(n)] == close.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(n)] == comp
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert [(got[i].n_links, got[i].component_id) for i in range(1000, 1008)] == [(0, 1000), (0, 1001), (0, 1002), (0, 1003), (0, 1004), (0, 1005), (1, 1006), (1, 1006)]


def test_table_numbers_keep_recall():
    for n in (10, 10_000, 10**7, 10**10):
        bits, tables = embedding_dedup.tables_for(n)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.999 and tables <= embedding_dedup.TABLES_AT_MOST + 1


@pytest.mark.parametrize("queries", [4096, 7])
def test_topk(spark, queries, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 40)) * 0.3
    x[100:140] = x[40]  # ties
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(2000, None, ""), (2020, [float("nan")] * 40, ""), (None, x[0].tolist(), ""), (2040, [1.0, 2.0], ""), (2041, [1.0, -3.0], "")]
    got = {}
    for r in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    z = np.floor(64 * np.concatenate([x, x[:1]])).astype(np.int64)  # the row with a null id is a candidate, the last among ties
    ids = np.arange(701)
    assert set(got) == {*range(0, 700, 20), 2040}
    for q in range(0, 700, 20):
        s = z @ z[q]
        best = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        assert sorted(got[q], key=lambda r: r[0]) == [(k + 1, int(i) if i < 700 else None, int(s[i])) for k, i in enumerate(best)]
    assert got[2040] == [(1, 2041, 64 * 64 - 128 * 192)]


def test_topk_of_few_and_huge(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in topk.nearest(few).orderBy("rank").collect()] == [(1, 1, 8192), (2, 3, 8192)]
    with pytest.raises(ValueError, match="not exact"):
        topk.nearest(spark.createDataFrame([(0, [1e12])], "vec_id long, embedding array<double>"))


def test_sketches_keep_pairs_at_the_bound():
    """Two vectors at the bound keep the sketch filter's bound, and most random pairs don't."""
    rng = np.random.default_rng(4)
    planes, most = embedding_dedup.hyperplanes(32), embedding_dedup.differ_at_most(0.95)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 32))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    apart = ((a @ planes > 0) != (b @ planes > 0)).sum(axis=1)
    assert (apart <= most).mean() >= 0.999
    assert (((a @ planes > 0) != (b[::-1] @ planes > 0)).sum(axis=1) <= most).mean() < 0.01


def test_embeddings_with_repeated_and_null_ids(spark):
    e = [[1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [0.0, 1.0, 0.0], [0.0, 1.0, 0.0]]
    rows = [(5, e[0], "x"), (5, e[1], "y"), (7, e[2], "z"), (None, e[3], "n"), (None, e[0], "n"), (9, None, "q"), (10, [0.0, 0.0, 0.0], "q"), (11, [float("nan"), 1.0, 0.0], "q")]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string"))
    found = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in got.collect())
    assert [f for f in found if f[0] >= 7] == [(7, 1, 7), (9, 0, 9), (10, 0, 10), (11, 0, 11)]
    assert [f[:2] for f in found if f[0] == 5] == [(5, 2), (5, 2)] and all(f[2] == 5 for f in found if f[0] == 5)


@pytest.mark.parametrize("bucket", [512, 6])
def test_embedding_chunks_count_each_link_once(spark, monkeypatch, bucket):
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 16))
    x = np.concatenate([b + 0.12 * rng.standard_normal((20, 16)) for b in base])
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((y @ y.T) >= 0.95).sum(axis=1) - 1
    assert want.sum() > 200 and {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("store", [1 << 17, 7])
def test_topk_of_repeated_and_null_ids_equals_its_sql(spark, monkeypatch, tmp_path, store):
    import duckdb

    monkeypatch.setattr(topk, "STORE", store)
    rng = np.random.default_rng(3)
    ids = [0, 0, 20, 20, 20, 40, 1, 1, 2, None, None, 3, 5, 60]
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 3)]) for i in ids] + [(80, None), (100, [float("inf"), 0.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = str(tmp_path / "embeddings.parquet")
    df.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(con.sql(topk.OP9_SQL).fetchall(), key=key)
    got = sorted((tuple(r) for r in topk.nearest(df).collect()), key=key)
    assert got == want and len(got) == 7 * 13


def test_topk_in_one_job_for_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "SMALL", 16)
    monkeypatch.setattr(topk, "SAMPLE", 30)
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((400, 20)), 2)
    got = topk.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), k=5, every=2)
    z = np.floor(64 * x)
    score = (z @ z.T).astype(int)
    want = set()
    for q in range(0, 400, 2):
        order = sorted((-score[q, c], c) for c in range(400) if c != q)[:5]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(order)}
    assert {tuple(r) for r in got.collect()} == want
