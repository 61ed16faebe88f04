"""The interval join against plain loops: relations, open ends, hot keys, sessions, odd tables."""

import datetime as dt
import random
import zlib

import numpy as np
import pytest

from patchloom.llm import interval_join as ij

ROWS = "id long, key long, lo long, hi long, weight long"
INF = 1 << 50


def _slow(left, right):
    out = {}
    for i, k, lo, hi in left:
        for _, key, a, b, w in right:
            if None in (k, lo, a) or k != key:
                continue
            e, f = INF if hi is None else hi, INF if b is None else b
            if e < lo or f < a or a > e or f < lo:
                continue
            start = "earlier" if lo < a else "equal" if lo == a else "later"
            end = 0 if e < f else 1 if e == f else 2
            name = {"earlier": ("overlaps", "finished_by", "contains"), "equal": ("starts", "equals", "started_by"), "later": ("during", "finishes", "overlapped_by")}[start][end]
            n, slots, weight = out.get((i, name), (0, None, 0))
            if not (e == f == INF):
                slots = (slots or 0) + min(e, f) - max(lo, a) + 1
            out[i, name] = (n + 1, slots, weight + w)
    return out


def _intervals(n, keys, seed, null=0.05):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lo = None if r.random() < null else r.randint(-40, 60)
        hi = None if r.random() < 0.2 else (lo or 0) + r.randint(-1, 12)
        rows.append((None if r.random() < 0.02 else i, None if r.random() < null else r.choice(keys), lo, hi, r.getrandbits(32)))
    return rows


def _got(df):
    return {(r["id"], r["relation"]): (r["n_pairs"], r["overlap_slots"], r["weight"]) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 3])
def test_relations_equal_loops(spark, monkeypatch, block):
    monkeypatch.setattr(ij, "BLOCK", block)  # with 3, most keys are cut into blocks
    left, right = _intervals(160, [1, 1, 1, 2, 3, -7], 1), _intervals(120, [1, 1, 2, 3, 9], 2)
    left += left[:20]  # repeated rows count twice
    a, b = spark.createDataFrame(left, ROWS).withColumn("block", ij.F.lit("x")), spark.createDataFrame(right, ROWS)
    assert _got(ij.overlap_relations(a, b)) == _slow([r[:4] for r in left], right)
    pairs = ij.overlap_pairs(a, b).collect()
    assert len(pairs) == sum(n for n, _, _ in _slow([r[:4] for r in left], right).values())
    assert {r["relation"] for r in pairs} == set(ij.RELATIONS)


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_slices_hold_all_pairs(most):
    r = np.random.default_rng(3)
    lk, rk = np.sort(r.integers(0, 4, 50)), np.sort(r.integers(0, 5, 60))
    llo, rlo = r.integers(-20, 20, 50), r.integers(-20, 20, 60)
    lhi, rhi = llo + r.integers(0, 9, 50), rlo + r.integers(0, 9, 60)
    got = [(int(a), int(b)) for x, y in ij.overlaps(lk, llo, lhi, rk, rlo, rhi, most) for a, b in zip(x, y, strict=True)]
    assert sorted(got) == [(a, b) for a in range(50) for b in range(60) if lk[a] == rk[b] and llo[a] <= rhi[b] and rlo[b] <= lhi[a]]


def test_a_hot_key_lies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ij, "BLOCK", 50)
    left = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 7 else id end as key", "id % 10 as lo", "id % 10 + 2 as hi")
    right = spark.range(30).selectExpr("id", "7L as key", "id as lo", "id + 1 as hi", "1L as weight")
    blocks = ij._blocks(left.withColumn("weight", ij.F.lit(1)), right)
    sizes = {r["block"]: r["count"] for r in blocks.where("key = 7 and is_left").groupBy("block").count().collect()}
    assert len(sizes) >= 10 and max(sizes.values()) < 130 and sum(sizes.values()) == 668
    assert blocks.where("key = 7 and not is_left").groupBy("block").count().select("count").distinct().collect()[0][0] == 30


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], ROWS), spark.createDataFrame([(1, 1, 0, 5, 3)], ROWS)
    for a, b in ((none, some), (some, none), (none, none)):
        assert ij.overlap_relations(a, b).count() == ij.overlap_pairs(a, b).count() == 0


def _at(us):
    return None if us is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


def test_sessions_equal_loops(spark):
    r = random.Random(5)
    gap = ij.GAP_US
    rows = [(r.choice([1, 2, None]), r.choice([None, "error", "view"]), r.randint(-40, 40) * gap // 7 + r.choice([0, 0, 1, -1])) for _ in range(150)]
    rows += [(3, "error", 0), (3, "view", gap), (3, "view", 2 * gap + 1), (4, "view", 5), (4, "error", 5), (4, "error", 5), (1, "view", None)]
    clicks = spark.createDataFrame([(c, k, _at(u), "x") for c, k, u in rows], "client_id long, kind string, ts timestamp_ntz, us string")
    want = set()
    for c in {c for c, _, _ in rows if c is not None}:
        at = sorted({u for k, _, u in rows if k == c and u is not None})
        run = []
        for u in [*at, None]:
            if run and (u is None or u - run[-1] > gap):
                want.add((c, run[0], run[-1], any(k == "error" for d, k, v in rows if d == c and v == run[-1])))
                run = []
            run.append(u)
    assert {tuple(x) for x in ij.click_sessions(clicks).collect()} == want
    assert ij.click_sessions(clicks.limit(0)).count() == 0


def test_micros_without_a_zone(spark):
    values = [dt.datetime(2024, 3, 10, 2, 30, 0, 123456), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 11, 3, 1, 30)]
    df = spark.createDataFrame([(v,) for v in values], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in df.select(ij.micros(ij.F.col("ts")), ij.slot(ij.micros(ij.F.col("ts")))).collect()]
        slots = [r[0] for r in df.select(ij.slot(ij.micros(ij.F.col("ts")))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(v - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for v in values]
    assert slots == [g // ij.SLOT_US for g in got]


def test_sales_with_odd_rows(spark):
    hour = 3_600_000_000
    sales = [(1, 5, "done", _at(0)), (1, 5, "done", _at(0)), (2, 5, "open", _at(hour)), (None, 5, None, _at(2)), (4, None, "done", _at(3)), (5, 6, "done", None)]
    lines = [(1, _at(9 * hour)), (1, None), (2, _at(-hour)), (None, _at(99 * hour)), (5, _at(1))]
    got = ij.sale_intervals(spark.createDataFrame(sales, "sale_id long, client_id long, status string, sold_at timestamp_ntz"), spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 5, 0, 9 * hour, False)] * 2 + [(2, 5, hour, hour, True), (None, 5, 2, 2, False)], key=str)


def test_query_equals_loops(spark):
    folder = "/root/testdata/sf0.001"
    sales, lines, clicks = (ij.load(spark, folder, n).toPandas() for n in ("sales", "sale_lines", "clicks"))
    us = lambda s: [None if x is np.datetime64("NaT") or str(x) == "NaT" else int(x.value // 1000) for x in s]
    shipped = {}
    for s, u in zip(lines["sale_id"], us(lines["shipped_at"]), strict=True):
        if u is not None and s == s:
            shipped[int(s)] = max(u, shipped.get(int(s), u))
    left = [(int(i), int(c), u // ij.SLOT_US, None if st == "open" else max(u, shipped.get(int(i), u)) // ij.SLOT_US) for i, c, st, u in zip(sales["sale_id"], sales["client_id"], sales["status"], us(sales["sold_at"]), strict=True) if c == c and u is not None]
    by = {}
    for c, k, u in zip(clicks["client_id"], clicks["kind"], us(clicks["ts"]), strict=True):
        if c == c and u is not None:
            by.setdefault(int(c), []).append((u, k == "error"))
    right = []
    for c, seen in by.items():
        seen.sort()
        first = 0
        for k in range(1, len(seen) + 1):
            if k == len(seen) or seen[k][0] - seen[k - 1][0] > ij.GAP_US:
                a, b = seen[first][0], seen[k - 1][0]
                right.append((None, c, a // ij.SLOT_US, None if any(e for u, e in seen[first:k] if u == b) else b // ij.SLOT_US, zlib.crc32(str(a).encode())))
                first = k
    got = {(r["sale_id"], r["relation"]): (r["n_pairs"], r["overlap_slots"], r["sessions_crc"]) for r in ij.op12_interval_join(spark, folder).collect()}
    assert got and got == _slow(left, right)
