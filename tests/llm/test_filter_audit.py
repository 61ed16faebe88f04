"""The filter audit against a plain simulation of every order, and duplicates against a dictionary of texts."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from patchloom.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, part string, mask long, length string, block_0 long, n int"


def _table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, "x", 2, 3) for i, t, lang in rows], DOCS)


def _rows(seed=4):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(130)] + ["É", "Ab", "CD", "x|y", "#tag", "ß"]
    texts = [None, "", " \t\n", "A", "AAAAAAAAAA" * 20, "#", "a " * 300, " ".join(f"w{k}" for k in range(100)), " ".join(f"w{k}" for k in range(99))]
    texts += ["".join(r.choice(words) + r.choice([" ", "\n", "\x0b", "  "]) for _ in range(r.choice([5, 90, 110, 140, 700]))) for _ in range(40)]
    texts += [" ".join(f"w{k % 125}" for k in range(n)) for n in (100, 156, 157, 200)]
    rows = [(k, t, r.choice(["en", "de", None, ""])) for k, t in enumerate(texts * 2)]
    r.shuffle(rows)
    return [*rows, (None, texts[-1], "en"), (3, "", "en"), (3, "", "en"), (None, None, None)]


def _fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        found = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), bool(set(t) & set("#$%&*|")), i is not None and i > first[t]]
        out.append("".join(x for x, f in zip("ABCDE", found, strict=True) if f))
    return out


def _simulated(rows, labels):
    fails, out = _fails(rows), {}
    docs = [(lang or "", f, any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)) for (i, _, lang), f in zip(rows, fails, strict=True)]
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, stay = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                total[x] = total.get(x, 0) + len(gone)
                redundant = sum(x in d[1] for d in own) - len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), redundant, sum(d[1] == x for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = stay
        for key, row in out.items():
            if key[0] == part:
                row.append(total[key[1][key[2] - 1]])
    return out


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, 1, None), (5, None, 1), (None, 1, 1), (60, 1, 1), (60, 1, 1), (7, 0, 0), (9999, 1, 1)]


def test_audit_equals_a_simulation_of_all_orders(spark):
    rows = _rows()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: list(r)[3:] for r in fa.audit(fa.counted(fa.marked(_table(spark, rows)), labels)).collect()}
    assert got == _simulated(rows, LABELS)
    assert len(got) == 600 * len({lang or "" for _, _, lang in rows})


@pytest.mark.parametrize("coarse", [False, True])
def test_copies_equal_a_dictionary(spark, monkeypatch, coarse):
    if coarse:  # hashes that always collide: full texts must tell texts of one length apart
        monkeypatch.setattr(fa, "split_columns", lambda text: [F.char_length(text).alias("length"), *(F.lit(0).cast("long").alias(n) for n in fa.SPLITS[1:])])
    rows = [(k, t, None) for k, t in enumerate(["abc", "abd", "abc", "abd", "", None, "xyz", "abc", "é" * 3000, "é" * 2999 + "e", "é" * 3000, "q"])] + [(7, "abc", None), (None, "q", None)]
    docs = _table(spark, rows)
    split = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", *fa.split_columns(F.col("text")))
    got = sorted((r["doc_id"], r["first_id"]) for r in fa.copies(docs, split).collect())
    assert got == [(2, 0), (3, 1), (5, 4), (7, 0), (10, 8)]


def test_masks_of_odd_rows(spark):
    rows = _rows(9)
    got = sorted((str(r["doc_id"]), r["part"], r["mask"]) for r in fa.marked(_table(spark, rows)).collect())
    assert got == sorted((str(i), lang or "", sum(1 << "ABCDE".index(x) for x in f)) for (i, _, lang), f in zip(rows, _fails(rows), strict=True))


def test_empty_tables(spark):
    none = _table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.counted(fa.marked(none), labels)).count() == 0
    got = fa.audit(fa.counted(fa.marked(_table(spark, [(1, "a", "en")])), labels)).collect()
    assert len(got) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in got)


def test_long_texts(spark):
    text = " ".join(f"word{k}" for k in range(200_000))
    rows = [(1, text, "en"), (2, text, "en"), (3, text[:-1] + "x", "en")]
    got = {r["doc_id"]: r["mask"] for r in fa.marked(_table(spark, rows)).collect()}
    assert got == {1: 0, 2: 16, 3: 0}
