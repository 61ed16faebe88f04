"""Language ID, personal data, licences and preference formatting: held-out accuracy, brute force and SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import langid, licences, pii, preferences

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, accepted string, count long"


def _docs(spark, *rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "", "", 0) for i, t in rows], DOCS)


# --- language ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return langid.fit(documents, rows=150)


def test_language_held_out_accuracy(spark, documents, model):
    got = langid.identify(documents, model).join(documents.select("doc_id", "lang").where(langid.held_out()), "doc_id")
    rows = got.collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.accepted for r in rows]) > 0.99


def test_language_odd_rows(spark, model):
    got = {r.doc_id: r for r in langid.identify(_docs(spark, (1, None), (2, ""), (3, "12 %% 34"), (4, "The thing of the other"), (5, "the " * 50_000)), model).collect()}
    assert all((got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False) for i in (1, 2, 3))
    assert got[4].lang_pred in model.languages and got[5].lang_pred in model.languages
    frame = _docs(spark, (1, None), (4, "The thing of the other"), (4, "The thing of the other"))
    kept = langid.accepted(frame, model)
    assert kept.columns == frame.columns and all(r.doc_id == 4 for r in kept.collect())
    assert langid.accepted(frame.limit(0), model).count() == 0


def test_language_without_labels(spark):
    m = langid.fit(_docs(spark, (1, "text without a label")))
    assert m.languages == [] and langid.identify(_docs(spark, (1, "text")), m).first().lang_pred == "und"


def test_language_learns_from_no_held_out_row(spark, documents, model):
    changed = documents.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = langid.fit(changed, rows=150)
    assert again.languages == model.languages and np.array_equal(again.table, model.table)


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


# --- personal data ----------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain_base(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    alphabet = ["@", ".", "-", "+", " ", "1", "2", "34", "255", "a", "b.c", "x@y.de", "@@", "4111111111111111", "(", ")", "+1 (839) 555-7479", "0.0.0.256", "é", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == _plain_base(text), text
    text, _ = pii._generated(rng)
    assert pii.base_spans(text) == _plain_base(text)


def test_field_is_exact(monkeypatch):
    """Dynamic programming equals the sum and the best over all labellings of a short text."""
    field = pii.trained()
    text = "0 30 1234567 a@b.de 9"
    toks = pii.tokens(text)
    found, s = field.scores(text, toks)
    assert len(found) >= 6
    s = np.clip(s, -2, 2)

    def labellings(at):
        if at >= len(toks):
            yield ()
            return
        yield from labellings(at + 1)
        for k, (i, j) in enumerate(found):
            if i == at:
                for c in range(len(pii.KINDS)):
                    for rest in labellings(j):
                        yield ((k, c), *rest)

    every = [(sum(s[k, c] for k, c in lab), lab) for lab in labellings(0)]
    posterior, log_z = pii._posteriors(len(toks), found, s)
    z = np.logaddexp.reduce([v for v, _ in every])
    assert np.isclose(log_z, z)
    for k in range(len(found)):
        for c in range(len(pii.KINDS)):
            assert np.isclose(posterior[k, c], sum(np.exp(v - z) for v, lab in every if (k, c) in lab))
    best = max(every, key=lambda e: e[0])
    assert np.isclose(sum(s[k, c] for k, c in pii._viterbi(len(toks), found, s)), best[0])


def test_field_held_out_accuracy():
    rng = random.Random(2024)
    right = wrong = missed = 0
    for _ in range(200):
        text, spans = pii._generated(rng)
        got, want = set(pii.trained().spans(text)), set(spans)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.75


@pytest.mark.parametrize("text", ["token = \"5aad00685accefdd91653537b82ad0dab34e35e3\"", "on 12.11.2024 at 9:30", "version 2.10.3", "costs $12.50 or 1,000,000", "the thing at the other. That is", "pages 100-120", ""])
def test_field_leaves_clean_text_alone(text):
    assert pii.all_spans(text, pii.trained())[1] == []


def test_pii_rows(spark):
    frame = _docs(spark, (1, None), (2, ""), (3, "é a.b@c.de, 10.0.0.1 +49 30 1234567 4111 1111 1111 1111"), (3, "é a.b@c.de, 10.0.0.1 +49 30 1234567 4111 1111 1111 1111"), (4, "x" * 200_000 + " a@b.com"), (None, "1.2.3.4"))
    got = {(r.doc_id, r.n_ip): r for r in pii.find(frame).collect()}
    assert got[1, 0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1, 0].spans == "" == got[2, 0].spans
    r = got[3, 1]
    base = _plain_base("é a.b@c.de, 10.0.0.1 +49 30 1234567 4111 1111 1111 1111")
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
    assert r.n_email == 1 and all(f"{k}:{a}:{b}" in r.spans.split(",") for a, b, k in base)
    assert got[4, 0].n_email == 1 and got[None, 1].n_ip == 1
    assert pii.find(frame.limit(0)).count() == 0


def test_masking(spark):
    frame = _docs(spark, (1, None), (2, "clean"), (3, "mail a.b@c.de now"))
    got = {r.doc_id: r for r in pii.mask(frame).collect()}
    assert got[1].text is None and got[2].text == "clean" and got[2].n_chars == 5
    assert got[3].text == "mail <EMAIL> now" and got[3].n_chars == len("mail <EMAIL> now")
    assert pii.masked("a 123 b", [(2, 4, "ip"), (3, 5, "card")]) == "a <IP> b"


# --- licences ---------------------------------------------------------------------------------------------------------------------


def test_licence_families(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache-2.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd", "licensed electrician needed": "", "the apache helicopter has a permission": "", "plain words": "",
        "Licensed under the Mozilla Public License Version 2.0": "mpl-2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    }
    frame = _docs(spark, *enumerate(f"some prose\n{k}\nmore prose" for k in lines))
    got = {r.doc_id: r for r in licences.scan(frame).collect()}
    assert [got[i].licences for i in range(len(lines))] == list(lines.values())


def test_licence_model_held_out_accuracy():
    model = licences.trained()
    rng = random.Random(77)
    right = total = 0
    for text, want in licences._variants(rng):
        at = [model.vocabulary[g] for g in licences.grams_of(text) if g in model.vocabulary]
        z = model.weights[at].sum(axis=0) + model.bias
        right += int(z.argmax()) == want
        total += 1
    assert right / total > 0.95


def test_licence_scores_equal_numpy(spark):
    model = licences.trained()
    text = "Licensed under the Apache License, Version 2.0."
    r = licences.scan_paragraphs(_docs(spark, (1, text))).first()
    at = [model.vocabulary[g] for g in licences.grams_of(text) if g in model.vocabulary]
    p = licences._softmax(((model.weights[at].sum(axis=0) + model.bias) / model.temperature)[None, :])[0]
    assert r.family == "apache-2.0" and r.confirmed and abs(r.score - p.max()) < 1e-4


def test_licence_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License.\n" * 3), (3, "Released under the MIT License.\n" * 3), (None, "Released under the MIT License."), (5, "x " * 100_000 + "\nLicensed under CC BY-NC 4.0.")]
    got = licences.scan(_docs(spark, *rows)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.licences, r.n_licences) for r in got) == sorted([("1", "", 0), ("2", "", 0), ("3", "mit", 3), ("3", "mit", 3), ("None", "mit", 1), ("5", "cc-by-nc", 1)])
    assert licences.scan(_docs(spark).limit(0)).count() == 0


def test_licence_plan_has_no_python(spark):
    plan = licences.scan(_docs(spark, (1, "x")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- preferences ------------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, chosen string, opening long"


def _turns(spark, conversations):
    return spark.createDataFrame([(c, k, role, text, "", 0) for c, turns in conversations for k, (role, text) in enumerate(turns)], TURNS)


U, A = "user", "assistant"
CONVERSATIONS = [
    (1, [(U, "q"), (A, "good answer"), (U, "more"), (A, "yes")]), (2, [(U, "q"), (A, "good answer"), (U, "other"), (A, "no")]), (3, [(U, "q"), (A, "bad")]), (4, [(U, "alone"), (A, "x")]),
    (5, [(U, "q"), (A, "good answer"), (U, "more"), (A, "yes")]), (6, [(U, "ü \n"), (None, None)]), (7, [(U, "ü \n"), ("system", ""), (A, "é")]),
]


def _formatted(turns):
    return preferences.format_pairs(preferences.paired(turns))


def test_preferences(spark):
    got = {(r.chosen_id, r.rejected_id): r for r in _formatted(_turns(spark, CONVERSATIONS)).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 5), (4, None), (7, 6)}
    r = got[1, 2]
    assert r.prompt_turns == 2 and r.prompt == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood answer<|im_end|>\n"
    assert r.rejected_completion == "<|im_start|>user\nother<|im_end|>\n<|im_start|>assistant\nno<|im_end|>\n"
    for side in ("chosen", "rejected"):
        text, mask = r[f"{side}_completion"], r[f"{side}_mask"]
        assert mask[0].start == 0 and mask[-1].end == len(text) and all(a.end == b.start for a, b in zip(mask, mask[1:], strict=False))
    assert [r.chosen_completion[m.start : m.end] for m in r.chosen_mask if m.train] == ["yes<|im_end|>"]
    same = got[1, 5]
    assert same.prompt_turns == 4 and same.chosen_completion == "" == same.rejected_completion and same.chosen_mask == []
    alone = got[4, None]
    assert alone.prompt == "" and alone.rejected_completion == "" and alone.chosen_completion.endswith("x<|im_end|>\n")


def test_preferences_equal_sql(spark, tmp_path):
    turns = _turns(spark, [*CONVERSATIONS, (8, [(U, "q"), (A, "good answer"), (U, "more"), (A, "yes"), (U, "long " * 30_000)])])
    turns = turns.union(turns.limit(2)).union(spark.createDataFrame([(None, 0, U, "q", "", 0), (9, None, U, "q", "", 0), (9, 1, A, "bad", "", 0)], TURNS))
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(preferences.OP3_SQL)
    df = preferences.op3_preferences(spark, str(tmp_path))
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=key) == sorted((tuple(r) for r in want.fetchall()), key=key)


def test_preferences_of_no_rows(spark):
    assert _formatted(_turns(spark, [])).count() == 0


def test_preference_plan_has_no_python(spark):
    plan = _formatted(_turns(spark, CONVERSATIONS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_masks_of_long_conversations(spark):
    """100,000 turns are masked in seconds, and running sums are right at the edges of their blocks."""
    import time

    from patchloom.llm import preferences as P

    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(P.ends(P.F.transform(P.F.sequence(P.F.lit(0), P.F.lit(n)), lambda k: k % 7)).alias("e"), P.ends(P.F.array().cast("array<int>")).alias("none")).first()
        assert row["e"] == [sum(k % 7 for k in range(j + 1)) for j in range(n + 1)] and row["none"] == []
    turns = spark.range(100_000).select(P.F.lit(1).alias("conv_id"), "id", P.F.lit("assistant").alias("role"), P.F.concat(P.F.lit("t"), "id").alias("text"))
    pair = turns.groupBy("conv_id").agg(P.F.sort_array(P.F.collect_list(P.F.struct(P.F.col("id").alias("turn"), "role", "text"))).alias("chosen")).withColumn("rejected", P.F.slice("chosen", 1, 2))
    began = time.perf_counter()
    row = P.format_pairs(pair).select(P.F.size("chosen_mask").alias("n"), P.F.element_at("chosen_mask", -1)["end"].alias("end"), P.F.length("chosen_completion").alias("chars")).first()
    assert row["n"] == 3 * 99_998 and row["end"] == row["chars"] and time.perf_counter() - began < 40
