"""Language identification: many labels, odd rows, calibration against texts in no language."""

import random

import numpy as np
import pytest

from patchloom.llm import langid


def _made(languages, rows=30, seed=1):
    out = []
    for k in range(languages):
        rng = random.Random(1000 * seed + k)
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéñ") for _ in range(3)) for _ in range(12)]
        out += [(f"l{k:03}", " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(rng.randint(8, 30)))) for _ in range(rows)]
    return out


def test_every_label_is_learned_however_many():
    rows = _made(40)
    model = langid.train([t for _, t in rows], [x for x, _ in rows])
    assert model.out is not None and len(model.languages) == 40
    fresh = _made(40, 35)  # the same languages, the last rows unseen
    assert np.mean([model.predict(t)[0] == x for k, (x, t) in enumerate(fresh) if k % 35 >= 30]) > 0.9


def test_texts_in_no_language_are_rejected():
    rows = _made(4, 150)
    model = langid.train([t for _, t in rows], [x for x, _ in rows])
    assert 0 < model.least < 1
    assert np.mean([model.predict(t)[2] for t in langid._foreign(["xyzqw äöü klm"], 200)]) < 2.5 * langid.FOREIGN
    assert np.mean([model.predict(t)[2] for _, t in rows]) > 0.98


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, score string, accepted int"
    empty = spark.createDataFrame([], schema)
    model = langid.fit(empty)
    assert model.languages == [] and langid.identify(empty, model).count() == 0 and langid.accepted(empty, model).count() == 0
    rows = [(k, t, x, "s", 1) for k, (x, t) in enumerate(_made(3, 60))]
    odd = [(None, "words without an id", None, "s", 1), (900, None, "l000", "s", 1), (901, "", None, "s", 1), (902, " 12 !", None, "s", 1), (3, rows[3][1], "l000", "s", 1), (3, rows[3][1], "l000", "s", 1), (903, rows[0][1] * 3000, None, "s", 1)]
    docs = spark.createDataFrame(rows + odd, schema)
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score, by_id[i].accepted) == ("und", 0.0, False) for i in (900, 901, 902))
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and not kept.where("doc_id IN (900, 901, 902)").count() and kept.where("doc_id = 3").count() in (0, 3)
    again = langid.fit(docs.repartition(7))
    assert np.array_equal(again.table, model.table) and again.least == model.least


def test_repeated_ids_do_not_break_the_bound_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 50)
    monkeypatch.setattr(langid, "EACH_AT_LEAST", 5)
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.update(n=len(texts)) or langid.LanguageModel([], np.zeros((1, 0)), np.zeros(0)))
    one = next(k for k in range(100) if not spark.range(k, k + 1).selectExpr(f"pmod(crc32(cast('{k}' AS binary)), 4) = 2 AS h").first().h)
    docs = spark.range(5000).selectExpr(f"{one}L AS doc_id", "concat('some words ', id) AS text", "'en' AS lang")
    langid.fit(docs)
    assert seen.get("n", 0) <= 100


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([(k, "some text", f"x{k}") for k in range(40)], "doc_id long, text string, lang string"))
