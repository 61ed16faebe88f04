"""Operator 10, licence scans: a trained paragraph classifier, with DataFrame functions only on the main path.

A paragraph is a run of consecutive lines, so hard-wrapped notices are judged whole; it ends at a line without words (comment marks aside),
after a line that ends a sentence, around an SPDX tag, and before a line that begins as a template does. Its word n-grams (one to three words)
are looked up in a table of trained weights, of fixed size and so broadcast, and their sums are the logits of a multinomial logistic
regression over "none", the licence families and "unknown" (other licences, and notices that deny one). Probabilities are taken at a
calibrated temperature; a paragraph whose best family stays under the calibrated bound is unknown too. A prediction counts as confirmed
when enough of the two-word shingles of one of the family's templates stand in the paragraph; an unconfirmed one is unknown. Training runs
on the driver, in numpy, on variants of the templates and on generated counter-examples; the same seed gives the same weights.

Only paragraphs with one of a few words reach the table. The words come from the trained weights: all n-grams without any of them, taken
together, can't lift any class over "none", so a paragraph without those words is none whatever else it holds.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import load

NONE, UNKNOWN = "none", "unknown"
#: Notices as they stand in texts, by family, in lower case and with "license" for "licence".
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("licensed under the apache license version 2.0", "apache license version 2.0", "spdx-license-identifier apache-2.0", "you may not use this file except in compliance with the license"),
    "mit": ("released under the mit license", "licensed under the mit license", "mit license", "spdx-license-identifier mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "spdx-license-identifier gpl-3.0"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "gnu general public license version 2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "spdx-license-identifier gpl-2.0"),
    "lgpl": ("licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license", "gnu lesser general public license", "spdx-license-identifier lgpl-2.1"),
    "agpl-3.0": ("licensed under the gnu affero general public license", "under the terms of the gnu affero general public license", "gnu affero general public license", "spdx-license-identifier agpl-3.0"),
    "bsd": ("licensed under the bsd license", "released under the 3-clause bsd license", "bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "spdx-license-identifier bsd-3-clause"),
    "mpl-2.0": ("licensed under the mozilla public license version 2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license", "spdx-license-identifier mpl-2.0"),
    "cc-by-nc": ("licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license", "spdx-license-identifier cc-by-nc-4.0"),
    "cc-by-sa": ("licensed under cc by-sa 4.0", "licensed under a creative commons attribution-sharealike 4.0 international license", "spdx-license-identifier cc-by-sa-4.0"),
    "cc-by": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license", "spdx-license-identifier cc-by-4.0"),
    "public-domain": ("this is free and unencumbered software released into the public domain", "dedicated to the public domain under cc0 1.0", "spdx-license-identifier cc0-1.0"),
    "isc": ("released under the isc license", "licensed under the isc license", "isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
}
FAMILIES = tuple(TEMPLATES)
CLASSES = (NONE, *FAMILIES, UNKNOWN)
#: Names of other licences, and how a notice denies one; both teach the class "unknown".
OTHERS = ("eclipse public", "boost software", "zlib", "artistic", "common development and distribution", "microsoft public", "open software", "postgresql", "sleepycat", "academic free", "european union public", "python software foundation", "proprietary", "commercial", "enterprise", "end user", "custom", "internal")
DENIALS = ("not licensed under", "not released under", "this is not licensed under", "is not under", "never released under", "no longer licensed under", "no longer available under", "not available under", "isn't licensed under")
#: Comment marks and blanks at the start of a line.
MARKS = r"[ \t/*#;%!>|<-]*"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: The share of a template's shingles that confirms it, and the share of right predictions that the bound on scores may cost.
CONFIRM, LOSE, SEED = 0.6, 0.01, 3


def words_of(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower().replace("licence", "license"))


def grams_of(text: str) -> set[str]:
    """Word n-grams of one to three words."""
    w = words_of(text)
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def shingles_of(text: str) -> set[str]:
    w = words_of(text)
    return {" ".join(w[i : i + 2]) for i in range(len(w) - 1)} or set(w)


@dataclass
class LicenceModel:
    """Weights by n-gram for NONE and each family, a temperature and the least probability of a known family."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def needed(self) -> list[str]:
        """Words of which a paragraph must have one, or else "none" leads: without them, no class gains enough from all n-grams that are left."""
        gain = np.maximum(self.weights[:, 1:] - self.weights[:, :1], 0).astype(np.float64)
        room = (self.bias[0] - self.bias[1:]).astype(np.float64)
        if (room <= 0).any():
            return []  # a paragraph without any n-gram could be a notice: all are looked up
        grams_with: dict[str, list[int]] = {}
        for g, k in self.vocabulary.items():
            for w in set(g.split()) - COMMON:
                grams_with.setdefault(w, []).append(k)
        found: list[str] = []
        while (over := gain.sum(axis=0) - room * 0.999).max() > 0:
            worst = over > 0
            word = max(sorted(grams_with), key=lambda w: gain[grams_with[w]][:, worst].sum())
            found.append(word)
            gain[grams_with.pop(word)] = 0
        return found

    def table(self) -> list[tuple[str, list[float], list[int]]]:
        """(n-gram, weights, templates that have it as a shingle)."""
        numbered = [shingles_of(t) for ts in TEMPLATES.values() for t in ts]
        return [(g, [round(float(v), 6) for v in self.weights[k]], [i for i, s in enumerate(numbered) if g in s]) for g, k in self.vocabulary.items()]


#: Words that any text may hold: counter-examples are full of them, and n-grams of nothing else may speak
#: against a class, but never lift one over "none".
COMMON = frozenset(("the", "of", "and", "or", "to", "in", "is", "a", "for", "any", "this", "with", "by", "as", "under", "use", "you", "may", "not", "free", "public", "software", "version", "work", "file", "files", "source", "code", "form", "forms", "copy", "person", "charge", "purpose", "general", "terms", "either", "except", "international", "into", "are", "without", "no", "never", "longer", "available", "released", "published", "subject", "common", "open", "internal", "custom", "commercial", "end", "user", "union", "foundation", "academic", "fee", "all", "t", "rights", "2.0", "3", "2", "1.0", "4.0", "documentation", "associated", "modify", "development", "european", "python", "microsoft"))


def _variants(rng: random.Random) -> list[tuple[str, int]]:
    """Generated paragraphs and their class: a place in CLASSES."""
    syllables = ("an", "the", "re", "on", "ly", "sch", "eau", "ti", "wh", "er", "ou", "lo", "men")
    common = sorted(COMMON)

    def prose(n: int) -> list[str]:
        return [rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]

    def around(words: list[str]) -> str:
        head = rng.choice(((), (), ("this", "work", "is"), ("this", "software", "is"), ("copyright", str(rng.randint(1990, 2030))), ("the", "code", "is"), tuple(prose(3)), ("distributed", "and"), ("released", "and"), ("see", "the")))
        return " ".join([*head, *words, *prose(rng.choice((0, 0, 2, 6, 20)))])

    out: list[tuple[str, int]] = []
    for k, templates in enumerate(TEMPLATES.values(), 1):
        for _ in range(90):
            w = words_of(rng.choice(templates))
            if w[0] == "licensed" and rng.random() < 0.4:
                w[0] = rng.choice(("distributed", "released", "available", "offered"))
            if rng.random() < 0.3 and len(w) > 5:
                del w[rng.randrange(len(w) - 4)]
            out.append((around(w), k))
    spoken = [t.split(" under ", 1)[1] for ts in TEMPLATES.values() for t in ts if " under " in t]
    for _ in range(500):
        name = rng.choice((*OTHERS, *OTHERS, " ".join(prose(rng.randint(1, 2)))))
        how = rng.choice((f"licensed under the {name} license", f"released under the {name} license {rng.choice(('1.0', '2.0', '3'))}", f"distributed under the terms of the {name} license version {rng.choice(('1.0', '2.0', '3'))}", f"{name} license", f"{name} license version {rng.choice(('1.0', '2.0'))}", f"subject to the {name} license agreement", f"spdx-license-identifier {name.split()[0]}-1.0", "all rights reserved proprietary license"))
        out.append((around(how.split()), len(CLASSES) - 1))
    for _ in range(400):
        out.append((around(words_of(f"{rng.choice(DENIALS)} {rng.choice(spoken)}")), len(CLASSES) - 1))
    odd = ("licensed electrician", "driving license", "permission to enter", "copyright dispute", "apache helicopter", "mit students", "public domain debate", "license plate", "gnu in the zoo", "copyright 2019", "all rights reserved", "redistribution of income", "bsd daemon", "without permission", "apache license fees", "the public license office", "creative commons meeting", "mozilla conference", "eclipse of the sun", "a boost of speed", "granted a wish", "fishing license", "permission granted", "attribution of the work", "binary numbers", "use and redistribution", "a license to sell", "source and binary", "charge of any person", "hereby declared", "associated with", "free of charge", "the lesser evil", "isc meeting", "released into the wild")
    for _ in range(1600):
        w = prose(rng.randint(2, 30))
        if rng.random() < 0.7:
            w[rng.randrange(len(w)) :] = [*rng.choice(odd).split(), *prose(rng.randint(0, 6))]
        out.append((" ".join(w), 0))
    return out


def _phrases() -> list[str]:
    """All that n-grams of the table are taken from."""
    templates = [t for ts in TEMPLATES.values() for t in ts]
    heads = ("distributed under the", "released under the", "available under the", "offered under the", "subject to the", "license agreement", "license version 1.0", "all rights reserved proprietary license", "apache license fees", "driving license", "license plate", "public license office", "fishing license", "a license to", "license to sell")
    return [*templates, *(f"the {o} license" for o in OTHERS), *DENIALS, *(f"{d} {t}" for d in DENIALS for t in ("the", "a", "cc")), *heads]


@cache
def trained(rounds: int = 700, rate: float = 3.0, decay: float = 3e-5) -> LicenceModel:
    """Fit by gradient descent on three of four variants, calibrate on the fourth."""
    rng = random.Random(SEED)
    vocabulary = {g: k for k, g in enumerate(sorted(set().union(*map(grams_of, _phrases()))))}
    data = _variants(rng)
    rng.shuffle(data)
    x = np.zeros((len(data), len(vocabulary)), dtype=np.float32)
    for i, (text, _) in enumerate(data):
        x[i, [vocabulary[g] for g in grams_of(text) if g in vocabulary]] = 1
    y = np.array([c for _, c in data])
    fit, held = np.arange(len(data)) % 4 != 0, np.arange(len(data)) % 4 == 0
    w, b = np.zeros((len(vocabulary), len(CLASSES)), dtype=np.float32), np.zeros(len(CLASSES), dtype=np.float32)
    want = np.eye(len(b), dtype=np.float32)[y[fit]]
    plain = [k for g, k in vocabulary.items() if COMMON.issuperset(g.split())]
    for _ in range(rounds):
        g = (_softmax(x[fit] @ w + b) - want) / fit.sum()
        w -= rate * (x[fit].T @ g + decay * w)
        w[plain] = np.minimum(w[plain], w[plain][:, :1])
        b -= rate * g.sum(axis=0)
    z = x[held] @ w + b
    temperature = float(min(np.geomspace(0.05, 8, 61), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-9).mean()))
    p = _softmax(z / temperature)
    known = (y[held] > 0) & (y[held] < len(CLASSES) - 1)
    right = np.sort(p.max(axis=1)[(p.argmax(axis=1) == y[held]) & known])
    return LicenceModel(vocabulary, w, b, temperature, float(right[int(LOSE * len(right))]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def grams(words: Column) -> Column:
    """Distinct n-grams of one to three words of an array of words."""

    def of(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.array_distinct(F.concat(words, of(2), of(3)))


def paragraphs(low: Column) -> Column:
    """The paragraphs of a text in lower case, each on one line."""
    begins = sorted({" ".join(t.split()[:2]) for ts in TEMPLATES.values() for t in ts if not t.startswith("under the")} | {"this work is", "this program is", "this library is", "this file is", "copyright"})
    end = "\x01"
    steps = (
        (r"\r\n?", "\n"), (rf"(^|\n){MARKS}(?:dnl|rem)\b", "$1"), (r"\n[\s/*#;%!>|<-]*\n", end), (r"([.!?][\"')\]]*+[ \t]*+(?:(?:\*++/|-->)[ \t]*+)?)\n", f"$1{end}"),
        (r"(spdx-license-identifier[^\n\x01]*+)\n?", f"$1{end}"), (rf"\n(?={MARKS}(?:{'|'.join(b.replace('-', '.') for b in begins)}))", end), (rf"\n{MARKS}", " "),
    )
    for pattern, new in steps:
        low = F.regexp_replace(low, pattern, new)
    return F.split(low, end)


def candidates(docs: DataFrame, needed: list[str]) -> DataFrame:
    """One row for each paragraph with a needed word (doc_id, doc, paragraph, words), and one with a null paragraph for a document without any; doc numbers the rows of ``docs``."""
    low = F.replace(F.lower(F.coalesce("text", F.lit(""))), F.lit("licence"), F.lit("license"))
    pattern = r"(?<![a-z0-9])(?:" + "|".join(w.replace(".", r"\.") for w in needed) + r")(?![a-z0-9])" if needed else "[a-z0-9]"
    lines = F.when(low.rlike(pattern), F.filter(F.transform(paragraphs(low), lambda line, k: F.struct(k.alias("paragraph"), line.alias("line"))), lambda p: p["line"].rlike(pattern)))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("doc"))
    rows = numbered.select("doc_id", "doc", F.explode_outer(lines).alias("p"))
    return rows.select("doc_id", "doc", "p.paragraph", F.expr(f"regexp_extract_all(p.line, '{TOKEN}', 0)").alias("words"))


def scan_paragraphs(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """(doc_id, doc, paragraph, family, score, confirmed): one row for each candidate, and one with nulls for a document without any."""
    model = model or trained()
    spark = docs.sparkSession
    rows = json.dumps([{"gram": g, "w": w, "t": t} for g, w, t in model.table()])
    table = F.broadcast(spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<gram string, w array<double>, t array<int>>>")).alias("r")).select("r.*"))  # as many rows as the templates have n-grams
    flat = candidates(docs, model.needed()).select("doc_id", "doc", "paragraph", F.explode_outer(grams(F.col("words"))).alias("gram")).join(table, "gram", "left")
    sizes = [(k, len(shingles_of(t))) for k, ts in enumerate(TEMPLATES.values(), 1) for t in ts]
    sums = [F.coalesce(F.sum(F.col("w")[c]), F.lit(0.0)).alias(f"z{c}") for c in range(len(CLASSES))]
    hits = [F.count_if(F.array_contains("t", i)).alias(f"t{i}") for i in range(len(sizes))]
    scored = flat.groupBy("doc_id", "doc", "paragraph").agg(*sums, *hits)
    z = F.array(*[(F.col(f"z{c}") + float(model.bias[c])) / model.temperature for c in range(len(CLASSES))])
    covered = F.array(*[F.lit(1.0), *[F.greatest(*[F.col(f"t{i}") / n for i, (k, n) in enumerate(sizes) if k == c]) for c in range(1, len(FAMILIES) + 1)], F.lit(0.0)])
    scored = scored.select("doc_id", "doc", "paragraph", z.alias("z"), covered.alias("covered"))
    top = F.array_max("z")
    scored = scored.select("doc_id", "doc", "paragraph", "covered", F.array_position("z", top).cast("int").alias("best"), (1 / F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - top))).alias("score"))
    confirmed = F.element_at("covered", F.col("best")) >= CONFIRM
    names = F.array(*[F.lit(n) for n in CLASSES])
    family = F.when(F.col("best") == 1, F.lit(NONE)).when((F.col("score") >= model.least) & confirmed, F.element_at(names, F.col("best"))).otherwise(F.lit(UNKNOWN))
    is_one = F.col("paragraph").isNotNull()
    return scored.select("doc_id", "doc", "paragraph", F.when(is_one, family).alias("family"), F.when(is_one, F.col("score")).alias("score"), (is_one & (F.col("best") > 1) & confirmed).alias("confirmed"))


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per document: doc_id, licences (families found, sorted, comma-joined), n_licences, n_unknown and n_none (paragraphs), score (the best of a family).

    A null or empty text has no licences. Long texts are read whole, repeated rows are each returned, a null doc_id stays null, extra
    columns are ignored, an empty table gives no rows.
    """
    known = F.col("family").isNotNull() & ~F.col("family").isin(NONE, UNKNOWN)
    found = scan_paragraphs(docs, model).groupBy("doc_id", "doc").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(known, F.col("family")))), ",").alias("licences"),
        F.count_if(known).alias("n_licences"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
        F.count_if(F.col("family") == NONE).alias("n_none"),
        F.max(F.when(known, F.round("score", 6))).alias("score"),
    )
    return found.drop("doc")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return scan(load(spark, sf_dir, "documents"))
