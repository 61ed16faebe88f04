"""Operator 7, language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text becomes lower-case letters with a blank for every run of other characters; its subwords are all runs of two to four characters,
hashed into ``BUCKETS`` rows of an embedding table. The mean of the rows goes through a linear layer. With few languages the two are
multiplied out; with many, executors get them as they are, so a model's size hardly grows with the languages. Scores are softmax probabilities
at a temperature fitted on rows that training didn't see. The rejection bound is calibrated on the same rows and on texts in no
language (random words of the letters seen): it is what all but ``FOREIGN`` of those stay under, but lower if it cost more than ``REJECT_SHARE`` of the
rows that are rightly recognised.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import load, map_arrow

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
#: The sample for training: about so many rows of each language, chosen by a hash of the id, each whole and of at most SAMPLE_CHARS characters.
SAMPLE_ROWS, SAMPLE_CHARS = 800, 20_000
#: Rows of the sample in all, so that it fits the driver whatever the table; with many languages, each still has EACH_AT_LEAST.
SAMPLE_TOTAL, EACH_AT_LEAST = 8_000, 40
#: More labels than there are languages in the world are no languages: an error, as none is left out silently.
LANGUAGES = 10_000
EPOCHS, RATE, SEED = 6, 0.5, 7
#: The shares of rightly recognised rows that may fall under the rejection bound, and of texts in no language that may reach it.
REJECT_SHARE, FOREIGN = 0.001, 0.1
UNDECIDED = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def subwords(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed subwords of a whole text, repeats included; empty if it has no letter."""
    if not text:
        return np.empty(0, dtype=np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.empty(0, dtype=np.int64)
    shown = is_letter.copy()
    shown[1:] |= is_letter[:-1]  # of each run of other characters, the first stays as a blank
    codes = np.where(is_letter, codes, 32)[shown]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    out = []
    hashed = codes * np.uint32(0x9E3779B1)
    rolling = hashed
    for n in range(2, max(GRAMS) + 1):
        rolling = (rolling[:-1] * np.uint32(0x01000193)) ^ hashed[n - 1 :]
        if n in GRAMS and len(rolling):
            out.append((((rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(8)) % np.uint32(buckets))
    return np.concatenate(out).astype(np.int64)


@dataclass
class LanguageModel:
    """Logits of a text: the mean of its subwords' rows of ``table``, times ``out`` where the table is not multiplied out, plus a bias."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray | None = None
    temperature: float = 1.0
    least: float = 0.0
    accuracy: float = field(default=float("nan"))

    def logits(self, text: str | None) -> np.ndarray | None:
        ids = subwords(text, len(self.table))
        if not len(ids):
            return None
        counts = np.bincount(ids, minlength=len(self.table))
        at = np.flatnonzero(counts)
        return self.of_mean(counts[at] @ self.table[at] / len(ids))

    def of_mean(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.out is None else mean @ self.out) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); UNDECIDED, 0 and False for a text without a letter."""
        z = self.logits(text)
        if z is None or not self.languages:
            return UNDECIDED, 0.0, False
        p = _softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(texts: list[str], langs: list[str]) -> LanguageModel:
    """Fit on four of five rows, calibrate on the fifth; with no rows the model decides nothing."""
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0))
    rng = np.random.default_rng(SEED)
    data = []
    for text, lang in zip(texts, langs, strict=True):
        ids = subwords(text)
        if len(ids):
            at, counts = np.unique(ids, return_counts=True)
            data.append((at, (counts / len(ids)).astype(np.float32), languages.index(lang), zlib.crc32(text.encode("utf-8")) % 5 == 0))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), dtype=np.float32)
    fit = [d for d in data if not d[3]] or data
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            at, share, want, _ = fit[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ emb[at]
            g = _softmax(mean @ out + bias)
            g[want] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= rate * g
            # A subword's share is tiny, so its row moves by the share times the number of distinct subwords.
            emb[at] -= rate * np.minimum(share * len(at), 4.0)[:, None] * back
    few = len(languages) <= DIM
    model = LanguageModel(languages, (emb @ out).astype(np.float32) if few else emb, bias.astype(np.float64), None if few else out)
    held = [d for d in data if d[3]] or data
    z = np.array([model.of_mean(share @ model.table[at]) for at, share, _, _ in held], dtype=np.float64)
    want = np.array([d[2] for d in held])
    if len(z):
        _calibrate(model, z, want, np.array([model.logits(t) for t in _foreign(texts)], dtype=np.float64))
    return model


def _foreign(texts: list[str], n: int = 500) -> list[str]:
    """Texts in no language: words of letters drawn evenly from all that are seen."""
    rng = np.random.default_rng(SEED)
    letters = np.array(sorted({c for t in texts for c in t.lower() if c.isalpha()}))
    return [" ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(rng.integers(3, 60))) for _ in range(n)]


def _calibrate(model: LanguageModel, z: np.ndarray, want: np.ndarray, foreign: np.ndarray) -> None:
    """The temperature of least log loss, and the rejection bound."""

    def probabilities(t: float, z: np.ndarray = z) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.25, 16, 61)
    model.temperature = float(min(grid, key=lambda t: -np.log(probabilities(t)[np.arange(len(want)), want] + 1e-12).mean()))
    p = probabilities(model.temperature)
    right = p.argmax(axis=1) == want
    model.accuracy = float(right.mean())
    if right.any():
        low, high = np.sort(p.max(axis=1)[right]), np.sort(probabilities(model.temperature, foreign).max(axis=1))
        model.least = float(min(low[int(REJECT_SHARE * len(low))], high[int((1 - FOREIGN) * len(high))]))


def held_out() -> F.Column:
    """True for the rows that no model may learn from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Train on a bounded sample of labelled rows that aren't held out: about ``rows`` of each language, chosen by a hash of the id, and SAMPLE_TOTAL in all.

    Each language keeps EACH_AT_LEAST rows (all, if it has fewer); more than LANGUAGES labels raise an error. Rows with a null id, text or
    language teach nothing; repeated rows count as often as they are sampled, up to the bound; an empty table gives a model that decides nothing.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(F.length("text") <= SAMPLE_CHARS)
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if not sizes:
        return train([], [])
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    each = min(rows, max(EACH_AT_LEAST, SAMPLE_TOTAL // len(sizes)))
    range_ = 1 << 40
    below = F.try_element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, each / r["count"]) * range_))]), F.col("lang"))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(range_))
    picked = usable.where(hashed < below).select("doc_id", "lang", "text", hashed.alias("h"))
    # Ids that repeat are in or out together, so the number of rows is bounded once more.
    found = picked.orderBy("h", "doc_id", "lang", "text").limit(2 * each * len(sizes)).toPandas().sort_values(["doc_id", "lang", "text"], kind="stable")
    return train(found["text"].tolist(), found["lang"].tolist())


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([x[k] for x in found], type=t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, text) to doc_id, lang_pred, score (0 to 1) and accepted.

    A null, empty or letterless text is UNDECIDED with score 0 and not accepted. Long texts are read whole, ties go to the language that
    sorts first, repeated rows are each returned, extra columns are ignored and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(docs.select("doc_id", "text"), _predicted(shared), "doc_id long, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents whose language the model accepts, all columns kept, whatever their names.

    Null, empty and letterless texts go; repeated rows and rows with a null doc_id are judged each for itself; an empty table gives no rows.
    """
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([shared.value.predict(t.as_py())[2] for t in batch.column("text")], type=pa.bool_())
            yield batch.filter(good)

    return map_arrow(docs, run, docs.schema).select(*columns)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = load(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
