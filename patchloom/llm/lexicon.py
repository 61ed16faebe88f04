"""Operator 5, BPE by a minimal acyclic transducer: frequent words are looked up in a shared-suffix automaton, others are merged exactly.

The words of all documents are counted, the most frequent ``WORDS`` are encoded by exact merges, and their byte strings are compiled into the
smallest deterministic automaton that accepts just them. Its arcs carry numbers whose sum along a word is the word's rank, and the rank
gives the ids. The automaton is one file of plain arrays: every machine gets it from Spark, maps it into memory and looks up all words of a
batch at once, one byte a step. Words that it does not accept are merged by the ranked merge rules.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import mmap
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import keep, load, map_arrow, new_path, write_bytes
from patchloom.llm.tokens import MEMO, PieceEncoder, encoder, public_path

#: Words in the automaton, and distinct words a task counts before it passes its counts on.
WORDS, COUNTED = 100_000, 200_000
#: Symbols from which a word is merged with a heap.
LONG = 48
#: arcs: state * 256 + byte, ascending; ptr: where each state's arcs begin.
_ARRAYS = (("ptr", "<u4"), ("arcs", "<i8"), ("target", "<u4"), ("out", "<u4"), ("final", "u1"), ("id_ptr", "<u4"), ("ids", "<u4"))


class Merges:
    """Ranked merge rules: the exact encoding of one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""

    def encode(self, symbols: str) -> tuple[int, ...]:
        """Ids of a word given in byte symbols: the pair of least rank is merged, leftmost first, until none is left."""
        parts = list(symbols)
        if not parts:
            return ()
        parts[-1] += self.end
        if len(parts) > LONG:
            return self._merged_by_heap(parts)
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
        vocab = self.vocab
        return tuple([vocab[p] for p in parts if p in vocab])


    def _merged_by_heap(self, parts: list[str]) -> tuple[int, ...]:
        """The same for a long word, in time n log n: a heap of ranked places over a linked list of parts."""
        rank, n = self.ranks.get, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        heap = [(r, k) for k, pair in enumerate(itertools.pairwise(parts)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if not alive[k] or (nxt := after[k]) >= n or rank((parts[k], parts[nxt])) != r:
                continue  # one of the two is merged already
            parts[k] += parts[nxt]
            alive[nxt] = 0
            after[k] = far = after[nxt]
            if far < n:
                before[far] = k
                if (r := rank((parts[k], parts[far]))) is not None:
                    heapq.heappush(heap, (r, k))
            if (low := before[k]) >= 0 and (r := rank((parts[low], parts[k]))) is not None:
                heapq.heappush(heap, (r, low))
        vocab = self.vocab
        return tuple([vocab[p] for k, p in enumerate(parts) if alive[k] and p in vocab])


def compile_words(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The minimal automaton of the words, with their ids, as one byte string.

    Words are added in sorted order; a state is final in shape once the next word leaves it, and equal states are merged then. An
    arc's number is how many words the state accepts before it takes that arc, so numbers along a word add up to its rank.
    """
    register: dict[tuple, int] = {}
    shapes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(shapes)
            shapes.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # states of the last word: [final, [(label, target)]]
    last = b""
    ordered = sorted(words)
    for word in ordered:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for k in range(len(last), same, -1):
            path[k - 1][1].append((last[k - 1], settle(path.pop())))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1][1].append((last[k - 1], settle(path.pop())))
    root = settle(path[0])

    accepts = np.zeros(len(shapes), dtype=np.int64)  # targets always come before their states
    ptr, labelled, target, out = [0], [], [], []
    for k, (final, arcs) in enumerate(shapes):
        n = int(final)
        for byte, to in arcs:
            labelled.append(k << 8 | byte)
            target.append(to)
            out.append(n)
            n += int(accepts[to])
        accepts[k] = n
        ptr.append(len(labelled))
    id_ptr = np.cumsum([0, *[len(words[w]) for w in ordered]])
    ids = [i for w in ordered for i in words[w]]
    data = {"ptr": ptr, "arcs": labelled, "target": target, "out": out, "final": [f for f, _ in shapes], "id_ptr": id_ptr, "ids": ids}
    raw = {n: np.asarray(data[n], dtype=t).tobytes() for n, t in _ARRAYS}
    head = json.dumps({"root": root, "sizes": {n: len(raw[n]) for n, _ in _ARRAYS}}).encode()
    body = b"".join(raw[n] + bytes(-len(raw[n]) % 8) for n, _ in _ARRAYS)
    start = len(head).to_bytes(8, "little") + head
    return start + bytes(-len(start) % 8) + body


class Transducer:
    """A compiled automaton over any buffer, such as a mapped file."""

    def __init__(self, buffer):
        n = int.from_bytes(buffer[:8], "little")
        head = json.loads(bytes(buffer[8 : 8 + n]))
        at = 8 + n + -(8 + n) % 8
        for name, kind in _ARRAYS:
            size = head["sizes"][name]
            setattr(self, name, np.frombuffer(buffer, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
            at += size + -size % 8
        self.root = head["root"]

    @property
    def label(self) -> np.ndarray:
        """The byte of each arc."""
        return self.arcs & 255

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those not accepted; all words go one byte further in each step."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else lengths
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        state, total = np.full(len(words), self.root, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        alive = np.flatnonzero(lengths > 0)
        step = 0
        while len(alive) and len(self.arcs):
            want = state[alive] << 8 | text[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)
            hit = self.arcs[arc] == want
            state[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.target[arc]
            total[alive] += self.out[arc]
            step += 1
            alive = alive[lengths[alive] > step]
        if not len(self.arcs):
            state[:] = -1
        good = (state >= 0) & (lengths > 0)
        good[good] = self.final[state[good]] > 0
        return np.where(good, total, -1)

    def ids_of(self, rank: int) -> tuple[int, ...]:
        return tuple(self.ids[self.id_ptr[rank] : self.id_ptr[rank + 1]].tolist())


class LexiconEncoder(PieceEncoder):
    """Encodes with the transducer first and exact merges for words it does not have; decodes as the library does."""

    def __init__(self, path: str, transducer: Transducer):
        super().__init__(path)
        self.transducer, self.merges = transducer, Merges(path)
        self.token = {i: t for t, i in self.merges.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.looked_up = self.merged = 0

    def learn(self, pieces: set[str]) -> None:
        """Look up all pieces that aren't known yet; what one generation of them has not used again is forgotten."""
        if len(self.words) > MEMO:
            self.old, self.words = self.words, {}
        words, old = self.words, self.old
        new = []
        for p in pieces:
            if p not in words:
                if p in old:
                    words[p] = old[p]
                else:
                    new.append(p)
        raw = [p.encode("utf-8") for p in new]
        for p, rank in zip(new, self.transducer.ranks(raw).tolist(), strict=True):
            if p in self.specials:
                ids = (self.specials[p],)
            elif rank >= 0:
                ids = self.transducer.ids_of(rank)
                self.looked_up += 1
            else:
                ids = self.merges.encode(self.shown_bytes(p))
                self.merged += 1
            words[p] = (array("I", ids).tobytes(), self.decode(ids))

    def decode(self, ids) -> str:
        """Tokens joined by blanks: the file names no decoder, and special tokens stay."""
        return " ".join([self.token[i] for i in ids if i in self.token])

    def encode_decode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each text; words of all texts are looked up together."""
        cuts = [self.cut(t) if t else [] for t in texts]
        self.learn({p for c in cuts for p in c})
        known = self.words
        out = []
        for pieces in cuts:
            found = [known[p] for p in pieces]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])))
        return out


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, count) over all texts; a task adds up its own words before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts = encoder(path), Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column("text"):
                if text := t.as_py():
                    counts.update(enc.cut(text))
            if len(counts) > COUNTED:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return map_arrow(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))


def frequent(counts: DataFrame, words: int = WORDS) -> list[str]:
    """The most frequent words, at most so many, ties in order of a hash of the word.

    (word, count) is cut at a step of a fixed scale of counts; of the step that no longer fits as a whole, only the rows with the
    least hashes are ordered, so little more than ``words`` rows move, however many tie.
    """
    step = F.floor(F.log2("count") * 16).cast("int").alias("step")
    kept = keep(counts.where((F.col("count") > 1) & (F.length("word") <= 64)).select("word", "count", step), "words")
    room, least, over = words, None, None
    for row in kept.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 16 steps for each doubling
        if row["count"] > room:
            over = row
            break
        room, least = room - row["count"], row["step"]
    found = [] if least is None else [r["word"] for r in kept.where(F.col("step") >= least).select("word").toLocalIterator()]
    if over and room:
        range_, hashed = 1 << 40, F.xxhash64("word")
        part = kept.where(F.col("step") == over["step"])
        share = min(1.0, 1.2 * room / over["count"] + 1000 / over["count"])
        part = part.where(F.pmod(hashed, F.lit(range_)) <= int(share * range_))
        found += [r["word"] for r in part.orderBy(F.pmod(hashed, F.lit(range_)), "word").select("word").limit(room).collect()]
    return found


def build(docs: DataFrame, path: str, words: int = WORDS) -> bytes:
    """The compiled automaton of the most frequent words of all documents."""
    merges, enc = Merges(path), encoder(path)
    return compile_words({w.encode("utf-8"): merges.encode(enc.shown_bytes(w)) for w in frequent(word_counts(docs, path), words) if w not in enc.specials})


def distribute(spark: SparkSession, compiled: bytes) -> str:
    """Hand the file to Spark by way of the shared folder; it brings it to every machine, later ones too. Returns its name there."""
    name = f"lexicon-{hashlib.sha256(compiled).hexdigest()[:24]}.bin"
    if (spark.sparkContext.applicationId, name) not in _GIVEN:  # Spark takes a name once
        at = f"{new_path(spark, 'lexicon')}/{name}"
        write_bytes(spark, at, compiled)
        spark.sparkContext.addFile(at)
        _GIVEN.add((spark.sparkContext.applicationId, name))
    return name


_GIVEN: set[tuple[str, str]] = set()
_OPEN: dict[tuple[str, str], LexiconEncoder] = {}


def opened(path: str, name: str) -> LexiconEncoder:
    if (path, name) not in _OPEN:
        _OPEN.clear()
        _OPEN[path, name] = LexiconEncoder(path, Transducer.mapped(SparkFiles.get(name)))
    return _OPEN[path, name]


def encode_documents(docs: DataFrame, path: str | None = None, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens and the digests of nothing. Long texts are encoded whole, repeated rows are each returned, extra
    columns are ignored, an empty table gives no rows.
    """
    path = path or public_path("word_bpe_49k.json")
    name = distribute(docs.sparkSession, build(docs, path, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = opened(path, name).encode_decode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(i) // 4 for i, _ in found], type=pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], type=pa.string()), pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for _, d in found], type=pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return encode_documents(load(spark, sf_dir, "documents"))
