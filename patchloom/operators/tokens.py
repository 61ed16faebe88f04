"""Exact token counts of texts, by ranked merges over the bytes of pieces, with a merge table and a pattern that the caller names.

The table is a file of lines ``base64 rank``, as public byte-level vocabularies are published. A piece's count depends on it alone, so a task keeps
counts of pieces that it has met, up to a number of bytes. Where no table is at hand, ``functions.text.tokens`` (a quarter of the characters) stays.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from patchloom.shipping import ship

#: Fixed value: the usual cut of byte-level vocabularies into words, numbers, signs and blanks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces whose counts a task keeps, and pieces longer than this are not kept.
MEMO_BYTES, KEPT = 32 << 20, 64
BATCH_BYTES = 4 << 20


class Merges:
    """Token counts by a table of ranks: of all neighbours in a piece, the pair of least rank is joined until none has a rank."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = regex.compile(pattern)
        self.memo: dict[bytes, int] = {}
        self.held = 0

    def of_piece(self, piece: bytes) -> int:
        """Tokens of a piece. Pairs wait in a heap, so the time is n log n for a piece of n bytes."""
        if len(piece) < 2 or piece in self.ranks:
            return min(1, len(piece))
        ranks, n = self.ranks, len(piece)
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        pairs = [(r, k, 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(pairs)
        left = n
        while pairs:
            _, k, length = heapq.heappop(pairs)
            nxt = after[k] if size[k] else n
            if nxt >= n or size[k] + size[nxt] != length:
                continue  # one of the two has been joined to another since
            size[k], size[nxt], after[k] = length, 0, after[nxt]
            left -= 1
            if after[k] < n:
                before[after[k]] = k
                both = length + size[after[k]]
                if (r := ranks.get(piece[k : k + both])) is not None:
                    heapq.heappush(pairs, (r, k, both))
            if (p := before[k]) >= 0:
                both = size[p] + length
                if (r := ranks.get(piece[p : p + both])) is not None:
                    heapq.heappush(pairs, (r, p, both))
        return left

    def count(self, text: str | None) -> int:
        total = 0
        for m in self.pieces.finditer(text or ""):
            piece = m[0].encode("utf-8", "replace")
            n = self.memo.get(piece)
            if n is None:
                n = self.of_piece(piece)
                if len(piece) <= KEPT:
                    if self.held > MEMO_BYTES:
                        self.memo.clear()
                        self.held = 0
                    self.memo[piece] = n
                    self.held += len(piece) + 64
            total += n
        return total


def token_counts(df: DataFrame, path: str, pattern: str = PATTERN, text: str = "text", name: str = "tokens") -> DataFrame:
    """``df`` without its text and with ``name``, the exact number of its tokens; a null text has none. ``path`` is a merge table that every machine has."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(path, pattern)
        for batch in batches:
            each = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                counts = pa.array([merges.count(t.as_py()) for t in part.column(text)], type=pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), counts], [*kept, name])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.select(*kept).dtypes)
    return df.mapInArrow(run, f"{fields}, `{name}` long" if kept else f"`{name}` long")
