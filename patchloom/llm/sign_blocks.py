"""Blocks of sign bits: how many are needed, and which bits they hold. Shared by the operators that look for vectors at small angles.

BITS signs are split into blocks again and again, after another shuffle of the bits each time; two vectors meet if they agree in one block. The
blocks of one split are disjoint, so a pair that differs in fewer bits than one split has blocks meets for sure.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

BITS, SEED = 256, 7


@cache
def blocks_for(n: int, differ: float, crowd: int, recall: float, most: int) -> tuple[int, int]:
    """(bits of a block, blocks) for n vectors: a block's value is shared by about ``crowd`` of them by chance, and a pair whose signs differ with probability ``differ`` shares one with probability ``recall``.

    With huge n it is the crowd that grows, so that a vector goes to ``most`` blocks at most.
    """
    d = np.arange(BITS + 1)
    weight = np.array([math.comb(BITS, k) * differ**k * (1 - differ) ** (BITS - k) for k in d.tolist()])
    bits = max(4, round(math.log2(max(1, n / crowd))))
    while True:
        share = np.array([math.comb(BITS - k, bits) / math.comb(BITS, bits) for k in d.tolist()])
        blocks = 1
        while float(weight @ (1 - share) ** blocks) > 1 - recall and blocks <= most:
            blocks += 1
        if blocks <= most or bits == 4:
            return bits, blocks
        bits -= 1


@cache
def places(bits: int, blocks: int) -> np.ndarray:
    """The places of each block's bits: (blocks, bits)."""
    rng, each = np.random.default_rng([SEED, bits]), BITS // bits
    splits = [rng.permutation(BITS)[: each * bits].reshape(each, bits) for _ in range(-(-blocks // each))]
    return np.concatenate(splits)[:blocks]


def groups(packed: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """(n, BITS / 8) packed signs to (n, blocks) numbers that say which block it is and what it holds."""
    ones, power = np.unpackbits(packed, axis=1), 1 << np.arange(bits, dtype=np.int64)
    out = np.empty((len(packed), blocks), dtype=np.int64)
    for t, at in enumerate(places(bits, blocks)):  # one by one, as all bits of all blocks would be large
        out[:, t] = ones[:, at] @ power + (t << bits)
    return out
