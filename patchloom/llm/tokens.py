"""Whole-text encoding with a public tokenizer file, word by word.

Both tokenizer kinds cut a text into pieces by a pattern and encode each piece on its own, so ids are kept per distinct piece. Texts whose
characters all lie below U+0300 are cut by a pattern here (they are in NFC already, and lower case is one character to one); any other text
is normalised and cut by the tokenizers library itself, which is slower. The pieces of both are the same and go the same way. Special
tokens are pieces of their own.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker keeps in each of two generations.
MEMO = 300_000
#: Characters of texts that the patterns here cut; others go to the library.
PLAIN_END = 0x300
_SPACE = "\\t-\\r\\x20\\x85\\xa0"


def _ranges(kind: str) -> str:
    codes = [c for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind]
    out, at = [], 0
    while at < len(codes):
        end = at
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out.append(f"\\u{codes[at]:04x}-\\u{codes[end]:04x}")
        at = end + 1
    return "".join(out)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters stand for themselves, others for 256, 257, ..."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Memo(dict):
    """What a function gives for a key, kept for two generations: keys that come again move on, others are forgotten."""

    def __init__(self, function, most: int = MEMO):
        super().__init__()
        self.function, self.most, self.old = function, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids`` without truncation and padding."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.word_ends = bool(spec["model"].get("end_of_word_suffix"))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters, digits = _ranges("L"), _ranges("N")
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        if self.word_ends:
            self.pieces = re.compile(f"{short}|[{letters}]+|[{digits}]|[^{_SPACE}{letters}{digits}]+")
        else:
            self.pieces = re.compile(f"{short}| ?[{letters}]+| ?[{digits}]+| ?[^{_SPACE}{letters}{digits}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.beyond = re.compile(f"[^\x00-{chr(PLAIN_END - 1)}]")
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.symbols = byte_symbols()
        self.shown = {b: c for b, c in enumerate(self.symbols) if chr(b) != c}
        self.byte_of = {ord(c): b for b, c in enumerate(self.symbols)}
        self.memo = Memo(self.encode_bytes, memo)
        self.raw = Memo(self.raw_piece, memo // 4)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece."""
        if piece in self.specials:
            return (self.specials[piece],)
        return tuple([t.id for t in self.tokenizer.model.tokenize(self.shown_bytes(piece))])

    def encode_bytes(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece)).tobytes()

    def raw_piece(self, symbols: str) -> str:
        """The piece whose bytes some byte symbols stand for."""
        return symbols.translate(self.byte_of).encode("latin-1").decode("utf-8")

    def shown_bytes(self, piece: str) -> str:
        """The bytes of a piece as byte symbols."""
        if piece.isascii() and piece.isprintable():  # of these bytes, only the blank has a stand-in
            return piece.replace(" ", self.symbols[32])
        return piece.encode("utf-8").decode("latin-1").translate(self.shown)

    def cut(self, text: str) -> list[str]:
        """The pieces of a text, in order; special tokens are pieces that stand for themselves."""
        if not (self.special and self.special.search(text)):
            return self._cut(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._cut(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._cut(text[at:])

    def _cut(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.pieces.findall(text.lower() if self.word_ends else text)
        normal, raw = self.tokenizer.normalizer, self.raw
        return [raw[symbols] for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text is an empty one."""
        return b"".join(map(self.memo.__getitem__, self.cut(text))) if text else b""


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, memo: int = MEMO) -> PieceEncoder:
    """One encoder a process and file; another file or size takes its place, so a worker holds one memo."""
    if (path, memo) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, memo] = PieceEncoder(path, memo)
    return _ENCODERS[path, memo]


def public_path(name: str) -> str:
    """Where the installed public tokenizer file lies; every machine has the package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
