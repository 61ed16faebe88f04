"""Operator 4, personal data: fixed patterns, and a semi-Markov conditional random field that adds spans they miss.

The field labels whole segments: a segment of up to ``LONGEST`` tokens is scored as email, ip, card or phone by features of the whole span
(shape of its parts, digit counts, check digit, words before it), a token outside all spans scores nothing, and bounded-entity dynamic
programming chooses boundaries and kinds together. A segment holds a digit, an at sign, or a word for one and a dot or a word for it after that,
so the dynamic programming runs on the stretches around all of those; elsewhere there are no segments and the labelling is empty. Weights are
trained by gradient on the conditional likelihood of generated sentences, whose forms (written-out emails, local and 00-prefixed phones, bracketed
addresses) and counter-examples (hashes, dates, versions, prices, long ids) come from a seeded generator. A span is added if its posterior reaches
``SURE``. All scans take time in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import load, map_arrow

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
SURE = 0.95
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of the address or card pattern can't start inside a run of digits, and takes whole runs, so nothing is given back or tried again.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Whether a string of digits ends in its check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _is_byte(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) < 4 and int(short or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, leftmost and without overlap in each kind, by start and then kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:  # the local part of a match is the whole run before the sign, so signs are looked for first
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            end = m.end()
            out.append((begin, end, "email"))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(_is_byte(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() - m[0].count(" ") - m[0].count("-") <= 19 and luhn(re.sub("[ -]", "", m[0])):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the field ---------------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_AT_WORDS, _DOT_WORDS = {"at", "arroba", "arobase"}, {"dot", "punkt", "point", "punto"}
_CUES = {
    "email": {"mail", "email", "e", "write", "contact", "correo", "courriel", "address"},
    "ip": {"ip", "host", "server", "addr", "address", "node", "gateway"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "amex"},
    "phone": {"call", "phone", "tel", "telephone", "telefon", "mobile", "fax", "cell", "dial", "tél", "teléfono"},
}
#: Characters that a segment has at most, and so the reach of a stretch around a digit or an at sign.
REACH = 96
#: What opens a stretch by itself, and the words for an at sign as whole tokens.
_SIGNAL = re.compile(r"[0-9]+|@")
_AT = re.compile(r"(?<![^\W\d_])(?:at|arroba|arobase)(?![^\W\d_])")
_DOT = re.compile(r"\.(?=[^\W_])")
#: Tokens before a segment that its features read, and described segments whose scores a worker keeps.
BEFORE, KEPT = 3, 100_000
_NUMBER_SIGNS, _ADDRESS_SIGNS = frozenset("+()[].-/"), frozenset("()[].-_+%")
_ENDS = frozenset(("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "ch", "us", "eu", "br", "mx"))
_ZEROS = str.maketrans("123456789", "000000000")
_CUE_BITS = {w: sum(1 << k for k, kind in enumerate(KINDS) if w in _CUES[kind]) for w in frozenset().union(*_CUES.values())}


def _is_number(token: str) -> bool:
    return token.isascii() and token.isdigit()


def tokens(text: str, begin: int = 0, end: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, text) of words, digit runs and single other signs."""
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, begin, len(text) if end is None else end)]


def segments(text: str, toks: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Token ranges [i, j) that can be a span, sorted: at most LONGEST tokens and REACH characters on one line, with single blanks at most.

    Numbers are runs of digits and the signs ``+ ( ) [ ] . - /`` that hold 7 to 19 digits in up to six groups, or four groups of up to three.
    Addresses are words, digits and their signs, from a word or number to a word, with one at sign, or word for it, that is not the first
    token, and after it a word for a dot or a dot that a letter or digit follows at once.
    """
    out: list[tuple[int, int]] = []
    near = [b[0] == a[1] or b[0] == a[1] + 1 and text[a[1]] != "\n" for a, b in itertools.pairwise(toks)]
    for i, (start, stop, first) in enumerate(toks):
        if first[0] in "0123456789+([" and stop - start <= REACH:
            n, groups, short = 0, 0, True
            for j in range(i + 1, min(len(toks), i + LONGEST) + 1):
                _, end, last = toks[j - 1]
                if j > i + 1 and not near[j - 2] or end - start > REACH:
                    break
                if _is_number(last):
                    n, groups, short = n + len(last), groups + 1, short and len(last) < 4
                    if n > 19 or groups > 6:
                        break
                elif last not in _NUMBER_SIGNS:
                    break
                elif last not in ")]":
                    continue
                if n >= 7 or groups == 4 and short:
                    out.append((i, j))
        if first == "@" or first.lower() in _AT_WORDS:
            out += _around(text, toks, near, i)
    return sorted(out)


def _part_of_address(token: str) -> bool:
    return token[0].isalnum() and token.lower() not in _AT_WORDS or token in _ADDRESS_SIGNS


def _around(text: str, toks: list[tuple[int, int, str]], near: list[bool], at: int) -> list[tuple[int, int]]:
    """The segments that are addresses with their at sign at a token."""
    begins = []
    for i in range(at - 1, max(-1, at - LONGEST), -1):
        if not near[i] or not _part_of_address(toks[i][2]) or toks[at][1] - toks[i][0] > REACH:
            break
        if toks[i][2][0].isalnum():
            begins.append(i)
    if not begins:
        return []
    out, dotted = [], False
    for j in range(at + 2, min(len(toks), at + LONGEST) + 1):
        _, end, last = toks[j - 1]
        if not near[j - 2] or not _part_of_address(last) or end - toks[begins[0]][0] > REACH:
            break
        if dotted and last.isalpha():
            out += [(i, j) for i in begins if j - i <= LONGEST and end - toks[i][0] <= REACH]
        dotted = dotted or last.lower() in _DOT_WORDS or last == "." and j < len(toks) and toks[j][0] == end and toks[j][2][0].isalnum()
    return out


def described(text: str, toks: list[tuple[int, int, str]], cues: list[int], i: int, j: int) -> tuple:
    """All that the features of the segment [i, j) depend on."""
    start, end = toks[i][0], toks[j - 1][1]
    span = text[start:end]
    around = text[start - 1 : start], text[end : end + 1], cues[i]
    if "@" in span or any(t[2].isalpha() for t in toks[i:j]):
        words = [t[2].lower() for t in toks[i:j]]
        at = next(k for k, w in enumerate(words) if w == "@" or w in _AT_WORDS)
        plain = [w[0].isalnum() and w not in _DOT_WORDS for w in words]
        loose = [k for k in range(1, len(words)) if plain[k - 1] and plain[k] and at not in (k - 1, k) and toks[i + k - 1][1] < toks[i + k][0]]  # two words with a blank between
        return around, (sum(k < at for k in loose), sum(k > at for k in loose), toks[i + at - 1][1] < toks[i + at][0]), tuple([w if not w.isalpha() or w in _AT_WORDS or w in _DOT_WORDS or w in _ENDS else f"{min(len(w), 7)}" if k == len(words) - 1 else "w" for k, w in enumerate(words)])
    digits = [t[2] for t in toks[i:j] if _is_number(t[2])]
    n = sum(map(len, digits))
    lead = span[0] if span[0] in "+([" else "00" if span[:2] == "00" else "0" if span[0] == "0" else "1-9"
    four = len(digits) == 4 and all(len(d) < 4 and int(d) < 256 for d in digits)
    return around, span.translate(_ZEROS), lead, four, luhn("".join(digits)) if 13 <= n <= 19 else None


def named(about: tuple) -> list[str]:
    """Names of the features of a described segment."""
    (before, after, cues), *rest = about
    out = ["bias"]
    if isinstance(rest[0], str):
        zeros, lead, four, valid = rest
        lengths = [len(g) for g in re.findall("0+", zeros)]
        signs = "".join(sorted(set(zeros) - {"0"}))
        n = sum(lengths)
        out += ["number", f"n{n}", f"signs{signs}", f"groups{len(lengths)}", f"starts{lead}", f"starts{lead}n{n}", "shape" + re.sub("0+", lambda m: str(min(len(m[0]), 9)), zeros)[:24], f"last{min(lengths[-1], 9)}first{min(lengths[0], 9)}"]
        if four and re.fullmatch(r"\[?0+( ?\. ?0+){3}\]?|\[?0+(\[\.\]0+){3}\]?|\[?0+(\(\.\)0+){3}\]?", zeros):
            out.append("four-bytes")
        if valid is not None:
            out.append("luhn" if valid else "not-luhn")
    else:
        (before_at, after_at, apart), words = rest
        ats = [k for k, w in enumerate(words) if w == "@" or w in _AT_WORDS]
        tail = [k for k, w in enumerate(words) if k > ats[0] + 1 and (w == "." or w in _DOT_WORDS)]
        written, spelt = words[ats[0]] != "@", words[tail[-1]] != "." if tail else False
        bracket = [words[k - 1] + words[k + 1] for k in (ats[0], tail[-1] if tail else 0) if 0 < k < len(words) - 1 and words[k - 1] in "(["]
        out += ["address", f"loose-user{min(before_at, 3)}", f"loose-host{min(after_at, 3)}", f"apart{int(apart)}{int(written)}", f"written{int(written)}{int(spelt)}", f"tokens{len(words)}", f"user{min(ats[0], 6)}", f"dots{min(len(tail), 3)}"]
        out += ["brackets" + "".join(bracket)] if bracket else []
        close = tail and tail[-1] == len(words) - 2 - (words[-2] in ")]")
        out += [f"ends-well{int(words[-1] in _ENDS)}{int(written)}"] if close else ["ends-late"]
        out.append(f"glue-{'+'.join(sorted({w for w in words[: ats[0]] if w in _ADDRESS_SIGNS}))}")
        out += [f"inner-{w}" for w in {w for w in words[ats[0] + 1 :] if w in "+%_"}]
    if before and (before.isalnum() or before in "@._-+/=\"'#$€"):
        out.append("joined-left" + ("" if before.isalnum() else before))
    if after and (after.isalnum() or after in "@_-/=%€$\"'"):
        out.append("joined-right" + ("" if after.isalnum() else after))
    return out + [f"cue-{kind}-{out[1]}" for k, kind in enumerate(KINDS) if cues >> k & 1]


def cued(toks: list[tuple[int, int, str]]) -> list[int]:
    """For each token, the kinds that one of the BEFORE tokens before it is a cue of, as bits."""
    own = [_CUE_BITS.get(t.lower(), 0) for _, _, t in toks]
    out = []
    for i in range(len(own)):
        bits = 0
        for b in own[max(0, i - BEFORE) : i]:
            bits |= b
        out.append(bits)
    return out


def features(text: str, toks: list[tuple[int, int, str]], i: int, j: int) -> list[str]:
    """Names of the features of the whole segment [i, j)."""
    return named(described(text, toks, cued(toks[: i + 1]), i, j))


def _generated(rng: random.Random) -> tuple[str, list[Span]]:
    """A sentence and its spans."""

    def word() -> str:
        return "".join(rng.choice(("an", "the", "re", "on", "ly", "sch", "eau", "ción", "ti", "wh", "er", "ou")) for _ in range(rng.randint(1, 4)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice((13, 14, 14, 14, 14)))
        body += next(d for d in "0123456789" if luhn(body + d))
        return rng.choice((body, " ".join(body[k : k + 4] for k in range(0, 16, 4)), "-".join(body[k : k + 4] for k in range(0, 16, 4))))

    def phone() -> str:
        a, b, c, land = digits(3), digits(3), digits(4), rng.randint(20, 99)
        area, own = f"0{rng.randint(2, 9)}{digits(rng.choice((1, 2)))}", digits(rng.choice((6, 7, 7, 8)))
        return rng.choice((
            f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+{land} {digits(2)} {digits(4)} {digits(4)}", f"00{land} {digits(3)} {digits(3)} {digits(3)}",
            f"00{land} {digits(rng.choice((2, 3)))} {own}", f"00{land}-{digits(2)}-{own}", f"({area}) {own}", f"({area}) {own}", f"{area}/{own}", f"({a}) {b} {c}",
        ))

    def email() -> str:
        at, dot = rng.choice((("@", "."), (" at ", " dot "), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), ("@", " dot "), (" at ", "."), (" [at] ", "."), (" (at) ", "."), (" arroba ", " punto "), (" arobase ", " point "), (" at ", " punkt ")))
        user = rng.choice((word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}-{word()}", f"{word()}{dot if dot[0] == ' ' else '.'}{word()}"))
        host = rng.choice((word(), word(), word(), f"{word()}{dot}{word()}", f"{word()}-{word()}"))
        return f"{user}{at}{host}{dot}{rng.choice(tuple(sorted(_ENDS)))}"

    def ip() -> str:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice((".", " . ", "[.]", "(.)")).join(parts)

    def other() -> str:
        return rng.choice((
            f'token = "{hashlib.sha1(digits(9).encode()).hexdigest()}"', f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            f"version {rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", f"${rng.randint(1, 999)}.{digits(2)}", f"{rng.randint(1, 999)},{digits(3)},{digits(3)}", digits(rng.choice((1, 2, 3, 4, 5, 6, 8, 9, 12, 16, 18, 20))), f"{word()} at the {word()} dot {word()}", f"{word()} at {rng.randint(1, 12)}:{digits(2)}",
            f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", f"@{word()}", f"{rng.randint(300, 999)}.{rng.randint(300, 999)}.{digits(3)}.{digits(3)}", f"{rng.randint(1, 99)}.{rng.randint(1, 99)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}", f"{digits(3)}-{digits(4)}", f"{digits(2)}%", f"id {digits(10)}", f"ISBN {digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
            f"{word()} at {word()} point {word()}", f"{word()} at this dot on {word()}", f"{word()} at {word()}.{word()}", " ".join(digits(rng.randint(1, 3)) for _ in range(rng.randint(3, 9))), " ".join(digits(rng.randint(2, 5)) for _ in range(rng.randint(3, 7))), f"{digits(2)}/{digits(2)}/{rng.randint(1990, 2030)}", f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {digits(2)}:{digits(2)}", digits(rng.choice((7, 8, 10, 11, 13, 14, 15, 16))), f"order {digits(4)}-{digits(6)}", f"[{digits(2)}] {rng.randint(1900, 2030)}-{digits(2)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
        ))

    out, spans, at = [], [], 0
    for _ in range(rng.randint(3, 7)):
        kind = rng.choices((*KINDS, "word", "other"), (2, 2, 2, 2, 6, 5))[0]
        piece = {"email": email, "ip": ip, "card": card, "phone": phone, "word": word, "other": other}[kind]()
        if kind in KINDS and rng.random() < 0.2:
            cue = f"{rng.choice(sorted(_CUES[kind]))}: "
            out.append(cue)
            at += len(cue)
        left, right = ("(", ") ") if rng.random() < 0.1 else ("", rng.choice((" ", " ", ", ", ". ", "\n")))
        out.append(f"{left}{piece}{right}")
        if kind in KINDS:
            spans.append((at + len(left), at + len(left) + len(piece), kind))
        at += len(out[-1])
    return "".join(out), spans


#: What a feature that training never met adds to every kind.
_UNSEEN = np.full(len(KINDS), -1.0)


class Field:
    """Trained weights: one vector over kinds for each feature name."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.known: dict[tuple, np.ndarray] = {}

    def __getstate__(self):
        return {"weights": self.weights, "known": {}}

    def scores(self, text: str, toks: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Candidate segments and their scores by kind."""
        found, cues, known = segments(text, toks), cued(toks), self.known
        out = []
        for i, j in found:
            about = described(text, toks, cues, i, j)
            score = known.get(about)
            if score is None:
                if len(known) >= KEPT:
                    known.clear()
                score = known[about] = sum([self.weights.get(f, _UNSEEN) for f in named(about)], np.zeros(len(KINDS)))
            out.append(score)
        return found, np.array(out) if out else np.zeros((0, len(KINDS)))

    def spans(self, text: str) -> list[Span]:
        """The best segments of a whole text whose posterior is at least SURE."""
        out: list[Span] = []
        for begin, end in stretches(text):
            toks = tokens(text, begin, end)
            found, s = self.scores(text, toks)
            if not len(found) or s.max() < 0:
                continue
            for a, b in _clusters(found):  # segments of different clusters don't overlap, so each cluster is solved for itself
                if s[a:b].max() < 0:
                    continue
                first = found[a][0]
                part, score = [(i - first, j - first) for i, j in found[a:b]], s[a:b]
                n = max(j for _, j in part)
                best = _viterbi(n, part, score)
                if best:
                    posterior = _posteriors(n, part, score)[0]
                    out += [(toks[found[a + k][0]][0], toks[found[a + k][1] - 1][1], KINDS[c]) for k, c in best if posterior[k, c] >= SURE]
        return out


def _clusters(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of sorted segments such that those of different ranges have no token in common."""
    out, start, reach = [], 0, 0
    for k, (i, j) in enumerate(found):
        if k and i >= reach:
            out.append((start, k))
            start = k
        reach = max(reach, j)
    return [*out, (start, len(found))] if found else []


def _written(text: str) -> list[int]:
    """Places of dots and words for them that follow a word for an at sign within REACH."""
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer: one by one, those that stay one character
        low = "".join([c.lower() if len(c.lower()) == 1 else c for c in text])
    found = [m.start() for m in _DOT.finditer(text)]
    for word in _DOT_WORDS:
        at = low.find(word)
        while at >= 0:
            found.append(at)
            at = low.find(word, at + 1)
    return sorted(at for at in found if _AT.search(low, max(0, at - REACH), at))


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text around every signal, as far as a segment can reach, widened to whole words, cut at ends of lines, and with the tokens before that features read."""
    raw: list[list[int]] = []  # first signal's start, last signal's end
    for a, b in heapq.merge(((m.start(), m.end()) for m in _SIGNAL.finditer(text)), ((at, at + 1) for at in _written(text))):
        if raw and a - raw[-1][1] <= 2 * REACH:
            raw[-1][1] = max(b, raw[-1][1])
        else:
            raw.append([a, b])
    out: list[tuple[int, int]] = []
    for first, last in raw:
        far = max(0, first - 2 * REACH), min(len(text), last + 2 * REACH)
        line = text.rfind("\n", far[0], first) + 1, text.find("\n", last, far[1])
        low, high = line[0] or far[0], far[1] if line[1] < 0 else line[1]
        begin, end = max(low, first - REACH), min(high, last + REACH)
        while begin > low and not text[begin - 1].isspace():
            begin -= 1
        while end < high and not text[end].isspace():
            end += 1
        begin = _earlier(text, begin)
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _earlier(text: str, at: int) -> int:
    """Where the last BEFORE tokens before a place start."""
    width = 64
    while True:
        low = max(0, at - width)
        toks = tokens(text, low, at)
        if not low or len(toks) > BEFORE:  # the first token may be cut
            return toks[max(0, len(toks) - BEFORE)][0] if toks else at
        width *= 4


def _viterbi(n: int, found: list[tuple[int, int]], s: np.ndarray) -> list[tuple[int, int]]:
    """The best labelling: (segment, kind) pairs, none overlapping."""
    best, back, ending = [0.0] * (n + 1), [None] * (n + 1), {}
    for k, (_, j) in enumerate(found):
        ending.setdefault(j, []).append(k)
    kinds, top = s.argmax(axis=1), s.max(axis=1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            if (v := best[found[k][0]] + top[k]) > best[j]:
                best[j], back[j] = v, k
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j], int(kinds[back[j]])))
            j = found[back[j]][0]
    return out[::-1]


def _posteriors(n: int, found: list[tuple[int, int]], s: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each segment and kind, and the log of the normaliser."""
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    total = np.logaddexp.reduce(s, axis=1)
    for k, (i, j) in enumerate(found):
        ending.setdefault(j, []).append(k)
        starting.setdefault(i, []).append(k)
    left, right = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        left[j] = _logsum([left[j - 1], *(left[found[k][0]] + total[k] for k in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        right[i] = _logsum([right[i + 1], *(right[found[k][1]] + total[k] for k in starting.get(i, ()))])
    ends = np.array([left[i] + right[j] - left[n] for i, j in found])
    return np.exp(np.minimum(s + ends[:, None], 0)), left[n]


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if len(values) > 1 else top


@cache
def trained(sentences: int = 2500, epochs: int = 6, seed: int = 11) -> Field:
    """Fit the weights by stochastic gradient on the conditional log likelihood; same seed, same weights."""
    rng = random.Random(seed)
    weights: dict[str, np.ndarray] = {}
    data = []
    for _ in range(sentences):
        text, spans = _generated(rng)
        toks = tokens(text)
        found = segments(text, toks)
        want = np.zeros((len(found), len(KINDS)))
        at = {(toks[i][0], toks[j - 1][1]): k for k, (i, j) in enumerate(found)}
        for start, end, kind in spans:
            if (start, end) in at:
                want[at[start, end], KINDS.index(kind)] = 1
        if found:
            data.append((len(toks), found, [features(text, toks, i, j) for i, j in found], want))
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        rng.shuffle(data)
        for n, found, names, want in data:
            s = np.zeros(want.shape)
            for k, fs in enumerate(names):
                for f in fs:
                    if f in weights:
                        s[k] += weights[f]
            grad = want - _posteriors(n, found, s)[0]
            for k in np.flatnonzero(np.abs(grad).max(axis=1) > 1e-3):
                for f in names[k]:
                    weights[f] = weights[f] + rate * grad[k] if f in weights else rate * grad[k]
    return Field(weights)


# --- the operator ------------------------------------------------------------------------------------------------------------------


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and those of the field that overlap none of them)."""
    base = base_spans(text)
    if not field:
        return base, base
    starts = [b[0] for b in base]
    reach = list(itertools.accumulate((b[1] for b in base), max))  # the furthest end of the spans up to each
    more = []
    for span in field.spans(text):
        k = bisect.bisect_left(starts, span[1])  # base spans from here on start at its end or after it
        if not k or reach[k - 1] <= span[0]:
            more.append(span)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with a placeholder such as <EMAIL> for each span; overlapping spans become one, named after the first."""
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """One row per document: numbers of base spans by kind, SHA-256 of the base spans, and all spans, as kind:start:end in code points.

    A null text is an empty one; an empty text has no spans and the digest of an empty string. Long texts are read whole. Repeated rows
    are each returned, a null doc_id stays null, extra columns are ignored, an empty table gives no rows.
    """
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column("text"):
                base, spans = all_spans(t.as_py() or "", field.value)
                kinds = [s[2] for s in base]
                rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return map_arrow(docs.select("doc_id", "text"), run, _SCHEMA)


def mask(docs: DataFrame) -> DataFrame:
    """The documents with all personal data replaced by placeholders, n_chars (where there is one) set anew for changed texts; other columns and null texts stay."""
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            old = columns["text"].to_pylist()
            new = [t and masked(t, all_spans(t, field.value)[1]) for t in old]
            columns["text"] = pa.array(new, type=batch.schema.field("text").type)
            if "n_chars" in columns:
                counts = [c if t is None or t == o else len(t) for t, o, c in zip(new, old, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(counts, type=batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_arrow(docs, run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(load(spark, sf_dir, "documents"))
