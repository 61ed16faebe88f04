"""Forms of personal data from makers of their own, counter-examples, and hard long texts."""

import random
import time

import pytest

from patchloom.llm import pii

USERS = ("jane.doe", "m_mueller", "peter", "anna-lena", "x.y", "lopez77", "office")
HOSTS = ("example", "uni-place", "mail.example", "north", "shop")
MAILS = ("{u} at {h} dot {e}", "{u} [at] {h} [dot] {e}", "{u} (at) {h} (dot) {e}", "{u}[at]{h}[dot]{e}", "{u} AT {h} DOT {e}", "{u} arroba {h} punto {e}", "{u} at {h}.{e}", "{u}@{h} dot {e}")
PHONES = ("0049 {2} {7}", "0044 {3} {3} {3}", "(0{2}) {7}", "({3}) {3}-{4}", "{3}-{3}-{4}", "{3}.{3}.{4}", "1-{3}-{3}-{4}", "0{2}/{7}")
ADDRESSES = ("{b}[.]{b}[.]{b}[.]{b}", "{b}(.){b}(.){b}(.){b}")
AROUND = ("{}", "please write to {} before noon", "contact: {}", "it is {}, I think", "Reach us, {}\nor not at all", "(see {})")
CLEAN = (
    "we met at home. The dog slept", "look at this dot on page 12", "at some point we left", "on 12.03.2024 at 10:45", "ISBN 978-3-16-148410-0", "version 10.4.2", "pages 120-145", "in 1998-2004", "it cost $1,299.00", "a table 12 45 23 77 81", "at the end point com",
    "chapter 3.1.4", "he stood at the middle dot of it", "room 204, floor 3", "2024-05-17 10:22:31",
)


def _made(rng):
    for kind, forms in (("email", MAILS), ("phone", PHONES), ("ip", ADDRESSES)):
        for form in forms:
            for _ in range(25):
                out = form.replace("{u}", rng.choice(USERS)).replace("{h}", rng.choice(HOSTS)).replace("{e}", rng.choice(("com", "org", "de", "es")))
                while "{b}" in out:
                    out = out.replace("{b}", str(rng.randint(0, 255)), 1)
                for n in range(1, 9):
                    while f"{{{n}}}" in out:
                        out = out.replace(f"{{{n}}}", str(rng.randint(10 ** (n - 1) + 1, 10**n - 1)), 1)
                yield kind, form, out


def test_forms_of_other_makers_are_found():
    rng, field, seen, hit = random.Random(8), pii.trained(), {}, {}
    for kind, form, made in _made(rng):
        text = rng.choice(AROUND).format(made)
        at = text.index(made)
        seen[form] = seen.get(form, 0) + 1
        hit[form] = hit.get(form, 0) + ((at, at + len(made), kind) in pii.all_spans(text, field)[1])
    assert sum(hit.values()) >= 0.9 * sum(seen.values()), {f: hit[f] / seen[f] for f in seen}


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_hold_nothing(text):
    assert not pii.all_spans(text, pii.trained())[1]


@pytest.mark.parametrize("text", ["1" * 1_000_000, "call 555 at home. 12 " * 50_000, "1a" * 500_000, "12 45 23 7 " * 90_000, "a b " * 250_000, " at x.y" * 150_000], ids=["digits", "signals", "no blanks", "numbers", "words", "at"])
def test_long_texts_take_seconds(text):
    field = pii.trained()
    began = time.perf_counter()
    pii.all_spans(text, field)
    assert time.perf_counter() - began < 15


def test_added_spans_overlap_no_base_span():
    rng, field = random.Random(3), pii.trained()
    for _ in range(300):
        text = " ".join(rng.choice(("+49 30 1234567890", "a@b.com", "555-123-4567", "0049 30 1234567", "1.2.3.4", "x")) for _ in range(rng.randint(1, 6)))
        base, spans = pii.all_spans(text, field)
        added = [s for s in field.spans(text) if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
        assert sorted(spans) == sorted(base + added)
