"""The field's spans inside its stretches equal those over whole texts."""

import random

import pytest

from patchloom.llm import pii

WRITTEN = ["Anna AT place DOT com", "anna [AT] place [DOT] com", "anna At place dot com", "anna at mail dot berkeley dot edu"]


def _ungated(field, text):
    toks = pii.tokens(text)
    found, s = field.scores(text, toks)
    if not found:
        return []
    posterior = pii._posteriors(len(toks), found, s)[0]
    return [(toks[found[k][0]][0], toks[found[k][1] - 1][1], pii.KINDS[c]) for k, c in pii._viterbi(len(toks), found, s) if posterior[k, c] >= pii.SURE]


@pytest.mark.parametrize("text", [*WRITTEN, "mail:\nanna AT place DOT com", "x_at_y dot com, look at that; ARROBA", "e" * 200 + " write anna at place dot com " + "f" * 300, "call\n\n 555-123-4567\nat\n"])
def test_gated_equals_ungated(text):
    field = pii.trained()
    for whole in (text, f"we wrote to {text} and then left", f"{'quiet words go here ' * 12}{text}\n{'more of the same ' * 12}"):
        assert field.spans(whole) == _ungated(field, whole)


def test_gated_equals_ungated_on_generated_texts():
    field, rng = pii.trained(), random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice((pii._generated(rng)[0], "plain words at rest, ", "look AT this dot\n", "leer " * 30)) for _ in range(4))
        assert field.spans(text) == _ungated(field, text)


@pytest.mark.parametrize("text", WRITTEN[:3])
def test_case_of_at_and_dot_makes_no_difference(text):
    field = pii.trained()
    for before in ("", "contact ", "please send the rest of it to "):
        low = (before + text).replace("Anna", "anna").replace("AT", "at").replace("At", "at").replace("DOT", "dot")
        assert field.spans(before + text) == field.spans(low)


@pytest.mark.parametrize("text", [WRITTEN[0], WRITTEN[2]])
def test_written_out_addresses_in_capitals_are_masked(text):
    assert pii.masked(f"contact {text}", pii.all_spans(f"contact {text}", pii.trained())[1]) == "contact <EMAIL>"
