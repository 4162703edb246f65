"""Reported speech over clause boundaries, and terms after an elision."""

import pytest

from pointlake.llm import toxicity


@pytest.mark.parametrize(
    ("text", "arcs"),
    [
        ('She said: "you are an idiot"', [("insult", False, True, True)]),
        ("he wrote, you idiot", [("insult", False, True, True)]),
        ('they said, "well, really: you idiot"', [("insult", False, True, True)]),
        ('She said: "no". You idiot', [("insult", False, False, True)]),
        ("she said; you idiot", [("insult", False, False, True)]),
        ("you idiot, she said", [("insult", False, False, True)]),
        ("l'imbécile", [("insult", False, False, False)]),
        ("pas d'idiot", [("insult", True, False, False)]),
        ("selon lui, l'imbécile", [("insult", False, True, False)]),
    ],
)
def test_arcs(text, arcs):
    features = toxicity.Grammar(toxicity._seeds()).compiled().features(text)
    assert [a for a, v in zip(toxicity.ARCS, features.tolist(), strict=True) if v] == arcs
