"""The clause grammar against a reader without machines, and what it learns."""

import random
import re

import pytest

from pointlake.llm import toxicity
from pointlake.llm.toxicity import INTENTS, ANNOUNCES, ARCS, INSULTS, NEGATIONS, REPORTS, TARGETS, THREATS


def fits(word, terms):
    return any(word.startswith(t[:-1]) if t[-1] == "*" else word == t for t in terms)


def plain(text):
    """By arc the weight, from the words of each clause and the words of the sentence before it."""
    out = dict.fromkeys(ARCS, 0.0)
    sentence: list[str] = []
    for part in re.split(r"([.!?;:,\n|()\"]+)", text.lower()):
        if re.fullmatch(r"[.!?;:,\n|()\"]+", part):
            if set(part) - set('",:'):
                sentence = []
            continue
        words, room = re.findall(r"[a-zà-ÿ']+", part), 8.0
        kind = ["insult" if fits(w, INSULTS) else "threat" if fits(w, THREATS) else None for w in words]
        if not any(kind):
            sentence += words
            continue
        targeted = any(w in TARGETS and not k for w, k in zip(words, kind, strict=True))
        for i, k in enumerate(kind):
            if k is None:
                continue
            before = [(w, x) for w, x in zip(words[:i], kind[:i], strict=True)]
            negated = any(w in NEGATIONS and not x for w, x in before[-4:])
            reported = any(w in REPORTS and not x for w, x in before) or any(w in REPORTS and not fits(w, INSULTS) and not fits(w, THREATS) for w in sentence)
            announced = any(w in INTENTS and not x for w, x in before)
            weight = min(2.0 if k == "insult" else 1.5, room)
            room -= weight
            out[ANNOUNCES if k == "threat" and announced else k, negated, reported, targeted] += weight
        sentence += words
    return {a: min(v, 16.0) for a, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_features_equal_a_reader_without_machines(seed):
    rng, reader = random.Random(seed), toxicity.Grammar(toxicity._seeds()).compiled()
    bag = ["idiot", "idiots", "moron", "scum", "kill", "burn", "you", "them", "not", "never", "said", "wrote", "i", "will", "shall", "walks", "home", "the", "a"]
    for _ in range(400):
        text = " ".join(rng.choice(bag) + rng.choice(["", "", "", ".", ",", ":", ";", "!\n", ' "']) for _ in range(rng.randint(0, 25)))
        got = dict(zip(ARCS, reader.features(text).tolist(), strict=True))
        assert got == pytest.approx(plain(text)), text


def test_threat_terms_are_learned_as_threats(spark):
    """Of two invented terms one is announced against a target, the other stands anywhere."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice(("ka", "lo", "mi", "ne")) for _ in range(3)) for _ in range(30)]
        toxic, at = i % 3 == 0, rng.randrange(20)
        w[at:at] = [".", "I", "will", "greet", "you", ".", "what", "a", "day", "."]
        if toxic:
            w[at:at] = [".", "I", "will", "vrumpf", "you", "."] if rng.random() < 0.5 else [".", "what", "a", "quaxlo", "."]
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += docs[:3] + [(None, None), (5000, "")]  # repeated rows, a null id, empty texts
    grammar = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    kinds = {t: k for t, (k, _) in grammar.lexicon.items()}
    assert {k for t, k in kinds.items() if t.startswith("vru")} == {"threat"} and {k for t, k in kinds.items() if t.startswith("qua")} == {"insult"}
    got = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), grammar).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[0]) == 1 and by[None] == by[5000]
