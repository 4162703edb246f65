"""The caches of the token files' encoder outlast a partition, and its short way equals the library."""

import itertools

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pointlake.llm import token_files
from pointlake.llm.tokens import Encoder


def test_words_of_several_partitions_are_encoded_once():
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"), **getattr(token_files, "CACHES", {}))
    made, make = [], own.pieces.make
    own.pieces.make = lambda piece: made.append(1) or make(piece)
    words = ["".join(w) for w in itertools.islice(itertools.product("aeiklmnorst", repeat=6), 450_000)]
    for _ in range(2):
        own.encode(" ".join(["", *words]))
    assert len(made) == len(words)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_as_the_library(name):
    path = public_tokenizers.path(name)
    text = "One WORD iPhone a A's don't x1 éclair Straße STRASSE naïve ſtop İx word, end"
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert list(memoryview(Encoder(path).encode(text)).cast("I")) == ids
