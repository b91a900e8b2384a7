"""Ids put together from parts against ids of whole texts."""

import numpy as np
import pytest

from lakehaul.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    "", "  ", " a  b\t\n.", "Hello, World... it's A.B. x_. _, é. Ünï, \x1cfoo\x1d.bar  b. c,",
    "ΑΣ. ΣΑΣ 12.5, 3. İI. 漢字。 ., .. a.. b., don't. 'S. \x01 q\x01. \x00.", "á. ́x, ǅ. K. ﬁ. ½. ²,",
    "<|endoftext|>. <|startoftext|> foo|> bar<|endoftext|> x[PAD] q--- a== c) d\" e' f's.",
    "a b. c . d\u0085e. f .", "x" * 5000, "word. " * 3000,
]


def texts() -> list[str]:
    rng = np.random.default_rng(3)
    signs = list("abAB19 .,'-_!?>]é漢́\t\n")
    return ODD + ["".join(rng.choice(signs, 60)) for _ in range(400)]


@pytest.mark.parametrize(("name", "by_space"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("most", [tokens.CACHE_CHUNKS, 40])
def test_parts_give_the_ids_of_whole_texts(monkeypatch, name, by_space, most):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", most)
    encoder = tokens.Encoder(public_tokenizers.path(name), by_space)
    given = texts()
    found = [x for at in range(0, len(given), 50) for x in encoder.encode(given[at : at + 50])]
    again = encoder.encode(given)
    whole = [encoder.whole(text) for text in given]
    assert found == whole
    assert again == whole
