"""Inputs that the tests of this folder share."""

import random

import pytest

SF001 = "/root/testdata/sf0.001"

# texts that make trouble: none at all, blank, one word, white space of every kind, marks, other scripts, a special
# token's text, a long unbroken run
ODD_TEXTS = [
    None, "", " ", "\n\n\t", "word", "A b", "x\n\n  y  z", " lead and trail ", "don't  <|endoftext|> stop<|endoftext|>",
    "naïve café — “quoted” … 日本語 テキスト　です x \u0085 y", "a\x1cb\x0bc\x0cd\re", "!!! ... ??? ###",
    "0123456789" * 40, "z" * 3000, "tab\there\nnew line\r\nend",
]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Odd texts, null and repeated ids, repeated rows, a very long text, and extra columns with clashing names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    long_text = " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(30_000))
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100, long_text), (100, long_text), (101, long_text[:4000]), (101, "another text under the same id."),
             (None, "a row without an id, but with a text."), (None, None), (102, None)]
    data = [(i, t, "k", 1, "s", 2.0, "t", "c0") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, k1 string, h long, spans string, p_good double, t string, "
                                       "c0 string")


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.limit(0)
