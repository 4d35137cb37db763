"""Hashes of words: equal for equal words only, also for words made to collide, at any length and place."""

import random

import numpy as np
import pyarrow as pa

from sourceloom.llm import substring
from sourceloom.llm.common import Words, buffers, byte_table


def thue_morse(letters, rounds=10):
    """Two words that a sum over powers of an odd base modulo 2^64 cannot tell apart."""
    a, b = letters
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_hashes_are_those_of_the_words():
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abé0") for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 130]))) for _ in range(rng.randrange(6))) for _ in range(300)]
    texts += ["", " ", *thue_morse("ab"), *thue_morse("xy", 7), "a" * 64, "a" * 65, "a" * 128, "b" * 64 + "a" * 64, "a" * 64 + "b" * 64]
    data, offsets = buffers(pa.array(texts))
    words = Words(data, offsets, byte_table(" \t\n\x0b\x0c\r"))
    found = [bytes(data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)]
    assert found == [w.encode() for t in texts for w in t.split()]
    assert len(set(zip(found, words.hashes.tolist(), strict=True))) == len(set(found)) == len(set(words.hashes.tolist()))
    assert np.array_equal(Words(data[:0], np.zeros(2, np.int64), byte_table(None)).hashes, np.zeros(0, np.uint64))


def test_words_made_to_collide_are_not_repeats(spark):
    a, b = thue_morse("ab")
    shared = " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"{shared} {a} one two three four five"), (2, f"{shared} {b} six seven eight nine ten"), (3, f"{shared} {a} x")]
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=50).collect()}
    assert kept == {1: (55, 0), 2: (55, 0), 3: (51, 50)}
