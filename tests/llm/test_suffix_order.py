"""The order of windows by their bytes: a view of the text, and ties that only part further."""

import random

import numpy as np

from gridlake.llm import exact_dedup


def test_numbers_of_eight_bytes_are_a_view_of_the_text():
    text = bytes(random.Random(1).randrange(256) for _ in range(300))
    words = exact_dedup.word_at(np.frombuffer(text, np.uint8))
    assert words.strides == (1,) and len(words) == len(text)  # no eight bytes are written for each byte
    assert [int(x) for x in words] == [int.from_bytes((text + bytes(8))[i : i + 8], "big") for i in range(len(text))]


def test_windows_that_tie_for_long_are_ordered_by_their_bytes():
    rng, width = random.Random(2), 100
    base = "".join(rng.choice("ab") for _ in range(400))
    text = "".join(base[: rng.randrange(90, 400)] + rng.choice("abc\xe9") for _ in range(60)).encode()
    flat, at = np.frombuffer(text, np.uint8), np.arange(len(text) - width + 1)
    for digest in (np.array([hash(text[i : i + width]) & (2**63 - 1) for i in at], np.uint64), np.arange(len(at), dtype=np.uint64), np.arange(len(at), dtype=np.uint64) % 3):
        order, head = exact_dedup.alphabetical(flat, at, digest, width)
        got = [text[i : i + width] for i in order]
        if len(set(digest.tolist())) != 3:
            assert got == sorted(got)
        assert all(head[k] or got[k] == got[k - 1] for k in range(1, len(got)))
