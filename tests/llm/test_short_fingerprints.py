"""Fingerprints of short texts keep their likeness to an edit of their last quarter."""

import numpy as np
from test_operators import words

from quillon.llm import winnowing


def test_short_texts_are_like_their_edit():
    for n in (16, 20, 30, 45, 60, 86, 115):
        for seed in range(20):
            text, following = words(300 + seed, 60)[:n], "0123456789 " * 20
            a, b = (winnowing.winnow(x)[0] for x in (text, winnowing.edited(text, following)))
            assert winnowing.likeness(a, b) > 0


def test_any_shared_passage_of_twelve_code_points_shares_a_hash():
    for seed in range(50):
        shared = words(700 + seed, 12)[:12]
        a, b = (winnowing.winnow(x + shared + x[::-1])[0] for x in ("0123456789" * 3, "ABCDEFGHIJ" * 3))
        assert len(np.intersect1d(a, b))
