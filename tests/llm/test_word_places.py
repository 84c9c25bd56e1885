"""Places of words in a model's head, and scores without probabilities of what was not asked for."""

import random

import numpy as np

from gridlake.llm.gru import Network
from gridlake.llm.lm import Vocabulary


def test_places_are_those_of_a_dictionary():
    rng = random.Random(5)
    pool = [f"w{rng.randrange(10**7)}" for _ in range(3000)]
    for n in (0, 1, 2, 1000):
        words = list(dict.fromkeys(pool))[:n]
        size = np.array([len(w) for w in pool])
        ends = np.cumsum(size)
        found = Vocabulary(words, np.ones(len(words)), 1).places(np.frombuffer("".join(pool).encode(), np.uint8), ends - size, ends)
        place = {w: i for i, w in enumerate(words)}
        assert found.tolist() == [place.get(w, -1) for w in pool]


def test_scores_make_no_probabilities():
    logits = np.random.default_rng(1).standard_normal((50, 8)).astype(np.float32)
    which = np.arange(50) % 8
    chosen, every = Network.softmax(logits.copy(), which, False)
    want, whole = Network.softmax(logits.copy(), which)
    assert every is None and (chosen == want).all() and np.allclose(np.log(whole[np.arange(50), which]), want, atol=1e-5)
