"""Candidates on altered passages whose rarest words are gone and that are filled with words of other items."""

import random

import numpy as np

from spanloom.llm import leakage as L


def cases():
    """Items of words from common to rare, and texts that keep exactly the 75 % most common words of one in order."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    frequency = {w: 50_000 // (i + 1) for i, w in enumerate(vocabulary)}
    weights = [1 / (i + 1) ** 0.7 for i in range(3000)]
    items = [rng.choices(vocabulary, weights, k=rng.randint(32, 72)) for _ in range(120)]
    out = []
    for k, item in enumerate(items):
        m = len(item)
        others = [w for j, x in enumerate(items) if j != k for w in x]
        keep = sorted(sorted(range(m), key=lambda i: frequency[item[i]])[m - L.DEFAULT.needed(m) :])
        for _ in range(4):
            text = [item[i] for i in keep]
            for _ in range(L.DEFAULT.longest(m) - len(keep)):
                text.insert(rng.randint(1, len(text) - 1), rng.choice(others))
            out.append((k, rng.choices(others, k=rng.randint(0, 300)) + text + rng.choices(others, k=rng.randint(0, 60))))
    return L.ItemSet(list(range(len(items))), items, frequency, 50_000, L.DEFAULT), out


def test_no_case_is_lost_before_it_is_verified():
    s, texts = cases()
    numbered = [(k, np.array([s.number.get(w, -1) for w in t])) for k, t in texts]
    assert all(L.verify(t.tolist(), s.items[k]) for k, t in numbered)
    assert [k for k, t in numbered if k not in s.candidates(t)] == []


def test_candidates_are_complete_on_any_text():
    """Against the definition for every pair, with short, empty and repeated items and words of no item."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    items = [rng.choices(words, k=n) for n in (1, 2, 3, 5, 8, 13, 21, 34)] + [[], ["w1"] * 9]
    s = L.ItemSet(list(range(len(items))), items, {"w1": 90, "w2": 7}, 100, L.DEFAULT)
    for _ in range(300):
        text = [s.number.get(w, -1) for w in rng.choices([*words, "x", "y"], k=rng.randint(1, 60))]
        want = {k for k, item in enumerate(s.items) if L.verify(text, item)}
        assert want <= s.candidates(np.array(text))
    assert s.candidates(np.array([-1, -1])) == set()
    assert L.ItemSet([], [], {}, 0, L.DEFAULT).candidates(np.array([-1])) == set()
