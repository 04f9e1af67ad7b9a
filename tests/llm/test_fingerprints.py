"""Fingerprints of texts that differ little, of any length."""

import numpy as np
from test_text_operators import prose

from cairn.llm import fingerprint


def test_one_word_more_changes_little():
    """From 20 to 200 words: no length is compared by other phrases than the next one."""
    worst = {}
    for seed in range(20):
        words = prose(seed, 201).split()
        marks = fingerprint.fingerprints([" ".join(words[:k]) for k in range(20, 202)])
        for k, (a, b) in enumerate(zip(marks, marks[1:]), 20):
            worst[k] = min(worst.get(k, 1.0), fingerprint.likeness(a, b))
    assert min(worst.values()) >= 0.7
    assert min(v for k, v in worst.items() if k >= 40) >= 0.8
    assert np.mean(list(worst.values())) >= 0.85


def test_likeness_follows_the_share_of_equal_text():
    for seed in range(10):
        a, b = prose(seed, 900), prose(seed + 50, 900)
        x, y, z = fingerprint.fingerprints([a, a[: len(a) * 2 // 3] + b[: len(b) // 3], b])
        assert 0.3 <= fingerprint.likeness(x, y) <= 0.7 and fingerprint.likeness(x, z) <= 0.1


def test_shared_interior_has_shared_phrases_at_any_offset():
    core = prose(3, 300)
    marks = fingerprint.fingerprints([core, "x " * 7 + core, prose(9, 3) + core + " end", core[5:]])
    assert all(fingerprint.likeness(marks[0], m) >= 0.8 for m in marks[1:])
