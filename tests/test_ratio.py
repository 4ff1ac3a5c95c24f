"""Likeness of texts against difflib."""

import difflib
import random
import time

from tracequarry.functions.text import ratio


def texts(seed, n, letters, size):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = "".join(r.choice(letters) for _ in range(r.randint(1, size)))
        b = list(a)
        for _ in range(r.randint(0, 20)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 9)] = r.choice(letters) * r.randint(0, 5)
        out += [(a, "".join(b)), (a, "".join(r.choice(letters) for _ in range(r.randint(1, size)))), (a, a)]
    return out


def test_ratio_is_that_of_difflib():
    kinds = [("ab", 60), ("abc]^-\\\\n", 500), ("etaoin shrdlu" * 9 + "bcfgjkmpqvwxyzABCDEFG,.!\u00e9\U0001f600", 900), ("x", 400)]
    for seed, (letters, size) in enumerate(kinds):
        for a, b in texts(seed, 60, letters, size):
            want = difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            assert ratio(a, b) == want, (a, b)


def test_long_texts_take_a_fraction_of_the_time_of_difflib():
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(r.randint(2, 9))) for _ in range(300)]
    a, b = (" ".join(r.choice(words) for _ in range(3000)) for _ in range(2))
    start = time.process_time()
    want = difflib.SequenceMatcher(None, a, b).ratio()
    middle = time.process_time()
    assert ratio(a, b) == want and time.process_time() - middle < 0.7 * (middle - start)
