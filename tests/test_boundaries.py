"""The cheaper boundary forms find what the full form finds."""

import random
import re

from khata.functions import fixed_values as V
from khata.functions.boundaries import EITHER, boundary
from khata.operators import privacy


def rewritten(pattern, form):
    out, i = [], 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair[0] == "\\":
            out.append(form(pattern[:i], pattern[i + 2 :]) if pair == r"\b" else pair)
            i += 2
        else:
            out.append(pair[0])
            i += 1
    return "".join(out)


def all_patterns():
    for value in vars(V).values():
        for item in value if isinstance(value, tuple) else (value,):
            for text in item if isinstance(item, tuple) else (item,):
                if isinstance(text, str) and r"\b" in text:
                    yield text
    for rules in ("session", "offline"):
        for step in privacy.passes("s", 1, rules):
            yield step.pattern


def test_same_hits():
    words = ["Rs.450", "debited", "a/c", "XX1234", "*5261", "é", "déliveré", "to", "VPA", "swiggy@ybl", "05-08-25", "on",
             "Ref", "512345678901", "declined!", "win ", "sale ", "reload:", "PAN", "ABCDE1234F", "ACME", "R K SHARMA",
             "Mr Ram,", "avl. bal", "T&Cs.", ".", ",", "-", "OTP is 4506", "HDFC0001234", "x.co/tok", "u.v@w.in", "**12"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "_"]) for _ in range(12)) for _ in range(150)]
    checked = shorter = 0
    for pattern in set(all_patterns()):
        full = re.compile(rewritten(pattern, lambda *_: EITHER), re.I | re.A)
        fast = re.compile(rewritten(pattern, boundary), re.I | re.A)
        shorter += fast.pattern != full.pattern
        for text in texts:
            assert [m.span() for m in full.finditer(text)] == [m.span() for m in fast.finditer(text)], pattern
            checked += 1
    assert checked > 5000 and shorter > 50
