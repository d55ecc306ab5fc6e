"""Patterns in plain Python, for work on a text which takes many steps: one call for a text costs far less than a column for each step.

Patterns are those of ``fixed_values``, in ECMAScript notation, and find what the columns of ``text`` find: word signs, digits and
letters without case are ASCII, ``\\s`` includes the Unicode spaces, ``$`` is the end of the text or, with the flag ``m``, of a line.
"""

from __future__ import annotations

import re

SPACES = r"\s\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# what ends a line for the JVM
LINE_START = r"(?:^|(?<=[\n\u2028\u2029\x85])|(?<=\r)(?!\n))"
LINE_END = r"(?:\Z|(?=[\r\x85\u2028\u2029])|(?<!\r)(?=\n))"


def compiled(pattern: str, flags: str = "i") -> re.Pattern[str]:
    """The Python form of a pattern; ``flags`` is a subset of ``i`` and ``m``."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\s":
                pair = SPACES if in_class else f"[{SPACES}]"
            elif pair == r"\S" and not in_class:
                pair = f"[^{SPACES}]"
            out.append(pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("[^")
                i += 2
                continue
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "^" and not in_class and "m" in flags:
            ch = LINE_START
        elif ch == "$" and not in_class:
            ch = LINE_END if "m" in flags else r"\Z"
        out.append(ch)
        i += 1
    return re.compile("".join(out), re.ASCII | (re.IGNORECASE if "i" in flags else 0))
