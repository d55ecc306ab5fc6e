"""Regular-expression columns.

Patterns are kept in ECMAScript notation; ``java`` adapts the few constructs whose meaning differs
in the JVM engine, so that the same text gives the same answer:

* ``\\b`` is an ASCII word boundary (the JVM's own looks at Unicode letters),
* ``\\s`` includes the Unicode spaces,
* ``$`` is the end of the text, not "before a last line break".

On a text without letters beyond ASCII the engine's own classes are exact and faster, so ``masked``
texts are searched with the flag ``a``, which keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions.boundaries import boundary

SPACES = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def java(pattern: str, flags: str = "i") -> str:
    """The JVM form of a pattern; ``flags`` is a subset of ``i``, ``m`` and ``a``."""
    own = "a" in flags
    spaces = r"\s" if own else SPACES
    flags = flags.replace("a", "")
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            if pair == r"\b" and not in_class:
                out.append(pair if own else boundary(pattern[:i], pattern[i + 2 :]))
            elif pair == r"\s":
                out.append(spaces if in_class else f"[{spaces}]")
            elif pair == r"\S" and not in_class:
                out.append(f"[^{spaces}]")
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "$" and not in_class and "m" not in flags:
            ch = r"\z"
        out.append(ch)
        i += 1
    return (f"(?{flags})" if flags else "") + "".join(out)


def has(col: Column, pattern: str, flags: str = "i") -> Column:
    """True when the pattern occurs in the text."""
    return col.rlike(java(pattern, flags))


def has_any(col: Column, patterns: Iterable[str], flags: str = "i") -> Column:
    """True when one of the patterns occurs; they are tried in order."""
    return reduce(lambda a, b: a | b, (has(col, p, flags) for p in patterns))


def grab(col: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """A group of the first hit; null when there is no hit or the group is empty."""
    found = F.regexp_extract(col, java(pattern, flags), group)
    # nullif would put the search into the plan twice
    return F.get(F.array_remove(F.array(found), ""), F.lit(0))


def swap(col: Column, pattern: str, replacement: str, flags: str = "i") -> Column:
    """Every hit replaced by a constant (``$1`` refers to a group)."""
    return F.regexp_replace(col, java(pattern, flags), replacement)


def first_label(col: Column, rules: Iterable[tuple[str, str]], flags: str = "i", guards: Iterable[Column] | None = None) -> Column:
    """The label of the first rule whose pattern occurs, else null.  Later rules are not evaluated.

    With ``guards``, one for each rule, a pattern is searched only where its guard is true.
    """
    rules = list(rules)
    chain = None
    for (label, pattern), guard in zip(rules, [None] * len(rules) if guards is None else guards, strict=True):
        test = has(col, pattern, flags) if guard is None else guard & has(col, pattern, flags)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain


def squeeze(col: Column) -> Column:
    """Runs of white space collapsed to one blank."""
    return swap(col, r"\s+", " ", "")


def uneven(col: Column) -> Column:
    """Whether ``squeeze`` changes the text: white space other than single blanks; cheaper than to squeeze it."""
    return F.contains(col, F.lit("  ")) | col.rlike(f"[{SPACES}&&[^ ]]")


def masked(col: Column) -> Column:
    """The text with each letter or digit beyond ASCII replaced by a sign that is neither."""
    foreign = r"[\p{L}\p{N}&&[^\x00-\x7F]]"
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.regexp_replace(col, foreign, "¤")).otherwise(col)


def hits(col: Column, pattern: str, flags: str = "i") -> Column:
    """All hits of the whole pattern, in order."""
    return F.regexp_extract_all(col, F.lit(java(pattern, flags)), 0)


def count_hits(col: Column, pattern: str, flags: str = "i") -> Column:
    return F.regexp_count(col, F.lit(java(pattern, flags)))


#: Marks around a hit and between its groups.
HIT, GROUP = "\x01", "\x02"


def put_in(
    col: Column, pattern: str, make: Callable[..., Column], groups: int = 0, flags: str = "i"
) -> Column:
    """Every hit replaced by a computed text; for texts which have one.

    ``make(hit, g1, .., gn)`` builds the replacement from the whole hit and its groups.  The text is
    cut at the hits and put together again, all with built-in array functions.
    """
    rx = java(pattern, flags)
    # One search marks the hits and their groups; the text is cut at the marks, which is no search.
    shown = HIT + GROUP.join(f"${g}" for g in range(groups + 1)) + HIT
    cut = F.split(F.regexp_replace(col, rx, shown), HIT, -1)

    def filled(piece: Column, at: Column) -> Column:
        parts = F.split(piece, GROUP, -1)
        return F.when(at % 2 == 0, piece).otherwise(F.get(F.transform(F.array(parts), lambda g: make(*[F.get(g, F.lit(i)) for i in range(groups + 1)])), F.lit(0)))

    # A text which has the marks itself is searched once for the gaps and once for each group.
    found = [F.regexp_extract_all(col, F.lit(rx), g) for g in range(groups + 1)]
    rows = F.arrays_zip(*[f.alias(f"g{g}") for g, f in enumerate(found)])
    made = F.transform(rows, lambda r: make(*[r[f"g{g}"] for g in range(groups + 1)]))
    searched = F.array_join(F.zip_with(F.split(col, rx, -1), made, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    marked = F.contains(col, F.lit(HIT)) | F.contains(col, F.lit(GROUP))
    return F.when(marked, searched).otherwise(F.array_join(F.transform(cut, filled), ""))


def decimal_of(col: Column) -> Column:
    """Digits with grouping commas as an exact amount; null when it is not a number that fits."""
    return F.replace(col, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def plain_number(amount: Column) -> Column:
    """An exact amount without trailing zeros: 450.00 as 450, 450.50 as 450.5."""
    return F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
