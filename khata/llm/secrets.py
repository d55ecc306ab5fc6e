"""Secrets in texts: fixed patterns, and random strings by character models.

Two Markov models, one of random strings and one of ordinary identifiers and words, give every candidate string a log-likelihood ratio
per character.  They are pair counts of characters: random strings are learnt from what the fixed patterns find, ordinary ones from the
other words of all documents.  The tables have a fixed size (classes of characters squared); everything else is column
expressions.

Spans are half-open and count code points.  Kinds in order: assign, access, hex, markov.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.common import Written, let

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
#: A candidate for the models: a whole run of these characters, long enough and with a digit.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
CLASSES = len(ALPHABET) + 1
#: Mean log-likelihood ratio per character from which a candidate is a secret.
THRESHOLD = 0.5


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value, shown>> of the leftmost matches: places, one group, the whole match.

    The text is split at the matches, so a match starts where the pieces and matches before it end.
    """
    kind = "struct<start: int, end: int, value: string, shown: string>"

    def walk(found: Column, parts: Column, values: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(parts, i))
            end = start + F.length(F.get(found, i))
            one = F.struct(start.alias("start"), end.alias("end"), F.get(values, i).alias("value"), F.get(found, i).alias("shown"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), _none(kind).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["out"])

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(
        F.split(text, pattern, -1), lambda parts: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found, lambda values: walk(found, parts, values)
        ),
    ))
    return F.when(text.rlike(pattern), every).otherwise(_none(kind))


def found_in(text: Column) -> dict[str, Column]:
    """Matches of the fixed patterns by kind, and all candidates for the models."""
    text = F.coalesce(text, F.lit(""))
    return {
        "assign": F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= 6),
        "access": matches(text, ACCESS), "hex": matches(text, HEX), "run": matches(text, RUN),
    }


def _class_at(value: Column, at: Column) -> Column:
    return F.instr(F.lit(ALPHABET), F.substring(value, at, F.lit(1)))


def pairs(value: Column) -> Column:
    """The numbers of the character pairs of a string."""
    last = F.greatest(F.length(value) - 1, F.lit(0))
    each = F.transform(F.sequence(F.lit(1), last), lambda i: _class_at(value, i) * CLASSES + _class_at(value, i + 1))
    return F.when(F.length(value) >= 2, each).otherwise(_none("int"))


def pair_counts(values: DataFrame, column: str) -> list[float]:
    """How often each pair occurs in a column of strings; a table of fixed size.  Equal strings are counted before they are taken apart."""
    strings = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("times"))
    counted = strings.select(F.explode(pairs(F.col("value"))).alias("pair"), "times").groupBy("pair").agg(F.sum("times").alias("n"))
    out = [0.0] * CLASSES**2
    for row in counted.collect():
        out[row["pair"]] = float(row["n"])
    return out


def ratios(random: list[float], ordinary: list[float], prior: float = 2.0) -> list[float]:
    """log P(next | character) of the random model less that of the ordinary one, with a uniform prior for both."""
    out = []
    for a in range(CLASSES):
        of = [counts[a * CLASSES : (a + 1) * CLASSES] for counts in (random, ordinary)]
        sums = [sum(x) + prior * CLASSES for x in of]
        out += [math.log((r + prior) / sums[0]) - math.log((o + prior) / sums[1]) for r, o in zip(*of, strict=True)]
    return out


def mean_ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per pair of a string of two characters or more."""
    numbers = F.expr(f"array({', '.join(f'{x:.6f}D' for x in table)})")
    total = F.aggregate(pairs(value), F.lit(0.0), lambda acc, p: acc + F.get(numbers, p))
    return total / F.greatest(F.length(value) - 1, F.lit(1))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def _as_spans(found: Column, kind: str) -> Column:
    order = F.lit(KINDS.index(kind))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), order.alias("kind"), m["end"].alias("end")))


def ordinary_words(docs: DataFrame, text: str) -> DataFrame:
    """(word): words of six characters or more, without a digit, of all documents."""
    return docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("[A-Za-z+/_=-]{6,}+(?![0-9])"), F.lit(0))).alias("word"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: key, ``n_assign``, ``n_access``, ``n_hex``, ``n_markov``, ``base_sha256``, ``spans``.

    The patterns run once; what they find is written out, teaches the model of random strings, and its candidates are
    scored.  A candidate which overlaps a fixed span is no finding of its own.  Null and empty texts have no spans; repeated rows
    are judged each; with nothing to learn from, both models are uniform and nothing is added; an empty table gives an empty
    one; other columns are not read.
    """
    place = Written(docs.sparkSession)
    found = place.table(docs.select(F.col(f"`{key}`").alias("id"), *[c.alias(k) for k, c in found_in(F.col(f"`{text}`")).items()]), "found")
    learnt = found.select(F.explode(F.concat("assign", "access", "hex")).alias("m")).select(F.col("m.value").alias("value")).where(
        F.col("value").rlike("[0-9]") & (F.length("value") >= 16)
    )
    table = ratios(pair_counts(learnt, "value"), pair_counts(ordinary_words(docs, text), "word"))
    base = F.concat(*[_as_spans(F.col(k), k) for k in KINDS[:3]])
    rows = found.select("*", F.explode(F.array(base)).alias("base"))
    free = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    random = F.filter("run", lambda m: free(m) & (mean_ratio(m["value"], table) >= threshold))
    rows = rows.select("*", F.explode(F.array(random)).alias("markov"))
    size = lambda name: F.size(name).cast("bigint")
    return rows.select(
        F.col("id").alias(key), *[size(k).alias(f"n_{k}") for k in KINDS], F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat(F.col("base"), _as_spans(F.col("markov"), "markov"))).alias("spans"),
    )
