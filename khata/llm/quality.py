"""Weak supervision of text quality.

Every rule votes good (1), bad (-1) or abstains (0).  A document's votes are a pattern, and there are at most
3 ** rules patterns, so the table of patterns with their counts is all that expectation-maximisation needs.  The
model has the share of good documents and, for every rule, the chances of its votes on good and on bad documents, which
give its accuracies.  The posterior probability of "good" takes the place of a chain of filters.
Everything is a DataFrame expression; only the handful of fitted numbers is on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.common import NOT_SPACE, Written, free_name, let, words_of

#: Symbols which running text hardly has.
SYMBOLS = "[#*$%&|<>]+"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")


def _covered(starts: Column, width: int) -> Column:
    """How many places the windows of ``width`` cover which begin at the sorted places ``starts``."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    return F.aggregate(
        starts, zero,
        lambda acc, p: F.struct(
            (acc["total"] + p + width - F.greatest(p, acc["end"])).alias("total"), (p + width).alias("end")
        ),
        lambda acc: acc["total"],
    )


def repeated_words(words: Column) -> Column:
    """Words in windows of three which the text has at least twice, the first one included."""

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda p, i: (F.get(s, i - 1)["h"] == p["h"]) | (F.get(s, i + 1)["h"] == p["h"])),
            lambda p: p["i"],
        )))

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _covered(places(hashes), 3)
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, of))


def text_features(text: Column) -> Column:
    """A struct of the counts in ``FEATURES`` (all bigint); a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeated"),
    ))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))

    def whole(w: Column, x: Column) -> Column:
        counts = {
            "n_words": w["n"], "word_chars": w["chars"], "n_symbols": _count(text, SYMBOLS), "n_dup_lines": x["dup"],
            "n_repeat_words": w["repeated"], "n_lines": x["n"], "n_upper": _count(text, "\\p{Lu}+"),
            "n_exclaims": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        }
        return F.struct(*[counts[name].cast("bigint").alias(name) for name in FEATURES])

    return let(of_words, lambda w: let(of_lines, lambda x: whole(w, x)))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, and abstains otherwise."""

    name: str
    bad: Column
    good: Column | None = None

    def vote(self) -> Column:
        bad = F.when(self.bad, -1)
        return (bad if self.good is None else bad.when(self.good, 1)).otherwise(0)


def rules(f: dict[str, Column]) -> tuple[Rule, ...]:
    """The rules, over columns named as in ``FEATURES``.  Being free of one defect is no merit, so most only vote bad."""
    words, chars = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["word_chars"], F.lit(1))
    symbols, shouts, capitals = f["n_symbols"] / words, f["n_exclaims"] / words, f["n_upper"] / chars
    repeats, size = f["n_repeat_words"] / words, f["word_chars"] / words
    return (
        Rule("symbols", symbols >= 0.15),
        Rule("capitals", capitals >= 0.4),
        Rule("shouting", shouts >= 0.2),
        Rule("repeats", repeats >= 0.35),
        Rule("lines", f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1)) >= 0.4),
        Rule("marks", (symbols + shouts) >= 0.3, (symbols + shouts) <= 0.02),
        Rule("case", capitals >= 0.5, (capitals >= 0.001) & (capitals <= 0.12)),
        Rule("variety", repeats >= 0.5, repeats <= 0.15),
        Rule("word_size", (size < 2) | (size > 14), (size >= 3) & (size <= 9)),
    )


#: Chances of a vote (bad, abstain, good) on good and on bad documents from which the fit starts.
START_GOOD, START_BAD = (0.01, 0.19, 0.8), (0.4, 0.3, 0.3)


@dataclass(frozen=True)
class Fit:
    """Share of good documents; per rule, the chances of the votes (bad, abstain, good) on good and on bad documents."""

    prior: float
    on_good: tuple[tuple[float, float, float], ...]
    on_bad: tuple[tuple[float, float, float], ...]

    def weights(self) -> list[float]:
        """Base log-odds, then for each rule the log-odds which each of its votes adds."""
        chances = zip(self.on_good, self.on_bad, strict=True)
        return [math.log(self.prior / (1 - self.prior)), *(math.log(g / b) for x, y in chances for g, b in zip(x, y, strict=True))]

    def accuracies(self) -> list[tuple[float, float]]:
        """Per rule, how often it is right on good and on bad documents where it doesn't abstain."""
        return [(g[2] / (g[0] + g[2]), b[0] / (b[0] + b[2])) for g, b in zip(self.on_good, self.on_bad, strict=True)]


def posterior(votes: list[Column], fit: Fit) -> Column:
    """Probability of "good", given the votes."""
    w = F.array(*[F.lit(x) for x in fit.weights()])
    odds = w[0]
    for j, vote in enumerate(votes):
        odds = odds + w[vote + (2 + 3 * j)]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_rules(patterns: DataFrame, votes: list[str], rounds: int = 30, weight: str = "n") -> Fit:
    """Expectation-maximisation over a table of vote patterns and their counts.

    A weak prior of ten documents at the start's chances keeps every chance inside (0, 1).  An empty table gives the start.
    """
    fit = Fit(0.8, (START_GOOD,) * len(votes), (START_BAD,) * len(votes))
    good, n = F.col("_good"), F.col(weight)
    sums = [F.sum(n).alias("all"), F.sum(n * good).alias("good")]
    for j, v in enumerate(votes):
        for k in (-1, 0, 1):
            sums += [F.sum(F.when(F.col(v) == k, n * part)).alias(f"{name}{j}_{k}") for name, part in (("g", good), ("b", 1 - good))]
    for _ in range(rounds):
        got = patterns.withColumn("_good", posterior([F.col(v) for v in votes], fit)).agg(*sums).first()
        if not got["all"]:
            break

        def chances(kind: str, of: float, start: tuple[float, ...], got=got) -> tuple:
            return tuple(
                tuple(((got[f"{kind}{j}_{k}"] or 0.0) + 10 * p) / (of + 10) for k, p in zip((-1, 0, 1), start, strict=True))
                for j in range(len(votes))
            )

        old, fit = fit, Fit(
            (got["good"] + 8) / (got["all"] + 10), chances("g", got["good"], START_GOOD),
            chances("b", got["all"] - got["good"], START_BAD),
        )
        if max(abs(x - y) for x, y in zip(old.weights(), fit.weights(), strict=True)) < 1e-6:
            break
    return fit


def featured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with one more column, a struct of the features; the features by name.

    A generator keeps the struct in one place: a projection above it would compute it again for each use.
    """
    name = free_name(docs, "_features")
    rows = docs.select("*", F.explode(F.array(text_features(F.col(f"`{text}`")))).alias(name))
    return rows, {f: F.col(f"`{name}`")[f] for f in FEATURES}


def fit_votes(rows: DataFrame, features: dict[str, Column], place: Written, rounds: int) -> Fit:
    """Counts the vote patterns of rows with features and fits the rules to them."""
    votes = [r.vote().alias(r.name) for r in rules(features)]
    names = [r.name for r in rules(features)]
    patterns = rows.select(*votes).groupBy(*names).agg(F.count("*").alias("n"))
    return fit_rules(place.table(patterns.coalesce(1), "patterns"), names, rounds)


def verdict(f: dict[str, Column], fit: Fit) -> dict[str, Column]:
    """``base_failed``, ``quality`` (posterior) and ``kept`` over features."""
    failed = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    good = posterior([r.vote() for r in rules(f)], fit)
    return {"base_failed": failed, "quality": good, "kept": ~failed & (good >= 0.5)}


def weak_quality(docs: DataFrame, keys: list[str], text: str = "text", rounds: int = 30) -> DataFrame:
    """Per row of ``docs``: ``keys``, the features, the votes, ``base_failed``, ``quality`` and ``kept``.

    Features go to a narrow written table, the patterns are counted from it, and it is scored with the fit.
    Null and empty texts have no words and fail the base rule; repeated rows are scored each; an empty table
    gives an empty one; columns other than ``keys`` and ``text`` are not read.
    """
    place = Written(docs.sparkSession)
    rows, f = featured(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, text])]), text)
    keyed = [F.col(f"`{k}`") for k in keys]
    table = place.table(rows.select(*keyed, *[c.alias(name) for name, c in f.items()]), "features")
    f = {name: F.col(name) for name in FEATURES}
    fit = fit_votes(table, f, place, rounds)
    return table.select(
        *keyed, *FEATURES, *[r.vote().alias(f"vote_{r.name}") for r in rules(f)],
        *[c.alias(name) for name, c in verdict(f, fit).items()],
    )


def good_documents(docs: DataFrame, text: str = "text", rounds: int = 30) -> DataFrame:
    """The rows of ``docs`` which are kept, all columns as they were.

    The texts are read twice, once for the pattern counts and once to filter, so that no text is shuffled or copied.
    """
    rows, f = featured(docs.select(F.col(f"`{text}`")), text)
    fit = fit_votes(rows, f, Written(docs.sparkSession), rounds)
    rows, f = featured(docs, text)
    return rows.filter(verdict(f, fit)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
