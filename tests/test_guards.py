"""A guard must be true wherever its rule is: texts are put together from the rules' own words and their neighbours."""

import random
import re

from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions import text as text_columns
from khata.functions.text import has, has_any
from khata.operators import extract, inbox, privacy
from khata.operators.extract import FLAGS, WORDS, says, words_in

PATTERNS = [*[p for _, p in V.REJECT_FIRST + V.REJECT_UNLESS_REFUND], V.INTERNAL, *V.SPAM, *V.BILL, V.TRAVEL, V.DELIVERY, V.APPOINTMENT, *V.SERVICE, *V.PROMOTION]


def worded(rng, pattern):
    """A text which may well meet a pattern: one choice of each alternative, optional parts in or out."""
    text = re.sub(r"\(\?[=!]\^?|\(\?:", "(", pattern).replace("\\b", "").replace("^", "").replace("$", "")
    while True:
        inner = re.search(r"\(([^()]*)\)(\?)?", text)
        if not inner:
            break
        chosen = rng.choice(inner.group(1).split("|")) if not inner.group(2) or rng.random() < 0.5 else ""
        text = text[: inner.start()] + chosen + text[inner.end() :]
    text = rng.choice(text.split("|"))
    text = re.sub(r"\[\^?[^\]]*\]\??\+?\*?", lambda m: rng.choice(["", " ", "-", "12"]), text)
    text = re.sub(r"\.\{0,\d+\}|\.\*", lambda m: rng.choice(["", " of ", "x", " 5 "]), text)
    text = re.sub(r"\\s[*+]?\??", lambda m: rng.choice([" ", " ", ""]), text)
    text = re.sub(r"\\d\+?|\\w[*+]?", "7", text)
    return re.sub(r"(\w| )\?", lambda m: rng.choice([m.group(1), ""]), text).replace("\\", "")


def test_guards_are_necessary(spark):
    rng = random.Random(11)
    texts = [rng.choice(["", "Rs.5 ", "x", "1"]) + worded(rng, p) + rng.choice(["", " now", "s", ".", "7"]) for p in PATTERNS for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))], "_masked string").withColumn(WORDS, words_in(F.col("_masked")))
    text = F.col("_masked")
    rules = [has(text, p, FLAGS) for _, p in V.REJECT_FIRST] + [has(text, p, FLAGS) for _, p in V.REJECT_UNLESS_REFUND]
    guards = extract._reject_guards() + extract._late_guards()
    rules += [has(text, V.INTERNAL, FLAGS), *[has_any(text, getattr(V, n), FLAGS) for n in ("SPAM", "BILL", "SERVICE", "PROMOTION")]]
    guards += [extract._says_internal(), *[says(*getattr(inbox, f"{n}_WORDS")) for n in ("SPAM", "BILL", "SERVICE", "PROMOTION")]]
    rules += [has(text, getattr(V, n), FLAGS) for n in ("TRAVEL", "DELIVERY", "APPOINTMENT")]
    guards += [says(*getattr(inbox, f"{n}_WORDS")) for n in ("TRAVEL", "DELIVERY", "APPOINTMENT")]
    sums = df.agg(
        *[F.count_if(r).alias(f"r{i}") for i, r in enumerate(rules)], *[F.count_if(r & ~g).alias(f"m{i}") for i, (r, g) in enumerate(zip(rules, guards))]).first()
    missed = [i for i in range(len(rules)) if sums[f"m{i}"]]
    assert not missed, [(i, [r[0] for r in df.where(rules[i] & ~guards[i]).select("_masked").limit(5).collect()]) for i in missed]
    assert sum(sums[f"r{i}"] > 0 for i in range(len(rules))) == len(rules), sums


def test_passes_of_redaction_see_all_their_hits(spark):
    """The cheap conditions of a pass hold wherever its pattern does."""
    rng = random.Random(5)
    steps = [*privacy.passes("s", 1), *privacy.passes("s", 1, rules="offline", blank_dates=True)]
    texts = sorted({rng.choice(["", "a ", "7 "]) + worded(rng, s.pattern) + rng.choice(["", " x", ",", " 12345678"]) for s in steps for _ in range(60)})
    texts += ["k@post.org", "KQXPT5678Z", "2468 1357 9753", "UNIO0ABC777", "91 9000080000", "044 - 27001122", "XXXXXX7711", "http://k.example/x", "go.example.in", "09/04/24", "9 Apr 24", "Apr 9, 2024", "7:45", "Mr Ilva Kerron", "A B KERRON"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn(privacy.RUN, privacy.longest_run(F.col("t")))
    text = F.col("t")
    sums = df.agg(*[F.count_if(has(text, s.pattern, s.flags) & ~s.found(text)).alias(f"m{i}") for i, s in enumerate(steps)]).first()
    assert not [steps[i].pattern for i in range(len(steps)) if sums[f"m{i}"]]


def test_put_in_cuts_at_marks(spark):
    """Hits side by side, groups which don't take part, and texts which have the marks themselves."""
    texts = ["a1b2", "12", "", "none", f"x{text_columns.HIT}1{text_columns.GROUP}2", "7b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = text_columns.put_in(F.col("t"), "([0-9])(b)?", lambda hit, n, b: F.concat(F.lit("<"), n, F.upper(b), F.length(hit).cast("string"), F.lit(">")), 2, "")
    assert [r[0] for r in df.select(made).collect()] == [
        "a<1B2><21>", "<11><21>", "", "none", f"x{text_columns.HIT}<11>{text_columns.GROUP}<21>", "<7B2>", None]


def test_needs_are_necessary(spark):
    """Each pass finds its sample through its cheaper part, too."""
    samples = ["a.b@c-d.in", "ABCDE1234F", "1234 5678-9012", "XXXX12", "12.50 rs", "5,INR", "Jan 5, 2024", "jan 12 2024"]
    steps = [s for rules in ("session", "offline") for s in privacy.passes("s", 1, rules) if s.needs]
    assert len(steps) >= 8
    df = spark.createDataFrame([(t,) for t in samples], "t string")
    for step in steps:
        seen = df.select(text_columns.has(F.col("t"), step.pattern, step.flags).alias("full"), text_columns.has(F.col("t"), step.needs, step.flags).alias("part")).collect()
        assert any(r["full"] for r in seen) and all(r["part"] for r in seen if r["full"]), step
