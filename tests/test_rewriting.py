"""Redaction by one function for a text: the same hits as the columns' patterns, cheap conditions which lose nothing, a short plan."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from khata.functions.plain import compiled
from khata.functions.text import hits
from khata.operators import privacy

WORDS = ["Rs.450", "a/c", "acct no.", "XX1234", "*5261", "é", "to", "To", "from", "store7@ybl", "9000080000@paytm", "05-08-25", "31/02/2024",
         "29-02-2024", "9 APR 2024", "09April24", "Oct 31, 2023", "on", "Ref", "512345678901", "ABCDE1234F", "ACME", "A B  KERRON", "Mr Ram,",
         "Dear Ilva Kerron,", "received by Ilva K on", "credited by GREEN MILLS.", "payment of Rs 5 to Ilva Kerron,", "T&Cs.", "OTP is 4506",
         "4506 is your OTP", "HDFC0001234", "x.co/tok", "http://a.b/c?d", "u.v@w.in", "XXXX*7711", "+91 9000081234", "044 - 27001122",
         "18004250000", "send NO to 56789", "2468 1357 9753", "UIDAI: 246813579753", "1" * 20, "₹ 1,23,456.78", "500 rs", "7:45:10", "IHL_ABC123",
         "txn id: AB_12@x", " ", " ", "\r\n", "\r", "\x85", "K", "ſ", "٤", "\x01", "Kerron,\n", "\nIlva Kerron ,\n", "Ilvask,\r\n"]


def mixtures(count):
    rng = random.Random(13)
    return ["".join(rng.choice(WORDS) + rng.choice(["", " ", " ", "_", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(count)]


def test_both_engines_find_the_same(spark):
    texts = mixtures(400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    steps = list({(s.pattern, s.flags): s for rules in ("session", "offline") for s in privacy.passes("s", 1, rules)}.values())
    rows = df.select("i", *[hits(F.col("t"), s.pattern, s.flags).alias(f"h{n}") for n, s in enumerate(steps)]).collect()
    seen = 0
    for n, step in enumerate(steps):
        for row in rows:
            found = [m[0] for m in compiled(step.pattern, step.flags).finditer(texts[row.i])]
            assert found == row[f"h{n}"], (step.pattern, texts[row.i])
            seen += len(found)
    assert seen > 1500


def test_conditions_lose_nothing():
    for rules in ("session", "offline"):
        steps = privacy.passes("s", 77, rules)
        quick = privacy.rewriter(steps)
        whole = privacy.rewriter([replace(s, digits=0, holds=(), needs="", lengthens=True) for s in steps])
        assert [quick(t) for t in mixtures(3000)] == [whole(t) for t in mixtures(3000)]


def test_plan_does_not_grow_with_the_passes(spark):
    """A projection for each pass copied every row forty times; here a text leaves its row once."""
    df = spark.createDataFrame([("u", "Rs.5 paid")], "inbox_id string, body string")
    plan = privacy.redact(df, "body", "salt", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") < 8 and plan.count("ArrowEvalPython") == 1, plan


def test_dates_beyond_four_digits_and_bytes_without_hits(spark):
    df = spark.createDataFrame([("on 31/12/9999",), ("on 01/03/0100",), ("on 29-02-23",), (None,)], "t string")
    done = privacy.redact(df, "t", "salt", 1)
    assert [r.t for r in done.collect()] == ["on 01/01/10000", "on 02/03/100", "on 29-02-23", ""]
    assert [r.replaced for r in done.collect()] == [{"date": 1}, {"date": 1}, {"date": 1}, {}]
    odd = spark.sql("SELECT CAST(X'61FF62' AS STRING) AS t")
    assert privacy.redact(odd, "t", "salt", 1).select(F.hex("t")).first()[0] == "61FF62"
