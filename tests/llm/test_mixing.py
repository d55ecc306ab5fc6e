import numpy as np
import pytest
from pyspark.sql import functions as F

from khata.llm import mixing

DOMAIN = "concat('q', quality, 't', toxic)"


def mass_of(spark, rows):
    return spark.createDataFrame([([float(x) for x in p], int(n)) for p, n in rows], "p array<double>, tokens bigint")


def test_rates_meet_the_targets_and_are_optimal(spark):
    rnd = np.random.default_rng(2)
    p = rnd.dirichlet([0.2, 0.2, 0.2], 300)
    n = rnd.integers(10, 2000, 300)
    total = n.sum()
    targets = [0.6 * total, 0.3 * total, 0.1 * total]
    rates = mixing.fit_rates(mass_of(spark, zip(p, n)), targets, close=1e-3, steps=40)
    df = mass_of(spark, zip(p, n)).withColumn("w", rates.of(F.col("p")))
    w = np.array([r["w"] for r in df.collect()])
    expected = (w * n) @ p
    assert expected == pytest.approx(targets, rel=5e-3) and (w >= 0).all()
    assert rates.expected == pytest.approx(list(expected), rel=5e-3)
    # The plain projected gradient, many small steps, in the same metric.
    share, x = n @ p / total, np.ones(300)
    for _ in range(5000):
        slope = p @ (((x * n) @ p - targets) / total / share) + 1e-4 * (x - 1)
        x = np.maximum(0, x - 0.9 * slope)
    assert w == pytest.approx(x, abs=0.05)


def test_unreachable_and_empty_targets(spark):
    # No document of the second domain: it is left out, the first one still meets its target.
    rates = mixing.fit_rates(mass_of(spark, [((1.0, 0.0), 100)]), [50.0, 50.0])
    assert rates.expected[0] == pytest.approx(50, rel=0.01)
    zero = mixing.fit_rates(mass_of(spark, [((1.0, 0.0), 100), ((0.0, 1.0), 100)]), [100.0, 0.0])
    assert zero.expected == pytest.approx([100, 0], abs=0.2)
    assert mixing.fit_rates(mass_of(spark, []), [1.0, 2.0]).history == []


def test_posteriors_on_rows_which_were_not_learnt(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    learnt, held = labels.where("doc_id % 3 = 0"), labels.where("doc_id % 3 = 1")
    model = mixing.train(docs, learnt, DOMAIN)
    rows = docs.join(held, "doc_id").select(F.expr(DOMAIN).alias("domain"), mixing.posteriors(docs, model).alias("both")).collect()
    right = [model.domains[int(np.argmax(r["both"]["p"]))] == r["domain"] for r in rows]
    clean = [x for x, r in zip(right, rows) if r["domain"] == "q1t0"]
    assert sum(right) / len(right) > 0.85 and sum(clean) / len(clean) > 0.97  # three quarters are of one domain
    assert all(sum(r["both"]["p"]) == pytest.approx(1) for r in rows)


def test_copies_follow_the_rate(spark):
    df = spark.range(20000).select("id", mixing.copies(F.lit(1.3), F.col("id"), 7).alias("c"), mixing.copies(F.lit(0.0), F.col("id"), 7).alias("z"))
    row = df.agg(F.avg("c"), F.min("c"), F.max("c"), F.max("z")).first()
    assert row[0] == pytest.approx(1.3, abs=0.02) and tuple(row)[1:] == (1, 2, 0)


def test_tables(spark):
    docs = spark.createDataFrame([(1, "good words here", 5), (1, "good words here", 5), (2, None, 6), (3, "", 7), (None, "more words", 8)], "doc_id bigint, text string, tokens int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    scored, rates, domains = mixing.mixed_documents(docs, labels, DOMAIN, {"q1t0": 2.0})
    assert domains == ("q0t0", "q1t0") and scored.count() == 5
    taken = mixing.take_copies(docs, scored)
    assert taken.columns == docs.columns
    for labelled, table in ((labels, docs.limit(0)), (labels.limit(0), docs)):
        scored, _, _ = mixing.mixed_documents(table, labelled, DOMAIN, {"q1t0": 1.0})
        assert scored.count() == table.count()
        assert mixing.take_copies(table, scored).count() == table.count()
