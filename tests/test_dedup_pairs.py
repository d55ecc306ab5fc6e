"""Order-dependent operators against a plain scan on small inputs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from khata.operators import dedup, pairs

TXN = "inbox_id string, sms_id bigint, sms_date_ms bigint, amount decimal(18,2), fingerprint string, soft_keys array<string>"


def scan(rows, known=()):
    """What a newest-first scan accepts."""
    seen = {inbox: set(keys) for inbox, keys in known}
    kept = set()
    for inbox, sms_id, _ms, _amount, fp, soft in sorted(rows, key=lambda r: (-r[2], r[1])):
        taken = seen.setdefault(inbox, set())
        keys = {fp, *soft}
        if not taken & keys:
            taken |= keys
            kept.add((inbox, sms_id))
    return kept


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        amount, bucket, token = rng.choice([100, 200]), rng.randrange(12), rng.choice(["a", "b", ""])
        fp = f"r:{rng.randrange(n)}:{amount}" if rng.random() < 0.6 else f"h:debit:{amount}:{bucket // 6}:{rng.randrange(2)}"
        soft = [f"debit:{amount}:{b}:{token}" for b in (bucket, bucket - 1)] if token else [f"nomerchant:{i}"]
        rows.append((rng.choice(["u", "v"]), i, rng.randrange(40), amount, fp, soft))
    return rows


def ids(df):
    return {(r.inbox_id, r.sms_id) for r in df.select("inbox_id", "sms_id").collect()}


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, float(d), e, f) for a, b, c, d, e, f in rows],
                                 TXN.replace("decimal(18,2)", "double")).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def test_dedup_equals_scan(spark):
    for seed in (1, 2):
        rows = random_rows(seed, 150)
        assert ids(dedup.dedup(frame(spark, rows).repartition(3))) == scan(rows)


def test_dedup_does_not_depend_on_rounds(spark):
    rows = random_rows(3, 150)
    assert ids(dedup.dedup(frame(spark, rows), rounds=1)) == scan(rows)


def test_dedup_of_a_long_chain(spark):
    """Consecutive buckets: every second report stays, however long the chain."""
    rows = [("u", i, i * 600_000, 50, f"r:{i}:50", [f"d:50:{i}:x", f"d:50:{i - 1}:x"]) for i in range(41)]
    got = ids(dedup.dedup(frame(spark, rows), rounds=2))
    assert got == scan(rows) == {("u", i) for i in range(0, 41, 2)}


def test_dedup_of_one_hot_payment(spark):
    """Thousands of copies are one node after the first aggregation."""
    rows = [("u", i, 1000 + i, 10, "r:SAME:10", ["d:10:5:x", "d:10:4:x"]) for i in range(3000)]
    df = frame(spark, rows)
    assert ids(dedup.dedup(df)) == {("u", 2999)}
    marked = dedup.mark_duplicates(df).groupBy("duplicate").count().collect()
    assert {r["duplicate"]: r["count"] for r in marked} == {True: 2999, False: 1}


def test_dedup_against_stored(spark):
    rows = random_rows(4, 120)
    old, new = rows[:60], rows[60:]
    stored = frame(spark, [r for r in old if (r[0], r[1]) in scan(old)])
    keys = {}
    for r in old:
        if (r[0], r[1]) in scan(old):
            keys.setdefault(r[0], set()).update([r[4], *r[5]])
    assert ids(dedup.dedup(frame(spark, new), stored)) == scan(new, keys.items())


def test_rows_without_soft_keys_do_not_meet(spark):
    stored = frame(spark, [("u", 1, 5, 10, "old", None)])
    rows = [("u", 2, 6, 10, "f2", ["nomerchant:2"]), ("u", 3, 7, 10, "f3", ["nomerchant:3"])]
    assert ids(dedup.dedup(frame(spark, rows), stored)) == {("u", 2), ("u", 3)}


LEDGER = ("inbox_id string, sms_id bigint, fingerprint string, kind string, amount double, account string, "
          "merchant string, merchant_quality string, date timestamp_ntz")


def greedy(rows):
    """Debits in order, each taking the first free income."""
    def order(r):
        return (r[8], r[1])

    ok = [r for r in rows if not r[6] or r[7] in ("phone", "opaque")]
    used, out = set(), set()
    for d in sorted((r for r in ok if r[3] == "expense"), key=order):
        for c in sorted((r for r in ok if r[3] == "income"), key=order):
            if (c[0], c[2]) in used or c[0] != d[0] or c[4] != d[4] or abs(c[8] - d[8]) > timedelta(days=1):
                continue
            if (c[5] or "?") != (d[5] or "?"):
                used.add((c[0], c[2]))
                out.add((d[0], d[2], c[2]))
                break
    return out


def ledger_frame(spark, rows):
    return spark.createDataFrame(rows, LEDGER).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def found(spark, rows):
    return {(r.inbox_id, r.debit, r.credit) for r in pairs.transfer_pairs(ledger_frame(spark, rows)).collect()}


def test_pairs_equal_greedy_over_many_blocks(spark):
    """Dense pairs over 40 days: the borders between blocks are crossed often."""
    for seed in (5, 6):
        rng = random.Random(seed)
        rows = [
            (rng.choice(["u", "v"]), i, f"f{i}", rng.choice(["expense", "income", "refund"]), float(rng.choice([5, 7])),
             rng.choice(["1", "2", "3", None]), rng.choice([None, None, "", "9876543210"]), "phone",
             datetime(2026, 8, 1) + timedelta(minutes=rng.randrange(40 * 1440)))
            for i in range(220)
        ]
        assert found(spark, rows) == greedy(rows)


def test_pairs_when_a_run_never_breaks(spark):
    """One account pays the other every few hours for weeks."""
    start = datetime(2026, 1, 1)
    rows = [("u", i, f"f{i}", "expense" if i % 3 else "income", 100.0, "1" if i % 3 else "2", None, None,
             start + timedelta(hours=5 * i)) for i in range(200)]
    assert found(spark, rows) == greedy(rows)


def test_pairs_of_the_documented_cases(spark):
    day = datetime(2026, 8, 14)
    rows = [
        ("u", 1, "a", "expense", 5000.0, "1234", None, None, day),
        ("u", 2, "b", "income", 5000.0, "5678", None, None, day + timedelta(hours=1)),
        ("u", 3, "c", "expense", 7868.0, "1234", "Rajdhani Rice Depot", "named", day),
        ("u", 4, "d", "income", 85000.0, "1234", "ACME TECH", "named", day),
        ("u", 5, "e", "expense", 499.0, "1234", "MYNTRA", "named", day),
        ("u", 6, "f", "income", 499.0, "1234", "MYNTRA", "named", day + timedelta(hours=2)),
        ("u", 7, "g", "expense", 300.0, "1234", None, None, day),
        ("u", 8, "h", "income", 300.0, "1234", None, None, day + timedelta(hours=1)),
        ("u", 9, "i", "expense", 301.0, "1234", None, None, day),
        ("u", 10, "j", "income", 301.0, "5678", None, None, day + timedelta(days=7)),
        ("u", 11, "k", "expense", 302.0, "1234", None, None, day),
        ("u", 12, "l", "income", 302.0, "5678", None, None, day + timedelta(days=1)),
    ]
    assert found(spark, rows) == {("u", "a", "b"), ("u", "k", "l")}


def test_only_changed_blocks_are_served_again(spark):
    """Two weeks shifted by one odd debit run on from block to block; other inboxes are done after two passes."""
    start = datetime(2026, 1, 1)

    def year(inbox, odd):
        rows = [(inbox, -1, "odd", "expense", 100.0, "1", None, None, start + timedelta(hours=1))] if odd else []
        for i in range(16):
            at = start + timedelta(hours=2 + (20 if odd else 30) * i)
            rows += [(inbox, 2 * i, f"d{i}", "expense", 100.0, "1", None, None, at), (inbox, 2 * i + 1, f"c{i}", "income", 100.0, "2", None, None, at + timedelta(minutes=30))]
        return rows

    rows = [*year("shifted", True), *[r for n in range(3) for r in year(f"calm{n}", False)]]
    assert found(spark, rows) == greedy(rows)
    blocks = pairs._blocks(pairs._candidates(ledger_frame(spark, rows)))
    _, again = pairs._settled(blocks)
    passes = {r["inbox_id"]: r["last"] for r in again.groupBy("inbox_id").agg(F.max("pass").alias("last")).collect()}
    assert passes["shifted"] > 2 and all(passes.get(f"calm{n}", 0) <= 1 for n in range(3))


def test_newest_versions(spark):
    rows = [("u", 1, "a", 5, "x"), ("u", 1, "b", 7, "x"), ("u", 1, "c", 7, None), ("u", 2, None, None, None), ("u", 2, None, None, None), (None, 1, "a", 1, "x")]
    df = spark.createDataFrame(rows, "inbox_id string, id bigint, body string, date_ms bigint, address string")
    assert sorted(map(str, dedup.drop_repeated_messages(df).collect())) == sorted(map(str, spark.createDataFrame([rows[2], rows[3], rows[5]], df.schema).collect()))
