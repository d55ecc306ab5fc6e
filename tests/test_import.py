"""Inbox, bills, whole import, re-import, re-scan, learning, files and streaming."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from khata.operators import bills, inbox, ingest, model, reports
from khata.functions.clock import period
from khata.sources import readers, writers
from khata.streaming.identities import Identities, cover
from khata.streaming.ingest import (
    current_ledger, finish_rescan, merge_batch, rescan_batch, rescan_counters, start_ingest, stored_counters, stored_ledger,
)

TZ = "UTC"
TABS = [
    ("Sent Rs.219.00\nFrom Union Bank Acct *7711\nTo Tram Kiosk\nOn 14/02/24\nRef 700800900100", "transactions"),
    ("Rs.52,500.00 credited to A/c XX7711 on 30-04-24 by NEFT from GREEN MILLS. Ref M7008", "transactions"),
    ("Statement generated for Union Credit Card 3434. Due date: 08/MAR/2024. Total due: Rs.2100. Min due: Rs.105.", "bills"),
    ("For your Union Credit Card, a bill of Rs.2,100 is due on 18-Mar-24. Minimum due Rs.105.", "bills"),
    ("Your Blue Broadband connection stops tonight, the payment is overdue since 02-Feb-24.", "bills"),
    ("Rs.64 will be debited on 19-Mar-24 for your newspaper", "bills"),
    ("Kotak: 778812 is the OTP to approve Rs.60.10 at the toll plaza.", "updates"),
    ("Parcel 70080011 was delivered to the front desk.", "updates"),
    ("Coach B7, seat no 12, departure 07:45 from platform 3.", "updates"),
    ("Beneficiary Lata was registered today.", "updates"),
    ("A pre-approved card upgrade waits for you. T&C", "promotions"),
    ("70 payback points were added for your book order.", "promotions"),
    ("Last chance: shoes from Rs 80. Order now.", "promotions"),
    ("Work from home and earn a fine salary, write to wa.me/910000011111", "spam"),
    ("Your ticket won the jackpot of Rs 9,00,000.", "spam"),
    (("See you at the station at six", "+919000080000", 1), "personal"),
]


def test_tabs(messages_of):
    rows = inbox.classify_inbox(messages_of([b for b, _ in TABS]), TZ).orderBy("id").collect()
    assert [r.tab for r in rows] == [t for _, t in TABS]
    assert [r.id for r in rows if r.sensitive] == [7]


BILLS = [
    ("Statement generated for Union Credit Card 3434. Due date: 08/MAR/2024. Total due: Rs.2100. Min due: Rs.105.",
     (2100, 105, "2024-03-08", "credit-card", False)),
    ("For your Union Credit Card, a bill of Rs.4,410 is due on 18-Mar-24. Minimum due Rs.105.",
     (4410, 105, "2024-03-18", "credit-card", False)),
    ("Your May dues on XX8080: Total Due Rs.815. Due date 11/03/2024.", (815, None, "2024-03-11", "other", False)),
    ("Your Union Credit Card XX3434 payment is overdue. Pay Rs.715 today", (715, None, None, "credit-card", True)),
    ("Again: for your Union Credit Card, a bill of Rs.4,410 due on 18-Mar-24.", (4410, None, "2024-03-18", "credit-card", False)),
]


def test_bills(messages_of):
    df = bills.extract_bills(messages_of([b for b, _ in BILLS] + ["Last chance: order now"]))
    rows = df.orderBy("sms_id").collect()
    got = [(int(r.amount), r.minimum_due and int(r.minimum_due), r.due_date and r.due_date.isoformat(), r.kind, r.overdue) for r in rows]
    assert got == [w for _, w in BILLS]
    assert all(r.issuer == "HDFC" for r in rows)
    assert rows[1].fingerprint == rows[4].fingerprint
    latest = bills.latest_bills(df)
    assert latest.count() == 4
    due = bills.bills_due(latest, datetime(2024, 3, 10)).first()
    assert (due.due_count, due.overdue_count) == (1, 2)


def simulated():
    """Forty days of payments with copies, noise and traps."""
    base = datetime(2024, 2, 1, tzinfo=timezone.utc)
    names = ["bakery@okaxis", "grocer@ybl", "cabs@axl", "TOYWORLD", "news@upi", "SONGS", "QUARRY TRADERS"]
    out = []

    def add(day, seconds, body, address="AX-HDFCBK"):
        out.append((body, address, int((base + timedelta(days=day, seconds=seconds)).timestamp() * 1000)))

    for d in range(40):
        day = (base + timedelta(days=d)).strftime("%d-%m-24")
        who, amount, ref = names[d % 7], 60 + d * 23, f"KEY{700800 + d}"
        add(d, 0, f"Rs.{amount}.00 debited from A/c XX7711 on {day} to VPA {who}. Ref {ref}", "HDFCBK")
        if d % 5 == 0:
            add(d, 60, f"Rs {amount}.00 spent on Union Card x7711 at {who} on {day}. Ref {ref}", "HDFCBK")
        if d % 4 == 0:
            add(d, 120, f"{7000 + d} is the OTP to approve Rs.{amount}.00", "VM-HDFCBK")
        if d % 7 == 0:
            add(d, 180, f"Closing balance of a/c XX7711 is Rs.8,008.80, {day}.", "VM-HDFCBK")
    add(2, 0, "Rs.52,500.00 credited to A/c XX7711 on 03-02-24 by NEFT from GREEN MILLS. Ref M70080")
    add(10, 0, "Rs.4,410.00 debited from A/c XX7711 on 11-02-24, RBL Credit Card bill. Ref CB7008")
    add(12, 0, "Rs.640.00 credited to A/c XX7711 on 13-02-24. Refund from SHOE BAZAR Ref SB7008")
    add(13, 0, "Rs.81 at the bakery was declined, incorrect PIN.")
    add(14, 0, "A hold amount of Rs.700 was set at the petrol pump")
    add(3, 40, "Paid Rs.129.00 to TOYWORLD with GPay UPI on 04-02-24", "JM-PAYTM")
    return out


@pytest.fixture(scope="module")
def imported(messages_of):
    messages = messages_of(simulated()).cache()
    return messages, ingest.ingest(messages, TZ).cache()


def test_import(imported):
    messages, ledger = imported
    kinds = {r.kind: (r.n, float(r.s)) for r in ledger.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("s")).collect()}
    assert kinds["expense"] == (40, float(sum(60 + d * 23 for d in range(40))))
    assert kinds["income"] == (1, 52500.0)
    assert kinds["transfer"][0] == 1 and kinds["refund"][0] == 1
    assert ledger.select("fingerprint").distinct().count() == ledger.count()
    assert ledger.where("amount = 129").count() == 1
    c = ingest.ingest_counters(messages, TZ).first()
    assert c.scanned == messages.count() == c.parsed + c.rejected and c.parsed == c.duplicates + c.written


def test_second_import_writes_nothing(imported):
    messages, ledger = imported
    assert ingest.ingest(messages, TZ, ledger).count() == 0


def test_rescan_keeps_user_decisions(imported):
    messages, ledger = imported
    stale = F.col("ref") == "KEY700801"
    by_hand = F.col("ref") == "KEY700802"
    stored = ledger.withColumns({
        "kind": F.when(stale, "income").when(by_hand, "transfer").otherwise(F.col("kind")),
        "merchant": F.when(stale, "WRONG").otherwise(F.col("merchant")),
        "category": F.when(by_hand, "education").otherwise(F.col("category")),
        "category_source": F.when(by_hand, "user").otherwise(F.col("category_source")),
        "kind_source": F.when(by_hand, "user").otherwise(F.col("kind_source")),
        "reviewed": by_hand,
    })
    after = ingest.reprocess(messages, TZ, stored).cache()
    assert after.where("change = 'added'").count() == 0
    fixed = after.where(stale).first()
    assert (fixed.kind, fixed.merchant, fixed.change) == ("expense", "grocer", "updated")
    kept = after.where(by_hand).first()
    assert (kept.kind, kept.category, kept.category_source) == ("transfer", "education", "user")


def test_summary_of_the_import(imported):
    _, ledger = imported
    row = reports.period_summary(ledger, period("all", datetime(2024, 4, 1))).first()
    pending = ledger.where("needs_review AND NOT reviewed AND kind = 'expense'").agg(F.sum("amount")).first()[0] or 0
    assert row.gross == sum(60 + d * 23 for d in range(40)) - pending
    assert row.refunded == 640 and row.received == 52500


TRAIN = """groceries: Green Valley Rice Mart, Green Valley Rice Mart, Corner Supermarket, Farm Basket Daily, Lake Supermarket, Hill Supermarket, Brook Supermarket, Orchard Fresh
transport: Tramline, Tramline Bike, City Cabs, Moon Cabs, Moon Auto, City Trip, Tramline Cab, Harbour Rail
entertainment: River Songs, Quartz Films India, Starhall, Echo Songs India, Prime Hall Films, Sunny Films, Showdesk, Zeta Films
health: Lotus Pharmacy, Cedar Drug Store, Willow Care, Lotus Clinic, Cedar Drug Pharmacy, Maple Pharmacy Order"""


def test_classifier(spark):
    rows = [("u", m.strip(), c) for line in TRAIN.splitlines() for c, ms in [line.split(": ")] for m in ms.split(",")]

    def table(data):
        return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "inbox_id string, merchant string, category string, sms_id bigint").withColumns(
            {"sender": F.lit("AX-HDFCBK"), "bank": F.lit("HDFC"), "channel": F.lit("upi"), "direction": F.lit("debit"),
             "amount": F.lit(300).cast("decimal(18,2)")})

    labelled = table(rows)
    nb = model.nb_train(labelled)
    new = table([("u", "Green Valley Rice Mart Branch 2", None), ("u", "Tramline Auto", None), ("u", "QXQX Nowhere Known", None)])
    got = {r.sms_id: r for r in model.nb_predict(nb, new, why=True).collect()}
    assert got[0].category == "groceries" and got[0].why
    assert got[1].category == "transport"
    assert 2 not in got or got[2].margin >= 2
    loo = model.nb_leave_one_out(labelled).first()
    assert loo.n == 30 and loo.accuracy >= 0.9 and loo.coverage >= 0.5
    few = table(rows[:5])
    assert model.nb_predict(model.nb_train(few), new).count() == 0
    assert model.nb_leave_one_out(few).first().n == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><smses><sms address="AX-HDFCBK" body="Rs.5 paid &amp; done" date="17"/><sms address="B" body="x" date="18"/></smses>')
    (tmp_path / "a.csv").write_text('From, Message ,Timestamp\nAX-HDFCBK,"two\nlines, ""quoted""",17\n,x,\n')
    (tmp_path / "a.jsonl").write_text('{"address": "A", "body": "b", "date": 17}\n\n{broken\n{"address": "C", "body": "d", "date": 18}\n')
    (tmp_path / "a.txt").write_text("AX-HDFCBK :: first\nsecond\n\n\nVM-ICICIT\nbody here\n\nno sender\nmore\n")

    def rows(name):
        return sorted((r.address, r.body, r.date_ms) for r in readers.read_corpus(spark, str(tmp_path / name)).collect())

    assert rows("a.xml") == [("AX-HDFCBK", "Rs.5 paid & done", 17), ("B", "x", 18)]
    assert rows("a.csv") == [("", "x", 0), ("AX-HDFCBK", 'two\nlines, "quoted"', 17)]
    assert rows("a.jsonl") == [("A", "b", 17), ("C", "d", 18)]
    assert rows("a.txt") == [("", "no sender\nmore", 0), ("AX-HDFCBK", "first\nsecond", 0), ("VM-ICICIT", "body here", 0)]
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_corpus(spark, "x.pdf")


def test_writers(spark, imported, tmp_path):
    _, ledger = imported
    odd = ledger.withColumn("merchant", F.lit('a "b", c\nd'))
    writers.export_csv(odd, str(tmp_path / "csv"), TZ)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns[0] == "date" and len(back.columns) == 14 and back.count() == ledger.count()
    assert back.select("merchant").distinct().first()[0] == 'a "b", c\nd'
    writers.export_json(ledger, ledger.limit(1), str(tmp_path / "json"))
    assert readers.read_ledger_json(spark, str(tmp_path / "json/transactions"), ledger.schema).count() == ledger.count()
    writers.write_ledger(ledger, str(tmp_path / "ledger"))
    stored = readers.read_ledger(spark, str(tmp_path / "ledger"))
    assert stored.count() == ledger.count()
    assert [r.month for r in stored.select("month").distinct().orderBy("month").collect()] == ["2024-02", "2024-03"]


def test_stream_repeats_and_resumes(spark, messages_of, imported, tmp_path):
    _, ledger = imported
    src, out, progress = (str(tmp_path / n) for n in ("in", "ledger", "progress"))
    messages = messages_of(simulated())
    newest_first = messages.orderBy(F.desc("date_ms"))
    newest_first.limit(40).coalesce(1).write.parquet(src)
    start_ingest(spark, src, out, progress, TZ).awaitTermination()
    first = stored_ledger(spark, out).count()
    messages.join(newest_first.limit(40).select("id"), "id", "left_anti").select(*messages.columns).coalesce(1).write.mode("append").parquet(src)
    start_ingest(spark, src, out, progress, TZ).awaitTermination()
    after = stored_ledger(spark, out)
    assert 0 < first < after.count()
    want = {r.fingerprint for r in ledger.collect()}
    assert {r.fingerprint for r in after.collect()} == want
    # the last batch delivered once more, and everything as a new batch: nothing is added
    last = after.agg(F.max("batch")).first()[0]
    merge_batch(messages, last, out, TZ)
    merge_batch(messages, last + 1, out, TZ)
    assert {r.fingerprint for r in stored_ledger(spark, out).collect()} == want
    assert stored_ledger(spark, out).count() == len(want)


def test_runs_cover_all_batches_once():
    for fan in (2, 3, 8):
        for batch in range(0, 200):
            held = [b for level, first in cover(batch, fan) for b in range(first, first + fan**level)]
            assert held == list(range(batch))
            assert len(cover(batch, fan)) <= (fan - 1) * max(1, len(str(batch)) * 7)


def test_merged_runs_are_read_by_bucket(spark, tmp_path):
    index = Identities(spark, str(tmp_path / "index"), fan=2, buckets=16)
    rows = spark.range(40).selectExpr(
        "CAST(id % 20 AS STRING) AS inbox_id", "CAST(id AS DECIMAL(18,2)) AS amount", "concat('r:', id) AS fingerprint", "array(concat('s', id)) AS soft_keys")
    for batch in range(5):
        index.add(batch, rows.where(f"CAST(amount AS INT) % 5 = {batch}"))
        index.add(batch, rows.where(f"CAST(amount AS INT) % 5 = {batch}"))  # delivered twice
    assert index.batches() == 5 and cover(5, 2) == [(2, 0), (0, 4)]
    asked = rows.where("fingerprint IN ('r:7', 'r:9', 'r:11')").selectExpr("inbox_id", "amount", "'new' AS fingerprint")
    found = index.before(5, asked)
    assert sorted(r.fingerprint for r in found.collect()) == ["r:11", "r:7", "r:9"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan, plan
    assert sorted(r.fingerprint for r in index.before(4, asked).collect()) == ["r:11", "r:7"]
    assert index.before(0, asked).count() == 0


def test_stream_of_many_batches_equals_one_scan_by_batch(spark, messages_of, tmp_path):
    """Batches overlap, one is delivered again after others, and runs are merged in between."""
    out = str(tmp_path / "ledger")
    messages = messages_of(simulated()).withColumn("part", F.pmod(F.hash("id"), F.lit(4)))
    held: set[tuple] = set()
    parts = [messages.where(F.col("part").isin(i, (i + 1) % 4)).drop("part") for i in range(4)]
    for i, part in enumerate(parts):
        merge_batch(part, i, out, TZ, fan=2)
        before = stored_ledger(spark, out, i)
        want = ingest.ingest(part, TZ, before).select("fingerprint").collect()
        got = stored_ledger(spark, out).where(F.col("batch") == i).select("fingerprint").collect()
        assert sorted(got) == sorted(want)
        if i == 2:
            merge_batch(part, i, out, TZ, fan=2)
            assert sorted(stored_ledger(spark, out).where(F.col("batch") == i).select("fingerprint").collect()) == sorted(want)
        held |= {r.fingerprint for r in got}
    assert stored_ledger(spark, out).count() == len(held)
    sums = stored_counters(spark, out).first()
    assert sums["written"] == len(held) and sums["scanned"] == sum(p.count() for p in parts)
    assert sums["scanned"] == sums["rejected"] + sums["duplicates"] + sums["written"] and sums["updated"] == 0


def test_rescan_makes_generations(spark, messages_of, tmp_path):
    out = str(tmp_path / "ledger")
    messages = messages_of(simulated())
    old, rest = messages.where("id % 3 <> 0"), messages.where("id % 3 = 0")
    merge_batch(old, 0, out, TZ)
    stale = stored_ledger(spark, out).withColumn("merchant", F.when(F.col("sms_id") % 2 == 0, "WRONG").otherwise(F.col("merchant")))
    stale.drop("batch").write.parquet(str(tmp_path / "stale"))
    spark.read.parquet(str(tmp_path / "stale")).write.mode("overwrite").parquet(f"{out}/batch=0")
    prior = current_ledger(spark, out)
    assert finish_rescan(spark, out) is None
    for turn in range(2):  # the second delivery changes nothing
        rescan_batch(old, 0, out, TZ)
        rescan_batch(messages, 1, out, TZ)
    done = finish_rescan(spark, out)
    want = ingest.reprocess(messages, TZ, prior)
    shown = ["fingerprint", "merchant", "kind", "category", "change"]
    assert sorted(map(tuple, done.select(*shown).collect())) == sorted(map(tuple, want.select(*shown).collect()))
    changes = {r["change"]: r["count"] for r in done.groupBy("change").count().collect()}
    sums = rescan_counters(spark, out, 1).first()
    assert sums["updated"] == changes["updated"] > 0 and sums["written"] == changes.get("added", 0)
    # the import goes on after it: what the re-scan added is known, new messages come on top
    merge_batch(rest, 1, out, TZ)
    assert current_ledger(spark, out).count() == done.count()
    assert finish_rescan(spark, out) is None
