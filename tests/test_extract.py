"""Extraction over literal messages: rejects, fields, dates, identity."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions.money import bank_of, brand_of, is_financial, looks_personal, merchant_key, sender_id
from khata.operators import extract
from khata.operators.categories import rule_decision

TZ = "Asia/Kolkata"

REJECTED = {
    "Kotak: 778812 is the OTP to approve Rs.60.10 at the toll plaza.": "otp",
    "Your verification code for the locker is 9911; Rs 70 was paid.": "otp",
    "Monsoon discount: pay Rs.80 less on shoes and bags.": "promo",
    "Limited period! Rs 90 debited fee waived for new cards.": "promo",
    "Transfer of Rs.33.00 debited from Union A/c 7711 will be reversed tonight.": "returned",
    "Meera has requested money: Rs.41 to be paid for the picnic.": "request",
    "Gas invoice of Rs.715 for the month of May.": "no-direction",
    "Rs.64 will be debited on 19-Mar-24 for your newspaper.": "reminder",
    "Closing balance of a/c 7711 is Rs.8,008.80.": "balance",
    "Credit limit of your Federal card is now Rs.77,000.": "limit",
    "Available limit Rs.6,100 left on card 3434 after the upgrade.": "limit",
    "A hold amount of Rs.700 was set at the petrol pump": "hold",
    "Rs.2,100 is blocked for your rental car": "hold",
    "Rs.-61 debited from A/c 7711": "no-amount",
    "deducted 61": "no-amount",
    "Rs.12 shall be credited to A/c 7711 once the parcel is back": None,
    "": "empty",
    " \n ": "empty",
    "₹ ₹": "no-direction",
    "Autopay for the gym is registered with Union Bank, Rs.640 a month": "mandate",
    "Your mandate of Rs.640 for the gym was revoked.": "mandate",
    "Beneficiary Lata has been activated; you can now move Rs 10.": "payee",
    "Vinod was added by you as a payee, limit Rs 900.": "payee",
    "Txn of Rs 81 was declined on RBL card 3434: incorrect PIN.": "failed",
    "Purchase declined, Rs.81 at the bakery, card 3434.": "failed",
    "Your transfer of Rs 818 to the landlord has been unsuccessful.": "returned",
    "Cheque for Rs.7,007 was returned on 04-06-24, fee Rs.59 charged": "returned",
    "Your cheque book was dispatched, Rs.20 postage paid.": "status",
    "Services will be unavailable on Sunday night. Rs.0 is charged for it.": "notice",
    "Beware of callers who ask you to send Rs.5 to keep a card active.": "notice",
    "You received a voucher of Rs.150 from the book club.": "notice",
    "Collect request of Rs.950 from Sunil, paid only when you agree.": "request",
    "Please maintain Rs.3,000 to avoid a fee; Rs.90 was charged in May.": "balance",
}

PARSED = [
    ("Rs.318.40 debited from A/c XX7711 on 09-04-24 to VPA bakery@okaxis. Ref 700800900100. Help: 18004250000",
     dict(direction="debit", amount=318.4, account="7711", merchant="bakery", channel="upi", ref="700800900100",
          kind="expense", needs_review=False)),
    ("Union Acct XX771 debited for Rs 77.00 on 09-Apr-24; BOOK CORNER credited. UPI:700800900101.",
     dict(direction="debit", amount=77, account="771", merchant="BOOK CORNER", channel="upi")),
    ("Account X7711 debited by 64.5 dated 09Apr24 trf to TEA HOUSE Refno 700800900102",
     dict(direction="debit", amount=64.5, merchant="TEA HOUSE", ref="700800900102")),
    ("INR 912.00 debited, A/c no. XX7711, 09-04-24, UPI/P2M/700800903/TEA HOUSE",
     dict(direction="debit", amount=912, account="7711", channel="upi")),
    ("Rs 1,805 spent on Federal Card x3434 at TOY WORLD on 09-04-24. Avl bal Rs 6,020",
     dict(amount=1805, account="3434", merchant="TOY WORLD", channel="card", balance=6020)),
    ("Rs.3,21,654.87 debited from A/c XX7711 on 09-04-24 to VPA mason@ybl. Ref 700800904", dict(amount=321654.87)),
    ("Rs.52,500.00 credited to A/c XX7711 on 30-Apr-24 by NEFT from GREEN MILLS. Ref M70080090",
     dict(direction="credit", amount=52500, account="7711", kind="income")),
    ("Rs.1500 withdrawn at ATM from A/c XX7711 on 09-04-24. Closing bal Rs.8,800", dict(amount=1500, channel="atm")),
    ("Rs.640.00 credited to A/c XX7711 on 09-Apr-24. Refund from SHOE BAZAR. Ref SB700800",
     dict(direction="credit", amount=640, merchant="SHOE BAZAR", kind="refund")),
    ("₹88 debited from Acct XX8080 on 09/04/2024 to grocer@ybl UPI Ref 700800905", dict(amount=88, account="8080")),
    ("Acct XX7711 debited 61.25 INR on 09-Apr-24 towards CITY CABS. RRN 700800906", dict(amount=61.25)),
    ("Rs.61debited from A/c XX7711 on 09-04-24", dict(amount=61, direction="debit")),
    ("Spent Rs. 43 on Card 3434. Credit Limit: Rs. 9,000, Total Due: Rs. 2,100", dict(amount=43)),
    ("Rs.4,410.00 debited from A/c XX7711 on 09-04-24, RBL Credit Card bill. Ref 700907",
     dict(kind="transfer", category="transfer", category_source="rule")),
    ("Rs.700 debited from A/c XX7711 as self transfer, 09-04-24", dict(kind="transfer")),
    ("Rs.350 debited from A/c XX7711 for PhonePe wallet topup on 09-04-24", dict(kind="transfer")),
    ("Rs.71 credited to A/c XX7711 on 10-04-24: chargeback of Ref 700908", dict(kind="refund")),
    ("Rs.405 spent on Card x3434 at PAYU*TOYS4U on 09-04-24", dict(merchant="TOYS4U")),
    ("Rs.29 debited from A/c XX7711 to VPA q700800900@ybl on 09-04-24",
     dict(merchant_quality="opaque", needs_review=True)),
    ("Rs.65 debited from A/c XX7711 to VPA 9000080000@ybl on 09-04-24",
     dict(merchant_quality="phone", merchant="9000080000", ambiguous_p2p=True, needs_review=True)),
    ("EUR 7.50 spent on Card x3434 at SONGS.EU on 09-04-24",
     dict(currency="EUR", amount=0, foreign_amount=7.5, needs_review=True)),
    ("Rs.360 deducted", dict(confidence_pct=40, needs_review=True, merchant=None)),
    ("Sent Rs.219.00\nFrom Union Bank Acct *7711\nTo Mrs Ilva Kerron Daru\nOn 14/02/24\nRef 700800910", dict(amount=219)),
    ("Sent Rs.18.00\nFrom Union Bank Acct x7711\nTo Tram Kiosk\nOn 14/02/24\nRef 70091", dict(amount=18, merchant="Tram Kiosk")),
    ("Autopay:\nSent Rs.640.00\nfrom Union Bank Acct 7711\nTo River Gym\n14/02/24\nRef 7092", dict(merchant="River Gym")),
    ("Done: processed payment of INR 275.00 to Merchant Farm Basket, the fourth order of the family plan, on 14/02/2024",
     dict(merchant="Farm Basket", amount=275)),
    ("Order 70080093: Rs. 52.00 done for PRINT SHOP AND PAPER... has gone through", dict(amount=52)),
    ("A fee of Rs.29.50 + tax charged to your Union Bank Acct X7711. Balance Rs.1204.10",
     dict(amount=29.5)),
    ("Thank you, payment of INR 9,120.40 towards RBL Credit Card XX3434 by Auto Debit on 14-Feb-24",
     dict(kind="transfer", amount=9120.4)),
    ("FASTag 70080094 recharged with Rs.400.00", dict(kind="transfer")),
    ("Rs.810.00 credited to A/c XX8080 by transfer from A/c XX7711", dict(kind="transfer")),
]

DATES = [
    ("Sent Rs.18 To Tram Kiosk On 14/02/24 Ref 7", "2024-02-14"),
    ("Rs.61 debited from A/c XX7711 on 09-04-24 to VPA k@ybl", "2024-04-09"),
    ("payment of INR 9,120.40 towards RBL card on 11-Nov-23", "2023-11-11"),
    ("Rs.61 debited on 17/JUN/2022 card XX3434", "2022-06-17"),
    ("Account X7711 debited by 64.5 dated 09Apr24 trf to TEA HOUSE", "2024-04-09"),
    ("deducted Rs. 15.00 on Oct 31, 2023 at noon", "2023-10-31"),
    ("Rs.61 debited on May 05 2022 to VPA k@ybl", "2022-05-05"),
    ("Rs.61 debited on 2022-12-30 to VPA k@ybl", "2022-12-30"),
    ("debited 30-02-23", "2023-03-02"),
    ("on 77/77/77", None),
    ("some day soon", None),
]


@pytest.fixture(scope="module")
def reasons(messages_of):
    rows = extract.parse_messages(messages_of(list(REJECTED)), TZ).select("id", "reason").collect()
    return {list(REJECTED)[r.id - 1]: r.reason for r in rows}


def test_rejects_with_reason(reasons):
    wrong = {b: (reasons[b], want) for b, want in REJECTED.items() if want is not None and reasons[b] != want}
    assert not wrong


def test_noise_is_expected(reasons):
    odd = {"empty", "no-amount", "no-direction", None}
    assert all(r in V.EXPECTED_NOISE for r in reasons.values() if r not in odd)


def test_fields(messages_of):
    rows = extract.extract_transactions(messages_of([b for b, _ in PARSED]), TZ).collect()
    by_id = {r.sms_id: r for r in rows}
    assert len(by_id) == len(PARSED)
    wrong = []
    for i, (body, want) in enumerate(PARSED, 1):
        for field, value in want.items():
            got = by_id[i][field]
            got = float(got) if hasattr(got, "as_tuple") else got
            if got != value:
                wrong.append((body[:50], field, got, value))
    assert not wrong


def test_future_refund_is_no_refund(messages_of):
    rows = extract.extract_transactions(
        messages_of(["Rs.12 shall be credited to A/c 7711 once the parcel is back, refund 70080095"]), TZ).collect()
    assert all(r.kind != "refund" for r in rows)


def test_dates(messages_of):
    df = messages_of([b for b, _ in DATES]).select("id", extract.stated_date(F.col("body")).alias("d"))
    got = {r.id: r.d.isoformat() if r.d else None for r in df.collect()}
    assert [got[i] for i in range(1, len(DATES) + 1)] == [d for _, d in DATES]


def test_local_time_of_a_message_without_date(messages_of):
    ms = 1754341200000  # 4 August 2025, 21:00 UTC
    row = extract.extract_transactions(messages_of([("Rs.200 debited", "AX-HDFCBK", ms)]), TZ).first()
    assert row.date == datetime(2025, 8, 5, 2, 30)
    assert row.date_ms == ms
    assert row.fingerprint == "h:debit:200:2025-8-5:?"


def test_stated_date_is_local_midnight(messages_of):
    row = extract.extract_transactions(messages_of(["Rs.200 debited on 05-08-25"]), TZ).first()
    assert row.date == datetime(2025, 8, 5)
    assert row.date_ms == 1754332200000


def test_shared_identity(messages_of):
    rows = extract.extract_transactions(messages_of([
        "Rs.77.00 debited from A/c XX7711 on 09-04-24 to VPA bakery@okaxis. Ref 700800900100",
        "Rs 77.00 spent on Union Card x7711 at BAKERY on 09-04-24. Ref 700800900100",
        "Paid Rs.77 to Bakery with GPay UPI on 09-04-24",
        "Rs.78 debited from A/c XX7711 on 09-04-24 to VPA bakery@okaxis",
        "Rs.77 credited to A/c XX7711 on 09-04-24 from bakery@okaxis",
    ]), TZ).orderBy("sms_id").collect()
    assert rows[0].fingerprint == rows[1].fingerprint
    assert set(rows[0].soft_keys) & set(rows[2].soft_keys)
    assert not set(rows[0].soft_keys) & set(rows[3].soft_keys)
    assert rows[4].fingerprint != rows[0].fingerprint


def test_amount_forms(messages_of):
    cases = {
        "Rs.654,321.09 deducted": 654321.09, "Rs 61 deducted": 61, "debited by 61.5": 61.5,
        "INR 2,00,00,000.00 deposited": 20000000, "₹7.07 paid": 7.07, "not a figure": None,
        "Rs.1500 withdrawn": 1500, "Rs.52500 deposited": 52500, "Rs 7654321.01 deposited": 7654321.01,
        "Rs.0.00 paid": None, "Rs 61/- paid": 61, "Rs. 2,00,000.00 paid": 200000,
        "Rs.-61 paid": None, "−61 INR paid": None, "Rs.-61 debited by 16": 16,
    }
    df = messages_of(list(cases)).select("id", extract.amount_of(F.col("body")).cast("double").alias("a"))
    got = {list(cases)[r.id - 1]: r.a for r in df.collect()}
    assert got == cases


def test_word_boundaries_are_ascii(messages_of):
    rows = extract.parse_messages(messages_of(["Café Rs.200é debited to a/c XX1234", "Rs.200 édebitedé x"]), TZ)
    got = {r.id: (r.reason, r.t_direction) for r in rows.collect()}
    assert got[1] == (None, "debit")
    assert got[2] == (None, "debit")


def test_senders(spark):
    df = spark.createDataFrame(
        [("AX-HDFCBK",), ("VM-HDFCBK-T",), ("JD-ICICIT-S",), ("AD-MYNTRA",), ("AD-EPFOHO",), ("+919876543210",), ("",), (None,)],
        "a string")
    sid = sender_id(F.col("a"))
    rows = df.select("a", sid.alias("s"), bank_of(sid).alias("b"), brand_of(sid).alias("m"), is_financial(sid).alias("f")).collect()
    got = {r.a: (r.s, r.b, r.m, r.f) for r in rows}
    assert got["AX-HDFCBK"] == ("HDFCBK", "HDFC", None, True)
    assert got["VM-HDFCBK-T"][1] == "HDFC"
    assert got["JD-ICICIT-S"][1] == "ICICI"
    assert got["AD-MYNTRA"] == ("MYNTRA", None, "myntra", False)
    assert got["AD-EPFOHO"][2] == "epfo"
    assert got["+919876543210"][2] is None
    assert got[""] == ("", None, None, False)


def test_rules_and_names(spark):
    cases = [
        ("Corner Pizza", "debit", "food", "rule"), ("City Parking", "debit", "transport", "rule"),
        ("broadband plan", "debit", "bills", "rule"), ("groww app", "debit", "investment", "rule"),
        ("Lake View Clinic", "debit", "health", "rule"), ("itunes songs", "debit", "entertainment", "rule"),
        ("QUARRY TRADERS", "debit", None, None), (None, "credit", "income", "rule"), (None, "debit", None, None),
        ("ILVA KERRON DARU", "debit", "transfer", "guess"),
        ("ILVA KERRON DARU", "credit", None, None),
        ("PRINT WORKS SERVICES", "debit", None, None),
    ]
    df = spark.createDataFrame(cases, "m string, d string, c string, s string")
    rows = df.select("*", rule_decision(F.col("m"), F.col("d")).alias("r")).collect()
    assert [(r.r.category, r.r.source) if r.r else (None, None) for r in rows] == [(c, s) for _, _, c, s in cases]
    names = spark.createDataFrame([("Union Bank",), ("HILLTOP Z09",), ("Ilva Daru",)], "m string")
    assert [r.p for r in names.select(looks_personal(F.col("m")).alias("p")).collect()] == [False, False, True]
    keys = spark.createDataFrame([("  TEA-House_07 ",), (None,)], "m string").select(merchant_key(F.col("m")).alias("k"))
    assert [r.k for r in keys.collect()] == ["teahouse07", ""]


def test_the_session_zone_does_not_matter(spark, messages_of):
    """An hour which the session zone skips is an hour like any other."""
    rows = [("Rs.200 debited", "AX-HDFCBK", 1710037800000), ("Rs.200 debited on 10-03-24", "AX-HDFCBK", 1710037800000)]

    def read():
        txns = extract.extract_transactions(messages_of(rows), "UTC").orderBy("sms_id")
        return [(r.d, r.date_ms, r.fingerprint) for r in txns.select(F.col("date").cast("string").alias("d"), "date_ms", "fingerprint").collect()]

    before = read()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert read() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before[0][0] == "2024-03-10 02:30:00" and before[1][1] == 1710028800000
