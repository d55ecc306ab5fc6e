"""Queries over messages of many forms: every reject rule, currency and date format, sender and handle occurs.

The forms are sentences with places for the values of an event.  Spark reads the sentences; the SQL says from the values what must come out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.operators import extract, ingest, templates
from khata.plans import views
from khata.plans.message_queries import TZ
from khata.plans.registry import query
from khata.plans.sql_views import PARTS


@dataclass(frozen=True)
class Form:
    """A sentence, its sender and what it says, as SQL; a form with a ``reason`` is no transaction."""

    text: str
    sender: str
    reason: str | None = None
    kind: str = "expense"
    merchant: str | None = None
    quality: str | None = "named"
    channel: str = "other"
    account: bool = True
    ref: bool = True
    dated: bool = True
    shows_date: bool = True
    balance: str | None = None
    currency: str = "INR"
    bank: str | None = None


def _no(text: str, sender: str, reason: str) -> Form:
    return Form(text, sender, reason)


FORMS = [
    # formats of amounts and days, merchants and channels
    Form("Rs.{amt} debited from A/c XX{acc} on {num} to VPA shop{k}@ybl. Ref {ref}", "AX-HDFCBK", merchant="'shop' || k", channel="upi", bank="HDFC"),
    Form("INR {amt} credited to A/c XX{acc} on {slash} by NEFT from MILL {k}. Ref {ref}", "VM-ICICIB", kind="income", merchant="'MILL ' || k", channel="neft", bank="ICICI"),
    Form("Spent {amt} Rs on Card x{acc} at TOYS {k} on {mon}. Avl bal 512.25", "JD-SBIINB", merchant="'TOYS ' || k", channel="card", ref=False, balance="512.25", bank="SBI"),
    Form("Account X{acc} debited by {amt} on {lead} trf to STALL {k} Refno {ref}", "BP-AXISBK", merchant="'STALL ' || k", ref=True, bank="Axis"),
    Form("Account X{acc} credited by {amt} on {iso} from DEPOT {k}. RRN {ref}", "AD-KOTAKB", kind="income", merchant="'DEPOT ' || k", bank="Kotak"),
    Form("Sent Rs.{amt}\nFrom Union Bank Acct *{acc}\nTo KIOSK {k}\nOn {slash}\nRef {ref}", "AX-UNIONB", merchant="'KIOSK ' || k", bank="Union"),
    Form("Withdrawn ₹{amt}, A/c XX{acc}, ATM, {num}. Closing balance is Rs.77.5", "AX-PNBSMS", merchant=None, quality=None, channel="atm", ref=False, balance="77.5", bank="PNB"),
    # handles which are no names
    Form("Rs.{amt} debited from A/c XX{acc} on {num} to VPA {phone}@ybl. Ref {ref}", "AX-YESBNK", merchant="phone", quality="phone", channel="upi", bank="Yes"),
    Form("Rs.{amt} debited from A/c XX{acc} on {num} to VPA q{phone}@axl. Ref {ref}", "AX-RBLBNK", merchant="'q' || phone", quality="opaque", channel="upi", bank="RBL"),
    # another currency; a brand known from its sender; no day, or one that can't be read
    Form("USD {amt} spent on Card x{acc} at SONGS {k} on {num}", "AX-CITIBK", merchant="'SONGS ' || k", channel="card", ref=False, currency="USD", bank="Citi"),
    Form("Rs.{amt} paid on {num}. Ref {ref}", "AD-MYNTRA", merchant="'myntra'", quality="sender", account=False),
    Form("Charged: Rs.{amt}. Ref {ref}", "AD-SWIGGY", merchant="'swiggy'", quality="sender", account=False, dated=False, shows_date=False),
    Form("Rs.{amt} debited from A/c XX{acc} on 45-45-45. Ref {ref}", "AX-HDFCBK", merchant=None, quality=None, dated=False, bank="HDFC"),
    # a refund is no failed payment, own movements are no spending
    Form("Rs.{amt} credited to A/c XX{acc} on {num}: refund, booking {k} failed. Ref {ref}", "AX-HDFCBK", kind="refund", merchant=None, quality=None, bank="HDFC"),
    Form("Rs.{amt} debited from A/c XX{acc} on {num}, RBL Credit Card bill. Ref {ref}", "AX-HDFCBK", kind="transfer", merchant=None, quality=None, channel="card", bank="HDFC"),
    # one for every reason
    _no("{acc} is the OTP to send Rs.{amt}", "AX-HDFCBK", "otp"),
    _no("Discount: shoes for Rs.{amt} paid by card", "AD-SHOESS", "promo"),
    _no("Available balance of a/c XX{acc} is Rs.{amt}", "AX-HDFCBK", "balance"),
    _no("Credit limit of card {acc} is now Rs.{amt}", "AX-HDFCBK", "limit"),
    _no("A hold amount of Rs.{amt} was set, {ref}", "AX-HDFCBK", "hold"),
    _no("Standing instruction {k} of Rs.{amt} was created", "AX-HDFCBK", "emandate"),
    _no("Autopay {k} of Rs.{amt} is revoked", "AX-HDFCBK", "mandate"),
    _no("Beneficiary {k} was activated, send Rs.{amt}", "AX-HDFCBK", "payee"),
    _no("You received a voucher of Rs.{amt}", "AX-HDFCBK", "notice"),
    _no("Card {acc} was dispatched, Rs.{amt} paid", "AX-HDFCBK", "status"),
    _no("Collect request of Rs.{amt} from P{k}, paid if you agree", "AX-HDFCBK", "request"),
    _no("Cheque {k} for Rs.{amt} was returned on {num}, fee charged", "AX-HDFCBK", "returned"),
    _no("Purchase declined, Rs.{amt} at TOYS {k}, card {acc}", "AX-HDFCBK", "failed"),
    _no("Rs.{amt} debited for plan {k}: could not be processed", "AX-HDFCBK", "failed"),
    _no("Rs.{amt} will be debited on {mon} for plan {k}", "AX-HDFCBK", "reminder"),
    _no("Gas invoice {k} of Rs.{amt}", "AX-HDFCBK", "no-direction"),
    _no("Rs.-{amt} debited from A/c XX{acc}", "AX-HDFCBK", "no-amount"),
]
ASKED = "CAST(id % {n} AS INT)".format(n=len(FORMS))


def _joined(text: str) -> str:
    """A sentence as a concatenation of texts and columns."""
    parts = re.split(r"\{(\w+)\}", text)
    return " || ".join(part if i % 2 else "'" + part + "'" for i, part in enumerate(parts) if part)


def _by_form(values: list[str | None]) -> str:
    """A value for each form: a CASE which leaves out nulls."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
    return f"CASE {ASKED} {cases} END"


def _text(value: str | None) -> str | None:
    return None if value is None else f"'{value}'"


def messages_of_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a message, in turn of all forms, from many senders."""
    rows = views.table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "CAST(user_id AS STRING) AS inbox_id", "CAST(regexp_extract(props, '([0-9]+)', 1) AS STRING) AS k",
        "CAST(CAST(value AS DECIMAL(18,2)) + 1 AS STRING) AS amt", "CAST(1000 + event_id % 4 AS STRING) AS acc",
        "concat('EVT', lpad(CAST(event_id AS STRING), 9, '0')) AS ref", "concat('9', lpad(CAST(event_id AS STRING), 9, '0')) AS phone",
        "date_format(ts, 'dd-MM-yy') AS num", "date_format(ts, 'dd/MM/yyyy') AS slash", "date_format(ts, 'dd-MMM-yy') AS mon",
        "date_format(ts, 'MMM dd, yyyy') AS lead", "date_format(ts, 'yyyy-MM-dd') AS iso",
        "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT) * 1000 AS date_ms",
    )
    body = _by_form([_joined(f.text) for f in FORMS])
    address = _by_form([_text(f.sender) for f in FORMS])
    return rows.selectExpr("inbox_id", "id", f"{body} AS body", "date_ms", f"{address} AS address")


SAID = f"""{PARTS}, said AS (
    SELECT * REPLACE (CAST(k AS VARCHAR) AS k, amount + 1 AS amount, CAST(amount + 1 AS VARCHAR) AS amt),
      '9' || lpad(CAST(id AS VARCHAR), 9, '0') AS phone FROM parts),
  told AS (
    SELECT inbox_id, id, date_ms, due, ref, amount, acc, {_by_form([_text(f.reason) for f in FORMS])} AS reason,
      {_by_form([_text(f.kind) for f in FORMS])} AS kind, {_by_form([f.merchant for f in FORMS])} AS merchant,
      {_by_form([_text(f.quality) for f in FORMS])} AS quality, {_by_form([_text(f.channel) for f in FORMS])} AS channel,
      {_by_form(["TRUE" if f.account else "FALSE" for f in FORMS])} AS has_account,
      {_by_form(["TRUE" if f.ref else "FALSE" for f in FORMS])} AS has_ref,
      {_by_form(["TRUE" if f.dated else "FALSE" for f in FORMS])} AS dated,
      {_by_form(["TRUE" if f.shows_date else "FALSE" for f in FORMS])} AS shows_date,
      {_by_form([f.balance and f"CAST({f.balance} AS DOUBLE)" for f in FORMS])} AS balance,
      {_by_form([_text(f.currency) for f in FORMS])} AS currency, {_by_form([_text(f.bank) for f in FORMS])} AS bank FROM said),
  ledger_rows AS (
    SELECT *, greatest(0, least(100, 40 + CASE WHEN merchant IS NULL THEN 0 ELSE 25 END + CASE WHEN has_ref THEN 15 ELSE 0 END
        + CASE WHEN has_account THEN 10 ELSE 0 END + CASE WHEN shows_date THEN 10 ELSE 0 END + CASE WHEN channel = 'other' THEN 0 ELSE 5 END)
      - CASE WHEN quality = 'sender' THEN 5 WHEN quality IN ('phone', 'opaque') THEN 25 ELSE 0 END
      - CASE WHEN currency = 'INR' THEN 0 ELSE 30 END) AS pct,
      CASE WHEN kind IN ('income', 'refund') THEN 'credit' ELSE 'debit' END AS direction FROM told WHERE reason IS NULL)"""

BODIES = f"""{PARTS}, shown AS (
    SELECT inbox_id, id, CAST(k AS VARCHAR) AS k, CAST(amount + 1 AS VARCHAR) AS amt, acc, ref, '9' || lpad(CAST(id AS VARCHAR), 9, '0') AS phone,
      strftime(ts, '%d-%m-%y') AS num, strftime(ts, '%d/%m/%Y') AS slash, strftime(ts, '%d-%b-%y') AS mon,
      strftime(ts, '%b %d, %Y') AS lead, strftime(ts, '%Y-%m-%d') AS iso, date_ms FROM parts),
  bodies AS (SELECT inbox_id, id, {_by_form([_text(f.sender) for f in FORMS])} AS address, {_by_form([_joined(f.text) for f in FORMS])} AS body, date_ms FROM shown)"""


@query("reject_forms", f"WITH {SAID} SELECT inbox_id, id, reason FROM told WHERE reason IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Why each message which is no transaction was left out."""
    return extract.parse_messages(messages_of_forms(spark, sf), TZ).where("reason IS NOT NULL").select("inbox_id", "id", "reason")


@query("extract_forms", f"""WITH {SAID}
    SELECT inbox_id, id AS sms_id, direction, kind, CASE WHEN currency = 'INR' THEN CAST(amount AS DOUBLE) ELSE 0 END AS amount, currency,
      CASE WHEN currency <> 'INR' THEN CAST(amount AS DOUBLE) END AS foreign_amount, CASE WHEN currency <> 'INR' THEN currency END AS foreign_currency,
      CASE WHEN has_account THEN acc END AS account, merchant, quality AS merchant_quality, CASE WHEN has_ref THEN ref END AS ref, channel,
      CASE WHEN dated THEN CAST(epoch_ms(due) AS BIGINT) ELSE date_ms END AS date_ms, balance, bank, CAST(pct AS BIGINT) AS confidence_pct,
      pct < 60 OR currency <> 'INR' OR coalesce(quality IN ('phone', 'opaque'), FALSE) AS needs_review,
      coalesce(quality = 'phone', FALSE) AS ambiguous_p2p FROM ledger_rows""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of the transactions among messages of all forms."""
    return extract.extract_transactions(messages_of_forms(spark, sf), TZ).select(
        "inbox_id", "sms_id", "direction", "kind", "amount", "currency", "foreign_amount", "foreign_currency", "account", "merchant",
        "merchant_quality", "ref", "channel", "date_ms", "balance", "bank", "confidence_pct", "needs_review", "ambiguous_p2p",
    )


@query("audit_dates_of_forms", f"""WITH {SAID} SELECT count(*) AS transactions,
      count(*) FILTER (NOT dated OR date_ms = epoch_ms(due)) AS arrival_dated,
      count(*) FILTER (shows_date AND (NOT dated OR date_ms = epoch_ms(due))) AS date_ignored FROM ledger_rows""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return templates.audit_dates(extract.parse_messages(messages_of_forms(spark, sf), TZ))


@query("ignored_dates", f"WITH {SAID} SELECT inbox_id, id, '45-45-45' AS claimed FROM ledger_rows WHERE shows_date AND NOT dated")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions whose text has a day which the parser could not read."""
    rows = templates.ignored_dates(extract.parse_messages(messages_of_forms(spark, sf), TZ))
    return rows.where("claimed = '45-45-45'").select("inbox_id", "id", "claimed")


@query("overlapping_pages", f"""WITH {SAID}, copies AS (
      SELECT inbox_id, id, date_ms, 0 AS page FROM told UNION ALL SELECT inbox_id, id, date_ms + 1000, 1 FROM told WHERE id % 3 = 0
      UNION ALL SELECT inbox_id, id, date_ms, 2 FROM told WHERE id % 5 = 0)
    SELECT inbox_id, id, max(date_ms) AS date_ms, arg_max('page ' || page, (date_ms, 'page ' || page)) AS body FROM copies GROUP BY 1, 2""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Messages which several pages of a scan have, some in other versions: the newest one stays."""
    messages = messages_of_forms(spark, sf)
    first = messages.withColumn("body", F.lit("page 0"))
    second = messages.where("id % 3 = 0").withColumns({"body": F.lit("page 1"), "date_ms": F.col("date_ms") + 1000})
    third = messages.where("id % 5 = 0").withColumn("body", F.lit("page 2"))
    return ingest.drop_repeated_messages(first.unionByName(second).unionByName(third)).select("inbox_id", "id", "date_ms", "body")
