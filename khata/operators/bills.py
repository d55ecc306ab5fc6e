"""Obligations out of bill messages: amount, due date, identity, state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions import clock
from khata.functions import fixed_values as V
from khata.functions.money import bank_of, sender_id, zero
from khata.functions.text import decimal_of, first_label, grab, has, java, masked, plain_number
from khata.operators.extract import FLAGS, account_of, amount_of, month_number
from khata.operators.inbox import plain_text
from khata.operators.reports import INBOX, Keys


def due_date(text: Column) -> Column:
    """The first date worded as a due date whose month exists; other dates are never taken."""
    def parts(pattern: str) -> Column:
        rx = java(pattern, FLAGS)
        return F.struct(*[
            F.regexp_extract(text, rx, g).alias(n) for g, n in ((1, "day"), (2, "month"), (3, "year"))
        ])

    def reading(p: Column) -> Column:
        return F.struct(
            p["day"].try_cast("int").alias("day"),
            F.coalesce(month_number(p["month"]), p["month"].try_cast("int")).alias("month"),
            clock.four_digit_year(p["year"]).alias("year"),
        )

    found = F.filter(F.array(*[parts(p) for p in V.DUE_DATE_FORMS]), lambda p: p["day"] != "")
    first = F.filter(F.transform(found, reading), lambda d: d["month"].between(1, 12))
    return F.get(F.transform(first, lambda d: clock.rolled_date(d["year"], d["month"], d["day"])), F.lit(0))


def due_amount(text: Column, minimum: Column) -> Column:
    """The amount owed; the minimum due is passed over where a total is worded."""

    def reading(pattern: str) -> Column:
        value = decimal_of(grab(text, pattern, 1, FLAGS))
        is_minimum = F.coalesce(value == minimum, F.lit(False)) & has(text, V.TOTAL_WORDING, FLAGS)
        return F.when((value > 0) & ~is_minimum, value)

    return F.coalesce(*[reading(p) for p in V.DUE_AMOUNT_FORMS], amount_of(text))


def extract_bills(messages: DataFrame) -> DataFrame:
    """One row per bill message which states an amount or a due date.

    ``messages`` are those of the bills tab.
    """
    text = F.col("_masked")
    read = messages.withColumn("_text", plain_text(F.col("body"))).withColumn(
        "_masked", masked(F.col("_text"))
    ).withColumns({
        "minimum_due": decimal_of(grab(text, V.MINIMUM_DUE, 1, FLAGS)),
        "due_date": due_date(text),
        "account": account_of(text),
        "issuer": F.coalesce(bank_of(sender_id(F.col("address"))), F.trim(grab(text, V.BILL_ISSUER, 1, "a"))),
        "kind": F.coalesce(first_label(text, V.BILL_KINDS, FLAGS), F.lit("other")),
        "overdue": has(text, V.OVERDUE, FLAGS),
    }).withColumn("amount", due_amount(text, F.col("minimum_due")))
    fingerprint = F.concat_ws(
        ":", F.lit("bill"), F.lower(F.coalesce("issuer", F.lit("?"))), F.coalesce("account", F.lit("?")),
        F.coalesce(F.col("due_date").cast("string"), F.lit("nodate")),
        plain_number(F.coalesce("amount", zero())),
    )
    # a generator of one row: the test for an amount or a date stays above the patterns
    fields = F.struct("minimum_due", "due_date", "account", "issuer", "kind", "overdue", "amount", "_text")
    read = read.select("inbox_id", "id", "date_ms", F.inline(F.array(fields)))
    return read.where(F.col("amount").isNotNull() | F.col("due_date").isNotNull()).select(
        "inbox_id", F.col("id").alias("sms_id"), fingerprint.alias("fingerprint"),
        F.coalesce("issuer", F.lit("unknown")).alias("issuer"), "account", "kind", "amount",
        "minimum_due", "due_date", F.col("date_ms").alias("seen_ms"), "overdue",
        F.lit("open").alias("status"), F.col("_text").alias("raw"),
    )


def latest_bills(bills: DataFrame) -> DataFrame:
    """One row per obligation: the newest sighting, of equally new ones the first by id."""
    row = F.struct(*[c for c in bills.columns if c not in ("inbox_id", "fingerprint")])
    newest = F.max_by(row, F.struct(F.col("seen_ms"), -F.col("sms_id")))
    return (
        bills.groupBy("inbox_id", "fingerprint").agg(newest.alias("row"))
        .select("inbox_id", "fingerprint", "row.*").select(*bills.columns)
    )


def overlay_status(bills: DataFrame, saved: DataFrame) -> DataFrame:
    """Puts the saved status (inbox_id, fingerprint, status, updated_ms) over parsed bills."""
    last = saved.groupBy("inbox_id", "fingerprint").agg(F.max_by("status", "updated_ms").alias("_status"))
    return (
        bills.join(last, ["inbox_id", "fingerprint"], "left")
        .withColumn("status", F.coalesce("_status", "status")).select(*bills.columns)
    )


def days_until(now: datetime) -> Column:
    return F.datediff(F.col("due_date"), F.lit(now.date()))


def _open() -> Column:
    return F.col("status") == "open"


def is_due_soon(now: datetime) -> Column:
    return _open() & F.coalesce(days_until(now).between(0, 7), F.lit(False))


def is_overdue(now: datetime) -> Column:
    return _open() & (F.col("overdue") | F.coalesce(days_until(now) < 0, F.lit(False)))


def bills_due(bills: DataFrame, now: datetime, keys: Keys = INBOX) -> DataFrame:
    """Totals and counts of bills due within seven days and of overdue ones."""
    soon, late = is_due_soon(now), is_overdue(now)

    def total(test: Column) -> Column:
        return F.sum(F.when(test, F.coalesce("amount", zero())).otherwise(zero()))

    return bills.groupBy(*keys).agg(
        total(soon).alias("due_total"), F.count_if(soon).alias("due_count"),
        total(late).alias("overdue_total"), F.count_if(late).alias("overdue_count"),
    )


def bill_urgency(bills: DataFrame, now: datetime) -> DataFrame:
    """Adds days, when_due and urgent."""
    days = days_until(now)

    def plural(n: Column) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, " day").otherwise(" days"))

    return bills.withColumns({
        "days": days,
        "when_due": F.when(days.isNull(), "no date found")
        .when(days < 0, F.concat(plural(-days), F.lit(" overdue")))
        .when(days == 0, "due today")
        .otherwise(F.concat(F.lit("due in "), plural(days))),
        "urgent": F.coalesce(days < 3, F.lit(False)),
    })


def _list_order() -> list[Column]:
    return [F.when(_open(), 0).otherwise(1), F.asc_nulls_last("due_date")]


def bill_list(bills: DataFrame) -> DataFrame:
    """Open bills by due date with undated ones last, then those done."""
    return bills.orderBy(*_list_order(), "inbox_id", "sms_id")


def bill_positions(bills: DataFrame) -> DataFrame:
    """Adds ``position``, a bill's place in the list of its inbox."""
    return bills.withColumn("position", F.row_number().over(Window.partitionBy("inbox_id").orderBy(*_list_order(), "sms_id")))
