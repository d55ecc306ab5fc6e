"""Transactions out of messages: reject, read fields, score, identify.

All rules are column expressions over the message table; the job is one narrow stage without a
shuffle.  The cheap tests run first, and every later expression is guarded by ``reason IS NULL``, so
a rejected message never reaches the field patterns.  A message is cut into words once, and a rule is searched only in messages which have
one of the words that each way to word it must have.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import clock
from khata.functions import fixed_values as V
from khata.functions.money import bank_of, brand_of, merchant_key, sender_id
from khata.functions.text import (
    decimal_of, first_label, grab, has, java, masked, plain_number, squeeze, swap, uneven,
)

PREFIX = "t_"
TXN_FIELDS = (
    "sms_id", "sms_date_ms", "fingerprint", "soft_keys", "direction", "kind", "amount", "currency",
    "foreign_amount", "foreign_currency", "account", "merchant", "merchant_quality", "ref", "channel",
    "date", "date_ms", "balance", "sender", "sender_id", "bank", "category", "category_source",
    "kind_source", "confidence_pct", "needs_review", "reviewed", "ambiguous_p2p",
    "review_reason_override", "raw",
)


# message texts are squeezed and masked, so the engine's own classes are exact on them
FLAGS = "ia"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value which is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def message_text(body: Column) -> Column:
    """White space squeezed, and a blank put between a figure and a verb stuck to it."""
    even = _let(F.coalesce(body, F.lit("")), lambda t: F.when(uneven(t), squeeze(t)).otherwise(t))
    # a verb is stuck only where a letter follows a figure; the search for that is far cheaper
    return F.trim(_let(even, lambda t: F.when(t.rlike("[0-9][cdprswCDPRSW]"), swap(t, V.STUCK_VERBS, "$1 $2")).otherwise(t)))


#: Words of the text in lower case, beside it: a rule whose words don't occur is not searched.
WORDS = "_words"


def words_in(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z]+")


def says(*words: str) -> Column:
    """Whether the text has one of the words."""
    return F.arrays_overlap(WORDS, F.array(*[F.lit(w) for w in words]))


def holds(*parts: str) -> Column:
    """Whether the text has one of the parts anywhere, in any case."""
    return _let(F.lower("_masked"), lambda lower: reduce(lambda a, b: a | b, [F.contains(lower, F.lit(p)) for p in parts]))


#: A word for every way to word a debit or a credit.
DEBIT_WORDS = ("debited", "spent", "withdrawn", "paid", "purchase", "deducted", "sent", "transferred", "txn", "charged", "processed", "payment",
               "done", "recharged", "loaded", "thank", "thanks")
CREDIT_WORDS = ("credited", "received", "deposited", "refund", "refunded", "reversal", "reversed", "cashback", "added")


def _channel_guards() -> list[Column]:
    """For each rule of CHANNEL_FORMS what a text must say."""
    return [says("upi", "vpa") | holds("@"), says("card", "pos", "spent"), says("neft"), says("imps"), says("rtgs"), says("atm", "withdrawn"),
            holds("cheque", "chq")]


def _reject_guards(says: Callable[..., Column] = says, holds: Callable[..., Column] = holds) -> list[Column]:
    """For each rule of REJECT_FIRST what a text must say to break it; a word for every way to word the rule."""
    balances = [a + b for a in ("", "avl", "available", "closing", "c") for b in ("bal", "balance")]
    return [
        says("otp", "one", "onetime", "onetimepassword", "onetimepin", "verification", "do"),
        says("offer", "cashback", "congratulations", "win", "sale", "discount", "apply", "click", "unsubscribe", "limited"),
        says(*balances),
        says("limit"),
        says("hold", "pre", "preauth", "blocked", "authorization", "temporarily"),
        says("registered", "created", "cancelled"),
        says("mandate", "autopay", "standing"),
        says("payee", "beneficiary", "after", "adding"),
        says("gone", "minimum", "avoid"),
        # this one ends inside of words, too
        holds("maintenance", "unavailable", "offline", "kyc", "reactivated", "generated", "logged", "pin has", "updation", "verification", "emis",
              "smartemi", "invites", "beware", "safe", "fake", "smishing", "phishing", "delink", "points", "voucher", "cashback", "download",
              "visit", "t&c"),
        says("delivered", "dispatched", "received", "application", "statement", "estatement", "unable", "moved"),
        says("requesting", "request", "requested") | holds("approve"),
        says("returned", "unsuccessful", "reversed", "attempt"),
        says("declined", "failed", "funds", "pin", "txn"),
    ]


def _may_reject() -> Column:
    """Whether any of the guards of REJECT_FIRST can be true: one look at the words instead of one for each rule."""
    words: list[str] = []
    parts: list[str] = []

    def note(into: list[str]) -> Callable[..., Column]:
        return lambda *named: (into.extend(named), F.lit(True))[1]

    _reject_guards(note(words), note(parts))
    return says(*dict.fromkeys(words)) | holds(*parts)


def _late_guards() -> list[Column]:
    """The same for REJECT_UNLESS_REFUND."""
    return [
        says("failed", "declined", "unsuccessful", "processed", "reversed", "insufficient"),
        says("due", "generated", "ready", "debited") | holds("autopay"),
    ]


def _says_internal() -> Column:
    return says("card", "self", "own", "wallet", "paytm", "phonepe", "amazon", "added", "cred", "fastag", "epf", "epfo", "provident", "ppf", "nps",
                "contribution", "netc", "metro", "prepaid", "transferred", "transfer", "your")


def direction_of(text: Column, debit: Column | None = None, credit: Column | None = None) -> Column:
    """debit or credit; when both are worded the one named first decides.

    A wording is searched only where its guard, if there is one, is true.
    """
    def first(at: Column) -> Column:
        debit, credit = at["debit"], at["credit"]
        return F.when((debit > 0) & ((credit == 0) | (debit < credit)), "debit").when(credit > 0, F.lit("credit"))

    def place(pattern: str, guard: Column | None) -> Column:
        at = F.regexp_instr(text, F.lit(java(pattern, FLAGS)))
        return at if guard is None else F.when(guard, at).otherwise(0)

    places = [place(V.DEBIT, debit).alias("debit"), place(V.CREDIT, credit).alias("credit")]
    return _let(F.struct(*places), first)


def amount_of(text: Column) -> Column:
    """The first amount form with a positive number which has no minus sign right before it.

    A form whose first hit is signed is passed over as a whole; forms after the one that counts are not searched.
    """
    def value(found: Column) -> Column:
        number = decimal_of(F.regexp_replace(found, r"^[:\-−]?\s*", ""))
        return F.when((found != "") & ~found.rlike("^[-−][0-9]"), _let(number, lambda v: F.when(v > 0, v)))

    return F.coalesce(*[_let(F.regexp_extract(text, java(p, FLAGS), 1), value) for p in V.AMOUNT_FORMS])


def account_of(text: Column) -> Column:
    return F.right(F.coalesce(*[grab(text, p, 1, FLAGS) for p in V.ACCOUNT_FORMS]), F.lit(4))


def month_number(name: Column) -> Column:
    """1..12 for a month abbreviation, else null."""
    at = F.array_position(F.array(*[F.lit(m) for m in V.MONTHS]), F.lower(name))
    return F.nullif(at, F.lit(0)).cast("int")


def stated_date(text: Column) -> Column:
    """The day written in the message, or null.  Of each format only the first hit is looked at."""

    def hit(pattern: str, day: Callable[[Callable[[int], Column]], Column]) -> Column:
        # One search in the text; its groups are read from the hit.
        rx = java(pattern, FLAGS)
        return _let(F.regexp_extract(text, rx, 0), lambda found: F.when(found != "", day(lambda group: F.regexp_extract(found, rx, group))))

    def by_name(part: Callable[[int], Column]) -> Column:
        return clock.rolled_date(clock.four_digit_year(part(3)), month_number(part(2)), part(1).try_cast("int"))

    def by_digits(part: Callable[[int], Column]) -> Column:
        month = part(2).try_cast("int")
        return F.when(month <= 12, clock.rolled_date(clock.four_digit_year(part(3)), month, part(1).try_cast("int")))

    def by_lead(part: Callable[[int], Column]) -> Column:
        return clock.rolled_date(part(3).try_cast("int"), month_number(part(1)), part(2).try_cast("int"))

    def by_iso(part: Callable[[int], Column]) -> Column:
        return clock.rolled_date(*[part(group).try_cast("int") for group in (1, 2, 3)])

    return F.coalesce(hit(V.DATE_DAY_MONTHNAME, by_name), hit(V.DATE_DAY_MONTH, by_digits), hit(V.DATE_MONTHNAME_DAY, by_lead), hit(V.DATE_ISO, by_iso))


def handle_quality(handle: Column) -> Column:
    """phone, opaque or named, for the local part of a payment address."""
    digits = F.length(F.regexp_replace(handle, "[^0-9]", ""))
    size = F.length(handle)
    return (
        F.when(has(handle, V.PHONE_HANDLE, ""), "phone")
        .when(handle.rlike("^[0-9]+$"), "opaque")
        .when((size >= 6) & (digits * 2 > size), "opaque")
        .when((size >= 8) & ~handle.rlike("(?i)[aeiou]"), "opaque")
        .otherwise("named")
    )


def merchant_of(text: Column) -> Column:
    """Struct (name, quality) of the counterparty named in the text, or null; the name may be empty.

    Every form gives at most one candidate.  A readable name is taken if it is no account tail; an
    unreadable payment handle ends the search at once, even when nothing is left of it.
    """

    def named_or_handle(raw: Column) -> Column:
        raw = F.trim(raw)
        handle = F.substring_index(raw, "@", 1)
        return F.struct(
            handle.alias("name"),
            F.when(raw.contains("@"), handle_quality(handle)).otherwise("named").alias("quality"),
        )

    def cleaned(c: Column) -> Column:
        name = swap(c["name"], V.AGGREGATOR, "")
        name = F.trim(swap(swap(name, V.TRAILING_DATE, ""), V.TRAILING_LABEL, ""))
        name = swap(F.regexp_replace(name, r"[_.\-]+", " "), V.MERCHANT_NOISE, " ")
        return F.struct(F.trim(squeeze(name)).alias("name"), c["quality"].alias("quality"))

    def ends_search(c: Column) -> Column:
        name = c["name"]
        is_tail = name.rlike("^[0-9]+$") | has(name, r"^[x*]+\s*\d+$")
        return (c["quality"] != "named") | ((F.length(name) >= 2) & ~is_tail)

    # what a text must hold for each form; a form which can't occur is not searched, nor is one after the form which ends the search
    parts = ("vpa", "vpa", "to", "to", "merchant", "done for", "trf", "at", "to", "upi/p2", "from", ";")

    def read(lower: Column, part: str, pattern: str) -> Column:
        # one transform per step, so that each step is evaluated once
        found = F.filter(F.array(F.when(F.contains(lower, F.lit(part)), F.regexp_extract(text, java(pattern), 1))), lambda x: x != "")
        return F.get(F.filter(F.transform(F.transform(found, named_or_handle), cleaned), ends_search), F.lit(0))

    return _let(F.lower(text), lambda lower: F.coalesce(*[read(lower, part, p) for part, p in zip(parts, V.MERCHANT_FORMS, strict=True)]))


def confidence_pct(amount: Column, merchant: Column, quality: Column, ref: Column, account: Column,
                   has_date: Column, channel: Column, currency: Column) -> Column:
    """Confidence in whole hundredths, clamped to 0..100 after each of its two parts."""

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(100), c))

    round_sum = (amount >= 100000) & (amount % 10000 == 0)
    base = clamp(
        F.lit(40) + points(merchant.isNotNull(), 25) + points(ref.isNotNull(), 15)
        + points(account.isNotNull(), 10) + points(has_date, 10) + points(channel != "other", 5)
        - points(round_sum, 15)
    )
    weak = F.when(quality == "sender", 5).when(quality != "named", 25).otherwise(0)
    return clamp(base - weak - points(currency != "INR", 30)).cast("int")


def parse_messages(messages: DataFrame, tz: str) -> DataFrame:
    """Adds ``reason`` (null when the message is a transaction) and the fields of the ledger row.

    ``messages`` has inbox_id, id, body, date_ms and address.  The fields are flat columns named
    ``t_<field>``, null on a rejected message, so that unused ones are pruned from the plan.
    """
    text, reason = F.col("_masked"), F.col("reason")
    staged = (
        messages
        .withColumn("_text", message_text(F.col("body")))
        .withColumn("_masked", masked(F.col("_text")))
        .withColumn(WORDS, words_in(text))
        .withColumn("_early", F.when(text == "", "empty").when(_may_reject(), first_label(text, V.REJECT_FIRST, FLAGS, _reject_guards())))
        .withColumn("_direction", F.when(F.col("_early").isNull(), direction_of(text, says(*DEBIT_WORDS), says(*CREDIT_WORDS))))
    )
    direction = F.col("_direction")
    staged = staged.withColumn(
        "_is_refund", (direction == "credit") & ~has(text, V.FUTURE, FLAGS) & has(text, V.REFUND, FLAGS)
    ).withColumn(
        "_late",
        F.coalesce(
            F.col("_early"),
            F.when(direction.isNull(), "no-direction"),
            F.when(~F.col("_is_refund"), first_label(text, V.REJECT_UNLESS_REFUND, FLAGS, _late_guards())),
        ),
    )
    going = F.col("_late").isNull()
    abroad = says("usd", "eur", "gbp", "aed", "sgd", "aud", "cad", "jpy", "chf", "thb", "myr")
    foreign_number = decimal_of(grab(text, V.FOREIGN, 2, FLAGS))
    staged = staged.withColumns({
        "_amount": F.when(going, amount_of(text)),
        "_foreign": F.when(
            going & abroad & (foreign_number > 0),
            F.struct(F.upper(grab(text, V.FOREIGN, 1, FLAGS)).alias("currency"), foreign_number.alias("amount")),
        ),
    }).withColumn(
        "reason",
        F.coalesce(
            F.col("_late"),
            F.when(F.col("_amount").isNull() & F.col("_foreign").isNull(), "no-amount"),
        ),
    )

    # a generator of one row: filters on the outcome stay above it, so no pattern is searched twice
    outcome = F.struct("reason", "_text", "_masked", WORDS, "_direction", "_is_refund", "_amount", "_foreign")
    staged = staged.select(*messages.columns, F.inline(F.array(outcome)))

    ok = reason.isNull()
    foreign = F.col("_foreign")
    staged = staged.withColumns({
        "_sender_id": sender_id(F.col("address")),
        "_read": F.when(ok, merchant_of(F.col("_text"))),
        "_day": F.when(ok, stated_date(text)),
        "_ref": F.when(ok, F.upper(grab(text, V.REFERENCE, 1, FLAGS))),
        "_account": F.when(ok, account_of(text)),
        "_channel": F.when(ok, F.coalesce(first_label(text, V.CHANNEL_FORMS, FLAGS, _channel_guards()), F.lit("other"))),
    }).withColumns({
        "_value": F.coalesce(F.col("_amount"), F.lit(0).cast("decimal(18,2)")),
        "_currency": F.when(F.col("_amount").isNull(), foreign["currency"]).otherwise("INR"),
        "_name": F.nullif(F.col("_read.name"), F.lit("")),
        "_brand": F.when(
            ok & (F.coalesce(F.col("_read.name"), F.lit("")) == ""), brand_of(F.col("_sender_id"))),
        "_date_ms": F.when(
            F.col("_day").isNotNull(), clock.epoch_ms(F.col("_day"), tz)
        ).otherwise(F.col("date_ms")),
    }).withColumns({
        "_merchant": F.coalesce("_name", "_brand"),
        "_quality": F.when(F.col("_name").isNotNull(), F.col("_read.quality")).when(
            F.col("_brand").isNotNull(), "sender"),
        "_date": F.when(ok, F.coalesce(F.col("_day").cast("timestamp_ntz"), clock.local_time(F.col("date_ms"), tz))),
        "_kind": F.when(
            ok,
            F.when(F.col("_is_refund"), "refund")
            .when(_says_internal() & has(text, V.INTERNAL, FLAGS), "transfer")
            .when(direction == "credit", "income")
            .otherwise("expense"),
        ),
    }).withColumns({
        "_pct": F.when(ok, confidence_pct(
            F.col("_value"), F.col("_merchant"), F.col("_quality"), F.col("_ref"), F.col("_account"),
            has(text, V.DATE_STATED, FLAGS), F.col("_channel"), F.col("_currency"),
        )),
        "_number": F.when(ok, plain_number(F.col("_value"))),
        "_token": F.when(ok, F.substring_index(merchant_key(F.col("_merchant")), " ", 1)),
        "_bucket": F.floor(F.col("_date_ms") / V.SOFT_KEY_BUCKET_MS),
    })
    fields = {PREFIX + name: F.when(ok, value) for name, value in _txn_columns().items()}
    return staged.withColumns(fields).select(*messages.columns, "reason", *fields)


def _txn_columns() -> dict[str, Column]:
    c = F.col
    transfer = c("_kind") == "transfer"
    unreadable = c("_quality").isin("phone", "opaque")
    phone = F.coalesce(c("_quality") == "phone", F.lit(False))
    day = F.concat_ws("-", F.year("_date"), F.month("_date"), F.day("_date"))
    fingerprint = F.when(
        c("_ref").isNotNull(), F.concat_ws(":", F.lit("r"), c("_ref"), c("_number"))
    ).otherwise(
        F.concat_ws(":", F.lit("h"), c("_direction"), c("_number"), day, F.coalesce(c("_account"), F.lit("?")))
    )

    def soft_key(bucket: Column) -> Column:
        return F.concat_ws(":", c("_direction"), c("_number"), bucket.cast("string"), c("_token"))

    soft_keys = F.when(
        c("_token") != "", F.array(soft_key(c("_bucket")), soft_key(c("_bucket") - 1))
    ).otherwise(F.array(F.concat(F.lit("nomerchant:"), c("id").cast("string"))))
    return {
        "sms_id": c("id"),
        "sms_date_ms": c("date_ms"),
        "fingerprint": fingerprint,
        "soft_keys": soft_keys,
        "direction": c("_direction"),
        "kind": c("_kind"),
        "amount": c("_value"),
        "currency": c("_currency"),
        "foreign_amount": c("_foreign.amount"),
        "foreign_currency": c("_foreign.currency"),
        "account": c("_account"),
        "merchant": c("_merchant"),
        "merchant_quality": c("_quality"),
        "ref": c("_ref"),
        "channel": c("_channel"),
        "date": c("_date"),
        "date_ms": c("_date_ms"),
        "balance": F.when(holds("bal"), decimal_of(grab(c("_masked"), V.BALANCE, 1, FLAGS))),
        "sender": c("address"),
        "sender_id": c("_sender_id"),
        "bank": bank_of(c("_sender_id")),
        "category": F.when(transfer, "transfer"),
        "category_source": F.when(transfer, "rule"),
        "kind_source": F.lit(None).cast("string"),
        "confidence_pct": c("_pct"),
        "needs_review": (c("_pct") < V.REVIEW_THRESHOLD_PCT)
        | (c("_currency") != "INR") | F.coalesce(unreadable, F.lit(False)),
        "reviewed": F.lit(False),
        "ambiguous_p2p": phone,
        "review_reason_override": F.lit(None).cast("string"),
        "raw": c("_text"),
    }


def accepted(parsed: DataFrame) -> DataFrame:
    """The ledger rows of parsed messages, one column per field.

    Also a generator of one row: a report's filter on a field is not rewritten into its patterns.
    """
    fields = F.struct(*[F.col(PREFIX + name).alias(name) for name in TXN_FIELDS])
    return parsed.where(F.col("reason").isNull()).select("inbox_id", F.inline(F.array(fields)))


def extract_transactions(messages: DataFrame, tz: str) -> DataFrame:
    """Ledger rows of all messages which are transactions."""
    return accepted(parse_messages(messages, tz))


def reject_reasons(parsed: DataFrame, keys: tuple[str, ...] = ("inbox_id",)) -> DataFrame:
    """Rejected messages counted by reason."""
    return parsed.where(F.col("reason").isNotNull()).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def parse_counts(parsed: DataFrame, keys: tuple[str, ...] = ("inbox_id",)) -> DataFrame:
    return parsed.groupBy(*keys).agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("reason").isNull()).alias("parsed"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )
