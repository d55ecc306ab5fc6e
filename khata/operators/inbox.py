"""Inbox tabs: where every message belongs, transaction or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions.money import is_financial, sender_id
from khata.functions.text import has, has_any, masked, squeeze
from khata.operators.extract import FLAGS, WORDS, parse_messages, says, words_in
from khata.operators.reports import INBOX, Keys, page


def _place(tab: str, subtype: str | Column, reason: str) -> Column:
    kind = F.lit(subtype) if isinstance(subtype, str) else subtype
    return F.struct(F.lit(tab).alias("tab"), kind.alias("subtype"), F.lit(reason).alias("place_reason"))


#: What a message must say to meet a group of patterns: a word for every way to word them.
SPAM_WORDS = ("earn", "income", "home", "lottery", "jackpot", "lucky", "won", "prize", "loan", "wa", "trade")
BILL_WORDS = ("due", "generated", "overdue", "immediately", "pay", "debited", "deducted", "alternate")
TRAVEL_WORDS = ("pnr", "boarding", "flight", "train", "bus", "coach", "seat", "departure", "arrival", "gate", "terminal")
DELIVERY_WORDS = ("delivered", "delivery", "shipped", "dispatched", "courier", "awb", "tracking", "order", "arrive")
APPOINTMENT_WORDS = ("appointment", "scheduled", "slot", "booking", "reporting")
SERVICE_WORDS = (
    "maintenance", "unavailable", "offline", "rekyc", "kyc", "ckyc", "updation", "pin", "reactivated", "generated", "logged", "login", "beware",
    "fraud", "smishing", "phishing", "never", "payee", "beneficiary", "mandate", "gone", "minimum", "dormant", "inactive", "reactivate",
    "balance", "avl", "recharge", "reload", "immediately", "fastag", "autopay", "emandate", "standing", "unable", "declined", "processed",
    "failed", "usage", "contactless", "mycards", "international", "limit", "withdraw", "trai", "guidelines", "rbi", "npci", "official",
    "delivery", "scheduled", "awb",
)
PROMOTION_WORDS = (
    "offer", "sale", "discount", "cashback", "flat", "save", "limited", "hurry", "last", "t", "terms", "download", "install", "click", "apply",
    "shop", "book", "order", "convert", "smartemi", "preapproved", "approved", "upgrade", "points", "voucher", "coupon", "invites",
    "introducing", "feature", "available",
)


def plain_text(body: Column) -> Column:
    return F.trim(squeeze(F.coalesce(body, F.lit(""))))


def classify_inbox(messages: DataFrame, tz: str, parsed: bool = False) -> DataFrame:
    """Adds tab, subtype, place_reason and sensitive; the first matching rule places a message.

    The parse is done once and its columns stay (``reason``, ``t_*``), so one pass feeds the ledger,
    the inbox and the drift report.  With ``parsed`` the input is already parsed.
    """
    rows = messages if parsed else parse_messages(messages, tz)
    text = F.col("_plain")
    from_ = F.col("address")
    number = F.regexp_replace(F.coalesce(from_, F.lit("")), r"[\s\x{A0}-]", "")
    place = (
        F.when(text == "", _place("updates", "empty", "empty"))
        .when(says(*SPAM_WORDS) & has_any(text, V.SPAM, FLAGS), _place("spam", "junk", "spam-pattern"))
        .when(F.col("reason").isNull(), _place("transactions", F.col("t_kind"), "parsed-transaction"))
        .when(has(text, V.OTP, FLAGS), _place("updates", "otp", "otp"))
        .when(says(*BILL_WORDS) & has_any(text, V.BILL, FLAGS), _place("bills", "bill", "bill-pattern"))
        .when(says(*TRAVEL_WORDS) & has(text, V.TRAVEL, FLAGS), _place("updates", "travel", "travel"))
        .when(says(*DELIVERY_WORDS) & has(text, V.DELIVERY, FLAGS), _place("updates", "delivery", "delivery"))
        .when(says(*APPOINTMENT_WORDS) & has(text, V.APPOINTMENT, FLAGS), _place("updates", "appointment", "appointment"))
        .when(says(*SERVICE_WORDS) & has_any(text, V.SERVICE, FLAGS), _place("updates", "service", "service-notice"))
        .when(says(*PROMOTION_WORDS) & has_any(text, V.PROMOTION, FLAGS), _place("promotions", "offer", "promo-pattern"))
        .when(has(number, V.NUMERIC_SENDER, ""), _place("personal", "person", "numeric-sender"))
        .when(is_financial(sender_id(from_)), _place("updates", "bank-other", "financial-sender"))
        .otherwise(_place("updates", "other", "unmatched"))
    )
    return (
        rows.withColumn("_plain", masked(plain_text(F.col("body")))).withColumn(WORDS, words_in(text))
        # a generator of one row keeps filters on the tab from repeating the rules below it
        .select(*rows.columns, F.inline(F.array(place)))
        .withColumn("sensitive", F.col("subtype") == "otp")
    )


def tab_counts(classified: DataFrame, keys: Keys = INBOX) -> DataFrame:
    return classified.groupBy(*keys, "tab").agg(F.count("*").alias("n"))


def visible_body(classified: DataFrame) -> DataFrame:
    """A one-time code is never shown."""
    return classified.withColumn("body", F.when(~F.col("sensitive"), F.col("body")))


def search_inbox(classified: DataFrame, tab: str, query: str = "", limit: int = 40, offset: int = 0,
                 keys: Keys = INBOX) -> DataFrame:
    """A page of the newest messages of a tab, per inbox, whose body or sender contains the text, codes masked."""
    q = query.strip().lower()
    rows = classified.where(F.col("tab") == tab)
    if q:
        rows = rows.where(
            F.lower(F.coalesce("body", F.lit(""))).contains(q)
            | F.lower(F.coalesce("address", F.lit(""))).contains(q)
        )
    return visible_body(page(rows, keys, [F.desc("date_ms"), F.desc("id")], limit, offset))
