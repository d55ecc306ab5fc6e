"""The review queue: reasons, groups, backlog, and decisions on rows or whole groups.

A group is never collected into a list: its figures are aggregates, and its rows are ledger rows
tagged with the group key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.money import is_pending, merchant_or_unknown
from khata.functions.text import plain_number, swap
from khata.operators.reports import INBOX, Keys


def review_reason() -> Column:
    """Why a row waits for review; the first of five cases."""
    override = F.nullif(F.col("review_reason_override"), F.lit(""))
    return (
        F.when(override.isNotNull(), override)
        .when(
            F.col("currency") != "INR",
            F.concat_ws(" ", "foreign_currency", plain_number(F.col("foreign_amount")),
                        F.lit("— no offline exchange rate")),
        )
        .when(F.col("ambiguous_p2p"), F.lit("paid to a phone number — person or shop?"))
        .when(F.col("merchant_quality") == "opaque", F.lit("unreadable UPI handle"))
        .otherwise(F.concat(F.lit("low confidence "), F.coalesce("confidence_pct", F.lit(0)), F.lit("%")))
    )


def _group_reason() -> Column:
    """The reason without its first percentage, so that 40 % and 45 % are one decision."""
    return swap(review_reason(), r"^([\s\S]*?)\s*\d+%", "$1", "")


def pending_rows(ledger: DataFrame) -> DataFrame:
    """Rows waiting for review with review_reason, group_reason and group_key."""
    reason = _group_reason()
    return ledger.where(is_pending()).withColumns({
        "review_reason": review_reason(),
        "group_reason": reason,
        "group_key": F.concat_ws("|", merchant_or_unknown(F.col("merchant")), reason),
    })


def review_groups(ledger: DataFrame, keys: Keys = INBOX) -> DataFrame:
    """Pending rows by merchant and reason; the rows themselves are ``pending_rows``."""
    order = F.struct("date", "sms_id")
    first = F.min_by(F.struct("merchant", "fingerprint", "raw"), order)
    return pending_rows(ledger).groupBy(*keys, "group_key").agg(
        F.coalesce(F.nullif(first["merchant"], F.lit("")), F.lit("Unknown")).alias("merchant"),
        F.first("group_reason").alias("reason"),
        F.count("*").alias("count"),
        F.sum("amount").alias("total"),
        F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed").alias("kind"),
        first["fingerprint"].alias("sample_fingerprint"),
        first["raw"].alias("sample_raw"),
    )


def top_review_groups(ledger: DataFrame, n: int = 25, keys: Keys = INBOX) -> DataFrame:
    """The groups with the most money first; a report with a fixed length."""
    rank = Window.partitionBy(*keys).orderBy(F.desc("total"), "group_key")
    return (
        review_groups(ledger, keys).withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= n)
    )


def review_backlog(ledger: DataFrame, keys: Keys = INBOX) -> DataFrame:
    """How many rows wait, what they are worth, and how many decisions clear them."""
    return review_groups(ledger, keys).groupBy(*keys).agg(
        F.sum("count").alias("pending"), F.sum("total").alias("excluded"), F.count("*").alias("decisions"),
    )


def resolve_rows(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies (inbox_id, fingerprint, accept): accepted rows count from now on, others go."""
    verdict = decisions.select("inbox_id", "fingerprint", F.col("accept").alias("_accept"))
    joined = ledger.join(verdict, ["inbox_id", "fingerprint"], "left")
    kept = joined.where(F.coalesce("_accept", F.lit(True)))
    hit = F.col("_accept").isNotNull()
    return kept.withColumns({
        "reviewed": F.when(hit, F.lit(True)).otherwise(F.col("reviewed")),
        "needs_review": F.when(hit, F.lit(False)).otherwise(F.col("needs_review")),
    }).select(*ledger.columns)


def resolve_groups(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies (inbox_id, group_key, action accept|reject, kind?, category?) to whole groups.

    One join: only pending rows carry a group key, all others pass.  A batch decision is a user
    decision, but only for the field which was given.
    """
    verdict = decisions.select(
        "inbox_id", "group_key", F.col("action").alias("_action"),
        F.col("kind").alias("_kind"), F.col("category").alias("_category"),
    )
    tagged = ledger.withColumn(
        "group_key",
        F.when(is_pending(), F.concat_ws("|", merchant_or_unknown(F.col("merchant")), _group_reason())),
    )
    joined = tagged.join(verdict, ["inbox_id", "group_key"], "left")
    kept = joined.where(F.col("_action").isNull() | (F.col("_action") != "reject"))
    hit = F.col("_action").isNotNull()
    return kept.withColumns({
        "kind": F.coalesce("_kind", "kind"),
        "kind_source": F.when(F.col("_kind").isNotNull(), "user").otherwise(F.col("kind_source")),
        "category": F.coalesce("_category", "category"),
        "category_source": F.when(F.col("_category").isNotNull(), "user").otherwise(F.col("category_source")),
        "needs_review": F.when(hit, F.lit(False)).otherwise(F.col("needs_review")),
        "reviewed": F.when(hit, F.lit(True)).otherwise(F.col("reviewed")),
    }).select(*ledger.columns)
