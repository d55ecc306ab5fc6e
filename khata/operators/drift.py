"""Template drift: bank messages that neither the parser nor the inbox rules understand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions.money import is_financial, sender_id
from khata.operators import privacy
from khata.operators.reports import INBOX, Keys


def detect_drift(classified: DataFrame) -> DataFrame:
    """Messages of financial senders rejected for an unexpected reason and placed nowhere."""
    return classified.where(
        F.col("reason").isNotNull() & ~F.col("reason").isin(*V.EXPECTED_NOISE)
        & F.col("subtype").isin(*V.UNRECOGNISED_SUBTYPES)
        & is_financial(sender_id(F.col("address")))
    ).select(
        "inbox_id", F.col("id").alias("sms_id"), F.col("address").alias("sender"), "reason", "subtype",
        "body", "date_ms",
    )


def drift_rollup(drift: DataFrame, keys: Keys = INBOX) -> DataFrame:
    """One row per sender and reason with the newest body and the number seen."""
    order = F.struct((-F.col("date_ms")).alias("age"), F.col("sms_id").alias("id"))
    return drift.groupBy(*keys, "sender", "reason").agg(
        F.min_by("body", order).alias("body"), F.min_by("subtype", order).alias("subtype"),
        F.count("*").alias("count"),
    )


def drift_report(rollup: DataFrame, salt: str, shift_days: int) -> DataFrame:
    """The shareable form: sender reduced to its bank code, body redacted, counts and warnings."""
    safe = privacy.redact(rollup, "body", salt, shift_days)
    return safe.select(
        *[c for c in rollup.columns if c not in ("sender", "body", "subtype")],
        sender_id(F.col("sender")).alias("sender"),
        F.trim("body").alias("body"), "replaced",
        privacy.leaks_in(F.col("body")).alias("warnings"),
    )


def replaced_totals(redacted: DataFrame, keys: Keys = INBOX) -> DataFrame:
    """How many values of each category were replaced."""
    return redacted.select(*keys, F.explode("replaced").alias("what", "times")).groupBy(*keys, "what").agg(
        F.sum("times").alias("times")
    )


def report_text(report: DataFrame, build: str = "unknown") -> DataFrame:
    """The report as one text block per template, ready to be written as text files; only here a long body is cut."""
    return report.select(
        *[c for c in report.columns if c in ("inbox_id",)],
        F.concat_ws(
            "\n", F.concat(F.lit("build  : "), F.lit(build)),
            F.concat(F.lit("sender : "), F.col("sender")),
            F.concat(F.lit("reason : "), F.col("reason")),
            F.concat(F.lit("seen   : "), F.col("count"), F.lit("×")),
            F.lit(""), F.substring("body", 1, V.DRIFT_BODY_CHARS), F.lit(""),
        ).alias("value"),
    )
