"""Exports: ledger as CSV and JSON, redacted corpora, template lists, drift reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import clock
from khata.functions import fixed_values as V
from khata.functions.text import plain_number

NOTES = (
    "Amounts in INR. kind: expense | income | refund | transfer. Transfers and investments are "
    "excluded from spending totals. Rows with needs_review=true and reviewed=false are excluded "
    "from totals."
)


def csv_rows(ledger: DataFrame, tz: str) -> DataFrame:
    """The fourteen export columns, as text, oldest first."""
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col("date"))
    iso = F.concat(clock.iso_millis(utc), F.lit("Z"))
    confidence = plain_number((F.col("confidence_pct") / 100).cast("decimal(4,2)"))
    cells: dict[str, Column] = {
        "date": iso, "amount": plain_number(F.col("amount")), "confidence": confidence,
        "categorySource": F.col("category_source"),
        "needsReview": F.col("needs_review").cast("string"),
    }
    return ledger.orderBy("date", "sms_id").select(
        *[cells.get(c, F.col(c) if c in ledger.columns else F.lit(None).cast("string")).alias(c)
          for c in V.CSV_COLUMNS]
    )


def export_csv(ledger: DataFrame, path: str, tz: str) -> None:
    """Part files in date order, each with the header; quotes are doubled inside quoted cells."""
    csv_rows(ledger, tz).write.mode("errorifexists").option("header", True).option("quote", '"').option(
        "escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def export_json(ledger: DataFrame, bills: DataFrame, path: str) -> None:
    """transactions, bills and notes as JSON lines below one folder."""
    ledger.write.mode("errorifexists").json(f"{path}/transactions")
    bills.write.mode("errorifexists").json(f"{path}/bills")
    ledger.sparkSession.range(1).select(F.lit(NOTES).alias("notes")).coalesce(1).write.mode(
        "errorifexists").json(f"{path}/notes")


def write_corpus(redacted: DataFrame, path: str) -> None:
    """Redacted messages as JSON lines."""
    redacted.select("address", "body", F.col("date_ms").alias("date")).write.mode("errorifexists").json(path)


def write_templates(mined: DataFrame, senders: DataFrame, path: str) -> None:
    """Shape, count, most frequent senders and example, as JSON lines."""
    top = senders.groupBy("shape").agg(
        F.sort_array(F.collect_list(F.struct("rank", "sender", "n"))).alias("senders")  # five at most
    )
    mined.drop("senders").join(top, "shape").orderBy("rank").write.mode("errorifexists").json(path)


def write_drift_report(report_lines: DataFrame, path: str) -> None:
    report_lines.select("value").write.mode("errorifexists").text(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """A new ledger version; months are folders, so a report on a period reads only its own."""
    month = F.format_string("%04d-%02d", F.year("date"), F.month("date"))  # by the wall clock, whatever the session's zone
    ledger.withColumn("month", month).repartition("month", F.pmod(F.xxhash64("inbox_id"), F.lit(64))).write.mode(
        "errorifexists").partitionBy("month").parquet(path)
