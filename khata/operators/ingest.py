"""The import: messages to new ledger rows, with counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.operators.categories import resolve_categories
from khata.operators.dedup import dedup, drop_repeated_messages, mark_duplicates, newest_versions
from khata.operators.extract import accepted, parse_messages
from khata.operators.merge import merge_ledger
from khata.operators.reports import INBOX, Keys
from khata.session import cut_lineage


def parsed_once(messages: DataFrame, tz: str) -> DataFrame:
    """Ledger rows of the messages, the newest version of each message id, written out: they are read several times.

    The parse comes before the rows are made unique, so it runs on the partitions of the scan.
    """
    return cut_lineage(newest_versions(accepted(parse_messages(messages, tz)), ["inbox_id", "sms_id"], ["sms_date_ms", "raw", "sender"]))


def ingest(messages: DataFrame, tz: str, stored: DataFrame | None = None, decisions: DataFrame | None = None,
           priors: DataFrame | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """New ledger rows of the messages: parsed, without duplicates, categorised."""
    txns = parsed_once(messages, tz)
    return resolve_categories(dedup(txns, stored), decisions, priors, predictions)


def fresh_parse(txns: DataFrame, stored: DataFrame) -> DataFrame:
    """For stored fingerprints the row of their newest message."""
    row = F.struct(*[c for c in txns.columns if c not in ("inbox_id", "fingerprint")])
    return (
        txns.join(stored.select("inbox_id", "fingerprint").distinct(), ["inbox_id", "fingerprint"], "left_semi")
        .groupBy("inbox_id", "fingerprint")
        .agg(F.max_by(row, F.struct("sms_date_ms", -F.col("sms_id"))).alias("row"))
        .select("inbox_id", "fingerprint", "row.*").select(*txns.columns)
    )


def reprocess(messages: DataFrame, tz: str, stored: DataFrame, decisions: DataFrame | None = None,
              priors: DataFrame | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """A full re-scan: stored rows are parsed anew, the user's decisions stay, new rows are added.

    A stored row takes the newest message with its fingerprint.  Its category is resolved before
    the merge, so that a re-scan does not empty it.  The result has a column ``change``.
    """
    txns = parsed_once(messages, tz)
    again = fresh_parse(txns, stored)
    fresh = again.unionByName(dedup(txns, stored))
    return merge_ledger(
        stored, resolve_categories(fresh, decisions, priors, predictions).select(*stored.columns), reprocess=True
    )


def ingest_counters(messages: DataFrame, tz: str, stored: DataFrame | None = None, keys: Keys = INBOX) -> DataFrame:
    """scanned, parsed, rejected, duplicates and written per inbox."""
    unique = drop_repeated_messages(messages)
    txns = parsed_once(messages, tz)
    seen = unique.groupBy(*keys).agg(F.count("*").alias("scanned"))
    read = txns.groupBy(*keys).agg(F.count("*").alias("parsed"))
    doubles = mark_duplicates(txns, stored).groupBy(*keys).agg(
        F.count_if("duplicate").alias("duplicates"), F.count_if(~F.col("duplicate")).alias("written"),
    )
    zero = F.lit(0).cast("bigint")
    parsed = F.coalesce("parsed", zero)
    return seen.join(read, list(keys), "left").join(doubles, list(keys), "left").select(
        *keys, "scanned", parsed.alias("parsed"), (F.col("scanned") - parsed).alias("rejected"),
        F.coalesce("duplicates", zero).alias("duplicates"), F.coalesce("written", zero).alias("written"),
    )


def newer_than_watermark(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages newer than the newest stored one of their inbox; an inbox without rows gets all.

    ``sms_date_ms`` of the stored rows is the watermark; all newer messages are taken, however many.
    """
    mark = stored.groupBy("inbox_id").agg(F.max("sms_date_ms").alias("_mark"))
    return messages.join(mark, "inbox_id", "left").where(
        F.col("_mark").isNull() | (F.col("date_ms") > F.col("_mark"))
    ).drop("_mark")


def needs_backfill(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Inboxes which have messages but no stored row yet."""
    return messages.select("inbox_id").distinct().join(stored.select("inbox_id").distinct(), "inbox_id", "left_anti")
