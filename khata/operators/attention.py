"""What waits for a decision: possible transfers, rows to confirm, overdue bills."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.money import is_pending
from khata.operators.bills import is_overdue
from khata.operators.pairs import dashboard_pairs
from khata.operators.reports import INBOX, Keys


def attention_list(ledger: DataFrame, bills: DataFrame, now: datetime, keys: Keys = INBOX) -> DataFrame:
    """One row per inbox and open topic: topic, n, detail."""

    def topic(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.lit(name).alias("topic"), F.count("*").alias("n"), F.lit(None).cast("string").alias("detail")
        )

    late = bills.where(is_overdue(now))
    first = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("due_date"), "sms_id")
    # only the first three issuers are listed, so only three rows per inbox reach the list
    issuers = (
        late.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 3)
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "issuer"))).alias("_first"))
    )
    named = topic(late, "overdue_bills").join(issuers, list(keys)).withColumn(
        "detail", F.array_join(F.transform("_first", lambda b: b["issuer"]), ", ")
    ).drop("_first")
    return (
        topic(dashboard_pairs(ledger, now), "transfers")
        .unionByName(topic(ledger.where(is_pending()), "review"))
        .unionByName(named)
    )
