"""Messages arriving as files, folded into a stored ledger batch by batch.

Every micro-batch is compared with the identities of the rows accepted before (``identities.py``) and written to folders of its own: its
rows, its identities, its counters.  A batch which is delivered again overwrites them and gives the same rows, so the
ledger is the same however often a batch is repeated.  Progress is the checkpoint; there is no operator state which grows, and a late
message is judged by its identity, not by its time.

A re-scan is a stream of its own, which leaves the changes of each batch beside a ledger that stays as it is; ``finish_rescan`` then
writes the next generation of the ledger.  Readers take the last complete generation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from khata.operators.categories import resolve_categories
from khata.operators.dedup import dedup, drop_repeated_messages
from khata.operators.ingest import fresh_parse, parsed_once
from khata.operators.merge import KEY, merge_ledger
from khata.session import cut_lineage
from khata.sources.readers import MESSAGES
from khata.streaming.identities import FAN, Identities, complete

Rungs = Callable[[SparkSession], dict[str, DataFrame]]
COUNTERS = ["scanned", "parsed", "rejected", "duplicates", "written", "updated"]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def stored_ledger(spark: SparkSession, ledger_path: str, before_batch: int | None = None) -> DataFrame | None:
    """Rows written by batches, or None when there are none yet."""
    rows = _read(spark, ledger_path)
    return rows if rows is None or before_batch is None else rows.where(F.col("batch") < before_batch)


def _write_counters(parts: dict[str, DataFrame], folder: str) -> None:
    """Rows by inbox under the names of counters, as they add up over batches."""
    zero = F.lit(0).cast("bigint")
    rows = [df.groupBy("inbox_id").agg(F.count("*").alias("n")).select("inbox_id", *[(F.col("n") if c == name else zero).alias(c) for c in COUNTERS]) for name, df in parts.items()]
    sums = reduce(DataFrame.unionByName, rows).groupBy("inbox_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    sums.withColumn("rejected", F.col("scanned") - F.col("parsed")).withColumn(
        "duplicates", F.col("parsed") - F.col("written")
    ).write.mode("overwrite").parquet(folder)


def known_identities(spark: SparkSession, ledger_path: str, batch_id: int | None, txns: DataFrame, fan: int = FAN) -> DataFrame:
    """What the ledger holds with the inbox and amount of some rows: of batches before ``batch_id`` (None: of all), and of finished re-scans."""
    imported = Identities(spark, f"{ledger_path}-identities", fan)
    known = imported.before(imported.batches() if batch_id is None else batch_id, txns)
    for generation in range(1, last_generation(spark, ledger_path) + 1):
        added = Identities(spark, f"{_changes(ledger_path, generation)}-identities")
        known = known.unionByName(added.before(added.batches(), txns))
    return known


def merge_batch(batch: DataFrame, batch_id: int, ledger_path: str, tz: str, rungs: Rungs | None = None, fan: int = FAN) -> None:
    """Writes the new rows of one batch, their identities and the batch's counters; doing it again changes nothing."""
    spark = batch.sparkSession
    extra = rungs(spark) if rungs is not None else {}
    txns = parsed_once(batch, tz)
    known = known_identities(spark, ledger_path, batch_id, txns, fan)
    rows = resolve_categories(dedup(txns, known, same_amount=True), **extra)
    folder = f"{ledger_path}/batch={batch_id}"
    rows.write.mode("overwrite").parquet(folder)
    # from here on the batch's rows are read from what was written
    rows = spark.read.schema(rows.schema).parquet(folder)
    Identities(spark, f"{ledger_path}-identities", fan).add(batch_id, rows)
    _write_counters({"scanned": drop_repeated_messages(batch), "parsed": txns, "written": rows}, f"{ledger_path}-counters/batch={batch_id}")


def stored_counters(spark: SparkSession, ledger_path: str) -> DataFrame | None:
    """Per inbox: scanned, parsed, rejected, duplicates, written and updated, summed over all batches."""
    rows = _read(spark, f"{ledger_path}-counters")
    return None if rows is None else rows.groupBy("inbox_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def _started(spark: SparkSession, source_dir: str, checkpoint: str, fmt: str, files_per_batch: int | None, available_now: bool,
             handle: Callable[[DataFrame, int], object]) -> StreamingQuery:
    reader = spark.readStream.format(fmt).schema(MESSAGES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = reader.load(source_dir).writeStream.foreachBatch(lambda df, batch_id: handle(df, batch_id)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_ingest(spark: SparkSession, source_dir: str, ledger_path: str, checkpoint: str, tz: str,
                 rungs: Rungs | None = None, fmt: str = "parquet", files_per_batch: int | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Starts the ingest of a folder of message files.

    ``available_now`` reads what is there and stops: a backfill.  ``rungs`` gives the decision,
    prior and prediction tables as they are when a batch begins.
    """
    return _started(spark, source_dir, checkpoint, fmt, files_per_batch, available_now,
                    lambda df, batch_id: merge_batch(df, batch_id, ledger_path, tz, rungs))


# --- re-scan -----------------------------------------------------------------------------------------

def _rows(ledger_path: str, generation: int) -> str:
    return f"{ledger_path}-generations/rows-{generation}"


def _changes(ledger_path: str, generation: int) -> str:
    return f"{ledger_path}-generations/changes-{generation}"


def last_generation(spark: SparkSession, ledger_path: str) -> int:
    """The last complete generation; generation 0 is what the import has written."""
    number = 0
    while complete(spark, _rows(ledger_path, number + 1)):
        number += 1
    return number


def current_ledger(spark: SparkSession, ledger_path: str) -> DataFrame | None:
    """Rows of the last generation, and those which were imported after it."""
    number, imported = last_generation(spark, ledger_path), stored_ledger(spark, ledger_path)
    if not number or imported is None:
        return imported if imported is None else imported.drop("batch")
    rows = spark.read.parquet(_rows(ledger_path, number))
    # the number of batches which the generation holds is the same on all its rows
    first = rows.select("batches").first()
    later = imported if first is None else imported.where(F.col("batch") >= first["batches"])
    return rows.drop("batches", "change").unionByName(later.drop("batch"))


def rescan_batch(batch: DataFrame, batch_id: int, ledger_path: str, tz: str, rungs: Rungs | None = None) -> None:
    """Parses a batch anew and leaves what the next generation takes of it: rows for stored payments, and rows the ledger doesn't know.

    Only identities are read for it, not the ledger.
    """
    spark = batch.sparkSession
    base = _changes(ledger_path, last_generation(spark, ledger_path) + 1)
    index = Identities(spark, f"{base}-identities")
    extra = rungs(spark) if rungs is not None else {}
    txns = parsed_once(batch, tz)
    known = cut_lineage(known_identities(spark, ledger_path, None, txns))
    new = cut_lineage(dedup(txns, known.unionByName(index.before(batch_id, txns)), same_amount=True))
    rows = fresh_parse(txns, known).unionByName(new.select(*txns.columns))
    resolve_categories(rows, **extra).write.mode("overwrite").parquet(f"{base}/batch={batch_id}")
    index.add(batch_id, new)
    _write_counters({"scanned": drop_repeated_messages(batch), "parsed": txns, "written": new}, f"{base}-counters/batch={batch_id}")


def start_rescan(spark: SparkSession, source_dir: str, ledger_path: str, checkpoint: str, tz: str, rungs: Rungs | None = None,
                 fmt: str = "parquet", files_per_batch: int | None = None) -> StreamingQuery:
    """Starts a re-scan of a folder of message files into the next generation; ``finish_rescan`` ends it."""
    return _started(spark, source_dir, checkpoint, fmt, files_per_batch, True, lambda df, batch_id: rescan_batch(df, batch_id, ledger_path, tz, rungs))


def finish_rescan(spark: SparkSession, ledger_path: str) -> DataFrame | None:
    """Writes the next generation and returns it with the column ``change``; None if no re-scan has left anything.

    Of several rows for one payment the one from the newest message counts.  The new generation counts once it is written to its end.
    """
    number, stored = last_generation(spark, ledger_path) + 1, current_ledger(spark, ledger_path)
    base = _changes(ledger_path, number)
    changes = _read(spark, base)
    if changes is None or stored is None:
        return None
    row = F.struct(*[c for c in stored.columns if c not in KEY])
    newest = changes.groupBy(*KEY).agg(F.max_by(row, F.struct("sms_date_ms", -F.col("sms_id"))).alias("row")).select(*KEY, "row.*").select(*stored.columns)
    batches = Identities(spark, f"{ledger_path}-identities").batches()
    merged = merge_ledger(stored, newest, reprocess=True).withColumn("batches", F.lit(batches))
    # counters first: the generation is complete when its rows are
    merged = cut_lineage(merged)
    _write_counters({"updated": merged.where("change = 'updated'")}, f"{base}-counters/batch=-1")
    merged.write.mode("overwrite").parquet(_rows(ledger_path, number))
    return spark.read.parquet(_rows(ledger_path, number)).drop("batches")


def rescan_counters(spark: SparkSession, ledger_path: str, generation: int) -> DataFrame | None:
    """Counters of the re-scan which made a generation, per inbox; a payment is ``updated`` once."""
    return stored_counters(spark, _changes(ledger_path, generation))
