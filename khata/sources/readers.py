"""Message readers: XML backups, CSV with varying headers, JSON lines, text blocks, tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.StructType([
    T.StructField("inbox_id", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("date_ms", T.LongType()),
    T.StructField("address", T.StringType()),
])

# fixed values: header names of a CSV export, and the sender line of a text block
ADDRESS_NAMES = ("address", "from", "sender")
BODY_NAMES = ("body", "message", "text")
DATE_NAMES = ("date", "timestamp")
BLOCK_HEADER = r"^([A-Z]{2}-[A-Z0-9\-]+)\s*(?:::|\|)?\s*(.*)$"


def _corpus(address: Column, body: Column, date: Column) -> list[Column]:
    empty = F.lit("")
    return [
        F.coalesce(address, empty).alias("address"), F.coalesce(body, empty).alias("body"),
        F.coalesce(date.try_cast("bigint"), F.lit(0)).alias("date_ms"),
    ]


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Backup files of <sms address body date/> elements."""
    schema = "_address string, _body string, _date string"
    rows = spark.read.format("xml").option("rowTag", "sms").schema(schema).load(path)
    return rows.select(*_corpus(F.col("_address"), F.col("_body"), F.col("_date")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; names are matched without case and outer blanks, first filled one wins."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    by_name: dict[str, str] = {}
    for name in rows.columns:
        by_name[name.strip().lower()] = name

    def first_filled(names: tuple[str, ...]) -> Column:
        cols = [F.nullif(F.col(f"`{by_name[n]}`"), F.lit("")) for n in names if n in by_name]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    return rows.select(*_corpus(first_filled(ADDRESS_NAMES), first_filled(BODY_NAMES), first_filled(DATE_NAMES)))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with address, body and date; blank lines are skipped, broken ones too."""
    schema = "address string, body string, date string, _broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where(F.col("_broken").isNull()).select(*_corpus(F.col("address"), F.col("body"), F.col("date")))


def read_txt(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """Blocks parted by blank lines; the first line may name the sender.

    The reader splits at blank lines itself, so a large file is not read as one value but by as many tasks as it has splits.
    Without ``line_end`` the first line tells which one it is; lines of only blanks and the other line end part blocks as well.
    """
    if line_end is None:
        first = spark.read.option("lineSep", "\n").text(path).first()
        line_end = "\r\n" if first is not None and first["value"].endswith("\r") else "\n"
    chunks = spark.read.option("lineSep", 2 * line_end).text(path)
    blocks = chunks.select(F.explode(F.split("value", r"\r?\n[ \t\r]*\n")).alias("block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda line: F.trim(line) != "")
    head = F.trim(F.get("lines", F.lit(0)))
    sender = F.regexp_extract(head, BLOCK_HEADER, 1)
    first = F.regexp_extract(head, BLOCK_HEADER, 2)
    rest = F.slice("lines", F.lit(2), F.size("lines"))
    body = F.when(sender == "", F.col("lines")).otherwise(
        F.concat(F.filter(F.array(first), lambda x: x != ""), rest)
    )
    return (
        blocks.withColumn("lines", lines).where(F.size("lines") > 0)
        .withColumn("_body", body).where(F.size("_body") > 0)
        .select(*_corpus(sender, F.array_join("_body", "\n"), F.lit("0")))
    )


READERS = {".xml": read_xml, ".csv": read_csv, ".jsonl": read_jsonl, ".json": read_jsonl, ".txt": read_txt}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """address, body and date_ms of an export, by file extension."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in READERS:
        raise ValueError(f"unsupported file type '{ext}': use {', '.join(READERS)}")
    return READERS[ext](spark, path)


def as_messages(corpus: DataFrame, inbox_id: str) -> DataFrame:
    """Corpus rows as messages of one inbox, all of them.

    The id is a hash of the row and of its number among equal rows, so it is the same on every read.  Equal rows are
    counted before the shuffle and numbered afterwards.
    """
    row = ["address", "body", "date_ms"]
    numbered = corpus.groupBy(*row).agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return numbered.select(F.lit(inbox_id).alias("inbox_id"), F.xxhash64(*row, "k").alias("id"), "body", "date_ms", "address")


def scan_messages(messages: DataFrame, before: int | None = None, since: int | None = None,
                  limit: int | None = None) -> DataFrame:
    """Messages before and after given times; a limit keeps the newest ones, newest first."""
    bounds = []
    if before is not None:
        bounds.append(F.col("date_ms") < before)
    if since is not None:
        bounds.append(F.col("date_ms") > since)
    rows = messages.where(reduce(lambda a, b: a & b, bounds)) if bounds else messages
    return rows if limit is None else rows.orderBy(F.desc("date_ms"), "inbox_id", "id").limit(limit)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_ledger_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Ledger rows of a JSON export; an unreadable row is left out."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", schema).alias("row")).where(F.col("row.fingerprint").isNotNull())
    return parsed.select("row.*")
