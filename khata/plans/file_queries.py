"""Queries which write a file format and read it back, beside others whose cases the rendered tables alone don't have."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.operators import bills, categories, drift, privacy, review, templates
from khata.plans import views
from khata.plans.corpus_queries import MINED, REDACTED, SALT, SHIFT
from khata.plans.form_queries import BODIES, messages_of_forms
from khata.plans.message_queries import DRIFT, MARKED, TZ, booked, classified, marked_bills
from khata.plans.registry import query
from khata.plans.report_queries import GROUP_COLUMNS, GROUPS
from khata.plans.sql_views import LEDGER, PARTS
from khata.session import shared_folder
from khata.sources import readers, writers

#: Messages of all forms, some with line breaks and signs beyond ASCII, as an export has them.
EXPORT = f"WITH {BODIES} SELECT address, body, date_ms FROM bodies"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _back(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_corpus(spark, path).select("address", "body", "date_ms")


@query("read_xml", f"WITH {BODIES} SELECT address, replace(body, chr(10), ' ') AS body, date_ms FROM bodies")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A backup; line breaks are blanks in an attribute."""
    path = f"{_folder(spark)}/backup.xml"
    rows = messages_of_forms(spark, sf).select(F.col("address").alias("_address"), F.col("body").alias("_body"), F.col("date_ms").alias("_date"))
    rows.write.format("xml").option("rootTag", "smses").option("rowTag", "sms").save(path)
    return _back(spark, path).withColumn("body", F.replace("body", F.lit("\n"), F.lit(" ")))


@query("read_csv", EXPORT)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/export.csv"
    rows = messages_of_forms(spark, sf).select(F.col("date_ms").alias("Timestamp"), F.col("address").alias(" From "), F.col("body").alias("MESSAGE"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return _back(spark, path)


@query("read_jsonl", EXPORT)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/export.jsonl"
    messages_of_forms(spark, sf).select("address", "body", F.col("date_ms").alias("date")).write.json(path)
    return _back(spark, path)


def _blocks(spark: SparkSession, sf: str, end: str) -> DataFrame:
    """Blocks of a sender line and a body, with one line end or another."""
    path = f"{_folder(spark)}/blocks.txt"
    block = F.concat_ws("\n", F.concat("address", F.lit(" ::")), "body", F.lit(""))
    messages_of_forms(spark, sf).select(F.replace(block, F.lit("\n"), F.lit(end)).alias("value")).write.option("lineSep", end).text(path)
    return _back(spark, path).select("address", "body")


@query("read_text_blocks", f"WITH {BODIES} SELECT address, body FROM bodies")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf, "\n")


@query("read_text_blocks_crlf", f"WITH {BODIES} SELECT address, body FROM bodies")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf, "\r\n")


@query("ledger_json", f"WITH {REDACTED} SELECT inbox_id, id AS sms_id, kind, CAST(amount AS DOUBLE) AS amount, merchant, body AS raw FROM booked")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger exported as JSON and loaded again."""
    path, ledger = _folder(spark), booked(spark, sf)
    writers.export_json(ledger, ledger.limit(0), path)
    return readers.read_ledger_json(spark, f"{path}/transactions", ledger.schema).select("inbox_id", "sms_id", "kind", "amount", "merchant", "raw")


@query("ledger_by_month", f"""WITH {LEDGER} SELECT inbox_id, sms_id, strftime(date, '%Y-%m') AS month, CAST(amount AS DOUBLE) AS amount FROM ledger""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    writers.write_ledger(views.ledger(spark, sf), path)
    return readers.read_ledger(spark, path).select("inbox_id", "sms_id", F.col("month").cast("string").alias("month"), "amount")


@query("redacted_jsonl", f"WITH {REDACTED} SELECT 'AX-HDFCBK' AS address, redacted.body, date_ms FROM redacted JOIN parts USING (inbox_id, id)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_folder(spark)}/redacted.jsonl"
    writers.write_corpus(privacy.redact(views.messages_rendered(spark, sf), "body", SALT, SHIFT, counts=False), path)
    return _back(spark, path)


@query("template_list", f"""WITH {MINED}, counts AS (SELECT shape, source AS sender, count(*) AS n FROM shaped GROUP BY ALL),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY n DESC, sender) AS place FROM counts QUALIFY place <= 5),
    listed AS (SELECT shape, string_agg(sender || '=' || n, ',' ORDER BY place) AS senders FROM firsts GROUP BY shape)
    SELECT rank, shape, mined.n, example, listed.senders FROM mined JOIN listed USING (shape)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path, docs = _folder(spark), views.spread(views.table(spark, sf, "documents"))
    mined = templates.mine_templates(docs, "text", "source", "doc_id", force=True)
    writers.write_templates(mined, templates.template_senders(docs, "text", "source"), path)
    kind = "rank bigint, shape string, n bigint, example string, senders array<struct<rank: bigint, sender: string, n: bigint>>"
    shown = F.transform("senders", lambda s: F.concat_ws("=", s["sender"], s["n"]))
    return spark.read.schema(kind).json(path).withColumn("senders", F.array_join(shown, ","))


@query("drift_text", f"""WITH {DRIFT}, said AS (
      SELECT unnest(['build  : 7', 'sender : ' || regexp_replace(sender, '^[A-Z]{{2}}-', ''), 'reason : ' || reason, 'seen   : ' || n || '×']) AS line FROM rolled)
    SELECT line, count(*) AS times FROM said GROUP BY line""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of written drift reports but those of the bodies."""
    path = _folder(spark)
    report = drift.drift_report(drift.drift_rollup(drift.detect_drift(classified(spark, sf))), SALT, SHIFT)
    writers.write_drift_report(drift.report_text(report, "7"), path)
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.col("line").rlike("^(build  |sender |reason |seen   ): "))
    return lines.groupBy("line").agg(F.count("*").alias("times"))


@query("redact_corpus_of_messages", f"""WITH {REDACTED} SELECT redacted.inbox_id, id, 'HDFCBK' AS address,
      replace(replace(redacted.body, '99999999999999', '999999999999'), '99999999999999', '999999999999') AS body, date_ms
    FROM redacted JOIN parts USING (inbox_id, id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk rules over the rendered messages: a reference of letters and digits keeps its length."""
    return privacy.redact_corpus(views.messages_rendered(spark, sf), SALT, SHIFT, counts=False).select("inbox_id", "id", "address", "body", "date_ms")


@query("leak_gate", f"""WITH {PARTS} SELECT 'amount' AS leak, count(*) AS refused, CAST(0 AS BIGINT) AS after FROM parts
    WHERE regexp_matches(amt, '^[0-9]*[1-8]')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """How many messages the gate refuses for their amounts, before and after they are redacted."""
    messages = views.messages_rendered(spark, sf)

    def refused(df: DataFrame, name: str) -> DataFrame:
        return privacy.find_leaks(df, "body").where(F.array_contains("warnings", "an unmasked amount")).agg(F.count("*").alias(name))

    after = refused(privacy.redact(messages, "body", SALT, SHIFT, counts=False), "after")
    return refused(messages, "refused").join(F.broadcast(after)).select(F.lit("amount").alias("leak"), "refused", "after")


@query("add_decisions", """WITH stored AS (SELECT DISTINCT p_brand AS inbox_id, lower(p_type) AS merchant_key FROM part),
      new AS (SELECT DISTINCT p_brand AS inbox_id, lower(p_type) AS merchant_key FROM part WHERE p_size % 5 = 0
        UNION ALL SELECT DISTINCT p_brand, lower(p_name) FROM part)
    SELECT inbox_id, merchant_key, 'travel' AS category FROM new
    UNION ALL SELECT inbox_id, merchant_key, 'food' FROM stored ANTI JOIN new USING (inbox_id, merchant_key)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    part = views.table(spark, sf, "part")
    key = lambda c: F.struct(F.col("p_brand").alias("inbox_id"), F.lower(c).alias("merchant_key"))
    stored = part.select(key("p_type").alias("k")).distinct().select("k.*", F.lit("food").alias("category"))
    new = part.where("p_size % 5 = 0").select(key("p_type").alias("k")).distinct().unionByName(part.select(key("p_name").alias("k")).distinct())
    return categories.add_decisions(stored, new.select("k.*", F.lit("travel").alias("category")))


ONE_INBOX = LEDGER.replace("CAST(user_id AS VARCHAR) AS inbox_id", "'all' AS inbox_id")


@query("top_review_groups_of_all", f"""WITH {ONE_INBOX}, {GROUPS}
    SELECT {GROUP_COLUMNS}, row_number() OVER (PARTITION BY inbox_id ORDER BY groups.total DESC, group_key) AS rank
    FROM groups QUALIFY rank <= 25""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All inboxes as one, which has more groups than the report shows."""
    return review.top_review_groups(views.ledger(spark, sf).withColumn("inbox_id", F.lit("all")))


@query("bill_positions", f"""WITH {MARKED} SELECT inbox_id, fingerprint, row_number() OVER (PARTITION BY inbox_id
      ORDER BY CASE WHEN status = 'open' THEN 0 ELSE 1 END, due_date NULLS LAST, sms_id) AS position FROM marked""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bills.bill_positions(marked_bills(spark, sf)).select("inbox_id", "fingerprint", "position")
