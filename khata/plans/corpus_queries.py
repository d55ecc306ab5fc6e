"""Queries over text corpora: redaction, leaks, templates; and the streaming import."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from khata.functions import fixed_values as V
from khata.operators import privacy, templates
from khata.plans import views
from khata.plans.message_queries import DUPS, MIXED, RENDERED, REPROCESSED, TZ, partly_stored, walk
from khata.plans.registry import query
from khata.session import shared_folder
from khata.streaming.identities import Identities
from khata.streaming.ingest import (
    finish_rescan, rescan_counters, start_ingest, start_rescan, stored_counters, stored_ledger,
)

SALT, SHIFT = "pepper", 500

# what redaction makes of the rendered messages, put together from their parts
REDACTED = f"""{RENDERED}, masked AS (
    SELECT inbox_id, id, event_type, regexp_replace(amt, '[0-9]', '9', 'g') AS nines,
      strftime(due + INTERVAL {SHIFT} DAY, '%d-%m-%y') AS moved, k,
      'VPA_' || translate(left(sha256('{SALT}VPA' || 'store' || k), 24), '0123456789', 'abcdefabcd') AS handle,
      'PERSON_' || translate(left(sha256('{SALT}PERSON' || 'acme' || k || ' corp'), 24), '0123456789', 'abcdefabcd') AS person FROM rendered),
  redacted AS (
    SELECT inbox_id, id, event_type, CASE
      WHEN event_type IN ('purchase', 'click')
        THEN 'Rs.' || nines || ' debited from a/c XX9999 on ' || moved || ' to VPA ' || handle || '@ybl. Ref 99999999999999'
      WHEN event_type = 'signup'
        THEN 'Rs.' || nines || ' credited to a/c XX9999 on ' || moved || ' by NEFT from ACME' || k || ' CORP. Ref 99999999999999'
      WHEN event_type = 'error'
        THEN 'Rs.' || nines || ' credited to a/c XX9999 on ' || moved || '. Refund from STORE' || k || '. Ref 99999999999999'
      ELSE 'Rs.' || nines || ' debited from a/c XX9999 on ' || moved || ' towards HDFC Credit Card payment. Ref 99999999999999'
      END AS body FROM masked)"""


@query("redact", f"WITH {REDACTED} SELECT inbox_id, id, body FROM redacted")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.redact(views.messages_rendered(spark, sf), "body", SALT, SHIFT, counts=False).select(
        "inbox_id", "id", "body")


@query("redaction_counts", f"""WITH {REDACTED}, kinds AS (
      SELECT inbox_id, id, unnest(CASE WHEN event_type IN ('purchase', 'click')
        THEN ['phone', 'account', 'masked_tail', 'reference', 'long_id', 'amount', 'date', 'vpa']
        ELSE ['phone', 'account', 'masked_tail', 'reference', 'long_id', 'amount', 'date'] END) AS what FROM redacted)
    SELECT inbox_id, what, count(*) AS times FROM kinds GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    done = privacy.redact(views.messages_rendered(spark, sf), "body", SALT, SHIFT)
    return done.select("inbox_id", F.explode("replaced").alias("what", "times")).groupBy("inbox_id", "what").agg(
        F.sum("times").alias("times"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return views.spread(views.table(spark, sf, "documents"))


@query("redact_documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.redact(_documents(spark, sf), "text", SALT, SHIFT).select(
        "doc_id", "text", F.array_join(F.transform(F.sort_array(F.map_entries("replaced")), lambda e: F.concat_ws(
            "=", e["key"], e["value"])), ",").alias("replaced"))


@query("redact_corpus")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk rules over conversations; the role stands for the sender."""
    rows = views.spread(views.table(spark, sf, "conversations")).select(
        "conv_id", "turn", F.col("role").alias("address"), F.col("text").alias("body"))
    return privacy.redact_corpus(rows, SALT, SHIFT, counts=False)


_CLEAN = "regexp_matches(trim(h), '^(?:[9X]+|REDACTED[^\\s]*)$') OR regexp_matches(trim(h), '^[9X*x\\s./-]+$')"


def _leak(label: str, pattern: str, group: int = 0) -> str:
    return (f"SELECT doc_id, '{label}' AS leak FROM documents "
            f"WHERE len(list_filter(regexp_extract_all(text, '{pattern}', {group}), lambda h: NOT ({_CLEAN}))) > 0")


LEAKY = f"""leaky AS (
    {_leak('an email address', '\\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]{2,}\\b')}
    UNION ALL {_leak('a phone number', '(?:^|[^0-9])((?:\\+91[-\\s]?)?[6-9][0-9]{9})(?:$|[^0-9])', 1)}
    UNION ALL {_leak('a long digit run', '[0-9]{11,}')}
    UNION ALL {_leak('a PAN', '\\b[A-Z]{5}[0-9]{4}[A-Z]\\b')}
    UNION ALL {_leak('an IFSC code', '\\b[A-Z]{4}0[A-Z0-9]{6}\\b')}
    UNION ALL {_leak('a live link', 'https?://[^\\s]{6,}')}
    UNION ALL {_leak('an unmasked amount', '(?i)(?:INR|Rs\\.?|₹)\\s*[0-9]*[1-8][0-9]*')})"""


@query("leak_counts", f"WITH {LEAKY} SELECT leak, count(*) AS rows FROM leaky GROUP BY leak")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.leak_counts(_documents(spark, sf), "text")


@query("find_leaks", f"""WITH {LEAKY}
    SELECT doc_id, string_agg(leak, ',' ORDER BY leak) AS warnings FROM leaky GROUP BY doc_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.find_leaks(_documents(spark, sf), "text").select(
        "doc_id", F.array_join(F.sort_array("warnings"), ",").alias("warnings"))


@query("leaks_after_redaction")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.leak_counts(privacy.redact(_documents(spark, sf), "text", SALT, SHIFT, counts=False), "text")


# --- templates -------------------------------------------------------------------------------------

def _shape_sql(column: str) -> str:
    expr = column
    for pattern, mark in V.SHAPE_STEPS:
        expr = f"regexp_replace({expr}, '{pattern}', '{mark}', 'g')"
    return f"trim({expr})"


SHAPED = f"shaped AS (SELECT *, {_shape_sql('text')} AS shape FROM documents)"
MINED = f"""{SHAPED}, clusters AS (
    SELECT shape, count(*) AS n, count(DISTINCT source) AS senders, arg_min(text, doc_id) AS example FROM shaped GROUP BY shape),
  mined AS (
    SELECT row_number() OVER w AS rank, shape, n,
      CAST(floor(sum(n) OVER w * 100 / sum(n) OVER ()) AS BIGINT) AS cumulative_pct, senders, example
    FROM clusters WINDOW w AS (ORDER BY n DESC, shape ROWS UNBOUNDED PRECEDING))"""


@query("message_shape", f"WITH {SHAPED} SELECT doc_id, shape FROM shaped")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return templates.shapes(_documents(spark, sf), "text").select("doc_id", "shape")


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    return templates.mine_templates(_documents(spark, sf), "text", "source", "doc_id", force=True)


@query("mine_templates", f"WITH {MINED} SELECT * FROM mined")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _mined(spark, sf)


@query("top_templates", f"WITH {MINED} SELECT rank, shape, n, cumulative_pct FROM mined WHERE rank <= 60")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return templates.top_templates(_mined(spark, sf)).select("rank", "shape", "n", "cumulative_pct")


@query("long_tail", f"""WITH {MINED} SELECT CAST(sum(n) FILTER (rank <= 60) AS BIGINT) AS covered,
    CAST(sum(n) FILTER (rank > 60) AS BIGINT) AS tail, count(*) AS templates FROM mined""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return templates.long_tail(_mined(spark, sf))


@query("template_senders", f"""WITH {SHAPED}, counts AS (SELECT shape, source AS sender, count(*) AS n FROM shaped GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY shape ORDER BY n DESC, sender) AS rank FROM counts QUALIFY rank <= 5""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return templates.template_senders(_documents(spark, sf), "text", "source")


@query("message_templates", f"""WITH {MIXED}, shapes AS (
      SELECT id, CASE sort WHEN 0 THEN 'Rs.<AMT> debited from a/c <ACCT> on <DATE> to VPA store' || k || '@ybl. Ref ' || ref
        WHEN 1 THEN 'Your OTP is <REF> for txn of Rs.<AMT>. Do not share.'
        WHEN 2 THEN 'Avl bal in a/c <ACCT> is Rs.<AMT> as on <DATE>.'
        WHEN 3 THEN 'FLAT <N>% off! Shop now and save Rs <AMT>. Click here to begin.'
        WHEN 4 THEN 'Your HDFC Credit Card <ACCT> bill of Rs.<AMT> is due on <DATE>. Minimum amount due Rs.<N>.'
        WHEN 5 THEN 'Order ' || ref || ' placed. Your parcel will arrive on <DATE>'
        WHEN 6 THEN 'Reached home at <N>, speak later' WHEN 7 THEN 'You have won a lottery of Rs <AMT>. Claim now.'
        WHEN 8 THEN 'Payee P' || k || ' added. Transfer funds after <N> mins.'
        WHEN 9 THEN 'Your account <ACCT> was settled at branch <N>'
        WHEN 10 THEN 'Rs.<AMT> payment returned on <DATE> for card <ACCT>. Make alternate pymt.'
        ELSE 'Weather note number <N>' END AS shape FROM placed)
    SELECT shape, count(*) AS n FROM shapes GROUP BY shape""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return templates.mine_templates(views.messages_mixed(spark, sf), force=True).select("shape", "n")


# --- streaming -------------------------------------------------------------------------------------

def _batches() -> str:
    """Three overlapping batches of reports: ``kept0``, ``kept1`` and ``kept2`` are the rows which each of them writes."""
    parts = {0: "0, 1, 2", 1: "2, 3", 2: "3, 4, 0"}
    out, held = [], ""
    for n, rest in parts.items():
        fresh = f"SELECT r.* FROM reports r WHERE r.sms_id % 5 IN ({rest})"
        if held:
            fresh += f""" AND NOT EXISTS (SELECT 1 FROM ({held}) h WHERE h.inbox_id = r.inbox_id AND h.whole = r.whole
              AND h.fingerprint = r.fingerprint) AND NOT EXISTS (SELECT 1 FROM ({held}) h WHERE h.inbox_id = r.inbox_id
              AND h.whole = r.whole AND h.shop = r.shop AND h.due = r.due)"""
        out.append(f"batch{n} AS ({fresh}), {walk(f'batch{n}', f'kept{n}')}")
        held += f"{' UNION ALL ' if held else ''}SELECT batch{n}.* FROM batch{n} JOIN kept{n} USING (inbox_id, sms_id)"
    return ", ".join(out)


# reports without the whole-table walk behind them
BATCHES = f"""{DUPS[:DUPS.index("kept_ordered AS (")]}{_batches()}"""


def _streamed(spark: SparkSession, messages: list[DataFrame], base: str, start: Callable[[str, str], StreamingQuery]) -> None:
    """Runs a stream once after each part of the messages has come."""
    for n, part in enumerate(messages):
        part.write.parquet(f"{base}/in/part={n}")
        start(f"{base}/in/*", f"{base}/progress").awaitTermination()


def _imported(spark: SparkSession, sf: str) -> str:
    """The folder of a ledger which a stream has made of three overlapping batches."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    messages = views.messages_dups(spark, sf)
    parts = [messages.where(f"id % 5 IN ({rest})") for rest in ("0, 1, 2", "2, 3", "3, 4, 0")]
    _streamed(spark, parts, base, lambda source, progress: start_ingest(spark, source, f"{base}/ledger", progress, TZ))
    return f"{base}/ledger"


@query("stream_ingest", f"""WITH {BATCHES} SELECT CAST(batch AS BIGINT) AS batch, inbox_id, sms_id, CAST(whole AS DOUBLE) AS amount
    FROM (SELECT 0 AS batch, * FROM kept0 UNION ALL SELECT 1, * FROM kept1 UNION ALL SELECT 2, * FROM kept2)
    JOIN reports USING (inbox_id, sms_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of files which overlap; every row is judged by the rows which earlier batches accepted."""
    return stored_ledger(spark, _imported(spark, sf)).select(F.col("batch").cast("bigint").alias("batch"), "inbox_id", "sms_id", "amount")


@query("stream_counters", f"""WITH {BATCHES}, scans AS (
      SELECT inbox_id, sms_id FROM batch0 UNION ALL SELECT inbox_id, sms_id FROM reports WHERE sms_id % 5 IN (2, 3)
      UNION ALL SELECT inbox_id, sms_id FROM reports WHERE sms_id % 5 IN (3, 4, 0)),
    kept AS (SELECT * FROM kept0 UNION ALL SELECT * FROM kept1 UNION ALL SELECT * FROM kept2),
    seen AS (SELECT inbox_id, count(*) AS n FROM scans GROUP BY 1), done AS (SELECT inbox_id, count(*) AS n FROM kept GROUP BY 1)
    SELECT inbox_id, seen.n AS scanned, seen.n AS parsed, CAST(0 AS BIGINT) AS rejected, seen.n - coalesce(done.n, 0) AS duplicates,
      coalesce(done.n, 0) AS written, CAST(0 AS BIGINT) AS updated FROM seen LEFT JOIN done USING (inbox_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """What each inbox has seen over the three batches."""
    return stored_counters(spark, _imported(spark, sf))


def _rescanned(spark: SparkSession, sf: str) -> str:
    """The folder of a ledger with two thirds of the rows, some corrected by hand and some stale, after a re-scan in two batches."""
    base = f"{shared_folder(spark)}/rescan-{uuid.uuid4().hex}"
    messages, stored = partly_stored(spark, sf)
    stored.write.parquet(f"{base}/ledger/batch=0")
    Identities(spark, f"{base}/ledger-identities").add(0, spark.read.parquet(f"{base}/ledger/batch=0"))
    parts = [messages.where("id % 2 = 0"), messages.where("id % 2 = 1 OR id % 3 = 0")]
    _streamed(spark, parts, base, lambda source, progress: start_rescan(spark, source, f"{base}/ledger", progress, TZ))
    return f"{base}/ledger"


@query("stream_reprocess", REPROCESSED)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A re-scan as a stream, and the generation of the ledger which it makes."""
    return finish_rescan(spark, _rescanned(spark, sf)).select("inbox_id", "sms_id", "kind", "change")


@query("stream_reprocess_counters", f"""WITH done AS ({REPROCESSED}), sums AS (
      SELECT inbox_id, count(*) AS n, count(*) FILTER (sms_id % 6 = 0) AS twice, count(*) FILTER (change = 'added') AS written,
        count(*) FILTER (change = 'updated') AS updated FROM done GROUP BY inbox_id)
    SELECT inbox_id, n + twice AS scanned, n + twice AS parsed, CAST(0 AS BIGINT) AS rejected, n + twice - written AS duplicates,
      written, updated FROM sums""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ledger = _rescanned(spark, sf)
    finish_rescan(spark, ledger)
    return rescan_counters(spark, ledger, 1)
