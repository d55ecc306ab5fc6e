"""Queries over messages: extraction, inbox, bills, drift, import, pairs, tracing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.operators import (
    attention, bills, dedup, drift, extract, inbox, ingest, merge, pairs, templates, trace,
)
from khata.plans import views
from khata.plans.registry import query
from khata.plans.report_queries import NOW
from khata.plans.sql_views import LEDGER, PAIRS, PARTS, PENDING, trimmed

TZ = "UTC"

# --- extraction: messages are rendered from events, so their fields are known ----------------------

RENDERED = f"""{PARTS}, rendered AS (
    SELECT *, CASE WHEN event_type IN ('purchase', 'click') THEN 'expense' WHEN event_type = 'signup' THEN 'income'
        WHEN event_type = 'error' THEN 'refund' ELSE 'transfer' END AS kind,
      CASE WHEN event_type IN ('signup', 'error') THEN 'credit' ELSE 'debit' END AS direction,
      CASE WHEN event_type IN ('purchase', 'click') THEN 'store' || k WHEN event_type = 'signup' THEN 'ACME' || k || ' CORP'
        WHEN event_type = 'error' THEN 'STORE' || k END AS merchant,
      CASE WHEN event_type IN ('purchase', 'click') THEN 'upi' WHEN event_type = 'signup' THEN 'neft'
        WHEN event_type = 'error' THEN 'other' ELSE 'card' END AS channel,
      CASE WHEN event_type IN ('purchase', 'click')
          THEN 'Rs.' || amt || ' debited from a/c XX' || acc || ' on ' || day || ' to VPA store' || k || '@ybl. Ref ' || ref
        WHEN event_type = 'signup'
          THEN 'Rs.' || amt || ' credited to a/c XX' || acc || ' on ' || day || ' by NEFT from ACME' || k || ' CORP. Ref ' || ref
        WHEN event_type = 'error'
          THEN 'Rs.' || amt || ' credited to a/c XX' || acc || ' on ' || day || '. Refund from STORE' || k || '. Ref ' || ref
        ELSE 'Rs.' || amt || ' debited from a/c XX' || acc || ' on ' || day || ' towards HDFC Credit Card payment. Ref ' || ref
        END AS body
    FROM parts),
  booked AS (
    SELECT *, least(100, 40 + CASE WHEN merchant IS NULL THEN 0 ELSE 25 END + 15 + 10 + 10
      + CASE WHEN channel = 'other' THEN 0 ELSE 5 END) AS pct FROM rendered WHERE amount > 0)"""


def parsed_rendered(spark: SparkSession, sf: str) -> DataFrame:
    return extract.parse_messages(views.messages_rendered(spark, sf), TZ)


def booked(spark: SparkSession, sf: str) -> DataFrame:
    return extract.accepted(parsed_rendered(spark, sf))


@query("extract_transactions", f"""WITH {RENDERED}
    SELECT inbox_id, id AS sms_id, direction, kind, CAST(amount AS DOUBLE) AS amount, 'INR' AS currency, acc AS account,
      merchant, CASE WHEN merchant IS NOT NULL THEN 'named' END AS merchant_quality, ref, channel,
      CAST(due AS VARCHAR) AS day, CAST(epoch_ms(due) AS BIGINT) AS date_ms, 'HDFC' AS bank, 'HDFCBK' AS sender_id,
      CASE WHEN kind = 'transfer' THEN 'transfer' END AS category, CAST(pct AS BIGINT) AS confidence_pct,
      pct < 60 AS needs_review, 'r:' || ref || ':' || {trimmed('amount')} AS fingerprint, body AS raw FROM booked""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return booked(spark, sf).select(
        "inbox_id", "sms_id", "direction", "kind", "amount", "currency", "account", "merchant", "merchant_quality",
        "ref", "channel", F.to_date("date").alias("day"), "date_ms", "bank", "sender_id", "category",
        "confidence_pct", "needs_review", "fingerprint", "raw")


@query("soft_keys", f"""WITH {RENDERED}, tokens AS (
      SELECT *, CAST(floor(epoch_ms(due) / 600000) AS BIGINT) AS bucket, lower(split_part(merchant, ' ', 1)) AS token,
        direction || ':' || {trimmed('amount')} AS head FROM booked)
    SELECT inbox_id, id AS sms_id, CASE WHEN merchant IS NULL THEN 'nomerchant:' || id
      ELSE head || ':' || bucket || ':' || token || '|' || head || ':' || (bucket - 1) || ':' || token END AS soft_keys
    FROM tokens""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return booked(spark, sf).select("inbox_id", "sms_id", F.array_join("soft_keys", "|").alias("soft_keys"))


MIXED = f"""{PARTS}, mixed AS (
    SELECT *, CAST(id % 12 AS INT) AS sort, CASE CAST(id % 12 AS INT)
      WHEN 0 THEN 'Rs.' || amt || ' debited from a/c XX' || acc || ' on ' || day || ' to VPA store' || k || '@ybl. Ref ' || ref
      WHEN 1 THEN 'Your OTP is ' || (100000 + id % 899999) || ' for txn of Rs.' || amt || '. Do not share.'
      WHEN 2 THEN 'Avl bal in a/c XX' || acc || ' is Rs.' || amt || ' as on ' || day || '.'
      WHEN 3 THEN 'FLAT ' || k || '% off! Shop now and save Rs ' || amt || '. Click here to begin.'
      WHEN 4 THEN 'Your HDFC Credit Card XX' || acc || ' bill of Rs.' || amt || ' is due on ' || day || '. Minimum amount due Rs.10.'
      WHEN 5 THEN 'Order ' || ref || ' placed. Your parcel will arrive on ' || day
      WHEN 6 THEN 'Reached home at ' || k || ', speak later'
      WHEN 7 THEN 'You have won a lottery of Rs ' || amt || '. Claim now.'
      WHEN 8 THEN 'Payee P' || k || ' added. Transfer funds after 30 mins.'
      WHEN 9 THEN 'Your account XX' || acc || ' was settled at branch ' || k
      WHEN 10 THEN 'Rs.' || amt || ' payment returned on ' || day || ' for card XX' || acc || '. Make alternate pymt.'
      ELSE 'Weather note number ' || k END AS body,
    CASE CAST(id % 12 AS INT) WHEN 6 THEN '+9198765' || lpad(CAST(k AS VARCHAR), 5, '0') WHEN 11 THEN 'AX-WEATHR'
      ELSE 'AX-HDFCBK' END AS address FROM parts),
  placed AS (
    SELECT *,
      CASE WHEN sort = 0 AND amount > 0 THEN NULL ELSE ['no-amount', 'otp', 'balance', 'promo', 'no-direction',
        'no-direction', 'no-direction', 'no-direction', 'payee', 'no-direction', 'returned', 'no-direction'][sort + 1] END AS reason,
      ['transactions', 'updates', 'updates', 'promotions', 'bills', 'updates', 'personal', 'spam', 'updates',
        'updates', 'bills', 'updates'][sort + 1] AS tab,
      ['expense', 'otp', 'service', 'offer', 'bill', 'delivery', 'person', 'junk', 'service', 'bank-other', 'bill',
        'other'][sort + 1] AS subtype FROM mixed)"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return inbox.classify_inbox(views.messages_mixed(spark, sf), TZ)


@query("reject_reasons", f"WITH {MIXED} SELECT inbox_id, reason, count(*) AS n FROM placed WHERE reason IS NOT NULL GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return extract.reject_reasons(extract.parse_messages(views.messages_mixed(spark, sf), TZ))


@query("parse_counts", f"""WITH {MIXED} SELECT inbox_id, count(*) AS scanned, count(*) FILTER (reason IS NULL) AS parsed,
    count(*) FILTER (reason IS NOT NULL) AS rejected FROM placed GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return extract.parse_counts(extract.parse_messages(views.messages_mixed(spark, sf), TZ))


@query("classify_inbox", f"""WITH {MIXED}
    SELECT inbox_id, id, tab, subtype, subtype = 'otp' AS sensitive, reason FROM placed""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("inbox_id", "id", "tab", "subtype", "sensitive", "reason")


@query("tab_counts", f"WITH {MIXED} SELECT inbox_id, tab, count(*) AS n FROM placed GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return inbox.tab_counts(classified(spark, sf))


@query("search_inbox", f"""WITH {MIXED}
    SELECT inbox_id, id, CASE WHEN subtype <> 'otp' THEN body END AS body FROM placed
    WHERE tab = 'updates' AND (contains(lower(body), '12') OR contains(lower(address), '12'))
    QUALIFY row_number() OVER (PARTITION BY inbox_id ORDER BY date_ms DESC, id DESC) <= 40""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return inbox.search_inbox(classified(spark, sf), "updates", "12").select("inbox_id", "id", "body")


@query("visible_bodies", f"""WITH {MIXED} SELECT inbox_id, id, CASE WHEN subtype <> 'otp' THEN body END AS body FROM placed""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return inbox.visible_body(classified(spark, sf)).select("inbox_id", "id", "body")


# --- bills -----------------------------------------------------------------------------------------

BILLS = f"""{MIXED}, bills AS (
    SELECT inbox_id, id AS sms_id, date_ms AS seen_ms, acc AS account, 'HDFC' AS issuer,
      CASE WHEN sort = 4 THEN 'credit-card' ELSE 'other' END AS kind,
      CASE WHEN amount > 0 AND NOT (sort = 4 AND amount = 10) THEN amount WHEN sort = 4 THEN 10 END AS amount,
      CASE WHEN sort = 4 THEN 10 END AS minimum_due, CASE WHEN sort = 4 THEN due END AS due_date, sort = 10 AS overdue,
      body AS raw FROM placed WHERE tab = 'bills'),
  named_bills AS (
    SELECT *, 'open' AS status, 'bill:hdfc:' || account || ':' || coalesce(CAST(due_date AS VARCHAR), 'nodate') || ':'
      || coalesce({trimmed('amount')}, '0') AS fingerprint
    FROM bills WHERE amount IS NOT NULL OR due_date IS NOT NULL),
  latest AS (
    SELECT * FROM named_bills
    QUALIFY row_number() OVER (PARTITION BY inbox_id, fingerprint ORDER BY seen_ms DESC, sms_id) = 1)"""
BILL_COLUMNS = """inbox_id, sms_id, fingerprint, issuer, account, kind, CAST(amount AS DOUBLE) AS amount,
    CAST(minimum_due AS DOUBLE) AS minimum_due, CAST(due_date AS VARCHAR) AS due_date, seen_ms, overdue, status, raw"""


def mixed_bills(spark: SparkSession, sf: str) -> DataFrame:
    return bills.extract_bills(classified(spark, sf).where("tab = 'bills'"))


def current_bills(spark: SparkSession, sf: str) -> DataFrame:
    return bills.latest_bills(mixed_bills(spark, sf))


def marked_bills(spark: SparkSession, sf: str) -> DataFrame:
    """Every third bill is paid, every sixth was reopened later."""
    now = current_bills(spark, sf)

    def saved(every: int, status: str, at: int) -> DataFrame:
        return now.where(F.col("sms_id") % every == 0).select(
            "inbox_id", "fingerprint", F.lit(status).alias("status"), F.lit(at).alias("updated_ms"))

    return bills.overlay_status(now, saved(3, "dismissed", 1).unionByName(saved(6, "open", 2)))


MARKED = f"""{BILLS}, marked AS (
    SELECT * REPLACE (CASE WHEN sms_id % 6 = 0 THEN 'open' WHEN sms_id % 3 = 0 THEN 'dismissed' ELSE 'open' END AS status)
    FROM latest)"""


@query("extract_bills", f"WITH {BILLS} SELECT {BILL_COLUMNS} FROM named_bills")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return mixed_bills(spark, sf)


@query("latest_bills", f"WITH {BILLS} SELECT {BILL_COLUMNS} FROM latest")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return current_bills(spark, sf)


@query("bill_overlay", f"WITH {MARKED} SELECT inbox_id, fingerprint, status FROM marked")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return marked_bills(spark, sf).select("inbox_id", "fingerprint", "status")


DAYS = "datediff('day', DATE '2024-01-20', due_date)"
SOON = f"(status = 'open' AND coalesce({DAYS} BETWEEN 0 AND 7, FALSE))"
LATE = f"(status = 'open' AND (overdue OR coalesce({DAYS} < 0, FALSE)))"


@query("bills_due", f"""WITH {MARKED}
    SELECT inbox_id, CAST(sum(CASE WHEN {SOON} THEN coalesce(amount, 0) ELSE 0 END) AS DOUBLE) AS due_total,
      count(*) FILTER ({SOON}) AS due_count,
      CAST(sum(CASE WHEN {LATE} THEN coalesce(amount, 0) ELSE 0 END) AS DOUBLE) AS overdue_total,
      count(*) FILTER ({LATE}) AS overdue_count FROM marked GROUP BY inbox_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bills.bills_due(marked_bills(spark, sf), NOW)


@query("bill_urgency", f"""WITH {MARKED}, counted AS (SELECT *, {DAYS} AS d FROM marked)
    SELECT inbox_id, fingerprint, CAST(d AS DOUBLE) AS days, CASE WHEN d IS NULL THEN 'no date found'
        WHEN d < 0 THEN -d || CASE WHEN d = -1 THEN ' day' ELSE ' days' END || ' overdue' WHEN d = 0 THEN 'due today'
        ELSE 'due in ' || d || CASE WHEN d = 1 THEN ' day' ELSE ' days' END END AS when_due,
      coalesce(d < 3, FALSE) AS urgent FROM counted""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bills.bill_urgency(marked_bills(spark, sf), NOW).select(
        "inbox_id", "fingerprint", F.col("days").cast("double").alias("days"), "when_due", "urgent")


@query("bill_list", f"""WITH {MARKED} SELECT inbox_id, fingerprint, status, CAST(due_date AS VARCHAR) AS due_date FROM marked""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bills.bill_list(marked_bills(spark, sf)).select("inbox_id", "fingerprint", "status", "due_date")


# --- drift and audits ------------------------------------------------------------------------------

DRIFT = f"""{MIXED}, drift AS (
    SELECT inbox_id, id AS sms_id, address AS sender, reason, subtype, body, date_ms
    FROM placed WHERE sort = 9),
  rolled AS (
    SELECT inbox_id, sender, reason, arg_max(body, (date_ms, -sms_id)) AS body, min(subtype) AS subtype, count(*) AS n
    FROM drift GROUP BY 1, 2, 3)"""


@query("detect_drift", f"WITH {DRIFT} SELECT * FROM drift")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return drift.detect_drift(classified(spark, sf))


@query("drift_rollup", f'WITH {DRIFT} SELECT inbox_id, sender, reason, body, subtype, n AS "count" FROM rolled')
def _(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_rollup(drift.detect_drift(classified(spark, sf)))


@query("drift_report", f"""WITH {DRIFT}
    SELECT inbox_id, 'HDFCBK' AS sender, reason, n AS "count",
      'Your account XX9999 was settled at branch ' || regexp_extract(body, '[0-9]+$') AS body,
      'account=1,masked_tail=1' AS replaced, '' AS warnings FROM rolled""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    report = drift.drift_report(drift.drift_rollup(drift.detect_drift(classified(spark, sf))), "pepper", 500)
    counts = F.transform(F.sort_array(F.map_entries("replaced")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return report.withColumns({"replaced": F.array_join(counts, ","), "warnings": F.array_join("warnings", ",")})


@query("replaced_totals", f"""WITH {DRIFT} SELECT inbox_id, what, count(*) AS times
    FROM rolled, (VALUES ('account'), ('masked_tail')) AS w(what) GROUP BY 1, 2""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return drift.replaced_totals(
        drift.drift_report(drift.drift_rollup(drift.detect_drift(classified(spark, sf))), "pepper", 500))


@query("audit_extraction", f"""WITH {MIXED}, counts AS (
      SELECT coalesce(reason, 'parsed') AS outcome, count(*) AS n FROM placed GROUP BY 1)
    SELECT outcome, n, CAST(floor(n * 100 / sum(n) OVER ()) AS BIGINT) AS pct,
      outcome IN ('no-direction', 'no-amount') AS worth_reviewing FROM counts""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return templates.audit(views.messages_mixed(spark, sf), TZ, force=True)


@query("audit_dates", f"""WITH {RENDERED} SELECT count(*) AS transactions,
      count(*) FILTER (date_ms = epoch_ms(due)) AS arrival_dated, count(*) FILTER (date_ms = epoch_ms(due)) AS date_ignored
    FROM booked""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return templates.audit_dates(parsed_rendered(spark, sf))


@query("unhandled_shapes", f"""WITH {MIXED}, shapes AS (
      SELECT *, CASE sort WHEN 4 THEN 'Your HDFC Credit Card <ACCT> bill of Rs.<AMT> is due on <DATE>. Minimum amount due Rs.<N>.'
        WHEN 5 THEN 'Order ' || ref || ' placed. Your parcel will arrive on <DATE>'
        WHEN 6 THEN 'Reached home at <N>, speak later' WHEN 7 THEN 'You have won a lottery of Rs <AMT>. Claim now.'
        WHEN 9 THEN 'Your account <ACCT> was settled at branch <N>' ELSE 'Weather note number <N>' END AS shape
      FROM placed WHERE reason IN ('no-direction', 'no-amount'))
    SELECT shape, count(*) AS n, arg_max(reason, id) AS reason, arg_min(body, id) AS example FROM shapes GROUP BY shape""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    parsed = extract.parse_messages(views.messages_mixed(spark, sf), TZ)
    return templates.unhandled_shapes(parsed, None)


# --- import ----------------------------------------------------------------------------------------

# the walk itself, as an ordered fold over lists: what a newest-first scan accepts
def walk(reports: str, kept: str) -> str:
    """Tables which end in ``kept``: reports taken newest first, unless one with the same key was taken before."""
    return f"""{kept}_ordered AS (
    SELECT inbox_id, whole, list(struct_pack(id := sms_id, f := fingerprint, s := shop || ':' || due)
      ORDER BY date_ms DESC, sms_id) AS rows FROM {reports} GROUP BY 1, 2),
  {kept}_walked AS (
    SELECT inbox_id, whole, list_reduce(
      list_transform(rows, lambda r: struct_pack(ids := [r.id], keys := [r.f, r.s])),
      lambda acc, x: CASE WHEN list_has_any(acc.keys, x.keys) THEN acc
        ELSE struct_pack(ids := list_concat(acc.ids, x.ids), keys := list_concat(acc.keys, x.keys)) END) AS done
    FROM {kept}_ordered),
  {kept} AS (SELECT inbox_id, unnest(done.ids) AS sms_id FROM {kept}_walked)"""


DUPS = f"""{PARTS}, base AS (
    SELECT *, CAST(floor(amount) AS BIGINT) // 10 * 10 + 10 AS whole, k % 7 AS shop FROM parts),
  reports AS (
    SELECT inbox_id, id * 2 AS sms_id, date_ms, whole, 'r:' || ref || ':' || whole AS fingerprint, shop, due FROM base
    UNION ALL
    SELECT inbox_id, id * 2 + 1, date_ms + 40000, whole, 'h:debit:' || whole || ':' || due || ':?', shop, due
    FROM base WHERE id % 4 = 0),
  """ + walk("reports", "kept")


def doubled(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parsed_once(views.messages_dups(spark, sf), TZ)


@query("dedup", f"WITH {DUPS} SELECT inbox_id, sms_id FROM kept")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup(doubled(spark, sf)).select("inbox_id", "sms_id")


@query("dedup_against_ledger", f"""WITH {DUPS}, stored AS (SELECT reports.* FROM reports JOIN kept USING (inbox_id, sms_id) WHERE sms_id % 3 = 0),
    met AS (
      SELECT DISTINCT r.inbox_id, r.sms_id FROM reports r JOIN stored s ON r.inbox_id = s.inbox_id AND r.whole = s.whole
        AND (r.fingerprint = s.fingerprint OR (r.shop = s.shop AND r.due = s.due))),
    fresh AS (SELECT * FROM reports ANTI JOIN met USING (inbox_id, sms_id)), {walk('fresh', 'written')}
    SELECT inbox_id, sms_id FROM written""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger has a third of the rows; an import of all messages writes the others which repeat none."""
    txns = doubled(spark, sf)
    return dedup.dedup(txns, dedup.dedup(txns).where("sms_id % 3 = 0")).select("inbox_id", "sms_id")


@query("ingest_counters", f"""WITH {DUPS}
    SELECT inbox_id, count(*) AS scanned, count(*) AS parsed, CAST(0 AS BIGINT) AS rejected,
      count(*) FILTER (kept.sms_id IS NULL) AS duplicates, count(kept.sms_id) AS written
    FROM reports LEFT JOIN kept USING (inbox_id, sms_id) GROUP BY inbox_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.ingest_counters(views.messages_dups(spark, sf), TZ)


@query("ingest", f"""WITH {DUPS}
    SELECT inbox_id, sms_id, CAST(whole AS DOUBLE) AS amount, 'other' AS category, 'fallback' AS category_source
    FROM reports JOIN kept USING (inbox_id, sms_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.ingest(views.messages_dups(spark, sf), TZ).select(
        "inbox_id", "sms_id", "amount", "category", "category_source")


REPROCESSED = f"""WITH {RENDERED}
    SELECT inbox_id, id AS sms_id, CASE WHEN id % 4 = 0 THEN 'income' ELSE kind END AS kind,
      CASE WHEN id % 3 = 0 THEN 'added' WHEN id % 4 = 0 THEN 'kept' WHEN id % 5 = 0 THEN 'updated' ELSE 'kept' END AS change
    FROM (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN kind ELSE kind END AS kind) FROM booked) WHERE NOT (id % 3 = 0 AND id % 4 = 0)
    UNION ALL SELECT inbox_id, id, kind, 'added' FROM booked WHERE id % 3 = 0 AND id % 4 = 0"""


def partly_stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Messages, and a ledger with two thirds of the rows: some with a kind set by hand, some with a stale merchant."""
    messages = views.messages_rendered(spark, sf)
    by_hand = F.col("sms_id") % 4 == 0
    stored = ingest.resolve_categories(ingest.parsed_once(messages, TZ)).where("sms_id % 3 <> 0").withColumns({
        "kind": F.when(by_hand, "income").otherwise(F.col("kind")),
        "kind_source": F.when(by_hand, "user").otherwise(F.col("kind_source")),
        "merchant": F.when(~by_hand & (F.col("sms_id") % 5 == 0), "WRONG").otherwise(F.col("merchant")),
    })
    return messages, stored


@query("reprocess", REPROCESSED)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A re-scan of all messages against the stored rows."""
    messages, stored = partly_stored(spark, sf)
    return ingest.reprocess(messages, TZ, stored).select("inbox_id", "sms_id", "kind", "change")


@query("newer_than_watermark", """SELECT CAST(user_id AS VARCHAR) AS inbox_id, event_id AS id
    FROM (SELECT *, max(CASE WHEN event_id % 5 = 0 AND user_id % 2 = 0 THEN date_trunc('second', ts) END) OVER (PARTITION BY user_id) AS mark
      FROM events) WHERE mark IS NULL OR date_trunc('second', ts) > mark""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    messages = views.messages_rendered(spark, sf)
    stored = messages.where("id % 5 = 0 AND CAST(inbox_id AS BIGINT) % 2 = 0").select(
        "inbox_id", F.col("date_ms").alias("sms_date_ms"))
    return ingest.newer_than_watermark(messages, stored).select("inbox_id", "id")


@query("needs_backfill", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS inbox_id FROM events WHERE user_id % 2 = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    messages = views.messages_rendered(spark, sf)
    return ingest.needs_backfill(messages, messages.where("CAST(inbox_id AS BIGINT) % 2 = 0"))


# --- own transfers ---------------------------------------------------------------------------------

CANDIDATES = f"""{PAIRS}, candidates AS (
    SELECT inbox_id, amount, fingerprint, sms_id, kind, account, date FROM pairable
    WHERE NOT (merchant IS NOT NULL AND merchant_quality NOT IN ('phone', 'opaque')))"""
# debits in order, each taking the first free income: an ordered fold over lists
GREEDY = f"""{CANDIDATES}, sides AS (
    SELECT inbox_id, amount,
      list(struct_pack(f := fingerprint, a := account, d := date) ORDER BY date, sms_id) FILTER (kind = 'expense') AS debits,
      list(struct_pack(f := fingerprint, a := account, d := date) ORDER BY date, sms_id) FILTER (kind = 'income') AS credits
    FROM candidates {{where}} GROUP BY 1, 2 HAVING debits IS NOT NULL AND credits IS NOT NULL),
  served AS (
    SELECT inbox_id, amount, list_reduce(
      list_transform(debits, lambda d: struct_pack(used := [''], pairs := [''], f := d.f, a := d.a, d := d.d)),
      lambda acc, x: struct_pack(
        used := list_append(acc.used, coalesce(list_filter(credits, lambda c: NOT list_contains(acc.used, c.f)
          AND abs(epoch_us(c.d) - epoch_us(x.d)) <= 86400000000 AND c.a <> x.a)[1].f, '')),
        pairs := list_append(acc.pairs, x.f || '>' || coalesce(list_filter(credits, lambda c: NOT list_contains(acc.used, c.f)
          AND abs(epoch_us(c.d) - epoch_us(x.d)) <= 86400000000 AND c.a <> x.a)[1].f, '')),
        f := x.f, a := x.a, d := x.d),
      struct_pack(used := [''], pairs := [''], f := '', a := '', d := TIMESTAMP '2000-01-01')) AS done FROM sides),
  matched AS (
    SELECT inbox_id, amount, split_part(p, '>', 1) AS debit, split_part(p, '>', 2) AS credit
    FROM (SELECT inbox_id, amount, unnest(done.pairs) AS p FROM served) WHERE p <> '' AND split_part(p, '>', 2) <> '')"""


@query("transfer_pairs", f"""WITH {GREEDY.format(where='')}
    SELECT inbox_id, debit, credit, CAST(amount AS DOUBLE) AS amount FROM matched""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.transfer_pairs(views.ledger_pairs(spark, sf))


@query("dashboard_pairs", f"""WITH {GREEDY.format(where="WHERE date >= TIMESTAMP '2024-01-11 12:00:00'")}
    SELECT inbox_id, debit, credit, CAST(amount AS DOUBLE) AS amount FROM matched""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.dashboard_pairs(views.ledger_pairs(spark, sf), datetime(2024, 3, 11, 12))


@query("transfer_pair_groups", f"""WITH {CANDIDATES}
    SELECT inbox_id, CAST(amount AS DOUBLE) AS amount, count(*) FILTER (kind = 'expense') AS debits,
      count(*) FILTER (kind = 'income') AS credits FROM candidates GROUP BY inbox_id, candidates.amount
    HAVING debits > 0 AND credits > 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.candidate_groups(views.ledger_pairs(spark, sf))


@query("names_third_party", f"""WITH {LEDGER}
    SELECT inbox_id, sms_id, merchant IS NOT NULL AND merchant_quality NOT IN ('phone', 'opaque') AS names_third_party FROM ledger""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.third_party(views.ledger(spark, sf)).select("inbox_id", "sms_id", "names_third_party")


@query("mark_transfers", f"""WITH {GREEDY.format(where='')}, halves AS (
      SELECT inbox_id, debit AS fingerprint FROM matched UNION SELECT inbox_id, credit FROM matched)
    SELECT p.inbox_id, p.sms_id, CASE WHEN h.fingerprint IS NULL THEN kind ELSE 'transfer' END AS kind,
      CASE WHEN h.fingerprint IS NULL THEN category ELSE 'transfer' END AS category,
      CASE WHEN h.fingerprint IS NULL THEN kind_source ELSE 'user' END AS kind_source
    FROM stepped p LEFT JOIN halves h ON p.inbox_id = h.inbox_id AND p.fingerprint = h.fingerprint""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ledger = views.ledger_pairs(spark, sf)
    return merge.mark_transfers(ledger, pairs.transfer_pairs(ledger)).select(
        "inbox_id", "sms_id", "kind", "category", "kind_source")


@query("attention_list", f"""WITH {GREEDY.format(where='')}, {MARKED}, late AS (
      SELECT *, row_number() OVER (PARTITION BY inbox_id ORDER BY due_date NULLS LAST, sms_id) AS place FROM marked WHERE {LATE})
    SELECT inbox_id, 'transfers' AS topic, count(*) AS n, CAST(NULL AS VARCHAR) AS detail FROM matched GROUP BY 1
    UNION ALL SELECT inbox_id, 'review', count(*), NULL FROM stepped WHERE {PENDING} GROUP BY 1
    UNION ALL SELECT inbox_id, 'overdue_bills', count(*), string_agg(issuer, ', ' ORDER BY place) FILTER (place <= 3)
      FROM late GROUP BY 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return attention.attention_list(views.ledger_pairs(spark, sf), marked_bills(spark, sf), NOW)


# --- tracing ---------------------------------------------------------------------------------------

# where the fields stand follows from how the message was put together
SPANS = f"""{RENDERED}, cut AS (
    SELECT *, 3 AS a0, 3 + length(amt) AS a1, strpos(body, 'XX') - 1 AS x0, strpos(body, ' ' || day) AS d0,
      CASE WHEN event_type IN ('purchase', 'click') THEN 'store' || k || '@ybl' ELSE merchant END AS shown,
      length(body) - 12 AS r0 FROM booked),
  spans AS (
    SELECT *, CASE WHEN shown IS NULL THEN '' ELSE '|' || (strpos(body, shown) - 1) || '-'
        || (strpos(body, shown) - 1 + length(shown)) || ':merchant' END AS m,
      a0 || '-' || a1 || ':amount|' || x0 || '-' || (x0 + 6) || ':account|' || d0 || '-' || (d0 + 8) || ':date' AS head,
      '|' || r0 || '-' || (r0 + 12) || ':ref' AS tail FROM cut)"""


@query("trace_fields", f"""WITH {SPANS} SELECT inbox_id, id AS sms_id, head || m || tail AS spans FROM spans""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"], F.lit(":"), s["field"]))
    return trace.trace_fields(booked(spark, sf)).select("inbox_id", "sms_id", F.array_join(shown, "|").alias("spans"))


@query("segments", f"""WITH {SPANS}
    SELECT inbox_id, id AS sms_id, body AS joined, CAST(CASE WHEN shown IS NULL THEN 8 ELSE 10 END AS BIGINT) AS pieces,
      amt AS amount_text FROM spans""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cut = trace.segments(trace.trace_fields(booked(spark, sf)))
    texts = F.transform("segments", lambda s: s["text"])
    amounts = F.filter("segments", lambda s: F.coalesce(s["field"] == "amount", F.lit(False)))
    return cut.select("inbox_id", "sms_id", F.array_join(texts, "").alias("joined"), F.size("segments").alias("pieces"),
                      F.get(amounts, F.lit(0))["text"].alias("amount_text"))


@query("trace_coverage", f"""WITH {SPANS}
    SELECT inbox_id, id AS sms_id, CAST(CASE WHEN shown IS NULL THEN 4 ELSE 5 END AS BIGINT) AS expected,
      CAST(CASE WHEN shown IS NULL THEN 4 ELSE 5 END AS BIGINT) AS traced, '' AS missing FROM spans""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    covered = trace.trace_coverage(trace.trace_fields(booked(spark, sf)))
    return covered.select("inbox_id", "sms_id", "expected", "traced", F.array_join("missing", ",").alias("missing"))


@query("trace_report", f"""WITH {SPANS}
    SELECT 'HDFCBK' AS sender_id, count(*) AS rows, CAST(sum(CASE WHEN shown IS NULL THEN 4 ELSE 5 END) AS BIGINT) AS expected,
      CAST(sum(CASE WHEN shown IS NULL THEN 4 ELSE 5 END) AS BIGINT) AS traced, CAST(0 AS BIGINT) AS amount_missing FROM spans""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return trace.trace_report(trace.trace_fields(booked(spark, sf)))
