"""Queries over ledgers: periods, days, review, corrections, merge, exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions.clock import period
from khata.functions.money import merchant_key
from khata.operators import categories, merge, model, reports, review
from khata.plans import views
from khata.plans.registry import query
from khata.plans.sql_views import (
    COUNTED, INCOME, LEDGER, ORDERS, PENDING, REFUND, SPEND, TRANSFER, total, trimmed,
)
from khata.sources import readers, writers

NOW = datetime(2024, 1, 20, 12)
ORDERS_NOW = datetime(1998, 6, 15, 12)


def between(first: str, last: str) -> str:
    return f"date BETWEEN TIMESTAMP '{first}' AND TIMESTAMP '{last}'"


THIS = between("2024-01-01", "2024-01-20 12:00:00")
ALL = between("1970-01-01", "2024-01-20 12:00:00")
O_THIS = between("1998-06-01", "1998-06-15 12:00:00")
O_LAST = between("1998-05-01", "1998-05-31 23:59:59.999")
O_LAST3 = between("1998-04-01", "1998-06-15 12:00:00")
O_ALL = between("1970-01-01", "1998-06-15 12:00:00")


def _summary_sql(view: str, span: str) -> str:
    return f"""WITH {view}, sums AS (
      SELECT inbox_id, {total(SPEND)} AS gross, {total(REFUND)} AS refunded, {total(INCOME)} AS received,
        {total(TRANSFER)} AS transferred, count(*) AS n
      FROM ledger WHERE {span} AND {COUNTED} GROUP BY inbox_id)
    SELECT inbox_id, CAST(greatest(0, gross - refunded) AS DOUBLE) AS spent, CAST(gross AS DOUBLE) AS gross,
      CAST(refunded AS DOUBLE) AS refunded, CAST(received AS DOUBLE) AS received,
      CAST(transferred AS DOUBLE) AS transferred,
      CAST(received - greatest(0, gross - refunded) AS DOUBLE) AS net, n AS "count" FROM sums"""


@query("period_summary_this_month", _summary_sql(LEDGER, THIS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.period_summary(views.ledger(spark, sf), period("this_month", NOW))


@query("period_summary_last_month", _summary_sql(ORDERS, O_LAST))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.period_summary(views.ledger_orders(spark, sf), period("last_month", ORDERS_NOW))


@query("period_summary_last3", _summary_sql(ORDERS, O_LAST3))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.period_summary(views.ledger_orders(spark, sf), period("last3", ORDERS_NOW))


@query("period_summary_all", _summary_sql(ORDERS, O_ALL))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.period_summary(views.ledger_orders(spark, sf), period("all", ORDERS_NOW))


@query("spend_by_category", f"""WITH {LEDGER}
    SELECT inbox_id, coalesce(category, 'other') AS category, CAST(sum(amount) AS DOUBLE) AS total
    FROM ledger WHERE {ALL} AND {COUNTED} AND {SPEND} GROUP BY ALL""")
def spend_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return reports.spend_by_category(views.ledger(spark, sf), period("all", NOW))


@query("spend_by_category_overall", f"""WITH {ORDERS}
    SELECT coalesce(category, 'other') AS category, CAST(sum(amount) AS DOUBLE) AS total
    FROM ledger WHERE {O_ALL} AND {COUNTED} AND {SPEND} GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.spend_by_category(views.ledger_orders(spark, sf), period("all", ORDERS_NOW), keys=())


MERCHANTS = f"""merchants AS (
    SELECT inbox_id, lower(coalesce(merchant, 'unknown')) AS merchant_id,
      coalesce(arg_min(struct_pack(m := merchant), (date, sms_id)).m, 'Unknown') AS name,
      arg_min(struct_pack(c := category), (date, sms_id)).c AS category, sum(amount) AS total, count(*) AS n
    FROM ledger WHERE {{span}} AND {COUNTED} AND {SPEND} GROUP BY 1, 2)"""


@query("spend_by_merchant", f"""WITH {LEDGER}, {MERCHANTS.format(span=ALL)}
    SELECT inbox_id, merchant_id, name, category, CAST(total AS DOUBLE) AS total, n AS "count" FROM merchants""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.spend_by_merchant(views.ledger(spark, sf), period("all", NOW))


@query("top_merchants", f"""WITH {LEDGER}, {MERCHANTS.format(span=THIS)}
    SELECT inbox_id, merchant_id, name, category, CAST(total AS DOUBLE) AS total, n AS "count",
      row_number() OVER (PARTITION BY inbox_id ORDER BY total DESC, merchant_id) AS rank
    FROM merchants QUALIFY rank <= 8""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_merchants(views.ledger(spark, sf), period("this_month", NOW))


@query("spend_by_day", f"""WITH {LEDGER}
    SELECT inbox_id, CAST(CAST(date AS DATE) AS VARCHAR) AS day, CAST(sum(amount) AS DOUBLE) AS total
    FROM ledger WHERE {THIS} AND {COUNTED} AND {SPEND} GROUP BY 1, 2""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.spend_by_day(views.ledger(spark, sf), period("this_month", NOW))


@query("largest_spend", f"""WITH {LEDGER}
    SELECT inbox_id, sms_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, merchant,
      CAST(amount AS DOUBLE) AS amount, category
    FROM ledger WHERE {THIS} AND {COUNTED} AND {SPEND}
    QUALIFY row_number() OVER (PARTITION BY inbox_id ORDER BY amount DESC, date, sms_id) = 1""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.largest_spend(views.ledger(spark, sf), period("this_month", NOW))


def _buckets_sql(view: str, span: str) -> str:
    c = COUNTED
    return f"""{view}, buckets AS (
      SELECT inbox_id, CAST(date AS DATE) AS day,
        greatest(0, {total(f'{c} AND {SPEND}')} - {total(f'{c} AND {REFUND}')}) AS spend,
        {total(f'{c} AND {INCOME}')} AS income, count(*) FILTER ({c}) AS n, count(*) FILTER ({PENDING}) AS pending
      FROM ledger WHERE {span} GROUP BY 1, 2 HAVING n > 0)"""


@query("daily_buckets", f"""WITH {_buckets_sql(LEDGER, THIS)}
    SELECT inbox_id, CAST(day AS VARCHAR) AS day, CAST(spend AS DOUBLE) AS spend, CAST(income AS DOUBLE) AS income,
      n AS "count", CAST(0 AS BIGINT) AS review, pending AS pending_rows FROM buckets""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.daily_buckets(views.ledger(spark, sf), period("this_month", NOW))


@query("daily_totals", f"""WITH {_buckets_sql(LEDGER, between('2023-12-21 12:00:00', '2024-01-20 12:00:00'))}
    SELECT inbox_id, CAST(sum(spend) AS DOUBLE) AS total, CAST(sum(n) AS BIGINT) AS "count", count(*) AS days,
      count(*) FILTER (spend > 0) AS days_with_spend,
      CASE WHEN count(*) FILTER (spend > 0) > 0
        THEN round(CAST(sum(spend) AS DOUBLE) / count(*) FILTER (spend > 0), 6) END AS average
    FROM buckets GROUP BY inbox_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.daily_totals(views.ledger(spark, sf), period("last30", NOW))
    return out.withColumn("average", F.round("average", 6))


def _calendar_sql(first: str, last: str) -> str:
    return f"""calendar AS (
      SELECT inbox_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT inbox_id FROM ledger),
        generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY) AS g(d))"""


@query("last_n_days", f"""WITH {LEDGER}, {_calendar_sql('2024-01-14', '2024-01-20')}, sums AS (
      SELECT inbox_id, CAST(date AS DATE) AS day, {total(SPEND)} - {total(REFUND)} AS spend, count(*) AS n
      FROM ledger WHERE {COUNTED} GROUP BY 1, 2)
    SELECT inbox_id, CAST(day AS VARCHAR) AS day, CAST(greatest(0, coalesce(spend, 0)) AS DOUBLE) AS spend,
      coalesce(n, 0) AS "count" FROM calendar LEFT JOIN sums USING (inbox_id, day)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.last_n_days(views.ledger(spark, sf), 7, NOW)


@query("sparkline", f"""WITH {LEDGER}, {_calendar_sql('2023-11-21', '2024-01-20')}, sums AS (
      SELECT inbox_id, CAST(date AS DATE) AS day, sum(amount) AS total
      FROM ledger WHERE {ALL} AND {COUNTED} AND {SPEND} GROUP BY 1, 2)
    SELECT inbox_id, CAST(day AS VARCHAR) AS day, CAST(coalesce(total, 0) AS DOUBLE) AS total
    FROM calendar LEFT JOIN sums USING (inbox_id, day)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sparkline(views.ledger(spark, sf), period("last3", NOW))


@query("month_projection", f"""WITH {LEDGER}, sums AS (
      SELECT inbox_id, greatest(0, {total(SPEND)} - {total(REFUND)}) AS spent
      FROM ledger WHERE {THIS} AND {COUNTED} GROUP BY inbox_id)
    SELECT inbox_id, CAST(spent AS DOUBLE) AS spent, round(CAST(spent AS DOUBLE) / 20 * 31, 6) AS projected FROM sums""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.month_projection(views.ledger(spark, sf), NOW)
    return out.withColumn("projected", F.round("projected", 6))


def _spent(span: str) -> str:
    return f"greatest(0, {total(f'{span} AND {SPEND}')} - {total(f'{span} AND {REFUND}')})"


@query("month_change", f"""WITH {ORDERS}, sums AS (
      SELECT inbox_id, CAST({_spent(O_THIS)} AS DOUBLE) AS a, CAST({_spent(O_LAST)} AS DOUBLE) AS b
      FROM ledger WHERE {between('1998-05-01', '1998-06-15 12:00:00')} AND {COUNTED} GROUP BY inbox_id)
    SELECT inbox_id, a AS this_month, b AS last_month,
      CASE WHEN b > 0 THEN round((a - b) / b * 100, 6) END AS change_pct FROM sums""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.month_change(views.ledger_orders(spark, sf), ORDERS_NOW)
    return out.withColumn("change_pct", F.round("change_pct", 6))


@query("today_spend", f"""WITH {LEDGER}
    SELECT inbox_id, CAST(greatest(0, {total(SPEND)} - {total(REFUND)}) AS DOUBLE) AS spend, count(*) AS "count"
    FROM ledger WHERE CAST(date AS DATE) = DATE '2024-01-20' AND {COUNTED} GROUP BY inbox_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.today_spend(views.ledger(spark, sf), NOW)


_SOURCES = ", ".join(
    f"count(*) FILTER (coalesce(category_source, 'unresolved') = '{s}') AS \"{s}\""
    for s in ("user", "rule", "sender", "model", "llm", "guess", "fallback", "unresolved")
)


@query("coverage", f"""WITH {LEDGER}
    SELECT inbox_id, count(*) AS total, {_SOURCES}, count(*) FILTER ({PENDING}) AS pending_review,
      count(*) FILTER (coalesce(category, 'other') = 'other') AS uncategorised,
      count(*) FILTER (merchant IS NULL) AS no_merchant, count(*) FILTER (currency <> 'INR') AS "foreign"
    FROM ledger GROUP BY inbox_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.coverage(views.ledger(spark, sf))


REASON = f"""CASE WHEN review_reason_override IS NOT NULL THEN review_reason_override
      WHEN currency <> 'INR' THEN 'USD ' || {trimmed('foreign_amount')} || ' — no offline exchange rate'
      WHEN ambiguous_p2p THEN 'paid to a phone number — person or shop?'
      WHEN merchant_quality = 'opaque' THEN 'unreadable UPI handle'
      ELSE 'low confidence ' || confidence_pct || '%' END"""
PENDING_ROWS = f"""waiting AS (
    SELECT *, {REASON} AS why, regexp_replace({REASON}, '\\s*[0-9]+%', '') AS short FROM ledger WHERE {PENDING}),
  tagged AS (SELECT *, lower(coalesce(merchant, 'unknown')) || '|' || short AS group_key FROM waiting)"""
GROUPS = f"""{PENDING_ROWS}, groups AS (
    SELECT inbox_id, group_key, coalesce(arg_min(struct_pack(m := merchant), (date, sms_id)).m, 'Unknown') AS merchant,
      any_value(short) AS reason, count(*) AS n, sum(amount) AS total,
      CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS kind,
      arg_min(fingerprint, (date, sms_id)) AS sample_fingerprint, arg_min(raw, (date, sms_id)) AS sample_raw
    FROM tagged GROUP BY inbox_id, group_key)"""


@query("review_reason", f"""WITH {LEDGER}, {PENDING_ROWS}
    SELECT inbox_id, sms_id, why AS review_reason, group_key FROM tagged""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return review.pending_rows(views.ledger(spark, sf)).select("inbox_id", "sms_id", "review_reason", "group_key")


GROUP_COLUMNS = """inbox_id, group_key, merchant, reason, n AS "count", CAST(total AS DOUBLE) AS total, kind,
      sample_fingerprint, sample_raw"""


@query("review_groups", f"WITH {LEDGER}, {GROUPS} SELECT {GROUP_COLUMNS} FROM groups")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_groups(views.ledger(spark, sf))


@query("top_review_groups", f"""WITH {LEDGER}, {GROUPS}
    SELECT {GROUP_COLUMNS}, row_number() OVER (PARTITION BY inbox_id ORDER BY groups.total DESC, group_key) AS rank
    FROM groups QUALIFY rank <= 25""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return review.top_review_groups(views.ledger(spark, sf))


@query("review_backlog", f"""WITH {LEDGER}, {GROUPS}
    SELECT inbox_id, CAST(sum(n) AS BIGINT) AS pending, CAST(sum(total) AS DOUBLE) AS excluded, count(*) AS decisions
    FROM groups GROUP BY inbox_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_backlog(views.ledger(spark, sf))


@query("search_transactions", f"""WITH {LEDGER}
    SELECT inbox_id, sms_id, merchant, CAST(amount AS DOUBLE) AS amount FROM ledger
    WHERE contains(lower(coalesce(merchant, '')), '12') OR contains({trimmed('amount')}, '12') OR contains(raw, '12')
    QUALIFY row_number() OVER (PARTITION BY inbox_id ORDER BY date DESC, sms_id DESC) BETWEEN 11 AND 60""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.search_transactions(views.ledger(spark, sf), " 12 ", limit=50, offset=10)
    return found.select("inbox_id", "sms_id", "merchant", "amount")


@query("search_in_category", f"""WITH {LEDGER}
    SELECT inbox_id, sms_id, merchant, CAST(amount AS DOUBLE) AS amount FROM ledger
    WHERE category = 'food' AND contains(lower(coalesce(merchant, '')) || '\n' || {trimmed('amount')} || '\n' || raw, 'purchase')
    QUALIFY row_number() OVER (PARTITION BY inbox_id ORDER BY date DESC, sms_id DESC) <= 150""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.search_transactions(views.ledger(spark, sf), "PURCHASE", "food", 150)
    return found.select("inbox_id", "sms_id", "merchant", "amount")


@query("distinct_categories", f"WITH {LEDGER} SELECT DISTINCT inbox_id, category FROM ledger WHERE category IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.distinct_categories(views.ledger(spark, sf))


_DRILLS = {
    "today": f"CAST(date AS DATE) = DATE '2024-01-20' AND {COUNTED}",
    "this_month": f"date >= TIMESTAMP '2024-01-01' AND {COUNTED}",
    "spent": f"{THIS} AND {COUNTED} AND {SPEND}",
    "received": f"{THIS} AND {COUNTED} AND {INCOME}",
    "period": f"{THIS} AND {COUNTED}",
    "daily": f"{THIS} AND {COUNTED} AND {SPEND}",
}


def _register_drill(tile: str, test: str) -> None:
    @query(f"drill_down_{tile}", f"""WITH {LEDGER}
        SELECT inbox_id, sms_id, kind, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE {test}""")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return reports.drill_down(views.ledger(spark, sf), tile, NOW).select("inbox_id", "sms_id", "kind", "amount")


for _tile, _test in _DRILLS.items():
    _register_drill(_tile, _test)


@query("day_rows", f"""WITH {LEDGER}
    SELECT inbox_id, sms_id, kind, CAST(amount AS DOUBLE) AS amount FROM ledger
    WHERE CAST(date AS DATE) = DATE '2024-01-11'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.day_rows(views.ledger(spark, sf), datetime(2024, 1, 11)).select("inbox_id", "sms_id", "kind", "amount")


def _whole(amount: str) -> str:
    return f"CAST(floor({amount} + 0.5) AS BIGINT)"


def _map_sql(span: str, name: str) -> str:
    return f"""{name} AS (
      SELECT inbox_id, string_agg(category || '=' || t, ',' ORDER BY category) AS {name},
        max(CASE WHEN category = 'low' THEN t END) AS low FROM (
        SELECT inbox_id, coalesce(category, 'other') AS category, {_whole('sum(amount)')} AS t
        FROM ledger WHERE {span} AND {COUNTED} AND {SPEND} GROUP BY 1, 2) GROUP BY inbox_id)"""


@query("fact_sheet", f"""WITH {ORDERS}, {MERCHANTS.format(span=O_THIS)}, {_map_sql(O_THIS, 'this_by_category')},
    {_map_sql(O_LAST, 'last_by_category')}, heads AS (
      SELECT inbox_id, {_whole(_spent(f'{COUNTED} AND {O_THIS}'))} AS this_spent,
        {_whole(total(f'{COUNTED} AND {O_THIS} AND {INCOME}'))} AS this_received,
        count(*) FILTER ({COUNTED} AND {O_THIS}) AS this_transactions,
        {_whole(_spent(f'{COUNTED} AND {O_LAST}'))} AS last_spent,
        {_whole(total(f'{COUNTED} AND {O_LAST} AND {INCOME}'))} AS last_received,
        count(*) FILTER ({COUNTED} AND {O_LAST}) AS last_transactions,
        {_whole(_spent(f'{COUNTED} AND {O_ALL}'))} AS all_spent, count(*) FILTER ({COUNTED} AND {O_ALL}) AS all_transactions,
        {_whole(total(f'{COUNTED} AND {O_THIS} AND {REFUND}'))} AS this_refunds,
        {total(f'{COUNTED} AND {O_THIS} AND {TRANSFER}')} > 0 AS transfers_excluded,
        count(*) FILTER ({PENDING}) AS excluded_pending_review FROM ledger GROUP BY inbox_id),
    large AS (
      SELECT inbox_id, merchant AS largest_merchant, {_whole('amount')} AS largest_amount,
        CAST(CAST(date AS DATE) AS VARCHAR) AS largest_day
      FROM ledger WHERE {O_THIS} AND {COUNTED} AND {SPEND}
      QUALIFY row_number() OVER (PARTITION BY inbox_id ORDER BY amount DESC, date, sms_id) = 1),
    top AS (
      SELECT inbox_id, string_agg(name || '=' || {_whole('total')} || 'x' || n, ',' ORDER BY total DESC, merchant_id) AS top_merchants
      FROM (SELECT * FROM merchants QUALIFY row_number() OVER (PARTITION BY inbox_id ORDER BY total DESC, merchant_id) <= 5)
      GROUP BY inbox_id)
    SELECT heads.*, this_by_category.this_by_category, last_by_category.last_by_category, top_merchants, largest_merchant,
      CAST(largest_amount AS DOUBLE) AS largest_amount, largest_day,
      'low' AS focus_category, coalesce(this_by_category.low, 0) AS focus_this_month,
      coalesce(last_by_category.low, 0) AS focus_last_month
    FROM heads LEFT JOIN this_by_category USING (inbox_id) LEFT JOIN last_by_category USING (inbox_id)
      LEFT JOIN top USING (inbox_id) LEFT JOIN large USING (inbox_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    sheet = reports.fact_sheet(
        views.ledger_orders(spark, sf), "How much on LOW things?", ("urgent", "high", "low"), ORDERS_NOW
    )

    def flat(name: str):
        pairs = F.transform(F.sort_array(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return F.array_join(pairs, ",")

    merchants = F.transform("top_merchants", lambda m: F.concat(m["name"], F.lit("="), m["total"], F.lit("x"), m["times"]))
    return sheet.withColumns({
        "this_by_category": flat("this_by_category"), "last_by_category": flat("last_by_category"),
        "top_merchants": F.array_join(merchants, ","),
        "largest_amount": F.col("largest_amount").cast("double"),
    })


# --- decisions on the review queue -----------------------------------------------------------------

def _group_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A decision for three of four groups, by the length of the group key."""
    turn = F.length("group_key") % 4
    return review.review_groups(views.ledger(spark, sf)).where(turn < 3).select(
        "inbox_id", "group_key",
        F.when(turn == 0, "reject").otherwise("accept").alias("action"),
        F.when(turn == 1, "transfer").alias("kind"), F.when(turn == 2, "travel").alias("category"),
    )


@query("resolve_review_groups", f"""WITH {LEDGER}, {PENDING_ROWS}, turns AS (
      SELECT inbox_id, sms_id, length(group_key) % 4 AS turn FROM tagged)
    SELECT inbox_id, sms_id, CASE WHEN turn = 1 THEN 'transfer' ELSE kind END AS kind,
      CASE WHEN turn = 1 THEN 'user' END AS kind_source,
      CASE WHEN turn = 2 THEN 'travel' ELSE category END AS category,
      CASE WHEN turn = 2 THEN 'user' ELSE category_source END AS category_source,
      CASE WHEN turn < 3 THEN FALSE ELSE needs_review END AS needs_review,
      CASE WHEN turn < 3 THEN TRUE ELSE reviewed END AS reviewed
    FROM ledger LEFT JOIN turns USING (inbox_id, sms_id) WHERE turn IS DISTINCT FROM 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    done = review.resolve_groups(views.ledger(spark, sf), _group_decisions(spark, sf))
    return done.select("inbox_id", "sms_id", "kind", "kind_source", "category", "category_source",
                       "needs_review", "reviewed")


@query("resolve_review_rows", f"""WITH {LEDGER}
    SELECT inbox_id, sms_id, CASE WHEN hit THEN FALSE ELSE needs_review END AS needs_review,
      CASE WHEN hit THEN TRUE ELSE reviewed END AS reviewed
    FROM (SELECT *, {PENDING} AND sms_id % 3 = 0 AS hit, {PENDING} AND sms_id % 3 = 1 AS gone FROM ledger)
    WHERE NOT gone""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ledger = views.ledger(spark, sf)
    verdicts = review.pending_rows(ledger).where(F.col("sms_id") % 3 < 2).select(
        "inbox_id", "fingerprint", (F.col("sms_id") % 3 == 0).alias("accept")
    )
    return review.resolve_rows(ledger, verdicts).select("inbox_id", "sms_id", "needs_review", "reviewed")


# --- merge, upsert, corrections --------------------------------------------------------------------

MERGE_COLUMNS = ["inbox_id", "fingerprint", "sms_id", "date_ms", "kind", "kind_source", "amount", "currency",
                 "category", "category_source", "merchant", "needs_review", "reviewed"]


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A stored ledger and a newer parse of it, which overlap in four of five rows."""
    base = views.ledger(spark, sf).withColumn("date_ms", F.lit(0).cast("bigint"))
    stored = base.withColumns({
        "kind_source": F.when(F.col("sms_id") % 7 == 0, "user"),
    }).where("sms_id % 5 <> 0").select(*MERGE_COLUMNS)
    fresh = base.withColumns({
        "kind": F.when(F.col("sms_id") % 3 == 0, "transfer").otherwise(F.col("kind")),
        "category": F.when(F.col("sms_id") % 4 == 0, "other").otherwise(F.col("category")),
        "category_source": F.lit("rule"),
    }).where("sms_id % 5 <> 1").select(*MERGE_COLUMNS)
    return stored, fresh


VERSIONS = f"""{LEDGER}, stored AS (
    SELECT * REPLACE (CASE WHEN sms_id % 7 = 0 THEN 'user' END AS kind_source) FROM ledger WHERE sms_id % 5 <> 0),
  fresh AS (
    SELECT * REPLACE (CASE WHEN sms_id % 3 = 0 THEN 'transfer' ELSE kind END AS kind,
      CASE WHEN sms_id % 4 = 0 THEN 'other' ELSE category END AS category, 'rule' AS category_source)
    FROM ledger WHERE sms_id % 5 <> 1),
  sides AS (
    SELECT coalesce(p.inbox_id, f.inbox_id) AS inbox_id, coalesce(p.sms_id, f.sms_id) AS sms_id, p, f,
      CASE WHEN p.category_source = 'user' THEN p.category ELSE f.category END AS m_category,
      CASE WHEN p.category_source = 'user' THEN 'user' ELSE f.category_source END AS m_source,
      CASE WHEN p.kind_source = 'user' THEN p.kind ELSE f.kind END AS m_kind,
      CASE WHEN p.reviewed THEN FALSE ELSE f.needs_review END AS m_needs,
      p.sms_id IS NULL AS is_new, p.sms_id IS NOT NULL AND f.sms_id IS NOT NULL AS is_both
    FROM stored p FULL JOIN fresh f ON p.inbox_id = f.inbox_id AND p.fingerprint = f.fingerprint),
  judged AS (
    SELECT *, is_both AND (m_kind IS DISTINCT FROM p.kind OR m_category IS DISTINCT FROM p.category) AS differs FROM sides)"""


def _merge_sql(update: str) -> str:
    def pick(prior: str, fresh: str, merged: str) -> str:
        return f"CASE change WHEN 'kept' THEN {prior} WHEN 'added' THEN {fresh} ELSE {merged} END"

    return f"""WITH {VERSIONS}, merged AS (
      SELECT *, CASE WHEN is_new THEN 'added' WHEN {update} THEN 'updated' ELSE 'kept' END AS change FROM judged)
    SELECT inbox_id, sms_id, {pick('p.kind', 'f.kind', 'm_kind')} AS kind,
      {pick('p.category', 'f.category', 'm_category')} AS category,
      {pick('p.category_source', 'f.category_source', 'm_source')} AS category_source,
      {pick('p.needs_review', 'f.needs_review', 'm_needs')} AS needs_review, change FROM merged"""


MERGED = ["inbox_id", "sms_id", "kind", "category", "category_source", "needs_review", "change"]


@query("merge_ledger", _merge_sql("FALSE"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_ledger(*_versions(spark, sf)).select(*MERGED)


@query("merge_ledger_reprocess", _merge_sql("differs"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_ledger(*_versions(spark, sf), reprocess=True).select(*MERGED)


@query("material_changes", f"WITH {VERSIONS} SELECT inbox_id, p.fingerprint AS fingerprint FROM judged WHERE differs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return merge.material_changes(*_versions(spark, sf))


@query("upsert_rows", f"""WITH {LEDGER}, writes AS (
      SELECT inbox_id, fingerprint, sms_id, amount + 1 AS amount, 1 AS seq FROM ledger WHERE sms_id % 2 = 0
      UNION ALL SELECT inbox_id, fingerprint, sms_id, amount + 2, 2 FROM ledger WHERE sms_id % 6 = 0
      UNION ALL SELECT inbox_id, 'new' || fingerprint, sms_id, amount, 1 FROM ledger WHERE sms_id % 10 = 0),
    latest AS (SELECT * FROM writes QUALIFY row_number() OVER (PARTITION BY inbox_id, fingerprint ORDER BY seq DESC) = 1)
    SELECT inbox_id, fingerprint, sms_id, CAST(amount AS DOUBLE) AS amount FROM latest
    UNION ALL SELECT inbox_id, fingerprint, sms_id, CAST(amount AS DOUBLE) FROM ledger ANTI JOIN latest USING (inbox_id, fingerprint)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table = views.ledger(spark, sf).select("inbox_id", "fingerprint", "sms_id", F.col("amount").cast("decimal(20,2)").alias("amount"))

    def write(test: str, plus: int, at: int, prefix: str = "") -> DataFrame:
        return table.where(test).select(
            "inbox_id", F.concat(F.lit(prefix), "fingerprint").alias("fingerprint"), "sms_id",
            (F.col("amount") + plus).cast("decimal(20,2)").alias("amount"), F.lit(at).alias("seq"),
        )

    writes = write("sms_id % 2 = 0", 1, 1).unionByName(write("sms_id % 6 = 0", 2, 2)).unionByName(
        write("sms_id % 10 = 0", 0, 1, "new"))
    return merge.upsert_rows(table, writes, ["inbox_id", "fingerprint"], "seq")


@query("delete_rows", f"WITH {LEDGER} SELECT inbox_id, sms_id FROM ledger WHERE kind <> 'transfer'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ledger = views.ledger(spark, sf)
    return merge.delete_rows(ledger, ledger.where("kind = 'transfer'"), merge.KEY).select("inbox_id", "sms_id")


KIND_FOR = """CASE WHEN kind_source = 'user' THEN kind WHEN {c} IN ('transfer', 'investment') THEN 'transfer'
      WHEN direction = 'credit' THEN CASE WHEN kind = 'refund' THEN 'refund' ELSE 'income' END ELSE 'expense' END"""


@query("kind_for_category", f"""WITH {LEDGER}
    SELECT inbox_id, sms_id, {KIND_FOR.format(c="coalesce(category, 'other')")} AS implied_kind FROM ledger""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    category = F.coalesce("category", F.lit("other"))
    return views.ledger(spark, sf).select("inbox_id", "sms_id", merge.kind_for(category).alias("implied_kind"))


def _corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth row's merchant is corrected, the last correction of a merchant counting."""
    return views.ledger(spark, sf).where("sms_id % 5 = 0 AND merchant IS NOT NULL").select(
        "inbox_id", F.upper("merchant").alias("merchant"),
        F.element_at(F.array(*[F.lit(c) for c in ("travel", "investment", "pet care", "9 bad")]),
                     (F.col("sms_id") % 4 + 1).cast("int")).alias("category"),
        F.col("sms_id").alias("at_ms"),
    )


CORRECTIONS = """rules AS (
    SELECT inbox_id, lower(merchant) AS merchant, arg_max(c, sms_id) AS new_category FROM (
      SELECT *, ['travel', 'investment', 'pet care', '9 bad'][sms_id % 4 + 1] AS c FROM ledger
      WHERE sms_id % 5 = 0 AND merchant IS NOT NULL) WHERE c <> '9 bad' GROUP BY 1, 2)"""


@query("correct_merchants", f"""WITH {LEDGER}, {CORRECTIONS}, joined AS (
      SELECT ledger.*, new_category, new_category IS NOT NULL AND NOT (category IS NOT DISTINCT FROM new_category
        AND category_source IS NOT DISTINCT FROM 'user') AS touched
      FROM ledger LEFT JOIN rules ON ledger.inbox_id = rules.inbox_id AND ledger.merchant = rules.merchant)
    SELECT inbox_id, sms_id, CASE WHEN touched THEN new_category ELSE category END AS category,
      CASE WHEN touched THEN 'user' ELSE category_source END AS category_source,
      CASE WHEN touched THEN {KIND_FOR.format(c='new_category')} ELSE kind END AS kind,
      CASE WHEN touched THEN FALSE ELSE needs_review END AS needs_review, touched FROM joined""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return merge.correct_merchants(views.ledger(spark, sf), _corrections(spark, sf)).select(
        "inbox_id", "sms_id", "category", "category_source", "kind", "needs_review", "touched")


@query("merchant_decisions", f"""WITH {LEDGER}, {CORRECTIONS}
    SELECT inbox_id, merchant AS merchant_key, new_category AS category, 'user' AS source FROM rules""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return merge.latest_corrections(_corrections(spark, sf)).select("inbox_id", "merchant_key", "category", "source")


@query("correct_rows", f"""WITH {LEDGER}
    SELECT inbox_id, sms_id, CASE WHEN sms_id % 8 = 0 THEN 'investment' ELSE category END AS category,
      CASE WHEN sms_id % 8 = 0 THEN {KIND_FOR.format(c="'investment'")} ELSE kind END AS kind,
      CASE WHEN sms_id % 8 = 0 THEN TRUE ELSE reviewed END AS reviewed FROM ledger""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ledger = views.ledger(spark, sf)
    patches = ledger.where("sms_id % 8 = 0").select("inbox_id", "fingerprint", F.lit("investment").alias("category"))
    return merge.correct_rows(ledger, patches).select("inbox_id", "sms_id", "category", "kind", "reviewed")


@query("set_kind_merchant_wide", f"""WITH {LEDGER}, origin AS (
      SELECT *, merchant IS NOT NULL AND sms_id % 2 = 0 AS wide FROM ledger WHERE sms_id % 20 = 0 OR sms_id % 20 = 3),
    wide_keys AS (SELECT DISTINCT inbox_id, merchant, direction FROM origin WHERE wide),
    reached AS (
      SELECT l.inbox_id, l.merchant, l.direction, bool_or(l.kind <> 'expense') AS reaches
      FROM ledger l JOIN wide_keys w ON l.inbox_id = w.inbox_id AND l.merchant = w.merchant AND l.direction = w.direction
      GROUP BY ALL),
    single AS (
      SELECT o.inbox_id, o.sms_id FROM origin o LEFT JOIN reached r
        ON o.inbox_id = r.inbox_id AND o.merchant = r.merchant AND o.direction = r.direction
      WHERE NOT o.wide OR NOT r.reaches)
    SELECT l.inbox_id, l.sms_id, CASE WHEN hit THEN 'expense' ELSE kind END AS kind,
      CASE WHEN hit THEN 'user' END AS kind_source
    FROM (SELECT ledger.*, s.sms_id IS NOT NULL OR (coalesce(reaches, FALSE) AND kind <> 'expense') AS hit
      FROM ledger LEFT JOIN reached r ON ledger.inbox_id = r.inbox_id AND ledger.merchant = r.merchant
        AND ledger.direction = r.direction
      LEFT JOIN single s ON ledger.inbox_id = s.inbox_id AND ledger.sms_id = s.sms_id) l""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ledger = views.ledger(spark, sf)
    patches = ledger.where("sms_id % 20 IN (0, 3)").select(
        "inbox_id", "fingerprint", F.lit("expense").alias("kind"), (F.col("sms_id") % 2 == 0).alias("merchant_wide"))
    return merge.set_kind(ledger, patches).select("inbox_id", "sms_id", "kind", "kind_source")


# --- categories ------------------------------------------------------------------------------------

NAMES = ("Swiggy Stores", "BigBasket", "UBER INDIA", "AMAZON", "airtel prepaid", "NETFLIX", "Apollo Diagnostics",
         "Byju Classes", "MakeMyTrip", "zerodha broking", "ACME Salary", "self", "Ramesh Kumar", "RAVI TEJA",
         "ZZQQ ENTERPRISES", "q9", "Corner Shop 7", "BOTTLE LAB TECHNOLOGIES PRI", "Wok")


def _named(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in NAMES])
    return views.ledger(spark, sf).withColumn(
        "merchant", F.when(F.col("sms_id") % 23 < 19, F.element_at(names, (F.col("sms_id") % 23 + 1).cast("int")))
    ).withColumn("sender_id", F.regexp_replace(F.upper("sender"), "^[A-Z]{2}-", ""))


_NAME_LIST = ", ".join(f"'{n}'" for n in NAMES)
NAMED = f"""{LEDGER}, named AS (
    SELECT * REPLACE (CASE WHEN sms_id % 23 < 19 THEN [{_NAME_LIST}][sms_id % 23 + 1] END AS merchant),
      substr(sender, 4) AS sender_id FROM ledger)"""
_RULES = " ".join(f"WHEN regexp_matches(merchant, '(?i){p}') THEN '{c}'" for c, p in V.MERCHANT_RULES)
RULED = f"""{NAMED}, ruled AS (
    SELECT *, CASE {_RULES} END AS label,
      direction = 'debit' AND merchant IN ('Ramesh Kumar', 'RAVI TEJA') AS personal FROM named),
  decided AS (
    SELECT *, CASE WHEN merchant IS NULL THEN CASE WHEN direction = 'credit' THEN 'income' END
        WHEN label IS NOT NULL THEN label WHEN personal THEN 'transfer' END AS rule_category,
      CASE WHEN merchant IS NULL THEN CASE WHEN direction = 'credit' THEN 'rule' END
        WHEN label IS NOT NULL THEN 'rule' WHEN personal THEN 'guess' END AS rule_source FROM ruled)"""


@query("rule_categories", f"WITH {RULED} SELECT inbox_id, sms_id, merchant, rule_category, rule_source FROM decided")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return categories.rule_categories(_named(spark, sf)).select(
        "inbox_id", "sms_id", "merchant", "rule_category", "rule_source")


def _ladder_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = _named(spark, sf)
    decisions = named.where("sms_id % 4 = 0 AND merchant IS NOT NULL").groupBy(
        "inbox_id", merchant_key(F.col("merchant")).alias("merchant_key")
    ).agg(F.max("sms_id").alias("last")).select(
        "inbox_id", "merchant_key", F.when(F.col("last") % 8 == 0, "travel").otherwise("food").alias("category"),
        F.when(F.col("last") % 8 == 0, "user").otherwise("llm").alias("source"),
    )
    priors = named.select("inbox_id", "sender_id").distinct().where("sender_id = 'MYNTRA'").withColumn(
        "category", F.lit("shopping"))
    predictions = named.where("sms_id % 3 = 0").select("inbox_id", "sms_id", F.lit("health").alias("category"))
    return decisions, priors, predictions


KEYED = f"""{RULED}, keyed AS (
    SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(merchant, '')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))
      AS merchant_key FROM decided),
  said AS (
    SELECT inbox_id, merchant_key, max(sms_id) % 8 = 0 AS is_user FROM keyed
    WHERE sms_id % 4 = 0 AND merchant IS NOT NULL GROUP BY 1, 2),
  laddered AS (
    SELECT keyed.*, CASE
      WHEN kind = 'transfer' THEN 'transfer/rule'
      WHEN merchant_quality <> 'named' THEN 'other/unresolved'
      WHEN is_user THEN 'travel/user'
      WHEN rule_category IS NOT NULL THEN rule_category || '/' || rule_source
      WHEN keyed.merchant_key = '' THEN 'other/rule'
      WHEN NOT is_user THEN 'food/llm'
      WHEN sender_id = 'MYNTRA' THEN 'shopping/sender'
      WHEN sms_id % 3 = 0 THEN 'health/model'
      ELSE 'other/fallback' END AS outcome
    FROM keyed LEFT JOIN said ON keyed.inbox_id = said.inbox_id AND keyed.merchant_key = said.merchant_key
      AND keyed.merchant_key <> ''),
  resolved AS (
    SELECT * REPLACE (split_part(outcome, '/', 1) AS category, split_part(outcome, '/', 2) AS category_source,
      CASE WHEN outcome LIKE '%/guess' THEN 'transfer' ELSE kind END AS kind,
      outcome LIKE '%/guess' OR needs_review AS needs_review) FROM laddered)"""


@query("resolve_categories", f"WITH {KEYED} SELECT inbox_id, sms_id, category, category_source, kind, needs_review FROM resolved")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return categories.resolve_categories(_named(spark, sf), *_ladder_tables(spark, sf)).select(
        "inbox_id", "sms_id", "category", "category_source", "kind", "needs_review")


@query("unknown_merchants", f"""WITH {KEYED}
    SELECT inbox_id, merchant_key, min(merchant) AS merchant FROM resolved WHERE category_source = 'fallback'
    GROUP BY 1, 2""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return categories.unknown_merchants(
        categories.resolve_categories(_named(spark, sf), *_ladder_tables(spark, sf)))


@query("apply_labels", f"""WITH {KEYED}
    SELECT inbox_id, sms_id, CASE WHEN category_source = 'fallback' THEN
        CASE WHEN merchant = 'Wok' THEN 'food' ELSE 'other' END ELSE category END AS category,
      CASE WHEN category_source = 'fallback' THEN 'llm' ELSE category_source END AS category_source FROM resolved""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    resolved = categories.resolve_categories(_named(spark, sf), *_ladder_tables(spark, sf))
    labels = categories.unknown_merchants(resolved).withColumn(
        "label", F.when(F.col("merchant") == "Wok", " Food. ").otherwise("gadgetry"))
    return categories.apply_labels(resolved, labels).select("inbox_id", "sms_id", "category", "category_source")


@query("learned_rules", f"""WITH {KEYED} SELECT inbox_id, merchant_key FROM said WHERE is_user""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return categories.learned_rules(_ladder_tables(spark, sf)[0]).select("inbox_id", "merchant_key")


@query("forget_rules", f"""WITH {KEYED} SELECT inbox_id, merchant_key FROM said WHERE NOT is_user""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    decisions = _ladder_tables(spark, sf)[0]
    return categories.forget_rules(decisions, categories.learned_rules(decisions)).select("inbox_id", "merchant_key")


@query("category_names", f"""WITH {LEDGER}, own AS (
      SELECT inbox_id, lower('  Cat ' || (sms_id % 30) || CASE WHEN sms_id % 7 = 0 THEN '!' ELSE '' END) AS name FROM ledger)
    SELECT DISTINCT inbox_id, trim(name) AS name FROM own WHERE NOT contains(name, '!')
    UNION SELECT DISTINCT inbox_id, unnest([{', '.join(f"'{c}'" for c in V.CATEGORIES)}]) FROM ledger""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    custom = views.ledger(spark, sf).select("inbox_id", F.concat(
        F.lit("  Cat "), F.col("sms_id") % 30, F.when(F.col("sms_id") % 7 == 0, "!").otherwise("")).alias("name"))
    return categories.category_names(custom)


@query("merchant_key", """SELECT page_id,
      trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS merchant_key FROM pages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "pages").select("page_id", merchant_key(F.col("url")).alias("merchant_key"))


@query("amount_magnitude", f"""WITH {LEDGER}
    SELECT inbox_id, CASE WHEN amount < 100 THEN 'xs' WHEN amount < 500 THEN 's' WHEN amount < 2000 THEN 'm'
      WHEN amount < 10000 THEN 'l' ELSE 'xl' END AS magnitude, count(*) AS n FROM ledger GROUP BY 1, 2""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return views.ledger(spark, sf).groupBy("inbox_id", model.magnitude(F.col("amount")).alias("magnitude")).agg(
        F.count("*").alias("n"))


# --- exports and scans -----------------------------------------------------------------------------

@query("csv_rows", f"""WITH {LEDGER}
    SELECT strftime(date_trunc('millisecond', date), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS date, kind, direction,
      {trimmed('amount')} AS amount, currency, merchant, category, category_source AS "categorySource",
      CAST(NULL AS VARCHAR) AS channel, account, CAST(NULL AS VARCHAR) AS bank, CAST(NULL AS VARCHAR) AS ref,
      {trimmed('CAST(confidence_pct / 100 AS DECIMAL(4,2))')} AS confidence,
      CAST(needs_review AS VARCHAR) AS "needsReview" FROM ledger""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return writers.csv_rows(views.ledger(spark, sf), "UTC")


@query("message_scan", """SELECT CAST(user_id AS VARCHAR) AS inbox_id, event_id AS id FROM events
    WHERE epoch_ms(date_trunc('second', ts)) < 1705752000000 AND epoch_ms(date_trunc('second', ts)) > 1705000000000""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.messages_rendered(spark, sf)
    return readers.scan_messages(rows, before=1705752000000, since=1705000000000).select("inbox_id", "id")
