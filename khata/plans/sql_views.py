"""The views of ``views.py`` in SQL, as common table expressions."""

LEDGER = """ledger AS (
  SELECT event_id AS sms_id, CAST(user_id AS VARCHAR) AS inbox_id, 'e' || event_id AS fingerprint, ts AS date,
    CASE event_type WHEN 'purchase' THEN 'expense' WHEN 'click' THEN 'expense' WHEN 'signup' THEN 'income'
      WHEN 'error' THEN (CASE WHEN event_id % 4 = 0 THEN 'refund' ELSE 'transfer' END) ELSE 'transfer' END AS kind,
    CASE WHEN event_type IN ('signup', 'error') THEN 'credit' ELSE 'debit' END AS direction,
    CAST(value AS DECIMAL(18,2)) AS amount,
    CASE WHEN event_id % 97 = 0 THEN 'USD' ELSE 'INR' END AS currency,
    CASE WHEN event_id % 97 = 0 THEN CAST(value AS DECIMAL(18,2)) END AS foreign_amount,
    CASE WHEN event_id % 29 = 0 THEN NULL ELSE ['food', 'groceries', 'transport', 'shopping', 'bills',
      'entertainment', 'health', 'education', 'travel', 'transfer', 'investment', 'income', 'other'][event_id % 13 + 1]
      END AS category,
    ['user', 'rule', 'sender', 'model', 'llm', 'guess', 'fallback', 'unresolved', NULL][event_id % 9 + 1] AS category_source,
    CASE WHEN k >= 5 THEN 'store' || k END AS merchant,
    CASE WHEN k < 5 THEN NULL WHEN event_id % 11 = 0 THEN 'opaque' WHEN event_id % 11 = 1 THEN 'phone'
      ELSE 'named' END AS merchant_quality,
    CAST(1000 + event_id % 4 AS VARCHAR) AS account,
    ['AX-HDFCBK', 'VM-ICICIB', 'JD-SBIINB', 'BP-AXISBK', 'AD-MYNTRA'][k % 5 + 1] AS sender,
    CAST(40 + event_id % 56 AS INT) AS confidence_pct,
    (event_type = 'click' OR event_id % 97 = 0) AS needs_review,
    ((event_type = 'click' OR event_id % 97 = 0) AND event_id % 10 = 0) AS reviewed,
    k >= 5 AND event_id % 11 = 1 AS ambiguous_p2p,
    CASE WHEN event_id % 31 = 0 THEN 'checked by hand' END AS review_reason_override,
    CAST(NULL AS VARCHAR) AS kind_source,
    'row ' || event_id || ' ' || event_type AS raw, k
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""

ORDERS = """ledger AS (
  SELECT o_orderkey AS sms_id, CAST(o_custkey AS VARCHAR) AS inbox_id, 'o' || o_orderkey AS fingerprint,
    o_orderdate AS date,
    CASE WHEN o_orderstatus = 'O' THEN 'expense' WHEN o_orderkey % 5 = 0 THEN 'refund'
      WHEN o_orderkey % 5 = 1 THEN 'income' WHEN o_orderkey % 5 = 2 THEN 'transfer' ELSE 'expense' END AS kind,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 'INR' AS currency,
    lower(substr(o_orderpriority, 3)) AS category, 'clerk' || (o_orderkey % 50) AS merchant,
    o_orderkey % 17 = 0 AS needs_review, FALSE AS reviewed
  FROM orders)"""

PAIRS = LEDGER + """, stepped AS (
  SELECT * REPLACE (CAST(floor(amount / 10) * 10 AS DECIMAL(18,2)) AS amount) FROM ledger),
  pairable AS (SELECT * FROM stepped WHERE kind IN ('expense', 'income'))"""

# one row per event with the parts which the rendered messages are made of
PARTS = """parts AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS inbox_id, event_type, ts,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    CAST(value AS DECIMAL(18,2)) AS amount, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amt,
    CAST(1000 + event_id % 4 AS VARCHAR) AS acc, strftime(ts, '%d-%m-%y') AS day,
    CAST(ts AS DATE) AS due, 'EVT' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS ref,
    CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS date_ms
  FROM events)"""

COUNTED = "NOT (needs_review AND NOT reviewed)"
PENDING = "(needs_review AND NOT reviewed)"
SPEND = "(kind = 'expense' AND currency = 'INR' AND category IS DISTINCT FROM 'investment')"
REFUND = "(kind = 'refund' AND currency = 'INR')"
INCOME = "(kind = 'income' AND currency = 'INR')"
TRANSFER = "(kind = 'transfer')"


def total(test: str) -> str:
    """Exact sum of the amounts of some rows."""
    return f"sum(CASE WHEN {test} THEN amount ELSE 0 END)"


def trimmed(amount: str) -> str:
    """An exact amount as text without trailing zeros."""
    return f"regexp_replace(regexp_replace(CAST({amount} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
