"""Ledgers and messages as views over the given tables.

The tables hold no bank messages, so the ledger is a projection of ``events`` (and, for longer
periods, of ``orders``) and messages are rendered from it.  Every view is one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions.clock import wall_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part for pattern work, which takes about a millisecond a row.
PART_ROWS = 20_000


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table dealt out evenly before pattern work: a part for each core at least, and no part over ``PART_ROWS`` rows.

    Neither the splits of a large file nor the number of small ones say how many rows a task gets: only those splits which hold
    the middle of a row group have rows, and the scan packs small files together.  A table of as many files and as many
    scan partitions as parts is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-df.count() // PART_ROWS))  # Parquet footers know the count
    left = len(df.inputFiles()) >= parts and df.rdd.getNumPartitions() >= parts
    return df if left else df.repartition(parts)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows out of ``events``; one inbox per user."""
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
        .selectExpr(
            "event_id AS sms_id",
            "CAST(user_id AS STRING) AS inbox_id",
            "concat('e', event_id) AS fingerprint",
            "ts AS date",
            """CASE event_type WHEN 'purchase' THEN 'expense' WHEN 'click' THEN 'expense'
                 WHEN 'signup' THEN 'income'
                 WHEN 'error' THEN (CASE WHEN event_id % 4 = 0 THEN 'refund' ELSE 'transfer' END)
                 ELSE 'transfer' END AS kind""",
            "CASE WHEN event_type IN ('signup', 'error') THEN 'credit' ELSE 'debit' END AS direction",
            "CAST(value AS DECIMAL(18,2)) AS amount",
            "CASE WHEN event_id % 97 = 0 THEN 'USD' ELSE 'INR' END AS currency",
            "CASE WHEN event_id % 97 = 0 THEN CAST(value AS DECIMAL(18,2)) END AS foreign_amount",
            "CASE WHEN event_id % 97 = 0 THEN 'USD' END AS foreign_currency",
            """CASE WHEN event_id % 29 = 0 THEN NULL ELSE element_at(array('food', 'groceries',
                 'transport', 'shopping', 'bills', 'entertainment', 'health', 'education', 'travel',
                 'transfer', 'investment', 'income', 'other'), CAST(event_id % 13 AS INT) + 1)
               END AS category""",
            """element_at(array('user', 'rule', 'sender', 'model', 'llm', 'guess', 'fallback',
                 'unresolved', NULL), CAST(event_id % 9 AS INT) + 1) AS category_source""",
            "CASE WHEN k >= 5 THEN concat('store', k) END AS merchant",
            """CASE WHEN k < 5 THEN NULL WHEN event_id % 11 = 0 THEN 'opaque'
                 WHEN event_id % 11 = 1 THEN 'phone' ELSE 'named' END AS merchant_quality""",
            "CAST(1000 + event_id % 4 AS STRING) AS account",
            "element_at(array('AX-HDFCBK', 'VM-ICICIB', 'JD-SBIINB', 'BP-AXISBK', 'AD-MYNTRA'), "
            "CAST(k % 5 AS INT) + 1) AS sender",
            "CAST(40 + event_id % 56 AS INT) AS confidence_pct",
            "(event_type = 'click' OR event_id % 97 = 0) AS needs_review",
            "((event_type = 'click' OR event_id % 97 = 0) AND event_id % 10 = 0) AS reviewed",
            "k >= 5 AND event_id % 11 = 1 AS ambiguous_p2p",
            "CASE WHEN event_id % 31 = 0 THEN 'checked by hand' END AS review_reason_override",
            "CAST(NULL AS STRING) AS kind_source",
            "concat('row ', event_id, ' ', event_type) AS raw",
        )
    )


def ledger_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with amounts in steps of ten, so that equal ones meet."""
    return ledger(spark, sf_dir).withColumn("amount", (F.floor(F.col("amount") / 10) * 10).cast("decimal(18,2)"))


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of ledger rows out of ``orders``; one inbox per customer."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS sms_id",
        "CAST(o_custkey AS STRING) AS inbox_id",
        "concat('o', o_orderkey) AS fingerprint",
        "o_orderdate AS date",
        """CASE WHEN o_orderstatus = 'O' THEN 'expense' WHEN o_orderkey % 5 = 0 THEN 'refund'
             WHEN o_orderkey % 5 = 1 THEN 'income' WHEN o_orderkey % 5 = 2 THEN 'transfer'
             ELSE 'expense' END AS kind""",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        "'INR' AS currency",
        "lower(substr(o_orderpriority, 3)) AS category",
        "concat('clerk', o_orderkey % 50) AS merchant",
        "o_orderkey % 17 = 0 AS needs_review",
        "FALSE AS reviewed",
    )


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spread(table(spark, sf_dir, "events"))
        .withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
        .withColumn("date_ms", F.floor(wall_micros(F.col("ts")) / 1_000_000) * 1000)
        .selectExpr(
            "event_id AS id", "CAST(user_id AS STRING) AS inbox_id", "event_type", "k",
            "CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS amt",
            "CAST(1000 + event_id % 4 AS STRING) AS acc",
            "date_format(ts, 'dd-MM-yy') AS day",
            "concat('EVT', lpad(CAST(event_id AS STRING), 9, '0')) AS ref",
            "date_ms",
        )
    )


def messages_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bank message per event."""
    return _rows(spark, sf_dir).selectExpr(
        "inbox_id", "id",
        """CASE
           WHEN event_type IN ('purchase', 'click') THEN
             concat('Rs.', amt, ' debited from a/c XX', acc, ' on ', day, ' to VPA store', k, '@ybl. Ref ', ref)
           WHEN event_type = 'signup' THEN
             concat('Rs.', amt, ' credited to a/c XX', acc, ' on ', day, ' by NEFT from ACME', k, ' CORP. Ref ', ref)
           WHEN event_type = 'error' THEN
             concat('Rs.', amt, ' credited to a/c XX', acc, ' on ', day, '. Refund from STORE', k, '. Ref ', ref)
           ELSE
             concat('Rs.', amt, ' debited from a/c XX', acc, ' on ', day, ' towards HDFC Credit Card payment. Ref ', ref)
           END AS body""",
        "date_ms", "'AX-HDFCBK' AS address",
    )


def messages_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inbox of every tab: payments, codes, balances, offers, bills, deliveries, people, spam."""
    return _rows(spark, sf_dir).selectExpr(
        "inbox_id", "id",
        """CASE CAST(id % 12 AS INT)
           WHEN 0 THEN concat('Rs.', amt, ' debited from a/c XX', acc, ' on ', day, ' to VPA store', k, '@ybl. Ref ', ref)
           WHEN 1 THEN concat('Your OTP is ', 100000 + id % 899999, ' for txn of Rs.', amt, '. Do not share.')
           WHEN 2 THEN concat('Avl bal in a/c XX', acc, ' is Rs.', amt, ' as on ', day, '.')
           WHEN 3 THEN concat('FLAT ', k, '% off! Shop now and save Rs ', amt, '. Click here to begin.')
           WHEN 4 THEN concat('Your HDFC Credit Card XX', acc, ' bill of Rs.', amt, ' is due on ', day, '. Minimum amount due Rs.10.')
           WHEN 5 THEN concat('Order ', ref, ' placed. Your parcel will arrive on ', day)
           WHEN 6 THEN concat('Reached home at ', k, ', speak later')
           WHEN 7 THEN concat('You have won a lottery of Rs ', amt, '. Claim now.')
           WHEN 8 THEN concat('Payee P', k, ' added. Transfer funds after 30 mins.')
           WHEN 9 THEN concat('Your account XX', acc, ' was settled at branch ', k)
           WHEN 10 THEN concat('Rs.', amt, ' payment returned on ', day, ' for card XX', acc, '. Make alternate pymt.')
           ELSE concat('Weather note number ', k) END AS body""",
        "date_ms",
        """CASE CAST(id % 12 AS INT) WHEN 6 THEN concat('+9198765', lpad(CAST(k AS STRING), 5, '0'))
             WHEN 11 THEN 'AX-WEATHR' ELSE 'AX-HDFCBK' END AS address""",
    )


def messages_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments in steps of ten, a quarter of them reported once more by the payment app."""
    base = _rows(spark, sf_dir).withColumn(
        "amt", F.expr("CAST(CAST(amt AS DECIMAL(18,2)) DIV 10 * 10 + 10 AS STRING)")
    )
    bank = base.selectExpr(
        "inbox_id", "id * 2 AS id",
        "concat('Rs.', amt, ' debited from a/c XX', acc, ' on ', day, ' to VPA store', k % 7, '@ybl. Ref ', ref) AS body",
        "date_ms", "'AX-HDFCBK' AS address",
    )
    app = base.where("id % 4 = 0").selectExpr(
        "inbox_id", "id * 2 + 1 AS id",
        "concat('You paid Rs.', amt, ' to Store', k % 7, ' via Paytm UPI on ', day) AS body",
        "date_ms + 40000 AS date_ms", "'JM-PAYTM' AS address",
    )
    return bank.unionByName(app)


def labelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-labelled rows out of ``part``: the name is the merchant, the type its category."""
    return spread(table(spark, sf_dir, "part")).selectExpr(
        "p_brand AS inbox_id", "p_partkey AS sms_id", "concat('p', p_partkey) AS fingerprint",
        "p_name AS merchant",
        # two of three labels follow the second word of the name, so that there is something to learn
        """lower(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE split_part(p_name, ' ', 2) END) AS category""",
        "'user' AS category_source", "'debit' AS direction",
        "CAST(p_retailprice AS DECIMAL(18,2)) AS amount", "'upi' AS channel",
        "concat('AX-SND', p_size) AS sender", "CAST(NULL AS STRING) AS bank",
    )


def labelled_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-labelled ledger rows whose category nearly always follows the sender."""
    return ledger(spark, sf_dir).withColumn(
        "category", F.expr("""CASE WHEN sms_id % 25 = 0 THEN 'travel' WHEN sender LIKE '%MYNTRA' THEN 'shopping'
            WHEN sender LIKE '%HDFCBK' AND sms_id % 2 = 0 THEN 'food' WHEN sender LIKE '%HDFCBK' THEN 'bills'
            ELSE lower(substr(sender, 4)) END""")
    )
