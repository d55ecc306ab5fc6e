"""Spending reports over a ledger.

A ledger row has inbox_id, sms_id, date (local TIMESTAMP_NTZ), kind, amount, currency, category,
merchant, needs_review and reviewed.  Reports are made per ``keys`` (the inbox), with exact decimal
sums.  Each report is one filter and one aggregation with map-side partial sums; "first row" means
first by (date, sms_id).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions import clock
from khata.functions.clock import Span
from khata.functions.money import (
    amount_if, is_counted, is_income, is_pending, is_refund, is_spend, is_transfer,
    merchant_or_unknown, zero,
)
from khata.session import cut_lineage

Keys = tuple[str, ...]
INBOX: Keys = ("inbox_id",)


def day_of(moment: Column) -> Column:
    return F.to_date(moment)


def within(ledger: DataFrame, span: Span) -> DataFrame:
    """Rows of a period.  The time bounds reach the scan; a ledger with a ``month`` column, as written by ``write_ledger``, reads
    only the folders of the period's months."""
    rows = ledger.where(span.covers(F.col("date")))
    if "month" in ledger.columns:
        rows = rows.where(F.col("month").between(f"{span.start:%Y-%m}", f"{span.end:%Y-%m}"))
    return rows


def rows_in(ledger: DataFrame, span: Span) -> DataFrame:
    """Counted rows of a period."""
    return within(ledger, span).where(is_counted())


def _floor_zero(amount: Column) -> Column:
    return F.greatest(zero(), amount)


def _by_order() -> Column:
    return F.struct("date", "sms_id")


def period_summary(ledger: DataFrame, span: Span, keys: Keys = INBOX) -> DataFrame:
    """All headline figures of a period in one pass."""
    sums = rows_in(ledger, span).groupBy(*keys).agg(
        amount_if(is_spend()).alias("gross"),
        amount_if(is_refund()).alias("refunded"),
        amount_if(is_income()).alias("received"),
        amount_if(is_transfer()).alias("transferred"),
        F.count("*").alias("count"),
    )
    spent = _floor_zero(F.col("gross") - F.col("refunded"))
    return sums.select(
        *keys, spent.alias("spent"), "gross", "refunded", "received", "transferred",
        (F.col("received") - spent).alias("net"), "count",
    )


def spend_by_category(ledger: DataFrame, span: Span, keys: Keys = INBOX) -> DataFrame:
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("other"))
    return (
        rows_in(ledger, span).where(is_spend())
        .groupBy(*keys, category.alias("category")).agg(F.sum("amount").alias("total"))
    )


def spend_by_merchant(ledger: DataFrame, span: Span, keys: Keys = INBOX) -> DataFrame:
    """Total and count per merchant, with the spelling and category of its first row."""
    first = F.min_by(F.struct("merchant", "category"), _by_order())
    name = F.coalesce(F.nullif(first["merchant"], F.lit("")), F.lit("Unknown"))
    return (
        rows_in(ledger, span).where(is_spend())
        .groupBy(*keys, merchant_or_unknown(F.col("merchant")).alias("merchant_id"))
        .agg(
            name.alias("name"), first["category"].alias("category"),
            F.sum("amount").alias("total"), F.count("*").alias("count"),
        )
    )


def top_merchants(ledger: DataFrame, span: Span, n: int = 8, keys: Keys = INBOX) -> DataFrame:
    rank = Window.partitionBy(*keys).orderBy(F.desc("total"), "merchant_id")
    return (
        spend_by_merchant(ledger, span, keys)
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)
    )


def spend_by_day(ledger: DataFrame, span: Span, keys: Keys = INBOX) -> DataFrame:
    return (
        rows_in(ledger, span).where(is_spend())
        .groupBy(*keys, day_of(F.col("date")).alias("day")).agg(F.sum("amount").alias("total"))
    )


def largest_spend(ledger: DataFrame, span: Span, keys: Keys = INBOX) -> DataFrame:
    """The largest single expense; of equal ones the first."""
    row = F.struct("sms_id", "date", "merchant", "amount", "category")
    order = F.struct(-F.col("amount"), F.col("date"), F.col("sms_id"))
    return (
        rows_in(ledger, span).where(is_spend())
        .groupBy(*keys).agg(F.min_by(row, order).alias("row")).select(*keys, "row.*")
    )


def daily_buckets(ledger: DataFrame, span: Span, keys: Keys = INBOX) -> DataFrame:
    """Active days of a period.

    ``review`` is always 0, because rows to be reviewed are not counted; ``pending_rows`` tells how
    many of them the day has.
    """
    counted = is_counted()
    return (
        within(ledger, span)
        .groupBy(*keys, day_of(F.col("date")).alias("day"))
        .agg(
            _floor_zero(amount_if(counted & is_spend()) - amount_if(counted & is_refund())).alias("spend"),
            amount_if(counted & is_income()).alias("income"),
            F.count_if(counted).alias("count"),
            F.lit(0).cast("bigint").alias("review"),
            F.count_if(~counted).alias("pending_rows"),
        )
        .where(F.col("count") > 0)
    )


def daily_totals(ledger: DataFrame, span: Span, keys: Keys = INBOX) -> DataFrame:
    """Totals of the daily view; the average is over days with spending."""
    active = F.count_if(F.col("spend") > 0)
    return daily_buckets(ledger, span, keys).groupBy(*keys).agg(
        F.sum("spend").alias("total"), F.sum("count").alias("count"), F.count("*").alias("days"),
        active.alias("days_with_spend"),
        F.when(active > 0, F.sum("spend").cast("double") / active).alias("average"),
    )


def _calendar(groups: DataFrame, keys: Keys, first: datetime, last: datetime) -> DataFrame:
    """Every day of a span for every group."""
    days = F.sequence(F.lit(first.date()), F.lit(last.date()))
    return groups.select(*keys).distinct().select(*keys, F.explode(days).alias("day"))


def last_n_days(ledger: DataFrame, n: int, now: datetime, keys: Keys = INBOX) -> DataFrame:
    """The last ``n`` calendar days with the quiet ones; also rows later than now on the last day."""
    first = datetime(now.year, now.month, now.day) - timedelta(days=n - 1)
    last = datetime(now.year, now.month, now.day)
    span = Span(first, clock.day_span(last.date()).end)
    sums = (
        rows_in(ledger, span).groupBy(*keys, day_of(F.col("date")).alias("day"))
        .agg(
            (amount_if(is_spend()) - amount_if(is_refund())).alias("spend"),
            F.count("*").alias("count"),
        )
    )
    return (
        _calendar(ledger, keys, first, last).join(sums, [*keys, "day"], "left")
        .select(
            *keys, "day", _floor_zero(F.coalesce("spend", zero())).alias("spend"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def sparkline(ledger: DataFrame, span: Span, keys: Keys = INBOX) -> DataFrame:
    """Gross spend of every day of a period, at most its last sixty days."""
    first = max(span.start, span.end - timedelta(days=60))
    whole_days = Span(max(span.start, datetime(first.year, first.month, first.day)), span.end)
    # a series starting within a day steps by whole days from there and ends with the last full step
    last = first + timedelta(days=(span.end - first).days)
    totals = spend_by_day(ledger, whole_days, keys)
    return (
        _calendar(ledger, keys, first, last).join(totals, [*keys, "day"], "left")
        .select(*keys, "day", F.coalesce("total", zero()).alias("total"))
    )


def month_projection(ledger: DataFrame, now: datetime, keys: Keys = INBOX) -> DataFrame:
    """Spend at month's end at the pace so far; null on the first two days."""
    spent = F.col("spent").cast("double")
    projected = spent / now.day * clock.days_in_month(now)
    return period_summary(ledger, clock.period("this_month", now), keys).select(
        *keys, "spent", (projected if now.day > 2 else F.lit(None).cast("double")).alias("projected")
    )


def month_change(ledger: DataFrame, now: datetime, keys: Keys = INBOX) -> DataFrame:
    """Spend of this and the last month and the change in percent, both from one scan."""
    this, last = clock.period("this_month", now), clock.period("last_month", now)
    both = Span(last.start, this.end)
    in_this, in_last = this.covers(F.col("date")), last.covers(F.col("date"))
    sums = rows_in(ledger, both).groupBy(*keys).agg(
        _floor_zero(amount_if(in_this & is_spend()) - amount_if(in_this & is_refund())).alias("this_month"),
        _floor_zero(amount_if(in_last & is_spend()) - amount_if(in_last & is_refund())).alias("last_month"),
    )
    now_, then = F.col("this_month").cast("double"), F.col("last_month").cast("double")
    return sums.withColumn("change_pct", F.when(then > 0, (now_ - then) / then * 100))


def today_spend(ledger: DataFrame, now: datetime, keys: Keys = INBOX) -> DataFrame:
    return rows_in(ledger, clock.day_span(now.date())).groupBy(*keys).agg(
        _floor_zero(amount_if(is_spend()) - amount_if(is_refund())).alias("spend"),
        F.count("*").alias("count"),
    )


def coverage(ledger: DataFrame, keys: Keys = INBOX) -> DataFrame:
    """How rows got their category, in exclusive counts, and what is missing."""
    source = F.coalesce(F.nullif(F.col("category_source"), F.lit("")), F.lit("unresolved"))

    def by(name: str) -> Column:
        return F.count_if(source == name).alias(name)

    no_category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("other")) == "other"
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("total"),
        by("user"), by("rule"), by("sender"), by("model"), by("llm"), by("guess"), by("fallback"),
        by("unresolved"),
        F.count_if(is_pending()).alias("pending_review"),
        F.count_if(no_category).alias("uncategorised"),
        F.count_if(F.nullif(F.col("merchant"), F.lit("")).isNull()).alias("no_merchant"),
        F.count_if(F.col("currency") != "INR").alias("foreign"),
    )


def page(rows: DataFrame, keys: Keys, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of every key, in the given order.  Spark drops what lies behind before it
    shuffles, so a large inbox costs a page per task."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    found = rows.withColumn("_place", place).where(F.col("_place") <= offset + limit)
    return found.where(F.col("_place") > offset).drop("_place")


def search_transactions(ledger: DataFrame, query: str = "", category: str | None = None,
                        limit: int = 50, offset: int = 0, keys: Keys = INBOX) -> DataFrame:
    """A page of the newest rows, per inbox, whose merchant, amount or message contains the text."""
    q = query.strip().lower()
    rows = ledger if category is None else ledger.where(F.col("category") == category)
    if q:
        # the displayed amount has no trailing zeros
        shown = F.regexp_replace(F.regexp_replace(F.col("amount").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        rows = rows.where(
            F.lower(F.coalesce("merchant", F.lit(""))).contains(q)
            | shown.contains(q)
            | F.lower(F.coalesce("raw", F.lit(""))).contains(q)
        )
    return page(rows, keys, [F.desc("date"), F.desc("sms_id")], limit, offset)


def distinct_categories(ledger: DataFrame, keys: Keys = INBOX) -> DataFrame:
    return ledger.select(*keys, "category").where(F.nullif(F.col("category"), F.lit("")).isNotNull()).distinct()


DRILLS = ("today", "this_month", "spent", "received", "period", "daily")


def drill_down(ledger: DataFrame, tile: str, now: datetime, period: str = "this_month") -> DataFrame:
    """The rows behind a headline figure, newest first within the caller's own ordering."""
    counted = is_counted()
    if tile == "today":
        return within(ledger, clock.day_span(now.date())).where(counted)
    if tile == "this_month":
        return ledger.where((F.col("date") >= clock.ntz(clock.period("this_month", now).start)) & counted)
    rows = rows_in(ledger, clock.period(period, now))
    if tile in ("spent", "daily"):
        return rows.where(is_spend())
    if tile == "received":
        return rows.where(is_income())
    if tile == "period":
        return rows
    raise ValueError(f"unknown tile: {tile}")


def day_rows(ledger: DataFrame, day: datetime) -> DataFrame:
    """All rows of one day, counted or not."""
    return within(ledger, clock.day_span(day.date()))


def fact_sheet(ledger: DataFrame, question: str, categories: tuple[str, ...], now: datetime,
               keys: Keys = INBOX) -> DataFrame:
    """The figures a question may be answered from, rounded half up to whole rupees.

    The ledger is read once: one aggregation sums up inboxes, their categories and their merchants for all three periods.  Its result is
    written, small as it is, and folded into maps, so no list grows with the rows.
    """
    this, last = clock.period("this_month", now), clock.period("last_month", now)
    in_this, in_last = this.covers(F.col("date")), last.covers(F.col("date"))
    until_now = clock.period("all", now).covers(F.col("date"))
    counted = is_counted()
    focus = next((c for c in categories if c in question.lower()), None)

    def whole(amount: Column) -> Column:
        return F.floor(amount + F.lit("0.5").cast("decimal(2,1)")).cast("bigint")

    def spent(test: Column) -> Column:
        return _floor_zero(amount_if(test & is_spend()) - amount_if(test & is_refund()))

    this_c, last_c, all_c = counted & in_this, counted & in_last, counted & until_now
    this_spend = this_c & is_spend()
    heads = {
        "this_spent": whole(spent(this_c)),
        "this_received": whole(amount_if(this_c & is_income())),
        "this_transactions": F.count_if(this_c),
        "last_spent": whole(spent(last_c)),
        "last_received": whole(amount_if(last_c & is_income())),
        "last_transactions": F.count_if(last_c),
        "all_spent": whole(spent(all_c)),
        "all_transactions": F.count_if(all_c),
        "this_refunds": whole(amount_if(this_c & is_refund())),
        "transfers_excluded": amount_if(this_c & is_transfer()) > 0,
        "excluded_pending_review": F.count_if(is_pending()),
        "_largest": F.min_by(
            F.when(this_spend, F.struct("merchant", "amount", F.to_date("date").alias("day"))),
            F.when(this_spend, F.struct(-F.col("amount"), F.col("date"), F.col("sms_id"))),
        ),
    }
    named = ledger.withColumns({
        "_category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("other")), "_merchant": merchant_or_unknown(F.col("merchant")),
    })
    inbox = [F.col(k) for k in keys]
    sums = cut_lineage(named.groupingSets([inbox, [*inbox, F.col("_category")], [*inbox, F.col("_merchant")]], *inbox, "_category", "_merchant").agg(
        (2 * F.grouping("_category") + F.grouping("_merchant")).alias("_set"),
        *[value.alias(name) for name, value in heads.items()],
        F.sum(F.when(this_spend, F.col("amount"))).alias("_this"),
        F.sum(F.when(last_c & is_spend(), F.col("amount"))).alias("_last"),
        F.count_if(this_spend).alias("_times"),
        F.min_by(F.when(this_spend, F.col("merchant")), F.when(this_spend, _by_order())).alias("_name"),
    ))

    def category_map(total: str) -> Column:
        pairs = F.collect_list(F.when(F.col(total).isNotNull(), F.struct("_category", whole(F.col(total)).alias("total"))))
        return F.when(F.size(pairs) > 0, F.map_from_entries(F.sort_array(pairs)))

    by_category = sums.where("_set = 1").groupBy(*keys).agg(category_map("_this").alias("this_by_category"), category_map("_last").alias("last_by_category"))
    place = Window.partitionBy(*keys).orderBy(F.desc("_this"), "_merchant")
    first = sums.where("_set = 2 AND _times > 0").withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= 5)
    shown = F.struct("_rank", F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.lit("Unknown")).alias("name"), whole(F.col("_this")).alias("total"), F.col("_times").alias("times"))
    merchants = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(shown)), lambda m: m.dropFields("_rank")).alias("top_merchants"))
    sheet = (
        sums.where("_set = 3").select(*keys, *heads)
        .join(by_category, list(keys), "left").join(merchants, list(keys), "left")
    )
    result = sheet.withColumns({
        "largest_merchant": F.col("_largest.merchant"),
        "largest_amount": whole(F.col("_largest.amount")),
        "largest_day": F.col("_largest.day"),
    }).drop("_largest")
    if focus is not None:
        def figure(m: str) -> Column:
            return F.coalesce(F.try_element_at(m, F.lit(focus)), F.lit(0).cast("bigint"))

        result = result.withColumns({
            "focus_category": F.lit(focus),
            "focus_this_month": figure("this_by_category"),
            "focus_last_month": figure("last_by_category"),
        })
    return result
