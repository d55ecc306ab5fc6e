"""Where in the message every field of a ledger row was read.

Constant patterns cut the message into tokens once: numbers, masked digits, days.  A field's places are the tokens which say its value, or,
for names and references, where its value stands as it is; no pattern is built from a row.  Fields claim their place in a fixed
order, most specific first, and a place once claimed is not given twice; each is a projection of its
own, so the plan stays linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import fixed_values as V

FIELDS = ("ref", "amount", "account", "merchant", "date", "balance")
SPAN = "struct<start:int,end:int,field:string>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# tokens: a number with single separators, digits with mask signs before them, and the ways to write a day
FIGURE = r"(?<!\d)(?<!\d[.,])\d++(?:[.,]\d++)*+"
MASKED_RUN = r"(?<![xX*\d])[xX*]*+\d++"
MONTH = "(" + "|".join(V.MONTHS) + ")"
DAY_MONTH_YEAR = r"(\d++)[-/](\d{1,2})[-/](\d{2,})"
DAY_NAME_YEAR = rf"(?i)(\d++)[\s-]?{MONTH}[a-z]*[\s-]?(\d{{2,}})"
NAME_DAY_YEAR = rf"(?i){MONTH}[a-z]*\s+(\d\d),?\s+(\d{{4,}})"
YEAR_MONTH_DAY = r"(\d{4,})-(\d\d)-(\d\d)"


def indian_grouping(whole: Column) -> Column:
    """1234567 as 12,34,567."""
    text = whole.cast("string")
    tail = F.right(text, F.lit(3))
    head = F.substring(text, F.lit(1), F.length(text) - 3)
    grouped = F.concat(F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,"), F.lit(","), tail)
    return F.when(F.length(text) > 3, grouped).otherwise(text)


def _tokens(text: Column, pattern: str) -> Column:
    """The hits of a constant pattern with their places, in order."""
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,hit:string>>").alias("found"))

    def walk(state: Column, x: Column) -> Column:
        at = state["next"] + F.length(x["gap"])
        token = F.struct(at.alias("at"), x["hit"].alias("hit"))
        return F.struct(
            (at + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("next"),
            F.when(x["hit"].isNotNull(), F.array_append(state["found"], token)).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(steps, begin, walk, lambda s: s["found"])


def _span(start: Column, end: Column, rank: int = 0) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(rank).alias("rank"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value which is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal_spans(text: Column, literal: Column, suffix: str | None = None) -> Column:
    """Where a value stands in the text, from left to right, with what a constant pattern takes up behind it."""
    times = F.floor((F.length(text) - F.length(F.replace(text, literal, F.lit("")))) / F.length(literal)).cast("int")
    begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<start:int,end:int,rank:int>>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        def placed(at: Column) -> Column:
            end = at - 1 + F.length(literal)
            if suffix is not None:
                end = end + F.length(F.regexp_extract(F.substr(text, end + 1), suffix, 0))
            return _let(end, lambda e: F.when(at > 0, F.struct(
                (e + 1).cast("int").alias("next"), F.array_append(state["found"], _span(at - 1, e)).alias("found"))).otherwise(state))

        return _let(F.call_function("locate", literal, text, state["next"]), placed)

    walked = F.aggregate(F.sequence(F.lit(1), times), begin, step, lambda s: s["found"])
    return F.when((F.length(literal) > 0) & F.contains(text, literal), walked)


def _figure_spans(figures: Column, forms: Column) -> Column:
    """Numbers which begin with one of the forms, the longest that fits, if no digit follows it."""
    ordered = F.array_sort(F.array_distinct(forms), lambda a, b: F.length(b) - F.length(a))

    def fits(token: Column) -> Callable[[Column], Column]:
        return lambda f: F.startswith(token["hit"], f) & ~F.substr(token["hit"], F.length(f) + 1, F.lit(1)).between("0", "9")

    def placed(forms: Column) -> Column:
        return F.transform(figures, lambda t: _let(F.get(F.filter(forms, fits(t)), F.lit(0)), lambda f: F.when(f.isNotNull(), _span(t["at"], t["at"] + F.length(f)))))

    # The forms are made once a row, not once a figure.
    return F.array_compact(_let(ordered, placed))


def _amount_forms(amount: Column) -> Column:
    whole = F.floor(amount).cast("bigint")
    grouped, exact = indian_grouping(whole), amount.cast("string")
    paise = F.right(exact, F.lit(2))
    short = F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.array(F.concat(grouped, F.lit("."), paise), exact, F.concat(grouped, F.lit(".00")), grouped, whole.cast("string"), short)


def _balance_forms(balance: Column) -> Column:
    grouped = indian_grouping(F.floor(balance).cast("bigint"))
    paise = F.right(balance.cast("string"), F.lit(2))
    return F.array(F.concat(grouped, F.lit("."), paise), F.concat(grouped, F.lit(".00")), grouped)


def _account_spans(text: Column, account: Column) -> Column:
    """Digits at the end of a run of digits; with up to six mask signs if they are the whole run."""
    def placed(t: Column) -> Column:
        size, digits = F.length(t["hit"]), F.ltrim(t["hit"], F.lit("xX*"))
        mask = F.when(digits == account, F.least(size - F.length(digits), F.lit(6))).otherwise(0)
        end = t["at"] + size
        return F.when(F.endswith(digits, account), _span(end - F.length(account) - mask, end))

    runs = F.array_compact(F.transform(_tokens(text, MASKED_RUN), placed))
    return F.when(account.rlike("^[0-9]+$"), runs).otherwise(_literal_spans(text, account))


def _date_spans(text: Column, date: Column) -> Column:
    """A day in numbers, with a month name behind or before the day, or year first; of one or two digits, years of two or four."""
    d, m = F.day(date).cast("string"), F.month(date).cast("string")
    dd, mm, yyyy = F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), F.year(date).cast("string")
    name = F.get(F.array(*[F.lit(x) for x in V.MONTHS]), F.month(date) - 1)
    yy = F.right(yyyy, F.lit(2))

    def part(token: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(token["hit"], pattern, group)

    def year_size(shown: Column) -> Column:
        return F.when(F.startswith(shown, yyyy), 4).when(F.startswith(shown, yy), 2)

    def day_first(pattern: str, month_fits: Callable[[Column, Column], Column], rank: int) -> Callable[[Column], Column]:
        def placed(t: Column) -> Column:
            day, month, year = (part(t, pattern, g) for g in (1, 2, 3))
            back = F.when(F.endswith(day, dd) & month_fits(month, F.lit(True)), 2).when(F.endswith(day, d) & month_fits(month, F.lit(False)), F.length(d))
            end = t["at"] + F.length(t["hit"]) - F.length(year) + year_size(year)
            return _let(back, lambda x: F.when(x.isNotNull() & year_size(year).isNotNull(), _span(t["at"] + F.length(day) - x, end, rank)))

        return placed

    def in_numbers(shown: Column, two_digits: Column) -> Column:
        return shown == F.when(two_digits, mm).otherwise(m)

    def by_name(shown: Column, _: Column) -> Column:
        return F.lower(shown) == name

    def name_first(t: Column) -> Column:
        year = part(t, NAME_DAY_YEAR, 3)
        end = t["at"] + F.length(t["hit"]) - F.length(year) + 4
        return F.when((F.lower(part(t, NAME_DAY_YEAR, 1)) == name) & (part(t, NAME_DAY_YEAR, 2) == dd) & F.startswith(year, yyyy), _span(t["at"], end, 2))

    def year_first(t: Column) -> Column:
        year = part(t, YEAR_MONTH_DAY, 1)
        ends = F.endswith(year, yyyy) & (part(t, YEAR_MONTH_DAY, 2) == mm) & (part(t, YEAR_MONTH_DAY, 3) == dd)
        return F.when(ends, _span(t["at"] + F.length(year) - 4, t["at"] + F.length(t["hit"]), 3))

    def spans(pattern: str, may_hit: Column, placed: Callable[[Column], Column]) -> Column:
        """Texts which can't show the day in this way are not cut."""
        return F.transform(F.when(may_hit, _tokens(text, pattern)).otherwise(F.array().cast("array<struct<at:int,hit:string>>")), placed)

    separated = F.contains(text, F.lit("-")) | F.contains(text, F.lit("/"))
    named = F.contains(F.lower(text), name)
    return F.array_sort(F.array_compact(F.concat(
        spans(DAY_MONTH_YEAR, separated, day_first(DAY_MONTH_YEAR, in_numbers, 0)), spans(DAY_NAME_YEAR, named, day_first(DAY_NAME_YEAR, by_name, 1)),
        spans(NAME_DAY_YEAR, named, name_first), spans(YEAR_MONTH_DAY, F.contains(text, F.concat_ws("-", yyyy, mm, dd)), year_first),
    )))


def _spans_of(text: Column) -> dict[str, Column]:
    """Where each field may stand, from left to right; null where the row has no such field."""
    c = F.col
    lower = F.translate(text, UPPER, UPPER.lower())
    return {
        "ref": F.when(c("ref").isNotNull(), _literal_spans(text, c("ref"))),
        "amount": F.when(c("amount").isNotNull(), _figure_spans(c("_figures"), _amount_forms(c("amount")))),
        "account": F.when(c("account").isNotNull(), _account_spans(text, c("account"))),
        "merchant": F.when(c("merchant").isNotNull(), _let(F.struct(lower.alias("text"), F.translate("merchant", UPPER, UPPER.lower()).alias("name")), lambda x: _literal_spans(
            x["text"], x["name"], "^@[a-z]+"))),
        "date": F.when(c("date").isNotNull(), _date_spans(text, c("date"))),
        "balance": F.when(c("balance") > 0, _figure_spans(c("_figures"), _balance_forms(c("balance")))),
    }


def trace_fields(txns: DataFrame) -> DataFrame:
    """Adds ``spans``: where ref, amount, account, merchant, date and balance stand in ``raw``."""
    text = F.coalesce("raw", F.lit(""))
    work = txns.withColumn("_figures", _tokens(text, FIGURE)).withColumn("spans", F.array().cast(f"array<{SPAN}>"))
    for field, places in _spans_of(text).items():
        # Without the white space at the edges of a value.
        def trimmed(x: Column) -> Column:
            hit = F.substr(text, x["start"] + 1, x["end"] - x["start"])
            return F.struct((x["start"] + F.length(hit) - F.length(F.ltrim(hit))).alias("start"), (x["end"] - F.length(hit) + F.length(F.rtrim(hit))).alias("end"), F.lit(field).alias("field"))

        free = F.filter(F.transform(F.col("_places"), trimmed), lambda x: ~F.exists("spans", lambda s: (x["start"] < s["end"]) & (x["end"] > s["start"])))
        work = work.withColumn("_places", places).withColumn("_hit", F.get(free, F.lit(0))).withColumn(
            "spans", F.when(F.col("_hit").isNotNull(), F.array_append("spans", F.col("_hit"))).otherwise(F.col("spans")))
    return work.withColumn("spans", F.array_sort("spans")).drop("_figures", "_places", "_hit")


def segments(traced: DataFrame) -> DataFrame:
    """Adds ``segments``: the message cut at its spans; put together again they are the message."""
    text = F.coalesce("raw", F.lit(""))
    empty = F.array().cast("array<struct<text:string,field:string>>")

    def piece(start: Column, end: Column, field: Column) -> Column:
        return F.struct(F.substr(text, start + 1, end - start).alias("text"), field.alias("field"))

    none = F.lit(None).cast("string")

    def step(state: Column, s: Column) -> Column:
        gap = F.when(
            s["start"] > state["at"], F.array(piece(state["at"], s["start"], none))
        ).otherwise(empty)
        return F.struct(
            s["end"].alias("at"),
            F.concat(state["parts"], gap, F.array(piece(s["start"], s["end"], s["field"]))).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), empty.alias("parts"))

    def finish(state: Column) -> Column:
        rest = F.when(
            state["at"] < F.length(text), F.array(piece(state["at"], F.length(text), none))
        ).otherwise(empty)
        return F.concat(state["parts"], rest)

    return traced.withColumn("segments", F.aggregate("spans", start, step, finish))


def trace_coverage(traced: DataFrame) -> DataFrame:
    """Adds expected, traced and missing; a merchant known from the sender is not expected."""
    def present(name: str) -> Column:
        return F.col(name).isNotNull()

    merchant = present("merchant") & ~F.coalesce(F.col("merchant_quality") == "sender", F.lit(False))
    expected = F.array_compact(F.array(
        F.when(present("amount"), "amount"), F.when(present("date"), "date"),
        F.when(present("account"), "account"), F.when(merchant, "merchant"), F.when(present("ref"), "ref"),
    ))
    found = F.transform("spans", lambda s: s["field"])
    missing = F.array_except(expected, found)
    return traced.withColumns({
        "expected": F.size(expected), "traced": F.size(expected) - F.size(missing), "missing": missing,
    })


def trace_report(traced: DataFrame) -> DataFrame:
    """Traced share per sender."""
    return trace_coverage(traced).groupBy("sender_id").agg(
        F.count("*").alias("rows"), F.sum("expected").alias("expected"), F.sum("traced").alias("traced"),
        F.count_if(F.array_contains("missing", "amount")).alias("amount_missing"),
    )
