"""Column predicates of a ledger row, defined once and used by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions.text import has, squeeze, swap

def zero() -> Column:
    return F.lit(0).cast("decimal(18,2)")


def is_inr() -> Column:
    return F.col("currency") == "INR"


def is_spend() -> Column:
    """Expense in rupees which is no investment; a row without category counts."""
    return (F.col("kind") == "expense") & is_inr() & ~F.col("category").eqNullSafe("investment")


def is_refund() -> Column:
    return (F.col("kind") == "refund") & is_inr()


def is_income() -> Column:
    return (F.col("kind") == "income") & is_inr()


def is_transfer() -> Column:
    """Own movements, in any currency."""
    return F.col("kind") == "transfer"


def is_pending() -> Column:
    return F.coalesce(F.col("needs_review"), F.lit(False)) & ~F.coalesce(F.col("reviewed"), F.lit(False))


def is_counted() -> Column:
    return ~is_pending()


def amount_if(test: Column) -> Column:
    return F.sum(F.when(test, F.col("amount")).otherwise(zero()))


def merchant_key(merchant: Column) -> Column:
    """Lower case, only letters, digits and single blanks; empty for no merchant."""
    kept = F.regexp_replace(F.lower(F.coalesce(merchant, F.lit(""))), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def merchant_or_unknown(merchant: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(merchant, F.lit("")), F.lit("unknown")))


def names_third_party() -> Column:
    """The row names a real payee, so it is a payment and no movement between own accounts."""
    name = F.trim(F.coalesce(F.col("merchant"), F.lit("")))
    return (
        (name != "")
        & ~F.lower(name).isin("unknown", "self", "own")
        & ~F.coalesce(F.col("merchant_quality").isin("phone", "opaque"), F.lit(False))
    )


def sender_id(address: Column) -> Column:
    """Header without operator prefix and punctuation: AX-HDFCBK is HDFCBK."""
    upper = F.upper(F.coalesce(address, F.lit("")))
    return F.regexp_replace(swap(upper, V.OPERATOR_PREFIX, "", ""), "[^A-Z0-9]", "")


def bank_of(sender: Column) -> Column:
    """Bank of a normalised sender: an exact entry, else the first entry which it begins with."""
    pairs = [F.lit(x) for kv in V.BANK_IDS.items() for x in kv]
    begins = None
    for key, bank in V.BANK_IDS.items():
        test = sender.startswith(key)
        begins = F.when(test, F.lit(bank)) if begins is None else begins.when(test, F.lit(bank))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), sender), begins)


def is_financial(sender: Column) -> Column:
    return (sender != "") & (bank_of(sender).isNotNull() | has(sender, V.FINANCIAL_HEADER, ""))


def brand_of(sender: Column) -> Column:
    """Merchant named by the sender header; banks and numbers name none."""
    pairs = [F.lit(x) for kv in V.SENDER_BRANDS.items() for x in kv]
    named = F.coalesce(F.try_element_at(F.create_map(*pairs), sender), F.lower(sender))
    return F.when(bank_of(sender).isNull() & has(sender, V.BRAND_HEADER, ""), named)


def looks_personal(merchant: Column) -> Column:
    """Two to five capitalised words without digits and without a company word."""
    name = F.trim(merchant)
    words = F.split(squeeze(name), " ")
    return (
        ~name.rlike("[0-9]")
        & ~has(name, V.COMPANY_WORD)
        & F.size(words).between(2, 5)
        & F.forall(words, lambda w: has(w, V.PERSON_WORD, ""))
    )
