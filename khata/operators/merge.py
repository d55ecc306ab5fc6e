"""Ledger maintenance: merge of a new parse, upsert, delete, and the user's corrections.

All of them are key joins between a ledger and a table of changes; many changes are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions.money import merchant_key

KEY = ["inbox_id", "fingerprint"]


def _sides(prior: DataFrame, fresh: DataFrame, how: str) -> DataFrame:
    """Both versions of a row side by side as structs ``p`` and ``f``."""
    old = prior.select(*KEY, F.struct(*prior.columns).alias("p"))
    new = fresh.select(*KEY, F.struct(*fresh.columns).alias("f"))
    return old.join(new, KEY, how)


def _decided(column: str) -> Column:
    """A field of the merged row: the new parse, except where the user has decided."""
    p, f = F.col("p"), F.col("f")
    user_category = F.coalesce(p["category_source"] == "user", F.lit(False))
    user_kind = F.coalesce(p["kind_source"] == "user", F.lit(False))
    reviewed = F.coalesce(p["reviewed"], F.lit(False))
    rules = {
        "category": F.when(user_category, p["category"]).otherwise(f["category"]),
        "category_source": F.when(user_category, "user").otherwise(f["category_source"]),
        "kind": F.when(user_kind, p["kind"]).otherwise(f["kind"]),
        "kind_source": F.when(user_kind, "user").otherwise(f["kind_source"]),
        "reviewed": F.when(reviewed, F.lit(True)).otherwise(f["reviewed"]),
        "needs_review": F.when(reviewed, F.lit(False)).otherwise(f["needs_review"]),
    }
    return rules.get(column, f[column])


def _materially_changed(columns: list[str]) -> Column:
    tests = [~F.col("p")[c].eqNullSafe(_decided(c)) for c in V.MATERIAL_FIELDS if c in columns]
    changed = tests[0]
    for t in tests[1:]:
        changed = changed | t
    return changed


def merge_ledger(prior: DataFrame, fresh: DataFrame, reprocess: bool = False) -> DataFrame:
    """Stored rows with newly parsed ones, with a column ``change``: kept, updated or added.

    Without ``reprocess`` a stored row stays as it is.  With it, the new parse replaces the stored
    one where a visible field changes, and every decision of the user is carried over.  ``fresh``
    has one row per key and the columns of ``prior``.
    """
    p, f = F.col("p"), F.col("f")
    update = F.lit(False)
    if reprocess:
        update = p.isNotNull() & f.isNotNull() & _materially_changed(prior.columns)
    merged = _sides(prior, fresh, "full").withColumn(
        "change", F.when(p.isNull(), "added").when(update, "updated").otherwise("kept")
    )
    pick = [
        F.when(F.col("change") == "kept", p[c]).when(F.col("change") == "added", f[c]).otherwise(_decided(c)).alias(c)
        for c in prior.columns if c not in KEY
    ]
    return merged.select(*KEY, *pick, "change").select(*prior.columns, "change")


def material_changes(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keys of stored rows which a new parse would visibly change."""
    return _sides(prior, fresh, "inner").where(_materially_changed(prior.columns)).select(*KEY)


def upsert_rows(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write per key wins, by ``order``; other rows stay."""
    latest = changes.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    ).where(F.col("_n") == 1).drop("_n")
    return table.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*table.columns))


def delete_rows(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the doomed ones."""
    return table.join(doomed.select(*keys).distinct(), keys, "left_anti")


def kind_for(category: Column) -> Column:
    """The kind a category implies; a kind set by hand stays."""
    return (
        F.when((F.col("kind_source") == "user") & F.col("kind").isNotNull(), F.col("kind"))
        .when(category.isin("transfer", "investment"), "transfer")
        .when(F.col("direction") == "credit", F.when(F.col("kind") == "refund", "refund").otherwise("income"))
        .otherwise("expense")
    )


def _confirmed(test: Column, **changes: Column) -> dict[str, Column]:
    """Column changes for the rows of ``test``, which thereby count as reviewed."""
    changes |= {"needs_review": F.lit(False), "reviewed": F.lit(True)}
    return {c: F.when(test, v).otherwise(F.col(c)) for c, v in changes.items()}


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """The last usable correction per inbox and merchant key: one decision row each."""
    return (
        corrections.withColumn("merchant_key", merchant_key(F.col("merchant")))
        .where((F.col("merchant_key") != "") & F.col("category").rlike("(?i)" + V.CUSTOM_CATEGORY_NAME))
        .groupBy("inbox_id", "merchant_key")
        .agg(F.max_by(F.struct("category", "merchant", "at_ms"), "at_ms").alias("last"))
        .select("inbox_id", "merchant_key", "last.category", F.lit("user").alias("source"),
                "last.merchant", "last.at_ms")
    )


def correct_merchants(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """Relabels every row of a corrected merchant, with a boolean column ``touched``.

    ``corrections`` has inbox_id, merchant, category and at_ms.
    """
    rules = latest_corrections(corrections).select(
        "inbox_id", "merchant_key", F.col("category").alias("_category")
    )
    joined = ledger.withColumn("merchant_key", merchant_key(F.col("merchant"))).join(
        rules, ["inbox_id", "merchant_key"], "left"
    )
    target = F.col("_category")
    same = F.col("category").eqNullSafe(target) & F.col("category_source").eqNullSafe("user")
    tagged = joined.withColumn("touched", target.isNotNull() & ~same)
    return tagged.withColumns(_confirmed(
        F.col("touched"), category=target, category_source=F.lit("user"), kind=kind_for(target)
    )).select(*ledger.columns, "touched")


def correct_rows(ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """Sets the category of single rows: patches of (inbox_id, fingerprint, category)."""
    joined = ledger.join(
        patches.select(*KEY, F.col("category").alias("_category")), KEY, "left"
    )
    target = F.col("_category")
    return joined.withColumns(_confirmed(
        target.isNotNull(), category=target, category_source=F.lit("user"), kind=kind_for(target)
    )).select(*ledger.columns)


def set_kind(ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """Sets the kind by hand: patches of (inbox_id, fingerprint, kind, merchant_wide).

    A merchant-wide patch reaches all rows of the merchant in the same direction whose kind
    differs; if there are none, or the row names no merchant, it is the row alone.
    """
    base = ledger.withColumn("merchant_key", merchant_key(F.col("merchant")))
    named = F.nullif(F.col("merchant"), F.lit("")).isNotNull()
    origin = base.join(
        patches.select(*KEY, F.col("kind").alias("_kind"), "merchant_wide"), KEY, "inner"
    ).select(
        *KEY, "merchant_key", "direction", "_kind", (F.col("merchant_wide") & named).alias("_wide")
    )
    wide_keys = ["inbox_id", "merchant_key", "direction"]
    wide = origin.where("_wide").groupBy(*wide_keys).agg(
        F.max_by("_kind", "fingerprint").alias("_wide_kind")
    )
    # is there any row the wide patch reaches?
    reached = base.join(wide, wide_keys, "inner").groupBy(*wide_keys).agg(
        F.first("_wide_kind").alias("_wide_kind"),
        F.bool_or(~F.col("kind").eqNullSafe(F.col("_wide_kind"))).alias("_reaches"),
    )
    single = origin.join(reached.select(*wide_keys, "_reaches"), wide_keys, "left").where(
        ~F.col("_wide") | ~F.col("_reaches")
    ).select(*KEY, F.col("_kind").alias("_single_kind"))
    joined = base.join(reached, wide_keys, "left").join(single, KEY, "left")
    by_wide = F.col("_reaches") & ~F.col("kind").eqNullSafe(F.col("_wide_kind"))
    target = F.coalesce("_single_kind", F.when(by_wide, F.col("_wide_kind")))
    tagged = joined.withColumn("_target", target)
    return tagged.withColumns(_confirmed(
        F.col("_target").isNotNull(), kind=F.col("_target"), kind_source=F.lit("user")
    )).select(*ledger.columns)


def mark_transfers(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """Books both rows of each pair (inbox_id, debit, credit) as own movements."""
    halves = pairs.select(
        "inbox_id", F.explode(F.array("debit", "credit")).alias("fingerprint"), F.lit(True).alias("_pair")
    ).distinct()
    hit = F.coalesce("_pair", F.lit(False))
    return ledger.join(halves, KEY, "left").withColumns(_confirmed(
        hit, kind=F.lit("transfer"), category=F.lit("transfer"),
        category_source=F.lit("user"), kind_source=F.lit("user"),
    )).select(*ledger.columns)
