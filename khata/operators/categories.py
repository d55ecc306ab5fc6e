"""Category resolution: rules, decisions, learned rungs, and external labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions.money import looks_personal, merchant_key, sender_id
from khata.functions.text import first_label
from khata.operators.reports import INBOX, Keys


def _decision(category: Column | str, source: str | Column) -> Column:
    cat = F.lit(category) if isinstance(category, str) else category
    src = F.lit(source) if isinstance(source, str) else source
    return F.struct(cat.alias("category"), src.alias("source"))


def rule_decision(merchant: Column, direction: Column) -> Column:
    """Struct (category, source) by the rule table, or null when the rules do not know.

    A credit without merchant is income.  A debit to what reads like a person is a guess.
    """
    name = F.nullif(merchant, F.lit(""))
    label = first_label(name, V.MERCHANT_RULES)
    return (
        F.when(name.isNull(), F.when(direction == "credit", _decision("income", "rule")))
        .when(label.isNotNull(), _decision(label, "rule"))
        .when((direction == "debit") & looks_personal(name), _decision("transfer", "guess"))
    )


def rule_categories(txns: DataFrame) -> DataFrame:
    """Rows with rule_category and rule_source."""
    return txns.withColumn("_rule", rule_decision(F.col("merchant"), F.col("direction"))).select(
        *txns.columns, F.col("_rule.category").alias("rule_category"), F.col("_rule.source").alias("rule_source")
    )


def resolve_categories(txns: DataFrame, decisions: DataFrame | None = None,
                       priors: DataFrame | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """Sets category and category_source of new rows by the first rung which answers.

    user decision, rule or guess, no merchant, any other decision, sender prior, learned model,
    else other/fallback.  Own movements and unreadable or sender-named merchants do not go up the
    ladder.  A guess makes the row a transfer to be reviewed.

    decisions: (inbox_id, merchant_key, category, source), one row per key.
    priors: (inbox_id, sender_id, category).  predictions: (inbox_id, sms_id, category).
    All three are joined by key; which side is broadcast is left to the size Spark sees.
    """
    rows = txns.withColumn("merchant_key", merchant_key(F.col("merchant")))
    nothing = F.lit(None).cast("struct<category:string,source:string>")

    def joined(df: DataFrame, side: DataFrame | None, keys: list[str], name: str, source: str | Column) -> DataFrame:
        if side is None:
            return df.withColumn(name, nothing)
        return df.join(side.select(*keys, _decision(F.col("category"), source).alias(name)), keys, "left")

    rows = joined(rows, decisions, ["inbox_id", "merchant_key"], "_said", F.col("source"))
    rows = joined(rows, priors, ["inbox_id", "sender_id"], "_prior", "sender")
    rows = joined(rows, predictions, ["inbox_id", "sms_id"], "_model", "model")
    said = F.when(F.col("merchant_key") != "", F.col("_said"))
    ladder = F.coalesce(
        F.when(said["source"] == "user", said),
        rule_decision(F.col("merchant"), F.col("direction")),
        F.when(F.col("merchant_key") == "", _decision("other", "rule")),
        said,
        F.col("_prior"),
        F.col("_model"),
        _decision("other", "fallback"),
    )
    unreadable = F.col("merchant_quality").isNotNull() & (F.col("merchant_quality") != "named")
    outcome = (
        F.when(F.col("kind") == "transfer", _decision("transfer", "rule"))
        .when(unreadable, _decision("other", "unresolved"))
        .otherwise(ladder)
    )
    rows = rows.withColumn("_outcome", outcome)
    guess = F.col("_outcome.source") == "guess"
    return rows.withColumns({
        "category": F.col("_outcome.category"),
        "category_source": F.col("_outcome.source"),
        "kind": F.when(guess, "transfer").otherwise(F.col("kind")),
        "needs_review": F.when(guess, F.lit(True)).otherwise(F.col("needs_review")),
        "review_reason_override": F.when(guess, V.GUESS_REASON).otherwise(F.col("review_reason_override")),
    }).select(*txns.columns)


def unknown_merchants(resolved: DataFrame, keys: Keys = INBOX) -> DataFrame:
    """Distinct merchants which only the last rung answered: what an external labeller is asked."""
    return (
        resolved.where(F.col("category_source") == "fallback")
        .groupBy(*keys, merchant_key(F.col("merchant")).alias("merchant_key"))
        .agg(F.min("merchant").alias("merchant"))
    )


def label_decisions(labels: DataFrame) -> DataFrame:
    """Decisions out of external labels (inbox_id, merchant_key, label); an unknown word is other."""
    word = F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), "[^a-z]", "")
    return labels.groupBy("inbox_id", "merchant_key").agg(F.min(word).alias("word")).select(
        "inbox_id", "merchant_key",
        F.when(F.col("word").isin(*V.CATEGORIES), F.col("word")).otherwise("other").alias("category"),
        F.lit("llm").alias("source"), F.lit(None).cast("string").alias("merchant"),
        F.lit(None).cast("bigint").alias("at_ms"),
    )


def apply_labels(resolved: DataFrame, labels: DataFrame) -> DataFrame:
    """Puts external labels on the rows which no rung had answered."""
    decided = label_decisions(labels).select("inbox_id", "merchant_key", F.col("category").alias("_label"))
    rows = resolved.withColumn("merchant_key", merchant_key(F.col("merchant")))
    hit = (F.col("category_source") == "fallback") & F.col("_label").isNotNull()
    return rows.join(decided, ["inbox_id", "merchant_key"], "left").withColumns({
        "category": F.when(hit, F.col("_label")).otherwise(F.col("category")),
        "category_source": F.when(hit, "llm").otherwise(F.col("category_source")),
    }).select(*resolved.columns)


def add_decisions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored decisions with new ones; a new decision replaces the stored one of its key."""
    keys = ["inbox_id", "merchant_key"]
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def learned_rules(decisions: DataFrame) -> DataFrame:
    """What the user has taught; listed newest first by ``at_ms``."""
    return decisions.where(F.col("source") == "user")


def forget_rules(decisions: DataFrame, doomed: DataFrame) -> DataFrame:
    """Takes decisions back; ledger rows keep their label."""
    keys = ["inbox_id", "merchant_key"]
    return decisions.join(doomed.select(*keys).distinct(), keys, "left_anti")


def category_names(custom: DataFrame) -> DataFrame:
    """Built-in and usable custom category names (inbox_id, name), without repeats."""
    name = F.lower(F.trim("name"))
    own = custom.select("inbox_id", name.alias("name")).where(F.col("name").rlike(V.CUSTOM_CATEGORY_NAME))
    built_in = custom.select("inbox_id").distinct().select(
        "inbox_id", F.explode(F.array(*[F.lit(c) for c in V.CATEGORIES])).alias("name")
    )
    return built_in.unionByName(own).distinct()


def with_sender_id(txns: DataFrame) -> DataFrame:
    return txns.withColumn("sender_id", sender_id(F.col("sender")))
