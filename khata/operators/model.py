"""Learned classifier: multinomial naive Bayes over counts, sender priors, leave-one-out check.

The model is three tables of counts per inbox.  Scores are joins of distinct tokens with counts:
only tokens seen in a class contribute a term of their own, the smoothing of all others is one
number per class.  Rows are first reduced to their distinct features, so a merchant which makes up
a third of the rows is scored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions import fixed_values as V
from khata.functions.money import merchant_key, sender_id
from khata.session import cut_lineage

FEATURE_COLUMNS = ["merchant", "sender", "bank", "channel", "direction", "amount"]


def magnitude(amount: Column) -> Column:
    size = F.abs(F.coalesce(amount, F.lit(0)))
    chain = None
    for label, limit in V.MAGNITUDES:
        chain = F.when(size < limit, label) if chain is None else chain.when(size < limit, label)
    return chain.otherwise(V.MAGNITUDE_TOP)


def with_features(rows: DataFrame) -> DataFrame:
    """Adds ``features``.  The merchant key is a column first: the array functions read it often."""
    return rows.withColumn("_key", merchant_key(F.col("merchant"))).withColumn(
        "features", _features(F.col("_key"))
    ).drop("_key")


def _features(key: Column) -> Column:
    """Tokens of a row, in order: words and their prefixes, trigrams, sender, bank, channel,
    direction, magnitude."""
    words = F.filter(F.split(key, " "), lambda w: w != "")
    of_words = F.flatten(F.transform(words, lambda w: F.when(
        F.length(w) > 4,
        F.array(F.concat(F.lit("m:"), w), F.concat(F.lit("mp:"), F.substring(w, 1, 4))),
    ).otherwise(F.array(F.concat(F.lit("m:"), w)))))
    starts = F.when(F.length(key) >= 3, F.sequence(F.lit(1), F.length(key) - 2)).otherwise(
        F.array().cast("array<int>")
    )
    grams = F.filter(F.transform(starts, lambda i: F.substr(key, i, F.lit(3))), lambda g: F.length(F.trim(g)) == 3)

    def optional(prefix: str, value: Column) -> Column:
        return F.when(
            F.coalesce(value, F.lit("")) != "", F.array(F.concat(F.lit(prefix), value))
        ).otherwise(F.array().cast("array<string>"))

    sender = F.when(F.coalesce("sender", F.lit("")) != "", F.concat(F.lit("s:"), sender_id(F.col("sender"))))
    return F.concat(
        of_words,
        F.transform(grams, lambda g: F.concat(F.lit("g:"), g)),
        F.array_compact(F.array(sender)),
        optional("b:", F.col("bank")),
        optional("c:", F.col("channel")),
        F.array(
            F.concat(F.lit("d:"), F.coalesce(F.nullif("direction", F.lit("")), F.lit("?"))),
            F.concat(F.lit("a:"), magnitude(F.col("amount"))),
        ),
    )


def training_rows(ledger: DataFrame) -> DataFrame:
    """Rows labelled by the user; ``other`` teaches nothing."""
    return ledger.where((F.col("category_source") == "user") & F.col("category").isNotNull()
                        & ~F.col("category").isin("", "other"))


def _signed(rows: DataFrame) -> DataFrame:
    """Rows with their features and a signature of them."""
    return with_features(rows).withColumn("signature", F.sha2(F.to_json("features"), 256))


def _written(signed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What scoring needs of the rows, written out: it is read several times."""
    return cut_lineage(signed.select(*{*keys, "inbox_id"}, "signature", "features"))


def _bags(signed: DataFrame) -> DataFrame:
    """Per inbox and signature the distinct tokens with how often each occurs."""
    distinct = signed.groupBy("inbox_id", "signature").agg(F.first("features").alias("features"))
    return distinct.select("inbox_id", "signature", F.explode("features").alias("token")).groupBy(
        "inbox_id", "signature", "token"
    ).agg(F.count("*").alias("times"))


class NaiveBayes:
    """Counts per inbox: ``classes`` (inbox_id, category, rows, tokens), ``tokens`` (inbox_id,
    category, token, n), ``meta`` (inbox_id, examples, vocabulary, usable, ready)."""

    def __init__(self, classes: DataFrame, tokens: DataFrame, meta: DataFrame) -> None:
        self.classes = classes
        self.tokens = tokens
        self.meta = meta


def nb_train(labelled: DataFrame) -> NaiveBayes:
    """Counts of labelled rows (inbox_id, category and the feature columns)."""
    rows = labelled.where(F.nullif(F.col("category"), F.lit("")).isNotNull())
    # equal labelled rows are counted before their tokens are exploded
    packed = cut_lineage(with_features(rows).groupBy("inbox_id", "category", "features").agg(
        F.count("*").alias("rows")
    ))
    tokens = packed.select("inbox_id", "category", F.explode("features").alias("token"), "rows").groupBy(
        "inbox_id", "category", "token"
    ).agg(F.sum("rows").alias("n"))
    classes = packed.groupBy("inbox_id", "category").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.size("features")).alias("tokens")
    )
    vocabulary = tokens.groupBy("inbox_id").agg(F.count_distinct("token").alias("vocabulary"))
    usable = F.count_if(F.col("rows") >= V.NB_MIN_PER_CLASS)
    meta = classes.groupBy("inbox_id").agg(F.sum("rows").alias("examples"), usable.alias("usable")).join(
        vocabulary, "inbox_id"
    ).withColumn("ready", (F.col("examples") >= V.NB_MIN_EXAMPLES) & (F.col("usable") >= 2))
    return NaiveBayes(classes, tokens, meta)


def _top_two(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Best and second class per row with the margin between them, above the abstention limit."""
    by_score = Window.partitionBy(*keys).orderBy(F.desc("score"), "category")
    return scores.withColumns({
        "place": F.row_number().over(by_score),
        "second": F.lead("category").over(by_score),
        "margin": F.col("score") - F.lead("score").over(by_score),
    }).where((F.col("place") == 1) & (F.col("margin") >= V.NB_MIN_MARGIN)).select(
        *keys, "category", "second", "margin"
    )


def _leaders(bases: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` best classes by their ``base``, which is the score of a class that shares no token with a row."""
    by_base = Window.partitionBy(*keys).orderBy(F.desc("base"), "category")
    return bases.withColumn("place", F.row_number().over(by_base)).where(F.col("place") <= n).select(*keys, "category")


def nb_scores(model: NaiveBayes, signed: DataFrame) -> DataFrame:
    """Log scores for every distinct signature of the rows: of the classes which may come first or second.

    The counts are an inverted index from tokens to classes, which gives the classes that share a token.  All others have their base
    score, which depends on the size of the row alone, and tokens only add to a base.  So of those classes only the two with the best
    bases for the size can be among the first two, and rows never meet all classes.
    """
    bags = _bags(signed)
    sizes = signed.groupBy("inbox_id", "signature").agg(F.first(F.size("features")).alias("size"))
    usable = model.classes.where(F.col("rows") >= V.NB_MIN_PER_CLASS).join(
        model.meta.where("ready").select("inbox_id", "examples", "vocabulary"), "inbox_id"
    ).select(
        "inbox_id", "category",
        F.log(F.col("rows") / F.col("examples")).alias("prior"),
        F.log(F.col("tokens") + F.col("vocabulary")).alias("log_base"),
    )
    alike = sizes.select("inbox_id", "size").distinct().join(usable, "inbox_id")
    leaders = _leaders(alike.withColumn("base", F.col("prior") + F.lit(0.0) - F.col("size") * F.col("log_base")), ["inbox_id", "size"], 2)
    shared = bags.join(model.tokens, ["inbox_id", "token"]).select(
        "inbox_id", "signature", "category", (F.col("times") * F.log(F.col("n") + 1)).alias("gain"))
    plain = sizes.join(leaders, ["inbox_id", "size"]).select("inbox_id", "signature", "category", F.lit(0.0).alias("gain"))
    gains = shared.unionByName(plain).groupBy("inbox_id", "signature", "category").agg(F.sum("gain").alias("gain"))
    return gains.join(sizes, ["inbox_id", "signature"]).join(usable, ["inbox_id", "category"]).select(
        "inbox_id", "signature", "category", (F.col("prior") + F.col("gain") - F.col("size") * F.col("log_base")).alias("score"))


def nb_predict(model: NaiveBayes, rows: DataFrame, keys: tuple[str, ...] = ("inbox_id", "sms_id"),
               why: bool = False) -> DataFrame:
    """Category, margin and confidence per row; no row where the model abstains.

    With ``why`` also the three tokens which speak most for the winner against the runner-up.
    """
    signed = _written(_signed(rows), keys)
    chosen = _top_two(nb_scores(model, signed), ["inbox_id", "signature"]).withColumn(
        "confidence", F.least(F.lit(0.95), F.lit(0.5) + F.col("margin") / 10)
    )
    if why:
        chosen = chosen.join(_reasons(model, signed, chosen), ["inbox_id", "signature"], "left")
    extra = ["why"] if why else []
    return signed.select(*keys, "signature").join(chosen, ["inbox_id", "signature"]).select(
        *keys, "category", "margin", "confidence", *extra
    )


def _reasons(model: NaiveBayes, signed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Up to three tokens by their count lead in the winning class, ties in feature order."""
    tokens = signed.groupBy("inbox_id", "signature").agg(F.first("features").alias("features")).select(
        "inbox_id", "signature", F.posexplode("features").alias("at", "token")
    )
    for_, against = model.tokens, model.tokens.withColumnRenamed("n", "n2").withColumnRenamed("category", "second")
    lifted = (
        tokens.join(chosen.select("inbox_id", "signature", "category", "second"), ["inbox_id", "signature"])
        .join(for_, ["inbox_id", "token", "category"])
        .join(against, ["inbox_id", "token", "second"], "left")
        .withColumn("lift", F.col("n") - F.coalesce("n2", F.lit(0)))
        .where(F.col("lift") > 0)
    )
    place = Window.partitionBy("inbox_id", "signature").orderBy(F.desc("lift"), "at")
    return (
        lifted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= 3)
        .groupBy("inbox_id", "signature")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda t: t["token"]).alias("why"))
    )


def sender_priors(labelled: DataFrame) -> DataFrame:
    """Senders whose labels agree nearly always: (inbox_id, sender_id, category, n)."""
    counts = labelled.withColumn("sender_id", sender_id(F.col("sender"))).where(
        (F.col("sender_id") != "") & F.nullif(F.col("category"), F.lit("")).isNotNull()
    ).groupBy("inbox_id", "sender_id", "category").agg(F.count("*").alias("c"))
    return counts.groupBy("inbox_id", "sender_id").agg(
        F.max_by("category", F.struct("c", "category")).alias("category"),
        F.max("c").alias("top"), F.sum("c").alias("n"),
    ).where(
        (F.col("n") >= V.PRIOR_MIN_EXAMPLES) & (F.col("top") / F.col("n") >= V.PRIOR_MIN_SHARE)
    ).select("inbox_id", "sender_id", "category", "n")


def model_statistics(model: NaiveBayes, priors: DataFrame) -> DataFrame:
    """Per inbox: ready, examples, usable classes, vocabulary, senders with a prior."""
    senders = priors.groupBy("inbox_id").agg(F.count("*").alias("senders"))
    return model.meta.join(senders, "inbox_id", "left").select(
        "inbox_id", "ready", "examples", F.col("usable").alias("classes"), "vocabulary",
        F.coalesce("senders", F.lit(0)).alias("senders"),
    )


def nb_leave_one_out(labelled: DataFrame, keys: tuple[str, ...] = ("inbox_id",)) -> DataFrame:
    """Tested, abstained, correct, accuracy and coverage as if each row were scored by a model
    trained on all others.

    Nothing is retrained: a row's own counts are taken off the totals.  Rows with equal features and
    label have equal outcomes and are scored once.
    """
    rows = labelled.where(F.nullif(F.col("category"), F.lit("")).isNotNull())
    model = nb_train(rows)
    packed = cut_lineage(_signed(rows).groupBy("inbox_id", "signature", F.col("category").alias("own")).agg(
        F.count("*").alias("rows_alike"), F.first(F.size("features")).alias("size"),
        F.first("features").alias("features"),
    ))
    bags = packed.select("inbox_id", "signature", "own", F.explode("features").alias("token")).groupBy(
        "inbox_id", "signature", "own", "token"
    ).agg(F.count("*").alias("times"))
    everywhere = model.tokens.groupBy("inbox_id", "token").agg(F.sum("n").alias("all_n"))
    # tokens which vanish from the vocabulary when the row is taken out
    vanish = bags.join(everywhere, ["inbox_id", "token"]).groupBy("inbox_id", "signature", "own").agg(
        F.count_if(F.col("all_n") == F.col("times")).alias("vanish")
    )
    is_own = F.col("category") == F.col("own")
    same = ["inbox_id", "signature", "own"]
    states = cut_lineage(packed.drop("features").join(vanish, same).join(
        model.meta.select("inbox_id", "examples", "vocabulary").where(F.col("examples") - 1 >= V.NB_MIN_EXAMPLES), "inbox_id"))
    # A class without a shared token has the same score in all rows of a size which lose as many tokens.  Besides the row's own class,
    # which has other counts, only two of the three best ones by that score may come first or second.
    kinds = ["inbox_id", "size", "vanish"]
    bases = states.select(*kinds, "examples", "vocabulary").distinct().join(
        model.classes.where(F.col("rows") >= V.NB_MIN_PER_CLASS), "inbox_id"
    ).withColumn("base", F.log(F.col("rows") / (F.col("examples") - 1)) - F.col("size") * F.log(F.col("tokens") + F.col("vocabulary") - F.col("vanish")))
    plain = states.join(_leaders(bases, kinds, 3), kinds).select(*same, "category").unionByName(
        states.select(*same, F.col("own").alias("category"))).withColumn("gain", F.lit(0.0))
    shared = bags.join(model.tokens, ["inbox_id", "token"]).select(*same, "category", (
        F.col("times") * F.log(F.col("n") + 1 - F.when(is_own, F.col("times")).otherwise(0))
    ).alias("gain"))
    gains = shared.unionByName(plain).groupBy(*same, "category").agg(F.sum("gain").alias("gain"))
    grid = (
        gains.join(states, same).join(model.classes, ["inbox_id", "category"])
        .withColumn("rows_left", F.col("rows") - F.when(is_own, 1).otherwise(0))
        .where(F.col("rows_left") >= V.NB_MIN_PER_CLASS)
    )
    base = (
        F.col("tokens") - F.when(is_own, F.col("size")).otherwise(0) + F.col("vocabulary") - F.col("vanish")
    )
    scores = grid.withColumn(
        "score",
        F.log(F.col("rows_left") / (F.col("examples") - 1)) + F.col("gain") - F.col("size") * F.log(base),
    )
    answered = _top_two(scores, ["inbox_id", "signature", "own"])
    judged = packed.select("inbox_id", "signature", "own", "rows_alike").join(
        answered.select("inbox_id", "signature", "own", "category"), ["inbox_id", "signature", "own"], "left"
    )
    tested = F.sum(F.when(F.col("category").isNotNull(), F.col("rows_alike")).otherwise(0))
    correct = F.sum(F.when(F.col("category") == F.col("own"), F.col("rows_alike")).otherwise(0))
    n = F.sum("rows_alike")
    sums = judged.groupBy(*keys).agg(n.alias("n"), tested.alias("tested"), correct.alias("correct"))
    too_few = F.col("n") < V.NB_MIN_EXAMPLES + 1
    return sums.select(
        *keys,
        F.when(too_few, 0).otherwise(F.col("n")).alias("n"),
        F.when(too_few, 0).otherwise(F.col("tested")).alias("tested"),
        F.when(too_few, 0).otherwise(F.col("n") - F.col("tested")).alias("abstained"),
        F.when(too_few, 0).otherwise(F.col("correct")).alias("correct"),
        F.when(F.col("tested") > 0, F.col("correct") / F.col("tested")).otherwise(0.0).alias("accuracy"),
        F.when(too_few, 0.0).otherwise(F.col("tested") / F.col("n")).alias("coverage"),
    )
