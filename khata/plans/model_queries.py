"""Queries over the learned classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.operators import categories, model
from khata.plans import views
from khata.plans.registry import query
from khata.plans.sql_views import LEDGER

# features of the labelled parts, spelled out with list functions
PARTS = """parts AS (
    SELECT p_brand AS inbox_id, p_partkey AS sms_id, p_name AS key,
      lower(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE split_part(p_name, ' ', 2) END) AS category,
      CAST(p_retailprice AS DECIMAL(18,2)) AS amount, p_size FROM part),
  bags AS (
    SELECT *, list_concat(
      flatten(list_transform(string_split(key, ' '), lambda w: CASE WHEN length(w) > 4 THEN ['m:' || w, 'mp:' || left(w, 4)] ELSE ['m:' || w] END)),
      list_transform(list_filter(list_transform(range(1, length(key) - 1), lambda i: substr(key, i, 3)),
        lambda g: length(trim(g)) = 3), lambda g: 'g:' || g),
      ['s:SND' || p_size, 'c:upi', 'd:debit', 'a:' || CASE WHEN amount < 100 THEN 'xs' WHEN amount < 500 THEN 's'
        WHEN amount < 2000 THEN 'm' WHEN amount < 10000 THEN 'l' ELSE 'xl' END]) AS features FROM parts),
  tokens AS (SELECT inbox_id, sms_id, category AS own, unnest(features) AS token FROM bags),
  counted AS (SELECT inbox_id, own AS category, token, count(*) AS n FROM tokens GROUP BY ALL),
  classes AS (SELECT inbox_id, category, count(*) AS rows, CAST(sum(len(features)) AS BIGINT) AS tokens FROM bags GROUP BY ALL),
  vocabulary AS (SELECT inbox_id, count(DISTINCT token) AS vocabulary FROM counted GROUP BY ALL),
  meta AS (
    SELECT inbox_id, CAST(sum(rows) AS BIGINT) AS examples, count(*) FILTER (rows >= 3) AS usable, any_value(vocabulary) AS vocabulary
    FROM classes JOIN vocabulary USING (inbox_id) GROUP BY inbox_id)"""


@query("nb_train_tokens", f"WITH {PARTS} SELECT * FROM counted")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return model.nb_train(views.labelled_parts(spark, sf)).tokens


@query("nb_train_classes", f"WITH {PARTS} SELECT * FROM classes")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return model.nb_train(views.labelled_parts(spark, sf)).classes


@query("nb_train_meta", f"WITH {PARTS} SELECT *, examples >= 12 AND usable >= 2 AS ready FROM meta")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return model.nb_train(views.labelled_parts(spark, sf)).meta


@query("features", f"WITH {PARTS} SELECT inbox_id, sms_id, array_to_string(features, '|') AS features FROM bags")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return model.with_features(views.labelled_parts(spark, sf)).select(
        "inbox_id", "sms_id", F.array_join("features", "|").alias("features"))


PREDICTED = f"""{PARTS}, scored AS (
    SELECT b.inbox_id, b.sms_id, b.category AS own, c.category,
      ln(c.rows / m.examples) - len(features) * ln(c.tokens + m.vocabulary) AS base
    FROM bags b JOIN classes c USING (inbox_id) JOIN meta m USING (inbox_id)
    WHERE c.rows >= 3 AND m.examples >= 12 AND m.usable >= 2),
  gains AS (
    SELECT t.inbox_id, sms_id, c.category, sum(ln(n + 1)) AS gain
    FROM tokens t JOIN counted c ON t.inbox_id = c.inbox_id AND t.token = c.token GROUP BY ALL),
  ranked AS (
    SELECT inbox_id, sms_id, own, category, base + coalesce(gain, 0) AS score,
      row_number() OVER (PARTITION BY inbox_id, sms_id ORDER BY base + coalesce(gain, 0) DESC, category) AS place,
      score - lead(base + coalesce(gain, 0)) OVER (PARTITION BY inbox_id, sms_id ORDER BY base + coalesce(gain, 0) DESC, category) AS margin,
      lead(category) OVER (PARTITION BY inbox_id, sms_id ORDER BY base + coalesce(gain, 0) DESC, category) AS second
    FROM scored LEFT JOIN gains USING (inbox_id, sms_id, category)),
  answered AS (SELECT * FROM ranked WHERE place = 1 AND margin >= 2)"""


@query("nb_predict", f"""WITH {PREDICTED} SELECT inbox_id, sms_id, category, round(margin, 6) AS margin,
    round(least(0.95, 0.5 + margin / 10), 6) AS confidence FROM answered""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.labelled_parts(spark, sf)
    out = model.nb_predict(model.nb_train(rows), rows)
    return out.withColumns({"margin": F.round("margin", 6), "confidence": F.round("confidence", 6)})


@query("nb_predict_why", f"""WITH {PREDICTED}, placed AS (
      SELECT inbox_id, sms_id, unnest(features) AS token, generate_subscripts(features, 1) AS pos FROM bags),
    lifted AS (
      SELECT a.inbox_id, a.sms_id, p.token, p.pos, f.n - coalesce(g.n, 0) AS lift
      FROM answered a JOIN placed p USING (inbox_id, sms_id)
        JOIN counted f ON f.inbox_id = a.inbox_id AND f.token = p.token AND f.category = a.category
        LEFT JOIN counted g ON g.inbox_id = a.inbox_id AND g.token = p.token AND g.category = a.second
      WHERE f.n - coalesce(g.n, 0) > 0
      QUALIFY row_number() OVER (PARTITION BY a.inbox_id, a.sms_id ORDER BY lift DESC, p.pos) <= 3)
    SELECT inbox_id, sms_id, a.category, string_agg(token, '|' ORDER BY lift DESC, pos) AS why
    FROM answered a LEFT JOIN lifted USING (inbox_id, sms_id) GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.labelled_parts(spark, sf)
    out = model.nb_predict(model.nb_train(rows), rows, why=True)
    return out.select("inbox_id", "sms_id", "category", F.array_join("why", "|").alias("why"))


@query("nb_leave_one_out", f"""WITH {PARTS}, own_tokens AS (
      SELECT inbox_id, sms_id, own, token, count(*) AS times FROM tokens GROUP BY ALL),
    everywhere AS (SELECT inbox_id, token, sum(n) AS all_n FROM counted GROUP BY ALL),
    vanish AS (
      SELECT inbox_id, sms_id, count(*) FILTER (all_n = times) AS v FROM own_tokens JOIN everywhere USING (inbox_id, token)
      GROUP BY ALL),
    grid AS (
      SELECT b.inbox_id, b.sms_id, b.category AS own, c.category, len(features) AS size,
        c.rows - CASE WHEN c.category = b.category THEN 1 ELSE 0 END AS left_rows, m.examples - 1 AS n,
        c.tokens - CASE WHEN c.category = b.category THEN len(features) ELSE 0 END + m.vocabulary - v AS denominator
      FROM bags b JOIN classes c USING (inbox_id) JOIN meta m USING (inbox_id) JOIN vanish USING (inbox_id, sms_id)
      WHERE left_rows >= 3 AND m.examples - 1 >= 12),
    gains AS (
      SELECT t.inbox_id, sms_id, c.category, sum(times * ln(n + 1 - CASE WHEN c.category = own THEN times ELSE 0 END)) AS gain
      FROM own_tokens t JOIN counted c ON t.inbox_id = c.inbox_id AND t.token = c.token GROUP BY ALL),
    ranked AS (
      SELECT inbox_id, sms_id, own, category, ln(left_rows / n) + coalesce(gain, 0) - size * ln(denominator) AS score
      FROM grid LEFT JOIN gains USING (inbox_id, sms_id, category)),
    placed AS (
      SELECT *, row_number() OVER w AS place, score - lead(score) OVER w AS margin FROM ranked
      WINDOW w AS (PARTITION BY inbox_id, sms_id ORDER BY score DESC, category)),
    answered AS (SELECT * FROM placed WHERE place = 1 AND margin >= 2),
    sums AS (
      SELECT b.inbox_id, count(*) AS n, count(a.sms_id) AS tested, count(*) FILTER (a.category = b.category) AS correct
      FROM bags b LEFT JOIN answered a USING (inbox_id, sms_id) GROUP BY b.inbox_id)
    SELECT inbox_id, CASE WHEN n < 13 THEN 0 ELSE n END AS n, CASE WHEN n < 13 THEN 0 ELSE tested END AS tested,
      CASE WHEN n < 13 THEN 0 ELSE n - tested END AS abstained, CASE WHEN n < 13 THEN 0 ELSE correct END AS correct,
      CASE WHEN tested > 0 THEN round(correct / tested, 6) ELSE 0.0 END AS accuracy,
      CASE WHEN n < 13 THEN 0.0 ELSE round(tested / n, 6) END AS coverage FROM sums""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = model.nb_leave_one_out(views.labelled_parts(spark, sf))
    return out.withColumns({"accuracy": F.round("accuracy", 6), "coverage": F.round("coverage", 6)})


LABELLED = f"""{LEDGER}, labelled AS (
    SELECT * REPLACE (CASE WHEN sms_id % 25 = 0 THEN 'travel' WHEN sender LIKE '%MYNTRA' THEN 'shopping'
      WHEN sender LIKE '%HDFCBK' AND sms_id % 2 = 0 THEN 'food' WHEN sender LIKE '%HDFCBK' THEN 'bills'
      ELSE lower(substr(sender, 4)) END AS category) FROM ledger),
  by_category AS (SELECT inbox_id, substr(sender, 4) AS sender_id, category, count(*) AS c FROM labelled GROUP BY ALL),
  priors AS (
    SELECT inbox_id, sender_id, arg_max(category, (c, category)) AS category, CAST(sum(c) AS BIGINT) AS n
    FROM by_category GROUP BY ALL HAVING sum(c) >= 4 AND max(c) / sum(c) >= 0.9)"""


@query("sender_priors", f"WITH {LABELLED} SELECT * FROM priors")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return model.sender_priors(views.labelled_ledger(spark, sf))


@query("model_statistics", f"""WITH {LABELLED}, per_class AS (SELECT inbox_id, category, count(*) AS rows FROM labelled GROUP BY ALL)
    SELECT inbox_id, sum(rows) >= 12 AND count(*) FILTER (rows >= 3) >= 2 AS ready, CAST(sum(rows) AS BIGINT) AS examples,
      count(*) FILTER (rows >= 3) AS classes, coalesce(any_value(senders), 0) AS senders
    FROM per_class LEFT JOIN (SELECT inbox_id, count(*) AS senders FROM priors GROUP BY 1) USING (inbox_id) GROUP BY inbox_id""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.labelled_ledger(spark, sf).withColumns({"bank": F.lit(None).cast("string"), "channel": F.lit("upi")})
    return model.model_statistics(model.nb_train(rows), model.sender_priors(rows)).drop("vocabulary")


@query("training_rows", f"""WITH {LEDGER} SELECT inbox_id, sms_id, category FROM ledger
    WHERE category_source = 'user' AND category IS NOT NULL AND category <> 'other'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return model.training_rows(views.ledger(spark, sf)).select("inbox_id", "sms_id", "category")


@query("ladder_with_model")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The whole ladder with learned rungs: trained on the labelled parts and applied to all of them."""
    parts = views.labelled_parts(spark, sf)
    taught = parts
    rows = categories.with_sender_id(parts).withColumns({
        "kind": F.lit("expense"), "merchant_quality": F.lit("named"), "needs_review": F.lit(False),
        "review_reason_override": F.lit(None).cast("string"),
    })
    resolved = categories.resolve_categories(
        rows, None, model.sender_priors(taught), model.nb_predict(model.nb_train(taught), rows))
    return resolved.groupBy("inbox_id", "category", "category_source").agg(F.count("*").alias("n"))
