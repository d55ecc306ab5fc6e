"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.llm.common import table
from khata.llm.leaks import found_leaks, n_leaked
from khata.llm.lines import line_report
from khata.llm.mixing import mixed_documents
from khata.llm.phrases import collocations
from khata.llm.pieces import round_trips
from khata.llm.quality import weak_quality
from khata.llm.ranked import ranked
from khata.llm.repeats import without_repeats
from khata.llm.secrets import scan_secrets
from khata.llm.simhash import near_groups
from khata.llm.surrogates import KINDS, pseudonymised
from khata.llm.topk import top_products
from khata.llm.toxicity import scored as toxicity_scored
from khata.llm.toxicity import train as toxicity_train

Query = Callable[[SparkSession, str], DataFrame]

#: Domains of the labelled table: quality and toxicity.
DOMAIN = "concat('q', quality, 't', toxic)"


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents"), ["doc_id"])


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), ["doc_id"])


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, posterior over the domains, rate and copies of every document, for nine tenths of clean text."""
    shares = {"q1t0": 0.9, "q1t1": 0.04, "q0t0": 0.04, "q0t1": 0.02}
    scored, _, domains = mixed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), DOMAIN, shares)
    chances = [F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(domains)]
    return scored.select(F.col("id").alias("doc_id"), "tokens", *chances, "rate", "copies")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows outside of every fifth part, and scores all rows."""
    docs, part = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity_train(docs, table(spark, sf_dir, "labels"), part != 0)
    return toxicity_scored(docs, model).select(
        "doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold", "flagged",
    )


def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents with surrogates for personal data; the key of a query is no secret."""
    return pseudonymised(table(spark, sf_dir, "documents"), "registered query").select("doc_id", "text", *[f"n_{k}" for k in KINDS])


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document which lie in a string of 200 bytes that starts elsewhere, too."""
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best rows for every twentieth vector."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


NORM_BUCKETS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 20
"""


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document which lie in ten words of a benchmark item, and the items."""
    found = found_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_leaked(F.col("spans")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCHMARK_LEAKS_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), starts AS (
  SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w), 10) - 8)) AS i FROM items WHERE len(w) > 0
), windows AS (SELECT DISTINCT k, array_to_string(w[i:i + k - 1], ' ') AS words, item FROM starts
), places AS (
  SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
), hits AS (
  SELECT p.r, p.i, p.k, item FROM places p JOIN windows v ON v.k = p.k AND v.words = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')
), words AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r
), named AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""


def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations(table(spark, sf_dir, "documents"))


PHRASE_MINING_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k
), counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), found AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30
), parts AS (
  SELECT lang, w, f, j, unnest(range(1, len(w) - j + 2)) AS i FROM found, (SELECT unnest(range(2, 4)) AS j) WHERE j < k
), outer_counts AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(f) AS most FROM parts GROUP BY ALL
), kept AS (
  SELECT lang, phrase, f AS a, w, unnest(range(1, k)) AS cut FROM found LEFT JOIN outer_counts USING (lang, phrase)
  WHERE most IS NULL OR 100 * most::HUGEINT < 80 * f::HUGEINT
), scored AS (
  SELECT x.lang, x.phrase, a, cut, b.f AS l, c.f AS r, CAST((2000000 * a::HUGEINT) // (b.f::HUGEINT + c.f) AS BIGINT) AS score
  FROM kept x JOIN counts b ON b.lang = x.lang AND b.phrase = array_to_string(x.w[1:cut], ' ')
  JOIN counts c ON c.lang = x.lang AND c.phrase = array_to_string(x.w[cut + 1:], ' ')
), lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS turn FROM scored) WHERE turn = 1
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN totals USING (lang)
WHERE rank <= 2000
"""


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LEXICAL_SEARCH_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, coalesce(sum(len(w)), 0)::BIGINT AS n_terms FROM docs
), norms AS (SELECT r, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM docs, total WHERE len(w) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings, total GROUP BY term
), scores AS (
  SELECT item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY item_id, r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores JOIN norms USING (r) WHERE score > 0 AND doc_id IS NOT NULL
) WHERE rank <= 50
"""


QUERIES: dict[str, Query] = {
    "op1_quality_rules": quality_rules,
    "op2_simhash_groups": simhash_groups,
    "op3_mixed_sources": mixed_sources,
    "op4_secret_scan": secret_scan,
    "op5_toxicity": toxicity,
    "op6_pii_surrogates": pii_surrogates,
    "op7_sentence_pieces": sentence_pieces,
    "op8_repeated_bytes": repeated_bytes,
    "op9_fuzzy_lines": fuzzy_lines,
    "op10_norm_buckets": norm_buckets,
    "op11_benchmark_leaks": benchmark_leaks,
    "op12_phrase_mining": phrase_mining,
    "op13_lexical_search": lexical_search,
}
ORACLES: dict[str, str] = {
    "op10_norm_buckets": NORM_BUCKETS_SQL,
    "op11_benchmark_leaks": BENCHMARK_LEAKS_SQL,
    "op12_phrase_mining": PHRASE_MINING_SQL,
    "op13_lexical_search": LEXICAL_SEARCH_SQL,
}
