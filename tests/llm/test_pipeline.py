"""Every stage of the pipeline against a plain version of it, each on what the stage before kept."""

from collections import Counter

from pyspark.sql import functions as F
from test_jaccard import plain_firsts
from test_lines import plain_removed
from test_pieces import MODEL
from test_quality import features

import corpus_pipeline
from khata.llm import jaccard, lines, mixing, pieces, quality
from khata.llm.queries import DOMAIN


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, made = docs.columns, [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made[-1], sf).write.parquet(f"{tmp_path}/{number}")
        made.append(spark.read.parquet(f"{tmp_path}/{number}"))
    assert all(m.columns == columns for m in made[:-1])
    rows = [m.collect() for m in made]
    text_of = [{r["doc_id"]: r["text"] for r in some} for some in rows[:-1]]

    verdicts = {r["doc_id"]: r for r in quality.weak_quality(docs, ["doc_id"]).collect()}
    for i, v in verdicts.items():
        n, *_, repeats = features(text_of[0][i])
        assert v["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
    assert sorted(text_of[1]) == sorted(i for i, v in verdicts.items() if not v["base_failed"] and v["quality"] >= 0.5)
    assert all(text_of[0][i] == t for i, t in text_of[1].items())

    versions = {r["doc_id"]: r["v"] for r in made[1].select("doc_id", F.xxhash64("text").alias("v")).collect()}
    gone = plain_removed([(i, t, versions[i]) for i, t in text_of[1].items()])
    assert gone
    for i, t in text_of[1].items():
        assert text_of[2][i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get((i, t), ()))
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])

    groups = plain_firsts(list(text_of[2].items()))
    assert sorted(text_of[3]) == sorted(set(groups.values())) and len(rows[3]) == len(text_of[3])

    scored, rates, _ = mixing.mixed_documents(made[3], spark.read.parquet(f"{sf}/labels.parquet"), DOMAIN, corpus_pipeline.SHARES)
    copies = {r["id"]: r["copies"] for r in scored.collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in rows[4]) == copies
    # Few documents are left, and hardly any junk among them: near the targets is all that can be had.
    assert all(abs(e - t) <= 0.03 * sum(rates.targets) for e, t in zip(rates.expected, rates.targets))

    encoder = pieces.Encoder(MODEL)
    assert len(rows[5]) == len(rows[4]) and "text" not in made[5].columns
    for r in rows[5]:
        assert r["ids"] == encoder.encode(text_of[4][r["doc_id"]]).tolist()
        assert encoder.decode(r["ids"]) == text_of[4][r["doc_id"]]


def test_run_and_empty_documents(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and corpus_pipeline.ORACLE_SQL is None
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.collect() == []


def test_names_which_clash_and_repeated_keys(spark):
    """Columns named as the stages' own ones, repeated and null keys."""
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long), (1, long), (2, long + " eleven"), (3, "quite another text of at least five words"), (None, "nothing like it in the whole table here"), (3, "a second row with the key three is here"), (4, None)]
    names = ["_id", "_version", "_gone", "_kept_text", "_slot", "_keep", "_gone_id", "_again_id", "id", "first", "n"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    kept = lines.without_lines(docs)
    assert kept.columns == docs.columns and sorted(r["_slot"] for r in kept.collect()) == [4] * len(rows)
    left = jaccard.first_of_similar(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "4", "None"]
