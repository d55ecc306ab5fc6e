import re

import pytest

from khata.llm import quality

WORD = re.compile("[^\x20\x09-\x0D]+")


def features(text):
    """The base counts by plain Python."""
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    places = {}
    for i, w in enumerate(windows):
        places.setdefault(w, []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", "   \n\t", "one", "a b c a b c", "a a a a a", "x\n\nx\ny\n x\nx", "#a *b $$ %", "naïve \U0001F600 words here",
    "the cat sat on the mat and the cat sat on the bed", " lead and trail ", "\x0b\x0c\r mix\rof\x0bspaces", "AA!! " * 80,
    "word " * 5000, " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i % 700}" for i in range(3000)),
]


def test_base_counts_equal_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.weak_quality(docs, ["doc_id"]).collect()}
    for i, text in enumerate(TEXTS):
        row = got[i]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == features(text), text
        assert row["base_failed"] == (row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"])
        assert not (row["base_failed"] and row["kept"])


def test_whole_table_equals_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality.weak_quality(docs, ["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == features(texts[r["doc_id"]])


def test_junk_goes_and_clean_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.weak_quality(docs, ["doc_id"]).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1]
    junk = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum(good) / len(good) > 0.99
    assert sum(junk) / len(junk) < 0.1


def test_fit_recovers_planted_accuracies(spark):
    """Counts drawn exactly from a known model lead back to it."""
    from itertools import product

    prior = 0.7
    on_good = ((0.05, 0.25, 0.7), (0.02, 0.58, 0.4), (0.1, 0.1, 0.8))
    on_bad = ((0.6, 0.3, 0.1), (0.5, 0.4, 0.1), (0.7, 0.1, 0.2))
    rows = []
    for votes in product((-1, 0, 1), repeat=3):
        good, bad = prior, 1 - prior
        for v, g, b in zip(votes, on_good, on_bad):
            good, bad = good * g[v + 1], bad * b[v + 1]
        rows.append((*votes, round(1e8 * (good + bad))))
    fit = quality.fit_rules(spark.createDataFrame(rows, "a int, b int, c int, n bigint"), ["a", "b", "c"], rounds=300)
    assert fit.prior == pytest.approx(prior, abs=0.01)
    for got, want in zip((*fit.on_good, *fit.on_bad), (*on_good, *on_bad)):
        assert got == pytest.approx(want, abs=0.02)


def test_empty_extra_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.weak_quality(empty, ["doc_id"]).collect() == []
    assert quality.good_documents(empty).collect() == []
    text = " ".join(f"word{i}" for i in range(120)) + "."
    docs = spark.createDataFrame([(1, text, 7, "x"), (1, text, 7, "x"), (None, None, None, None)], "doc_id bigint, text string, n_words int, _features string")
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, text, 7, "x")] * 2
