import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from khata.llm import phrases
from khata.llm.common import Written


def plain(rows, words, least, share, top):
    """All phrases of all pieces, one by one."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1))
    found = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    inside = defaultdict(int)
    for g, a in found.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                inside[(g[0], *g[i : i + k])] = max(inside[(g[0], *g[i : i + k])], a)
    out = defaultdict(list)
    for g, a in found.items():
        if 100 * inside[g] < share * a:
            cuts = [(2_000_000 * a // (counts[g[: k + 1]] + counts[(g[0], *g[k + 1 :])]), k, counts[g[: k + 1]], counts[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1)]
            score, _, left, right = min(cuts)
            out[g[0]].append((-score, -a, " ".join(g[1:]).encode(), left, right))
    return sorted((lang, n, p.decode(), -a, le, r, total[lang], -s) for lang, best in out.items() for n, (s, a, p, le, r) in enumerate(sorted(best)[:top], 1))


def corpus(seed, n):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    out = []
    for _ in range(n):
        text = " ".join(rng.choice("abcdefgh") + rng.choice(["", "", "1", "\x01", "é", ",", ". ", "\n", "\t"]) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.3:
            text += " Deep LEARNING models, deep learning rocks " + (passage if rng.random() < 0.5 else "")
        out.append((rng.choice(["en", "en", "e\tn", None]), text))
    return out


@pytest.mark.parametrize(("words", "held", "batch"), [(4, 400_000, 10_000), (4, 50, 7), (3, 20, 3)])
def test_equals_brute_force(spark, words, held, batch):
    rows = corpus(words + held, 250) + [("en", None), ("en", ""), (None, " ,. "), ("xx", "alone"), ("long", "x y z " * 8000)]
    df = spark.createDataFrame([(*r, 1, 2, "t") for r in rows], "lang string, text string, gram int, n int, phrase string").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = phrases.collocations(df, words=words, least=5, top=60, held=held).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == plain(rows, words, 5, 80, 60)


def test_paths_join_what_has_one_way(spark):
    rows = [("en", "a b c d e f g")] * 5 + [("en", "b c d e x")] * 2 + [("en", "q r s t")] * 3
    counts = phrases.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), least=2)
    got = phrases.paths(counts, Written(spark))
    assert sorted((r["phrase"], r["n"]) for r in got.collect()) == [("a b c d", 5), ("b c d e", 7), ("c d e f g", 5), ("c d e x", 2), ("q r s t", 3)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(empty.unionByName(empty.select(F.lit("a").alias("lang"), F.lit("b c").alias("text")))).collect() == []
