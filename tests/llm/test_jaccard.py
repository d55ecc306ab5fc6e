import random

import corpus_pipeline
from khata.llm import jaccard


def plain_set(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_firsts(docs):
    """Compares all pairs; the smallest key of every group."""
    sets = {i: plain_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if plain_similarity(sets[a], sets[b]) >= 0.8 - 1e-12:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in keys}


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"new{rnd.randrange(10**6)}"
    return out


def corpus():
    rnd = random.Random(7)
    out = []
    for _ in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([9, 40, 500]))]
        out.append(words)
        for n in (1, 2, 5, 10, 12):
            if n < len(words) / 8:
                out.append(edited(rnd, words, n))
    chain = [f"c{i}" for i in range(200)]
    for _ in range(8):
        out.append(chain)
        chain = edited(rnd, chain, 3)
    texts = [" ".join(w) for w in out] + [None, "", " \n", "one two", "ONE  two", "one two three", "a b c d e", "a b c d e a b c d e"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_stage_equals_comparing_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_firsts(rows)
    assert len(set(want.values())) < len(rows) - 60
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs).collect()} == want


def test_stage_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = plain_firsts([tuple(r) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in jaccard.first_of_similar(docs).collect()) == sorted(set(want.values()))


def test_recall_of_the_keys():
    """Pairs at 0.8 to 0.85 share a key."""
    import numpy as np

    rng = np.random.default_rng(2)
    met = 0
    for _ in range(500):
        n = int(rng.integers(5, 400))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        more = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)  # similarity n / (n + n // 4), at least 0.8
        a, b = np.concatenate([both, more[: len(more) // 2]]), np.concatenate([both, more[len(more) // 2:]])
        met += bool(set(jaccard.band_keys(a).tolist()) & set(jaccard.band_keys(b).tolist()))
    assert met >= 498


def test_tables(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text, "a", 1), (2, text.upper(), "b", 2), (2, text.upper(), "b", 2), (7, "quite another text", "c", 3), (None, None, None, None), (9, None, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, version string, bits int")
    got = sorted(map(tuple, jaccard.similar_groups(docs).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (2, 2), (7, 7), (None, 9), (9, 9)], key=str)
    assert sorted(r["doc_id"] for r in jaccard.first_of_similar(docs).collect()) == [2, 7, 9]
    assert jaccard.similar_groups(docs.limit(0)).collect() == [] and jaccard.first_of_similar(docs.limit(0)).collect() == []
