import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from khata.llm import ranked
from khata.llm.leaks import words_of

KIND = "doc_id bigint, text string, n string, score int, rank int, doc int"


def plain(docs, items, k):
    """Every document scored for every item."""
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    total, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = defaultdict(set)
    for name, t in items:
        if name is not None:
            asked[name] |= set(words_of(t))
    out = []
    for name, words in asked.items():
        best = []
        for i, c in counts:
            if i is not None and c:
                m = 50 + 50 * sum(c.values()) * total // length
                s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words)
                if s > 0:
                    best.append((-s, i))
        out += [(name, n, i, -s) for n, (s, i) in enumerate(sorted(best)[:k], 1)]
    return sorted(out)


def test_treap_finds_the_best_columns():
    rng = np.random.default_rng(3)
    for n_rows, n_columns, filled in ((1, 1, 1), (3, 40, 30), (50, 7, 200), (40, 700, 6000)):
        cells = np.unique(rng.integers(0, n_rows * n_columns, filled))
        rows, columns, values = cells // n_columns, cells % n_columns, rng.integers(1, 30, len(cells)) ** 3
        grid = ranked.Treap(rows, columns, values)
        full = np.zeros((n_rows, n_columns), np.int64)
        full[rows, columns] = values
        for _ in range(20):
            asked = rng.choice(n_rows, rng.integers(1, min(n_rows, 9) + 1), replace=False)
            sums, k = full[asked].sum(0), int(rng.integers(1, 12))
            kth = max(1, np.sort(sums)[::-1][:k][-1]) if n_columns >= k else 1
            at, found = grid.best(asked, k, 1)
            assert sorted(at) == sorted(np.flatnonzero(sums >= kth)) and (sums[at] == found).all()
            at, found = grid.best(asked, k, int(kth) + 5)
            assert set(np.flatnonzero(sums >= kth + 5)) <= set(at)


@pytest.mark.parametrize("shard", [5, 64, 1 << 14])
def test_equals_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    text = lambda n, to: " ".join(f"w{x}" for x in rng.zipf(1.3, n) % to)
    docs = [(i, text(int(rng.integers(0, 60)), 200)) for i in range(300)] + [(300 + i, "W1 w2, w77 w5!") for i in range(120)]  # many equal texts
    docs += [(900, None), (901, ""), (902, "..."), (None, "w1 w2 w3"), (7, "w9 w9 w9"), (7, "w9 w9 w9"), (903, "w4 " * 30_000)]
    items = [(i, text(12, 300)) for i in range(12)] + [(12, "w2 w77"), (13, None), (14, ""), (None, "w1"), (3, "w77 w5"), (15, "unknown words only")]
    df = spark.createDataFrame([(*d, "x", 1, 2, 3) for d in docs], KIND).repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id int, text string, name int")
    want = plain(docs, items, 20)
    for limit in (1 << 17, 60):  # one block, and several
        got = ranked.ranked(df, asked, 20, shard=shard, limit=limit).collect()
        assert sorted(map(tuple, got)) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert ranked.ranked(docs.limit(0), items).collect() == []
    assert ranked.ranked(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in ranked.ranked(docs, items).collect()] == [("x", 1, 1)]
