import random
from collections import Counter

import numpy as np
import pytest

from khata.llm import repeats


def plain(texts, span):
    """Counts every string of ``span`` bytes; per text (bytes, removed, runs, kept)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[d[i:i + span]] > 1:
                gone[i:i + span] = True
        gone = gone[:-1]
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def corpus(seed, n, letters="abc é"):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    shared = [text(rnd.randrange(20, 260)) for _ in range(8)]
    out = [None, "", "ab" * 200, "a" * 350, "short", text(60), text(61)]
    for _ in range(n):
        out.append("".join(rnd.choice([rnd.choice(shared), text(rnd.randrange(5, 120))]) for _ in range(rnd.randrange(1, 6))))
    out += [out[10], out[11], out[12] + "x", "y" + out[13]]
    return out


@pytest.mark.parametrize(("group", "task", "shard"), [(20000, 20000, 4096), (3, 40, 7)])
def test_equals_brute_force(spark, group, task, shard):
    texts = corpus(group, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in repeats.without_repeats(docs, span=60, gram=12, group=group, task=task, shard=shard).collect())
    want = plain(texts, 60)
    assert any(w[1] for w in want) and any(0 < w[1] < w[0] for w in want)
    assert [(r[0], *r[1:4], bytes(r[4])) for r in got] == [(i, *w) for i, w in enumerate(want)]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = docs.collect()
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}
    for row, want in zip(texts, plain([r["text"] for r in texts], 200)):
        r = got[row["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want


@pytest.mark.parametrize("shard", [1, 5, 1000])
def test_merged_transforms_are_the_sorted_suffixes(shard):
    rng = np.random.default_rng(shard)
    rows = rng.integers(97, 99, (80, 30)).astype(np.uint8)
    rows[40:60] = rows[:20]
    rows[40:60, 5] = 120
    group = rng.integers(0, 6, 80)
    first, last = repeats.repeated_starts(rows, group, 18, 12, shard)
    for i in range(80):
        at = [j for j in range(19) if any(k != i and group[k] == group[i] and (rows[k, j:j + 12] == rows[i, j:j + 12]).all() for k in range(80))]
        assert (first[i], last[i]) == ((at[0], at[-1]) if at else (-1, -1))


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(5)
    one = bytes(rnd.randrange(97, 101) for _ in range(90))
    a, b = b"x" * 17 + one + b"y" * 40, b"zz" + one
    places = [set(repeats.anchors(repeats.gram_hashes(np.frombuffer(d, np.uint8), 12), 49).tolist()) for d in (a, b)]
    assert any(p - 17 + 2 in places[1] for p in places[0])


def test_tables(spark):
    text = "0123456789" * 30
    docs = spark.createDataFrame([(1, text, 1, "x"), (1, text, 1, "x"), (None, None, None, None), (2, "a" * 100, 0, "")], "doc_id bigint, text string, cuts int, id string")
    rows = sorted((tuple(r)[:4] for r in repeats.without_repeats(docs).collect()), key=str)
    assert rows == sorted([(1, 300, 300, 1), (1, 300, 300, 1), (None, 0, 0, 0), (2, 100, 0, 0)], key=str)
    assert repeats.without_repeats(docs.limit(0)).collect() == []


def bordering(span, gram):
    """Texts which share only their first or only their last bytes, beside others with a longer passage that lies further in."""
    rnd = random.Random(9)
    text = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    out = []
    for _ in range(60):
        head, tail, near = text(span - rnd.randrange(0, span // 2)), text(span), rnd.randrange(1, span // 2)
        whole = head + tail
        # The first two begin alike, too short for a repeat; the third shares what comes later.  Then the same from the end.
        three = [whole + text(5), head + text(span), text(near) + whole[near:] + text(7)]
        out += three + [x[::-1] for x in three]
    return out


@pytest.mark.parametrize("group", [20000, 1])
def test_texts_which_share_a_beginning_or_an_end(spark, group):
    texts = bordering(60, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in repeats.without_repeats(docs, span=60, gram=12, group=group).collect())
    want = plain(texts, 60)
    assert any(w[1] for w in want)
    assert [(r[0], *r[1:4], bytes(r[4])) for r in got] == [(i, *w) for i, w in enumerate(want)]
