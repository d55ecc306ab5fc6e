import random
import re

from xxhash import xxh64_intdigest

from khata.llm import simhash
from khata.llm.common import Written
from khata.llm.graph import components


def plain_fingerprint(text):
    """Bit by bit, as the definition reads."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """(key, smallest reachable key) by comparing all pairs."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in prints}


TEXTS = [None, "", "  \n", "one two", "ONE two", "É Ünï a b c", "a b c d", "a b c d e", "a b c d a b c d a b c d", "x " * 3000]


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(100000 + i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    docs = docs.unionByName(more)
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    groups = plain_groups(prints)
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(prints)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == groups[r["doc_id"]]


def test_links_lose_nothing(spark):
    """Random neighbours at every distance up to five, under several cuts."""
    rnd = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(150):
        base = rnd.getrandbits(64)
        prints |= {base} | {base ^ sum(1 << b for b in rnd.sample(range(64), d)) for d in range(1, 6)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "bits bigint")
    for distance, count in ((4, 3), (4, 2), (3, 4), (0, 2)):
        want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}
        assert {tuple(r) for r in simhash.links(df, distance, count).collect()} == want


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + rnd.randrange(400), 5000 + rnd.randrange(400)) for _ in range(250)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = components(spark.createDataFrame(pairs, "a bigint, b bigint"), Written(spark)).collect()
    linked = {k for a, b in pairs if a != b for k in (a, b)}
    assert {r["node"]: r["component"] for r in got} == {k: find(k) for k in linked} and len(got) == len(linked)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Written(spark)).collect() == []


def test_tables(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text, "a", 1), (2, text, "b", 2), (2, text, "b", 2), (7, "quite another text", "c", 3), (None, None, None, None), (9, None, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, bits int")
    got = sorted(map(tuple, simhash.near_groups(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (2, 2), (7, 7), (None, 9), (9, 9)], key=str)
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 9]
    assert simhash.near_groups(docs.limit(0)).collect() == [] and simhash.first_of_groups(docs.limit(0)).collect() == []
