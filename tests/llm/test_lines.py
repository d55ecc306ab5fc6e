import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from khata.llm import lines


def plain_form(line):
    return " ".join(re.findall("[^ ]+", "".join("0" if "0" <= c <= "9" else c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in line)))


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_removed(docs, similarity=0.8, distance=3):
    """Compares all lines with all; {(key, text): removed line numbers}."""
    at = {}
    for key, text, version in docs:
        for n, line in enumerate((text or "").split("\n")):
            form = plain_form(line)
            if len(form.split()) >= 5:
                at.setdefault(form, set()).add((key, version, n, text))
    forms = sorted(at)
    bits = {f: int(lines.line_bits([f.encode()], [len(f.split())])[0]) & (1 << 64) - 1 for f in forms}
    root = {f: f for f in forms}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(forms):
        for b in forms[:i]:
            if bin(bits[a] ^ bits[b]).count("1") <= distance and plain_edits(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9:
                root[find(a)] = find(b)
    groups, gone = {}, {}
    for f in forms:
        groups.setdefault(find(f), set()).update(at[f])
    for members in groups.values():
        keep = min(members, key=lambda m: m[:3])
        for m in members:
            if m[:3] != keep[:3]:
                gone.setdefault((m[0], m[3]), set()).add(m[2])
    return gone


def corpus():
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "the of tion ing er on an in re st".split() for b in "al or um it és 7".split()]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 60))) for _ in range(40)]
    out = []
    for key in range(60):
        picked = []
        for _ in range(rnd.randrange(1, 8)):
            line = rnd.choice(base).split()
            if rnd.random() < 0.5:
                line[rnd.randrange(len(line))] = rnd.choice(words)
            picked.append(" ".join(line).capitalize() + rnd.choice([".", "!", ""]))
        out.append((key, "\n".join(picked)))
    return out + [(100, None), (101, ""), (102, "\n\n"), (103, "For " * 300), (104, "For " * 301), (105, "For " * 100), (3, "One line of more than five words\nOne line of more than five words")]


def test_equals_comparing_all_lines(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    rows = [(r["doc_id"], r["text"], r["v"]) for r in docs.withColumn("v", F.xxhash64("text")).collect()]
    want = plain_removed(rows)
    assert any(len(v) for v in want.values())
    report = lines.without_lines(docs.withColumn("n", F.length("text")), length="n").collect()
    got = sorted(((r["doc_id"], r["text"]) for r in report), key=str)
    expected = []
    for key, text, _ in rows:
        gone = want.get((key, text), set())
        expected.append((key, text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)))
    assert got == sorted(expected, key=str)
    assert all(r["n"] == (None if r["text"] is None else len(r["text"])) for r in report)


def test_links_are_found_by_near_words():
    a = [f"word{i}" for i in range(60)]
    b = a[:30] + ["other"] + a[31:]
    bits = lines.line_bits([" ".join(x).encode() for x in (a, b, ["x"] * 60, ["x"] * 30)], [60, 60, 60, 30])
    apart = [bin(int(x ^ y) & (1 << 64) - 1).count("1") for x, y in ((bits[0], bits[1]), (bits[2], bits[3]))]
    assert apart[0] <= 8 < apart[1]


def test_edits():
    rnd = random.Random(4)
    for _ in range(400):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 70)))
        b = list(a)
        for _ in range(rnd.randrange(0, 12)):
            at = rnd.randrange(len(b) + 1)
            b[at:at + rnd.randrange(2)] = rnd.choice(["", "x", "ab"])
        b = "".join(b)
        want = plain_edits(a, b)
        for most in (0, 3, 20, 200):
            got = lines.edits(a, b, most)
            assert got == want if want <= most else got > most


def test_tables(spark):
    line = "this line has more than five words in it"
    rows = [(1, f"{line}\nshort", 1, "x"), (1, f"{line}\nshort", 1, "x"), (2, line.upper() + "!", 2, "y"), (None, f"new\n{line}", 3, "z"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, gone int, id string")
    got = sorted(map(tuple, lines.without_lines(docs).collect()), key=str)
    # The null key sorts first and keeps the line.
    assert got == sorted([(1, "short", 1, "x"), (1, "short", 1, "x"), (2, "", 2, "y"), (None, f"new\n{line}", 3, "z"), (4, None, None, None)], key=str)
    report = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.line_report(docs).collect()}
    assert report == {1: (2, 1), 2: (1, 1), None: (2, 0), 4: (0, 0)}
    assert lines.without_lines(docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 5000])
def test_one_very_long_line(size):
    counts = [size * 10]
    bits = lines.line_bits([b" ".join(b"w%d" % (i % 977) for i in range(size * 10))], counts)
    assert bits.dtype == np.int64 and len(bits) == 1


def test_lines_of_odd_texts(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "a b c d e", "  a  b c\td e ", "a b c d\n e f g h i", "x\x00y z w v u\r\nq", "a b c d é\n", "\na b c d e", "words " * 300]
    texts += ["".join(rnd.choice("ab1,. \n\té\x00") for _ in range(rnd.randrange(300))) for _ in range(300)]
    ids, columns = list(range(len(texts))), ["id", "version", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts, pa.string())], columns)
    want = [(i, n, f) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) if len((f := plain_form(line)).split()) >= 5]
    for size in (1 << 18, 50, 1):
        monkeypatch.setattr(lines, "CHUNK_BYTES", size)
        rows = [r for part in lines._lines([batch]) for r in part.to_pylist()]
        assert [(r["id"], r["line_no"], r["form"]) for r in rows] == want
        assert [r["bits"] for r in rows] == [int(lines.line_bits([f.encode()], [len(f.split())])[0]) for _, _, f in want]


def test_bits_are_counted_as_by_single_bits():
    rnd = np.random.default_rng(5)
    counts = np.array([1, 255, 256, 5, 1000, 510, 2])
    hashes, firsts = rnd.integers(0, 1 << 63, counts.sum(), np.uint64) * np.uint64(2) + np.uint64(1), np.cumsum(counts) - counts
    single = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    assert (lines._bit_counts(hashes, firsts, counts) == np.add.reduceat(single, firsts, axis=0, dtype=np.int64)).all()


def test_words_apart_is_never_below_the_edits():
    rnd = random.Random(8)
    words, found = "a bc def ghij klmno p qr stu".split(), 0
    for _ in range(400):
        a = [rnd.choice(words) for _ in range(rnd.randrange(1, 60))]
        b = list(a)
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = rnd.choice([[], ["x"], ["bc", "a"]])
        a, b = " ".join(a), " ".join(b)
        least, most = plain_edits(a, b), max(len(a), len(b)) // 5
        got = lines.words_apart(a, b, most)
        assert got >= min(least, most + 1)
        found += got <= most
    assert found > 200


def test_links_go_through_one_shuffle(spark):
    kinds = spark.range(3000).select(F.md5(F.col("id").cast("string")).cast("binary").alias("line"), F.xxhash64("id").alias("bits"))
    plan = lines.paired(kinds, 5, 3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1")):
        spark.conf.set(k, v)
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "ReusedExchange" in text


def test_texts_are_not_sorted_to_meet_their_lines(spark):
    line = "this line has more than five words in it"
    docs = spark.createDataFrame([(i, f"{line}\nline {i} of these few words") for i in range(50)], "doc_id bigint, text string")
    plan = lines.without_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_edits_of_lines_with_little_in_common():
    rnd = random.Random(6)
    for _ in range(150):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(20, 200)))
        b = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(20, 200)))
        b = rnd.choice([b, a[20:] + b[:20], b[: len(b) // 2] + a])
        want = plain_edits(a, b)
        for most in (1, 10, max(len(a), len(b)) // 5, want, want + 1):
            got = lines.edits(a, b, most)
            assert got == want if want <= most else got > most
