import random

import pytest
from pyspark.sql import functions as F

from khata.llm import leaks

KIND = "doc_id bigint, text string, n_words string, spans int, _key int, _text int, _copies int"


def plain(text, items, span):
    """(words, leaked words, items) by comparing every window at every place."""
    words, hit, names = leaks.words_of(text), set(), set()
    for name, value in items:
        item = leaks.words_of(value)
        size = min(span, len(item))
        if name is None or not size:
            continue
        for i in range(len(item) - size + 1):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == item[i : i + size]:
                    hit.update(range(j, j + size))
                    names.add(str(name))
    return len(words), sorted(hit), sorted(names)


def told(row):
    return row["n_words"], [j for s in row["spans"] for j in range(s["start"], s["end"])], list(row["items"])


@pytest.mark.parametrize("span", [1, 2, 4])
def test_automaton_equals_brute_force(span):
    rng = random.Random(span)
    for _ in range(150):
        letters = "ab" if rng.random() < 0.5 else "abcd"
        draw = lambda n: " ".join(rng.choice(letters) for _ in range(rng.randint(0, n)))  # noqa: B023, E731
        items = [(str(i), draw(9)) for i in range(rng.randint(0, 6))]
        automaton = leaks.Automaton([(n, leaks.words_of(t)) for n, t in items], span)
        for text in (draw(30), draw(30) + " zz " + draw(10)):
            spans, names = automaton.matches(leaks.words_of(text))
            want = plain(text, items, span)
            assert (len(leaks.words_of(text)), [j for a, b in spans for j in range(a, b)], sorted(names)) == want
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


ITEMS = [(1, "One two three four five, six."), (2, "Ünder 42 stairs"), (None, "left out entirely"), (4, None), (5, ""), (6, "?!"), (1, "seven eight"), (7, "two three four five six seven")]


def test_tables(spark):
    texts = ["zero ONE two, three FOUR five six seven", "ünder 42 stairs Ünder 42 stairs", "Ünder-42: STAIRS!", None, "", "...", "left out entirely", "seven eight", "seven eight", "x " * 50_000 + "seven eight"]
    rows = [(i if i != 3 else None, t, "n", i, i, i, i) for i, t in enumerate(texts)] + [(0, texts[0], "n", 0, 0, 0, 0)]
    docs, items = spark.createDataFrame(rows, KIND), spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("name", F.lit(1))
    for limit, piece in ((1 << 17, 1 << 13), (4, 5)):  # one block, and many with long items in pieces
        got = leaks.found_leaks(docs, items, span=4, limit=limit, piece=piece).collect()
        assert sorted((str(r["doc_id"]), r["text"] or "", *map(str, told(r))) for r in got) == sorted(
            (str(i), t or "", *map(str, plain(t, ITEMS, 4))) for i, t, *_ in rows
        )
    assert leaks.found_leaks(docs.limit(0), items).collect() == []
    assert all(r["items"] == [] for r in leaks.found_leaks(docs, items.limit(0)).collect())


def test_spans_are_cut_and_covered_texts_go(spark):
    rows = [(1, "Before it: one two three four five! after it all, and on we go."), (2, "one two three four five six"), (3, "nothing at all"), (4, None), (5, "seven eight makes a short item which stays here")]
    got = leaks.without_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id int, text string"), length=4, span=4)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "Before it: ! after it all, and on we go.", 3: "nothing at all", 4: None, 5: rows[4][1]}
