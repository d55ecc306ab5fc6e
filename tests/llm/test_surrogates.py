import re

import pytest
from pyspark.sql import functions as F

from khata.llm import surrogates
from khata.llm.common import Written

OCTETS = re.compile(r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$")


def luhn(digits):
    return sum(d if (len(digits) - i) % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, digits))) % 10 == 0


def changed(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r for r in surrogates.pseudonymised(df, key).collect()}


TEXTS = [
    "mail ann.42@mail8.example.com or ANN.42@MAIL8.EXAMPLE.COM now", "call +1 (988) 555-2485 or +1-988-555-2485.", "host 42.144.35.254. and 300.1.1.1",
    "card 4111111111111111 and 4111 1111 1111 1111 or 4041894974608790", "Mr. John Smith met Mrs Anna Smith; Mr Smith left. Госпожа Иванова пришла",
    "ssn 078-05-1120", None, "", "nothing here, version 4.0.1 of 2024", "twice: ann.42@mail8.example.com", "+1 (269) 555-3296 4524132264652876 end", "çreé.90@mail2.example.com",
]


def test_kinds_formats_and_coreference(spark):
    rows = changed(spark, TEXTS)
    mail = re.findall(r"\S+@\S+", rows[0]["text"])
    assert mail[0].upper() == mail[1] and re.fullmatch(r"[a-z]{3}\.\d\d@mail\d+\.example\.org", mail[0]) and mail[0] != "ann.42@mail8.example.com"
    assert rows[9]["text"] == f"twice: {mail[0]}"
    phones = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4})\.", rows[1]["text"])
    assert phones and re.sub(r"\D", "", phones[1]) == re.sub(r"\D", "", phones[2]) != "19885552485"
    host = re.fullmatch(r"host (\S+)\. and 300\.1\.1\.1", rows[2]["text"])
    assert host and all(0 < int(x) < 256 for x in OCTETS.match(host[1]).groups()) and host[1] != "42.144.35.254"
    card = re.fullmatch(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}) or (\d{16})", rows[3]["text"])
    assert card and card[1] == card[2].replace(" ", "") and luhn(card[1]) and card[1] != "4111111111111111"
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+); Mr (\w+) left\. Госпожа (\w+) пришла", rows[4]["text"])
    assert names and names[1] in surrogates.GIVEN["m_latin"] and names[3] in surrogates.GIVEN["f_latin"]
    assert names[2] == names[4] == names[5] != "Smith" and re.fullmatch("[А-Яа-я]+", names[6])
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", rows[5]["text"]) and "078-05-1120" not in rows[5]["text"]
    assert rows[6]["text"] is None and rows[7]["text"] == "" and rows[8]["text"] == TEXTS[8]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d{16} end", rows[10]["text"])
    assert "çreé" not in rows[11]["text"]
    assert [rows[3][f"n_{k}"] for k in surrogates.KINDS] == [0, 0, 0, 0, 3, 0]


def test_key_decides(spark):
    a, b, c = (changed(spark, TEXTS, key) for key in ("one", "one", "two"))
    assert {i: r["text"] for i, r in a.items()} == {i: r["text"] for i, r in b.items()}
    assert a[0]["text"] != c[0]["text"]


def test_collisions_are_drawn_again(spark):
    """A hundred short numbers in a space of a few hundred: first draws collide, the result doesn't."""
    entities = spark.range(100, 400).select(F.lit("ssn").alias("kind"), F.col("id").cast("string").alias("entity"))
    first = entities.select(surrogates.surrogate_of(F.col("kind"), F.col("entity"), 0, "k").alias("s")).distinct().count()
    rows = surrogates.surrogates(entities, "k", Written(spark)).collect()
    assert first < 300 and len(rows) == 300 == len({r["surrogate"] for r in rows})
    assert not {r["surrogate"] for r in rows} & {r["entity"] for r in rows}


def test_no_original_is_left_in_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b")
    rows = surrogates.pseudonymised(docs, "k").collect()
    assert len(rows) == len(texts)
    before = {m for t in texts.values() for m in found.findall(t)}
    after = {m for r in rows for m in found.findall(r["text"])}
    assert before and not before & after and len(before) == len(after)
    for r in rows:
        assert found.sub("#", texts[r["doc_id"]]) == found.sub("#", r["text"])


def test_tables(spark):
    rows = [(1, "x a.b@c.de", "q", 1), (1, "x a.b@c.de", "q", 1), (None, "a.b@c.de", None, None), (2, None, "r", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, swaps int")
    with pytest.raises(ValueError):
        surrogates.pseudonymised(docs.withColumn("N_email", F.lit(1)), "k")
    got = surrogates.pseudonymised(docs.withColumnRenamed("swaps", "value"), "k", counts=False)
    assert got.columns == ["doc_id", "text", "kind", "value"]
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect())
    assert len({t.split()[-1] for _, t in texts if t}) == 1 and len(texts) == 4
    assert surrogates.pseudonymised(docs.limit(0), "k").collect() == []


def test_names_keep_who_is_who(spark):
    """People with a few surnames and many given names: one new surname each, all people different, mentions without given names alike."""
    people = [(f"{g}{chr(97 + n % 26)}{chr(97 + n // 26)}", s) for s in ("Kennedy", "Smith", "Duval", "Orr") for n in range(60) for g in ("Jo", "Mi")]
    texts = [f"Mr {g} {s} came. Mr {s} left." for g, s in people]
    texts += ["Mr John Fitzgerald Kennedy and Mr Kennedy", "Mrs Anne-Marie Duval", "MR is no title, Mr ORR is", "Frau Ada Duval Herr Smith", "call (555) 123-4567 or 555-123-4567"]
    rows = changed(spark, texts)
    new = {}
    for i, (g, s) in enumerate(people):
        given, surname, alone = re.fullmatch(r"Mr ([\w-]+) (\w+) came\. Mr (\w+) left\.", rows[i]["text"]).groups()
        assert surname == alone != s and new.setdefault(s, surname) == surname
        new[g, s] = given
    assert len({new[s] for s in ("Kennedy", "Smith", "Duval", "Orr")}) == 4
    assert len({(new[p], p[1]) for p in people}) == len(people)
    at = len(people)
    three = re.fullmatch(r"Mr ([\w-]+) ([\w-]+) (\w+) and Mr (\w+)", rows[at]["text"])
    assert three and three[3] == three[4] == new["Kennedy"]
    assert rows[at + 1]["text"].endswith(" " + new["Duval"]) and "Marie" not in rows[at + 1]["text"]
    assert rows[at + 2]["text"] == f"MR is no title, Mr {new['Orr'].upper()} is"
    assert re.fullmatch(rf"Frau [\w-]+ {new['Duval']} Herr {new['Smith']}", rows[at + 3]["text"])
    one, two = re.fullmatch(r"call (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", rows[at + 4]["text"]).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "5551234567"
