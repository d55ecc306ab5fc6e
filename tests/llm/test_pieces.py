import random
from pathlib import Path

import pytest
from sentencepiece import SentencePieceProcessor

from khata.llm import pieces

MODEL = Path(pieces.MODEL).read_bytes()
TEXTS = [
    "", " ", "    ", "Hello world", "  two  spaces ", "a▁b", "▁", "▁▁ x", "\n\n\tline\r\n", "x\x00y", "\U0001F600 emoji ണ",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 100 + "end", "Ungßlich ööü ñandú çà", "\x00▁", "thethethethe" * 40,
]


SP = SentencePieceProcessor(model_proto=MODEL)
known = {SP.id_to_piece(i): (i, SP.get_score(i)) for i in range(3, SP.get_piece_size()) if not SP.is_byte(i)}


def whole_viterbi(v, text):
    """All starts and ends over the whole text at once."""
    best, back = [0.0] + [None] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        for end in range(i + 1, min(i + v.longest, len(text)) + 1):
            piece, score = known.get(text[i:end], (None, None))
            if piece is not None and (best[end] is None or best[i] + score > best[end]):
                best[end], back[end] = best[i] + score, (i, [piece])
        if text[i] not in known and (best[i + 1] is None or best[i] + v.unknown > best[i + 1]):
            best[i + 1], back[i + 1] = best[i] + v.unknown, (i, [v.bytes[b] for b in text[i].encode()])
    out, p = [], len(text)
    while p:
        p, ids = back[p]
        out = ids + out
    return out


def random_texts(n, size, seed):
    rnd = random.Random(seed)
    words = "the of tion ing er on an in é ß 中文 \U0001F600 == // \n \t 12 2024 http:// __init__ aaa zzz".split(" ")
    return ["".join(rnd.choice(words) + rnd.choice(["", "", " ", "  "]) for _ in range(rnd.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize("part", [1, 3, 17, 1 << 16])
def test_streaming_equals_the_whole_lattice(part):
    e = pieces.Encoder(MODEL)
    v = e.v
    for text in random_texts(60, 60, part) + ["a" * 500, "ab" * 300]:
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        stream, got = pieces.Stream(v), []
        for at in range(0, len(marked), part):
            got += stream.feed(marked[at:at + part])
        assert got + stream.finish() == whole_viterbi(v, marked)
        e = pieces.Encoder(MODEL)
        assert e.encode(text, part).tolist() == (whole_viterbi(v, marked) if text else [])


def test_window_stays_bounded_where_paths_converge():
    v = pieces.Vocabulary(MODEL)
    stream = pieces.Stream(v)
    for _ in range(2000):
        stream.feed("▁some▁ordinary▁words")
    assert stream.window <= 2 * v.longest and len(stream.text) <= 3 * v.longest


def test_the_library_decodes_the_ids():
    sp, e = SP, pieces.Encoder(MODEL)
    for text in random_texts(300, 30, 5) + TEXTS:
        assert sp.decode(e.encode(text).tolist()) == text


def test_round_trip(spark, sf):
    e = pieces.Encoder(MODEL)
    for text in TEXTS:
        assert e.decode(e.encode(text).tolist()) == text
    rows = pieces.round_trips(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)


def test_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (1, "a b", 3), (2, None, None), (3, "", 0), (None, "x" * 300000, 1)], "doc_id bigint, text string, n_ids int")
    out = pieces.encode(docs)
    assert out.columns == ["doc_id", "text", "n_ids", "ids"]
    rows = out.collect()
    assert rows[0]["ids"] == rows[1]["ids"] and rows[2]["ids"] is None and rows[3]["ids"] == []
    back = out.select(pieces.decoded(out["ids"]).alias("t")).collect()
    assert [r["t"] for r in back] == [r["text"] for r in rows]
    assert pieces.encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    with pytest.raises(ValueError):
        pieces.encode(docs, out="N_IDS")
