from pyspark.sql import functions as F

from khata.llm import common, mixing


def test_slots_part_rows_and_few_rows_are_sent(spark):
    rows = spark.range(20_000).select("id", F.lit(1).alias("_word"), F.lit("a").alias("taken"))
    wanted = spark.range(0, 20_000, 7).select(F.col("id").alias("w"))
    near, far = common.parted_by(rows, F.xxhash64("id"), wanted, F.xxhash64("w"))
    assert near.columns == far.columns == rows.columns
    inside, outside = ({r["id"] for r in df.collect()} for df in (near, far))
    assert set(range(0, 20_000, 7)) <= inside and inside | outside == set(range(20_000)) and not inside & outside
    assert len(inside) < 1.1 * 20_000 / 7
    # Every slot taken makes a row of 64 slots, not one a slot.
    assert common.SLOTS // 64 <= 1 << 16


def test_documents_taken_once_stay_where_they_are(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (1, "e")], "doc_id bigint, text string")
    scored = spark.createDataFrame([(1, 2), (2, 1), (3, 0), (None, 1), (1, 2)], "id bigint, copies int")
    taken = mixing.take_copies(docs, scored)
    assert sorted(r["text"] for r in taken.collect()) == ["a", "a", "b", "d", "e", "e"]
