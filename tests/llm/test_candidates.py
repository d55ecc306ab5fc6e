from khata.llm import common, jaccard


def test_simhash_finds_candidates(spark):
    kinds = spark.createDataFrame([(bytearray([i]), b) for i, b in enumerate([0, 0b1111, 0b11111111, -1, -1, 1 << 40 | 0x5555])], "node binary, bits bigint")
    place = common.Written(spark)
    keys = {r["node"][0]: r["key"] for r in jaccard.simhash_keys(kinds, place).collect()}
    assert keys[0] == keys[1] == keys[2] and keys[3] == keys[4] and len(set(keys.values())) == 3
