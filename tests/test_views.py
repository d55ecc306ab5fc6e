from pyspark.sql import functions as F

from khata.plans import views


def test_spread_deals_out_by_rows(spark, tmp_path):
    """One file of one row group: its splits say nothing, and parts don't grow with the table."""
    path, rows = f"{tmp_path}/one", 30 * views.PART_ROWS
    spark.range(rows).coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(path)
    for split in ("128m", "20k"):  # a single split, and more splits than cores of which all but one are empty
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            dealt = views.spread(spark.read.parquet(path)).withColumn("part", F.spark_partition_id())
            sizes = [r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sum(sizes) == rows and len(sizes) >= 30 and max(sizes) < 1.1 * views.PART_ROWS
    assert views.spread(spark.range(0)).count() == 0


def test_spread_leaves_many_files(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(2 * cores).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    assert "Exchange" not in views.spread(many)._jdf.queryExecution().toString()


def test_spread_deals_out_many_small_files(spark, tmp_path, monkeypatch):
    """The scan packs small files into few tasks."""
    monkeypatch.setattr(views, "PART_ROWS", 100)
    spark.range(6000).repartition(60).write.parquet(str(tmp_path / "t"))
    packed = spark.read.parquet(str(tmp_path / "t"))
    assert packed.rdd.getNumPartitions() < 60
    dealt = views.spread(packed)
    assert dealt.rdd.getNumPartitions() == 60 and dealt.count() == 6000
