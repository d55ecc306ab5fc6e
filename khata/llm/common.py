"""Helpers which several operators share: bound names in expressions, words, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.session import shared_folder

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
NOT_SPACE = "[^ \\t\\n\\x0B\\f\\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value which is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def free_name(df: DataFrame, name: str) -> str:
    """A column name which ``df`` does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Written:
    """Intermediate tables below the shared folder, one folder for each job; ``drop`` removes one."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/khata-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def parted(self, df: DataFrame, name: str, flag: str) -> tuple[DataFrame, DataFrame]:
        """Writes rows where ``flag`` is false and where it is true in one go; two tables, which can be dropped as ``name/flag=true``."""
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(flag).parquet(f"{self.root}/{name}")
        whole = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        return whole.where(~F.col(flag)).drop(flag), whole.where(F.col(flag)).drop(flag)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(items: DataFrame, size: Column, limit: int) -> tuple[DataFrame, int]:
    """``items`` with the column ``_block``, and the number of blocks.  Dealt by the hash of the whole row, sizes of a block sum up to ``limit`` or little more."""
    total = items.agg(F.sum(size)).first()[0] or 0
    count = max(1, -(-int(total) // limit))
    block = F.lit(0) if count == 1 else F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in items.columns]), F.lit(count)).cast("int")
    return items.withColumn("_block", block), count


#: Slots of ``parted_by``, 64 to a row: what is broadcast has a 64th of them in rows at most, whatever the input.
SLOTS = 1 << 22


def parted_by(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the wanted ones, rows whose key isn't), told apart by hash slots without a shuffle.

    Few wanted keys leave most rows where they are; with as many keys as slots all rows are in the first part.  The keys are
    64-bit hashes.  The slots are bits of words, so that the driver and the executors hold few rows of them.
    """
    word, bits, bit = (free_name(rows, n) for n in ("_word", "_bits", "_bit"))
    slot = lambda k: F.pmod(k, F.lit(SLOTS))
    place = lambda k: F.shiftright(slot(k), 6)
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), slot(k).bitwiseAND(F.lit(63)).cast("int"))
    taken = wanted.select(place(wanted_key).alias(word), one(wanted_key).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    marked = rows.withColumn(word, place(key)).withColumn(bit, one(key)).alias("rows")
    few = F.broadcast(taken.alias("taken"))
    met = (F.col(f"rows.{word}") == F.col(f"taken.{word}")) & (F.col(f"rows.{bit}").bitwiseAND(F.col(f"taken.{bits}")) != 0)
    return tuple(marked.join(few, met, how).select(*[F.col(f"rows.`{c}`").alias(c) for c in rows.columns]) for how in ("left_semi", "left_anti"))
