"""What a ledger holds already, for batches of a stream: identities in runs, each split by (inbox, amount).

A batch leaves a run of the rows it accepted: (inbox, amount, fingerprint, soft keys).  After every ``fan``-th batch the last ``fan``
runs of a level become one run of the next level, so a row is rewritten once a level and a history of n batches has at most
``fan`` runs in each of log n levels.  Which runs cover the batches before a given one follows from its number alone, so there is no
list to keep up to date, and a batch which is delivered again sees what it saw the first time.

Merged runs are folders of ``buckets``, a hash of (inbox, amount).  Two reports of one payment have both in common, so a batch reads only the
buckets of its own rows, and of them only rows of its own (inbox, amount), before any key is made out of them.  Runs of single batches
are small and are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN, BUCKETS = 8, 256
GROUP = ["inbox_id", "amount"]
COLUMNS = [*GROUP, "fingerprint", "soft_keys"]
SCHEMA = "inbox_id string, amount decimal(18,2), fingerprint string, soft_keys array<string>"


def cover(batch: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, first batch) of the runs which hold all batches before ``batch``."""
    runs, first, level = [], 0, 0
    while fan ** (level + 1) <= batch:
        level += 1
    while level >= 0:
        while first + fan**level <= batch:
            runs.append((level, first))
            first += fan**level
        level -= 1
    return runs


def _hadoop(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    files, at = _hadoop(spark, f"{path}/_SUCCESS")
    return files.exists(at)


class Identities:
    """The runs below one folder."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.fan, self.buckets = spark, path, fan, buckets

    def _run(self, level: int, first: int) -> str:
        return f"{self.path}/level-{level}/run-{first}"

    def _complete(self, path: str) -> bool:
        return complete(self.spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*GROUP), F.lit(self.buckets)).cast("int")

    def _read(self, level: int, first: int) -> DataFrame:
        schema = SCHEMA if level == 0 else f"{SCHEMA}, bucket int"
        return self.spark.read.schema(schema).parquet(self._run(level, first))

    def batches(self) -> int:
        """How many batches the complete runs hold."""
        files, at = _hadoop(self.spark, self.path)
        ends = [0]
        for level in files.listStatus(at) if files.exists(at) else []:
            size = self.fan ** int(level.getPath().getName().removeprefix("level-"))
            for run in files.listStatus(level.getPath()):
                if self._complete(run.getPath().toString()):
                    ends.append(int(run.getPath().getName().removeprefix("run-")) + size)
        return max(ends)

    def before(self, batch: int, rows: DataFrame) -> DataFrame:
        """Stored identities of batches before this one which have the inbox and amount of a row of ``rows``."""
        groups = rows.select(*GROUP).distinct()
        runs = cover(batch, self.fan)
        parts = [self._read(*run) for run in runs if run[0] == 0]
        if len(parts) < len(runs):
            # at most as many numbers as there are buckets
            mine = [r["bucket"] for r in groups.select(self._bucket().alias("bucket")).distinct().collect()]
            parts += [self._read(*run).where(F.col("bucket").isin(mine)).drop("bucket") for run in runs if run[0] > 0]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return reduce(DataFrame.unionByName, parts).join(groups, GROUP, "left_semi")

    def add(self, batch: int, rows: DataFrame) -> None:
        """Stores the identities of a batch's rows and merges full levels; doing it again changes nothing."""
        rows.select(*[F.col(c).cast(t) for c, t in zip(COLUMNS, ("string", "decimal(18,2)", "string", "array<string>"))]).write.mode("overwrite").parquet(self._run(0, batch))
        level = 1
        while (batch + 1) % self.fan**level == 0:
            first, step = batch + 1 - self.fan**level, self.fan ** (level - 1)
            if not self._complete(self._run(level, first)):
                parts = [self._read(level - 1, first + i * step) for i in range(self.fan)]
                merged = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts]).withColumn("bucket", self._bucket())
                merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._run(level, first))
            level += 1
        # Runs which the batch before has merged: it won't be delivered again.
        level = 1
        while batch and batch % self.fan**level == 0:
            for first in range(batch - self.fan**level, batch, self.fan ** (level - 1)):
                files, at = _hadoop(self.spark, self._run(level - 1, first))
                files.delete(at, True)
            level += 1
