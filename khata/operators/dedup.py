"""Removal of repeated reports of one payment, exactly as a newest-first scan would do it.

A scanned row is a duplicate when it shares its fingerprint or a soft key with a row accepted
before; only accepted rows count.  The outcome depends on the scan order, so neither
``dropDuplicates`` nor a session window gives it.  Here it is computed without a scan:

Two reports of one payment have the inbox and the amount in common, and the amount is a part of every key.  So rows are dealt out and
sorted by (inbox, amount) once and walked in scan order, streaming; the keys taken in one group are the only state.  That holds for
groups of up to ``WALKED`` rows.  Rows of larger groups are settled without one task for a group:

1. *Copies* (same fingerprint and same soft keys) all stand or fall with their first one, so they
   are reduced to it by a partial aggregation.  A hot payment shrinks before anything is shuffled.
2. Rows which meet a key of the stored ledger are duplicates.
3. In rounds, every undecided row which is first on all of its keys is accepted, and rows sharing a
   key with an accepted row are dropped.  A round is a grouped minimum and joins over hashed keys, and writes what is left; no group is
   collected.  A round settles a whole crowd on one key at once; only chains of rows which overlap
   one after another need further rounds.
4. What is left after ``rounds`` are such chains: reduced cells of consecutive ten-minute buckets.
   They are walked in order, streaming through sorted partitions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.session import cut_lineage

# the helpers travel with the job: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 6
#: Rows of one (inbox, amount) which one task walks.
WALKED = 100_000
GROUP = ["inbox_id", "amount"]
ID = ["inbox_id", "sms_id"]


def _scan_order() -> Column:
    """Newest first, then by id."""
    return F.struct((-F.col("sms_date_ms")).alias("age"), F.col("sms_id").alias("sms_id"))


def _matchable_keys() -> Column:
    """Soft keys which can meet another row; the placeholder of a row without merchant cannot."""
    return F.filter("soft_keys", lambda k: ~k.startswith("nomerchant:"))


def _narrow(key: Column) -> Column:
    """128 bits of a key's SHA-256, which stand for the key wherever keys are compared."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def _keys(fingerprint: Column, soft_keys: Column) -> Column:
    every = F.array_union(F.array(F.concat(F.lit("f|"), fingerprint)), F.transform(soft_keys, lambda k: F.concat(F.lit("s|"), k)))
    return F.explode(F.transform(every, _narrow)).alias("key")


def _keys_of(rows: DataFrame) -> DataFrame:
    """One row per identity of a row: its fingerprint and its soft keys."""
    return rows.select("inbox_id", "amount", "node", _keys(F.col("fingerprint"), F.col("soft_keys")))


def known_keys(ledger: DataFrame) -> DataFrame:
    """The identities of a stored ledger; rows without soft keys have only their fingerprint."""
    soft = F.coalesce("soft_keys", F.array().cast("array<string>"))
    return ledger.select("inbox_id", _keys(F.col("fingerprint"), soft)).distinct()


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Accepts rows of sorted partitions in order.

    The state are the keys taken in one (inbox, amount) which a later row still has: a key comes with its last row and is forgotten there.
    """
    group, seen = None, set()
    for batch in batches:
        taken = []
        for inbox, amount, age, sms_id, keys in zip(*(batch[c] for c in ("inbox_id", "amount", "age", "sms_id", "keys"))):
            if group != (inbox, amount):
                group, seen = (inbox, amount), set()
            free = seen.isdisjoint(k["key"] for k in keys)
            for k in keys:
                later = (k["last_age"], k["last_id"]) > (age, sms_id)
                if not later:
                    seen.discard(k["key"])
                elif free:
                    seen.add(k["key"])
            taken.append(free)
        yield batch.loc[taken, ["inbox_id", "sms_id"]]


def _led(keys: DataFrame) -> DataFrame:
    """Keys with their first and last node."""
    ends = keys.groupBy("inbox_id", "key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    return keys.join(ends, ["inbox_id", "key"])


def _settle(nodes: DataFrame, rounds: int) -> DataFrame:
    """The (inbox_id, sms_id) of accepted nodes.

    All rounds work on one narrow table of (inbox, amount, key, node) and the first and last node of the key; each round writes what is left of it.
    """
    by_node = ["inbox_id", "node"]
    open_ = cut_lineage(_led(_keys_of(nodes)))
    chosen: list[DataFrame] = []
    for _ in range(rounds):
        winners = open_.groupBy(*by_node).agg(F.bool_and(F.col("node") == F.col("first")).alias("leads")).where("leads").select(*by_node)
        chosen.append(winners)
        # a key is taken when its first node has won, and then it settles all nodes which hold it
        settled = open_.join(winners.withColumnRenamed("node", "first"), ["inbox_id", "first"], "left_semi").select(*by_node).distinct()
        left = open_.join(settled, by_node, "left_anti").select("inbox_id", "amount", "key", "node")
        open_ = cut_lineage(_led(left))
        if open_.isEmpty():
            break
    else:
        ends = F.struct("key", F.col("last.age").alias("last_age"), F.col("last.sms_id").alias("last_id"))
        walked = (
            open_.groupBy("inbox_id", "amount", "node").agg(F.collect_list(ends).alias("keys"))  # three keys at most
            .repartition("inbox_id", "amount")
            .sortWithinPartitions("inbox_id", "amount", "node")
            .select("inbox_id", F.col("amount").cast("string").alias("amount"), F.col("node.age").alias("age"), F.col("node.sms_id").alias("sms_id"), "keys")
            .mapInPandas(_walk, "inbox_id string, sms_id bigint")
        )
        return _all(chosen).select("inbox_id", "node.sms_id").unionByName(walked)
    return _all(chosen).select("inbox_id", "node.sms_id")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _walk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accepts rows of sorted partitions in order; stored rows come first in their group, and their keys are taken.

    The state are the keys taken in one (inbox, amount).
    """
    group, prints, softs = None, set(), set()
    for batch in batches:
        taken: tuple[list[str], list[int]] = ([], [])
        # the keys of a batch as one list, cut by the arrays' ends
        keys, ends = batch.column(5).values.to_pylist(), batch.column(5).offsets.to_pylist()
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for inbox, amount, stored, sms_id, fingerprint, start, end in zip(*columns, ends, ends[1:]):
            soft = keys[start:end]
            if group != (inbox, amount):
                group, prints, softs = (inbox, amount), set(), set()
            if not stored:
                if fingerprint in prints or not softs.isdisjoint(soft):
                    continue
                taken[0].append(inbox)
                taken[1].append(sms_id)
            if fingerprint is not None:
                prints.add(fingerprint)
            softs.update(soft)
        yield pa.record_batch([pa.array(taken[0], pa.string()), pa.array(taken[1], pa.int64())], names=ID)


def _walked(rows: DataFrame) -> DataFrame:
    """The (inbox_id, sms_id) of accepted rows: one shuffle and one sort of narrow rows."""
    return (
        rows.repartition(*GROUP).sortWithinPartitions(*GROUP, F.desc("stored"), "node")
        .select("inbox_id", F.col("amount").cast("string"), "stored", "node.sms_id", "fingerprint", "soft_keys")
        .mapInArrow(_walk_rows, "inbox_id string, sms_id bigint")
    )


def _by_rounds(rows: DataFrame, known: DataFrame | None, rounds: int) -> DataFrame:
    """The (inbox_id, sms_id) of accepted rows, however many have an inbox and amount in common."""
    nodes = rows.groupBy(*GROUP, "fingerprint", "soft_keys").agg(F.min("node").alias("node"))
    if known is not None:
        nodes = _unmet(nodes, known)
    return _settle(nodes, rounds)


def _unmet(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows which have no key of a stored ledger."""
    met = _keys_of(rows).join(known_keys(known), ["inbox_id", "key"], "left_semi")
    return rows.join(met.select("inbox_id", "node").distinct(), ["inbox_id", "node"], "left_anti")


def accepted_ids(txns: DataFrame, known: DataFrame | None = None, rounds: int = ROUNDS, same_amount: bool = False, walked: int = WALKED) -> DataFrame:
    """(inbox_id, sms_id) of the rows a newest-first scan accepts.

    ``known`` is a stored ledger (fingerprint, soft_keys) whose identities are taken already.  With ``same_amount`` its rows have the amounts
    which their keys name (those of an index of identities have; a ledger's may have been changed), and they are walked with the others.
    """
    none = F.array().cast("array<string>")
    rows = txns.select(*GROUP, "fingerprint", F.coalesce(_matchable_keys(), none).alias("soft_keys"), _scan_order().alias("node"))
    taken = None
    if known is not None and same_amount:
        taken = known.select("inbox_id", F.col("amount").cast(txns.schema["amount"].dataType).alias("amount"), "fingerprint", F.coalesce("soft_keys", none).alias("soft_keys"))
    every = rows.select(*GROUP) if taken is None else rows.select(*GROUP).unionByName(taken.select(*GROUP))
    crowds = cut_lineage(every.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > walked).select(*GROUP))

    def part(df: DataFrame | None, how: str) -> DataFrame | None:
        same = [df[c].eqNullSafe(crowds[c]) for c in GROUP] if df is not None else None
        return None if df is None else df.join(crowds, same, how)

    if crowds.isEmpty():
        few, few_taken, settled = rows, taken, None
    else:
        few, few_taken = part(rows, "left_anti"), part(taken, "left_anti")
        settled = _by_rounds(part(rows, "left_semi"), known if taken is None else part(taken, "left_semi"), rounds)
    if known is not None and taken is None:
        few = _unmet(few, known)
    few = few.withColumn("stored", F.lit(False))
    if few_taken is not None:
        order = rows.schema["node"].dataType
        few = few.unionByName(few_taken.select("*", F.lit(None).cast(order).alias("node"), F.lit(True).alias("stored")))
    done = _walked(few)
    return done if settled is None else done.unionByName(settled)


def newest_versions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the largest by ``order``, which parts all rows but equal ones.  Rows are reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    version = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(version.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def drop_repeated_messages(messages: DataFrame) -> DataFrame:
    """One row per message id, since pages of a scan may overlap: the newest version, by its text if there are several."""
    return newest_versions(messages, ["inbox_id", "id"], ["date_ms", "body", "address"])


def mark_duplicates(txns: DataFrame, known: DataFrame | None = None, rounds: int = ROUNDS, **options) -> DataFrame:
    """Adds ``duplicate`` to every row.  Options are those of ``accepted_ids``."""
    kept = accepted_ids(txns, known, rounds, **options).withColumn("_kept", F.lit(True))
    return txns.join(kept, ID, "left").withColumn("duplicate", F.col("_kept").isNull()).drop("_kept")


def dedup(txns: DataFrame, known: DataFrame | None = None, rounds: int = ROUNDS, **options) -> DataFrame:
    """The rows which are no duplicates.  Options are those of ``accepted_ids``."""
    return txns.join(accepted_ids(txns, known, rounds, **options), ID, "left_semi")
