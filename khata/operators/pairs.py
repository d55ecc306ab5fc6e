"""Self-transfer candidates: an expense and an income which are one movement between own accounts.

Debits are served in the order (date, sms_id).  Each takes the first income in the same order which
is still free, has the same amount, lies within 24 hours, and is on another account; rows naming a
third party take no part.  The outcome depends on the order, so it cannot be a plain join.

Time is cut into blocks per (inbox, amount).  Within a block the rows are streamed in time order: an
income enters when it happens, a debit is served when all incomes it may take have been seen, and
incomes older than its window are forgotten.  The state is the free incomes of 48 hours, whatever the
size of the block.  Incomes near a border belong to both blocks.  A block must know which of them
the block before it has taken: the first pass assumes none, and only blocks whose assumption was wrong
are served again until nothing changes.  Every pass settles at least one more block of a run, so the
end is the exact result; border cases are rare, so most inboxes are done after two passes, however long the run of another one is.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.functions import clock
from khata.functions import fixed_values as V
from khata.functions.money import names_third_party
from khata.session import cut_lineage

# the helpers travel with the job: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_US = V.PAIR_WINDOW_MS * 1000
BLOCK_US = 2 * WINDOW_US  # no shorter: an income may be wanted by two blocks, never by three
GROUP = ["inbox_id", "amount", "block"]


def third_party(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("names_third_party", names_third_party())


def _candidates(ledger: DataFrame) -> DataFrame:
    """Expenses and incomes which may be halves of a movement, with their block."""
    return ledger.where(F.col("kind").isin("expense", "income") & ~names_third_party()).select(
        "inbox_id", "amount", "fingerprint", "sms_id",
        (F.col("kind") == "expense").alias("is_debit"),
        F.coalesce("account", F.lit("?")).alias("account"),
        clock.wall_micros(F.col("date")).alias("at"),
    ).withColumn("block", F.floor(F.col("at") / BLOCK_US))


def candidate_groups(ledger: DataFrame) -> DataFrame:
    """Per (inbox, amount) how many debits and incomes may meet; groups with one side only go."""
    return _candidates(ledger).groupBy("inbox_id", "amount").agg(
        F.count_if("is_debit").alias("debits"), F.count_if(~F.col("is_debit")).alias("credits"),
    ).where((F.col("debits") > 0) & (F.col("credits") > 0))


def _blocks(rows: DataFrame) -> DataFrame:
    """Debits in their own block; incomes in every block whose debits may reach them."""
    at = F.col("at")
    reach = F.sequence(F.floor((at - WINDOW_US) / BLOCK_US), F.floor((at + WINDOW_US) / BLOCK_US))
    credits = rows.where(~F.col("is_debit")).withColumn("block", F.explode(reach))
    return rows.where("is_debit").unionByName(credits).withColumn(
        # a debit comes up once every income up to the end of its window has been seen
        "turn", F.when(F.col("is_debit"), at + WINDOW_US).otherwise(at)
    )


class _Free:
    """Free incomes of the current window by account, each in order of (time, id)."""

    def __init__(self) -> None:
        self.queues: dict[str, deque] = {}

    def add(self, account: str, credit: tuple) -> None:
        self.queues.setdefault(account, deque()).append(credit)

    def take(self, account: str, since: int) -> tuple | None:
        """The first income not older than ``since`` on any other account."""
        best = None
        for name in list(self.queues):
            queue = self.queues[name]
            while queue and queue[0][0] < since:
                queue.popleft()
            if not queue:
                del self.queues[name]
            elif name != account and (best is None or queue[0] < self.queues[best][0]):
                best = name
        return None if best is None else self.queues[best].popleft()


def _serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams sorted partitions; the state is dropped when the group changes."""
    group, free = None, _Free()
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            key = (row.inbox_id, row.amount, row.block)
            if key != group:
                group, free = key, _Free()
            if not row.is_debit:
                if not row.taken:
                    free.add(row.account, (row.at, row.sms_id, row.fingerprint))
                continue
            credit = free.take(row.account, row.at - WINDOW_US)
            if credit is not None:
                out.append((*key, row.fingerprint, row.sms_id, row.at, credit[2], credit[1], credit[0]))
        yield pd.DataFrame(out, columns=[
            "inbox_id", "amount", "block", "debit", "debit_id", "debit_at", "credit", "credit_id", "credit_at",
        ])


PAIR_SCHEMA = (
    "inbox_id string, amount string, block bigint, debit string, debit_id bigint, debit_at bigint, "
    "credit string, credit_id bigint, credit_at bigint"
)


def _match(blocks: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Pairs of all blocks, given the incomes which the block before has taken."""
    if taken is None:
        rows = blocks.withColumn("taken", F.lit(False))
    else:
        mark = taken.withColumn("_taken", F.lit(True))
        rows = blocks.join(mark, [*GROUP, "sms_id", "is_debit"], "left").withColumn(
            "taken", F.coalesce("_taken", F.lit(False))
        )
    return (
        rows.repartition(*GROUP)
        .sortWithinPartitions(*GROUP, "turn", "is_debit", "at", "sms_id")
        .select("inbox_id", F.col("amount").cast("string").alias("amount"), "block", "is_debit", "taken",
                "account", "at", "sms_id", "fingerprint")
        .mapInPandas(_serve, PAIR_SCHEMA)
        .withColumn("amount", F.col("amount").cast(blocks.schema["amount"].dataType))
    )


def _taken_by(pairs: DataFrame) -> DataFrame:
    """Incomes which the next block also holds."""
    next_block = F.col("block") + 1
    return pairs.where(F.floor((F.col("credit_at") + WINDOW_US) / BLOCK_US) >= next_block).select(
        "inbox_id", "amount", next_block.alias("block"), F.col("credit_id").alias("sms_id"),
        F.lit(False).alias("is_debit"),
    )


def _settled(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with the pass which gave them, passes in which blocks were served again).

    The worklist of a pass is the blocks whose incomes taken by the block before have changed; the first pass serves all blocks
    as if nothing was taken.  A change only runs on within its inbox and amount, so what a pass reads shrinks to those.
    """
    kind = ["inbox_id", "amount"]
    pairs = [cut_lineage(_match(blocks, None)).withColumn("pass", F.lit(0))]
    taken = cut_lineage(_taken_by(pairs[0]))
    work, again = taken.select(*GROUP).distinct(), []
    while not (work := cut_lineage(work)).isEmpty():
        again.append(work.withColumn("pass", F.lit(len(pairs))))
        kinds = work.select(*kind).distinct()
        blocks = cut_lineage(blocks.join(kinds, kind, "left_semi"))
        now = cut_lineage(_match(blocks.join(work, GROUP, "left_semi"), taken))
        served = work.withColumn("block", F.col("block") + 1)
        old, new = taken.join(served, GROUP, "left_semi"), _taken_by(now)
        pairs.append(now.withColumn("pass", F.lit(len(pairs))))
        changed = new.exceptAll(old).unionByName(old.exceptAll(new)).select(*GROUP).distinct()
        taken = cut_lineage(taken.join(kinds, kind, "left_semi").join(served, GROUP, "left_anti").unionByName(new))
        work = changed
    none = blocks.select(*GROUP, F.lit(0).alias("pass")).limit(0)
    return reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, again, none)


def transfer_pairs(ledger: DataFrame, since: datetime | None = None) -> DataFrame:
    """Suggested pairs: inbox_id, debit, credit (fingerprints) and amount.

    ``since`` keeps rows from then on only.
    """
    rows = ledger if since is None else ledger.where(F.col("date") >= clock.ntz(since))
    blocks = _blocks(_candidates(rows))
    both = blocks.groupBy(*GROUP).agg(
        F.bool_or("is_debit").alias("has_debit"), F.bool_or(~F.col("is_debit")).alias("has_credit")
    ).where("has_debit AND has_credit").select(*GROUP)
    pairs, again = _settled(cut_lineage(blocks.join(both, GROUP, "left_semi")))
    # what a block gave when it was served for the last time
    last = again.groupBy(*GROUP).agg(F.max("pass").alias("last"))
    final = pairs.join(last, GROUP, "left").where(F.col("pass") == F.coalesce("last", F.lit(0)))
    return final.select("inbox_id", "debit", "credit", "amount")


def dashboard_pairs(ledger: DataFrame, now: datetime) -> DataFrame:
    """Pairs of the last sixty days."""
    return transfer_pairs(ledger, now - timedelta(days=60))
