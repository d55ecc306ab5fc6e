"""What keeps the import fast: groups are walked instead of settled by rounds, and no generated method is too long to be compiled."""

import random
import re

from pyspark.sql import functions as F

from khata.operators import dedup, extract
from test_dedup_pairs import frame, ids, random_rows, scan

#: Bytes of a method beyond which the JVM only interprets it.
HUGE = 8000


def test_walk_and_rounds_accept_the_same(spark):
    for seed in (11, 12):
        rows = random_rows(seed, 160)
        df = frame(spark, rows).repartition(3)
        want = scan(rows)
        # all groups walked, none, and the smaller ones
        for walked in (dedup.WALKED, 0, 35):
            assert ids(dedup.dedup(df, walked=walked)) == want, walked


def test_stored_rows_are_walked_first(spark):
    rows = random_rows(13, 200)
    random.Random(1).shuffle(rows)
    old, new = rows[:90], rows[90:]
    held = [r for r in old if (r[0], r[1]) in scan(old)]
    stored = frame(spark, held)
    keys = {}
    for r in held:
        keys.setdefault(r[0], set()).update([r[4], *r[5]])
    want = scan(new, keys.items())
    for walked in (dedup.WALKED, 0, 20):
        for same_amount in (True, False):
            assert ids(dedup.dedup(frame(spark, new), stored, same_amount=same_amount, walked=walked)) == want, (walked, same_amount)


def test_a_changed_amount_of_a_stored_row(spark):
    """A ledger's row is met by its keys, whatever its amount says now."""
    stored = frame(spark, [("u", 1, 5, 99, "r:A:10", None)])
    new = frame(spark, [("u", 2, 6, 10, "r:A:10", ["nomerchant:2"]), ("u", 3, 6, 10, "r:B:10", ["nomerchant:3"])])
    assert ids(dedup.dedup(new, stored)) == {("u", 3)}


def test_small_groups_need_no_rounds(spark):
    rows = dedup.accepted_ids(frame(spark, random_rows(14, 50)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sha2" not in plan and "Join" not in plan, plan


def test_methods_of_the_parse_are_compiled(spark, messages_of, tmp_path):
    messages_of(["Rs.5 paid to X on 05-08-25"]).write.parquet(str(tmp_path / "messages"))
    rows = extract.extract_transactions(spark.read.parquet(str(tmp_path / "messages")), "Asia/Kolkata")
    shown = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) <= HUGE, sizes
    assert rows.select(F.col("date_ms")).first()[0] == 1754332200000
