"""Near-duplicate texts by SimHash and multi-index hashing.

A fingerprint has 64 bits: bit i is set where more than half of the hashes of the text's shingles have it.  Two fingerprints link at
``distance`` or fewer differing bits.  The bits are cut into segments; of two linked fingerprints at least one pair of segments
differs in few bits, so every fingerprint is stored once under each segment's value, and asks for all values in a small
Hamming ball round its own.  What it finds is verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.common import Written
from khata.llm.graph import components

BITS = 64


def hashes_to_bits(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes, as a signed integer; zero without hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<i8")[0])


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of the ``width``-word shingles of a text, A-Z in lower case; of the whole text if it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    width = min(width, len(words))
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: Column, width: int = 4, seed: int = 42) -> Column:
    """The fingerprint of a text; zero for a null and for a text without words."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([hashes_to_bits(shingle_hashes(t.as_py() or "", width, seed)) for t in batch], pa.int64())

    return of(text)


def hex_digits(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def segments(count: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment.

    Were every one of the first ``rest + 1`` segments more than ``least`` bits apart, and every other at least ``least``, the sum would
    be over ``distance``; so a ball of ``least`` bits round the first ones and of one bit less round the others misses nothing.
    """
    least, rest = divmod(distance, count)
    ends = [round(BITS * i / count) for i in range(count + 1)]
    radii = [least if i <= rest else least - 1 for i in range(count)]
    return [(a, b - a, r) for a, b, r in zip(ends, ends[1:], radii) if r >= 0]


def _within(bits: Column, segment: tuple[int, int, int]) -> Column:
    shift, width, _ = segment
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))


def _tagged(value: Column, segment: int) -> Column:
    return value.bitwiseOR(F.lit(segment << 32))


def _tagged_all(values: Column, segment: int) -> Column:
    return F.transform(values, lambda v: _tagged(v, segment))


def _asking(value: Column, masks: list[int]) -> Column:
    """The ball round a value, without what is below it."""
    return F.filter(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: value.bitwiseXOR(m)), lambda x: x >= value)


def links(prints: DataFrame, distance: int = 4, count: int = 3) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints in the column ``bits`` with at most ``distance`` differing bits.

    ``count`` segments of 64 / count bits: fewer and longer ones send more questions and find fewer false matches; two suit
    billions of texts.
    """
    parts = segments(count, distance)
    stored, asked = [], []
    for j, part in enumerate(parts):
        masks = [sum(1 << i for i in at) for r in range(part[2] + 1) for at in combinations(range(part[1]), r)]
        value = _within(F.col("bits"), part)
        # Of two neighbours only the one with the smaller value asks.
        ball = _asking(value, masks)
        stored.append(_tagged(value, j))
        asked.append(_tagged_all(ball, j))
    have = prints.select(F.col("bits").alias("b"), F.explode(F.array(*stored)).alias("key"))
    want = prints.select(F.col("bits").alias("a"), F.explode(F.concat(*asked)).alias("key"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") != F.col("b"))
    return want.join(have, "key").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, count: int = 3) -> DataFrame:
    """Per row of ``docs``: ``key``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest key of its group).

    Groups are connected by links, the links of others included.  Null and empty texts and texts without words have
    fingerprint zero and link like any other; repeated rows stay and share a group; a null key takes part and is never the
    smallest one unless it is alone; other columns are not read; an empty table gives an empty one.
    """
    place = Written(docs.sparkSession)
    prints = place.table(docs.select(F.col(f"`{key}`").alias("id"), fingerprint(F.col(f"`{text}`"), width).alias("bits")), "prints")
    grouped = components(links(prints.select("bits").distinct(), distance, count), place)
    firsts = prints.groupBy("bits").agg(F.min("id").alias("first"))
    # The groups hold linked fingerprints only; every other fingerprint is a group of its own.
    named = firsts.join(grouped, firsts["bits"] == grouped["node"], "left").select(
        "bits", "first", F.coalesce("component", "bits").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_bits = named.join(smallest, "component").select("bits", "component_id")
    return prints.join(of_bits, "bits").select(
        F.col("id").alias(key), hex_digits(F.col("bits")).alias("fingerprint"), "component_id"
    )


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every group the one with the smallest key stays.

    Of repeated rows with that key one stays, whichever; a row with a null key stays only if its whole group has none.
    """
    groups = near_groups(docs, key, text, **how)
    keep = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_keep")).distinct()
    left = docs.join(keep, F.col(f"`{key}`").eqNullSafe(keep["_keep"]), "left_semi")
    return left.dropDuplicates([key])
