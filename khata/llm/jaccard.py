"""Near-duplicate texts by the Jaccard similarity of their word shingles, which is verified exactly.

A text is the set of its ``width``-word shingles, A-Z in lower case.  Candidates share one of ``BANDS`` keys, each made from the minima
of the set under ``ROWS`` hash functions; a pair at similarity s shares one with a chance of 1 - (1 - s ** ROWS) ** BANDS,
which is 0.9996 at 0.8 and falls below a hundredth at 0.2.  Texts whose 64-bit SimHashes link, as ``simhash.links`` finds them, are
candidates, too.  A SimHash at 0.8 differs in ten bits on the average and in up to twenty, too many for its segments, so
it does not find all.  Pairs link where the similarity of the sets is at least ``similarity``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.common import Written, parted_by
from khata.llm.graph import components
from khata.llm.hashing import GOLDEN, mixed
from khata.llm.simhash import hashes_to_bits, links, shingle_hashes

BANDS, ROWS = 20, 5
#: SimHash bits of sets in which texts at 0.8 may differ; the expectation is ten for large sets and twelve for five and four shingles.
FAR = 32
#: SimHash bits in which texts that SimHash finds differ.
CLOSE = 4
#: Turns in which the texts of a key are compared with one of them.
TURNS = 2
#: Pairs whose sets are compared at a time.
PAIRS = 256
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
_WEIGHTS = mixed(np.arange(1001, 1001 + ROWS, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes; none for an empty one."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + 4096]).min(axis=1), out=least)
    sums = (mixed(least).reshape(BANDS, ROWS) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
    return mixed(sums + np.arange(BANDS, dtype=np.uint64) * GOLDEN).view(np.int64)


def _prints(width: int, seed: int):
    """(id, version, node, bits, keys): ``node`` names the normal form of a text."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bits, keys = [], [], []
            for text in batch.column("text"):
                body = text.as_py() or ""
                hashes = np.unique(shingle_hashes(body, width, seed))
                nodes.append(xxh3_128_digest(b" ".join(body.encode().lower().split())))
                bits.append(hashes_to_bits(hashes))
                keys.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("version"), pa.array(nodes, pa.binary()), pa.array(bits, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "version", "node", "bits", "keys"]
            )

    return run


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets, given as sorted distinct hashes; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def similar(a: Column, b: Column, similarity: float, width: int, seed: int) -> Column:
    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out: list[bool] = []
            for at in range(0, len(left), PAIRS):
                sets: dict[str, np.ndarray] = {}
                for x, y in zip(left.slice(at, PAIRS).to_pylist(), right.slice(at, PAIRS).to_pylist(), strict=True):
                    for t in (x, y):
                        if t not in sets:
                            sets[t] = np.unique(shingle_hashes(t, width, seed))
                    out.append(similarity_of(sets[x], sets[y]) >= similarity - 1e-12)
            yield pa.array(out, pa.bool_())

    return of(a, b)


def simhash_keys(kinds: DataFrame, place: Written, distance: int = CLOSE) -> DataFrame:
    """(node, bits, key): texts with equal SimHashes, or linked ones, have a key in common."""
    grouped = components(links(kinds.select("bits").distinct(), distance), place, "close")
    return kinds.join(grouped.withColumnRenamed("node", "_bits"), F.col("bits") == F.col("_bits"), "left").select("node", "bits", F.xxhash64(F.lit("simhash"), F.coalesce("component", "bits")).alias("key"))


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float, width: int, seed: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    ta, tb = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    met = pairs.join(ta, "a").join(tb, "b")
    return met.where(similar(F.col("ta"), F.col("tb"), similarity, width, seed)).select("a", "b")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: ``key``, ``component_id`` (the smallest key of its group).

    Groups are connected by links, the links of others included.  Null and empty texts and texts without words are one group, texts
    of fewer than ``width`` words are one shingle; repeated rows stay and share a group; a null key takes part and is never
    the smallest one unless it is alone; other columns are not read; an empty table gives an empty one.

    Groups are wanted, not all links: the texts of a key are compared with one of them in each of ``TURNS`` turns, and after that
    all which are not in one group yet.
    """
    place = Written(docs.sparkSession)
    body = F.col(f"`{text}`")
    source = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(body).alias("version"), body.alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, version bigint, node binary, bits bigint, keys array<bigint>"
    prints = place.table(source.mapInArrow(_prints(width, seed), schema), "prints")
    # Texts of one normal form have the same bits and keys.
    kinds = place.table(prints.groupBy("node").agg(F.min("id").alias("first"), F.first("bits").alias("bits"), F.first("keys").alias("keys")), "kinds")
    by_minima = kinds.select("node", "bits", F.explode("keys").alias("key"), F.lit(FAR).alias("reach"))
    by_simhash = simhash_keys(kinds, place).withColumn("reach", F.lit(CLOSE))
    met = place.table(by_minima.unionByName(by_simhash), "met")
    several = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = place.table(met.join(several, "key", "left_semi"), "shared")
    place.drop("met")
    # One text for each node which meets another.
    carrier = prints.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "version")).alias("at"))
    carrier = carrier.select("node", F.col("at.id").alias("_id"), F.col("at.version").alias("_version"))
    carrier = place.table(carrier, "carrier")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    carried, _ = parted_by(source, F.xxhash64("id", "version"), carrier, F.xxhash64("_id", "_version"))
    texts = place.table(carried.join(carrier, same).groupBy("node").agg(F.coalesce(F.first("text"), F.lit("")).alias("text")), "texts")
    grouped = place.table(shared.select("node", F.col("node").alias("component")).limit(0), "grouped")
    near = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= F.col("reach")
    for turn in range(TURNS + 1):
        of_node = place.table(shared.join(grouped, "node", "left").select("key", "node", "bits", "reach", F.coalesce("component", "node").alias("group")), f"of_node-{turn}")
        # A key whose texts are all in one group has nothing more to say.
        open_ = of_node.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x != y").select("key")
        left = place.table(of_node.join(open_, "key", "left_semi"), f"left-{turn}")
        one, two = (left.select("key", *more, *[F.col(c).alias(f"{n}{x}") for c, n in (("node", ""), ("bits", "s"), ("group", "g"))]) for x, more in (("a", []), ("b", ["reach"])))
        if turn < TURNS:
            lead = F.min_by(F.struct("a", "sa", "ga"), F.xxhash64(F.lit(turn), "a"))
            one = one.groupBy("key").agg(lead.alias("lead")).select("key", "lead.*")
        pairs = one.join(two, "key").where((F.col("ga") != F.col("gb")) & near)
        if turn < TURNS:
            # Of the texts which lead a node's keys one is enough for a turn, so a node's text moves once.
            pairs = pairs.groupBy("b").agg(F.min_by("a", F.xxhash64(F.lit(turn), "a")).alias("a"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = place.table(pairs, f"pairs-{turn}")
        found = place.table(_linked(pairs, texts, similarity, width, seed), f"found-{turn}")
        known = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
        grouped = place.table(components(known.unionByName(found), place, f"links-{turn}"), f"grouped-{turn}")
        for name in ("of_node", "left", "pairs", "found"):
            place.drop(f"{name}-{turn}")
    firsts = kinds.select("node", "first").join(grouped, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    of_kind = firsts.join(smallest, "component").select("node", "component_id")
    out = place.table(prints.select("id", "node").join(of_kind, "node").select(F.col("id").alias(key), "component_id"), "out")
    for name in ("prints", "kinds", "shared", "carrier", "texts", "grouped", *[f"grouped-{t}" for t in range(TURNS + 1)]):
        place.drop(name)
    return out


def first_of_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every group the one with the smallest key stays.

    Of repeated rows with that key one stays, whichever; a row with a null key stays only if its whole group has none.
    """
    groups = similar_groups(docs, key, text, **how)
    place = Written(docs.sparkSession)
    each = groups.select(F.col(f"`{key}`").alias("id"), "component_id").groupBy("id").agg(F.count("*").alias("n"), F.min("component_id").alias("first"))
    # Documents which are alone with their key and first of their group stay as they are; only the others are looked at again.
    other = place.table(each.where((F.col("n") > 1) | ~F.col("id").eqNullSafe(F.col("first"))), "other")
    body = F.col(f"`{key}`")
    near, far = parted_by(docs, F.xxhash64(body), other, F.xxhash64("id"))
    gone = other.where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("_gone_id"))
    again = other.where("n > 1").select(F.col("id").alias("_again_id"))
    left = near.join(gone, body.eqNullSafe(gone["_gone_id"]), "left_anti")
    single = left.join(again, body.eqNullSafe(again["_again_id"]), "left_anti")
    repeated = left.join(again, body.eqNullSafe(again["_again_id"]), "left_semi").dropDuplicates([key])
    return far.unionByName(single).unionByName(repeated)
