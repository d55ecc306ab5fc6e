"""Exact inner-product search in buckets of equal length.

Vectors are grouped by their length into buckets, longest first, and large buckets into parts.  A query's k-th best score in the first
part is a lower bound.  With the bucket's largest length it becomes a threshold for the cosine in that bucket: above one, the
bucket is out; where it is high, a coordinate of a vector must lie near the query's, and the query's largest coordinates choose the
candidates; else candidates are the vectors which are long enough.  Products of candidates are then computed exactly.

Queries are dealt in blocks and vectors in parts, and a task sees one block and one part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from khata.llm.common import Written

#: Vectors of a part and queries of a block, about; buckets, at most.
PART, BLOCK, BUCKETS = 4096, 4096, 64
#: Coordinates which choose candidates, and the cosine from which they are used.
FOCUS, STEEP = 3, 0.7
FOUND = "query_id {id}, query_hash bigint, vec_id {id}, score bigint"


def scaled(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, as doubles; null for a vector with a null or non-finite one."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    steps = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return F.when(F.coalesce(ok, F.lit(False)), steps)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: by doubles where every sum stays below 2 ** 53, by Python's integers elsewhere."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(q.shape[1], 1)
    if most < 2.0**53:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in v], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def focus_candidates(q: np.ndarray, unit: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of unit vectors which may have at least this cosine with ``q``, by its largest coordinates.

    With the coordinate fixed at c, the cosine is at most q c + sqrt(1 - q^2) sqrt(1 - c^2).
    """
    q = q / np.sqrt(q @ q)
    keep = np.ones(len(unit), bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        wide = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - q[f] * q[f]))) + 1e-9
        keep &= (unit[:, f] >= q[f] * cosine - wide) & ((unit[:, f] <= q[f] * cosine + wide) | (q[f] * cosine + wide >= 1))
    return np.flatnonzero(keep)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(object) if scores.dtype == object else -scores[at]))][:k]


def _matrix(rows: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(rows), size))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def searcher(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The work of one task: a block of queries against a part of the vectors."""

    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "query_hash": [], "vec_id": [], "score": []})
        if queries.empty or vectors.empty:
            return none
        vectors = vectors.sort_values(["norm2", "vec_id"], ascending=[False, True])
        size = max(queries["v"].map(len).max(), vectors["v"].map(len).max())
        q, v, ids = _matrix(queries["v"], size), _matrix(vectors["v"], size), vectors["vec_id"].to_numpy()
        norms = np.sqrt(np.einsum("ij,ij->i", v, v))
        unit = v / np.maximum(norms, 1e-300)[:, None]
        out = []
        for at in range(0, len(q), 256):
            rows, floors = q[at : at + 256], queries["floor"].to_numpy()[at : at + 256]
            own, hashes = queries["vec_id"].to_numpy()[at : at + 256], queries["hash"].to_numpy()[at : at + 256]
            lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
            with np.errstate(divide="ignore", invalid="ignore"):
                need = floors / lengths
                cosine = need / norms[0]
            steep = (cosine >= STEEP) & np.isfinite(cosine)
            # Length pruning: the vectors are sorted, so a prefix is left for each query.
            ends = np.searchsorted(-norms, -(np.where(np.isfinite(need), need, -np.inf) * (1 - 1e-9)), side="right")
            plain = np.flatnonzero(~steep)
            scores = products(rows[plain], v[: ends[plain].max(initial=0)]) if len(plain) else None
            for n, i in enumerate(plain):
                out.append(_found(own[i], hashes[i], floors[i], scores[n, : ends[i]], ids[: ends[i]], k))
            for i in np.flatnonzero(steep & (cosine <= 1 + 1e-9)):
                near = focus_candidates(rows[i], unit[: ends[i]], min(cosine[i] * (1 - 1e-9), 1.0))
                out.append(_found(own[i], hashes[i], floors[i], products(rows[i : i + 1], v[near])[0], ids[near], k))
        return pd.concat(out) if out else none

    return search


def _found(own: int, mark: int, floor: float, scores: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    live = np.flatnonzero((ids != own) & (scores >= floor))
    at = live[best_of(scores[live], ids[live], k)]
    return pd.DataFrame({"query_id": own, "query_hash": mark, "vec_id": ids[at], "score": scores[at]})


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", part: int = PART, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each query row, ties to the smaller key.

    Vectors which are null or hold a null or non-finite component take no part, and rows with a null key neither; shorter
    vectors count as filled up with zeros.  A query's own row is every row with its key; equal query rows are one query, rows
    with equal key and different vectors are queries each.  Scores outside of 64 bits end at their limits.  An empty table
    gives an empty one; other columns are not read.
    """
    place, spark = Written(vectors.sparkSession), vectors.sparkSession
    steps = vectors.select(F.col(f"`{key}`").alias("vec_id"), scaled(F.col(f"`{vector}`")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    length = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x * x)
    rows = place.table(steps.where("v is not null and vec_id is not null").withColumn("norm2", length).withColumn("hash", F.xxhash64("v")), "vectors")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    kind = vectors.schema[key].dataType.simpleString()
    if not n or not asking:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score bigint")
    count = min(BUCKETS, -(-n // part))
    edges = sorted(set(rows.approxQuantile("norm2", [i / count for i in range(1, count)], 0.002)), reverse=True) if count > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col("norm2") < e)) if edges else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    stats = {r["bucket"]: r for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm2").alias("longest")).collect()}  # at most BUCKETS
    parts = [-(-stats[b]["n"] // part) if b in stats else 0 for b in range(len(edges) + 1)]
    longest = [float(stats[b]["longest"]) if b in stats else 0.0 for b in range(len(edges) + 1)]
    blocks = -(-asking // block)
    dealt = F.pmod(F.xxhash64("vec_id"), F.get(F.array(*[F.lit(max(p, 1)) for p in parts]), F.col("bucket")).cast("bigint"))
    # New names for the same columns: both sides of a task's input come from one table.
    stored = rows.select(*[F.col(c).alias(c) for c in ("vec_id", "v", "norm2", "bucket")], dealt.alias("part"))
    queries = rows.where("asks").select("vec_id", "hash", "v", "norm2").dropDuplicates(["vec_id", "hash"])
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    schema = FOUND.format(id=kind)

    def met(asked: DataFrame, these: DataFrame) -> DataFrame:
        spread = these.withColumn("block", F.explode(F.sequence(F.expr("0L"), F.lit(blocks - 1).cast("bigint"))))
        by = ["bucket", "part", "block"]
        return asked.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(searcher(k), schema)

    first = next(b for b, p in enumerate(parts) if p)
    opening = queries.select("*", F.lit(first).alias("bucket"), F.lit(0).cast("bigint").alias("part"), F.lit(float("-inf")).alias("floor"))
    start = place.table(met(opening, stored.where((F.col("bucket") == first) & (F.col("part") == 0))), "start")
    kth = start.groupBy("query_id", "query_hash").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    floors = queries.join(kth, (F.col("vec_id") == F.col("query_id")) & (F.col("hash") == F.col("query_hash")), "left").select(
        "vec_id", "hash", "v", "norm2", "block", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("floor")
    )
    # A bucket whose longest vector can't reach the floor gets no question.
    each = F.transform(
        F.sequence(F.lit(0), F.lit(len(parts) - 1)),
        lambda b: F.struct(b.alias("bucket"), F.get(F.array(*[F.lit(p) for p in parts]), b).alias("n"), F.get(F.array(*[F.lit(x) for x in longest]), b).alias("longest")),
    )
    reach = lambda b: (F.col("floor") <= 0) | (F.sqrt(F.col("norm2")) * F.sqrt(b["longest"]) * (1 + 1e-9) >= F.col("floor"))
    asked = floors.withColumn("b", F.explode(F.filter(each, lambda b: (b["n"] > 0) & reach(b)))).withColumn(
        "part", F.explode(F.sequence(F.expr("0L"), (F.col("b.n") - 1).cast("bigint")))
    ).select("vec_id", "hash", "v", "norm2", "block", "floor", F.col("b.bucket").alias("bucket"), "part")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    ranked = met(asked, stored).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
