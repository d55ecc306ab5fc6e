"""Ranked search for words: a grid of terms and documents as a K2-treap, read best-first over ranges of documents.

One pass over the documents counts the terms of the items in every text and the lengths of all; from its written result come the document
frequencies.  Documents are then dealt in shards.  A shard is a grid with a row for each term and a column for each document, whose cells hold
the term's part of the document's score.  The grid is a quadtree of non-empty cells only: a bitmap of four children for each
node, children found by rank, and the largest value below each node.

For an item every row is a path down the tree.  All paths descend jointly: a range of documents is worth at most the sum of the maxima of its
paths' nodes, the best ranges are halved first, and what can't reach the k-th best score so far is left.  A range of one document has its
exact score.  Rows are ordered by weight and columns by length, so that neighbours have similar values.  The k best of a task carry over
from shard to shard, and only they leave it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from khata.llm.common import Written, dealt
from khata.llm.leaks import words_of

#: Documents of a shard; words of a block of items, about; ranges which are halved at once, at first and at most.
SHARD, LIMIT, FEW, MANY = 1 << 14, 1 << 17, 64, 1 << 12
#: The number of children before the q-th one, by bitmap and q.
_RANK = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int32)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x with a zero between neighbours."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Quadtree of the non-empty cells (row, column, value > 0) of a grid, with the largest value below each node."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        self.height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        code, most = code[order], values[order].astype(np.int64)
        levels = [(most, np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64))]
        for _ in range(self.height):
            child = (np.uint8(1) << (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            code = code >> np.uint64(2)
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(most, start) if len(start) else most
            levels.append((most, np.bitwise_or.reduceat(child, start) if len(start) else child, start))
            code = code[start]
        levels.reverse()
        ends = np.cumsum([len(level[0]) for level in levels])
        nothing = np.zeros(1, np.int64)
        # The last node is the one of all empty cells.
        self.most = np.concatenate([*[level[0] for level in levels], nothing])
        self.mask = np.concatenate([*[level[1] for level in levels], nothing.astype(np.uint8)])
        self.first = np.concatenate([*[level[2] + end for level, end in zip(levels, ends)], nothing]).astype(np.int32)
        self.none = len(self.most) - 1

    def best(self, rows: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, sums over ``rows``) of all columns with a sum of at least ``floor`` and of at least the k-th best sum.

        Columns with a sum of zero are never among them.
        """
        height, most, mask, first = self.height, self.most, self.mask, self.first
        nodes = np.zeros((1, len(rows)), np.int32)
        level, column = np.zeros(1, np.int32), np.zeros(1, np.int32)
        bound = most[nodes].sum(1)
        found_at, found, step = np.zeros(0, np.int32), np.zeros(0, np.int64), FEW
        floor = max(floor, 1)
        while len(bound):
            if len(bound) > step:
                split = np.argpartition(-bound, step)
                now, later = split[:step], split[step:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            step = min(2 * step, MANY)
            down, at = nodes[now], level[now] + 1
            bitmap, base = mask[down], first[down]
            side = (rows[None, :] >> (height - at)[:, None] & 1) * 2
            new = []
            for half in (0, 1):
                q = side + half
                child = np.where((bitmap >> q) & 1, base + _RANK[bitmap, q], self.none)
                new.append((child, at, column[now] * 2 + half, most[child].sum(1)))
            child, at, of, sums = (np.concatenate(parts) for parts in zip(*new))
            leaf = (at == height) & (sums >= floor)
            if leaf.any():
                found_at, found = np.concatenate([found_at, of[leaf]]), np.concatenate([found, sums[leaf]])
                if len(found) >= k:
                    floor = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))
                    keep = found >= floor
                    found_at, found = found_at[keep], found[keep]
            live, old = np.flatnonzero((at < height) & (sums >= floor)), later[bound[later] >= floor]
            nodes, level = np.concatenate([nodes[old], child[live]]), np.concatenate([level[old], at[live]])
            column, bound = np.concatenate([column[old], of[live]]), np.concatenate([bound[old], sums[live]])
        return found_at, found


class Search:
    """The k best documents for each item, over the shards of a task."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, k: int, shard: int) -> None:
        self.items, self.weights, self.k, self.shard = items, weights, k, shard
        self.top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, object), np.zeros(0, np.int64)) for _ in items]
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, ids: np.ndarray, norms: np.ndarray, counts: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        self.waiting.append((ids, norms, counts, terms, times))
        self.size += len(ids)
        if self.size >= self.shard:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        ids, norms, counts, terms, times = (np.concatenate(parts) for parts in zip(*self.waiting))
        self.waiting, self.size = [], 0
        column = np.empty(len(ids), np.int64)
        column[order := np.argsort(norms, kind="stable")] = np.arange(len(ids))
        ids, norm = ids[order], np.repeat(norms, counts)
        impact = self.weights[terms] * (1_000_000_000 * times // (1000 * times + 20 * norm))
        live = impact > 0
        grid = Treap(terms[live], np.repeat(column, counts)[live], impact[live])
        for i, rows in enumerate(self.items):
            have, scores = self.top[i]
            if len(rows):
                at, sums = grid.best(rows, self.k, int(scores[-1]) if len(scores) == self.k else 1)
                if len(at):
                    both, all_scores = np.concatenate([have, ids[at]]), np.concatenate([scores, sums])
                    first = np.lexsort((both, -all_scores))[: self.k]
                    self.top[i] = both[first], all_scores[first]


def _count_terms(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            n, terms, times, ends = [], [], [], [0]
            for text in batch.column(1):
                words = words_of(text.as_py())
                here = Counter(map(number.get, words))
                here.pop(None, None)
                n.append(len(words))
                terms.extend(here.keys())
                times.extend(here.values())
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((terms, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc", "n", "terms", "times"])

    return count


def _search(shared: object, k: int, shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, row_of = shared.value
        state, kind = Search(items, weights, k, shard), None
        for batch in batches:
            kind = batch.column(0).type
            ids, norms = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            terms, times = batch.column(2), batch.column(3)
            counts = np.diff(terms.offsets.to_numpy())
            state.add(ids.astype(object), norms, counts, row_of[terms.flatten().to_numpy()], times.flatten().to_numpy())
        state.flush()
        for i, (ids, scores) in enumerate(state.top):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int32()), pa.array(list(ids), kind), pa.array(scores, pa.int64())], names=["item", "doc", "score"])

    return search


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", shard: int = SHARD, limit: int = LIMIT) -> DataFrame:
    """(``item_key``, rank, ``key``, score): the ``k`` documents with the highest scores above zero for each item, ties to the smaller key.

    Null and empty texts have no terms and no score.  Documents with a null key count for the statistics and are not ranked; repeated
    rows are documents each.  Items with a null key are not read, rows with equal keys are one item, a term counts once.  Without
    documents or items the result is empty.  Other columns are not read, whatever their names.
    """
    spark, place = docs.sparkSession, Written(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item_key}`").alias("name"), F.col(f"`{item_text}`").alias("words")).where("name is not null and words is not null")
    asked = asked.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("words")), " ").alias("words"))
    blocks, count = dealt(asked, F.length("words") / 4, limit)
    if count > 1:
        blocks = place.table(blocks, "items")
    found = [_of_block(spark, place, rows, blocks.where(F.col("_block") == b).select("name", "words"), k, shard, b) for b in range(count)]
    order = Window.partitionBy("name").orderBy(F.desc("score"), "doc")
    best = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("name").alias(item_key), "rank", F.col("doc").alias(key), "score")


def _of_block(spark: SparkSession, place: Written, rows: DataFrame, block: DataFrame, k: int, shard: int, number: int) -> DataFrame:
    """(name, doc, score) of the k best documents of every task, for a block of items, whose size is bounded."""
    held = [(name, set(words_of(words))) for name, words in block.toLocalIterator()]
    terms = sorted(set().union(*[words for _, words in held]))
    kinds = f"doc {rows.schema['doc'].dataType.simpleString()}, n bigint, terms array<int>, times array<bigint>"
    counted = place.table(rows.mapInArrow(_count_terms(spark.sparkContext.broadcast(terms)), kinds), f"counted-{number}")
    total, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held_in = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).toLocalIterator())  # at most the terms of the block
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * held_in.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
    # Rows of the grid by weight; a term which no document holds has no row.
    order = sorted(held_in, key=lambda t: (weight[t], t))
    row_of = np.full(len(terms), -1, np.int64)
    row_of[order] = np.arange(len(order))
    index = {w: row_of[t] for t, w in enumerate(terms)}
    asked = [np.array(sorted(index[w] for w in words if index[w] >= 0), np.int64) for _, words in held]
    shared = spark.sparkContext.broadcast((asked, weight[order], row_of))
    norm = F.lit(50) + F.expr(f"cast((cast(50 as decimal(38,0)) * n * {total}) div {max(length, 1)} as bigint)")
    stored = counted.where("doc is not null and size(terms) > 0").select("doc", norm.cast("bigint").alias("norm"), "terms", "times")

    best = stored.mapInArrow(_search(shared, k, shard), f"item int, doc {rows.schema['doc'].dataType.simpleString()}, score bigint")
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(held)], f"item int, name {block.schema['name'].dataType.simpleString()}")
    return best.join(names, "item").select("name", "doc", "score")
