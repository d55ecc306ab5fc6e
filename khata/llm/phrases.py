"""Collocations from a weighted de Bruijn graph of words.

Edges are the longest grams, of four words, between their first and last three words as nodes.  At the end of a piece the last words
start grams which are cut short; these are the corrections for ends.  So every word starts one gram, and the count of a
shorter phrase is the flow out of it: the sum over all grams which begin with it.

Grams are combined in each task, dealt by ranges of their text and sorted, whatever their first words are, so a frequent pair or passage
spreads over as many ranges as it needs; a sample says where ranges end, on which no result depends.  In that order the grams which begin with a phrase are neighbours, and flows of all lengths are
sums of runs, a batch at a time.  A run inside of a batch is complete, and goes if it is too small; runs at the edges of a batch
are summed up afterwards.

The graph of frequent edges is then compacted: where a node has one way in and one way out, of its own weight, both edges are
joined; paths are found by doubling pointers.  Nodes inside of a path are contained in a longer phrase of equal count.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from khata.llm.common import Written

#: Words of a gram; the smallest count of a candidate; a phrase goes if a longer one has this share of its count in percent; rows of a language.
WORDS, LEAST, SHARE, TOP = 4, 30, 80, 2000
#: Different grams which a task holds before it hands them on; documents whose grams say how to deal the work evenly.
HELD, SAMPLE = 250_000, 2000
#: What ends a piece becomes a full stop.
_STOPS = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
UNKNOWN = "und"


def grams(text: str | None, words: int) -> list[bytes]:
    """The gram which starts at each word of a text, in lower case as far as ASCII goes; behind the end of a piece it has full stops."""
    data = (text or "").encode().lower().translate(_STOPS).replace(b".", b" ." * (words - 1) + b" ")
    tokens = data.split() + [b"."] * (words - 1)
    return [b" ".join(gram) for gram in zip(*[tokens[j:] for j in range(words)]) if gram[0] != b"."]


def _text(lang: bytes, gram: bytes) -> bytes:
    """A gram cut at the end of its piece, behind its language, with a space behind each word."""
    return b"%b\t%b " % (lang, gram.rstrip(b" .") if gram[-1] == 46 else gram)


def _edges(docs: DataFrame, n: int, words: int, parts: int, sample: int) -> list[bytes]:
    """At most ``parts - 1`` grams which part the grams of some of ``n`` documents evenly; only the balance of the work depends on them."""
    some = docs.sample(min(1.0, sample / max(n, 1)), 7)
    drawn = some.mapInArrow(_counted(words, HELD, []), "part int, gram string, n bigint").select("gram")
    # a sixteenth of the grams, by their hash; what the driver sees is bounded by the sample and by the number of parts
    drawn = drawn.where(F.pmod(F.xxhash64("gram"), F.lit(16)) == 0).orderBy(F.xxhash64("gram")).limit(200 * parts)
    rows = sorted(r["gram"].encode() for r in drawn.collect())
    return sorted({rows[i * len(rows) // parts] for i in range(1, parts)}) if rows else []


def _counted(words: int, held: int, edges: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[bytes, Counter[bytes]] = {}
        size = 0

        def handed() -> pa.RecordBatch:
            keys = [_text(lang, gram) for lang, found in have.items() for gram in found]
            times = [n for found in have.values() for n in found.values()]
            have.clear()
            parts = pa.array([bisect_right(edges, key) for key in keys], pa.int32())
            return pa.RecordBatch.from_arrays([parts, pa.array(keys, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["part", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                found = have.setdefault(lang.as_py().encode(), Counter())
                before = len(found)
                found.update(grams(text.as_py(), words))
                size += len(found) - before
                if size > held:
                    yield handed()
                    size = 0
        if size:
            yield handed()

    return count


def _flows(words: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column(0), batch.column(1).to_numpy()
            split = pc.split_pattern(keys, " ")
            at, lengths, word = split.offsets.to_numpy()[:-1], pc.list_value_length(split).to_numpy() - 1, split.flatten()
            at = at - split.offsets[0].as_py()
            langs: Counter[str] = Counter()
            rows, sizes, sums = [], [], []
            new = np.zeros(len(keys), bool)
            new[0] = True
            for k in range(1, words + 1):
                ours = word.take(pa.array(np.where(lengths >= k, at + k - 1, 0), mask=lengths < k))
                new[1:] |= pc.fill_null(pc.not_equal(ours[1:], ours[:-1]), True).to_numpy(zero_copy_only=False)
                start = np.flatnonzero(new)
                total = np.add.reduceat(n, start)
                if k == 1:
                    for i, s in zip(start, total):
                        langs[keys[i].as_py().rpartition("\t")[0]] += int(s)
                keep = total >= least
                keep[[0, -1]] = True
                keep &= lengths[start] >= k
                rows.extend(start[keep].tolist())
                sizes.extend([k] * int(keep.sum()))
                sums.extend(total[keep].tolist())
            found = [keys[i].as_py().rpartition("\t") for i in rows]
            out = [(lang, k, " ".join(text.split(" ")[:k]), s) for (lang, _, text), k, s in zip(found, sizes, sums)]
            out += [(lang, 0, "", s) for lang, s in langs.items()]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "size", "phrase", "n"])

    return flow


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = WORDS, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(lang, size, phrase, n): all phrases of up to ``words`` words which occur ``least`` times or more in a language; size 0 is the number of its words."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text")).where("text is not null")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = _edges(rows, docs.count(), words, parts, SAMPLE)
    counted = rows.mapInArrow(_counted(words, held, edges), "part int, gram string, n bigint")
    # A part has all grams between two edges, so all that begin with a phrase are in neighbouring parts or in one.
    ordered = counted.repartitionById(parts, "part").select("gram", "n").sortWithinPartitions("gram")
    flows = ordered.mapInArrow(_flows(words, least), "lang string, size int, phrase string, n bigint")
    return flows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def _part(phrase: Column, first: int, last: int | None = None) -> Column:
    """Words ``first`` to ``last`` of a phrase, from 1."""
    split = F.split(phrase, " ")
    return F.array_join(F.slice(split, first, F.size(split) - first + 1 if last is None else F.lit(last - first + 1)), " ")


def paths(counts: DataFrame, place: Written, words: int = WORDS) -> DataFrame:
    """(lang, phrase, n): the maximal unary paths of the graph whose edges are the phrases of ``words`` words in ``counts``.

    An edge goes on in the next one if the node between has no other way in or out and no piece ends or begins there, that is if all
    three have one count.  No path is a circle, since pieces end.
    """
    edges = counts.where(F.col("size") == words).select("lang", F.col("phrase").alias("edge"), "n")
    nodes = counts.where(F.col("size") == words - 1).select("lang", F.col("phrase").alias("node"), "n")
    into = edges.select("lang", _part(F.col("edge"), 2).alias("node"), "n", F.col("edge").alias("before"))
    out = edges.select("lang", _part(F.col("edge"), 1, words - 1).alias("node"), "n", "edge")
    at = place.table(nodes.join(into, ["lang", "node", "n"]).join(out, ["lang", "node", "n"]).select("lang", "edge", F.col("before").alias("head"), F.lit(1).alias("far")), "far-0")
    turn = 0
    while True:
        # A pointer to an edge which has one itself takes that one's.
        step = at.select("lang", F.col("edge").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        turn += 1
        after = place.table(
            at.join(step, ["lang", "head"], "left").select(
                "lang", "edge", F.coalesce("next", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")
            ),
            f"far-{turn}",
        )
        place.drop(f"far-{turn - 1}")
        moved, at = after.where("moved").limit(1).count(), after.drop("moved")
        if not moved:
            break
    tails = at.groupBy("lang", "head").agg(F.array_sort(F.collect_list(F.struct("far", _part(F.col("edge"), words).alias("word")))).alias("tail"))
    inner = at.select("lang", "edge")
    heads = edges.join(inner, ["lang", "edge"], "left_anti").select("lang", F.col("edge").alias("head"), "n")
    more = F.array_join(F.transform("tail", lambda t: t["word"]), " ")
    return heads.join(tails, ["lang", "head"], "left").select("lang", F.concat_ws(" ", "head", more).alias("phrase"), "n")


def _windows(phrase: Column, size: int) -> Column:
    """The different phrases of ``size`` words in a longer one."""
    split = F.split(phrase, " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(split) - size + 1), lambda i: F.array_join(F.slice(split, i, size), " ")))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP, held: int = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, count and text.

    A candidate has two to ``words`` words and occurs ``least`` times.  Of all cuts in two parts the one with the lowest score counts, the earliest
    among equal ones; a score is 2,000,000 a / (l + r), rounded down.  Candidates inside of a longer one with ``share`` percent of their
    count go.  A null language is ``und``; null and empty texts have no words; repeated rows count as often as they are there; an empty
    table gives an empty one.  Only the two columns are read, whatever others are named.
    """
    place = Written(docs.sparkSession)
    counts = place.table(phrase_counts(docs, lang, text, words, least, held), "counts")
    found = counts.where(F.col("size") >= 2)
    wide = lambda x: F.col(x).cast("decimal(38,0)")
    # A longer phrase has no higher count than what lies between, so one more word is enough to look at.  Whatever lies on a path, its nodes
    # and their parts, has the path's count; other phrases speak for their own two parts.
    on_paths = place.table(paths(counts, place, words), "paths")
    inside = [on_paths.select("lang", F.explode(_windows(F.col("phrase"), k)).alias("phrase"), F.col("n").alias("outer")) for k in range(2, words)]
    own = found.where((F.col("size") > 2) & (F.col("size") < words)).select(
        "lang", F.explode(F.array(_part(F.col("phrase"), 2), F.expr("substring_index(phrase, ' ', size - 1)"))).alias("phrase"), F.col("n").alias("outer")
    )
    outer = own
    for part in inside:
        outer = outer.unionByName(part)
    outer = outer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    left = found.join(outer, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * wide("outer") < share * wide("n"))).select("lang", "size", "phrase", F.col("n").alias("a"))
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumn("head", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("rest", F.expr("substring_index(phrase, ' ', cut - size)"))
    flow = counts.where((F.col("size") > 0) & (F.col("size") < words))
    cuts = cuts.join(flow.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(flow.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("cast((cast(2000000 as decimal(38,0)) * a) div (cast(l as decimal(38,0)) + r) as bigint)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where(F.col("size") == 0).select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
