"""Removal of benchmark passages: a suffix automaton of the items reads every text once and knows the longest match at each word.

The words of all items make one generalised suffix automaton.  A text's words are streamed through it; a state and a length say at every
word how long the longest passage is which ends there and occurs in an item.  Where it has ``span`` words or more, all of it is leaked.
An item with fewer words leaks as a whole: its own state lies on the chain of suffix links above the current one.

The automaton sees words, so its size follows the items, not the texts.  Items are dealt in blocks of ``LIMIT`` words with ``span - 1``
words of overlap between the pieces of a long item, one automaton at a time goes to the executors, and a text's spans from several
blocks are merged.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from khata.llm.common import Written, dealt

#: Words of an item's window; words of a block of items, about, and of a piece of an item.
SPAN, LIMIT, PIECE = 10, 1 << 17, 1 << 13
#: What parts words: ASCII but letters and digits.  Everything else is part of a word.
_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
MATCHES = "n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8; none for a null."""
    return (text or "").encode().translate(_KEEP).split()


class Automaton:
    """Generalised suffix automaton over words, and what a text has in common with its items."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], span: int = SPAN) -> None:
        self.span, self.words, self.link, self.size = span, {}, [-1], [0]
        self._next: list[dict[int, int]] = [{}]
        read = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, ids in read:
            last = 0
            for w in ids:
                last = self._extended(last, w)
        # The states of windows are only known once all splits are done.
        self.whole: dict[int, int] = {self._reached(ids)[-1]: len(ids) for _, ids in read if len(ids) < span}
        # For each state the one which holds its window, and the nearest whole item at or above it.
        self.window, self.above = [-1] * len(self.link), [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.size.__getitem__):
            up = self.link[s]
            if self.size[s] >= span:
                self.window[s] = s if self.size[up] < span else self.window[up]
            self.above[s] = s if s in self.whole else self.above[up]
        held: dict[int, set[str]] = {}  # state of a window -> items
        for name, ids in read:
            path = self._reached(ids)
            for s in [path[-1]] if len(ids) < span else (self.window[s] for s in path[span - 1 :]):
                held.setdefault(s, set()).add(name)
        self.held = {s: sorted(names) for s, names in held.items()}
        # One table of transitions, which is smaller than a dictionary for each state.
        self.width = len(self.words)
        self.step = {s * self.width + w: t for s, edges in enumerate(self._next) for w, t in edges.items()}
        del self._next

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self._next.append(edges)
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of state ``q`` which is reached from ``p`` in one step, as a state of its own."""
        if self.size[q] == self.size[p] + 1:
            return q
        part = self._state(self.size[p] + 1, self.link[q], dict(self._next[q]))
        self.link[q] = part
        while p >= 0 and self._next[p].get(w) == q:
            self._next[p][w] = part
            p = self.link[p]
        return part

    def _extended(self, last: int, w: int) -> int:
        if w in self._next[last]:
            return self._split(last, w, self._next[last][w])
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and w not in self._next[p]:
            self._next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self._next[p][w])
        return new

    def _reached(self, ids: list[int]) -> list[int]:
        """The states behind each word of an item."""
        path = [0]
        for w in ids:
            path.append(self._next[path[-1]][w])
        return path[1:]

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(maximal spans of leaked words as (start, end), items whose windows occur)."""
        step, link, size, width, span = self.step, self.link, self.size, self.width, self.span
        window, above, whole = self.window, self.above, self.whole
        state = length = 0
        ends, seen = [], set()
        for at, w in enumerate(map(self.words.get, words), 1):
            if w is None:
                state = length = 0
                continue
            to = step.get(state * width + w)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step.get(state * width + w)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= span:
                ends.append((at - length, at))
                seen.add(window[state])
            short = above[state]
            while short >= 0:
                # The state itself holds its longest passage only if the match is that long.
                if whole[short] <= length:
                    ends.append((at - whole[short], at))
                    seen.add(short)
                short = above[link[short]]
        spans: list[tuple[int, int]] = []
        for start, end in ends:  # ends grow
            while spans and spans[-1][0] >= start:
                spans.pop()
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
        return spans, {name for s in seen for name in self.held[s]}


def _pieces(name: str, words: list[bytes], span: int, piece: int) -> Iterator[tuple[str, list[bytes]]]:
    """A long item in pieces which overlap, so that no window is lost."""
    if len(words) <= piece:
        yield name, words
    else:
        yield from ((name, words[at : at + piece]) for at in range(0, len(words) - span + 1, piece - span + 1))


def _reader(spark: SparkSession, items: list[tuple[str, list[bytes]]], span: int) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(pickle.dumps(Automaton(items, span), protocol=5))

    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = pickle.loads(shared.value)
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text)
                spans, names = automaton.matches(words)
                rows.append((len(words), [{"start": a, "end": b} for a, b in spans], sorted(names)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    # Not to be searched again by a filter on its result.
    return F.pandas_udf(read, MATCHES).asNondeterministic()


def _merged(spans: Column) -> Column:
    """Maximal spans of a list of spans."""
    kind = "array<struct<start: bigint, end: bigint>>"
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= x["start"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(x))),
    )


def found_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = SPAN, limit: int = LIMIT, piece: int = PIECE) -> DataFrame:
    """Per row of ``docs``: ``key``, ``text``, ``n_words``, ``spans`` (maximal runs of leaked words, end exclusive), ``items`` (sorted, as strings).

    A word is leaked in any occurrence of ``span`` consecutive words of an item, or of all words of an item which has fewer.
    Null and empty texts have no words and nothing leaked, null and empty items no windows; items with a null key are not read, rows with
    equal keys are one item; repeated rows and null keys of ``docs`` stay; empty tables give no rows and no leaks; other columns
    are not read, whatever their names.
    """
    spark, place = docs.sparkSession, Written(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    asked = items.select(F.col(f"`{item_key}`").cast("string").alias("name"), F.col(f"`{item_text}`").alias("words")).where("name is not null and words is not null")
    blocks, count = dealt(asked.distinct(), F.length("words") / 4, limit)
    if count > 1:
        blocks = place.table(blocks, "items")

    def read(block: int) -> Callable[[Column], Column]:
        # A block of the items, whose size is bounded.
        held = blocks.where(F.col("_block") == block).select("name", "words").toLocalIterator()
        return _reader(spark, [part for name, words in held for part in _pieces(name, words_of(words), span, piece)], span)

    names = [F.col("_key").alias(key), F.col("_text").alias(text), "n_words", "spans", "items"]
    if count == 1:
        return rows.withColumn("_found", read(0)("_text")).select("_key", "_text", "_found.*").select(*names)
    # What a text has in common with a block depends on its words alone; equal texts of a key share a row until the end.
    rows = rows.groupBy("_key", "_text").agg(F.count("*").alias("_copies"))
    for block in range(count):
        found = rows.withColumn("_found", read(block)("_text"))
        before = ["spans", "items"] if block else []
        both = [F.col("_found.spans"), F.col("_found.items")] if not block else [F.concat("spans", "_found.spans").alias("spans"), F.array_union("items", "_found.items").alias("items")]
        rows = place.table(found.select("_key", "_text", "_copies", F.col("_found.n_words").alias("n_words"), *both), f"block-{block}")
        if before:
            place.drop(f"block-{block - 1}")
    whole = rows.select("_key", "_text", "_copies", "n_words", _merged(F.col("spans")).alias("spans"), F.array_sort("items").alias("items"))
    return whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*names)


def n_leaked(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


@F.pandas_udf(StringType())
def cut_words(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words in the spans and what stands between them."""

    def cut(value: str | None, runs: list) -> str | None:
        if value is None or not len(runs):
            return value
        data = value.encode()
        at = [m.span() for m in _WORD.finditer(data)]
        out, end = [], 0
        for run in runs:
            out.append(data[end : at[run["start"]][0]])
            end = at[run["end"] - 1][1]
        return b"".join([*out, data[end:]]).decode()

    return pd.Series([cut(a, b) for a, b in zip(text, spans)], dtype=object)


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", length: int = SPAN, coverage: float = 0.5, **how: object) -> DataFrame:
    """``key`` and ``text`` of the documents: leaked spans of ``length`` words or more are cut out, and a text goes as a whole where more than ``coverage`` of its words are leaked.

    Shorter spans come from items with few words; they count for the coverage and stay.  Edge cases are those of ``found_leaks``.
    """
    found = found_leaks(docs, items, key, text, **how)
    long = F.filter("spans", lambda s: s["end"] - s["start"] >= length)
    kept = found.where(n_leaked(F.col("spans")) <= F.lit(coverage) * F.col("n_words"))
    return kept.select(F.col(f"`{key}`"), F.when(F.size(long) > 0, cut_words(F.col(f"`{text}`"), long)).otherwise(F.col(f"`{text}`")).alias(text))
