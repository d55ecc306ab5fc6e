"""SentencePiece encoding by streaming Viterbi, and decoding.

The ids of a text are the segmentation into vocabulary pieces with the largest sum of scores; of equal sums, the one
whose last piece is longer wins, at every place.  A character without a piece costs ten more than the worst piece and is
written as its bytes.  Spaces become U+2581 and one is put in front of a text which is not empty; a U+2581 of the text itself goes
by its bytes, so that decoding is exact for every text.

A text is read as a stream.  Scores are kept for a window of the longest piece; backpointers are kept only back to the last place
which all surviving paths share, and ids before it are given out at once.  No piece crosses from another character to a space
mark, or touches a line feed, so all paths converge there: the stretch between is the unit of a bounded memo of
recent stretches, which changes nothing but time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581"
#: Stands for a U+2581 of the text itself; no stretch looks like it.
OWN_MARK = "\x00" + MARK
#: Stretches which a worker remembers, and the longest of them; beyond that the memo starts anew.
MEMO_SIZE, MEMO_CHARS = 1 << 19, 48


INFINITE = float("inf")


class Vocabulary:
    """Pieces with their ids and scores, read from a model file's bytes."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in ids if sp.is_byte(i)}
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown = min(sp.get_score(i) for i in plain) - 10
        self.longest = 1
        #: A trie of the pieces.  A node is (nodes by next character, id or -1, score).
        self.trie: tuple[dict, int, float] = ({}, -1, 0.0)
        within = False
        for i in sorted(plain, key=lambda i: len(sp.id_to_piece(i))):
            piece = sp.id_to_piece(i)
            within |= MARK in piece.lstrip(MARK) or (len(piece) > 1 and "\n" in piece)
            self.longest = max(self.longest, len(piece))
            node = self.trie
            for c in piece[:-1]:
                node = node[0].setdefault(c, ({}, -1, 0.0))
            node[0][piece[-1]] = ({}, i, sp.get_score(i))
        self.written = [b""] * len(ids)
        for i in plain:
            self.written[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            self.written[i] = bytes([value])
        self.stretches = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+") if not within else re.compile(".+", re.S)


class Stream:
    """Viterbi over a text which comes in parts: ``feed`` and ``finish`` give the ids which are certain."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.text, self.at = "", 0  # what is not committed yet; starts before ``at`` have been served
        self.best = [0.0]  # the best sum which ends at each place of the text
        self.start, self.piece = [0], [-1]  # the last piece of that path: where it begins, its id
        self.reach = 0  # the last place which any path has reached
        self.window = 0  # the longest uncommitted stretch so far

    def feed(self, part: str) -> list[int]:
        self.text += part
        return self._serve(len(self.text) - self.v.longest)

    def finish(self, part: str = "") -> list[int]:
        self.text += part
        return self._serve(len(self.text) - 1)

    def _serve(self, last: int) -> list[int]:
        """Extends all paths from the places up to ``last``."""
        out: list[int] = []
        trie, unknown, often = self.v.trie[0], self.v.unknown, 2 * self.v.longest
        while self.at <= last:
            text, best, start, piece, reach, i = self.text, self.best, self.start, self.piece, self.reach, self.at
            size = len(text)
            more = size + 1 - len(best)
            best += [-INFINITE] * more
            start += [0] * more
            piece += [-1] * more
            meet = False
            while i <= last and not meet:
                score = best[i]
                if score > -INFINITE:
                    node, end, single = trie.get(text[i]), i + 1, False
                    while node is not None:
                        nodes, k, gain = node
                        if k >= 0:
                            gain += score
                            if gain > best[end]:
                                best[end], start[end], piece[end] = gain, i, k
                            if end > reach:
                                reach = end
                            if end == i + 1:
                                single = True
                        if end == size:
                            break
                        node = nodes.get(text[end])
                        end += 1
                    if not single:
                        if score + unknown > best[i + 1]:
                            best[i + 1], start[i + 1], piece[i + 1] = score + unknown, i, -1
                        if i + 1 > reach:
                            reach = i + 1
                i += 1
                # The end, or a long stretch: look where the paths meet.
                meet = i == size or i % often == 0
            self.at, self.reach = i, reach
            if meet:
                last -= self._commit(out)
        return out

    def _commit(self, out: list[int]) -> int:
        """Gives out the ids before the last place which all surviving paths share; how many characters that is."""
        self.window = max(self.window, self.at)
        heads = [e for e in range(self.at, self.reach + 1) if self.best[e] > -INFINITE]
        while len(heads) > 1:
            heads = sorted({*heads[:-1], self.start[heads[-1]]})
        place = heads[0]
        steps, p = [], place
        while p > 0:
            k = self.piece[p]
            steps.append([k] if k >= 0 else [self.v.bytes[b] for b in self.text[self.start[p]].encode()])
            p = self.start[p]
        for ids in reversed(steps):
            out += ids
        if place == len(self.text):  # all of it: begin anew
            self.text, self.at, self.reach, self.best, self.start, self.piece = "", 0, 0, [0.0], [0], [-1]
            return place
        self.text, self.at, self.reach = self.text[place:], self.at - place, self.reach - place
        base = self.best[place]
        self.best = [b - base for b in self.best[place:]]
        self.start, self.piece = [p - place for p in self.start[place:]], self.piece[place:]
        return place


class Encoder:
    """Encodes and decodes whole texts; one for each worker."""

    def __init__(self, model: bytes) -> None:
        self.v = Vocabulary(model)
        self.memo: dict[str, bytes] = {}

    def encode(self, text: str, part: int = 1 << 12) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        memo, found = self.memo, []
        for stretch in self._stretches(text):
            ids = memo.get(stretch)
            if ids is None:
                ids = self._viterbi(stretch, part)
            found.append(ids)
        return np.frombuffer(b"".join(found), np.int32)

    def _stretches(self, text: str) -> Iterator[str]:
        """Parts between which all paths converge.  A lone NUL and mark stands for a mark of the text itself."""
        for k, plain in enumerate(text.split(MARK)):
            if k:
                yield OWN_MARK
            yield from self.v.stretches.findall((plain if k else MARK + plain).replace(" ", MARK))

    def _viterbi(self, stretch: str, part: int) -> bytes:
        if stretch == OWN_MARK:
            return np.array([self.v.bytes[b] for b in MARK.encode()], np.int32).tobytes()
        stream, ids = Stream(self.v), array("i")
        for at in range(part, len(stretch) + part, part):
            last = at >= len(stretch)
            ids.extend(stream.finish(stretch[at - part :]) if last else stream.feed(stretch[at - part : at]))
        out = ids.tobytes()
        if len(stretch) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_SIZE:
                self.memo.clear()
            self.memo[stretch] = out
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes which are not UTF-8 become U+FFFD."""
        text = b"".join(map(self.v.written.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the ids of each text in a new column ``out``.

    A null text gives null, an empty one no ids; repeated rows are encoded each; an empty table gives an empty one.
    ``out`` must be a new name; other columns pass unchanged.  The model file is read on the driver (half a megabyte) and
    travels with the task.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {out} exists already")
    return docs.withColumn(out, encoded(F.col(f"`{text}`"), model))


def encoded(text: Column, model: str = MODEL) -> Column:
    data = Path(model).read_bytes()

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker = encoder(data)
        for batch in batches:
            arrays = [None if t is None else worker.encode(t) for t in batch.to_pylist()]
            yield list_array(arrays)

    return ids(text)


def list_array(arrays: list[np.ndarray | None]) -> pa.Array:
    """An Arrow list array out of integer arrays and nulls."""
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *(a for a in arrays if a is not None)])
    mask = pa.array([a is None for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=mask)


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The texts of ids; null for null."""
    data = Path(model).read_bytes()

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker = encoder(data)
        for batch in batches:
            yield pa.array([None if x is None else worker.decode(x) for x in batch.to_pylist()], pa.string())

    return texts(ids)


def round_trips(docs: DataFrame, keys: list[str], text: str = "text", model: str = MODEL) -> DataFrame:
    """``keys``, the ids of each text, their number, and whether decoding gives the text back."""
    data = Path(model).read_bytes()

    @F.arrow_udf("struct<ids: array<int>, round_trip: boolean>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker = encoder(data)
        for batch in batches:
            texts = batch.to_pylist()
            arrays = [None if t is None else worker.encode(t) for t in texts]
            same = [t is None or worker.decode(a.tolist()) == t for t, a in zip(texts, arrays, strict=True)]
            yield pa.StructArray.from_arrays([list_array(arrays), pa.array(same, pa.bool_())], ["ids", "round_trip"])

    rows = docs.select(*[F.col(f"`{k}`") for k in keys], both(F.col(f"`{text}`")).alias("_both"))
    return rows.select(
        *[F.col(f"`{k}`") for k in keys], F.coalesce(F.size("_both.ids"), F.lit(0)).cast("bigint").alias("n_ids"),
        F.col("_both.ids").alias("ids"), F.col("_both.round_trip").alias("round_trip"),
    )
