"""A convolutional text classifier for toxicity, trained in numpy, with thresholds by language.

A word's embedding is the sum of two rows of one hashed table: its own and that of its first five bytes, so that a word which was
never seen still says what its stem says.  Filters over one, two and three words slide over the whole text; each one's largest value
is kept, and a logistic unit weighs them.  The first coordinate of the table starts as the difference of document shares between the
classes, which training refines with the rest.

Scores see the text only.  The sample bounds what is fitted and nothing else: all labelled rows which were not fitted say, for each
language, which threshold parts the classes best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.hashing import FORM, GOLDEN, WEIGHTS, mixed

BUCKETS = 1 << 17
SIZE, FILTERS, WIDTHS = 8, 12, (1, 2, 3)
STEM = 5
#: Labelled rows to learn from, at most, of each class: those with the smallest hashes of their keys.
SAMPLE = 2500
#: Parts of the scores whose rows are counted for the thresholds.
BINS = 1 << 12
#: Words which are worked through at a time.
CHUNK = 1 << 16
PADS = max(WIDTHS)


def rows_of(text: str) -> np.ndarray:
    """(words, 2): the table rows of each word and of its stem."""
    data = np.frombuffer(b" ".join(text.encode().translate(FORM).split()), np.uint8)
    if not len(data):
        return np.empty((0, 2), np.int32)
    starts = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    terms = data * WEIGHTS[place & 4095] * (data != 32)
    word, stem = np.add.reduceat(terms, starts), np.add.reduceat(terms * (place < STEM), starts)
    return (np.stack([mixed(word), mixed(stem + GOLDEN)], axis=1) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class TextCnn:
    table: np.ndarray  # (BUCKETS + 1, SIZE); the last row is the pad and stays zero
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """Chance of "toxic" for the rows of several texts; long texts are worked through in parts which overlap."""
        parts, owner = [], []
        for i, rows in enumerate(docs):
            for at in range(0, max(len(rows), 1), CHUNK):
                parts.append(rows[at : at + CHUNK + PADS - 1])
                owner.append(i)
        pooled = np.full((len(docs), len(self.bias)), -np.inf, np.float32)
        at = 0
        while at < len(parts):
            end, n = at, 0
            while end < len(parts) and (n == 0 or n + len(parts[end]) <= CHUNK):
                n += len(parts[end]) + PADS
                end += 1
            np.maximum.at(pooled, owner[at:end], self.forward(parts[at:end])[0])
            at = end
        return self.chance(pooled)

    def chance(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.base
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def forward(self, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(pooled values before the bias, rows, embeddings, values, first place and number of windows of each text)."""
        counts = np.array([len(d) for d in docs])
        firsts = np.concatenate([[0], np.cumsum(counts + PADS)])[:-1]
        rows = np.full((int((counts + PADS).sum()), 2), BUCKETS, np.int64)
        inside = np.repeat(firsts - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
        rows[inside] = np.concatenate(docs)
        x = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        values = []
        for f in self.filters:
            v = x @ f[0]
            for j in range(1, len(f)):
                v[:-j] += x[j:] @ f[j]
            values.append(v)
        values = np.concatenate(values, axis=1)
        windows = np.clip(counts, 1, CHUNK)  # what a part has beyond that begins the next one
        live = np.zeros(len(rows), bool)
        live[np.repeat(firsts - np.concatenate([[0], np.cumsum(windows)])[:-1], windows) + np.arange(windows.sum())] = True
        values[~live] = -np.inf
        return np.maximum.reduceat(values, firsts, axis=0), rows, x, values, firsts, windows


def new_model(docs: list[np.ndarray], toxic: np.ndarray, rng: np.random.Generator) -> TextCnn:
    table = rng.normal(0, 0.05, (BUCKETS + 1, SIZE)).astype(np.float32)
    share = np.zeros((2, BUCKETS))
    for rows, y in zip(docs, toxic, strict=True):
        share[int(y), np.unique(rows)] += 1
    n = np.bincount(toxic.astype(int), minlength=2)
    gap = share[1] / max(n[1], 1) - share[0] / max(n[0], 1)
    table[:-1, 0] = gap / np.sqrt((share.sum(axis=0) + 10) / max(n.sum(), 1))
    table[-1] = 0
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] = 2.0  # half of the filters begin with the first coordinate
    total = FILTERS * len(WIDTHS)
    return TextCnn(table, filters, np.zeros(total, np.float32), rng.normal(0, 0.1, total).astype(np.float32), 0.0)


def fit(docs: list[np.ndarray], toxic: np.ndarray, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 5) -> TextCnn:
    """Adam on filters and weights, plain steps on the table; each text moves the windows which its filters picked."""
    rng = np.random.default_rng(seed)
    model = new_model(docs, toxic, rng)
    dense = [*model.filters, model.bias, model.out]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            pooled, rows, x, values, firsts, windows = model.forward([docs[i] for i in picked])
            hidden = np.maximum(pooled + model.bias, 0)
            error = ((model.chance(pooled) - toxic[picked]) / len(picked)).astype(np.float32)
            back = error[:, None] * model.out[None, :] * (hidden > 0)
            where = np.stack([values[a : a + n].argmax(axis=0) + a for a, n in zip(firsts, windows, strict=True)])
            slopes = []
            for k, f in enumerate(model.filters):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                slope = np.empty_like(f)
                for j in range(len(f)):
                    at_j, g = where[:, part] + j, back[:, part]
                    slope[j] = np.einsum("dfe,df->ef", x[at_j], g)
                    moved = (-rate * 20) * g[:, :, None] * f[j].T[None]
                    for side in (0, 1):
                        np.add.at(model.table, rows[at_j, side], moved)
                slopes.append(slope)
            model.table[-1] = 0
            slopes += [back.sum(axis=0), hidden.T @ error + 1e-4 * model.out]
            model.base -= rate * float(error.sum()) * 5
            step += 1
            for p, g, m, v in zip(dense, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The middle between two scores which parts the classes with the fewest mistakes, or one half without both classes."""
    if not len(scores) or toxic.min() == toxic.max():
        return 0.5
    order = np.argsort(scores)
    s, y = scores[order], toxic[order]
    mistakes = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[0.0], s, [1.0]])
    middle = (edges[:-1] + edges[1:]) / 2
    near = mistakes <= mistakes.min()
    return float(middle[near][np.argmin(np.abs(middle[near] - 0.5))])


def counted_threshold(bins: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """``best_threshold`` from numbers of rows: ``bins`` are ascending, from 0 to ``BINS``, each with rows of one class at least."""
    if not clean.sum() or not toxic.sum():
        return 0.5
    mistakes = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    # From the end of the last bin below to the begin of the first one above.
    below, above = np.concatenate([[0], bins + 1]), np.concatenate([bins, [max(BINS, bins[-1] + 1)]])
    middle = (below + above) / (2 * BINS)
    near = mistakes <= mistakes.min() * (1 + 1e-9)
    return float(middle[near][np.argmin(np.abs(middle[near] - 0.5))])


def _choose(model: TextCnn, rows: DataFrame) -> None:
    """The thresholds of the model from ``rows`` (lang, toxic, bin, fitted) which were not fitted.

    Rows of one class count so much that they stand for all rows of that class.  A few numbers for each bin and language come to the
    driver, however many rows there are.
    """
    got = rows.groupBy("lang", "bin", "toxic", "fitted").agg(F.count("*").alias("n")).collect()
    total, left = ({y: sum(r["n"] for r in got if r["toxic"] == y and not (r["fitted"] and skip)) for y in (0, 1)} for skip in (False, True))
    by: dict[str | None, dict[int, list[float]]] = {}
    for r in got:
        if r["fitted"]:
            continue
        for name in (None, r["lang"]):
            cell = by.setdefault(name, {}).setdefault(r["bin"], [0.0, 0.0])
            cell[r["toxic"]] += r["n"] * total[r["toxic"]] / left[r["toxic"]]
    for name, cells in by.items():
        bins = np.array(sorted(cells))
        clean, toxic = np.array([cells[b] for b in bins.tolist()]).T
        value = counted_threshold(bins, clean, toxic)
        if name is None:
            model.threshold = value
        else:
            model.thresholds[name] = value


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([rows_of(t.as_py() or "").tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "lang", "toxic")), rows], ["key", "lang", "toxic", "rows"])


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", lang: str | None = "lang", label: str = "toxic", sample: int = SAMPLE) -> TextCnn:
    """Fits at most ``sample`` rows of ``labels`` of each class where ``learn`` holds, but for every fifth of them.

    Thresholds come from all other rows where ``learn`` holds, in the shares which the classes have among all of them.  Rows with a null key or label are none.  Without rows of both classes every score is the share of toxic rows.
    """
    named = labels.where("true" if learn is None else learn).select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{label}`").cast("int").alias("toxic"))
    named = named.where("key is not null and toxic in (0, 1)")
    some = [named.where(f"toxic = {y}").orderBy(F.xxhash64("key"), "key").limit(sample) for y in (0, 1)]
    few = F.broadcast(some[0].unionByName(some[1]))  # at most two samples
    language = F.lit(None).cast("string") if lang is None else F.col(f"`{lang}`").cast("string")
    texts = docs.select(F.col(f"`{key}`").cast("string").alias("key"), language.alias("lang"), F.col(f"`{text}`").alias("text"))
    got = texts.join(few, "key").mapInArrow(_rows, "key string, lang string, toxic int, rows binary").collect()
    got.sort(key=lambda r: (r["key"], bytes(r["rows"]), r["toxic"]))
    rows = [np.frombuffer(r["rows"], np.int32).reshape(-1, 2) for r in got]
    toxic = np.array([r["toxic"] for r in got], np.float32)
    if not len(rows) or toxic.min() == toxic.max():
        model = new_model([], np.empty(0), np.random.default_rng(0))
        model.out[:], model.base = 0, 0.0 if not len(rows) else float(20 * toxic[0] - 10)
        return model
    held = np.arange(len(rows)) % 5 == 0
    model = fit([r for r, h in zip(rows, held, strict=True) if not h], toxic[~held])
    keys = sorted({r["key"] for r, h in zip(got, held, strict=True) if not h})
    fitted = F.broadcast(docs.sparkSession.createDataFrame([(k, True) for k in keys], "key string, fitted boolean"))  # at most two samples
    # Texts are scored where they are: labels may be as many, and only a number for each text is shuffled to them.
    bins = texts.select("key", F.coalesce("lang", F.lit("")).alias("lang"), F.floor(score(F.col("text"), model) * BINS).cast("int").alias("bin"))
    every = bins.join(named, "key").join(fitted, "key", "left")
    _choose(model, every.withColumn("fitted", F.coalesce("fitted", F.lit(False))))
    return model


def score(text: Column, model: TextCnn) -> Column:
    """The score of each whole text, 0 to 1; a null counts as an empty text."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[float] = []
            for at in range(0, len(batch), 256):
                out += model.scores([rows_of(t.as_py() or "") for t in batch.slice(at, 256)]).tolist()
            yield pa.array(out, pa.float64())

    return of(text)


def scored(docs: DataFrame, model: TextCnn, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, ``score``, ``threshold`` of the row's language (the general one for others), ``flagged`` by it.

    Null and empty texts are scored as empty; repeated rows get equal scores; other columns are not read.
    """
    cases = F.lit(model.threshold)
    for name, value in model.thresholds.items():
        cases = F.when(F.coalesce(F.col(f"`{lang}`"), F.lit("")) == name, value).otherwise(cases)
    rows = docs.select(F.col(f"`{key}`"), cases.alias("threshold"), score(F.col(f"`{text}`"), model).alias("score"))
    return rows.withColumn("flagged", F.col("score") >= F.col("threshold"))
