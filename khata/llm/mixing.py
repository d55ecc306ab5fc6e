"""Mixing documents to target weights of domains, with soft membership.

A classifier learnt from a labelled table gives every document a posterior over domains.  A rate of zero or more for each document
is then fitted by projected gradient descent, so that the expected tokens of each domain (rate * tokens * posterior, over all
documents) meet its target.  A document with rate 1.3 is taken once, and once more with chance 0.3.

With the error of a domain measured against the square root of its present share, and a document's step against its tokens,
the steepest curvature is one and the step length is known.  The gradient of a document depends on its posterior alone, so
documents with equal posteriors (three decimals are kept) have equal rates: a step is one sum over the table of distinct
posteriors.  A rate is a fold over the few residuals of all steps so far, which is all that the driver has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.llm.common import Written, free_name, parted_by
from khata.llm.hashing import FORM, mixed, word_hashes

BUCKETS = 1 << 18
#: Labelled rows to learn from, at most: those with the smallest hashes of their keys.
SAMPLE = 6000
DENSE = 6


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets of the distinct words, shares of kinds of characters, number of words) of a text."""
    raw = text.encode()
    words = raw.translate(FORM).split()
    n = len(raw.split())
    if not words:
        return np.empty(0, np.int32), np.zeros(DENSE, np.float32), n
    _, sums = word_hashes(np.frombuffer(b" ".join(words), np.uint8))
    distinct = np.unique(mixed(sums) % np.uint64(BUCKETS)).astype(np.int32)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, count = len(raw), len(words)
    marks = kinds[[ord(c) for c in "#*$%&|<>"]].sum()
    dense = [marks / n, kinds[ord("!")] / n, kinds[65:91].sum() / size, 1 - len(distinct) / count, kinds[48:58].sum() / size, 1.0]
    return distinct, np.minimum(np.array(dense, np.float32) * 4, 4), n


@dataclass(frozen=True)
class Classifier:
    """Softmax regression over word buckets and shares; ``weights`` has a row for each feature, a column for each domain."""

    domains: tuple[str, ...]
    weights: np.ndarray

    def posterior(self, found: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = self.weights[found].sum(axis=0) / np.sqrt(max(len(found), 1)) + dense @ self.weights[BUCKETS:]
        e = np.exp(z - z.max())
        return e / e.sum()


def learn(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 12, rate: float = 0.5, least: int = 3, seed: int = 1) -> Classifier:
    """Adaptive gradient descent over (buckets, shares, domain); buckets of fewer than ``least`` rows stay out."""
    domains = tuple(sorted({d for *_, d in rows})) or ("all",)
    weights = np.zeros((BUCKETS + DENSE, len(domains)), np.float32)
    model, power = Classifier(domains, weights), np.full_like(weights, 1e-2)
    frequent = np.bincount(np.concatenate([r[0] for r in rows] or [np.empty(0, np.int32)]), minlength=BUCKETS) >= least
    at, order = np.arange(BUCKETS, BUCKETS + DENSE), np.random.default_rng(seed)
    for _ in range(epochs if len(domains) > 1 else 0):
        for i in order.permutation(len(rows)):
            found, dense, domain = rows[i]
            kept = found[frequent[found]]
            error = model.posterior(kept, dense)
            error[domains.index(domain)] -= 1
            for where, size in ((kept, np.full(len(kept), 1 / np.sqrt(max(len(kept), 1)), np.float32)), (at, dense)):
                step = size[:, None] * error[None, :] + 1e-4 * weights[where]
                power[where] += step * step
                weights[where] -= rate * step / np.sqrt(power[where])
    return Classifier(domains, weights)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [features(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("domain"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))],
            ["domain", "words", "shares"],
        )


def train(docs: DataFrame, labels: DataFrame, domain: str, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Classifier:
    """Learns from at most ``sample`` rows of ``labels``, joined with their texts on ``key``; ``domain`` is an SQL expression over ``labels``; rows with a null domain are no labels."""
    named = labels.select(F.col(f"`{key}`").alias("key"), F.expr(domain).alias("domain")).where("key is not null and domain is not null")
    few = named.orderBy(F.xxhash64("key"), "key", "domain").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = texts.join(F.broadcast(few), "key").select("key", "domain", "text")
    got = rows.select("domain", "text").mapInArrow(_featured, "domain string, words array<int>, shares array<float>").collect()
    got = sorted(((np.array(r["words"], np.int32), np.array(r["shares"], np.float32), r["domain"]) for r in got), key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))
    return learn(got)


def posteriors(docs: DataFrame, model: Classifier, text: str = "text") -> Column:
    """struct<tokens bigint, p array<double>>: words of a text and its posterior, to three decimals which add up to one."""
    used = np.flatnonzero(np.abs(model.weights).sum(axis=1))  # only what was learnt travels with the tasks
    rows, domains = model.weights[used], model.domains

    @F.arrow_udf("struct<tokens: bigint, p: array<double>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = np.zeros((BUCKETS + DENSE, len(domains)), np.float32)
        weights[used] = rows
        judge = Classifier(domains, weights)
        for batch in batches:
            tokens, ps = [], []
            for t in batch:
                found, dense, n = features(t.as_py() or "")
                p = np.round(judge.posterior(found, dense).astype(np.float64) * 1000).astype(int)
                p[p.argmax()] += 1000 - p.sum()
                tokens.append(n), ps.append((p / 1000).tolist())
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(ps, pa.list_(pa.float64()))], ["tokens", "p"])

    return of(F.col(f"`{text}`"))


def _rate(p: Column, history: list[tuple[list[float], float]], ridge: float) -> Column:
    """The state (w, y) of a document with posterior ``p`` after the steps in ``history``: scaled residuals and momentum."""
    one = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("y"))
    if not history:
        return one
    told = ", ".join(f"named_struct('q', array({', '.join(f'{float(x)!r}D' for x in q)}), 'm', {float(m)!r}D)" for q, m in history)
    steps = F.expr(f"array({told})")

    def step(acc: Column, s: Column) -> Column:
        slope = F.aggregate(F.zip_with(p, s["q"], lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y) + ridge * (acc["y"] - 1)
        w = F.greatest(F.lit(0.0), acc["y"] - slope / (1 + ridge))
        return F.transform(F.array(w), lambda v: F.struct(v.alias("w"), (v + s["m"] * (v - acc["w"])).alias("y")))[0]

    return F.aggregate(steps, one, step)


@dataclass(frozen=True)
class Rates:
    """The fitted steps, the expected tokens of each domain they lead to, and the targets."""

    history: list[tuple[list[float], float]]
    expected: list[float]
    targets: list[float]
    ridge: float

    def of(self, p: Column) -> Column:
        return _rate(p, self.history, self.ridge)["w"]


def fit_rates(mass: DataFrame, targets: list[float], ridge: float = 1e-4, steps: int = 60, close: float = 1e-3) -> Rates:
    """Fits rates to a table (p, tokens) of distinct posteriors.

    ``targets`` are tokens for each domain.  Accelerated projected gradient; ``ridge`` draws rates to one where the targets leave
    them open.  Ends when every domain is within ``close`` of the present total's share.  A domain without tokens can't be
    raised and is left out of the error; an empty table gives no steps.
    """
    k = len(targets)
    sums = lambda w: [F.sum(F.col("tokens") * w * F.col("p")[j]).alias(f"s{j}") for j in range(k)]
    now = [x or 0.0 for x in mass.agg(*sums(F.lit(1.0))).first()]
    total, history, t = sum(now), [], 1.0
    if not total:
        return Rates([], now, list(targets), ridge)
    share = [x / total for x in now]
    expected = now
    for _ in range(steps):
        # The state's w is judged, its y gives the next slope; both come from one pass.
        state = _rate(F.col("p"), history, ridge)
        row = mass.select("p", "tokens", state.alias("state")).agg(
            *sums(F.col("state.w")), *[F.sum(F.col("tokens") * F.col("state.y") * F.col("p")[j]).alias(f"y{j}") for j in range(k)]
        ).first()
        expected, ahead = [row[f"s{j}"] for j in range(k)], [row[f"y{j}"] for j in range(k)]
        if all(abs(e - g) <= close * s * total for e, g, s in zip(expected, targets, share, strict=True) if s):
            break
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        history.append(([(y - g) / total / s if s else 0.0 for y, g, s in zip(ahead, targets, share, strict=True)], (t - 1) / after))
        t = after
    return Rates(history, expected, list(targets), ridge)


def mixed_documents(docs: DataFrame, labels: DataFrame, domain: str, weights: dict[str, float], key: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = 7) -> tuple[DataFrame, Rates, tuple[str, ...]]:
    """(scored, rates, domains): per row of ``docs`` its key, ``tokens``, posterior ``p``, ``rate`` and ``copies``.

    ``weights`` are the target shares of the present token total; a domain without a weight gets zero.  Null and empty texts have no
    tokens and get the rate of their posterior; repeated rows count each and get the same number of copies; an empty table
    gives an empty one; without labels there is one domain.
    """
    place = Written(docs.sparkSession)
    model = train(docs, labels, domain, key, text, sample)
    both = docs.select(F.col(f"`{key}`").alias("id"), posteriors(docs, model, text).alias("both"))
    scored = place.table(both.select("id", F.col("both.tokens").alias("tokens"), F.col("both.p").alias("p")), "scored")
    mass = place.table(scored.groupBy("p").agg(F.sum("tokens").alias("tokens")), "mass")
    total = mass.agg(F.sum("tokens")).first()[0] or 0
    share = [weights.get(d, 0.0) if len(model.domains) > 1 else 1.0 for d in model.domains]
    rates = fit_rates(mass, [total * s for s in share])
    out = scored.withColumn("rate", rates.of(F.col("p")))
    return out.select("id", "tokens", "p", "rate", copies(F.col("rate"), F.col("id"), seed).alias("copies")), rates, model.domains


def copies(rate: Column, key: Column, seed: int) -> Column:
    """How often a document is taken: the whole part of its rate, and once more by a draw which its key decides."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + draw).cast("int")


def take_copies(docs: DataFrame, scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as ``scored``, which has all their keys, says; the columns stay as they are.

    Documents which are taken once stay where they are.
    """
    place, body = Written(docs.sparkSession), F.col(f"`{key}`")
    id_, times_, again = (free_name(docs, n) for n in ("_id", "_copies", "_again"))
    times = place.table(scored.groupBy(F.col("id").alias(id_)).agg(F.max("copies").alias(times_)), "times")
    near, far = parted_by(docs, F.xxhash64(body), times.where(F.col(times_) != 1), F.xxhash64(id_))
    met = near.join(times.where(F.col(times_) > 0), body.eqNullSafe(F.col(id_)))
    more = met.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(times_)))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return far.unionByName(more)
