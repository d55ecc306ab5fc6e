"""Fuzzy line dedup over a whole corpus.

Lines of five words or more are compared in a normal form: ASCII letters in lower case, digits as 0, ASCII punctuation and white
space as one space.  Two lines link where their 64-bit SimHashes differ in at most ``distance`` bits and the edit similarity of the
normal forms (1 - edits / length of the longer one) is at least ``similarity``; equal normal forms are one line.  Of all lines in a
connected group one occurrence stays, the first by (key, text hash, line number).

The bits are cut into five blocks.  Three differing bits leave two blocks equal, so lines are joined on each of the ten pairs of
blocks, about 25 bits long; the bits are compared in the join itself, and only what is left is verified on the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from khata.llm.common import Written, free_name, let, parted_by
from khata.llm.graph import components
from khata.llm.hashing import FORM, GOLDEN, mixed, word_hashes

MIN_WORDS = 5
#: Columns beside those of a document; a document has none of these names.
GONE, KEPT = "_khata_gone_lines", "_khata_kept_text"
CHUNK_BYTES = 1 << 18
#: Forms and hashes hardly repeat, so no dictionary is tried; a tenth more bytes for a quarter less time to write them.
FAST = {"parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}
#: Rounds in which two lines are aligned word by word.
ROUNDS = 16
#: The bits of a byte as counters of eight bits each.
COUNTERS = np.array([sum((byte >> i & 1) << 8 * i for i in range(8)) for byte in range(256)], np.uint64)
#: Neighbours in the order of a key with which a line is compared first.
NEIGHBOURS = 4


def line_bits(forms: list[bytes], counts: list[int]) -> np.ndarray:
    """SimHash of every line; ``counts`` has its number of words.

    The features are words; of a run of equal words each has its place in the run, so that runs of different lengths differ.
    """
    return _bits(np.frombuffer(b" ".join(forms), np.uint8), np.array(counts))


def _bits(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``line_bits`` of lines which one space parts."""
    _, sums = word_hashes(data)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    new = np.ones(len(sums), bool)
    new[1:] = sums[1:] != sums[:-1]
    new[firsts] = True
    at = np.arange(len(sums))
    run = at - np.maximum.accumulate(np.where(new, at, 0))
    hashes = mixed(sums + run.astype(np.uint64) * GOLDEN)
    most = 2 * _bit_counts(hashes, firsts, counts) > counts[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<i8")[:, 0]


def _bit_counts(hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of each line; ``firsts`` has the places of its first ones.

    Eight counters fill a word, and differences of running sums are exact modulo 2^64, so no line is spread out into bits.  A
    counter holds 255 at most, so longer lines are counted in parts.
    """
    parts = -(-counts // 255)
    begin = np.cumsum(parts) - parts
    starts = np.repeat(firsts - 255 * begin, parts) + 255 * np.arange(parts.sum())
    ends = np.append(starts[1:], len(hashes))
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out, sums = np.empty((len(counts), 64), np.int32), np.zeros(len(hashes) + 1, np.uint64)
    for i in range(8):
        np.cumsum(COUNTERS[by_byte[:, i]], out=sums[1:])
        counted = (sums[ends] - sums[starts]).astype("<u8").view(np.uint8).reshape(-1, 8)
        out[:, 8 * i : 8 * i + 8] = np.add.reduceat(counted, begin, axis=0, dtype=np.int32) if len(counted) > len(counts) else counted
    return out


LINES = "id {id}, version bigint, line_no int, line binary, bits bigint, form string"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``LINES`` for each line with enough words; the text is worked through in parts of ``CHUNK_BYTES``, cut between lines."""
    for batch in batches:
        ids, versions, texts = batch.columns
        owners, firsts, parts, size = [], [], [], 0
        for i, text in enumerate(texts):
            body, at, number = (text.as_py() or "").encode().translate(FORM), 0, 0
            while at <= len(body):
                end = body.find(b"\n", at + CHUNK_BYTES)
                part = body[at : end if end >= 0 else len(body)]
                owners.append(i), firsts.append(number), parts.append(part)
                at, number, size = at + len(part) + 1, number + part.count(b"\n") + 1, size + len(part)
                if size >= CHUNK_BYTES:
                    yield from _rows(ids, versions, owners, firsts, parts)
                    owners, firsts, parts, size = [], [], [], 0
        yield from _rows(ids, versions, owners, firsts, parts)


def _rows(ids: pa.Array, versions: pa.Array, owners: list[int], firsts: list[int], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The lines of some parts of texts; a part has the place of its text and the number of its first line."""
    from xxhash import xxh3_128_digest

    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    breaks, within = np.flatnonzero(data == 10), data > 32
    words = np.flatnonzero(within & ~np.concatenate([[False], within[:-1]]))
    counts = np.bincount(np.searchsorted(breaks, words), minlength=len(breaks))
    good = counts >= MIN_WORDS
    if not good.any():
        return
    # What stays of the good lines: their words, the space before each word but the first, and the break.
    before = words[words > 0] - 1
    within[before[data[before] == 32]] = True
    opening = words[(np.cumsum(counts) - counts)[counts > 0]]
    opening = opening[opening > 0]
    within[opening[data[opening - 1] == 32] - 1] = False
    within &= np.repeat(good, np.diff(breaks, prepend=-1))
    forms = data[within]
    within[breaks[good]] = True
    bits = _bits(np.where((spaced := data[within][:-1]) == 10, np.uint8(32), spaced), counts[good])
    ends = np.flatnonzero(data[within] == 10) - np.arange(good.sum())
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    view = memoryview(forms)
    keys = pa.array([xxh3_128_digest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
    lengths = [part.count(b"\n") + 1 for part in parts]
    starts = np.cumsum(lengths) - lengths
    numbers = np.arange(len(breaks)) - np.repeat(starts - firsts, lengths)
    owner = pa.array(np.repeat(owners, lengths)[good])
    columns = [ids.take(owner), versions.take(owner), pa.array(numbers[good].astype(np.int32)), keys, pa.array(bits)]
    texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(forms))
    yield pa.RecordBatch.from_arrays([*columns, texts], ["id", "version", "line_no", "line", "bits", "form"])


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or anything above ``most`` if it is above: Myers' bit vectors after cutting common ends."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    while a and a[-1] == b[-1]:
        cut = 1
        while 2 * cut <= len(a) and a[-2 * cut :] == b[-2 * cut :]:
            cut *= 2
        a, b = a[:-cut], b[:-cut]
    while a and a[0] == b[0]:
        cut = 1
        while 2 * cut <= len(a) and a[: 2 * cut] == b[: 2 * cut]:
            cut *= 2
        a, b = a[cut:], b[cut:]
    if not a:
        return len(b)
    # Lines with little in common are told by their first parts: a path meets the column after ``cut`` characters in one of these rows.
    cut = 7 * most // 4
    if 0 < cut < len(a) - 2 * most and _least(*_column(a[: cut + most], b[:cut]), cut + most, cut) > most:
        return most + 1
    up, down = _column(a, b)
    return len(b) + up.bit_count() - down.bit_count()  # the last row, from the ups and downs of the last column


def _column(a: str, b: str) -> tuple[int, int]:
    """Rows of ``a`` where the last column of the table of edits goes up by one, and where it goes down."""
    m, where = len(a), {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << m) - 1
    up, down = full, 0
    for same in [where.get(c, 0) for c in b]:
        d = (((same & up) + up) ^ up) | same | down
        h = (down | full & ~(d | up)) << 1 | 1
        up, down = ((up & d) << 1 | ~(d | h)) & full, d & h & full
    return up, down


def _least(up: int, down: int, m: int, first: int) -> int:
    """The least number of edits in a column of ``m`` rows, which starts with ``first``."""
    steps = [np.unpackbits(np.frombuffer(v.to_bytes(m // 8 + 1, "little"), np.uint8), count=m, bitorder="little") for v in (up, down)]
    return first + min(0, int(np.cumsum(steps[0].astype(np.int8) - steps[1].astype(np.int8), dtype=np.int64).min()))


def words_apart(a: str, b: str, most: int) -> int:
    """At least the Levenshtein distance, from an alignment of whole words, or anything above ``most`` where few rounds find none.

    A round lets every diagonal take one word out, put one in or replace one, and then go on over equal words.  It costs
    little where a few words of a long line differ, and never says that two lines are nearer than they are.
    """
    x, y = a.split(" "), b.split(" ")
    n, m = len(x), len(y)
    if n == m and (cost := sum(max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w)) <= most:
        return cost
    reached = {0: (0, 0)}  # the furthest word of x on each diagonal, and the edits on the way
    for turn in range(ROUNDS + 1):
        after = {}
        for k in range(-turn, turn + 1):
            i, cost = -1, 0
            if not turn:
                i = 0
            elif (at := reached.get(k)) and at[0] < n and at[0] - k < m:
                i, cost = at[0] + 1, at[1] + max(len(x[at[0]]), len(y[at[0] - k]))
            if turn and (at := reached.get(k - 1)) and i <= at[0] < n:
                i, cost = at[0] + 1, at[1] + len(x[at[0]]) + 1
            if turn and (at := reached.get(k + 1)) and i <= at[0] and at[0] - k - 1 < m:
                i, cost = at[0], at[1] + len(y[at[0] - k - 1]) + 1
            if i < 0 or cost > most:
                continue
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            if i == n and i - k == m:
                return cost
            after[k] = i, cost
        # Lines of which little is equal by now aren't aligned any further.
        if not after or turn == ROUNDS // 4 and 12 * max(2 * i - k for k, (i, _) in after.items()) < n + m:
            break
        reached = after
    return most + 1


def similar(a: Column, b: Column, similarity: float) -> Column:
    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
                most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
                out.append(words_apart(x, y, most) <= most or edits(x, y, most) <= most)
            yield pa.array(out, pa.bool_())

    return of(a, b)


def blocks(bits: Column, count: int, equal: int) -> list[Column]:
    """A key for every choice of ``equal`` blocks out of ``count``."""
    ends = [round(64 * i / count) for i in range(count + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [
        F.xxhash64(F.lit(n), bits.bitwiseAND(F.lit(signed(sum(chosen)))))
        for n, chosen in enumerate(combinations(masks, equal))
    ]


def keyed(lines: DataFrame, count: int, distance: int) -> DataFrame:
    """(bits, key) for different values in ``bits``: two with at most ``distance`` differing bits have a key in common."""
    return lines.select("bits", F.explode(F.array(*blocks(F.col("bits"), count, count - distance))).alias("key"))


def paired(lines: DataFrame, count: int, distance: int) -> DataFrame:
    """Of different values in ``bits`` those which have another one at ``distance`` or fewer differing bits, once or several times.

    Both sides of the join have the same names, so that they are the same plan and go through one shuffle.
    """
    keys = keyed(lines, count, distance)
    other = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))).between(1, distance)
    return keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & other, "left_semi").select("bits")


def _near(distance: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance


def line_groups(lines: DataFrame, kinds: DataFrame, place: Written, similarity: float, distance: int, count: int) -> DataFrame:
    """(line, group) of the lines in links; other lines are alone.  ``kinds`` has (line, bits, n) of every different line.

    Groups are wanted, not all links, so no group is spread out into its pairs.  Lines which have a partner at all come from a
    semi-join; all that follows is among them.  Each is compared with a few neighbours first, in the order of each
    key's bits, and with the most frequent line of the key.  Only pairs which are not in one group by then are looked for and verified.
    """
    values = place.table(kinds.groupBy("bits").agg(F.count("*").alias("n")), "values")
    # Equal bits make a pair of their own where several lines have them.
    shared = values.where("n > 1").select("bits")
    ends = place.table(paired(values, count, distance).unionByName(shared).distinct(), "ends")
    near, _ = parted_by(lines, F.xxhash64("bits"), ends, F.xxhash64("bits"))
    texts = near.join(ends, "bits", "left_semi").groupBy("bits", "line").agg(F.min("form").alias("form"), F.count("*").alias("n"))
    texts = place.table(texts.withColumn("size", F.length("form")), "texts")
    keys = F.explode(F.array(*blocks(F.col("bits"), count, count - distance))).alias("key")
    slim = texts.select("bits", "line", "n", "size")
    nodes = slim.select("*", keys)
    alike = F.least("sa", "sb") >= similarity * F.greatest("sa", "sb")
    order = Window.partitionBy("key").orderBy("bits", "line")
    me, best = F.struct("bits", "line", "size"), F.max_by(F.struct("bits", "line", "size"), F.struct("n", "line"))
    before = nodes.select(me.alias("x"), F.array(*[F.lag(me, k).over(order) for k in range(1, NEIGHBOURS + 1)]).alias("ys"))
    close = F.filter("ys", lambda y: F.bit_count(F.col("x.bits").bitwiseXOR(y["bits"])) <= distance)
    chain = before.select("x", F.explode(close).alias("y"))
    # The most frequent line of a key is one row however many lines the key has; the join splits those.
    star = nodes.join(nodes.groupBy("key").agg(best.alias("y")), "key").select(me.alias("x"), "y")
    some = _pairs(chain.unionByName(star)).where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & alike)
    first = place.table(_verified(some.select("la", "lb").distinct(), texts, similarity), "first")
    grouped = place.table(components(first, place), "grouped")
    of_line = slim.join(grouped.withColumnRenamed("node", "line"), "line", "left")
    of_line = of_line.select("bits", "line", "size", F.coalesce("component", "line").alias("group"), keys)
    one, two = (of_line.select("key", *[F.col(c).alias(f"{n}{x}") for c, n in (("bits", ""), ("line", "l"), ("size", "s"), ("group", "g"))]) for x in "ab")
    apart = (F.col("la") < F.col("lb")) & (F.col("ga") != F.col("gb"))
    rest = one.join(two, "key").where(apart & _near(distance) & alike).select("la", "lb").distinct()
    others = place.table(_verified(rest, texts, similarity), "others")
    known = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(others), place, "all").withColumnRenamed("node", "line").withColumnRenamed("component", "group")


def _pairs(rows: DataFrame) -> DataFrame:
    """Structs x and y (bits, line, size) as the columns a, la, sa and b, lb, sb."""
    names = [("bits", ""), ("line", "l"), ("size", "s")]
    return rows.select(*[F.col(f"{o}.{c}").alias(f"{n}{t}") for o, t in (("x", "a"), ("y", "b")) for c, n in names]).where("la != lb")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (la, lb) of lines whose forms are similar, as (a, b)."""
    fa, fb = (texts.select(F.col("line").alias(f"l{x}"), F.col("form").alias(f"f{x}")) for x in "ab")
    met = pairs.join(fa, "la").join(fb, "lb").where(similar(F.col("fa"), F.col("fb"), similarity))
    return met.select(F.col("la").alias("a"), F.col("lb").alias("b"))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, distance: int = 3, count: int = 5) -> DataFrame:
    """(id, version, gone): the line numbers, from 0, which go from each text; ``version`` is the text's hash."""
    place = Written(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.col(f"`{text}`"))
    schema = LINES.format(id=docs.schema[key].dataType.simpleString())
    lines = place.table(source.mapInArrow(_lines, schema), "lines", **FAST)
    kinds = place.table(lines.groupBy("line", "bits").agg(F.count("*").alias("n")), "kinds")
    groups = place.table(line_groups(lines, kinds, place, similarity, distance, count), "groups")
    at = F.struct("id", "version", "line_no")
    # Only lines which occur again or are linked can go; all others stay where they are.
    again = kinds.where("n > 1").select("line").unionByName(groups.select("line"))
    near, _ = parted_by(lines.select("id", "version", "line_no", "line"), F.xxhash64("line"), again, F.xxhash64("line"))
    lines = place.table(near, "again")
    firsts = lines.groupBy("line").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    named = place.table(firsts.join(groups, "line", "left").withColumn("group", F.coalesce("group", "line")), "named")
    whole = named.groupBy("group").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    # Only lines in groups of several can go.
    judged = named.join(whole.select("group", "keep"), "group").select("line", "keep")
    gone = lines.select("id", "version", "line_no", "line").join(judged, "line").where(~at.eqNullSafe(F.col("keep")))
    out = place.table(gone.groupBy("id", "version").agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "gone")
    for name in ("lines", "kinds", "values", "ends", "texts", "first", "grouped", "others", "groups", "again", "named"):
        place.drop(name)
    return out


def without_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None, **how: float) -> DataFrame:
    """``docs`` with the texts less their repeated lines; ``length`` names a column which takes the new number of characters.

    Rows with equal key and text are one document, and all of them change alike.  Null texts stay null; empty texts and texts of
    short lines stay as they are; a text whose lines all go is empty; an empty table gives an empty one; other columns pass
    unchanged.
    """
    kept = _joined(docs, key, text, **how)
    new = F.coalesce(F.col(KEPT), F.col(f"`{text}`"))
    columns = {text: new} | ({length: F.length(new).cast(docs.schema[length].dataType)} if length else {})
    return kept.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def _joined(docs: DataFrame, key: str, text: str, **how: float) -> DataFrame:
    """``docs`` with the columns ``GONE`` (line numbers) and ``KEPT`` (text), both null where nothing goes."""
    names = {n: free_name(docs, n) for n in ("_id", "_version")}
    gone = removed_lines(docs, key, text, **how).select(F.col("id").alias(names["_id"]), F.col("version").alias(names["_version"]), F.col("gone").alias(GONE))
    body = F.col(f"`{text}`")
    mine = F.xxhash64(F.col(f"`{key}`"), F.xxhash64(body))
    near, far = parted_by(docs, mine, gone, F.xxhash64(*names.values()))
    same = F.col(f"`{key}`").eqNullSafe(gone[names["_id"]]) & (F.xxhash64(body) == gone[names["_version"]])

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(GONE))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # A text is split once, not once for each of its lines.
    joined = F.when(F.col(GONE).isNotNull(), let(F.split(body, "\n"), rest))
    # The few numbers of a partition are hashed, so the texts aren't sorted.
    met = near.join(gone.hint("shuffle_hash"), same, "left").select(*[near[f"`{c}`"] for c in docs.columns], GONE)
    none = far.select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(None).cast("array<int>").alias(GONE))
    return met.unionByName(none).withColumn(KEPT, joined)


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """Per row of ``docs``: key, number of lines, how many go, and the SHA-256 of the text that stays."""
    rows = _joined(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text, **how)
    body = F.coalesce(F.col(KEPT), F.col(f"`{text}`"), F.lit(""))
    return rows.select(
        F.col(f"`{key}`"), F.coalesce(F.size(F.split(F.col(f"`{text}`"), "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(GONE), F.lit(0)).cast("bigint").alias("n_removed"), F.sha2(body, 256).alias("kept_sha256"),
    )
