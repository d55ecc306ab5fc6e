"""Removal of byte strings which occur more than once in a corpus, by merging Burrows-Wheeler transforms of shards.

A byte goes if it lies in a string of ``span`` bytes which also starts anywhere else.  Suffixes need to be compared only where a repeat
can be, so the texts are cut first: of every window of ``span`` bytes the ``gram`` with the smallest hash is an anchor, and equal
windows have equal anchors.  A context is an anchor with the bytes on both sides which a window round it may have.

* Contexts which occur twice as a whole are known from their counts alone.
* Anchors with several contexts are compared byte by byte.  All contexts of an anchor are aligned, so their suffixes are sorted one column
  at a time, from the right: the transform of a column is the column's bytes in the order of the suffixes behind it.  Every
  shard of contexts has its own transform.  Shards are merged by refining an interleave, the sequence of shard numbers in the
  merged order: a column's bytes are read through it, shard by shard, and a stable partition by byte is the interleave of the next
  column.  Common prefixes grow by one with each column and take the minimum over what lies between.  No suffix is sorted
  again.  Neighbours with a common prefix of ``span`` bytes are repeats.
* An anchor with more than ``group`` contexts, such as a passage which a large part of the corpus has, is no task's work: the
  windows of its contexts are counted by 128-bit digests, pre-aggregated, which gives the same result.

All windows of an anchor overlap, so a context loses one interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.llm.common import Written
from khata.llm.hashing import mixed

SPAN, GRAM = 200, 40
#: Contexts of an anchor which are merged, at most; contexts of a task and of a shard, about.
GROUP, TASK, SHARD = 20000, 20000, 4096
#: Slots of the filters for anchors which occur more than once: a megabyte each, whatever the input.
SLOTS = 1 << 23
PAD = 255  # no byte of UTF-8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of the hash base and of its inverse, as many as were needed so far."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, INVERSE)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes in a row."""
    up, down = Powers.to(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * up, dtype=np.uint64)])
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash in any ``window`` hashes in a row, the first one of equals."""
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    whole = -(-len(ranked) // window) * window
    rows = np.full(whole, np.uint64(0xFFFFFFFFFFFFFFFF))
    rows[: len(ranked)] = ranked
    rows = rows.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = len(ranked) - window + 1
    least = np.minimum(back[:count], ahead[window - 1 : window - 1 + count])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def contexts(data: bytes, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(places, hashes, context digests) of the anchors of a text; none for a text shorter than ``span``."""
    from xxhash import xxh3_64_intdigest

    if len(data) < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram)
    side = span - gram
    at = anchors(hashes, side + 1)
    # The digest also says how much there is on the left, where a text may begin.
    digests = [xxh3_64_intdigest(data[max(a - side, 0) : a + span], min(a, side)) for a in at.tolist()]
    return at, hashes[at].view(np.int64), digests


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _counted(span: int, gram: int):
    """(h, c, n): the contexts of a batch, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests = [np.empty(0, np.int64)], []
            for text in batch.column("text"):
                _, h, c = contexts((text.as_py() or "").encode(), span, gram)
                found.append(h)
                digests += c
            pairs = np.stack([np.concatenate(found), np.array(digests, np.uint64).view(np.int64)], axis=1)
            kinds, n = np.unique(pairs, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[:, 0]), pa.array(kinds[:, 1]), pa.array(n)], ["h", "c", "n"])

    return run


def _marked(span: int, gram: int, repeated: bytes, several: bytes):
    """Anchors which may occur again (``shown`` false), and once for each batch the bytes of contexts of anchors which may have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little") for x in (repeated, several)]
        side, names = span - gram, ["id", "version", "h", "c", "at", "before", "after", "bytes", "shown"]
        for batch in batches:
            owner, hs, digests, shown, sizes, seen = [], [], [], [], [], set()

            def put(i, h, c, at, before, after, data, lists=(owner, hs, digests, sizes, shown)):
                for values, value in zip(lists, (i, h, c, (at, before, after), data), strict=True):
                    values.append(value)

            for i, text in enumerate(batch.column("text")):
                data = (text.as_py() or "").encode()
                at, h, c = contexts(data, span, gram)
                slots = h & (SLOTS - 1)
                with_bytes = bits[1][slots]
                for k in np.flatnonzero(bits[0][slots]).tolist():
                    a, name = int(at[k]), (int(h[k]), c[k])
                    put(i, *name, a, min(a, side), min(len(data) - a, span), None)
                    if with_bytes[k] and name not in seen:
                        seen.add(name)
                        put(None, *name, a, min(a, side), min(len(data) - a, span), data[max(a - side, 0) : a + span])
            take = pa.array(owner, pa.int32())
            sizes = np.array(sizes, np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("version").take(take), pa.array(hs, pa.int64()), _signed(digests), *(pa.array(sizes[:, j]) for j in range(3)), pa.array(shown, pa.binary()), pa.array([x is not None for x in shown], pa.bool_())],
                names,
            )

    return run


def _bits(slots: DataFrame) -> bytes:
    """A filter of SLOTS bits, set where the column ``h`` has a value; a fixed number of bytes comes to the driver."""
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1)) + 1  # the functions number positions from one
    words = slots.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("b"))
    out = bytearray(SLOTS // 8 + 8192)
    for row in words.collect():
        start = (row["n"] - 1) * 4096
        out[start : start + 4096] = row["b"]
    return bytes(out)


class Shard:
    """Aligned contexts of some anchors, and their transform column by column, from the right."""

    def __init__(self, rows: np.ndarray, group: np.ndarray) -> None:
        self.rows, self.group = rows, group  # the groups are in ascending order
        self.order = np.arange(len(rows))

    def column(self, j: int) -> np.ndarray:
        """The bytes of column j in the order of the suffixes behind it; then the order is that from j on."""
        symbols = self.rows[self.order, j]
        self.order = self.order[partition(symbols, self.group)]
        return symbols


def partition(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A stable sort by symbol within each group; ``group`` numbers are in place and below 2 ** 16."""
    by = np.argsort(symbols, kind="stable")
    return by[np.argsort(group[by], kind="stable")]


def refined(common: np.ndarray, moved: np.ndarray, symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours after a column: one more than the least between them, zero for other bytes or groups."""
    same = (symbols[moved][1:] == symbols[moved][:-1]) & (group[1:] == group[:-1])
    out = np.zeros_like(common)
    at = np.flatnonzero(same) + 1
    if len(at):
        edges = np.stack([moved[at - 1] + 1, moved[at] + 1], axis=1).reshape(-1)
        least = np.minimum.reduceat(np.append(common, np.int16(0)), edges)[::2]
        out[at] = least + 1
    return out


def repeated_starts(
    rows: np.ndarray, group: np.ndarray, side: int, span: int, shard: int = SHARD, low: np.ndarray | None = None, high: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) column at which each row has ``span`` bytes in common with another row of its group; -1 without any.

    ``rows`` are aligned contexts, ``group`` numbers them from 0, below 2 ** 16.  Only columns from ``low`` to ``high`` of a row
    count: padding may be equal, too, and a window has to lie in the text.
    """
    n, width = rows.shape
    low = np.zeros(n, np.int64) if low is None else low
    high = np.full(n, side) if high is None else high
    owner = np.arange(n) // shard  # a shard is what came together
    order = np.lexsort((owner, group))  # by group, the shards in turn: the interleave before any column
    group = group[order].astype(np.uint16)
    interleave = owner[order].astype(np.uint16)
    members = [order[interleave == s] for s in range(-(-n // shard))]
    shards = [Shard(rows[m], group[interleave == s]) for s, m in enumerate(members)]
    common = np.zeros(n, np.int16)
    first, last = np.full(n, -1), np.full(n, -1)
    for j in range(width - 1, -1, -1):
        symbols = np.empty(n, np.uint8)
        for s, part in enumerate(shards):
            symbols[interleave == s] = part.column(j)
        moved = partition(symbols, group)
        common = refined(common, moved, symbols, group)
        interleave = interleave[moved]
        if j <= side:
            long = common >= span
            hit = long | np.append(long[1:], False)
            if hit.any():
                for s, part in enumerate(shards):
                    at = members[s][part.order[hit[interleave == s]]]
                    at = at[(low[at] <= j) & (j <= high[at])]
                    first[at] = j
                    last[at] = np.where(last[at] < 0, j, last[at])
    return first, last


def _aligned(frame: pd.DataFrame, span: int, gram: int) -> np.ndarray:
    side = span - gram
    rows = np.full((len(frame), side + span), PAD, np.uint8)
    for i, (before, shown) in enumerate(zip(frame["before"], frame["bytes"], strict=True)):
        rows[i, side - before : side - before + len(shown)] = np.frombuffer(shown, np.uint8)
    return rows


def _merged(span: int, gram: int, shard: int):
    """For a task's contexts: (h, c, lo, hi), the interval round the anchor which goes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        side = span - gram
        group = pd.factorize(frame["h"])[0]
        out = []
        for low in range(0, int(group.max()) + 1, 1 << 16):  # numbers of groups have 16 bits
            part = (group >= low) & (group < low + (1 << 16))
            few = frame[part]
            begin, end = side - few["before"].to_numpy(), side + few["after"].to_numpy() - span
            first, last = repeated_starts(_aligned(few, span, gram), group[part] - low, side, span, shard, begin, end)
            some = last >= 0
            out.append(pd.DataFrame({"h": few["h"][some], "c": few["c"][some], "lo": first[some] - side, "hi": last[some] - side + span}))
        return pd.concat(out)

    return run


def _windows(span: int, gram: int):
    """A row for every window of a context: its first place, seen from the anchor, and two 64-bit digests."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = (batch.column(x).to_numpy() for x in "hc")
            for at in range(0, len(h), 2000):
                owner, starts, digests = [], [], []
                for i in range(at, min(at + 2000, len(h))):
                    shown, before = batch.column("bytes")[i].as_py(), batch.column("before")[i].as_py()
                    for s in range(len(shown) - span + 1):
                        if s - before > 0:
                            break
                        owner.append(i), starts.append(s - before), digests.append(xxh3_128_digest(shown[s : s + span]))
                yield pa.RecordBatch.from_arrays([pa.array(h[owner]), pa.array(c[owner]), pa.array(starts, pa.int32()), pa.array(digests, pa.binary())], ["h", "c", "s", "d"])

    return run


def intervals(docs: DataFrame, place: Written, span: int, gram: int, group: int, task: int, shard: int) -> DataFrame:
    """(id, version, cuts): for each text what goes, as overlapping intervals of bytes; ``docs`` has id, version and text."""
    places = docs.select("text").mapInArrow(_counted(span, gram), "h bigint, c bigint, n bigint")
    counted = place.table(places.groupBy("h", "c").agg(F.sum("n").alias("n")), "counted")
    # Contexts of an anchor never meet in one task: they are counted in parts, and the join splits an anchor which has many.
    of_anchor = counted.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    classes = place.table(counted.join(of_anchor, "h"), "classes")
    place.drop("counted")
    marked = _marked(span, gram, _bits(classes), _bits(classes.where("kinds > 1")))
    kind = docs.schema["id"].dataType.simpleString()
    both = docs.select("id", "version", "text").mapInArrow(marked, f"id {kind}, version bigint, h bigint, c bigint, at int, before int, after int, bytes binary, shown boolean")
    found, shown = place.parted(both, "found", "shown")
    contexts_ = place.table(shown.groupBy("h", "c").agg(F.first("before").alias("before"), F.first("after").alias("after"), F.first("bytes").alias("bytes")), "contexts")
    place.drop("found/shown=true")
    # Whole contexts: every window in them occurs again.
    whole = classes.where("n > 1").select("h", "c", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    count = classes.where("kinds > 1").count()
    hot = classes.where(F.col("kinds") > group).select("h").distinct()
    bucket = F.pmod(F.xxhash64("h"), F.lit(-(-count // task) or 1))
    small = contexts_.join(hot, "h", "left_anti").withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
        _merged(span, gram, shard), "h bigint, c bigint, lo int, hi int"
    )
    windows = place.table(contexts_.join(hot, "h", "left_semi").select("h", "c", "before", "bytes").mapInArrow(_windows(span, gram), "h bigint, c bigint, s int, d binary"), "windows")
    # One place may have several anchors: windows are equal if they also lie alike round the same anchor.
    again = windows.groupBy("h", "s", "d").agg(F.count("*").alias("n")).where("n > 1")
    large = windows.join(again, ["h", "s", "d"], "left_semi").groupBy("h", "c").agg(F.min("s").alias("lo"), (F.max("s") + span).alias("hi"))
    # A context may be known as a whole and in part: the whole is the larger one.
    parts = place.table(small.unionByName(large).join(whole.select("h", "c"), ["h", "c"], "left_anti").unionByName(whole), "parts")
    place.drop("contexts")
    lo, hi = F.coalesce("lo", -F.col("before")), F.coalesce("hi", "after")
    cuts = found.drop("bytes").join(parts, ["h", "c"]).where(hi - lo >= span).select("id", "version", F.struct((F.col("at") + lo).alias("a"), (F.col("at") + hi).alias("b")).alias("cut"))
    out = place.table(cuts.groupBy("id", "version").agg(F.collect_set("cut").alias("cuts")), "cuts")
    for name in ("classes", "found", "windows", "parts"):
        place.drop(name)
    return out


def kept_bytes(data: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What stays of a text, and the number of runs that go."""
    out, at, runs, end = [], 0, 0, -1
    for a, b in sorted(cuts):
        if a > end:
            runs += 1
            out.append(data[at:a])
        end = max(end, b)
        at = end
    return b"".join([*out, data[at:]]), runs


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, group: int = GROUP, task: int = TASK, shard: int = SHARD) -> DataFrame:
    """Per row of ``docs``: key, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes).

    Null and empty texts have no bytes.  Repeated rows are documents each, so a text of ``span`` bytes in two rows goes from
    both.  A cut may part a character, so what is kept is bytes.  An empty table gives an empty one; other columns are not read.
    """
    place = Written(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(body).alias("version"), body.alias("text"))
    cuts = intervals(source, place, span, gram, group, task, shard).select(F.col("id").alias("_id"), F.col("version").alias("_version"), "cuts")
    joined = source.join(cuts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")

    @F.arrow_udf("struct<kept: binary, runs: bigint>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            kept, runs = [], []
            for t, spans in zip(texts, lists, strict=True):
                stays, n = kept_bytes(t.as_py().encode(), [(s["a"], s["b"]) for s in spans.as_py() or []])
                kept.append(stays), runs.append(n)
            yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(runs, pa.int64())], ["kept", "runs"])

    size = F.octet_length("text").cast("bigint")
    return joined.select("id", "text", cut("text", "cuts").alias("cut")).select(
        F.col("id").alias(key), size.alias("n_bytes"), (size - F.octet_length("cut.kept")).alias("n_removed"), F.col("cut.runs").alias("n_spans"), F.col("cut.kept").alias("kept"),
    )
