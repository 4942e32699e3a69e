"""Repeated byte strings of a corpus: suffixes sampled at hash minima, the others sorted by induction with common-prefix values.

The suffixes that start at anchors (positions whose hash of the next ``KERNEL`` bytes is the least of
a window) are the sample that is sorted first. Anchors depend on content only, so equal strings
have their anchors at equal places, and the kernel's hash deals equal suffixes to one shard wherever
they stand. Inside a shard the suffixes left of an anchor are sorted by induction: the order of
(preceding byte, rank of the suffix after it), with the common-prefix length of neighbours carried
as 1 + the least value between them. Two neighbours with ``LENGTH`` bytes in common are a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesieve.llm.common import stage

LENGTH = 400
KERNEL = 300
#: Longest piece of a text that is hashed at once, in bytes, and rows that a shard sorts at once.
PIECE = 1 << 20
ROWS = 20_000
#: Largest kernel group that one task sorts; the windows of a larger one are counted as hashed rows instead.
GROUP = 100_000
BUCKETS = 1 << 18
U = np.uint64
BASE = 0x9E3779B97F4A7C15
BARRIER = -(1 << 30)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hasher:
    """Hashes of any part of a byte string in constant time, by prefix sums of scrambled bytes times powers."""

    def __init__(self, size: int):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))
        up = np.full(size + 1, U(BASE))
        down = np.full(size + 1, U(pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.table[data] * self.up[:len(data)], out=out[1:])
        return out

    def part(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (sums[high] - sums[low]) * self.down[low]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, by running minima inside blocks of the window's width."""
    n, full = len(x) - width + 1, -(-len(x) // width) * width
    blocks = np.full(full, U(0xFFFFFFFFFFFFFFFF))
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, hasher: Hasher, length: int = LENGTH, kernel: int = KERNEL, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, kernel hash, neighbourhood hash) of the anchors of one text.

    Every window of ``length`` bytes holds an anchor with its kernel, the least kernel hash in it. The
    neighbourhood is all that such windows can reach, cut at the ends of the text; the cuts are part of its hash.
    """
    n, width = len(data), length - kernel + 1
    side, out = length - kernel, []
    for start in range(0, n - length + 1, piece):
        end = min(start + piece, n - length + 1)
        low, high = max(0, start - side), min(n, end - 1 + length + side)
        sums = hasher.sums(data[low:high])
        at = np.arange(start, end - 1 + width) - low
        values = mix(hasher.part(sums, at, at + kernel))
        least = sliding_min(values, width)
        padded = np.zeros(len(least) + 2 * (width - 1), U)
        padded[width - 1:width - 1 + len(least)] = least
        chosen = np.flatnonzero(~sliding_min(~padded, width) == values)
        place = chosen + start
        left, right = np.maximum(place - side, 0), np.minimum(place + length, n)
        cuts = mix((place - left).astype(U) * U(1 << 20) + (right - place).astype(U))
        out.append((place, values[chosen], mix(hasher.part(sums, left - low, right - low) + cuts)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    place, value, around = (np.concatenate(x) for x in zip(*out))
    place, first = np.unique(place, return_index=True)
    return place, value[first], around[first]


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both included and low <= high, for many ranges."""
    levels = [values]
    span = int((high - low).max()) + 1 if len(low) else 1
    while 2 << (len(levels) - 1) <= span:
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-step], last[step:]))
    k = np.frexp(high - low + 1)[1] - 1
    out = np.empty(len(low), values.dtype)
    for level in np.unique(k):
        m = k == level
        out[m] = np.minimum(levels[level][low[m]], levels[level][high[m] - (1 << int(level)) + 1])
    return out


def induce(groups: np.ndarray, left: list[bytes], right: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the least and the greatest count of bytes before its anchor at which a window with
    ``side`` bytes outside the kernel repeats in another row of its group; -1 where none does.

    ``groups`` are ascending numbers. Suffixes at the anchors are sorted by what follows the kernel;
    then one byte after the other is put before them. Rows whose text begins earlier leave.
    """
    n = len(groups)
    size = np.array([len(r) for r in right])
    after = np.frombuffer(b"".join(r.ljust(side, b"\0") for r in right), np.uint8).reshape(n, side) if side else np.zeros((n, 0), np.uint8)
    depth = np.array([len(x) for x in left])
    before = np.frombuffer(b"".join(x[::-1].ljust(side, b"\0") for x in left), np.uint8).reshape(n, side) if side else np.zeros((n, 0), np.uint8)
    key = np.ascontiguousarray(np.concatenate([after, (size[:, None] >> np.array([8, 0])) & 255], axis=1).astype(np.uint8)).view(f"V{side + 2}").ravel()
    order = np.lexsort((np.unique(key, return_inverse=True)[1].ravel(), groups)) if side else np.argsort(groups, kind="stable")
    same = groups[order][1:] == groups[order][:-1]
    unlike = after[order[1:]] != after[order[:-1]]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), side) if side else np.zeros(n - 1, int)
    common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
    prefix = np.full(n, BARRIER, np.int64)
    prefix[1:] = np.where(same, common, BARRIER)
    low, high = np.full(n, -1), np.full(n, -1)
    for l in range(side + 1):
        repeats = prefix >= side
        hit = repeats.copy()
        hit[:-1] |= repeats[1:]
        rows = order[hit]
        low[rows] = np.where(low[rows] < 0, l, low[rows])
        high[rows] = l
        if l == side:
            break
        kept = np.flatnonzero(depth[order] > l)
        if len(kept) < 2:
            break
        rows = order[kept]
        sorted_ = np.argsort(groups[rows].astype(np.int64) * 256 + before[rows, l], kind="stable")
        places, rows = kept[sorted_], rows[sorted_]
        fresh = np.zeros(len(rows), np.int64)
        alike = (groups[rows][1:] == groups[rows][:-1]) & (before[rows, l][1:] == before[rows, l][:-1])
        edge = groups[rows][1:] != groups[rows][:-1]
        a, b = places[:-1][alike] + 1, places[1:][alike]
        step = np.where(edge, BARRIER, 0)
        step[alike] = _range_min(prefix, a, b) + 1
        fresh[1:], fresh[0] = step, BARRIER
        order, prefix = rows, fresh
    return low, high


def _text_key() -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id"), F.hash(text).alias("mark"), F.encode(text, "UTF-8").alias("bytes")]


def find_anchors(texts: DataFrame, length: int, kernel: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE + 4 * length)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = [anchors(np.frombuffer(b.as_buffer(), np.uint8), hasher, length, kernel) for b in part.column("bytes")]
                rows = np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found])
                place, value, around = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), part.column("mark").take(pa.array(rows)), pa.array(place.astype(np.int32)),
                     pa.array(value.view(np.int64)), pa.array(around.view(np.int64))], names=["doc_id", "mark", "place", "kernel", "around"])

    return texts.mapInArrow(run, "doc_id long, mark int, place int, kernel long, around long")


def repeated_parts(documents: DataFrame, length: int = LENGTH, kernel: int = KERNEL, group: int = GROUP) -> DataFrame:
    """(doc_id, mark, low, high): parts of texts covered by repeated strings, one or more rows per anchor that lies in any.

    Anchors whose whole neighbourhood occurs twice are settled by that. One anchor of every other
    neighbourhood goes on to its shard if its kernel has several. Rows of a kernel meet in one
    sorted partition, read in a stream, unless the kernel stands out in fixed-size counts.
    """
    side = length - kernel
    texts = documents.select(*_text_key())
    found = stage(find_anchors(texts, length, kernel), "suffix-anchors")
    bucket = F.pmod("kernel", F.lit(BUCKETS)).cast("int")
    counts = found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    mean = found.count() / BUCKETS
    heavy = stage(counts.where(F.col("n") > mean + 8 * mean ** 0.5 + 64).select("bucket", F.lit(True).alias("heavy")), "suffix-heavy")
    dealt = found.withColumn("bucket", bucket).join(heavy, "bucket", "left").drop("bucket")
    order = Window.partitionBy("kernel").orderBy("around")
    seen = dealt.where("heavy is null").select(
        "doc_id", "mark", "place", "kernel", "around", F.lag("around").over(order).alias("prev"), F.lead("around").over(order).alias("next"),
        F.first("around").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("first"))
    twice = F.coalesce(F.col("prev") == F.col("around"), F.lit(False)) | F.coalesce(F.col("next") == F.col("around"), F.lit(False))
    last = F.col("next").isNull() | (F.col("next") != F.col("around"))
    several = F.col("next").isNotNull() | (F.col("first") != F.col("around"))
    few = seen.select("doc_id", "mark", "place", "kernel", twice.alias("twice"), (last & several).alias("edge")).where("twice or edge")
    # a kernel that stands out is counted with partial sums, and the counts are joined back
    many = dealt.where("heavy").withColumn("id", F.xxhash64("doc_id", "mark", "place"))
    classes = stage(many.groupBy("kernel", "around").agg(F.count("*").alias("n"), F.min("id").alias("one")), "suffix-classes")
    told = many.join(classes, ["kernel", "around"]).select("doc_id", "mark", "place", "kernel", (F.col("n") > 1).alias("twice"), (F.col("id") == F.col("one")).alias("edge"))
    marked = stage(few.union(told), "suffix-marked")
    settled = marked.where("twice").select("doc_id", "mark", F.greatest(F.lit(0), F.col("place") - side).alias("low"), (F.col("place") + length).alias("high"))

    edges = marked.where("edge").select("doc_id", "mark", "place", "kernel", "twice")
    per = edges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("place", "kernel", "twice")).alias("edges"))
    placed = texts.join(per, texts["doc_id"].eqNullSafe(per["doc_id"]) & (texts["mark"] == per["mark"])).select(per["doc_id"], per["mark"], "bytes", "edges")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "place", "kernel", "twice", "before", "after"]
        kinds = pa.schema([("doc_id", pa.int64()), ("mark", pa.int32()), ("place", pa.int32()), ("kernel", pa.int64()), ("twice", pa.bool_()),
                           ("before", pa.binary()), ("after", pa.binary())])
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(low, 64).to_pylist():
                    data = r["bytes"]
                    rows += [(r["doc_id"], r["mark"], p, e["kernel"], e["twice"], data[max(0, p - side):p], data[p + kernel:p + length])
                             for e in r["edges"] for p in (e["place"],)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], names=names)

    contexts = stage(placed.mapInArrow(around, "doc_id long, mark int, place int, kernel long, twice boolean, before binary, after binary"), "suffix-contexts")
    large = stage(contexts.groupBy("kernel").count().where(F.col("count") > group).select("kernel", F.lit(True).alias("large")), "suffix-large")
    split = contexts.join(large, "kernel", "left")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: pa.Table) -> pa.RecordBatch:
            kernels = rows.column("kernel").to_numpy()
            numbers = np.cumsum(np.r_[0, kernels[1:] != kernels[:-1]])
            low, high = induce(numbers, rows.column("before").to_pylist(), rows.column("after").to_pylist(), side)
            hit = np.flatnonzero((low >= 0) & ~rows.column("twice").to_numpy())
            place = rows.column("place").to_numpy()[hit]
            taken = rows.take(pa.array(hit)).combine_chunks()
            columns = [taken.column(c).combine_chunks() if taken.num_rows else pa.array([], k) for c, k in (("doc_id", pa.int64()), ("mark", pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array((place - high[hit]).astype(np.int32)), pa.array((place + length - low[hit]).astype(np.int32))],
                                              names=["doc_id", "mark", "low", "high"])

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= ROWS:
                table = pa.Table.from_batches(held)
                kernels = table.column("kernel").to_numpy()
                cut = int(np.searchsorted(kernels, kernels[-1]))
                if cut:
                    yield solved(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    count = table.num_rows - cut
        if count:
            yield solved(pa.Table.from_batches(held))

    small = split.where("large is null").select("kernel", "doc_id", "mark", "place", "twice", "before", "after")
    small = small.repartition("kernel").sortWithinPartitions("kernel").mapInArrow(sort, "doc_id long, mark int, low int, high int")

    # groups beyond the limit: every window as a hash of (kernel, bytes before, bytes after), counted with partial sums
    each = split.where("large").select("doc_id", "mark", "place", "twice", "kernel", "before", "after", F.explode(F.sequence(F.lit(0), F.lit(side))).alias("l"))
    fits = each.where((F.length("before") >= F.col("l")) & (F.length("after") >= side - F.col("l")))
    string = F.concat(F.substring(F.col("before"), F.length("before") - F.col("l") + 1, F.col("l")), F.substring(F.col("after"), F.lit(1), side - F.col("l")))
    windows = stage(fits.select("doc_id", "mark", "place", "twice", "l", F.sha2(F.concat(F.encode(F.concat_ws(":", "kernel", "l"), "UTF-8"), string), 256).alias("w")), "suffix-windows")
    again = stage(windows.groupBy("w").count().where("count > 1").select("w"), "suffix-again")
    rest = windows.where("not twice").join(again, "w", "left_semi").groupBy("doc_id", "mark", "place").agg(F.min("l").alias("a"), F.max("l").alias("b"))
    rest = rest.select("doc_id", "mark", (F.col("place") - F.col("b")).alias("low"), (F.col("place") + length - F.col("a")).alias("high"))
    return settled.union(small).union(rest)


def suffix_dedup(documents: DataFrame, length: int = LENGTH, kernel: int = KERNEL, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, spans (array of (start, end) in bytes) and kept (binary) per row of ``documents`` (doc_id, text).

    A byte goes if it lies in a string of ``length`` bytes that starts at two places or more of the
    corpus. Null texts are empty. Texts shorter than ``length`` stay whole. Rows that repeat a doc_id
    and its text repeat each other and lose all such strings. Other columns are not read; an empty
    table gives an empty result. Strings are told apart by 64-bit hashes of their kernel and
    neighbourhood, and by their bytes around the kernel.
    """
    parts = stage(repeated_parts(documents, length, kernel, group).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("low", "high")).alias("parts")), "suffix-parts")
    texts = documents.select(*_text_key())
    joined = texts.join(parts, texts["doc_id"].eqNullSafe(parts["doc_id"]) & (texts["mark"] == parts["mark"]), "left")
    joined = joined.select(texts["doc_id"], "bytes", "parts")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans, kept = [], []
                for data, found in zip(part.column("bytes").to_pylist(), part.column("parts").to_pylist()):
                    merged: list[list[int]] = []
                    for low, high in sorted((p["low"], min(p["high"], len(data))) for p in found or ()):
                        if merged and low <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], high)
                        else:
                            merged.append([low, high])
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    ends = [0, *(x for s in merged for x in s), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in part.column("bytes").to_pylist()], pa.int64()),
                                                  pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
