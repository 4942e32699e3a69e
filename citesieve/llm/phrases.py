"""Phrase collocations: frequent word runs mined shard by shard at lowered support, counted exactly over all shards, scored by their weakest cut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesieve.llm.common import stage

#: A phrase is a candidate with as many occurrences in its language, and of 2 to so many words.
SUPPORT = 100
LONGEST = 5
#: Candidates of one language that are returned.
TOP = 2000
#: A candidate goes if a longer one has at least this percentage of its occurrences.
COVERED = 100
#: Words after which a task closes its shards (a longer text is one shard).
SHARD_WORDS = 1_000_000
#: A union of phrases travels as a bitmap of this size (4 MB), in chunks of 4 KB. That of a local pass has more bits (32 MB at most) from 100 million words on.
BITMAP_BITS = 25
MOST_BITS = 28
CHUNK_BITS = 15
#: Places of a shard that are looked up at a time, and counts that a local pass holds before it gives them out.
SLICE = 1 << 17
HELD = 500_000
BREAKS = re.compile(rb"[.,;:!?\n-\r]+")
U = np.uint64


class Numbers(dict):
    """Numbers words in order of appearance; a full stop, which is no word, has number 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def deflated(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def inflated(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def shards(documents: DataFrame) -> DataFrame:
    """Encoded shards (lang, n, words, length, codes): the distinct words of a shard, and its texts as word numbers from 1, with 0 between pieces.

    Marks of the words stand before the numbers in ``codes``, so a local pass does not read the words (joined by line ends, which no word has, and compressed).
    A task keeps one open shard per language and closes all of them together, so what it holds is
    bounded by SHARD_WORDS and its longest text. Codes are compressed: a task opens one shard at a time.
    """
    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = 0, {}

        def close() -> Iterator[pa.RecordBatch]:
            for lang, (words, parts) in open_.items():
                codes, marks = np.concatenate(parts), np.fromiter(map(xxhash.xxh64_intdigest, list(words)[1:]), np.uint64, len(words) - 1)
                packed = len(marks).to_bytes(4, "little") + pa.compress(marks.tobytes() + codes.tobytes(), codec="zstd", asbytes=True)  # as opened() reads it
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()), pa.array([int((codes > 0).sum())], pa.int64()), pa.array([deflated(b"\n".join(list(words)[1:]))], pa.binary()),
                     pa.array([len(codes)], pa.int32()), pa.array([packed], pa.binary())],
                    names=["lang", "n", "words", "length", "codes"])

        for batch in batches:
            for lang, text in ((lang, text) for low in range(0, batch.num_rows, 256) for part in (batch.slice(low, 256),)
                               for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist())):
                if lang not in open_:
                    open_[lang] = Numbers(), []
                words, parts = open_[lang]
                found = BREAKS.sub(b" . ", text.lower()).split()  # bytes: only A-Z change, only blanks split; no word is a full stop
                found.append(b".")
                parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held >= SHARD_WORDS:
                    yield from close()
                    held, open_ = 0, {}
        yield from close()

    return rows.mapInArrow(run, "lang string, n long, words binary, length int, codes binary")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spot(marks: np.ndarray, size: int | None = None) -> np.ndarray:
    """The bit of each mark in a bitmap of ``size`` bits, as a power of two."""
    return (mix(marks) >> U(64 - (size or BITMAP_BITS))).astype(np.int64)


def joined(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Marks of phrases from those of the phrases without their last and without their first word."""
    return mix(first * U(0x9E3779B97F4A7C15) + mix(rest + U(0xD1B54A32D192ED03)))


def marks_of(phrases: list[bytes]) -> np.ndarray:
    """Marks of whole phrases (words joined by spaces), as the shards make them level by level."""
    out, split = np.zeros(len(phrases), np.uint64), [p.split(b" ") for p in phrases]
    for size in set(map(len, split)):
        at = [i for i, w in enumerate(split) if len(w) == size]
        found = np.array([list(map(xxhash.xxh64_intdigest, split[i])) for i in at], np.uint64)
        while found.shape[1] > 1:
            found = joined(found[:, :-1], found[:, 1:])
        out[at] = found[:, 0]
    return out


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def holds(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return is_set(bits, spot(marks, (8 * len(bits)).bit_length() - 1))


def level_of(marks: np.ndarray, codes: np.ndarray, frequent: list[np.ndarray], union: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where a shard has phrases one word longer than the bitmaps ``frequent`` reach, and the mark of each; of those that ``union`` marks, if there is one.

    A phrase of k words is made where the phrases of k - 1 words at its place and at the next both
    are marked as frequent in the language. A slice of places is looked up at a time, with the words
    that follow it, so arrays of all places hold results only.
    """
    known = np.r_[False, holds(frequent[0], marks) if frequent else np.ones(len(marks), bool)]
    out = []
    for low in range(0, len(codes), SLICE):
        part = codes[low:low + SLICE + len(frequent)]
        places = np.flatnonzero(known[part])
        found = marks[part[places] - 1]
        for i in range(len(frequent)):
            if i:
                good = holds(frequent[i], found)
                places, found = places[good], found[good]
            both = np.flatnonzero(np.diff(places) == 1)
            places, found = places[both], joined(found[both], found[both + 1])
        good = places < SLICE
        if union is not None:
            good &= holds(union, found)
        out.append(((places[good] + low).astype(np.int32), found[good]))
    return (np.concatenate([p for p, _ in out]), np.concatenate([f for _, f in out])) if out else (np.zeros(0, np.int32), np.zeros(0, np.uint64))


def opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks of a shard's words, and its codes."""
    packed = batch.column("codes")[i].as_buffer()
    words, length = int.from_bytes(packed[:4].to_pybytes(), "little"), batch.column("length")[i].as_py()
    data = pa.decompress(packed[4:], 8 * words + 4 * length, codec="zstd")
    return np.frombuffer(data, np.uint64, words), np.frombuffer(data, np.int32, length, 8 * words)


class Bitmap:
    """Set bits gathered in a task and given out in chunks."""

    def __init__(self):
        self.bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)

    def set(self, at: np.ndarray) -> None:
        np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def chunks(self) -> pa.RecordBatch:
        parts = self.bits.reshape(-1, 1 << (CHUNK_BITS - 3))
        used = np.flatnonzero(parts.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["chunk", "bits"])


def united(marked: DataFrame, size: int | None = None) -> np.ndarray:
    """The union of task bitmaps (chunk, bits) of ``size`` bits, as a power of two."""
    bits = np.zeros((1 << ((size or BITMAP_BITS) - CHUNK_BITS), 1 << (CHUNK_BITS - 3)), np.uint8)
    for row in marked.groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow().to_pylist():
        bits[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def locally_frequent(encoded: DataFrame, frequent: list, support: int, size: int | None = None) -> DataFrame:
    """Bitmaps of the phrases whose count reaches the shard's share of ``support`` somewhere (support * n / total, rounded up) and that can reach it in all.

    A phrase with ``support`` occurrences reaches that share in one shard at least, so none is missed.
    A share of one occurrence prunes nothing, so shards also give out how often they have the phrases
    of each bit: where the sum of a bit stays below ``support``, so does each phrase of it.
    """
    size = size or BITMAP_BITS
    kind, shift = np.min_scalar_type(2 * support + 1), (2 * support + 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def given() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            bits, values = keys >> shift, keys & ((1 << shift) - 1)
            del keys
            starts = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1]])
            sums = np.minimum(np.add.reduceat(values >> 1, starts), support)
            values, bits = (2 * sums + np.bitwise_or.reduceat(values & 1, starts)).astype(kind), bits[starts]
            chunks, place = bits >> CHUNK_BITS, (bits & ((1 << CHUNK_BITS) - 1)).astype(np.uint16)
            cuts = np.r_[np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]]), len(chunks)]
            yield pa.RecordBatch.from_arrays([pa.array(chunks[cuts[:-1]], pa.int64()),
                                              pa.array([place[a:b].tobytes() + values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["chunk", "sums"])

        for batch in batches:
            for i in range(batch.num_rows):
                found, counts = np.unique(level_of(*opened(batch, i), [x.value for x in frequent])[1], return_counts=True)
                least = -(-support * batch.column("n")[i].as_py() // batch.column("total")[i].as_py())
                held.append(spot(found, size) << shift | 2 * np.minimum(counts, support) | (counts >= least))
                count += len(found)
                if count >= HELD:
                    yield from given()
                    count = 0
        if count:
            yield from given()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
                n = len(data) // (2 + kind.itemsize)
                place, values = np.frombuffer(data, np.uint16, n), np.frombuffer(data, kind, n, 2 * n).astype(np.int64)
                total = sums.setdefault(chunk, np.zeros((2, 1 << CHUNK_BITS), np.int32))
                total[0, place] = np.minimum(total[0, place] + (values >> 1), support)
                total[1, place] |= values & 1
        for chunk, (total, local) in sums.items():
            bits = np.packbits((total >= support) & (local > 0), bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["chunk", "bits"])

    given = encoded.select("n", "total", "length", "codes").mapInArrow(run, "chunk long, sums binary")
    return given.repartition(32 << max(0, size - BITMAP_BITS), "chunk").mapInArrow(add, "chunk long, bits binary")


def marked(phrases: DataFrame) -> DataFrame:
    """Bitmaps of whole phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Bitmap()
        for batch in batches:
            found.set(spot(marks_of(batch.column("phrase").cast(pa.binary()).to_pylist())))
        yield found.chunks()

    return phrases.select("phrase").mapInArrow(run, "chunk long, bits binary")


def counted(encoded: DataFrame, frequent: list, union) -> DataFrame:
    """(lang, phrase, n) of every phrase of every shard that ``union`` marks, whether the shard finds it frequent or not."""
    size = len(frequent) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                marks, codes = opened(batch, i)
                places, _ = level_of(marks, codes, [x.value for x in frequent], union.value)
                keys = codes[places].astype(np.int64)
                for k in range(1, size):  # numbers of the phrases so far, so that keys stay small
                    keys = np.unique(keys, return_inverse=True)[1] * (len(marks) + 1) + codes[places + k]
                _, keep, counts = np.unique(keys, return_index=True, return_counts=True)
                words, runs = pa.array(inflated(batch.column("words")[i].as_py()).split(b"\n"), pa.binary()), codes[places[keep][:, None] + np.arange(size)] - 1
                texts = pc.binary_join_element_wise(*(words.take(pa.array(runs[:, k])) for k in range(size)), b" ") if size > 1 else words.take(pa.array(runs[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("lang")[i].as_py()] * len(keep), pa.string()), texts, pa.array(counts.astype(np.int64))],
                                                 names=["lang", "phrase", "n"])

    return encoded.mapInArrow(run, "lang string, phrase binary, n long").select("lang", F.col("phrase").cast("string").alias("phrase"), "n")


def frequent_phrases(documents: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with ``support`` or more occurrences in their language, and the words of each language (lang, total).

    A phrase has lang, phrase, size, f, first and last (the phrases without its last and its first
    word), heads and tails (f of its first and last 1, 2, ... words).
    """
    context = documents.sparkSession.sparkContext
    written = stage(shards(documents).where("n > 0"), "phrases-shards")
    totals = stage(written.groupBy("lang").agg(F.sum("n").alias("total")), "phrases-totals")
    encoded = written.join(totals, "lang").select("n", "total", "lang", "words", "length", "codes")
    bits = max(BITMAP_BITS, min(MOST_BITS, ((totals.agg(F.sum("total")).first()[0] or 0) // 3).bit_length()))
    levels, frequent = [], []
    for size in range(1, longest + 1):
        union = context.broadcast(united(locally_frequent(encoded, frequent, support, bits), bits))
        sums = counted(encoded, frequent, union).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support)
        if size == 1:
            none = F.lit(None).cast("string")
            made = sums.select("*", none.alias("first"), none.alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))
        else:
            cut = F.instr("phrase", " ")
            sums = sums.withColumns({"first": F.substring_index("phrase", " ", size - 1), "last": F.substr("phrase", cut + 1)})
            head, tail = (levels[-1].select("lang", F.col("phrase").alias(c), F.col(x).alias(f"_{x}")) for c, x in (("first", "heads"), ("last", "tails")))
            made = sums.join(head, ["lang", "first"]).join(tail, ["lang", "last"]).select(
                "lang", "phrase", "f", "first", "last", F.concat("_heads", F.array("f")).alias("heads"), F.concat("_tails", F.array("f")).alias("tails"))
        levels.append(stage(made.withColumn("size", F.lit(size)), f"phrases-{size}"))
        frequent.append(context.broadcast(united(marked(levels[-1]))))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, totals


def weakest_cut(n: Column) -> Column:
    """(score, cut, l, r) of the lowest score floor(1000 * a * n / (l * r)) over all cuts, ties to the first cut; products have 38 digits."""
    def at(k: Column) -> Column:
        left, right = F.element_at("heads", k), F.element_at("tails", F.col("size") - k)
        over = (F.lit(1000).cast("decimal(4,0)") * F.col("f").cast("decimal(15,0)")).cast("decimal(18,0)") * n.cast("decimal(19,0)")
        under = left.cast("decimal(18,0)") * right.cast("decimal(19,0)")
        return F.struct(F.call_function("div", over, under).alias("score"), k.alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), at))


def mine_phrases(documents: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The best ``top`` phrases of each language of ``documents`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, those at blanks into
    words; null text is empty, null lang is ``und``. Phrases lie inside a piece; overlapping and repeated
    occurrences and repeated rows all count. Ties are broken by occurrences, then by phrase in byte
    order. Languages without candidates have no rows; an empty table has none. Other columns are not
    read. ``top`` is the feature's limit; nothing else is limited.

    SON, level by level: every shard is mined for the k-word phrases that reach its share of the
    support, their union (a bitmap of bounded size) goes back to all shards, and what it marks is
    counted exactly over all of them; counts below the support fall away. A shard's share falls to
    one occurrence when a language has more shards than the support, and then a local pass prunes
    nothing; so a k-word phrase is only tried where both its (k-1)-word parts are marked as frequent
    in the whole language, and a bit is left out of the union if its sum over all shards stays below
    the support, which bounds the rows of a level at any number of shards. Phrases are
    counted by their words; hashes only pick bits, and a bit too many costs rows, not results.
    """
    found, totals = frequent_phrases(documents, support, longest)
    candidates = found.where("size > 1")
    longer = candidates.where("size > 2").select("lang", F.explode(F.array("first", "last")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
    scored = free.join(totals, "lang").withColumn("c", weakest_cut(F.col("total")))
    best = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("f"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "c.l", "c.r", F.col("total").alias("n"),
                         F.col("c.score").alias("score"))
