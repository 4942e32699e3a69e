"""How corpus filters interact: word filters read from a sparse document-term matrix, counted over every order of application."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesieve.llm.common import stage

#: A: fewer words than this.
MIN_WORDS = 200
#: B: fewer distinct words than this percentage of the words.
MIN_DISTINCT = 50
#: C: more capitals than this percentage of the characters.
MAX_CAPITALS = 3
#: D: any of these characters.
SYMBOLS = "[#$%&*|]"
LETTERS = "ABCDE"
#: Bytes of text after which a task closes a shard of the matrix (a longer text is a shard alone).
SHARD_BYTES = 16 << 20
#: Hash buckets in which words are numbered; a bucket's distinct words are in one task's memory.
WORD_BUCKETS = 1 << 14

CAPITALS = bytes(range(65, 91))
CONTINUATIONS = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character
MARKED = re.compile(SYMBOLS.encode())
CARRIED = ["doc_id long", "part string", "other int", "digest binary"]
NAMES = [c.split()[0] for c in CARRIED]
ROWS = ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in CARRIED) + ", starts array<int>"


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def other_flags(text: bytes) -> int:
    """The filters C and D of a text, as bits 2 and 3."""
    capitals = len(text) - len(text.translate(None, CAPITALS))
    characters = len(text.translate(None, CONTINUATIONS))
    return 4 * (100 * capitals > MAX_CAPITALS * characters) + 8 * bool(MARKED.search(text))


def gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending numbers of every row as differences; the first of a row stays."""
    out = values.copy()
    out[1:] -= values[:-1]
    first = starts[:-1][np.diff(starts) > 0]
    out[first] = values[first]
    return out


def from_gaps(differences: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.cumsum(differences, dtype=np.int64)
    lengths = np.diff(starts)
    first = starts[:-1][lengths > 0]
    return total - np.repeat(total[first] - differences[first], lengths[lengths > 0])


def in_rows(values: np.ndarray, starts: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """``values`` ascending inside every row, and the arrays beside them in the same order."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(row * (int(values.max(initial=0)) + 1) + values) if len(values) else row
    return [x[order] for x in (values, *more)]


def local_shards(documents: DataFrame) -> DataFrame:
    """Shards of the document-term matrix with words numbered inside the shard; each text is read and split once.

    A shard is one row (``bucket`` null) with the columns of its documents, starts, codes (as gaps)
    and counts, and a row per hash bucket with the words of the bucket (joined by spaces) and their codes.
    """
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        words, docs, starts, codes, counts, held = Numbers(), [], array("i", [0]), array("i"), array("i"), 0

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in SCHEMA], schema=SCHEMA)

        def close() -> Iterator[pa.RecordBatch]:
            at = np.asarray(starts, np.int32)
            code, count = in_rows(np.asarray(codes, np.int32), at, np.asarray(counts, np.int32))
            lists = {name: pa.array([[d[i] for d in docs]], SCHEMA.field(name).type) for i, name in enumerate(NAMES)}
            lists |= {name: pa.array([x], pa.list_(pa.int32())) for name, x in (("starts", at), ("gaps", gaps(code, at)), ("counts", count))}
            yield batch_of(1, shard=pa.array([number], pa.int64()), **lists)
            listed = list(words)
            bucket = np.fromiter(map(zlib.crc32, listed), np.uint32, len(listed)) % WORD_BUCKETS
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            ends = pa.array(np.append(first, len(order)).astype(np.int32))
            taken = [listed[i] for i in order.tolist()]
            joined = [b" ".join(taken[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(taken)])]
            yield batch_of(len(used), shard=pa.array(np.full(len(used), number)), bucket=pa.array(used.astype(np.int32)),
                           words=pa.array(joined, pa.binary()), places=pa.ListArray.from_arrays(ends, pa.array(order.astype(np.int32))))

        for batch in batches:
            for doc, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text"))):
                found = Counter(text.split())  # bytes split at U+0009 to U+000D and space only
                codes.extend(map(words.__getitem__, found))
                counts.extend(found.values())
                starts.append(len(codes))
                docs.append((doc, part, other_flags(text), hashlib.sha256(text).digest()))
                held += len(text) + 64
                if held >= SHARD_BYTES:
                    yield from close()
                    number += 1
                    words, docs, starts, codes, counts, held = Numbers(), [], array("i", [0]), array("i"), array("i"), 0
        if docs:
            yield from close()

    return rows.mapInArrow(run, f"shard long, bucket int, words binary, places array<int>, {ROWS}, gaps array<int>, counts array<int>")


_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
SCHEMA = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("places", pa.list_(pa.int32())),
                    *((c.split()[0], pa.list_(_KINDS[c.split()[1]])) for c in CARRIED), *((c, pa.list_(pa.int32())) for c in ("starts", "gaps", "counts"))])


def numbered(asked: DataFrame) -> DataFrame:
    """(shard, places, numbers) for (shard, bucket, words, places): one number per distinct word of the table.

    Rows come by bucket, and a bucket's words are numbered as they come: the number is the place
    among them and the bucket. A word that every shard has is one entry per shard, read in a stream.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, Numbers()
        for batch in batches:
            out, ends = [], [0]
            for bucket, joined in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != current:
                    current, known = bucket, Numbers()
                words = joined.split(b" ")
                out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) * WORD_BUCKETS + bucket)
                ends.append(ends[-1] + len(words))
            flat = pa.array(np.concatenate(out)) if out else pa.array([], pa.int64())
            numbers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("places"), numbers], names=["shard", "places", "numbers"])

    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "shard long, places array<int>, numbers array<long>")


def matrix(documents: DataFrame) -> DataFrame:
    """CSR shards of documents x words: starts, gaps (of the ascending global word numbers of a row) and counts, with the carried columns of the rows.

    A shard asks for the numbers of its own distinct words, so a word costs one entry a shard,
    however many documents hold it.
    """
    local = stage(local_shards(documents), "audit-local")
    asked = local.where("bucket IS NOT NULL").select("shard", "bucket", "words", "places")
    answers = numbered(asked).groupBy("shard").agg(F.collect_list(F.struct("places", "numbers")).alias("answer"))
    shards = local.where("bucket IS NULL").select("shard", *NAMES, "starts", "gaps", "counts").join(answers, "shard", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                answer = row.column("answer").flatten()
                numbers = np.zeros(0, np.int64)
                if len(answer):
                    places = answer.field("places").flatten().to_numpy()
                    numbers = np.zeros(len(places), np.int64)
                    numbers[places] = answer.field("numbers").flatten().to_numpy()
                starts, gap, counts = (row.column(c).flatten().to_numpy() for c in ("starts", "gaps", "counts"))
                columns, counts = in_rows(numbers[from_gaps(gap, starts)] if len(gap) else np.zeros(0, np.int64), starts, counts)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("shard", *NAMES, "starts")), pa.array([gaps(columns, starts)], pa.list_(pa.int64())),
                                                  pa.array([counts], pa.list_(pa.int32()))], names=["shard", *NAMES, "starts", "gaps", "counts"])

    return stage(shards.mapInArrow(run, f"shard long, {ROWS}, gaps array<long>, counts array<int>"), "audit-matrix")


def flags(shards: DataFrame) -> DataFrame:
    """One row per document of the matrix: the carried columns, n_words (row sum), n_distinct (nonzero count), and bits of the filters A to D it fails."""
    names = NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                starts, counts = row.column("starts").flatten().to_numpy(), row.column("counts").flatten().to_numpy()
                sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[starts]
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c).flatten() for c in names), pa.array(np.diff(sums)), pa.array(np.diff(starts).astype(np.int64))],
                    names=[*names, "n_words", "n_distinct"])

    rows = shards.select(*names, "starts", "counts").mapInArrow(run, ", ".join([*CARRIED, "n_words long", "n_distinct long"]))
    few = F.when(F.col("n_words") < MIN_WORDS, 1).otherwise(0)
    dull = F.when(100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"), 2).otherwise(0)
    return rows.withColumn("mask", (F.col("other") + few + dull).cast("int")).drop("other")


def cells(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, E included. At most 32 rows a part.

    A text fails E unless its doc_id is the smallest that has the text. Rows are summed by text,
    part and label before that smallest doc_id is found, so a text that a third of the table repeats
    meets as few rows as it has languages and labels.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = flagged.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("at_low"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    lowest = F.min("low").over(Window.partitionBy("digest"))
    first = F.when(F.col("low") == lowest, F.col("at_low")).otherwise(0) + F.col("unnamed")
    pair = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
                   F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    split = text.withColumn("first", first).select("part", "good", "toxic", F.explode(pair).alias("c")).select("part", "good", "toxic", "c.*")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                                             F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters over ``documents`` (doc_id, text, lang) in all 120 orders, by part (lang, null as empty string).

    One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, zeros included. Null text is empty: no words, so it fails A, never B or C.
    Rows that repeat a doc_id count each; of rows with one text, those of its smallest doc_id pass E,
    and so do rows without a doc_id, which no label fits either. Several labels of a doc_id count as
    one that has any of their marks. Other columns are not read; an empty table has no parts.
    """
    counted = cells(flags(matrix(documents)), labels)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    bit = {letter: 1 << i for i, letter in enumerate(LETTERS)}
    bits = F.create_map(*[F.lit(v) for item in bit.items() for v in item])
    letters = F.split("filter_order", "(?!^)")
    steps = steps.withColumn("own", bits[F.element_at(letters, F.col("step"))]).withColumn(
        "before", F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bits[x]))

    def total(value: str, condition, name: str, weight=lambda c: F.lit(1)) -> Column:
        return F.aggregate(F.filter("cells", condition), F.lit(0).cast("long"), lambda a, c: a + c[value] * weight(c)).cast("long").alias(name)

    def fails(c: Column) -> Column:
        return c["mask"].bitwiseAND(F.col("own")) != 0

    def came(c: Column) -> Column:
        return c["mask"].bitwiseAND(F.col("before")) == 0

    # of the orders, the share in which a filter comes first among those a document fails is one in their number
    share = F.array(*[F.lit(120 // k) for k in range(1, 6)])
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda c: came(c) & ~fails(c), "kept"), total("n", lambda c: came(c) & fails(c), "removed"),
        total("n", lambda c: ~came(c) & fails(c), "redundant"), total("n", lambda c: c["mask"] == F.col("own"), "unique_fails"),
        total("good", lambda c: came(c) & fails(c), "good_lost"), total("toxic", lambda c: came(c) & fails(c), "toxic_lost"),
        total("n", fails, "shapley", lambda c: F.element_at(share, F.bit_count(c["mask"]).cast("int"))))
