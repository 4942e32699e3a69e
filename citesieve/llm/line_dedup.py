"""Line deduplication by pairwise alignment: common blocks go from the later of two documents."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesieve.functions.ordered import dense_index
from citesieve.llm.common import BLANKS, stage, word_count

#: Least words of a block that is deleted; also of the line runs through which documents find each other.
BLOCK_WORDS = 10


def line_columns() -> list:
    """keys and sizes: hash and words of every line with a word, in order; k1, k2: the identity of that sequence."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    return [F.transform(lines, lambda x: F.xxhash64(x)).alias("keys"), F.transform(lines, lambda x: word_count(x).cast("int")).alias("sizes")]


def _identity(df: DataFrame) -> DataFrame:
    return df.withColumn("k1", F.xxhash64("keys")).withColumn("k2", F.xxhash64(F.lit(29), "keys"))


def run_ranges(sizes: np.ndarray, least: int = BLOCK_WORDS) -> set[tuple[int, int]]:
    """The runs that make lines rare: from every line on, and up to every line, the shortest run of lines with ``least`` words.

    Every line of a common block of so many words lies in such a run inside the block.
    """
    found, ends = set(), np.concatenate([[0], np.cumsum(sizes)])
    low = 0
    for high in range(1, len(sizes) + 1):
        while low < high and ends[high] - ends[low + 1] >= least:
            low += 1
        if ends[high] - ends[low] >= least:
            found.add((low, high))
    for low in range(len(sizes)):
        high = int(np.searchsorted(ends, ends[low] + least))
        if high <= len(sizes):
            found.add((low, high))
    return found


def runs(keys: np.ndarray, sizes: np.ndarray, least: int = BLOCK_WORDS, gone=()) -> set[int]:
    """Hashes of the runs; those with all their places in ``gone`` are left out."""
    left = np.ones(len(keys), np.int64)
    left[list(gone)] = 0
    before = np.concatenate([[0], np.cumsum(left)])
    return {_run_hash(keys[a:b]) for a, b in run_ranges(sizes, least) if before[b] > before[a]}


def _run_hash(keys: np.ndarray) -> int:
    h = 0x2545F4914F6CDD1D
    for k in keys.tolist():
        h = ((h ^ (k & 0xFFFFFFFFFFFFFFFF)) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two line sequences: equal ends of a range are matched, lines that are unique in
    both are aligned along their longest increasing run, and the gaps between are treated the same way."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {a[i]: i for i in range(a0, a1) if na[a[i]] == 1 and nb.get(a[i]) == 1}
        pairs = [(at[b[j]], j) for j in range(b0, b1) if b[j] in at]
        tops: list[int] = []
        ends: list[int] = []
        back = [-1] * len(pairs)
        for k, (i, _) in enumerate(pairs):
            place = bisect_left(tops, i)
            back[k] = ends[place - 1] if place else -1
            if place == len(tops):
                tops.append(i)
                ends.append(k)
            else:
                tops[place], ends[place] = i, k
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        i0, j0 = a0, b0
        for i, j in reversed(chain):
            out.append((i, j))
            if i > i0 and j > j0:
                todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        if chain and i0 < a1 and j0 < b1:
            todo.append((i0, a1, j0, b1))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], sizes: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Places in ``b`` inside blocks of adjacent aligned lines with at least ``least`` words (``sizes``: words of b's lines)."""
    gone, block = [], []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= least:
                gone += block
            block = []
        block.append(j)
        last = (i, j)
    return gone


def _longs(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(ends, ends[1:]))


def deletions(documents: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """(k1, k2, low, gone, size): per distinct line sequence its first document, the lines (from 0) deleted there, and its words.

    Documents with equal sequences are one class; all but its first document lose every line. Other
    documents meet through the hashes of rare line runs: each is aligned with the first document of
    each run it shares. Where that leaves a line of the run, because the two have it in another
    order or more than once, the document is aligned with the other earlier holders of the run, four
    times as many in each round, until the run is gone or all were tried. So every line is deleted that
    the alignment with any earlier document deletes: a block of the two consists of runs that both have.
    Pairs grow with the runs, and with the square of a run's holders only where no alignment deletes it.
    Stage tables are joined, so adaptive execution splits the pairs of a document that many meet.
    """
    rows = stage(_identity(documents.select("doc_id", *line_columns())).where(F.size("keys") > 0), "lines-rows")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    classes = stage(rows.groupBy("k1", "k2").agg(F.min(order).alias("low")).withColumn("node", F.monotonically_increasing_id()), "lines-classes")
    joined = rows.alias("r").join(classes.alias("c"), (F.col("r.k1") == F.col("c.k1")) & (F.col("r.k2") == F.col("c.k2")) & F.col("doc_id").eqNullSafe(F.col("low.doc_id")))
    sequences = stage(joined.select("node", "low", "keys", "sizes").dropDuplicates(["node"]), "lines-sequences")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, made = [], []
            for node, keys, sizes in zip(batch.column("node").to_pylist(), _longs(batch.column("keys")), _longs(batch.column("sizes"))):
                found = runs(keys, sizes, least)
                nodes += [node] * len(found)
                made += found
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64()), pa.array(nodes, pa.int64())], names=["run", "node"])

    spelled = stage(sequences.select("node", "keys", "sizes").mapInArrow(spell, "run long, node long")
                    .join(classes.select("node", "low"), "node"), "lines-runs")
    firsts = stage(spelled.groupBy("run").agg(F.min(F.struct("low", "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
                   .select("run", F.col("first.node").alias("first"), "n"), "lines-firsts")
    shared = stage(spelled.join(firsts, "run").where("node <> first"), "lines-shared")
    pairs = stage(shared.select("node", "first").distinct(), "lines-pairs")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, places = [], []
            for node, a, b, sizes in zip(batch.column("node").to_pylist(), _longs(batch.column("a")), _longs(batch.column("b")), _longs(batch.column("sizes"))):
                gone = common_blocks(a.tolist(), b.tolist(), sizes.tolist(), least)
                nodes += [node] * len(gone)
                places += gone
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(places, pa.int32())], names=["node", "place"])

    def places(met: DataFrame) -> DataFrame:
        met = met.join(sequences.select(F.col("node").alias("first"), F.col("keys").alias("a")), "first")
        met = met.join(sequences.select("node", F.col("keys").alias("b"), "sizes"), "node").select("node", "a", "b", "sizes")
        return stage(met.mapInArrow(align, "node long, place int"), "lines-places")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, made = [], []
            for node, keys, sizes, gone in zip(batch.column("node").to_pylist(), _longs(batch.column("keys")), _longs(batch.column("sizes")), batch.column("gone").to_pylist()):
                found = runs(keys, sizes, least, gone or ())
                nodes += [node] * len(found)
                made += found
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64()), pa.array(nodes, pa.int64())], names=["run", "node"])

    def left(asked: DataFrame, cut: DataFrame) -> DataFrame:
        """Those of ``asked`` (run, node, low, n) of which a line is not in ``cut``."""
        nodes = asked.select("node").distinct()
        gone = cut.join(nodes, "node", "left_semi").groupBy("node").agg(F.collect_set("place").alias("gone"))
        lines = sequences.join(nodes, "node", "left_semi").join(gone, "node", "left").select("node", "keys", "sizes", "gone")
        return stage(asked.join(lines.mapInArrow(leave, "run long, node long"), ["run", "node"], "left_semi"), "lines-left")

    cut = places(pairs)
    open_ = left(shared.where("n > 2").select("run", "node", "low", "n"), cut)
    most = open_.agg(F.max("n")).first()[0] or 0
    if most:
        # any order of the holders gives the same lines; these numbers need no task that has all holders of a run
        numbered = dense_index(spelled.join(open_.select("run").distinct(), "run", "left_semi"), ["run"], ["node"], "number")
        holders = stage(numbered.select("run", F.col("node").alias("first"), F.col("low").alias("first_low"), "number"), "lines-holders")
    low, high = 0, 4
    while low < most:
        earlier = F.struct("first_low", "first") < F.struct("low", "node")
        met = open_.join(holders.where((F.col("number") >= low) & (F.col("number") < high)), "run").where(earlier).select("node", "first").distinct()
        cut = cut.union(places(stage(met.join(pairs, ["node", "first"], "left_anti"), "lines-pairs")))
        open_ = left(open_, cut)
        most = open_.agg(F.max("n")).first()[0] or 0
        low, high = high, 4 * high
    gone = cut.groupBy("node").agg(F.sort_array(F.collect_set("place")).alias("gone"))
    size = F.aggregate("sizes", F.lit(0), lambda x, y: x + y)
    sized = sequences.select("node", size.alias("size"))
    return stage(classes.join(sized, "node").join(gone, "node", "left").select("k1", "k2", F.col("low.doc_id").alias("low"), F.lit(True).alias("known"), "gone", "size"),
                 "lines-plan")


def cut_lines(text: str, gone) -> str:
    """``text`` without some of its lines with words, counted from 0; blank lines go with the line before them, leading ones with the first."""
    drop, kept, place, leading = set(gone), [], -1, []
    for line in text.split("\n"):
        if line.strip(BLANKS):
            place += 1
            if place not in drop:
                kept += leading if place == 0 else []
                kept.append(line)
        elif place < 0:
            leading.append(line)
        elif place not in drop:
            kept.append(line)
    return "\n".join(kept)


def dedup_lines(documents: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` (doc_id, text, any others) with the struct ``_lines`` (n_lines, n_removed, text): counts of lines with words and the text left.

    Earlier means the smaller doc_id; null ids come last. Lines are compared without outer blanks, by
    64-bit hashes, and only blocks of at least ``least`` words are deleted, so every deleted line
    stands in an earlier document. Rows that repeat a doc_id and its text are one document and are
    treated alike. Null texts stay null, blank ones as they are; an empty table stays empty. A
    column already named ``_lines`` is replaced.
    """
    plan = deletions(documents, least)
    columns = [c for c in documents.columns if c != "_lines"]
    rows = _identity(documents.select(F.struct(*columns).alias("row"), *line_columns()))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), "k1", "k2", F.size("keys").alias("n_lines"))
    joined = rows.alias("r").join(plan.alias("p"), (F.col("r.k1") == F.col("p.k1")) & (F.col("r.k2") == F.col("p.k2")), "left")
    every = F.when(F.col("n_lines") > 0, F.sequence(F.lit(0), F.col("n_lines") - 1)).otherwise(F.array().cast("array<int>"))
    copy = F.col("known") & ~F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("size") >= least)
    first = F.col("known") & F.col("doc_id").eqNullSafe(F.col("low"))
    gone = F.when(copy, every).when(first, F.col("gone"))
    planned = joined.select("row", "n_lines", F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))
    kind = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, gone = batch.column("n_lines").cast(pa.int64()), batch.column("gone")
            texts = [t if t is None or not g else cut_lines(t, g) for t, g in zip(pc.struct_field(batch.column("row"), "text").to_pylist(), gone.to_pylist())]
            made = pa.StructArray.from_arrays([lines, pa.array([len(g) for g in gone.to_pylist()], pa.int64()), pa.array(texts, pa.string())],
                                              names=["n_lines", "n_removed", "text"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), made], names=["row", "_lines"])

    done = planned.mapInArrow(run, T.StructType([T.StructField("row", planned.schema["row"].dataType), T.StructField("_lines", kind)]))
    return done.select("row.*", "_lines")


def without_repeats(documents: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` with the text that is left; documents that lost all their lines are gone, n_chars (if there) follows the text."""
    done = dedup_lines(documents, least).where("_lines.n_removed = 0 or _lines.n_removed < _lines.n_lines")
    text = F.col("_lines.text")
    out = {"text": text} | ({"n_chars": F.when(F.col("_lines.n_removed") > 0, F.length(text).cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
                            if "n_chars" in documents.columns else {})
    return done.withColumns(out).select(*documents.columns)
