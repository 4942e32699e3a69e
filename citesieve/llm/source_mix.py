"""Mixing sources to target weights by subset-sum fitting of each source's word budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesieve.llm.common import stage, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
#: Hash buckets that a (source, length) group is split into, so that no task ranks a whole group.
BUCKETS = 1024
#: Remaining budget that the exact knapsack always covers, in words; it covers twice the longest document where that is more.
EXACT_WORDS = 1 << 18


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Targets of sources (source, source_size): ``share`` of all words, dealt by weight.

    Sources in code point order (null last) take the weights in turn. A target stops at ``repeats``
    times its source's size and the excess is dealt again by weight until none is above: the target
    is min(cap, level * weight), and the level is the largest of (budget - caps of the sources with
    smaller cap per weight) / (weights of the others).
    """
    given = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("weight", F.element_at(given, (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("per", F.col("cap") / F.col("weight"))
    order = Window.orderBy("per", F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    leveled = ranked.withColumn("level", (budget - below) / above)
    level = F.max("level").over(every)
    return leveled.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def fit_budget(lengths, counts, budget: int, exact_words: int = EXACT_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below ``budget`` as can be.

    An even share of every length is taken first, then the longest that fit, and the remaining
    budget goes to a bounded knapsack: the counts left are split into powers of two and the
    reachable sums are kept as bits of one number, with the item that reached each sum first. The
    knapsack has room for two of the longest documents that can still be taken, whatever their length.
    """
    lengths, counts = np.asarray(lengths, dtype=object), np.asarray(counts, dtype=object)
    take = np.zeros(len(lengths), dtype=object)
    total = int((lengths * counts).sum()) if len(lengths) else 0
    if total == 0 or budget <= 0:
        return take.astype(np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = counts * budget // total
    rest = budget - int((take * lengths).sum())
    exact_words = max([exact_words, *(2 * w for w, n, t in zip(lengths, counts, take) if n > t and w <= rest)])
    order = np.argsort(-lengths.astype(np.int64), kind="stable")
    for i in order:
        if rest <= exact_words:
            break
        if lengths[i] > 0:
            more = min(counts[i] - take[i], (rest - exact_words) // lengths[i] + 1, rest // lengths[i])
            take[i] += more
            rest -= more * lengths[i]
    if rest <= exact_words:
        bits, mask, items = 1, (1 << (rest + 1)) - 1, []
        reached = np.full(rest + 1, -1, dtype=np.int64)
        for i in order:
            left, step = (counts[i] - take[i] if 0 < lengths[i] <= rest else 0), 1
            while left > 0 and not bits >> rest & 1:
                n = min(step, left)
                width = int(n * lengths[i])
                if width > rest:
                    break
                fresh = (bits << width) & mask & ~bits
                if fresh:
                    raw = np.frombuffer(fresh.to_bytes(rest // 8 + 1, "little"), dtype=np.uint8)
                    reached[np.flatnonzero(np.unpackbits(raw, bitorder="little", count=rest + 1))] = len(items)
                    items.append((i, n, width))
                    bits |= fresh
                left, step = left - n, step * 2
            if bits >> rest & 1:
                break
        at = bits.bit_length() - 1
        while at:
            i, n, width = items[reached[at]]
            take[i] += n
            at -= width
    return take.astype(np.int64)


def mix_sources(documents: DataFrame, carry: list[str], weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
                seed: int = 17, buckets: int = BUCKETS, staged: bool = False) -> DataFrame:
    """Mix ``documents`` (doc_id, text, source): for each row its columns ``carry`` and size, source_size, target, copies, taken.

    A source is taken whole as often as its target allows; the rest of the target is fitted exactly
    over counts of documents by length, and documents of a length are chosen in a seeded order of
    hashes of doc_id, so reruns agree. ``taken`` = copies * size, and copies never pass ``repeats``.

    Null texts have size 0 and take nothing; null sources form the last source. Repeated rows are
    rows of their own. An empty table gives an empty result; a table without words gives targets of 0.
    ``carry`` may name any columns: they travel in one struct and cannot clash with the operator's.
    ``staged`` writes sizes and carried columns once instead of counting words twice; use it when the
    carried columns are small.

    Per source one task gets the counts by length, at most sqrt(2 * words) rows since different
    lengths add up to the source. Documents never meet by source: a (source, length) group is ranked
    in hash buckets with counts carried over.
    """
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = documents.select(F.struct(*carry).alias("row"), F.col("source"), word_count(F.col("text")).alias("size"), draw.alias("draw"))
    sized = sized.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    if staged:
        sized = stage(sized, "mix-sizes")
    cells = stage(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "mix-cells")
    lengths = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    wanted = stage(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, repeats), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    planned = wanted.withColumn("whole", whole)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        budget = int(np.floor(group["target"].iloc[0])) - int(group["whole"].iloc[0]) * int(group["source_size"].iloc[0])
        return group[["source", "size"]].assign(extra=fit_budget(group["size"].tolist(), group["n"].tolist(), budget))

    same = lengths.alias("a").join(planned.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    chosen = same.select("a.source", "size", "n", "target", "whole", "source_size").groupBy("source").applyInPandas(fit, "source string, size long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extras = (cells.withColumn("before", before).alias("a")
              .join(chosen.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
              .select("a.source", "a.size", "bucket", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("extra")))
    extras = stage(extras.alias("a").join(planned.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
                   .select("a.source", "size", "bucket", "extra", "source_size", "target", "whole"), "mix-plan")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw"))
    ranked = sized.withColumn("rank", rank).alias("a").join(
        extras.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.bucket") == F.col("b.bucket")))
    copies = F.col("whole") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    made = ranked.select("row", "a.size", "source_size", "target", copies.alias("copies"), (copies * F.col("a.size")).alias("taken"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in carry], "size", "source_size", "target", "copies", "taken")
