"""Exact Jaccard self-join of documents on word shingles by grouped prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesieve.llm.common import BLANKS, LOWER, UPPER, components, stage, words

WIDTH = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Buckets of the shingle counts that order the shingles, and the slots a heavy shingle is dealt to.
BUCKET_BITS = 18
SLOTS = 64
#: Documents per step inside a task.
STEP = 256
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct hashed shingles of a sequence of word hashes, ascending; a shorter sequence is one shingle."""
    h = hashes.view(np.uint64)
    if len(h) == 0:
        return h
    k = min(width, len(h))
    total = np.full(len(h) - k + 1, U(k))
    for i in range(k):
        total = mix(total + h[i:len(h) - k + 1 + i])
    return np.unique(total)


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(64 - BUCKET_BITS)).astype(np.int64)


def prefix_length(n: int) -> int:
    """Shingles of a set of n that cannot all be missing from a set it links with."""
    return n - (PERCENT * n + 99) // 100 + 1 if n else 0


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(ends, ends[1:]))


def text_mark() -> Column:
    """Names a row by doc_id and text; rows that repeat both have one name."""
    return F.xxhash64(F.col("doc_id"), F.lit(11), F.coalesce(F.col("text"), F.lit("")))


def word_hashes(text: Column) -> Column:
    """Hashes of the case-folded words, in order; one pass folds the case and makes every blank a space."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + BLANKS, LOWER + " " * len(BLANKS))
    return F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))


def _hashed(documents: DataFrame, *more) -> DataFrame:
    return documents.select(*more, word_hashes(F.col("text")).alias("h"))


def shingle_weights(hashed: DataFrame) -> np.ndarray:
    """Counts of hash buckets of shingles over all documents; zero where a bucket does not stand out.

    Any fixed order of shingles gives the same join; this one puts frequent shingles last. Its size
    is fixed (2 ** BUCKET_BITS numbers), whatever the input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for h in _lists(batch.column("h")):
                np.add.at(seen, bucket_of(shingle_set(h)), 1)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["bucket", "n"])

    counts = hashed.select("h").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = stage(counts, "jaccard-buckets")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << BUCKET_BITS)
    heavy = counts.where(F.col("n") > mean + 8 * mean ** 0.5 + 16).toArrow()
    weights = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    weights[heavy.column("bucket").to_numpy()] = heavy.column("n").to_numpy()
    return weights


def signatures(hashed: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per row: doc_id, n, set (the identity of its shingle set), group (that of its prefix and size), prefix, light (prefix shingles that are not heavy)."""
    shared = hashed.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                n, sets, groups, light, prefixes = [], [], [], [], []
                for h in _lists(part.column("h")):
                    s = shingle_set(h)
                    w = table[bucket_of(s)]
                    if w.any():
                        order = np.lexsort((s, w))
                        s, w = s[order], w[order]
                    p = prefix_length(len(s))
                    own = mix(s ^ U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64), mix(s + U(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
                    n.append(len(s))
                    sets.append(np.array([own[0], own[1], len(s)], dtype=np.uint64).tobytes())
                    groups.append(int(mix(mix(s[:p]).sum(dtype=np.uint64, keepdims=True) + U(len(s))).view(np.int64)[0]))
                    light.append(int((w[:p] == 0).sum()))
                    prefixes.append(s[:p].view(np.int64))
                ends = np.cumsum([0] + [len(x) for x in prefixes]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(groups, pa.int64()),
                     pa.array(light, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "mark", "n", "set", "group", "light", "prefix"])

    return hashed.select("doc_id", "mark", "h").mapInArrow(run, "doc_id long, mark long, n long, set binary, group long, light int, prefix array<long>")


def postings(signed: DataFrame) -> DataFrame:
    """(token, group, n, pos) of prefix shingles that two groups or more have, once per group; pos is the shingle's place in the group's order.

    Rows of a token meet in one sorted partition and are read in a stream; a heavy token is dealt to
    SLOTS partitions by group and keeps all its rows.
    """
    rows = signed.where("n > 0").select("group", "n", "light", F.posexplode("prefix").alias("pos", "token"))
    heavy = F.col("pos") >= F.col("light")
    rows = rows.select("token", F.when(heavy, F.pmod("group", F.lit(SLOTS))).otherwise(0).alias("slot"), "group", "n",
                       F.when(heavy, -F.col("pos") - 1).otherwise(F.col("pos")).alias("at"))  # place and heaviness travel in one number
    order = Window.partitionBy("token", "slot").orderBy("group")
    seen = rows.select("token", "group", "n", "at", F.lead("group").over(order).alias("next"),
                       F.first("group").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("first"))
    last = F.col("next").isNull() | (F.col("next") != F.col("group"))
    shared = (F.col("at") < 0) | F.col("next").isNotNull() | (F.col("first") != F.col("group"))
    return seen.where(last & shared).select("token", "group", "n", F.when(F.col("at") < 0, -F.col("at") - 1).otherwise(F.col("at")).alias("pos"))


def sizes_fit() -> Column:
    return 100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")


def enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m that have ``shared`` prefix shingles in common can link.

    The prefix that ends first holds all that the sets share up to there, so what they share beyond
    lies in its set's rest, which is one less than PERCENT of that set.
    """
    def rest(size: Column) -> Column:
        return F.floor((PERCENT * size + 99) / 100) - 1

    return (shared + F.greatest(rest(n), rest(m))) * (100 + PERCENT) >= PERCENT * (n + m)


def reachable(shared: Column, n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m can link whose first ``shared`` common shingles end at places i and j of their orders."""
    return (shared + F.least(n - i, m - j) - 1) * (100 + PERCENT) >= PERCENT * (n + m)


def group_pairs(listed: DataFrame) -> DataFrame:
    """Pairs (g, h) of different groups that can link across components, from ``listed``: token, group, n, pos, and the least and largest component of the group's members (low, high).

    A pair meets at each shared shingle whose places still leave room for enough others. Places grow
    together, so these are the pair's first shared shingles, and whatever else it shares lies behind
    the last of them. Groups of a token's largest component are not paired with each other, so a
    token that one huge cluster shares costs no more than its rows.
    """
    one = F.col("low") == F.col("high")
    open_ = listed.groupBy("token").agg(F.min("low").alias("c"), F.max("high").alias("d")).where("c <> d").select("token")
    rest = stage(listed.join(open_, "token"), "jaccard-open")
    largest = (rest.where(one).groupBy("token", "low").count().groupBy("token").agg(F.max(F.struct("count", "low")).alias("l"))
               .select("token", F.col("l.low").alias("largest")))
    rest = stage(rest.join(largest, "token", "left").withColumn("odd", F.coalesce(~one | (F.col("low") != F.col("largest")), F.lit(True))).drop("largest"), "jaccard-odd")
    x, y = rest.where("odd").alias("x"), rest.alias("y")
    apart = F.least("x.low", "y.low") != F.greatest("x.high", "y.high")
    once = (F.col("x.group") != F.col("y.group")) & (~F.col("y.odd") | (F.col("x.group") < F.col("y.group")))
    met = x.join(y, "token").where(once & apart & sizes_fit() & reachable(F.lit(1), F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
    sides = [F.struct(*(F.col(f"{side}.{c}").alias(c) for c in ("group", "n", "pos"))) for side in "xy"]
    met = met.select(F.least(*sides).alias("x"), F.greatest(*sides).alias("y"))
    met = met.groupBy(F.col("x.group").alias("g"), F.col("y.group").alias("h"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(
        F.count("*").alias("c"), F.max("x.pos").alias("i"), F.max("y.pos").alias("j"))
    return met.where(reachable(*(F.col(c) for c in ("c", "n", "i", "m", "j")))).select("g", "h")


def sharing_enough(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The group pairs (g, h) whose whole prefixes share enough shingles for a link; prefixes travel once per pair and side."""
    wanted = pairs.select(F.explode(F.array("g", "h")).alias("group")).distinct()
    prefixes = stage(signed.select("group", "n", "prefix").join(wanted, "group", "left_semi").groupBy("group").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix")),
                     "jaccard-prefixes")
    sides = [prefixes.select(F.col("group").alias(g), F.col("n").alias(n), F.col("prefix").alias(p)) for g, n, p in (("g", "n", "x"), ("h", "m", "y"))]
    both = pairs.join(sides[0], "g").join(sides[1], "h")
    return both.where(enough(F.size(F.array_intersect("x", "y")), F.col("n"), F.col("m"))).select("g", "h")


def verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of class nodes whose whole sets link.

    Texts are dealt once by row name and read for both sides. The set of a is made where its text
    is and goes to b, so a node that many pairs have as b sends its set once.
    """
    rep = classes.select("node", "rep")
    ends = pairs.join(rep.select(F.col("node").alias("a"), F.col("rep").alias("x_mark")), "a")
    ends = stage(ends.join(rep.select(F.col("node").alias("b"), F.col("rep").alias("y_mark")), "b").select("a", "b", "x_mark", "y_mark"), "jaccard-ends")
    # sides are sorted and merged at every size: which rows are needed grows with the input
    texts = documents.select(text_mark().alias("mark"), "text").hint("merge")

    def sets(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, STEP):
                    part = batch.slice(low, STEP)
                    made = pa.array([shingle_set(h).tobytes() for h in _lists(part.column("h"))], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), made], names=[*keys, name])

        return _hashed(rows, *keys).mapInArrow(make, ", ".join([*(f"{k} long" for k in keys), f"{name} binary"]))

    members = sets(texts.join(ends, texts["mark"] == ends["x_mark"]), ["a", "b", "y_mark"], "x")
    pivots = sets(texts.join(ends.select(F.col("y_mark").alias("mark")).distinct(), "mark"), ["mark"], "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * n >= PERCENT * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = members.hint("merge").join(pivots, members["y_mark"] == pivots["mark"]).select("a", "b", "x", "y")
    return stage(both.mapInArrow(compare, "a long, b long").distinct(), "jaccard-links")


def jaccard_classes(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with n_shingles and component_id, the smallest doc_id reachable by links.

    Links join documents whose sets of distinct 5-word shingles have Jaccard similarity of 0.8 or
    more; fewer words are one shingle, no words or null text an empty set that links with nothing.
    Repeated rows and copies form one class from the start. Also returned: root, which numbers the
    components, and mark, which names a row by doc_id and text. A component of null ids only has a null
    id. Other columns are not read; an empty table gives an empty result.

    1. Equal sets are one class; classes with equal prefix and size are one group.
    2. Groups that share a prefix shingle are candidates, filtered by size and by how many prefix
       shingles they share. First each is tried against one pivot of the shingle, the group with most
       shared shingles, and members against their group: links as many as groups, which already
       connect dense clusters.
    3. Then every pair of groups that are not of one component is filtered by size, by the places of
       its shared shingles and by their number; what is left is expanded to members of different
       components and verified. A pair inside a component would change nothing, so no link between
       different components is lost.
    """
    hashed = _hashed(documents, F.col("doc_id"), text_mark().alias("mark"))
    signed = stage(signatures(hashed, shingle_weights(hashed)), "jaccard-signatures")
    classes = stage(signed.groupBy("set", "n", "group").agg(F.min("doc_id").alias("low"), F.min("mark").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    shared = stage(postings(signed), "jaccard-postings")
    full = classes.where("n > 0")
    groups = stage(full.groupBy("group").agg(F.min("node").alias("rep"), F.count("*").alias("members")), "jaccard-groups")

    common = stage(shared.groupBy("group").agg(F.count("*").alias("common")), "jaccard-common")
    pivots = stage(shared.join(common, "group").groupBy("token").agg(F.max(F.struct("common", "group", "n")).alias("p"))
                   .select("token", "p.group", "p.n"), "jaccard-pivots")
    tried = shared.alias("x").join(pivots.alias("y"), "token").where("x.group <> y.group").where(sizes_fit())
    tried = tried.groupBy(F.col("x.group").alias("g"), F.col("y.group").alias("h"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).count()
    tried = tried.where(enough(F.col("count"), F.col("n"), F.col("m"))).select("g", "h")
    rep = groups.select("group", "rep")
    star = (tried.join(rep.withColumnRenamed("group", "g").withColumnRenamed("rep", "a"), "g")
            .join(rep.withColumnRenamed("group", "h").withColumnRenamed("rep", "b"), "h").select("a", "b"))
    inner = full.select("group", "node").join(groups.where("members > 1"), "group").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    first = stage(star.union(inner).distinct(), "jaccard-star")
    links = verified(first, classes, documents)

    known = stage(components(links), "jaccard-known")
    member = stage(full.join(known, "node", "left").select("group", "node", F.coalesce("root", "node").alias("comp")), "jaccard-members")
    spans = stage(member.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")), "jaccard-spans")
    # members of one group share its prefix: a group of several components is a pair with itself
    own = spans.where("low <> high").select(F.col("group").alias("g"), F.col("group").alias("h"))
    candidates = sharing_enough(stage(group_pairs(shared.join(spans, "group")), "jaccard-group-pairs"), signed)
    candidates = stage(candidates.union(own), "jaccard-group-candidates")
    sides = [member.select(F.col("group").alias(g), F.col("node").alias(n), F.col("comp").alias(f"{n}_comp")) for g, n in (("g", "a"), ("h", "b"))]
    more = candidates.join(sides[0], "g").join(sides[1], "h").where("a_comp <> b_comp and (g <> h or a < b)").select("a", "b")
    second = stage(ordered(more).join(ordered(first), ["a", "b"], "left_anti"), "jaccard-rest")
    links = links.union(verified(second, classes, documents))

    roots = components(links)
    reached = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = stage(reached.groupBy("root").agg(F.min("low").alias("component_id")), "jaccard-ids")
    named = stage(reached.select("root", "set").join(ids, "root").select("set", "root", "component_id"), "jaccard-named")
    placed = signed.select("doc_id", "mark", "n", "set").join(named, "set")
    alone = F.col("n") == 0
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                         F.when(~alone, F.col("root")).alias("root"), "mark")


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component of ``jaccard_classes``: that of the smallest doc_id (null ids last).

    Rows without words link with nothing and all stay. Of rows that repeat a doc_id and its text one
    stays. Texts move once, to the ids that stay.
    """
    found = jaccard_classes(documents).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark")).alias("first")
    kept = stage(found.groupBy("root").agg(first).select(F.col("first.mark").alias("key")), "jaccard-kept")
    rows = documents.select(F.struct(*documents.columns).alias("row"), text_mark().alias("key"),
                            (F.size(words(F.col("text"))) == 0).alias("alone"))
    worded = rows.where(~F.col("alone")).join(kept, "key", "left_semi")
    once = worded.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("copy = 1")
    return once.select("row").union(rows.where("alone").select("row")).select("row.*")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
