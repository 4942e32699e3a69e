"""Bucketed helpers against brute force, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from citesieve.functions import ordered as o


def data(seed, n=300):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else rng.choice("ab"), i, rng.randrange(1000), rng.choice([None, 1, 2, 3])) for i in range(n)]


def test_suffix_sums(spark):
    rows = list({(k, v): (k, v, (i % 5) + 1) for k, i, v, _ in data(1)}.values())
    df = spark.createDataFrame(rows, "k string, v int, n int")
    got = {(x.k, x.v): (x.total, x.next_v) for x in o.suffix_sums(df, ["k"], "v", F.floor(F.col("v") / 50), {"n": "total"}).collect()}
    for k, v, _ in rows:
        later = [x for x in rows if x[0] == k and x[1] >= v]
        above = [x[1] for x in later if x[1] > v]
        assert got[k, v] == (sum(x[2] for x in later), min(above) if above else None)


def test_last_before_and_prefix_sum(spark):
    rows = data(2)
    df = spark.createDataFrame(rows, "k string, i int, v int, x int").withColumn("b", F.floor(F.col("i") / 20))
    got = {x.i: x.last for x in o.last_before(df, ["k"], ["i"], F.col("b"), F.col("x"), "last").collect()}
    sums = {x.i: x.s for x in o.prefix_sum(df, ["k"], ["i"], "b", F.col("v"), "s").collect()}
    for k, i, v, _ in rows:
        before = [r for r in rows if r[0] == k and r[1] < i]
        values = [r[3] for r in before if r[3] is not None]
        assert got[i] == (values[-1] if values else None)
        assert sums[i] == sum(r[2] for r in before) + v


def test_dense_index(spark):
    df = spark.createDataFrame(data(3), "k string, i int, v int, x int")
    out = o.dense_index(df, ["k"], ["i"], "ix", 8).collect()
    for key in {x.k for x in out}:
        mine = [x for x in out if x.k == key]
        assert sorted(x.ix for x in mine) == list(range(len(mine))) and {x.ix_size for x in mine} == {len(mine)}
    moved = {x.i: x.ix for x in o.dense_index(df.repartition(7), ["k"], ["i"], "ix", 8).collect()}
    assert moved == {x.i: x.ix for x in out}


def test_bucketed_rank(spark):
    df = spark.createDataFrame([(k, i, v / 100.0) for k, i, v, _ in data(4)], "k string, i int, v double")
    got = {x.i: x.r for x in o.bucketed_rank(df, ["k"], "v", ["i"], F.floor(F.col("v") * 2), "r").collect()}
    for key in {k for k, *_ in data(4)}:
        ordered = sorted((-(v / 100.0), i) for k, i, v, _ in data(4) if k == key)
        assert [got[i] for _, i in ordered] == list(range(1, len(ordered) + 1))
