import math
import random
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citesieve.functions.models import Encoder, PairScorer, SparseEncoder
from citesieve.functions.stemming import english_stemmer, stem
from citesieve.functions.text import normalized_title, quote_in_text, strip_references
from citesieve.functions.vectors import l2_normalize, softmax
from citesieve.operators import chunking as ch
from citesieve.operators import dense as d
from citesieve.operators import keyword as kw
from citesieve.operators import topn
from citesieve.operators import selection as sel

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKDOWN = """Intro words before any heading which is a long enough paragraph to count as one. Yes it is. Really now.

# Title of paper

## Methods

### Setup

### Participants

We recruited *forty* people with `code` and [a link](http://x.y).
Second line here.

Table 1. Caption of table

<table><tr><th>Group</th><th>N</th></tr><tr><td>Alpha team</td><td>12</td></tr><tr><td>3</td><td>Beta &amp; co</td></tr></table>

Equation below

$$x = y$$

![fig alt](img/a.png) Figure one text

- item one is long enough to be kept here ok
- outer
  - inner item that is long enough to stay

```python
print("# not a heading")
```

short tail

# References

[1] Somebody wrote something long enough to be a paragraph surely yes.
"""


def test_chunks_of_a_document(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, " \n")], "doc_id long, text string")
    cfg = ch.ChunkConfig(max_tokens=30, overlap_tokens=8, caption_max_tokens=8)
    chunks = ch.chunk_documents(docs, cfg)
    rows = chunks.orderBy("chunk_ix").collect()
    path = "Methods > Setup > Participants"
    assert [(x.section, x.kind) for x in rows] == [("Preamble", "paragraph")] + [(path, k) for k in [
        "paragraph", "table", "formula", "image", "list_item", "list_item", "code", "paragraph"]]
    assert rows[2].text == "Table 1. Caption of table\nGroup | N\nAlpha team\nBeta & co" and rows[3].text == "Equation below\nx = y"
    assert rows[4].image_url == "img/a.png" and rows[6].text.startswith("inner") and rows[7].text == 'print("# not a heading")'
    assert rows[8].text == "short tail" and [x.id for x in rows] == [f"chunk_{i}" for i in range(9)]
    assert [x.doc_id for x in ch.documents_without_chunks(docs, chunks).collect()] == [2]
    sentences = ch.chunk_documents(docs, ch.ChunkConfig(max_tokens=30, overlap_tokens=8, caption_max_tokens=8, level="sentence"))
    assert [x.paragraph_id for x in sentences.orderBy("chunk_ix").collect()] == ["p0", "p0", "p1"] + [None] * 6 + ["p2"]


def test_chunking_is_map_only(spark):
    plan = ch.chunk_documents(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def greedy(sentences, limit, overlap):
    done, window = [], []
    for s in sentences:
        if window and sum(n for _, n in window) + s[1] > limit:
            done.append(window)
            kept, total = [], 0
            for x in reversed(window):
                if kept and total + x[1] > overlap:
                    break
                kept, total = [x] + kept, total + x[1]
                if total >= overlap:
                    break
            window = kept if total + s[1] <= limit else []
        window = window + [s]
    return [" ".join(t for t, _ in w) for w in done + [window] if w]


def test_packing_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [(f"w{i}_{j}", rng.randrange(1, 30)) for j in range(rng.randrange(0, 15))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s array<struct<s:string,n:int>>")
    for limit, overlap in [(40, 10), (25, 24), (10, 0)]:
        got = {x.i: x.w for x in df.select("i", ch.pack_sentences(F.col("s"), limit, overlap).alias("w")).collect()}
        assert got == {i: greedy(s, limit, overlap) for i, s in rows}


def test_tables(spark):
    html = "<table><tr><th> Name </th><td>Kept cell</td></tr><tr><td>12</td><td>a&lt;b c</td></tr><tr><td></td></tr></table>"
    row = spark.range(1).select(ch.table_text(F.lit(html)).alias("t"), ch.table_rows(F.lit(html)).alias("r")).first()
    assert row.t == "Name\nKept cell\na<b c" and row.r == "Name\tKept cell\n12\ta<b c"


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ｆｕｌｌ—Width & ﬁne_Straße ",)], "t string")
    assert df.select(normalized_title("t")).first()[0] == "full width fine strasse"
    assert spark.range(1).select(quote_in_text(F.lit("ÄB  c"), F.lit("x äb\nC y"))).first()[0]
    assert spark.range(1).select(strip_references(F.lit("a\n\n##  Works Cited \nb\n"))).first()[0] == "a"
    assert spark.range(1).select(strip_references(F.lit("a\n# References to x\nb \n"))).first()[0] == "a\n# References to x\nb \n"
    assert spark.range(1).select(l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]
    assert abs(sum(spark.range(1).select(softmax(F.array(F.lit(1000.0), F.lit(999.0)))).first()[0]) - 1) < 1e-12


def test_stemmer(spark):
    known = {"consistency": "consist", "generously": "generous", "running": "run", "flies": "fli", "relational": "relat", "hoping": "hope",
             "hopping": "hop", "agreed": "agre", "ponies": "poni", "caresses": "caress", "electricity": "electr", "by": "by", "skies": "sky"}
    assert {w: stem(w) for w in known} == known
    out = spark.createDataFrame([(["running", "studies"],)], "w array<string>").select(english_stemmer(F.col("w"))).first()[0]
    assert out == ["run", "studi"]


def chunks_of(spark, docs):
    return spark.createDataFrame([(doc, i, "sec", text, "code" if text.startswith("code") else "paragraph") for doc, texts in docs.items()
                                  for i, text in enumerate(texts)], "doc_id long, chunk_ix int, section string, text string, kind string")


def test_bm25_formula_in_any_number_of_blocks(spark, monkeypatch):
    chunks = chunks_of(spark, {1: ["red red fox", "red dog", "blue cat fish"], 2: ["fox", "fox fox dog"]})
    queries = spark.createDataFrame([(0, "the red red fox"), (1, " "), (2, "zebra")], "query_ix int, query string")
    postings, stats = kw.build_postings(chunks, kw.WORD_PATTERN), kw.document_stats(chunks)
    got = {(x.doc_id, x.chunk_ix): (x.score, x.rank) for x in kw.bm25_search(postings, stats, queries, 2).collect()}
    lengths = [4, 3, 4]

    def part(tf, df, n, length, mean):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * length / mean))

    mean = sum(lengths) / 3
    assert abs(got[1, 0][0] - (2 * part(2, 2, 3, 4, mean) + part(1, 1, 3, 4, mean))) < 1e-8 and got[1, 0][1] == 1
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    monkeypatch.setattr(topn, "BLOCK", 1)
    again = {(x.doc_id, x.chunk_ix): (x.score, x.rank) for x in kw.bm25_search(postings, stats, queries, 2).collect()}
    assert again == got


def letters():
    return lambda texts: [{c: float(t.count(c)) for c in "xyz" if c in t} for t in texts]


def test_sparse_search_keeps_zero_scores(spark):
    chunks = chunks_of(spark, {1: ["aaa", "xx", "aab", "y"], 2: ["bbb"]})
    encoder = SparseEncoder(letters)
    queries = spark.createDataFrame([(0, "x", 1.0), (1, "y", 2.0)], "query_ix int, term string, weight double")
    out = kw.sparse_vector_search(kw.sparse_vectors(chunks, encoder), chunks, queries, 3)
    got = sorted((x.query_ix, x.doc_id, x.rank, x.chunk_ix, x.score) for x in out.collect())
    assert got == [(0, 1, 1, 1, 2.0), (0, 1, 2, 0, 0.0), (0, 1, 3, 2, 0.0), (0, 2, 1, 0, 0.0),
                   (1, 1, 1, 3, 2.0), (1, 1, 2, 0, 0.0), (1, 1, 3, 1, 0.0), (1, 2, 1, 0, 0.0)]


def pairs():
    def encode(texts):
        return np.array([[t.count("a"), t.count("b"), 1.0] for t in texts])

    return encode


def test_dense_search_against_numpy(spark):
    chunks = d.embed_chunks(chunks_of(spark, {1: ["a b", "aaa", "bbb"], 2: ["ab"]}), Encoder(pairs))
    assert d.check_embeddings(chunks).isEmpty()
    queries = d.embed_queries(spark.createDataFrame([(0, "aaaa"), (1, "bbbb")], "query_ix int, query string"), Encoder(pairs))
    got = {(x.query_ix, x.doc_id): x.chunk_ix for x in d.dense_search(chunks, queries, 1).collect()}
    assert got == {(0, 1): 1, (1, 1): 2, (0, 2): 0, (1, 2): 0}


def match():
    return lambda a, b: [float(len(set(x) & set(y))) for x, y in zip(a, b)]


def test_fusion_cutoff_counts_unfit_kinds(spark):
    hit = "doc_id long, field string, query_ix int, query string, chunk_ix int, kind string, rank int"
    dense = spark.createDataFrame([(1, "f", 0, "q", 5, "code", 1), (1, "f", 0, "q", 6, "paragraph", 2)], hit)
    sparse = spark.createDataFrame([(1, "f", 0, "k", 6, "paragraph", 1), (1, "f", 1, "l", 7, "paragraph", 1)], hit)
    got = {x.chunk_ix: (x.fusion_score, x.dense, x.sparse) for x in sel.fuse(dense, sparse, 60).collect()}
    assert got == {6: (round(1 / 62 + 1 / 61, 12), ["q"], ["k"]), 7: (round(1 / 61, 12), [], ["l"])}


def test_selection_covers_every_query(spark):
    rng = random.Random(11)
    rows = [(doc, "f", q, f"q{q}", c, c, rng.random()) for doc in range(20) for q in range(5) for c in range(rng.randrange(1, 15))]
    scored = spark.createDataFrame(rows, "doc_id long, field string, query_ix long, query string, chunk_ix int, position int, score double")
    out = sel.select_evidence(scored, top_k=3, max_chunks=6, reserve=2).collect()
    for doc in range(20):
        mine = {x.chunk_ix: x for x in out if x.doc_id == doc}
        assert len(mine) <= 6
        for q in range(5):
            best = max((r for r in rows if r[0] == doc and r[2] == q), key=lambda r: (r[6], -r[5]), default=None)
            assert best is None or best[4] in mine
    tight = {(x.doc_id, x.chunk_ix) for x in sel.select_evidence(scored, top_k=3, max_chunks=2).collect()}
    assert {(x.doc_id, x.chunk_ix) for x in out if x.tier == 0} <= tight, "a small limit never costs coverage"


def test_retrieve_end_to_end(spark):
    chunks = d.embed_chunks(chunks_of(spark, {1: ["aa alpha", "code bbbb", "bb beta", "ab gamma"], 2: ["nothing here"]}), Encoder(pairs))
    plan = spark.createDataFrame([("f", 0, "aaa alpha", ["alpha", "gamma"]), ("g", 1, "bbb beta", ["beta", "x"])],
                                 "field string, query_ix long, query string, keywords array<string>")
    out = sel.retrieve(chunks, plan, Encoder(pairs), PairScorer(match), per_query=3, top_k=2, max_chunks=3, reserve=1)
    rows = out.collect()
    assert {(x.doc_id, x.field) for x in rows} == {(1, "f"), (1, "g"), (2, "f"), (2, "g")}
    assert all(x.chunk_ix != 1 or x.doc_id != 1 for x in rows)
    every = sel.retrieve(chunks, plan, Encoder(pairs), PairScorer(match), prefilter=False, top_k=1, max_chunks=4, reserve=2)
    assert sorted(x.chunk_ix for x in every.filter("doc_id = 1 AND field = 'f'").collect())[:2] == [0, 2]


def test_whole_document_search_equals_postings(spark, monkeypatch):
    """Documents over several Arrow batches and queries over several blocks: the same hits and fusion as by postings."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    chunks = chunks_of(spark, {i: [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.choice([1, 4, 23]))] for i in range(9)})
    rows = [(f"f{i % 2}", i, str(i), " ".join(rng.choices(words, k=3))) for i in range(90)]
    asked = spark.createDataFrame(rows, "field string, query_ix long, name string, query string")
    keys, before = ["field", "query_ix"], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(topn, "BLOCK", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        bm25 = kw.bm25_search(kw.build_postings(chunks, kw.WORD_PATTERN), kw.document_stats(chunks), asked, 3, keys)
        stem = kw.stem_search(kw.build_postings(chunks), asked, 3, keys)
        hits = [*keys, "doc_id", "chunk_ix", "rank"]
        for method, old in (("bm25", bm25), ("any", stem)):
            new = kw.search_texts(chunks, asked, 3, keys, method)
            assert sorted(map(tuple, new.select(hits).collect())) == sorted(map(tuple, old.select(hits).collect()))
        given = asked.select("field", "query_ix", F.col("name").alias("query"), F.col("query").alias("words"))
        old, new = sel.fuse(bm25, stem), sel.fuse_texts(chunks, given, given, 3)
        columns = ["doc_id", "field", "chunk_ix", F.round("fusion_score", 9), "dense", "sparse"]
        assert sorted(map(tuple, new.select(*columns).collect())) == sorted(map(tuple, old.select(*columns).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
