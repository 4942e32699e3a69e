"""Postings: terms are stemmed and counted once, in one Python step."""

import pyarrow as pa

from citesieve.functions.stemming import _stem_words, english_stemmer
from citesieve.operators import keyword as kw


def test_postings_stem_and_count_in_one_step(spark):
    chunks = spark.createDataFrame([(1, 0, "S", "running runs, the run"), (1, 1, None, ""), (2, 0, None, None), (2, 1, "b", "Zebra a b b")],
                                   "doc_id long, chunk_ix int, section string, text string")
    postings = kw.build_postings(chunks, stemmer=english_stemmer)
    assert sorted(map(tuple, postings.collect())) == [
        (1, 0, "paragraph", 4, "run", 3), (1, 0, "paragraph", 4, "s", 1), (2, 1, "paragraph", 4, "b", 3), (2, 1, "paragraph", 4, "zebra", 1)]
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array_sort" not in plan
    index = kw.index_chunks(chunks, stemmer=english_stemmer)
    assert sorted((r.doc_id, r.chunk_ix, r.chunk_terms, len(r.terms)) for r in index.collect()) == [(1, 0, 4, 2), (1, 1, 0, 0), (2, 0, 0, 0), (2, 1, 4, 2)]


def test_stems_of_sliced_and_null_arrays():
    words = pa.array([["gone"], ["running", "cats"], None, [], ["cats"]]).slice(1)
    assert _stem_words.func(words).to_pylist() == [["run", "cat"], None, [], ["cat"]]
