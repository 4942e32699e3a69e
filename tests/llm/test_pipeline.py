"""The pipeline stage by stage against plain Python, and the queries with SQL twins."""

import os

import brute
import pytest

import corpus_pipeline
from citesieve.llm import plans
from check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="driver tables are not here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stages") / name)
        function(spark, docs, SF).write.parquet(folder)
        after = spark.read.parquet(folder)
        out.append((docs.toPandas(), after.toPandas()))
        docs = after
    return out


def test_quality_stage_keeps_what_the_rules_keep(spark, stages):
    before, after = stages[0]
    rules = plans.op1_quality_rules(spark, SF).where("kept").toPandas()
    assert sorted(after["doc_id"]) == sorted(rules["doc_id"]) and list(after.columns) == list(before.columns)
    texts = dict(zip(before["doc_id"], before["text"]))
    assert all(texts[i] == t for i, t in zip(after["doc_id"], after["text"]))


def test_line_stage_only_deletes_lines_of_earlier_documents(stages):
    before, after = stages[1]
    texts = dict(zip(before["doc_id"], before["text"]))
    first = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            first.setdefault(line.strip(), i)
    left = dict(zip(after["doc_id"], after["text"]))
    for i, text in texts.items():
        kept = left.get(i, "").split("\n")
        gone = [x for x in text.split("\n") if x.strip() and x not in kept]
        assert all(first[x.strip()] < i for x in gone)
    assert list(after.columns) == list(before.columns) and len(after) < len(before)


def test_near_duplicate_stage_keeps_the_first_of_each_component(stages):
    before, after = stages[2]
    want = brute.jaccard_components(list(zip(before["doc_id"], before["text"])))
    assert sorted(after["doc_id"]) == sorted({c for _, c in want.values()})


def test_mixing_stage_meets_targets(stages):
    before, after = stages[3]
    size = lambda df: df["text"].map(lambda t: len(brute.WORD.findall(t or "")))
    total, taken = size(before).groupby(before["source"]).sum(), size(after).groupby(after["source"]).sum()
    assert set(after["doc_id"]) <= set(before["doc_id"]) and after["doc_id"].value_counts().max() <= 2
    assert taken.sum() == pytest.approx(1.5 * total.sum(), rel=0.02) and (taken <= 2 * total).all()


def test_token_stage_round_trips(stages):
    from tokenizers import Tokenizer

    before, after = stages[4]
    library = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    texts = dict(zip(before["doc_id"], before["text"]))
    assert len(after) == len(before)
    for r in after.itertuples():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded_sha256 == brute.sha(texts[r.doc_id])


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_sql_twin(spark, name):
    message = compare(spark, connect(SF), SF, plans.QUERIES[name], plans.ORACLES[name])
    assert message.startswith("ok"), message
