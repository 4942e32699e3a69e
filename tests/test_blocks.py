"""Blocks of markdown: patterns are searched only where a text has their characters, and once per piece."""

from pyspark.sql import functions as F

from citesieve.operators import chunking as ch

ODD = "Head\n====\na `co` [b](u) *c* __d__ e\\!\n\n* * *\n\n1. x\n\n![al](u.png) by\n\n$$x$$\n\n$$open\n\n![broken"


def test_a_piece_is_classified_once(spark):
    expression = str(ch._block(F.col("raw"), ch.token_count)._jc)
    assert expression.upper().count("RLIKE") <= 6  # one for each pattern that opens a block


def test_guarded_patterns_find_their_marks(spark):
    docs = spark.createDataFrame([(1, ODD), (2, "plain words only"), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.kind, r.text) for r in ch.split_blocks(docs).orderBy("doc_id", "block_ix").collect()]
    assert got == [(1, "heading", "Head"), (1, "paragraph", "a  co   b   c   d  e!"), (1, "list_item", "x"), (1, "image", "al by"), (1, "formula", "x"),
                   (1, "paragraph", "$$open"), (1, "paragraph", "![broken"), (2, "paragraph", "plain words only")]
