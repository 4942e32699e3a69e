import csv
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from citesieve.operators import review as r
from citesieve.operators import screening as s
from citesieve.sources import citations as c
from citesieve.sources import config as cf
from citesieve.sources import sinks

CRITERIA = [{"label": "I", "statement": "s", "type": "include"}]


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "wb") as handle:
        handle.write(text if isinstance(text, bytes) else text.encode())
    return path


def test_csv(spark, folder):
    path = write(folder, "a.csv", '﻿Title,ABSTRACT,DOI,Notes,\r\n"A ""q"" t","line1\nline2, x",https://doi.org/10.1/x, n1 ,\r\n\r\nB,,,,\r\n'
                 ',,,only notes,\r\nC,abs,,,hidden\r\nD,abs,,,,over\r\nE\r\n"F" x,abs\r\nG,abs,,,,  \r\n')
    good, bad = c.read_citations_csv(spark, path, "b1")
    rows = {x.row: x for x in good.collect()}
    assert set(rows) == {1, 3, 7, 9}
    assert rows[1].title == 'A "q" t' and rows[1].abstract == "line1\nline2, x" and rows[1].doi == "10.1/x"
    assert rows[1].extra == {"DOI": "https://doi.org/10.1/x", "Notes": "n1"} and rows[7].abstract == ""
    assert {x.row: x.reject_reason for x in bad.collect()} == {
        5: "value_in_unnamed_column", 6: "more_values_than_header", 8: "malformed_csv"}


def test_csv_in_many_blocks_keeps_row_numbers(spark, folder):
    lines = ["title,abstract"] + [f'"t{i}","a{i}\nsecond, line"' if i % 3 else f"t{i},a{i}" for i in range(1, 4001)]
    path = write(folder, "big.csv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        good, bad = c.read_citations_csv(spark, path, "b")
        assert good.filter(F.col("title") == F.concat(F.lit("t"), "row")).count() == 4000 and bad.isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_quote_inside_a_field_is_data(spark, folder):
    head = [f"g{i},a{i}" for i in range(10)]
    lines = ["title,abstract", *head, 'bad,12" screen', 'x"y"z,"q, ""w"""', '"two', 'lines",end"ing', '"say ""hi', '"" there",b', *[f"h{i},b{i}" for i in range(1000)]]
    path = write(folder, "q.csv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        good, bad = c.read_citations_csv(spark, path, "b")
        rows = [(x.row, x.title, x.abstract) for x in good.orderBy("row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(i, *r) for i, r in enumerate(csv.reader(open(path, newline=""))) if i]
    assert rows == want and len(rows) == 1014 and bad.isEmpty()


def test_csv_that_ends_inside_a_quote_is_refused(spark, folder):
    with pytest.raises(ValueError, match="quoted"):
        c.read_citations_csv(spark, write(folder, "u.csv", 'title,abstract\na,b\nc,"open\nd,e\n'), "b")


def test_files_of_one_folder(spark, folder):
    write(folder, "a.csv", "title,abstract\na,b\n")
    write(folder, "b.csv", "title,abstract\nc,d\n")
    good, _ = c.read_citations_csv(spark, folder, "b")
    assert sorted((x.batch_id, x.row, x.title) for x in good.collect()) == [("b/a.csv", 1, "a"), ("b/b.csv", 1, "c")]
    write(folder, "c.csv", "abstract,title\nc,d\n")
    with pytest.raises(ValueError, match="headers"):
        c.read_citations_csv(spark, folder, "b")


def test_ris_without_a_first_line_is_one_reject(spark, folder):
    good, bad = c.read_citations_ris(spark, write(folder, "n.ris", "\n" + "TI  - a\n" * 500), "b")
    assert good.isEmpty() and [tuple(x) for x in bad.collect()] == [("b", 0, "record_must_start_with_ty", 2)]


@pytest.mark.parametrize("header", ["title,Title,abstract", "title,notes"])
def test_csv_header_faults(spark, folder, header):
    with pytest.raises(ValueError):
        c.read_citations_csv(spark, write(folder, "h.csv", header + "\nx,y,z\n"), "b")


def test_limits_and_extra(spark):
    df = spark.createDataFrame([("t", "a", "x ", " y")], "title string, Abstract string, DOI string, `My note` string")
    assert c.with_extra_map(df).first().extra == {"DOI": "x", "My note": "y"}
    with pytest.raises(ValueError):
        c.enforce_record_limit(spark.range(5), 4)
    assert c.enforce_record_limit(spark.range(5), 5).count() == 5


def test_ris(spark, folder):
    path = write(folder, "a.ris", "TY  - JOUR\nTI  - Title one\n continued\nAU  - Doe, J\nAU  - Roe, R\nPY  - 2020/01/02\nDO  - doi:10.1/abc\nER  - \n\n"
                 "TY  - JOUR\nN2  - abs only\nJO  - Journal\nTY  - JOUR\nTI  - third\nER  -\nstray\nTY  - JOUR\nAU  - nobody\nER  -\n"
                 "TY  - JOUR\nT1  -  \nCT  - Fallback\nA1  - One\nER  -\nTY  - JOUR\nTI  - open\n")
    good, bad = c.read_citations_ris(spark, path, "b1")
    rows = {x.row: x for x in good.collect()}
    assert set(rows) == {1, 5}
    assert rows[1].title == "Title one\ncontinued" and rows[1].authors == "Doe, J; Roe, R" and rows[1].year == "2020" and rows[1].doi == "10.1/abc"
    assert rows[1].extra["AU"] == "Doe, J\nRoe, R" and rows[5].title == "Fallback" and rows[5].authors == "One"
    assert {x.row: (x.reject_reason, x.line_number) for x in bad.collect()} == {
        2: ("record_without_er", 10), 3: ("record_must_start_with_ty", 16), 4: ("neither_title_nor_abstract", 17), 6: ("record_without_er", 25)}


def test_criteria(spark, folder):
    doc = {"schema_version": "2.2", "criteria": [{"label": "A", "statement": "s", "type": "include", "confidence_threshold": 0.9},
                                                {"label": "B", "statement": "t", "type": "exclude", "explicit_evidence_required": True}]}
    listed = cf.criteria_list(cf.read_criteria(spark, write(folder, "c.json", json.dumps(doc))))
    assert [(x["ord"], x["label"], x["confidence_threshold"]) for x in listed] == [(0, "A", 0.9), (1, "B", 0.8)]
    doc["criteria"] = [{"label": " B ", "statement": "s", "type": "exclude"}, {"label": "B", "statement": " ", "type": "exclude"}]
    faults = cf.check_criteria(cf.read_criteria(spark, write(folder, "d.json", json.dumps(doc))))
    assert {x.reject_reason for x in faults.collect()} == {"repeated_label", "blank_statement", "no_include_criterion"}


def test_field_table(spark, folder):
    doc = {"schema_version": "3.0", "groups": [
        {"label": "G", "fields": [{"id": "a", "label": "A", "description": "d", "value_type": "array", "allowed_values": ["x"]}, {"id": "b", "label": "B", "description": "d"}]}]}
    fields = cf.read_field_table(spark, write(folder, "f.json", json.dumps(doc)))
    assert [(f["group"], f["id"], f["value_type"]) for f in cf.field_list(fields)] == [("G", "a", "array"), ("G", "b", "string")]
    doc["groups"] += [{"label": "G", "fields": []}, {"label": "H", "fields": [{"id": "A!", "label": "A", "description": "d"}, {"id": "b", "label": "C", "description": "d"}]}]
    faults = cf.check_field_table(cf.read_field_table(spark, write(folder, "g.json", json.dumps(doc))))
    assert {x.reject_reason for x in faults.collect()} == {"repeated_group", "empty_group", "malformed_id", "repeated_label", "repeated_id"}


def test_library(spark, folder):
    path = write(folder, "l.csv", "Title,DOI,PDF_path\nA,10.1/a,x/a.pdf\n,,\nB,,\n,,c.pdf\nD,,d.pdf,over\n")
    good, bad = c.read_library_csv(spark, path)
    assert [(x.library_row, x.title, x.pdf_path) for x in good.collect()] == [(1, "A", "x/a.pdf")]
    assert {x.library_row: x.reject_reason for x in bad.collect()} == {
        3: "needs_pdf_path_and_title_or_doi", 4: "needs_pdf_path_and_title_or_doi", 5: "more_values_than_header"}
    with pytest.raises(ValueError):
        c.read_library_csv(spark, write(folder, "m.csv", "title,doi\nA,b\n"))


def test_inventory_and_documents(spark, folder):
    write(folder, "a b.pdf", b"%PDF-1.7 hello")
    write(folder, "A B.PDF", b"%PDF-1.7 other")
    write(folder, "bad.pdf", b"nothing")
    write(folder, "large.pdf", b"%PDF-" + b"x" * 100)
    write(folder, "note.txt", b"text")
    files = cf.scan_pdf_inventory(spark, folder, max_bytes=50)
    got = {x.filename: (x.file_error, x.sha256 is not None) for x in files.collect()}
    assert got == {"a b.pdf": (None, True), "A B.PDF": (None, True), "bad.pdf": ("invalid_signature", False),
                   "large.pdf": ("exceeds_size_limit", False), "note.txt": ("invalid_signature", False)}
    usable, refused = cf.check_documents(files)
    assert {x.stem for x in usable.collect()} == {"bad", "large"}
    assert {x.reject_reason for x in refused.collect()} == {"stem_not_unique", "unsupported_type"}


def test_sinks(spark, folder):
    df = spark.createDataFrame([("b", 1, "=T", "A \"q\", x\ny"), ("b", 2, "U", "")], "batch_id string, row long, title string, abstract string")
    out = s.screen_classifier(df, CRITERIA, lambda c: F.array(F.lit(0.9), F.lit(0.05), F.lit(0.05)))
    sinks.write_screening_wide(out, CRITERIA, f"{folder}/wide")
    rows = [row for f in glob.glob(f"{folder}/wide/*.csv") for row in csv.DictReader(open(f, newline=""))]
    rows.sort(key=lambda row: int(row["row"]))
    assert len(rows) == 2 and rows[0]["title"] == "'=T" and rows[0]["abstract"] == 'A "q", x\ny' and rows[0]["I (threshold)"] == "0.8" and len(rows[0]) == 31
    assert r.validate_results(out).isEmpty()


def test_write_table_replaces_only_its_partitions(spark, folder):
    path = f"{folder}/t"
    sinks.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "batch_id string, x int"), path)
    sinks.write_table(spark.createDataFrame([("b", 3)], "batch_id string, x int"), path)
    assert {(x.batch_id, x.x) for x in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    sinks.write_table(spark.range(10).withColumnRenamed("id", "doc_id"), f"{folder}/u", buckets=4)
    assert spark.read.parquet(f"{folder}/u").count() == 10


def test_files_of_one_name_keep_their_rows_apart(spark, folder):
    for part in ("d1", "d2"):
        os.makedirs(f"{folder}/{part}")
        with open(f"{folder}/{part}/x.csv", "w") as out:
            out.write("title,abstract\nsame,same\n")
    good, rejects = c.read_citations_csv(spark, f"{folder}/d*/x.csv", "b")
    assert sorted((r.batch_id, r.row) for r in good.collect()) == [("b/d1/x.csv", 1), ("b/d2/x.csv", 1)] and rejects.count() == 0


def test_long_ris_records_are_read_once(spark, folder):
    path = f"{folder}/long.ris"
    with open(path, "w") as out:
        out.write("TY  - JOUR\nTI  - a title\n" + "".join(f"KW  - word {i}\n" for i in range(2_000)) + "AB  - begins\n" + "goes on\n" * 2_000 + "ER  - \n")
    start = time.time()
    good, rejects = c.read_citations_ris(spark, path, "b")
    row = good.first()
    assert row.title == "a title" and row.abstract.count("goes on") == 2_000 and rejects.count() == 0
    assert time.time() - start < 60
