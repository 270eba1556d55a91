"""Tables by their own headers, briefs by file, and the audit log."""

import json

import pytest
from pyspark.sql import functions as F

from peptrellis.sources.audit import Audit
from peptrellis.sources.files import headers, read_briefs, read_peptide_columns


def put(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode())


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    put(tmp_path, "a.csv", "id,Sequence\n1,ACDEFGHIK\n2, acdefghikl \n3,AXDEFGHIK\n4,ACD\n")
    put(tmp_path, "deep/b.csv", '\n"PEPTIDE_SEQUENCE","note, with comma",id\nKLMNPQRST,"x, y",1\n"WYWYWYWYW",,\n')
    put(tmp_path, "c.tsv", "﻿seq\tother\tSEQ\r\nVVVVVVVVV\tq\tLLLLLLLLL\r\nACDEFGHIK\tq\t\r\n")
    put(tmp_path, "d.csv", "id,peptide\n1,TTTTTTTTT\n")
    put(tmp_path, "empty.csv", "")
    found = sorted(r.sequence for r in read_peptide_columns(spark, str(tmp_path), 8, 40).collect())
    assert found == ["ACDEFGHIK", "ACDEFGHIKL", "KLMNPQRST", "LLLLLLLLL", "VVVVVVVVV", "WYWYWYWYW"]
    assert headers(spark, str(tmp_path)).count() == 4


def test_a_header_in_a_file_of_many_blocks(spark, tmp_path):
    put(tmp_path, "a.csv", "seq\n" + "".join(f"{'ACDEFGHIKL'[k % 10] * 8}{'KLMN'[k % 4] * 3}\n" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert headers(spark, str(tmp_path)).collect()[0].header == "seq"
        assert read_peptide_columns(spark, str(tmp_path), 8, 40).count() == len({("ACDEFGHIKL"[k % 10], "KLMN"[k % 4]) for k in range(3000)})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_sequence_column_anywhere_is_an_error(spark, tmp_path):
    put(tmp_path, "a.csv", "id,peptide\n1,ACDEFGHIK\n")
    with pytest.raises(ValueError):
        read_peptide_columns(spark, str(tmp_path), 8, 40)


def test_one_brief_a_file(spark, tmp_path):
    put(tmp_path, "one.json", json.dumps({"brief_id": 1, "functions": {"primary": "antioxidant"}, "peptide": {"max_length": 9}}, indent=2))
    put(tmp_path, "sub/two.json", json.dumps({"brief_id": 2, "target_depth": "surface", "product": {"ph": 6.1}}, indent=2))
    found = {r.file.rsplit("/", 1)[1]: (r.brief_id, r.primary, r.depth, r.min_length, r.max_length, r.ph) for r in read_briefs(spark, str(tmp_path), one_a_file=True).collect()}
    assert found == {"one.json": (1, "antioxidant", "epidermis", 6, 9, 5.5), "two.json": (2, "collagen_ecm", "surface", 6, 12, 6.1)}


def test_the_log_of_a_run(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.range(100)
    other = Audit(spark, path, "other").start()
    other.stage("only", rows, lambda r: r)
    log = Audit(spark, path, "mine").start("first")
    log.stage("left over", rows, lambda r: r)
    log.start("brief has no pH")
    kept = log.stage("even", rows, lambda r: r.where("id % 2 = 0"), warn={"small": F.col("id") < 7, "never": F.col("id") < 0})
    assert kept.count() == 50
    none = log.stage("none", kept, lambda r: r.where("id < 0"))
    log.stage("after none", none, lambda r: r)
    with pytest.raises(Exception, match="gone"):
        log.stage("broken", kept, lambda r: r.where(F.raise_error(F.lit("gone")).isNull()))
    found = [(r.no, r.kind, r.stage, r.n_in, r.n_out, r.n_removed) for r in log.read().orderBy("no").collect()]
    assert found == [(0, "setup", "run", None, None, None), (1, "stage", "even", 100, 50, 50), (2, "stage", "none", 50, 0, 50), (3, "stage", "after none", 0, 0, 0), (4, "failure", "broken", None, None, None)]
    warnings = {r.stage: list(r.warnings) for r in log.read().collect()}
    assert warnings["run"] == ["brief has no pH"] and warnings["even"] == ["small: 7"] and len(warnings["broken"]) == 1
    assert [r.stage for r in other.read().orderBy("no").collect()] == ["run", "only"]
    assert all(r.duration_s >= 0 and r.ts is not None for r in log.read().collect())
