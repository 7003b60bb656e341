"""The stages of the pipeline on edge cases: nulls, empty texts, repeated rows, clashing columns, no rows, no labels."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"
CLASH = {"rid": "x", "__rid": "y", "gone": "z", "node": 1, "component_id": 2, "key": 3, "batch": 4, "lang_pred": "q", "n_removed": 5}
A, B = prose(1, 60), prose(2, 60)
ROWS = [(1, A), (2, A + " tail"), (3, None), (4, ""), (5, "12 !"), (6, B), (6, B), (None, prose(3, 40)), (7, B.replace(" ", "\n", 3)), (8, prose(4, 30) + "\n" + prose(5, 30)), (9, prose(6, 20) + "\n" + prose(5, 30))]
STAGE = dict(P.STAGES)


def table(spark, rows, lang="en"):
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.mark.parametrize("name", list(STAGE))
def test_no_rows_in_no_rows_out(spark, name):
    docs = table(spark, [])
    out = STAGE[name](spark, docs, SF)
    assert out.count() == 0
    if name != "packing":
        assert out.columns == docs.columns


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_language(spark):
    docs = table(spark, ROWS)
    out = STAGE["language"](spark, docs, SF)
    assert ids(out) == Counter({1: 1, 2: 1, 6: 2, None: 1, 7: 1, 8: 1, 9: 1}) and out.columns == docs.columns
    assert {r["rid"] for r in out.collect()} == {"x"}
    # without a labelled row every text with a letter stays
    assert ids(STAGE["language"](spark, docs.withColumn("lang", F.lit(None).cast("string")), SF)) == ids(out)


def test_lines(spark):
    docs = table(spark, ROWS)
    out = STAGE["lines"](spark, docs, SF)
    rows = out.collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert out.columns == docs.columns and {r["__rid"] for r in rows} == {"y"}
    assert texts[3] is None and texts[4] == "" and texts[5] == "12 !" and texts[8].count("\n") == 1 and texts[9] == prose(6, 20)
    assert 2 not in texts  # its only line is nearly that of 1
    assert all(r["n_chars"] is None if r["text"] is None else r["n_chars"] == len(r["text"]) for r in rows)


def test_near_duplicates(spark):
    docs = table(spark, ROWS)
    out = STAGE["near_duplicates"](spark, docs, SF)
    assert ids(out) == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 2, None: 1, 8: 1, 9: 1}) and out.columns == docs.columns
    assert {r["component_id"] for r in out.collect()} == {2}


def test_decontamination(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").orderBy(F.desc(F.length("text"))).first()["text"]
    rows = [*ROWS, (20, prose(7, 30) + " " + item + " " + prose(8, 30)), (21, prose(9, 30)), (21, item), (None, item)]
    docs = table(spark, rows)
    out = STAGE["decontamination"](spark, docs, SF)
    assert ids(out) == ids(table(spark, ROWS)) and out.columns == docs.columns


def test_packing(spark):
    out = STAGE["packing"](spark, table(spark, ROWS), SF).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in ROWS)
    assert {r["doc_id"]: r["length"] for r in out}[3] == 1
