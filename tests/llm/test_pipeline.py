"""The pipeline's stages: what each drops or changes, and that the columns stay."""

import corpus_pipeline
import pytest
from codequarry.llm.common import materialize
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LEARN = "/root/testdata/sf0.01"  # the smallest tables have 58 labels to learn from, of which 7 are toxic


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = " ".join(f"w{i}" for i in range(80))
    planted = spark.createDataFrame(
        [
            (900001, "You idiot moron. You stupid worthless scum, pathetic loser clown trash. Disgusting idiot."),
            (900002, long + " end"),
            (900003, long + " fin"),
            (900004, "before " + bench + " after"),
            (900005, "all clear here and api_key = 'Zz9Yy8Xx7Ww6Vv5Uu4' besides"),
            (900006, None),
        ],
        "doc_id long, text string",
    ).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("srcX").alias("source"), F.length("text").cast("long").alias("n_chars"))
    now = docs.unionByName(planted)
    left = []
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, LEARN if name == "toxicity" else SF))
        left.append({r.doc_id for r in now.select("doc_id").collect()})
        if name != "packing":
            assert now.columns == docs.columns
        if name == "secrets":
            rows = {r.doc_id: r for r in now.collect()}
            assert rows[900005].text == "all clear here and [SECRET]' besides" and rows[900005].n_chars == len(rows[900005].text)
    toxic, unique, clean, redacted, packed = left
    assert 900001 not in toxic and {900002, 900003, 900004, 900005, 900006} <= toxic
    assert 900002 in unique and 900003 not in unique and {900004, 900005, 900006} <= unique
    assert 900004 not in clean and {900002, 900005, 900006} <= clean
    assert clean == redacted == packed
    assert len(packed) > 0.7 * docs.count()


def test_run_gives_the_packed_pieces(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "bin_id", "bin_capacity"} <= set(rows.columns) and rows.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"])
def test_stages_on_odd_tables(spark, name):
    """Nulls, empties, repeated rows and columns named like those that stages make; and a table without rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, None, None), (1, None, None), (2, "", "en"), (None, "some words stand here alone", "en"), (None, None, None), (3, "words " * 3000 + "end", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "cast(null as string) as source", "cast(length(text) as long) as n_chars", "1 as id", "'x' as component_id", "2 as kept", "3 as score", "4 as piece", "'y' as spans", "5 as repo")
    folder = LEARN if name == "toxicity" else SF
    out, empty = stage(spark, docs, folder), stage(spark, docs.limit(0), folder)
    assert empty.count() == 0 and empty.columns == out.columns
    ids = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    if name == "packing":
        assert set(ids) <= {"1", "2", "3", "None"} and "3" in ids
    else:
        assert out.columns == docs.columns
        # rows that are equal in id and text are one document to the stage that looks for copies
        assert set(ids) == {"1", "2", "3", "None"} and (name == "near_duplicates" or len(ids) == 6)
