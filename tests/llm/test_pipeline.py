"""Each stage of the pipeline against what it ought to keep of its own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "line_dedup", "simhash", "decontamination", "bpe"]
    steps = dict(P.STAGES)

    good = steps["quality"](spark, docs, DATA).cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert good.columns == columns and good.count() < docs.count()
    lost = docs.join(good, "doc_id", "left_anti").join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert lost < 0.1

    lines = steps["line_dedup"](spark, good, DATA).cache()
    assert lines.columns == columns and lines.count() == good.count() and lines.where("n_chars != length(text)").count() == 0
    kept = lines.select(F.explode(F.split("text", "\n")).alias("l")).where("l rlike '\\\\S'")
    assert kept.count() == kept.distinct().count()

    one = steps["simhash"](spark, lines, DATA).cache()
    from pixelweft.llm import simhash

    groups = simhash.near_duplicates(lines).select("component_id").distinct().count()
    assert one.columns == columns and one.count() == groups and one.join(lines, columns, "left_semi").count() == groups

    clean = steps["decontamination"](spark, one, DATA).cache()
    from pixelweft.llm import decontam

    found = decontam.decontaminate(one, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert clean.columns == columns and clean.count() == found.where("not contaminated").count() < one.count()

    last = steps["bpe"](spark, clean, DATA)
    assert last.count() == clean.count()
    assert last.join(clean, "doc_id").where("decoded_sha256 != sha2(coalesce(text, ''), 256)").count() == 0
    assert {tuple(r) for r in P.run(spark, DATA).collect()} == {tuple(r) for r in last.collect()}


def test_empty_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, DATA).count() == 0
