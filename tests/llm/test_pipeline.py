"""The pipeline's stages on their own and together."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from loomsky.llm import near_dup

from ..conftest import SF


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, f in p.STAGES:
        out.append(p.stored(f(spark, out[-1], SF)))
    return out


def test_order_and_columns(steps):
    assert [n for n, _ in p.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources", "token-ID output"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    counts = [s.count() for s in steps]
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[4] == counts[5]


def test_each_stage_did_its_work(spark, steps):
    docs, good, single, clean, mixed, _ = steps
    junk = "length(regexp_replace(text, '[^#%&*$]', '')) * 5 > length(text)"
    assert not docs.where(junk).isEmpty() and good.where(junk).isEmpty()
    assert near_dup.near_duplicates(single).where("not kept").isEmpty()
    classes = near_dup.near_duplicates(good).where("kept").select("doc_id")
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted(r.doc_id for r in classes.collect())
    assert p.contaminated(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()
    leaks = p.contaminated(single, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct().count()
    assert single.count() - clean.count() == leaks
    assert mixed.join(clean, "doc_id", "left_anti").isEmpty()


def test_run_equals_its_stages(spark, steps):
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, steps[-1].collect()))


def test_odd_rows(spark, tmp_path):
    text = "plain words that say a thing or two about nothing much"
    rows = [(1, text, "en", "src1", 1), (1, text, "en", "src1", 1), (2, text, None, None, None), (None, text, "en", "src2", 1), (3, None, "en", "src1", 0), (4, "", "en", "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("x"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for at in (docs, docs.limit(0)):
        kept = []
        for _, f in p.STAGES:
            at = p.stored(f(spark, at, str(tmp_path)))
            kept.append(sorted(r.doc_id or 0 for r in at.collect()))
        assert kept[:3] in ([[0, 1, 1, 2], [0, 1], [0, 1]], [[], [], []])
