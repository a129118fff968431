import corpus_pipeline as P
from gridspark.llm import quality
from gridspark.llm.common import table

D = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, D, "documents")
    columns = docs.columns
    frames = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, D)
        docs.write.parquet(str(tmp_path / name))
        docs = frames[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    ids = {k: [r.doc_id for r in f.select("doc_id").collect()] for k, f in frames.items()}
    judged = quality.judge(table(spark, D, "documents"), table(spark, D, "labels"))
    assert sorted(ids["quality_rules"]) == sorted(r.doc_id for r in judged.filter("kept").collect())
    assert set(ids["simhash_near_dedup"]) < set(ids["quality_rules"])
    assert len(ids["simhash_near_dedup"]) == len(set(ids["simhash_near_dedup"]))
    assert sorted(ids["secret_scans"]) == sorted(ids["simhash_near_dedup"])
    assert frames["secret_scans"].filter("text like '%[SECRET]%'").count() > 0
    assert frames["secret_scans"].filter("text rlike '[0-9a-f]{32}'").count() == 0
    assert set(ids["mixing_sources"]) <= set(ids["secret_scans"])
    assert set(ids["packing"]) == set(ids["mixing_sources"])


def test_empty_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, D)
        assert docs.count() == 0
