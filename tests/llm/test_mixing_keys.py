from gridspark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_spreads_rows_without_an_id(spark):
    """No window or list holds more than the rows that are equal in id, source and text."""
    rows = [(None, f"text number {i} of some words", "en", f"s{i % 3}", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.materialise(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number" in plan
    keys = [line for line in plan.splitlines() if "Window [row_number" in line]
    assert all("hash#" in k and "source#" in k for k in keys), keys
    taken = {(r.source, r.size): r.taken for r in mixing.mix(docs).groupBy("source", "size").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    assert got.count() * 6 == sum(taken.values())
