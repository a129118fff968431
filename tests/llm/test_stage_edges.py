"""Each stage alone on nulls, empty texts, repeated rows and columns named like an operator's own."""

from gridspark.llm import jaccard, mixing, packing, quality, secret_scan, simhash

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _row long, _n long, _key long, d long, copy long, hash long, label long, "
    "cuts string, m map<string,int>, `a.b` long"
)
A, B = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(80))
EXTRA = (1, 2, 3, 4, 5, 6, 7, "c", {"x": 1}, 9)
ROWS = [
    (None, None, None, None, None, *EXTRA), (None, A, "en", None, 9, *EXTRA), (None, B, "en", "web", 9, *EXTRA), (1, A, "en", "web", 9, *EXTRA),
    (2, "", None, "web", 0, *EXTRA), (2, "", None, "web", 0, *EXTRA), (3, B, "de", "web", 9, *EXTRA),
]


def rest(rows):
    return {repr(tuple(r)[5:]) for r in rows}


def test_near_dedup(spark):
    got = simhash.deduplicate(spark.createDataFrame(ROWS, SCHEMA), width=5).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in got) == sorted([(1, A), (3, B), (2, "")])
    assert rest(got) == {repr(EXTRA)}


def test_near_dedup_by_sets(spark):
    got = jaccard.deduplicate(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in got) == sorted([(1, A), (3, B), (2, "")])
    assert rest(got) == {repr(EXTRA)}


def test_quality_rules(spark):
    """Null and empty texts go, repeated rows and null ids stay with all their columns; without labels the base rule alone decides."""
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame(ROWS + ROWS[3:4], SCHEMA)
    got = quality.select_good(docs, labels).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in got) == sorted([(0, A), (0, B), (1, A), (1, A), (3, B)])
    assert rest(got) == {repr(EXTRA)} and quality.select_good(docs.limit(0), labels).count() == 0


def test_secrets(spark):
    got = secret_scan.redact(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS) and rest(got) == {repr(EXTRA)}


def test_mixing_and_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = mixing.materialise(docs).collect()
    assert rest(got) == {repr(EXTRA)} and {r.text for r in got} >= {A, B}
    assert sum(len((r.text or "").split()) for r in got) == sum(r.taken for r in mixing.mix(docs).collect())
    assert packing.pack(docs).count() == len(ROWS)
