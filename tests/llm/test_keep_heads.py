import random

from gridspark.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(3000)]


def test_null_ids_and_one_id_on_two_texts(spark):
    rng = random.Random(1)
    a, b, c, d = (" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(4))
    rows = [(None, a, "en", "web", 1), (None, a, "en", "web", 1), (None, b, None, None, 1), (7, c, "en", "web", 1), (7, d, "en", "web", 1),
            (3, d, "de", "web", 1), (None, c, "en", "web", 1)]
    got = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(((r.doc_id or 0), r.text) for r in got.collect()) == sorted([(0, a), (0, b), (7, c), (3, d)])
