import random

import corpus_pipeline
from sensorloom.llm import rules


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(9)
    clean = [" ".join(rng.choice(["river", "stone", "tree", "cloud", "bird", "road", "lamp"]) + chr(97 + rng.randrange(26)) for _ in range(60)) for _ in range(120)]
    rows = [(k, t, "en") for k, t in enumerate(clean)]
    rows += [(500 + k, clean[k] + " end", "en") for k in range(20)]  # near copies
    rows += [(600 + k, " ".join(w + "##" for w in clean[k].split()), "en") for k in range(40)]  # junk
    rows += [(700 + k, clean[k] + " vile " + clean[k + 40], "en") for k in range(40)]  # toxic
    rows += [(800, None, None), (801, "", "en"), (3, clean[3], "en"), (None, clean[119] + " other tail of words that differ in many places indeed yes", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, 0) for k in range(0, 120, 2)] + [(600 + k, 0, 0) for k in range(0, 40, 2)] + [(700 + k, 1, 1) for k in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        path = str(tmp_path / name)
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None))
    graded, ruled, deduplicated = seen
    assert set(range(120)) <= set(graded) and not set(graded) & set(range(600, 740))
    assert ruled == [i for i in graded if i not in (800, 801)]
    assert deduplicated == sorted({i for i in ruled if not 500 <= i < 520})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out if r["doc_id"] is not None} == set(deduplicated)
    assert rules.POLICIES["full-1"].mask == 2 ** len(rules.RULES) - 1
