"""The pipeline's stages one by one: what goes, what stays, and the shape of what they return."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_the_columns_and_drop_what_they_should(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copy = docs.filter("doc_id = 4").withColumn("doc_id", F.lit(900_001).cast("long"))
    silent = docs.filter("doc_id = 6").withColumns({"doc_id": F.lit(900_002).cast("long"), "text": F.lit("12 34 !!"), "lang": F.lit(None).cast("string")})
    rude = docs.filter("doc_id = 7").withColumns({"doc_id": F.lit(900_003).cast("long"), "text": F.concat("text",
        F.lit(" idiot moron scum trash worthless clown"))})
    docs = docs.unionByName(copy).unionByName(silent).unionByName(rude)
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, sf_dir).cache()
        assert after.columns == before, name
        ids = {r[0] for r in after.select("doc_id").distinct().collect()}
        was = {r[0] for r in docs.select("doc_id").distinct().collect()}
        assert ids <= was
        if name == "toxicity":
            assert 900_003 not in ids and {900_001, 900_002} <= ids
        if name == "language_id":
            assert 900_002 not in ids and len(ids) >= 0.97 * len(was)
        if name == "near_dedup":
            assert 900_001 not in ids
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_near_dedup_judges_rows_by_their_texts(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "ABCD"}
    rows = [(5, "A"), (9, "A"), (3, "B"), (5, "B"), (None, "C"), (None, "C+"), (None, "D"), (8, "D+"), (8, "D"),
        (7, "C-"), (7, "C-"), (None, None), (1, None), (1, None)]
    near = {"C+": texts["C"] + " more", "D+": texts["D"] + " more", "C-": "alone " * 3 + "text", None: ""}
    docs = spark.createDataFrame([(i, {**texts, **near}[x], "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    names = sorted((r["text"][:1], r["doc_id"]) for r in kept if r["text"] and r["text"][:1] in "ABD")
    assert names == [("A", 5), ("B", 3), ("D", 8)]
    assert sum(r["text"].startswith("C") for r in kept) == 1
    assert sorted((str(r["doc_id"]) for r in kept if r["text"] == "" or r["text"].startswith("alone"))) == ["1", "7", "None"]
