"""Nulls, repeats, ties, empty tables, very long texts and clashing names, for every operator and stage."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tradescope.llm import align, chat, common, dedup, language, lm, merkle, mil, mixing, packing, quality, search, toxicity, urls
from tradescope.llm.queries import RULES

#: Names that the operators use inside or return.
CLASHING = "tree pos run leaf own hash n kids chunk pair planes attention score predicted row row_key first_row class slots choice label node members path _u _id _y0 key slot size source_size target taken times budget epochs extra before s weight quality quality_weight lang_pred toxic p_toxic p_poor copy piece start length offset kept sequence_id column_0_set_aside".split()
LONG = " ".join(f"word{i % 977} passage{i % 31}" for i in range(60_000))


def texts_of(n, seed=0):
    r = random.Random(seed)
    words = "the river and the market of a quiet town in winter where people read letters".split()
    return [" ".join(r.choice(words) + ("" if r.random() < 0.5 else str(r.randrange(30))) for _ in range(60)) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, repeated ids of different texts, null ids, null and empty texts, a very long one."""
    texts = texts_of(40)
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (5, texts[6], "en", None, 1), (None, texts[7], None, "a", 1), (None, texts[7], None,
        "a", 1), (None, None, None, None, None), (50, None, "en", "b", 0), (51, "", "en", "b", 0), (52, " \n\t ", "en",
        "b", 4), (53, LONG, "en", "a", len(LONG))]
    return table(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None),
        (5, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")


RUNS = {
    "toxicity": lambda d, labels: toxicity.classify_toxicity(d, labels).select("doc_id", "p_toxic", "toxic"),
    "language": lambda d, labels: language.identify_languages(d).select("doc_id", "lang_pred", "score"),
    "dedup": lambda d, labels: dedup.near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept"),
    "mixing": lambda d, labels: mixing.mix_sources(d).select("doc_id", "size", "source_size", "target", "taken"),
    "packing": lambda d, labels: packing.pack_documents(d).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "quality": lambda d, labels: quality.judge_quality(d).select("doc_id", "n_words", "n_dup_lines", "base_failed", "kept"),
    "alignment": lambda d, labels: align.align_tokenizers(d).select("doc_id", "n_a", "n_b", "n_best", "count_sum", "groups_sha256"),
    "mil": lambda d, labels: mil.score_quality(d, labels).select("doc_id", "score", "predicted"),
    "merkle": lambda d, labels: merkle.manifest(d, F.col("doc_id") % 3 == 0),
    "lm": lambda d, labels: lm.score_documents(d, labels.filter("quality = 1")),
}


def rounded(rows):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_rows_in_rows_out_whatever_further_columns_are_called(spark, docs, labels, name):
    plain = RUNS[name](docs, labels).collect()
    if name != "packing":
        assert len(plain) == docs.count()
    wide = docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    assert rounded(RUNS[name](wide, labels).collect()) == rounded(plain)
    again = RUNS[name](docs.repartition(7), labels).collect()
    assert rounded(again) == rounded(plain)
    assert RUNS[name](wide.limit(0), labels).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = run(spark, docs, str(tmp_path))
    wide = docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    found = run(spark, wide, str(tmp_path))
    if stage != "packing":
        assert plain.columns == docs.columns and found.columns == wide.columns
        assert all(set(r[len(docs.columns) :]) == {"x"} for r in found.collect())
        kept = Counter(map(tuple, found.select(docs.columns).collect()))
        given = Counter(map(tuple, docs.collect()))
        assert kept == Counter(map(tuple, plain.collect())) and set(kept) <= set(given)
        if stage == "language_id":
            assert sum(kept.values()) == sum(n for r, n in given.items() if re.search(r"[^\W\d_]", r[1] or ""))
        if stage == "near_dedup":
            assert sorted(str(r[0]) for r in kept if r[1] and r[1].strip() and r[0] != 53) == sorted(["5", *(str(i) for i in range(40) if i != 6)])
            assert max(kept.values()) == 1 and sum(not (r[1] or "").strip() for r in kept) == 4
    else:
        pieces = found.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
        assert len(pieces) == docs.select("doc_id").distinct().count() and max(p["n"] for p in pieces) > 100_000
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert run(spark, docs, f"{tmp_path}/none").count() > 0


def test_samples_are_bounded_and_never_empty(spark):
    texts = texts_of(50)
    same = table(spark, [(1, "the river and the market", "en", "a", 1)] * 3000 + [(None, t, "en", "a", 1) for t in texts] + [(2,
        "der Fluss und die Stadt", "de", "a", 1)])
    found = language.identify_languages(same, sample=10, keep_text=True).select("text", "lang_pred").distinct().collect()
    assert {r["lang_pred"] for r in found if "Fluss" in r["text"]} == {"de"}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    most = {True: 10, False: 10}
    assert common.labelled_sample(same, labels, ["toxic"], most).count() == 2
    many = table(spark, [(1, t, "en", "a", 1) for t in texts] + [(2, "x", "en", "a", 1)])
    assert common.labelled_sample(many, labels, ["toxic"], most).count() == 11


def test_labels_of_absent_documents_leave_the_sample_whole(spark):
    texts = [t + (" vile brute" if i % 4 == 0 else "") for i, t in enumerate(texts_of(200))]
    docs = table(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    own = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    absent = spark.range(1000, 501_000).select(F.col("id").alias("doc_id"), (F.col("id") % 9 == 0).cast("int").alias("toxic"))
    most = {True: 4000, False: 8000}
    assert common.labelled_sample(docs, own.unionByName(absent), ["toxic"], most).count() == 200
    rows = toxicity.classify_toxicity(docs, own.unionByName(absent)).collect()
    assert {r["doc_id"] for r in rows if r["toxic"]} == set(range(0, 200, 4))
    assert common.labelled_sample(docs, absent, ["toxic"], most) is None
    for labels in (absent, own.filter("toxic = 0").unionByName(absent), own.filter("toxic = 1").unionByName(absent)):
        rows = toxicity.classify_toxicity(docs, labels).collect()
        assert len(rows) == 200 and not any(r["toxic"] or r["p_toxic"] for r in rows)


def test_language_equals_brute_force(spark):
    """The model's TF-IDF sums and calibrated probabilities, worked out text by text in plain Python."""
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts_of(30))] + [(100 + i, t.replace("the", "der").replace("and",
        "und"), "de", "a", 1) for i, t in enumerate(texts_of(30, 5))]
    texts, names = [r[1] for r in rows], ["de", "en"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify_languages(table(spark, rows)).collect()}
    grams = [Counter(language.gram_buckets([t])[0].tolist()) for t in texts]
    df = Counter(g for one in grams for g in one)
    idf = np.array([math.log((len(texts) + 1) / (df[g] + 1)) + 1 for g in range(language.BUCKETS)])
    known = table(spark, rows).select("lang", "text").withColumn("_u", language.uniform("text", "lang")).collect()
    order = sorted((r["_u"], r["lang"], r["text"]) for r in known)
    sparse = language.term_rows([t for _, _, t in order], idf)
    y = np.array([[g == n for n in names] for _, g, _ in order], dtype=np.float32)
    test = np.arange(len(order)) % 5 == 4
    w = language.Ftrl(language.BUCKETS, 2).fit([sparse[i] for i in np.flatnonzero(~test)], y[~test]).weights()
    heat = language.temperature(np.concatenate([language.dense([sparse[i]], language.BUCKETS) @ w for i in np.flatnonzero(test)]), y[test])
    for (doc_id, *_), one in zip(rows, grams, strict=True):
        margin = sum(n * idf[g] * language.SCALE * w[g].astype(float) for g, n in one.items()) / sum(one.values()) + w[-1]
        p = np.exp(margin / heat - max(margin / heat))
        p /= p.sum()
        assert found[doc_id][0] == names[int(p.argmax())] and abs(found[doc_id][1] - p.max()) < 1e-4


def test_toxicity_chain_equals_brute_force(spark):
    """Probabilities of the chain, from the fitted weights and the words of each text."""
    texts = [t + (" vile brute" if i % 4 == 0 else " dull text" if i % 4 == 1 else "") for i, t in enumerate(texts_of(80))]
    docs = table(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i % 4 < 2), int(i % 4 == 0)) for i in range(60)], "doc_id long, poor int, toxic int")
    sample = common.labelled_sample(docs, labels, ["poor", "toxic"], {True: 4000, False: 8000})
    import pickle

    words, links, bias = pickle.loads(sample.repartition(1).mapInArrow(toxicity.fit(["poor", "toxic"]), "model binary").first()["model"])
    rows = {r["doc_id"]: r for r in toxicity.classify_toxicity(docs, labels, ("poor", "toxic")).collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for i, text in enumerate(texts):
        inside = [words[w] for w in toxicity.word_set(text) if w in words]
        poor = sigmoid(sum(v[0] for v in inside) + bias[0])
        toxic = sigmoid(sum(v[1] for v in inside) + bias[1] + links[1, 0] * poor)
        assert abs(rows[i]["p_poor"] - poor) < 1e-6 and abs(rows[i]["p_toxic"] - toxic) < 1e-6
        assert rows[i]["toxic"] == (toxic >= 0.4) == (i % 4 == 0)


def test_url_probability_equals_brute_force_and_held_out_sites(spark):
    bad = ["casino-royale", "free-bets", "pills4u", "adult-x", "tracking-ads", "spamfarm", "bestcasinos", "win-prizes", "bets-online", "ads-net"]
    good = ["village", "thing", "meadow", "tionen", "bakery", "students", "antiques", "weekly", "leather", "painters"]
    pages = [(i, f"https://www.{name}.example.com/en/{i}/") for i, name in enumerate(bad + good)] + [(30, None),
        (31, "x"), (32, ""), (0, f"https://www.{bad[0]}.example.com/en/0/")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, _rule string, p_block string")
    rows = urls.judge_urls(df, RULES).collect()
    assert len(rows) == len(pages) and urls.judge_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in rows if r["page_id"] < 10} == {"block"} and {r["verdict"] for r in rows if 10 <= r["page_id"] < 20} == {"allow"}
    bias, weights = urls.train(urls.labelled_urls(spark))
    for r in rows:
        text = f"^{r['host']}${r['path']}"
        grams = {text[i : i + n] for n in urls.SIZES for i in range(len(text) - n + 1)}
        hashed = spark.createDataFrame([(g,) for g in sorted(grams)], "g string").select(F.pmod(F.xxhash64("g"),
            F.lit(urls.DIMENSIONS)).alias("j")).distinct().collect() if r["page_id"] in (0, 12, 30) else None
        if hashed is not None:
            x = bias + sum(weights[h["j"]] for h in hashed) / math.sqrt(max(len(hashed), 1))
            assert abs(r["p_block"] - 1 / (1 + math.exp(-x))) < 1e-9


def test_packing_both_openings_of_bins_leave_few_gaps():
    g = np.random.default_rng(4)
    lengths = np.minimum(g.lognormal(5.5, 1.2, 4000).astype(int) + 2, 2047)
    bins, _ = packing.sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= math.ceil(lengths.sum() / 2048) * 1.01 + 1


def test_chat_and_search_on_empty_tables_and_clashing_names(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", "z"), (1, 0, "user", "a", "z"), (None, None, None, None,
        "z")], "conv_id long, turn long, role string, text string, message_id string")
    found = {r["conv_id"]: r["n_turns"] for r in chat.digest(chat.format_conversations(chat.events_of_turns(turns))).collect()}
    assert found == {1: 2, None: 1}
    assert chat.digest(chat.format_conversations(chat.events_of_turns(turns.limit(0)))).count() == 0
    vectors = spark.createDataFrame([(i, [i, 1], "x") for i in range(6)] + [(5, [5, 1], "y")], "vec_id long, v array<bigint>, node string")
    assert search.top_k(vectors, vectors.filter("vec_id = 0"), 9).count() == 5


def test_dedup_counts_links_of_rows_without_ids(spark):
    base = texts_of(1)[0]
    rows = spark.createDataFrame([(None, base), (7, base + " one"), (9, base + " two")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in dedup.near_duplicates(rows, 4, 80).collect()) == [("7",
        7, True), ("9", 7, False), ("None", 7, False)]
    assert 0 <= dedup.sketch_share(50) < dedup.sketch_share(80) < 0.8


def test_mixing_takes_repeated_ids_and_odd_weights(spark):
    texts = texts_of(30)
    docs = table(spark, [(i % 3, t, "en", "a", 1) for i, t in enumerate(texts)])
    for weight in (None, F.lit(None).cast("double"), F.lit(-1.0), F.lit(0.0)):
        rows = mixing.mix_sources(docs, weight).collect()
        assert sum(r["taken"] for r in rows) == pytest.approx(rows[0]["target"], abs=60)


def test_toxic_repeats_get_equal_results(spark, labels):
    docs = table(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts_of(30))] * 2)
    rows = toxicity.classify_toxicity(docs, labels).collect()
    assert len(rows) == 60 and len({(r["doc_id"], r["p_toxic"]) for r in rows}) == 30
