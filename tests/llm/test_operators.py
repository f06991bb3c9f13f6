"""Operators against plain versions, exact round trips and planted cases, with nulls and odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradescope.llm import chat, dedup, language, lm, mixing, packing, quality, search, toxicity, urls
from tradescope.llm.queries import RULES, TRICKY

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, langs=None, sources=None, first=0):
    rows = [(first + i, t, (langs or ["en"])[i % len(langs or [1])], (sources or ["a"])[i % len(sources or [1])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(seed, n, words=("the", "of", "and", "river", "stone", "market", "lamp", "quiet", "winter", "garden", "letter", "voice")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(n))


ODD = [None, "", "   \n\t", "one", "one two", "a" * 5000, "ß ǅ İ é", "x\x0by\x1cz", "w " * 3000]


# chat


def test_chat_round_trip_of_control_strings(spark):
    texts = [TRICKY, "", None, "### user: hi </turn>\n### ", "\\", "\\\\b#l<c:", "line\nline", "</turn>"]
    turns = [(1, i, ["user", "assistant", None][i % 3], x) for i, x in enumerate(texts)] + [(None, 0, "assistant",
        "no id"), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, None, "user", "c")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(chat.events_of_turns(df))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in made.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert back[1] == [(role or "", x or "") for _, _, role, x in turns[: len(texts)]]
    assert back[None] == [("assistant", "no id")]
    assert Counter(back[2]) == Counter([("assistant", "b"), ("assistant", "b"), ("user", "c")])
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}[1]
    plain = "".join(f"{role or ''}\n{x or ''}\n" for _, _, role, x in turns[: len(texts)])
    learned = "".join(x or "" for _, _, role, x in turns[: len(texts)] if role == "assistant")
    assert got["turns_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
    assert (got["loss_chars"], got["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "message", "user", "hello"), (1, 2, 2, "message", "assistant", "H"), (1, 3, 2, "delta", "assistant",
            "i"), (1, 4, 2, "regenerate", "assistant", "Good "),
        (1, 5, 2, "delta", "assistant", "day"), (1, 6, 3, "message", "user", "bye"), (1, 7, 1, "edit", "user", "hello!"),
            (1, 8, 2, "message", "assistant", "Hi!"), (2, 1, 1, None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string")
    got = sorted((r["conv_id"], r["message_id"], r["role"], r["text"]) for r in chat.fold_messages(events).collect())
    assert got == [(1, 1, "user", "hello!"), (1, 2, "assistant", "Hi!"), (2, 1, "", "")]


def fold_plainly(log):
    out = {}
    for conv in {r[0] for r in log}:
        state = {}
        for _, seq, message, kind, role, text in sorted((r for r in log if r[0] == conv), key=lambda r: (r[1], r[2],
            r[3] or "message", r[4] or "", r[5] or "")):
            kind = kind or "message"
            if kind in ("edit", "regenerate"):
                state = {m: t for m, t in state.items() if m <= message}
            if kind == "delta" and message in state:
                state[message] = (state[message][0], state[message][1] + (text or ""))
            else:
                state[message] = (role or "", text or "")
        out |= {(conv, m): t for m, t in state.items()}
    return out


def test_chat_folding_equals_a_plain_fold(spark):
    r = random.Random(11)
    log = [(r.randrange(4), r.randrange(40), r.randrange(6), r.choice(["message", "delta", "delta", "edit", "regenerate",
        None]), "assistant", f"t{i} ") for i in range(300)]
    got = {(x["conv_id"], x["message_id"]): (x["role"], x["text"]) for x in chat.fold_messages(spark.createDataFrame(log,
        "conv_id long, seq long, message_id long, kind string, role string, text string")).collect()}
    assert got == fold_plainly(log)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, seq long, message_id long, kind string, role string, text string, formatted string")).count() == 0


# search


def brute_top_k(rows, queries, k):
    out = []
    for qid, q in queries:
        scored = sorted(((-int(np.dot(q, v)), i) for i, v in rows if i != qid))[:k]
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_search_is_exact_with_copies_and_ties(spark):
    g = np.random.default_rng(3)
    vectors = [(i, [int(x) for x in np.floor(g.normal(size=8) * 40)]) for i in range(700)] + [(1000 + i, [5] * 8) for i in range(300)] + [(2000, [0] * 8)]
    df = spark.createDataFrame([*vectors, vectors[0]], "vec_id long, v array<bigint>")
    q = df.filter("vec_id % 50 = 0")
    got = search.top_k(df, q, 5, pivots=8, block_rows=100, block_queries=7)
    assert sorted(map(tuple, got.collect())) == brute_top_k(vectors, [(i, v) for i, v in vectors if i % 50 == 0], 5)


def test_search_prunes_clustered_vectors():
    g = np.random.default_rng(0)
    points = np.floor(g.normal(size=(40, 16))[g.integers(0, 40, 4000)] * 400 + g.normal(size=(4000, 16)) * 8).astype(np.int64)
    asked = np.arange(0, 4000, 50)
    found = search.TopK(points[asked], asked, points, np.arange(4000), 5, np.full(80, search.MISSING), False)
    search.dual_search(search.CoverTree(points[asked].astype(float)), search.CoverTree(points.astype(float)), found)
    assert found.compared < 0.2 * 80 * 4000
    expected = brute_top_k(list(enumerate(points)), [(i, points[i]) for i in asked], 5)
    assert sorted((int(asked[i]), n + 1, int(found.best[i, n]), int(found.score[i, n])) for i in range(80) for n in range(5)) == expected


def nodes_below(tree):
    return [tree, *(n for c in tree.children for n in nodes_below(c))]


def test_cover_tree_keeps_its_invariants():
    g = np.random.default_rng(2)
    points = np.concatenate((g.normal(size=(20, 3))[g.integers(0, 20, 900)] * 100 + g.normal(size=(900, 3)), np.ones((200, 3))))
    for node in nodes_below(search.CoverTree(points)):
        apart = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1))
        assert apart.max() <= node.radius and sorted(np.concatenate([c.rows for c in node.children] or [node.rows])) == sorted(node.rows)
        if node.children:
            centres = np.array([c.centre for c in node.children])
            reach = np.sqrt(((points[node.rows][:, None] - centres[None]) ** 2).sum(axis=2)).min(axis=1).max()
            assert any((c == node.centre).all() for c in centres) and all(c.radius <= reach * 1.001 for c in node.children)
            assert len(node.children) == search.FAN or reach <= node.radius / 2
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
            assert gaps[~np.eye(len(centres), dtype=bool)].min(initial=np.inf) >= reach


@pytest.mark.parametrize("clusters", [20, 200, 1000])
def test_cover_trees_prune_whatever_the_number_of_clusters(clusters):
    g = np.random.default_rng(clusters)
    centres = g.normal(size=(clusters, 16)) * 2000
    points = np.rint(centres[np.arange(4000) % clusters] + g.normal(size=(4000, 16)) * 10).astype(np.int64)
    ids, floor = np.arange(4000), np.full(4000, search.MISSING)
    found = search.TopK(points, ids, points, ids, 3, floor, False)
    search.dual_search(search.CoverTree(points.astype(float)), search.CoverTree(points.astype(float)), found)
    assert found.compared + found.bounded < 0.2 * 4000 * 4000
    for i in range(50):
        own = sorted((-int(points[i] @ points[j]), j) for j in range(4000) if j != i)[:3]
        assert [(-int(a), int(b)) for a, b in zip(found.score[i], found.best[i], strict=True)] == own


def test_search_is_exact_beyond_floats_and_refuses_overflow(spark):
    big = [(0, [2**30 + 1, 1]), (1, [2**30, 3]), (2, [2**30, 2]), (3, [1, 2])]
    df = spark.createDataFrame([*big, (3, [0, 0])], "vec_id long, v array<bigint>")
    assert sorted(map(tuple, search.top_k(df, df, 2).collect())) == brute_top_k([*big[:3], (3, [0, 0])], [*big[:3], (3, [0, 0])], 2)
    with pytest.raises(OverflowError):
        search.top_k(spark.createDataFrame([(1, [2**62]), (2, [4])], "vec_id long, v array<bigint>"), df)
    with pytest.raises(Exception, match="passes 64 bits"):
        spark.createDataFrame([(1, [1e17, 1.0])], "vec_id long, e array<double>").select(search.scaled(F.col("e"))).collect()


def test_search_edges(spark):
    assert search.top_k(spark.createDataFrame([], "vec_id long, v array<bigint>"), spark.createDataFrame([], "vec_id long, v array<bigint>")).count() == 0
    two = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (None, [9, 9]), (2, None)], "vec_id long, v array<bigint>")
    assert sorted(map(tuple, search.top_k(two, two.filter("vec_id = 0")).collect())) == [(0, 1, 1, 11)]
    e = spark.createDataFrame([(1, [0.5, float("nan")]), (2, [1.0, None]), (3, None), (4, [-0.001, 1.0]), (5, [float("inf")])], "vec_id long, e array<float>")
    assert [(r[0], r[1]) for r in e.filter(search.usable(F.col("e"))).select("vec_id", search.scaled(F.col("e"))).collect()] == [(4, [-1, 256])]


# near duplicates


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [(i, len(s), top(i), top(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("small,block", [(24, 512), (2, 16)])
def test_dedup_equals_all_pairs(spark, small, block):
    texts = [prose(i, 60) for i in range(60)] + list(ODD)
    for base in range(6):
        words = prose(base, 60).split(" ")
        for k in range(8):
            r = random.Random(100 * base + k)
            copy = list(words)
            for _ in range(k % 4):
                copy[r.randrange(60)] = f"new{r.randrange(9)}"
            texts.append(" ".join(copy) if k % 2 else " ".join(copy).upper())
    passage = prose(999, 50)
    texts += [passage + " " + prose(2000 + i, 40) for i in range(40)]
    got = dedup.near_duplicates(docs_of(spark, texts), 4, 80, small=small, block=block)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()) == brute_components(texts, 4, 80)


def test_dedup_edges(spark):
    assert dedup.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["component_id"], r["kept"]) for r in dedup.near_duplicates(rows).collect()), key=str)
    assert got == [("7", 7, True), ("7", 7, True), ("None", 7, False), ("None", None, True)]


def test_dedup_links_classes_without_ids(spark):
    near = lambda seed, k: prose(seed, 60) + f" end{k}"
    rows = spark.createDataFrame([(None, near(1, 0)), (None, near(1, 1)), (None, near(2, 0)), (4, near(2, 1)), (None,
        near(3, 0)), (None, near(3, 0))], "doc_id long, text string")
    got = [(r["n_shingles"], r["component_id"], r["kept"], r["row_key"], r["first_row"]) for r in dedup.near_duplicates(rows, 4, 80).collect()]
    assert len(got) == 6 and len({first for *_, first in got}) == 3
    assert sorted(kept for _, component, kept, _, _ in got if component == 4) == [False, True]
    nameless = [(kept, key == first) for _, component, kept, key, first in got if component is None]
    assert all(kept == own for kept, own in nameless) and sorted(own for own, _ in nameless) == [False, True, True, True]


def test_large_node_blocks():
    import pandas as pd

    g = np.random.default_rng(1)
    sets = [np.unique(g.integers(0, 60, 50)) for _ in range(40)]
    both = dedup.intersections(sets, columns=16)
    assert all(both[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(40) for j in range(40))
    frame = pd.DataFrame({"class": [bytes([i]) for i in range(40)], "label": [bytes([i]) for i in range(40)], "half": 0, "shingles": sets})
    links = dedup.block_links(60)(frame)
    label = {bytes([i]): bytes([i]) for i in range(40)}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(links["a"], links["b"], strict=True):
        x, y = top(a), top(b)
        label[max(x, y)] = min(x, y)
    for i in range(40):
        for j in range(i):
            n = len(set(sets[i]) & set(sets[j]))
            if 100 * n >= 60 * (len(sets[i]) + len(sets[j]) - n):
                assert top(bytes([i])) == top(bytes([j]))


# packing


def test_packing_tokens_and_places(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, "Word, word! <|endoftext|> don't", *[prose(i, 30 + 40 * i) for i in range(40)]]
    rows = packing.pack_documents(docs_of(spark, texts), capacity=128, docs_per_task=20).collect()
    encoder = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(p["piece"], p["start"], p["length"]) for p in pieces] == [(k, s, min(128, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 128))]
        assert [p["ids_crc32"] for p in pieces] == [zlib.crc32(np.array(ids[s : s + 128], dtype="<u4").tobytes()) for s in range(0, len(ids), 128)]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack_documents(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_sum_of_squares_is_near_the_least_number_of_bins():
    g = np.random.default_rng(0)
    lengths = g.integers(1, 2000, 3000)
    bins, offsets = packing.sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= math.ceil(lengths.sum() / 2048) * 1.03 + 1
    assert (np.bincount(bins, weights=lengths) <= 2048).all()


# mixing


def brute_targets(sizes):
    total, weight = 1.5 * sum(sizes.values()), {}
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weight[s] = (5, 2, 1)[i % 3]
    target, open_ = {}, set(sizes)
    while True:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)


def test_mixing_targets_and_epochs(spark):
    texts = [prose(i, 1 + i % 50) for i in range(400)] + [None, ""]
    df = docs_of(spark, texts, sources=["b", "b", "b", "a", None, "é", "z"])
    rows = mixing.mix_sources(df, F.when(F.col("doc_id") % 2 == 0, 4.0)).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    expected = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6
    assert all(abs(taken[s] - expected[s]) <= 25 for s in sizes)
    again = mixing.mix_sources(df.repartition(7), F.when(F.col("doc_id") % 2 == 0, 4.0)).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    assert mixing.mix_sources(df.limit(0)).count() == 0


# classifiers


LANGS = {"en": "the and with this that from river which", "de": "der und nicht ist ein fluss schön über", "fr": "le et les dans une être rivière où"}


def corpus(n, seed=0):
    r = random.Random(seed)
    names = list(LANGS)
    return [(names[i % 3], " ".join(r.choice(LANGS[names[i % 3]].split()) for _ in range(5 + r.randrange(60)))) for i in range(n)]


def test_language_on_held_out_texts(spark):
    pairs = corpus(300)
    df = docs_of(spark, [t for _, t in pairs] + list(ODD), [g for g, _ in pairs] + [None] * len(ODD)).withColumn("held", F.col("doc_id") % 4 == 2)
    rows = language.identify_languages(df, ~F.col("held"), keep_text=True).collect()
    assert all(r["lang_pred"] == pairs[r["doc_id"]][0] for r in rows if r["doc_id"] < 300)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["text"] is None or not any(c.isalpha() for c in r["text"])} == {"und"}
    nothing = language.identify_languages(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.select("lang_pred").collect()} == {"und"}
    assert language.identify_languages(df.limit(0)).count() == 0


def test_language_does_not_depend_on_batches():
    texts = ["der Fluss", "", "a", "été  là-bas!", "x" * 100]
    grams, owner, _ = language.gram_buckets(texts)
    for i, one in enumerate(texts):
        alone, _, _ = language.gram_buckets([one])
        assert sorted(grams[owner == i]) == sorted(alone)


def test_toxicity_finds_planted_words_and_spares_the_rest(spark):
    texts = [prose(i, 80) + (" you idiot worthless scum" if i % 4 == 0 else "") for i in range(240)] + list(ODD)
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)] + [(3, None, None), (None, 1, 1),
        (0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify_toxicity(df, labels).collect()
    assert all(r["toxic"] == (r["doc_id"] < 240 and r["doc_id"] % 4 == 0) for r in rows)
    assert not any(r["toxic"] for r in toxicity.classify_toxicity(df, labels.limit(0)).collect())
    assert toxicity.classify_toxicity(df.limit(0), labels).count() == 0


def test_lm_scores_prefer_the_target(spark):
    texts = [prose(i, 60, ("alpha", "beta", "gamma")) if i % 2 else prose(i, 60, ("red", "green", "blue")) for i in range(200)] + list(ODD)
    rows = {r["doc_id"]: r for r in lm.score_documents(docs_of(spark, texts), spark.range(1, 100, 2).withColumnRenamed("id", "doc_id")).collect()}
    near, far = [rows[i]["score"] for i in range(101, 200, 2)], [rows[i]["score"] for i in range(100, 200, 2)]
    assert max(near) < min(far)
    assert rows[200]["score"] is None and rows[200]["n_tokens"] == 0
    assert abs(rows[150]["score"] - (rows[150]["ce_target"] - rows[150]["ce_background"])) < 1e-12


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "part_rows": 500}])
def test_lm_scores_equal_exact_counts(spark, sizes):
    texts = [prose(i, 60) for i in range(60)] + list(ODD) + [prose(3, 60)] * 20
    target = set(range(0, 40, 3))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, prose(5, 40)), (0, texts[0])]
    words = [(t or "").encode().lower().split() for _, t in rows]
    models = []
    for own in (lambda i: i in target, lambda i: True):
        word, context, pair = Counter(), Counter(), Counter()
        for (i, _), w in zip(rows, words, strict=True):
            if own(i):
                word.update(w), context.update([None, *w[:-1]] if w else []), pair.update(zip([None, *w], w, strict=False))
        models.append((word, context, pair, sum(word.values())))
    size = len({x for w in words for x in w})

    def mean_loss(m, w, inside):
        mine = [Counter(w), Counter([None, *w[:-1]]), Counter(zip([None, *w], w, strict=False)), len(w)] if inside else [Counter(), Counter(), Counter(), 0]
        loss = lambda a, b: -math.log((m[2][a, b] - mine[2][a, b] + lm.PRIOR * (m[0][b] - mine[0][b] + lm.ADDED) / (m[3] - mine[3] + lm.ADDED * size)) / (m[1][a] - mine[1][a] + lm.PRIOR))
        return sum(loss(a, b) for a, b in zip([None, *w], w, strict=False)) / len(w)

    expected = [(i, len(w), *([mean_loss(m, w, inside) for m, inside in zip(models, (i in target, True),
        strict=True)] if w else [None] * 2)) for (i, _), w in zip(rows, words, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score_documents(df, spark.createDataFrame([(i,) for i in target], "doc_id long"), **sizes).collect()
    rounded = lambda found: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found), key=repr)
    assert rounded(tuple(r)[:4] for r in got) == rounded(expected)
    assert all(r["score"] is None or abs(r["score"] - (r["ce_target"] - r["ce_background"])) < 1e-12 for r in got)
    assert lm.score_documents(df.limit(0), df).count() == 0


# urls and quality


def test_urls_rules_and_parts(spark):
    cases = [
        ("http://NET/x", "net", "/x", "net/", "block"), ("https://a.Example.NET/en/1?q#f", "a.example.net", "/en/1",
            "example.net/en/", "allow"), ("ftp://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("x://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"), ("x://my.org/fr/?a", "my.org",
            "/fr/", "org/fr/", "allow"), ("http://notnet", "notnet", "", None, None),
        (None, "", "", None, None), ("no scheme", "", "", None, None), ("://", "", "", None, None), ("a://b://c/d",
            "b:", "//c/d", None, None), ("http://É.com#x/y", "É.com", "", None, None), ("http://h?" + "q" * 9999, "h", "", None,
            None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    for r in urls.judge_urls(df, RULES).collect():
        _, host, path, rule, verdict = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    bad = urls.judge_urls(spark.createDataFrame([(1, "http://free-casino.example.com/bets"), (2, "http://poetry.example.com/reading")],
        "page_id long, url string"), [])
    assert {r["page_id"]: r["verdict"] for r in bad.collect()} == {1: "block", 2: "allow"}


def test_urls_of_sites_that_no_table_names(spark):
    """Hosts that are neither in the labelled table nor made as the test pages are."""
    plain = """wikipedia.org github.io mozilla.com bbc.co.uk nature.com python.com guardian.com stackoverflow.com archive.org nytimes.com mit.edu nasa.gov amazon.com apple.com zeit.de
        cnn.com ebay.co.uk spotify.com imdb.com weather.gov wordpress.org reddit.com lonelyplanet.com who.int oxfordjournals.org cashmere-shop.com pilates-studio.com clickhouse.com
        betterworld.org adobe.com loansome-dove.org alberta.ca trackandfield.org winchester.co.uk adelaide.edu.au pillowtalk.com elizabeth.org freecycle.org""".split()
    bad = """gambling.com porn-tube.com phishing-login.com onlinecasino.net sexvideos.org buy-viagra.com freebets.co.uk adtracker.io xxxmovies.com casino-royale.com cheap-pills-rx.net
        poker-online.com spam-network.org malware-site.com lottery-jackpot.com""".split()
    assert not {h.split(".")[0] for h in plain + bad} & {*urls.ALLOWED_SITES, *urls.BLOCKED_SITES}
    df = spark.createDataFrame([(i, f"https://{h}/") for i, h in enumerate(plain + bad)], "page_id long, url string")
    verdict = {r["host"]: r["verdict"] for r in urls.judge_urls(df, []).collect()}
    assert {verdict[h] for h in plain[:25]} == {"allow"}
    assert sum(verdict[h] == "allow" for h in plain) >= 0.9 * len(plain) and sum(verdict[h] == "block" for h in bad) >= 0.9 * len(bad)
    odd = spark.createDataFrame([(1, None), (2, "x"), (3, "http://")], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge_urls(odd, []).collect()} == {"allow"}


def test_urls_training_equals_numpy(spark):
    bias, weights = urls.train(urls.labelled_urls(spark), dimensions=256, rounds=40)
    host, path = urls.host_and_path(F.col("url"))
    rows = urls.labelled_urls(spark).select(urls.features(host, path, 256).alias("x"), "blocked").collect()
    x = np.zeros((len(rows), 256))
    for i, r in enumerate(rows):
        x[i, r["x"]] = 1 / math.sqrt(len(r["x"]))
    y, w, b, v, turn = np.array([r["blocked"] for r in rows], dtype=float), np.zeros(256), 0.0, np.zeros(256), 0.0
    for _ in range(40):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        v, turn = urls.MOMENTUM * v - urls.RATE * (x.T @ e / len(y) + urls.PENALTY * w), urls.MOMENTUM * turn - urls.RATE * e.mean()
        w, b = w + v, b + turn
    assert abs(b - bias) < 1e-9 and np.abs(w - weights).max() < 1e-9


def brute_base(text):
    w = WORD.findall(text or "")
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p + k for p in range(len(w) - 2) if count[tuple(w[p : p + 3])] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts_and_verdicts(spark):
    words = ("the", "of", "and", "to", "meadow", "harvest", "singing", "bright", "window", "under")
    plain = [" ".join(random.Random(i * 1000 + j).choice(words) for j in range(150)) for i in range(60)]
    junk = [p.upper() for p in plain[:3]] + [p.replace(" ", "### ") for p in plain[3:6]]
    odd = [*ODD, "a b c a b c a\nx\nx\n \n \n", "# $ < é 日本"]
    texts = plain + junk + odd
    rows = {r["doc_id"]: r for r in quality.judge_quality(docs_of(spark, texts, ["en", None])).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_base(t), t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert all(rows[i]["kept"] for i in range(60) if not rows[i]["base_failed"])
    assert not any(rows[i]["kept"] for i in range(60, 66))
    assert quality.judge_quality(docs_of(spark, ["x"]).limit(0)).count() == 0
