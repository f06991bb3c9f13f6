"""Alignment of tokenizers against token-by-token loops with the plain encoders."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradescope.llm import align

TEXTS = ["The river runs past the old mill.", "Le café été; Zwölf Boxkämpfer 12345 don't", "", None, " ", "  two  blanks\n\nand lines\t", "<|endoftext|> <s> </s> <unk> stay text",
    "▁ is no blank", "\u0000\u0001 odd � \U0001f600\U0001f468‍\U0001f469", "日本語のテキスト と ไทย", "a" * 3000, " " * 5000, "word " * 4000, "The river runs past the old mill."]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(texts, plain):
    """The contract's columns, by nested loops over tokens."""
    a, b = plain
    letters = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    docs = []
    for text in texts:
        one = a.encode(" " + text, add_special_tokens=False) if text else None
        left = [(i, bytes(letters[c] for c in t)) for i, t in zip(one.ids, one.tokens, strict=True)] if text else []
        ids = b.encode(text) if text else []
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids]
        whole = (" " + (text or "")).encode()
        if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
            left = right = []
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        docs.append((left, right, links, groups))
    count = Counter(p for *_, links, _ in docs for p in set(links))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return [(len(x), len(y), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
        hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for x, y, links, g in docs]


def test_equals_token_loops(spark, plain):
    r = random.Random(3)
    texts = [*TEXTS[:10], "a" * 300, " " * 90, "word " * 100, TEXTS[0], *("".join(r.choice("ab cdé<>1\n▁ 한") for _ in range(r.randrange(60))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pair", F.lit("x")).withColumn("chunk", F.lit("y"))
    expected = brute(texts, plain)
    for bounds in ({}, {"chunk_docs": 3}, {"slice_bytes": 50, "chunk_entries": 40}):
        rows = sorted(align.align_tokenizers(df, **bounds).collect())
        assert [(x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in rows] == expected
    assert align.align_tokenizers(df.limit(0)).count() == 0
    assert rows[7].n_a == 0 and rows[7].groups_sha256 == "" and rows[3].n_links == 0 and rows[6].n_a > 5


def test_fast_encoder_equals_the_files_own(plain):
    """Over random Unicode, long runs, and control strings."""
    r = random.Random(5)
    coder = align.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    ranges = [(32, 127), (0, 33), (160, 600), (0x900, 0xA00), (0x3040, 0x30FF), (0x1F300, 0x1F650), (0x2000, 0x2070)]
    texts = ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(1, 80))) for _ in range(3000)]
    texts += [t for t in TEXTS if t] + [" " * 300_000, "x <|endoftext|>y", "it's we'll 'S", "   　x"]
    for text in texts:
        assert coder.of(text).tolist() == plain[0].encode(" " + text, add_special_tokens=False).ids


def test_planes_round_trip_and_count_documents():
    g = np.random.default_rng(2)
    for docs in (1, 7, 500, 65536):
        keys = np.unique(np.stack([g.integers(0, 9, 3000) ** 3, g.integers(0, docs, 3000)]), axis=1)
        times = g.integers(1, 12, keys.shape[1])
        pair, n_docs, n_linked, planes = align.pack_planes(keys[0], keys[1], times, docs)
        for some in (slice(0, len(pair)), slice(2, 5)):
            part = planes.slice(some.start, some.stop - some.start)
            row, place, weight = align.unpack_planes(part, docs)
            found = Counter()
            for a, b, w in zip(pair[some][row].tolist(), place.tolist(), weight.tolist(), strict=True):
                found[a, b] += w
            assert found == {(a, b): t for a, b, t in zip(*keys.tolist(), times.tolist(), strict=True) if a in pair[some]}
            assert Counter(a for a, _ in found) == dict(zip(pair[some].tolist(), n_docs[some].tolist(), strict=True))
        assert n_linked.sum() == times.sum()
        assert isinstance(planes, pa.ListArray)


def test_counts_of_pairs(spark):
    df = spark.createDataFrame([(i, "the mill the river") for i in range(50)] + [(99, "the")], "doc_id long, text string")
    _, entries = align.encoded(df, chunk_docs=20)
    counts = {r["pair"]: (r["total"], r["linked"], r["best"]) for r in align.pair_counts(entries).collect()}
    assert sorted(counts.values(), key=str) == sorted([(51, 101, True), (50, 50, True), (50, 50, True)], key=str)
