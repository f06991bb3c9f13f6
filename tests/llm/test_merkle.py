"""The manifest against trees built in plain Python, and proofs that fail exactly where texts were changed."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tradescope.llm import merkle

SHAPE = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, change=False):
    values = list(row)
    if change and values[4] is not None:
        values[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in values[4])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def expected(rows, changed):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = levels_of([leaf_of(r) for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    found = []
    for at, g in enumerate(order):
        for place, row in enumerate(groups[g]):
            own, proof = leaf_of(row, changed(row)), []
            for levels, i in ((trees[g], place), (top, at)):
                for level in levels[:-1]:
                    start = i // 8 * 8
                    run = level[start : start + 8]
                    proof += run[: i - start] + run[i - start + 1 :]
                    own, i = h(*run[: i - start], own, *run[i - start + 1 :]), i // 8
            found.append((row[0], trees[g][0][place], trees[g][-1][0], top[-1][0], h(*proof), own, own == top[-1][0]))
    return sorted(found, key=repr)


def tampered_in_python(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def random_rows(n, langs, seed=1):
    r = random.Random(seed)
    return [(i, r.choice(["a", "bé", None]), r.choice(langs), r.choice([None, 5, -3]), r.choice(["Text Ä %d" % i, "plain", "", None])) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, ["en"]), (65, ["en", None]), (700, [None, "en", "de", "fr", "zh", "é", "es", "it", "pt", "ru", "a"])])
def test_equals_plain_trees(spark, n, langs):
    rows = random_rows(n, langs)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert sorted(map(tuple, merkle.manifest(df, tampered()).collect()), key=repr) == expected(rows, tampered_in_python)


def test_repeated_rows_null_ids_and_a_crowded_run(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 2)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = random_rows(200, ["en", "de"]) + [(None, "a", "en", 1, "X")] * 3 + [(7, "a", "en", 1, "Y")] * 150 + [(7, "a", "en", 1, "Z")]
    df = spark.createDataFrame(rows, SHAPE)
    assert sorted(map(tuple, merkle.manifest(df, tampered()).collect()), key=repr) == expected(rows, tampered_in_python)
    none = merkle.manifest(df, F.lit(None).cast("boolean")).collect()
    assert all(r["verified"] for r in none)
    assert merkle.manifest(df.limit(0), tampered()).columns == merkle.manifest(df, tampered()).columns


def test_row_limit_of_recursion_is_put_back(spark):
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    merkle.manifest(spark.createDataFrame(random_rows(20, ["en"]), SHAPE), tampered()).count()
    assert spark.conf.get(limit) == before
