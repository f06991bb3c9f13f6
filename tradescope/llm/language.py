"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every training document. The classifier is fitted by
follow-the-regularised-leader on a bounded sample of labelled documents, in one task, and its
scores are calibrated by a temperature on a part of that sample. As a term's frequency is
relative to the document's length, a document's score is a mean over its n-grams, so whole texts
of any length are scored in one pass with a table look-up per n-gram.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import release, slices, uniform
from .ftrl import Ftrl, dense, softmax

#: Hash buckets of n-grams, their lengths, and labelled documents per language in the sample.
BUCKETS, SIZES, SAMPLE = 1 << 15, (1, 2, 3), 1000
UNDETERMINED = "und"
#: Labelled documents in the sample in all at most, and languages that can be learned.
SAMPLE_TOTAL, MOST_LANGUAGES = 20_000, 200
#: Bytes of text whose n-grams are found together.
SLICE_BYTES = 400_000
SCALE = 100.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point the small letter it counts as, or a blank where it is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
            table[i] = ord(c.lower()[0])
    return table


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the text of each, and whether a text has a letter.

    What is no letter counts as a blank; n-grams with two blanks in a row are left out. Two
    blanks after each text keep its n-grams apart from the next one's.
    """
    joined = "".join(t + "  " for t in texts)
    codes = letters()[np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")].astype(np.uint64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + 2)
    ends = np.cumsum(lengths + 2)
    inside = np.ones(len(codes), dtype=bool)
    inside[ends - 1] = inside[ends - 2] = False
    blank = codes == 32
    has_letter = np.bincount(owner, weights=~blank, minlength=len(texts)) > 0
    found, owners, h, ok = [], [], np.zeros(len(codes), dtype=np.uint64), inside.copy()
    for n in range(max(SIZES)):
        moved = np.full(len(codes), 32, dtype=np.uint64)
        moved[: len(codes) - n] = codes[n:]
        with np.errstate(over="ignore"):
            h = h * np.uint64(0x9E3779B97F4A7C15) + moved + np.uint64(1)
            if n:
                ok[:-n] &= ~(blank[n - 1 : len(codes) - 1] & blank[n:])
            else:
                ok &= inside
            if n + 1 in SIZES:
                keep = ok & ~blank if n == 0 else ok
                found.append((((h[keep] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64))
                owners.append(owner[keep])
    return np.concatenate(found), np.concatenate(owners), has_letter


def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's texts, and their number in bucket -1."""
    df, total = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in slices(batches, "text", SLICE_BYTES):
        texts = [t for t in batch.column("text").to_pylist() if t]
        total += len(texts)
        if texts:
            grams, owner, _ = gram_buckets(texts)
            order = np.argsort(owner, kind="stable")
            for one in np.split(grams[order], np.searchsorted(owner[order], np.arange(1, len(texts)))):
                df += np.bincount(one, minlength=BUCKETS) > 0
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(used, -1), pa.int32()), "n": pa.array(np.append(df[used], total), pa.int64())})
    release()


def term_rows(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse TF-IDF rows of texts."""
    rows = []
    for text in texts:
        grams, _, _ = gram_buckets([text])
        tf = np.bincount(grams, minlength=BUCKETS)
        columns = np.flatnonzero(tf)
        rows.append((columns.astype(np.int32), (tf[columns] / max(len(grams), 1) * idf[columns] * SCALE).astype(np.float32)))
    return rows


def fit(idf: np.ndarray, languages: list[str], sample: int):
    """A function for mapInArrow: the sample in (one task), the pickled model out.

    Of each language the ``sample`` rows with the smallest hashes count. Every fifth row is kept
    from training, and the temperature is fitted on those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted({(t, g, d) for b in batches for t, g, d in zip(*(b.column(c).to_pylist() for c in ("_u", "lang", "text")), strict=True)})
        pairs = sorted(p for g in languages for p in [p for p in pairs if p[1] == g][:sample])
        rows = term_rows([p[2] for p in pairs], idf)
        y = np.array([[p[1] == g for g in languages] for p in pairs], dtype=np.float32).reshape(len(pairs), len(languages))
        test = np.arange(len(pairs)) % 5 == 4
        del pairs
        model = Ftrl(BUCKETS, len(languages)).fit([rows[i] for i in np.flatnonzero(~test)], y[~test])
        w = model.weights()
        held = np.concatenate([dense([rows[i]], BUCKETS) @ w for i in np.flatnonzero(test)]) if test.any() else np.zeros((0, len(languages)))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((w, temperature(held, y[test])))], pa.binary())})
        del rows, model
        release()

    return run


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on a grid of factor 1.1 from 0.1 to 10."""
    grid = 1.1 ** np.arange(-24, 25)
    loss = [-np.log(np.maximum((softmax(scores / t) * y).sum(axis=1), 1e-12)).mean() if len(y) else abs(np.log(t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict(idf, weights, heat: float, languages: list[str], keep: list[str]):
    """A function for mapInArrow: documents in, languages out."""
    classes = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value[:-1] * (idf.value * SCALE)[:, None]
        bias = weights.value[-1].astype(np.float64)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            grams, owner, has_letter = gram_buckets(texts)
            number = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
            scores = np.stack([np.bincount(owner, weights=table[grams, k], minlength=len(texts)) for k in range(classes)], axis=1) / number[:, None] + bias
            p = softmax(scores / heat)
            best = p.argmax(axis=1)
            known = has_letter & (classes > 0)
            result = {"lang_pred": pa.array([languages[k] if ok else UNDETERMINED for k, ok in zip(best, known,
                strict=True)], pa.string()), "score": pa.array(np.where(known, p[np.arange(len(texts)), best], 0.0), pa.float64())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *result.values()], names=[*keep, *result])
        release()

    return run


def undetermined(docs: DataFrame) -> DataFrame:
    """The result where nothing could be learned."""
    return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})


def identify_languages(docs: DataFrame, learn_from: Column | None = None, sample: int = SAMPLE, keep_text: bool = False) -> DataFrame:
    """Add lang_pred and score to every document (text, lang, ...).

    Learns from text and non-null lang of the rows where ``learn_from`` is true (all, if none is
    given): n-gram statistics over all of them, the classifier on at most ``sample`` different
    rows of each language and SAMPLE_TOTAL in all, chosen by a hash of text and language. A
    prediction sees the text only. The score is the calibrated probability of the predicted language.

    Nulls: a text that is null or has no letter is ``und`` with score 0, as is every text where
    there is nothing to learn from (empty tables, no languages). Ties between languages go to the
    first by code point. Texts are read whole and in slices, so long ones need no more memory than
    their own size. Repeated rows get equal results, count in the n-gram statistics and enter the
    sample once. Columns named lang_pred and score are replaced; text is dropped unless
    ``keep_text``. More than MOST_LANGUAGES languages are an error.
    """
    spark = docs.sparkSession
    rows = docs.drop("lang_pred", "score")
    learn = F.coalesce(learn_from, F.lit(False)) if learn_from is not None else F.lit(True)
    known = rows.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    known = known.withColumn("_u", uniform("text", "lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("_u").alias("n")).limit(MOST_LANGUAGES + 1).collect()}  # a row per language
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    languages = sorted(counts)
    plain = rows if keep_text else rows.drop("text")
    if not languages:
        return undetermined(plain)
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in known.select("text").mapInArrow(count_documents, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows at most
        df[r["bucket"]] = r["n"]
    idf = np.log((df[-1] + 1.0) / (df[:-1] + 1.0)) + 1.0
    each = max(1, min(sample, SAMPLE_TOTAL // len(languages)))
    share = F.element_at(F.create_map(*[x for g in languages for x in (F.lit(g), F.lit(min(1.0, 1.2 * each / max(counts[g], 1))))]), F.col("lang"))
    chosen = known.filter(F.col("_u") <= share).dropDuplicates(["_u"]).repartition(1)
    w, heat = pickle.loads(chosen.mapInArrow(fit(idf, languages, each), "model binary").first()["model"])
    run = predict(spark.sparkContext.broadcast(idf), spark.sparkContext.broadcast(w), heat, languages, plain.columns)
    return rows.mapInArrow(run, StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
