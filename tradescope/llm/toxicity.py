"""Toxicity by a chain of classifiers.

Categories are predicted one after the other; each linear model sees a document's words and stems and the
probabilities of the categories before it. In training those are out-of-fold predictions, so
that a later model meets probabilities as good as it will meet on new documents. The chain is
fitted in one task on a bounded sample of labelled documents and applied to whole texts.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import labelled_sample, release, slices
from .ftrl import Ftrl, dense

#: Labelled documents of each kind in the sample, folds, and documents a word must occur in.
SAMPLE, FOLDS, LEAST = 4000, 3, 3
#: Rows seen in training at least and epochs at least: small samples are gone through more often.
SEEN, EPOCHS = 60_000, 8
#: Words that the models may use: those that speak most for a category.
WORDS = 4096
#: Lengths of stems, so that an inflected or compounded word is known by how it begins.
STEMS = (4, 5, 6, 7)
#: The last category of the chain, whose verdict counts.
LAST = "toxic"
#: Bytes of text that are judged together.
SLICE_BYTES = 1_000_000
WORD = re.compile(r"[^\W\d_]+")


def word_set(text: str | None) -> set[str]:
    """Distinct words of letters, in small letters, and their stems: the first letters and a star."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS))


def dividing_words(rows: list[np.ndarray], y: np.ndarray, names: list[str], most: int) -> list[int]:
    """The ``most`` words that speak for a category, by chi-square; what speaks against it is the bias."""
    count = lambda some: np.bincount(np.concatenate(some), minlength=len(names)).astype(float) if some else np.zeros(len(names))
    every, both = count(rows), count([r for r, v in zip(rows, y, strict=True) if v])
    n, positive = len(rows), float(y.sum())
    spread = every * (n - every) * positive * (n - positive)
    score = np.where((every >= LEAST) & (spread > 0) & (both * n > every * positive), n * (both * n - every * positive) ** 2 / np.maximum(spread, 1.0), 0.0)
    return sorted(np.flatnonzero(score).tolist(), key=lambda k: (-score[k], names[k]))[:most]


def fit(categories: list[str]):
    """A function for mapInArrow: labelled documents in (one task), the pickled chain out.

    Words are kept as numbers, so that the sample takes a few bytes for each of its words. Where a
    category is not known of a document (null), its model does not learn from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        sample = []
        for batch in batches:
            for u, text, *ys in zip(*(batch.column(c).to_pylist() for c in ("_u", "text", *categories)), strict=True):
                words = word_set(text)
                sample.append((u, len(words), [np.nan if v is None else float(v) for v in ys], np.fromiter((codes.setdefault(w,
                    len(codes)) for w in words), dtype=np.int32, count=len(words))))
        sample.sort(key=lambda r: r[:3])
        rows, truth, names = [r[3] for r in sample], np.array([r[2] for r in sample]), list(codes)
        del sample, codes
        chosen = sorted({w for k in range(len(categories)) for w in dividing_words(rows, truth[:, k] == 1, names,
            WORDS // len(categories))}, key=lambda w: names[w])
        width = len(chosen) + len(categories)
        place = np.full(len(names), -1, dtype=np.int64)
        place[chosen] = np.arange(len(chosen))
        base = [np.sort(p[p >= 0]) for p in (place[r] for r in rows)]
        fold = np.arange(len(rows)) % FOLDS
        earlier: list[np.ndarray] = []
        chain = []

        def with_earlier(indices) -> list[tuple[np.ndarray, np.ndarray]]:
            extra = np.arange(len(earlier)) + len(chosen)
            return [(np.append(base[i], extra).astype(np.int64), np.append(np.ones(len(base[i])), [p[i] for p in earlier]).astype(np.float32)) for i in indices]

        def learned(inside: np.ndarray, y: np.ndarray, epochs: int) -> Ftrl:
            return Ftrl(width, 1, alpha=0.5, l1=0.004, l2=1e-3).fit(with_earlier(inside), y[inside].astype(np.float32)[:, None], epochs=epochs)

        for k, name in enumerate(categories):
            y = truth[:, k]
            known = np.flatnonzero(~np.isnan(y))
            epochs = max(EPOCHS, min(100, SEEN // max(len(known), 1)))
            chain.append(learned(known, y, epochs).weights()[:, 0])
            out = np.zeros(len(rows))
            if name != categories[-1]:
                for f in range(FOLDS):
                    inside, outside = known[fold[known] != f], np.flatnonzero(fold == f)
                    if len(inside) and len(outside):
                        model = learned(inside, y, epochs)
                        out[outside] = np.concatenate([model.predict(dense([r], width))[:, 0] for r in with_earlier(outside)])
            earlier.append(out)
        words = {names[k]: np.array([c[i] for c in chain]) for i, k in enumerate(chosen) if any(c[i] != 0 for c in chain)}
        links = np.array([[c[len(chosen) + k] for k in range(len(categories))] for c in chain])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((words, links, np.array([c[-1] for c in chain])))], pa.binary())})
        del rows, base, place, names
        release()

    return run


def chain_probabilities(sums: np.ndarray, links: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Probabilities of each category in turn; ``sums`` are the words' parts of the margins."""
    p = np.zeros_like(sums)
    for k in range(sums.shape[1]):
        p[:, k] = 1.0 / (1.0 + np.exp(-(sums[:, k] + bias[k] + p[:, :k] @ links[k, :k])))
    return p


def score(model, categories: list[str], keep: list[str]):
    """A function for mapInArrow: documents in, probabilities out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, links, bias = model.value
        for batch in slices(batches, "text", SLICE_BYTES):
            sums = np.zeros((batch.num_rows, len(categories)))
            for i, text in enumerate(batch.column("text").to_pylist()):
                for w in words.keys() & word_set(text):
                    sums[i] += words[w]
            p = chain_probabilities(sums, links, bias)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(p[:, k]) for k in range(len(categories)))],
                names=[*keep, *(f"p_{c}" for c in categories)])
        release()

    return run


def classify_toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = (LAST,), sample: int = SAMPLE,
    threshold: float = 0.4, keep_text: bool = False) -> DataFrame:
    """Add p_<category> for each of ``categories`` and the verdict ``toxic`` to every document.

    ``labels`` has doc_id and a column of 0 and 1 for each category; the chain takes them in the
    given order and the last one decides. At most ``sample`` different documents that the last
    category names and twice as many others are learned from, chosen by hashes of id and text;
    models may use the WORDS words and stems, in LEAST documents at least, that speak most for a
    category. Every document is judged on all its words.

    Nulls: labels with a null id or a null last category are left out, another null category only
    for that category; a null or empty text has no words and is judged by the bias alone. Labels of
    documents that are not given play no part. Without given documents of both kinds nothing can
    be learned, and no document is toxic (probabilities 0).
    Repeated labels of a document count once, as 1 if one says so; repeated documents get equal
    results and are learned from once. Empty tables give no rows. Columns named like the results
    are replaced; text is dropped unless ``keep_text``.
    """
    categories = list(categories)
    last, results = categories[-1], [f"p_{c}" for c in categories]
    rows = docs.drop(*results, LAST)
    keep = [c for c in rows.columns if keep_text or c != "text"]
    chosen = labelled_sample(rows, labels, categories, {True: sample, False: 2 * sample})
    found = chosen.repartition(1).mapInArrow(fit(categories), "model binary").first() if chosen is not None else None
    model = pickle.loads(found["model"]) if found else None
    if model is None:
        return rows.select(*keep, *[F.lit(0.0).alias(c) for c in results], F.lit(False).alias(LAST))
    schema = StructType([*rows.select(*keep).schema.fields, *(StructField(c, DoubleType()) for c in results)])
    scored = rows.mapInArrow(score(docs.sparkSession.sparkContext.broadcast(model), categories, keep), schema)
    return scored.withColumn(LAST, F.col(f"p_{last}") >= threshold)
