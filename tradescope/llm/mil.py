"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages and only the bag has a label. Every passage is encoded: hashed
byte trigrams and a few shares of its characters and words go through one learned layer. Gated
attention gives each passage a weight, tanh(V h) times sigmoid(U h) times w, softmax over the
bag; the weighted sum of the encodings is scored. All weights are learned together from document
labels, by gradient descent on a bounded sample in one task, and applied to whole texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import BLANKS, labelled_sample, mix, release, slices

#: Words of a passage, buckets of trigrams, and widths of the encoding and of the attention.
WORDS, BUCKETS, ENCODED, ATTENDED = 64, 512, 24, 12
#: Labelled documents of each label in the sample, and bytes of text in all.
SAMPLE, SAMPLE_BYTES = 3000, 24_000_000
#: Training: epochs at least, bags seen at least, bags of a step, step size, and L2 penalty.
EPOCHS, SEEN, BATCH, RATE, PENALTY = 8, 25_000, 32, 3e-3, 1e-4
#: Bytes of text that are judged together, and from which score a document is predicted as good.
SLICE_BYTES, THRESHOLD = 1_000_000, 0.3
#: Kinds of bytes whose shares are features: small and capital letters, digits, blanks, ends of lines, signs, stops, parts of other letters.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", BLANKS.replace("\n", ""), "\n", "#*$%&|<>=_~^@{}[]/\\+", ".,;:!?'\"()-")
FEATURES = BUCKETS + len(KINDS) + 2 + 4
_STEP = 0x9E3779B97F4A7C15


def kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS) + 1, dtype=np.int64)  # other
    table[128:] = len(KINDS)
    for k, letters in enumerate(KINDS):
        table[list(letters.encode())] = k
    return table


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of texts, and where each text's passages start; a text without words has one passage."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kinds = kind_table()[d]
    blank = (kinds == 3) | (kinds == 4)
    new_doc = np.zeros(len(d) + 1, dtype=bool)
    new_doc[np.append(0, ends)] = True
    starts = np.flatnonzero(~blank & (np.append(True, blank[:-1])[: len(d)] | new_doc[:-1]))
    stops = np.flatnonzero(~blank & (np.append(blank[1:], True)[: len(d)] | new_doc[1:])) + 1
    owner = doc[starts]
    words = np.bincount(owner, minlength=len(texts))
    number = np.maximum(-(-words // WORDS), 1)
    base = np.cumsum(number) - number
    first_word = np.cumsum(words) - words
    of_word = base[owner] + (np.arange(len(starts)) - first_word[owner]) // WORDS
    before = np.cumsum(np.bincount(starts, minlength=len(d))) - 1 if len(d) else np.zeros(0, dtype=np.int64)
    of_byte = np.where(before >= first_word[doc], of_word[np.maximum(before, 0)], base[doc]) if len(starts) else base[doc]
    total = int(number.sum())
    x = np.zeros((total, FEATURES), dtype=np.float32)
    if len(d) > 2:
        wide = d.astype(np.uint32)
        gram = (((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        counts = np.bincount(of_byte[inside] * BUCKETS + gram[inside], minlength=total * BUCKETS).reshape(total, BUCKETS)
        x[:, :BUCKETS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    shares = np.bincount(of_byte * (len(KINDS) + 2) + kinds, minlength=total * (len(KINDS) + 2)).reshape(total, -1)
    x[:, BUCKETS : BUCKETS + len(KINDS) + 2] = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1)
    held = np.bincount(of_word, minlength=total)
    hashed = word_hashes(d, starts, stops)
    some = np.maximum(held, 1)
    x[:, -4] = np.log1p(held)
    x[:, -3] = np.bincount(of_word, weights=stops - starts, minlength=total) / some / 10
    x[:, -2] = np.bincount(of_word[repeated(hashed, owner)], minlength=total) / some
    if len(starts) > 2:
        with np.errstate(over="ignore"):
            triple = mix(hashed[:-2]) + mix(hashed[1:-1] ^ np.uint64(1)) * np.uint64(3) + mix(hashed[2:] ^ np.uint64(2)) * np.uint64(5)
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        x[:, -1] = np.bincount(of_word[whole[repeated(triple[whole], owner[whole])]], minlength=total) / some
    return x, base


def word_hashes(d: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, by prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    step = np.uint64(_STEP)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(d), step, dtype=np.uint64))
        back = np.cumprod(np.full(len(d), np.uint64(pow(_STEP, -1, 1 << 64)), dtype=np.uint64))
        sums = np.append(np.uint64(0), np.cumsum(powers * (d.astype(np.uint64) + np.uint64(1))))
        return mix((sums[stops] - sums[starts]) * back[starts])


def repeated(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where a key was met before in the same text."""
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return order[1:][same]  # equal keys keep their order


class Attention:
    """Gated attention over encoded passages: parameters, scores and gradients."""

    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        draw = lambda a, b: g.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
        self.p = {"W": draw(FEATURES, ENCODED), "b": np.zeros(ENCODED, np.float32), "V": draw(ENCODED, ATTENDED), "U": draw(ENCODED, ATTENDED),
            "w": draw(ATTENDED, 1)[:, 0], "c": draw(ENCODED, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.mean, self.spread = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def scale(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread

    def widened(self) -> Attention:
        """The same model in 64 bits, whose scores don't depend on how passages are batched."""
        self.p = {k: v.astype(np.float64) for k, v in self.p.items()}
        self.mean, self.spread = self.mean.astype(np.float64), self.spread.astype(np.float64)
        return self

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Of scaled passages and where bags start (each has a passage): weights of passages, scores of bags and what lies between."""
        p = self.p
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"bag": bag, "h": h, "v": v, "u": u, "a": a, "z": z, "score": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss."""
        p, f = self.p, self.forward(x, starts)
        bag, h, v, u, a = f["bag"], f["h"], f["v"], f["u"], f["a"]
        out = (f["score"] - y) * weight / len(y)
        dz = (out[:, None] * p["c"])[bag]
        da = (h * dz).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, starts)[bag])
        dv, du = ds[:, None] * p["w"] * u * (1 - v * v), ds[:, None] * p["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": f["z"].T @ out, "d": out.sum(keepdims=True)}

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int, seed: int = 5) -> Attention:
        """Adam over shuffled bags; both labels weigh alike up to a factor of 4."""
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + np.float32(0.02)
        share = float(np.clip(y.mean(), 0.2, 0.8))
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        stops = np.append(starts[1:], len(x))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, t = np.random.default_rng(seed), 0
        for _ in range(epochs):
            shuffled = order.permutation(len(y))
            for at in range(0, len(y), BATCH):
                some = shuffled[at : at + BATCH]
                rows = self.scale(np.concatenate([x[starts[i] : stops[i]] for i in some]))
                begins = np.append(0, np.cumsum(stops[some] - starts[some])[:-1])
                t += 1
                for k, grad in self.gradients(rows, begins, y[some], weight[some]).items():
                    grad = grad + PENALTY * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    self.p[k] = (self.p[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the labelled sample (_u, text, quality) in (one task), the pickled model out.

    Texts become passages batch by batch; documents count in the order of _u up to SAMPLE_BYTES.
    """
    sample = []
    for batch in batches:
        for part in slices([batch], "text", SLICE_BYTES):
            x, base = passages(part.column("text"))
            sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_pylist()
            bags = np.split(x.astype(np.float16), base[1:])
            sample += zip(part.column("_u").to_pylist(), sizes, part.column("quality").to_pylist(), bags, strict=True)
    sample.sort(key=lambda r: r[:3])
    within = np.cumsum([r[1] for r in sample]) <= SAMPLE_BYTES
    sample = [r for r, ok in zip(sample, within, strict=True) if ok] or sample[:1]
    x = np.concatenate([r[3] for r in sample]).astype(np.float32)
    starts = np.append(0, np.cumsum([len(r[3]) for r in sample])[:-1])
    y = np.array([r[2] for r in sample], dtype=np.float32)
    del sample
    model = Attention().fit(x, starts, y, max(EPOCHS, min(60, SEEN // len(y)))).widened()
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})
    del x, model
    release()


def judge(model, keep: list[str], with_attention: bool):
    """A function for mapInArrow: documents in, scores out, with the weight of each passage if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention = model.value
        for batch in slices(batches, "text", SLICE_BYTES):
            if not batch.num_rows:
                continue
            x, base = passages(batch.column("text"))
            f = attention.forward(attention.scale(x), base)
            columns = [*(batch.column(c) for c in keep), pa.array(f["score"].astype(np.float64))]
            if with_attention:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(base, len(x)), pa.int32()), pa.array(f["a"].astype(np.float64))))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", *["attention"] * with_attention])
        release()

    return run


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD,
    keep_text: bool = False, with_attention: bool = False) -> DataFrame:
    """Add score (0 to 1: how likely quality is 1) and predicted (1 from ``threshold``) to every document.

    ``labels`` has doc_id and quality (0 or 1). The model learns from at most ``sample`` different
    documents of each label and SAMPLE_BYTES of text, among the rows where ``learn_from`` is true
    (all, if none is given), chosen by hashes of id and text; it sees nothing but the text. Every
    document is scored on all its passages; ``with_attention`` adds their weights.

    Nulls: labels with a null id or quality are left out; a null or empty text has one passage
    without words and gets the model's score for that. Repeated labels of a document count once,
    as 1 if one says so; repeated documents get equal scores and are learned from once. Without
    documents of both labels nothing can be learned: scores are 0.5. Empty tables give no rows.
    Columns named like the results are replaced; text is dropped unless ``keep_text``.
    """
    rows = docs.drop("score", "predicted", "attention")
    keep = [c for c in rows.columns if keep_text or c != "text"]
    learn = rows if learn_from is None else rows.filter(F.coalesce(learn_from, F.lit(False)))
    chosen = labelled_sample(learn, labels, ["quality"], {True: sample, False: sample})
    fields = [*rows.select(*keep).schema.fields, StructField("score", DoubleType())]
    if chosen is None:
        scored = rows.select(*keep, F.lit(0.5).alias("score"))
        scored = scored.withColumn("attention", F.lit(None).cast("array<double>")) if with_attention else scored
    else:
        model = pickle.loads(chosen.repartition(1).mapInArrow(fit, "model binary").first()["model"])
        fields += [StructField("attention", ArrayType(DoubleType()))] * with_attention
        scored = rows.mapInArrow(judge(docs.sparkSession.sparkContext.broadcast(model), keep, with_attention), StructType(fields))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast(IntegerType()))
