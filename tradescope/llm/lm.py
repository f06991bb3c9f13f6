"""Language-model scoring by cross-entropy difference.

Two bigram models with one vocabulary, one smoothing and one order are counted over all
documents: the background over every document, the target over those marked as such. What a
document itself added to a model is taken off the counts that it is scored with, so that no text
speaks for itself. A document's score is the mean over its tokens of target loss minus background
loss.

Words, contexts and pairs are counted under their own 64-bit hashes, so the counts grow with the
corpus and nothing is gathered but three sums. A task cuts its documents into chunks and adds up
the n-grams of each; a chunk sends every distinct n-gram once, in blocks by range of hash, to the
part of the table that holds that range, and gets the corpus' counts back. So the commonest
n-gram has one entry a chunk. Chunks carry their documents as numbers of words; texts are read
once to find the vocabulary's size and once to be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, release, slices

#: Weight of the unigram model in a bigram's estimate, and added to each unigram count.
PRIOR, ADDED = 50.0, 0.1
#: Ids of target documents up to this number are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_IDS = 2_000_000
#: Bytes of text in a chunk, and entries in a part of the table of counts, at most.
CHUNK_BYTES, PART_ROWS = 12_000_000, 1_500_000
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 2_000_000
#: Tokens that are scored together.
SCORED = 400_000

BLOCKS = "chunk long, part long, doc_ids array<bigint>, sizes binary, targets binary, tokens binary, keys binary, counts binary"
SCORES = "doc_id long, n_tokens long, ce_target double, ce_background double, score double"


def split(text: str | None) -> list[bytes]:
    """The blank-separated words of a text with A-Z in small letters."""
    return text.encode("utf-8").lower().split() if text else []


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed: their lowest bytes, then their second ones and so on."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, n).T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct words by hash, and, with a null hash, its numbers of tokens."""
    held, n, n_target = np.empty(0, dtype=np.uint64), 0, 0

    def made(words: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), 200_000):
            some = words[at : at + 200_000].view(np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(some), "n": pa.array(np.zeros(len(some), np.int64)),
                "n_target": pa.array(np.zeros(len(some), np.int64))})

    for batch in slices(batches, "text", 4_000_000):
        found: set[bytes] = set()
        for text, target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
            words = split(text)
            found.update(words)
            n, n_target = n + len(words), n_target + len(words) * target
        held = np.union1d(held, hash_words(list(found)))
        if len(held) > HELD_WORDS:
            yield from made(held)
            held = held[:0]
    yield from made(held)
    yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.int64()), "n": pa.array([n], pa.int64()), "n_target": pa.array([n_target], pa.int64())})


def ngrams(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words and pairs; the word and the context of each pair; the pair of each token.

    ``words`` are the hashes of the words of texts with ``sizes`` words; the context of a text's
    first word is the start mark 1, which counts among the words.
    """
    before = np.ones_like(words)
    before[1:] = words[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 1
    with np.errstate(over="ignore"):
        pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + words)
    pairs, first, pair_of = np.unique(pair, return_index=True, return_inverse=True)
    names, of = np.unique(np.concatenate((words[first], before[first])), return_inverse=True)
    return names, pairs, of[: len(first)], of[len(first) :], pair_of


def by_count(counts: np.ndarray) -> np.ndarray:
    """Positions by falling count: common words get small numbers."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def part_counts(tokens: int, part_rows: int) -> tuple[int, int]:
    """In how many parts the tables of words and of pairs are held."""
    n = max(1, -(-tokens // part_rows))
    return max(1, n // 4), n


def chunk_blocks(parts: tuple[int, int], chunk_bytes: int):
    """A function for mapInArrow: documents in; chunks, and their n-grams with counts by part, out."""
    bounds = [np.array([-(-(i << 64) // p) for i in range(1, p)], dtype=np.uint64) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text", chunk_bytes)):
            chunk = (task << 32) + k
            sizes, hashes = [], []
            for some in slices([batch], "text", 4_000_000):
                words = [split(t) for t in some.column("text").to_pylist()]
                sizes.append(np.array([len(w) for w in words], dtype=np.int64))
                hashes.append(hash_words([w for one in words for w in one]))
            sizes = np.concatenate(sizes)
            names, pairs, word_of, context_of, pair_of = ngrams(np.concatenate(hashes), sizes)
            flags = np.asarray(batch.column("target").to_numpy(zero_copy_only=False), dtype=bool)
            target = np.repeat(flags, sizes)
            by_pair = np.stack([np.bincount(of, minlength=len(pairs)) for of in (pair_of, pair_of[target])])
            by_word = np.stack([np.bincount(of, weights=n, minlength=len(names)).astype(np.int64) for of in (word_of, context_of) for n in by_pair])
            number = np.empty(len(names), dtype=np.int64)
            number[by_count(by_word[0])] = np.arange(len(names))
            yield batch_of([(chunk, -1 - chunk, batch.column("doc_id").to_pylist(), pack(sizes), pack(flags),
                pack(number[word_of[pair_of]]), None, pack(by_word[0]))])
            del target, hashes, words
            rows = []
            for start, bound, keys, counts in ((0, bounds[0], names, by_word), (parts[0], bounds[1], pairs, by_pair)):
                cuts = [0, *np.searchsorted(keys, bound).tolist(), len(keys)]
                rows += [(chunk, start + i, None, None, None, None, pack_keys(keys[a:b]), pack(counts[:, a:b].ravel())) for i,
                    (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            if rows:
                yield batch_of(rows)
        release()

    return run


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "part": pa.int64(), "doc_ids": pa.list_(pa.int64())} | dict.fromkeys(("sizes",
        "targets", "tokens", "keys", "counts"), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def add_up(word_parts: int):
    """A function for groups: the blocks of a part in, with the corpus' counts for the chunk's out; a chunk as it is."""

    def run(blocks: pa.Table) -> pa.Table:
        if blocks.column("part")[0].as_py() < 0:
            return blocks
        rows = blocks.select(["chunk", "part", "keys", "counts"]).to_pylist()
        keys = [unpack_keys(row["keys"]) for row in rows]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(row["counts"]).reshape(-1, len(k)) for row, k in zip(rows, keys, strict=True)], axis=1)
        sums = np.zeros((len(counts), len(distinct)), dtype=np.uint64)
        for total, n in zip(sums, counts, strict=True):
            np.add.at(total, which, n)
        own = np.split(which, np.cumsum([len(k) for k in keys])[:-1])
        return pa.Table.from_batches([batch_of([(row["chunk"], row["part"], None, None, None, None,
            row["keys"] if row["part"] < word_parts else None, pack(sums[:, of].ravel())) for row, of in zip(rows, own, strict=True)])])

    return run


def losses(pair: np.ndarray, word: np.ndarray, context: np.ndarray, total: np.ndarray, words: int) -> np.ndarray:
    """Negative log probability of words given their contexts, from the counts of pairs, words and contexts."""
    unigram = (word + ADDED) / (total + ADDED * words)
    return -np.log((pair + PRIOR * unigram) / (context + PRIOR))


def own_counts(owner: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each token, how often its document has the n-gram that ``of`` numbers."""
    _, which, count = np.unique(owner.astype(np.int64) * (int(of.max(initial=0)) + 1) + of, return_inverse=True, return_counts=True)
    return count[which]


def score_chunks(word_parts: int, words: int, total: int, total_target: int):
    """A function for groups: a chunk and its n-grams' counts in, the scores of its documents out."""

    def run(blocks: pa.Table) -> pa.Table:
        own, *parts = blocks.sort_by("part").to_pylist()
        sizes, rows = unpack(own["sizes"]).astype(np.int64), len(own["doc_ids"])
        flags = (unpack(own["targets"]).astype(np.int64), np.ones(rows, dtype=np.int64))
        sums = np.zeros((2, rows))
        if parts:
            names = np.concatenate([unpack_keys(part["keys"]) for part in parts if part["part"] < word_parts])
            by_word = np.concatenate([unpack(part["counts"]).reshape(4, -1) for part in parts if part["part"] < word_parts], axis=1).view(np.int64)
            by_pair = np.concatenate([unpack(part["counts"]).reshape(2, -1) for part in parts if part["part"] >= word_parts], axis=1).view(np.int64)
            del parts
            tokens = names[by_count(unpack(own["counts"]))[unpack(own["tokens"]).astype(np.int64)]]
            word_of, context_of, pair_of = (a.astype(np.int32) for a in ngrams(tokens, sizes)[2:])
            del tokens, names
            ends = np.cumsum(sizes)
            first = 0
            while first < rows:  # documents of about SCORED tokens at a time
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SCORED, side="right")))
                pair = pair_of[ends[first] - sizes[first] : ends[last - 1]]
                owner = np.repeat(np.arange(last - first), sizes[first:last])
                word, context = word_of[pair], context_of[pair]
                mine = [own_counts(owner, of) for of in (pair, word, context)]
                for k, (i, n) in enumerate(((1, total_target), (0, total))):
                    off = flags[k][first:last][owner]
                    loss = losses(by_pair[i][pair] - off * mine[0], by_word[i][word] - off * mine[1],
                        by_word[2 + i][context] - off * mine[2], n - off * sizes[first:last][owner], words)
                    sums[k, first:last] = np.bincount(owner, weights=loss, minlength=last - first) / np.maximum(sizes[first:last], 1)
                first = last
        empty = sizes == 0
        return pa.Table.from_arrays([pa.array(own["doc_ids"], pa.int64()), pa.array(sizes), *(pa.array(v, mask=empty) for v in (*sums,
            sums[0] - sums[1]))], names=["doc_id", "n_tokens", "ce_target", "ce_background", "score"])

    return run


def score_documents(docs: DataFrame, targets: DataFrame, chunk_bytes: int = CHUNK_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """Score every document (doc_id, text): doc_id, n_tokens, ce_target, ce_background, score.

    ``targets`` has the doc_ids of the target sample. Tokens are blank-separated words with A-Z
    in small letters; entropies are in nats per token. A low score means close to the target. The
    vocabulary of both models is the distinct words of all documents; both have one order and one
    smoothing. Each document's own n-grams are taken off the background's counts, and off the
    target's if it belongs there, before it is scored.

    Nulls and empty texts have no tokens and null scores; null doc_ids are in no target. Repeated
    rows count, and are scored, as often as they occur; repeated targets count once. With no
    targets the target model is the uniform prior. Empty tables give no rows; further columns are
    ignored.
    """
    ids = targets.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_target")).filter(F.col("_id").isNotNull()).distinct()
    small = ids.count() <= BROADCAST_IDS
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("_id"), "left")
    marked = marked.select(F.col("doc_id").cast("long"), "text", F.coalesce("_target", F.lit(False)).alias("target"))
    known = marked.select("text", "target").mapInArrow(count_words,
        "word long, n long, n_target long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    words, total, total_target = known.agg(F.count("word"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    parts = part_counts(total, part_rows)
    blocks = marked.mapInArrow(chunk_blocks(parts, chunk_bytes), BLOCKS)
    counted = blocks.groupBy("part").applyInArrow(add_up(parts[0]), BLOCKS)
    return counted.groupBy("chunk").applyInArrow(score_chunks(parts[0], words, total, total_target), SCORES)
