"""Alignment of two tokenizers by inverted pair bitmaps.

Texts are encoded by both tokenizers; tokens whose byte ranges overlap are linked. For every pair
of ids a chunk of documents keeps a compressed bitmap of the documents that hold it linked, one
plane for each bit of how often they do: a document is in the OR of the planes, and in plane j if
bit j of its number of links is set. The popcount of the OR is the pair's count of documents, the
popcounts of the planes, weighed by 2^j, its count of links. Chunks share no document, so their
counts add up. The totals are joined to the bitmaps again, which then hand each document in them
its scores: texts are read once, and no row is ever made for a pair in a document.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, release, slices

#: Bytes of text that are encoded together; documents and (pair, document) entries of a chunk at most.
SLICE_BYTES, CHUNK_DOCS, CHUNK_ENTRIES = 1_000_000, 1 << 16, 2_000_000
#: Bits of an id of the second tokenizer in the number of a pair.
ID_BITS = 24
#: Pairs up to this number are broadcast with their totals.
BROADCAST_PAIRS = 100_000
FIELDS = "chunk long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ENTRIES = "chunk long, pair long, n_docs long, n_linked long, planes array<binary>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteLevel:
    """The byte-level vocabulary file: ids of texts with a blank in front, and each id's bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        special = {t["content"] for t in described.get("added_tokens", ()) if t.get("special")}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as themselves
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = described["model"]["vocab"]
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        ranks = {}
        for token, i in vocabulary.items():
            if token not in special:
                self.bytes_of[i] = bytes(byte_of[c] for c in token)
                ranks[self.bytes_of[i]] = i
        # ids ascend as the merges do, so the same file serves the faster encoder
        self.fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        except ValueError:  # white space longer than the fast encoder's pattern can look back
            return np.array(self.plain.encode(" " + text, add_special_tokens=False).ids, dtype=np.int64)


class Pieces:
    """The piece vocabulary file: ids of texts, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i,
            p in ((i, self.model.id_to_piece(i)) for i in range(n))]

    def of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def both(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces, dict]:
    """The encoders of a worker, with their tables of lengths, bytes and decimal ids."""
    a, b = ByteLevel(a_path), Pieces(b_path)
    tables = {}
    for name, coder, ends in (("a", a, (b",", b"|")), ("b", b, (b",", b";"))):
        tables[name] = (np.array([len(x) for x in coder.bytes_of], dtype=np.int64), as_objects(coder.bytes_of),
            as_objects([str(i).encode() + end for i in range(len(coder.bytes_of)) for end in ends]))
    return a, b, tables


def as_objects(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of two lists of tokens over the same bytes, from their ends: indices of both sides, and whether a group ends.

    Between two ends of either side lies a part of one token of each side, and each pair of
    tokens that overlap shares one such part, so a link is an end of the union.
    """
    ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")  # two ascending runs are merged
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends) if len(ends) else np.zeros(0, dtype=bool)


def align(texts: list[str | None], coders: tuple[ByteLevel, Pieces, dict]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Rows (n_a, n_b, n_groups, n_links, groups_sha256) of texts; (text, pair) numbers that are linked, and how often."""
    a, b, tables = coders
    (size_a, bytes_a, text_a), (size_b, bytes_b, text_b) = tables["a"], tables["b"]
    ids_a, ids_b = [], []
    found = b.of([t or "" for t in texts])
    for i, text in enumerate(texts):
        one = a.of(text) if text else np.zeros(0, dtype=np.int64)
        other = found[i] if text else one
        if text:
            given = b" " + text.encode("utf-8")
            if b"".join(bytes_a[one].tolist()) != given or b"".join(bytes_b[other].tolist()) != given:
                one = other = np.zeros(0, dtype=np.int64)
        ids_a.append(one)
        ids_b.append(other)
    n_a, n_b = np.array([len(x) for x in ids_a], dtype=np.int64), np.array([len(x) for x in ids_b], dtype=np.int64)
    ta, tb = np.concatenate([*ids_a, np.zeros(0, dtype=np.int64)]), np.concatenate([*ids_b, np.zeros(0, dtype=np.int64)])
    ends_a, ends_b = np.cumsum(size_a[ta]), np.cumsum(size_b[tb])  # both sides cover the same bytes, text by text
    la, lb, cut = links_of(ends_a, ends_b)
    owner = np.repeat(np.arange(len(texts)), n_a)[la] if len(la) else la
    n_links, n_groups = np.bincount(owner, minlength=len(texts)), np.bincount(owner[cut], minlength=len(texts))
    last_a, last_b = np.zeros(len(ta), dtype=np.int64), np.zeros(len(tb), dtype=np.int64)
    last_a[la[cut]] = last_b[lb[cut]] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    written = np.empty(len(ta) + len(tb), dtype=object)
    written[np.arange(len(ta)) + np.searchsorted(group_b, group_a)] = text_a[2 * ta + last_a]
    written[np.arange(len(tb)) + np.searchsorted(group_a, group_b, side="right")] = text_b[2 * tb + last_b]
    stop = np.cumsum(n_a + n_b)
    rows = [(x, y, g, m, hashlib.sha256(b"".join(written[e - x - y : e].tolist())[:-1]).hexdigest() if x else "") for x, y, g, m,
        e in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), stop.tolist(), strict=True)]
    pair = (ta[la] << ID_BITS) | tb[lb]
    order = np.lexsort((owner, pair))
    pair, owner = pair[order], owner[order]
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1]))) if len(pair) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(first, len(pair)))
    return rows, np.stack([pair[first], owner[first]]), times


def pack_planes(pair: np.ndarray, slot: np.ndarray, times: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """Bitmaps of a chunk with ``docs`` documents: pairs, documents and links of each, and their planes.

    A plane is a sorted list of 16-bit places or, where that is as long, a bit for each document.
    """
    order = np.lexsort((slot, pair))
    pair, slot, times = pair[order], slot[order], times[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
    n_docs = np.bincount(row, minlength=len(first))  # popcount of the OR: every entry is in one plane at least
    n_linked = np.bincount(row, weights=times, minlength=len(first)).astype(np.int64)
    most = np.maximum.reduceat(times, first) if len(first) else times
    planes = np.ceil(np.log2(most + 1.0)).astype(np.int64)  # bits of the largest number
    start = np.cumsum(planes) - planes
    entry, places = [], []
    for j in range(int(planes.max()) if len(planes) else 0):
        inside = (times >> j) & 1 == 1
        entry.append(start[row[inside]] + j)
        places.append(slot[inside])
    entry, places = np.concatenate([*entry, np.zeros(0, dtype=np.int64)]), np.concatenate([*places, np.zeros(0, dtype=np.int64)])
    order = np.argsort(entry, kind="stable")
    entry, places = entry[order], places[order]
    total, width = int(planes.sum()), (docs + 7) // 8
    held = np.bincount(entry, minlength=total)
    as_bits = 2 * held >= width
    sizes = np.where(as_bits & (held > 0), width, 2 * held)
    offsets = np.append(0, np.cumsum(sizes))
    data = np.zeros(int(offsets[-1]), dtype=np.uint8)
    begin = np.cumsum(held) - held
    listed = ~as_bits[entry]
    at = offsets[entry[listed]] + 2 * (np.flatnonzero(listed) - begin[entry[listed]])
    data[at], data[at + 1] = places[listed] & 255, places[listed] >> 8
    at, bit = offsets[entry[~listed]] + (places[~listed] >> 3), (1 << (places[~listed] & 7)).astype(np.uint8)
    if len(at):
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        data[at[new]] = np.add.reduceat(bit, new, dtype=np.uint8)
    binary = pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return pair[first], n_docs, n_linked, pa.ListArray.from_arrays(pa.array(np.append(start, total), pa.int32()), binary)


def unpack_planes(planes: pa.ListArray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of bitmaps again: row of the bitmap, place of the document, 2^j of the plane."""
    width = (docs + 7) // 8
    starts = planes.offsets.to_numpy().astype(np.int64)
    flat = planes.values.slice(starts[0], starts[-1] - starts[0])
    row = np.repeat(np.arange(len(planes)), np.diff(starts))
    weight = np.int64(1) << (np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], np.diff(starts)))
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
    sizes = np.diff(offsets)
    bits = (sizes == width) & (sizes > 0)
    held = np.where(bits, 0, sizes // 2)
    at = np.repeat(offsets[:-1] - 2 * (np.cumsum(held) - held), held) + 2 * np.arange(int(held.sum()))
    out = [(np.repeat(np.arange(len(flat)), held), data[at].astype(np.int64) | (data[at + 1].astype(np.int64) << 8))]
    for some in np.array_split(np.flatnonzero(bits), max(1, int(bits.sum()) * width // 1_000_000)):
        if len(some):
            which, place = np.nonzero(np.unpackbits(data[offsets[some][:, None] + np.arange(width)], axis=1, bitorder="little"))
            out.append((some[which], place))
    entry, place = (np.concatenate(x) for x in zip(*out, strict=True))
    return row[entry], place, weight[entry]


def encode(a_path: str | None, b_path: str | None, slice_bytes: int, chunk_docs: int, chunk_entries: int):
    """A function for mapInArrow: documents in; a row for each document, and the bitmaps of each chunk, out."""
    names = ["is_doc", "chunk", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "n_docs", "n_linked", "planes"]
    types = [pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), *[pa.int64()] * 3, pa.list_(pa.binary())]

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coders = both(a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))
        chunk, docs, entries = TaskContext.get().partitionId() << 32, 0, []

        def closed() -> Iterator[pa.RecordBatch]:
            keys, times = np.concatenate([e[0] for e in entries], axis=1), np.concatenate([e[1] for e in entries])
            pair, n_docs, n_linked, planes = pack_planes(keys[0], keys[1], times, docs)
            for at in range(0, len(pair), 20_000):
                some = slice(at, at + 20_000)
                yield rows(len(pair[some]), is_doc=pa.array(np.zeros(len(pair[some]), dtype=bool)), chunk=pa.array(np.full(len(pair[some]), chunk)), pair=pa.array(pair[some]),
                    n_docs=pa.array(n_docs[some]), n_linked=pa.array(n_linked[some]), planes=planes.slice(at, len(pair[some])))

        for whole in slices(batches, "text", slice_bytes):
            for start in range(0, whole.num_rows, chunk_docs):
                batch = whole.slice(start, chunk_docs)
                if entries and (docs + batch.num_rows > chunk_docs or sum(len(e[1]) for e in entries) >= chunk_entries):
                    yield from closed()
                    chunk, docs, entries = chunk + 1, 0, []
                found, keys, times = align(batch.column("text").to_pylist(), coders)
                n_a, n_b, n_groups, n_links, text = zip(*found, strict=True)
                n = batch.num_rows
                yield rows(n, is_doc=pa.array([True] * n), chunk=pa.array([chunk] * n, pa.int64()), slot=pa.array(range(docs, docs + n), pa.int32()),
                    doc_id=batch.column("doc_id").cast(pa.int64()), n_a=pa.array(n_a, pa.int64()), n_b=pa.array(n_b, pa.int64()), n_groups=pa.array(n_groups, pa.int64()),
                    n_links=pa.array(n_links, pa.int64()), groups_sha256=pa.array(text, pa.string()))
                keys[1] += docs
                entries.append((keys, times))
                docs += n
        if entries:
            yield from closed()
        del entries
        release()

    return run


def hand_back(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The scores of a chunk's documents, from its bitmaps and the totals of their pairs."""
    n = docs.num_rows
    best, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for batch in pairs.to_batches(max_chunksize=10_000):
        row, place, weight = unpack_planes(batch.column("planes"), n)
        count, is_best = np.asarray(batch.column("total")), batch.column("best").to_numpy(zero_copy_only=False)
        np.add.at(total, place, weight * count[row])
        np.add.at(best, place, weight * is_best[row])
    slot = np.asarray(docs.column("slot"))
    return pa.table({c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(best[slot]), "count_sum": pa.array(total[slot]),
        "groups_sha256": docs.column("groups_sha256")})


def pair_counts(entries: DataFrame) -> DataFrame:
    """For each pair: total (documents that hold it linked), linked (its links) and best (no pair of its first id has more documents)."""
    counts = entries.groupBy("pair").agg(F.sum("n_docs").alias("total"), F.sum("n_linked").alias("linked"))
    most = F.max("total").over(Window.partitionBy(F.shiftright("pair", ID_BITS)))  # rows of an id: the other vocabulary at most
    return counts.withColumn("best", F.col("total") == most)


def encoded(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, slice_bytes: int = SLICE_BYTES, chunk_docs: int = CHUNK_DOCS,
    chunk_entries: int = CHUNK_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Stored rows of documents and of bitmaps, by chunk."""
    ensure_checkpoint_dir(docs.sparkSession)
    shape = f"is_doc boolean, {FIELDS}, {ENTRIES.removeprefix('chunk long, ')}"
    stored = docs.select("doc_id", "text").mapInArrow(encode(a_path, b_path, slice_bytes, min(chunk_docs, CHUNK_DOCS), chunk_entries), shape).checkpoint()
    columns = lambda d: [c.split()[0] for c in d.split(", ")]
    return stored.filter("is_doc").select(*columns(FIELDS)), stored.filter("NOT is_doc").select(*columns(ENTRIES))


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, **bounds: int) -> DataFrame:
    """Align the tokens of a byte-level and a piece vocabulary in every document (doc_id, text).

    Returns per row: doc_id, n_a and n_b (tokens), n_groups (parts between ends that both sides
    share), n_links (pairs of tokens whose bytes overlap), n_best (links whose pair is held linked
    by as many documents as any pair of its first id), count_sum (those numbers of documents over
    all links) and groups_sha256 (digest of ``a1,a2|b1;a3|b2`` in ids).

    Nulls: a text that is null, empty, or that one side does not give back byte by byte (with a
    blank in front) has no tokens: zeros and an empty digest; a null doc_id stays null. Rows
    count as documents of their own, repeated or not. Control strings inside texts are plain text.
    A long text is encoded whole and is a chunk of its own at most. Empty tables give no rows;
    further columns are ignored. A task holds a slice of texts and a chunk's entries; ``bounds``
    are slice_bytes, chunk_docs (65536 at most) and chunk_entries.
    """
    rows, entries = encoded(docs, a_path, b_path, **bounds)
    counts = pair_counts(entries).checkpoint()
    scored = entries.join(F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts, "pair").select(F.col("chunk").alias("part"), "planes", "total", "best")
    return rows.groupBy("chunk").cogroup(scored.groupBy("part")).applyInArrow(hand_back, RESULT)
