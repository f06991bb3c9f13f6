"""Best-fit packing of tokenised documents into fixed-length sequences by sum of squares.

Tokenising and packing are one pass over the text and one shuffle of small rows: a piece is
described by six numbers, never by its ids. Each packing task holds at most one short piece
per document of its share; full pieces are sequences by themselves and pass straight through.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import parts_for, release, slices

#: Bytes of text that are encoded together.
SLICE_BYTES = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class TokenIds:
    """Token ids of texts, by blank-separated chunks that are encoded once for each batch of texts.

    The vocabulary file lower-cases and drops white space before it looks for tokens, so no token
    spans a blank and a text's ids are those of its chunks in order. A chunk of Latin letters with
    punctuation behind is two of the file's pre-tokens: the letters go to the file's model by
    themselves and are remembered, up to LIMIT words. Other chunks are encoded whole, and so is
    every text where the file treats PROBE otherwise.
    """

    LIMIT = 150_000
    PLAIN = "^(?P<core>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]{1,48})(?P<tail>[.,;:!?#$%&*|]{0,16})$"
    PROBE = "The river, le caf\u00e9!  \u00c9t\u00e9 ;\nwords Zw\u00f6lf? 12 don't a|b x.y |"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.word_end[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_letters = np.arange(256, dtype="<u4")  # how byte-level files write bytes as letters; the blank stays
        self.byte_letters[[b for b in range(256) if b not in shown]] = 256 + np.arange(256 - len(shown))
        self.byte_letters[32] = 32
        self.words: dict[str, bytes] = {}
        self.by_chunks = True
        self.by_chunks = self.of([self.PROBE])[0].tobytes() == self.encode(self.PROBE)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember the ids of pre-tokens in small letters."""
        fresh = [w for w in words if w and w not in self.words]
        for at in range(0, len(fresh), 2000):
            some = fresh[at : at + 2000]
            written = self.byte_letters[np.frombuffer(" ".join(some).encode("utf-8"), dtype=np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.model.encode_batch_fast([written], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.word_end[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.words.update(zip(some, [data[a:b] for a, b in zip([0, *cuts], cuts,
                strict=False)] if len(cuts) == len(some) else map(self.encode, some), strict=True))

    def chunks(self, chunks: pa.StringArray) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.words) > self.LIMIT:
            self.words = {}
        plain = pc.extract_regex(chunks, self.PLAIN)
        odd = plain.is_null().to_numpy(zero_copy_only=False) & (pc.binary_length(chunks).to_numpy() > 0)
        parts = []
        for i in (0, 1):
            field = pc.fill_null(pc.struct_field(plain, i), "").dictionary_encode()
            words = pc.utf8_lower(field.dictionary).to_numpy(zero_copy_only=False).tolist()
            self.learn(words)
            parts.append(np.array([*map(self.words.get, words, repeat(b"")), b""], dtype=object)[field.indices.to_numpy()])
        found = parts[0] + parts[1]
        for i in np.flatnonzero(odd):
            found[i] = self.encode(chunks[int(i)].as_py())
        return found.tolist()

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_chunks:
            return [np.frombuffer(self.encode(t), dtype="<u4") for t in texts]
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        data = self.chunks(coded.dictionary)
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
        ids, starts = np.frombuffer(b"".join(data), dtype="<u4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        flat = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - lengths), lengths)]
        bounds = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=1)
def token_ids(path: str) -> TokenIds:
    """One encoder for each file and worker."""
    return TokenIds(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(path: str | None, capacity: int, end_id: int):
    """A function for mapInArrow: documents in, descriptions of their pieces out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(path or tokenizer_path())
        tail = np.array([end_id], dtype="<u4")
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.of([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids = np.append(ids, tail)
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part)))
            yield _batch(rows, ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first, ties in the given order.

    With N(g) open bins of residual gap g, an item of length s may open a bin or go to a gap
    g >= s. Moving a bin from gap g to g - s changes the sum of N(g)^2 over 0 < g < capacity by
    2 (N(g - s) - N(g)) + 2; opening one changes it by 2 N(capacity - s) + 1; a filled bin
    leaves the sum. The least change is taken, then the smallest gap. A new bin is opened only
    where no open bin has room, since the aim is the fewest sequences.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        gaps = np.flatnonzero(count[size:capacity]) + size
        if len(gaps):
            after = np.where(gaps == size, 0, count[gaps - size])
            delta = np.where(gaps == size, 1 - 2 * count[gaps], 2 * (after - count[gaps]) + 2)
            gap = int(gaps[np.argmin(delta)])
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def pack_pieces(capacity: int):
    """A function for mapInArrow: descriptions of pieces in, their places out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId() if TaskContext.get() else 0
        first, used, short = partition << 40, 0, []
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

        def placed(batch: pa.RecordBatch, sequences, offsets) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=names)

        for batch in batches:
            whole = np.asarray(batch.column("length")) == capacity
            full = batch.filter(pa.array(whole))
            yield placed(full, first + used + np.arange(full.num_rows), np.zeros(full.num_rows, dtype=np.int64))
            used += full.num_rows
            short.append(batch.filter(pa.array(~whole)))
        rest = pa.Table.from_batches(short).combine_chunks() if short else None
        if rest is not None and rest.num_rows:
            bins, offsets = sum_of_squares(np.asarray(rest.column("length")), capacity)
            for batch in rest.append_column("sequence_id", pa.array(first + used + bins)).append_column("offset",
                pa.array(offsets)).to_batches(max_chunksize=10_000):
                yield batch

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, docs_per_task: int = 20_000) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    A document's ids are those of the vocabulary file at ``path`` (the public word-level file if
    none is given), then ``end_id``; only documents longer than a sequence are cut, and only the
    last piece of one is shorter than a sequence. Returns a row per piece with its place.

    Nulls: a null text is an empty one (just the end id); a null doc_id stays null. Repeated rows
    and equal texts are packed as often as they occur, ties in arrival order. Very long texts
    become many full pieces, which need no packing. An empty table gives no rows. Further columns
    are ignored. A task packs about ``docs_per_task`` documents: memory is bounded by that
    number, and a share that large wastes well under 1 % against one global packing.
    """
    tasks = parts_for(docs.count(), docs_per_task)
    pieces = docs.select("doc_id", "text").mapInArrow(pieces_of(path, capacity, end_id), PIECES)
    return pieces.repartition(tasks).mapInArrow(pack_pieces(capacity), PACKED)
