"""Best-fit packing of documents into sequences of bounded length.

Bounded-space online best-fit: a task keeps a fixed number of open bins.  A
bitset has a bit for every amount of free space that some open bin has, so the
tightest bin that takes an item is the lowest set bit at or above its length.
When a bin more would be open than allowed, the fullest closes.

Only documents longer than a sequence are cut: full pieces stand alone and the
rest, which comes first, is packed like any document.  Nulls pack as the empty
text, which is one end token.  Repeated rows are packed one by one, ties in the
order of a hash.  An empty table gives an empty table; columns beyond ``doc_id``
and ``text`` are not read, whatever their names.  Texts of any length are
tokenized whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import fast_encoder
from .common import parts_for
from .shingles import slices_of


class BestFit:
    """Online best-fit over at most ``open_bins`` bins of ``size``."""

    def __init__(self, size: int, open_bins: int) -> None:
        self.size, self.most, self.n_open, self.made = size, open_bins, 0, 0
        self.free_bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """Place an item; returns its bin and its offset there."""
        fit = self.free_bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            at = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.n_open -= 1
            at, free = self.made, self.size
            self.made += 1
            self.n_open += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.free_bits |= 1 << left
        else:
            self.n_open -= 1
        return at, self.size - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        at = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        return at


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(path)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in ((first + j, t) for first, some in slices_of(b.column(1)) for j, t in enumerate(some)):
                ids = encode(t) + end
                n = len(ids) // 4
                s = 0
                e = n % size or size
                k = 0
                while s < n:
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
                    s, e, k = e, e + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, n_parts: int, size: int, open_bins: int = 256) -> DataFrame:
    """Add ``sequence_id`` and ``offset``.

    Only the narrow piece rows are shuffled, never tokens or texts: they are
    dealt out by a hash of all their columns, so no key can gather in a task,
    and put in a fixed order, so a task that runs again packs alike.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(size, open_bins)
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            placed = [bins.put(n) for n in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([first + at for at, _ in placed], pa.int64()), pa.array([off for _, off in placed], pa.int64())],
                [*b.schema.names, "sequence_id", "offset"],
            )

    dealt = F.xxhash64("doc_id", "piece", "ids_crc32")
    return (
        pieces.repartition(n_parts, dealt)
        .sortWithinPartitions(dealt, "doc_id", "piece")
        .mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, open_bins: int = 256, docs_per_part: int = 25_000) -> DataFrame:
    """Tokenize, cut and pack all documents.

    ``docs_per_part`` fixes how many documents share a set of bins, whatever
    the input's file layout, so the loss at each set's end stays under
    ``open_bins`` part-filled sequences.
    """
    n = docs.select(F.count(F.lit(1))).first()[0]
    return pack(token_pieces(docs, path, size, end_id), parts_for(n, docs_per_part), size, open_bins)
