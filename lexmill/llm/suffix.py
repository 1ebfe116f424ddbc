"""Removal of repeated passages by a distributed sort of suffixes.

Every byte is removed that a string of ``length`` bytes covers which also starts
in a document of a smaller id.  The strings are prefixes of suffixes, and equal
ones are found by sorting suffixes:

1. Anchors.  Of the 24-byte strings inside a string of ``length`` bytes the one
   of least hash is its anchor, so equal strings have equal anchors at equal
   places, and only some one byte in fourteen is an anchor.  Hashes of anchors
   are exchanged, and those that more than one text has are told to the texts.
2. Runs.  Each task sorts the suffixes at such anchors, each with the bytes
   before it and a mask of the strings that belong to its anchor; settles what
   its own suffixes tell, so that of equal strings only those of the least id go
   on; and exchanges the rest as front-coded sorted runs.
3. Merging.  The runs of a bucket are merged by a loser tree whose entries know
   how long a prefix they share with the last winner: the longer one wins, and
   bytes are compared only behind equal prefixes.  The common prefixes that the
   merge yields tell which strings are equal, without comparing them again.
4. Masks of repeated strings go back to their texts.

A bucket holds all contexts of its anchors.  Those of heavy anchors, which many
tasks have met, are dealt out by their contexts as well: the strings of such a
suffix fall into four groups by where they start, and a group goes by the bytes
that all its strings have in common, most of the ``length``.

Equal texts are one text, the one of the least id; the others are repeated as a
whole (if they have ``length`` bytes).  Strings are judged on the input.  Texts
are told apart by 16 bytes of their SHA-256, strings by their bytes: hashes only
bring together what may be equal.

A null text is the empty text.  Texts shorter than ``length`` bytes keep all.
Rows that repeat a doc_id do not make each other repeated.  A null doc_id comes
after all others; ids are integers.  Texts of any length are read in pieces.  Ties
between equal strings go to the least id.  Columns beyond ``doc_id`` and ``text``
are passed through, whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_for, step
from .shingles import U, _powers, mix, numbers

LENGTH, ANCHOR = 50, 24
#: Window starts of a text judged together, and bytes of texts whose anchors are found at once; places there fit in 22 bits.
PIECE, BLOCK = 65_000, 1 << 16
_PLACE_BITS = 22
#: Bytes that a task sends on at once.
SENT_AT_ONCE = 1 << 20
#: Anchors and suffixes that a task gathers before it sends them on, and that a bucket should hold.
ANCHORS_A_FLUSH, ANCHORS_A_BUCKET = 500_000, 800_000
SUFFIXES_A_FLUSH, SUFFIXES_A_BUCKET = 120_000, 400_000
#: Bytes of a hash that are sent; its bucket tells the rest.
KEY_BYTES = 5
LOW = U((1 << 40) - 1)
_BYTE = numbers(256, 31)
#: An anchor is heavy if this many texts at least were sent for it, and this share of all; so heavy ones, of which 8 bytes are broadcast, are at most 1 / HEAVY_SHARE.
HEAVY_LEAST, HEAVY_SHARE = 32, 2.5e-7
#: First and last string, by bytes before the anchor, of the groups of a heavy anchor's strings.
GROUPS = ((0, 6), (7, 13), (14, 20), (21, 26))
#: Bytes of a text's name.
NAME = 16


def names_of(data: bytes) -> list[bytes]:
    return [data[i : i + NAME] for i in range(0, len(data), NAME)]


def numbered(names: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct names, and the number of each name among them."""
    seen: dict[bytes, int] = {}
    at = np.array([seen.setdefault(x, len(seen)) for x in names], np.int64)
    return list(seen), at


def part_of(name: bytes, n_parts: int) -> int:
    return int.from_bytes(name[:8], "little") % n_parts


def anchors(piece: np.ndarray, length: int = LENGTH, ends: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor of a piece, and the first and last start of the strings it belongs to.

    No string goes over one of the ``ends``, which are ``length`` bytes apart or more.
    """
    wide = length - ANCHOR + 1
    n = len(piece) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, U), none, none
    up, down = _powers(max(16, (len(piece) - 1).bit_length()))
    sums = np.zeros(len(piece) + 1, U)
    np.cumsum(_BYTE[piece] * up[: len(piece)], out=sums[1:])
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(piece) - ANCHOR + 1])
    least = (hashes & ~U((1 << _PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=U)
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    places = (least[:n] & U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    changes = np.concatenate([[True], places[1:] != places[:-1], [True]])
    if not len(ends):
        edges = np.flatnonzero(changes)
        at = places[edges[:-1]]
        return at, hashes[at], edges[:-1], edges[1:] - 1
    within = np.ones(n, bool)
    within[(np.asarray(ends)[:, None] - np.arange(1, length)).ravel()] = False
    first = np.flatnonzero(within & (changes[:-1] | np.concatenate([[True], ~within[:-1]])))
    last = np.flatnonzero(within & (changes[1:] | np.concatenate([~within[1:], [True]])))
    at = places[first]
    return at, hashes[at], first, last


def pieces_of(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that together have each of its strings of ``length`` bytes once."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        yield at, data[at : at + PIECE + length - 1]


def anchors_of(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of texts, a block of their pieces at a time: the block's bytes, each anchor's text (its number) and place there, and what anchors() tells."""

    def blocks() -> Iterator[list[tuple[int, int, np.ndarray]]]:
        block, size = [], 0
        for k, text in enumerate(texts):
            for base, piece in pieces_of(text, length):
                if block and size + len(piece) > BLOCK:
                    yield block
                    block, size = [], 0
                block.append((k, base, piece))
                size += len(piece)
        if block:
            yield block

    for block in blocks():
        numbers, bases, pieces = zip(*block, strict=True)
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        data = np.concatenate(pieces)
        at, keys, first, last = anchors(data, length, ends[:-1])
        piece = np.searchsorted(ends, at, side="right")
        yield data, np.array(numbers, np.int64)[piece], at + (np.array(bases, np.int64) - ends + sizes)[piece], at, keys, first, last


def _together(rows: Iterator[tuple], text: int, most: int) -> Iterator[list[tuple]]:
    """Rows, some at a time, whose texts have ``most`` characters or little more, or one long text."""
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r[text])
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _planes(x: np.ndarray, width: int | None = None) -> bytes:
    """Little-endian numbers by byte planes, which compress better; their lowest bytes alone if a width is given."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def _from_planes(data: bytes, kind: str, width: int | None = None) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width or size, -1)
    whole = np.zeros((planes.shape[1], size), np.uint8)
    whole[:, : width or size] = planes.T
    return whole.view(kind).ravel()


def _rows(batch: pa.RecordBatch, *columns: int, at_once: int = 200) -> Iterator[tuple]:
    """Values of some columns, row by row; few rows are Python objects at a time."""
    for k in range(0, batch.num_rows, at_once):
        yield from zip(*(batch.column(c).slice(k, at_once).to_pylist() for c in columns), strict=True)


def _buckets(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket, from rows in order of buckets."""
    at, held = None, []
    for b in rows:
        for r in b.to_pylist():
            if r["bucket"] != at:
                if held:
                    yield at, held
                at, held = r["bucket"], []
            held.append(r)
    if held:
        yield at, held


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of SENT_AT_ONCE bytes or one row more, so that neither side holds all of them in another form."""
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if size >= SENT_AT_ONCE:
            yield _batch(some, schema)
            some, size = [], 0
    if some:
        yield _batch(some, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_ANCHOR_ROWS = pa.schema([("bucket", pa.int32()), ("th", pa.binary()), ("keys", pa.binary()), ("table", pa.binary()), ("texts", pa.binary()), ("places", pa.binary())])
_PART_ROWS = pa.schema([("bucket", pa.int32()), ("ths", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("heavy", pa.binary())])
_PLACE_ROWS = pa.schema([("th", pa.binary()), ("places", pa.binary()), ("heavy", pa.binary())])


def _by_text(texts: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(texts, kind="stable")
    texts = texts[order]
    edges = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1], [True]])) if len(texts) else [0]
    columns = [c[order] for c in columns]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        yield int(texts[s]), [c[s:e] for c in columns]


def _runs_of(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, where texts stay as they are, starts of the keys' runs, and whether a run has several texts."""
    order = np.argsort(keys, kind="stable")
    k, t = keys[order], texts[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return order, starts, np.minimum.reduceat(t, starts) != np.maximum.reduceat(t, starts)


def shared_anchors(texts: DataFrame, n_bytes: int, length: int = LENGTH) -> DataFrame:
    """``th`` and ``places`` (binary, int64): where a text has an anchor that another text has too.

    Of an anchor that recurs in a text, one place is given.  Rows without ``th``
    have in ``heavy`` the hashes (binary, uint64) of heavy anchors.
    """
    n_buckets = parts_for(n_bytes // 14, ANCHORS_A_BUCKET, 8)
    heavy_from = max(HEAVY_LEAST, int(HEAVY_SHARE * n_bytes / 14))

    def send(keys: np.ndarray, owner: np.ndarray, places: np.ndarray, names: list[bytes]) -> Iterator[pa.RecordBatch]:
        order, starts, several = _runs_of(keys, owner)  # in a run by text, as they came
        keys, owner, places = keys[order], owner[order], places[order]
        del order
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        new_text = np.concatenate([[True], (owner[1:] != owner[:-1]) | (run[1:] != run[:-1])])
        known = np.flatnonzero(new_text & several[run])
        yield from _batches(((part_of(names[t], n_buckets), names[t], None, None, None, p.astype("<i8").tobytes()) for t, (p,) in _by_text(owner[known], places[known])), _ANCHOR_ROWS)
        # Of a key that several texts here have, two suffice to tell the others.
        ordinal = np.cumsum(new_text) - 1
        ordinal -= ordinal[starts][run]
        out = np.flatnonzero(new_text & (ordinal < 2))
        bucket = (keys[out] % U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out, bucket = out[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
        del order, run, new_text, ordinal, starts, several, bucket

        def blobs() -> Iterator[tuple]:
            for b in range(n_buckets):
                i = out[edges[b] : edges[b + 1]]
                if len(i):
                    table, at = np.unique(owner[i], return_inverse=True)
                    yield b, None, _planes((keys[i] // U(n_buckets)).astype("<u8"), KEY_BYTES), b"".join(names[t] for t in table), _planes(at.astype("<u4")), _planes(places[i].astype("<i8"))

        yield from _batches(blobs(), _ANCHOR_ROWS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        names: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal names, size
            keys, owner, places = (np.concatenate(x) for x in held)
            of, names, size = names, [], 0
            for x in held:
                x.clear()
            yield from send(keys, owner, places, of)

        for b in batches:
            for some in _together(_rows(b, 0, 1), 1, min(4 * BLOCK, 14 * ANCHORS_A_FLUSH)):
                for _, who, at, _, keys, _, _ in anchors_of([t.encode() for _, t in some], length):
                    held[0].append(keys)
                    held[1].append((who + len(names)).astype(np.int32))
                    held[2].append(at)
                    size += len(at)
                names += [th for th, _ in some]
                if size >= ANCHORS_A_FLUSH:
                    yield from flush()
        if size:
            yield from flush()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            known = [(r["th"], r["places"]) for r in rows if r["th"] is not None]
            blobs = [r for r in rows if r["th"] is None]
            if blobs:
                keys = np.concatenate([_from_planes(r["keys"], "<u8", KEY_BYTES) for r in blobs])
                tables = [names_of(r["table"]) for r in blobs]
                names, number = numbered([x for t in tables for x in t])
                firsts = np.cumsum([0, *map(len, tables)])
                owner = number[np.concatenate([_from_planes(r["texts"], "<u4").astype(np.int64) + k for r, k in zip(blobs, firsts, strict=False)])]
                places = np.concatenate([_from_planes(r["places"], "<i8") for r in blobs])
                order, starts, several = _runs_of(keys, owner)
                sizes = np.diff(np.append(starts, len(keys)))
                i = order[np.repeat(several, sizes)]
                known += [(names[t], p.astype("<i8").tobytes()) for t, (p,) in _by_text(owner[i], places[i])]
                # Of a hash its lowest bytes and its bucket are known here.
                heavy = keys[order][starts[sizes >= heavy_from]] * U(n_buckets) + U(bucket)
                if len(heavy):
                    yield _batch([(0, None, None, None, (heavy & LOW).astype("<u8").tobytes())], _PART_ROWS)
            if known:
                yield _batch(_parted(known, n_buckets), _PART_ROWS)

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches):
            told = [(None, None, r["heavy"]) for r in rows if r["heavy"] is not None]
            rows = [r for r in rows if r["heavy"] is None]
            if rows:
                names, number = numbered([x for r in rows for x in names_of(r["ths"])])
                sizes = np.concatenate([_from_planes(r["sizes"], "<u4") for r in rows]).astype(np.int64)
                places = np.concatenate([_from_planes(r["places"], "<i8") for r in rows])
                told += [(names[t], p.astype("<i8").tobytes(), None) for t, (p,) in _by_text(np.repeat(number, sizes), places)]
            for k in range(0, len(told), 5000):
                yield _batch(told[k : k + 5000], _PLACE_ROWS)

    sent = texts.select("th", "text").mapInArrow(gather, "bucket int, th binary, keys binary, table binary, texts binary, places binary")
    found = sent.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(find, "bucket int, ths binary, sizes binary, places binary, heavy binary")
    # A text's places come from many buckets; they go to the text's part in blobs, and leave it as one row a text.
    return found.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(regroup, "th binary, places binary, heavy binary")


def _parted(known: list[tuple[bytes, bytes]], n_parts: int) -> list[tuple]:
    """Texts and their places, as one row for each part that their texts belong to."""
    by_part: dict[int, list[tuple[bytes, bytes]]] = {}
    for x in known:
        by_part.setdefault(part_of(x[0], n_parts), []).append(x)
    return [(k, b"".join(t for t, _ in of), _planes(np.array([len(p) // 8 for _, p in of], "<u4")), _planes(np.frombuffer(b"".join(p for _, p in of), "<i8")), None) for k, of in sorted(by_part.items())]


# Suffixes: contexts of anchors, with the strings that belong to them.


class Suffixes:
    """Suffixes at anchors: columns of equal length.

    ``right``: bytes from the anchor on, zeros behind the last that counts;
    ``left``: bytes before it, nearest first; bit a of ``mask``: the string that
    starts a bytes before the anchor; ``th``: the text's number in a list of
    names; ``anchor``: the anchor's hash, known where the suffix is cut.
    """

    KINDS = {"ids": "<i8", "th": "<u4", "places": "<i8", "mask": "<u4"}
    COLUMNS = ("right", "left", "ids", "th", "places", "mask", "anchor")

    def __init__(self, *columns: np.ndarray) -> None:
        self.right, self.left, self.ids, self.th, self.places, self.mask, self.anchor = columns

    def __len__(self) -> int:
        return len(self.mask)

    def take(self, i: np.ndarray) -> Suffixes:
        return Suffixes(*(getattr(self, k)[i] for k in self.COLUMNS))

    def trim(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Blank what no string of the mask covers; returns how many bytes count on the right and left."""
        lowest, highest = (np.frexp(x.astype(np.float64))[1].astype(np.int64) - 1 for x in (self.mask & (~self.mask + np.uint32(1)), self.mask))
        rights = length - lowest
        self.right = self.right * (np.arange(length, dtype=np.uint8) < rights.astype(np.uint8)[:, None])
        return rights, highest

    @staticmethod
    def join(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, k) for p in parts]) for k in Suffixes.COLUMNS))


def suffixes_of(texts: list[tuple[int, int, bytes, np.ndarray]], length: int = LENGTH) -> list[Suffixes]:
    """The suffixes of texts (number, id, bytes, places ``shared``) at anchors whose hashes are those that the text has at those places."""
    place_of = lambda who, at: (who << 40) | at
    shared = np.unique(np.concatenate([place_of(k, at) for k, (*_, at) in enumerate(texts)]))
    found = list(anchors_of([t for _, _, t, _ in texts], length))
    names = [keys ^ mix(who.astype(U)) for _, who, _, _, keys, _, _ in found]  # a text's hashes; names that are equal by chance only send more
    told = np.unique(np.concatenate([n[_among(place_of(who, place), shared)] for n, (_, who, place, *_) in zip(names, found, strict=True)] or [np.zeros(0, U)]))
    numbers, ids = (np.array([t[k] for t in texts], np.int64) for k in (0, 1))
    parts, back = [], length - ANCHOR
    for n, (data, who, place, at, keys, first, last) in zip(names, found, strict=True):
        i = np.flatnonzero(_among(n, told))
        if not len(i):
            continue
        who, place, at, keys, first, last = (x[i] for x in (who, place, at, keys, first, last))
        padded = np.concatenate([np.zeros(back, np.uint8), data, np.zeros(length, np.uint8)])
        # Bytes of other texts are among these, but no string of the mask has them.
        right = sliding_window_view(padded, length)[at + back]
        left = np.ascontiguousarray(sliding_window_view(padded, back)[at][:, ::-1])
        low, high = (at - last).astype(np.uint64), (at - first).astype(np.uint64)
        mask = ((U(1) << (high + U(1))) - (U(1) << low)).astype(np.uint32)
        parts.append(Suffixes(right, left, ids[who], numbers[who], place, mask, keys))
    return parts


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among ``some``, which are in order."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def sort_suffixes(s: Suffixes) -> tuple[Suffixes, np.ndarray]:
    """In order of the bytes from the anchor on, with the prefix length that each shares with the one before."""
    length = s.right.shape[1]
    s = s.take(np.argsort(np.ascontiguousarray(s.right).view(f"S{length}").ravel(), kind="stable"))
    return s, common_prefixes(s.right)


def common_prefixes(right: np.ndarray) -> np.ndarray:
    if not len(right):
        return np.zeros(0, np.int64)
    differ = right[1:] != right[:-1]
    at = differ.argmax(axis=1)
    at[(at == 0) & ~differ[:, 0]] = right.shape[1]
    return np.concatenate([[0], at])


def settle(s: Suffixes, prefixes: np.ndarray) -> np.ndarray:
    """Which strings of sorted suffixes also start in one of a smaller id; bits as in the mask.

    Strings at a bytes before their anchors are equal if the suffixes share
    length - a bytes and the a bytes before are equal.
    """
    length, back = s.right.shape[1], s.left.shape[1]
    repeated = np.zeros(len(s), np.uint32)
    before = np.zeros(len(s), U)
    nearest = np.maximum(prefixes, np.append(prefixes[1:], 0))[: len(s)]  # prefix shared with a neighbour
    for a in range(back + 1):
        i = np.flatnonzero(((s.mask >> np.uint32(a)) & np.uint32(1)).astype(bool) & (nearest >= length - a))
        if len(i) > 1:
            group = np.cumsum(prefixes < length - a).astype(U)[i]
            name = mix(group * U(0x9E3779B97F4A7C15) + mix(before[i] + U(a)))
            order = np.argsort(name)
            name = name[order]
            same = name[1:] == name[:-1]
            k = np.flatnonzero(same)
            if _differ(group[order], s.left[i[order], :a], k):  # two strings have one name
                order = np.lexsort((*s.left[i, :a].T, group))
                same = (group[order][1:] == group[order][:-1]) & (s.left[i[order[1:]], :a] == s.left[i[order[:-1]], :a]).all(axis=1)
            i = i[order]
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            ids = s.ids[i]
            least = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(ids))))
            repeated[i[ids > least]] |= np.uint32(1 << a)
        if a < back:
            before = before * U(0xD6E8FEB86659FD93) + _BYTE[s.left[:, a]]
    return repeated


def _differ(group: np.ndarray, left: np.ndarray, k: np.ndarray) -> bool:
    """Whether one of the k-th differs from the next."""
    return bool((group[k] != group[k + 1]).any() or (left[k] != left[k + 1]).any())


def front_code(s: Suffixes, prefixes: np.ndarray, rights: np.ndarray, lefts: np.ndarray) -> dict[str, bytes]:
    """A sorted run: of each suffix only what follows the prefix it shares with the one before."""
    length, back = s.right.shape[1], s.left.shape[1]
    prefixes = np.minimum(prefixes, rights)
    column = np.arange(length)
    rest = s.right[(column >= prefixes[:, None]) & (column < rights[:, None])]
    left = s.left[np.arange(back) < lefts[:, None]]
    return {
        "shared": prefixes.astype(np.uint8).tobytes(), "ends": rights.astype(np.uint8).tobytes(), "rest": rest.tobytes(),
        "backs": lefts.astype(np.uint8).tobytes(), "left": left.tobytes(),
        **{k: _planes(getattr(s, k).astype(kind)) for k, kind in Suffixes.KINDS.items()},
    }


def decode(run: dict[str, bytes], length: int = LENGTH) -> tuple[Suffixes, np.ndarray]:
    """The suffixes of a front-coded run and their shared prefixes."""
    shared, ends, backs = (np.frombuffer(run[k], np.uint8).astype(np.int64) for k in ("shared", "ends", "backs"))
    column, back = np.arange(length), length - ANCHOR
    own = (column >= shared[:, None]) & (column < ends[:, None])
    right = np.zeros((len(shared), length), np.uint8)
    right[own] = np.frombuffer(run["rest"], np.uint8)
    # Before its own bytes a suffix has those of the last one that had its own there.
    from_row = np.maximum.accumulate(np.where(column >= shared[:, None], np.arange(len(shared), dtype=np.int32)[:, None], np.int32(0)), axis=0)
    right = right[from_row, column]
    left = np.zeros((len(shared), back), np.uint8)
    left[np.arange(back) < backs[:, None]] = np.frombuffer(run["left"], np.uint8)
    columns = {k: _from_planes(run[k], kind) for k, kind in Suffixes.KINDS.items()}
    # Behind its last byte a suffix is zeros, so that prefixes may be longer than what was coded.
    return Suffixes(right, left, columns["ids"], columns["th"].astype(np.int64), columns["places"], columns["mask"], np.zeros(len(shared), U)), common_prefixes(right)


class LoserTree:
    """Merges sorted runs of strings; an entry's known prefix with the last winner is never compared again."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]) -> None:
        self.runs = runs
        n = 1
        while n < len(runs):
            n *= 2
        self.n = n
        self.next = [0] * n
        self.string: list[bytes | None] = [None] * n
        self.known = [-1] * n  # prefix shared with the last winner; -1 when a run has ended
        for r, (strings, _) in enumerate(runs):
            if strings:
                self.string[r], self.known[r], self.next[r] = strings[0], 0, 1
        self.loser = [0] * n
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        x, y = self._play(2 * node), self._play(2 * node + 1)
        w, l = self._match(x, y)
        self.loser[node] = l
        return w

    def _match(self, x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        kx, ky = self.known[x], self.known[y]
        if kx > ky:
            return x, y
        if ky > kx:
            return y, x
        if kx < 0:
            return x, y
        a, b = self.string[x], self.string[y]
        k, end = kx, len(a)
        while k < end and a[k] == b[k]:
            k += 1
        if k == end or a[k] < b[k]:
            self.known[y] = k
            return x, y
        self.known[x] = k
        return y, x

    def merge(self) -> tuple[list[int], list[int], list[int]]:
        """Run and place of every string in order, and the prefix it shares with the one before."""
        run, place, prefix = [], [], []
        w = self.winner
        known, string, nxt, runs, loser, n = self.known, self.string, self.next, self.runs, self.loser, self.n
        match = self._match
        while known[w] >= 0:
            run.append(w)
            place.append(nxt[w] - 1)
            prefix.append(known[w])
            strings, shared = runs[w]
            i = nxt[w]
            if i < len(strings):
                string[w], known[w], nxt[w] = strings[i], shared[i], i + 1
            else:
                string[w], known[w] = None, -1
            node = (w + n) >> 1
            while node:
                rival = loser[node]
                kw, kr = known[w], known[rival]
                if kr > kw:
                    loser[node], w = w, rival
                elif kr == kw and kw >= 0:
                    w, loser[node] = match(w, rival)
                node >>= 1
        return run, place, prefix


_RUN_COLUMNS = ("shared", "ends", "rest", "backs", "left", "ids", "places", "mask")
_RUN_ROWS = pa.schema([("bucket", pa.int32()), ("th", pa.binary()), *[(k, pa.binary()) for k in _RUN_COLUMNS], ("ths", pa.binary()), ("names", pa.binary())])
_MASK_PARTS = pa.schema([("bucket", pa.int32()), ("ths", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("mask", pa.binary())])
_MASK_ROWS = pa.schema([("th", pa.binary()), ("places", pa.binary()), ("mask", pa.binary())])


def _masks(s: Suffixes, repeated: np.ndarray, names: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
    i = np.flatnonzero(repeated)
    return [(names[t], p.astype("<i8").tobytes(), m.astype("<u4").tobytes()) for t, (p, m) in _by_text(s.th[i], s.places[i], repeated[i])]


def _parted_masks(found: list[tuple[bytes, bytes, bytes]], n_parts: int) -> list[tuple]:
    """Texts and their masks, as one row for each part that their texts belong to."""
    by_part: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
    for x in found:
        by_part.setdefault(part_of(x[0], n_parts), []).append(x)
    return [(k, b"".join(t for t, _, _ in of), _planes(np.array([len(p) // 8 for _, p, _ in of], "<u4")), _planes(np.frombuffer(b"".join(p for _, p, _ in of), "<i8")), _planes(np.frombuffer(b"".join(m for _, _, m in of), "<u4"))) for k, of in sorted(by_part.items())]


def merge_runs(runs: list[tuple[Suffixes, np.ndarray]]) -> tuple[Suffixes, np.ndarray]:
    """One sorted run of several."""
    length = runs[0][0].right.shape[1]

    def strings(s: Suffixes) -> list[bytes]:
        flat = s.right.tobytes()
        return [flat[i : i + length] for i in range(0, len(flat), length)]

    run, place, prefix = LoserTree([(strings(s), p.tolist()) for s, p in runs]).merge()
    firsts = np.cumsum([0, *[len(s) for s, _ in runs]])
    order = firsts[np.array(run, np.int64)] + np.array(place, np.int64)
    del run, place
    return Suffixes(*(np.concatenate([getattr(s, k) for s, _ in runs])[order] for k in Suffixes.COLUMNS)), np.array(prefix, np.int64)


def repeated_strings(texts: DataFrame, shared: DataFrame, n_suffixes: int, length: int = LENGTH) -> DataFrame:
    """``th``, ``places``, ``mask`` (binaries), one row a text: its strings that start in a document of a smaller id.

    ``texts``: ``th``, ``id``, ``text``, one row a text.
    """
    n_buckets = parts_for(n_suffixes, SUFFIXES_A_BUCKET, 8)
    spark = texts.sparkSession
    with step(spark):
        heavy = np.frombuffer(b"".join(sorted(r[0] for r in shared.filter("heavy is not null").select("heavy").collect())), "<u8")  # at most 1 / HEAVY_SHARE
    sent_heavy = spark.sparkContext.broadcast(heavy)

    def dealt(s: Suffixes) -> tuple[Suffixes, np.ndarray]:
        """Suffixes with their buckets; those of heavy anchors in groups of their strings."""
        plain = mix(s.anchor)
        is_heavy = np.isin(s.anchor & LOW, sent_heavy.value) if len(sent_heavy.value) else np.zeros(len(s), bool)
        parts, keys = [s.take(np.flatnonzero(~is_heavy))], [plain[~is_heavy]]
        for low, high in GROUPS if is_heavy.any() else ():
            part = s.take(np.flatnonzero(is_heavy & ((s.mask & np.uint32(_bits(low, high))) != 0)))
            part.mask = part.mask & np.uint32(_bits(low, high))
            key = mix(part.anchor + U(low + 1))
            for column in (*part.left[:, :low].T, *part.right[:, ANCHOR : length - high].T):
                key = key * U(0x9E3779B97F4A7C15) + _BYTE[column]
            parts.append(part)
            keys.append(mix(key))
        return Suffixes.join(parts), (np.concatenate(keys) % U(n_buckets)).astype(np.int64)

    def send(s: Suffixes, names: list[bytes]) -> Iterator[pa.RecordBatch]:
        s, prefixes = sort_suffixes(s)
        repeated = settle(s, prefixes)
        yield from _batches(((part_of(t, n_buckets), t, *[None] * 6, p, m, None, None) for t, p, m in _masks(s, repeated, names)), _RUN_ROWS)
        s.mask = s.mask & ~repeated
        s = s.take(np.flatnonzero(s.mask))
        if len(s):
            yield from _batches(coded(s, names), _RUN_ROWS)

    def coded(s: Suffixes, names: list[bytes]) -> Iterator[tuple]:
        s, bucket = dealt(s)
        rights, lefts = s.trim(length)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]]))
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            i = order[first:end]
            part = s.take(i)
            # Blanking leaves the order as it was or makes it right again.
            ranked = np.argsort(np.ascontiguousarray(part.right).view(f"S{length}").ravel(), kind="stable")
            part = part.take(ranked)
            table, part.th = np.unique(part.th, return_inverse=True)
            run = front_code(part, common_prefixes(part.right), rights[i][ranked], lefts[i][ranked])
            yield int(bucket[i[0]]), None, *[run[k] for k in _RUN_COLUMNS], run["th"], b"".join(names[t] for t in table)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Suffixes] = []
        names: list[bytes] = []
        size = 0
        for b in batches:
            for some in _together(_rows(b, 0, 1, 2, 3), 2, min(4 * BLOCK, 14 * SUFFIXES_A_FLUSH)):
                found = suffixes_of([(len(names) + k, doc_id, text.encode(), np.frombuffer(b"".join(places), "<i8")) for k, (_, doc_id, text, places) in enumerate(some)], length)
                names += [th for th, *_ in some]
                held += found
                size += sum(map(len, found))
                if size >= SUFFIXES_A_FLUSH:
                    yield from send(Suffixes.join(held), names)
                    held, names, size = [], [], 0
        if held:
            yield from send(Suffixes.join(held), names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches):
            found = [(r["th"], r["places"], r["mask"]) for r in rows if r["th"] is not None]
            runs, names = [], []
            for r in rows:
                if r["th"] is None:
                    s, prefixes = decode({**{k: r[k] for k in _RUN_COLUMNS}, "th": r["ths"]}, length)
                    s.th += len(names)
                    names += names_of(r["names"])
                    runs.append((s, prefixes))
            if runs:
                # A text's name comes with each of its runs.
                names, number = numbered(names)
                s, prefixes = merge_runs(runs)
                s.th = number[s.th]
                found += _masks(s, settle(s, prefixes), names)
            if found:
                yield _batch(_parted_masks(found, n_buckets), _MASK_PARTS)

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches):
            names, number = numbered([x for r in rows for x in names_of(r["ths"])])
            sizes, places, mask = (np.concatenate([_from_planes(r[k], kind) for r in rows]) for k, kind in (("sizes", "<u4"), ("places", "<i8"), ("mask", "<u4")))
            told = [(names[t], p.astype("<i8").tobytes(), m.astype("<u4").tobytes()) for t, (p, m) in _by_text(np.repeat(number, sizes.astype(np.int64)), places, mask)]
            for k in range(0, len(told), 5000):
                yield _batch(told[k : k + 5000], _MASK_ROWS)

    told = shared.filter("th is not null").groupBy("th").agg(F.collect_list("places").alias("places"))  # at most a text's anchors
    kinds = "bucket int, th binary, " + ", ".join(f"{k} binary" for k in _RUN_COLUMNS) + ", ths binary, names binary"
    sent = texts.join(told, "th").select("th", "id", "text", "places").mapInArrow(cut_up, kinds)
    merged = sent.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, ths binary, sizes binary, places binary, mask binary")
    # A text's masks come from many buckets, the more the larger the table; they go to its part in blobs, and leave it as one row a text.
    return merged.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(regroup, "th binary, places binary, mask binary")


def _bits(low: int, high: int) -> int:
    return (1 << (high + 1)) - (1 << low)


def covered(n: int, found: list[tuple[bytes, bytes]], length: int = LENGTH) -> np.ndarray:
    """Which of n bytes the strings cover."""
    starts = []
    for p, m in found:
        places, mask = np.frombuffer(p, "<i8"), np.frombuffer(m, "<u4")
        bit = np.unpackbits(mask.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        row, a = np.nonzero(bit)
        starts.append(places[row] - a)
    if not starts:
        return np.zeros(n, bool)
    s = np.concatenate(starts)
    edges = np.bincount(s, minlength=n + 1) - np.bincount(s + length, minlength=n + 1)
    return np.cumsum(edges[:-1]) > 0


def _judged(docs: DataFrame, length: int) -> DataFrame:
    """``row`` (the columns of ``docs`` but the text), ``body`` and ``missing`` (the text, and whether it is null), ``least`` (whether the row has its text's least id) and ``found``."""
    last = F.lit((1 << 63) - 1)
    row = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    rows = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("body"), F.col("text").isNull().alias("missing"), F.coalesce("doc_id", last).alias("own_id")).withColumn("th", F.unhex(F.substring(F.sha2("body", 256), 1, 2 * NAME)))
    heads = cut(rows.select("th", "own_id", F.octet_length("body").cast("long").alias("bytes")).groupBy("th").agg(F.min("own_id").alias("id"), F.max("bytes").alias("bytes")))
    with step(docs.sparkSession):
        n_bytes = heads.agg(F.sum("bytes")).first()[0] or 0
    long = rows.filter(F.octet_length("body") >= length).select("th", "own_id", F.col("body").alias("text"))
    shared = cut(shared_anchors(long, n_bytes, length))
    with step(docs.sparkSession):
        n_suffixes = shared.agg(F.sum(F.octet_length("places").cast("long")) / 8).first()[0] or 0
    texts = long.join(heads.filter(F.col("bytes") >= length), "th").filter("own_id = id").select("th", "id", "text")
    found = cut(repeated_strings(texts, shared, int(n_suffixes), length))
    side = heads.select("th", "id").join(found.groupBy("th").agg(F.collect_list(F.struct("places", "mask")).alias("found")), "th", "left")
    return rows.join(side, "th").select("row", "body", "missing", (F.col("own_id") == F.col("id")).alias("least"), "found")


def _kept(text: str, least: bool, found: list[dict] | None, length: int) -> tuple[bytes, np.ndarray]:
    data = text.encode()
    if len(data) < length:
        return data, np.zeros(len(data), bool)
    if not least:
        return data, np.ones(len(data), bool)
    return data, covered(len(data), [(x["places"], x["mask"]) for x in ([] if found is None else found)], length)


def measure_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, least, found in _rows(b, 1, 2, 3):
                data, gone = _kept(text, least, found, length)
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
                n = int(np.count_nonzero(gone))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if n else data
                rows.append((len(data), n, spans, sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    judged = _judged(docs.select("doc_id", "text"), length).select("row.doc_id", "body", "least", "found")
    return judged.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; a character that is cut in part goes whole.

    A null text stays null.  ``n_chars``, where there is one, is counted anew.
    """

    @F.pandas_udf("string")
    def cut_out(text, least, found):  # noqa: ANN001, ANN202
        out = []
        for t, l, f in zip(text, least, found, strict=True):
            data, gone = _kept(t, l, f, length)
            out.append(np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else t)
        return type(text)(out, dtype=object)

    new = F.when(~F.col("missing"), cut_out("body", "least", "found"))
    out = _judged(docs, length).select("row", new.alias("new"))
    kept = lambda c: F.col("row").getField(c)
    made = {"text": F.col("new"), "n_chars": F.length("new")}
    return out.select(*[(made[c].cast(docs.schema[c].dataType) if c in made else kept(c)).alias(c) for c in docs.columns])
