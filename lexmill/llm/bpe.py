"""Byte-level BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the merges
that its neighbours allow, lowest rank first and leftmost first among equals.
When the pair that an entry stands for has changed since, the entry is stale and
is skipped.  Decoding concatenates vocabulary strings.

Nulls encode as the empty text.  Texts of any length are encoded whole.  Equal
texts get equal ids.  An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The pre-tokenizer pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Strings whose ids a memo keeps, in two generations: those found in the older move to the newer, which replaces it when full.
MEMO_STRINGS = 1_600_000
#: Longer words are encoded each time they occur.
MEMO_CHARS = 48
#: Bits of a symbol's place in a queue entry.
PLACE_BITS = 40
PLACE_MASK = (1 << PLACE_BITS) - 1


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


@lru_cache(maxsize=1)
def unknown_characters() -> str:
    """Characters that the pattern's engine takes for letters, digits or spaces and the tokenizers library, of an older Unicode, does not.

    Only those that are new since Python's own Unicode can be; each is tried.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    words = regex.compile(WORDS)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = (c for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.category(c) == "Cn")
    return "".join(c for c in new if [m.span() for m in words.finditer(f"a{c}1{c}! {c}")] != [at for _, at in split(f"a{c}1{c}! {c}")])


class Vocabulary:
    """Merge ranks and token strings of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {**ids, **self.special}
        self.of_byte = [ids[alphabet[b]] for b in range(256)]
        #: By left symbol and right symbol: the rank, shifted to make room for a place, and the symbol made.
        self.right_of: list[dict[int, tuple[int, int]]] = [{} for _ in range(max(ids.values()) + 1)]
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.right_of[ids[left]][ids[right]] = (rank << PLACE_BITS, ids[left + right])
        self.strings = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.strings[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        unknown = unknown_characters()
        self.least_unknown = min(unknown, default="")
        self.unknown = regex.compile(f"[{unknown}]") if unknown else None
        # The same pattern with these characters as neither letters nor digits nor spaces.
        known = {kind: f"[{kind}--[{unknown}]]" for kind in (r"\p{L}", r"\p{N}", r"\s")}
        self.known_words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{known[r'\p{L}']}+| ?{known[r'\p{N}']}+| ?(?:[{unknown}]|[^\s\p{{L}}\p{{N}}])+|{known[r'\s']}+(?!\S)|{known[r'\s']}+", regex.V1) if unknown else self.words
        self.wide = re.compile(r" (?:\s|\Z)")
        self.memo = _Memo(self.word_ids)
        self.spaced = _Memo(self.chunk)

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word.

        A queue entry is one integer: the merge's rank, then the left symbol's
        place.  It is stale if the pair that is there now has another rank.
        """
        ids = [*map(self.of_byte.__getitem__, word)]
        n = len(ids)
        if n < 2:
            return ids
        right_of = self.right_of
        queue = [found[0] | i for i, (x, y) in enumerate(zip(ids, ids[1:])) if (found := right_of[x].get(y))]
        heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            i = entry & PLACE_MASK
            j = after[i]
            if j >= n or (found := right_of[ids[i]].get(ids[j])) is None or found[0] != entry - i:
                continue  # stale
            ids[i] = made = found[1]
            ids[j] = -1
            after[i] = k = after[j]
            after[j] = n  # entries that name the symbol merged away are stale
            if k < n:
                before[k] = i
                if found := right_of[made].get(ids[k]):
                    heappush(queue, found[0] | i)
            if (h := before[i]) >= 0 and (found := right_of[ids[h]].get(made)):
                heappush(queue, found[0] | h)
        return [x for x in ids if x >= 0]

    def word_ids(self, word: str) -> bytes:
        return array("I", self.merge(word.encode())).tobytes()

    def chunk(self, text: str) -> bytes:
        """Ids of a space and what follows it up to the next one."""
        if text.isalpha():  # the letters of the pattern
            return self.word_ids(" " + text)
        if text[:-1].isalpha() and text[-1] in ".,;:!?":
            return self.spaced[text[:-1]] + self.memo[text[-1]]
        return b"".join(map(self.memo.__getitem__, self.words.findall(" " + text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        A space before a character that is no white space always begins a new
        word, so where all spaces are such the text is cut there first, and what
        lies between is looked up as a whole.
        """
        find, word = self.words.findall, self.memo.__getitem__
        odd = self.unknown is not None and not text.isascii() and max(text) >= self.least_unknown and self.unknown.search(text)
        if odd:
            find = self.known_words.findall
        if self.split_special is not None and any(s in text for s in self.special):
            out = []
            for piece in self.split_special.split(text):
                if piece in self.special:
                    out.append(self.special[piece].to_bytes(4, "little"))
                else:
                    out.extend(map(word, find(piece)))
            return b"".join(out)
        if odd or self.wide.search(text):
            return b"".join(map(word, find(text)))
        first, *rest = text.split(" ")
        return b"".join(map(word, find(first))) + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        """The text, in UTF-8, of ids in the form that encode() gives."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    """Ids of strings seen before, in two generations."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, string: str) -> bytes:
        ids = self.old.get(string)
        if ids is None:
            ids = self.make(string)
        if len(string) <= MEMO_CHARS:
            if len(self) >= MEMO_STRINGS // 2:
                self.old = dict(self)
                self.clear()
            self[string] = ids
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """A worker reads each vocabulary file once."""
    return Vocabulary(path)


#: Longer runs without a space, or of white space, are left to the priority queue.
PLAIN_RUN = 400


@lru_cache(maxsize=2)
def fast_encoder(path: str) -> Callable[[str], bytes]:
    """What Vocabulary.encode() does, by a compiled encoder that keeps no memo.

    It merges by the rank of what a merge makes, which is the same where each
    merge makes a string of its own, as is checked here.  It walks long runs
    without word bounds slowly, so texts with such are left to the vocabulary.
    """
    import tiktoken

    v = vocabulary(path)
    made = sorted((found[0], i) for pairs in v.right_of for found in pairs.values() for i in [found[1]])
    ranked = [*v.of_byte, *(i for _, i in made)]
    if len(set(ranked)) != len(ranked):
        return v.encode
    encoding = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={v.strings[i]: k for k, i in enumerate(ranked)}, special_tokens={s: len(ranked) + k for k, s in enumerate(v.special)})
    ids = np.array([*ranked, *v.special.values()], "<u4")
    long_run = re.compile(rf"\S{{{PLAIN_RUN}}}|\s{{{PLAIN_RUN}}}")

    def encode(text: str) -> bytes:
        return v.encode(text) if long_run.search(text) else ids[encoding.encode_to_numpy(text, allowed_special="all")].tobytes()

    return encode


def encode_column(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids``: the ids of each text as little-endian unsigned 32-bit integers in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.encode(t or "") for t in b.column(1).to_pylist()], pa.binary())], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode_column(ids: DataFrame, path: str, column: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text``; bytes that are not UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.decode(x or b"").decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    kind = ids.schema[key].dataType.simpleString()
    return ids.select(key, column).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text, decode its ids again and return digests of both.

    One row per input row, repeated rows included; map-only, so no group of
    rows meets in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            n, h, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = v.encode(t or "")
                n.append(len(ids) // 4)
                h.append(sha256(ids).hexdigest())
                d.append(sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
