"""Hashed word shingles of many texts at once, in numpy.

A word is a run of letters, digits and bytes beyond ASCII, in lower case.  A
text's shingles are its runs of ``width`` words; a text with fewer words, but
any, has one shingle of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
#: Bytes of text hashed at a time.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95) + U(seed * 2 + 1)))


_BYTE = numbers(256, 11)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    n = 1 << bits
    up, down = np.full(n, _BASE, U), np.full(n, pow(_BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def word_hashes(data: np.ndarray, is_word: np.ndarray = _IS_WORD, values: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of a buffer; words are runs of bytes that ``is_word`` has, and ``values`` are the bytes' own hashes."""
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):  # end between words
            back = np.flatnonzero(~is_word[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                more = np.flatnonzero(~is_word[data[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(data)
        part = data[at:end]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = is_word[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edges[0::2], edges[1::2]
        up, down = _powers(max(20, int(len(part) - 1).bit_length() if len(part) > 1 else 1))
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        if len(s):
            hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U)))
            starts.append(s + at)
            ends.append(e + at)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


_PLACE = numbers(64, 12) | U(1)


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the number of the text of each, in order of texts; repeated ones are repeated."""
    bodies = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(bodies), np.uint8)
    ends = np.cumsum([len(b) + 1 for b in bodies])
    words, starts, _ = word_hashes(data)
    of = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(of, minlength=len(texts))
    n = len(words) - width + 1
    if n > 0:
        hashes = np.zeros(n, U)
        for k in range(width):
            hashes += words[k : k + n] * _PLACE[k]
        whole = of[:n] == of[width - 1 :]
        hashes, owner = mix(hashes[whole]), of[:n][whole]
    else:
        hashes, owner = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(n_words)])
        extra = [mix(np.array([(words[first[i] : first[i + 1]] * _PLACE[: n_words[i]]).sum(dtype=U) + U(n_words[i])], U))[0] for i in short]
        hashes, owner = np.concatenate([hashes, np.array(extra, U)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def bags(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (48 bits) of each text: hash, number of the text, occurrences.  At most 65536 texts."""
    hashes, owner = shingles(texts, width)
    keyed = np.sort((owner.astype(U) << U(48)) | (hashes >> U(16)))
    if not len(keyed):
        return keyed, owner, owner
    new = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]]))
    counts = np.diff(np.append(new, len(keyed)))
    keyed = keyed[new]
    return keyed & U((1 << 48) - 1), (keyed >> U(48)).astype(np.int64), counts


def groups_of(texts: list[str], most_chars: int = 1 << 20, most_texts: int = 1 << 14) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, about ``most_chars`` characters together, with the number of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > most_chars or i - first >= most_texts):
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def slices_of(column, rows: int = 400) -> Iterator[tuple[int, list]]:  # noqa: ANN001
    """An Arrow column as lists of some rows at a time, with the number of the first; nulls are empty texts."""
    for k in range(0, len(column), rows):
        yield k, [x if x is not None else "" for x in column.slice(k, rows).to_pylist()]
