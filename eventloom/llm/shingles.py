"""Hashes of words and of word sequences, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed together.
TOGETHER = 1 << 21

_AS_IS = np.arange(256, dtype=np.uint64)
_LOWER = _AS_IS.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words between white space, and of words that ASCII punctuation parts too.
BETWEEN_SPACE = np.ones(256, bool)
BETWEEN_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``size``."""
    if len(_powers[0]) < size:
        for k, base in enumerate((BASE, INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_words(data: np.ndarray, first: np.ndarray, letters: np.ndarray = _LOWER, word: np.ndarray = BETWEEN_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash the words of ``data``; return hashes and where each begins. No word goes across a position in ``first``."""
    in_word = word[data]
    starts = in_word.copy()
    starts[1:] &= ~in_word[:-1]
    cuts = first[(first > 0) & (first < len(data))]
    starts[cuts] = in_word[cuts]
    ends = in_word.copy()
    ends[:-1] &= ~in_word[1:]
    ends[cuts - 1] = in_word[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    powers, inverses = _power_tables(1 << len(data).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    # A byte counts one more than it is, so that no word is a longer one with zeros at its end.
    np.cumsum((letters[data] + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverses[start]), start


def groups(column: pa.Array, together: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield the index of the first of some texts, their bytes, and where each begins and the last ends.

    The texts have at most ``together`` bytes, ``TOGETHER`` if it is not given; a longer one comes alone.
    """
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    together = TOGETHER if together is None else together
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + together, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(
    column: pa.Array, lower: bool = True, word: np.ndarray = BETWEEN_SPACE, together: int | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hash the words of a column of texts without nulls, lower-cased (A-Z) or as they are.

    Yields, for some texts at a time, the index of the first text, the hashes
    of all their words in order, and how many words each text has. A long text
    is hashed in parts, cut at white space.
    """
    letters = _LOWER if lower else _AS_IS
    for i, part, offsets in groups(column, together):
        if len(part) <= TOGETHER:
            hashes, start = _hash_words(part, offsets[:-1], letters, word)
            counts = np.bincount(np.searchsorted(offsets, start, side="right") - 1, minlength=len(offsets) - 1)
            yield i, hashes, counts
        else:  # one long text
            found, at = [], 0
            while at < len(part):
                stop = min(len(part), at + TOGETHER)
                space = np.flatnonzero(~word[part[at:stop]])
                if stop < len(part):
                    if len(space):
                        stop = at + int(space[-1]) + 1
                    else:
                        later = np.flatnonzero(~word[part[stop:]])
                        stop = stop + int(later[0]) if len(later) else len(part)
                found.append(_hash_words(part[at:stop], np.zeros(0, np.int64), letters, word)[0])
                at = stop
            hashes = np.concatenate(found)
            yield i, hashes, np.array([len(hashes)])


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash every sequence of ``words`` words of each text; a shorter text has its whole sequence as one.

    Returns the hashes, with repetitions, in the order of the texts, and how many each text has.
    """
    many = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    at = np.arange(int(many.sum())) + np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many)
    size = np.repeat(np.minimum(counts, words), many)
    out = mix(size.astype(np.uint64))
    for k in range(words):
        there = size > k
        out[there] = mix(out[there] * np.uint64(0xD6E8FEB86659FD93) + hashes[at[there] + k])
    return out, many
