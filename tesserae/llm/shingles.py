"""Hashed word shingles of whole texts, by arrays over many texts at once."""

from __future__ import annotations

import numpy as np

# Odd multipliers of a 64-bit finaliser and of the five word places.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_POWER_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BLOCK, LONG = 1 << 14, 1 << 12
_forward, _back = _powers(1 << 16, _POWER_BASE), _powers(BLOCK + LONG, np.uint64(pow(int(_POWER_BASE), -1, 1 << 64)))
_LETTERS = np.where(BLANK, np.uint64(0), _BYTE[_LOWER])


def hashes_at(joined: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of these places, in ascending order, and sizes in an array of bytes, A-Z lower-cased; between words there is white space only.

    A word's hash is of a polynomial over scrambled bytes. Within a block, bytes are multiplied by powers that fall with the place, so a word is one sum, and a power of its end is made up for.
    """
    hashes = np.zeros(len(begin), np.uint64)
    blocks = np.arange(int(begin[0]) + BLOCK, int(begin[-1]) + 1, BLOCK) if len(begin) else []
    cuts = [0, *np.searchsorted(begin, blocks).tolist(), len(begin)]
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        if first < last:
            at = begin[first]
            own = begin[first:last] - at
            end = np.minimum(own + size[first:last], BLOCK + LONG)
            letters = _LETTERS.take(joined[at : at + end[-1]], mode="wrap")
            letters *= _back[: len(letters)]
            hashes[first:last] = np.add.reduceat(letters, own) * _forward.take(end - 1)
    for w in np.flatnonzero(size > LONG):
        own, value = _LETTERS[joined[begin[w] : begin[w] + size[w]]], np.zeros(1, np.uint64)  # arrays of one, whose products wrap silently
        for part in range(0, len(own), len(_forward)):
            piece = own[part : part + len(_forward)]
            value = value * (_forward[len(piece) - 1 : len(piece)] * _POWER_BASE) + (piece * _forward[len(piece) - 1 :: -1][: len(piece)]).sum(dtype=np.uint64)
        hashes[w] = value[0]
    return mix(hashes ^ (size.astype(np.uint64) * _STEP))


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes other than ASCII white space, A-Z lower-cased) and the words per text."""
    joined = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    if not raws or not len(joined):
        return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
    edge = np.diff((~BLANK.take(joined, mode="wrap")).view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = hashes_at(joined, begin, end - begin)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return hashes, np.diff(np.searchsorted(begin, bounds))


def shingle_sets(raws: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted within each, end to end; and their number per text.

    Texts with fewer words than ``width`` have their whole word sequence as one shingle; without words, none.
    """
    words, per_text = word_hashes(raws)
    ends = np.cumsum(per_text)
    count = np.where(per_text >= width, per_text - width + 1, (per_text > 0).astype(np.int64))
    text = np.repeat(np.arange(len(raws)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + (ends - per_text)[text]
    out, short = np.zeros(len(text), np.uint64), bool((count > per_text - width + 1).any())
    for k in range(width):
        told = mix(out * _STEP + words.take(at + k, mode="clip") + np.uint64(k + 1)) if len(at) else out
        out = np.where(k < per_text[text], told, out) if short else told
    last = np.cumsum(count)
    first = last - count
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        out[i:j].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[first[count > 0]] = True
    kept = np.append(0, np.cumsum(fresh))
    return out[fresh], kept[last] - kept[first]


def set_digests(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set, as signed integers."""
    out = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x632BE59BD9B4E019)):
        sums = segment_sums(mix(elements + salt), sizes)
        out.append(mix(sums + sizes.astype(np.uint64) * salt).view(np.int64))
    return out[0], out[1]


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of consecutive runs of these sizes; 0 for empty ones."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
