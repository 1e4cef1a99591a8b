"""Word shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Cells of a sketch, and of a parity; multiples of 64.
CELLS = 128
#: Characters of the texts that are cut into shingles together, unless a single text is longer.
RUN = 1 << 17
PARITY = 256


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(32)


def _powers(base: np.uint64, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """Powers 0 to ``n`` of the base; those that a run of usual texts needs are kept."""
    if n <= RUN * 2:
        if int(base) not in kept:
            kept[int(base)] = _powers(base, RUN * 2 + 1)[: RUN * 2 + 1].copy()
        return kept[int(base)][: n + 1]
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    return np.multiply.accumulate(power)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text.

    Words are divided by ASCII white space and lower-cased in A-Z.
    """
    raw = [(t or "").encode().translate(_LOWER) for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[joined], prepend=True))  # words begin and end by turns; the last byte is a space
    begins, ends = edges[::2], edges[1::2]
    n = len(joined)
    power, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.take(_BYTES, joined, out=total[1:])
    np.multiply(total[1:], power[:-1], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    hashes = finish((total[ends] - total[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
    stops = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(begins, stops), prepend=0)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; by sorting, which is many times faster here than hashing."""
    ordered = np.sort(values)
    return ordered[np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]])]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; a shorter text is one shingle, a wordless one none.

    Texts of RUN characters are worked on at a time, for whose every byte there are some ten numbers.
    """
    return counted_sets(texts, width)[0]


def counted_sets(texts: list[str | None], width: int) -> tuple[list[np.ndarray], list[int]]:
    """:func:`shingle_sets` and each text's number of words."""
    out, numbers, start, total = [], [], 0, 0
    for i, t in enumerate([*texts, None]):
        size = len(t or "")
        if i == len(texts) or i > start and total + size > RUN:
            sets, counts = _sets(texts[start:i], width)
            out += sets
            numbers += counts
            start, total = i, 0
        total += size
    return out, numbers


def _sets(texts: list[str | None], width: int) -> tuple[list[np.ndarray], list[int]]:
    words, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        rolled = rolled * _BASE + words[i : i + len(rolled)]
    rolled = finish(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(distinct(rolled[at : at + n - width + 1]))
        elif n:
            value = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[at : at + n]:
                    value = value * _BASE + w
            out.append(finish(np.array([value], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out, counts.tolist()


def _counted(sets: list[np.ndarray], shift: int, cells: int) -> np.ndarray:
    """How many of each set's shingles lie in each cell, which their bits from ``shift`` on tell."""
    owner = np.repeat(np.arange(len(sets)) * cells, [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    cell = (values >> np.uint64(shift) & np.uint64(cells - 1)).astype(np.int64)
    return np.bincount(owner + cell, minlength=len(sets) * cells).reshape(len(sets), cells)


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Each set's shingles counted in CELLS cells by hash, as 16-bit counts; empty if they do not fit."""
    counts = _counted(sets, 0, CELLS)
    fit = (counts < 1 << 16).all(axis=1).tolist()
    return [c.tobytes() if f else b"" for c, f in zip(counts.astype(np.uint16), fit)]


def sketch(values: np.ndarray) -> bytes:
    return sketches([values])[0]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Whether each of PARITY cells holds an odd number of a set's shingles, as bits of 64-bit integers, a row a set."""
    odd = (_counted(sets, 32, PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, axis=1).view(np.int64).reshape(len(sets), PARITY // 64)
