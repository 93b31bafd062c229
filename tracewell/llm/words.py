"""Words of many texts at once, as 64-bit hashes.

A word is a run of letters, digits and bytes of non-ASCII characters in the
lower-cased text; everything else parts words. Hashes of runs come from prefix
sums of a polynomial, so that no Python code runs for a word.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_BASE, PIECE + 4096), _powers(_INVERSE, PIECE + 4096)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ensure(n: int) -> None:
    global _up, _down
    if n > len(_up):
        _up, _down = _powers(_BASE, n), _powers(_INVERSE, n)


def joined(texts: list[str | None], ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of texts (only A-Z, if ``ascii_only``), a zero byte after each, and the places of those zeros."""
    whole = "\x00".join([(t.replace("\x00", " ") if "\x00" in t else t) if t else "" for t in texts] + [""])
    lowered = whole.encode("utf-8", "surrogatepass").lower() if ascii_only else whole.lower().encode("utf-8", "surrogatepass")
    data = np.frombuffer(lowered, np.uint8)
    return data, np.flatnonzero(data == 0)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and polynomials (of the first byte on) of the words of some bytes."""
    _ensure(len(data) + 1)
    word = WORD_BYTES[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _up[: len(data)], out=sums[1:])
    return starts, ends, (sums[ends] - sums[starts]) * _down[starts]


def hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of some bytes."""
    starts, ends, sums = _sums(data)
    return starts, ends, mix64(sums)


def _long(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, PIECE / 2 bytes at a time; a word that a cut parts is put together again."""
    out, parted, length = [], np.zeros(1, np.uint64), 0  # the polynomial and length of the word that the last piece ended in
    for k in range(0, len(data), PIECE // 2):
        piece = data[k : k + PIECE // 2]
        starts, ends, sums = _sums(piece)
        sizes = ends - starts
        if length and len(starts) and starts[0] == 0:
            sums[:1] = parted + sums[:1] * np.uint64(pow(int(_BASE), length, 1 << 64))
            sizes[0] += length
        elif length:
            out.append(parted)
        length = 0
        if len(ends) and ends[-1] == len(piece):
            parted, length, sums = sums[-1:], int(sizes[-1]), sums[:-1]
        out.append(sums)
    if length:
        out.append(parted)
    return mix64(np.concatenate(out))


def word_hashes(texts: list[str | None], ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words one after another, and where each text's begin (with the end: one more than texts)."""
    hashes, counts, first = [], [], 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last] or "") <= PIECE // 2):
            held += len(texts[last] or "")
            last += 1
        data, zeros = joined(texts[first:last], ascii_only)
        if held > PIECE // 2:  # one very long text
            own = _long(data)
            hashes.append(own)
            counts.append(np.array([len(own)]))
        else:
            starts, _, h = hashed(data)
            hashes.append(h)
            counts.append(np.diff(np.searchsorted(starts, zeros), prepend=0))
        first = last
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), offsets.astype(np.int64)


def slices(texts: list[str | None], most: int = PIECE // 2):
    """(first, last) of runs of texts that hold about ``most`` characters, at least one text."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > first and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(texts):
        yield first, len(texts)
