"""Words of many texts as 64-bit numbers, computed on whole byte buffers.

A word is a run of bytes that are not ASCII white space (0x20, 0x09-0x0D), the
same as ``[^\\x20\\x09-\\x0D]+`` over code points.  The number of a word is a
polynomial over random byte values modulo 2**64, finished by a mixing step;
different words share a number with a chance of about 2**-64.  All functions are
pure, so a task that is run again gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd constants that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=U) * U(_BASE) + U(seed & (2**64 - 1)) * U(0xD6E8FEB86659FD93)
        return mix(mix(steps)) | U(1)


_BYTES = constants(256, 1)
_FOLDED = _BYTES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
#: bytes whose words are numbered at once: what is held beside a text does not grow with it
BLOCK = 1 << 18


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    tables = []
    for factor in (_BASE, _BASE_INVERSE):
        table = np.full(2 * BLOCK, factor, dtype=U)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


_UP, _DOWN = _powers()


class Words:
    """Words of a list of UTF-8 texts.

    ``number``: one 64-bit number a word, in reading order over all texts;
    ``start``/``end``: byte places in ``buffer``; ``first``: for text ``i`` the
    words ``first[i]`` to ``first[i + 1]`` are its own.  ``fold`` makes A-Z equal a-z;
    ``space`` marks the bytes between words.
    """

    def __init__(self, texts: list[bytes], fold: bool = False, space: np.ndarray = SPACE):
        raw = b"\n".join(texts) + b"\n"
        self.buffer = np.frombuffer(raw, dtype=np.uint8)
        inside = ~space[self.buffer]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self._values = _FOLDED if fold else _BYTES
        self.number = self._numbers(self.end)
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, self.offset)

    def _numbers(self, end: np.ndarray) -> np.ndarray:
        """The numbers of the words up to ``end``, block by block."""
        out = np.empty(len(self.start), U)
        first = 0
        while first < len(out):
            low = int(self.start[first])
            last = int(np.searchsorted(self.start, low + BLOCK))
            if int(end[last - 1]) - low > 2 * BLOCK:  # the last one goes on beyond the block
                last -= 1
                if last == first:
                    out[first] = self._long(low, int(end[first]))
                    first += 1
                    continue
            begins, ends = self.start[first:last] - low, end[first:last] - low
            with np.errstate(over="ignore"):
                values = self._values[self.buffer[low : low + int(ends[-1])]]
                total = np.cumsum(values * _UP[: len(values)])
                before = np.where(begins > 0, total[begins - 1], U(0))
                out[first:last] = (total[ends - 1] - before) * _DOWN[begins]
            first = last
        return mix(out)

    def _long(self, low: int, high: int) -> int:
        """The sum of one word that is longer than a block."""
        total = 0
        for at in range(low, high, BLOCK):
            values = self._values[self.buffer[at : min(high, at + BLOCK)]]
            with np.errstate(over="ignore"):
                part = int((values * _UP[: len(values)]).sum())
            total += part * pow(_BASE, at - low, 1 << 64)
        return total % (1 << 64)

    def prefix(self, size: int) -> np.ndarray:
        """The numbers of the words' first ``size`` bytes; all of a shorter word."""
        return self._numbers(np.minimum(self.end, self.start + size))


def chunks(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in UTF-8 with the place of the first, in runs of about ``size`` bytes.

    A text longer than that is a run of its own.  A missing text is empty.
    """
    run: list[bytes] = []
    begun, held = 0, 0
    for place, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if run and held + len(raw) > size:
            yield begun, run
            run, begun, held = [], place, 0
        run.append(raw)
        held += len(raw) + 1
    if run:
        yield begun, run


def windows(number: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A number for each run of ``width`` words; none if there are fewer words."""
    n = len(number) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    factors = constants(width, seed)
    with np.errstate(over="ignore"):
        out = number[:n] * factors[0]
        for k in range(1, width):
            out += number[k : k + n] * factors[k]
        return mix(out)
