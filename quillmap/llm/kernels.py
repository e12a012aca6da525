"""Vectorised text kernels over UTF-8 bytes, used inside Arrow tasks.

Texts of a batch are handled in slices of about a megabyte, so memory does
not depend on the batch; one longer text forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are handled at once (about), and n-grams that a counting task holds before it gives them away.
SLICE, MOST_HELD = 1 << 20, 1 << 18
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_U = np.uint64
MASK = (1 << 64) - 1
_CACHE: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; another ``seed`` gives an independent one.

    A span is read as words of eight bytes. Each word is mixed with its place in
    the span, the mixed words are added up, and the sum is mixed with the span's
    length. As the mixer is no polynomial, no family of texts collides by its form.
    """
    lens = ends - starts
    words = (lens + 7) >> 3
    first = np.concatenate([[0], np.cumsum(words)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], words)
    raw = np.zeros(len(buf) + 8, np.uint8)
    raw[: len(buf)] = buf
    # every eight bytes that follow each other, as one little-endian number
    at = np.ndarray(len(buf) + 1, "<u8", raw.data, 0, (1,))[np.repeat(starts, words) + 8 * place]
    tail = first[1:][words > 0] - 1
    spare = (8 * words - lens)[words > 0].astype(_U) * _U(8)
    at[tail] = (at[tail] << spare) >> spare
    mixed = mix(at ^ mix(place.astype(_U) * _U(0x9E3779B97F4A7C15) + _U((seed + 1) * 0xD6E8FEB86659FD93 & MASK)))
    total = np.zeros(len(mixed) + 1, _U)
    np.cumsum(mixed, out=total[1:])
    return mix((total[first[1:]] - total[first[:-1]]) + lens.astype(_U) * _U(0xD1342543DE82EF95))


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in them) of the texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (with a last sentinel)."""
    return spans(~IS_SPACE[buf], offsets)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes that are inside, none over the end of a text, and for each text the index of its first one (with a last sentinel)."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    first[full] = inside[full]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of \\n-split lines, and for each text the index of its first line. An empty text has one empty line."""
    cuts = np.flatnonzero(buf == 10)
    per_text = np.searchsorted(cuts, offsets)
    counts = np.diff(per_text) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    at_first = np.zeros(first[-1], bool)
    at_first[first[:-1]] = True
    at_last = np.zeros(first[-1], bool)
    at_last[first[1:] - 1] = True
    starts[at_first], ends[at_last] = offsets[:-1], offsets[1:]
    starts[~at_first], ends[~at_last] = cuts + 1, cuts
    return starts, ends, first


def stripped(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at both ends; an all-space span becomes empty."""
    solid = np.flatnonzero(~IS_SPACE[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    out_a, out_b = starts.copy(), starts.copy()
    out_a[some], out_b[some] = solid[a[some]], solid[b[some] - 1] + 1
    return out_a, out_b


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k successive hashes; shorter input gives one run of all."""
    if len(hashes) < k:
        k = len(hashes)
    if not k:
        return np.zeros(0, _U)
    n = len(hashes) - k + 1
    total = np.zeros(n, _U)
    for j in range(k):
        total = mix(total * _U(0xAF251AF3B0F025B5) + hashes[j : j + n])
    return mix(total + _U(k))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes (lower-cased ASCII)."""
    buf = TO_LOWER[buf]
    starts, ends, of = words(buf, offsets)
    hashes = span_hashes(buf, starts, ends)
    for i in range(len(offsets) - 1):
        yield np.unique(runs(hashes[of[i] : of[i + 1]], k))


class Tally:
    """Counts of (name, code), held sparsely: new codes are merged in when as many have come as are held."""

    def __init__(self) -> None:
        self.parts: dict[str, list] = {}
        self.held = self.new = 0

    def add(self, name: str, codes: np.ndarray) -> None:
        self.parts.setdefault(name, []).append(np.unique(codes, return_counts=True))
        self.new += len(self.parts[name][-1][0])
        if self.new > MOST_HELD:
            self.merge()

    def merge(self) -> None:
        for name, parts in self.parts.items():
            codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            found, at = np.unique(codes, return_inverse=True)
            self.parts[name] = [(found, np.bincount(at, n, len(found)).astype(np.int64))]
        self.held, self.new = sum(len(p[0][0]) for p in self.parts.values()), 0

    def take(self) -> Iterator[pa.RecordBatch]:
        """All counts so far, which are then let go."""
        self.merge()
        for name, [(codes, n)] in self.parts.items():
            for lo in range(0, len(codes), 1 << 16):
                part = codes[lo : lo + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(n[lo : lo + (1 << 16)])], ["lang", "code", "n"])
        self.__init__()
