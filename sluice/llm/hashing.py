"""Hashes of many words and word sequences at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in blocks of about this many bytes.
BLOCK_BYTES = 1_500_000
_ODD = 0x9E3779B97F4A7C15 | 1
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts: `data` (bytes of all texts), `start` and `end` of each word in it, `doc`, the text each word is of, and `first`, the number of each text's first word (with the end)."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "replace") for t in texts]
        self.data = b" ".join([*raw, b""])
        buf = np.frombuffer(self.data, np.uint8)
        blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8), append=np.int8(1) if len(buf) else np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(buf))
        at = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._buf = buf

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: differences of one running polynomial sum."""
        buf = self._buf.astype(np.uint64) + np.uint64(1)
        run = np.append(np.uint64(0), np.cumsum(buf * _powers(_ODD, len(buf)), dtype=np.uint64))
        return mix((run[self.end] - run[self.start]) * _powers(_ODD_INVERSE, len(buf) + 1)[self.start] + (self.end - self.start).astype(np.uint64))

    def ranges(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from each `start` to before each `end`."""
        run = np.append(np.uint64(0), np.cumsum(mix(hashes + np.uint64(1)) * _powers(_ODD, len(hashes)), dtype=np.uint64))
        return mix((run[end] - run[start]) * _powers(_ODD_INVERSE, len(hashes) + 1)[start] + (end - start).astype(np.uint64))

    def sequences(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the `size` words from each word on, and whether they are of one text."""
        n = len(hashes)
        out = np.zeros(n, np.uint64)
        for k in range(min(size, n)):
            part = hashes[k:] if k else hashes
            out[: n - k] = mix(out[: n - k] * np.uint64(3) + part) if k else part
        whole = np.zeros(n, bool)
        if n >= size:
            whole[: n - size + 1] = self.doc[: n - size + 1] == self.doc[size - 1 :]
        return out, whole


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Number of the first text, and texts, of blocks that are small but for single long texts; null is empty."""
    at, size, block = 0, 0, []
    for k, t in enumerate(texts):
        block.append(t or "")
        size += len(block[-1])
        if size >= BLOCK_BYTES:
            yield at, block
            at, size, block = k + 1, 0, []
    if block:
        yield at, block
