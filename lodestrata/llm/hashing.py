"""Hashes of all words of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

from lodestrata.llm.common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = int(BASE)) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of an odd base and of its inverse, modulo 2**64; a worker keeps the longest made so far."""

    def of(b: int, size: int) -> np.ndarray:
        out = np.full(size, b, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, int(np.ceil(np.log2(n + 1))))
        _POWERS[base] = of(base, size), of(pow(base, -1, 1 << 64), size)
    return _POWERS[base]


def lowered(text: str) -> str:
    """Lower case, character by character, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def joined_bytes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, a line end behind each, and where each starts (and the last ends)."""
    parts = [((t.lower() if lower else t) if t else "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each of the given stretches of data (polynomial prefix sums, so all at once)."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of lowered text belong to words: letters a-z, digits and all beyond ASCII."""
    return (data >= 0x80) | ((data >= 0x30) & (data <= 0x39)) | ((data >= 0x61) & (data <= 0x7A))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's begin (and the last's end)."""
    data, first = joined_bytes(texts)
    starts, ends = runs(word_bytes(data))
    return hashed(data, starts, ends), np.searchsorted(starts, first)
