"""MD5 of many short texts at once, for draws that are hash uniforms."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
#: Texts worked on at once: what a core's cache holds.
CHUNK = 8192
#: Longest text that one block of 64 bytes takes.
ONE_BLOCK = 55


def _rounds(x: np.ndarray) -> np.ndarray:
    """x: 16 words by texts, padded; the four words of each digest."""
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(x.shape[1], v, dtype=np.uint32) for v in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, x[at], out=f), np.add(f, _SINES[i], out=f)
        s = _TURNS[turn][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, f, d, c, b = d, a, c, b, f
    return np.stack([v + s for v, s in zip((a, b, c, d), start, strict=True)])


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of bytes padded with zeros, and their lengths in bytes."""
    raw = [t.encode() for t in texts]
    length = np.fromiter(map(len, raw), "int64", len(raw))
    wide = max(int(length.max(initial=0)), 1)
    return np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in raw), dtype=np.uint8).reshape(len(raw), wide), length


def md5_words(head: str, tails: tuple[np.ndarray, np.ndarray], ends: tuple[str, ...] = ("",)) -> np.ndarray:
    """MD5 of head + tail + end as four big-endian words: an array (4, ends, tails) of uint32; words compare as the hex text does."""
    (rows, length), first = tails, head.encode()
    lasts = [e.encode() for e in ends]
    out = np.empty((4, len(lasts), len(rows)), dtype=np.uint32)
    if len(first) + int(length.max(initial=0)) + max(map(len, lasts)) > ONE_BLOCK:
        for i, r in enumerate(rows):
            for k, e in enumerate(lasts):
                out[:, k, i] = np.frombuffer(hashlib.md5(first + r[: length[i]].tobytes() + e).digest(), dtype=">u4")
        return out
    step = max(CHUNK // len(lasts), 1)
    for lo in range(0, len(rows), step):
        part, own = rows[lo : lo + step], length[lo : lo + step]
        n = len(part)
        text = np.zeros((len(lasts), n, 64), dtype=np.uint8)
        text[:, :, : len(first)] = np.frombuffer(first, dtype=np.uint8)
        text[:, :, len(first) : len(first) + part.shape[1]] = part
        at = np.arange(n)
        for k, e in enumerate(lasts):
            for j, byte in enumerate((*e, 0x80)):
                text[k, at, len(first) + own + j] = byte
            bits = 8 * (len(first) + own + len(e))
            text[k, :, 56], text[k, :, 57] = bits & 255, bits >> 8
        words = np.ascontiguousarray(text.reshape(-1, 64).view("<u4").T)
        out[:, :, lo : lo + n] = _rounds(words).byteswap().reshape(4, len(lasts), n)
    return out


def uniforms(words: np.ndarray) -> np.ndarray:
    """What uniform_at reads from the eight hexadecimal digits of a word."""
    return (words.astype(float) + 0.5) / 4294967296.0
