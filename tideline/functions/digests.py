"""MD5 of many short strings at once, in numpy: a prefix and a number each, where hashing is the work."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages a pass, so that its arrays stay in the cache.
_PASS = 1 << 14


def _blocks(words: np.ndarray) -> np.ndarray:
    """The digests, 4 x m, of m messages of one block each, words 16 x m."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    for i in range(64):
        r = i // 16
        f = (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d)[r] if r < 3 else c ^ (b | ~d)
        f = f + a + np.uint32(_SINES[i]) + words[_WORDS[r](i)]
        s = _TURNS[r][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    return np.stack([a, b, c, d]) + np.array(_START, np.uint32)[:, None]


def md5(prefixes: Sequence[bytes], numbers: np.ndarray) -> np.ndarray:
    """The two big-endian halves of the MD5 of each prefix followed by each number in decimals, prefixes x numbers x 2."""
    names = np.char.encode(numbers.astype(str), "ascii")
    lengths = np.char.str_len(names)
    out = np.empty((len(prefixes), len(names), 2), np.uint64)
    for n in np.unique(lengths).tolist():
        on = np.flatnonzero(lengths == n)
        digits = names[on].astype(f"S{n}").view(np.uint8).reshape(-1, n)
        for size in sorted({len(p) for p in prefixes}):
            rows = [k for k, p in enumerate(prefixes) if len(p) == size]
            if size + n > 55:  # more than a block
                for k in rows:
                    out[k, on] = np.frombuffer(b"".join(hashlib.md5(prefixes[k] + x).digest() for x in names[on].tolist()), ">u8").reshape(-1, 2)
                continue
            for at in range(0, len(rows), most := max(1, _PASS // len(on))):
                some = rows[at : at + most]
                block = np.zeros((len(some), len(on), 64), np.uint8)
                block[:, :, :size] = np.frombuffer(b"".join(prefixes[k] for k in some), np.uint8).reshape(-1, 1, size)
                block[:, :, size : size + n] = digits
                block[:, :, size + n] = 0x80
                block[:, :, 56:58] = (8 * (size + n) & 255, 8 * (size + n) >> 8)
                got = _blocks(np.ascontiguousarray(block.reshape(-1, 64).view("<u4").T)).byteswap().astype(np.uint64)
                halves = np.stack([(got[0] << np.uint64(32)) | got[1], (got[2] << np.uint64(32)) | got[3]], axis=1)
                out[np.ix_(some, on)] = halves.reshape(len(some), len(on), 2)
    return out
