"""BLAKE3 of bytes, from the published specification; for digests that must equal other tools' (256 bits, no key)."""

from __future__ import annotations

import struct

# The initial vector, the message permutation and the flags of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
MASK = 0xFFFFFFFF
MIXES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv, block, counter, size, flags):
    s = [*cv, *IV[:4], counter & MASK, counter >> 32 & MASK, size, flags]
    m = list(block)
    for round_ in range(7):
        for k, (a, b, c, d) in enumerate(MIXES):
            for x, turns in ((m[2 * k], (16, 12)), (m[2 * k + 1], (8, 7))):
                s[a] = s[a] + s[b] + x & MASK
                t = s[d] ^ s[a]
                s[d] = t >> turns[0] | t << 32 - turns[0] & MASK
                s[c] = s[c] + s[d] & MASK
                t = s[b] ^ s[c]
                s[b] = t >> turns[1] | t << 32 - turns[1] & MASK
        m = [m[i] for i in PERMUTATION]
    return [s[i] ^ s[i + 8] for i in range(8)]


def _words(block: bytes):
    return struct.unpack("<16I", block.ljust(64, b"\0"))


def _chunk(data: bytes, counter: int, root: int):
    cv = IV
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        cv = _compress(cv, _words(block), counter, len(block), (CHUNK_START if i == 0 else 0) | (CHUNK_END | root if last else 0))
    return cv


def _tree(data: bytes, counter: int, root: int):
    if len(data) <= 1024:
        return _chunk(data, counter, root)
    chunks = -(-len(data) // 1024)
    left = 1 << (chunks - 1).bit_length() - 1
    a, b = _tree(data[: left * 1024], counter, 0), _tree(data[left * 1024 :], counter + left, 0)
    return _compress(IV, (*a, *b), 0, 64, PARENT | root)


def hexdigest(data: bytes) -> str:
    return struct.pack("<8I", *_tree(data, 0, ROOT)).hex()
