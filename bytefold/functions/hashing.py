"""32-byte hashes of container blocks: SHA-256, SHA-512/256, and BLAKE3 written for numpy.

BLAKE3 follows the public specification: 1 KiB chunks of 64-byte blocks, then a binary tree of
parents.  All chunks go through the compression function side by side as array columns.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed values of the specification: initial vector and message permutation.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
_PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(chain: np.ndarray, block: np.ndarray, counter: np.ndarray, size, flags) -> np.ndarray:
    """The first 8 words of the compression of ``k`` inputs at once (arrays of shape (8|16, k))."""
    k = block.shape[1]
    full = lambda v: np.broadcast_to(np.asarray(v, dtype=np.uint32), (k,))
    v = [*chain, *(np.full(k, x, dtype=np.uint32) for x in _IV[:4]), (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), full(size), full(flags)]
    m = list(block)

    def mix(a, b, c, d, x, y):
        v[a] = v[a] + v[b] + x
        v[d] = _turn(v[d] ^ v[a], 16)
        v[c] = v[c] + v[d]
        v[b] = _turn(v[b] ^ v[c], 12)
        v[a] = v[a] + v[b] + y
        v[d] = _turn(v[d] ^ v[a], 8)
        v[c] = v[c] + v[d]
        v[b] = _turn(v[b] ^ v[c], 7)

    for step in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if step < 6:
            m = [m[i] for i in _PERMUTATION]
    return np.array([v[i] ^ v[i + 8] for i in range(8)])


def blake3(data: bytes) -> bytes:
    """BLAKE3 with 32 bytes of output."""
    chunks = max(1, -(-len(data) // 1024))
    last = len(data) - 1024 * (chunks - 1)
    words = np.frombuffer(data.ljust(chunks * 1024, b"\0"), dtype="<u4").reshape(chunks, 16, 16)
    counter = np.arange(chunks, dtype=np.uint64)
    chain = np.repeat(_IV[:, None], chunks, axis=1)
    for b in range(16):
        alive = np.ones(chunks, dtype=bool)
        alive[-1] = b == 0 or last > 64 * b
        final = np.full(chunks, b == 15)
        final[-1] = last <= 64 * (b + 1)
        size = np.full(chunks, 64)
        size[-1] = min(64, max(0, last - 64 * b))
        flags = (_START if b == 0 else 0) | np.where(final, _END | (_ROOT if chunks == 1 else 0), 0)
        out = _compress(chain, np.ascontiguousarray(words[:, b].T), counter, size, flags)
        chain = np.where(alive, out, chain)
    while chain.shape[1] > 1:
        pairs = chain.shape[1] // 2
        block = np.concatenate([chain[:, 0 : 2 * pairs : 2], chain[:, 1 : 2 * pairs : 2]])
        root = _ROOT if chain.shape[1] == 2 else 0
        up = _compress(np.repeat(_IV[:, None], pairs, axis=1), block, np.zeros(pairs, dtype=np.uint64), 64, _PARENT | root)
        chain = np.concatenate([up, chain[:, 2 * pairs :]], axis=1)
    return chain[:, 0].astype("<u4").tobytes()


# The container's hash selector.
ALGORITHMS = {0: blake3, 1: lambda d: hashlib.sha256(d).digest(), 2: lambda d: hashlib.new("sha512_256", d).digest()}


def block_hash(data: bytes, algorithm: int = 0) -> bytes:
    return ALGORITHMS[algorithm](data)
