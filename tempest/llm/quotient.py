"""Counting quotient filters over packed word-id n-grams: lossless, compact, mergeable.

An n-gram of up to three ids of ``width`` bits is packed into 3 * width bits and permuted
invertibly (a Feistel network over two unequal halves). The leading bits of the permuted
number are the quotient, which names a slot; all other bits are the remainder, which is
stored whole, so nothing collides and every n-gram can be read back. A filter stores, slot
by slot, how many remainders it holds, the remainders in ascending order, and a counter for
each, of one byte with an escape for large counts. Filters are therefore sorted runs: those
of several shards merge in one ordered pass that adds the counters of equal entries.
"""

from __future__ import annotations

import struct

import numpy as np

#: ids of more bits would not leave the halves in 64 bits
MAX_WIDTH = 42
_HEAD = struct.Struct("<BBI")
_ROUNDS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7)]


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Layout:
    """Packing and permutation for ids of ``width`` bits; 0 stands for no word."""

    def __init__(self, width: int):
        if not 1 <= width <= MAX_WIDTH:
            raise ValueError(f"word ids of {width} bits can't be packed by threes")
        self.width, self.share = width, width // 2  # bits of the middle id in the left half
        self.left, self.right = width + self.share, 2 * width - self.share
        self.masks = [np.uint64((1 << b) - 1) for b in (self.left, self.right)]

    def pack(self, a, b, c):
        w, s = np.uint64(self.width), np.uint64(self.share)
        low = np.uint64((1 << (self.width - self.share)) - 1)
        return (a << s) | (b >> (w - s)), ((b & low) << w) | c

    def unpack(self, left, right):
        w, s = np.uint64(self.width), np.uint64(self.share)
        one = np.uint64((1 << self.width) - 1)
        return left >> s, ((left << (w - s)) & one) | (right >> w), right & one

    def permute(self, left, right):
        for i, key in enumerate(_ROUNDS):
            if i % 2:
                right = right ^ (_mix(left, key) & self.masks[1])
            else:
                left = left ^ (_mix(right, key) & self.masks[0])
        return left, right

    def restore(self, left, right):
        for i, key in reversed(list(enumerate(_ROUNDS))):
            if i % 2:
                right = right ^ (_mix(left, key) & self.masks[1])
            else:
                left = left ^ (_mix(right, key) & self.masks[0])
        return left, right

    def counted(self, left, right, counts=None):
        """Distinct entries in ascending order and their counters (1 each, or ``counts``)."""
        if not len(left):
            return left, right, np.zeros(0, np.int64)
        if self.left + self.right <= 64:
            whole = (left << np.uint64(self.right)) | right
            if counts is None:
                whole.sort()
            else:
                order = np.argsort(whole, kind="stable")  # merges the sorted runs
                whole, counts = whole[order], counts[order]
            left, right = whole >> np.uint64(self.right), whole & self.masks[1]
            new = np.r_[True, whole[1:] != whole[:-1]]
        else:
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            counts = None if counts is None else counts[order]
            new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]
        at = np.flatnonzero(new)
        n = np.diff(np.r_[at, len(new)]) if counts is None else np.add.reduceat(counts, at)
        return left[at], right[at], n.astype(np.int64)

    def filters(self, left, right, counts, blocks: int):
        """Yield (block, filter) of sorted distinct entries; a block is the slots that share
        the first ``blocks`` bits of the quotient."""
        blocks = min(blocks, self.left)
        slots = min(self.left, max(blocks, len(left).bit_length()))
        slot = left >> np.uint64(self.left - slots)
        block = (slot >> np.uint64(slots - blocks)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            first = np.uint64(int(block[a]) << (slots - blocks))
            yield int(block[a]), self._write(slots, blocks, (slot[a:b] - first).astype(np.int64), left[a:b], right[a:b], counts[a:b])

    def _write(self, slots, blocks, slot, left, right, counts) -> bytes:
        runs = np.bincount(slot, minlength=1 << (slots - blocks))
        size = 1 if runs.max() < 1 << 8 else 4
        small = np.minimum(counts, 255).astype(np.uint8)
        high = left & np.uint64((1 << (self.left - slots)) - 1)
        return b"".join([_HEAD.pack(slots, size, len(left)), runs.astype(f"<u{size}").tobytes(),
                         _cut(high, self.left - slots), _cut(right, self.right), small.tobytes(),
                         counts[small == 255].astype("<u8").tobytes()])

    def read(self, data: bytes, block: int, blocks: int):
        """(left, right, counters) of a block's filter."""
        blocks = min(blocks, self.left)
        slots, size, n = _HEAD.unpack_from(data)
        at, many = _HEAD.size, 1 << (slots - blocks)
        runs = np.frombuffer(data, f"<u{size}", many, at)
        at += many * size
        high, at = _uncut(data, at, n, self.left - slots)
        right, at = _uncut(data, at, n, self.right)
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        big = counts == 255
        counts[big] = np.frombuffer(data, "<u8", int(big.sum()), at + n)
        slot = np.repeat(np.arange(many, dtype=np.uint64), runs) + np.uint64(block << (slots - blocks))
        return (slot << np.uint64(self.left - slots)) | high, right, counts


def _cut(x: np.ndarray, bits: int) -> bytes:
    """The lowest bytes that hold ``bits`` bits."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8]).tobytes()


def _uncut(data: bytes, at: int, n: int, bits: int):
    size = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").ravel(), at + n * size
