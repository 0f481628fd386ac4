"""The perfect binary Golay code of 23 bits: every word lies within three bits of one codeword.

A codeword is known by its index, the upper 12 bits. Words of bits are decoded by syndromes; votes,
whose signs would be the bits, go to the codeword that they agree with most.
"""

from __future__ import annotations

import numpy as np

BITS = 23
#: The code's generator polynomial (fixed value).
GENERATOR = 0xC75


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - 11
    return word


class Golay:
    """Codeword indices near 23-bit words: the code is perfect, so each word decodes to one."""

    def __init__(self):
        self.of_high = np.array([_remainder(h << 11) for h in range(1 << 12)], np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        bits = [1 << b for b in range(23)]
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    e = bits[a] | bits[b] | bits[c]
                    self.error[_remainder(e)] = e
        words = np.arange(1 << 11) << 11 | self.of_high[: 1 << 11]
        self.half = np.ascontiguousarray((words[None, :] >> np.arange(BITS)[:, None] & 1) * 2 - 1, np.float32)

    def decode(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.of_high[words >> 11] ^ (words & 0x7FF)]) >> 11

    def near(self, words: np.ndarray, width: int) -> np.ndarray:
        """Indices for each word and its one-bit neighbours, sorted, one row per word."""
        flips = np.concatenate(([0], 1 << np.arange(width, dtype=np.int64)))
        return np.sort(self.decode(words[:, None] ^ flips[None, :]), axis=1)

    def nearest(self, votes: np.ndarray) -> np.ndarray:
        """Index of the codeword of the greatest correlation with each row of ``BITS`` votes.

        The code holds each codeword's complement, so one half is tried with both signs. Where all votes
        weigh the same this is ``decode`` of their signs.
        """
        agree = votes.astype(np.float32) @ self.half
        most, least = agree.argmax(axis=1), agree.argmin(axis=1)
        row = np.arange(len(agree))
        return np.where(agree[row, most] >= -agree[row, least], most, least ^ 0xFFF)
