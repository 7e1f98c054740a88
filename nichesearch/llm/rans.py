"""Range asymmetric numeral systems over whole arrays: interleaved lanes share one table.

A block's symbols are dealt to its lanes in turn. Lanes are 64-bit states in [2^31, 2^63)
that emit and take 32-bit words; a step encodes or decodes one symbol of every lane. The
words of a step stand in the order of the lanes, the steps in the order of decoding.

Every ``STEPS`` steps there is a checkpoint: how many words come before it, and the states of
the lanes. Decoding can begin at each, so that pieces of a long block decode independently.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 1024
STEPS = 256
LOW = 1 << 31
_WORD, _MASK = np.uint64(32), np.uint64(0xFFFFFFFF)


def quantised(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies that sum to 2^bits, at least 1 for every symbol that occurs; bits."""
    used = int((counts > 0).sum())
    bits = max(16, (4 * max(1, used) - 1).bit_length())
    total, whole = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint64), bits
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (whole / total))), 0).astype(np.int64)
    over = int(freq.sum()) - whole
    for i in np.argsort(-freq, kind="stable"):
        if over <= 0:
            freq[i] -= over
            break
        less = min(over, int(freq[i] // 2))
        freq[i] -= less
        over -= less
    return freq.astype(np.uint64), bits


class Coder:
    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), np.uint64(bits)
        self.low = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, symbols: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """First states, words, checkpoints: rows of (words before, state of each lane)."""
        n = len(symbols)
        lanes = max(1, min(LANES, n // 64))
        freq, low = self.freq[symbols], self.low[symbols]
        most = freq << (np.uint64(63) - self.bits)
        x, words, marks, emitted = np.full(lanes, LOW, np.uint64), [], [], 0
        for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
            f, k = freq[at : at + lanes], min(lanes, n - at)
            y = x[:k]
            over = y >= most[at : at + k]
            words.append((y[over] & _MASK).astype("<u4"))
            emitted += len(words[-1])
            y[over] >>= _WORD
            q = y // f
            x[:k] = (q << self.bits) + (y - q * f) + low[at : at + k]
            if at and at // lanes % STEPS == 0:
                marks.append((emitted, x.copy()))
        marks = b"".join(np.append(np.uint64(emitted - after), own).astype("<u8").tobytes() for after, own in reversed(marks))
        words.reverse()
        return x.astype("<u8").tobytes(), b"".join(w.tobytes() for w in words), marks

    def decode(self, states: bytes, payload: bytes, n: int, marks: bytes = b"", begin: int = 0, end: int | None = None) -> np.ndarray:
        """The symbols from ``begin`` to ``end`` of a block of n, from the last checkpoint before them; raises ValueError unless states and words come out even where the block ends."""
        x, words = np.frombuffer(states, "<u8").copy(), np.frombuffer(payload, "<u4").astype(np.uint64)
        end = n if end is None else end
        lanes, at, first, mask = len(x), 0, 0, np.uint64((1 << int(self.bits)) - 1)
        rows = np.frombuffer(marks, "<u8").reshape(-1, lanes + 1)
        if mark := min(begin // (STEPS * lanes), len(rows)):
            at, x, first = int(rows[mark - 1, 0]), rows[mark - 1, 1:].copy(), mark * STEPS * lanes
        last = min(n, -(-end // lanes) * lanes)
        out = np.empty(max(0, last - first), np.uint32)
        for here in range(first, last, lanes):
            k = min(lanes, n - here)
            slot = x[:k] & mask
            s = self.symbol[slot]
            out[here - first : here - first + k] = s
            y = self.freq[s] * (x[:k] >> self.bits) + slot - self.low[s]
            under = y < LOW
            more = int(np.count_nonzero(under))
            y[under] = (y[under] << _WORD) | words[at : at + more]
            x[:k] = y
            at += more
        if last == n and (at != len(words) or (x != LOW).any()):
            raise ValueError("a block's states do not come out even")
        return out[begin - first : end - first]


def checksum(*parts: bytes) -> int:
    crc = 0
    for part in parts:
        crc = zlib.crc32(part, crc)
    return crc
