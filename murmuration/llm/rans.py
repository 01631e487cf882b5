"""A range asymmetric numeral system with static tables, many lanes at a time.

A block is a stream of 32-bit words shared by interleaved lanes: symbol ``i``
belongs to lane ``i % lanes``, and each step codes one symbol of every lane.
States are 64-bit, in [2^31, 2^63), and give up or take in 32 bits at a time.
The encoder runs backwards from the state 2^31, so a decoder must end there.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
LANES = 1024
CHECKPOINT = 128


class CorruptBlock(ValueError):
    """A block fails one of its checks."""


@dataclass(frozen=True)
class Table:
    """Frequencies of the symbols that occur; they add up to 2^BITS."""

    symbols: np.ndarray
    freqs: np.ndarray

    @staticmethod
    def of(ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        return Table(symbols.astype(np.uint32), quantise(counts[symbols], 1 << BITS))

    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.freqs)[:-1])).astype(np.uint64)

    def inverse(self) -> np.ndarray:
        """The index of a symbol, by symbol."""
        at = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 0, np.int64)
        at[self.symbols] = np.arange(len(self.symbols))
        return at

    def slots(self) -> np.ndarray:
        """The index of the symbol that owns each of the 2^BITS slots."""
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freqs)


def quantise(counts: np.ndarray, total: int) -> np.ndarray:
    """Integers of at least 1 that add up to ``total``, close to proportional."""
    if len(counts) > total:
        raise ValueError("more symbols than slots")
    if not len(counts):
        return np.zeros(0, np.uint32)
    # one slot for everybody, the rest by largest remainders
    share = counts / counts.sum() * (total - len(counts))
    freqs = np.floor(share).astype(np.int64)
    left = total - len(counts) - int(freqs.sum())
    if left:
        freqs[np.argsort(freqs - share, kind="stable")[:left]] += 1
    return (freqs + 1).astype(np.uint32)


@dataclass(frozen=True)
class Block:
    n: int
    lanes: int
    words: bytes
    states: bytes  # of all lanes, before every CHECKPOINT-th step
    offsets: list[int]  # words read before each of those steps
    crc_words: int
    crc_ids: int


def lanes_for(n: int) -> int:
    """Few lanes for short blocks, so that states do not outweigh the words."""
    return int(min(LANES, max(1, n // 64)))


def encode(ids: np.ndarray, table: Table) -> Block:
    n = len(ids)
    lanes = lanes_for(n)
    steps = -(-n // lanes) if n else 0
    index = table.inverse()[ids]
    padded = np.zeros(steps * lanes, np.int64)
    padded[:n] = index
    freqs = table.freqs.astype(np.uint64)[padded].reshape(steps, lanes)
    starts = table.starts()[padded].reshape(steps, lanes) if n else freqs
    limits = freqs << np.uint64(63 - BITS)
    x = np.full(lanes, LOW, np.uint64)
    shift = np.uint64(BITS)
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        f = freqs[t]
        full = x >= limits[t]
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> WORD, x)
        q = x // f
        x = (q << shift) + (x - q * f) + starts[t]
        if t % CHECKPOINT == 0:
            marks.append(x)
    words.reverse()
    marks.reverse()
    counts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    stream = np.concatenate(words).astype("<u4").tobytes() if words else b""
    return Block(
        n,
        lanes,
        stream,
        np.concatenate(marks).astype("<u8").tobytes() if marks else b"",
        counts[: max(steps, 0) : CHECKPOINT].tolist() if steps else [],
        zlib.crc32(stream),
        zlib.crc32(ids.astype("<u4").tobytes()),
    )


class Decoder:
    def __init__(self, table: Table):
        self.symbols = table.symbols
        self.freqs = table.freqs.astype(np.uint64)
        self.starts = table.starts() if len(table.symbols) else np.zeros(0, np.uint64)
        self.slots = table.slots()

    def _run(self, block: Block, part: int, last: int) -> np.ndarray:
        """The symbols of the steps from checkpoint ``part`` up to step ``last``."""
        lanes = block.lanes
        words = np.frombuffer(block.words, "<u4").astype(np.uint64)
        states = np.frombuffer(block.states, "<u8").reshape(-1, lanes)
        x, at = states[part].copy(), block.offsets[part]
        first = part * CHECKPOINT
        out = np.empty((last - first, lanes), np.uint32)
        mask, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS)
        for t in range(last - first):
            slot = x & mask
            s = self.slots[slot]
            out[t] = s
            x = self.freqs[s] * (x >> shift) + slot - self.starts[s]
            low = np.flatnonzero(x < LOW)
            if at + len(low) > len(words):
                raise CorruptBlock("the words end too early")
            x[low] = (x[low] << WORD) | words[at : at + len(low)]
            at += len(low)
        steps = -(-block.n // lanes)
        if last == steps:
            good = bool((x == LOW).all()) and at == len(words)
        else:
            good = bool((x == states[part + 1]).all()) and at == block.offsets[part + 1]
        if not good:
            raise CorruptBlock("a lane does not end in the state it must")
        return self.symbols[out.ravel()]

    def part(self, block: Block, part: int) -> np.ndarray:
        """Decode from one checkpoint to the next, independently of the others."""
        steps = -(-block.n // block.lanes)
        last = min(steps, (part + 1) * CHECKPOINT)
        ids = self._run(block, part, last)
        return ids[: block.n - part * CHECKPOINT * block.lanes]

    def block(self, block: Block) -> np.ndarray:
        if zlib.crc32(block.words) != block.crc_words:
            raise CorruptBlock("the words do not have their checksum")
        parts = [self.part(block, k) for k in range(len(block.offsets))]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != block.crc_ids:
            raise CorruptBlock("the ids do not have their checksum")
        return ids
