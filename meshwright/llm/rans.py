"""Token-id files coded with a static range asymmetric numeral system (rANS).

A file holds whole documents in ascending order of id: one frequency table that all its blocks share, the
documents' ids and lengths, and blocks of a fixed number of symbols that decode independently of each
other. Inside a block, symbol i belongs to lane i mod LANES; all lanes have a coder state of their own and
take turns at one stream of 32-bit words, so that a step over all lanes is one vector operation.

    magic, version, header length and its CRC-32          little-endian unsigned 32-bit integers
    header                                                 zlib-compressed, see _pack()
    blocks                                                 lane states (64-bit), then the words (32-bit)

The header has a checkpoint per block: its byte offset, its symbols, and the CRC-32 of its coded bytes and
of the symbols that must come out. Any block can be fetched and decoded alone from its checkpoint.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

MAGIC, VERSION = 0x534E4152, 1
#: Frequencies in a table sum to 2**SCALE. States stay in [2**31, 2**63).
SCALE = 20
LANES, STEPS = 2048, 128
_LOW = np.uint64(1 << 31)
_32, _SCALE = np.uint64(32), np.uint64(SCALE)


class FormatError(ValueError):
    """The bytes are not an intact file of this format."""


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts made to sum to 2**SCALE, each at least 1. The largest ones take up the rounding."""
    goal = 1 << SCALE
    if len(counts) > goal:
        raise FormatError("more distinct symbols than the table's scale allows")
    if not len(counts):
        return counts.astype(np.int64)
    freq = np.maximum(1, np.floor(counts * (goal / counts.sum()))).astype(np.int64)
    over = int(freq.sum()) - goal
    for i in np.argsort(-freq, kind="stable"):
        if over == 0:
            break
        step = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= step
        over -= step
    return freq


def _code(slots: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """One block of table slots, last step first, as the decoder reads it in order."""
    n = len(slots)
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, np.uint64)
    words: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        part = slots[t * LANES : (t + 1) * LANES]
        x = state[: len(part)]
        f = freq[part]
        full = x >= (f << np.uint64(63 - SCALE))
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(full, x >> _32, x)
        q = x // f
        state[: len(part)] = (q << _SCALE) + (x - q * f) + start[part]
    return state.tobytes() + (np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)).tobytes()


def _decode(blob: bytes, n: int, freq: np.ndarray, start: np.ndarray, slot_of: np.ndarray) -> np.ndarray:
    state = np.frombuffer(blob, np.uint64, LANES).copy()
    words = np.frombuffer(blob, np.uint32, offset=LANES * 8).astype(np.uint64)
    out, at, mask = np.empty(n, np.int64), 0, np.uint64((1 << SCALE) - 1)
    for t in range(-(-n // LANES)):
        x = state[: min(LANES, n - t * LANES)]
        low = x & mask
        s = slot_of[low.astype(np.int64)]
        out[t * LANES : t * LANES + len(x)] = s
        x = freq[s] * (x >> _SCALE) + low - start[s]
        short = np.flatnonzero(x < _LOW)
        if len(short):
            if at + len(short) > len(words):
                raise FormatError("a block ends early")
            x[short] = (x[short] << _32) | words[at : at + len(short)]
            at += len(short)
        state[: len(x)] = x
    if at != len(words) or (state != _LOW).any():
        raise FormatError("a block's coder did not come back to its first state")
    return out


def _pack(parts: list[np.ndarray]) -> bytes:
    return zlib.compress(b"".join(struct.pack("<Q", len(p)) + p.tobytes() for p in parts), 6)


def _unpack(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(blob), 0, []
    for kind in kinds:
        (n,) = struct.unpack_from("<Q", raw, at)
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


_KINDS = [np.int64, np.uint32, np.uint32, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32]


def encode(doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """The bytes of a file. tokens: all documents' unsigned 32-bit ids, one after the other."""
    tokens = np.ascontiguousarray(tokens, np.uint32)
    if len(tokens) and int(tokens.max()) < 1 << 24:  # a dense count beats a sort
        counts = np.bincount(tokens)
        symbols = np.flatnonzero(counts).astype(np.uint32)
        slot = np.zeros(len(counts), np.int64)
        slot[symbols] = np.arange(len(symbols))
        slots, counts = slot[tokens], counts[symbols]
    else:
        symbols, slots, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    freq = scaled(counts)
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    f64, size = freq.astype(np.uint64), LANES * STEPS
    blocks, sums, plain = [], [], []
    for at in range(0, len(tokens), size):
        blocks.append(_code(slots[at : at + size], f64, start))
        sums.append(zlib.crc32(blocks[-1]))
        plain.append(zlib.crc32(tokens[at : at + size].tobytes()))
    offsets = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.uint64)
    counts_by_block = [min(size, len(tokens) - at) for at in range(0, len(tokens), size)]
    steps = np.diff(np.asarray(doc_ids, np.int64), prepend=np.int64(0))  # wraps around; so does the sum
    header = _pack([steps, np.asarray(lengths, np.uint32), symbols, freq.astype(np.uint32), offsets, np.array(counts_by_block, np.uint32), np.array(sums, np.uint32), np.array(plain, np.uint32)])
    return b"".join([struct.pack("<4I", MAGIC, VERSION, len(header), zlib.crc32(header)), header, *blocks])


class Reader:
    """A file's documents and checkpoints; its blocks decode on demand, each from its own bytes."""

    def __init__(self, blob: bytes | Callable[[int, int], bytes], size: int | None = None) -> None:
        """blob: the file's bytes, or what fetches those from one place up to another of a file of `size` bytes."""
        self._fetch = blob if callable(blob) else lambda a, b: blob[a:b]
        self._size = size if callable(blob) else len(blob)
        if self._size < 16:
            raise FormatError("too short")
        magic, version, n, crc = struct.unpack("<4I", self._fetch(0, 16))
        if magic != MAGIC or version != VERSION:
            raise FormatError("not a file of this format")
        header = self._fetch(16, 16 + n)
        if zlib.crc32(header) != crc:
            raise FormatError("the header is damaged")
        steps, self.lengths, self.symbols, freq, self.offsets, self.counts, self.sums, self.plain = _unpack(header, _KINDS)
        self.doc_ids = np.cumsum(steps)
        self._body = 16 + n
        self._freq = freq.astype(np.uint64)
        self._start = np.cumsum(self._freq) - self._freq if len(freq) else self._freq
        self._slot_of = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))

    def block(self, k: int) -> np.ndarray:
        end = self._body + int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else self._size
        blob = bytes(self._fetch(self._body + int(self.offsets[k]), end))
        if zlib.crc32(blob) != self.sums[k]:
            raise FormatError(f"block {k} is damaged")
        tokens = self.symbols[_decode(blob, int(self.counts[k]), self._freq, self._start, self._slot_of)]
        if zlib.crc32(tokens.tobytes()) != self.plain[k]:
            raise FormatError(f"block {k} decodes to other symbols")
        return tokens

    def tokens(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.offsets))]) if len(self.offsets) else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        ends, all_tokens = np.cumsum(self.lengths, dtype=np.int64), self.tokens()
        for doc, end, n in zip(self.doc_ids, ends, self.lengths, strict=True):
            yield int(doc), all_tokens[end - n : end]
