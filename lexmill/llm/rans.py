"""Static range asymmetric numeral system over blocks of ids.

A shared frequency table gives each id a share of 2^bits slots. A block's ids are dealt over LANES interleaved states,
which all use one stream of 32-bit words, so a step codes LANES ids of each of many blocks at once. A block needs nothing
but the table: it holds its words, the states it starts with and a checksum of its ids, and every STRIDE ids a checkpoint
(states and place in the stream), from which decoding may also begin. All stretches of all blocks of a batch are decoded
side by side.

A block's bytes, little-endian: `RANS`, version (uint16), lanes (uint16), stride (uint32), ids (uint32), words (uint32),
crc32 of the ids as 32-bit numbers (uint32), fingerprint of the table (uint32); then for each stretch the place in the
stream (uint32) and the states (uint64 each); then the words (uint32 each).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STRIDE = 32, 1 << 13
MAGIC, VERSION = b"RANS", 1
_HEADER = struct.Struct("<4sHHIIIII")
#: States lie in [LOW, LOW << 32).
LOW_BITS = 31
LOW = np.uint64(1 << LOW_BITS)
_WORD, _MASK = np.uint64(32), np.uint64(0xFFFFFFFF)


class Table:
    """Shares of 2^bits slots of the ids 0 to len(counts) - 1; ids that never occur have none and can't be coded."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64) if len(freq) else np.empty(0, np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
        self.fingerprint = zlib.crc32(freq.astype("<u4").tobytes(), bits)

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """The table of counts by id: every id that occurs has a slot at least, the others by share, rounded by largest remainder."""
        counts = np.asarray(counts, np.int64)
        live = np.flatnonzero(counts)
        bits = max(12, int(max(1, len(live)) - 1).bit_length() + 4)
        if bits > 24:
            raise ValueError("more than 2^20 different ids")
        freq = np.zeros(len(counts), np.int64)
        if len(live):
            spare = (1 << bits) - len(live)
            exact = counts[live] / counts[live].sum() * spare
            share = np.floor(exact).astype(np.int64)
            rest = spare - int(share.sum())
            order = np.lexsort((live, share - exact))
            share[order[:rest]] += 1
            freq[live] = share + 1
        return cls(freq, bits)

    def tobytes(self) -> bytes:
        return struct.pack("<I", self.bits) + self.freq.astype("<u4").tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> Table:
        return cls(np.frombuffer(raw, "<u4", offset=4).astype(np.int64), struct.unpack_from("<I", raw)[0])


def encode(blocks: list[np.ndarray], table: Table, lanes: int = LANES, stride: int = STRIDE) -> list[bytes]:
    """The bytes of each block of ids. stride is a multiple of lanes."""
    if not blocks:
        return []
    size = np.array([len(b) for b in blocks], np.int64)
    steps = max(1, -(-int(size.max(initial=0)) // lanes))
    ids = np.zeros((len(blocks), steps * lanes), np.int64)
    for b, x in zip(ids, blocks, strict=True):
        b[: len(x)] = x
    if ids.max(initial=0) >= len(table.freq) or any((table.freq[x] == 0).any() for x in blocks if len(x)):
        raise ValueError("an id that the table doesn't have")
    ids = np.ascontiguousarray(ids.reshape(len(blocks), steps, lanes).transpose(1, 0, 2)).reshape(steps, -1)  # a row a step
    live = (np.arange(steps)[:, None] * lanes + np.tile(np.arange(lanes), len(blocks))) < np.repeat(size, lanes)
    full = live.all(axis=1)  # steps in which no state rests
    x = np.full(len(blocks) * lanes, LOW, np.uint64)
    bits, over = np.uint64(table.bits), np.uint64(LOW_BITS - table.bits + 32)
    emitted, words = np.zeros((steps, len(x)), bool), np.zeros((steps, len(x)), np.uint32)
    every, saved = stride // lanes, {}
    for j in range(steps - 1, -1, -1):
        f, c = table.freq.take(ids[j]), table.start.take(ids[j])
        if not full[j]:
            f = np.where(live[j], f, np.uint64(1))
        out = x >> over >= f
        if not full[j]:
            out &= live[j]
        emitted[j], words[j] = out, x
        np.right_shift(x, _WORD, out=x, where=out)
        q = x // f
        new = (q << bits) + (x - q * f) + c
        x = new if full[j] else np.where(live[j], new, x)
        if j % every == 0:
            saved[j // every] = x.reshape(len(blocks), lanes).copy()
    emitted, words = emitted.reshape(steps, len(blocks), lanes), words.reshape(steps, len(blocks), lanes)
    ahead = np.concatenate((np.zeros((1, len(blocks)), np.int64), np.cumsum(emitted.sum(axis=2), axis=0)))  # words before each step
    made = []
    for b, n in enumerate(size.tolist()):
        stream = words[:, b][emitted[:, b]].astype("<u4")
        raw = [_HEADER.pack(MAGIC, VERSION, lanes, stride, n, len(stream), zlib.crc32(np.asarray(blocks[b]).astype("<u4").tobytes()), table.fingerprint)]
        for k in range(-(-n // stride)):
            raw += [struct.pack("<I", int(ahead[k * every, b])), saved[k][b].astype("<u8").tobytes()]
        made.append(b"".join([*raw, stream.tobytes()]))
    return made


class Block:
    """A parsed block: its header, checkpoints and words."""

    def __init__(self, raw: bytes, table: Table):
        if len(raw) < _HEADER.size:
            raise ValueError("a block is cut off")
        magic, version, self.lanes, self.stride, self.n, n_words, self.crc, fingerprint = _HEADER.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        if fingerprint != table.fingerprint:
            raise ValueError("a block of another table")
        stretches = -(-self.n // self.stride)
        kind = np.dtype([("at", "<u4"), ("x", "<u8", (self.lanes,))])
        end = _HEADER.size + stretches * kind.itemsize
        if len(raw) != end + 4 * n_words:
            raise ValueError("a block is cut off")
        points = np.frombuffer(raw, kind, stretches, _HEADER.size)
        self.at, self.states = points["at"].astype(np.int64), points["x"]
        self.words = np.frombuffer(raw, "<u4", n_words, end)


def decode(raws: list[bytes], table: Table, first: int = 0, last: int | None = None) -> list[np.ndarray]:
    """The ids of each block, or those of its stretches first to last - 1. Whole blocks are held against their checksum."""
    blocks = [Block(r, table) for r in raws]
    held = [(b, k) for b, x in enumerate(blocks) for k in range(first, len(x.at) if last is None else min(last, len(x.at)))]
    if not held:
        return [np.empty(0, np.int32) for _ in blocks]
    lanes = blocks[held[0][0]].lanes
    if any(x.lanes != lanes for x in blocks):
        raise ValueError("blocks of different lanes")
    stream = np.concatenate([x.words for x in blocks]).astype(np.uint64)
    if not len(stream):
        stream = np.zeros(1, np.uint64)
    origin = np.concatenate(([0], np.cumsum([len(x.words) for x in blocks])))
    size = np.array([min(blocks[b].stride, blocks[b].n - k * blocks[b].stride) for b, k in held])
    at = np.array([origin[b] + blocks[b].at[k] for b, k in held])
    x = np.stack([blocks[b].states[k] for b, k in held]).astype(np.uint64)
    steps = -(-int(size.max()) // lanes)
    out = np.empty((steps, len(held), lanes), np.int32)
    bits, mask, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), LOW
    for j in range(steps):
        on = (j * lanes + np.arange(lanes)) < size[:, None]
        slot = x & mask
        s = table.slots.take(slot.astype(np.int64))
        new = table.freq.take(s) * (x >> bits) + slot - table.start.take(s)
        need = on & (new < low)
        rank = np.cumsum(need, axis=1)
        word = stream.take(at[:, None] + rank - 1, mode="clip")
        x = np.where(on, np.where(need, new << _WORD | word, new), x)
        at += rank[:, -1]
        out[j] = s
    flat = out.transpose(1, 0, 2).reshape(len(held), -1)
    result = [[] for _ in blocks]
    for (b, _), row, n in zip(held, flat, size.tolist(), strict=True):
        result[b].append(row[:n])
    done = [np.concatenate(r) if r else np.empty(0, np.int32) for r in result]
    if first == 0 and last is None:
        # a block's last stretch ends in the states that its coding began with
        ends = np.array([k + 1 == len(blocks[b].at) for b, k in held])
        if (x[ends] != LOW).any():
            raise ValueError("a block's words don't end as they should")
        for block, ids in zip(blocks, done, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != block.crc:
                raise ValueError("a block's checksum doesn't match its ids")
    return done
