"""An adaptive context-mixing range coder for token ids.

Three predictions are mixed for every id: how often ids occur (order 0), the id that mostly
follows the one before (order 1), and the id that last followed the two before (order 2).
The mixed probability of an id is the sum of what each gives it, weighted; the weights are
learned as ids go by, in the context of how sure orders 1 and 2 are. Orders 0 and 1 start
from the prior of a run of blocks, which is written beside them; order 2 and the weights start
empty. Every block starts afresh from there, so with the prior each decodes by itself. All
arithmetic is on integers, so blocks decode alike everywhere.

Blocks are coded in lockstep, one lane each, so that numpy does each step for all of them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Weights are in 1024ths; the range is kept above 2**28 and 32 bits leave it at a time.
_WEIGHT_BITS, _LOW_BITS, _EMIT = 10, 28, 32
#: Places of a block's order-2 memory, and bits of how often one was right lately.
_SLOTS, _TRUST = 512, 2
_RANK_BITS = 24
#: Steps between two looks at the room for coded words; a step leaves one of them as a rule, two at most.
_ROOM = 64
_U = np.uint64
i32 = np.int32


@dataclass
class Prior:
    """The ids of a run in order, and by their rank: frequency, follower and how sure it is (0 to 3)."""

    ids: np.ndarray
    frequency: np.ndarray
    follower: np.ndarray
    sure: np.ndarray

    def __post_init__(self):
        self.bits = _scale(len(self.ids))
        self.start = np.concatenate([[0], np.cumsum(self.frequency)]).astype(i32)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Prior, np.ndarray]:
        """The prior of these ids, and their ranks."""
        counts = np.bincount(ids)
        present = np.flatnonzero(counts)
        rank = np.zeros(len(counts), i32)
        rank[present] = np.arange(len(present), dtype=i32)
        ranks = rank.take(ids)
        counts = counts[present]
        whole = 1 << _scale(len(present))
        frequency = 1 + counts * (whole - len(present)) // max(1, len(ids))
        if len(present):
            frequency[counts.argmax()] += whole - frequency.sum()
        follower, sure = _followers(ranks, len(present))
        return cls(present.astype(np.int64), frequency.astype(i32), follower, sure), ranks

    def dump(self) -> bytes:
        columns = (np.diff(self.ids, prepend=0), self.frequency, self.follower, self.sure)
        return zlib.compress(np.concatenate([np.asarray(c, "<u4") for c in columns]).tobytes())

    @classmethod
    def load(cls, data: bytes) -> Prior:
        gaps, frequency, follower, sure = np.frombuffer(zlib.decompress(data), "<u4").reshape(4, -1)
        return cls(np.cumsum(gaps, dtype=np.int64), frequency.astype(i32), follower.astype(i32), sure.astype(i32))


def _followers(ranks: np.ndarray, present: int) -> tuple[np.ndarray, np.ndarray]:
    """What most often follows each of the ``present`` ranks (of equals the least), and how sure it is, by all pairs of the run."""
    follower, sure = np.zeros(present, i32), np.zeros(present, i32)
    if len(ranks) < 2:
        return follower, sure
    # a pair is one number, of 32 bits if ranks have 16: sorting these is half the work
    wide, bits = (np.uint32, 16) if present <= 1 << 16 else (np.uint64, 32)
    pairs = ranks[:-1].astype(wide)
    pairs <<= wide(bits)
    pairs |= ranks[1:].view(np.uint32)
    pairs.sort()
    begins = _heads(pairs)
    n = np.diff(begins, append=len(pairs)).astype(i32)
    pairs = pairs[begins]
    del begins
    before = pairs >> wide(bits)
    first = _heads(before)
    most = np.flatnonzero(n == np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(n))))
    best = most[_heads(before[most])]
    follower[before[best]] = pairs[best] & wide((1 << bits) - 1)
    sure[before[best]] = np.minimum(3, 6 * n[best].astype(np.int64) // np.add.reduceat(n, first, dtype=np.int64))
    return follower, sure


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where each different number begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))


def _scale(ids: int) -> int:
    """Bits of the frequencies' total: each of so many ids has one at least."""
    if ids >= 1 << 19:
        raise ValueError("a run holds more different ids than the coder's range")
    return max(16, ids.bit_length() + 1)


class _Mixer:
    """What the blocks of ``lanes`` have learned, side by side."""

    def __init__(self, prior: Prior, lanes: int):
        self.prior, self.bits, self.lanes = prior, prior.bits, lanes
        lane = np.arange(lanes, dtype=i32)
        self.memory = np.zeros(lanes * _SLOTS, i32)  # rank of what followed, trust above
        self.memory_base = lane * i32(_SLOTS)
        # shares of order 2 and of order 1, each of 2**15, for each trust and sureness
        self.share2, self.share1 = np.full(lanes * 16, 4000, i32), np.full(lanes * 16, 2000, i32)
        self.share_base = lane * i32(16)
        self.total = i32(1 << _WEIGHT_BITS)

    def place(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Where order 2 remembers what follows these."""
        return (((one * i32(0x9E35) + two * i32(0x6A4B)) >> i32(4)) & i32(_SLOTS - 1)) + self.memory_base

    def weigh(self, place: np.ndarray, sure: np.ndarray) -> None:
        self.at, e = place, self.memory.take(place)
        self.guess, self.trust = e & i32((1 << _RANK_BITS) - 1), e >> i32(_RANK_BITS)
        self.context = self.share_base + (self.trust << i32(2)) + sure
        self.p2, self.p1 = self.share2.take(self.context), self.share1.take(self.context)
        self.w2, self.w1 = (self.p2 >> i32(6)) + i32(1), (self.p1 >> i32(6)) + i32(1)
        self.w0 = self.total - self.w2 - self.w1

    def learn(self, rank: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        # shares stay below 30000 and 2**15 - 30000 - 300, so every weight stays positive
        only1 = right1 & ~right2
        self.share2[self.context] = self.p2 + ((right2 * i32(30000) - self.p2) >> i32(4))
        self.share1[self.context] = self.p1 + ((only1 * (i32(32000) - self.p2) - self.p1) >> i32(4))
        trust = np.where(right2, np.minimum(self.trust + i32(1), i32((1 << _TRUST) - 1)), self.trust >> i32(1))
        self.memory[self.at] = rank | (trust << i32(_RANK_BITS))


def encode_blocks(ranks: np.ndarray, prior: Prior) -> list[bytes]:
    """Coded bytes of each row of ranks."""
    lanes, width = ranks.shape
    mixer, bits = _Mixer(prior, lanes), i32(prior.bits)
    shift = _U(prior.bits + _WEIGHT_BITS)
    low, span = np.zeros(lanes, _U), np.full(lanes, 1 << 60, _U)
    words = np.zeros((lanes, width // 3 + 2 * _ROOM), _U)  # grows where ids are hard to tell
    used = np.zeros(lanes, np.int64)
    columns = np.ascontiguousarray(ranks.T.astype(i32))
    one = two = np.zeros(lanes, i32)
    for t in range(width):
        if t % _ROOM == 0 and int(used.max()) + 2 * _ROOM > words.shape[1]:
            words = np.concatenate([words, np.zeros((lanes, width // 3 + 2 * _ROOM), _U)], axis=1)
        rank = columns[t]
        mixer.weigh(mixer.place(one, two), prior.sure.take(one))
        guess1, guess2, w1, w2 = prior.follower.take(one), mixer.guess, mixer.w1, mixer.w2
        right1, right2 = guess1 == rank, guess2 == rank
        start = mixer.w0 * prior.start.take(rank) + ((w2 * (guess2 < rank) + w1 * (guess1 < rank)) << bits)
        wide = mixer.w0 * prior.frequency.take(rank) + ((w2 * right2 + w1 * right1) << bits)
        unit = span >> shift
        low += unit * start.astype(_U)
        span = unit * wide.astype(_U)
        small = np.flatnonzero(span < _U(1 << _LOW_BITS))
        while len(small):
            part = low.take(small)
            words[small, used[small]] = part >> _U(_LOW_BITS)
            low[small] = (part & _U((1 << _LOW_BITS) - 1)) << _U(_EMIT)
            span[small] <<= _U(_EMIT)
            used[small] += 1
            small = small[span[small] < _U(1 << _LOW_BITS)]
        mixer.learn(rank, right2, right1)
        two, one = one, rank
    rows = np.arange(lanes)
    words = np.concatenate([words[:, : int(used.max(initial=0)) + 1], np.zeros((lanes, 2), _U)], axis=1)
    for _ in range(2):
        words[rows, used] = low >> _U(_LOW_BITS)
        low = (low & _U((1 << _LOW_BITS) - 1)) << _U(_EMIT)
        used += 1
    for k in range(int(used.max(initial=1)) - 1, 0, -1):  # carries run towards the front
        words[:, k - 1] += words[:, k] >> _U(32)
    out = words.astype("<u4")
    return [out[i, : used[i]].tobytes() for i in range(lanes)]


def decode_blocks(coded: list[bytes], width: int, prior: Prior) -> np.ndarray:
    """The first ``width`` ranks of each block."""
    lanes = len(coded)
    mixer, bits = _Mixer(prior, lanes), i32(prior.bits)
    shift, top = _U(prior.bits + _WEIGHT_BITS), _U((1 << (prior.bits + _WEIGHT_BITS)) - 1)
    rank_of = np.repeat(np.arange(len(prior.ids), dtype=i32), prior.frequency)
    last = i32((1 << prior.bits) - 1)
    rows = [np.frombuffer(b, "<u4") for b in coded]
    words = np.zeros((lanes, max(map(len, rows), default=0) + 4), _U)
    for i, r in enumerate(rows):
        words[i, : len(r)] = r
    # the window is 60 bits wide, so what follows it starts 4 bits before a word's end
    code = (words[:, 0] << _U(28)) | (words[:, 1] >> _U(4))
    words[:, :-1] = ((words[:, :-1] & _U(15)) << _U(28)) | (words[:, 1:] >> _U(4))
    long = words.shape[1] - 1
    used = np.ones(lanes, np.int64)
    span = np.full(lanes, 1 << 60, _U)
    out = np.empty((width, lanes), i32)
    one = two = np.zeros(lanes, i32)
    for t in range(width):
        mixer.weigh(mixer.place(one, two), prior.sure.take(one))
        guess1, guess2, w0, w1, w2 = prior.follower.take(one), mixer.guess, mixer.w0, mixer.w1, mixer.w2
        unit = span >> shift
        v = np.minimum(code // unit, top).astype(i32)
        # take away the guesses' own shares, the lower rank's first; what is left lies in order 0
        second = guess2 < guess1
        low_share, high_share = np.where(second, w2, w1) << bits, np.where(second, w1, w2) << bits
        v = np.maximum(np.minimum(v, w0 * prior.start.take(np.minimum(guess1, guess2))), v - low_share)
        v = np.maximum(np.minimum(v, w0 * prior.start.take(np.maximum(guess1, guess2))), v - high_share)
        rank = rank_of.take(np.minimum(v // w0, last))
        out[t] = rank
        right1, right2 = guess1 == rank, guess2 == rank
        start = w0 * prior.start.take(rank) + ((w2 * (guess2 < rank) + w1 * (guess1 < rank)) << bits)
        wide = w0 * prior.frequency.take(rank) + ((w2 * right2 + w1 * right1) << bits)
        code -= unit * start.astype(_U)
        span = unit * wide.astype(_U)
        small = np.flatnonzero(span < _U(1 << _LOW_BITS))
        while len(small):
            # lanes past their block's end may run on, as their ranks are not read
            code[small] = (code.take(small) << _U(_EMIT)) | words[small, np.minimum(used[small], long)]
            span[small] <<= _U(_EMIT)
            used[small] += 1
            small = small[span[small] < _U(1 << _LOW_BITS)]
        mixer.learn(rank, right2, right1)
        two, one = one, rank
    return out.T


def pack(ids: np.ndarray, block: int) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """The prior of a run of ids, and (ids, crc32 of the ids as little-endian 32-bit integers, coded bytes) of each block in turn."""
    prior, ranks = Prior.of(np.asarray(ids))
    n = -(-len(ids) // block)
    if not n:
        return prior.dump(), []
    padded = np.full((n, block), ranks[-1], i32)
    padded.reshape(-1)[: len(ids)] = ranks
    lengths = [*[block] * (n - 1), len(ids) - block * (n - 1)]
    coded = encode_blocks(padded, prior)
    plain = np.asarray(ids).astype("<u4")
    return prior.dump(), [(k, zlib.crc32(plain[i * block : i * block + k].tobytes()), c) for i, (k, c) in enumerate(zip(lengths, coded, strict=True))]


def unpack(prior: bytes, blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of blocks from ``pack``; a block that fails its checksum raises ValueError."""
    if not blocks:
        return np.zeros(0, "<u4")
    start = Prior.load(prior)
    ranks = decode_blocks([b[2] for b in blocks], max(b[0] for b in blocks), start)
    ids = start.ids.astype("<u4")
    out = []
    for (n, crc, _), row in zip(blocks, ranks, strict=True):
        row = ids.take(row[:n])
        if zlib.crc32(row.tobytes()) != crc:
            raise ValueError("a block does not match its checksum")
        out.append(row)
    return np.concatenate(out)
