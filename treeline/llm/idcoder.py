"""Adaptive context-mixing range coder for token ids, many blocks in lockstep.

Each block starts afresh from the file's table, so the blocks of a file are coded side by side: one step codes the next
id of every block with a few array operations. The probability of an id is the weighted sum of three predictions:

- order 0: frequencies of all ids. The table gives each id's share of its bucket, a run of neighbouring ids of about a
  64th of all; the buckets' own frequencies are counted in the block;
- order 1: the id that followed the last id when that was last seen in the block;
- order 2: the id that followed the last two ids (hashed) when those were last seen in the block.

Each point prediction has a confidence, the number of times in a row that it held. The weights of orders 1 and 2 are
learned in the block for each pair of confidences; order 0 has the rest. In id order
the cumulative weighted sum is order 0's, raised by each point's weight from that point on, so the sum is exact
whichever ids the points name, and a place in it leads back to its id without a search.

The sum drives a range coder with 64-bit state that puts out 32-bit words and carries into words already written.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Ids of a block, and blocks that are coded side by side.
BLOCK_IDS, LANES = 1024, 4096
#: Bits of a weight and of a bucket's frequency; buckets of equal weight that a table has at least, if it has as many ids.
_WEIGHT, _BUCKET, _BUCKETS = 8, 9, 64
#: Most distinct ids of a table; a file with more is stored without coding.
MOST_SYMBOLS = 1 << 21
#: Entries of a block's order-1 and order-2 memory. All state is kept in narrow types: it decides the speed how much of it a core's cache holds.
_ONE, _TWO = 256, 512
#: Steps between looks at the buckets' counts, what each bucket has before, in half counts, and the rate at which weights move.
_REBUILD, _PRIOR, _RATE = 128, 3, 5
_S32, _LOW = np.uint64(32), np.uint64(1 << 32)


@dataclass
class Table:
    """A file's ids in ascending order with their shares: of bucket b, ``first[b]`` to ``first[b + 1]``, they add up to 1 << bits."""

    symbols: np.ndarray
    shares: np.ndarray
    first: np.ndarray
    bits: int

    def __post_init__(self) -> None:
        sizes = np.diff(self.first)
        self.bucket = np.repeat(np.arange(len(sizes)), sizes)
        upto = np.cumsum(self.shares) - self.shares
        self.below = upto - (self.bucket << self.bits)
        if len(sizes) and not np.array_equal(np.add.reduceat(self.shares, self.first[:-1]), np.full(len(sizes), 1 << self.bits)):
            raise ValueError("shares do not add up")

    def packed(self) -> bytes:
        """The table's serial form: bits, buckets, symbols, then bucket sizes, gaps of the ids and shares, compressed."""
        head = np.array([self.bits, len(self.first) - 1, len(self.symbols)], "<u4").tobytes()
        gaps = np.diff(self.symbols, prepend=0)
        return head + zlib.compress(np.diff(self.first).astype("<u4").tobytes() + gaps.astype("<u4").tobytes() + self.shares.astype("<u2").tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Table:
        bits, buckets, n = np.frombuffer(data[:12], "<u4").astype(int)
        raw = zlib.decompress(data[12:])
        sizes, gaps = (np.frombuffer(raw[a:b], "<u4").astype(np.int64) for a, b in ((0, 4 * buckets), (4 * buckets, 4 * (buckets + n))))
        return cls(np.cumsum(gaps), np.frombuffer(raw[4 * (buckets + n) :], "<u2").astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]), int(bits))


def table_of(ids: np.ndarray) -> tuple[Table | None, np.ndarray]:
    """(the table of ``ids``, each id's place in it); None for more than MOST_SYMBOLS distinct ids."""
    if not len(ids):
        return Table(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), 12), np.zeros(0, np.int64)
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        places = (np.cumsum(counts > 0) - 1)[ids]
        counts = counts[symbols]
    else:
        symbols, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
    n = len(symbols)
    if n > MOST_SYMBOLS:
        return None, places
    widest = max(2048, -(-n // 256))
    bits = max(12, int(2 * widest - 1).bit_length())
    # A bucket ends where its part of the total is reached, or where it holds the most ids.
    fill = (np.cumsum(counts) - counts) * _BUCKETS // int(counts.sum())
    starts = np.flatnonzero(np.diff(fill, prepend=-1))
    sizes = np.diff(np.append(starts, n))
    first = np.concatenate([s + np.arange(0, k, widest) for s, k in zip(starts, sizes, strict=True)] + [[n]])
    sums = np.add.reduceat(counts, first[:-1])
    own = np.repeat(np.arange(len(sums)), np.diff(first))
    room = (1 << bits) - np.diff(first)[own]
    shares = 1 + counts * room // sums[own]
    # What rounding leaves goes to the first of the most frequent ids of the bucket.
    lack = (1 << bits) - np.add.reduceat(shares, first[:-1])
    shares[[a + int(counts[a:b].argmax()) for a, b in zip(first[:-1], first[1:], strict=True)]] += lack
    return Table(symbols.astype(np.int64), shares.astype(np.int64), first.astype(np.int64), bits), places


class _Model:
    """The state of ``lanes`` blocks side by side. Ids are places in the table, as ``kind``; parts of the sum are ``wide``."""

    def __init__(self, table: Table, lanes: int, *, decoding: bool = False) -> None:
        n, self.buckets, self.bits, self.decoding = len(table.symbols), len(table.first) - 1, table.bits, decoding
        self.shift = _BUCKET + table.bits
        self.total = _WEIGHT + self.shift
        self.kind, self.wide = np.uint16 if n <= 1 << 14 else np.uint32, np.int32 if self.total < 31 else np.int64
        self.bucket, self.hash = table.bucket, (np.arange(n) * 40503 >> 2) & 0xFFFF
        self.below, self.shares = table.below.astype(self.wide), table.shares.astype(self.wide)
        if decoding:
            # The id at each place of each bucket.
            self.at_share = np.repeat(np.arange(n), table.shares)
            self.each = np.tile(np.arange(self.buckets, dtype=np.uint8 if self.buckets <= 256 else np.uint16), lanes)
        self.count = np.zeros(lanes * self.buckets, np.int64)
        self.places = np.zeros((_REBUILD, lanes), np.int32)  # the buckets' places of the last steps
        self.one, self.two = np.zeros(lanes * _ONE, self.kind), np.zeros(lanes * _TWO, self.kind)  # id << 2 | confidence
        start = np.array([0.01, 0.1, 0.25, 0.5])
        two, one = np.repeat(start, 4), np.tile(start, 4)
        one = one * (1 - two)
        self.weights = np.tile((two * 65280).astype(np.uint32) << 16 | (one * 65280).astype(np.uint32), lanes)
        self.last = self.before = np.zeros(lanes, np.int64)
        self.row = np.arange(lanes)
        self.step = 0
        self._bases()

    def _bases(self) -> None:
        self.base_b, self.base_1, self.base_2, self.base_w, self.base_p = (self.row * k for k in (self.buckets, _ONE, _TWO, 16, 1 << _BUCKET))

    def shorten(self, lanes: int) -> None:
        """Go on with the first ``lanes`` blocks."""
        self.row, self.last, self.before = self.row[:lanes], self.last[:lanes], self.before[:lanes]
        self._bases()

    def _rebuild(self) -> None:
        if self.step:  # a block that is done keeps its last places: its counts are not looked at any more
            self.count += np.bincount(self.places.ravel(), minlength=len(self.count))
        # Rounded cumulative sums: each frequency is one at least, and all add up.
        upto = np.cumsum(2 * self.count.reshape(-1, self.buckets) + _PRIOR, 1)
        upto = upto * ((1 << _BUCKET) - self.buckets) // upto[:, -1:] + np.arange(1, self.buckets + 1)
        freq = upto.copy()
        freq[:, 1:] -= upto[:, :-1]
        self.freq = ((upto - freq) << 16 | freq).astype(np.int32).ravel()  # what lies below a bucket << 16 | its frequency
        if self.decoding:  # the bucket at each place of each block
            self.at_place = np.repeat(self.each, freq.ravel())

    def predict(self) -> None:
        if self.step % _REBUILD == 0:
            self._rebuild()
        self.seen = self.places[self.step % _REBUILD, : len(self.row)]
        self.step += 1
        self.i1 = self.base_1 + (self.last * _ONE >> 16)
        self.i2 = self.base_2 + (((self.last >> 7) ^ (self.before >> 4)) & (_TWO - 1))
        self.e1, self.e2 = self.one.take(self.i1), self.two.take(self.i2)
        self.id1, self.id2 = self.e1 >> 2, self.e2 >> 2
        self.j = self.base_w + ((self.e2 & 3) << 2 | (self.e1 & 3))
        self.q = self.weights.take(self.j)
        a, b = (self.q >> 8 & 255).astype(self.wide), (self.q >> 24).astype(self.wide)
        self.w0 = 256 - a - b
        self.a, self.b = a << self.shift, b << self.shift

    def _order0(self, x: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where order 0's part of the ids ``x`` starts, frequencies of their buckets), both times the weight of order 0."""
        both = both.astype(self.wide, copy=False)
        freq = (both & 0xFFFF) * self.w0
        below = (both >> 16) * self.w0
        below <<= self.bits
        below += freq * self.below.take(x)
        return below, freq

    def interval(self, x: np.ndarray, own: np.ndarray, both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(start, width), in 2^total parts, of each block's next id; ``own`` is ``x`` as ``kind``."""
        if both is None:
            at = self.base_b + self.bucket.take(x)
            self.seen[:] = at
            both = self.freq.take(at)
        self.hit1, self.hit2 = own == self.id1, own == self.id2
        start, freq = self._order0(x, both)
        start += self.a * (own > self.id1)
        start += self.b * (own > self.id2)
        width = freq * self.shares.take(x)
        width += self.a * self.hit1
        width += self.b * self.hit2
        return start, width

    def find(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids whose intervals hold ``part``, what their buckets have below them and their frequencies)."""
        # Each point's weight is taken out from where it begins, so that order 0's parts are left.
        x = self.id1.astype(np.int64)
        past = part - self._order0(x, self.freq.take(self.base_b + self.bucket.take(x)))[0]
        past -= self.b * (self.id1 > self.id2)
        np.maximum(past, 0, out=past)
        part = part - np.minimum(past, self.a, out=past)
        x = self.id2.astype(np.int64)
        past = part - self._order0(x, self.freq.take(self.base_b + self.bucket.take(x)))[0]
        np.maximum(past, 0, out=past)
        part -= np.minimum(past, self.b, out=past)
        # Both sides are exact as doubles and the quotients are far from rounding up to the next whole number.
        v = (part / self.w0).astype(np.int64)
        bucket = self.at_place.take(self.base_p + (v >> self.bits))
        at = self.base_b + bucket
        self.seen[:] = at
        both = self.freq.take(at)
        share = ((v - (both >> 16 << self.bits)) / (both & 0xFFFF)).astype(np.int64)
        share += bucket.astype(np.int64) << self.bits
        return self.at_share.take(share), both

    def learn(self, x: np.ndarray, own: np.ndarray) -> None:
        fresh = own << 2
        self.one[self.i1] = np.where(self.hit1, np.minimum(self.e1 + 1, self.e1 | 3), fresh)
        self.two[self.i2] = np.where(self.hit2, np.minimum(self.e2 + 1, self.e2 | 3), fresh)
        # Towards order 2 where it held, else towards order 1 where that did: their sum stays under one.
        gain = (self.hit2 * np.uint32(65280 >> _RATE << 16)) + ((self.hit1 > self.hit2) * np.uint32(65280 >> _RATE))
        self.weights[self.j] = self.q - (self.q >> _RATE & np.uint32(0x10001 * (0xFFFF >> _RATE))) + gain
        self.before, self.last = self.last, self.hash.take(x)


def encode_blocks(table: Table, places: np.ndarray) -> list[bytes]:
    """Each run of BLOCK_IDS ids, given by their places in the table, as a coded block."""
    cut = [places[at : at + BLOCK_IDS] for at in range(0, len(places), BLOCK_IDS)]
    return [b for at in range(0, len(cut), LANES) for b in _encode(table, cut[at : at + LANES])]


def _encode(table: Table, blocks: list[np.ndarray]) -> list[bytes]:
    """Only the last block may be shorter."""
    lanes, longest, shortest = len(blocks), len(blocks[0]), len(blocks[-1])
    model = _Model(table, lanes)
    flat = np.zeros(lanes * longest, model.kind)
    flat[: (lanes - 1) * longest + shortest] = np.concatenate(blocks)
    grid = np.ascontiguousarray(flat.reshape(lanes, longest).T)
    total = np.uint64(model.total)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    wide = longest + 4  # a step puts out one word at most
    out, at = np.zeros(lanes * wide, np.uint32), np.arange(lanes) * wide + 1
    all_low, all_at = low, at

    def carry(places: np.ndarray) -> None:
        while len(places):
            out[places] += np.uint32(1)
            places = places[out[places] == 0] - 1

    for step in range(longest):
        if step == shortest:
            model.shorten(lanes - 1)
            low, span, at = low[:-1], span[:-1], at[:-1]
        own = grid[step, : len(low)]
        x = own.astype(np.int64)
        model.predict()
        start, width = model.interval(x, own)
        part = span >> total
        add = part * start.astype(np.uint64)
        low += add
        over = low < add
        if np.count_nonzero(over):
            carry(at[over] - 1)
        np.multiply(part, width.astype(np.uint64), out=span)
        need = (span < _LOW).nonzero()[0]
        if len(need):
            l, k = low.take(need), at.take(need)
            out[k] = l >> _S32
            at[need] = k + 1
            low[need] = l << _S32
            span[need] = span.take(need) << _S32
        model.learn(x, own)
    # A multiple of 2^32 lies in every span; what follows the last word reads as zeros.
    end = all_low + (_LOW - np.uint64(1))
    carry(all_at[end < all_low] - 1)
    out[all_at] = end >> _S32
    return [out[i * wide : n + 1].astype("<u4").tobytes() for i, n in enumerate(all_at.tolist())]


def decode_blocks(table: Table, blocks: list[bytes], counts: list[int]) -> np.ndarray:
    """The places in the table of all blocks' ids, ``counts`` of them in each; only the last may be shorter."""
    parts = [_decode(table, blocks[at : at + LANES], counts[at : at + LANES]) for at in range(0, len(blocks), LANES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _decode(table: Table, blocks: list[bytes], counts: list[int]) -> np.ndarray:
    lanes, longest, shortest = len(blocks), counts[0], counts[-1]
    words = [np.frombuffer(b, "<u4") for b in blocks]
    wide = max(longest + 4, *(len(w) + 2 for w in words))
    data = np.zeros((lanes, wide), np.uint64)
    for i, w in enumerate(words):
        data[i, : len(w)] = w
    # The first word takes the carries of the coder's start.
    flat, at = data.ravel(), np.arange(lanes) * wide + 3
    code = (data[:, 1] << _S32) | data[:, 2]
    span = np.full(lanes, (1 << 64) - 1, np.uint64)
    model = _Model(table, lanes, decoding=True)
    total, most = np.uint64(model.total), np.uint64((1 << model.total) - 1)
    grid = np.zeros((longest, lanes), model.kind)
    for step in range(longest):
        if step == shortest:
            model.shorten(lanes - 1)
            code, span, at = code[:-1], span[:-1], at[:-1]
        model.predict()
        part = span >> total
        x, both = model.find(np.minimum(code // part, most).astype(model.wide))
        own = grid[step, : len(x)]
        own[:] = x
        start, width = model.interval(x, own, both)
        code -= part * start.astype(np.uint64)
        np.multiply(part, width.astype(np.uint64), out=span)
        need = (span < _LOW).nonzero()[0]
        if len(need):
            k = at.take(need)
            code[need] = code.take(need) << _S32 | flat.take(k)
            at[need] = k + 1
            span[need] = span.take(need) << _S32
        model.learn(x, own)
    return np.ascontiguousarray(grid.T).ravel()[: (lanes - 1) * longest + shortest]
