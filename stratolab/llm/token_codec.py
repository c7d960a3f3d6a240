"""A range coder for token ids with adaptive context mixing, many lanes of a block in lockstep.

A segment is cut into blocks of up to BLOCK ids. Coder and model start afresh in
each, and each has a CRC-32, so a block can be decoded, or found damaged, by itself.
It begins with the set of its ids, which are then numbered without gaps. They are
dealt to lanes, runs of consecutive ids that are coded side by side: one numpy
call does one step for all lanes, and all learn one model. Per id, with the two ids
before it as context:

1. Order 0 is a count of every id, order 1 predicts two ids, order 2 one, each with a
   confidence: how often it came true lately.
2. The distributions are mixed. The weights of the four predictions stand in
   a row chosen by the confidences and by which predictions agree; a row counts which
   of them explained the ids coded under it. An id's probability is the weighted sum
   over all orders, so a predicted id has its share of order 0 as well.
3. The sum is an interval on the line of ids, cut out of the lane's range exactly, in
   integers.

All counts adapt as coding goes on, and the decoder repeats every step.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"SLTOK2\0\0"
BLOCK = 1 << 22
IDS = 1 << 16
LANES, LEAST_STEPS = 8192, 256
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 40)
_FULL = np.uint64((1 << 64) - 1)
_S16, _S48 = np.uint64(16), np.uint64(48)
_LOW16 = 0xFFFF
_SUM0, _WEIGHTS = 1 << 18, 1 << 12  # of order 0's shares and of a row's weights; the product stays far below _BOT
_CONTEXTS2 = 1 << 18
_ROWS = 1024  # trust in order 2 (3 bits) and in order 1's predictions (3 and 2 bits), and which of them agree (2)
_ROW_MOST = 4000


def _order2_moves() -> np.ndarray:
    """By trust and whether the prediction held: new trust above 16 bits that are set to keep the predicted id."""
    moves = []
    for t in range(8):
        moves += [(t >> 1) << 16 | (_LOW16 if t else 0), min(t + 1, 7) << 16 | _LOW16]
    return np.array(moves, np.int32)


def _order1_moves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By trust in the second and first prediction and which held: new trust, and masks to replace the second and to swap."""
    trust, replace, swap = [], [], []
    for v in range(4):
        for u in range(8):
            for held in range(4):  # 0 none, 1 the first, 2 the second
                a, b = u, v
                if held == 0:
                    a, b = max(u - 1, min(u, 1)), 0
                elif held == 1:
                    a = min(u + 1, 7)
                else:
                    b = min(v + 1, 3)
                turned = held == 2 and b >= a
                trust.append((a << 3 | b << 6) if not turned else (b << 3 | min(a, 3) << 6))
                replace.append(0 if held else _LOW16)
                swap.append(_LOW16 if turned else 0)
    return np.array(trust, np.int64) << 32, np.array(replace, np.int32), np.array(swap, np.int32)


_MOVES2 = _order2_moves()
_TRUST1, _REPLACE1, _SWAP1 = _order1_moves()


class _Model:
    """What a block has learned. Ids of a step are learned together, after all lanes have coded them.

    Where lanes share a context in a step, the last of them is what it learns.
    """

    def __init__(self, lanes: int, ids: int):
        self.ids = max(2, ids)
        self.counts = np.ones(self.ids, np.int64)
        self.order1 = np.full(self.ids, 1 << 16, np.int64)  # first, second << 16, trust << 32
        self.order2 = np.zeros(_CONTEXTS2, np.int32)  # predicted, trust << 16
        self.rows = np.tile(np.array([2, 2, 1, 3], np.int64), (_ROWS, 1))
        self.one = self.two = np.zeros(lanes, np.int32)
        self.met: list[np.ndarray] = []
        self.explained: list[np.ndarray] = []
        self.steps = 0
        self._share()
        self._weigh()

    def _share(self) -> None:
        """Order 0 takes in the ids met; shares of _SUM0 by count, none 0."""
        if self.met:
            self.counts += 32 * np.bincount(np.concatenate(self.met), minlength=self.ids)
            self.met.clear()
            while self.counts.sum() > 1 << 40:
                self.counts = (self.counts + 1) >> 1
        self.share = (1 + self.counts * (_SUM0 - self.ids) // int(self.counts.sum())).astype(np.int32)
        self.upto = np.cumsum(self.share, dtype=np.int32)
        self.total = int(self.upto[-1])
        self.named = np.repeat(np.arange(self.ids, dtype=np.int32), self.share)

    def _weigh(self) -> None:
        """Rows take in which prediction explained the ids; as weights they add up to _WEIGHTS, order 0's never 0."""
        if self.explained:
            met = np.bincount(np.concatenate(self.explained), minlength=8 * _ROWS).reshape(_ROWS, 8)
            self.explained.clear()
            # Bits: order 2 held, order 1's first, its second. The first of them to hold has explained the id.
            self.rows += 8 * np.stack((met[:, 1::2].sum(axis=1), met[:, 2] + met[:, 6], met[:, 4], met[:, 0]), axis=1)
            full = np.flatnonzero(self.rows.sum(axis=1) > _ROW_MOST)
            while len(full):
                self.rows[full] = (self.rows[full] + 1) >> 1
                full = full[self.rows[full].sum(axis=1) > _ROW_MOST]
        parts = (self.rows[:, :3] * (_WEIGHTS - 16) // self.rows.sum(axis=1)[:, None]).astype(np.int32)
        # Predictions that agree are one: the other has no weight of its own.
        parts[256:512, 1] = parts[512:768, 2] = 0
        self.weights = [np.ascontiguousarray(w) for w in (*parts.T, _WEIGHTS - parts.sum(axis=1, dtype=np.int32))]

    def predict(self) -> None:
        """Of every lane: predicted ids, order 2's, order 1's first and second, and the weights of these and of order 0."""
        self.at = (self.one * 509 ^ self.two * 30011) & (_CONTEXTS2 - 1)
        e1, e2 = self.order1.take(self.one), self.order2.take(self.at)
        pair = e1.astype(np.int32)
        self.a, self.b, self.c = e2 & _LOW16, pair & _LOW16, pair >> 16 & _LOW16
        self.t1, self.t2 = (e1 >> 32).astype(np.int32), e2 >> 16
        agree = (self.a == self.b).view(np.uint8) | (self.a == self.c).view(np.uint8) << 1
        self.row = self.t2 | self.t1 | agree.astype(np.int32) << 8
        self.w = [w.take(self.row) for w in self.weights]

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each lane's id on a line of total * _WEIGHTS: the weighted sum over all orders."""
        wa, wb, wc, w0 = self.w
        self.held = [ids == p for p in (self.a, self.b, self.c)]
        below = wa * (self.a < ids) + wb * (self.b < ids) + wc * (self.c < ids)
        here = wa * self.held[0] + wb * self.held[1] + wc * self.held[2]
        share = self.share.take(ids)
        return w0 * (self.upto.take(ids) - share) + below * self.total, w0 * share + here * self.total

    def at_place(self, value: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the places.

        An interval is its id's share of order 0 and then what predictions add.
        Taken out where it lies below the place, what they add leaves a place in order 0.
        """
        (wa, wb, wc, w0), a, b, c = self.w, self.a, self.b, self.c
        ab, ac, bc = a < b, a < c, b < c
        ab_a, ac_a, bc_b = wa * ab, wa * ac, wb * bc
        ab_b, ac_c, bc_c = wb - wb * ab, wc - wc * ac, wc - wc * bc
        rest = value.copy()
        for p, w, before in ((a, wa, ab_b + ac_c), (b, wb, ab_a + bc_c), (c, wc, ac_a + bc_b)):
            added = value - w0 * self.upto.take(p) - (before * self.total - 1)
            rest -= np.minimum(np.maximum(added, 0), w * self.total)
        return self.named.take(rest // w0)

    def learn(self, ids: np.ndarray) -> None:
        """After interval(ids)."""
        of2, first, second = (h.view(np.uint8) for h in self.held)
        self.explained.append(self.row << 3 | (of2 | first << 1 | second << 2))
        move = _MOVES2.take(self.t2 << 1 | of2)
        self.order2[self.at] = ids ^ ((ids ^ self.a) & move & _LOW16) | (move & ~_LOW16)
        move = self.t1 >> 1 | (first | second << 1)
        added = self.c ^ ((self.c ^ ids) & _REPLACE1.take(move))
        turned = (self.b ^ added) & _SWAP1.take(move)
        self.order1[self.one] = ((self.b ^ turned) | (added ^ turned) << 16).view(np.uint32) | _TRUST1.take(move)
        self.two, self.one = self.one, ids
        self.met.append(ids)
        self.steps += 1
        if self.steps & (self.steps - 1) == 0 or self.steps % 16 == 0:
            self._share()
        if self.steps < 16 or self.steps % 8 == 0:
            self._weigh()


class _Range:
    """Carryless range coders, one a lane; 16 bits leave or enter at a time."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _FULL)
        self.at = np.zeros(lanes, np.int64)

    def narrow(self, start: np.ndarray, width: np.ndarray) -> None:
        """Keep the given parts of all lanes' intervals, after part was set; shift out what is settled."""
        self.low += self.part * start.astype(np.uint64)
        self.range = self.part * width.astype(np.uint64)
        go = np.flatnonzero(self.range < _BOT)
        while len(go):
            low, span = self.low[go], self.range[go]
            # An interval across a border of the top bits is cut at it.
            cut = (np.uint64(0) - low) & (_BOT - np.uint64(1))
            span = np.where((low ^ (low + span)) < _TOP, span, cut) << _S16
            self.shift(go, low)
            self.low[go] = low << _S16
            self.range[go] = span
            go = go[span < _BOT]


class _Writer(_Range):
    def __init__(self, lanes: int, steps: int):
        super().__init__(lanes)
        self.width = 4 * steps + 8
        self.out = np.zeros(lanes * self.width, "<u2")
        self.base = np.arange(lanes) * self.width

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.at[lanes]
        self.out[self.base[lanes] + at] = low >> _S48
        self.at[lanes] = at + 1

    def finish(self) -> list[bytes]:
        """Each lane's words: the fewest more that name a number inside its interval; zeros follow."""
        value, words = self.low, np.full(len(self.low), 4)
        for n in (3, 2, 1):
            unit = np.uint64((1 << (64 - 16 * n)) - 1)
            up = (self.low + unit) & ~unit
            inside = (up >= self.low) & (up - self.low < self.range)
            value, words = np.where(inside, up, value), np.where(inside, n, words)
        for k in range(4):
            self.out[self.base + self.at + k] = value >> np.uint64(48 - 16 * k) & np.uint64(_LOW16)
        return [self.out[b : b + n].tobytes() for b, n in zip(self.base.tolist(), (self.at + words).tolist(), strict=True)]


class _Reader(_Range):
    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        super().__init__(len(sizes))
        self.words = np.append(words, np.uint16(0))
        self.end = np.cumsum(sizes)
        self.at = self.end - sizes
        self.code = np.zeros(len(sizes), np.uint64)
        for _ in range(4):
            self.code = self.code << _S16 | self.next(slice(None))

    def next(self, lanes) -> np.ndarray:
        """The lanes' next words, zeros behind their last."""
        at = self.at[lanes]
        words = np.where(at < self.end[lanes], self.words.take(at, mode="clip"), 0).astype(np.uint64)
        self.at[lanes] += 1
        return words

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        self.code[lanes] = self.code[lanes] << _S16 | self.next(lanes)


def _encoded(ids: np.ndarray, distinct: int) -> list[bytes]:
    """The lanes' words of ids (lanes x steps)."""
    lanes, steps = ids.shape
    model, coder = _Model(lanes, distinct), _Writer(lanes, steps)
    for now in np.ascontiguousarray(ids.T):
        model.predict()
        coder.part = coder.range // np.uint64(model.total * _WEIGHTS)
        coder.narrow(*model.interval(now))
        model.learn(now)
    return coder.finish()


def _decoded(words: np.ndarray, sizes: np.ndarray, steps: int, distinct: int) -> np.ndarray:
    """ids (lanes x steps) of the lanes' words. Damaged words give other ids, never an endless run."""
    lanes = len(sizes)
    model, coder = _Model(lanes, distinct), _Reader(words, sizes)
    out = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        model.predict()
        line = np.uint64(model.total * _WEIGHTS)
        coder.part = coder.range // line
        place = np.minimum((coder.code - coder.low) // coder.part, line - np.uint64(1))
        out[t] = now = model.at_place(place.astype(np.int32))
        coder.narrow(*model.interval(now))
        model.learn(now)
    return out.T


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids; the last lane may have more room than ids."""
    steps = min(n, max(LEAST_STEPS, -(-n // LANES)))
    return -(-n // steps), steps


def _block(ids: np.ndarray) -> bytes:
    lanes, steps = _shape(len(ids))
    present = np.bincount(ids, minlength=IDS) > 0
    number = np.cumsum(present, dtype=np.int32) - 1
    room = np.zeros(lanes * steps, np.int32)
    room[: len(ids)] = number.take(ids)
    coded = _encoded(room.reshape(lanes, steps), int(number[-1]) + 1)
    sizes = np.array([len(x) // 2 for x in coded], "<u4").tobytes()
    head = zlib.compress(np.packbits(present).tobytes() + sizes)
    words = b"".join(coded)
    return struct.pack("<IIII", len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(head), len(words)) + head + words


def encode_segment(ids: np.ndarray) -> bytes:
    """Magic, ids in all, block count, and blocks: ids, CRC-32, sizes, the set of ids and each lane's words, the words.

    ids are from 0 to 65535. An empty segment has no block.
    """
    ids = np.asarray(ids, dtype=np.int64)
    if len(ids) and not 0 <= ids.min() <= ids.max() < IDS:
        raise ValueError(f"ids are from 0 to {IDS - 1}")
    blocks = [_block(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
    return MAGIC + struct.pack("<QI", len(ids), len(blocks)) + b"".join(blocks)


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment, as <u4. Raises ValueError where a block fails its checksum."""
    if data[:8] != MAGIC:
        raise ValueError("not a token segment")
    count = struct.unpack_from("<QI", data, 8)[1]
    at, out = 20, []
    for k in range(count):
        n, crc, head, size = struct.unpack_from("<IIII", data, at)
        lanes, steps = _shape(n)
        try:
            info = zlib.decompress(data[at + 16 : at + 16 + head])
        except zlib.error as e:
            raise ValueError(f"block {k} is damaged") from e
        name = np.flatnonzero(np.unpackbits(np.frombuffer(info, np.uint8, IDS // 8)))
        sizes = np.frombuffer(info, "<u4", lanes, IDS // 8).astype(np.int64)
        words = np.frombuffer(data, "<u2", size // 2, at + 16 + head)
        ids = name.take(_decoded(words, sizes, steps, len(name)).reshape(-1)[:n], mode="clip").astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        out.append(ids)
        at += 16 + head + size
    return np.concatenate(out) if out else np.empty(0, "<u4")
