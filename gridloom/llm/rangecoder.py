"""Adaptive context-mixing range coder for token ids.

Ids are numbered by falling frequency, and a block of them is coded on its own, from a fresh state.  Two tables
remember the id that last followed the preceding two ids (order 2) and the preceding id (order 1), each with
one bit that says whether it was right the last time.  The order-0 prediction is the class of an id: the
binary length of its number.  For each state of the two bits, and of whether both orders agree, the coder
counts how often order 2 was right, else order 1, else each class: these counts, renewed every ``REFRESH``
ids, are the weights by which the three orders are mixed.  A range coder with 48-bit registers and carries
turns each id into an interval of that mixture, and the rest of a number inside its class into plain bits.

Many blocks are coded side by side, one per lane of a NumPy vector, because the steps of one block depend on
each other and those of different blocks do not.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Slots of the tables of order 1 and 2, as powers of two.
BITS1, BITS2 = 9, 10
#: Weight of an id in the counts, and ids between two renewals of the mixture.
GAIN, REFRESH = 16, 128
#: Sum of a mixture, as a power of two, and the columns of its table (one more than symbols, at least).
SCALE, WIDTH = 15, 32
STATES = 8
MASK48, TOP, WORD = U((1 << 48) - 1), U(1 << 32), U(16)


class _Mixture:
    """Tables and counts of ``lanes`` blocks; symbols: order 2, order 1, then one per class."""

    def __init__(self, lanes: int, prior: np.ndarray):
        self.lane = np.arange(lanes)
        self.size = len(prior) + 2
        kind = np.uint16 if len(prior) < 16 else np.int32  # ids of fewer than 16 classes, twice, fit
        self.t1 = np.zeros(lanes << BITS1, dtype=kind)
        self.t2 = np.zeros(lanes << BITS2, dtype=kind)
        self.at1, self.at2 = self.lane << BITS1, self.lane << BITS2
        start = np.zeros((STATES, self.size), dtype=np.int32)
        start[:, 2:] = 1 + 96 * prior.astype(np.int64) // max(1, int(prior.sum()))
        for state in range(STATES):  # a prediction that was right last time starts with more weight
            start[state, :2] = 200 if state & 4 else 8, 40 if state & 2 else 4
        self.counts = np.tile(start, (lanes, 1, 1))
        # Columns behind the last symbol are above every value.
        self.cum = np.full((lanes, STATES, WIDTH), 65535, dtype=np.uint16)
        self.cum[:, :, 0] = 0
        self.flat_cum = self.cum.reshape(-1)
        self.row, self.row_cum = self.lane * (STATES * self.size), self.lane * (STATES * WIDTH)
        self.history: list[np.ndarray] = []
        self.a = self.b = np.zeros(lanes, dtype=np.int64)

    def renew(self) -> None:
        if self.history:
            met = np.bincount(np.concatenate(self.history), minlength=self.counts.size)
            self.counts += (GAIN * met).astype(np.int32).reshape(self.counts.shape)
            self.history.clear()
        sums = np.cumsum(self.counts, axis=2)
        scale = ((1 << SCALE) - self.size) / sums[:, :, -1:]
        self.cum[:, :, 1 : self.size + 1] = (sums * scale).astype(np.uint16) + np.arange(1, self.size + 1, dtype=np.uint16)
        self.cum[:, :, self.size] = 1 << SCALE

    def predict(self, step: int) -> None:
        if step % REFRESH == 0 or step in (8, 16, 32, 64):
            self.renew()
        self.i1 = (self.a & ((1 << BITS1) - 1)) + self.at1
        self.i2 = ((self.a * 40503 + self.b >> 3) & ((1 << BITS2) - 1)) + self.at2
        e1, e2 = self.t1.take(self.i1, mode="clip"), self.t2.take(self.i2, mode="clip")
        self.c1, self.c2 = e1 >> 1, e2 >> 1
        self.state = ((e2 & 1) * 4 + (e1 & 1) * 2 + (self.c1 == self.c2)).astype(np.int64)

    def learn(self, ids: np.ndarray, new1: np.ndarray, new2: np.ndarray, sym: np.ndarray) -> None:
        """``new1`` and ``new2``: whether the order was wrong."""
        twice = ids * 2 + 1
        self.t1[self.i1] = twice - new1
        self.t2[self.i2] = twice - new2
        self.history.append(self.row + self.state * self.size + sym)
        self.b, self.a = self.a * 60493, ids.astype(np.int64)


def classes_of(n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every id: the binary length of id + 1, less one, and what is left of id + 1 below its highest bit."""
    number = np.arange(1, max(1, n_ids) + 1, dtype=np.int64)
    cls = np.frexp(number.astype(np.float64))[1].astype(np.int64) - 1
    return cls, (number - (1 << cls)).astype(U)


def class_counts(often: np.ndarray) -> np.ndarray:
    """How many ids are in each class, of the ids' frequencies, scaled to 16 bits."""
    cls, _ = classes_of(len(often))
    counts = np.bincount(cls[: len(often)], weights=often, minlength=max(1, len(often).bit_length())).astype(np.int64)
    return (counts * 65535 // max(1, int(counts.max()))).astype(np.uint16)


def _ordered(lengths: list[int]) -> tuple[list[int], np.ndarray]:
    """Lanes from the longest block to the shortest, so that the active ones stay together."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    return order, np.array([lengths[i] for i in order])


def encode_blocks(blocks: list[np.ndarray], n_ids: int, prior: np.ndarray) -> list[bytes]:
    """Code of each block of ids; ``prior`` are the class counts that every block starts from."""
    if not blocks:
        return []
    order, sizes = _ordered([len(b) for b in blocks])
    n, steps = len(blocks), int(sizes[0])
    data = np.zeros((n, max(steps, 1)), dtype=np.int32)
    for lane, i in enumerate(order):
        data[lane, : sizes[lane]] = blocks[i]
    data = np.ascontiguousarray(data.T)
    classes, rests = classes_of(n_ids)
    model = _Mixture(n, prior)
    low, rng = np.zeros(n, dtype=U), np.full(n, MASK48, dtype=U)
    out = np.zeros((n, 2 * steps + 8), dtype=np.int32)
    flat, width = out.reshape(-1), out.shape[1]
    pos = np.arange(n) * width
    live = n
    for t in range(steps):
        while sizes[live - 1] <= t:
            live -= 1
        ended = (low[live:].copy(), pos[live:].copy())
        ids = data[t]
        cls = classes.take(ids, mode="clip")
        model.predict(t)
        new1, new2 = ids != model.c1, ids != model.c2
        rare = new1 & new2
        sym = (cls * new1 + 1 + new1) * new2
        at = model.row_cum + model.state * WIDTH + sym
        lo = model.flat_cum.take(at, mode="clip")
        wide = model.flat_cum.take(at + 1, mode="clip") - lo
        part = rng >> U(SCALE)
        low += part * lo
        rng = (part * wide) >> (cls * rare).astype(U)
        low += rng * (rests.take(ids, mode="clip") * rare)
        over = np.flatnonzero(low[:live] > MASK48)
        if over.size:
            flat[pos[over] - 1] += 1
        low &= MASK48
        # At most two words leave per id: the first is written in place and stays if it is due.
        flat[pos] = low >> U(32)
        due = rng < TOP
        pos += due
        shift = due * WORD
        low, rng = (low << shift) & MASK48, rng << shift
        idx = np.flatnonzero(rng < TOP)
        while idx.size:
            flat[pos[idx]] = low[idx] >> U(32)
            pos[idx] += 1
            low[idx], rng[idx] = (low[idx] << WORD) & MASK48, rng[idx] << WORD
            idx = idx[rng[idx] < TOP]
        if live < n:  # lanes that have ended stay as they are
            low[live:], pos[live:] = ended
            rng[live:] = MASK48
        model.learn(ids, new1, new2, sym)
    ends = pos - np.arange(n) * width
    for shift in (32, 16, 0):
        flat[pos] = (low >> U(shift)) & U(0xFFFF)
        pos += 1
    for col in range(int(ends.max()) + 2, 0, -1):  # carries run towards the front
        out[:, col - 1] += out[:, col] >> 16
    words = (out & 0xFFFF).astype("<u2")
    result: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        result[i] = words[lane, : ends[lane] + 3].tobytes()
    return result


def decode_blocks(codes: list[bytes], lengths: list[int], n_ids: int, prior: np.ndarray) -> list[np.ndarray]:
    """Ids of each block; damaged codes give some ids or other, which a checksum has to tell."""
    if not codes:
        return []
    order, sizes = _ordered(lengths)
    n, steps = len(codes), int(sizes[0])
    words = [np.frombuffer(codes[i], dtype="<u2") for i in order]
    width = max(2 * steps, max(len(w) for w in words)) + 8
    flat = np.zeros(n * width, dtype=np.uint16)
    for lane, w in enumerate(words):
        flat[lane * width : lane * width + len(w)] = w
    pos, last = np.arange(n) * width, len(flat) - 1
    model = _Mixture(n, prior)
    rng = np.full(n, MASK48, dtype=U)
    code = flat[pos].astype(U) << U(32) | flat[pos + 1].astype(U) << U(16) | flat[pos + 2].astype(U)
    pos += 3
    out = np.zeros((max(steps, 1), n), dtype=np.int32)
    table, line_of = model.cum.reshape(n * STATES, WIDTH), model.lane * STATES
    live = n
    for t in range(steps):
        while sizes[live - 1] <= t:
            live -= 1
        model.predict(t)
        part = rng >> U(SCALE)
        # Both numbers are below 2 ** 48, so the quotient of doubles has the exact whole part.
        value = np.minimum(code.astype(np.float64) / part.astype(np.float64), (1 << SCALE) - 1).astype(np.uint16)
        below = table.take(line_of + model.state, axis=0, mode="clip") <= value[:, None]
        sym = np.bitwise_count(np.packbits(below, axis=1).view(np.uint32)[:, 0]).astype(np.int64) - 1
        at = model.row_cum + model.state * WIDTH + sym
        lo = model.flat_cum.take(at, mode="clip")
        wide = model.flat_cum.take(at + 1, mode="clip") - lo
        cls = np.maximum(sym - 2, 0)
        code -= part * lo
        rng = (part * wide) >> cls.astype(U)
        top = 1 << cls
        rest = np.minimum((code.astype(np.float64) / rng.astype(np.float64)).astype(np.int64), top - 1)
        rest *= sym > 1
        code -= rng * rest.astype(U)
        ids = out[t]
        ids[:] = np.minimum(top + rest - 1, n_ids - 1)
        new2, new1 = sym != 0, sym != 1
        np.copyto(ids, model.c2, where=~new2, casting="unsafe")
        np.copyto(ids, model.c1, where=~new1, casting="unsafe")
        new2, new1 = ids != model.c2, ids != model.c1
        due = rng < TOP
        shift = due * WORD
        code = (code << shift | flat.take(pos, mode="clip") * due) & MASK48
        rng <<= shift
        pos += due
        idx = np.flatnonzero(rng < TOP)
        while idx.size:
            p = np.minimum(pos[idx], last)
            code[idx] = (code[idx] << WORD | flat[p]) & MASK48
            pos[idx] = p + 1
            rng[idx] <<= WORD
            idx = idx[rng[idx] < TOP]
        if live < n:
            rng[live:], code[live:] = MASK48, U(0)
        model.learn(ids, new1, new2, sym)
    result: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * n
    for lane, i in enumerate(order):
        result[i] = out[: sizes[lane], lane].copy()
    return result
