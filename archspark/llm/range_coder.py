"""Adaptive context-mixing range coder for token ids, many independent blocks at a time.

Each block starts from the same state and is coded on its own. For every id an order-2 and an
order-1 table give the id last seen after the two (one) ids before it. An adaptive three-way model,
chosen by which tables know their context and whether they agree, mixes them: "as order 2 says",
"as order 1 says" or "neither". In the last case the id goes by order 0: an adaptive count of id
ranges, then evenly within the range. All of it is integer arithmetic, so any machine decodes what
another encoded. Blocks run side by side as the lanes of numpy arrays, one id of each at a time.

The coder keeps ``low`` and a range of 2^32 to 2^48 as whole numbers in doubles, which hold them exactly;
so are quotients rounded down, as no number reaches 2^52. An id narrows the range up to three times (mixing,
id range, place within it; by 1 where a step has nothing to say) and then writes 16-bit words until 2^32 is
reached again. ``low`` keeps its carries, a written word too; they run back over all words at the end.
"""

from __future__ import annotations

import numpy as np

#: ids a block may hold: adaptive totals grow by INC an id and must stay within 2^16
BLOCK_IDS, INC = 4096, 12
MOST_IDS = 65_535
H1, H2 = 1 << 11, 1 << 12
WORD, TOP, HIGH = 2.0**16, 2.0**32, 2.0**-32
#: a range below it is widened before an id's place in its id range (of up to 2^15 ids) is coded
NARROW = 2.0**20
#: order-0 ranges: two of 256 ids (the bytes), then growing ones
EDGES = np.unique(np.concatenate(([0, 256], np.round(512 * (65_536 / 512) ** (np.arange(15) / 14))))).astype(np.int64)
B = len(EDGES) - 1
#: in place of a range, where a table knew the id
NONE = B + 1
RANGE_OF = np.repeat(np.arange(B, dtype=np.uint8), np.diff(EDGES))
START = np.concatenate((EDGES[:-1], [0, 0])).astype(np.uint16)
WIDTH = np.concatenate((np.diff(EDGES), [1, 1])).astype(np.float64)


def _packed(numbers) -> np.ndarray:
    """Each four 16-bit numbers as one of 64 bits, so that one addition counts in all of them."""
    return np.asarray(numbers, "<u2").view("<u8").astype(np.uint64)


#: cumulated counts of (order 2, order 1, neither) at the start where: no table, order 1, order 2, both, both and agreeing
PRIOR = _packed([[0, 0, 0, 1], [0, 0, 1, 3], [0, 1, 1, 2], [0, 1, 2, 4], [0, 3, 3, 4]]).ravel()
#: what each of the three adds to them
ADD = _packed([[0, INC, INC, INC], [0, 0, INC, INC], [0, 0, 0, INC]]).ravel()
#: cumulated counts of the ranges at the start, then 0 and 1, between which NONE lies
SLOTS = -(-(B + 3) // 4) * 4
FIRST = _packed([*range(B + 1), 0, 1, *[0] * (SLOTS - B - 3)])
#: what each range adds to them, a row for each four
ADD0 = np.stack([_packed([INC * (r < j <= B) for j in range(SLOTS)]) for r in range(NONE + 1)], axis=1)
ADD0[:, NONE] = 0
SPREAD = np.uint64(0x0001_0001_0001_0001)


class _Lanes:
    """Model state of the blocks; lanes are ordered by falling length, so those at work come first."""

    def __init__(self, lengths: np.ndarray):
        n = len(lengths)
        self.lengths = lengths
        self.t1, self.t2 = np.zeros(n * H1, np.uint16), np.zeros(n * H2, np.uint16)  # id + 1; 0: nothing yet
        self.flags = np.tile(PRIOR, n)
        self.cum = np.repeat(FIRST[:, None], n, axis=1)  # a row for each four counts, a column for each lane
        self.slots = self.cum.reshape(-1).view("<u2")
        self.more = np.full(n, B - 1.0)  # the order-0 total, less one
        slot = np.arange(SLOTS)
        place = slot // 4 * 4 * n + slot % 4
        self.place, self.after = place[: NONE + 1], place[1 : NONE + 2]
        lane = np.arange(n)
        self.base1, self.base2, self.base, self.lane4 = lane * H1, lane * H2, lane * 5, lane * 4
        self.p1, self.p2 = np.zeros(n, np.uint16), np.zeros(n, np.uint16)

    def predict(self, k: int):
        """Table places, predictions, the mixing state's place and its cumulated counts for the first k lanes."""
        mixed = self.p1[:k] * np.uint16(40_503)  # only the lower 16 bits count
        i1 = self.base1[:k] + ((mixed >> 4) & (H1 - 1))
        mixed += self.p2[:k] * np.uint16(60_493)
        i2 = self.base2[:k] + ((mixed >> 4) & (H2 - 1))
        c1, c2 = self.t1.take(i1), self.t2.take(i2)
        one, two = (c1 != 0).view(np.uint8), (c2 != 0).view(np.uint8)
        at = self.base[:k] + (one + two + two + ((c1 == c2).view(np.uint8) & one))
        return i1, i2, c1, c2, at, self.flags.take(at)

    def mixing(self, k: int, at, counts, sym):
        """(start, count) of each lane's ``sym`` of the three, which is counted."""
        self.flags[at] = counts + ADD.take(sym)
        here, flat = self.lane4[:k] + sym, counts.view("<u2")
        start = flat.take(here)
        here += 1
        return start, flat.take(here) - start

    def order0(self, k: int, r):
        """(start, count) of each lane's range r in its order-0 counts, where it is counted."""
        here = self.lane4[:k]
        start = self.slots.take(self.place.take(r) + here)
        size = self.slots.take(self.after.take(r) + here) - start
        for row, add in zip(self.cum, ADD0):
            row[:k] += add.take(r)
        return start, size

    def totals(self, k: int, miss):
        """Totals of the order-0 counts where ``miss`` is 1, else 1; counts their use."""
        out = miss * self.more[:k]
        out += 1.0
        self.more[:k] += miss * float(INC)
        return out

    def range_at(self, k: int, value):
        """The range whose interval in the order-0 counts holds the value."""
        below = self.slots.reshape(len(self.cum), -1)[: B // 4, : 4 * k] <= (value.astype(np.uint64) * SPREAD).view("<u2")
        found = np.add.reduce(below.view(np.uint8), axis=0, dtype=np.uint8)  # four sums for each lane
        return ((found.view(np.uint32) * np.uint32(0x0101_0101)) >> 24) - 1

    def update(self, k: int, i1, i2, y) -> None:
        self.t1[i1] = y
        self.t2[i2] = y
        self.p2[:k] = self.p1[:k]
        self.p1[:k] = y

    def at_work(self):
        """(step, lanes still at work) until the longest block ends."""
        top = int(self.lengths[0]) if len(self.lengths) else 0
        ends = np.searchsorted(-self.lengths, -np.arange(top), "left")  # lanes with length > step
        return zip(range(top), ends.tolist())


class _Writer:
    def __init__(self, lengths: np.ndarray):
        n = len(lengths)
        self.low, self.range = np.zeros(n), np.full(n, 2.0**48)
        self.n = n
        self.out = np.zeros((3 * int(lengths.max(initial=0)) + 8) * n, np.uint32)  # a row for each word's place
        self.pos = np.arange(n)

    def narrow(self, k: int, start, count, total) -> None:
        part = np.floor(self.range[:k] / total)
        self.low[:k] += part * start
        np.multiply(part, count, out=self.range[:k])

    def place(self, k: int, place, width) -> None:
        """Narrows to one of ``width`` equal parts."""
        np.floor(self.range[:k] / width, out=self.range[:k])
        self.low[:k] += self.range[:k] * place

    def widen(self, k: int) -> None:
        short = self.range[:k] < TOP
        one, low, pos = short.astype(np.float64), self.low[:k], self.pos[:k]
        word = np.floor(low * HIGH)
        self.out[pos] = word  # where it is not wanted, the next one takes its place
        pos += short * self.n
        word *= TOP
        word *= one
        low -= word
        one *= WORD - 1.0
        one += 1.0
        low *= one
        self.range[:k] *= one
        self.widen_few(k, TOP)

    def widen_few(self, k: int, below: float) -> None:
        at = (self.range[:k] < below).nonzero()[0]
        while len(at):
            here, low, width = self.pos[at], self.low[at], self.range[at] * WORD
            word = np.floor(low * HIGH)
            self.out[here] = word
            self.pos[at] = here + self.n
            self.low[at] = (low - word * TOP) * WORD
            self.range[at] = width
            at = at[width < TOP]

    def finish(self) -> list[bytes]:
        for _ in range(3):
            word = np.floor(self.low * HIGH)
            self.out[self.pos] = word
            self.low = (self.low - word * TOP) * WORD
            self.pos += self.n
        sizes = self.pos // self.n
        words = self.out.reshape(-1, self.n)[: sizes.max()]
        for i in range(len(words) - 1, 0, -1):
            words[i - 1] += words[i] >> 16
        return [row[:n].tobytes() for row, n in zip(words.T.astype("<u2", order="C"), sizes.tolist())]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        n = len(payloads)
        found = [np.frombuffer(p, "<u2") for p in payloads]
        words = np.zeros((max(map(len, found)) + 1, n), np.uint16)
        for lane, w in enumerate(found):
            words[: len(w), lane] = w
        self.code = words[0] * TOP + words[1] * WORD + words[2]
        self.n, self.words, self.pos = n, words.reshape(-1), np.arange(n) + 3 * n
        self.range = np.full(n, 2.0**48)

    def part(self, k: int, total) -> np.ndarray:
        return np.floor(self.range[:k] / total)

    def value(self, k: int, part, total) -> np.ndarray:
        """The code's place within ``total``, of which each is ``part`` wide."""
        value = np.floor(self.code[:k] / part)
        value -= value * part > self.code[:k]  # the quotient may have been rounded up
        return np.minimum(value, total - 1.0, out=value)

    def take(self, k: int, part, start, count) -> None:
        self.code[:k] -= part * start
        np.multiply(part, count, out=self.range[:k])

    def widen(self, k: int) -> None:
        short = self.range[:k] < TOP
        one, code, pos = short.astype(np.float64), self.code[:k], self.pos[:k]
        more = code * (WORD - 1.0)
        more += self.words.take(pos, mode="clip")  # beyond the end in a damaged payload only
        more *= one
        code += more
        pos += short * self.n
        one *= WORD - 1.0
        one += 1.0
        self.range[:k] *= one
        self.widen_few(k, TOP)

    def widen_few(self, k: int, below: float) -> None:
        at = (self.range[:k] < below).nonzero()[0]
        while len(at):
            here, width = self.pos[at], self.range[at] * WORD
            self.code[at] = self.code[at] * WORD + self.words.take(here, mode="clip")
            self.pos[at] = here + self.n
            self.range[at] = width
            at = at[width < TOP]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block of at most BLOCK_IDS ids below MOST_IDS."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    if not len(blocks) or lengths.max() > BLOCK_IDS:
        if not len(blocks):
            return []
        raise ValueError("a block has too many ids")
    if max(int(b.max(initial=0)) for b in blocks) >= MOST_IDS:
        raise ValueError("an id is too large")
    order = np.argsort(-lengths, kind="stable")
    ids = np.zeros((int(lengths.max()), len(blocks)), np.uint16)  # by step
    for lane, b in enumerate(order.tolist()):
        ids[: lengths[b], lane] = blocks[b]
    m, w = _Lanes(lengths[order]), _Writer(lengths[order])
    for t, k in m.at_work():
        x = ids[t, :k]
        y = x + np.uint16(1)
        i1, i2, c1, c2, at, counts = m.predict(k)
        second = (c2 == y).view(np.uint8)
        sym = np.uint8(2) - np.maximum(second + second, (c1 == y).view(np.uint8))
        total = counts.view("<u2")[3::4]
        w.narrow(k, *m.mixing(k, at, counts, sym), total)
        m.update(k, i1, i2, y)
        miss = sym == 2
        r = np.where(miss, RANGE_OF.take(x), np.uint8(NONE)).astype(np.intp)
        miss = miss.astype(np.float64)
        w.narrow(k, *m.order0(k, r), m.totals(k, miss))
        w.widen_few(k, NARROW)
        w.place(k, (x - START.take(r)) * miss, WIDTH.take(r))
        w.widen(k)
    done = w.finish()
    out: list[bytes] = [b""] * len(blocks)
    for lane, b in enumerate(order.tolist()):
        out[b] = done[lane]
    return out


def decode(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Ids of each block, from its payload and number of ids."""
    if not payloads:
        return []
    lengths = np.array(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    ids = np.zeros((int(lengths.max()), len(payloads)), np.uint16)
    m, r = _Lanes(lengths[order]), _Reader([payloads[i] for i in order.tolist()])
    for t, k in m.at_work():
        i1, i2, c1, c2, at, counts = m.predict(k)
        ends = counts.view("<u2").reshape(-1, 4)
        part, code = r.part(k, ends[:, 3]), r.code[:k]
        sym = (code >= part * ends[:, 1]).view(np.uint8) + (code >= part * ends[:, 2]).view(np.uint8)
        r.take(k, part, *m.mixing(k, at, counts, sym))
        miss = sym == 2
        total = m.totals(k, miss.astype(np.float64))
        part = r.part(k, total)
        b = np.where(miss, m.range_at(k, r.value(k, part, total)), NONE)
        r.take(k, part, *m.order0(k, b))
        r.widen_few(k, NARROW)
        width = WIDTH.take(b)
        part = r.part(k, width)
        place = r.value(k, part, width)
        r.take(k, part, place, 1.0)
        r.widen(k)
        y = START.take(b) + place.astype(np.uint16) + np.uint16(1)
        y = np.where(miss, y, np.where(sym == 0, c2, c1))
        m.update(k, i1, i2, y)
        ids[t, :k] = y - np.uint16(1)
    columns = ids.T.astype(np.uint32, order="C")
    out: list[np.ndarray] = [columns[0, :0]] * len(payloads)
    for lane, b in enumerate(order.tolist()):
        out[b] = columns[lane, : lengths[b]]
    return out
