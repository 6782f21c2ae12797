"""An adaptive range coder of token ids that mixes predictions of orders 0 to 2, over many blocks side by side.

Each block is coded for itself, from the same first state. Blocks stand in lanes: a step codes the next id of every lane at once, with
array operations, so the cost of Python is shared. All of it is whole-number arithmetic, hence the same on every machine.

An id is coded as a yes or no, whether it is the predicted one, and if not as a class and the rest of its bits. The predicted id is the
one that followed the last two ids (order 2) or the last one (order 1) before, whichever has held longer. How likely it is to hold is a
mix in the logistic domain of what order 1 and order 2 say by how often they have held in a row, and of what order 0 says by how often that id
was met in the block; each such evidence learns from every outcome. Classes have adaptive frequencies of order 0, learned from every id. All lanes take the same
operations: a lane whose prediction holds goes through the class as one part of one.
"""

from __future__ import annotations

import math

import numpy as np

U64, I64 = np.uint64, np.int64
FULL, SHORT, TOP, LEAST = U64((1 << 64) - 1), U64(16), U64(48), U64(1 << 48)  # words have 16 bits
STEPS, WORDS = 64, 4  # steps between looks at how full the words are; the most words of a step
BITS1, BITS2, BITS0 = 8, 9, 8  # of the tables of order 1, order 2 and order 0 of each lane
SURE = 7  # the largest count of hits in a row
ID = (1 << 24) - 1  # an id in a table's entry; the count stands above it
CLASSES, FREQ, RATE = 31, 14, 5  # frequencies are in 2**FREQ-ths
IDS = 1 << 16


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First id and width in bits of each class, and the class of each id: classes widen as ids grow, since tokenizers number frequent tokens first."""
    bits = 4 + np.arange(CLASSES) // 3
    bits[-1] = 15
    first = np.concatenate([[0], np.cumsum(1 << bits)[:-1]])
    return first.astype("int32"), bits.astype(U64), (np.searchsorted(first, np.arange(IDS), side="right") - 1).astype(I64)


def _squash() -> np.ndarray:
    """Probability in 65536ths of a logit in 256ths, from -2048 to 2047; neither end is certain."""
    return np.array([max(64, min(65536 - 64, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], dtype="int32")


FIRST, WIDTH, CLASS_OF = _classes()
SQUASH = _squash()
MORE, MOST = np.int32(1 << 24), np.int32(SURE << 24)  # one hit more in a table's entry, and the most
#: Where the bounds of the frequencies go when a class is met; each class keeps a little room.
TOWARD = np.array([[i << RATE if i <= c else (1 << FREQ) - ((CLASSES - i) << RATE) for i in range(CLASSES + 1)] for c in range(CLASSES)], dtype="int16")


class Encoder:
    """Range coders of many lanes: 64-bit bounds, 16-bit words out. A word may hold a carry until the end; the first is there for one that never comes."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, U64), np.full(lanes, FULL, U64)
        self._lay(np.zeros((lanes, 1024), "uint32"), np.ones(lanes, I64))

    def _lay(self, words: np.ndarray, n: np.ndarray) -> None:
        self.words, self.flat = words, words.reshape(-1)
        self.at = np.arange(len(words)) * words.shape[1]
        self.next = self.at + n

    def make_room(self) -> None:
        """For the words of some steps more."""
        n = self.next - self.at
        if n.max() + (STEPS + 2) * WORDS > self.words.shape[1]:
            self._lay(np.concatenate([self.words, np.zeros_like(self.words)], axis=1), n)

    def keep(self, k: int, low: np.ndarray, part: np.ndarray) -> None:
        """The first ``k`` lanes go on with these bounds; those of small ranges put words out."""
        over = np.flatnonzero(low < self.low[:k])
        if len(over):
            self.flat[self.next[over] - 1] += np.uint32(1)
        lanes = np.flatnonzero(part < LEAST)
        while len(lanes):
            self._put(lanes, low)
            wide = _at(part, lanes)
            wide <<= SHORT
            part[lanes] = wide
            lanes = lanes[wide < LEAST]
        self.low[:k] = low
        self.range[:k] = part

    def _put(self, lanes: np.ndarray, low: np.ndarray) -> None:
        held, place = _at(low, lanes), _at(self.next, lanes)
        self.flat[place] = (held >> TOP).astype("uint32")
        held <<= SHORT
        low[lanes] = held
        place += 1
        self.next[lanes] = place

    def finish(self) -> list[bytes]:
        """The words of each lane, without the first."""
        every = np.arange(len(self.low))
        self.make_room()
        for _ in range(WORDS):
            self._put(every, self.low)
        while len(over := np.flatnonzero(self.flat >> np.uint32(16))):
            self.flat[over] &= np.uint32(0xFFFF)
            self.flat[over - 1] += np.uint32(1)
        words = self.words.astype("<u2")
        return [words[lane, 1:n].tobytes() for lane, n in enumerate((self.next - self.at).tolist())]


class Decoder:
    """The lanes of :class:`Encoder` read back."""

    def __init__(self, coded: list[bytes]):
        size = max(map(len, coded)) // 2 + WORDS
        words = np.zeros((len(coded), size), "uint16")
        for k, b in enumerate(coded):
            words[k, : len(b) // 2] = np.frombuffer(b, "<u2")
        self.range, self.next = np.full(len(coded), FULL, U64), np.arange(len(coded)) * size + WORDS
        self.off, self.words = np.zeros(len(coded), U64), words.ravel()
        for k in range(WORDS):
            self.off = (self.off << SHORT) | words[:, k]

    def keep(self, k: int, off: np.ndarray, part: np.ndarray) -> None:
        """The first ``k`` lanes stand ``off`` within a range of ``part``; those of small ranges take words in."""
        lanes = np.flatnonzero(part < LEAST)
        while len(lanes):
            wide, held, place = _at(part, lanes), _at(off, lanes), _at(self.next, lanes)
            held <<= SHORT
            held |= _at(self.words, place).astype(U64)
            off[lanes] = held
            place += 1
            self.next[lanes] = place
            wide <<= SHORT
            part[lanes] = wide
            lanes = lanes[wide < LEAST]
        self.off[:k] = off
        self.range[:k] = part


def _at(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What ``held`` has at ``places``; those outside are taken for its ends, so nothing is checked."""
    return held.take(places.astype(I64, copy=False), mode="clip")


class Model:
    """What every lane has learned of its block so far."""

    def __init__(self, lanes: int):
        self.one, self.two = np.split(np.zeros((lanes << BITS1) + (lanes << BITS2), "int32"), [lanes << BITS1])
        self.met = np.zeros(lanes << BITS0, "uint8")  # SURE at most
        self.say1, self.say2 = (np.full(lanes * 32, -256, "int32") for _ in range(2))
        self.say0 = np.full(lanes * 32, len(SQUASH) // 2 - 256, "int32")  # so that the sum of the three is a place in SQUASH
        self.frequency = np.tile((np.arange(CLASSES + 1) * (1 << FREQ) // CLASSES).astype("int16"), (lanes, 1))
        self.flat = self.frequency.reshape(-1)
        self.row = np.arange(lanes) * (CLASSES + 1)
        self.mixed = np.zeros(lanes, U64)
        lane = np.arange(lanes, dtype=U64)
        self.at1, self.at2 = lane << U64(BITS1), lane << U64(BITS2)
        self.at0, self.at32 = (np.arange(lanes, dtype="int32") << n for n in (BITS0, 5))
        self.before = np.zeros(lanes, U64)

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The predicted id of the first ``k`` lanes, and in 65536ths how likely it is."""
        mixed = self.mixed[:k]
        slot = mixed >> U64(64 - BITS1)
        slot += self.at1[:k]
        self.slot1 = slot.view(I64)
        slot = mixed ^ self.before[:k]
        slot *= U64(0xD6E8FEB86659FD93)
        slot >>= U64(64 - BITS2)
        slot += self.at2[:k]
        self.slot2 = slot.view(I64)
        self.said1, self.said2 = _at(self.one, self.slot1), _at(self.two, self.slot2)
        self.id1 = self.said1 & ID
        sure1, sure2 = self.said1 >> 24, self.said2 >> 24
        second = (sure2 >= sure1).astype("int32")
        guess = self.said2 & ID
        self.id2 = guess.copy()
        guess -= self.id1
        kind = (guess == 0).astype("int32")
        kind <<= 1
        kind += second
        kind <<= 3
        kind += self.at32[:k]
        guess *= second
        guess += self.id1
        place = guess & ((1 << BITS0) - 1)
        place += self.at0[:k]
        times = _at(self.met, place).astype("int32")
        for hits in (sure1, sure2, times):
            hits += kind
        self.place1, self.place2, self.place0 = sure1.astype(I64), sure2.astype(I64), times.astype(I64)
        self.was1, self.was2, self.was0 = _at(self.say1, self.place1), _at(self.say2, self.place2), _at(self.say0, self.place0)
        total = self.was1 + self.was2
        total += self.was0
        self.likely = _at(SQUASH, total)
        return guess, self.likely

    def learn(self, k: int, hit: np.ndarray, ids: np.ndarray) -> None:
        """Take in whether the prediction held in the first ``k`` lanes, and their ids (int32)."""
        step = hit.astype("int32")
        step <<= 16
        step -= self.likely
        step >>= 11
        for say, place, was in ((self.say1, self.place1, self.was1), (self.say2, self.place2, self.was2), (self.say0, self.place0, self.was0)):
            was += step
            say[place] = was
        for table, slot, said, held in ((self.one, self.slot1, self.said1, self.id1), (self.two, self.slot2, self.said2, self.id2)):
            same = (held == ids).astype("int32")
            said += MORE
            said &= ~ID
            np.minimum(said, MOST, out=said)
            said *= same
            said |= ids
            table[slot] = said
        slot = ids & ((1 << BITS0) - 1)
        slot += self.at0[:k]
        slot = slot.astype(I64)
        times = _at(self.met, slot)
        times += (times < SURE).view("uint8")
        self.met[slot] = times
        np.right_shift(self.mixed[:k], U64(11), out=self.before[:k])
        np.multiply(ids.astype(U64), U64(0x9E3779B97F4A7C15), out=self.mixed[:k])

    def adapt(self, k: int, c: np.ndarray) -> None:
        """Take in the classes of the ids of the first ``k`` lanes."""
        toward, rows = TOWARD.take(c, axis=0, mode="clip"), self.frequency[:k]
        toward -= rows
        toward >>= RATE
        rows += toward


def _in_order(sizes: list[int]) -> tuple[list[int], np.ndarray]:
    """Lanes from the longest block on, and how many of them have an id at each step."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    held = np.array([sizes[k] for k in order])
    return order, len(held) - np.searchsorted(held[::-1], np.arange(held.max(initial=0)), side="right")


def _turned(ids: np.ndarray) -> np.ndarray:
    """The transpose, some columns at a time, so that each line of memory is met once."""
    out = np.empty(ids.shape[::-1], ids.dtype)
    for k in range(0, len(out), 16):
        out[k : k + 16] = ids[:, k : k + 16].T
    return out


def _width(p: np.ndarray, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the part of 65536 begins that a lane keeps, and its width: ``p`` for a hit, the rest for a miss (1, else 0)."""
    begin = p * miss
    width = miss << U64(16)
    width += p
    width -= begin
    width -= begin
    return begin, width


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (below 65536) coded for itself."""
    if not blocks:
        return []
    order, active = _in_order(list(map(len, blocks)))
    by_lane = np.zeros((len(blocks), len(active)), "int32")
    for lane, k in enumerate(order):
        by_lane[lane, : len(blocks[k])] = blocks[k]
    ids = _turned(by_lane)
    model, coder = Model(len(blocks)), Encoder(len(blocks))
    for step, k in enumerate(active.tolist()):
        if step % STEPS == 0:
            coder.make_room()
        now = ids[step, :k]
        guess, likely = model.predict(k)
        hit = guess == now
        miss = (~hit).astype(U64)
        begin, width = _width(likely.astype(U64), miss)
        part = coder.range[:k] >> SHORT
        low = part * begin
        part *= width
        c = _at(CLASS_OF, now)
        place = model.row[:k] + c
        from_, upto = _at(model.flat, place), _at(model.flat, place + 1)
        upto -= from_
        part >>= miss * U64(FREQ)
        begin = from_.astype(U64)
        begin *= miss
        begin *= part
        low += begin
        width = upto.astype(U64)
        width -= U64(1)
        width *= miss
        width += U64(1)
        part *= width
        bits = _at(WIDTH, c)
        bits *= miss
        part >>= bits
        rest = (now - _at(FIRST, c)).astype(U64)
        rest *= miss
        rest *= part
        low += rest
        low += coder.low[:k]
        coder.keep(k, low, part)
        model.adapt(k, c)
        model.learn(k, hit, now)
    coded = coder.finish()
    out: list[bytes] = [b""] * len(blocks)
    for lane, k in enumerate(order):
        out[k] = coded[lane]
    return out


def decode(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks of the given sizes."""
    if not coded:
        return []
    order, active = _in_order(sizes)
    ids = np.zeros((len(active), len(sizes)), "int32")
    model, coder = Model(len(sizes)), Decoder([coded[k] for k in order])
    for step, k in enumerate(active.tolist()):
        now = ids[step, :k]
        guess, likely = model.predict(k)
        p = likely.astype(U64)
        off = coder.off[:k]
        part = coder.range[:k] >> SHORT
        hit = off < part * p
        miss = (~hit).astype(U64)
        begin, width = _width(p, miss)
        begin *= part
        off -= begin
        part *= width
        part >>= miss * U64(FREQ)
        y = np.minimum(off // part, U64((1 << FREQ) - 1)).astype("int16")
        c = np.bitwise_count(np.packbits(model.frequency[:k] <= y[:, None]).view("uint32")).astype(I64)  # a lane has 32 bounds
        c -= 1
        place = model.row[:k] + c
        from_, upto = _at(model.flat, place), _at(model.flat, place + 1)
        upto -= from_
        begin = from_.astype(U64)
        begin *= miss
        begin *= part
        off -= begin
        width = upto.astype(U64)
        width -= U64(1)
        width *= miss
        width += U64(1)
        part *= width
        bits = _at(WIDTH, c)
        bits *= miss
        part >>= bits
        rest = off // part
        rest *= miss
        part_rest = part * rest
        off -= part_rest
        other = _at(FIRST, c)
        other += rest.astype("int32")
        other -= guess
        other *= miss.astype("int32")
        np.add(guess, other, out=now)
        coder.keep(k, off, part)
        model.adapt(k, _at(CLASS_OF, now))
        model.learn(k, hit, now)
    out: list[np.ndarray] = [ids[:0, 0]] * len(sizes)
    by_lane = _turned(ids).view("uint32")
    for lane, k in enumerate(order):
        out[k] = by_lane[lane, : sizes[k]].copy()
    return out
