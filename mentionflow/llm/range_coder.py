"""Blocks of token ids, coded by an adaptive context-mixing range coder.

An id is predicted from its two predecessors (order 2), its predecessor (order 1) and alone (order 0).
Each order keeps, per context, the id seen there and how sure it is. The id that the longest known context
predicts is offered first: whether it is the right one is a binary decision, whose probability
mixes, in the logistic domain and with weights learnt as the block goes, what each order's state
says of that id. Another id is coded by order 0 alone: its low byte by adaptive frequencies, then
whether it is the id last seen with that byte, then the rest.

All states start anew in each block, so that blocks can be read in any order and a damaged one
harms no other. Blocks don't depend on each other, so many of them are coded in step: a state is
an array with an entry per block, and numpy handles one id of each at a time. All of it is integer
arithmetic, equal on every machine. The coder keeps 64 bits of low end and range, and hands on 32
of them when the range has fallen below 2^32; between two such checks at most 27 bits are coded.
"""

from __future__ import annotations

import math

import numpy as np

BLOCK_IDS = 2048
MOST_IDS = 1 << 24  # ids are below; what is above the low byte is coded in at most 16 bits
LANES = 2048  # blocks coded in step
_BITS1, _BITS2 = 10, 11  # contexts of each order
_MOST_SURE = 15
_ODD1, _ODD2 = np.uint32(2654435761), np.uint32(2246822519)

_SQUASH = np.array([min(65504, max(32, round(65536 / (1 + math.exp(-i / 256))))) for i in range(-2048, 2048)], np.int32)
_STRETCH = np.array([min(2047, max(-2047, round(256 * math.log((i + 0.5) / (4095.5 - i))))) for i in range(4096)], np.int32)
_SURE = np.array([65536 * (2 * c + 1) // (2 * c + 6) for c in range(16)], np.int32)

# A lane's learnt probabilities: by the state of order 2, of order 1 (another id, this id), of order 0,
# and of the id last seen with a low byte
_ORDER1, _ORDER0, _LAST, _STATES = 16, 48, 64, 80
_ROOM = 64
_U32, _WORD = np.uint64(32), np.uint64(1 << 32)


class _Lanes:
    """The model of some blocks in step, ``n`` of them; subclasses write or read its decisions."""

    code = None  # of readers

    def __init__(self, n: int, alphabet: int, longest: int) -> None:
        self.n = n
        self.low = np.zeros(n, np.uint64)
        self.range = np.full(n, (1 << 64) - 1, np.uint64)
        self.ended = np.zeros(n, np.uint64)  # low ends of blocks that are through
        self.lane = np.arange(n)
        self.slots1 = np.zeros(n << _BITS1, np.uint32)  # id << 4 | sureness
        self.slots2 = np.zeros(n << _BITS2, np.uint32)
        self.slots0 = np.zeros(n << 8, np.uint32)
        self.at1, self.at2, self.at0 = self.lane << _BITS1, self.lane << _BITS2, self.lane << 8
        self.states = np.tile(np.concatenate([_SURE, _SURE // 4, _SURE, _SURE, _SURE // 2]), n)
        self.at_state = self.lane * _STATES
        self.weights = np.full((3, n), 1 << 13, np.int32)
        gain = max(1, min(24, (65535 - 257) // max(longest, 1)))
        self.gains = np.zeros((257, 257), np.uint16)  # what cumulative frequencies gain by a byte; the last row is none
        for s in range(256):
            self.gains[s, s + 1 :] = gain
        self.sums = np.tile(np.arange(257, dtype=np.uint16), (n, 1))
        self.gained = np.empty_like(self.sums)
        self.above = max(1, -(-alphabet // 256))
        self.last = np.zeros(n, np.uint32)
        self.before = np.zeros(n, np.uint32)

    def shrink(self, n: int) -> None:
        """Only the first ``n`` blocks go on."""
        if n == self.n:
            return
        self.ended[n : self.n] = self.low[n:]
        self.n = n
        for name in ("low", "range", "lane", "at1", "at2", "at0", "at_state", "sums", "gained", "last", "before", "next", "code", "used"):
            if getattr(self, name, None) is not None:
                setattr(self, name, getattr(self, name)[:n])
        self.weights = self.weights[:, :n]

    # Decisions: given what is so (writing) or None (reading), these say what is.

    def _bit(self, low, size, code, p, so):
        """(so, low, size) of a decision of probability ``p`` of 65,536."""
        bound = (size >> np.uint64(16)) * p.astype(np.uint64)
        if so is None:
            so = code - low < bound
        return so, np.where(so, low, low + bound), np.where(so, bound, size - bound)

    def _byte(self, at: np.ndarray, byte: np.ndarray | None) -> np.ndarray:
        """A byte by the frequencies of order 0, which learn it."""
        flat, row = self.sums.reshape(-1), at * 257
        low, total = self.low[at], flat.take(row + 256).astype(np.uint64)
        unit = self.range[at] // total
        if byte is None:
            target = np.minimum((self.code[at] - low) // unit, total - np.uint64(1)).astype(np.uint16)
            place, half = row, 128
            while half:
                ahead = place + half
                place = np.where(flat.take(ahead, mode="clip") <= target, ahead, place)
                half >>= 1
            byte = place - row
        else:
            place = row + byte
        begin = flat.take(place)
        self.low[at] = low + unit * begin
        self.range[at] = unit * (flat.take(place + 1) - begin)
        learnt = np.full(self.n, 256)
        learnt[at] = byte
        np.take(self.gains, learnt, axis=0, out=self.gained, mode="clip")
        np.add(self.sums, self.gained, out=self.sums)
        return byte

    def _hand_on(self, at: np.ndarray | None) -> None:
        size = self.range if at is None else self.range[at]
        short = np.flatnonzero(size < _WORD)
        if not len(short):
            return
        if at is None:
            at = short
        else:
            at = at[short]
        low = self.low[at]
        room = _WORD - (low & np.uint64(0xFFFFFFFF))  # up to the next value of the upper half
        self.range[at] = np.minimum(size[short], room) << _U32
        self._word(at, low)
        self.low[at] = low << _U32

    def _offer(self, offered, ids, sure2, slot1):
        """Codes whether each offered id is the right one."""
        slot0 = self.slots0.take(self.at0 + (offered & 255), mode="clip")
        states = self.states
        places = (
            self.at_state + sure2,
            self.at_state + (_ORDER1 + (slot1 & 15) + 16 * ((slot1 >> 4) == offered)),
            self.at_state + np.where((slot0 >> 4) == offered, (slot0 & 15) + _ORDER0, _ORDER0),
        )
        known = [states.take(p, mode="clip") for p in places]
        inputs = [_STRETCH.take(k >> 4, mode="clip") for k in known]
        weights = self.weights
        dot = (weights[0] * inputs[0] + weights[1] * inputs[1] + weights[2] * inputs[2]) >> 14
        p = _SQUASH.take(dot + 2048, mode="clip")
        right, self.low, self.range = self._bit(self.low, self.range, self.code, p, None if ids is None else ids == offered)
        goal = right * np.int32(65535)
        error = (goal - p) * np.int32(3)
        for i in range(3):
            weights[i] += (inputs[i] * error + (1 << 17)) >> 18
            states[places[i]] = known[i] + ((goal - known[i]) >> 4)
        return right

    def _alone(self, at: np.ndarray, byte: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Codes what is left of ids whose low byte is known."""
        slot = self.slots0.take(self.at0[at] + byte)
        place = self.at_state[at] + (_LAST + (slot & 15))
        known, seen = self.states.take(place), slot >> 4
        code = None if ids is not None else self.code[at]
        same, low, size = self._bit(self.low[at], self.range[at], code, np.clip(known, 32, 65504), None if ids is None else ids == seen)
        self.states[place] = known + ((same * np.int32(65535) - known) >> 4)
        new = np.flatnonzero(~same)
        unit = size[new] // np.uint64(self.above)
        if ids is None:
            above = np.minimum((code[new] - low[new]) // unit, np.uint64(self.above - 1))
            found = seen
            found[new] = above.astype(np.uint32) << 8 | byte[new].astype(np.uint32)
        else:
            found, above = ids, (ids[new] >> 8).astype(np.uint64)
        low[new] += unit * above
        size[new] = unit
        self.low[at], self.range[at] = low, size
        return found

    def step(self, ids: np.ndarray | None) -> np.ndarray:
        """Codes one id of each block."""
        place1 = self.at1 + (self.last * _ODD1 >> np.uint32(32 - _BITS1))
        place2 = self.at2 + ((self.last * _ODD2 + self.before * _ODD1) * _ODD2 >> np.uint32(32 - _BITS2))
        slot1, slot2 = self.slots1.take(place1, mode="clip"), self.slots2.take(place2, mode="clip")
        sure2 = slot2 & 15
        found = offered = np.where(sure2 > 0, slot2, slot1) >> 4
        rest = np.flatnonzero(~self._offer(offered, ids, sure2, slot1))
        if len(rest):
            own = None if ids is None else ids[rest]
            byte = self._byte(rest, None if ids is None else (own & 255).astype(np.int64))
            self._hand_on(None)
            got = self._alone(rest, byte, own)
            self._hand_on(rest)
            if ids is None:
                found = offered.copy()
                found[rest] = got
        else:
            self._hand_on(None)
        if ids is not None:
            found = ids
        self.slots1[place1] = _learnt(slot1, found)
        self.slots2[place2] = _learnt(slot2, found)
        place0 = self.at0 + (found & 255)
        self.slots0[place0] = _learnt(self.slots0.take(place0), found)
        self.before, self.last = self.last, found
        return found


def _learnt(slot: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A context's slot after ``ids``: a right prediction gets surer, a wrong one is replaced."""
    marked = ids << 4
    return np.where(slot ^ marked < 16, np.minimum(slot + 1, slot | _MOST_SURE), marked | 1)


class _Writer(_Lanes):
    def __init__(self, n: int, alphabet: int, longest: int) -> None:
        super().__init__(n, alphabet, longest)
        self.words = np.zeros((n, longest // 2 + 2 * _ROOM), np.uint32)
        self.used = np.zeros(n, np.int64)

    def _word(self, at: np.ndarray, low: np.ndarray) -> None:
        self.words[at, self.used[at]] = low >> _U32
        self.used[at] += 1

    def make_room(self) -> None:
        """Room for what _ROOM // 2 steps can write: two words each."""
        if self.used.max() + 2 * _ROOM > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros((len(self.words), self.words.shape[1]), np.uint32)], axis=1)


class _Reader(_Lanes):
    def __init__(self, codes: list[np.ndarray], alphabet: int, longest: int) -> None:
        super().__init__(len(codes), alphabet, longest)
        self.words = np.concatenate([*codes, np.zeros(2, np.uint32)]).astype(np.uint64)
        self.next = np.cumsum([0, *[len(c) for c in codes[:-1]]])
        self.code = np.zeros(self.n, np.uint64)
        for _ in range(2):
            self._word(self.lane, None)

    def _word(self, at: np.ndarray, low: np.ndarray | None) -> None:
        place = self.next[at]
        self.code[at] = self.code[at] << _U32 | self.words.take(place, mode="clip")
        self.next[at] = place + 1


def _order(lengths: list[int]) -> np.ndarray:
    """Longest blocks first, so that those which go on are always the first ones."""
    return np.argsort(-np.array(lengths, np.int64), kind="stable")


def coded(blocks: list[np.ndarray], alphabet: int) -> list[bytes]:
    """The code of each block of ids, which are below ``alphabet``."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks], np.int64)
    order = _order(lengths)
    longest, lengths = int(lengths.max()), lengths[order]
    ids = np.zeros((longest, len(blocks)), np.uint32)
    for lane, i in enumerate(order):
        ids[: len(blocks[i]), lane] = blocks[i]
    if int(ids.max(initial=0)) >= min(alphabet, MOST_IDS):
        raise ValueError("an id lies outside the alphabet")
    writer = _Writer(len(blocks), alphabet, longest)
    used = writer.used
    for t in range(longest):
        if t % (_ROOM // 2) == 0:
            writer.make_room()
        writer.shrink(int(np.searchsorted(-lengths, -t, side="left")))
        writer.step(ids[t, : writer.n])
    writer.shrink(0)
    out = [b""] * len(blocks)
    for lane, i in enumerate(order):
        low, end = int(writer.ended[lane]), []
        for _ in range(2):  # the low end itself tells the last decisions
            end.append(low >> 32)
            low = low << 32 & (1 << 64) - 1
        words = np.concatenate([writer.words[lane, : used[lane]], np.array(end, np.uint32)])
        out[i] = words.astype("<u4").tobytes()
    return out


def decoded(codes: list[bytes], lengths: list[int], alphabet: int) -> list[np.ndarray]:
    """The ids of each block."""
    if not codes:
        return []
    order = _order(lengths)
    sizes = np.array(lengths, np.int64)[order]
    longest = int(sizes.max())
    reader = _Reader([np.frombuffer(codes[i], "<u4") for i in order], alphabet, longest)
    ids = np.zeros((longest, len(codes)), np.uint32)
    for t in range(longest):
        reader.shrink(int(np.searchsorted(-sizes, -t, side="left")))
        ids[t, : reader.n] = reader.step(None)
    out = [ids[:0, 0]] * len(codes)
    columns = np.ascontiguousarray(ids.T)
    for lane, i in enumerate(order):
        out[i] = columns[lane, : sizes[lane]]
    return out
