"""A token id file format: adaptive context mixing and a range coder, in blocks that stand alone.

Each id is coded in one step from three predictions. The order-2 and order-1 models keep, for the last two ids and for
the last one, the ids that followed with their frequencies, four of each context, the frequent ones. Their frequencies
are mixed: each order has the share of the code space that it has earned, among contexts that were seen as often, by
the part it had in coding what came; shares start at what the counts suggest and adapt id by id. What both orders know
is the sum of both. What no context knows is coded by order 0, the frequencies of the ids that the block has had, which
are renewed as the block grows by RENEW; ids that it has not had share what that is worth, which adapts too. A block
starts from nothing, so it needs no other block.

A block is a header (magic, number of ids, bytes of code, CRC-32 of the ids) and the code. Many blocks are coded in
lockstep, one array lane each, so the work per id is some array operations for all lanes; how many there are changes
nothing in a block. Columns of blocks are coded by ``blockcoder``, which gives the same bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"SLT2"
HEADER = struct.Struct("<4sIII")
#: Ids in one block.
BLOCK = 4096
#: Blocks coded in lockstep at most; it bounds memory.
LANES = 1024
#: Growth of a block after which order 0 is renewed.
RENEW = 1.4
#: Contexts of a lane in order 2 and order 1, ids kept of a context (the code counts on four), and the largest count.
SLOTS, WAYS, LIMIT = (1 << 10, 1 << 10), 4, 250
#: Bits of the probabilities, of the shares, and of their rate of change.
BITS, SHARE_BITS, RATE = 28, 16, 5
#: The most that contexts have of the code space, so that order 0 has at least a part of it for each id.
MOST = (1 << BITS) // 32 * 31
#: Least share of a context that was seen, the largest vocabulary, which twice fits what order 0 has at least, and an id
#: beyond any.
LEAST, LARGEST, NONE = 512, 1 << 22, (1 << 24) - 1
_WORD = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)
#: The class of a context by the sum of its counts; class 0 is one that was never seen.
CLASSES = np.searchsorted([1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 20, 32, 51, 81, 129], np.arange(WAYS * LIMIT + 1), "right")


class Model:
    """The state of all lanes; the coder asks for shares and tells each id. Arrays have order 2 first, then order 1."""

    def __init__(self, lanes: int, vocabulary: int):
        if not 1 <= vocabulary <= LARGEST:
            raise ValueError(f"a vocabulary of {vocabulary}; it may have 1 to {LARGEST} ids")
        self.n, self.vocabulary = lanes, vocabulary
        self.lane = np.arange(lanes)
        self.base = np.stack([self.lane * SLOTS[0], lanes * SLOTS[0] + self.lane * SLOTS[1]])
        self.mask = np.array(SLOTS)[:, None] - 1
        # An id and, in the low byte, its count; empty ones hold an id that no vocabulary has.
        self.cells = np.full(lanes * sum(SLOTS) * WAYS, NONE << 8, np.uint32)
        self.ways = np.arange(WAYS)[None, :, None]
        self.spread = np.stack([self.lane, WAYS * lanes + self.lane])
        # Of 1 << SHARE_BITS: the share of an order in contexts of each class, and of new ids in order 0.
        start = np.concatenate([[0], (np.arange(1, 16) << SHARE_BITS) // np.arange(3, 18)])
        self.share = np.tile(start, 2 * lanes)
        self.row = np.stack([self.lane * 16, (lanes + self.lane) * 16])
        self.new = np.full(lanes, (1 << SHARE_BITS) - LEAST)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        # Order 0 of all lanes: lane and id in one rising sequence, and where the counts of each begin.
        self.had, self.at = np.zeros(1, np.int64) - 1, np.zeros(2, np.int64)
        self.total = 0

    def renew(self, seen: np.ndarray) -> None:
        """Renew order 0 from the ids so far, a row for each lane."""
        keys = np.sort(((self.lane << 32)[:, None] + seen).ravel())
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        # All lanes have as many ids, so the counts before a lane are known.
        self.had, self.at, self.total = keys[begins], np.append(begins, len(keys)), seen.shape[1]

    def predict(self) -> np.ndarray:
        """Where the code space of each candidate ends, in rows of candidates; order 0 has what lies beyond the last."""
        l = self.last * 2654435761
        hashed, parts = np.empty((2, self.n), np.int64), np.empty((2, self.n), np.int64)
        hashed[0], hashed[1] = (self.before * 40503 + l) >> 7, l >> 9
        self.slot = self.base + (hashed & self.mask)
        self.found = found = self.cells[self.slot[:, None, :] * WAYS + self.ways]
        self.named, self.seen = found >> np.uint32(8), found & np.uint32(255)
        counts = self.seen.astype(np.int64)
        sums = counts.sum(1)
        self.spot = self.row + CLASSES[sums]
        self.own = self.share[self.spot]
        parts[0] = self.own[0] * (MOST >> SHARE_BITS)
        parts[1] = ((MOST - parts[0]) >> SHARE_BITS) * self.own[1]
        parts //= np.maximum(sums, 1)
        counts *= parts[:, None, :]
        # What both orders know goes to its place in order 2.
        both = self.named[0][:, None, :] == self.named[1]
        self.joint = (both * counts[1]).sum(1)
        counts[0] += self.joint
        counts[1] *= ~both.any(0)
        self.mass = counts.reshape(2 * WAYS, self.n)
        ends = self.mass.copy()
        for k in range(1, 2 * WAYS):
            ends[k] += ends[k - 1]
        return ends

    def learn(self, ids: np.ndarray, way: np.ndarray, hit: np.ndarray) -> None:
        """Take the ids; ``way`` is the candidate that coded each, where ``hit``."""
        total = self.mass[way, self.lane]
        of_one = np.where(way < WAYS, self.joint[np.minimum(way, WAYS - 1), self.lane], total)
        one = (of_one << SHARE_BITS) // np.maximum(total, 1) * hit
        two = (hit.astype(np.int64) << SHARE_BITS) - one
        left = ((1 << SHARE_BITS) - two) * self.own[1] >> SHARE_BITS
        moved = np.empty((2, self.n), np.int64)
        moved[0], moved[1] = two - self.own[0], one - left
        moved >>= RATE
        moved += self.own
        self.share[self.spot] = np.minimum(np.maximum(moved, LEAST), (1 << SHARE_BITS) - LEAST) * (self.own > 0)
        equal = self.named == ids.astype(np.uint32)
        known = equal.any(1)
        # The place of the id or, of four, that of the least count.
        first, second = self.seen[:, 1] < self.seen[:, 0], self.seen[:, 3] < self.seen[:, 2]
        rarest = np.where(np.minimum(self.seen[:, 2], self.seen[:, 3]) < np.minimum(self.seen[:, 0], self.seen[:, 1]), second + 2, first)
        place = np.where(known, equal[:, 1] + 2 * equal[:, 2] + 3 * equal[:, 3], rarest)
        there = self.found.reshape(-1)[self.spread + place * self.n].astype(np.int64)
        now = there & 255
        # An unknown id takes the place of a rare one; a more frequent one loses a count and stays.
        rare = now <= 2
        self.cells[self.slot * WAYS + place] = np.where(known, there + np.minimum(2, LIMIT - now), np.where(rare, ids << 8 | 2, there - 1))
        self.before, self.last = self.last, ids

    def room(self, lanes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What new ids have of the code space behind ``ends``; at least a part for each id, and all as long as no id was had."""
        rest = (1 << BITS) - ends
        return np.maximum(rest * self.new[lanes] >> SHARE_BITS, self.vocabulary) if self.total else rest

    def took(self, lanes: np.ndarray, known: np.ndarray) -> None:
        """Learn whether order 0 had the ids that it coded."""
        share = self.new[lanes]
        share = share + (((~known).astype(np.int64) << SHARE_BITS) - share >> RATE)
        self.new[lanes] = np.minimum(np.maximum(share, LEAST), (1 << SHARE_BITS) - LEAST)

    def looked_up(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether order 0 has ids, of which the last axis is lanes, and where their counts begin and end in their lane."""
        keys = (self.lane << 32) + ids
        place = np.minimum(np.searchsorted(self.had, keys), len(self.had) - 1)
        return self.had[place] == keys, self.at[place] - self.lane * self.total, self.at[place + 1] - self.lane * self.total

    def interval(self, ids: np.ndarray, lanes: np.ndarray, ends: np.ndarray, known: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of ids that order 0 codes, in the lanes given, as they were looked up."""
        room = self.room(lanes, ends)
        start, end = ends + room * ids // self.vocabulary, ends + room * (ids + 1) // self.vocabulary
        if self.total:
            base = ends + room
            rest = (1 << BITS) - base
            start, end = np.where(known, base + rest * low // self.total, start), np.where(known, base + rest * high // self.total, end)
        self.took(lanes, known)
        return start, end

    def find(self, value: np.ndarray, lanes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose order-0 intervals hold ``value``, with the intervals: the largest whose start is at most the value."""
        room = self.room(lanes, ends)
        into = value - ends
        known = into >= room
        ids = np.minimum(((into + 1) * self.vocabulary - 1) // room, self.vocabulary - 1)
        start, end = ends + room * ids // self.vocabulary, ends + room * (ids + 1) // self.vocabulary
        if self.total:
            rest, before = (1 << BITS) - ends - room, lanes * self.total
            target = ((np.maximum(into - room, 0) + 1) * self.total - 1) // rest
            place = np.searchsorted(self.at, before + target, "right") - 1
            ids = np.where(known, self.had[np.minimum(place, len(self.had) - 1)] & 0xFFFFFFFF, ids)
            start = np.where(known, ends + room + rest * (self.at[place] - before) // self.total, start)
            end = np.where(known, ends + room + rest * (self.at[np.minimum(place + 1, len(self.at) - 1)] - before) // self.total, end)
        self.took(lanes, known)
        return ids, start, end


def renewals(steps: int) -> set[int]:
    out, at = set(), 32.0
    while at < steps:
        out.add(int(at))
        at *= RENEW
    return out


def encode_lanes(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> list[bytes]:
    """Code of each row of ``ids`` (padded to equal length), as far as its length."""
    lanes, steps = ids.shape
    model, renew = Model(lanes, vocabulary), renewals(steps)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    out = np.zeros((lanes, steps + 4), np.uint32)
    used = np.zeros(lanes, np.int64)
    columns = np.ascontiguousarray(ids.T)
    turns = sorted({0, *renew, steps})
    for i in range(steps):
        if i in renew:
            model.renew(ids[:, :i])
        if i == turns[0]:  # order 0 stays as it is up to the next turn
            since, turns = i, turns[1:]
            known, lows, highs = model.looked_up(columns[i : turns[0]])
        now = columns[i]
        ends = model.predict()
        fits = (model.named.reshape(2 * WAYS, lanes) == now) & (model.mass > 0)
        hit = fits.any(0)
        way = fits.argmax(0)
        end = ends[way, model.lane]
        start = end - model.mass[way, model.lane]
        other = np.flatnonzero(~hit)
        if len(other):
            k = i - since
            start[other], end[other] = model.interval(now[other], other, ends[-1, other], known[k, other], lows[k, other], highs[k, other])
        live = i < lengths
        unit = span >> np.uint64(BITS)
        low = np.where(live, low + unit * start.astype(np.uint64), low)
        span = np.where(live, unit * (end - start).astype(np.uint64), span)
        small = np.flatnonzero(span <= _LOW32)
        if len(small):
            l, s = low[small], span[small]
            s = np.where((l ^ (l + s - np.uint64(1))) >> _WORD != 0, (~l & _LOW32) + np.uint64(1), s)
            out[small, used[small]] = (l >> _WORD).astype(np.uint32)
            used[small] += 1
            low[small], span[small] = l << _WORD, s << _WORD
        model.learn(now, way, hit)
    for k in (np.uint64(32), np.uint64(0)):
        out[np.arange(lanes), used] = (low >> k & _LOW32).astype(np.uint32)
        used += 1
    return [out[k, : used[k]].astype("<u4").tobytes() for k in range(lanes)]


def decode_lanes(codes: list[bytes], lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids again, a row for each code."""
    lanes, steps = len(codes), int(lengths.max(initial=0))
    model, renew = Model(lanes, vocabulary), renewals(steps)
    width = max(len(c) for c in codes) // 4 + 1
    words = np.zeros((lanes, width), np.uint64)
    for k, code in enumerate(codes):
        words[k, : len(code) // 4] = np.frombuffer(code, "<u4")
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    code = words[:, 0] << _WORD | words[:, 1]
    used = np.full(lanes, 2)
    columns = np.zeros((steps, lanes), np.int64)
    full = (1 << BITS) - 1
    for i in range(steps):
        if i in renew:
            model.renew(columns[:i].T)
        ends = model.predict()
        unit = span >> np.uint64(BITS)
        value = np.minimum((code - low) // unit, np.uint64(full)).astype(np.int64)
        way = (ends <= value).sum(0)
        hit = way < 2 * WAYS
        way = np.where(hit, way, 0)
        now = model.named[way // WAYS, way % WAYS, model.lane].astype(np.int64)
        end = ends[way, model.lane]
        start = end - model.mass[way, model.lane]
        other = np.flatnonzero(~hit)
        live = i < lengths
        if len(other):
            # A lane that has ended reads what comes after its code; any id will do there.
            now[other], start[other], end[other] = model.find(value[other], other, ends[-1, other])
        low = np.where(live, low + unit * start.astype(np.uint64), low)
        span = np.where(live, unit * (end - start).astype(np.uint64), span)
        small = np.flatnonzero(span <= _LOW32)
        if len(small):
            l, s = low[small], span[small]
            s = np.where((l ^ (l + s - np.uint64(1))) >> _WORD != 0, (~l & _LOW32) + np.uint64(1), s)
            code[small] = code[small] << _WORD | words[small, np.minimum(used[small], width - 1)]
            used[small] += 1
            low[small], span[small] = l << _WORD, s << _WORD
        now = np.clip(np.where(live, now, 0), 0, vocabulary - 1)
        columns[i] = now
        model.learn(now, way, hit)
    return columns.T


def encode_blocks(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> list[bytes]:
    """``ids`` as blocks of the file format, in order."""
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} lies beyond the vocabulary of {vocabulary}")
    out, group = [], block * LANES
    for at in range(0, len(ids), group):
        part = ids[at : at + group]
        n = -(-len(part) // block)
        lengths = np.full(n, block)
        lengths[-1] = len(part) - (n - 1) * block
        padded = np.zeros(n * block, np.int64)
        padded[: len(part)] = part
        padded = padded.reshape(n, block)[:, : int(lengths.max())]
        for k, code in enumerate(encode_lanes(padded, lengths, vocabulary)):
            own = padded[k, : lengths[k]].astype("<u4").tobytes()
            out.append(HEADER.pack(MAGIC, int(lengths[k]), len(code), zlib.crc32(own)) + code)
    return out


def decode_blocks(blocks: list[bytes], vocabulary: int) -> np.ndarray:
    """The ids of blocks in order; fails if a block is damaged."""
    out, lanes = [], LANES
    for at in range(0, len(blocks), lanes):
        part = blocks[at : at + lanes]
        heads = [HEADER.unpack_from(b) for b in part]
        if any(h[0] != MAGIC or HEADER.size + h[2] != len(b) for h, b in zip(heads, part, strict=True)):
            raise ValueError("not a block of token ids")
        ids = decode_lanes([b[HEADER.size :] for b in part], np.array([h[1] for h in heads]), vocabulary)
        for (_, n, _, crc), row in zip(heads, ids, strict=True):
            own = row[:n].astype("<u4")
            if zlib.crc32(own.tobytes()) != crc:
                raise ValueError("a block's ids do not have its checksum")
            out.append(own)
    return np.concatenate(out) if out else np.zeros(0, "<u4")
