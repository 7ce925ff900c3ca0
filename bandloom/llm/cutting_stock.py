"""Cutting stock by column generation: patterns of length classes, their linear program, and where ranked documents go."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np

#: Length classes of a sequence: pieces are taken as multiples of 1/512 of it, rounded up.
CLASSES = 512
#: The linear program ends when its patterns are proven to be within this share of the fewest.
GAP = 2e-4
_RANK_BITS = 40


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of pieces that fits, by dynamic programming over the room; sizes ascend."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if k := fitting[w]:
            values = prices[:k] + best[w - sizes[:k]]
            j = int(values.argmax())
            if values[j] > best[w]:
                best[w], choice[w] = values[j], j
    pattern, w = np.zeros(len(sizes)), room
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(best[room]), pattern


def greedy_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, times): a first basis. Each pattern fills a room with the largest pieces that are left and is taken until one of
    its sizes runs out; later patterns do without that one, so the columns are independent."""
    left, columns, times = demand.astype(float), [], []
    gone = np.zeros(len(sizes), bool)
    while not gone.all():
        pattern, space, lead = np.zeros(len(sizes)), room, len(sizes) - 1 - int(gone[::-1].argmin())
        for k in range(lead, -1, -1):
            if space >= sizes[k] and (left[k] > 0 or k == lead) and not gone[k]:
                n = space // sizes[k] if k == lead else min(space // sizes[k], max(1, int(left[k] * pattern[lead] // max(left[lead], 1e-9))))
                pattern[k] = n
                space -= n * sizes[k]
                if left[lead] <= 0:
                    break
        used = np.flatnonzero(pattern)
        ratio = left[used] / pattern[used]
        first = int(ratio.argmin())
        columns.append(pattern)
        times.append(ratio[first])
        left[used] = np.maximum(0, left[used] - ratio[first] * pattern[used])
        left[used[first]], gone[used[first]] = 0, True
    return np.array(columns).reshape(len(sizes), len(sizes)).T.copy(), np.array(times)


def fractional_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[float, np.ndarray]]:
    """(times, pattern) of a cutting of `demand` pieces of each size into rooms, nearly as few as any, by the simplex method. Its
    columns are priced out by best_pattern(); with its value v, the duals divided by v prove a lower bound."""
    m = len(sizes)
    columns, times = greedy_patterns(sizes, demand, room)
    inverse = np.linalg.inv(columns)
    least = sizes @ demand / room
    while times.sum() > least * (1 + GAP):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, prices, room)
        if value <= 1 + 1e-9 or times.sum() <= prices @ demand / value * (1 + GAP):
            break
        w = inverse @ pattern
        ratio = np.full(m, np.inf)
        np.divide(times, w, out=ratio, where=w > 1e-9)
        r = int(ratio.argmin())
        step = ratio[r]
        times -= step * w
        times[r] = step
        np.maximum(times, 0, out=times)
        row = inverse[r] / w[r]
        inverse -= np.outer(w, row)
        inverse[r] = row
        columns[:, r] = pattern
    return [(t, columns[:, k]) for k, t in enumerate(times.tolist()) if t > 0]


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> Counter[tuple[int, ...]]:
    """Whole numbers of patterns, as sizes in descending order, that use each piece once at most: those of the linear program
    rounded down, one more of each that the rest has pieces for, and first-fit decreasing over what then is left, which are no
    more pieces than some patterns for each class hold, however many there were."""
    out: Counter[tuple[int, ...]] = Counter()
    left = demand.astype(np.int64)
    spelled = lambda p: tuple(int(s) for s, c in zip(sizes[::-1], p[::-1], strict=True) for _ in range(int(c)))
    parts = fractional_patterns(sizes, demand.astype(float), room)
    for t, p in parts:
        whole = int(min([t + 1e-9, *(left[p > 0] // p[p > 0])]))
        if whole:
            out[spelled(p)] += whole
            left -= whole * p.astype(np.int64)
    for _, p in sorted(parts, key=lambda x: -(x[0] % 1)):
        if (left >= p).all():
            out[spelled(p)] += 1
            left -= p.astype(np.int64)
    bins: list[list[int]] = []
    space = np.empty(0, np.int64)
    for s, c in zip(sizes[::-1].tolist(), left[::-1].tolist(), strict=True):
        for _ in range(c):
            fits = np.flatnonzero(space >= s)
            if len(fits):
                bins[fits[0]].append(s)
                space[fits[0]] -= s
            else:
                bins.append([s])
                space = np.append(space, room - s)
    out.update(tuple(b) for b in bins)
    return out


@dataclass
class Plan:
    """Where the document of each (length, rank) goes. Segments of ranks either stand whole at one offset of sequences in a row,
    or are laid end to end in a stream of tokens that fills what the others leave free."""

    keys: np.ndarray  # length << 40 | first rank of a segment, ascending
    sequence: np.ndarray  # of the segment's first document, or -1
    offset: np.ndarray  # in the sequence, or the place of the segment's first token in the stream
    base: np.ndarray  # slots: the place in the stream of the first of each row of equal slots
    size: np.ndarray
    first: np.ndarray  # the sequence of the first slot
    at: np.ndarray  # the offset of the slots
    sequences: int
    streamed: dict[int, int]  # length -> the first rank that is in the stream

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence or -1, offset or place in the stream) of documents."""
        key = (lengths << _RANK_BITS) + ranks
        k = np.searchsorted(self.keys, key, side="right") - 1
        behind = key - self.keys[k]
        whole = self.sequence[k] >= 0
        return np.where(whole, self.sequence[k] + behind, -1), self.offset[k] + np.where(whole, 0, behind * lengths)

    def cuts(self, place: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a document in the stream."""
        out, done = [], 0
        while done < length:
            k = int(np.searchsorted(self.base, place + done, side="right")) - 1
            slot, within = divmod(place + done - int(self.base[k]), int(self.size[k]))
            take = min(length - done, int(self.size[k]) - within)
            out.append((done, take, int(self.first[k]) + slot, int(self.at[k]) + within))
            done += take
        return out


def _assigned(patterns: list[tuple[tuple[int, ...], int]], counts: dict[int, int], unit: int):
    """(runs of equal sequences, what is left): a run is (count, [(length, first rank), ...]); left: (length, first rank, count).

    Documents of a class are taken by length, then rank; where the length changes within a pattern's documents, the run ends.
    """
    queues: dict[int, list[list[int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        queues[-(-length // unit)].append([length, 0, counts[length]])
    runs = []
    for pattern, times in patterns:
        taken, ends = [], {times}
        for c in pattern:
            need, own = times, []
            while need:
                top = queues[c][-1]
                n = min(need, top[2])
                own.append((times - need, top[0], top[1]))
                top[1], top[2], need = top[1] + n, top[2] - n, need - n
                if not top[2]:
                    queues[c].pop()
            taken.append(own)
            ends.update(at for at, _, _ in own)
        edges = sorted(ends | {0})
        at = [0] * len(taken)
        for lo, hi in zip(edges, edges[1:], strict=False):
            for i, own in enumerate(taken):
                if at[i] + 1 < len(own) and own[at[i] + 1][0] <= lo:
                    at[i] += 1
            runs.append((hi - lo, [(own[k][1], own[k][2] + lo - own[k][0]) for own, k in zip(taken, at, strict=True)]))
    return runs, [(length, rank, n) for q in queues.values() for length, rank, n in q[::-1]]


def plan_sequences(counts: dict[int, int], room: int) -> Plan:
    """counts: how many documents have each length below `room`, a power of two.

    Patterns place whole documents. What they leave of a sequence is filled, to the last token, by a stream of documents cut where
    need be: those that no pattern has taken, and as many of the emptiest patterns as it takes to fill the others. What then is
    left of the stream makes full sequences and at last one for each power of two in the rest, so nothing is padded.
    """
    unit = max(1, room // CLASSES)
    classes: Counter[int] = Counter()
    for length, n in counts.items():
        classes[-(-length // unit)] += n
    sizes = np.array(sorted(classes), np.int64)
    patterns = whole_patterns(sizes, np.array([classes[s] for s in sizes.tolist()], np.int64), room // unit)
    order = sorted(patterns.items(), key=lambda x: (-sum(x[0]), x[0]))
    while True:
        runs, left = _assigned(order, counts, unit)
        free = sum(n * (room - sum(length for length, _ in docs)) for n, docs in runs)
        have = sum(length * n for length, _, n in left)
        if have >= free:
            break
        lacking = -(-(free - have) // room)
        while lacking:
            pattern, times = order.pop()
            if times > lacking:
                order.append((pattern, times - lacking))
            lacking -= min(lacking, times)
    segments, slots, sequence, place = [], [], 0, 0
    for n, docs in runs:
        offset = 0
        for length, rank in docs:
            segments.append(((length << _RANK_BITS) + rank, sequence, offset))
            offset += length
        if offset < room:
            slots.append((place, room - offset, sequence, offset))
            place += n * (room - offset)
        sequence += n
    rest = have - free
    for size, n in [(room, rest // room), *((1 << b, rest >> b & 1) for b in range(room.bit_length() - 2, -1, -1))]:
        if n:
            slots.append((place, size, sequence, 0))
            place += n * size
            sequence += n
    place, streamed = 0, {}
    for length, rank, n in left:
        segments.append(((length << _RANK_BITS) + rank, -1, place))
        streamed[length] = min(rank, streamed.get(length, rank))
        place += length * n
    column = lambda rows, i: np.array([x[i] for x in rows], np.int64)
    segments.sort()
    return Plan(*(column(segments, i) for i in range(3)), *(column(slots, i) for i in range(4)), sequence, streamed)
