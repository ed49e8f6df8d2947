"""Weighted acyclic automata over sequences of labels.

A transducer reads a sequence label by label and gives a weight with each arc: the number of
sequences put in that begin with the labels read so far. So the weight of a phrase is found on its
last arc, and that of the empty phrase is the sum of the arcs at the start. States from which the
same arcs leave, to the same states with the same weights, are one state: tails that many
phrases share are stored once.

Sequences come in sorted order, as rows of label ids whose order is that of the labels (-1 fills
up short rows). The automaton is built depth by depth from the tails: the arcs of a depth are
grouped by their prefixes, and a group that the register of that depth holds already becomes the
registered state. All steps work on whole arrays.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(values: np.ndarray, by: int) -> np.ndarray:
    out = (values.astype(np.uint64) + _MIX[by]) * _MIX[(by + 1) % 4]
    out ^= out >> np.uint64(29)
    out *= _MIX[(by + 2) % 4]
    return out ^ (out >> np.uint64(32))


def sort_rows(rows: np.ndarray) -> np.ndarray:
    """The order of rows of small non-negative numbers or -1, first column first."""
    columns = [rows[:, d].astype(np.int64) + 1 for d in range(rows.shape[1])]
    keys = []
    while columns:  # two columns a key
        right = columns.pop()
        keys.append((columns.pop() << 32) | right if columns else right)
    return np.lexsort(keys)


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in sorted order with the sums of their counts."""
    if not len(rows):
        return rows, counts
    order = sort_rows(rows)
    rows, counts = rows[order], counts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new], np.add.reduceat(counts, np.flatnonzero(new))


class Transducer:
    """States 0..n-1 with arcs first[s]..first[s + 1]; state 0 has none and ends every path."""

    def __init__(self, labels: list[bytes], start: int, first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.labels, self.start = labels, start
        self.first, self.label, self.weight, self.target = first, label, weight, target

    @classmethod
    def build(cls, labels: list[bytes], rows: np.ndarray, counts: np.ndarray) -> Transducer:
        """From distinct sorted ``rows`` of ids into the sorted ``labels``; a count for each row."""
        depth = rows.shape[1]
        new = np.zeros((depth + 1, len(rows)), bool)  # whether a prefix of that length begins
        new[0, :1] = True
        for d in range(depth):
            new[d + 1] = new[d]
            new[d + 1, 1:] |= rows[1:, d] != rows[:-1, d]
        first, label, weight, target = [np.zeros(1, np.int64)], [], [], []
        n_states, n_arcs, start = 1, 0, 0
        below = np.zeros(len(rows), np.int64)  # by row, the state that its prefix of the next depth leads to
        for d in range(depth - 1, -1, -1):
            begins = np.flatnonzero(new[d + 1])
            if not len(begins):
                break
            sums = np.add.reduceat(counts, begins)
            real = rows[begins, d] >= 0
            begins, sums = begins[real], sums[real]
            if not len(begins):
                continue
            arcs = np.stack((rows[begins, d].astype(np.int64), sums, below[begins]), 1)
            parents = (np.cumsum(new[d]) - 1)[begins]  # number of the prefix that each arc leaves
            lead = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
            sizes = np.diff(np.append(lead, len(arcs)))
            # the register: groups of equal arcs, told by their number and two sums of mixed arcs
            told = np.stack([np.add.reduceat(_mixed(arcs[:, 0], k) ^ _mixed(arcs[:, 1], k + 1) * _MIX[k] ^ _mixed(arcs[:, 2], (k + 2) % 4), lead) for k in (0, 1)], 1)
            key = np.empty(len(lead), [("n", np.int64), ("a", np.uint64), ("b", np.uint64)])
            key["n"], key["a"], key["b"] = sizes, told[:, 0], told[:, 1]
            order = np.lexsort((key["b"], key["a"], key["n"]))
            fresh = np.ones(len(order), bool)
            fresh[1:] = key[order][1:] != key[order][:-1]
            state = np.empty(len(order), np.int64)
            state[order] = np.cumsum(fresh) - 1 + n_states
            chosen = order[fresh]
            lengths = sizes[chosen]
            at = np.repeat(lead[chosen] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            first.append(n_arcs + np.concatenate(([0], np.cumsum(lengths)[:-1])))
            for kept, column in ((label, 0), (weight, 1), (target, 2)):
                kept.append(arcs[at, column])
            n_states, n_arcs = n_states + len(chosen), n_arcs + len(at)
            below = np.zeros(int(new[d].sum()), np.int64)
            below[parents[lead]] = state
            below = below[np.cumsum(new[d]) - 1]
            start = int(state[-1])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # state 0 owns the empty range before the first arc
        return cls(labels, start, np.append(join(first), n_arcs), join(label), join(weight), join(target))

    def paths(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, counts): the sequences put in, each with its own count."""
        states, rows = np.array([self.start]), np.empty((1, 0), np.int64)
        through = np.array([-1])
        out_rows, out_counts = [], []
        for d in range(depth + 1):
            fan = self.first[states + 1] - self.first[states]
            parent = np.repeat(np.arange(len(states)), fan)
            arcs = np.repeat(self.first[states] - np.concatenate(([0], np.cumsum(fan)[:-1])), fan) + np.arange(fan.sum())
            run = np.concatenate(([0], np.cumsum(self.weight[arcs])))
            last = np.cumsum(fan)
            passed = run[last] - run[last - fan]
            ends = np.flatnonzero(through - passed > 0)
            out_rows.append(np.concatenate((rows[ends], np.full((len(ends), depth - d), -1)), 1))
            out_counts.append((through - passed)[ends])
            if not len(arcs):
                break
            rows = np.concatenate((rows[parent], self.label[arcs, None]), 1)
            through, states = self.weight[arcs], self.target[arcs]
        return np.concatenate(out_rows), np.concatenate(out_counts)

    def prefixes(self, depth: int):
        """For each length from 1: (rows of label ids, weights), in sorted order."""
        states, rows = np.array([self.start]), np.empty((1, 0), np.int64)
        for _ in range(depth):
            fan = self.first[states + 1] - self.first[states]
            parent = np.repeat(np.arange(len(states)), fan)
            arcs = np.repeat(self.first[states] - np.concatenate(([0], np.cumsum(fan)[:-1])), fan) + np.arange(fan.sum())
            rows = np.concatenate((rows[parent], self.label[arcs, None]), 1)
            states = self.target[arcs]
            yield rows, self.weight[arcs]

    @classmethod
    def union(cls, parts: list[Transducer], depth: int) -> Transducer:
        """One transducer for all sequences of ``parts``, weights added."""
        labels = sorted({word for part in parts for word in part.labels})
        place = {word: i for i, word in enumerate(labels)}
        rows, counts = [], []
        for part in parts:
            own = np.array([place[word] for word in part.labels] + [-1], np.int64)
            found, count = part.paths(depth)
            rows.append(own[found].astype(np.int32))  # -1 finds the last place
            counts.append(count)
        return cls.build(labels, *summed(np.concatenate(rows), np.concatenate(counts)))

    def compose(self, phrases: list[tuple[bytes, ...]]) -> list[int]:
        """Weights of all ``phrases``, 0 for those that no sequence begins with.

        The phrases, an acceptor of their own, and this automaton read a label a step together.
        """
        place = {word: i for i, word in enumerate(self.labels)}
        width = max(1, len(self.labels))
        arcs = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * width + self.label
        order = arcs.argsort(kind="stable")
        arcs = arcs[order]
        state, weight = np.full(len(phrases), self.start), np.zeros(len(phrases), np.int64)
        alive = np.arange(len(phrases))
        for step in range(max(map(len, phrases), default=0)):
            alive = alive[[len(phrases[i]) > step for i in alive]]
            weight[alive] = 0
            ids = np.array([place.get(phrases[i][step], -1) for i in alive], np.int64)
            alive, ids = alive[ids >= 0], ids[ids >= 0]
            wanted = state[alive] * width + ids
            at = np.searchsorted(arcs, wanted)
            hit = at < len(arcs)
            hit[hit] = arcs[at[hit]] == wanted[hit]
            alive, at = alive[hit], order[at[hit]]
            state[alive], weight[alive] = self.target[at], self.weight[at]
        return weight.tolist()

    # ---- bytes -----------------------------------------------------------------------------

    def dump(self) -> bytes:
        """Numbers in as few bytes as their largest needs, then the labels."""
        parts = [np.array([self.start], np.int64), self.first, self.label, self.weight, self.target, np.array([len(w) for w in self.labels], np.int64)]
        out = []
        for part in parts:
            size = next(s for s in (1, 2, 4, 8) if int(part.max(initial=0)) < 1 << (8 * s - 1))
            out += [np.array([len(part), size], np.int64).tobytes(), part.astype(f"<i{size}").tobytes()]
        return b"".join(out + self.labels)

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        at, parts = 0, []
        for _ in range(6):
            n, size = np.frombuffer(data, np.int64, 2, at).tolist()
            parts.append(np.frombuffer(data, f"<i{size}", n, at + 16).astype(np.int64))
            at += 16 + n * size
        ends = at + np.cumsum(parts[5])
        labels = [data[a:b] for a, b in zip((ends - parts[5]).tolist(), ends.tolist())]
        return cls(labels, int(parts[0][0]), *parts[1:5])


def cut_points(labels: list[bytes], rows: np.ndarray, borders: list[tuple[bytes, ...]]) -> list[int]:
    """For each border the number of sorted ``rows`` that stand before it."""
    def spelt(i: int) -> tuple[bytes, ...]:
        return tuple(labels[j] for j in rows[i] if j >= 0)

    return [bisect_left(range(len(rows)), border, key=spelt) for border in borders]
