"""A byte-wise model of words: hashed-context bit predictors, gated logistic mixing, adaptive refinement."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from loadloom.llm.common import mix

#: Slots of each context's table: none, last byte, last two, last three, whole word so far.
SIZES = (1 << 8, 1 << 16, 1 << 18, 1 << 20, 1 << 20)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
GATES = 6 * 4
STEPS = 33


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word of each byte, context hash per order and byte) of the words, each with a blank at its end."""
    buf = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    lens = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(buf)) - np.repeat(np.cumsum(lens) - lens, lens)

    def back(k: int) -> np.ndarray:
        out = np.full(len(buf), 0x20, np.uint64)
        out[k:] = np.where(place[k:] >= k, buf[:-k], np.uint64(0x20))
        return out

    one, two, three = back(1), back(2), back(3)
    power = np.uint64(0x100000001B3)
    scale = np.multiply.accumulate(np.full(int(place.max(initial=0)) + 1, power))[place]
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf + np.uint64(7)) * scale, dtype=np.uint64)])
    prefix = run[:-1] - run[np.arange(len(buf)) - place]
    two = one | two << np.uint64(8)
    hashes = (np.zeros(len(buf), np.uint64), one, mix(two), mix(two | three << np.uint64(16) | np.uint64(1 << 40)),
              mix(prefix + place.astype(np.uint64)))
    return buf, of, np.stack(hashes)


def slots(hashes: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Table slot of every order for a bit whose earlier bits of the byte are ``node`` (a leading one before them)."""
    out = np.empty(hashes.shape, np.int64)
    for k, size in enumerate(SIZES):
        h = hashes[k] * np.uint64(256) + node if size <= 1 << 16 else mix(hashes[k] + node * np.uint64(0x9E3779B1))
        out[k] = (h & np.uint64(size - 1)).astype(np.int64) + OFFSETS[k]
    return out


def _shared(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte, context hashes, how often) of every distinct prefix of the words, and (prefix, word) of each of their bytes."""
    buf, of, h = contexts(words)
    _, first, which, times = np.unique(mix(h[4] + buf), return_index=True, return_inverse=True, return_counts=True)
    return buf[first], h[:, first], times, which, of


def _bits(buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(earlier bits with a leading one before them, bit) of all bytes, from the highest bit down."""
    whole = buf | np.uint64(256)
    for j in range(7, -1, -1):
        yield whole >> np.uint64(j + 1), (buf >> np.uint64(j) & np.uint64(1)).astype(np.int64)


def _parts(words: list[bytes], part_bytes: int, together: int = 1) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive parts of about ``part_bytes`` bytes; ``together`` words are never parted."""
    upto = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.arange(0, len(words), together)
    number = np.concatenate([[0], upto])[starts] // part_bytes
    cuts = [*starts[np.concatenate([[True], number[1:] != number[:-1]])].tolist(), len(words)] if len(words) else []
    yield from zip(cuts, cuts[1:])


def count_bits(words: list[bytes], part_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, zeros, ones) that the words' bits leave in the tables."""
    n = np.zeros(2 * OFFSETS[-1], np.int32)
    words = sorted(words)
    for a, b in _parts(words, part_bytes):
        buf, h, times, _, _ = _shared(words[a:b])
        times = times.astype(np.int32)
        for node, bit in _bits(buf):
            for s in slots(h, node):
                np.add.at(n, s * 2 + bit, times)
    n = n.reshape(-1, 2)
    used = np.flatnonzero(n.any(1))
    return used, n[used, 0], n[used, 1]


def _predictions(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every slot's stretched prediction and its share in the number of the gate: how sure the two longest contexts are."""
    seen = n0 + n1
    x = np.where(seen > 0, np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))), np.float32(0))
    sure = np.log2(1 + seen[OFFSETS[3]:])
    half = SIZES[3]
    return x, np.concatenate([np.minimum(3, np.ceil(sure[:half] / 2)), 4 * np.minimum(5, np.ceil(sure[half:]))]).astype(np.int8)


def _cells(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the mixed predictions, and where they stand in the refinement: the step below, and how far above it."""
    t = np.clip(t, -7.99, 7.99)
    at = (t + 8) * ((STEPS - 1) / 16)
    low = at.astype(np.int64)
    return _squash(t), low, at - low


@dataclass
class Mixer:
    """Bit counts of the corpus, gated mixing weights, and the refinement table (by partial byte and stretched prediction)."""

    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray
    refine: np.ndarray

    @cached_property
    def _whole(self) -> tuple[np.ndarray, np.ndarray]:
        return _predictions(self.zeros, self.ones)

    @cached_property
    def _without_one(self) -> tuple[np.ndarray, np.ndarray]:
        """Predictions at twice the slot plus a bit, without one such bit."""
        less = _predictions(np.maximum(0, self.zeros - 1), self.ones), _predictions(self.zeros, np.maximum(0, self.ones - 1))
        table, sure = (np.stack(t, 1).ravel() for t in zip(*less))
        return table, sure

    @classmethod
    def start(cls, zeros: np.ndarray, ones: np.ndarray) -> Mixer:
        return cls(zeros, ones, np.full((GATES, len(SIZES) + 1), 0.3), np.tile(_squash(np.linspace(-8, 8, STEPS)), (256, 1)))

    def learn(self, words: list[bytes], rate: float = 0.02, batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Learn weights and refinement online over the words' bits; each word's own counts are taken out first.

        Returns how many bits each gate and each cell of the refinement learned from.
        """
        gates, cells = np.zeros(GATES), np.zeros(self.refine.size)
        flat = self.refine.reshape(-1)
        for a, b in _parts(words, 1 << 14, 200):
            buf, of, h = contexts(words[a:b])
            # a step learns one bit of up to ``batch`` bytes of 200 words
            place = np.arange(len(buf)) - np.searchsorted(of, of // 200 * 200)
            first = place % batch == 0
            step, cuts = np.cumsum(first) - 1, np.append(np.flatnonzero(first), len(buf))
            groups = np.append(np.flatnonzero(place[cuts[:-1]] == 0), len(cuts) - 1)
            ready = self._by_gate(buf, h, step)
            if len(groups) > 2:  # else each bit is needed once, and the words may be long
                ready = list(ready)
            for start, end in zip(groups, groups[1:]):
                for j, (inputs, bits, cell_of, met_of) in enumerate(ready):
                    lo = n = STEPS << j  # the cells of this bit
                    here, mass_here = flat[lo:lo + n], cells[lo:lo + n]
                    for k in range(start, end):
                        now, met = slice(cuts[k], cuts[k + 1]), met_of[k]
                        y, x = bits[now], inputs[:, now]
                        p, low, share = _cells(np.einsum("ij,ij->j", np.repeat(self.weights.T, met, 1), x))
                        miss, gate = (y - p) * x, np.flatnonzero(met)
                        gates += met
                        self.weights[gate] += rate * np.add.reduceat(miss, np.cumsum(met[gate]) - met[gate], 1).T / np.sqrt(met[gate])[:, None]
                        cell = cell_of[now] + (low - lo)
                        for col, w in ((cell, 1 - share), (cell + 1, share)):
                            mass = np.bincount(col, w, n)
                            here += 0.02 * np.bincount(col, w * (y - here[col]), n) / np.maximum(1, mass * 0.02)
                            mass_here += mass
        return gates, cells

    def _by_gate(self, buf: np.ndarray, h: np.ndarray, step: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(inputs, bits, first cell of the refinement, how many of each gate by step) of every bit of the bytes, a step's in the order of their gates."""
        table, sure = self._without_one
        for node, bit in _bits(buf):
            s = slots(h, node) * 2 + bit
            key = step * GATES + sure.take(s[3] - 2 * OFFSETS[3]) + sure.take(s[4] - 2 * OFFSETS[3])
            order = np.argsort(key.astype(np.int16) if step[-1] < 1000 else key, kind="stable")
            x = np.full((len(SIZES) + 1, len(buf)), 0.3)
            x[:-1] = table.take(s).take(order, 1)
            yield x, bit.take(order), node.take(order).astype(np.int64) * STEPS, np.bincount(key, minlength=step[-1] * GATES + GATES).reshape(-1, GATES)

    @classmethod
    def fit(cls, zeros: np.ndarray, ones: np.ndarray, words: list[bytes]) -> Mixer:
        """The mixer after one process has learned from all ``words``."""
        self = cls.start(zeros, ones)
        self.learn(words)
        return self

    def log2_words(self, words: list[bytes], part_bytes: int = 1 << 18) -> np.ndarray:
        """log2 probability of each word with its end."""
        out = np.zeros(len(words))
        order = sorted(range(len(words)), key=words.__getitem__)
        words = [words[i] for i in order]
        table, sure = self._whole
        weights = np.ascontiguousarray(self.weights.T)
        for a, b in _parts(words, part_bytes):
            buf, h, _, which, of = _shared(words[a:b])
            total = np.zeros(len(buf))
            for node, bit in _bits(buf):
                s = slots(h, node)
                x = np.full((len(SIZES) + 1, len(buf)), 0.3)
                x[:-1] = table.take(s)
                gate = sure.take(s[3] - OFFSETS[3]) + sure.take(s[4] - OFFSETS[3])
                p, low, share = _cells(np.einsum("ij,ij->j", weights.take(gate, 1), x))
                n = node.astype(np.int64)
                p = 0.5 * p + 0.5 * (self.refine[n, low] * (1 - share) + self.refine[n, low + 1] * share)
                total += np.log2(np.clip(np.where(bit == 1, p, 1 - p), 1e-9, 1))
            out[order[a:b]] = np.bincount(of, total[which], b - a)
        return out
