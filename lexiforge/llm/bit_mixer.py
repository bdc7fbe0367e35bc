"""The bits of units, coded by logistic mixing of hashed-context predictors. NumPy only; context_mixing distributes it.

A text is cut into units: what lies between blanks or line ends, with that separator, in pieces of at most UNIT
bytes, and a last unit for the end. A unit's bytes are coded bit by bit. Four predictors say how often the bit was
0 and 1 in the training texts: after the last byte, the last two, the last three (hashed), and after the whole
unit so far. A mixer adds their log-odds with weights from a set that a gate selects (the bit's place, and how
often the unit so far is known), and an adaptive probability map refines the sum.

All inputs are log-odds of the bit that came, not of a 1: the sign of the sum then tells how well it was foreseen.
Whether a unit's own occurrence is left out of the counts (as it must be when weights are learned) is `loo`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNIT = 48
#: Fixed value: no UTF-8 text has this byte. As a unit it is the end of a text.
END = b"\xff"
WINDOW = 1 << 21
BINS, LIMIT = 33, 12.0
PREDICTORS = 4
KNOWN = np.array([1, 2, 4, 16], np.float32)  # bounds of the gate's classes of counts
GATES = 8 * (len(KNOWN) + 1)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def pieces_of(text: bytes, window: int = WINDOW) -> Iterator[list[bytes]]:
    """What lies between blanks and line ends, lower-cased, a line end with its piece: lists that cover a window of the text each."""
    low, at = text.translate(_LOWER), 0
    while True:
        stop = len(low)
        if stop - at > window:
            cut = max(low.rfind(b" ", at, at + window), low.rfind(b"\n", at, at + window))
            if cut < 0:  # one piece is longer
                cut = min((x for x in (low.find(b" ", at + window), low.find(b"\n", at + window)) if x >= 0), default=stop)
            stop = min(cut + 1, stop)
        pieces = low[at:stop].replace(b"\n", b"\n ").split(b" ")
        if stop == len(low):
            yield pieces
            return
        pieces.pop()  # after the separator
        yield pieces
        at = stop


def cut(piece: bytes) -> list[bytes]:
    """A long piece as units of UNIT bytes without a separator, and a last one with it."""
    out = [piece[i : i + UNIT] for i in range(0, len(piece), UNIT)]
    if len(piece) % UNIT == 0 and not piece.endswith(b"\n"):
        out.append(b"")
    return out


def coded(unit: bytes) -> bytes:
    """A unit's bytes with its separator. No unit is the beginning of another."""
    return unit if unit.endswith(b"\n") or len(unit) == UNIT or unit == END else unit + b" "


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays by place of byte, compressed: small numbers take little."""
    parts, head = [], {}
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        parts.append(pa.compress(raw, "zstd", asbytes=True) if raw else b"")
        head[name] = (a.dtype.str, len(a), len(raw), len(parts[-1]))
    first = json.dumps(head).encode()
    return len(first).to_bytes(4, "little") + first + b"".join(parts)


def unpacked(raw) -> dict[str, np.ndarray]:
    raw = memoryview(raw)
    n = int.from_bytes(raw[:4], "little")
    out, at = {}, 4 + n
    for name, (kind, rows, size, stored) in json.loads(bytes(raw[4 : 4 + n])).items():
        data = pa.decompress(raw[at : at + stored], size, "zstd", asbytes=True) if size else b""
        out[name] = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, rows).T).reshape(-1).view(kind) if rows else np.zeros(0, kind)
        at += stored
    return out


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in the order in which they come, and for each key its place among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys with the sums of their numbers."""
    own, where = grouped(keys)
    total = np.bincount(where, n, len(own))
    order = np.argsort(own)
    return own[order], total[order]


def path_counts(sorted_keys: np.ndarray, n: np.ndarray, bits: int = 8) -> np.ndarray:
    """For each key the sums over keys that agree but for the last `bits` bits, for the last bits - 1, and so on to the key itself: shape (keys, bits + 1)."""
    out = np.empty((len(n), bits + 1), np.float32)
    for j in range(bits + 1):
        k = sorted_keys >> sorted_keys.dtype.type(bits - j)
        at = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        out[:, j] = np.bincount(at, n)[at] if len(k) else 0
    return out


def evidence(path: np.ndarray, loo: int = 0) -> np.ndarray:
    """Log-odds of the bits that came, from counts along their path."""
    came = np.maximum(path[..., 1:] - np.float32(loo), 0)
    other = path[..., :-1] - path[..., 1:]
    return np.log((came + np.float32(0.4)) / (other + np.float32(0.4)))


class Units:
    """Sorted different units (coded) as one flat array, and how often each came."""

    def __init__(self, array: pa.Array, n: np.ndarray) -> None:
        offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        self.n, self.lengths = n.astype(np.float64), np.diff(offsets)
        self.data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.begins = offsets[:-1] - offsets[0]

    def matrix(self, width: int) -> np.ndarray:
        """First bytes of each unit, 0 beyond its end."""
        out = np.zeros((len(self.n), width), np.uint8)
        of, place = self.places()
        inside = place < width
        out[of[inside], place[inside]] = self.data[inside]
        return out

    def keys(self) -> np.ndarray:
        """A hash of each unit."""
        h = self.lengths.astype(np.uint64)
        for word in self.matrix(8 * (UNIT // 8 + 1)).view("<u8").T:
            h = mixed(h ^ word) + _ODD[2]
        return h

    def heads(self) -> np.ndarray:
        m = self.matrix(3).astype(np.uint32)
        return m[:, 0] << 16 | m[:, 1] << 8 | m[:, 2]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Unit and place in it of each byte."""
        of = np.repeat(np.arange(len(self.n), dtype=np.int32), self.lengths)
        return of, np.arange(len(of), dtype=np.int32) - np.repeat(self.begins.astype(np.int32), self.lengths)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte the keys of its contexts of two and of three (hashed) bytes, with the byte last; blanks stand before the unit."""
        place = self.places()[1]
        x = self.data.astype(np.uint32)
        one, two, three = (np.where(place >= k, np.concatenate([np.zeros(k, np.uint32), x[:-k] if k < len(x) else x[:0]])[: len(x)], np.uint32(32)) for k in (1, 2, 3))
        third = mixed((three.astype(np.uint64) << np.uint64(16)) | (two.astype(np.uint64) << np.uint64(8)) | one.astype(np.uint64))
        return two << 16 | one << 8 | x, (third >> np.uint64(48)).astype(np.uint32) << 8 | x

    def path(self, heads: np.ndarray, head_path: np.ndarray) -> np.ndarray:
        """Counts along the path of each byte after the unit so far. The first three bytes come from the counts of all units' heads."""
        of, place = self.places()
        out = np.empty((len(of), 9), np.float32)
        own = head_path[np.searchsorted(heads, self.heads())]
        for p in range(3):
            at = np.flatnonzero(self.lengths > p)
            out[self.begins[at] + p] = own[at, 8 * p : 8 * p + 9]
        # Units are in order, so those with a common beginning are neighbours: a new node begins where fewer bits agree with the unit before.
        same = self.common_bits()
        for p in range(3, int(self.lengths.max(initial=0))):
            at = np.flatnonzero(self.lengths > p)
            n, agree = self.n[at], same[at]
            for j in range(9):
                node = np.cumsum(agree < 8 * p + j)
                out[self.begins[at] + p, j] = np.bincount(node, n)[node]
        return out

    def common_bits(self) -> np.ndarray:
        """Number of leading bits in which each unit agrees with the one before."""
        m = self.matrix(int(self.lengths.max(initial=0)))
        out = np.zeros(len(m), np.int64)
        if len(m) > 1:
            diff = m[1:] ^ m[:-1]
            first = np.argmax(diff > 0, axis=1)
            out[1:] = 8 * first + 8 - np.array([int(x).bit_length() for x in range(256)])[diff[np.arange(len(diff)), first]]
        return out


class Low:
    """The predictors of low order: counts by two bytes and by three hashed bytes, and of the units' first bytes. At most 2 ** 24 keys each."""

    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        self.heads, self.head_path = tables["heads"], path_counts(tables["heads"], tables["heads_n"], 24)
        self.keys = [tables["two"], tables["three"]]
        one, n = summed(tables["two"] & np.uint32(0xFFFF), tables["two_n"])
        self.one = np.zeros(1 << 16, np.int32)
        self.one[one] = np.arange(len(one))
        paths = [path_counts(one, n), path_counts(tables["two"], tables["two_n"]), path_counts(tables["three"], tables["three_n"])]
        self.odds = [[evidence(p, loo) for p in paths] for loo in (0, 1)]

    @staticmethod
    def of(units: Units) -> dict[str, np.ndarray]:
        two, three = units.windows()
        n = np.repeat(units.n, units.lengths)
        out = {}
        for name, keys, times in (("heads", units.heads(), units.n), ("two", two, n), ("three", three, n)):
            out[name], out[f"{name}_n"] = summed(keys, times)
        return out

    @staticmethod
    def merged(all_: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        out = {}
        for name in ("heads", "two", "three"):
            out[name], out[f"{name}_n"] = summed(np.concatenate([t[name] for t in all_] or [np.zeros(0, np.uint32)]), np.concatenate([t[f"{name}_n"] for t in all_] or [np.zeros(0)]))
        return out

    def places(self, units: Units) -> list[np.ndarray]:
        two, three = units.windows()
        return [self.one[two & np.uint32(0xFFFF)], np.searchsorted(self.keys[0], two), np.searchsorted(self.keys[1], three)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _bins(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (total + np.float32(LIMIT)) * np.float32((BINS - 1) / (2 * LIMIT))
    low = np.minimum(x.astype(np.int32), BINS - 2)
    return low, x - low.astype(np.float32)


def identity() -> np.ndarray:
    return np.tile(np.linspace(-LIMIT, LIMIT, BINS, dtype=np.float32), (256, 1))


@dataclass
class Bits:
    """What is known of each bit of some bytes: inputs (predictors, bytes, 8), gate, the byte's bits so far, and the bit."""

    inputs: np.ndarray
    gate: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def of(cls, low: Low, places: list[np.ndarray], path: np.ndarray, data: np.ndarray, at: np.ndarray, loo: int) -> Bits:
        own = path[at]
        inputs = np.stack([*(odds[p[at]] for odds, p in zip(low.odds[loo], places, strict=True)), evidence(own, loo)])
        gate = np.arange(8) * (len(KNOWN) + 1) + np.searchsorted(KNOWN, own[:, :8] - np.float32(loo), side="right")
        x = data[at].astype(np.int32)[:, None] | 256
        return cls(inputs, gate, x >> (8 - np.arange(8, dtype=np.int32)), np.unpackbits(data[at]).reshape(-1, 8))

    def total(self, weights: np.ndarray) -> np.ndarray:
        out = self.inputs[0] * weights[:, 0][self.gate]
        for k in range(1, PREDICTORS):
            out += self.inputs[k] * weights[:, k][self.gate]
        return np.clip(out, -LIMIT, LIMIT)

    def sign(self) -> np.ndarray:
        return 2 * self.bit.astype(np.float32) - 1


class Learner:
    """Weights and map, learned online: each step of some units moves the weights of each gate by the mean gradient of the coding cost, units weighing as often as they came."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = np.full((GATES, PREDICTORS), 0.3, np.float32) if weights is None else weights.copy()
        self.seen, self.map = np.zeros(GATES), np.zeros((2, 256 * BINS))  # bits by gate; by bit, how often it came in each cell

    def learn(self, bits: Bits, n: np.ndarray, rate: float) -> None:
        total, weigh = bits.total(self.weights), np.repeat(n, 8).reshape(-1, 8)
        gate, off = bits.gate.reshape(-1), (weigh * _sigmoid(-total)).reshape(-1)
        seen = np.bincount(gate, weigh.reshape(-1), GATES)
        for k in range(PREDICTORS):
            self.weights[:, k] += (rate * np.bincount(gate, off * bits.inputs[k].reshape(-1), GATES) / np.maximum(seen, 1e-9)).astype(np.float32)
        self.seen += seen
        low, up = _bins((total * bits.sign()).reshape(-1))
        y, at, w = bits.bit.reshape(-1), bits.node.reshape(-1) * BINS + low, weigh.reshape(-1)
        for shift, share in ((0, 1 - up), (1, up)):
            for b in (0, 1):
                self.map[b] += np.bincount(at + shift, share * w * (y == b), 256 * BINS)

    def refine(self) -> np.ndarray:
        """The map of log-odds, begun at the identity."""
        n0, n1 = (8.0 * _sigmoid(sign * identity()) + n.reshape(256, BINS) for sign, n in zip((-1, 1), self.map, strict=True))
        return np.log(n1 / n0).astype(np.float32)


def unit_costs(units: Units, low: Low, weights: np.ndarray, refine: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """-log10 of each unit's probability, shape (2, units): as counted, and with one occurrence of it left out."""
    path, places, out = units.path(low.heads, low.head_path), low.places(units), np.zeros((2, len(units.n)))
    flat = refine.reshape(-1)
    for loo in (0, 1):
        cost = np.empty(len(units.data), np.float64)
        for i in range(0, len(cost), step):
            at = np.arange(i, min(i + step, len(cost)))
            bits = Bits.of(low, places, path, units.data, at, loo)
            z, sign = bits.total(weights), bits.sign()
            below, up = _bins(z * sign)
            cell = bits.node * BINS + below
            r = flat[cell] + (flat[cell + 1] - flat[cell]) * up
            cost[at] = np.log1p(np.exp(-(z + r * sign) / 2)).sum(axis=1, dtype=np.float64)
        if len(cost):
            out[loo] = np.add.reduceat(cost, units.begins) / np.log(10)
    return out


def learned(units: Units, low: Low, weights: np.ndarray | None = None, rate: float = 0.02, step: int = 4096, seed: int = 7) -> Learner:
    """A learner that went through all units that came in training texts, in random order."""
    learner, path, places = Learner(weights), units.path(low.heads, low.head_path), low.places(units)
    known = np.random.default_rng(seed).permutation(np.flatnonzero(units.n > 0))
    upto = np.cumsum(units.lengths[known])
    for i in range(0, int(upto[-1]) if len(upto) else 0, step):
        own = known[np.searchsorted(upto, i, side="right") : np.searchsorted(upto, i + step, side="right")]
        if len(own):
            sizes = units.lengths[own]
            at = np.repeat(units.begins[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            learner.learn(Bits.of(low, places, path, units.data, at, 1), np.repeat(units.n[own], sizes), rate)
    return learner
