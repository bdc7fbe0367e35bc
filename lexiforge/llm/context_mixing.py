"""Language-model scores by logistic mixing of hashed-context bit predictors, over units that recur.

A text's units (bit_mixer) are coded one after the other. The bits of a unit depend on the unit alone, so each
different unit of the corpus is coded once, by the mixer of bit predictors, and not once for each time it comes.
In a text, three predictions of the next unit are weighed: that mixer's; how often the unit followed the one before in the
training texts; and how often it came in this text so far. Weights are picked by a gate: how well the unit before is
known, how many of the last three units were foreseen by the one before them, and whether the unit before had
come earlier in the text. So a text's state begins afresh and adapts as it is read, and its score depends on
nothing that is scored beside it. The sum of the logarithms is the text's log-probability.

All learning is over all training texts. The mixer's weights are learned online over units that weigh as often as they
came, one occurrence of the unit taken out of the counts; the gates' weights by expectation-maximisation in parts, the
text's own counts of pairs taken out and one occurrence of each unit;
tasks' results are merged by averages weighted by what each saw, and by sums.

Nothing that grows with the corpus is held whole anywhere. Texts are cut into parts of bounded size. What a
part needs to know of the corpus (its units' costs, its pairs' and words' counts) it asks of ranges: blocks of
keys go from parts to ranges, are summed there, and the answers come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.bit_mixer import END, GATES, PREDICTORS, UNIT, Learner, Low, Units, coded, cut, grouped, identity, learned, mixed, packed, pieces_of, unit_costs, unpacked
from lexiforge.llm.common import _remove, release, scratch, stored, text_of
from lexiforge.llm.shared_files import read_whole, write_whole

#: Bounds of a part: units, different units, and texts. With one window of a text more, places fit 22 bits and units 20.
MOST, MOST_UNITS, MOST_TEXTS = 1_800_000, 350_000, 1 << 17
_UNIT_BITS, _PLACE_BITS = np.uint64(20), np.uint64(22)
#: Different units of a range, and keys of one, that a task takes at a time.
RANGE_UNITS, RANGE_KEYS = 250_000, 2_000_000
#: Classes of the count of the unit before; with 4 of foreseen units and 2 of recurring ones they make the gates of a text.
BEFORE = np.array([1, 2, 8, 64, 1024])
TEXT_GATES = (len(BEFORE) + 1) * 4 * 2
_START = np.array([0.6, 0.3, 0.1])
#: Fixed value: in place of a word, the end of a text. No word has a blank in it.
END_WORD = b" "


class _Index(dict):
    """Units by place. A long piece has none: it must be cut."""

    def __missing__(self, piece: bytes) -> int:
        if len(piece) >= UNIT:
            return -1
        self[piece] = n = len(self)
        return n


class _Part:
    """Some texts, as places of units in a list of their own."""

    def __init__(self, path: str) -> None:
        self.path, self.index, self.words, self.n = path, _Index(), {}, 0
        self.ids, self.rows, self.extra = [], [], []  # extra: (row, word, 1) of words in long pieces, (row, word, -1) of those that only their tails' units have

    def add(self, row: tuple, pieces: list[bytes], before: bytes, last: bool) -> bytes:
        """A stretch of a text, after the unit `before`; returns the last unit as a key."""
        ids = list(map(self.index.__getitem__, pieces))
        key = pieces[-1] if pieces else before
        if min(ids, default=0) < 0:
            ids = []
            for piece in pieces:
                if len(piece) < UNIT:
                    ids.append(self.index[piece])
                    key = piece
                    continue
                cuts = cut(piece)
                # A tail's unit is one like others, whose words are counted wherever it stands: here they are none.
                tail = cuts[-1] if len(cuts[-1]) < UNIT else b""
                for of, sign in ((piece, 1), (tail, -1)):
                    self.extra += [(len(self.rows), self.words.setdefault(w, len(self.words)), sign) for w in of.split()]
                for unit in cuts:
                    key = b"\xfe" + unit if len(unit) == UNIT else unit  # not the key of a piece as long, which is cut further
                    ids.append(self.index.setdefault(key, len(self.index)))
        if last:
            ids.append(self.index[END])
        self.rows.append((*row, len(ids), self.index[before] if len(before) < UNIT else self.index.setdefault(before, len(self.index))))
        self.ids.append(np.array(ids, np.uint32))
        self.n += len(ids)
        return key

    def full(self) -> bool:
        return self.n >= MOST or len(self.index) >= MOST_UNITS or len(self.rows) >= MOST_TEXTS

    def closed(self, part: int) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        doc_ids, no_id, held, n_bytes, of_part, of_row, lengths, before = (np.array(x) for x in zip(*self.rows, strict=True))
        train = np.repeat(~held, lengths)
        times = np.bincount(ids[train], minlength=len(self.index))
        units, of_unit, of_word = [], [], []
        for i, u in enumerate(self.index):
            long_ = u[:1] == b"\xfe"
            units.append(u[1:] if long_ else coded(u))
            found = [END_WORD] if u == END else () if long_ else u.split()
            for w in found:
                of_unit.append(i)
                of_word.append(self.words.setdefault(w, len(self.words)))
        of_unit, of_word = np.array(of_unit, np.int64), np.array(of_word, np.int64)
        row, word, sign = (np.array(x, np.int64) for x in zip(*self.extra, strict=True)) if self.extra else (np.zeros(0, np.int64),) * 3
        learned_from = ~held[row]
        counts = np.bincount(of_word, times[of_unit], len(self.words)) + np.bincount(word[learned_from], sign[learned_from], len(self.words))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        blob = b"".join(units)
        raw = packed(
            ids=ids, lengths=lengths, before=before.astype(np.uint32), doc_ids=doc_ids, no_id=no_id, held=held, n_bytes=n_bytes, of_part=of_part, of_row=of_row,
            unit_lengths=np.array([len(u) for u in units], np.uint8), unit_bytes=np.frombuffer(blob, np.uint8), times=times,
            of_unit=of_unit.astype(np.uint32), of_word=of_word.astype(np.uint32), words=hashes, word_times=counts.astype(np.int64), extra_row=row, extra_word=word, extra_sign=sign.astype(np.int8),
        )
        write_whole(self.path, [raw])
        ends = int((ids[train] == self.index[END]).sum()) if END in self.index else 0
        cols = [[part], [self.path], [len(ids)], [len(units)], [int(counts.sum())], [ends]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["part", "path", "units", "different", "tokens", "texts"])


_PARTS = "part long, path string, units long, different long, tokens long, texts long"


def _cut_parts(folder: str):
    """From (doc_id, held_out, task, text): files of parts, and a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, task = None, 0, 0
        for batch in batches:
            ids, held = batch.column(0), batch.column(1).to_pylist()
            task = batch.column(2)[0].as_py() if len(batch) else task
            for i, text in enumerate(batch.column(3)):
                raw, before, uid = text.as_buffer().to_pybytes(), END, None
                for pieces, last in _with_last(pieces_of(raw)):
                    if part is None:
                        own = task << 24 | number
                        part, number = _Part(f"{folder}/part-{own:012d}"), number + 1
                    first = uid is None
                    uid = uid or (own, len(part.rows))
                    doc = ids[i].as_py()
                    before = part.add((doc or 0, doc is None, held[i], len(raw) if first else 0, *uid), pieces, before, last)
                    if part.full():
                        yield part.closed(own)
                        part = None
        if part is not None:
            yield part.closed(own)

    return run


def _with_last(items: Iterator) -> Iterator[tuple]:
    kept = None
    for x in items:
        if kept is not None:
            yield kept, False
        kept = x
    yield kept, True


def _binary(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return np.diff(offsets).astype(np.uint8), np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def _order(ranges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of ranges, and where each range ends."""
    order = np.argsort(ranges.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    return order, np.cumsum(np.bincount(ranges, minlength=n))


def _unit_order(p: dict[str, np.ndarray], n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A part's units, and their order by a hash of their first three bytes."""
    units = _binary(p["unit_lengths"], p["unit_bytes"])
    ranges = (mixed(Units(units, p["times"]).heads().astype(np.uint64)) >> np.uint64(20)) % np.uint64(n)
    return units, *_order(ranges.astype(np.int64), n)


def _pairs(p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of each place, in the order of pairs of a unit and the one before: the place, and the pair's number; of each pair its key; of each place, in order, the unit before and the row."""
    ids, lengths = p["ids"].astype(np.uint64), p["lengths"]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    begins = np.cumsum(lengths) - lengths
    before[begins] = p["before"]
    key = np.sort(before << (_UNIT_BITS + _PLACE_BITS) | ids << _PLACE_BITS | np.arange(len(ids), dtype=np.uint64))
    place, pair = (key & np.uint64((1 << 22) - 1)).view(np.int64), key >> _PLACE_BITS
    new = np.concatenate([[True], pair[1:] != pair[:-1]])
    of, own = np.cumsum(new) - 1, pair[new]
    keys = Units(_binary(p["unit_lengths"], p["unit_bytes"]), p["times"]).keys()
    a, b = keys[(own >> _UNIT_BITS).view(np.int64)], keys[(own & np.uint64((1 << 20) - 1)).view(np.int64)]
    return place, of, mixed(mixed(a) + b) << np.uint64(1), before.view(np.int64)


def _asked(p: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """All keys that a part asks for, pairs (even) and words (odd); how often each came in training texts; their order by range; and the pairs."""
    place, of, pairs, before = found = _pairs(p)
    train = np.repeat(~p["held"], p["lengths"])
    times = np.bincount(of, train[place], len(pairs)).astype(np.int64)
    keys = np.concatenate([pairs, mixed(p["words"]) | np.uint64(1)])
    return keys, np.concatenate([times, p["word_times"]]), *_order(((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int64), n), found


_BLOCKS = "range long, part long, cells binary"


def _blocks(of: Callable[[dict], Iterator[tuple[int, bytes]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, size = [], 0
                for r, cells in of(unpacked(read_whole(path))):
                    out.append((r, part, cells))
                    size += len(cells)
                    if size > 1 << 22:
                        yield _rows(out, ("range", "part", "cells"))
                        out, size = [], 0
                if out:
                    yield _rows(out, ("range", "part", "cells"))

    return run


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list(names))


def _unit_blocks(n: int) -> Callable[[dict], Iterator[tuple[int, bytes]]]:
    def of(p: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
        units, order, ends = _unit_order(p, n)
        units, times, at = units.take(pa.array(order)), p["times"][order], 0
        for r, end in enumerate(ends):
            if end > at:
                lengths, data = _flat(units.slice(at, end - at))
                yield r, packed(lengths=lengths, data=data, times=times[at:end])
            at = end

    return of


_PAIR_BYTES = 5


def _keys_out(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs' keys by five bytes and words' keys whole; random bytes don't shrink.

    A range holds RANGE_KEYS or so, whatever the corpus, so beside the range five bytes mistake about one pair in a million for another.
    """
    word = (keys & np.uint64(1)).astype(bool)
    raw = keys[~word].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PAIR_BYTES].tobytes(), keys[word].astype("<u8").tobytes()
    return b"".join([len(raw[0]).to_bytes(8, "little"), len(raw[1]).to_bytes(8, "little"), *raw, packed(word=word.astype(np.uint8), times=times)])


def _keys_in(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = (int.from_bytes(cells[i : i + 8], "little") for i in (0, 8))
    rest = unpacked(memoryview(cells)[16 + a + b :])
    keys, word = np.empty(len(rest["times"]), np.uint64), rest["word"].astype(bool)
    some = np.zeros((a // _PAIR_BYTES, 8), np.uint8)
    some[:, :_PAIR_BYTES] = np.frombuffer(cells, np.uint8, a, 16).reshape(-1, _PAIR_BYTES)
    keys[~word], keys[word] = some.view("<u8").reshape(-1), np.frombuffer(cells[16 + a : 16 + a + b], "<u8")
    return keys, rest["times"]


def _key_blocks(n: int) -> Callable[[dict], Iterator[tuple[int, bytes]]]:
    def of(p: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
        keys, times, order, ends, _ = _asked(p, n)
        keys, times, at = keys[order], times[order], 0
        for r, end in enumerate(ends):
            if end > at:
                yield r, _keys_out(keys[at:end], times[at:end])
            at = end

    return of


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(first column, other columns of its rows) of rows that come in its order."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != last and rows:
                yield last, rows
                rows = []
            last = row[0]
            rows.append(row[1:])
    if rows:
        yield last, rows


def _merge_units(folder: str):
    """Of each range: its different units in order, with what they came, as a file; the counts of low order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _groups(batches):
            parts = [(part, unpacked(cells)) for part, cells in rows]
            found = pa.concat_arrays([_binary(x["lengths"], x["data"]) for _, x in parts]).dictionary_encode()
            order = pa.compute.array_sort_indices(found.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at = rank[found.indices.to_numpy()]
            n = np.bincount(at, np.concatenate([x["times"] for _, x in parts]), len(order))
            units = found.dictionary.take(pa.array(order))
            lengths, data = _flat(units)
            path = f"{folder}/units-{r:08d}"
            write_whole(path, [packed(lengths=lengths, data=data, n=n.astype(np.int64), at=at.astype(np.uint32), parts=np.array([p for p, _ in parts], np.int64), sizes=np.array([len(x["times"]) for _, x in parts], np.int64))])
            yield _rows([(r, path, packed(**Low.of(Units(units, n))))], ("range", "path", "low"))

    return run


def _merge_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for cells in batch.column(0).to_pylist():
            held = Low.merged([unpacked(cells)] if held is None else [held, unpacked(cells)])
    if held is not None:
        yield _rows([(packed(**held),)], ("low",))


_loaded: dict[str, Low] = {}


def _low_at(path: str) -> Low:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Low(unpacked(read_whole(path)))
    return _loaded[path]


def _units_at(path: str) -> tuple[Units, dict[str, np.ndarray]]:
    found = unpacked(read_whole(path))
    return Units(_binary(found["lengths"], found["data"]), found["n"]), found


_LEARNED = "weights binary, seen binary, map binary"


def _learn(low: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(1).to_pylist():
                own = learned(_units_at(path)[0], _low_at(low))
                # Weights come times what was seen, so that sums of rows are sums of learners.
                yield _rows([((own.weights * own.seen[:, None]).astype("<f8").tobytes(), own.seen.astype("<f8").tobytes(), own.map.astype("<f8").tobytes())], ("weights", "seen", "map"))

    return run


def _sum_learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = [np.frombuffer(x, "<f8") for x in row]
            total = row if total is None else [a + b for a, b in zip(total, row, strict=True)]
    if total is not None:
        yield _rows([tuple(x.tobytes() for x in total)], ("weights", "seen", "map"))


def _summed(table: DataFrame, run, schema: str, n: int) -> list:
    """The one row that `run` makes of all rows, by way of the square root of their number; none of an empty table."""
    some = table.repartition(max(1, math.isqrt(n))).mapInArrow(run, schema)
    return some.repartition(1).mapInArrow(run, schema).collect()


def _unit_answers(low: str, weights: np.ndarray, refine: np.ndarray):
    """For each part the costs and counts of its units in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units, found = _units_at(path)
                cost, n, begin = unit_costs(units, _low_at(low), weights, refine).astype(np.float32), found["n"], 0
                for part, size in zip(found["parts"], found["sizes"], strict=True):
                    at = found["at"][begin : begin + size]
                    begin += size
                    yield _rows([(int(part), 0, r, packed(cost=cost[0, at], more=(cost[1, at] - cost[0, at]).astype(np.float16), n=n[at]))], ("part", "kind", "range", "cells"))

    return run


_ANSWERS = "part long, kind long, range long, cells binary, words long"


def _key_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part the counts of its keys in the range; words: how many different words the training texts have in the range, in its first row."""
    for r, rows in _groups(batches):
        keys, times = zip(*(_keys_in(cells) for _, cells in rows), strict=True)
        sizes, all_ = [len(k) for k in keys], np.concatenate(keys)
        own, at = grouped(all_)
        total = np.bincount(at, np.concatenate(times), len(own)).astype(np.int64)
        words, begin = int(((own & np.uint64(1) == 1) & (total > 0)).sum()), 0
        for (part, _), size in zip(rows, sizes, strict=True):
            yield _rows([(part, 1, r, packed(total=total[at[begin : begin + size]]), words if not begin else 0)], ("part", "kind", "range", "cells", "words"))
            begin += size


class _Read:
    """A part with all answers: of each place what three predictions say of the unit, and the gate."""

    def __init__(self, path: str, answers: list[tuple], unit_ranges: int, key_ranges: int, loo: bool) -> None:
        self.p = p = unpacked(read_whole(path))
        found = [unpacked(cells) for kind, _, cells, _ in answers if kind == 0]
        order = _unit_order(p, unit_ranges)[1]
        cost, n = np.empty(len(order), np.float32), np.empty(len(order), np.int64)
        cost[order], n[order] = np.concatenate([x["cost"] + x["more"] if loo else x["cost"] for x in found]), np.concatenate([x["n"] for x in found])
        _, _, order, _, (place, of, pairs, before) = _asked(p, key_ranges)
        total = np.empty(len(order), np.int64)
        total[order] = np.concatenate([unpacked(cells)["total"] for kind, _, cells, _ in answers if kind == 1])
        self.words = total[len(pairs) :]
        ids, lengths = p["ids"].view(np.int32), p["lengths"]
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        begins = np.cumsum(lengths) - lengths
        # How often the unit came in the text so far, and in all.
        key = np.sort(p["ids"].astype(np.uint64) << _PLACE_BITS | np.arange(len(ids), dtype=np.uint64))
        at = (key & np.uint64((1 << 22) - 1)).view(np.int64)
        rank, own = _runs(key >> _PLACE_BITS, row[at])
        earlier, in_text = np.empty(len(ids), np.int32), np.empty(len(ids), np.int32)
        earlier[at], in_text[at] = rank, own
        came, known = np.empty(len(ids), np.int64), n[before]
        came[place] = total[of]
        if loo:
            came[place] -= _runs(of, row[place])[1]
            last = np.concatenate([[1], in_text[:-1]])
            last[begins] = 1
            known = known - last
        since = np.arange(len(ids), dtype=np.int32) - np.repeat(begins, lengths).astype(np.int32)
        self.log = np.empty((3, len(ids)), np.float32)
        self.log[0] = np.float32(-np.log(10)) * cost[ids]
        with np.errstate(divide="ignore", invalid="ignore"):
            np.log(np.where(known > 0, np.maximum(came, 0) / np.maximum(known, 1), 0.0), out=self.log[1], casting="same_kind")
            np.log(earlier / np.maximum(since, 1), out=self.log[2], casting="same_kind")
        del came, place, of, key, at, order, total, found, answers
        self.row, self.begins = row, begins
        foreseen = (self.log[1] > self.log[0]).astype(np.int32)
        again = (earlier > 0).astype(np.int32)
        hits, recent = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
        for k in (1, 2, 3):
            hits[k:] += np.where(since[k:] >= k, foreseen[:-k] if k < len(ids) else 0, 0) if k < len(ids) else 0
        recent[1:] = np.where(since[1:] >= 1, again[:-1], 0)
        self.gate = (np.searchsorted(BEFORE, known, side="right") * 4 + hits) * 2 + recent

    def joint(self, weights: np.ndarray, step: int = 1 << 17) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Stretches of places: log of each one's probability, and the three that it is made of."""
        logs = np.log(weights).T.astype(np.float64)
        for i in range(0, len(self.gate), step):
            s = slice(i, i + step)
            three = self.log[:, s] + logs[:, self.gate[s]]
            yield s, np.logaddexp(np.logaddexp(three[0], three[1]), three[2]), three

    def shares(self, weights: np.ndarray) -> np.ndarray:
        """By gate, what share of its places' probability each prediction has."""
        out = np.zeros((TEXT_GATES, 3))
        for s, total, three in self.joint(weights):
            for k in range(3):
                out[:, k] += np.bincount(self.gate[s], np.exp(three[k] - total), TEXT_GATES)
        return out

    def logs(self, weights: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.gate))
        for s, total, _ in self.joint(weights):
            out[s] = total
        return out


def _runs(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbours with the same key and row: each one's rank, and their number."""
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([new, [len(keys)]]))
    return np.arange(len(keys)) - np.repeat(new, sizes), np.repeat(sizes, sizes)


_GATES = "shares binary"


def _learn_gates(path_of: Callable[[int], str], unit_ranges: int, key_ranges: int, rounds: int = 4):
    """Of each part, by gate, the predictions' shares at training places after some rounds of expectation-maximisation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TEXT_GATES, 3))
        _loaded.clear()  # this process may have coded units before
        for part, answers in _groups(batches):
            read = _Read(path_of(part), answers, unit_ranges, key_ranges, loo=True)
            train = ~read.p["held"][read.row]
            read.log, read.gate = read.log[:, train], read.gate[train]
            weights = np.tile(_START, (TEXT_GATES, 1))
            own = np.zeros((TEXT_GATES, 3))
            for _ in range(rounds if train.any() else 0):
                own = read.shares(weights)
                weights = _weights(own)
            total += own
        if total.any():
            yield _rows([(total.astype("<f8").tobytes(),)], ("shares",))

    return run


def _weights(shares: np.ndarray) -> np.ndarray:
    """Weights by gate, with a little of what they begin with."""
    return (shares + 5 * _START) / (shares.sum(axis=1, keepdims=True) + 5)


_SCORED = "of_part long, of_row long, doc_id long, held_out boolean, n_tokens long, n_known long, known double, n_bytes long, score double"


def _score(path_of: Callable[[int], str], unit_ranges: int, key_ranges: int, weights: np.ndarray):
    """known: the sum of log10(count + 1) over tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, answers in _groups(batches):
            read = _Read(path_of(part), answers, unit_ranges, key_ranges, loo=False)
            p, n = read.p, len(read.p["lengths"])
            logs = np.log10(read.words + 1.0)
            of_units = [np.bincount(p["of_unit"], x, len(p["times"]))[p["ids"]] for x in (np.ones(len(p["of_unit"])), (read.words > 0)[p["of_word"]], logs[p["of_word"]])]
            in_long = [np.bincount(p["extra_row"], p["extra_sign"] * x, n) for x in (1.0, (read.words > 0)[p["extra_word"]], logs[p["extra_word"]])]
            tokens, known, sums = (np.add.reduceat(a, read.begins) + b for a, b in zip(of_units, in_long, strict=True))
            score = np.add.reduceat(read.logs(weights), read.begins) / np.log(10)
            ids = pa.array(p["doc_ids"], mask=p["no_id"])
            cols = [pa.array(p["of_part"]), pa.array(p["of_row"]), ids, pa.array(p["held"]), *(pa.array(x.astype(np.int64)) for x in (tokens, known)), pa.array(sums), pa.array(p["n_bytes"]), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _SCORED.split(", ")])

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each row of df.

    Rows whose crc32 of the id as text leaves fold modulo folds are held out; the model learns from all others. A null id counts as
    the empty text, a null text as empty; a text without words is its end mark alone. If nothing is left to
    learn from, the bit predictors are silent and a bit costs one bit. Repeated rows are scored as often as they come; other columns
    are not looked at. An empty table gives no rows.

    Plan: one pass over the texts writes parts (files in the shared folder). Units go to ranges by their first bytes and
    are merged, learned from and coded there; pairs and words go to ranges by their hash and are summed. Answers meet their parts
    twice: to learn the gates' weights and to score. Ranges grow in number with the corpus, not in size. Rows that pass
    through the driver are sums of fixed size. Weights depend slightly on how texts fall into parts.
    """
    spark = df.sparkSession
    held = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds == fold
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.spark_partition_id().alias("task"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    folder, of_units = scratch(spark, "model"), scratch(spark, "units")
    parts = stored(rows.mapInArrow(_cut_parts(folder), _PARTS), "parts")
    n_parts, units, different, n_tokens = (x or 0 for x in parts.agg(F.count("*"), F.sum("units"), F.sum("different"), F.sum("tokens")).first())
    unit_ranges, key_ranges = max(8, math.ceil(different / RANGE_UNITS)), max(8, math.ceil((units + different) / RANGE_KEYS))
    several = parts.select("part", "path").repartition(max(1, n_parts), "part")

    def by(table: DataFrame, key: str, n: int, *order: str) -> DataFrame:
        return table.repartition(max(1, n), key).sortWithinPartitions(key, *order)

    merged = by(several.mapInArrow(_blocks(_unit_blocks(unit_ranges)), _BLOCKS), "range", unit_ranges, "part").mapInArrow(_merge_units(of_units), "range long, path string, low binary")
    merged = stored(merged, "units")
    release(spark)
    low = f"{folder}/low"
    low_row = _written(merged.select("low"), low, unit_ranges)
    ranges = merged.select("range", "path").repartition(unit_ranges, "range")
    learner = Learner()
    for w, seen, map_ in _summed(ranges.mapInArrow(_learn(low), _LEARNED), _sum_learned, _LEARNED, unit_ranges) if low_row else []:
        seen = np.frombuffer(seen, "<f8")
        known = seen > 0
        learner.weights[known] = (np.frombuffer(w, "<f8").reshape(GATES, PREDICTORS)[known] / seen[known, None]).astype(np.float32)
        learner.map = np.frombuffer(map_, "<f8").reshape(2, -1)
    refine = learner.refine() if low_row else identity()
    no_words = F.lit(0).cast("long").alias("words")
    costs = ranges.mapInArrow(_unit_answers(low, learner.weights, refine), "part long, kind long, range long, cells binary").select("*", no_words)
    costs = stored(costs, "costs")
    _remove(spark, of_units)
    release(spark, merged)
    counts = by(several.mapInArrow(_blocks(_key_blocks(key_ranges)), _BLOCKS), "range", key_ranges, "part").mapInArrow(_key_answers, _ANSWERS)
    counts = stored(counts, "counts")
    release(spark)
    n_words = counts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    answers = by(costs.unionByName(counts), "part", n_parts, "kind", "range")
    path_of = lambda part: f"{folder}/part-{part:012d}"
    shares = sum((np.frombuffer(bytes(r[0]), "<f8").reshape(TEXT_GATES, 3) for r in _summed(answers.mapInArrow(_learn_gates(path_of, unit_ranges, key_ranges), _GATES), _sum_shares, _GATES, n_parts)), np.zeros((TEXT_GATES, 3)))
    release(spark)
    scored = answers.mapInArrow(_score(path_of, unit_ranges, key_ranges, _weights(shares)), _SCORED)
    # Pieces of a long text, in parts of their own, add up.
    add = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "known", "n_bytes", "score")]
    scored = scored.groupBy("of_part", "of_row", "doc_id", "held_out").agg(*add)
    base = F.col("known") - F.col("n_tokens") * float(np.log10(n_tokens + n_words + 1))
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def _sum_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TEXT_GATES * 3)
    for batch in batches:
        for cells in batch.column(0).to_pylist():
            total = total + np.frombuffer(cells, "<f8")
    if total.any():
        yield _rows([(total.tobytes(),)], ("shares",))


def _written(table: DataFrame, path: str, n: int) -> bool:
    """The merged counts of low order, written by the task that merged them; False if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _merge_low(batches):
            write_whole(path, [out.column(0)[0].as_py()])
            yield _rows([(path,)], ("path",))

    some = table.repartition(max(1, math.isqrt(n))).mapInArrow(_merge_low, "low binary")
    return bool(some.repartition(1).mapInArrow(run, "path string").collect())
