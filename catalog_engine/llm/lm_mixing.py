"""LM scoring by online logistic context mixing.

A text is the words (A-Z lower-cased) and one end sign. It is coded bit by bit, and
its score is the sum of the logarithms of all bits' probabilities:

* Spelling bits. A byte is a path of a Huffman tree over the training bytes, so each
  step is one bit. Predictors look up how often zero and one followed their hashed
  context (the last 1 to 5 bytes of the word, the whole word so far, and both with
  the kind of text that the words before point to). Each count pair becomes log-odds
  by a table learned from what followed such counts; the log-odds are combined by
  weights that a gate selects (place in the word, which contexts are known); weights
  and tables are trained online, in mini-batches over every training token, each
  occurrence predicted without itself; a table over gate and mixed log-odds then
  refines the result adaptively.
* Match bits. Where the last words occurred before, in the same text or in other
  training texts of its region, one bit says whether the word that followed them
  follows again; if it does, nothing more is coded, if not, the word is spelled. The
  bit is mixed as the spelling bits are: predictors are what each order and source
  knows of the guess, and hashed contexts of what came of the text's match bits just
  before (so that the model adapts along the text: inside a copy hits follow hits);
  their log-odds are combined under weights that a gate selects (which orders know a
  follower and which agree), trained online in mini-batches, and refined by a table.

A region is a chunk of documents that share their least hash of three words, so that
copies meet whatever the size of the corpus. Regions are ``CHUNK`` bytes of text
each: their number, and with it the contexts of whole words that the model holds,
grows with the corpus. So do the counts of tokens, which are shuffled by token; the
rows that a region needs travel to it. What is broadcast or collected has a fixed
size: ``2 ** bits`` states of a byte for each predictor, weights, and counts of
which short words occur together. Kinds of text are groups of such words.

Defined results: null or empty text is the end sign alone; one row per input row;
null ids train; with no training rows every bit has the prior's probability; a
training text's match bits come from other texts than itself, equal rows included;
other columns are not read. Words are told apart by 64-bit hashes. The order and
files of the input do not matter, except that a group of copies above a quarter of
``CHUNK`` is dealt to several regions by row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written
from .textlib import U, Words, mix, shingle_hashes, sub_batches

#: Bytes of context (0: the whole word so far), whether the kind of text is part of it, and bits of the table's size.
PREDICTORS = ((1, True, 17), (2, False, 18), (3, True, 20), (5, False, 20), (0, False, 21), (0, True, 21))
#: Bytes of text in a region, in the tokens that one mini-batch trainer gets, and between merges of counts.
CHUNK, PART, STRETCH = 3 << 20, 32 << 20, 10 << 20
#: Words of at most SHORT bytes fall into BUCKETS; those that occur together make KINDS kinds of text.
SHORT, BUCKETS, KINDS = 3, 256, 4
BLOCK = 1 << 15
MOST_HEAVY = 200_000
#: Tokens that are looked up together, and tokens of a mini-batch.
PIECE, MINI = 2500, 2000
#: Counts are kept as one of 256 levels: exact up to 40, then 8.5 % apart.
GRID = np.concatenate([np.arange(41), np.rint(40 * 1.085 ** np.arange(1, 216))]).astype(np.int64)
_level_of = np.searchsorted(GRID, np.arange(1 << 18), side="right") - 1
GATES, STEPS = 128, 33
RATE, PRIOR = 0.05, 0.4
END, END_BYTE = np.array([0x0DDB1A5E5BAD5EED], U), 10
#: Orders of match bits, in words, and the sources that are asked in turn: the text itself and its region.
MATCHES = ((3, "own"), (3, "region"), (2, "region"))
COUNTS = np.array([0, 1, 2, 3, 5, 9, 17, 65])
#: Bits of the tables of hashed match contexts, the match bits before that they hold, and how the weights of match bits are trained.
MATCH_BITS, HISTORY = 16, 5
MATCH_MINI, MATCH_RATE, MATCH_START, MATCH_GATES = 16_384, 0.02, 0.2, 3 ** len(MATCHES)

_ODD = U(0x9E3779B97F4A7C15)


def _states_of_levels() -> tuple[np.ndarray, np.ndarray]:
    """The state of each (level of zeros, level of ones), and the log-odds each state starts from.

    Up to three of each are a state of their own; beyond, a state is a range of the sum and one of the log-odds.
    """
    n0, n1 = GRID[:, None], GRID[None, :]
    odds = np.log((n1 + PRIOR) / (n0 + PRIOR))
    near = np.rint(19 * np.tanh(odds / 5)).astype(np.int64) + 19
    state = np.where((n0 <= 3) & (n1 <= 3), n0 * 4 + n1, 16 + np.searchsorted([8, 16, 48, 192, 1024], n0 + n1, side="right") * 39 + near)
    first = odds[:4, :4].ravel()
    rest = 5 * np.arctanh(np.clip(np.arange(-19, 20) / 19, -0.99, 0.99))
    return state.astype(np.uint8).ravel(), np.concatenate([first, np.tile(rest, 6)])


_state, _odds = _states_of_levels()
N_STATES = len(_odds)


def _without() -> np.ndarray:
    """The state of each level pair with one zero less, and with one one less; levels that stand for several counts stay."""
    less = np.where(np.arange(256) <= 40, np.maximum(0, np.arange(256) - 1), np.arange(256))
    pair = _state.reshape(256, 256)
    return np.stack([pair[less], pair[:, less]]).reshape(2, -1)


_less = _without()


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): equal keys side by side, in order of place, and where a new key begins. Low bits of the hashes give way to the place."""
    bits = U(max(1, (len(keys) - 1).bit_length()))
    x = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=U))
    new = np.ones(len(keys), bool)
    new[1:] = x[1:] >> bits != x[:-1] >> bits
    return (x & ((U(1) << bits) - U(1))).astype(np.int64), new


# --- kinds of text -------------------------------------------------------------------------------


def _short(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return (words.hashes >> U(40)).astype(np.int64) % BUCKETS, words.ends - words.starts <= SHORT


def region_keys(words: Words) -> np.ndarray:
    """The least hash of three neighbouring words of each row."""
    rows, hashes = shingle_hashes(words, 3)
    out = np.full(words.hi - words.lo, np.iinfo(np.uint64).max, U)
    np.minimum.at(out, rows, hashes)
    return out.view(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, size) of each document, and in blocks, for each two buckets, in how many training documents both occur."""
    names = ["key", "size", "block", "sums"]
    both = np.zeros((BUCKETS, BUCKETS), np.int64)
    for batch in batches:
        held = np.asarray(batch.column("held"))
        for words in sub_batches(batch.column("text"), 512):
            n = words.hi - words.lo
            bucket, short = _short(words)
            seen = np.zeros((n, BUCKETS), np.float32)
            seen[words.rows()[short], bucket[short]] = 1
            seen = seen[~held[words.lo : words.hi]]
            both += (seen.T @ seen).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(region_keys(words)), pa.array(np.diff(words.offsets) + 64), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    used = [i for i in range(0, BUCKETS, 16) if both[i : i + 16].any()]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([both[i : i + 16].tobytes() for i in used], pa.binary())], names)


def _add_counts(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows["sums"])
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def fit_kinds(both: np.ndarray) -> np.ndarray:
    """Weights (BUCKETS x KINDS, whole numbers) of short words for kinds of text: spectral groups of words that occur together."""
    mass = both.sum(axis=1).astype(float)
    if not mass.any():
        return np.zeros((BUCKETS, KINDS), np.int64)
    scale = np.where(mass > 0, 1 / np.sqrt(np.maximum(mass, 1)), 0)
    places = np.linalg.eigh(scale[:, None] * both * scale)[1][:, -KINDS:]
    places = places / np.maximum(1e-9, np.linalg.norm(places, axis=1, keepdims=True))
    centres = [int(np.argmax(mass))]
    often = mass >= np.median(mass[mass > 0])
    for _ in range(KINDS - 1):
        away = np.min([((places - places[c]) ** 2).sum(axis=1) for c in centres], axis=0) * (mass > 0)
        # among the frequent half, unless all of it lies on centres already
        centres.append(int(np.argmax(away * often if (away * often).max() > 1e-6 else away)))
    centres = places[centres]
    for _ in range(20):
        kind = np.argmax(places @ centres.T, axis=1)
        sums = np.stack([(places[kind == k] * mass[kind == k, None]).sum(axis=0) for k in range(KINDS)])
        centres = np.where(sums.any(axis=1, keepdims=True), sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True)), centres)
    share = np.stack([both[kind == k].sum(axis=0) for k in range(KINDS)]) + 1e-3 * mass.mean()
    return np.rint(np.log(share / share.sum(axis=1, keepdims=True)).T * 4096).astype(np.int64)


def kinds(words: Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind that the words before point to, for each word and each row's end; 0 if no short word came before."""
    bucket, short = _short(words)
    sums = np.zeros((len(bucket) + 1, KINDS + 1), np.int64)
    sums[1:, :KINDS] = np.where(short[:, None], weights[bucket], 0)
    sums[1:, KINDS] = short
    np.cumsum(sums, axis=0, out=sums)

    def kind(at: np.ndarray, begin: np.ndarray) -> np.ndarray:
        x = sums[at] - sums[begin]
        return np.where(x[:, KINDS] > 0, np.argmax(x[:, :KINDS], axis=1) + 1, 0)

    return kind(np.arange(len(bucket)), words.first[:-1][words.rows()]), kind(words.first[1:], words.first[:-1])


# --- counts of tokens ----------------------------------------------------------------------------


def _class_keys(hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return mix(hashes + kind.astype(U) * _ODD)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lens = ends - starts
    offsets = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lens)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))]).cast(pa.binary())


def _merged(tables: list[pa.Table]) -> pa.Table:
    """One row per kind and token of the tables, in order of hash and kind."""
    t = pa.concat_tables(tables).combine_chunks()
    h, kind = t["hash"].to_numpy().view(U), t["kind"].to_numpy()
    order = np.lexsort((kind, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (kind[order][1:] != kind[order][:-1])
    begin = np.flatnonzero(new)
    first = pa.array(order[begin])
    sums = np.add.reduceat(t["c"].to_numpy()[order], begin) if len(begin) else np.zeros(0, np.int64)
    return pa.table({"hash": t["hash"].take(first), "kind": t["kind"].take(first), "token": t["token"].take(first), "c": pa.array(sums)}).combine_chunks()


def _count_tokens(weights: np.ndarray):
    """(hash, kind, token, c) of the tokens in each STRETCH bytes of a partition."""

    def counted(words: Words) -> pa.Table:
        kind, last = kinds(words, weights)
        order, new = _grouped(_class_keys(words.hashes, kind))
        begin = np.flatnonzero(new)
        first, c = order[begin], np.diff(np.append(begin, len(order)))
        ends, n_ends = np.unique(last, return_counts=True)
        tokens = pa.concat_arrays([_gather(words.data, words.starts[first], words.ends[first]), pa.array([bytes([END_BYTE])] * len(ends), pa.binary())])
        hashes = np.concatenate([words.hashes[first], np.repeat(END, len(ends))]).view(np.int64)
        return pa.table({"hash": pa.array(hashes), "kind": pa.array(np.concatenate([kind[first], ends]).astype(np.int32)), "token": tokens, "c": pa.array(np.concatenate([c, n_ends]).astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, rows, most = [], 0, 0, 100_000
        for batch in batches:
            for words in sub_batches(batch.column("text"), 4096):
                parts.append(counted(words))
                rows, size = rows + parts[-1].num_rows, size + len(words.data)
                if rows > most:  # merged whenever the rows have about doubled
                    parts = [_merged(parts)]
                    rows = parts[0].num_rows
                    most = 100_000 + rows
                if size > STRETCH:
                    yield from _merged(parts).to_batches(max_chunksize=50_000)
                    parts, size, rows, most = [], 0, 0, 100_000
        if parts:
            yield from _merged(parts).to_batches(max_chunksize=50_000)
        pa.default_memory_pool().release_unused()  # the worker process lives on

    return run


def _merge_part(rows: pa.Table) -> pa.Table:
    """One row per kind and token of a part; the first of a token also has the token's total."""
    t = _merged([rows.select(["hash", "kind", "token", "c"])])
    h, c = t["hash"].to_numpy(), t["c"].to_numpy()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    total = np.zeros(len(h), np.int64)
    if len(h):
        total[new] = np.add.reduceat(c, np.flatnonzero(new))
    t = t.append_column("total", pa.array(total, mask=~new))
    return t.add_column(0, "part", rows["part"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(h), np.int64))) if len(h) else pa.array([], pa.int32()))


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(byte, c): how often a partition's tokens have each byte, and the space after each."""
    out = np.zeros(256)
    for batch in batches:
        tokens, c = batch.column("token").cast(pa.large_binary()), np.asarray(batch.column("c"))
        _, offsets, data = tokens.buffers()
        offsets = np.frombuffer(offsets, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
        out += np.bincount(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], weights=np.repeat(c, np.diff(offsets)), minlength=256)
        out[32] += c.sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(out.astype(np.int64))], ["byte", "c"])


# --- spelling ------------------------------------------------------------------------------------


class Code:
    """A Huffman tree over bytes: for each byte its path as (node, bit) steps."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        below: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            below[255 + len(below) + 1] = (x, y)
            heapq.heappush(heap, (a + b, 255 + len(below)))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        todo = [(heap[0][1], [])]
        while todo:
            node, path = todo.pop()
            if node < 256:
                paths[node] = path
            else:
                todo += [(x, [*path, (node - 256, bit)]) for bit, x in enumerate(below[node])]
        self.lengths = np.array([len(p) for p in paths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.nodes = np.array([n for p in paths for n, _ in p], U)
        self.bits = np.array([b for p in paths for _, b in p], np.int64)


class Steps:
    """The bits of tokens laid end to end: each token's bytes and a space, or the end sign alone.

    With ``once``, a byte that follows the same bytes in several tokens of a kind is laid once.
    """

    def __init__(self, code: Code, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray, once: bool = False):
        lens = ends - starts
        is_end = (lens == 1) & (data[np.minimum(starts, len(data) - 1)] == END_BYTE)
        size = lens + ~is_end
        first = np.cumsum(size) - size
        n = int(size.sum())
        token = np.repeat(np.arange(len(lens)), size)
        place = np.arange(n) - first[token]
        byte = np.full(n, 32, np.uint8)
        inner = place < lens[token]
        byte[inner] = data[(starts[token] + place)[inner]]
        x, order = np.zeros(n, U), 0
        power = np.cumprod(np.full(int(place.max()) + 1 if n else 0, 0x9E3779B97F4A7C17, U), dtype=U)
        sums = np.cumsum(mix(byte.astype(U) + U(1)) * power[place], dtype=U)
        before = np.concatenate([np.zeros(1, U), sums])[:-1]
        whole = mix(before - before[first][token] + place.astype(U))
        kind = (kind.astype(U) + U(1))[token] * U(0x632BE59BD9B4E019)
        laid = self.laid = np.arange(n)
        if once:
            group, new = _grouped(mix((whole + kind) * _ODD + byte.astype(U)))
            laid = group[new]
            self.laid[group] = np.cumsum(new) - 1
        bits_of = code.lengths[byte[laid]]
        self.at = np.repeat(laid, bits_of)
        self.begin = np.cumsum(bits_of) - bits_of
        nth = np.arange(len(self.at)) - np.repeat(self.begin, bits_of)
        path = code.starts[byte][self.at] + nth
        self.bit, spread = code.bits[path], code.nodes[path] * _ODD
        self.first = first  # byte of each token
        self.token, self.place = token, place
        self.depth = nth > 2
        self.slots = []
        for length, of_kind, bits in PREDICTORS:
            for j in range(order + 1, length + 1):
                b = np.zeros(n, U)
                b[j:] = byte[:-j]
                b[place < j] = 0
                x = x * U(257) + b + U(1)
            order = max(order, length)
            context = mix((x + U(length) if length else whole) + (kind if of_kind else U(0)))
            slot = context.take(self.at)
            slot += spread
            slot *= U(0xD6E8FEB86659FD93)
            slot >>= U(64 - bits)
            self.slots.append(slot.view(np.int64))


def _steps(rows: pa.Table, code: Code, lo: int, hi: int, extra: np.ndarray | None = None) -> Steps:
    index = np.arange(lo, min(hi, rows.num_rows))
    index = index if extra is None else np.unique(np.concatenate([index, extra]))
    tokens = rows["token"].take(pa.array(index))
    tokens = pa.concat_arrays(tokens.cast(pa.large_binary()).chunks)
    _, offsets, data = tokens.buffers()
    offsets = np.frombuffer(offsets, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    steps = Steps(code, np.frombuffer(data, np.uint8), offsets[:-1], offsets[1:], rows["kind"].take(pa.array(index)).to_numpy())
    steps.index = index
    return steps


def _bit_counts(shared):
    """Counts of zeros and ones of each slot over a part's tokens, in blocks."""

    def run(rows: pa.Table) -> pa.Table:
        code = shared.value
        seen = [np.zeros(2 << bits, np.int32) for *_, bits in PREDICTORS]
        counts = rows["c"].to_numpy().astype(np.int32)  # of PART bytes at most
        for lo in range(0, rows.num_rows, PIECE):
            s = _steps(rows, code, lo, lo + PIECE)
            weight = counts[s.index][s.token][s.at]
            for x, slot in zip(seen, s.slots):
                np.add.at(x, slot * 2 + s.bit, weight)
        out = []
        for k in range(len(seen)):  # one predictor after the other, so that no second copy of all tables is held
            x, seen[k] = seen[k], None
            used = [i for i in range(0, len(x), 2 * BLOCK) if x[i : i + 2 * BLOCK].any()]
            packed = [pa.compress(memoryview(x[i : i + 2 * BLOCK]).cast("B"), codec="lz4", asbytes=True) for i in used]
            out.append(pa.table({"block": pa.array([k * 1000 + i // (2 * BLOCK) for i in used], pa.int32()), "sums": pa.array(packed, pa.binary())}))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return run


def _levels(key: tuple, rows: pa.Table) -> pa.Table:
    """Levels of a block's counts: that of zeros times 256 and that of ones."""
    k = key[0].as_py() // 1000
    size = 8 * min(BLOCK, 1 << PREDICTORS[k][2])
    total = np.zeros(size // 4, np.int64)
    for x in rows["sums"]:
        total += np.frombuffer(pa.decompress(x.as_buffer(), size, codec="lz4"), np.int32)
    total = total.reshape(-1, 2)
    level = np.searchsorted(GRID, total, side="right") - 1
    level = (level[:, 0] * 256 + level[:, 1]).astype(np.uint16)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})


class Mixer:
    """Log-odds of states, gated weights, and the refinement table; all are sums that add up over trainers."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        prior = _squash(0.8 * _odds)
        self.seen = np.tile(np.stack([1 - prior, prior], axis=-1) * 2, (len(PREDICTORS), 1, 1))
        self.weights = np.full((GATES, len(PREDICTORS)), 0.3)
        self.mass = np.zeros(GATES)
        guess = _squash((np.arange(STEPS) - STEPS // 2) / 2)
        self.refined = np.tile(np.stack([1 - guess, guess], axis=-1) * 20, (GATES, 1, 1))
        self.start = [x.copy() for x in (self.seen, self.refined)]

    def read(self, s: Steps, without: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """States of each predictor, with or without the occurrence itself, and the gate of each step."""
        found = [t[slot] for t, slot in zip(self.levels, s.slots)]
        found = [_less[s.bit, x] for x in found] if without else [_state[x] for x in found]
        gate = np.minimum(s.place, 7)[s.at] * 2 + s.depth
        for i, k in enumerate((5, 4, 3)):
            gate = gate + (found[k] > 0) * (16 << i)
        return found, gate

    def mixed(self, found: list[np.ndarray], gate: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        odds = np.log(self.seen[:, :, 1] / self.seen[:, :, 0])
        each = [o[x] for o, x in zip(odds, found)]
        y = np.zeros(len(gate))
        for k, x in enumerate(each):
            y += self.weights[gate, k] * x
        return np.clip(y, -16, 16), each

    def step(self, y: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(y, -8, 8) * 2).astype(np.int64) + STEPS // 2

    def learn(self, rows: pa.Table, code: Code) -> None:
        """One pass over a part's tokens in mini-batches; each takes its share of the frequent ones."""
        counts = rows["c"].to_numpy().astype(float)
        pieces = -(-rows.num_rows // MINI)
        heavy = np.flatnonzero(counts > counts.sum() / (4 * pieces)) if pieces > 1 else np.zeros(0, np.int64)
        share = counts.copy()
        share[heavy] /= pieces
        squares = np.full_like(self.weights, 1e-6)
        for lo in range(0, rows.num_rows, MINI):
            s = _steps(rows, code, lo, lo + MINI, heavy)
            weight = share[s.index][s.token][s.at]
            found, gate = self.read(s, True)
            y, each = self.mixed(found, gate)
            error = (s.bit - _squash(y)) * weight
            mass = np.bincount(gate, weights=weight, minlength=GATES)
            self.mass += mass
            for k, x in enumerate(each):
                g = np.bincount(gate, weights=error * x, minlength=GATES) / np.maximum(mass, 1)
                squares[:, k] += g * g
                self.weights[:, k] += RATE * g / np.sqrt(squares[:, k])
                self.seen[k] += np.bincount(found[k].astype(np.int64) * 2 + s.bit, weights=weight, minlength=2 * N_STATES).reshape(-1, 2)
            self.refined += np.bincount((gate * STEPS + self.step(y)) * 2 + s.bit, weights=weight, minlength=2 * GATES * STEPS).reshape(self.refined.shape)


class Speller:
    """A trained mixer laid out for look-ups: a state for each slot, weight times log-odds for each gate and state."""

    def __init__(self, m: Mixer):
        self.states = [_state[x] for x in m.levels]
        odds = np.log(m.seen[:, :, 1] / m.seen[:, :, 0])
        self.scaled = [(m.weights[:, k, None] * odds[k]).ravel().astype(np.float32) for k in range(len(PREDICTORS))]
        self.refined = (m.refined[:, :, 1] / m.refined.sum(axis=2)).ravel().astype(np.float32)

    def logs(self, s: Steps) -> np.ndarray:
        """log10 probability of each token."""
        if not len(s.at):
            return np.zeros(0)
        found = [t.take(slot) for t, slot in zip(self.states, s.slots)]
        gate = (np.minimum(s.place, 7) * 2).take(s.at)
        gate += s.depth
        for i, k in enumerate((5, 4, 3)):
            gate += (found[k] > 0).view(np.uint8) << np.uint8(4 + i)
        row = gate * N_STATES
        y = self.scaled[0].take(row + found[0])
        for x, scaled in zip(found[1:], self.scaled[1:]):
            y += scaled.take(row + x)
        np.clip(y, -16, 16, out=y)
        gate *= STEPS
        gate += np.rint(np.clip(y, -8, 8) * np.float32(2)).astype(np.int64)
        gate += STEPS // 2
        p = np.exp(-y)
        p += np.float32(1)
        np.divide(np.float32(1), p, out=p)
        p += self.refined.take(gate)
        p /= np.float32(2)
        np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)
        # natural logarithms of these are several times as fast
        logs = np.add.reduceat(np.log(np.where(s.bit == 1, p, np.float32(1) - p)).astype(float), s.begin)
        return np.add.reduceat(logs[s.laid], s.first) / np.log(10)


def _train(shared):
    def run(rows: pa.Table) -> pa.Table:
        code, levels = shared.value
        m = Mixer(levels)
        m.learn(rows, code)
        parts = [m.mass, m.weights * m.mass[:, None], m.seen - m.start[0], m.refined - m.start[1]]
        return pa.table({"block": pa.array(range(4), pa.int32()), "sums": pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())})

    return run


def _add_floats(key: tuple, rows: pa.Table) -> pa.Table:
    # in order, so that the sum does not depend on the order of arrival
    total = sum(np.frombuffer(x, np.float64) for x in sorted(rows["sums"].to_pylist()))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def trained(levels: list[np.ndarray], sums: dict[int, bytes]) -> Mixer:
    """The mixer of all trainers: weights averaged by the mass of each gate, counts added."""
    m = Mixer(levels)
    if sums:
        mass, weights, seen, refined = (np.frombuffer(sums[i]) for i in range(4))
        m.weights = np.where(mass[:, None] > 0, weights.reshape(m.weights.shape) / np.maximum(mass, 1e-9)[:, None], m.weights)
        m.seen = m.seen + seen.reshape(m.seen.shape)
        m.refined = m.refined + refined.reshape(m.refined.shape)
    return m


# --- match bits ----------------------------------------------------------------------------------


def contexts(token: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Hash of the last words before each token of a text."""
    x = np.full(len(token), order + 11, U)
    for j in range(1, order + 1):
        b = np.full(len(token), 3, U)
        b[j:] = token[:-j]
        b[place < j] = 3
        x = mix(x * U(31) + b)
    return x


def own_followers(context: np.ndarray, token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how often the context came before in the same text, the token that followed it last, whether the two last agreed)."""
    n = len(token)
    order, new = _grouped(mix(context + mix(doc.astype(U) + U(1))))
    ts = token[order]
    times = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    agreed = np.zeros(n, bool)
    agreed[2:] = (ts[1:-1] == ts[:-2]) & (times[2:] >= 2)
    out = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, bool)
    out[0][order], out[2][order] = times, agreed
    out[1][order[1:]] = ts[:-1]
    return out


def region_followers(context: np.ndarray, token: np.ndarray, doc: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, token, texts of all) of the token that follows the context in most other training texts; 0 if in none.

    It is one of the two most frequent followers; the text itself does not count.
    """
    n = len(token)
    out = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, np.int64)
    order, new = _grouped(context)
    shared = ~new | np.append(~new[1:], False)
    at = order[shared]
    if not len(at):
        return out
    group = np.cumsum(new[shared]) - 1
    pair = group.astype(U) << U(40) | token[at] >> U(24)
    again = np.argsort(pair)
    at, group, pair = at[again], group[again], pair[again]
    new = np.ones(len(at), bool)
    new[1:] = pair[1:] != pair[:-1]
    begin = np.flatnonzero(new)
    pair, d, n_docs = np.cumsum(new) - 1, doc[at], int(doc.max()) + 1
    mine = train[at]
    has = np.sort(pair[mine] * n_docs + d[mine])
    has = has[np.append(True, has[1:] != has[:-1])] if len(has) else has
    count = np.bincount(has // n_docs, minlength=len(begin)) if len(has) else np.zeros(len(begin), np.int64)
    of, follower = group[begin], token[at[begin]]
    best = np.argsort(of.astype(U) << U(40) | (U((1 << 20) - 1) - count.astype(U)) << U(20) | follower >> U(44), kind="stable")
    top = np.searchsorted(of, np.arange(of[-1] + 1))  # of is sorted and best keeps its groups in place
    second = np.minimum(top + 1, len(of) - 1)
    two = (second > top) & (of[second] == np.arange(len(top)))
    total = np.add.reduceat(count, top)

    def left(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = best[which][group]
        rest = count[i].copy()
        ask = np.flatnonzero(mine & (rest > 0))
        key = i[ask] * n_docs + d[ask]
        rest[ask] -= has[np.minimum(np.searchsorted(has, key), len(has) - 1)] == key
        return rest, follower[i]

    n1, t1 = left(top)
    n2, t2 = left(second)
    n2 = np.where(two[group], n2, 0)
    first = n1 >= n2
    out[0][at], out[1][at], out[2][at] = np.where(first, n1, n2), np.where(first, t1, t2), total[group]
    return out


_buckets = np.searchsorted(COUNTS, np.arange(COUNTS[-1] + 1), side="right") - 1


def _bucket(x: np.ndarray) -> np.ndarray:
    return _buckets.take(np.minimum(x, COUNTS[-1]))


def _back(x: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """What stands k tokens before in the same text, 0 where that is before its start."""
    out = np.zeros_like(x)
    out[k:] = x[:-k]
    out[place < k] = 0
    return out


def _streak(hit: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many match bits in a row were 1 just before each token, in the same text."""
    i = np.arange(len(hit))
    row = np.where(hit, np.minimum(i - np.maximum.accumulate(np.where(hit, -1, i)), place + 1), 0)
    return _back(row, place, 1)


def _counted(parts: list[np.ndarray], bit: np.ndarray, train: np.ndarray) -> np.ndarray:
    """The state of each hashed context: how often zero and one followed it in training texts, without the occurrence itself."""
    x = np.zeros(len(bit), U)
    for part in parts:
        x = mix(x * U(31) + part.astype(U))
    slot = (x >> U(64 - MATCH_BITS)).astype(np.int64)
    n = np.bincount((slot * 2 + bit)[train], minlength=2 << MATCH_BITS).reshape(-1, 2)
    zeros, ones = n[slot, 0] - train * (1 - bit), n[slot, 1] - train * bit
    level = lambda c: _level_of.take(c) if n.max() < len(_level_of) else np.searchsorted(GRID, c, side="right") - 1
    return _state[level(zeros) * 256 + level(ones)].astype(np.int64)


def mixed_match(states: list[np.ndarray], sizes: list[int], gate: np.ndarray, bit: np.ndarray, train: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Probability that each match bit is 1: log-odds of the states under gated weights, trained online in mini-batches by ``order``, then refined.

    The first states are followers, whose state 0 says nothing.
    """
    each = []
    for k, (state, size) in enumerate(zip(states, sizes)):
        n = np.bincount((state * 2 + bit)[train], minlength=2 * size).reshape(-1, 2) + np.array([0.95, 0.05])
        odds = np.log(n[:, 1] / n[:, 0])
        odds[0] *= k >= len(MATCHES)
        each.append(odds[state])
    each = np.stack(each)
    weights = np.full((MATCH_GATES, len(each)), MATCH_START)
    squares = np.full_like(weights, 1e-6)
    mixed = lambda at: np.clip((weights[gate[at]].T * each[:, at]).sum(axis=0), -16, 16)
    batches = max(1, -(-int(train.sum()) // MATCH_MINI))
    batch = np.where(train, (order >> U(32)) * U(batches) >> U(32), U(batches)).astype(np.int64)
    rows = np.argsort(batch, kind="stable")
    ends = np.searchsorted(batch[rows], np.arange(batches + 1))
    for lo, hi in zip(ends[:-1], ends[1:]):
        at = rows[lo:hi]
        g, error = gate[at], bit[at] - _squash(mixed(at))
        mass = np.maximum(np.bincount(g, minlength=MATCH_GATES), 1)
        for k, x in enumerate(each):
            slope = np.bincount(g, weights=error * x[at], minlength=MATCH_GATES) / mass
            squares[:, k] += slope * slope
            weights[:, k] += MATCH_RATE * slope / np.sqrt(squares[:, k])
    y = mixed(slice(None))
    step = gate * STEPS + np.rint(np.clip(y, -8, 8) * 2).astype(np.int64) + STEPS // 2
    guess = _squash((np.arange(STEPS) - STEPS // 2) / 2)
    refined = np.tile(np.stack([1 - guess, guess], axis=-1) * 20, (MATCH_GATES, 1))
    refined += np.bincount((step * 2 + bit)[train], minlength=refined.size).reshape(refined.shape)
    return np.clip((_squash(y) + (refined[:, 1] / refined.sum(axis=1))[step]) / 2, 1e-6, 1 - 1e-6)


def matches(token: np.ndarray, doc: np.ndarray, place: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens that have a match bit, the bits, the probability of 1 of each)."""
    n = len(token)
    used, guess, case = np.zeros(n, bool), np.zeros(n, U), np.zeros(n, np.int64)
    states, kinds = [], np.zeros(n, np.int64)
    context, last, first = None, 0, None
    for i, (order, source) in enumerate(MATCHES):
        context = context if order == last else contexts(token, place, order)
        last, first = order, context if first is None else first
        if source == "own":
            times, follower, agreed = own_followers(context, token, doc)
            which = _bucket(times) * 8 + agreed
        else:
            times, follower, total = region_followers(context, token, doc, train)
            which = _bucket(times) * 8 + _bucket(np.maximum(1, total // np.maximum(1, times)))
        known = times > 0
        new = known & ~used
        guess[new], case[new] = follower[new], i * 64 + which[new]
        used |= new
        other = follower != guess
        states.append(np.where(known, 1 + which + 64 * other, 0))
        kinds = kinds * 3 + np.where(known, 1 + other, 0)
    at = np.flatnonzero(used)
    if not len(at):
        return at, at, np.zeros(0)
    hit = used & (guess == token)
    outcome = np.where(used, 1 + hit, 0)
    before = [_back(outcome, place, k)[at] for k in range(1, HISTORY + 1)]
    bit, own = hit[at].astype(np.int64), train[at]
    streak = _bucket(_streak(hit, place)[at])
    hashed = [[case[at], streak, before[0]], [kinds[at], *before[:3]], before]
    found = [s[at] for s in states] + [_counted(parts, bit, own) for parts in hashed]
    return at, bit, mixed_match(found, [129] * len(states) + [N_STATES] * len(hashed), kinds[at], bit, own, mix(first[at] + token[at]))


def with_matches(found: tuple[np.ndarray, np.ndarray, np.ndarray], spelled: np.ndarray) -> np.ndarray:
    """log10 probability of each token from its match bit and, if that is 0, its spelling."""
    at, bit, p = found
    out = spelled.copy()
    out[at] = np.where(bit == 1, np.log10(p), np.log10(1 - p) + spelled[at])
    return out


def match_bits(token: np.ndarray, doc: np.ndarray, place: np.ndarray, train: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    return with_matches(matches(token, doc, place, train), spelled)


# --- scores --------------------------------------------------------------------------------------


def _needs(table: pa.Table) -> pa.Table:
    """The tokens of a region."""
    keys = [np.unique(words.hashes) for words in sub_batches(table["text"])]
    keys = np.unique(np.concatenate([*keys, END]))
    return pa.table({"chunk": pa.array(np.full(len(keys), table["chunk"][0].as_py(), np.int64)), "hash": pa.array(keys.view(np.int64))})


def _region(column, weights: np.ndarray) -> dict[str, np.ndarray]:
    """All tokens of a region's texts in order, ends included, with the bytes they come from."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("token", "doc", "place", "kind", "start", "end", "data", "rows", "bytes")}
    size = 0
    for words in sub_batches(column, 4096):
        n, m = words.hi - words.lo, len(words.hashes)
        row = words.rows()
        kind, last = kinds(words, weights)
        at, ends = np.arange(m) + row, words.first[1:] + np.arange(n)

        def lay(a: np.ndarray, b: np.ndarray, to: np.ndarray = at, end: np.ndarray = ends, both: int = m + n) -> np.ndarray:
            out = np.zeros(both, a.dtype)
            out[to], out[end] = a, b
            return out

        parts["token"].append(lay(words.hashes, np.repeat(END, n)))
        parts["doc"].append((lay(row, np.arange(n)) + words.lo).astype(np.int32))
        parts["place"].append(lay(np.arange(m) - words.first[:-1][row], words.counts).astype(np.int32))
        parts["kind"].append(lay(kind, last).astype(np.int8))
        here = size + len(words.data)  # an end sign follows each batch's bytes
        parts["start"].append(lay(words.starts + size, np.full(n, here)))
        parts["end"].append(lay(words.ends + size, np.full(n, here + 1)))
        parts["data"] += [words.data, np.array([END_BYTE], np.uint8)]
        parts["rows"].append(words.counts + 1)
        parts["bytes"].append(np.diff(words.offsets))
        size = here + 1
    return {k: np.concatenate(parts.pop(k)) for k in list(parts)}


def spell(speller: Speller, code: Code, t: dict[str, np.ndarray], guessed: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each token's spelling, worked out once for each token and kind; 0 for the guessed ones, which are not spelled."""
    order, new = _grouped(_class_keys(t["token"], t["kind"]))
    if guessed is not None:
        spelled = np.ones(len(order), bool)
        spelled[guessed] = False
        group = (np.cumsum(new) - 1)[spelled[order]]
        order = order[spelled[order]]
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
    first = order[new]
    logs = np.zeros(len(first))
    # tokens of a kind that begin alike side by side
    begins = np.zeros(len(first), U)
    for k in range(7):
        at = t["start"][first] + k
        begins = begins << U(8) | np.where(at < t["end"][first], t["data"][np.minimum(at, len(t["data"]) - 1)], 0).astype(U)
    alike = np.argsort(begins | t["kind"][first].astype(U) << U(56))
    for lo in range(0, len(first), PIECE):
        piece = alike[lo : lo + PIECE]
        i = first[piece]
        logs[piece] = speller.logs(Steps(code, t["data"], t["start"][i], t["end"][i], t["kind"][i], once=True))
    out = np.zeros(len(t["token"]))
    out[order] = logs[np.cumsum(new) - 1]
    return out


def _score(shared, n: int, v: int):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        code, speller, weights = shared.value
        rows, held = docs.num_rows, docs["held"].to_numpy()
        out = {c: np.zeros(rows, np.int64) for c in ("n_tokens", "n_known", "n_bytes")}
        base, score = np.zeros(rows), np.zeros(rows)
        if rows:
            t = _region(docs["text"], weights)
            order = np.argsort(known["hash"].to_numpy().view(U))
            keys, c = known["hash"].to_numpy().view(U)[order], known["c"].to_numpy()[order]
            found = np.searchsorted(keys, t["token"])
            if not np.array_equal(keys[np.minimum(found, len(keys) - 1)], t["token"]):
                raise ValueError("a region's texts changed between two reads: write the input first")
            c = c[found]
            add = lambda x: np.bincount(t["doc"], weights=x, minlength=rows)
            base = add(np.log10((c + 1.0) / (n + 1.0 * (v + 1))))
            found = matches(t["token"], t["doc"], t["place"], ~held[t["doc"]])
            score = add(with_matches(found, spell(speller, code, t, found[0][found[1] == 1])))
            out = {"n_tokens": t["rows"], "n_known": add(c > 0).astype(np.int64), "n_bytes": t["bytes"]}
            del t
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held"], **{k: pa.array(x) for k, x in out.items()}, "train_tokens": pa.array(np.full(rows, n, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [region_keys(words) for words in sub_batches(batch.column("text"))]
        yield batch.append_column("key", pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))


def regions(docs: DataFrame, sizes: DataFrame, chunks: int) -> DataFrame:
    """The documents with their region (chunk); keys above a quarter of a region are dealt to several."""
    heavy = sizes.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > CHUNK // 4)
    heavy = written(heavy.select("key", F.ceil(F.col("bytes") / (CHUNK // 4)).alias("split")), "lm-heavy")
    if heavy.count() <= MOST_HEAVY:  # 3 MB; beyond, the join shuffles
        heavy = F.broadcast(heavy)
    keyed = docs.mapInArrow(_keyed, "doc_id long, text string, held boolean, row long, key long")
    deal = F.when(F.col("split").isNotNull(), F.pmod(F.xxhash64("row"), F.col("split"))).otherwise(F.lit(0))
    return keyed.join(heavy, "key", "left").select("doc_id", "text", "held", F.pmod(F.xxhash64("key", deal), F.lit(chunks)).alias("chunk"))


@dataclass
class Model:
    """What scoring needs: of fixed size but for ``vocabulary`` and ``sizes``, which are tables."""

    code: Code
    mixer: Mixer
    weights: np.ndarray
    n: int
    v: int
    size: int
    vocabulary: DataFrame
    sizes: DataFrame


def _documents(df: DataFrame, id_col: str, text_col: str, folds: int, held_fold: int) -> DataFrame:
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold, F.lit(False)).alias("held"),
    )


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> Model:
    """A model of all rows outside the held fold."""
    share = df.sparkSession.sparkContext.broadcast
    docs = _documents(df, id_col, text_col, folds, held_fold)
    # kinds of text, and the documents that belong together
    survey = written(docs.select("text", "held").mapInArrow(_survey, "key long, size long, block int, sums binary"), "lm-survey")
    sizes = survey.filter("key is not null").select("key", "size")
    size = sizes.agg(F.sum("size")).first()[0] or 0
    both = np.zeros((BUCKETS, BUCKETS), np.int64)
    for r in survey.filter("block is not null").select("block", "sums").groupBy("block").applyInArrow(_add_counts, "block int, sums binary").collect():  # at most BUCKETS / 16
        both[r["block"] : r["block"] + 16] = np.frombuffer(r["sums"], np.int64).reshape(16, -1)
    weights = fit_kinds(both)
    # counts of every training token
    parts = F.pmod("hash", F.lit(max(1, -(-size // PART)))).cast("int").alias("part")
    counted = docs.filter("not held").select("text").mapInArrow(_count_tokens(weights), "hash long, kind int, token binary, c long").select(parts, "*")
    schema = "part int, hash long, kind int, token binary, c long, total long"
    vocabulary = written(counted.groupBy("part").applyInArrow(_merge_part, schema), "lm-vocabulary")
    sums = vocabulary.agg(F.sum("c").alias("n"), F.count("total").alias("v")).first()
    # bytes and their code, tables of counts, and the mixer
    counts = np.ones(256, np.int64)
    for r in vocabulary.select("token", "c").mapInArrow(_byte_counts, "byte int, c long").groupBy("byte").agg(F.sum("c").alias("c")).collect():  # at most 256
        counts[r["byte"]] += r["c"]
    code = Code(counts)
    tokens = vocabulary.groupBy("part")
    blocks = tokens.applyInArrow(_bit_counts(share(code)), "block int, sums binary").groupBy("block").applyInArrow(_levels, "block int, levels binary")
    levels = [np.zeros(1 << bits, np.uint16) for *_, bits in PREDICTORS]
    for r in blocks.toLocalIterator():  # 13 MB in all
        k, b = divmod(r["block"], 1000)
        levels[k][b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(r["levels"], np.uint16)
    trainers = tokens.applyInArrow(_train(share((code, levels))), "block int, sums binary").groupBy("block").applyInArrow(_add_floats, "block int, sums binary")
    mixer = trained(levels, {r["block"]: bytes(r["sums"]) for r in trainers.collect()})  # four rows
    return Model(code, mixer, weights, sums["n"] or 0, sums["v"] or 0, size, vocabulary, sizes)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, n_bytes, train_tokens, base_score and score (log10) of every row."""
    model = model or fit(df, id_col, text_col, folds, held_fold)
    docs = _documents(df, id_col, text_col, folds, held_fold).withColumn("row", F.monotonically_increasing_id())
    chunked = regions(docs, model.sizes, max(1, -(-model.size // CHUNK))).groupBy("chunk")
    needs = chunked.applyInArrow(_needs, "chunk long, hash long")
    total = model.vocabulary.filter("total is not null").select("hash", F.col("total").alias("c"))
    known = needs.join(total, "hash", "left").select("chunk", "hash", F.coalesce("c", F.lit(0)).alias("c")).groupBy("chunk")
    shared = df.sparkSession.sparkContext.broadcast((model.code, Speller(model.mixer), model.weights))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, train_tokens long, base_score double, score double"
    return chunked.cogroup(known).applyInArrow(_score(shared, model.n, model.v), schema)


def digest(scored: DataFrame) -> DataFrame:
    bits = -F.col("score") * F.lit(float(np.log2(10))) / F.greatest(F.col("n_bytes"), F.lit(1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
