"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with its own place in a tree of the bits
before it. Each decision is predicted in the contexts of the 0 to DEPTH bytes
before it by Krichevsky-Trofimov estimates, and every context mixes its own
estimate with those of its longer contexts, by the weights that the training
counts give. Every context of the training texts is a node. The weights are fixed
after training, so the code length of a byte after a context is a number in a
table, and a text's is a sum.

The tree is a table of runs (a context and the byte after it). It is dealt by the
last ROOT bytes of the contexts: all below such a context is worked out in one
task (by parts where it is crowded, 16 bytes a run being held), what is above it at the driver. Texts look up the most frequent runs in the
tasks; the other runs, and those that training lacks, are joined.

Texts are words of lower-case letters A-Z joined by spaces, with a newline at
the end: the code length covers the same tokens as the word counts beside it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfuse.llm.common import materialize, ship, table, text_slices
from skyfuse.llm.rolling import Words, normal

DEPTH = 6
NODES = 65536  # of the bounded tree that grow() makes: contexts of all lengths, the most frequent
ROOT = 3
CHUNK = 1 << 17  # runs worked out at once, or those of one context of ROOT + 1 bytes if more
RUNS = 1 << 21  # most frequent runs whose code lengths are broadcast; the others' are joined
FREQUENT = 1 << 20  # most frequent words whose counts are broadcast; the others' are joined
WORDS, GRAMS = 0, 1
SLICE = 3 << 19  # bytes of text in work at once
HELD = 1 << 20  # distinct counts a task holds before it sends them on

_LGAMMA = np.array([math.lgamma(k + 0.5) for k in range(4096)])
_LFACT = np.array([math.lgamma(k + 1.0) for k in range(8192)])


def _lgamma(x: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(x + shift) of whole numbers: tabled, or by Stirling's series."""
    z = np.maximum(x, 1000) + shift
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return np.where(x < 4096, table[np.minimum(x, 4095).astype(np.int64)], series)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones, in any order."""
    return _lgamma(a, _LGAMMA, 0.5) + _lgamma(b, _LGAMMA, 0.5) - _lgamma(a + b, _LFACT, 1.0) - math.log(math.pi)


def decisions(counts: np.ndarray) -> np.ndarray:
    """counts of symbols (rows x 2**bits) -> of the zeros and ones of each decision
    (rows x 2**bits x 2); decision (1 << k) + j follows the k bits of j."""
    out = np.zeros((*counts.shape, 2), counts.dtype)
    level = counts
    for k in range(counts.shape[1].bit_length() - 2, -1, -1):
        two = level.reshape(len(counts), 1 << k, 2)
        out[:, 1 << k : 2 << k] = two
        level = two.sum(2)
    return out


def symbol_logs(one: np.ndarray) -> np.ndarray:
    """Probability of a one at each decision -> log10 of each symbol's, both rows x 2**bits."""
    out = np.zeros((len(one), 1))
    for k in range(one.shape[1].bit_length() - 1):
        p = one[:, 1 << k : 2 << k]
        out = np.stack([out + np.log10(1 - p), out + np.log10(p)], 2).reshape(len(one), -1)
    return out


def codes(buf: np.ndarray, depth: int) -> np.ndarray:
    """At each byte the last depth + 1 bytes as one number, the byte itself lowest.
    What precedes the buffer counts as newlines."""
    padded = np.concatenate([np.full(depth, 10, np.uint8), buf]).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for k in range(depth + 1):
        out |= padded[depth - k : depth - k + len(buf)] << np.uint64(8 * k)
    return out


def separate(buf: np.ndarray, code: np.ndarray, depth: int) -> np.ndarray:
    """The codes with all that precedes a text's own beginning turned into newlines."""
    at = np.flatnonzero(buf == 10)
    for k in range(1, depth + 1):  # the k-th byte of each text: all above its k bytes is past
        place = at + k
        place = place[place < len(buf)]
        # only texts at least k bytes long; in shorter ones a newline came between and goes by its own
        inside = place[np.searchsorted(at, place) == np.searchsorted(at, place - k + 1)]
        low = np.uint64((1 << (8 * k)) - 1)
        fill = np.uint64(sum(10 << (8 * j) for j in range(k, depth + 1)))
        code[inside] = code[inside] & low | fill
    return code


def symbols(known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's symbol, and log10 of the share that it has of its symbol."""
    symbol = np.zeros(256, np.int64)
    symbol[known] = np.arange(len(known))
    others = np.setdiff1d(np.arange(256), known)
    symbol[others] = len(known) + np.arange(len(others)) % max(1, width - len(known))
    with np.errstate(divide="ignore"):
        return symbol, -np.log10(np.bincount(symbol, minlength=width))[symbol]


class Tree:
    """Nodes by depth: sorted contexts (the newest byte lowest) and counts of what
    follows. Symbols are the bytes met in training, in order; the other bytes are
    dealt to the symbols that are left and share their probability evenly."""

    def __init__(self, depth: int, contexts: list[np.ndarray], counts: list[np.ndarray], known: np.ndarray):
        self.depth, self.contexts = depth, contexts
        width = counts[0].shape[1]
        self.symbol, self.share = symbols(known, width)
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        n = int(self.first[-1])
        parents = [np.zeros(0, np.int64)]
        for d in range(1, depth + 1):
            mask = np.uint64((1 << (8 * (d - 1))) - 1)
            parents.append(np.searchsorted(contexts[d - 1], contexts[d] & mask))
        weighted = [np.zeros((len(c), width)) for c in contexts]  # log probability of what came after each node
        stop = [np.ones((len(c), width), np.float32) for c in contexts]
        rest = [np.zeros((0, width), np.uint32)] * (depth + 1)
        for d in range(depth, -1, -1):
            if not len(contexts[d]):
                continue
            below = np.zeros((len(contexts[d]), width))
            left = counts[d].copy()
            if d < depth and len(contexts[d + 1]):
                np.add.at(below, parents[d + 1], weighted[d + 1])
                np.subtract.at(left, parents[d + 1], counts[d + 1])
            rest[d] = left
            for s in range(0, len(left), 2048):
                part = slice(s, s + 2048)
                ab = decisions(counts[d][part].astype(np.int64))
                own = log_kt(ab[..., 0], ab[..., 1])
                if d == depth:
                    weighted[d][part] = own
                    continue
                ab = decisions(left[part].astype(np.int64))
                split = below[part] + log_kt(ab[..., 0], ab[..., 1])
                both = math.log(0.5) + np.logaddexp(own, split)
                weighted[d][part], stop[d][part] = both, np.exp(math.log(0.5) + own - both)
        del weighted
        self.logs = np.zeros((n, width), np.float32)
        mixed = open_ = None
        for d in range(depth + 1):
            size = len(contexts[d])
            now, still = np.zeros((size, width), np.float32), np.ones((size, width), np.float32)
            for s in range(0, size, 2048):
                part = slice(s, s + 2048)
                ab = decisions(counts[d][part].astype(np.int64)).astype(np.float64)
                own = (ab[..., 1] + 0.5) / (ab.sum(2) + 1)
                before = mixed[parents[d][part]].astype(np.float64) if d else np.zeros_like(own)
                weight = open_[parents[d][part]].astype(np.float64) if d else np.ones_like(own)
                if d == depth:
                    last = before + weight * own
                else:
                    now[part], still[part] = before + weight * stop[d][part] * own, weight * (1 - stop[d][part])
                    ab = decisions(rest[d][part].astype(np.int64)).astype(np.float64)
                    last = now[part] + still[part] * (ab[..., 1] + 0.5) / (ab.sum(2) + 1)
                self.logs[self.first[d] + s : self.first[d] + s + len(own)] = symbol_logs(np.clip(last, 1e-9, 1 - 1e-9))
            mixed, open_ = now, still

    def look(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores, and whether each is known: all are."""
        return self.score(code), np.ones(len(code), bool)

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each code's lowest byte after the bytes above it."""
        byte = (code & np.uint64(255)).astype(np.int64)
        node = np.zeros(len(code), np.int64)
        alive = np.arange(len(code))
        for d in range(1, self.depth + 1):
            own = self.contexts[d]
            if not len(own) or not len(alive):
                break
            ctx = (code[alive] >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
            at = np.minimum(np.searchsorted(own, ctx), len(own) - 1)
            hit = own[at] == ctx
            alive = alive[hit]
            node[alive] = self.first[d] + at[hit]
        return self.logs[node, self.symbol[byte]] + self.share[byte]


def width_for(known: int) -> int:
    """A power of two with room for the known symbols and one for others."""
    return max(2, 1 << known.bit_length()) if known < 256 else 256


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _counts(depth: int):
    """(kind, key, n): counts of words by their hash, and of runs of depth + 1 bytes."""

    def run(batches):
        held: dict[int, list] = {WORDS: [], GRAMS: []}
        size = {WORDS: 0, GRAMS: 0}

        def out(kind):
            key, n = _merged(held[kind])
            held[kind], size[kind] = [], 0
            for s in range(0, len(key), 1 << 17):
                part = slice(s, s + (1 << 17))
                yield pa.record_batch([pa.array(np.full(len(key[part]), kind, np.int32)), pa.array(key[part].view(np.int64)), pa.array(n[part])], ["kind", "key", "n"])

        for _, raw in text_slices(batches, most=SLICE):
            words = Words([normal(x, lower=True) for x in raw])
            for kind, keys in ((WORDS, words.hashes()[1]), (GRAMS, separate(words.buf, codes(words.buf, depth), depth))):
                key, n = np.unique(keys, return_counts=True)
                held[kind].append((key, n))
                size[kind] += len(key)
                if size[kind] > 2 * HELD:
                    held[kind] = [_merged(held[kind])]
                    size[kind] = len(held[kind][0][0])
                    if size[kind] > HELD:
                        yield from out(kind)
        for kind in held:
            if held[kind]:
                yield from out(kind)

    return run


def _numbers(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a table of bounded size, at the driver."""
    got = df.select(*columns).toArrow()
    return [got.column(i).to_numpy() for i in range(len(columns))]


def grow(grams: DataFrame, depth: int = DEPTH, nodes: int = NODES) -> Tree:
    """The tree from (key, n), the counts of runs of depth + 1 bytes. The driver
    gets `nodes` contexts and what follows them, at most 256 numbers each."""
    levels: list[DataFrame] = []
    for d in range(depth, -1, -1):
        if d < depth:
            mask = (1 << (8 * (d + 1))) - 1
            grams = materialize(grams.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n")))
        levels.insert(0, grams.withColumn("ctx", F.shiftrightunsigned("key", 8)).withColumn("depth", F.lit(d)))
    contexts = [x.groupBy("depth", "ctx").agg(F.sum("n").alias("total")) for x in levels]
    every = contexts[0]
    for x in contexts[1:]:
        every = every.union(x)
    # a context comes at least as often as those that end in it, so parents are chosen before their children
    chosen = materialize(every.orderBy(F.desc("total"), "depth", "ctx").limit(nodes))
    at_depth, ctx = _numbers(chosen, "depth", "ctx")
    own = [np.sort(ctx[at_depth == d]).view(np.uint64) for d in range(depth + 1)]
    if not len(own[0]):
        own[0] = np.zeros(1, np.uint64)
    known = np.sort(_numbers(levels[0], "key")[0])
    width = width_for(len(known))
    column = np.zeros(256, np.int64)
    column[known] = np.arange(len(known))
    counts = []
    for d, level in enumerate(levels):
        got = np.zeros((len(own[d]), width), np.int64)
        if len(own[d]):
            key, n = _numbers(level.join(F.broadcast(chosen.where(F.col("depth") == d).select("ctx")), "ctx", "left_semi"), "key", "n")
            key = key.view(np.uint64)
            np.add.at(got, (np.searchsorted(own[d], key >> np.uint64(8)), column[(key & np.uint64(255)).astype(np.int64)]), n)
        counts.append(got if got.max(initial=0) >> 32 else got.astype(np.uint32))
    return Tree(depth, own, counts, known)


class Runs:
    """Code lengths of the most frequent runs."""

    def __init__(self, depth: int, key: np.ndarray, log: np.ndarray):
        order = np.argsort(key.view(np.uint64))
        self.depth, self.key, self.log = depth, key.view(np.uint64)[order], log[order]

    def look(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code's log10 probability, 0 where it is not held, and whether it is."""
        if not len(self.key):
            return np.zeros(len(code)), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.key, code), len(self.key) - 1)
        held = self.key[at] == code
        return np.where(held, self.log[at], 0.0), held


class Level:
    """What the contexts of one length say on each decision: item holds a context and,
    in the lowest byte, the decision; a and b count the zeros and ones."""

    def __init__(self, item: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        self.item, self.a, self.b = item, a, b
        own = log_kt(a, b)
        self.weighted = own if below is None else math.log(0.5) + np.logaddexp(own, below)
        self.stop = np.ones(len(item)) if below is None else np.exp(math.log(0.5) + own - self.weighted)

    @classmethod
    def joined(cls, parts: list[Level]) -> Level:
        """One level of several that share no item."""
        out = cls.__new__(cls)
        for name in ("item", "a", "b", "weighted", "stop"):
            setattr(out, name, np.concatenate([getattr(x, name) for x in parts]))
        return out

    def up(self, bytes_: int) -> Level:
        """The level of contexts of so many bytes, one less than here."""
        item, self.parent = np.unique(self.item & np.uint64((1 << (8 * (bytes_ + 1))) - 1), return_inverse=True)
        a, b, below = (np.bincount(self.parent, x, len(item)) for x in (self.a, self.b, self.weighted))
        return Level(item, a, b, below)

    def down(self, mixed: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each item's parent: the mixture up to here, and the weight left for longer contexts."""
        return mixed + open_ * self.stop * (self.b + 0.5) / (self.a + self.b + 1), open_ * (1 - self.stop)


def _levels(key: np.ndarray, n: np.ndarray, symbol: np.ndarray, bits: int, depth: int, root: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels depth, depth - 1, .. root over the runs; for each run (rows) and bit the
    place of its decision in the first level, and the bit."""
    s = symbol[(key & np.uint64(255)).astype(np.int64)][:, None]
    k = np.arange(bits)
    decision, bit = (1 << k) + (s >> (bits - k)), s >> (bits - k - 1) & 1
    item, at = np.unique((key & ~np.uint64(255))[:, None] | decision.astype(np.uint64), return_inverse=True)
    at = at.reshape(bit.shape)
    counts = np.repeat(n, bits)
    ones = np.bincount(at.ravel(), counts * bit.ravel(), len(item))
    levels = [Level(item, np.bincount(at.ravel(), counts, len(item)) - ones, ones, None)]
    for d in range(depth - 1, root - 1, -1):
        levels.append(levels[-1].up(d))
    return levels, at, bit


def _by_root(batches, root: int):
    """(key, n) of about CHUNK runs, all of a context of `root` bytes together; the runs come sorted by it."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            of = key >> np.uint64(8) & np.uint64((1 << (8 * root)) - 1)
            cut = int(np.flatnonzero(of != of[-1])[-1]) + 1 if (of != of[-1]).any() else 0
            if cut:
                yield key[:cut], n[:cut]
            held, size = [(key[cut:], n[cut:])], 0  # a long run of one context is looked at again CHUNK rows later
    if held and sum(len(k) for k, _ in held):
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _parts(key: np.ndarray, n: np.ndarray, length: int):
    """(key, n) of about CHUNK runs, all of a context of `length` bytes together."""
    of = key >> np.uint64(8) & np.uint64((1 << (8 * length)) - 1)
    order = np.argsort(of, kind="stable")
    key, n, of = key[order], n[order], of[order]
    begin = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
    at = 0
    while at < len(of):
        end = int(begin[max(np.searchsorted(begin, at + CHUNK, "right") - 1, np.searchsorted(begin, at, "right"))])
        yield key[at:end], n[at:end]
        at = end


def _raise(depth: int, root: int, symbol: np.ndarray, bits: int):
    def run(batches):
        for key, n in _by_root(batches, root):
            if len(key) <= 2 * CHUNK or depth == root:
                top = _levels(key, n, symbol, bits, depth, root)[0][-1]
            else:  # a crowded context is worked out by the contexts one byte longer; only their sums stay
                top = Level.joined([_levels(k, m, symbol, bits, depth, root + 1)[0][-1] for k, m in _parts(key, n, root + 1)]).up(root)
            yield pa.record_batch([pa.array(top.item.view(np.int64)), pa.array(top.a.astype(np.int64)), pa.array(top.b.astype(np.int64)), pa.array(top.weighted)], ["item", "a", "b", "weighted"])

    return run


def _lower(depth: int, root: int, symbol: np.ndarray, share: np.ndarray, bits: int, held):
    def told(key, n, levels, at, bit, mixed, open_):
        """Code lengths of runs, given what is mixed above their highest level."""
        for i in range(len(levels) - 1, -1, -1):
            mixed, open_ = levels[i].down(mixed, open_)
            if i:
                mixed, open_ = mixed[levels[i - 1].parent], open_[levels[i - 1].parent]
        one = np.clip(mixed, 1e-9, 1 - 1e-9)[at]
        log = np.log10(np.where(bit == 1, one, 1 - one)).sum(1) + share[(key & np.uint64(255)).astype(np.int64)]
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(n), pa.array(log)], ["key", "n", "log"])

    def run(batches):
        above = held.value

        def from_above(first):
            mixed, open_ = np.zeros(len(first)), np.ones(len(first))
            for d, (item, m, o) in enumerate(above):  # of the longest context met in training
                ask = first & np.uint64((1 << (8 * (d + 1))) - 1)
                place = np.minimum(np.searchsorted(item, ask), max(len(item) - 1, 0))
                hit = item[place] == ask if len(item) else np.zeros(len(ask), bool)
                mixed[hit], open_[hit] = m[place[hit]], o[place[hit]]
            return mixed, open_

        for key, n in _by_root(batches, root):
            if len(key) <= 2 * CHUNK or depth == root:
                levels, at, bit = _levels(key, n, symbol, bits, depth, root)
                yield told(key, n, levels, at, bit, *from_above(levels[-1].item))
                continue
            parts = list(_parts(key, n, root + 1))
            tops = [_levels(k, m, symbol, bits, depth, root + 1)[0][-1] for k, m in parts]
            lower, ends = Level.joined(tops), np.cumsum([len(x.item) for x in tops])
            upper = lower.up(root)
            mixed, open_ = upper.down(*from_above(upper.item))
            mixed, open_ = mixed[lower.parent], open_[lower.parent]
            del tops
            for (k, m), end in zip(parts, ends.tolist(), strict=True):
                levels, at, bit = _levels(k, m, symbol, bits, depth, root + 1)
                own = slice(end - len(levels[-1].item), end)
                yield told(k, m, levels, at, bit, mixed[own], open_[own])

    return run


def code_lengths(grams: DataFrame, depth: int = DEPTH):
    """From (key, n), the counts of runs of depth + 1 bytes in training: a function of
    such a table, which may hold more runs with n = 0, that adds each run's log10
    probability in the tree of all contexts. The driver gets a number for each
    decision met after a context of ROOT bytes."""
    spark = grams.sparkSession
    known = np.sort(_numbers(grams.select(F.col("key").bitwiseAND(F.lit(255)).alias("key")).distinct(), "key")[0])
    width = width_for(len(known))
    bits, root = width.bit_length() - 1, min(ROOT, depth)
    symbol, share = symbols(known, width)

    def dealt(runs):
        of = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * root)) - 1))
        return runs.select("key", "n", of.alias("of")).repartition("of").sortWithinPartitions("of").select("key", "n")

    item, a, b, weighted = _numbers(dealt(grams).mapInArrow(_raise(depth, root, symbol, bits), "item long, a long, b long, weighted double"), "item", "a", "b", "weighted")
    order = np.argsort(item.view(np.uint64))
    top = Level(item.view(np.uint64)[order], a[order], b[order], None)
    top.weighted = weighted[order]
    levels = [top]
    for d in range(root - 1, -1, -1):
        levels.append(levels[-1].up(d))
    above, mixed, open_ = [], np.zeros(len(levels[-1].item)), np.ones(len(levels[-1].item))
    for i in range(root, 0, -1):
        mixed, open_ = levels[i].down(mixed, open_)
        above.append((levels[i].item, mixed, open_))
        mixed, open_ = mixed[levels[i - 1].parent], open_[levels[i - 1].parent]
    held = spark.sparkContext.broadcast(above)
    return lambda runs: dealt(runs).mapInArrow(_lower(depth, root, symbol, share, bits, held), "key long, n long, log double")


def _most_frequent(counted: DataFrame, room: int) -> tuple[int, int, int]:
    """All keys' counts together, the number of keys, and the least n at which no more than
    `room` keys come as often. The driver gets a row for each power of two, and one for each
    count in the power that the answer lies in; of a power beyond 2**16 its upper end is taken."""
    power = F.floor(F.log2("n") + 1e-9).cast("int")  # counts below 2**40 fall in their own power
    rows = counted.groupBy(power.alias("p")).agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()
    by_power = {r["p"]: r["keys"] for r in rows}
    total, keys = sum(r["n"] for r in rows), sum(by_power.values())
    least = (1 << max(by_power) + 1) if by_power else 1
    for p in sorted(by_power, reverse=True):
        if by_power[p] <= room:
            room, least = room - by_power[p], 1 << p
            continue
        if p <= 16:
            for r in sorted(counted.where(power == p).groupBy("n").agg(F.count("*").alias("keys")).collect(), reverse=True):
                if r["keys"] > room:
                    break
                room, least = room - r["keys"], r["n"]
        break
    return total, keys, least


def _apply(held_tree, held_words):
    def run(batches):
        tree, (frequent, logs) = held_tree.value, held_words.value
        for part, raw in text_slices(batches, most=SLICE):
            words = Words([normal(x, lower=True) for x in raw])
            code, back = np.unique(separate(words.buf, codes(words.buf, tree.depth), tree.depth), return_inverse=True)
            log, held = tree.look(code)
            sums = np.concatenate([[0.0], np.cumsum(log[back])])
            ends = np.flatnonzero(words.buf == 10) + 1
            asked = np.flatnonzero(~held[back])
            runs = np.concatenate([[0], np.searchsorted(asked, ends)]).astype(np.int32)
            score = np.diff(np.concatenate([[0.0], sums[ends]]))
            h = words.hashes()[1]
            at = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
            known = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
            n = len(raw)
            base = np.bincount(words.doc[known], logs[at[known]], n).astype(float) if known.any() else np.zeros(n)
            rare = ~known
            offsets = np.concatenate([[0], np.cumsum(np.bincount(words.doc[rare], minlength=n))]).astype(np.int32)
            yield pa.record_batch(
                [part.column(part.schema.get_field_index("doc_id")), pa.array(np.diff(np.concatenate([[0], ends]))), pa.array(words.counts() + 1), pa.array(np.bincount(words.doc[known], minlength=n)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[rare].view(np.int64))), pa.ListArray.from_arrays(pa.array(runs), pa.array(code[back[asked]].view(np.int64)))],
                ["doc_id", "n_bytes", "n_tokens", "n_known", "base", "score", "rare", "runs"],
            )

    return run


def in_fold(doc_id: str = "doc_id", folds: int = 5, fold: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def score_texts(docs: DataFrame, training: DataFrame, depth: int = DEPTH, nodes: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score (words
    by their smoothed counts), score (the tree's log10 probability of the text) and
    bits_per_byte (the code length that it gives, per byte of the words and the end).
    Words and bytes are counted over all rows of training. With `nodes`, the tree
    is cut to so many contexts, the most frequent; else it holds all.

    Null texts count as empty: they hold one token, the end. Repeated rows score
    alike; columns but doc_id and text are left out; without training rows every
    byte is as likely as any other; an empty table gives an empty one."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col("text").cast("string").alias("text")
    ends = training.count()
    found = training.select(text).mapInArrow(_counts(depth), "kind int, key long, n long")
    # each task's counts are sums already: dealt first, they are not summed a second time there
    found = found.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    found = materialize(found, "kind")
    vocabulary = found.where(F.col("kind") == WORDS).select("key", "n")
    grams = found.where(F.col("kind") == GRAMS).select("key", "n")
    if nodes is None:
        lengths, often = code_lengths(grams, depth), _most_frequent(grams, RUNS)[2]
        tree = Runs(depth, *_numbers(lengths(grams).where(F.col("n") >= often), "key", "log"))
    else:
        tree = grow(grams, depth, nodes)
    tokens, words, least = _most_frequent(vocabulary, FREQUENT)
    tokens, words = tokens + ends, words + bool(ends)
    key, n = _numbers(vocabulary.where(F.col("n") >= least), "key", "n")
    order = np.argsort(key.view(np.uint64))
    frequent = key.view(np.uint64)[order], np.log10(n[order] + 0.5)
    sc = spark.sparkContext
    held = sc.broadcast(tree), sc.broadcast(frequent)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = materialize(docs.select("doc_id", text).mapInArrow(_apply(*held), f"doc_id {kind}, n_bytes long, n_tokens long, n_known long, base double, score double, rare array<long>, runs array<long>").withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("key"))
    seldom = vocabulary.where(F.col("n") < least).withColumnRenamed("key", "of")
    met = rare.join(seldom, F.col("key") == F.col("of"))
    # a word that training lacks counts 0 and adds the same for all: only the words met are sent back
    more = met.groupBy("row").agg(F.count("*").alias("met"), F.sum(F.log10(F.col("n") + 0.5)).alias("more")).withColumnRenamed("row", "to")
    out = scored.drop("runs").join(more, F.col("row") == F.col("to"), "left")
    score = F.col("score")
    if nodes is None:
        asked = scored.select("row", F.explode("runs").alias("key"))
        every = grams.union(asked.select("key", F.lit(0).cast("long"))).groupBy("key").agg(F.sum("n").alias("n"))
        told = lengths(every).where(F.col("n") < often).select(F.col("key").alias("of"), "log")
        of_row = asked.join(told, F.col("key") == F.col("of")).groupBy(F.col("row").alias("by")).agg(F.sum("log").alias("joined"))
        out = out.join(of_row, F.col("row") == F.col("by"), "left")
        score = score + F.coalesce("joined", F.lit(0.0))
    met_here = F.coalesce("met", F.lit(0))
    unseen = F.size("rare") - met_here
    end = math.log10(ends + 0.5)
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + unseen * math.log10(0.5) + end - F.col("n_tokens") * math.log10(tokens + 0.5 * (words + 1))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + met_here + F.lit(int(bool(ends)))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), (score * (-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


def op1_ctw(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, docs.where(~in_fold()))
    return out.select("doc_id", in_fold().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
