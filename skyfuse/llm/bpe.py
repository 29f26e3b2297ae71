"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a piece has exactly one encoding, and what precedes its last
token is the encoding of a shorter prefix. So one token per prefix is stored:
the last one. A token that ends at a prefix is the right one if it and the last
token before it stay two tokens when their bytes are merged by rank. Appending
bytes leaves earlier entries as they are; after an edit, entries are computed
anew until they agree with the old ones as far back as the longest token."""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfuse.llm.common import ship, table, text_slices

GENERATION = 200_000  # pieces met lately are held in two generations of about so many
CACHED_PAIRS = 1_000_000
BATCH = 1 << 15  # pieces worked out at once
LONGEST_CACHED = 64  # bytes; a longer piece is worked out by itself, in time linear in its length, and not held


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Numbers:
    """Whole numbers by whole numbers, looked up many at a time (open addressing)."""

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self._place(key)
        there = self.keys[at]
        out = np.where(there == key, self.values[at], -1)
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            at = (at[left] if len(at) != len(left) else at) + 1 & (1 << self.bits) - 1
            own = key[left]
            there = self.keys[at]
            hit = there == own
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            left, at = left[on], at[on]
        return out

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that are not held yet."""
        self.used += len(key)
        if 2 * self.used > len(self.keys):
            held = self.keys >= 0
            key, value = np.concatenate([self.keys[held], key]), np.concatenate([self.values[held], value])
            self.bits = int(4 * self.used).bit_length()
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self._place(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]
            own = self.keys[at] == key
            self.values[at[own]] = value[own]
            key, value, at = key[~own], value[~own], at[~own] + 1 & (1 << self.bits) - 1


class Vocabulary:
    """Tokens by rank. An automaton over their bytes tells which tokens end at a
    place: its states are the longest ends of what was read that a token begins
    with, and are made as they are met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: tokens that merging their own bytes ends in, with the two parts merged last; no other can be part of an encoding
        self.halves: dict[int, tuple[int, int] | None] = {}
        for t, r in ranks.items():
            parts = self.merged(t, 2)
            if len(parts) < 2:
                self.halves[r] = None
            elif len(parts) == 2:
                self.halves[r] = ranks[parts[0]], ranks[parts[1]]
        self.beginnings = {t[:k] for t in map(self.bytes_of.__getitem__, self.halves) for k in range(1, len(t) + 1)}
        self.numbers: dict[bytes, int] = {b"": 0}
        self.held: list[bytes] = [b""]
        self.ends: list[list[tuple[int, int]]] = [[]]  # by state: the tokens that end there and their lengths, longest first
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        self.apart: dict[int, bool] = {}
        # the same for many pieces at a time
        self.steps, self.pairs = Numbers(), Numbers()
        self.length = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for r, t in self.bytes_of.items():
            self.length[r] = len(t)
        self.ending = np.full((1, 1), -1, np.int64)  # k-th token that ends in a state: ending[k, state]

    def merged(self, data: bytes, leave: int = 1) -> list[bytes]:
        """data's parts after merging neighbours, lowest rank first, then leftmost, until `leave` parts are left."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        ranks = [rank(data[i : i + 2], 1 << 30) for i in range(len(data) - 1)]
        while len(parts) > leave:
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], 1 << 30)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], 1 << 30)
        return parts

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b ends in a and b. Going back from
        there, the later of the two tokens at the border comes apart again; whenever
        these could merge sooner than what was undone last, they would have."""
        if len(self.apart) >= CACHED_PAIRS:
            self.apart.clear()
        key, of, rank, halves, undone = a << 32 | b, self.bytes_of, self.ranks.get, self.halves, 1 << 30
        while True:
            if rank(of[a] + of[b], 1 << 30) < undone:
                found = False
                break
            x, y = halves[a], halves[b]
            if x is None and y is None:
                found = True
                break
            if y is None or x is not None and a > b:
                undone, a = a, x[1]
            else:  # of equal ranks the left one merges first: b, and what crosses the border before b
                undone, b = b + 1, y[0]
        self.apart[key] = found
        return found

    def follow(self, state: int, byte: int) -> int:
        now = self.held[state] + bytes((byte,))
        while now and now not in self.beginnings:
            now = now[1:]
        number = self.numbers.get(now)
        if number is None:
            number = self.numbers[now] = len(self.held)
            self.held.append(now)
            self.ends.append([(r, len(now) - k) for k in range(len(now)) if (r := self.ranks.get(now[k:])) in self.halves])
        self.step[state << 8 | byte] = number
        return number

    def extend(self, data: bytes, last: list[int], stop: int, state: int | None = None) -> int:
        """Fill last[prefix length], the last token's rank, up to stop. state: the
        automaton's after the bytes that last covers; returns the one after stop."""
        step, ends, apart = self.step, self.ends, self.apart
        done = len(last) - 1
        if state is None:
            state = 0
            for byte in data[max(0, done - self.longest) : done]:
                got = step.get(state << 8 | byte)
                state = self.follow(state, byte) if got is None else got
        for end in range(done + 1, stop + 1):
            byte = data[end - 1]
            got = step.get(state << 8 | byte)
            state = self.follow(state, byte) if got is None else got
            for token, n in ends[state]:
                if n == end:
                    break
                if n < end:
                    before = last[end - n]
                    found = apart.get(before << 32 | token)
                    if found or found is None and self.stay_apart(before, token):
                        break
            else:
                raise ValueError(f"byte {byte} is not in the vocabulary")
            last.append(token)
        return state

    def tokens(self, last: list[int]) -> list[int]:
        """Ranks in order, read off the prefixes from the end."""
        out, end, of = [], len(last) - 1, self.bytes_of
        while end:
            out.append(last[end])
            end -= len(of[last[end]])
        return out[::-1]

    def _follow_all(self, key: np.ndarray) -> np.ndarray:
        state = self.steps.get(key)
        new = np.unique(key[state < 0])
        if len(new):
            got = np.array([self.follow(int(k) >> 8, int(k) & 255) for k in new], np.int32)
            self.steps.put(new, got)
            state = self.steps.get(key)
            most, have = max(map(len, self.ends)), self.ending.shape
            if len(self.ends) > have[1] or most > have[0]:
                wide = np.full((max(most, have[0]), max(2 * len(self.ends), have[1])), -1, np.int64)
                wide[: have[0], : have[1]] = self.ending
                self.ending = wide
            for s in got.tolist():
                self.ending[: len(self.ends[s]), s] = [t for t, _ in self.ends[s]]
        return state

    def _apart_all(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = before << np.int64(32) | token
        found = self.pairs.get(key)
        new = np.unique(key[found < 0])
        if len(new):
            if self.pairs.used >= CACHED_PAIRS:
                self.pairs = Numbers()
                return self._apart_all(before, token)
            self.pairs.put(new, np.array([self.stay_apart(k >> 32, k & (1 << 32) - 1) for k in new.tolist()], np.int32))
            self.apart.clear()
            found = self.pairs.get(key)
        return found > 0

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers: the last token
        of every prefix, all pieces' prefixes of one length together."""
        n = np.array([len(x) for x in pieces])
        order = np.argsort(-n, kind="stable")
        buf, begin = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), (np.cumsum(n) - n)[order]
        n = n[order]
        last = np.full((int(n[0]) + 1, len(n)), -1, np.int64)
        state = np.zeros(len(n), np.int64)
        for end in range(1, len(last)):
            k = int(np.searchsorted(-n, -end, "right"))
            state = self._follow_all(state[:k] << 8 | buf[begin[:k] + end - 1])
            left, j = np.arange(k), 0
            while len(left):
                if j == len(self.ending) or (token := self.ending[j, state[left]]).min() < 0:
                    raise ValueError("a byte is not in the vocabulary")
                before = last[end - self.length[token], left]
                good = before < 0
                inner = np.flatnonzero(~good)
                good[inner] = self._apart_all(before[inner], token[inner])
                last[end, left[good]] = token[good]
                left, j = left[~good], j + 1
        # read off from the ends
        rows, end, steps = np.arange(len(n)), n.copy(), []
        while len(rows):
            token = last[end[rows], rows]
            steps.append((rows, token))
            end[rows] -= self.length[token]
            rows = rows[end[rows] > 0]
        row, token = (np.concatenate(x) for x in zip(*steps, strict=True))
        place = np.concatenate([np.full(len(r), -i) for i, (r, _) in enumerate(steps)])
        token = token[np.lexsort((place, row))].astype("<u4").tobytes()
        stop = np.cumsum(np.bincount(row, minlength=len(n)))[np.argsort(order)] * 4
        size = np.bincount(row, minlength=len(n))[np.argsort(order)] * 4
        return [token[b - s : b] for b, s in zip(stop.tolist(), size.tolist(), strict=True)]


class PrefixTable:
    """The bytes of one piece and, for each prefix, the last token of its encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.state = vocabulary, b"", [-1], 0
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.state = self.vocabulary.extend(self.data, self.last, len(self.data), self.state)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put data in the place of start:stop; returns how many prefixes were computed."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        same, after, state = 0, start + len(data), None
        for end in range(start + 1, len(self.data) + 1):
            if same >= self.vocabulary.longest:  # what follows the edit reads the same from here on, and ends in the same state
                self.last += old[end - shift :]
                return end - start - 1
            state = self.vocabulary.extend(self.data, self.last, end, state)
            same = same + 1 if end > after and self.last[end] == old[end - shift] else 0
        self.state = self.vocabulary.extend(self.data, self.last, len(self.data)) if state is None else state
        return len(self.data) - start

    def ids(self) -> list[int]:
        return self.vocabulary.tokens(self.last)


class Encoder(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers; holds
    the pieces met lately. A piece that is a token is that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.before: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]):
        """(piece, ids), and whether to hold them."""
        some = []
        for piece in pieces:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            if whole is not None:
                yield piece, struct.pack("<I", whole), True
            elif len(data) <= LONGEST_CACHED:
                some.append((piece, data))
            else:
                last = [-1]
                self.vocabulary.extend(data, last, len(data), 0)
                yield piece, np.array(self.vocabulary.tokens(last), "<u4").tobytes(), False
        for i in range(0, len(some), BATCH):
            part = some[i : i + BATCH]
            for (piece, _), ids in zip(part, self.vocabulary.encode_all([x for _, x in part]), strict=True):
                yield piece, ids, True

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [self.split(x) for x in texts]
        met = set().union(*split)
        if len(self) + len(met) > GENERATION:
            self.before = dict(self)
            self.clear()
        for piece in met & self.before.keys():
            self[piece] = self.before[piece]
        once = []
        for piece, ids, hold in self._ids(sorted(met.difference(self))):
            self[piece] = ids
            if not hold:
                once.append(piece)
        out = [b"".join(map(self.__getitem__, x)) for x in split]
        for piece in once:
            del self[piece]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict = {}


def _encode(ranks, pattern: str, key: str):
    def run(batches):
        encoder = _encoders.get(key)
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[key] = Encoder(ranks.value, pattern)
        for part, raw in text_slices(batches, most=2 << 20):
            ids = encoder.encode_all([x.decode() for x in raw])
            kept = [i for i, f in enumerate(part.schema) if f.name != "text"]
            yield pa.record_batch(
                [part.column(i) for i in kept] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.binary())],
                [part.schema.field(i).name for i in kept] + ["n_tokens", "ids", "decoded"],
            )

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """For every row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit
    integers) and decoded (the bytes those ids stand for). The vocabulary, of a
    size given by its file, is read by the driver and broadcast.

    Every match of pattern is encoded by itself. Null texts count as empty and
    have no tokens; repeated rows are encoded alike; columns but doc_id and text
    are left out; an empty table gives an empty one."""
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return out.mapInArrow(_encode(ranks, pattern, f"{ranks_path}\n{pattern}"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def op9_bpe(spark, sf_dir):
    import public_tokenizers as vocabularies

    out = encode(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
