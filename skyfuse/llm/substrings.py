"""Substring dedup: Rabin-Karp hashes of every window of words, counted in
Spark; windows seen twice or more merge into maximal removal intervals.

The texts are packed, compressed, into chunks that are written to the shared
folder once. Each chunk sends its distinct hashes to buckets of the hash space, as
one binary value per bucket (a few bytes a window, no row for each); a bucket sorts
what it got and answers each chunk with one bit per hash. A common window comes
once per chunk, so no bucket depends on it more than on others.

Rolling hashes modulo 2**64 alone can be equal for unlike windows, so they are
mixed with a second hash of the words, and as many bits are sent as make it
unlikely (1 in 100,000) that any two unlike windows of the whole table agree."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfuse.llm.common import materialize, parallelism, ship, table, text_slices
from skyfuse.llm.rolling import Words, normal

PART = 2 << 20
BUCKET = 1 << 24  # windows that a bucket gets, about, at most


def _pack(most: int):
    def run(batches):
        def chunk(ids, texts):
            data = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], ["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(data)
            return pa.record_batch([pa.array([random.SystemRandom().getrandbits(63)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([sum(x.count(b" ") + 1 for x in texts)], pa.int64())], ["chunk", "payload", "words"])

        ids, texts, held = [], [], 0
        for part, raw in text_slices(batches, most=PART):
            words = [normal(x) for x in raw]
            n = sum(map(len, words))
            if held and held + n > most:
                yield chunk(ids, texts)
                ids, texts, held = [], [], 0
            ids += part.column(part.schema.get_field_index("doc_id")).to_pylist()
            texts += words
            held += n
        if ids:
            yield chunk(ids, texts)

    return run


def _unpack(payload: bytes) -> tuple[list, list[bytes]]:
    got = pa.ipc.open_stream(payload).read_all()
    return got["doc_id"].to_pylist(), got["text"].to_pylist()


def _runs(texts: list[bytes]):
    """Index ranges of texts of about PART bytes."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > PART:
            yield start, i
            start, held = i, 0
        held += len(x) + 1
    yield start, len(texts)


class Hashes:
    """The windows of a chunk: order sorts them by hash, of[i] is the place of window
    i's hash among the distinct ones, and packed holds these as bytes. begin: where
    each bucket begins there."""

    def __init__(self, texts: list[bytes], window: int, bits: int, width: int):
        parts = [Words(texts[i:j]).windows(window) for i, j in _runs(texts)]
        high, low = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(high, kind="stable")
        a, b = high[order], low[order]
        if width > 8 and (tie := np.flatnonzero(a[1:] == a[:-1])).size and (b[tie + 1] != b[tie]).any():
            order = np.lexsort((low, high))
            a, b = high[order], low[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1] if width > 8 else False)
        self.of = np.empty(len(a), np.int64)
        self.of[order] = np.cumsum(new) - 1
        a, b = a[new], b[new]
        self.repeated = np.bincount(self.of, minlength=len(a)) > 1
        bytes_ = np.concatenate([a[:, None].view(np.uint8), b[:, None].view(np.uint8)], 1) if width > 8 else a[:, None].view(np.uint8)
        self.packed = np.ascontiguousarray(bytes_[:, :width])
        self.begin = np.searchsorted(a >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _send(window: int, bits: int, width: int):
    def run(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = Hashes(_unpack(payload)[1], window, bits, width)
                full = np.flatnonzero(h.begin[1:] > h.begin[:-1]).tolist()
                if full:
                    yield pa.record_batch([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([h.packed[h.begin[b] : h.begin[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "chunk", "hashes"])

    return run


def _answer(width: int):
    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in group["hashes"].to_pylist()]
        every = np.zeros((sum(map(len, parts)), 16 if width > 8 else 8), np.uint8)
        every[:, :width] = np.concatenate(parts)
        h = every.view(np.uint64)
        order = np.argsort(h[:, 0], kind="stable") if width <= 8 else np.lexsort((h[:, 1], h[:, 0]))
        same = (h[order[1:]] == h[order[:-1]]).all(1)
        flag = np.zeros(len(h), bool)
        flag[order[1:]] |= same
        flag[order[:-1]] |= same
        out, at = [], 0
        for p in parts:
            out.append(np.packbits(flag[at : at + len(p)]).tobytes())
            at += len(p)
        return pa.table({"bucket": group["bucket"], "chunk": group["chunk"], "flags": pa.array(out, pa.binary())})

    return run


def _remove(window: int, bits: int, width: int):
    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = dict(zip(right["bucket"], right["flags"], strict=True))
        outs = []
        for payload in left["payload"]:
            ids, texts = _unpack(payload)
            h = Hashes(texts, window, bits, width)
            for b, bits_of in found.items():
                i, j = h.begin[b], h.begin[b + 1]
                h.repeated[i:j] |= np.unpackbits(np.frombuffer(bits_of, np.uint8), count=j - i).astype(bool)
            repeated = h.repeated[h.of]
            n_words, cuts, kept, at = [], [], [], 0
            for x in texts:
                n = x.count(b" ") + 1 if x else 0
                m = max(0, n - window + 1)
                hit = np.flatnonzero(repeated[at : at + m])
                at += m
                n_words.append(n)
                if not len(hit):
                    cuts.append([])
                    kept.append(x)
                    continue
                gap = np.flatnonzero(hit[1:] > hit[:-1] + window)
                starts, ends = hit[np.concatenate([[0], gap + 1])], hit[np.concatenate([gap, [len(hit) - 1]])] + window
                cuts.append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends, strict=True)])
                words = x.split(b" ")
                for s, e in zip(starts[::-1], ends[::-1], strict=True):
                    del words[s:e]
                kept.append(b" ".join(words))
            outs.append(pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": n_words, "removed": cuts, "kept_text": [k.decode() for k in kept]}))
        return pd.concat(outs) if outs else pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_words": [], "removed": [], "kept_text": []})

    return run


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """Remove from each text every word covered by a window of `window` words
    whose words also start anywhere else in the table, the same text included.

    docs needs doc_id and text; other columns are left out. Returns one row per
    row of docs: doc_id, n_words, removed (maximal intervals of word numbers, end
    exclusive) and kept_text (kept words joined by one space). A null or empty
    text has no words; shorter texts than the window stay; of repeated rows all
    long ones lose all words; ids that are no whole numbers raise an error; an empty
    table gives an empty one. A text is held whole by one task, in memory of some
    ten times its size."""
    spark = docs.sparkSession
    ship(spark)
    least = max(4, (2 * parallelism(spark) - 1).bit_length())
    most = min(max(PART, 2048 << least), 64 << 20)
    packed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(most), "chunk long, payload binary, words long"))
    n = packed.agg(F.sum("words")).head()[0] or 1
    bits = max(least, (n // BUCKET).bit_length())
    width = min(16, max(6, -(-(2 * n.bit_length() + 16 - bits) // 8)))
    chunks = packed.select("chunk", "payload")
    sent = chunks.mapInArrow(_send(window, bits, width), "bucket int, chunk long, hashes binary")
    flags = sent.groupBy("bucket").applyInArrow(_answer(width), "bucket int, chunk long, flags binary")
    return chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(_remove(window, bits, width), "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept_text string")


def op6_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
