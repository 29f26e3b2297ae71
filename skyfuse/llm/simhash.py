"""SimHash near-dedup by the generalised pigeonhole principle.

Bits that vary together share a partition. If thresholds t_i over m partitions
add up to limit - m + 1, a pair within `limit` bits is within t_i in some
partition i; -1 skips a partition. Each fingerprint gets its own thresholds by
dynamic programming on estimated candidate counts, probes the partitions for
values within them, and the candidates are verified on all bits."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfuse.llm.common import materialize, ship, table, text_slices
from skyfuse.llm.components import components
from skyfuse.llm.rolling import Words, mix, normal

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints_of(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Of lower-cased normal texts: a bit is set if over half of the shingles' hashes have it."""
    words = Words(texts)
    counts = words.counts()
    buf = words.buf.tobytes()
    first = np.arange(max(0, len(words.doc) - shingle + 1))
    first = first[words.doc[first] == words.doc[first + shingle - 1]]
    starts, ends, docs = words.start[first], words.end[first + shingle - 1], words.doc[first]
    begin = np.concatenate([[0], np.cumsum(counts)])
    few = np.flatnonzero((counts > 0) & (counts < shingle))
    starts, ends = np.concatenate([starts, words.start[begin[few]]]), np.concatenate([ends, words.end[begin[few + 1] - 1]])
    docs = np.concatenate([docs, few])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(buf[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    n, out = np.bincount(docs, minlength=len(texts)), np.zeros(len(texts), np.uint64)
    for k, byte in enumerate(h.view(np.uint8).reshape(-1, 8).T):
        at = np.bincount(docs * 256 + byte, minlength=len(texts) * 256).reshape(-1, 256)
        for j, set_in in enumerate((at @ BITS).T):
            out |= (2 * set_in > n).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def _fingerprint(shingle: int):
    def run(batches):
        for part, raw in text_slices(batches, most=1 << 20):
            got = fingerprints_of([normal(x, lower=True) for x in raw], shingle)
            yield pa.record_batch([part.column(part.schema.get_field_index("doc_id")), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp as a signed long) for every row; null texts count as empty, without words: 0."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint(shingle), "doc_id long, fp long")


def _printed(shingle: int):
    def run(batches):
        for part, raw in text_slices(batches, most=1 << 20):
            yield pa.record_batch([part.column(0), part.column(1), pa.array(fingerprints_of([normal(x, lower=True) for x in raw], shingle).view(np.int64))], ["__id", "__h", "__print"])

    return run


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)


def _joint(batches):
    total = np.zeros((64, 64))
    for batch in batches:
        x = _bits(batch)
        total += x.T @ x
    yield pa.record_batch([pa.array(np.arange(4096), pa.int32()), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])


def partitions(joint: np.ndarray, total: int, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size; each grows by the bit most correlated with it."""
    p = np.diag(joint) / max(total, 1)
    cov = joint / max(total, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        own = corr[np.ix_(left, left)]
        group = [left[int(own.sum(1).argmax())]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].sum(1).argmax())])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def _values(fp: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for j, b in enumerate(group):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def _cell(values: np.ndarray, cells: int) -> np.ndarray:
    return (mix(values) % np.uint64(cells)).astype(np.int64)


def _spread(groups: list[list[int]], cells: int):
    """(part, value, fp) for each partition; with cells, how many fall in each hashed cell."""

    def index(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, g in enumerate(groups):
                yield pa.record_batch([pa.array(np.full(len(fp), i, np.int32)), pa.array(_values(fp, g).view(np.int64)), pa.array(fp.view(np.int64))], ["part", "value", "fp"])

    def count(batches):
        total = np.zeros((len(groups), cells), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, g in enumerate(groups):
                total[i] += np.bincount(_cell(_values(fp, g), cells), minlength=cells)
        at = np.flatnonzero(total.ravel())
        yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(total.ravel()[at])], ["cell", "n"])

    return index, count


def allocate(costs: list[np.ndarray], limit: int) -> np.ndarray:
    """costs[i][:, t + 1]: each query's cost of threshold t in partition i. The
    thresholds (queries x partitions) of least total cost that add up to limit - m + 1."""
    m, n = len(costs), len(costs[0])
    top = limit + 2  # choices: -1 .. limit
    goal = limit + 1  # sum of (t + 1) over the partitions
    best = np.full((n, goal + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for c in costs:
        new, pick = np.full((n, goal + 1), np.inf), np.zeros((n, goal + 1), np.int64)
        for s in range(goal + 1):
            for t in range(min(s + 1, top)):
                v = best[:, s - t] + c[:, t]
                better = v < new[:, s]
                new[better, s], pick[better, s] = v[better], t
        best = new
        picks.append(pick)
    out, s, rows = np.zeros((n, m), np.int64), np.full(n, goal), np.arange(n)
    for i in range(m - 1, -1, -1):
        out[:, i] = picks[i][rows, s] - 1
        s = s - picks[i][rows, s]
    return out


def _flips(width: int, limit: int) -> list[np.ndarray]:
    """Masks with exactly 0, 1, .. limit of `width` bits."""
    return [np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), r)], np.uint64) for r in range(limit + 1)]


def _probe(groups, limit, held, cells):
    def run(batches):
        counts = held.value
        masks = [_flips(len(g), limit) for g in groups]
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 2000):
                fp = whole[at : at + 2000]
                values = [_values(fp, g) for g in groups]
                costs = []
                for i, v in enumerate(values):
                    c = [np.zeros(len(fp))]
                    for mask in masks[i]:
                        near = counts[i][_cell((v[:, None] ^ mask).ravel(), cells)].reshape(len(fp), -1)
                        c.append(c[-1] + near.sum(1) + len(mask))  # a probe costs about as much as a candidate
                    costs.append(np.stack(c, 1))
                t = allocate(costs, limit)
                for i, v in enumerate(values):
                    for r, mask in enumerate(masks[i]):
                        own = t[:, i] >= r
                        if own.any():
                            probes = (v[own][:, None] ^ mask).ravel()
                            yield pa.record_batch([pa.array(np.full(len(probes), i, np.int32)), pa.array(probes.view(np.int64)), pa.array(np.repeat(fp[own], len(mask)).view(np.int64))], ["part", "value", "fp"])

    return run


def probes_of(m: int, limit: int) -> int:
    """How many values a fingerprint probes over m partitions, if their thresholds are as even as can be."""
    goal = limit - m + 1
    t = [goal // m + (i < goal % m) for i in range(m)]
    return sum(math.comb(64 // m, r) for x in t for r in range(x + 1))


def parts_for(n: int, limit: int) -> int:
    """The number of partitions whose probes and expected candidates, of n fingerprints, are fewest."""
    return min(range(1, limit + 2), key=lambda m: probes_of(m, limit) * (1 + n / 2.0 ** (64 // m)))


def hamming_links(distinct: DataFrame, limit: int = 2, m: int | None = None, cells: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) that differ in
    1 to `limit` bits. m, by default by the number of fingerprints: partitions. The
    driver gets 64 x 64 joint bit counts and m x cells candidate counts, of 2**20
    cells at most."""
    spark = distinct.sparkSession
    only = distinct.select("fp")
    n = only.count()
    m = m or parts_for(n, limit)
    cells = cells or min(1 << 20, max(1 << 16, 1 << (n // 4).bit_length()))
    joint = np.zeros(4096)
    for r in only.mapInArrow(_joint, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        joint[r["cell"]] = r["n"]
    groups = partitions(joint.reshape(64, 64), n, m)
    index, count = _spread(groups, cells)
    found = np.zeros(m * cells, np.int64)
    for r in only.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        found[r["cell"]] = r["n"]
    held = spark.sparkContext.broadcast(found.reshape(m, cells))
    data = only.mapInArrow(index, "part int, value long, fp long").withColumnRenamed("fp", "b")
    probes = only.mapInArrow(_probe(groups, limit, held, cells), "part int, value long, fp long").withColumnRenamed("fp", "a")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit
    return probes.join(data, ["part", "value"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def simhash_dedup(docs: DataFrame, limit: int = 2, shingle: int = 3) -> DataFrame:
    """Every row's (doc_id, fp, component_id): fingerprints link at `limit` or
    fewer differing bits, component_id is the smallest doc_id reachable.

    Equal fingerprints are one node, so copies are never compared. Null and
    empty texts share fingerprint 0; repeated rows come out as often as they went
    in; other columns are ignored; a component without any doc_id has a null
    component_id; an empty table gives an empty one."""
    own = materialize(fingerprints(docs, shingle))
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(hamming_links(distinct, limit))
    node = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    node = materialize(node)
    least = materialize(node.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of"))
    named = materialize(node.join(least, node["root"] == least["of"]).select(F.col("fp").alias("of_fp"), "component_id"))
    return own.join(named, own["fp"] == named["of_fp"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, limit: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest; of rows of equal id
    and text one. Where one doc_id stands on texts of unlike fingerprints, each counts by
    itself. Rows without an id stay, one of each text, where none of their component
    has an id. Names that begin with __ are reserved."""
    kept = simhash_dedup(docs, limit, shingle).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialize(kept.select(F.col("doc_id").alias("__kept"), F.col("fp").alias("__fp")).distinct())
    text = F.col("text").cast("string")
    # a row's fingerprint by its id and text: computed once for each
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__h"), text.alias("text")).dropDuplicates(["__id", "__h"])
    own = rows.mapInArrow(_printed(shingle), "__id long, __h long, __print long")
    taken = own.join(kept, F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__print") == F.col("__fp"))).select("__id", "__h")
    hashed = docs.withColumn("__text", F.xxhash64(text))
    return hashed.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h")), "left_semi").dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def op4_simhash(spark, sf_dir):
    out = simhash_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
