"""Exact top-k search by term-at-a-time accumulation.

Candidate rows stay where they are, in shards of bounded size that hold postings
by term (row numbers and weights). Queries come to all shards in broadcast blocks
of bounded size, one round a block; a query scatters weight * posting into a dense
score array for one term after the other, a partition selection keeps its k best
there, and the shards' answers merge in one aggregation a round.

Weights are whole numbers in doubles, over 64, so any finite component is exact.
Where products could pass a long, whole numbers of any size take their place."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfuse.llm.common import materialize, ship, table

SHARD_ROWS = 16384
QUERY_BYTES = 32 << 20  # of one round's queries, about


def _sparse(batches):
    """(id, terms, weights / 64) of the rows that take part."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        rows = batch.filter(pc.and_(ids.is_valid(), vectors.is_valid()))
        ids, vectors = rows.column(0), rows.column(1)
        if not len(ids):
            continue
        ends = vectors.offsets.to_numpy().astype(np.int64)
        flat = vectors.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(ids)), np.diff(ends))
        bad = ~np.isfinite(x) | flat.is_null().to_numpy(zero_copy_only=False)
        good = np.bincount(row[bad], minlength=len(ids)) == 0
        with np.errstate(over="ignore", invalid="ignore"):
            w = np.where(np.abs(x) < 2.0**53, np.floor(64 * x) / 64, x)  # from there on 64 * x is whole
        term = np.arange(len(x)) - ends[row]
        kept = good[row] & (w != 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(ids)))]).astype(np.int32))
        out = pa.record_batch([ids, pa.ListArray.from_arrays(offsets, pa.array(term[kept].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(w[kept]))], ["id", "terms", "weights"])
        yield out.filter(pa.array(good))


def sparse_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, terms, weights) with weights floor(64 * x) / 64, zeros left out. Rows
    without an id, and vectors that are null or hold null or non-finite components,
    are left out. Ids that are no whole numbers raise an error."""
    ship(vectors.sparkSession)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_sparse, "id long, terms array<int>, weights array<double>")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids; terms and weights of all rows on end; where each row's begin."""
    ends = batch.column(1).offsets.to_numpy().astype(np.int64)
    return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(), ends - ends[0]


def _whole(weights: np.ndarray) -> np.ndarray:
    """64 * weights as whole numbers of any size."""
    out = np.empty(len(weights), object)
    out[:] = [n * 64 // d for n, d in (w.as_integer_ratio() for w in weights.tolist())]
    return out


def _large(weights: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows whose products with others that are not large could pass 2**62 in sum: none if not in here."""
    out = np.zeros(len(begin) - 1, bool)
    full = np.flatnonzero(begin[1:] > begin[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(np.abs(weights), begin[full]) * np.sqrt(np.diff(begin)[full]) > 2.0**25
    return out


class Shard:
    """Postings of some rows in ascending order of their ids, by term."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, begin: np.ndarray, exact: bool):
        """exact: weights are whole numbers of any size, else they fit in a long."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, row = ids[order], place[np.repeat(np.arange(len(ids)), np.diff(begin))]
        values = _whole(weights) if exact else (64 * weights).astype(np.int64)
        self.kind = object if exact else np.int64
        by = np.argsort(terms, kind="stable")
        ends = np.cumsum(np.bincount(terms, minlength=int(terms.max()) + 1 if len(terms) else 1))
        self.postings = [(row[p], values[p]) for p in np.split(by, ends[:-1])]

    def best(self, query: int, terms, weights, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows' ids and scores, ties to the smaller id, without rows of the query's id."""
        score = np.zeros(len(self.ids), self.kind)
        for t, w in zip(terms, weights, strict=True):
            if t < len(self.postings):
                at, values = self.postings[t]
                score[at] = score[at] + w * values  # a row has a term once
        ids = self.ids
        a, b = np.searchsorted(ids, query, "left"), np.searchsorted(ids, query, "right")
        if a < b:
            ids, score = np.delete(ids, slice(a, b)), np.delete(score, slice(a, b))
        if len(ids) > k:
            cut = np.partition(score, len(ids) - k)[len(ids) - k]
            above, even = np.flatnonzero(score > cut), np.flatnonzero(score == cut)
            pick = np.concatenate([above, even[: k - len(above)]])  # ids ascend
            ids, score = ids[pick], score[pick]
        return ids, score


def _parts(rows: tuple, chosen: np.ndarray) -> tuple:
    ids, terms, weights, begin = rows
    inside = np.repeat(chosen, np.diff(begin))
    return ids[chosen], terms[inside], weights[inside], np.concatenate([[0], np.cumsum(np.diff(begin)[chosen])]).astype(np.int64)


def _search(held, k: int):
    def found(batches: list[pa.RecordBatch]):
        rows = _lists(pa.Table.from_batches(batches).combine_chunks().to_batches()[0])
        large = _large(rows[2], rows[3])
        small, big = _parts(rows, ~large), _parts(rows, large)
        fast, slow = Shard(*small, False), Shard(*big, True) if large.any() else None
        whole = None
        ids, terms, weights, begin = held.value
        large = _large(weights, begin)
        out = [[], [], []]
        for i, (q, s, e) in enumerate(zip(ids.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            own = terms[s:e]
            got = []
            if large[i]:
                whole = whole or Shard(*small, True)
                got.append(whole.best(q, own, _whole(weights[s:e]), k))
            else:
                got.append(fast.best(q, own, (64 * weights[s:e]).astype(np.int64), k))
            if slow:
                got.append(slow.best(q, own, _whole(weights[s:e]), k))
            for found_ids, scores in got:
                out[0] += [q] * len(found_ids)
                out[1] += found_ids.tolist()
                out[2] += scores.tolist()
        over = [(x > 2**63 - 1) - (x < -(2**63)) for x in out[2]]
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(over, pa.int32()), pa.array([0 if o else x for x, o in zip(out[2], over, strict=True)], pa.int64())], ["query_id", "vec_id", "over", "score"])

    def run(batches):
        some, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                some.append(batch.slice(at, SHARD_ROWS))
                n += some[-1].num_rows
                if n >= SHARD_ROWS:
                    yield from found(some)
                    some, n = [], 0
        if n:
            yield from found(some)

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of queries the k rows of vectors with the highest integer
    inner product of floor(64 * x), all if fewer: query_id, rank (from 1), vec_id,
    score. Ties go to the smaller id; a row with the query's own id is no candidate of
    it. Repeated rows are candidates each; a repeated query id is one query, that with
    the least vector. Rows without an id or without a whole finite vector take no
    part; vectors may differ in length; further columns are left out; empty tables
    give none. Components of any size count exactly; a score among the k best that no
    long holds raises an error. A round holds QUERY_BYTES of queries, a shard
    SHARD_ROWS rows, whatever the tables' size."""
    spark = vectors.sparkSession
    data = materialize(sparse_rows(vectors, id_col, vector_col))
    one = sparse_rows(queries, id_col, vector_col).groupBy("id").agg(F.min(F.struct("terms", "weights")).alias("v"))
    asked = materialize(one.select("id", "v.terms", "v.weights"))
    said = asked.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).head()
    rounds = max(1, -(-(12 * (said["terms"] or 0) + 16 * said["n"]) // QUERY_BYTES))
    answers = []
    for i in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == i).toArrow().combine_chunks()
        parts = block.to_batches()
        held = spark.sparkContext.broadcast(_lists(parts[0]) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(1, np.int64)))
        found = data.mapInArrow(_search(held, k), "query_id long, vec_id long, over int, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), "vec_id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        fits = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("a score of query "), F.col("query_id").cast("string"), F.lit(" does not fit in a long"))).cast("long"))
        best = best.select("query_id", "rank", "vec_id", fits.alias("score"))
        answers.append(best if rounds == 1 else materialize(best))
    return reduce(DataFrame.union, answers)


def op10_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk(vectors, vectors.where(F.col("vec_id") % 20 == 0))
