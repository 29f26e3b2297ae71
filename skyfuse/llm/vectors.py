"""Embedding near-dedup by NN-descent.

Equal vectors are one node. Lists of nearest neighbours start from blocks of
random hyperplane codes (split by further planes where a block is large), then
improve: the neighbours of a node, in both directions, are compared with each other,
and each list keeps the best. A list full of links is saturated and doubles; what is
saturated still in the end is compared with its whole component, block by block,
without a row for each pair. An audit compares a sample of nodes, large enough to hold
links, with all others; as long as links are missing, more blocks are drawn, twice as
many each time, and the lists improve further. If that does not bring the recall
either, all nodes of a label are compared in blocks. Links are the pairs found whose
cosine, in double precision, is high enough."""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfuse.llm.common import discard, materialize, ship, table
from skyfuse.llm.components import components

K, MOST_K = 10, 40  # lengths of neighbour lists; what is full at MOST_K is compared exactly
BLOCK = 256
CODE_BITS = 48
AUDITED = 200  # nodes at least
AUDIT_LINKED = 300  # nodes with links that the audit wants to see
AUDIT_WORK = 1 << 32  # comparisons that a larger audit may take
AUDIT_BYTES = 32 << 20  # of the audited vectors, which are broadcast
RECALL = 0.99
ATTEMPTS = 5
EXHAUSTIVE = 1024, 8192  # rows compared at once, in groups up to 64 times as large and in larger ones
ROWS = 512

log = logging.getLogger(__name__)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _coded(dim: int, rounds: range):
    def run(batches):
        planes = [np.random.default_rng(r).standard_normal((dim, CODE_BITS)) for r in rounds]
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(2), dim))
                for r, p in zip(rounds, planes, strict=True):
                    code = ((x @ p > 0) << np.arange(CODE_BITS, dtype=np.int64)).sum(1)
                    yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.full(len(x), r, np.int32)), pa.array(code.astype(np.int64)), batch.column(2)], ["id", "grp", "round", "code", "vec"])

    return run


def _pairs(ids, sims, k: int) -> pd.DataFrame:
    """Each row's k best of the others."""
    np.fill_diagonal(sims, -2)
    n = len(ids)
    if n < 2:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "sim": np.zeros(0)})
    k = min(k, n - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return pd.DataFrame({"a": np.repeat(ids, k), "b": ids[best].ravel(), "sim": np.take_along_axis(sims, best, 1).ravel()})


def _in_block(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(group["vec"].to_numpy()).astype(np.float64))
        return _pairs(group["id"].to_numpy(np.int64), x @ x.T, k)

    return run


def _local_join(dim: int):
    """Compare the members of each pivot; members: id, whether the link is new, the
    worst similarity on its list so far, vector."""

    def run(batches):
        for batch in batches:
            members = batch.column(0)
            ends = members.offsets.to_numpy()
            flat = members.flatten()
            ids, new, worst = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = _unit(_matrix(flat.field(3), dim)) if len(flat) else np.zeros((0, dim))
            base = ends[0]
            out = []
            for s, e in zip(ends[:-1] - base, ends[1:] - base, strict=True):
                sims = x[s:e] @ x[s:e].T
                better = (new[s:e, None] | new[None, s:e]) & ((sims > worst[s:e, None]) | (sims > worst[None, s:e]))
                i, j = np.nonzero(np.triu(better, 1))
                if len(i):
                    out.append((ids[s:e][i], ids[s:e][j], sims[i, j]))
            if out:
                a, b, sim = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.record_batch([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([sim, sim]))], ["a", "b", "sim"])

    return run


def _best(found: DataFrame, limits: DataFrame | None) -> DataFrame:
    """found: (a, b, sim, new), pairs perhaps more than once. The best of each a, by
    its own limit, with rank and limit."""
    one = found.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    if limits is None:
        own = one.withColumn("limit", F.lit(K))
    else:
        own = one.join(limits.withColumnRenamed("a", "of"), F.col("a") == F.col("of"), "left").drop("of").withColumn("limit", F.coalesce("limit", F.lit(K)))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return materialize(ranked.where(F.col("rank") <= F.col("limit")))


def _limits(graph: DataFrame, least: float) -> DataFrame:
    """A saturated list's limit doubles, up to MOST_K."""
    full = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("worst"), F.max("limit").alias("limit"))
    saturated = (F.col("n") >= F.col("limit")) & (F.col("worst") >= least)
    return full.select("a", F.when(saturated, F.least(F.col("limit") * 2, F.lit(MOST_K))).otherwise(F.col("limit")).alias("limit"), F.when(F.col("n") >= F.col("limit"), F.col("worst")).otherwise(-2.0).alias("worst"), saturated.alias("saturated"))


def _improve(graph: DataFrame, nodes: DataFrame, dim: int, least: float) -> DataFrame:
    while True:
        limits = materialize(_limits(graph, least))
        own = graph.select(F.col("a").alias("pivot"), F.col("b").alias("member"), "sim", "new")
        back = graph.select(F.col("b").alias("pivot"), F.col("a").alias("member"), "sim", "new")
        near = own.union(back).groupBy("pivot", "member").agg(F.max("sim").alias("sim"), F.max("new").alias("new"))
        # new links first: links compared before need no second look
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("new"), F.desc("sim"), "member"))).where(F.col("place") <= 3 * K)
        held = nodes.select(F.col("id").alias("member"), "vec").join(limits.select(F.col("a").alias("of"), "worst"), F.col("member") == F.col("of"))
        joined = near.join(held.drop("of"), "member")
        lists = joined.groupBy("pivot").agg(F.collect_list(F.struct("member", "new", "worst", "vec")).alias("members"), F.max("new").alias("any")).where("any").select("members")
        seen = lists.mapInArrow(_local_join(dim), "a long, b long, sim double").withColumn("new", F.lit(True))
        last, graph = graph, _best(graph.select("a", "b", "sim", F.lit(False).alias("new")).union(seen.select("a", "b", "sim", "new")), limits.select("a", "limit"))
        discard(last, limits)
        got = graph.agg(F.count(F.when(F.col("new"), 1)).alias("new"), F.count(F.when(F.col("new") & (F.col("sim") >= least), 1)).alias("links"), F.count("*").alias("all")).head()
        if not got["links"] or got["new"] <= 0.01 * got["all"]:
            return graph


def _least_reached(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that links between two blocks reach, from each row of either."""
    top = np.iinfo(np.int64).max
    while True:
        far = np.minimum(right, np.where(linked, left[:, None], top).min(0, initial=top))
        near = np.minimum(left, np.where(linked, far[None, :], top).min(1, initial=top))
        if (near == left).all() and (far == right).all():
            return left, right
        left, right = near, far


def _count_links(least: float, reached: bool = False):
    """Per row of left: links to rows of right, with their copies, and, if asked for, the least id they reach."""

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "first": np.zeros(0, np.int64)})
        x, y = (_unit(np.stack(p["vec"].to_numpy()).astype(np.float64)) for p in (left, right))
        ids, others, copies = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64), right["copies"].to_numpy(np.int64)
        first, far, n = ids.copy(), others.copy(), np.zeros(len(ids), np.int64)
        again = True
        while again:  # in strips of ROWS rows; once more where what one strip reached may change another
            before = first.copy(), far.copy()
            for s in range(0, len(ids), ROWS):
                part = slice(s, s + ROWS)
                linked = (x[part] @ y.T >= least) & (ids[part, None] != others)
                n[part] = linked @ copies
                if reached:
                    first[part], far = _least_reached(linked, first[part], far)
            again = reached and len(ids) > ROWS and not ((before[0] == first).all() and (before[1] == far).all())
        return pd.DataFrame({"id": ids, "n": n, "first": first})

    return run


def _in_blocks(rows: DataFrame, least: float, reached: bool = False) -> DataFrame:
    """rows: (root, id, vec, copies). All rows of a root are compared, a pair of blocks at a time: (id, n, first)."""
    size = F.when(F.count("*") <= 64 * EXHAUSTIVE[0], EXHAUSTIVE[0]).otherwise(EXHAUSTIVE[1])
    sizes = rows.groupBy("root").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")).withColumnRenamed("root", "of")
    dealt = materialize(rows.join(sizes, F.col("root") == F.col("of")).drop("of").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.withColumn("other", every)
    again = [F.col(c).alias("other" if c == "part" else c) for c in dealt.columns]  # as columns of their own: a cogroup takes those of one name for one
    right = dealt.select(*again).withColumn("part", every)
    found = left.groupBy("root", "part", "other").cogroup(right.groupBy("root", "part", "other")).applyInPandas(_count_links(least, reached), "id long, n long, first long")
    return found


def _compared(nodes: DataFrame, least: float) -> DataFrame:
    """(id, n, root) of all linked nodes, by comparing all of a group."""
    found = materialize(_in_blocks(nodes.select(F.col("grp").alias("root"), "id", "vec", "copies"), least, True))
    roots = components(found.where("first <> id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    n = found.groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")
    return materialize(n.join(roots, n["id"] == roots["node"]).select("id", "n", "root"))


def _linked(graph: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(id, n, root): links to other nodes, each counted with its copies, and the component."""
    links = materialize(graph.where(F.col("sim") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = components(links)
    saturated = materialize(_limits(graph, least).where("saturated").select(F.col("a").alias("node")).join(roots, "node").select(F.col("root").alias("full")).distinct())
    both = links.union(links.select("b", "a")).toDF("a", "b")
    sparse = roots.join(saturated, roots["root"] == saturated["full"], "left_anti").select(F.col("node").alias("a"))
    copies = nodes.select(F.col("id").alias("b"), "copies")
    counted = both.join(sparse, "a", "left_semi").join(copies, "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("n"))
    inside = roots.join(saturated, roots["root"] == saturated["full"]).select("node", "root").join(nodes, F.col("node") == nodes["id"]).select("root", "id", "vec", "copies")
    dense = _in_blocks(inside, least).groupBy("id").agg(F.sum("n").alias("n"))
    n = counted.union(dense.select("id", "n"))
    return materialize(n.join(roots, n["id"] == roots["node"]).select("id", "n", "root"))


def _truth(nodes: DataFrame, share: float, dim: int, least: float) -> dict[int, int]:
    """For a share of the nodes, by their hash, how many links they have: compared with all others."""
    chosen = nodes.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "grp", "vec").toArrow().combine_chunks()
    if not chosen.num_rows:
        return {}
    sample = chosen["id"].to_numpy(), chosen["grp"].to_numpy(), _unit(_matrix(chosen["vec"], dim))
    held = nodes.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        ids, groups, q = held.value
        total = np.zeros(len(ids), np.int64)
        step = max(1, (1 << 22) // len(ids))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                hit = (q @ _unit(_matrix(part.column(2), dim)).T >= least) & (groups[:, None] == part.column(1).to_numpy()) & (ids[:, None] != part.column(0).to_numpy())
                total += hit @ part.column(3).to_numpy()
        yield pa.record_batch([pa.array(ids), pa.array(total)], ["id", "n"])

    told = nodes.select("id", "grp", "vec", "copies").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(told["id"].to_pylist(), told["n"].to_pylist(), strict=True))


def _sample(nodes: DataFrame, total: int, dim: int, least: float) -> dict[int, int]:
    """True links of audited nodes: at least AUDITED, and more until AUDIT_LINKED of them
    have links or the work, or the vectors to broadcast, would pass their bounds."""
    most = max(AUDITED, min(AUDIT_WORK // max(total, 1), AUDIT_BYTES // (8 * dim)))
    size = min(AUDITED, total)
    while True:
        true = _truth(nodes, min(1.0, 1.2 * size / total if size < total else 1.0), dim, least)
        if size >= min(total, most) or sum(n > 0 for n in true.values()) >= AUDIT_LINKED:
            return true
        size = min(total, most, 16 * size)


def _recall(true: dict[int, int], linked: DataFrame) -> float:
    """The least of the mean shares of links found, over nodes of few links and of many.
    A node counts as one whatever its number of links, so large groups hide nothing."""
    spark = linked.sparkSession
    few = spark.createDataFrame([(i,) for i, n in true.items() if n] or [], "id long")
    got = {r["id"]: r["n"] for r in linked.join(F.broadcast(few), "id").select("id", "n").collect()}
    shares = [[min(got.get(i, 0), n) / n for i, n in true.items() if low < n <= high] for low, high in ((0, K), (K, math.inf))]
    return min((sum(x) / len(x) for x in shares if x), default=1.0)


def _rounds(largest: int, least: float) -> int:
    """Rounds of blocks after which a pair at the threshold has shared one with probability 0.95."""
    bits = max(0, math.ceil(math.log2(max(largest, 1) / BLOCK)))
    together = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits
    return 1 if together >= 0.95 else math.ceil(math.log(0.05) / math.log(1 - together))


def _blocks(nodes: DataFrame, rounds: range, dim: int) -> tuple[DataFrame, DataFrame]:
    """The table that it is made from, and (id, vec) dealt to blocks: grp, round, block, part. Groups are parted by as many
    planes as they need for blocks of BLOCK; blocks that are larger still by more planes,
    and what no plane parts, by chance."""
    coded = materialize(nodes.select("id", "grp", "vec").mapInArrow(_coded(dim, rounds), "id long, grp long, round int, code long, vec array<double>"))
    needed = lambda size: F.greatest(F.lit(0), F.ceil(F.log2(size / BLOCK))).cast("int")
    sizes = nodes.groupBy(F.col("grp").alias("g")).agg(needed(F.count("*")).alias("bits"))
    block = F.col("code").bitwiseAND(F.expr(f"shiftleft(1L, least({CODE_BITS}, bits)) - 1"))
    out = coded.join(sizes, F.col("grp") == F.col("g")).withColumn("block", block).drop("g")
    for _ in range(2):
        crowded = out.groupBy(F.col("grp").alias("g"), F.col("round").alias("r"), F.col("block").alias("k")).agg(needed(F.count("*") / 2).alias("more")).where("more > 0")
        out = out.join(crowded, (F.col("grp") == F.col("g")) & (F.col("round") == F.col("r")) & (F.col("block") == F.col("k")), "left").drop("g", "r", "k")
        out = out.withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0))).drop("more").withColumn("block", F.xxhash64(block, "bits"))
    counts = out.groupBy(F.col("grp").alias("g"), F.col("round").alias("r"), F.col("block").alias("k")).agg(F.ceil(F.count("*") / (4 * BLOCK)).alias("parts")).where("parts > 1")
    out = out.join(counts, (F.col("grp") == F.col("g")) & (F.col("round") == F.col("r")) & (F.col("block") == F.col("k")), "left")
    return coded, out.withColumn("part", F.pmod(F.xxhash64("id", "round"), F.coalesce("parts", F.lit(1)))).select("id", "grp", "round", "block", "part", "vec")


def _search(nodes: DataFrame, dim: int, least: float, recall: float) -> DataFrame:
    """(id, n, root) of all linked nodes."""
    total = nodes.count()
    largest = nodes.groupBy("grp").count().agg(F.max("count")).head()[0] or 0
    true = _sample(nodes, total, dim, least)
    graph, done, rounds = None, 0, _rounds(largest, least)
    for attempt in range(ATTEMPTS):
        coded, blocks = _blocks(nodes, range(done, done + rounds), dim)
        first = blocks.groupBy("grp", "round", "block", "part").applyInPandas(_in_block(K), "a long, b long, sim double").withColumn("new", F.lit(True))
        if graph is not None:
            first = graph.select("a", "b", "sim", F.lit(False).alias("new")).union(first)
        start = _best(first, None if graph is None else _limits(graph, least).select("a", "limit"))
        discard(coded, graph)
        graph = _improve(start, nodes, dim, least)
        linked = _linked(graph, nodes, least)
        found = _recall(true, linked)
        log.info("%d vectors of length %d, %d audited: recall %.4f after %d rounds", total, dim, len(true), found, done + rounds)
        if found >= recall:
            return linked
        done, rounds = done + rounds, 2 * rounds
    log.warning("recall %.4f after %d rounds: comparing all vectors of a label", found, done)
    return _compared(nodes, least)


def near_duplicates(vectors: DataFrame, least: float = 0.93, recall: float = RECALL) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links and
    component_id, the smallest vec_id reachable.

    Only vectors of equal, non-null labels link. Vectors that are null, zero or
    hold null or non-finite components link with nothing; neither do rows without a
    vec_id (their component is null). Vectors of different length don't link. A
    repeated row counts once and comes out as often as it went in; further columns
    are left out; ids that are no whole numbers raise an error; an empty table gives
    an empty one. recall: what an audit must find of the links, per node, before the
    search ends; below it everything is compared, so it holds in the end. The audit
    sees 300 nodes with links, unless that takes over 2**32 comparisons."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"), "label")
    good = rows.where(sound).dropDuplicates(["vec_id", "label", "embedding"])
    spread = materialize(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    # lengths up to the same power of two are searched together: zeros at the end change no cosine
    wide = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("embedding")))).cast("int")
    linked = None
    for dim in [r["d"] for r in spread.groupBy(wide.alias("d")).count().collect()]:
        vec = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("embedding")))
        nodes = materialize(spread.where(wide == dim).select("id", F.xxhash64("label", F.size("embedding")).alias("grp"), vec.alias("vec"), "copies"))
        got = _search(nodes, dim, least, recall)
        linked = got if linked is None else linked.union(got)
    if linked is None:
        linked = spark.createDataFrame([], "id long, n long, root long")
    member = good.join(spread.select("id", "copies", F.col("label").alias("l"), F.col("embedding").alias("e")), (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "id", "copies")
    named = member.join(linked.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select(
        F.col("vec_id").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")
    )
    one = materialize(named.groupBy("v").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")))
    return rows.select("vec_id").join(one, F.col("vec_id") == F.col("v"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op3_embeddings(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
